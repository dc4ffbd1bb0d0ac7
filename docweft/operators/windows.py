"""Order-dependent operators on rows of a group, as window plans. ``key`` are the group's columns, ``pos`` is its order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import joins as J


def line(key: list[str], *pos):
    return Window.partitionBy(*key).orderBy(*pos)


def before(key: list[str], *pos):
    """All rows before this one."""
    return line(key, *pos).rowsBetween(Window.unboundedPreceding, -1)


def after(key: list[str], *pos):
    """All rows after this one."""
    return line(key, *pos).rowsBetween(1, Window.unboundedFollowing)


def upto(key: list[str], *pos):
    return line(key, *pos).rowsBetween(Window.unboundedPreceding, 0)


def islands(df: DataFrame, key: list[str], pos: str | list[str], value: Column, out: str = "island") -> DataFrame:
    """The rows with the number of the run of equal ``value`` that they are in."""
    pos = [pos] if isinstance(pos, str) else pos
    w = line(key, *pos)
    changed = F.when(value.eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_changed", changed).withColumn(out, F.sum("_changed").over(upto(key, *pos))).drop("_changed")


def gap_runs(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """key, first, last, n of each run of consecutive integers."""
    run = df.withColumn("_run", F.col(value) - F.row_number().over(line(key, value)))
    return run.groupBy(*key, "_run").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count("*").alias("n")).drop("_run")


def carry_forward(value: Column, when: Column, key: list[str], *pos) -> Column:
    """``value`` of the last row before this one for which ``when`` holds."""
    return F.last(F.when(when, value), ignorenulls=True).over(before(key, *pos))


def next_found(value: Column, key: list[str], *pos) -> Column:
    """The next value that is not null."""
    return F.first(value, ignorenulls=True).over(after(key, *pos))


def next_greater(df: DataFrame, key: list[str], pos: str, value: str, out: str) -> DataFrame:
    """The next value in order that is strictly greater; null if there is none.

    Values may fall, so a running minimum would not do: the rest of a group's values is filtered. Groups are the parts of one
    document and fit a row.
    """
    rest = F.collect_list(value).over(after(key, pos))
    return df.withColumn(out, F.get(F.filter(rest, lambda x: x > F.col(value)), F.lit(0)))


def remap(df: DataFrame, key: list[str], pos: str, keep: Column) -> DataFrame:
    """The rows with ``new_pos`` after the others are deleted (null if deleted) and ``anchor``, the last survivor before (null if none)."""
    kept = F.sum(F.when(keep, 1).otherwise(0))
    n = kept.over(upto(key, pos))
    return df.withColumns({"new_pos": F.when(keep, n - 1), "anchor": F.when(n - F.when(keep, 1).otherwise(0) > 0, n - 1 - F.when(keep, 1).otherwise(0))})


def spread_rank(df: DataFrame, key: list[str], pos: Column, *order, out: str = "place") -> DataFrame:
    """The rows with their number within the key, by ``pos`` and then ``order``; a key may have any share of the rows.

    ``pos`` (a long) cuts a key to cells: rows are numbered within a cell, and a cell begins where those before it end.
    """
    cells = df.withColumn("_cell", pos)
    n = cells.groupBy(*key, "_cell").agg(F.count("*").alias("_n"))
    n = n.withColumn("_before", F.coalesce(F.sum("_n").over(before(key, "_cell")), F.lit(0))).drop("_n")  # one row a cell
    n = n.select(*[F.col(k).alias(f"_{k}") for k in key], F.col("_cell").alias("_c"), "_before")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    ranked = cells.withColumn(out, F.row_number().over(Window.partitionBy(*key, "_cell").orderBy(*order)))
    ranked = ranked.join(n, reduce(lambda a, b: a & b, [*same, F.col("_cell").eqNullSafe(F.col("_c"))]))
    return ranked.withColumn(out, F.col(out) + F.col("_before")).drop("_cell", "_c", "_before", *[f"_{k}" for k in key])


def spread_sort(df: DataFrame, key: list[str], by: str, pos: str, cell: int = 100_000, out: str = "place") -> DataFrame:
    """The rows with their number within the key, by ``by`` and then the number ``pos``; a key or a value may have any share of the rows.

    Rows are numbered within their value, and a value begins where the lower ones of its key end: of the key as a whole, a window
    sees one row for each distinct value.
    """
    ranked = spread_rank(df, [*key, by], F.floor(F.col(pos) / cell), pos, out=out)
    n = df.groupBy(*key, by).agg(F.count("*").alias("_n"))
    n = n.withColumn("_lower", F.coalesce(F.sum("_n").over(before(key, by)), F.lit(0))).drop("_n")
    n = n.select(*[F.col(k).alias(f"_{k}") for k in [*key, by]], "_lower")
    ranked = ranked.join(n, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*key, by]]))
    return ranked.withColumn(out, F.col(out) + F.col("_lower")).drop("_lower", *[f"_{k}" for k in [*key, by]])


def spread_lead(df: DataFrame, key: str, pos: str, value: str, out: str, cell: int = 100_000) -> DataFrame:
    """The rows with the next ``value`` of their key in order of the number ``pos``; a key may have any share of the rows.

    The next row is looked for within a cell of the key; a cell's last row takes the first value of the next cell that has rows.
    """
    cells = df.withColumn("_cell", F.floor(F.col(pos) / cell))
    firsts = cells.groupBy(key, "_cell").agg(F.struct(F.min_by(value, pos).alias("v")).alias("_first"))
    ahead = F.lead("_first").over(Window.partitionBy(key).orderBy("_cell"))  # one row a cell
    firsts = firsts.select(F.col(key).alias("_k"), F.col("_cell").alias("_c"), ahead.alias("_ahead"))
    inside = F.lead(F.struct(F.col(value).alias("v"))).over(Window.partitionBy(key, "_cell").orderBy(pos))
    led = cells.withColumn("_next", inside).join(firsts, F.col(key).eqNullSafe(F.col("_k")) & F.col("_cell").eqNullSafe(F.col("_c")))
    return led.withColumn(out, F.coalesce("_next", "_ahead")["v"]).drop("_cell", "_k", "_c", "_ahead", "_next")


def uniquify(df: DataFrame, name: str, pos: str, cell: int = 100_000) -> DataFrame:
    """The rows with ``unique_name``: further occurrences of a name, by the number ``pos``, get the least numbers from 2 on that make no name of the table.

    A name a-k is a taken number k of a. With the taken numbers t1 < t2 < ... of a name, its i-th further occurrence gets i + 1 + j for
    the last j with tj - j <= i: a running last over both, in cells, so that neither a name nor its numbers are held in one row.
    A null name stays null; numbers with a leading zero or more than nine digits are no numbers of that form.
    """
    ranked = spread_rank(df, [name], F.floor(F.col(pos) / cell), pos, out="_nth")
    split = r"^(?s)(.*)-([2-9]|[1-9][0-9]{1,8})$"
    taken = df.select(name).distinct().select(F.regexp_extract(name, split, 1).alias(name), F.regexp_extract(name, split, 2).try_cast("long").alias("_t")).filter("_t is not null")
    taken = spread_rank(taken, [name], F.floor(F.col("_t") / cell), "_t", out="_j").select(name, (F.col("_t") - F.col("_j")).alias("_i"), "_j")
    taken = taken.groupBy(name, "_i").agg(F.max("_j").alias("_j"))
    shifted = J.asof_backward(ranked.withColumn("_i", F.col("_nth") - 1), taken, [name], "_i", "_j", 4096)
    n = F.col("_nth") + F.coalesce("_j", F.lit(0))
    unique = F.when(F.col(name).isNotNull(), F.when(F.col("_nth") == 1, F.col(name)).otherwise(F.concat_ws("-", F.col(name), n.cast("string"))))
    return shifted.withColumn("unique_name", unique).drop("_nth", "_i", "_j")


def ordered_list(df: DataFrame, key: list[str], pos: str, value: str, sep: str) -> DataFrame:
    """key, n, joined: the values of each group in order."""
    rows = F.array_sort(F.collect_list(F.struct(pos, value)))
    return df.groupBy(*key).agg(F.count("*").alias("n"), F.array_join(F.transform(rows, lambda x: x[value]), sep).alias("joined"))


def merge_in_order(original: DataFrame, fresh: DataFrame, key: list[str], pos: str, free: Column, value: str) -> DataFrame:
    """key, pos, value: the k-th free row of ``original`` takes the k-th row of ``fresh``; without one it keeps its own; surplus rows follow."""
    slot = F.when(free, F.sum(F.when(free, 1).otherwise(0)).over(upto(key, pos)))
    o = original.select(*key, pos, F.col(value).alias("_own"), slot.alias("_slot"))
    f = fresh.select(*key, F.row_number().over(line(key, pos)).alias("_slot"), F.col(value).alias("_new"))
    merged = o.join(f, [*key, "_slot"], "left").select(*key, pos, F.coalesce("_new", "_own").alias(value))
    n = o.groupBy(*key).agg(F.max("_slot").alias("_n"), F.max(pos).alias("_last"))
    surplus = f.join(n, key).filter(F.col("_slot") > F.coalesce("_n", F.lit(0)))
    surplus = surplus.select(*key, (F.col("_last") + F.col("_slot") - F.coalesce("_n", F.lit(0))).alias(pos), F.col("_new").alias(value))
    return merged.unionByName(surplus)


def inject_after(df: DataFrame, key: list[str], pos: str, chips: DataFrame, matches: Column) -> DataFrame:
    """The rows and ``chips`` (key, chip), each chip after the first row of its group for which ``matches`` holds, else at the end; with ``new_pos``."""
    hits = df.join(chips, key).filter(matches).groupBy(*key, "chip").agg(F.min(pos).alias("_at"))
    ends = df.groupBy(*key).agg(F.max(pos).alias("_end"))
    placed = chips.join(hits, [*key, "chip"], "left").join(ends, key).select(*key, F.coalesce("_at", "_end").alias("_at"), F.lit(1).alias("_after"), "chip")
    rows = df.select(*key, F.col(pos).alias("_at"), F.lit(0).alias("_after"), F.lit(None).cast("string").alias("chip")).unionByName(placed)
    return rows.withColumn("new_pos", F.row_number().over(line(key, "_at", "_after", "chip")) - 1).drop("_after").withColumnRenamed("_at", pos)
