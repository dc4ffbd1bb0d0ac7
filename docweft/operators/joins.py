"""Joins that Spark has no operator for, as plans of equi joins, and rule cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def jaccard_top1(left: DataFrame, right: DataFrame, left_id: str, right_id: str, least: float) -> DataFrame:
    """left_id, right_id, j: the right row with the most similar token set, or null below ``least``.

    Tokens are join keys, so only pairs that share one meet; the pair counts are combined map-side.
    """
    a = left.select(left_id, F.size("tokens").alias("na"), F.explode("tokens").alias("token"))
    b = right.select(right_id, F.size("tokens").alias("nb"), F.explode("tokens").alias("token"))
    shared = a.join(b, "token").groupBy(left_id, right_id).agg(F.count("*").alias("n"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    shared = shared.withColumn("j", F.col("n") / (F.col("na") + F.col("nb") - F.col("n")))
    best = shared.groupBy(left_id).agg(F.max_by(F.struct(right_id, "j"), F.struct("j", -F.col(right_id))).alias("b"))
    ok = F.col("b.j") >= least
    return left.select(left_id).join(best, left_id, "left").select(left_id, F.when(ok, F.col(f"b.{right_id}")).alias(right_id), F.when(ok, F.col("b.j")).alias("j"))


def cascade(*rules: tuple[str, Column, float]) -> tuple[Column, Column, Column]:
    """Target, method and confidence of the first rule (name, target or null, confidence) that finds one; else null, 'none', 0."""
    method, confidence = F.lit("none"), F.lit(0.0)
    for name, target, sure in reversed(rules):
        method, confidence = F.when(target.isNotNull(), name).otherwise(method), F.when(target.isNotNull(), sure).otherwise(confidence)
    return F.coalesce(*[t for _, t, _ in rules]), method, confidence


def unique_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, value for keys that one row only has; ambiguous keys are refused."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.first(value).alias(value)).filter("n = 1").drop("n")


def range_join(points: DataFrame, ranges: DataFrame, key: list[str], point: str, low: str, high: str, width: int) -> DataFrame:
    """Pairs with low <= point <= high within a key: ranges are dealt to cells of ``width``, so the join is an equi join."""
    cell = lambda c: F.floor(c / width).cast("long")
    p = points.withColumn("_cell", cell(F.col(point)))
    r = ranges.withColumn("_cell", F.explode(F.sequence(cell(F.col(low)), cell(F.col(high)))))
    return p.join(r, [*key, "_cell"]).filter((F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))).drop("_cell")


def first_by(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order; Spark limits each task's rows before it shuffles."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_nth = 1").drop("_nth")


def asof_backward(left: DataFrame, right: DataFrame, key: list[str], at: str, value: str, width: int = 16) -> DataFrame:
    """Each left row with the ``value`` of the latest right row of its key at or before it: a running last over the union.

    The numbers ``at`` are cut to cells of ``width``; the value runs within a cell of a key, and each cell takes over the last
    value of the cells before. So a key with many rows is no hot spot. Values are not null.
    """
    kind = right.schema[value].dataType
    cell = F.floor(F.col(at) / width).cast("long")
    r = right.select(*key, at, F.col(value).alias("_v")).withColumn("_cell", cell)
    both = left.withColumns({"_v": F.lit(None).cast(kind), "_left": F.lit(1), "_cell": cell}).unionByName(r.withColumn("_left", F.lit(0)), allowMissingColumns=True)
    line = Window.partitionBy(*key, "_cell").orderBy(at, "_left").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = both.withColumn("_own", F.last("_v", ignorenulls=True).over(line)).filter("_left = 1").drop("_v", "_left")
    # a row for each cell of a key
    marks = r.groupBy(*key, "_cell").agg(F.max_by("_v", at).alias("_end")).unionByName(
        run.select(*key, "_cell").distinct().withColumn("_end", F.lit(None).cast(kind))
    ).groupBy(*key, "_cell").agg(F.first("_end", ignorenulls=True).alias("_end"))
    past = Window.partitionBy(*key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.withColumn("_past", F.last("_end", ignorenulls=True).over(past)).drop("_end")
    return run.join(marks, [*key, "_cell"], "left").withColumn(value, F.coalesce("_own", "_past")).drop("_own", "_past", "_cell")


def overlapping(df: DataFrame, key: list[str], ident: str, low: str, high: str, least: int, width: int = 16) -> DataFrame:
    """a, b, shared: pairs of ids, a < b, of one key whose ranges share ``least`` numbers or more.

    Ranges are dealt to cells, so only those of one cell meet, and a pair counts in the first cell that both have.
    """
    cell = lambda c: F.floor(F.col(c) / width).cast("long")
    r = df.filter(F.col(low) <= F.col(high)).withColumn("_first", cell(low)).withColumn("_cell", F.explode(F.sequence(cell(low), cell(high))))
    side = lambda n: r.select(*key, "_cell", F.col(ident).alias(n), F.col(low).alias(f"_{n}0"), F.col(high).alias(f"_{n}1"), F.col("_first").alias(f"_{n}f"))
    shared = F.least("_a1", "_b1") - F.greatest("_a0", "_b0") + 1
    pairs = side("a").join(side("b"), [*key, "_cell"])
    return pairs.filter((F.col("a") < F.col("b")) & (F.col("_cell") == F.greatest("_af", "_bf")) & (shared >= least)).select("a", "b", shared.alias("shared"))


def full_diff(old: DataFrame, new: DataFrame, key: list[str], fields: list[str], keep: Column | None = None) -> DataFrame:
    """key, action of each row: insert, update, delete or same; old rows for which ``keep`` (over ``old``) holds are never touched."""
    a = old.select(*key, F.struct(*fields).alias("_old"), (keep if keep is not None else F.lit(False)).alias("_keep"))
    b = new.select(*key, F.struct(*fields).alias("_new"))
    action = (
        F.when(F.coalesce("_keep", F.lit(False)), "same").when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "same").otherwise("update")
    )
    return a.join(b, key, "full_outer").select(*key, action.alias("action"))


def upsert(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """The table with the changed rows' columns overwritten and new rows inserted; written as a new version."""
    values = [c for c in table.columns if c not in key]
    t, c = table.withColumn("_t", F.lit(1)), changes.select(*key, *[F.col(v).alias(f"_{v}") for v in values], F.lit(1).alias("_c"))
    both = t.join(c, key, "full_outer")
    return both.select(*key, *[F.when(F.col("_c").isNotNull(), F.col(f"_{v}")).otherwise(F.col(v)).alias(v) for v in values])
