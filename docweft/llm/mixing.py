"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Each source's target is its share by weight, at most ``most`` times its size; what is cut off is shared anew by weight until no
source is above. Within a source documents have odds (``odds_col``): expected copies are in proportion to them, at most ``most``,
and so high that the source's target is met. Whole copies are certain, and the rest is a document's inclusion probability. Documents are ranked by random odds u/(1-u) divided by inclusion odds p/(1-p), and the source takes them
in that order until its words are as near the target as a prefix can come.

The order is never sorted as a whole: documents fall into cells by rank, the cells' sums are scanned, and only the cell in which
the target is met is refined, ``LEVELS`` times, then ranked. A source with a third of all rows spreads over all tasks.

Odds are taken in steps of an eighth of an octave, so a source has some hundred different ones at most.

Nulls: a null text has size 0; null odds are 1; a null source is a source of its own, last in order. Documents of size 0 and sources of size 0
take 0. Ties in rank: by id, then size; rows that are equal throughout share what their place gives. Empty table: empty result.
Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Cells per source and level.
CELLS = 1024
LEVELS = 2
#: Sources up to this number are broadcast with their targets.
FEW = 10_000
WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text: Column) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.size(F.split(F.regexp_replace(F.btrim(text, F.lit(" \t\n\x0b\f\r")), "[ \\t-\\r]+", " "), " ")) - F.when(F.btrim(text, F.lit(" \t\n\x0b\f\r")) == "", 1).otherwise(0), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """source, source_size, target from one row per source (source, source_size).

    Sources by code point, null last, take the weights in turn. With water level L a source gets min(L * weight, most * size);
    the sources that reach their bound are a prefix by bound / weight, so running sums give L without iteration.
    """
    nth = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last()))
    pick = F.element_at(F.array(*map(F.lit, weights)), ((nth - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("nth", nth).withColumn("weight", pick).withColumn("bound", F.lit(most) * F.col("source_size"))
    order = Window.partitionBy(F.lit(0)).orderBy((F.col("bound") / F.col("weight")).asc(), "nth")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumns({"bounds": F.coalesce(F.sum("bound").over(before), F.lit(0.0)), "open": F.sum("weight").over(after), "total": F.sum("source_size").over(every).cast("double")})
    # a source stands below its bound if the level that it would share with all later ones does not reach it
    s = s.withColumn("level", F.when(F.col("bound") / F.col("weight") > (F.col("total") - F.col("bounds")) / F.col("open"), (F.col("total") - F.col("bounds")) / F.col("open")))
    s = s.withColumn("level", F.max("level").over(every))
    return s.select("source", F.col("source_size").cast("long").alias("source_size"), F.coalesce(F.least("bound", F.col("level") * F.col("weight")), F.col("bound")).alias("target"))


def uniform(seed: int) -> Column:
    """A number in (0, 1) of 48 bits from the id; the same on each run and in any SQL engine."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, seed: int = 17, odds_col: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for each row of ``docs`` (doc_id, source, text).

    ``odds_col`` names a positive column by which documents of one source are preferred; without it all documents of a source
    have the same odds. No document is copied more than ``most`` times, rounded down.
    """
    sized = cut(_sized(docs, odds_col))
    out = _decide(sized, *_marks(sized, weights, most, seed), most, seed)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, seed: int = 17, odds_col: str | None = None) -> DataFrame:
    """The rows of the mix: each row of ``docs`` as often as it is taken, with all its columns."""
    rows = _sized(docs, odds_col, F.struct("*").alias("row"))
    out = _decide(rows, *_marks(cut(rows.drop("row")), weights, most, seed), most, seed).filter("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def _sized(docs: DataFrame, odds_col: str | None, *more: Column) -> DataFrame:
    odds = F.least(F.greatest(F.coalesce(F.col(odds_col).cast("double"), F.lit(1.0)), F.lit(1e-9)), F.lit(1e9)) if odds_col else F.lit(1.0)
    wish = F.pow(F.lit(2.0), F.round(F.log2(odds) * 8) / 8) if odds_col else odds
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), wish.alias("wish"), *more)


def _marks(sized: DataFrame, weights: tuple[float, ...], most: float, seed: int) -> tuple[DataFrame, bool]:
    """One row per source: source_size, target, wished, and up to which rank its documents are taken (all below ``low``, then up to ``last``); and whether sources are few."""
    grades = cut(sized.groupBy("source", "wish").agg(F.sum("size").alias("words")))
    targets = source_targets(grades.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    targets = cut(targets.join(_levels(grades, targets, float(int(most))), F.col("source").eqNullSafe(F.col("s")), "left").drop("s"))
    few = targets.count() <= FEW
    rows = _ranked(sized, targets, few, most, seed)
    sure = rows.groupBy(F.col("source").alias("s")).agg(F.sum(F.col("whole") * F.col("size")).alias("sure"))
    marks = targets.join(sure, F.col("source").eqNullSafe(F.col("s")), "left")
    marks = marks.select("source", (F.col("target") - F.coalesce("sure", F.lit(0))).alias("need"), F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
    for _ in range(LEVELS):
        marks = cut(_refine(rows, marks, few))
    edge = _join_source(rows.filter("can"), marks, few).filter("rank >= low and rank < high")
    line = Window.partitionBy("source").orderBy("rank", "doc_id", "size")
    edge = edge.withColumn("run", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    # a document is taken if that brings the sum nearer to the target than leaving it out
    last = edge.filter(F.col("run") - F.col("size") / 2.0 <= F.col("need")).groupBy("source").agg(F.max(F.struct("rank", "doc_id", "size")).alias("last"))
    marks = targets.select(F.col("source").alias("src"), "source_size", "target", "level").join(marks.select(F.col("source").alias("s"), "low"), F.col("src").eqNullSafe(F.col("s")))
    return cut(marks.join(last, F.col("src").eqNullSafe(F.col("source")), "left").select(F.col("src").alias("source"), "source_size", "target", "level", "low", "last")), few


def _levels(grades: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """s, level: the expected copies at odds of 1 of each source, with which min(level * odds, most) meets its target.

    ``grades`` has a row for each source and odds. Those that reach ``most`` come first by falling odds, so running sums give the level.
    """
    rows = grades.filter("words > 0").join(targets.select(F.col("source").alias("s"), "target"), F.col("source").eqNullSafe(F.col("s")))
    order = Window.partitionBy("s").orderBy(F.col("wish").desc())
    before = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * most
    open_ = F.sum(F.col("wish") * F.col("words")).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.col("target") - before) / open_)
    return rows.filter(F.col("level") * F.col("wish") <= most).groupBy("s").agg(F.max("level").alias("level"))


def _ranked(rows: DataFrame, targets: DataFrame, few: bool, most: float, seed: int) -> DataFrame:
    """The rows with their source's row, their certain copies ``whole``, their ``rank`` in (0, 1), and whether they ``can`` be taken once more."""
    # without a level all documents of the source are taken as often as they may be
    share = F.when(F.col("target") > 0, F.coalesce(F.col("level") * F.col("wish"), F.lit(most))).otherwise(0.0)
    rows = _join_source(rows, targets, few).withColumn("share", F.least(share, F.lit(float(int(most)))))
    p, u = F.col("share") - F.floor("share"), uniform(seed)
    odds = (u / (1 - u)) / (p / (1 - p))
    return rows.withColumns({"whole": F.floor("share"), "rank": F.when(p <= 0, 1.0).otherwise(odds / (1 + odds)), "can": (F.col("share") < int(most)) & (F.col("size") > 0)})


def _decide(rows: DataFrame, marks: DataFrame, few: bool, most: float, seed: int) -> DataFrame:
    """The rows with ``copies``."""
    rows = _ranked(rows, marks, few, most, seed)
    extra = F.col("can") & ((F.col("rank") < F.col("low")) | F.coalesce(F.struct("rank", "doc_id", "size") <= F.col("last"), F.lit(False)))
    return rows.withColumn("copies", (F.col("whole") + F.when(extra, 1).otherwise(0)).cast("long"))


def _join_source(rows: DataFrame, table: DataFrame, few: bool) -> DataFrame:
    """Each row with its source's row in ``table``: broadcast if the sources are few, otherwise by shuffle."""
    table = table.withColumnRenamed("source", "s")
    table = F.broadcast(table) if few else table
    return rows.join(table, F.col("source").eqNullSafe(F.col("s"))).drop("s")


def _refine(rows: DataFrame, marks: DataFrame, few: bool) -> DataFrame:
    """Narrow each source's [low, high) to the cell in which the words above ``low`` reach ``need``; ``need`` is then counted from there."""
    inside = _join_source(rows.filter("can"), marks, few).filter("rank >= low and rank < high")
    cell = F.least(F.floor((F.col("rank") - F.col("low")) / (F.col("high") - F.col("low")) * CELLS), F.lit(CELLS - 1)).cast("int")
    cells = inside.groupBy("source", cell.alias("cell")).agg(F.sum("size").alias("words"))
    line = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("run", F.sum("words").over(line))
    # the first cell at whose end the need is met; if none is, the source's last place is beyond all its ranks
    met = _join_source(cells, marks.select("source", "need"), few).filter(F.col("run") >= F.col("need")).groupBy("source").agg(F.min(F.struct("cell", "words", "run")).alias("m"))
    out = marks.withColumnRenamed("source", "src").join(met, F.col("src").eqNullSafe(F.col("source")), "left")
    step = (F.col("high") - F.col("low")) / CELLS
    beyond = F.col("m").isNull()
    last = F.col("m.cell") == CELLS - 1
    return out.select(
        F.col("src").alias("source"),
        F.when(beyond, F.col("need")).otherwise(F.col("need") - (F.col("m.run") - F.col("m.words"))).alias("need"),
        F.when(beyond, F.lit(1.0)).otherwise(F.col("low") + F.col("m.cell") * step).alias("low"),
        F.when(beyond | last, F.col("high")).otherwise(F.col("low") + (F.col("m.cell") + 1) * step).alias("high"),
    )
