"""Figures and where they go; the cascade is too long for one SQL text, so it is tested against a plain version over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.placement import place_figures, split_lists
from ..sources.tables import table
from .registry import query


def figure_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Books of one language, a section for each document and a block for each of its lines; figures and questions are taken from lines.

    Figures name a section that is theirs, another one or none, and bring an anchor from their own line or its end, a label or neither.
    """
    k, i = F.col("doc_id"), F.col("block")
    docs = table(spark, d, "documents").select("doc_id", X.text_or_empty(F.col("lang")).alias("book"), X.text_or_empty(F.col("text")).alias("whole"))
    name = F.concat(F.lit("part-"), k.cast("string"), F.when(k % 3 == 0, F.concat(F.lit("-example-"), (k % 40).cast("string"))).otherwise(F.lit("")))
    docs = docs.withColumn("section", name)
    sections = docs.select("book", "section", k.alias("place"), F.when(k % 11 > 0, k * 2).alias("page_start"), (k * 2 + k % 5).alias("page_end"))
    lines = docs.select("doc_id", "book", "section", F.posexplode(F.split("whole", "\n")).alias("block", "line"))
    number = F.concat((k % 30).cast("string"), F.lit("."), (i % 6).cast("string"), F.when(i % 5 == 3, ".1").when(i % 5 == 4, "a").otherwise(""))
    form = F.get(F.array(*map(F.lit, [" see Fig. ", " (Figure ", " as fig_", " in figures no. ", " table "])), (k % 5).cast("int"))
    text = F.when((k + i) % 4 == 0, F.concat("line", form, number)).otherwise(F.col("line"))
    kind = F.when(i % 9 == 4, "figure").otherwise("text")
    blocks = lines.select("book", "section", "block", kind.alias("kind"), F.when(kind == "figure", F.concat(F.lit("Figure "), number)).alias("label"), text.alias("text"), F.when(i % 3 == 2, F.split("line", ", ")).alias("items"))

    first = docs.groupBy("book").agg(F.min_by("section", "doc_id").alias("first_section"))
    first = F.broadcast(first) if first.count() <= 10_000 else first  # counted, else all lines are shuffled by their book
    named = F.when(i % 7 == 0, F.lit("_orphan")).when(i % 7 == 1, None).when(i % 5 == 3, F.col("first_section")).otherwise(F.col("section"))
    anchor = F.when(i % 4 == 0, F.substr("line", F.lit(4), F.lit(75))).when(i % 4 == 1, F.right("line", F.lit(15))).when(i % 4 == 2, F.col("line")).when(k % 2 == 0, F.left("line", F.lit(3)))
    figures = lines.join(first, "book").select(
        "book", F.concat(k.cast("string"), F.lit("/"), i.cast("string")).alias("figure"), F.when((k + i) % 3 == 0, "question").when(i % 2 == 0, "theory").alias("context"), named.alias("section"),
        F.when((i % 6).isin(1, 2), F.concat(F.lit("s"), F.floor(k / 3).cast("string"))).alias("section_uuid"), F.when(i % 13 != 5, k * 2 + i % 3).alias("page"), F.when(i % 3 == 1, F.concat(F.lit("Figure "), F.when((k + i) % 4 == 0, number).otherwise(F.concat(((k + i) % 45).cast("string"), F.lit("."), (i % 7).cast("string"))))).alias("label"),
        F.when(i % 4 == 1, F.concat(F.lit("Q. "), (k % 70).cast("string"))).alias("question_no"), F.when(i % 4 == 3, F.concat(F.lit("("), (k % 50).cast("string"), F.lit(")"))).alias("question_ref"),
        F.when(i % 2 == 0, "solution").alias("body_type"), anchor.alias("anchor"), F.when(k % 3 == 0, "above").when(k % 3 == 1, "below").alias("anchor_position"),
    )
    line = lambda n: F.get(F.split("whole", "\n"), n)
    questions = docs.filter("doc_id % 3 <> 1").select(
        "book", F.concat(F.lit("q"), k.cast("string")).alias("question"), k.alias("place"), F.when(k % 5 > 0, F.concat(F.lit("q"), (k % 60).cast("string"), F.lit("."))).alias("number"), F.when(k % 8 > 0, F.col("section")).alias("section"),
        F.concat(F.lit("s"), F.floor(k / 3).cast("string")).alias("section_uuid"), F.concat(line(F.lit(0)), F.lit(" as Figure "), (k % 45).cast("string"), F.lit("."), (k % 4).cast("string")).alias("raw_text"),
        F.concat_ws(" by fig ", line(F.lit(1)), F.concat(((k + 7) % 45).cast("string"), F.lit("."), (k % 7).cast("string"))).alias("solution_text"),
    )
    return {"figures": figures, "sections": sections, "blocks": blocks, "questions": questions}


@query()
def figure_cascade(spark, d):
    """Each figure to a question or block by the first rule of the cascade that holds, with the rule's name."""
    return place_figures(**figure_tables(spark, d))


@query("""WITH e AS (SELECT list, item, words, sum(length(words) + 1) OVER (PARTITION BY list ORDER BY item) - 1 AS stop, lead(item) OVER (PARTITION BY list ORDER BY item) IS NULL AS last
FROM (SELECT doc_id AS list, unnest(string_split(coalesce(text, ''), chr(10))) AS words, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS item FROM documents)),
f AS (SELECT doc_id AS list, n AS figure, CASE WHEN n = 0 THEN doc_id * 37 % (length(coalesce(text, '')) + 20) WHEN n = 1 THEN doc_id * 11 % 50 WHEN n = 2 AND doc_id % 9 < 4 THEN doc_id % 9 - 2 END AS off FROM documents, (VALUES (0), (1), (2), (3)) AS t(n)),
k AS (SELECT f.list, figure, off, coalesce(min(item) FILTER (stop >= off), max(item)) AS item FROM f JOIN e ON e.list = f.list GROUP BY f.list, figure, off),
c AS (SELECT DISTINCT list, item FROM k WHERE off IS NOT NULL),
p AS (SELECT e.list, e.item, e.words, e.last, coalesce(sum(CASE WHEN c.item IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY e.list ORDER BY e.item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM e LEFT JOIN c ON c.list = e.list AND c.item = e.item)
SELECT list, CAST(part AS BIGINT) AS part, CAST(0 AS BIGINT) AS nth, CAST(min(item) + 1 AS BIGINT) AS start, bool_or(last) AS last, string_agg(words, chr(10) ORDER BY item) AS content, CAST(NULL AS BIGINT) AS figure FROM p GROUP BY list, part
UNION ALL SELECT k.list, CAST(part AS BIGINT), row_number() OVER (PARTITION BY k.list, part ORDER BY off IS NULL, figure), NULL, NULL, NULL, CAST(figure AS BIGINT) FROM k JOIN p ON p.list = k.list AND p.item = k.item""")
def list_splits(spark, d):
    """The lines of each document as a list that is cut around four figures, of which some have no offset."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("list"), X.text_or_empty(F.col("text")).alias("text"))
    k = F.col("list")
    offsets = F.array(k * 37 % (F.length("text") + 20), k * 11 % 50, F.when(k % 9 < 4, k % 9 - 2), F.lit(None).cast("long"))
    figures = docs.select("list", F.posexplode(offsets).alias("figure", "offset"))
    rows = split_lists(docs.select("list", F.split("text", "\n").alias("items")), figures)
    return rows.select("list", *[F.col(c).cast("long").alias(c) for c in ("part", "nth", "start")], "last", "content", F.col("figure").cast("long").alias("figure"))
