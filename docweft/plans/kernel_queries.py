"""Queries over order-dependent kernels; SQL can't express them, so they are tested against plain versions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import repair as R
from ..functions import similarity as S
from ..functions import text as X
from ..operators import kernels as K
from ..operators import windows as W
from ..sources.tables import table
from .registry import query
from .text_queries import pairs


@query()
def lcs_ratio(spark, d):
    """Longest common substring of each document and the next one by the document's length."""
    return pairs(spark, d).select("doc_id", F.round(S.lcs_ratio("src", "ext"), 9).alias("ratio"))


@query()
def sequence_ratio(spark, d):
    """Matching ratio of the titles (first lines) of each document and the next one."""
    titles = pairs(spark, d, lambda text: F.substring_index(text, "\n", 1))
    return titles.select("doc_id", F.round(S.sequence_ratio("src", "ext"), 9).alias("ratio"))


@query()
def fidelity_report(spark, d):
    """Six tests of each document against the next, weighted; a failed test with a score gives part of its weight."""
    t = pairs(spark, d).select("doc_id", "src", "ext", S.lcs_ratio("src", "ext").alias("lcs"), S.window_ratio("src", "ext").alias("windows"))
    numbers = F.exists(X.numbers(F.col("src")), lambda n: ~F.contains(F.col("ext"), n))
    tests = [
        (0.40, F.col("lcs") >= 0.85, F.col("lcs")), (0.20, F.col("windows") >= 0.8, F.col("windows")), (0.15, ~numbers, F.lit(0.0)),
        (0.10, F.contains("src", F.lit("(a)")) == F.contains("ext", F.lit("(a)")), F.lit(0.0)), (0.10, X.coverage(F.col("src"), F.col("ext")) >= 0.9, X.coverage(F.col("src"), F.col("ext"))),
        (0.05, F.col("src").rlike(r"[.!?]\s*$"), F.lit(0.0)),
    ]
    score = sum((F.when(ok, w).otherwise(w * F.greatest(part, F.lit(0.0))) for w, ok, part in tests), F.lit(0.0))
    status = F.when(F.col("lcs") < 0.85, "failed").when(numbers | ~tests[3][1], "flagged").otherwise("passed")
    return t.select("doc_id", F.round("lcs", 9).alias("ratio"), F.round(score, 9).alias("score"), status.alias("status"))


@query()
def greedy_match(spark, d):
    """In each conversation the assistant's texts are matched one to one with the user's by their ratio."""

    def run(conv, rows):
        a, b = [r for r in rows if r.role == "assistant"], [r for r in rows if r.role == "user"]
        hits = K.match_texts([r.text or "" for r in a], [r.text or "" for r in b], 0.3)
        return [(conv, None if i is None else a[i].turn, None if j is None else b[j].turn, round(ratio, 9)) for i, j, ratio in hits]

    return K.by_group(table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), "conv_id", ["turn"], run, "conv_id long, found long, truth long, ratio double")


def boxes(spark, d):
    """Boxes on pages: parts of one brand and size stand on one page."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("id"), F.concat_ws("-", "p_brand", "p_size").alias("page"), (k % 7 * 10.0).alias("x0"), (k % 11 * 4.0).alias("y0"), (k % 7 * 10.0 + 12 + k % 3).alias("x1"), (k % 11 * 4.0 + 5).alias("y1"))


def corners(r) -> tuple:
    return r.x0, r.y0, r.x1, r.y1


@query()
def greedy_iou(spark, d):
    """On each page the boxes with odd ids take the images (even ids) that they overlap most, one each."""

    def run(page, rows):
        a, b = [r for r in rows if r.id % 2], [r for r in rows if not r.id % 2]
        return [(page, a[i].id, b[j].id) for i, j in K.match_boxes(list(map(corners, a)), list(map(corners, b)))]

    return K.by_group(boxes(spark, d), "page", ["id"], run, "page string, box long, image long")


@query()
def box_clusters(spark, d):
    """Clusters of neighbouring boxes of each page, named by their first box."""

    def run(page, rows):
        return [(page, r.id, rows[k].id) for r, k in zip(rows, K.box_clusters(list(map(corners, rows))))]

    return K.by_group(boxes(spark, d), "page", ["id"], run, "page string, id long, cluster long")


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey"]


@query()
def chip_question_claim(spark, d):
    """In each order odd lines (chips) claim even lines (questions): equal supplier first, then equal flag."""

    def run(order, rows):
        a, b = [r for r in rows if r.l_linenumber % 2], [r for r in rows if not r.l_linenumber % 2]
        tags = lambda part: [(str(r.l_suppkey % 4), r.l_returnflag) for r in part]
        return [(order, r.l_linenumber, None if h is None else b[h].l_linenumber) for r, h in zip(a, K.claim_chips(tags(a), tags(b)))]

    lines = table(spark, d, "lineitem").select("l_orderkey", *LINE_ORDER, "l_returnflag")
    return K.by_group(lines, "l_orderkey", [*LINE_ORDER, "l_returnflag"], run, "l_orderkey long, chip int, question int")


@query()
def anchor_cursor(spark, d):
    """The first line of each turn of a conversation is looked up among its turns, moving forward."""

    def run(conv, rows):
        texts = [r.text or "" for r in rows]
        return [(conv, r.turn, *hit) for r, hit in zip(rows, K.anchor_pages([t.split("\n")[0].strip() for t in texts], texts))]

    return K.by_group(table(spark, d, "conversations").select("conv_id", "turn", "text"), "conv_id", ["turn"], run, "conv_id long, turn long, page long, kind string")


@query()
def chunk_by_heading(spark, d):
    """Each document is cut at the begins of its paragraphs, searched in turn."""
    schema = "array<struct<begin:int,end:int,found:boolean>>"

    @F.pandas_udf(schema)
    def chunks(texts: pd.Series) -> pd.Series:
        cut = lambda t: K.chunk_by_titles(t or "", (t or "").split("\n"))
        return texts.map(lambda t: [{"begin": a, "end": b, "found": f} for a, b, f in cut(t)])

    rows = table(spark, d, "documents").select("doc_id", F.posexplode(chunks("text")).alias("nth", "c"))
    return rows.select("doc_id", "nth", "c.begin", "c.end", "c.found")


@query()
def draft_op_fold(spark, d):
    """Each order's lines are a draft, and each part an edit: the list after all edits, in order, and the errors."""

    def run(order, rows):
        names = [f"{r.l_linenumber}-{r.l_partkey}" for r in rows]
        kinds = ["remove", "edit", "insert", "move"]
        ops = []
        for name, r in zip(names, rows):
            kind = kinds[r.l_partkey % 4]
            ops.append((kind, name if r.l_partkey % 5 else "gone", {"edit": f"{name}!", "insert": names[0], "move": "0"}.get(kind)))
        out, errors = K.fold_edits(names, ops)
        return [(order, ",".join(out), len(errors))]

    return K.by_group(table(spark, d, "lineitem").select("l_orderkey", *LINE_ORDER), "l_orderkey", LINE_ORDER, run, "l_orderkey long, items string, n_errors int")


@query()
def figure_placement(spark, d):
    """In each conversation every third turn is a figure: placed by its label, its anchor, its page, or unattached."""

    def run(conv, rows):
        blocks = [{"text": r.text or "", "page": r.turn // 2} for r in rows]
        figures = [
            {"id": r.turn, "label": f"Figure {r.turn}", "anchor": " ".join((r.text or "").split()[-4:]), "page": r.turn // 2, "position": "below" if r.turn % 2 else "above"}
            for r in rows if r.turn % 3 == 0
        ]
        return [(conv, *hit) for hit in K.place_figures(blocks, figures)]

    return K.by_group(table(spark, d, "conversations").select("conv_id", "turn", "text"), "conv_id", ["turn"], run, "conv_id long, figure long, block int, method string")


@query()
def markdown_table_parse(spark, d):
    """Text and table segments of each document; lines with bars are read as cells."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(R.segments(X.text_or_empty(F.col("text")))).alias("nth", "s"))
    return rows.select("doc_id", "nth", "s.kind", F.size(F.coalesce("s.rows", F.array().cast("array<array<string>>"))).alias("n_rows"), F.length("s.text").alias("n_chars"))


@query()
def json_repair(spark, d):
    """Props with damage on purpose are parsed again."""
    broken = F.concat(F.lit("Result:\n"), F.replace("props", F.lit("}"), F.lit(",}")), F.lit("\nend"))
    return table(spark, d, "events").select("event_id", R.parsed(broken).alias("json"))


@query()
def match_normalise(spark, d):
    """Texts in the form in which they are matched."""
    return table(spark, d, "benchmark").select("item_id", R.match_key("text").alias("key"))


@query()
def final_merge_doc(spark, d):
    """Each conversation as one document: latest overlays replace blocks, deleted ones go, runs of a kind are one block, and the rest is rendered as Markdown."""
    b = table(spark, d, "conversations")
    overlay = b.filter("turn % 4 = 3").select("conv_id", "turn", F.when(F.col("turn") % 8 != 7, F.initcap("text")).alias("fresh"), F.lit(True).alias("hit"))
    rows = b.join(overlay, ["conv_id", "turn"], "left").filter("hit is null or fresh is not null").withColumn("text", X.text_or_empty(F.coalesce("fresh", "text")))
    rows = W.islands(rows.drop("hit", "fresh"), ["conv_id"], "turn", F.col("role"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    merged = rows.groupBy("conv_id", "island").agg(F.first("role").alias("role"), joined.alias("text"))
    merged = merged.withColumn("text", F.when(F.col("role") == "system", F.concat(F.lit("## "), "text")).when(F.col("role") == "user", F.concat(F.lit("**"), "text", F.lit("**"))).otherwise(F.col("text")))
    return W.ordered_list(merged, ["conv_id"], "island", "text", "\n\n").withColumnRenamed("joined", "markdown")
