"""Queries that compose documents from blocks, references and trees: placement, slices, inlining, corrections, validators of content."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blocks as B
from ..functions import rules as R
from ..functions import text as X
from ..operators import joins as J
from ..operators import tree as T
from ..operators import windows as W
from ..sources.tables import table
from .join_queries import BLOCKS_SQL, CONTAINING_SQL, SECTIONS_SQL, blocks, containing, sections
from .registry import query
from .scalar_queries import NAMES, quoted, sql_list, sql_lookup
from .tree_queries import KEY_SQL, NODES_SQL, key, nodes

# ---------------------------------------------------------------- references and labels


@query(f"""WITH c AS (SELECT b.block, s.id, row_number() OVER (PARTITION BY b.block ORDER BY s.level DESC, s.id) AS nth FROM {CONTAINING_SQL}),
f AS (SELECT b.block, max(struct_pack(p := s.p0, i := -s.id)) AS m FROM {BLOCKS_SQL} b JOIN {SECTIONS_SQL} s ON s.book = b.book AND s.p0 <= b.page GROUP BY b.block)
SELECT b.block, coalesce(c.id, -f.m.i) AS id, CASE WHEN c.id IS NOT NULL THEN 'inside' WHEN f.m IS NOT NULL THEN 'before' ELSE 'none' END AS how FROM {BLOCKS_SQL} b LEFT JOIN c ON c.block = b.block AND nth = 1 LEFT JOIN f ON f.block = b.block""")
def range_deepest_or_before(spark, d):
    """Each block to the deepest section that contains its page, else to the one that begins last at or before it."""
    deepest = J.first_by(containing(spark, d), ["block"], F.col("level").desc(), F.col("id")).select("block", F.col("id").alias("inside"))
    starts = sections(spark, d).groupBy("book", F.col("p0").alias("page")).agg(F.min("id").alias("before"))
    rows = J.asof_backward(blocks(spark, d).select("book", "block", "page"), starts, ["book"], "page", "before").join(deepest, "block", "left")
    how = F.when(F.col("inside").isNotNull(), "inside").when(F.col("before").isNotNull(), "before").otherwise("none")
    return rows.select("block", F.coalesce("inside", "before").alias("id"), how.alias("how"))


MENTIONS_SQL = """(SELECT doc_id, coalesce(lang, '') AS lang, lower(coalesce(text, '')) || ' see ' || ['fig. ', 'figure ', 'fig ', '(fig. '][doc_id % 4 + 1] || (doc_id % 30) || '.' || (doc_id % 4) || ['', 'a', ')'][doc_id % 3 + 1] || ' and figure ' || (doc_id % 11) AS t FROM documents)"""


def mentions(spark, d):
    """doc_id, lang, t: texts that name figures."""
    k = F.col("doc_id")
    at = lambda values, n: F.get(F.array(*map(F.lit, values)), (k % n).cast("int"))
    t = F.concat(
        F.lower(X.text_or_empty(F.col("text"))), F.lit(" see "), at(["fig. ", "figure ", "fig ", "(fig. "], 4), (k % 30).cast("string"), F.lit("."), (k % 4).cast("string"), at(["", "a", ")"], 3),
        F.lit(" and figure "), (k % 11).cast("string"),
    )
    return table(spark, d, "documents").select("doc_id", X.text_or_empty(F.col("lang")).alias("lang"), t.alias("t"))


@query(f"""WITH f AS (SELECT DISTINCT CAST(p_size % 12 AS VARCHAR) || CASE WHEN p_size % 3 = 0 THEN '.' || (p_size % 4) ELSE '' END AS n FROM part), m AS {MENTIONS_SQL}
SELECT f.n, count(*) AS n_docs, min(doc_id) AS first_doc FROM f JOIN m ON contains(t, 'figure ' || n) OR contains(t, 'fig ' || n) OR contains(t, 'fig. ' || n) GROUP BY f.n""")
def multi_pattern_labels(spark, d):
    """Texts that name a figure in any of the usual forms: what a text names is found once, and joined by number."""
    size = F.col("p_size")
    number = F.concat((size % 12).cast("string"), F.when(size % 3 == 0, F.concat(F.lit("."), (size % 4).cast("string"))).otherwise(""))
    figures = table(spark, d, "part").select(number.alias("n")).distinct()
    named = mentions(spark, d).select("doc_id", F.explode(B.mentioned_labels(F.col("t"))).alias("n"))
    return named.join(figures, "n").groupBy("n").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


@query(f"""WITH q AS (SELECT doc_id, lang, t AS stem, 'as figure ' || (doc_id % 7) || ' shows' AS solution FROM {MENTIONS_SQL}), f AS (SELECT DISTINCT lang, unnest(list_concat(regexp_extract_all(stem, '(figure|fig[.]?) ?([0-9]+)', 2), regexp_extract_all(solution, '(figure|fig[.]?) ?([0-9]+)', 2))) AS n FROM q),
h AS (SELECT f.lang, n, doc_id, CASE WHEN regexp_matches(stem, '(figure|fig[.]?) ?' || n || '([^0-9.a-z]|$)') THEN 'question' WHEN regexp_matches(solution, '(figure|fig[.]?) ?' || n || '([^0-9.a-z]|$)') THEN 'solution' END AS place FROM f JOIN q ON q.lang = f.lang)
SELECT lang, n, doc_id, place FROM (SELECT *, row_number() OVER (PARTITION BY lang, n ORDER BY doc_id) AS nth FROM h WHERE place IS NOT NULL) WHERE nth = 1""")
def label_in_questions(spark, d):
    """Of each section the first question that names a figure, in its stem or else in its solution: labels are joined as keys."""
    whole = r"(?:figure|fig\.?) ?([0-9]+(?:\.[0-9]+)*[a-z]?)"
    q = mentions(spark, d).withColumn("solution", F.concat(F.lit("as figure "), (F.col("doc_id") % 7).cast("string"), F.lit(" shows")))
    labels = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(whole), F.lit(1)))
    both = F.array(F.struct(F.lit("question").alias("place"), labels(F.col("t")).alias("found")), F.struct(F.lit("solution").alias("place"), labels(F.col("solution")).alias("found")))
    hits = q.select("lang", "doc_id", F.inline(both)).select("lang", "doc_id", "place", F.explode("found").alias("n")).filter(F.col("n").rlike("^[0-9]+$"))
    first = hits.groupBy("lang", "n").agg(F.min(F.struct("doc_id", "place")).alias("m"))
    return first.select("lang", "n", "m.doc_id", "m.place")


def present(rows: DataFrame, words: DataFrame, most: int = 10_000) -> DataFrame:
    """``rows`` whose last column is among the one column of ``words``; where these are many, all rows, so a join has to follow."""
    words = words.distinct()
    few = words.limit(most + 1).count() <= most
    return rows.join(F.broadcast(words), words.columns, "left_semi") if few else rows


QKEYS_SQL = """(SELECT o_custkey AS section, o_orderkey AS id, 'q' || (o_orderkey % 23) AS k FROM orders UNION SELECT o_custkey, o_orderkey, 'example' || (o_orderkey % 19) FROM orders WHERE o_orderkey % 3 = 0)"""
QREFS_SQL = "(SELECT o_custkey AS section, o_orderkey AS ref, CASE o_orderkey % 3 WHEN 0 THEN 'q' || (o_orderkey % 7) WHEN 1 THEN 'example' || (o_orderkey % 19) ELSE 'q' || (o_orderkey % 29) || '.a' END AS r FROM orders WHERE o_orderkey % 2 = 0)"


@query(f"""WITH h AS (SELECT r.section, r.ref, k.id, CASE WHEN r.r = k.k THEN 0 ELSE 1 END AS pri FROM {QREFS_SQL} r JOIN {QKEYS_SQL} k ON k.section = r.section AND (r.r = k.k OR contains(k.k, r.r) OR contains(r.r, k.k)))
SELECT ref, id, CASE WHEN pri = 0 THEN 'equal' ELSE 'part' END AS how FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY pri, id) AS nth FROM h) WHERE nth = 1""")
def reference_match(spark, d):
    """Free-text references to questions of their section: an equal key first, else one that is part of the other.

    All stretches of a key are join keys, so no reference is compared with all questions of its section; keys are short. Of a
    section's equal keys the least id counts, and equal references are looked up once. What is exploded is far larger than its
    table's files, by which Spark would choose a side to broadcast, so these joins are told to shuffle.
    """
    k = F.col("o_orderkey")
    orders = table(spark, d, "orders")
    number, example = F.concat(F.lit("q"), (k % 23).cast("string")), F.concat(F.lit("example"), (k % 19).cast("string"))
    keys = orders.select(F.col("o_custkey").alias("section"), k.alias("id"), F.explode(F.array_compact(F.array(number, F.when(k % 3 == 0, example)))).alias("k"))
    ref = F.when(k % 3 == 0, F.concat(F.lit("q"), (k % 7).cast("string"))).when(k % 3 == 1, example).otherwise(F.concat(F.lit("q"), (k % 29).cast("string"), F.lit(".a")))
    refs = orders.filter("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("section"), k.alias("ref"), ref.alias("r"))
    first, wanted = keys.groupBy("section", "k").agg(F.min("id").alias("id")), refs.select("section", "r").distinct()
    every = lambda c: F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.transform(F.sequence(F.lit(1), F.length(c) - i + 1), lambda n: F.substr(c, i, n))))))
    of_keys = present(first.select("section", "id", "k", every(F.col("k")).alias("r")), refs.select("r"))
    in_key = of_keys.groupBy("section", "r").agg(F.min(F.struct((F.col("r") != F.col("k")).cast("int").alias("pri"), "id")).alias("m"))
    of_refs = present(wanted.select("section", "r", every(F.col("r")).alias("k")).filter("r != k"), keys.select("k"))
    in_ref = of_refs.join(first.hint("merge"), ["section", "k"]).groupBy("section", "r").agg(F.min(F.struct(F.lit(1).alias("pri"), "id")).alias("m"))
    best = in_key.unionByName(in_ref).groupBy("section", "r").agg(F.min("m").alias("m"))
    rows = refs.join(best.hint("merge"), ["section", "r"])
    return rows.select("ref", "m.id", F.when(F.col("m.pri") == 0, "equal").otherwise("part").alias("how"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_linenumber % 4 > 0 THEN l_suppkey END NULLS LAST, l_linenumber, l_partkey) AS place FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE l_returnflag <> 'R' AND l_linenumber % 5 > 0 AND l_linestatus = 'O' AND p_size > 5""")
def visible_figures(spark, d):
    """Figures to show of a context: not hidden, attached, with an image; in order of their place, without one at the end."""
    refs = table(spark, d, "lineitem").filter("l_returnflag <> 'R' and l_linenumber % 5 > 0 and l_linestatus = 'O'")
    have = table(spark, d, "part").filter("p_size > 5").select(F.col("p_partkey").alias("l_partkey"))
    rows = refs.select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_linenumber") % 4 > 0, F.col("l_suppkey")).alias("at")).join(have, "l_partkey")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.col("at").asc_nulls_last(), "l_linenumber", "l_partkey"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", place.alias("place"))


@query(f"""WITH t AS (SELECT id, book, p1 - p0 AS span FROM {SECTIONS_SQL}), c AS (SELECT b.block, s.id, row_number() OVER (PARTITION BY b.block ORDER BY s.p1 - s.p0, s.id) AS nth FROM {CONTAINING_SQL})
SELECT CAST(block % 61 AS BIGINT) AS figure, count(*) AS n_refs, count(DISTINCT id) AS n_sections, min(id) AS first_section, count(*) FILTER (block % 3 = 0) AS n_question, CASE WHEN count(*) FILTER (block % 3 = 0) > 0 AND count(*) FILTER (block % 3 > 0) > 0 THEN 'both' WHEN count(*) FILTER (block % 3 = 0) > 0 THEN 'question' ELSE 'theory' END AS context
FROM c WHERE nth = 1 GROUP BY figure""")
def figure_candidates(spark, d):
    """Figures with the sections that their mentions fall into: several references of one figure, and in which contexts."""
    tight = J.first_by(containing(spark, d), ["block"], F.col("p1") - F.col("p0"), F.col("id"))
    question = F.col("block") % 3 == 0
    rows = tight.groupBy((F.col("block") % 61).alias("figure")).agg(
        F.count("*").alias("n_refs"), F.count_distinct("id").alias("n_sections"), F.min("id").alias("first_section"), F.count_if(question).alias("n_question")
    )
    context = F.when((F.col("n_question") > 0) & (F.col("n_question") < F.col("n_refs")), "both").when(F.col("n_question") > 0, "question").otherwise("theory")
    return rows.withColumn("context", context)


# ---------------------------------------------------------------- trees


@query(f"""WITH n AS {NODES_SQL} SELECT {KEY_SQL.format('a.path')} AS node, (SELECT {KEY_SQL.format('min(b.path)')} FROM n b WHERE b.path > a.path AND b.path[1:len(a.path)] <> a.path) AS next_node FROM n a WHERE len(a.path) <= 3""")
def next_non_descendant(spark, d):
    """The first node after each node's whole subtree."""
    return T.next_outside(nodes(spark, d)).filter(F.size("path") <= 3).select(key().alias("node"), key("next_path").alias("next_node"))


@query(f"""WITH n AS {NODES_SQL} SELECT {KEY_SQL.format('a.path')} AS node, (SELECT {KEY_SQL.format('min(w.path)')} FROM n w WHERE len(w.path) IN (2, 3) AND w.path[len(w.path)] % 2 = 0 AND a.path[1:len(w.path)] = w.path) AS wrapper FROM n a WHERE len(a.path) >= 2""")
def wrapper_ancestor(spark, d):
    """The highest wrapper (here: nations and customers with even keys) that contains a node, itself included."""
    n = nodes(spark, d).select("path").filter(F.size("path") >= 2)
    wrappers = n.filter((F.size("path") <= 3) & (F.element_at("path", -1) % 2 == 0)).select(F.col("path").alias("up"))
    found = T.prefixes(n, own=True).join(wrappers, "up").groupBy("path").agg(F.min("up").alias("wrapper"))
    return n.join(found, "path", "left").select(key().alias("node"), key("wrapper").alias("wrapper"))


@query(f"""WITH n AS {NODES_SQL}, p AS (SELECT path, p0, p1, unnest(range(p0, p1 + 1)) AS page FROM n WHERE len(path) = 3), c AS (SELECT DISTINCT path[1:3] AS path, unnest(range(p0, p1 + 1)) AS page FROM n WHERE len(path) = 4)
SELECT {KEY_SQL.format('p.path')} AS node, count(*) FILTER (c.page IS NULL) AS n_own, CAST(min(p.page) FILTER (c.page IS NULL) AS INTEGER) AS first_own, count(c.page) = count(*) AS covered FROM p LEFT JOIN c ON c.path = p.path AND c.page = p.page GROUP BY p.path""")
def extraction_units(spark, d):
    """Pages of a section that none of its children covers; sections that are covered wholly are no unit of their own."""
    n = nodes(spark, d)
    own = n.filter(F.size("path") == 3).select("path", F.explode(F.sequence("p0", "p1")).alias("page"))
    taken = n.filter(F.size("path") == 4).select(F.slice("path", 1, 3).alias("path"), F.explode(F.sequence("p0", "p1")).alias("page")).distinct().withColumn("hit", F.lit(True))
    rows = own.join(taken, ["path", "page"], "left").groupBy("path").agg(
        F.count_if(F.col("hit").isNull()).alias("n_own"), F.min(F.when(F.col("hit").isNull(), F.col("page"))).alias("first_own"), F.count("*").alias("n"), F.count("hit").alias("hits")
    )
    return rows.select(key().alias("node"), "n_own", "first_own", (F.col("hits") == F.col("n")).alias("covered"))


ENTRIES_SQL = f"""(SELECT path[1:3] AS book, len(path) = 3 AS container, path, CASE WHEN path[len(path)] % 11 <> 0 THEN p0 END AS p0, p1 FROM {NODES_SQL} WHERE len(path) >= 3)"""


@query(f"""WITH e AS {ENTRIES_SQL}, m AS (SELECT book, min(p0) FILTER (NOT container) AS first_child, max(CASE WHEN container THEN p1 END) AS wrapper_end FROM e GROUP BY book),
o AS (SELECT e.*, first_child, wrapper_end, last_value(e.p0 IGNORE NULLS) OVER (PARTITION BY e.book ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e JOIN m ON m.book = e.book),
s AS (SELECT *, CASE WHEN container AND first_child < coalesce(p0, before) THEN first_child ELSE coalesce(p0, before) END AS start FROM o),
n AS (SELECT *, CASE WHEN container THEN first_child ELSE (SELECT min(x.p0) FROM s x WHERE x.book = s.book AND NOT x.container AND struct_pack(p := x.p0, q := x.path) > struct_pack(p := s.start, q := s.path)) END AS stop FROM s),
z AS (SELECT *, least(coalesce(stop, wrapper_end, p1), 90) AS fin FROM n)
SELECT {KEY_SQL.format('path')} AS node, start AS page_start, CASE WHEN start IS NOT NULL AND start <= 90 AND fin >= start THEN fin END AS page_end, CASE WHEN start IS NULL THEN 'no start' WHEN start > 90 THEN 'out of bounds' WHEN fin < start THEN 'end before start' ELSE 'ok' END AS status FROM z""")
def slice_spec(spark, d):
    """The pages of each section's slice: its start, or that of the section before; up to the next start, else the wrapper's end; or what is wrong.

    A container ends where its first child begins, and begins no later. Pages beyond the last one (here: 90) are cut off.
    """
    e = nodes(spark, d).filter(F.size("path") >= 3).select(
        F.slice("path", 1, 3).alias("book"), (F.size("path") == 3).alias("container"), "path", F.when(F.element_at("path", -1) % 11 != 0, F.col("p0")).alias("p0"), "p1"
    )
    every = Window.partitionBy("book")
    child = F.when(~F.col("container"), F.col("p0"))
    before = F.last("p0", ignorenulls=True).over(W.before(["book"], "path"))
    e = e.withColumns({"first": F.min(child).over(every), "wrapper": F.max(F.when(F.col("container"), F.col("p1"))).over(every), "start": F.coalesce("p0", before)})
    e = e.withColumn("start", F.when(F.col("container") & (F.col("first") < F.col("start")), F.col("first")).otherwise(F.col("start")))
    # the next start in order of pages, then of the tree; entries without a page of their own stop nothing
    line = Window.partitionBy("book").orderBy("start", "path").rowsBetween(1, Window.unboundedFollowing)
    stop = F.when(F.col("container"), F.col("first")).otherwise(F.first(child, ignorenulls=True).over(line))
    e = e.withColumn("end", F.least(F.coalesce(stop, F.col("wrapper"), F.col("p1")), F.lit(90)))
    status = F.when(F.col("start").isNull(), "no start").when(F.col("start") > 90, "out of bounds").when(F.col("end") < F.col("start"), "end before start").otherwise("ok")
    return e.select(key().alias("node"), F.col("start").alias("page_start"), F.when(status == "ok", F.col("end")).alias("page_end"), status.alias("status"))


@query(f"""WITH s AS (SELECT id, book, p0, p1, lead(p0) OVER (PARTITION BY book ORDER BY id) AS bound FROM {SECTIONS_SQL}), b AS (SELECT *, CASE WHEN id % 7 = 0 THEN bound - 1 ELSE bound END AS fin FROM s)
SELECT id, CASE WHEN fin < p1 AND fin >= p0 AND (fin - p0 + 1) * 2 >= p1 - p0 + 1 THEN fin ELSE p1 END AS page_end FROM b""")
def narrowed_ends(spark, d):
    """A section ends where the next heading stands (a page before, if that is at the top), if that leaves half of its pages at least."""
    bound = F.lead("p0").over(Window.partitionBy("book").orderBy("id"))
    s = sections(spark, d).withColumn("at", bound - F.when(F.col("id") % 7 == 0, 1).otherwise(0))
    fits = (F.col("at") < F.col("p1")) & (F.col("at") >= F.col("p0")) & ((F.col("at") - F.col("p0") + 1) * 2 >= F.col("p1") - F.col("p0") + 1)
    return s.select("id", F.when(fits, F.col("at")).otherwise(F.col("p1")).alias("page_end"))


@query(f"""WITH o AS (SELECT book, lower(trim(title)) AS t, p0, min(id) AS old FROM {SECTIONS_SQL} WHERE id % 3 = 0 GROUP BY ALL)
SELECT s.id, CASE WHEN o.old IS NOT NULL THEN 'old-' || o.old ELSE sha256(s.book || '|' || lower(trim(s.title)) || '|' || s.p0 || '|' || s.id) END AS uuid FROM {SECTIONS_SQL} s LEFT JOIN o ON o.book = s.book AND o.t = lower(trim(s.title)) AND o.p0 = s.p0""")
def preserved_ids(spark, d):
    """Sections keep the id that their title and first page had before; others get one from their own key."""
    s = sections(spark, d).withColumn("t", F.lower(F.trim("title")))
    old = s.filter("id % 3 = 0").groupBy("book", "t", "p0").agg(F.min("id").alias("old"))
    fresh = F.sha2(F.concat_ws("|", "book", "t", "p0", "id"), 256)
    return s.join(old, ["book", "t", "p0"], "left").select("id", F.coalesce(F.concat(F.lit("old-"), F.col("old").cast("string")), fresh).alias("uuid"))


# ---------------------------------------------------------------- blocks

KINDS = ["body", "list_item", "widget", "equation", "kp", "figure"]
KIND_SQL = f"{sql_list(KINDS)}[turn % {len(KINDS)} + 1]"


def typed(spark, d):
    """Turns as blocks whose raw types are dealt by their place."""
    raw = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("turn") % len(KINDS) + 1).cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", raw.alias("raw"), X.text_or_empty(F.col("text")).alias("text"))


@query(f"""WITH r AS (SELECT conv_id, turn, {KIND_SQL} AS raw, coalesce(text, '') AS text FROM conversations), t AS (SELECT *, {sql_lookup('lower(trim(raw))', NAMES, 'p')} AS type, NOT list_contains({sql_list(NAMES)}, lower(trim(raw))) AS coerced, trim(text) = '' AS blank, regexp_matches(lower(text), {quoted(R.SOLUTION_START)}) AS bleed FROM r),
k AS (SELECT *, NOT blank AND NOT bleed AS keep FROM t), l AS (SELECT *, lag(type) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM k WHERE keep), m AS (SELECT conv_id, count(*) FILTER (NOT (type = 'list_item' AND coalesce(p = 'list_item', false))) AS n_out FROM l GROUP BY conv_id)
SELECT k.conv_id, count(*) AS n_in, coalesce(any_value(n_out), 0) AS n_out, count(*) FILTER (coerced) AS n_coerced, count(*) FILTER (blank) AS n_empty, count(*) FILTER (bleed AND NOT blank) AS n_bleed, round(count(*) FILTER (NOT keep) / count(*), 9) AS drop_ratio FROM k LEFT JOIN m ON m.conv_id = k.conv_id GROUP BY k.conv_id""")
def normalised_blocks(spark, d):
    """Blocks of each section after normalising: types resolved, empty ones and bleeding solutions dropped, list items joined; with counts of each."""
    t = typed(spark, d).withColumns({"type": B.block_type(F.col("raw")), "coerced": B.is_coerced(F.col("raw")), "blank": F.trim("text") == ""})
    t = t.withColumn("bleed", F.lower("text").rlike(R.SOLUTION_START) & ~F.col("blank")).withColumn("keep", ~F.col("blank") & ~F.col("bleed"))
    # the block before that stays
    last = F.last(F.when(F.col("keep"), F.col("type")), ignorenulls=True).over(W.before(["conv_id"], "turn"))
    t = t.withColumn("joined", (F.col("type") == "list_item") & F.coalesce(last == "list_item", F.lit(False)))
    n = t.groupBy("conv_id").agg(
        F.count("*").alias("n_in"), F.count_if(F.col("keep") & ~F.col("joined")).alias("n_out"), F.count_if("coerced").alias("n_coerced"), F.count_if("blank").alias("n_empty"),
        F.count_if("bleed").alias("n_bleed"), F.round(F.count_if(~F.col("keep")) / F.count("*"), 9).alias("drop_ratio"),
    )
    return n


@query(f"""WITH b AS (SELECT conv_id, turn, {KIND_SQL} AS raw, trim(coalesce(text, '')) AS text FROM conversations WHERE trim(coalesce(text, '')) <> ''),
i AS (SELECT *, count(*) FILTER (raw <> 'equation') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS bullet FROM b)
SELECT conv_id, bullet, count(*) AS n_parts, sha1(string_agg(text, ' ' ORDER BY turn)) AS hash FROM i GROUP BY ALL""")
def redistributed_bullets(spark, d):
    """Bullets out of blocks: an equation is glued to the bullet before it; equations before any bullet are one of their own."""
    b = typed(spark, d).withColumn("text", F.trim("text")).filter("text <> ''")
    b = b.withColumn("bullet", F.count_if(F.col("raw") != "equation").over(W.upto(["conv_id"], "turn")))
    glued = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ")
    return b.groupBy("conv_id", "bullet").agg(F.count("*").alias("n_parts"), F.sha1(glued).alias("hash"))


CHIPS_SQL = """(SELECT l_orderkey AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos, l_linenumber % 2 = 1 AS chip, l_suppkey % 3 AS number FROM lineitem)"""


@query(f"""WITH b AS {CHIPS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY s, chip, number ORDER BY pos) AS k FROM b), m AS (SELECT c.s, c.pos, q.pos AS question FROM r c JOIN r q ON q.s = c.s AND q.number = c.number AND q.k = c.k AND c.chip AND NOT q.chip),
g AS (SELECT b.s, b.pos, b.chip, m.question, NOT EXISTS (SELECT 1 FROM m x WHERE x.s = b.s AND x.pos = b.pos) AND b.chip AS stays FROM b LEFT JOIN m ON m.s = b.s AND m.pos = b.pos),
w AS (SELECT *, sum(stays::INT) OVER (PARTITION BY s ORDER BY pos ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT s, pos, question, CASE WHEN stays THEN n - 1 END::BIGINT AS new_pos, CASE WHEN question IS NOT NULL THEN n - 1 END::BIGINT AS anchor FROM w WHERE chip""")
def inlined_questions(spark, d):
    """Chips take the questions of their number in turn; chips that got one go, the others' places are counted anew, and a question stands after the last that stays before it (-1: at the begin)."""
    line = Window.partitionBy("s").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("s"), "l_linenumber", "l_partkey", "l_suppkey")
    b = b.select("s", (F.row_number().over(line) - 1).alias("pos"), (F.col("l_linenumber") % 2 == 1).alias("chip"), (F.col("l_suppkey") % 3).alias("number"))
    b = b.withColumn("k", F.row_number().over(Window.partitionBy("s", "chip", "number").orderBy("pos")))
    questions = b.filter("not chip").select("s", "number", "k", F.col("pos").alias("question"))
    chips = b.filter("chip").join(questions, ["s", "number", "k"], "left")
    n = F.sum(F.when(F.col("question").isNull(), 1).otherwise(0)).over(W.upto(["s"], "pos"))
    return chips.select("s", "pos", "question", F.when(F.col("question").isNull(), n - 1).alias("new_pos"), F.when(F.col("question").isNotNull(), n - 1).alias("anchor"))


@query("""WITH q AS (SELECT conv_id, count(*) FILTER (role = 'user') AS n, count(*) FILTER (role = 'user' AND contains(coalesce(text, ''), 'e')) AS solved FROM conversations GROUP BY conv_id),
w AS (SELECT conv_id, conv_id % 2 = 0 AND n = 1 AND solved = 1 AS duplicate FROM q)
SELECT c.conv_id, c.turn FROM conversations c JOIN w ON w.conv_id = c.conv_id WHERE NOT duplicate OR (role <> 'user' AND turn % 3 = 0)""")
def duplicate_solutions(spark, d):
    """A worked example with exactly one question, and that solved, repeats its solution: its blocks go, figures at its end stay."""
    b = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    question = F.col("role") == "user"
    solved = question & F.contains(X.text_or_empty(F.col("text")), F.lit("e"))
    q = b.groupBy("conv_id").agg(F.count_if(question).alias("n"), F.count_if(solved).alias("solved")).filter("conv_id % 2 = 0 and n = 1 and solved = 1").select("conv_id", F.lit(True).alias("duplicate"))
    rows = b.join(q, "conv_id", "left")
    return rows.filter(F.col("duplicate").isNull() | (~question & (F.col("turn") % 3 == 0))).select("conv_id", "turn")


ANCHOR_SQL = "CASE role WHEN 'user' THEN 'term' || turn || ': ' || text || ' ' || text || ' term' || turn WHEN 'system' THEN 'Fig ' || turn || ' caption' ELSE text || ' ' || turn END"


@query(f"SELECT conv_id, turn, sha1(concat_ws(' ', {ANCHOR_SQL}, 'x = 1', 'a b')) AS pool FROM conversations")
def anchor_pool(spark, d):
    """All words of a block by which a figure may be anchored, a definition's term first, in a fixed order of fields."""
    b = table(spark, d, "conversations")
    kind, text, turn = F.col("role"), F.col("text"), F.col("turn").cast("string")
    term = F.when(kind == "user", F.concat(F.lit("term"), turn))
    pool = F.concat_ws(
        " ", F.concat(term, F.lit(": "), text), F.when(kind != "system", text), F.when(kind == "system", F.concat(F.lit("Fig "), turn)), term, F.when(kind == "system", F.lit("caption")),
        F.when(~kind.isin("user", "system"), turn), F.array(F.lit("x = 1")), F.flatten(F.array(F.array(F.lit("a"), F.lit("b")))),
    )
    return b.filter("text is not null").select("conv_id", "turn", F.sha1(pool).alias("pool"))


# ---------------------------------------------------------------- reviews, statuses, corrections


@query("""WITH r AS (SELECT doc_id, ['verbatim', 'paraphrased', 'not_verbatim', 'hallucinated', NULL][doc_id % 5 + 1] AS verdict, CASE WHEN doc_id % 4 > 0 THEN (doc_id % 100) / 100.0 END::DOUBLE AS ratio, CASE WHEN doc_id % 2 = 0 THEN 'passed' ELSE 'flagged' END AS status, (doc_id % 37) / 37.0::DOUBLE AS score FROM documents)
SELECT doc_id, CASE verdict WHEN 'verbatim' THEN 'passed' WHEN 'paraphrased' THEN 'flagged' WHEN 'not_verbatim' THEN 'failed' WHEN 'hallucinated' THEN 'failed' ELSE status END AS status,
round(CASE verdict WHEN 'verbatim' THEN greatest(coalesce(ratio, 0), score, 0.95) WHEN 'paraphrased' THEN greatest(coalesce(ratio, 0.8), 0.8) WHEN 'not_verbatim' THEN least(coalesce(ratio, 0), 0.5) WHEN 'hallucinated' THEN 0 ELSE score END, 9)::DOUBLE AS score FROM r""")
def reconciled_reviews(spark, d):
    """The first review's verdict overrides the second's where it has one; scores are bounded by the verdict."""
    k = F.col("doc_id")
    verdict = F.get(F.array(*map(F.lit, ["verbatim", "paraphrased", "not_verbatim", "hallucinated", None])), (k % 5).cast("int"))
    both = B.reconciled(verdict, F.when(k % 4 > 0, (k % 100) / 100.0), F.when(k % 2 == 0, "passed").otherwise("flagged"), (k % 37) / 37.0)
    return table(spark, d, "documents").select("doc_id", both.alias("r")).select("doc_id", "r.status", F.round("r.score", 9).alias("score"))


@query("""SELECT c_custkey AS book, count(o_orderkey) AS total, count(*) FILTER (o_orderstatus = 'F') AS failed, CASE WHEN count(o_orderkey) = 0 OR count(*) FILTER (o_orderstatus = 'F') = 0 THEN 'done' WHEN count(*) FILTER (o_orderstatus = 'F') = count(o_orderkey) THEN 'failed' ELSE 'partial' END AS status
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def theory_status(spark, d):
    """A stage's status from the number of its failures."""
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("book")).agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("failed"))
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("book")).join(n, "book", "left").na.fill(0, ["total", "failed"])
    return rows.withColumn("status", B.stage_status(F.col("total"), F.col("failed")))


@query("""WITH b AS (SELECT o_custkey AS bank, CASE o_orderkey % 6 WHEN 0 THEN 'Crossword' WHEN 1 THEN 'Quick Check' ELSE 'Section' END AS title, CAST(o_orderkey % 9 AS INTEGER) AS expected, CAST(o_orderkey % 4 AS INTEGER) AS got, CASE WHEN o_orderkey % 9 > o_orderkey % 4 THEN 'partial' ELSE 'complete' END AS status FROM orders),
f AS (SELECT *, regexp_matches(lower(title), 'crossword|quick check') AS bogus FROM b)
SELECT bank, CAST(greatest(0, sum(expected) - 2 - coalesce(sum(expected) FILTER (bogus), 0)) AS BIGINT) AS expected, CAST(greatest(0, sum(got) - coalesce(sum(got) FILTER (bogus), 0)) AS BIGINT) AS got,
greatest(0, count(*) FILTER (status = 'partial') - count(*) FILTER (bogus AND status = 'partial')) AS partial FROM f GROUP BY bank""")
def corrected_stats(spark, d):
    """Stored totals without what blocks that hold no questions had put into them, never below 0."""
    k = F.col("o_orderkey")
    title = F.when(k % 6 == 0, "Crossword").when(k % 6 == 1, "Quick Check").otherwise("Section")
    b = table(spark, d, "orders").select(F.col("o_custkey").alias("bank"), R.any_of(title, ["crossword", "quick check"]).alias("bogus"), (k % 9).alias("expected"), (k % 4).alias("got"), (k % 9 > k % 4).alias("partial"))
    less = lambda total, out: F.greatest(F.lit(0).cast("long"), total - F.coalesce(out, F.lit(0)))
    only = lambda c: F.sum(F.when(F.col("bogus"), F.col(c)))
    return b.groupBy("bank").agg(
        less(F.sum("expected") - 2, only("expected")).alias("expected"), less(F.sum("got"), only("got")).alias("got"), less(F.count_if("partial"), F.count_if(F.col("partial") & F.col("bogus"))).alias("partial")
    )


@query("""WITH e AS (SELECT user_id, event_id, event_type, ts, ts + INTERVAL 30 MINUTE AS due FROM events), s AS (SELECT * FROM e WHERE event_type = 'click'), n AS (SELECT s.event_id, min(e.ts) AS done FROM s JOIN e ON e.user_id = s.user_id AND e.event_type = 'purchase' AND e.ts > s.ts GROUP BY s.event_id)
SELECT s.user_id, s.event_id, CASE WHEN n.done IS NOT NULL AND n.done <= s.due THEN 'verified' WHEN s.due <= (SELECT max(ts) FROM events) THEN 'again' ELSE 'waiting' END AS action FROM s LEFT JOIN n ON n.event_id = s.event_id""")
def delayed_verification(spark, d):
    """Each start is looked at again after half an hour: verified if its end has come by then, else sent again, or waiting."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    top = e.agg(F.max("ts").alias("top")).first()["top"]
    e = e.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    later = Window.partitionBy("user_id").orderBy("at").rangeBetween(1, Window.unboundedFollowing)
    end = F.when(F.col("event_type") == "purchase", F.col("at"))
    rows = e.withColumn("done", F.first(end, ignorenulls=True).over(later))
    due = F.col("at") + 30 * 60 * 1_000_000
    action = F.when(F.col("done") <= due, "verified").when(due <= F.unix_micros(F.lit(top).cast("timestamp")), "again").otherwise("waiting")
    return rows.filter("event_type = 'click'").select("user_id", "event_id", action.alias("action"))


# ---------------------------------------------------------------- validators of content

CT_SQL = f"(SELECT *, CASE WHEN id % 4 = 0 THEN ['questions'] WHEN id % 9 = 0 THEN ['theory', 'questions'] WHEN id % 13 = 0 THEN [] ELSE ['theory'] END AS ct, CASE WHEN id % 8 = 0 THEN 'Example ' || (id % 5) || '.' || (id % 3) WHEN id % 20 = 0 THEN 'Answers' ELSE title END AS head FROM {SECTIONS_SQL})"


@query(f"""WITH s AS {CT_SQL}, a AS (SELECT *, list_contains(ct, 'questions') AS cat_a, list_contains(ct, 'theory') AS cat_b FROM s WHERE TRUE),
f AS (SELECT *, coalesce(max(cat_b::INT) OVER (PARTITION BY book, level ORDER BY id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) = 1 AS theory_after FROM a), t AS (SELECT book, max(p1) AS last FROM a WHERE cat_b AND level > 1 GROUP BY book),
p AS (SELECT c.id, c.book, c.p0, q.id AS parent, q.p0 AS q0, q.p1 AS q1 FROM a c JOIN a q ON q.book = c.book AND q.level = c.level - 1 AND q.id = (c.id // 7) * 7 + q.level WHERE c.cat_a AND NOT c.cat_b AND q.cat_b AND (c.p0 < q.p0 OR c.p0 > q.p1))
SELECT 'content_types' AS type, id, 'error' AS severity, CASE WHEN len(ct) = 0 THEN 'empty' ELSE 'combination' END AS detail FROM s WHERE len(ct) = 0 OR len(ct) = 2
UNION ALL SELECT 'bank_at_end', id, 'warning', CASE WHEN lower(head) = 'answers' THEN 'help' ELSE 'position' END FROM f WHERE cat_a AND NOT regexp_matches(head, '[0-9]+[.][0-9]+') AND (lower(head) = 'answers' OR NOT theory_after)
UNION ALL SELECT 'empty_schema', c_custkey, 'error', 'pages ' || (c_custkey % 5) FROM customer WHERE c_custkey % 5 > 1 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
UNION ALL SELECT 'excluded_too_early', s.id, 'error', 'last ' || t.last FROM s JOIN t ON t.book = s.book WHERE s.id % 10 = 3 AND s.p0 < t.last
UNION ALL SELECT 'outside_theory', p.id, 'warning', coalesce(CAST((SELECT x.id FROM a x WHERE x.book = p.book AND x.cat_b AND x.id <> p.parent AND p.p0 BETWEEN x.p0 AND x.p1 ORDER BY x.level DESC, x.id LIMIT 1) AS VARCHAR), 'none') FROM p""")
def validator_content(spark, d):
    """Rules on what sections hold: content types, question banks at the end of a chapter, empty schemas, excluded parts before the end of theory, questions outside their theory (with the section where they would belong)."""
    k = F.col("id")
    arrays = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    ct = F.when(k % 4 == 0, arrays("questions")).when(k % 9 == 0, arrays("theory", "questions")).when(k % 13 == 0, arrays()).otherwise(arrays("theory"))
    head = F.when(k % 8 == 0, F.concat(F.lit("Example "), (k % 5).cast("string"), F.lit("."), (k % 3).cast("string"))).when(k % 20 == 0, "Answers").otherwise(F.col("title"))
    s = sections(spark, d).withColumns({"ct": ct, "head": head})
    s = s.withColumns({"cat_a": F.array_contains("ct", "questions"), "cat_b": F.array_contains("ct", "theory")})
    out = lambda df, type_, severity, detail: df.select(F.lit(type_).alias("type"), F.col("id").cast("long").alias("id"), F.lit(severity).alias("severity"), detail.alias("detail"))
    verdict = B.content_verdict(F.col("ct"))
    found = out(s.filter(verdict.isNotNull()), "content_types", "error", verdict)
    after = F.coalesce(F.max(F.col("cat_b").cast("int")).over(W.after(["book", "level"], "id")), F.lit(0)) == 1
    help_ = F.lower("head").isin(B.HELP_TITLES)
    banks = s.withColumn("after", after).filter(F.col("cat_a") & ~F.col("head").rlike("[0-9]+[.][0-9]+") & (help_ | ~F.col("after")))
    found = found.unionByName(out(banks, "bank_at_end", "warning", F.when(help_, "help").otherwise("position")))
    books = table(spark, d, "customer").select(F.col("c_custkey").alias("id")).filter("id % 5 > 1").join(s.select(F.col("book").alias("id")), "id", "left_anti")
    found = found.unionByName(out(books, "empty_schema", "error", F.concat(F.lit("pages "), (F.col("id") % 5).cast("string"))))
    last = s.filter("cat_b and level > 1").groupBy("book").agg(F.max("p1").alias("last"))
    early = s.filter("id % 10 = 3").join(last, "book").filter("p0 < last")
    found = found.unionByName(out(early, "excluded_too_early", "error", F.concat(F.lit("last "), F.col("last").cast("string"))))
    parents = s.filter("cat_b").select("book", F.col("level").alias("pl"), F.col("id").alias("parent"), F.col("p0").alias("q0"), F.col("p1").alias("q1"))
    child = s.filter("cat_a and not cat_b").withColumns({"pl": F.col("level") - 1, "parent": F.floor(F.col("id") / 7) * 7 + F.col("level") - 1})
    child = child.join(parents, ["book", "pl", "parent"]).filter("p0 < q0 or p0 > q1").select("book", "id", "parent", F.col("p0").alias("at"))
    would = J.range_join(child, s.filter("cat_b").select("book", F.col("id").alias("other"), "level", "p0", "p1"), ["book"], "at", "p0", "p1", 16).filter("other <> parent")
    would = J.first_by(would, ["id"], F.col("level").desc(), F.col("other")).select("id", "other")
    placed = child.join(would, "id", "left")
    return found.unionByName(out(placed, "outside_theory", "warning", F.coalesce(F.col("other").cast("string"), F.lit("none"))))


# ---------------------------------------------------------------- drafts


@query("""WITH chip AS (SELECT o_custkey AS book, o_orderkey AS child, o_orderkey % 5 AS pos FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_custkey, o_orderkey, o_orderkey % 4 FROM orders WHERE o_orderkey % 6 = 0),
used AS (SELECT book, child, min(pos) AS pos FROM chip GROUP BY ALL), slot AS (SELECT o_custkey AS book, o_orderkey AS child, coalesce(2 * u.pos + 2, 1000) AS slot FROM orders LEFT JOIN used u ON u.child = o_orderkey AND u.book = o_custkey),
item AS (SELECT c_custkey AS book, 'heading' AS item, 0 AS slot, 0 AS child, 0 AS a, 0 AS b, 0 AS c FROM customer
UNION ALL SELECT c_custkey, 'text ' || p, 2 * p + 1, 0, 0, 0, 0 FROM customer, range(0, 5) r(p) UNION ALL SELECT book, 'section ' || child, slot, child, 0, 0, 0 FROM slot
UNION ALL SELECT book, 'block ' || l_linenumber || ' of ' || child, slot, child, l_linenumber, l_partkey, l_suppkey FROM slot JOIN lineitem ON l_orderkey = child)
SELECT book, item, row_number() OVER (PARTITION BY book ORDER BY slot, child, a, b, c) AS place FROM item""")
def draft_seed(spark, d):
    """The items of a new draft: heading, texts, and at each reference the section that it names with its blocks, once; sections that nothing names come last."""
    k = F.col("o_orderkey")
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("book"), "o_orderkey")
    # a section stands at the first of its references: they are taken together before anything is placed
    at = F.array_compact(F.array(F.when(k % 3 == 0, k % 5), F.when(k % 6 == 0, k % 4)))
    slot = orders.select("book", k.alias("child"), F.coalesce(2 * F.array_min(at) + 2, F.lit(1000)).alias("slot"))
    zero = F.lit(0).cast("long")
    order = lambda *c: [x.cast("long").alias(n) for x, n in zip((*c, zero, zero, zero, zero, zero)[:5], ("slot", "child", "a", "b", "c"))]
    book = table(spark, d, "customer").select(F.col("c_custkey").alias("book"))
    text = book.select("book", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("p"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("child"), "l_linenumber", "l_partkey", "l_suppkey")
    name = F.col("child").cast("string")
    items = book.select("book", F.lit("heading").alias("item"), *order())
    items = items.unionByName(text.select("book", F.concat(F.lit("text "), F.col("p").cast("string")).alias("item"), *order(2 * F.col("p") + 1)))
    items = items.unionByName(slot.select("book", F.concat(F.lit("section "), name).alias("item"), *order(F.col("slot"), F.col("child"))))
    of = slot.join(lines, "child")
    block = F.concat(F.lit("block "), F.col("l_linenumber").cast("string"), F.lit(" of "), name)
    items = items.unionByName(of.select("book", block.alias("item"), *order(F.col("slot"), F.col("child"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"))))
    return items.select("book", "item", F.row_number().over(Window.partitionBy("book").orderBy("slot", "child", "a", "b", "c")).alias("place"))
