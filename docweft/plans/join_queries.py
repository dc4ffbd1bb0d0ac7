"""Queries for joins. Orders stand for the sections (page ranges) and the blocks (pages) of a book, which is their customer."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import joins as J
from ..sources.tables import table
from .registry import query

SECTIONS_SQL = """(SELECT o_custkey AS book, o_orderkey AS id, CAST(1 + o_orderkey % 3 AS INTEGER) AS level, CAST(1 + o_orderkey * 5 % 97 AS INTEGER) AS p0,
 CAST(1 + o_orderkey * 5 % 97 + o_orderkey % 13 AS INTEGER) AS p1, o_orderpriority AS title, o_orderstatus AS status FROM orders)"""
BLOCKS_SQL = "(SELECT o_custkey AS book, o_orderkey AS block, CAST(1 + o_orderkey * 7 % 103 AS INTEGER) AS page, o_totalprice AS weight FROM orders)"


def sections(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("book"), k.alias("id"), (1 + k % 3).cast("int").alias("level"), (1 + k * 5 % 97).cast("int").alias("p0"),
        (1 + k * 5 % 97 + k % 13).cast("int").alias("p1"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("status"),
    )


def blocks(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("book"), k.alias("block"), (1 + k * 7 % 103).cast("int").alias("page"), F.col("o_totalprice").alias("weight"))


def containing(spark, d):
    """Blocks with the sections whose pages contain theirs."""
    return J.range_join(blocks(spark, d), sections(spark, d), ["book"], "page", "p0", "p1", 16)


CONTAINING_SQL = f"{BLOCKS_SQL} b JOIN {SECTIONS_SQL} s ON s.book = b.book AND b.page BETWEEN s.p0 AND s.p1"


def first_sql(order: str, columns: str = "block, id") -> str:
    return f"SELECT {columns} FROM (SELECT b.block, s.*, row_number() OVER (PARTITION BY b.block ORDER BY {order}) AS nth FROM {CONTAINING_SQL}) WHERE nth = 1"


@query(first_sql("s.level DESC, s.id"))
def range_deepest(spark, d):
    """Each block to the deepest section that contains its page."""
    return J.first_by(containing(spark, d), ["block"], F.col("level").desc(), F.col("id")).select("block", "id")


@query(first_sql("s.p1 - s.p0, s.id"))
def range_tightest(spark, d):
    """Each block to the shortest section that contains its page."""
    return J.first_by(containing(spark, d), ["block"], F.col("p1") - F.col("p0"), F.col("id")).select("block", "id")


@query(f"""WITH c AS (SELECT b.block, s.id, s.p0, s.p1 FROM {CONTAINING_SQL}),
l AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c x WHERE x.block = c.block AND x.p0 >= c.p0 AND x.p1 <= c.p1 AND x.p1 - x.p0 < c.p1 - c.p0))
SELECT block, min(id) AS id FROM l GROUP BY block HAVING count(*) = 1""")
def range_unique_leaf(spark, d):
    """Each block to its only containing section without a smaller one inside, if there is just one."""
    c = containing(spark, d).select("block", "id", "p0", "p1")
    x = c.select(F.col("block").alias("b2"), F.col("p0").alias("x0"), F.col("p1").alias("x1"))
    inner = (F.col("block") == F.col("b2")) & (F.col("x0") >= F.col("p0")) & (F.col("x1") <= F.col("p1")) & (F.col("x1") - F.col("x0") < F.col("p1") - F.col("p0"))
    leaf = c.join(x, inner, "left_anti")
    return leaf.groupBy("block").agg(F.count("*").alias("n"), F.min("id").alias("id")).filter("n = 1").drop("n")


@query(f"""SELECT block, id FROM (SELECT b.block, s.id, row_number() OVER (PARTITION BY b.block ORDER BY s.p1 DESC, s.id) AS nth
FROM {BLOCKS_SQL} b JOIN {SECTIONS_SQL} s ON s.book = b.book AND abs(s.p1 - b.page) <= 1) WHERE nth = 1""")
def band_adjacent(spark, d):
    """Each block to the section that ends within a page of it, the latest such: three page keys make it an equi join."""
    near = blocks(spark, d).withColumn("p1", F.explode(F.sequence(F.col("page") - 1, F.col("page") + 1)))
    hits = near.join(sections(spark, d), ["book", "p1"])
    return J.first_by(hits, ["block"], F.col("p1").desc(), F.col("id")).select("block", "id")


@query(f"SELECT b.block, max(s.p0) AS p0 FROM {BLOCKS_SQL} b LEFT JOIN {SECTIONS_SQL} s ON s.book = b.book AND s.p0 <= b.page GROUP BY b.block")
def asof_backward(spark, d):
    """Each block with the last section start at or before its page."""
    right = sections(spark, d).select("book", F.col("p0").alias("page"), "p0")
    return J.asof_backward(blocks(spark, d).select("book", "block", "page"), right, ["book"], "page", "p0").select("block", "p0")


@query(f"""SELECT block, id, dist FROM (SELECT b.block, s.id, greatest(s.p0 - b.page, b.page - s.p1, 0) AS dist, row_number() OVER (PARTITION BY b.block ORDER BY greatest(s.p0 - b.page, b.page - s.p1, 0), s.id) AS nth
FROM {BLOCKS_SQL} b JOIN {SECTIONS_SQL} s ON s.book = b.book) WHERE nth = 1""")
def nearest_interval(spark, d):
    """Each block to the nearest section of its book, by the distance of its page to the range."""
    b, s = blocks(spark, d).select("book", "block", "page"), sections(spark, d)
    inside = containing(spark, d).groupBy("block").agg(F.min(F.struct(F.lit(0).alias("dist"), "id")).alias("inside"))
    # the last end before a page and the first start after it, each with the least id that has it
    ends = s.groupBy("book", (F.col("p1") + 1).alias("page")).agg(F.struct(F.first("p1").alias("p"), F.min("id").alias("id")).alias("left"))
    starts = s.groupBy("book", (1 - F.col("p0")).alias("page")).agg(F.struct(F.first("p0").alias("p"), F.min("id").alias("id")).alias("right"))
    rows = J.asof_backward(b, ends, ["book"], "page", "left").withColumn("page", -F.col("page"))
    rows = J.asof_backward(rows, starts, ["book"], "page", "right").withColumn("page", -F.col("page")).join(inside, "block", "left")
    side = lambda c, dist: F.when(F.col(c).isNotNull(), F.struct(dist.alias("dist"), F.col(f"{c}.id")))
    found = F.array_min(F.array_compact(F.array(F.col("inside"), side("left", F.col("page") - F.col("left.p")), side("right", F.col("right.p") - F.col("page")))))
    return rows.withColumn("m", found).filter("m is not null").select("block", "m.id", "m.dist")


@query(f"""SELECT a.id AS a, b.id AS b, least(a.p1, b.p1) - greatest(a.p0, b.p0) + 1 AS shared FROM {SECTIONS_SQL} a JOIN {SECTIONS_SQL} b ON a.book = b.book AND a.level = b.level AND a.id < b.id
WHERE least(a.p1, b.p1) - greatest(a.p0, b.p0) + 1 >= 2""")
def sibling_overlap(spark, d):
    """Sections of one level of a book that share two pages or more."""
    return J.overlapping(sections(spark, d), ["book", "level"], "id", "p0", "p1", 2)


@query(f"""SELECT c.id AS child, p.id AS parent FROM {SECTIONS_SQL} c JOIN {SECTIONS_SQL} p ON p.book = c.book AND p.level = c.level - 1 AND p.id = (c.id // 7) * 7 + p.level WHERE c.p0 < p.p0 OR c.p1 > p.p1""")
def outside_parent(spark, d):
    """Sections whose pages are not inside those of their parent."""
    c = sections(spark, d)
    p = c.select("book", F.col("id").alias("parent"), F.col("level").alias("pl"), F.col("p0").alias("q0"), F.col("p1").alias("q1"))
    c = c.withColumns({"pl": F.col("level") - 1, "parent": F.floor(F.col("id") / 7) * 7 + F.col("level") - 1})
    return c.join(p, ["book", "pl", "parent"]).filter((F.col("p0") < F.col("q0")) | (F.col("p1") > F.col("q1"))).select(F.col("id").alias("child"), "parent")


@query("SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O'")
def inner_refs(spark, d):
    """References with their targets; those without are dropped."""
    o = table(spark, d, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(o, "l_orderkey")


@query("SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'orphan' WHEN l.quality IS NULL THEN 'null' ELSE 'resolved' END AS outcome FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) GROUP BY outcome")
def composite_key_outcomes(spark, d):
    """How references resolve: resolved, orphan or null."""
    labels = table(spark, d, "labels").select("doc_id", "quality", F.lit(1).alias("hit"))
    outcome = F.when(F.col("hit").isNull(), "orphan").when(F.col("quality").isNull(), "null").otherwise("resolved")
    return table(spark, d, "documents").select("doc_id").join(labels, "doc_id", "left").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT o_orderkey, o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'")
def referenced_distinct(spark, d):
    """Orders that some returned line refers to, once each: a semi join needs no DISTINCT."""
    lines = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey", "left_semi")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def semi_join_keys(spark, d):
    """Rows whose key is in a set."""
    keys = table(spark, d, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_name").join(keys, "c_custkey", "left_semi")


@query("SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def anti_join_orphans(spark, d):
    """Rows without a counterpart."""
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def counts_left_default0(spark, d):
    """Counts on all keys, 0 where there is none; the counted side is aggregated before the join."""
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))




@query("""WITH k AS (SELECT doc_id, lower(trim(coalesce(text, ''))) AS t, source FROM documents), u AS (SELECT t, min(doc_id) AS target FROM k GROUP BY t HAVING count(*) = 1),
s AS (SELECT source, min(doc_id) AS target FROM k GROUP BY source)
SELECT k.doc_id, coalesce(l.doc_id, u.target, s.target) AS target, CASE WHEN l.doc_id IS NOT NULL THEN 'key' WHEN u.target IS NOT NULL THEN 'title' ELSE 'source' END AS method, CASE WHEN l.doc_id IS NOT NULL THEN 0.95 WHEN u.target IS NOT NULL THEN 0.7 ELSE 0.4 END::DOUBLE AS confidence
FROM k LEFT JOIN labels l ON l.doc_id = k.doc_id LEFT JOIN u ON u.t = k.t LEFT JOIN s ON s.source = k.source""")
def cascade_key_join(spark, d):
    """The first of three keys that finds a target: id, unique title, source."""
    k = table(spark, d, "documents").select("doc_id", F.lower(F.trim(X.text_or_empty(F.col("text")))).alias("t"), "source")
    u = J.unique_key(k.select("t", F.col("doc_id").alias("by_title")), "t", "by_title")
    s = k.groupBy("source").agg(F.min("doc_id").alias("by_source"))
    rows = k.join(table(spark, d, "labels").select("doc_id", F.col("doc_id").alias("by_key")), "doc_id", "left").join(u, "t", "left").join(s, "source", "left")
    target, method, sure = J.cascade(("key", F.col("by_key"), 0.95), ("title", F.col("by_title"), 0.7), ("source", F.col("by_source"), 0.4))
    return rows.select("doc_id", target.alias("target"), method.alias("method"), sure.alias("confidence"))


@query("""WITH k AS (SELECT doc_id, lower(trim(coalesce(text, ''))) AS t FROM documents)
SELECT t, min(doc_id) AS target FROM k GROUP BY t HAVING count(*) = 1""")
def unique_title_fallback(spark, d):
    """Titles that one document only has."""
    k = table(spark, d, "documents").select(F.lower(F.trim(X.text_or_empty(F.col("text")))).alias("t"), F.col("doc_id").alias("target"))
    return J.unique_key(k, "t", "target")




@query("""WITH a AS (SELECT item_id, lower(regexp_extract(text, '^[^.!?]{10,60}')) AS anchor FROM benchmark), h AS (SELECT a.item_id, d.doc_id FROM a JOIN documents d ON contains(lower(d.text), a.anchor) WHERE a.anchor <> '')
SELECT item_id, count(*) AS n, min(doc_id) AS first_doc, CASE WHEN count(*) = 1 THEN 'unique' ELSE 'many' END AS kind FROM h GROUP BY item_id""")
def contains_anchor(spark, d):
    """Documents that contain a benchmark item's opening words.

    Anchor and text meet on the rarest of the anchor's inner words, which are whole words of any text that contains it. Anchors without
    an inner word meet texts on their first ten characters, which are a window of such a text. No text is compared with all anchors.
    """
    anchor = F.lower(F.regexp_extract("text", "^[^.!?]{10,60}", 0))
    a = table(spark, d, "benchmark").select("item_id", anchor.alias("anchor")).filter("anchor <> ''")
    pieces = F.split("anchor", "[^a-z0-9]+")
    inner = F.array_distinct(F.filter(F.slice(pieces, 2, F.greatest(F.size(pieces) - 2, F.lit(0))), lambda w: w != ""))
    a = a.withColumn("inner", inner)
    docs = table(spark, d, "documents").select("doc_id", F.lower("text").alias("text"))
    words = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", "[^a-z0-9]+"))).alias("word"))
    keys = a.select("item_id", "anchor", F.explode("inner").alias("word"))
    often = words.join(keys.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n_docs"))
    rarest = J.first_by(keys.join(often, "word"), ["item_id", "anchor"], F.col("n_docs"), F.col("word")).select("item_id", "anchor", "word")
    near = words.join(rarest, "word").select("doc_id", "item_id", "anchor")
    short = a.filter(F.size("inner") == 0).select("item_id", "anchor", F.left("anchor", F.lit(10)).alias("window"))
    if not short.isEmpty():
        windows = docs.select("doc_id", F.explode(F.array_distinct(X.char_windows(F.col("text")))).alias("window"))
        near = near.unionByName(windows.join(short, "window").select("doc_id", "item_id", "anchor"))
    near = near.distinct()
    hits = near.join(docs, "doc_id").filter(F.contains("text", "anchor"))
    return hits.groupBy("item_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).withColumn("kind", F.when(F.col("n") == 1, "unique").otherwise("many"))


@query("""WITH t AS (SELECT DISTINCT n_name AS title FROM nation UNION SELECT r_name FROM region), c AS (SELECT p_partkey, lower(p_name) || ' ' || lower((SELECT n_name FROM nation WHERE n_nationkey = p_partkey % 25)) AS caption FROM part)
SELECT p_partkey, title FROM (SELECT p_partkey, title, row_number() OVER (PARTITION BY p_partkey ORDER BY length(title) DESC, title) AS nth FROM c JOIN t ON regexp_matches(' ' || regexp_replace(caption, '[^a-z0-9]+', ' ', 'g') || ' ', ' ' || regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g') || ' ')) WHERE nth = 1""")
def phrase_boundary(spark, d):
    """The longest title that stands in a caption between word boundaries; captions' word sequences are the join keys."""
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    titles = nation.select(F.col("n_name").alias("title")).union(table(spark, d, "region").select("r_name")).distinct()
    clean = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    titles = titles.withColumn("phrase", clean(F.col("title")))
    most = titles.agg(F.max(F.size(F.split("phrase", " ")))).first()[0] or 1
    parts = table(spark, d, "part").withColumn("n_nationkey", (F.col("p_partkey") % 25).cast("int")).join(nation, "n_nationkey")
    words = F.split(clean(F.concat_ws(" ", "p_name", "n_name")), " ")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(most)), lambda n: F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, i, n), " "))))
    hits = parts.select("p_partkey", F.explode(F.array_distinct(runs)).alias("phrase")).join(titles, "phrase")
    return J.first_by(hits, ["p_partkey"], F.length("title").desc(), F.col("title")).select("p_partkey", "title")


SLUG_SQL = "(SELECT CAST(o_orderkey % 40 AS VARCHAR) || '-' || CAST(o_orderkey % 7 AS VARCHAR) || '-' || o_orderkey AS slug, o_orderkey FROM orders)"


@query(f"""WITH s AS {SLUG_SQL}, n AS (SELECT DISTINCT CAST(c_custkey % 40 AS VARCHAR) AS id FROM customer UNION SELECT DISTINCT CAST(c_custkey % 40 AS VARCHAR) || '-' || CAST(c_custkey % 5 AS VARCHAR) FROM customer)
SELECT slug, id AS parent FROM (SELECT slug, id, row_number() OVER (PARTITION BY slug ORDER BY length(id) DESC) AS nth FROM s JOIN n ON starts_with(slug, id || '-')) WHERE nth = 1""")
def prefix_parent(spark, d):
    """The longest proper prefix of a slug that exists: each prefix is a join key."""
    k = F.col("o_orderkey")
    s = table(spark, d, "orders").select(F.concat_ws("-", k % 40, k % 7, k).alias("slug"))
    c = F.col("c_custkey")
    n = table(spark, d, "customer").select(F.explode(F.array((c % 40).cast("string"), F.concat_ws("-", c % 40, c % 5))).alias("parent")).distinct()
    parts = F.split("slug", "-")
    s = s.select("slug", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "-"))).alias("parent"))
    return J.first_by(s.join(n, "parent"), ["slug"], F.length("parent").desc()).select("slug", "parent")


@query("""WITH q AS (SELECT o_orderkey AS id, CAST(o_orderkey % 9 AS VARCHAR) || '.' || CAST(o_orderkey % 5 AS VARCHAR) || '.' || CAST(o_orderkey % 3 AS VARCHAR) AS num FROM orders),
n AS (SELECT DISTINCT CAST(p_size % 6 AS VARCHAR) || '.' || CAST(p_size % 4 AS VARCHAR) AS num FROM part UNION SELECT DISTINCT CAST(p_size % 8 AS VARCHAR) FROM part)
SELECT id, hit, CAST(3 - len(string_split(hit, '.')) AS INTEGER) AS dropped FROM (SELECT q.id, n.num AS hit, row_number() OVER (PARTITION BY q.id ORDER BY length(n.num) DESC) AS nth FROM q JOIN n ON q.num = n.num OR starts_with(q.num, n.num || '.')) WHERE nth = 1""")
def progressive_prefix(spark, d):
    """A dotted number is looked up whole, then without its last part, and so on."""
    k, p = F.col("o_orderkey"), F.col("p_size")
    q = table(spark, d, "orders").select(k.alias("id"), F.array(*[(k % m).cast("string") for m in (9, 5, 3)]).alias("parts"))
    n = table(spark, d, "part").select(F.explode(F.array(F.concat_ws(".", p % 6, p % 4), (p % 8).cast("string"))).alias("hit")).distinct()
    probes = q.select("id", F.posexplode(F.transform(F.array(F.lit(3), F.lit(2), F.lit(1)), lambda i: F.array_join(F.slice("parts", 1, i), "."))).alias("dropped", "hit"))
    return J.first_by(probes.join(n, "hit"), ["id"], F.col("dropped")).select("id", "hit", "dropped")


RULES_SQL = f"""WITH c AS (SELECT b.block, min(s.id) AS contained FROM {CONTAINING_SQL} GROUP BY b.block),
a AS (SELECT b.block, min(s.id) AS adjacent FROM {BLOCKS_SQL} b JOIN {SECTIONS_SQL} s ON s.book = b.book AND abs(s.p1 - b.page) <= 1 GROUP BY b.block),
n AS (SELECT b.block, max(struct_pack(p := s.p0, i := s.id)).i AS nearest FROM {BLOCKS_SQL} b JOIN {SECTIONS_SQL} s ON s.book = b.book AND s.p0 <= b.page GROUP BY b.block),
r AS (SELECT b.block, CASE WHEN b.block % 10 = 0 THEN b.block END AS own, contained, adjacent, nearest FROM {BLOCKS_SQL} b LEFT JOIN c USING (block) LEFT JOIN a USING (block) LEFT JOIN n USING (block)),
l AS (SELECT block, coalesce(own, contained, adjacent, nearest) AS target, CASE WHEN own IS NOT NULL THEN 'title' WHEN contained IS NOT NULL THEN 'contained' WHEN adjacent IS NOT NULL THEN 'adjacent' WHEN nearest IS NOT NULL THEN 'nearest' ELSE 'none' END AS method,
 CASE WHEN own IS NOT NULL THEN 0.95 WHEN contained IS NOT NULL THEN 0.9 WHEN adjacent IS NOT NULL THEN 0.85 WHEN nearest IS NOT NULL THEN 0.4 ELSE 0 END::DOUBLE AS confidence FROM r)"""


def links(spark, d):
    """Blocks with target, method, confidence by the cascade of rules."""
    b = blocks(spark, d)
    contained = containing(spark, d).groupBy("block").agg(F.min("id").alias("contained"))
    near = b.withColumn("p1", F.explode(F.sequence(F.col("page") - 1, F.col("page") + 1))).join(sections(spark, d), ["book", "p1"])
    adjacent = near.groupBy("block").agg(F.min("id").alias("adjacent"))
    starts = sections(spark, d).select("book", F.col("p0").alias("page"), F.struct("p0", "id").alias("s")).groupBy("book", "page").agg(F.max("s").alias("s"))
    nearest = J.asof_backward(b.select("book", "block", "page"), starts, ["book"], "page", "s").select("block", F.col("s.id").alias("nearest"))
    r = b.select("block").join(contained, "block", "left").join(adjacent, "block", "left").join(nearest, "block", "left")
    own = F.when(F.col("block") % 10 == 0, F.col("block"))
    target, method, sure = J.cascade(("title", own, 0.95), ("contained", F.col("contained"), 0.9), ("adjacent", F.col("adjacent"), 0.85), ("nearest", F.col("nearest"), 0.4))
    return r.select("block", target.alias("target"), method.alias("method"), sure.alias("confidence"))


@query(f"{RULES_SQL} SELECT * FROM l")
def rule_cascade_link(spark, d):
    """Each block's section by the first rule that finds one, with the rule's confidence."""
    return links(spark, d)


@query(f"{RULES_SQL} SELECT method, count(*) AS n, round(avg(confidence), 6) AS confidence, count(*) FILTER (target IS NULL) AS unlinked FROM l GROUP BY method")
def linking_stats(spark, d):
    """Links by method."""
    return links(spark, d).groupBy("method").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"), F.count_if(F.col("target").isNull()).alias("unlinked"))


@query(f"""{RULES_SQL}, q AS (SELECT l.block, l.target, l.confidence, CASE WHEN block % 4 = 0 THEN target + block % 2 * 7 END AS own FROM l)
SELECT block, CASE WHEN own IS NOT NULL AND own >= target AND own < target + 5 THEN own ELSE target END AS target, CASE WHEN own IS NOT NULL AND own >= target AND own < target + 5 THEN greatest(confidence, 0.9) ELSE confidence END AS confidence FROM q""")
def refine_descendant(spark, d):
    """A question's own rule replaces its block's link only below that link; the confidence is the greater one."""
    own = F.when(F.col("block") % 4 == 0, F.col("target") + F.col("block") % 2 * 7)
    below = F.coalesce((own >= F.col("target")) & (own < F.col("target") + 5), F.lit(False))
    return links(spark, d).select("block", F.when(below, own).otherwise(F.col("target")).alias("target"), F.when(below, F.greatest("confidence", F.lit(0.9))).otherwise(F.col("confidence")).alias("confidence"))


@query("""WITH o AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS q, l_shipdate AS s FROM lineitem WHERE l_returnflag IN ('A', 'N')), w AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity + CASE WHEN l_linenumber = 2 THEN 1 ELSE 0 END AS q, l_shipdate AS s FROM lineitem WHERE l_returnflag IN ('R', 'N')),
f AS (SELECT coalesce(o.k, w.k) AS k, coalesce(o.n, w.n) AS n, CASE WHEN o.k IS NOT NULL AND o.k % 5 = 0 THEN 'same' WHEN o.k IS NULL THEN 'insert' WHEN w.k IS NULL THEN 'delete' WHEN o.q IS DISTINCT FROM w.q OR o.s IS DISTINCT FROM w.s THEN 'update' ELSE 'same' END AS action FROM o FULL JOIN w ON o.k = w.k AND o.n = w.n)
SELECT action, count(*) AS n, CAST(sum(k) AS BIGINT) AS keys FROM f GROUP BY action""")
def fullouter_diff(spark, d):
    """What a new set of references changes: insert, update or delete; rows set by hand stay."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"), F.col("l_shipdate").alias("s"), "l_returnflag")
    old = lines.filter(F.col("l_returnflag").isin("A", "N"))
    new = lines.filter(F.col("l_returnflag").isin("R", "N")).withColumn("q", F.col("q") + F.when(F.col("n") == 2, 1).otherwise(0))
    return J.full_diff(old, new, ["k", "n"], ["q", "s"], F.col("k") % 5 == 0).groupBy("action").agg(F.count("*").alias("n"), F.sum("k").alias("keys"))


@query("""WITH r AS (SELECT user_id AS k, arg_max(CASE WHEN event_type = 'error' THEN NULL ELSE event_type END, struct_pack(t := ts, e := event_id)) AS v, max_by(event_type, struct_pack(t := ts, e := event_id)) AS last FROM events WHERE event_id % 3 = 0 GROUP BY user_id),
o AS (SELECT user_id AS k, min(event_type) AS base FROM events GROUP BY user_id)
SELECT o.k AS user_id, CASE WHEN r.last = 'error' THEN NULL ELSE coalesce(r.last, o.base) END AS shown FROM o LEFT JOIN r ON o.k = r.k""")
def overlay_latest_map(spark, d):
    """The latest overlay replaces the original; an empty one (here: an error) suppresses it."""
    e = table(spark, d, "events")
    last = e.filter("event_id % 3 = 0").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    base = e.groupBy("user_id").agg(F.min("event_type").alias("base"))
    shown = F.when(F.col("last") == "error", F.lit(None)).otherwise(F.coalesce("last", "base"))
    return base.join(last, "user_id", "left").select("user_id", shown.alias("shown"))


@query("SELECT a.doc_id, coalesce(CASE WHEN a.doc_id % 3 = 0 THEN NULL ELSE a.lang END, b.lang) AS lang FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id - a.doc_id % 10")
def variant_number_fallback(spark, d):
    """A variant takes its source's value where it has none."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    own = docs.select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("own"), (F.col("doc_id") - F.col("doc_id") % 10).alias("origin"))
    return own.join(docs.select(F.col("doc_id").alias("origin"), "lang"), "origin", "left").select("doc_id", F.coalesce("own", "lang").alias("lang"))


@query("""WITH u AS (SELECT doc_id, 0 AS pri FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 1 FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 2 FROM documents WHERE lang = 'fr')
SELECT doc_id, min(pri) AS origin FROM u GROUP BY doc_id""")
def union_keep_first(spark, d):
    """An ordered union: of each id the first list that has it."""
    labels = table(spark, d, "labels")
    parts = [labels.filter("quality = 1"), labels.filter("toxic = 1"), table(spark, d, "documents").filter("lang = 'fr'")]
    rows = [p.select("doc_id", F.lit(k).alias("origin")) for k, p in enumerate(parts)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("doc_id").agg(F.min("origin").alias("origin"))


@query(f"""WITH c AS (SELECT DISTINCT book, unnest(range(p0, p1 + 1)) AS page FROM {SECTIONS_SQL}), m AS (SELECT book, max(p1) AS n FROM {SECTIONS_SQL} GROUP BY book), a AS (SELECT book, unnest(range(1, n + 1)) AS page FROM m)
SELECT book, CAST(page AS INTEGER) AS page FROM (SELECT * FROM a EXCEPT SELECT * FROM c)""")
def set_difference_pages(spark, d):
    """Pages of a book that no section covers."""
    s = sections(spark, d)
    covered = s.select("book", F.explode(F.sequence("p0", "p1")).alias("page"))
    every = s.groupBy("book").agg(F.max("p1").alias("n")).select("book", F.explode(F.sequence(F.lit(1), "n")).alias("page"))
    return every.join(covered, ["book", "page"], "left_anti")


@query("""WITH t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(coalesce(text, ''), '[0-9]+'))) AS n FROM documents), k AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(text, '[0-9]+'))) AS n FROM benchmark)
SELECT t.doc_id, count(DISTINCT k.item_id) AS n_items FROM t JOIN k USING (n) GROUP BY t.doc_id""")
def label_equi_join(spark, d):
    """Labels are extracted from each text once and joined as keys, in place of a search of each text for each label."""
    label = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0))))
    t = table(spark, d, "documents").select("doc_id", label(X.text_or_empty(F.col("text"))).alias("n"))
    k = table(spark, d, "benchmark").select("item_id", label(F.col("text")).alias("n"))
    return t.join(k, "n").select("doc_id", "item_id").distinct().groupBy("doc_id").agg(F.count("*").alias("n_items"))


@query("""WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(coalesce(text, ''), '[0-9]{2,6}'))) AS n FROM documents WHERE doc_id % 2 = 0), x AS (SELECT doc_id - 1 AS doc_id, unnest(list_distinct(regexp_extract_all(coalesce(text, ''), '[0-9]{2,6}'))) AS n FROM documents WHERE doc_id % 2 = 1)
SELECT doc_id, n FROM w WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.doc_id = w.doc_id AND x.n = w.n)""")
def witness_missing(spark, d):
    """Numbers that a witness names and the extraction lacks."""
    docs = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(X.text_or_empty(F.col("text")), F.lit("[0-9]{2,6}"), F.lit(0)))).alias("n"))
    have = docs.filter("doc_id % 2 = 1").select((F.col("doc_id") - 1).alias("doc_id"), "n")
    return docs.filter("doc_id % 2 = 0").join(have, ["doc_id", "n"], "left_anti")


@query(r"""WITH a AS (SELECT doc_id, regexp_extract((doc_id % 17) || '.' || (doc_id % 5) || '-' || coalesce(lang, ''), '^[0-9]+(\.[0-9]+)*') AS stem FROM documents), g AS (SELECT stem, count(*) AS n FROM a GROUP BY stem HAVING count(*) > 1)
SELECT a.doc_id, g.n - 1 AS n_siblings FROM a JOIN g USING (stem)""")
def shared_stem_siblings(spark, d):
    """How many siblings with one numeric stem of their ids a row has, however many these are: stems are counted, not paired."""
    ident = F.concat_ws("-", F.concat_ws(".", F.col("doc_id") % 17, F.col("doc_id") % 5), X.text_or_empty(F.col("lang")))
    a = table(spark, d, "documents").select("doc_id", F.regexp_extract(ident, r"^[0-9]+(\.[0-9]+)*", 0).alias("stem"))
    g = a.groupBy("stem").agg(F.count("*").alias("n")).filter("n > 1")
    return a.join(g, "stem").select("doc_id", (F.col("n") - 1).alias("n_siblings"))


@query("""WITH old AS (SELECT doc_id, quality, toxic FROM labels), c AS (SELECT doc_id, CAST(doc_id % 2 AS INTEGER) AS quality, 0 AS toxic FROM documents WHERE doc_id % 4 = 0)
SELECT coalesce(o.doc_id, c.doc_id) AS doc_id, CASE WHEN c.doc_id IS NOT NULL THEN c.quality ELSE o.quality END AS quality, CASE WHEN c.doc_id IS NOT NULL THEN c.toxic ELSE o.toxic END AS toxic FROM old o FULL JOIN c ON o.doc_id = c.doc_id""")
def upsert_rows(spark, d):
    """The table after an upsert: changed rows overwritten, new ones inserted."""
    changes = table(spark, d, "documents").filter("doc_id % 4 = 0").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    return J.upsert(table(spark, d, "labels").select("doc_id", "quality", "toxic"), changes, ["doc_id"])


@query("""SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate NULLS LAST, l_linenumber) AS claim FROM lineitem QUALIFY claim <= 2""")
def claim_in_order(spark, d):
    """The first two rows of each key, numbered: with unique order keys a claim in order is a rank."""
    w = Window.partitionBy("l_orderkey").orderBy(F.col("l_shipdate").asc_nulls_last(), "l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).alias("claim")).filter("claim <= 2")
