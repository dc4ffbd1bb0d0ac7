"""Queries over scalar functions and predicates, sinks, and changes of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as X
from ..operators import joins as J
from ..operators import windows as W
from ..sources.tables import page_slice, parameterised, table
from .registry import query

TITLES_SQL = r"(SELECT doc_id, source, lang, regexp_extract(coalesce(text, ''), '^[^.!?\n]{0,80}') AS title, coalesce(text, '') AS text FROM documents)"


def titles(spark, d):
    t = X.text_or_empty(F.col("text"))
    return table(spark, d, "documents").select("doc_id", "source", "lang", F.regexp_extract(t, r"^[^.!?\n]{0,80}", 0).alias("title"), t.alias("text"))


def alternation(words):
    return "|".join(words)


@query(rf"""SELECT doc_id, lower(trim(regexp_replace(title, '\s+', ' ', 'g'))) AS squashed, regexp_replace(lower(trim(regexp_replace(title, '\s+', ' ', 'g'))), '[ .:\-—]+$', '') AS title_key,
regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') AS heading_key, regexp_replace(regexp_replace(lower(trim(regexp_replace(title, '\s+', ' ', 'g'))), '^([0-9]+ )+', ''), '( [0-9]+)+$', '') AS furniture,
left(regexp_replace(title, '[^A-Za-z0-9._-]+', '_', 'g'), 80) AS safe FROM {TITLES_SQL}""")
def normalised_titles(spark, d):
    """Titles in the forms in which they are compared and stored."""
    t = F.col("title")
    return titles(spark, d).select("doc_id", X.squash(t).alias("squashed"), X.title_key(t).alias("title_key"), X.heading_key(t).alias("heading_key"), X.furniture_key(t).alias("furniture"), R.safe_name(t).alias("safe"))


@query(rf"""SELECT doc_id, regexp_matches(lower(title), '{alternation(R.NON_QUESTION)}') AS non_question, lower(trim(title)) IN ({', '.join(repr(w) for w in R.GENERIC)}) AS generic, regexp_matches(lower(title), '{R.PUZZLE}') AS puzzle,
regexp_matches(lower(trim(title)), '{R.INDIVIDUAL}') AS individual, regexp_matches(lower(text), '{R.SOLUTION_START}') AND NOT regexp_matches(lower(title), '{R.ACTIVITY}') AS bleed, regexp_matches(text, '{R.MATH}') AS math FROM {TITLES_SQL}""")
def title_predicates(spark, d):
    """What kinds of title and text there are."""
    t, x = F.col("title"), F.col("text")
    return titles(spark, d).select("doc_id", R.any_of(t, R.NON_QUESTION).alias("non_question"), F.lower(F.trim(t)).isin(R.GENERIC).alias("generic"), R.any_of(t, [R.PUZZLE]).alias("puzzle"), R.is_individual(t).alias("individual"), R.solution_bleed(x, t).alias("bleed"), x.rlike(R.MATH).alias("math"))


KINDS_SQL = "CASE " + " ".join(f"WHEN contains(lower(p_type), '{w}') THEN '{k}'" for w, k in R.KINDS) + " ELSE 'section' END"


@query(f"""SELECT p_partkey, {KINDS_SQL} AS kind, CASE WHEN p_type IS NULL THEN 'exercise' {' '.join(f"WHEN contains(lower(p_type), '{w}') THEN '{k}'" for w, k in R.TYPES.items())} ELSE 'other' END AS question_kind FROM part""")
def kinds_of_titles(spark, d):
    """Kinds by ordered rules."""
    return table(spark, d, "part").select("p_partkey", R.kind_of_title(F.col("p_type")).alias("kind"), R.question_kind(F.col("p_type")).alias("question_kind"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'q' || o_orderkey % 90 WHEN 1 THEN 'example' || o_orderkey % 90 WHEN 2 THEN 'exercise' || o_orderkey % 90 ELSE 'section ' || o_orderkey % 90 END AS ref,
o_orderkey % 90 || '' AS number, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 9) || '.' || (o_orderkey % 5) || 'a' ELSE CAST(o_orderkey % 9 AS VARCHAR) END AS label FROM orders""")
def reference_keys(spark, d):
    """References, numbers and labels in the form in which they are joined."""
    k = F.col("o_orderkey")
    n = (k % 90).cast("string")
    ref = F.when(k % 4 == 0, F.concat(F.lit("Question "), n)).when(k % 4 == 1, F.concat(F.lit("Example. "), n)).when(k % 4 == 2, F.concat(F.lit("EXERCISE "), n)).otherwise(F.concat(F.lit("Section "), n))
    label = F.when(k % 2 == 0, F.concat(F.lit("Fig. "), (k % 9).cast("string"), F.lit("."), (k % 5).cast("string"), F.lit("a:"))).otherwise(F.concat(F.lit("Figure "), (k % 9).cast("string"), F.lit(" shows")))
    return table(spark, d, "orders").select("o_orderkey", X.question_ref(ref).alias("ref"), X.question_number(F.concat(F.lit(" Q. ("), n, F.lit(")."))).alias("number"), X.label_key(label).alias("label"))


@query("SELECT o_orderkey, CAST(o_orderkey % 50 AS VARCHAR) AS parent, CASE o_orderkey % 2 WHEN 0 THEN 'example' ELSE 'exercise' END AS kind, CAST(o_orderkey % 7 AS VARCHAR) AS num FROM orders")
def slug_parts(spark, d):
    """Parent, kind and number of each slug."""
    k = F.col("o_orderkey")
    slug = F.concat_ws("-", k % 50, F.when(k % 2 == 0, "example").otherwise("exercise"), k % 7)
    return table(spark, d, "orders").select("o_orderkey", X.slug_parts(slug).alias("s")).select("o_orderkey", "s.*")


@query(rf"""SELECT doc_id, CASE WHEN contains(title, ' of ') THEN left(trim(regexp_replace(string_split(title, ' of ')[-1], ' (and|in|on|with|for|by|from) .*$', '')), 80) END AS topic,
array_to_string(list_distinct([array_to_string(w, ' ')]), '') AS whole FROM (SELECT *, string_split_regex(trim(title), ' +') AS w FROM {TITLES_SQL})""")
def topics(spark, d):
    """The topic after a title's last of, and the title as its first needle."""
    return titles(spark, d).select("doc_id", R.topic(F.col("title")).alias("topic"), F.get(R.needles(F.col("title")), F.lit(0)).alias("whole"))


@query("""SELECT doc_id, CASE WHEN lang IN ('hi', 'ta', 'bn') THEN 'A' WHEN contains(text, '=') AND n > 20 THEN 'B' WHEN length(text) < 100 THEN 'C' ELSE 'D' END AS provider FROM (SELECT doc_id, lang, coalesce(text, '') AS text, length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[0-9]', '', 'g')) AS n FROM documents)""")
def provider_routing(spark, d):
    """The reader of each document by the first rule that holds."""
    t = X.text_or_empty(F.col("text"))
    digits = F.length(t) - F.length(F.regexp_replace(t, "[0-9]", ""))
    return table(spark, d, "documents").select("doc_id", R.route(F.col("lang"), F.instr(t, "="), F.when(digits > 20, 1.0).otherwise(0.0), F.length(t) < 100).alias("provider"))


@query("SELECT l_orderkey, CASE WHEN bool_or(l_discount > 0.09) THEN 'failed' WHEN count(*) FILTER (l_quantity > 25) = 0 THEN 'empty' WHEN count(*) FILTER (l_quantity > 25) < count(*) THEN 'partial' ELSE 'complete' END AS class FROM lineitem GROUP BY l_orderkey")
def unit_classes(spark, d):
    """Units by what was extracted of what was expected."""
    t = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("e"), F.count_if(F.col("l_quantity") > 25).alias("g"), F.bool_or(F.col("l_discount") > 0.09).alias("f"))
    return t.select("l_orderkey", R.unit_class(F.col("e"), F.col("g"), F.col("f")).alias("class"))


@query("""SELECT source, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids FROM documents WHERE text IS NULL OR trim(text) = '' OR length(trim(text)) < 40 GROUP BY source""")
def missing_solutions(spark, d):
    """Rows without text worth the name, by section."""
    t = F.col("text")
    rows = table(spark, d, "documents").filter(~R.solution_flag(t) | (F.length(F.trim(t)) < 40))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("doc_id")), ",").alias("ids"))


@query("""WITH p AS (SELECT conv_id AS book, turn AS page, coalesce(text, '') AS text FROM conversations), r AS (SELECT DISTINCT book, 1 + book % 2 AS p0, 3 + book % 3 AS p1 FROM p)
SELECT r.book AS range_id, sha1(string_agg(text, chr(10) ORDER BY page)) AS hash FROM r JOIN p ON p.book = r.book AND page BETWEEN p0 AND p1 GROUP BY r.book""")
def page_range_text(spark, d):
    """The text of a page range of each book."""
    p = table(spark, d, "conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").alias("page"), X.text_or_empty(F.col("text")).alias("text"))
    b = F.col("book_id")
    r = p.select("book_id").distinct().select(b.alias("range_id"), "book_id", (1 + b % 2).alias("p0"), (3 + b % 3).alias("p1"))
    return page_slice(p, r).select("range_id", F.sha1("text").alias("hash"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7")
def parameterised_scan(spark, d):
    """A textual query with a parameter; its filter reaches the scan."""
    return parameterised(spark, d, "orders", "o_custkey = :b", b=7).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 11")
def primary_key_lookup(spark, d):
    """One row by its key."""
    return table(spark, d, "customer").filter("c_custkey = 11").select("c_custkey", "c_name", "c_acctbal")


@query("SELECT conv_id, turn, CASE role WHEN 'system' THEN '### ' || text WHEN 'user' THEN '> ' || text ELSE text END AS line FROM conversations")
def markdown_lines(spark, d):
    """Blocks as Markdown, to be written as text."""
    return table(spark, d, "conversations").select("conv_id", "turn", R.render(F.col("role"), F.col("text")).alias("line"))


@query("""SELECT source, doc_id // 1000 AS part, '{"source":"' || source || '","part":' || (doc_id // 1000) || ',"ids":[' || string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) || ']}' AS json
FROM documents WHERE source IS NOT NULL GROUP BY source, part""")
def json_documents(spark, d):
    """Groups as JSON documents, each in parts by a thousand ids, so that no group has to fit one row."""
    part = F.floor(F.col("doc_id") / 1000).alias("part")
    g = table(spark, d, "documents").filter("source is not null").groupBy("source", part).agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    return g.select("source", "part", F.to_json(F.struct("source", "part", "ids")).alias("json"))


@query("""SELECT doc_id, CASE WHEN contains(lower(text), 'the ') THEN 'theory' WHEN contains(text, '?') THEN 'questions' WHEN lang = 'en' THEN 'theory' ELSE 'other' END AS first FROM (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents)""")
def content_types(spark, d):
    """Content types in order, each once; the first one leads."""
    t = X.text_or_empty(F.col("text"))
    found = F.array_distinct(F.array_compact(F.array(F.when(F.contains(F.lower(t), F.lit("the ")), "theory"), F.when(F.contains(t, F.lit("?")), "questions"), F.when(F.col("lang") == "en", "theory").otherwise("other"))))
    return table(spark, d, "documents").select("doc_id", found.alias("f")).select("doc_id", F.get("f", F.lit(0)).alias("first"))


# ---------------------------------------------------------------- changes: the next version of a table


@query("SELECT o_orderkey, CASE WHEN o_orderstatus IN ('P', 'O') AND o_totalprice > 100000 THEN 'L' ELSE o_orderstatus END AS status, o_orderstatus IN ('P', 'O') AND o_totalprice > 100000 AS won FROM orders")
def compare_and_set(spark, d):
    """An update under a condition, and which rows it won."""
    won = F.col("o_orderstatus").isin("P", "O") & (F.col("o_totalprice") > 100000)
    return table(spark, d, "orders").select("o_orderkey", F.when(won, "L").otherwise(F.col("o_orderstatus")).alias("status"), won.alias("won"))


@query("SELECT o_orderkey, CASE WHEN c_custkey IS NOT NULL THEN o_custkey END AS o_custkey FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey")
def set_null_on_delete(spark, d):
    """References to deleted rows become null."""
    kept = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("there"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(kept, "o_custkey", "left").select("o_orderkey", F.when(F.col("there"), F.col("o_custkey")).alias("o_custkey"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')")
def cascade_delete(spark, d):
    """Children of deleted rows go."""
    kept = table(spark, d, "orders").filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(kept, "l_orderkey", "left_semi")


@query("SELECT doc_id, 'kept' AS origin FROM documents WHERE length(coalesce(text, '')) >= 100 UNION ALL SELECT d.doc_id, 'restored' FROM documents d JOIN labels l USING (doc_id) WHERE length(coalesce(text, '')) < 100 AND quality = 1")
def restore_rejected(spark, d):
    """Rejected rows that were approved come back."""
    docs = table(spark, d, "documents").select("doc_id", F.length(X.text_or_empty(F.col("text"))).alias("n"))
    good = table(spark, d, "labels").filter("quality = 1").select("doc_id")
    back = docs.filter("n < 100").join(good, "doc_id", "left_semi").select("doc_id", F.lit("restored").alias("origin"))
    return docs.filter("n >= 100").select("doc_id", F.lit("kept").alias("origin")).unionByName(back)


@query("SELECT doc_id, source, source IN (SELECT source FROM documents d JOIN labels l USING (doc_id) GROUP BY source HAVING avg(toxic) > 0.12) AS hidden FROM documents")
def hide_sections(spark, d):
    """All rows of some sections get a flag."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    bad = docs.join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id").groupBy("source").agg(F.avg("toxic").alias("t")).filter("t > 0.12").select("source", F.lit(True).alias("h"))
    return docs.join(bad, "source", "left").select("doc_id", "source", F.coalesce("h", F.lit(False)).alias("hidden"))


@query("SELECT user_id, event_id, CASE WHEN event_type = 'signup' AND ts < (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE THEN 'free' ELSE 'held' END AS lock FROM events")
def lock_expiry(spark, d):
    """Locks older than ten minutes are free."""
    e = table(spark, d, "events")
    cut = e.agg(F.max("ts") - F.expr("interval 10 minutes")).first()[0]
    return e.select("user_id", "event_id", F.when((F.col("event_type") == "signup") & (F.col("ts") < F.lit(cut)), "free").otherwise("held").alias("lock"))


@query("""WITH q AS (SELECT doc_id, source, lower(trim(coalesce(text, ''))) AS num FROM documents), e AS (SELECT * FROM q WHERE doc_id % 2 = 0), n AS (SELECT * FROM q WHERE doc_id % 2 = 1),
f AS (SELECT min(doc_id) AS doc_id FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.source = n.source AND e.num = n.num) GROUP BY source, num)
SELECT doc_id, 'existing' AS origin FROM e UNION ALL SELECT doc_id, 'new' FROM f""")
def merge_insert_only(spark, d):
    """New rows are added by number; an existing one wins."""
    q = table(spark, d, "documents").select("doc_id", "source", F.lower(F.trim(X.text_or_empty(F.col("text")))).alias("num"))
    old, new = q.filter("doc_id % 2 = 0"), q.filter("doc_id % 2 = 1")
    fresh = new.join(old.select("source", "num"), ["source", "num"], "left_anti").groupBy("source", "num").agg(F.min("doc_id").alias("doc_id"))
    return old.select("doc_id", F.lit("existing").alias("origin")).unionByName(fresh.select("doc_id", F.lit("new").alias("origin")))


@query("""WITH t AS (SELECT page_id, lower(trim(regexp_extract(html, '<h1>([^<]*)', 1))) AS h FROM pages), n AS (SELECT h, count(*) AS n, min(page_id) AS first FROM t WHERE h <> '' GROUP BY h)
SELECT a.page_id, CASE WHEN n.n IS NULL THEN 'phantom' WHEN n.n = 1 THEN CASE WHEN n.first = a.page_id THEN 'confirmed' ELSE 'correction' END WHEN EXISTS (SELECT 1 FROM t x WHERE x.h = a.h AND abs(x.page_id - a.page_id) <= 1) THEN 'confirmed' ELSE 'skip' END AS verdict
FROM (SELECT page_id + CASE WHEN page_id % 6 = 0 THEN 3 ELSE 0 END AS page_id, h FROM t WHERE h <> '') a LEFT JOIN n USING (h)""")
def title_page_check(spark, d):
    """Claimed pages of titles: confirmed nearby, corrected if there is one other place, skipped if there are many, else phantom."""
    t = table(spark, d, "pages").select("page_id", F.lower(F.trim(F.regexp_extract("html", "<h1>([^<]*)", 1))).alias("h")).filter("h <> ''")
    claims = t.withColumn("page_id", F.col("page_id") + F.when(F.col("page_id") % 6 == 0, 3).otherwise(0))
    n = t.groupBy("h").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
    near = claims.withColumn("at", F.explode(F.sequence(F.col("page_id") - 1, F.col("page_id") + 1))).join(t.select("h", F.col("page_id").alias("at")), ["h", "at"]).select("page_id", "h", F.lit(True).alias("near")).distinct()
    rows = claims.join(n, "h", "left").join(near, ["page_id", "h"], "left")
    one = F.when(F.col("first") == F.col("page_id"), "confirmed").otherwise("correction")
    return rows.select("page_id", F.when(F.col("n").isNull(), "phantom").when(F.col("n") == 1, one).when(F.col("near"), "confirmed").otherwise("skip").alias("verdict"))


@query("""WITH q AS (SELECT o_orderkey AS id, o_custkey AS node FROM orders), s AS (SELECT c_custkey AS node, c_nationkey AS stem FROM customer), p AS (SELECT s.node, count(*) FILTER (o.node = s.node) AS own, count(*) AS pool FROM s JOIN s o ON o.stem = s.stem JOIN q ON q.node = o.node GROUP BY s.node)
SELECT node, own, pool - own AS borrowed FROM p""")
def borrow_from_siblings(spark, d):
    """A node's own questions and those that it may borrow from its siblings: counts are made by stem, not by pairs of siblings."""
    own = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("node")).agg(F.count("*").alias("own"))
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("stem")).join(own, "node", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    pool = s.groupBy("stem").agg(F.sum("own").alias("pool")).filter("pool > 0")
    return s.join(pool, "stem").select("node", "own", (F.col("pool") - F.col("own")).alias("borrowed"))


@query("SELECT p_partkey, CAST(least(p_size + 1, coalesce(lead(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey), p_size + 1)) AS INTEGER) AS page_end FROM part")
def padded_slice_end(spark, d):
    """Slices end a page later, but not beyond the next one's start."""
    led = W.spread_lead(table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), "p_brand", "p_partkey", "p_size", "nxt")
    return led.select("p_partkey", R.padded_end(F.col("p_size"), F.col("nxt")).alias("page_end"))


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1")
def first_of_section(spark, d):
    """The first referenced row of each section."""
    docs = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    return J.first_by(docs, ["source"], F.col("doc_id")).select("doc_id")
