"""Queries on ordered rows: conversations stand for sections with blocks (role is the block's kind), events for their history."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import windows as W
from ..sources.tables import table
from .join_queries import SECTIONS_SQL, sections
from .registry import query

KEY = ["conv_id"]


def blocks(spark, d):
    return table(spark, d, "conversations")


@query(f"""WITH c AS (SELECT DISTINCT book, unnest(range(p0, p1 + 1)) AS page FROM {SECTIONS_SQL}), m AS (SELECT book, max(p1) AS n FROM {SECTIONS_SQL} GROUP BY book), a AS (SELECT book, unnest(range(1, n + 1)) AS page FROM m),
g AS (SELECT book, page, page - row_number() OVER (PARTITION BY book ORDER BY page) AS run FROM (SELECT * FROM a EXCEPT SELECT * FROM c))
SELECT book, CAST(min(page) AS INTEGER) AS first, CAST(max(page) AS INTEGER) AS last, count(*) AS n FROM g GROUP BY book, run HAVING count(*) >= 3""")
def coverage_gap_islands(spark, d):
    """Runs of three pages and more that no section of a book covers."""
    s = sections(spark, d)
    covered = s.select("book", F.explode(F.sequence("p0", "p1")).alias("page"))
    every = s.groupBy("book").agg(F.max("p1").alias("n")).select("book", F.explode(F.sequence(F.lit(1), "n")).alias("page"))
    return W.gap_runs(every.join(covered, ["book", "page"], "left_anti"), ["book"], "page").filter("n >= 3")


ISLANDS_SQL = "(SELECT *, sum(CASE WHEN role IS NOT DISTINCT FROM prev AND nth > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, lag(role) OVER w AS prev, row_number() OVER w AS nth FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)))"


@query(f"SELECT conv_id, CAST(island AS BIGINT) AS island, min(role) AS role, min(turn) AS first, count(*) AS n, sha1(string_agg(coalesce(text, ''), ' | ' ORDER BY turn)) AS hash FROM {ISLANDS_SQL.replace('AS island', 'AS island', 1)} GROUP BY conv_id, island")
def list_run_collapse(spark, d):
    """Consecutive blocks of one kind as one block."""
    rows = W.islands(blocks(spark, d).withColumn("text", X.text_or_empty(F.col("text"))), KEY, "turn", F.col("role"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " | ")
    return rows.groupBy("conv_id", "island").agg(F.min("role").alias("role"), F.min("turn").alias("first"), F.count("*").alias("n"), F.sha1(text).alias("hash"))


@query("""WITH n AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_linenumber - l_partkey % 3 AS num FROM lineitem), r AS (SELECT *, l_linenumber - num AS run FROM n), i AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - row_number() OVER (PARTITION BY l_orderkey, run ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS isl FROM r)
SELECT l_orderkey, min(l_linenumber) AS first, count(*) AS n FROM i GROUP BY l_orderkey, run, isl HAVING count(*) >= 2""")
def numbered_run_collapse(spark, d):
    """Runs of two and more consecutive rows that number themselves n, n + 1, ..."""
    n = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", (F.col("l_linenumber") - F.col("l_partkey") % 3).alias("num"))
    run = F.col("l_linenumber") - F.col("num")
    rows = W.islands(n, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"], run)
    return rows.groupBy("l_orderkey", "island").agg(F.min("l_linenumber").alias("first"), F.count("*").alias("n")).filter("n >= 2").drop("island")


@query(f"SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY island, CASE WHEN role = 'user' THEN text END NULLS LAST, turn) - 1 AS new_pos FROM {ISLANDS_SQL}")
def runs_internal_sort(spark, d):
    """Only inside runs of questions are blocks sorted anew."""
    rows = W.islands(blocks(spark, d), KEY, "turn", F.col("role"))
    order = W.line(KEY, "island", F.when(F.col("role") == "user", F.col("text")).asc_nulls_last(), "turn")
    return rows.select("conv_id", "turn", "role", (F.row_number().over(order) - 1).alias("new_pos"))


@query("SELECT conv_id, turn, lead(role) OVER w AS next_role, lead(turn) OVER w AS next_turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def lead_next_unit(spark, d):
    """The next block's kind and place."""
    w = W.line(KEY, "turn")
    return blocks(spark, d).select("conv_id", "turn", F.lead("role").over(w).alias("next_role"), F.lead("turn").over(w).alias("next_turn"))


@query(f"""WITH s AS {SECTIONS_SQL}, n AS (SELECT a.id, a.book, a.p0, (SELECT b.p0 FROM s b WHERE b.book = a.book AND b.id > a.id AND b.p0 > a.p0 ORDER BY b.id LIMIT 1) AS nxt FROM s a)
SELECT id, greatest(p0, coalesce(nxt - 1, (SELECT max(p1) FROM s x WHERE x.book = n.book))) AS page_end FROM n""")
def next_greater_start(spark, d):
    """A section ends before the next one that starts later, or with the book."""
    s = W.next_greater(sections(spark, d), ["book"], "id", "p0", "nxt")
    last = F.max("p1").over(Window.partitionBy("book"))
    return s.select("id", F.greatest("p0", F.coalesce(F.col("nxt") - 1, last)).alias("page_end"))


@query("""SELECT conv_id, turn, first_value(CASE WHEN contains(text, '?') THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_turn FROM conversations""")
def next_found_position(spark, d):
    """The next block that matches."""
    found = F.when(F.contains("text", F.lit("?")), F.col("turn"))
    return blocks(spark, d).select("conv_id", "turn", W.next_found(found, KEY, "turn").alias("next_turn"))


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS owner FROM conversations""")
def last_seen_catb(spark, d):
    """The nearest block of a kind before each block."""
    return blocks(spark, d).select("conv_id", "turn", W.carry_forward(F.col("turn"), F.col("role") == "user", KEY, "turn").alias("owner"))


@query("SELECT conv_id, turn, CAST(max(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS INTEGER) AS cursor FROM conversations")
def running_max_cursor(spark, d):
    """A cursor that only moves forward."""
    return blocks(spark, d).select("conv_id", "turn", F.max(F.length("text")).over(W.upto(KEY, "turn")).alias("cursor"))


BOUNDS_SQL = "(SELECT conv_id, turn, CAST(sum(length(coalesce(text, '')) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS bound FROM conversations)"


@query(f"SELECT * FROM {BOUNDS_SQL}")
def prefix_sum_bounds(spark, d):
    """Where each item ends when items are joined by one separator."""
    return blocks(spark, d).select("conv_id", "turn", (F.sum(F.length(X.text_or_empty(F.col("text"))) + 1).over(W.upto(KEY, "turn")) - 1).alias("bound"))


@query(f"WITH b AS {BOUNDS_SQL}, o AS (SELECT conv_id, max(bound) // 2 AS mid FROM b GROUP BY conv_id) SELECT b.conv_id, min(turn) AS item FROM b JOIN o ON o.conv_id = b.conv_id AND bound >= mid GROUP BY b.conv_id")
def bucket_by_prefix_sum(spark, d):
    """The item in which an offset (here: half of all) falls."""
    b = prefix_sum_bounds(spark, d).withColumn("at", F.floor(F.max("bound").over(Window.partitionBy("conv_id")) / 2))
    return b.filter("bound >= at").groupBy("conv_id").agg(F.min("turn").alias("item"))


@query("""WITH k AS (SELECT conv_id, turn, role <> 'system' AND turn % 4 <> 1 AS keep FROM conversations), n AS (SELECT *, sum(keep::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS c FROM k)
SELECT conv_id, turn, CASE WHEN keep THEN c - 1 END::BIGINT AS new_pos, CASE WHEN c - keep::INT > 0 THEN c - 1 - keep::INT END::BIGINT AS anchor FROM n""")
def index_remap(spark, d):
    """New places after deletions, and the survivor before each block."""
    return W.remap(blocks(spark, d), KEY, "turn", (F.col("role") != "system") & (F.col("turn") % 4 != 1)).select("conv_id", "turn", "new_pos", "anchor")


@query(r"""WITH d AS (SELECT doc_id, source || '-' || lang || CASE WHEN doc_id % 19 = 5 THEN '-' || (doc_id % 7 + 2) ELSE '' END AS name FROM documents),
n AS (SELECT doc_id, name, row_number() OVER (PARTITION BY name ORDER BY doc_id) AS n FROM d),
t AS (SELECT regexp_extract(name, '^(.*)-[0-9]+$', 1) AS name, list(CAST(regexp_extract(name, '[0-9]+$') AS BIGINT)) AS taken FROM (SELECT DISTINCT name FROM d WHERE regexp_matches(name, '-([2-9]|[1-9][0-9]+)$')) GROUP BY 1),
c AS (SELECT name, max(n) AS most FROM n GROUP BY name),
f AS (SELECT c.name, list_filter(range(2, most + len(coalesce(taken, [])) + 2), lambda v: NOT list_contains(coalesce(taken, []), v)) AS free FROM c LEFT JOIN t ON t.name = c.name)
SELECT doc_id, CASE WHEN n = 1 THEN n.name ELSE n.name || '-' || free[n - 1] END AS unique_name FROM n JOIN f ON f.name = n.name""")
def uniquify_ids(spark, d):
    """Names that occur again get the least number that makes no name of the table: some names end in a number already."""
    end = F.when(F.col("doc_id") % 19 == 5, F.concat(F.lit("-"), (F.col("doc_id") % 7 + 2).cast("string"))).otherwise("")
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.concat("source", F.lit("-"), "lang"), end).alias("name"))
    return W.uniquify(docs.filter("name is not null"), "name", "doc_id").select("doc_id", "unique_name")


@query(rf"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '{X.SENTENCE}'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: length(s) >= 40) AS v FROM documents),
u AS (SELECT doc_id, len(v) AS m, unnest(v) AS s, generate_subscripts(v, 1) - 1 AS i FROM s) SELECT doc_id, i AS idx, sha1(s) AS hash FROM u WHERE i % greatest(1, m // 5) = 0""")
def stride_sample(spark, d):
    """About five of each text's long sentences, evenly spread."""
    v = F.filter(X.sentences(F.col("text")), lambda s: F.length(s) >= 40)
    rows = table(spark, d, "documents").select("doc_id", v.alias("v"))
    step = F.greatest(F.lit(1), F.floor(F.size("v") / 5).cast("int"))
    return rows.select("doc_id", step.alias("step"), F.posexplode("v").alias("idx", "s")).filter("idx % step = 0").select("doc_id", F.col("idx").cast("long"), F.sha1("s").alias("hash"))


@query("SELECT conv_id, count(*) FILTER (role = 'assistant') AS n_free, count(*) FILTER (role <> 'assistant') AS n_invariant, coalesce(string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) FILTER (role = 'assistant'), '') AS free FROM conversations GROUP BY conv_id")
def split_free_invariant(spark, d):
    """Blocks that may be written anew, and those that must stay, each in order."""
    free = F.col("role") == "assistant"
    places = F.array_sort(F.collect_list(F.when(free, F.col("turn"))))
    return blocks(spark, d).groupBy("conv_id").agg(F.count_if(free).alias("n_free"), F.count_if(~free).alias("n_invariant"), F.array_join(places, ",").alias("free"))


@query("""WITH o AS (SELECT conv_id, turn, text, CASE WHEN role = 'assistant' THEN sum((role = 'assistant')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) END AS slot FROM conversations),
f AS (SELECT conv_id, text || '!' AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS slot FROM conversations WHERE turn % 3 <> 2), n AS (SELECT conv_id, coalesce(max(slot), 0) AS n, max(turn) AS last FROM o GROUP BY conv_id),
m AS (SELECT o.conv_id, o.turn, coalesce(f.text, o.text) AS text FROM o LEFT JOIN f ON f.conv_id = o.conv_id AND f.slot = o.slot UNION ALL SELECT f.conv_id, n.last + f.slot - n.n, f.text FROM f JOIN n ON n.conv_id = f.conv_id WHERE f.slot > n.n)
SELECT conv_id, CAST(turn AS BIGINT) AS turn, sha1(coalesce(text, '')) AS hash FROM m""")
def merge_in_order(spark, d):
    """Rewritten blocks fill the free places in order; missing ones leave the original, surplus ones follow."""
    b = blocks(spark, d)
    fresh = b.filter("turn % 3 <> 2").withColumn("text", F.concat("text", F.lit("!")))
    merged = W.merge_in_order(b, fresh, KEY, "turn", F.col("role") == "assistant", "text")
    return merged.select("conv_id", F.col("turn").cast("long").alias("turn"), F.sha1(X.text_or_empty(F.col("text"))).alias("hash"))


@query("""WITH c AS (SELECT DISTINCT conv_id, 'chip-' || (conv_id % 3) AS chip FROM conversations), h AS (SELECT b.conv_id, c.chip, min(b.turn) AS t FROM conversations b JOIN c ON c.conv_id = b.conv_id WHERE contains(b.text, CAST(b.conv_id % 3 AS VARCHAR)) GROUP BY ALL),
e AS (SELECT conv_id, max(turn) AS t FROM conversations GROUP BY conv_id), r AS (SELECT conv_id, turn, 0 AS a, NULL AS chip FROM conversations UNION ALL SELECT c.conv_id, coalesce(h.t, e.t), 1, c.chip FROM c JOIN e ON e.conv_id = c.conv_id LEFT JOIN h ON h.conv_id = c.conv_id AND h.chip = c.chip)
SELECT conv_id, turn, chip, row_number() OVER (PARTITION BY conv_id ORDER BY turn, a, chip) - 1 AS new_pos FROM r""")
def chip_inject(spark, d):
    """References go after the first block that names them, else to the end."""
    b = blocks(spark, d).select("conv_id", "turn", "text")
    chips = b.select("conv_id").distinct().withColumn("chip", F.concat(F.lit("chip-"), (F.col("conv_id") % 3).cast("string")))
    return W.inject_after(b, KEY, "turn", chips, F.contains("text", (F.col("conv_id") % 3).cast("string")))


@query("""WITH i AS (SELECT conv_id, turn, role, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS range FROM conversations), s AS (SELECT DISTINCT conv_id, range FROM i JOIN (SELECT conv_id AS c, turn AS t FROM conversations WHERE contains(text, '?')) ON c = conv_id AND t = turn)
SELECT i.conv_id, i.turn, row_number() OVER (PARTITION BY i.conv_id ORDER BY i.turn) - 1 AS new_pos FROM i LEFT JOIN s ON s.conv_id = i.conv_id AND s.range = i.range WHERE s.range IS NULL OR i.range = 0""")
def worked_range_drop(spark, d):
    """Ranges from one heading to the next go if something in them is solved elsewhere (here: holds a question mark)."""
    rows = blocks(spark, d).withColumn("range", F.count_if(F.col("role") == "user").over(W.upto(KEY, "turn")))
    solved = rows.filter(F.contains("text", F.lit("?")) & (F.col("range") > 0)).select("conv_id", "range").distinct()
    left = rows.join(solved, ["conv_id", "range"], "left_anti")
    return left.select("conv_id", "turn", (F.row_number().over(W.line(KEY, "turn")) - 1).alias("new_pos"))


@query("""WITH e AS (SELECT doc_id FROM labels WHERE quality = 1) SELECT d.doc_id, coalesce(d.source, 'uncategorized') AS section, row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) AS place FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM e)""")
def never_drop(spark, d):
    """Items that were not emitted are given back to their section in order, or to the uncategorized ones."""
    emitted = table(spark, d, "labels").filter("quality = 1").select("doc_id")
    left = table(spark, d, "documents").select("doc_id", "source").join(emitted, "doc_id", "left_anti")
    left = W.spread_rank(left, ["source"], F.floor(F.col("doc_id") / 100_000), "doc_id")
    return left.select("doc_id", F.coalesce("source", F.lit("uncategorized")).alias("section"), "place")


NUM_SQL = "CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN CAST(doc_id % 10 + 1 AS VARCHAR) || '.' || ['i', 'iv', 'ix', 'b'][doc_id % 4 + 1] WHEN 2 THEN 'Q' || (doc_id % 37) ELSE CAST(doc_id % 12 AS VARCHAR) END"


def numbers(spark, d):
    k = F.col("doc_id")
    dotted = F.concat((k % 10 + 1).cast("string"), F.lit("."), F.element_at(F.array(*map(F.lit, ["i", "iv", "ix", "b"])), (k % 4 + 1).cast("int")))
    num = F.when(k % 4 == 0, "").when(k % 4 == 1, dotted).when(k % 4 == 2, F.concat(F.lit("Q"), (k % 37).cast("string"))).otherwise((k % 12).cast("string"))
    return table(spark, d, "documents").select("doc_id", "source", num.alias("num"))


@query(rf"""WITH n AS (SELECT doc_id, source, {NUM_SQL} AS num FROM documents), k AS (SELECT *, list_filter(string_split_regex(lower(num), '[^a-z0-9]+'), lambda p: p <> '') AS parts FROM n),
o AS (SELECT *, CASE WHEN len(parts) = 0 THEN [1000000000] ELSE list_transform(parts, lambda p: CASE WHEN regexp_matches(p, '^[0-9]+$') THEN CAST(CASE WHEN regexp_matches(p, '^[0-9]+$') THEN p ELSE '0' END AS INTEGER) ELSE coalesce(list_position(['i','ii','iii','iv','v','vi','vii','viii','ix','x'], p), ascii(p) + 1000) END) END AS key FROM k)
SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY key, doc_id) AS place FROM o""")
def natural_sort_merge(spark, d):
    """Order of numbers in the merge: part by part, Roman numerals as numbers, blank last."""
    rows = numbers(spark, d).select("doc_id", "source", X.natural_order(F.col("num")).alias("by"))
    return W.spread_sort(rows, ["source"], "by", "doc_id").select("doc_id", "place")


@query(f"""WITH n AS (SELECT doc_id, source, {NUM_SQL} AS num FROM documents) SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN regexp_extract(num, '[0-9]+') <> '' THEN CAST(CASE WHEN regexp_extract(num, '[0-9]+') <> '' THEN regexp_extract(num, '[0-9]+') ELSE '0' END AS INTEGER) ELSE 1000000000 END, num, doc_id) AS place FROM n""")
def natural_sort_export(spark, d):
    """Order of numbers in the export: the first number, then the text."""
    rows = numbers(spark, d).select("doc_id", "source", X.export_order(F.col("num")).alias("by"))
    return W.spread_sort(rows, ["source"], "by", "doc_id").select("doc_id", "place")


@query(f"SELECT id, unnest(range(p0, p1 + 1, 4)) AS first, least(unnest(range(p0, p1 + 1, 4)) + 3, p1) AS last FROM {SECTIONS_SQL} WHERE p1 - p0 >= 4")
def page_chunks(spark, d):
    """Long page ranges in chunks of four."""
    s = sections(spark, d).filter("p1 - p0 >= 4").select("id", "p1", F.explode(F.sequence("p0", "p1", F.lit(4))).alias("first"))
    return s.select("id", F.col("first").cast("long"), F.least(F.col("first") + 3, F.col("p1")).cast("long").alias("last"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE prev IS NULL OR prev <> event_type")
def change_only_emit(spark, d):
    """A snapshot is emitted when it differs from the one before."""
    w = W.line(["user_id"], "ts", "event_id")
    e = table(spark, d, "events").withColumn("prev", F.lag("event_type").over(w))
    return e.filter("prev is null or prev <> event_type").select("user_id", "event_id", "event_type")


@query("SELECT conv_id, count(*) AS n, sha1(string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn)) AS hash FROM conversations GROUP BY conv_id")
def plain_text_of_blocks(spark, d):
    """The blocks of a section as one text."""
    b = blocks(spark, d).withColumn("text", X.text_or_empty(F.col("text")))
    return W.ordered_list(b, KEY, "turn", "text", "\n\n").select("conv_id", "n", F.sha1("joined").alias("hash"))
