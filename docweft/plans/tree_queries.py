"""Queries on the tree region > nation > customer > order: a node's path holds the keys from the region down."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import tree as T
from ..sources.tables import table
from .join_queries import SECTIONS_SQL, sections
from .registry import query

NODES_SQL = """(SELECT [r_regionkey] AS path, r_name AS title, 0 AS expected, 1 AS p0, 1 AS p1 FROM region
 UNION ALL SELECT [n_regionkey, n_nationkey], n_name, 0, 1, 2 FROM nation
 UNION ALL SELECT [n_regionkey, n_nationkey, c_custkey], c_mktsegment, 1, CAST(1 + c_custkey % 50 AS INTEGER), CAST(5 + c_custkey % 50 AS INTEGER) FROM customer JOIN nation ON n_nationkey = c_nationkey
 UNION ALL SELECT [n_regionkey, n_nationkey, c_custkey, o_orderkey], o_orderpriority, CAST(o_orderkey % 3 AS INTEGER), CAST(1 + o_orderkey % 97 AS INTEGER), CAST(1 + o_orderkey % 97 + o_orderkey % 5 AS INTEGER) FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"""
KEY_SQL = "array_to_string({}, '.')"


def nodes(spark, d):
    region, nation, customer, orders = (table(spark, d, n) for n in ("region", "nation", "customer", "orders"))
    nation = nation.select("n_regionkey", "n_nationkey", "n_name")
    customer = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = orders.join(customer.select("n_regionkey", "n_nationkey", "c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    level = lambda df, path, *cols: df.select(F.array(*[F.col(p).cast("long") for p in path]).alias("path"), *[c.alias(n) for c, n in zip(cols, ("title", "expected", "p0", "p1"))])
    i = lambda c: c.cast("int")
    c, o = F.col("c_custkey"), F.col("o_orderkey")
    path = ["n_regionkey", "n_nationkey", "c_custkey", "o_orderkey"]
    levels = [
        level(region, ["r_regionkey"], F.col("r_name"), F.lit(0), F.lit(1), F.lit(1)),
        level(nation, path[:2], F.col("n_name"), F.lit(0), F.lit(1), F.lit(2)),
        level(customer, path[:3], F.col("c_mktsegment"), F.lit(1), i(1 + c % 50), i(5 + c % 50)),
        level(orders, path, F.col("o_orderpriority"), i(o % 3), i(1 + o % 97), i(1 + o % 97 + o % 5)),
    ]
    return reduce(lambda a, b: a.unionByName(b), levels)


def key(c="path"):
    return F.array_join(c, ".")


@query(f"SELECT {KEY_SQL.format('path')} AS node, row_number() OVER (PARTITION BY path[1:2] ORDER BY path) AS place FROM {NODES_SQL}")
def tree_preorder(spark, d):
    """Each node's place in a walk of its nation's tree."""
    return T.preorder(nodes(spark, d), 2).select(key().alias("node"), "place")


@query(f"""WITH n AS {NODES_SQL} SELECT {KEY_SQL.format('a.path')} AS node, a.title FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE len(b.path) > len(a.path) AND b.path[1:3] = a.path AND b.title = a.title) AND len(a.path) = 3
UNION ALL SELECT {KEY_SQL.format('path')}, title FROM n WHERE len(path) <> 3""")
def tree_descendant_dedup(spark, d):
    """Blocks of a node go when a node below it has the same one."""
    return T.drop_repeated_in_descendants(nodes(spark, d).select("path", "title"), "title").select(key().alias("node"), "title")


@query(f"""WITH n AS {NODES_SQL}, u AS (SELECT unnest(list_transform(range(1, len(path) + 1), lambda k: path[1:k])) AS up, expected FROM n)
SELECT {KEY_SQL.format('up')} AS node, CAST(sum(expected) AS BIGINT) AS total, count(*) AS n FROM u GROUP BY up""")
def tree_subtree_sum(spark, d):
    """Expected counts over each subtree."""
    return T.subtree_sum(nodes(spark, d), "expected").select(key().alias("node"), "total", "n")


@query(f"""WITH n AS {NODES_SQL}, p AS (SELECT DISTINCT path[1:len(path) - 1] AS path FROM n WHERE len(path) > 1) SELECT {KEY_SQL.format('n.path')} AS node, p.path IS NULL AS is_leaf FROM n LEFT JOIN p ON p.path = n.path WHERE p.path IS NULL OR len(n.path) = 1""")
def tree_leaf_or_top(spark, d):
    """Leaves and top-level nodes."""
    return T.with_children(nodes(spark, d)).filter("is_leaf or depth = 0").select(key().alias("node"), "is_leaf")


@query(f"""WITH n AS {NODES_SQL}, u AS (SELECT unnest(list_transform(range(1, len(path) + 1), lambda k: path[1:k])) AS up, p0, p1 FROM n) SELECT {KEY_SQL.format('up')} AS node, min(p0) AS p0, max(p1) AS p1 FROM u GROUP BY up""")
def tree_minmax_rollup(spark, d):
    """Page ranges from the bottom up."""
    return T.roll_up(nodes(spark, d), "p0", "p1").select(key().alias("node"), "p0", "p1")


@query(f"WITH n AS {NODES_SQL}, c AS (SELECT path FROM n WHERE len(path) = 3 AND title = 'BUILDING') SELECT {KEY_SQL.format('path')} AS node FROM n WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.path = n.path[1:3])")
def tree_prune(spark, d):
    """The tree without the subtrees of matching nodes."""
    n = nodes(spark, d)
    return T.prune(n, n.filter((F.size("path") == 3) & (F.col("title") == "BUILDING"))).select(key().alias("node"))


@query(f"WITH n AS {NODES_SQL} SELECT {KEY_SQL.format('path')} AS node, {KEY_SQL.format('path[1:len(path) - 1]')} AS parent FROM n WHERE len(path) > 1")
def tree_parent_map(spark, d):
    """Each node's parent."""
    return nodes(spark, d).filter(F.size("path") > 1).select(key().alias("node"), key(F.slice("path", 1, F.size("path") - 1)).alias("parent"))


@query(f"WITH n AS {NODES_SQL}, f AS (SELECT path, row_number() OVER (PARTITION BY path[1:2], title ORDER BY path) AS nth, title FROM n) SELECT {KEY_SQL.format('path')} AS node, title FROM f WHERE nth = 1")
def tree_first_seen(spark, d):
    """Of nodes with one name in a nation the first of the walk."""
    first = nodes(spark, d).groupBy(F.slice("path", 1, 2).alias("top"), "title").agg(F.min("path").alias("path"))
    return first.select(key().alias("node"), "title")


@query(f"WITH n AS {NODES_SQL}, c AS (SELECT CAST(doc_id AS BIGINT) AS id, doc_id % 7 AS expected FROM documents) SELECT {KEY_SQL.format('n.path')} AS node, CAST(coalesce(c.expected, n.expected) AS BIGINT) AS expected FROM n LEFT JOIN c ON c.id = n.path[len(n.path)]")
def tree_corrections(spark, d):
    """Corrections by id take the place of a node's own values."""
    c = table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 7).alias("fixed"))
    n = nodes(spark, d).withColumn("id", F.element_at("path", -1))
    return n.join(c, "id", "left").select(key().alias("node"), F.coalesce("fixed", F.col("expected").cast("long")).alias("expected"))


@query(f"WITH n AS {NODES_SQL}, p AS (SELECT path[1:len(path) - 1] AS up, count(*) AS n_children, CAST(sum(expected) AS BIGINT) AS expected FROM n WHERE len(path) > 1 GROUP BY up) SELECT {KEY_SQL.format('n.path')} AS node, coalesce(n_children, 0) AS n_children, coalesce(p.expected, 0) AS below FROM n LEFT JOIN p ON p.up = n.path")
def tree_attach_counts(spark, d):
    """Counts of the level below on each node."""
    n = nodes(spark, d).select("path", "expected")
    below = n.filter(F.size("path") > 1).groupBy(F.slice("path", 1, F.size("path") - 1).alias("path")).agg(F.count("*").alias("n_children"), F.sum("expected").alias("below"))
    return n.join(below, "path", "left").select(key().alias("node"), F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("below", F.lit(0)).alias("below"))


# ---------------------------------------------------------------- validators: rows of violations

V_SQL = f"""WITH s AS (SELECT *, CASE WHEN id % 101 = 0 THEN -p0 ELSE p0 END AS a, CASE WHEN id % 53 = 0 THEN p0 - 1 ELSE p1 END AS b FROM {SECTIONS_SQL}),
v AS (SELECT 'bad_page' AS type, id, 'error' AS severity FROM s WHERE a < 1
UNION ALL SELECT 'start_after_end', id, 'error' FROM s WHERE a > b
UNION ALL SELECT 'beyond_total', id, 'error' FROM s WHERE greatest(a, b) > 100
UNION ALL SELECT 'bad_type', id, 'error' FROM s WHERE title NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED')
UNION ALL SELECT 'leaf_without_start', id, 'error' FROM s WHERE level = 3 AND id % 17 = 0
UNION ALL SELECT DISTINCT 'sibling_overlap', x.id, 'error' FROM s x JOIN s y ON x.book = y.book AND x.level = y.level AND x.id < y.id AND least(x.b, y.b) - greatest(x.a, y.a) + 1 >= 2
UNION ALL SELECT DISTINCT 'duplicate_title', x.id, 'warning' FROM s x JOIN s y ON x.book = y.book AND x.title = y.title AND x.level = 1 AND y.level = 2)"""


def violations(spark, d):
    """type, id, severity of each broken rule; pages of some sections are made wrong on purpose."""
    s = sections(spark, d)
    s = s.withColumns({"a": F.when(F.col("id") % 101 == 0, -F.col("p0")).otherwise(F.col("p0")), "b": F.when(F.col("id") % 53 == 0, F.col("p0") - 1).otherwise(F.col("p1"))})
    types = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]
    # rules on one row: a single pass over the table yields all of them
    tests = {
        "bad_page": F.col("a") < 1, "start_after_end": F.col("a") > F.col("b"), "beyond_total": F.greatest("a", "b") > 100,
        "bad_type": ~F.col("title").isin(types), "leaf_without_start": (F.col("level") == 3) & (F.col("id") % 17 == 0),
    }
    found = s.select("id", F.explode(F.array_compact(F.array(*[F.when(test, name) for name, test in tests.items()]))).alias("type"))
    out = found.select("type", "id", F.lit("error").alias("severity"))
    overlap = J.overlapping(s.withColumnsRenamed({"a": "low", "b": "high"}), ["book", "level"], "id", "low", "high", 2).withColumnRenamed("a", "id")
    titles = s.filter("level = 1").join(s.filter("level = 2").select("book", "title"), ["book", "title"], "left_semi")
    out = out.unionByName(overlap.select(F.lit("sibling_overlap").alias("type"), "id", F.lit("error").alias("severity")).distinct())
    return out.unionByName(titles.select(F.lit("duplicate_title").alias("type"), "id", F.lit("warning").alias("severity")))


@query(f"{V_SQL} SELECT * FROM v")
def validator_all(spark, d):
    """All violations of all rules."""
    return violations(spark, d)


@query(f"{V_SQL} SELECT type, severity, count(*) AS n FROM v GROUP BY ALL")
def validator_summary(spark, d):
    """Violations by rule."""
    return violations(spark, d).groupBy("type", "severity").agg(F.count("*").alias("n"))


@query(f"{V_SQL} SELECT id, string_agg(CASE type WHEN 'bad_page' THEN 'Pages begin at 1.' WHEN 'start_after_end' THEN 'Start after end.' ELSE 'Check ' || type || '.' END, ' ' ORDER BY type) AS prompt FROM v WHERE severity = 'error' GROUP BY id")
def validator_prompt(spark, d):
    """A corrective message for each section with errors."""
    text = F.when(F.col("type") == "bad_page", "Pages begin at 1.").when(F.col("type") == "start_after_end", "Start after end.").otherwise(F.concat(F.lit("Check "), "type", F.lit(".")))
    rows = violations(spark, d).filter("severity = 'error'").select("id", "type", text.alias("text"))
    return rows.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type", "text"))), lambda x: x["text"]), " ").alias("prompt"))


@query(f"""WITH s AS {SECTIONS_SQL}, b AS (SELECT id, level = 1 AS cat_b, level = 3 AS cat_a, book FROM s), o AS (SELECT *, last_value(CASE WHEN cat_b THEN id END IGNORE NULLS) OVER (PARTITION BY book ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS owner FROM b)
SELECT id, owner FROM o WHERE cat_a AND owner IS NOT NULL""")
def validator_nesting(spark, d):
    """Question sections that belong under the theory section before them."""
    from ..operators.windows import carry_forward

    s = sections(spark, d)
    owner = carry_forward(F.col("id"), F.col("level") == 1, ["book"], "id")
    return s.withColumn("owner", owner).filter("level = 3 and owner is not null").select("id", "owner")
