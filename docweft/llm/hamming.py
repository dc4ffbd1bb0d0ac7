"""Exact top-k search in binary codes by incremental multi-index hashing.

A code of ``bits`` bits is cut into m segments, of as many as cost least for codes spread evenly. If the first a + 1 segments were probed up to
radius r and the others up to r - 1, all codes within distance m r + a are known: a code farther in each segment than it was
probed is at least m r + a + 1 away. So radii grow by one; candidates are verified by their whole distance, and the kth verified
distance of a query bounds what it still has to probe: at radius r just the segments a with m r + a up to that bound. Bounds are
looked at again after each radius, and after some segments of a large one. A query is done once its kth distance is covered. There is no other path: small and large tables are searched alike.

A code is taken only by the first of the segments in which it is nearest to the query, so it is found once without a distinct.
Segment values that many codes share are dealt to parts of at most about PART codes, each probed by itself.

Equal codes are one code with a number of rows and its least ids, so a code that many rows share is searched and found once.
Ranks are by distance, then id; a row is not its own neighbour. Nulls: a null code or id is neither found nor searched for.
Repeated ids: each row counts. Empty table: empty result; with fewer than k other rows all are returned. Further columns are ignored.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions

#: Codes of one segment value that are looked up together.
PART = 10_000
#: After about so many probes of a query its bound is looked at again.
STEP = 400
#: A probe (a row that is shuffled and sorted) costs about as much as comparing so many codes.
PROBE = 16


def sign_code(vector: Column) -> Column:
    """The signs of up to 64 numbers as a 64-bit code: 1 for above zero; null for a null or empty vector."""
    bit = lambda x: F.when((x > 0) & ~F.isnan(x), "1").otherwise("0")
    text = F.rpad(F.array_join(F.transform(vector, bit), ""), 64, "0")
    half = lambda at: F.conv(F.substring(text, at, 32), 2, 10).cast("long")
    return F.when(F.size(vector) > 0, F.shiftleft(half(1), 32).bitwiseOR(half(33)))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def cut_evenly(bits: int, m: int) -> list[tuple[int, int]]:
    """(first bit, width) of each of m segments."""
    edges = [bits * k // m for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def segments(bits: int, n_codes: int, need: int) -> list[tuple[int, int]]:
    """The segments whose probes and comparisons cost least for a query among so many codes spread evenly.

    Its ``need``-th neighbour is then at the distance within which so many codes are expected; segments are probed until that is covered.
    """
    ball, reach = 1, 0
    while reach < bits and n_codes * ball < need << bits:
        reach += 1
        ball += math.comb(bits, reach)
    best = None
    for m in range(1, bits + 1):
        widths = [w for _, w in cut_evenly(bits, m)]
        probes = codes = 0
        for at in range(reach + 1):  # segment after segment, radius after radius
            radius, s = divmod(at, m)
            probes += math.comb(widths[s], radius)
            codes += math.comb(widths[s], radius) * n_codes / (1 << widths[s])
        cost = PROBE * probes + codes
        if best is None or cost < best[0]:
            best = cost, m
    return cut_evenly(bits, best[1])


def search(rows: DataFrame, queries: DataFrame, k: int, bits: int = 64) -> DataFrame:
    """query_id, rank, neighbor_id, distance from rows and queries (id, code)."""
    some = lambda df, i, c: df.select(F.col("id").cast("long").alias(i), F.col("code").cast("long").alias(c)).dropna()
    rows, queries = some(rows, "id", "code"), cut(some(queries, "query_id", "q"))
    need = k + 1  # the query itself may be among them
    by_code = Window.partitionBy("code").orderBy("id")
    least = cut(rows.withColumn("n", F.row_number().over(by_code)).filter(F.col("n") <= need).drop("n"))
    codes = cut(least.groupBy("code").agg(F.count("*").alias("copies"), F.min("id").alias("first")))
    near = nearest_codes(codes, queries.select("q").distinct(), need, bits)
    # codes to rows, once for each query code, then to the queries that have it
    top = Window.partitionBy("q").orderBy("d", "id")
    near = near.join(least, "code").withColumn("n", F.row_number().over(top)).filter(F.col("n") <= need)
    lists = near.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("d", "id"))).alias("near"))  # need rows at most
    others = F.filter("near", lambda x: x["id"] != F.col("query_id"))
    each = queries.join(lists, "q").select("query_id", F.posexplode(F.slice(others, 1, k)).alias("p", "x"))
    distance_ = F.col("x.d").cast("int").alias("distance")
    return each.select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.id").alias("neighbor_id"), distance_)


def nearest_codes(codes: DataFrame, queries: DataFrame, need: int, bits: int = 64) -> DataFrame:
    """q, code, copies, first, d, radius: of each query code the nearest codes (code, copies, first) that hold ``need`` rows.

    ``radius`` is the segment radius with which the query was done.
    """
    spark = codes.sparkSession
    cuts = segments(bits, codes.count(), need)
    m, widest = len(cuts), max(w for _, w in cuts)
    index = codes.select("code", "copies", "first", F.inline(_values(F.col("code"), cuts)))
    crowds = cut(index.groupBy("s", "v").count().filter(F.col("count") > PART).select("s", "v", F.ceil(F.col("count") / PART).cast("int").alias("parts")))
    crowded = not crowds.isEmpty()
    if crowded:
        index = index.join(crowds, ["s", "v"], "left").withColumn("part", F.pmod(F.xxhash64("code"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    index = cut(index)
    best = Window.partitionBy("q").orderBy("d", "first", "code")
    run = F.sum("copies").over(best.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    open_ = cut(queries.select("q", F.lit(None).cast("int").alias("bound")))
    columns = ["q", "code", "copies", "first", "d"]
    found, done = None, []
    for radius, low, high in steps(cuts):
        if open_.isEmpty():
            break
        probes = _probes(open_.repartition(partitions(spark), "q"), cuts, radius, low, high)
        if crowded:
            probes = probes.join(crowds, ["s", "v"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        # Spark can't foresee how many values there are, so it is told not to broadcast them
        hits = probes.hint("merge").join(index, ["s", "v", "part"] if crowded else ["s", "v"])
        hits = hits.filter(_first_segment(cuts, radius)).withColumn("d", distance(F.col("q"), F.col("code")))
        hits = hits.filter(F.col("bound").isNull() | (F.col("d") <= F.col("bound"))).select(*columns)
        both = hits if found is None else hits.unionByName(found)
        found = cut(both.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= need).drop("n"))
        kth = found.withColumn("run", run).filter(F.col("run") >= need).groupBy("q").agg(F.min("d").alias("kth"))
        covered = F.least(F.lit(m * radius + high - 1), F.coalesce("bound", F.lit(bits)))
        ready = F.coalesce(F.col("kth") <= covered, F.lit(False)) | F.lit(radius == widest and high == m)
        state = cut(open_.join(kth, "q", "left").select("q", "kth", ready.alias("ready")))
        done.append(found.join(state.filter("ready").select("q"), "q", "left_semi").withColumn("radius", F.lit(radius)))
        open_ = state.filter("not ready").select("q", F.col("kth").alias("bound"))
        found = found.join(open_.select("q"), "q", "left_semi")
    out = codes.limit(0).select(F.lit(0).cast("long").alias("q"), "code", "copies", "first", F.lit(0).alias("d"), F.lit(0).alias("radius"))
    for more in done:
        out = out.unionByName(more)
    return out


def steps(cuts: list[tuple[int, int]]):
    """(radius, first segment, end): segments in order, by growing radius, about STEP values together; all of the first two radii."""
    for radius in range(max(w for _, w in cuts) + 1):
        low, size = 0, 0
        for s, (_, w) in enumerate(cuts):
            size += math.comb(w, radius)
            if s + 1 == len(cuts) or radius > 1 and size >= STEP:
                yield radius, low, s + 1
                low, size = s + 1, 0


def _values(code: Column, cuts: list[tuple[int, int]]) -> Column:
    """(s, v) of each segment of a code."""
    value = lambda a, w: F.shiftrightunsigned(code, a).bitwiseAND(F.lit((1 << w) - 1))
    return F.array(*[F.struct(F.lit(s).alias("s"), value(a, w).alias("v")) for s, (a, w) in enumerate(cuts)])


def _probes(open_: DataFrame, cuts: list[tuple[int, int]], radius: int, low: int, high: int) -> DataFrame:
    """q, bound, s, v: the values at this distance from the query's, in those of the segments that its bound leaves."""
    masks = {w: _long_array([sum(1 << b for b in turned) for turned in itertools.combinations(range(w), radius)]) for _, w in cuts}
    out = open_.select("q", "bound", F.inline(_values(F.col("q"), cuts)))
    out = out.filter((F.col("s") >= low) & (F.col("s") < high))
    out = out.filter(F.col("bound").isNull() | (F.col("s") + len(cuts) * radius <= F.col("bound")))
    mask = F.explode(_choose([masks[w] for _, w in cuts]))
    return out.withColumn("mask", mask).select("q", "bound", "s", F.col("v").bitwiseXOR(F.col("mask")).alias("v"))


def _first_segment(cuts: list[tuple[int, int]], radius: int) -> Column:
    """Whether ``s`` is the first segment in which the code is at ``radius`` from the query, and it is nearer in none."""
    x = F.col("q").bitwiseXOR(F.col("code"))
    apart = [F.bit_count(x.bitwiseAND(F.lit(_signed(((1 << w) - 1) << a)))) for a, w in cuts]
    none_nearer = F.lit(True)
    first = F.lit(True)
    for s, d in enumerate(apart):
        none_nearer = none_nearer & (d >= radius)
        first = first & ((F.col("s") <= s) | (d > radius))
    return none_nearer & first


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _long_array(values: list[int]) -> Column:
    """A constant array, as one literal; empty where a segment has fewer bits than are to be turned."""
    if not values:
        return F.array().cast("array<bigint>")
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _choose(masks: list[Column]) -> Column:
    out = F.when(F.col("s") == 0, masks[0])
    for s, m in enumerate(masks[1:], 1):
        out = out.when(F.col("s") == s, m)
    return out
