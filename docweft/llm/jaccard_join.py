"""Near-duplicate documents by a chosen-path join on word shingles.

A document is the set of its shingles of ``width`` words. Documents with one set are a node. A node's set is embedded as SIGNATURE
sampled tokens (minima of hash functions). In each run a node chooses some of its tokens by a hash that all nodes share, on
average 1 / threshold of them, then further ones by a hash of the path so far: nodes with one path share all tokens on it. Pairs
at the threshold keep at least one common path in a run with a probability that is known for each depth, and there are as many
runs as give ``recall``; the depth grows with the logarithm of the number of nodes. Where buckets are split, paths get longer: the
nodes of all split buckets get further runs, until there are as many as give ``recall`` at the greatest depth that was reached.

In each bucket (path) the least node is compared with all others by signature. Those far above the loose bound are done with, as
whatever is near them is within the bound of the least node as well (distances obey the triangle inequality); among those that
are left, small buckets are compared by brute force, and large ones are split by further tokens, unless all in them are linked to
the least node anyway. Loose links join nodes to candidate groups; inside a group all pairs of nodes are compared exactly, block
against block of about BLOCK sets or BLOCK_SHINGLES shingles, whichever are fewer, so that a large group, or one of long texts,
spreads over tasks; small groups share tasks of about BLOCK_SHINGLES. A task holds two blocks at most, and a single longer text
whole. No pair is written: a task returns each node's number of links and one edge to its component.

Words are folded to lower case (A-Z). A text of fewer words than a shingle has one shingle of all its words. Nulls: a null text is
empty, and texts without words are copies of each other. Very long texts: whole. Repeated rows and equal ids: each row is a
document; of rows that are equal in id and text ``keep_one_of_each`` keeps one at most. Missing ids stand after all others.
Empty table: empty result. Further columns are ignored by ``link_documents`` and kept by ``keep_one_of_each``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, batches, cut, mix, release, rolling
from .graph import components

SIGNATURE = 64
#: Estimates from signatures: a node this near the bucket's least is done with; one this near may be linked to it.
NEAR, LOOSE = 0.75, 0.4
#: Buckets up to this size are compared by brute force.
SMALL = 2_000
#: Rows of such buckets that share a task, on average.
BUNDLE = 2_000
BLOCK, BLOCK_SHINGLES = 1_000, 400_000
_A = mix(np.arange(1, SIGNATURE + 1, dtype=np.uint64)) | np.uint64(1)
_B = mix(np.arange(1001, SIGNATURE + 1001, dtype=np.uint64))


def shingle_sets(texts, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = Words(list(texts), lower=True)
    every = rolling(w.hash, width)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(every[a : b - width + 1]))
        else:
            out.append(rolling(w.hash[a:b], b - a, 7) if b > a else np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of SIGNATURE hash functions over each set, a row per set; an empty set has zeros."""
    sizes = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), SIGNATURE), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        data = np.concatenate([sets[k] for k in full])
        for k in range(SIGNATURE):
            out[full, k] = np.minimum.reduceat(data * _A[k] + _B[k], at)
    return mix(out)


def survival(depth: int) -> float:
    """Chance that a pair at the threshold has a common path of this depth: a branching process of mean 1."""
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-p)
    return p


def runs_for(recall: float, depth: int) -> int:
    """Runs after which a pair at the threshold has had a common path of this depth with a chance of ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(depth)))


def starts(first: int, last: int) -> np.ndarray:
    """Paths of no token, one for each of the runs from first to last."""
    return mix(np.arange(first, last + 1, dtype=np.uint64))


def extend(paths: np.ndarray, owner: np.ndarray, tokens: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Each path of a node (row ``owner`` of ``tokens``), longer by each token that the path's hash chooses."""
    most = np.uint64(min((1 << 64) - 1, int((1 << 64) / (threshold * SIGNATURE))))
    place = np.arange(1, SIGNATURE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    found, whose = [], []
    for k in range(0, len(paths), 4_000):
        h = mix(paths[k : k + 4_000, None] * np.uint64(0xD1342543DE82EF95) + tokens[owner[k : k + 4_000]] + place)
        row, col = np.nonzero(mix(h ^ np.uint64(0x5851F42D4C957F2D)) < most)
        found.append(h[row, col])
        whose.append(owner[k : k + 4_000][row])
    return (np.concatenate(found), np.concatenate(whose)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def tokens_of(packed) -> np.ndarray:
    """A byte of each token, a row per signature; they travel as eight to a number."""
    return np.array(packed.tolist(), np.int64).view(np.uint8).reshape(-1, SIGNATURE)


def _folded(shift: int):
    return lambda v: v.bitwiseOR(F.shiftrightunsigned(v, shift))


def alike(a: str, b: str) -> Column:
    """Share of the tokens that two signatures have in common: of the numbers' differences, the bytes that are zero are counted."""
    x = F.zip_with(a, b, lambda p, q: p.bitwiseXOR(q))
    for shift in (4, 2, 1):  # brings all bits of a byte together in its lowest one
        x = F.transform(x, _folded(shift))
    differ = F.aggregate(x, F.lit(0), lambda total, v: total + F.bit_count(v.bitwiseAND(F.lit(0x0101010101010101))))
    return 1 - differ / SIGNATURE


def brute_roots(tokens: np.ndarray) -> np.ndarray:
    """Of each row of a bucket the least row that it is loosely linked with, over any number of links."""
    left, ones, others = np.arange(len(tokens)), [], []
    while len(left) > 1:
        lead, left = left[0], left[1:]
        alike = (tokens[left] == tokens[lead]).mean(axis=1)
        ones.append(left[alike >= LOOSE])
        others.append(np.full(len(ones[-1]), lead))
        left = left[alike < NEAR]
    return roots(len(tokens), np.concatenate(ones), np.concatenate(others)) if ones else left


def intersections(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of each set on the left with each on the right (or left), by products of 0/1 matrices."""
    sets = left + (right or [])
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    order = np.argsort(values, kind="stable")
    values, row = values[order], row[order]
    new = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1 if len(values) else np.zeros(0, bool)
    keep = shared[column]
    row, column = row[keep], (np.cumsum(shared) - 1)[column[keep]]
    n, m = len(left), int(shared.sum())
    total = np.zeros((n, len(right) if right is not None else n), np.float32)
    step = max(64, 24_000_000 // max(1, len(sets)) // 4)
    for low in range(0, m, step):
        a, b = np.searchsorted(column, [low, low + step])
        x = np.zeros((len(sets), min(step, m - low)), np.float32)
        x[row[a:b], column[a:b] - low] = 1
        total += x[:n] @ (x[n:] if right is not None else x).T
    return total


def find_links(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Which sets are linked; against themselves (right is None) without the diagonal."""
    a = np.array([len(s) for s in left], np.float64)
    b = a if right is None else np.array([len(s) for s in right], np.float64)
    both = intersections(left, right).astype(np.float64)
    linked = both >= threshold * (a[:, None] + b[None, :] - both) - 1e-9
    linked &= both > 0
    if right is None:
        np.fill_diagonal(linked, False)
    return linked


def roots(n: int, pairs_i: np.ndarray, pairs_j: np.ndarray) -> np.ndarray:
    """The least row that each row is connected with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[pairs_i], root[pairs_j])
        fresh = root.copy()
        np.minimum.at(fresh, pairs_i, low)
        np.minimum.at(fresh, pairs_j, low)
        fresh = fresh[fresh]
        if (fresh == root).all():
            return root
        root = fresh


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the same components and few of them: each ``a`` keeps its least ``b``, to which its others are linked instead.

    Nodes of a group share the leads of its buckets, so what many nodes said of the same leads is said once. A node has no more
    values of b than buckets.
    """
    stars = edges.groupBy("a").agg(F.min("b").alias("least"), F.collect_set("b").alias("all"))
    ends = F.concat(F.array(F.struct("a", F.col("least").alias("b"))), F.transform("all", lambda x: F.struct(x.alias("a"), F.col("least").alias("b"))))
    return stars.select(F.inline(ends)).filter("a != b").distinct()


class Join:
    """Tables of one join: ``documents`` (doc_id, node) and ``nodes`` (node, root, links); all in the shared folder."""

    def __init__(self, docs: DataFrame, width: int = 5, threshold: float = 0.8, recall: float = 0.99):
        self.spark, self.width, self.threshold = docs.sparkSession, width, threshold
        text = F.col("text").cast("string")
        rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))
        n = rows.count()
        depth = max(2, 2 + math.ceil(math.log(max(1, n) / 1e6, 16)))
        runs = runs_for(recall, depth)
        self.documents = cut(self._embed(rows, depth, runs))
        first = [F.first(c).alias(c) for c in ("tokens", "paths", "size")]
        ids = [F.min(F.col("doc_id").cast("long")).alias("first_id"), F.min("doc_id").alias("doc_id")]
        self.copies = cut(self.documents.groupBy("node").agg(F.count("*").alias("copies"), *first, *ids))
        groups = components(self._candidates(depth, runs, recall))
        found = cut(self._compare(rows, groups))
        ends = components(found.filter("node != peer").select(F.col("node").alias("a"), F.col("peer").alias("b")))
        links = found.groupBy("node").agg(F.sum("links").alias("links"))
        self.nodes = cut(
            self.copies.select("node", "copies", "first_id").join(links, "node", "left").join(ends, "node", "left")
            .select("node", "copies", "first_id", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
        )

    def _embed(self, rows: DataFrame, depth: int, runs: int) -> DataFrame:
        width, threshold = self.width, self.threshold

        def run(frames):
            import xxhash

            for frame in batches(frames):
                sets = shingle_sets(frame["text"], width)
                tokens = signatures(sets)
                paths = np.tile(starts(1, runs), len(sets))
                owner = np.repeat(np.arange(len(sets)), runs)
                for _ in range(depth):
                    paths, owner = extend(paths, owner, tokens, threshold)
                order = np.argsort(owner, kind="stable")
                limits = np.searchsorted(owner[order], np.arange(len(sets) + 1))
                paths = paths[order].view(np.int64)
                yield pd.DataFrame({
                    "doc_id": frame["doc_id"].to_numpy(), "mark": frame["mark"].to_numpy(),
                    "node": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "size": list(map(len, sets)),
                    "tokens": list(np.ascontiguousarray(tokens.astype(np.uint8)).view(np.int64)),
                    "paths": [np.unique(paths[a:b]) if len(s) else np.zeros(0, np.int64) for s, a, b in zip(sets, limits[:-1], limits[1:])],
                })

        return rows.mapInPandas(run, "doc_id string, mark long, node binary, size long, tokens array<long>, paths array<long>")

    def _candidates(self, depth: int, runs: int, recall: float) -> DataFrame:
        """Loose links between nodes: a, b."""
        threshold = self.threshold

        def brute(frame):
            out = set()  # a row has one edge in a bucket, and the same edges come again in other buckets
            for _, bucket in frame.groupby("path", sort=False):
                if len(bucket) > 1:
                    names = bucket["node"].tolist()
                    out |= {(names[i], names[j]) for i, j in enumerate(brute_roots(tokens_of(bucket["tokens"]))) if i != j}
            release()
            return pd.DataFrame(sorted(out), columns=["a", "b"])

        def split(frames):
            for frame in frames:
                tokens = tokens_of(frame["tokens"])
                paths, owner = extend(frame["path"].to_numpy().view(np.uint64), np.arange(len(frame)), tokens.astype(np.uint64), threshold)
                yield pd.DataFrame({"path": paths.view(np.int64), "node": frame["node"].to_numpy()[owner]})

        def further(first, last):
            def run(frames):
                for frame in frames:
                    tokens = tokens_of(frame["tokens"]).astype(np.uint64)
                    paths, owner = np.tile(starts(first, last), len(frame)), np.repeat(np.arange(len(frame)), last - first + 1)
                    for _ in range(depth):
                        paths, owner = extend(paths, owner, tokens, threshold)
                    yield pd.DataFrame({"path": paths.view(np.int64), "node": frame["node"].to_numpy()[owner]}).drop_duplicates()

            return run

        sign = self.copies.select("node", "tokens")
        rows, found, halved = self.copies.select("node", F.explode("paths").alias("path")), [], None
        at = deepest = depth
        while True:
            heads = rows.groupBy("path").agg(F.count("*").alias("n"), F.min("node").alias("lead")).filter("n > 1")
            star = rows.join(heads, "path").filter("node != lead")
            star = star.join(sign, "node").join(sign.select(F.col("node").alias("lead"), F.col("tokens").alias("lead_tokens")), "lead")
            star = cut(star.withColumn("alike", alike("tokens", "lead_tokens")).filter(f"alike >= {LOOSE} or n > 2").select("path", "node", "lead", "tokens", "n", "alike"))
            found.append(star.filter(F.col("alike") >= LOOSE).select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct())
            rest = star.filter((F.col("alike") < NEAR) & (F.col("n") > 2))
            small, large = [rest.filter(F.col("n") <= SMALL)], rest.filter(F.col("n") > SMALL)
            more = not large.isEmpty()
            if more:  # only those left count; where the lead has linked all of them, their pairs are in one candidate group
                left = large.groupBy("path").agg(F.count("*").alias("left"), F.min("alike").alias("least")).filter(f"left > 1 and least < {LOOSE}")
                large = cut(large.join(left, "path").select("path", "node", "tokens", "left"))
                small.append(large.filter(F.col("left") <= SMALL))
                large = large.filter(F.col("left") > SMALL)
                more = not large.isEmpty()
            for part in small:
                part = part.select("path", "node", "tokens")
                bundle = F.pmod(F.xxhash64("path"), F.lit(math.ceil(part.count() / BUNDLE) or 1))
                found.append(part.withColumn("bundle", bundle).groupBy("bundle").applyInPandas(brute, "a binary, b binary"))
            if more:
                at += 1
                deepest = max(deepest, at)
                if halved is None:  # what is split further, or in further runs, are some of these
                    halved = cut(large.select("node").distinct())
                rows = cut(large.select("path", "node", "tokens").mapInPandas(split, "path long, node binary"))
                continue
            wanted = runs_for(recall, deepest)
            if wanted <= runs:
                break
            again = sign.join(halved, "node")
            rows, runs, at = cut(again.mapInPandas(further(runs + 1, wanted), "path long, node binary")), wanted, depth
        out = found[0]
        for more in found[1:]:
            out = out.union(more)
        return contracted(out)

    def _compare(self, rows: DataFrame, groups: DataFrame) -> DataFrame:
        """node, links (documents of other nodes that are linked), peer (a node of its component) from each task that has the node."""
        threshold, width = self.threshold, self.width
        weighed = groups.join(self.copies.select("node", "size"), "node")
        sizes = weighed.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("weight"))
        sizes = cut(sizes.select("root", "weight", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("weight") / BLOCK_SHINGLES, F.lit(1))).cast("int").alias("blocks")))
        shared = sizes.filter("blocks = 1").agg(F.sum("weight").alias("w")).first()["w"] or 0
        member = groups.join(sizes.drop("weight"), "root")
        member = member.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        # one text stands for a node: that of a document with this set, chosen when copies were counted, so copies never meet again
        one = self.copies.select("node", "copies", "doc_id").join(member, "node")

        def sets(frames):
            import xxhash

            for frame in batches(frames):
                found = shingle_sets(frame["text"], width)
                own = [xxhash.xxh3_128_digest(s.tobytes()) == node for s, node in zip(found, frame["node"])]
                frame = frame.drop(columns="text").assign(shingles=[s.tobytes() for s in found])
                yield frame[own]

        texts = rows.join(one, rows["doc_id"].eqNullSafe(one["doc_id"])).select("node", "root", "blocks", "block", "copies", "text")
        full = texts.mapInPandas(sets, "node binary, root binary, blocks int, block int, copies long, shingles binary").dropDuplicates(["node"])
        # small groups share tasks; of a large one each pair of blocks is a task
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        dealt = full.withColumn("other", other).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
        task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(math.ceil(shared / BLOCK_SHINGLES) or 1))).otherwise(F.xxhash64("root", "i", "j"))

        def compare(frame):
            out = []
            for (_, i, j), part in frame.groupby(["root", "i", "j"], sort=False):
                shingles = [np.frombuffer(b, np.uint64) for b in part["shingles"]]
                names, copies, block = part["node"].tolist(), part["copies"].to_numpy(), part["block"].to_numpy()
                if i == j:
                    linked = find_links(shingles, None, threshold)
                    links = linked @ copies
                    a, b = np.nonzero(np.triu(linked))
                else:
                    x, y = np.flatnonzero(block == i), np.flatnonzero(block == j)
                    linked = find_links([shingles[k] for k in x], [shingles[k] for k in y], threshold)
                    links = np.zeros(len(names), np.int64)
                    links[x], links[y] = linked @ copies[y], linked.T @ copies[x]
                    a, b = np.nonzero(linked)
                    a, b = x[a], y[b]
                root = roots(len(names), a, b)
                out += [(names[k], int(links[k]), names[root[k]]) for k in range(len(names)) if links[k]]
            release()
            return pd.DataFrame(out, columns=["node", "links", "peer"])

        cols = ["node", "root", "i", "j", "block", "copies", "shingles"]
        return dealt.withColumn("task", task).select("task", *cols).groupBy("task").applyInPandas(compare, "node binary, links long, peer binary")


def link_documents(docs: DataFrame, width: int = 5, threshold: float = 0.8, recall: float = 0.99) -> DataFrame:
    """doc_id, class_id, n_links for each row: the least id of its class of linked documents, and how many other documents it is linked to."""
    j = Join(docs, width, threshold, recall)
    least = j.nodes.groupBy("root").agg(F.min("first_id").alias("class_id"))
    nodes = j.nodes.join(least, "root").select("node", "class_id", (F.col("copies") - 1 + F.col("links")).alias("n_links"))
    return j.documents.select(F.col("doc_id").cast("long").alias("doc_id"), "node").join(nodes, "node").select("doc_id", "class_id", "n_links")


def keep_one_of_each(docs: DataFrame, width: int = 5, threshold: float = 0.8, recall: float = 0.99) -> DataFrame:
    """The rows of ``docs``, of each class only one: that with the least id."""
    j = Join(docs, width, threshold, recall)
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id").cast("long"), F.col("mark"), name.alias("name"))
    least = j.documents.join(j.nodes.select("node", "root"), "node").groupBy("root").agg(F.min(order).alias("least"))
    keep = least.select("least.name", "least.mark")
    # the row travels as one value, so none of its columns can clash
    rows = docs.select(name.alias("name"), F.xxhash64(F.col("text").cast("string")).alias("mark"), F.struct("*").alias("row"))
    if not j.documents.groupBy("doc_id", "mark").count().filter("count > 1").isEmpty():
        rows = rows.groupBy("name", "mark").agg(F.first("row").alias("row"))
    return rows.join(keep, ["name", "mark"], "left_semi").select("row.*")
