"""Removal of repeated passages by fixed-block anchors.

A repeat is a run of at least ``window`` words whose every window also starts in a document with a smaller id; windows are
judged on the input. Each text is cut into non-overlapping reference blocks of ``(window + 1) // 2`` words, so any window holds
one whole block. Blocks are the index, every rolling stretch of block length is a probe, and a stretch that meets a block
elsewhere is an anchor. Around anchors, and only there, whole windows are compared by 96 bits, made of two independent digests of
each word, against the least id that has them; overlapping repeated windows join to maximal exact repeats, whose words are removed.

Documents are dealt to chunks, keys to shards by hash range. A chunk sends each distinct key once, so a passage that a third of
all documents share is no hot spot: a shard gets it once a chunk. Anchor keys are short, as a false anchor only costs a comparison.

Nulls: a null text has no words. Texts shorter than a window: kept. Very long texts: whole. Missing ids stand after all others;
rows with equal ids (or both missing) take nothing from each other, and a document takes nothing from itself. Empty table: empty
result. Further columns are ignored by ``find_repeats`` and kept by ``remove_repeats``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, bits_for, chunked, ids_of, lean, pack, rolling, shard_bounds, shards_for, squeeze, unpack, unsqueeze

WINDOW = 13


class Passages:
    """Words of a chunk's texts with their anchors' keys and their windows."""

    def __init__(self, texts, window: int, bits: int):
        self.window, self.block = window, (window + 1) // 2
        self.words = w = Words(list(texts), wide=True)
        self.probe = rolling(w.hash, self.block) >> np.uint64(64 - bits)
        n = len(self.probe)
        self.whole = w.doc[:n] == w.doc[self.block - 1 : self.block - 1 + n]  # within one text
        self.is_block = self.whole & ((np.arange(n) - w.first[w.doc[:n]]) % self.block == 0)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys in order; of each, 1 if a reference block has it, plus 2 if it stands here more than once."""
        both = np.sort(self.probe[self.whole] << np.uint64(1) | self.is_block[self.whole].astype(np.uint64))
        key = both >> np.uint64(1)
        at = np.flatnonzero(np.diff(key, prepend=~key[:1]))
        if not len(at):
            return at.astype(np.uint64), at.astype(np.uint8)
        several = np.diff(np.append(at, len(key))) > 1
        return key[at], np.maximum.reduceat(both & np.uint64(1), at).astype(np.uint8) + 2 * several.astype(np.uint8)

    def near(self, anchors: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold a stretch whose key is among ``anchors``."""
        m = len(self.words.hash) - self.window + 1
        if m <= 0 or not len(anchors):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(anchors, self.probe), len(anchors) - 1)
        hits = np.concatenate([[0], np.cumsum((anchors[at] == self.probe) & self.whole)])
        reach = self.window - self.block + 1
        return np.flatnonzero((hits[reach : reach + m] > hits[:m]) & self.fits())

    def fits(self) -> np.ndarray:
        m = len(self.words.hash) - self.window + 1
        return self.words.doc[:m] == self.words.doc[self.window - 1 :] if m > 0 else np.zeros(0, bool)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each window, of 64 and 32 bits, from different digests of its words."""
        return rolling(self.words.hash, self.window, 1), (rolling(self.words.other, self.window, 2) >> np.uint64(32)).astype(np.uint32)


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where each run of equal rows begins, in sorted rows."""
    new = np.ones(len(keys[0]), bool)
    if len(new) > 1:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


#: Columns of the messages from chunks to shards.
PROBES = {"chunk": "int", "shard": "int", "keys": "binary", "marks": "binary"}
WINDOWS = {"chunk": "int", "shard": "int", "first": "binary", "second": "binary", "least": "binary", "most": "binary"}


def ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in columns.items())


def arrow(values: list, columns: dict[str, str]):
    """An Arrow table of these columns."""
    import pyarrow as pa

    kinds = {"int": pa.int32(), "binary": pa.binary()}
    return pa.table({name: pa.array(v, kinds[kind]) for (name, kind), v in zip(columns.items(), values)})


def _scan(docs: DataFrame, window: int):
    """The chunks of documents, and what the windows around their anchors share: chunk, first, second, least (packed arrays)."""
    dealt, chars = chunked(docs)
    bits, shards = bits_for(chars // 6), shards_for(chars)

    def probe(key, table):
        keys, marks = Passages(table["text"].to_pylist(), window, bits).keys()
        at = shard_bounds(keys, bits, shards)
        full = np.flatnonzero(np.diff(at))
        part = [slice(at[k], at[k + 1]) for k in full]
        return arrow([[key[0].as_py()] * len(full), full, [pack(keys[x]) for x in part], [squeeze(marks[x]) for x in part]], PROBES)

    def meet(key, frame):
        """Anchors: keys of a block that also stand elsewhere."""
        sent = [unpack(b) for b in frame["keys"]]
        keys, marks = np.concatenate(sent), np.concatenate([unsqueeze(b) for b in frame["marks"]]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, marks = keys[order], marks[order]
        at = runs(keys)
        anchors = keys[at][(np.bitwise_or.reduceat(marks & 1, at) > 0) & (np.add.reduceat(1 + (marks >> 1), at) > 1)]
        found = [k[np.isin(k, anchors, assume_unique=True)] for k in sent]
        return pd.DataFrame({"chunk": frame["chunk"], "anchors": [pack(k) for k in found]})[[len(k) > 0 for k in found]]

    def extend(left, right):
        p = Passages(left["text"].to_pylist(), window, bits)
        anchors = np.sort(np.concatenate([unpack(b) for b in right["anchors"].to_pylist()])) if len(right) else np.zeros(0, np.uint64)
        start = p.near(anchors)
        if not len(start):
            return arrow([[]] * len(WINDOWS), WINDOWS)
        one, two = (x[start] for x in p.windows())
        ids = ids_of(left["doc_id"].to_pylist())[p.words.doc[start]]
        order = np.lexsort((ids, two, one))
        one, two, ids = one[order], two[order], ids[order]
        at = runs(one, two)
        least, most = ids[at], ids[np.append(at[1:], len(ids)) - 1]
        one, two = one[at], two[at]
        limit = shard_bounds(one, 64, shards)
        full = np.flatnonzero(np.diff(limit))
        part = [slice(limit[k], limit[k + 1]) for k in full]
        chunk = [left["chunk"][0].as_py()] * len(full)
        low = [squeeze(least[s].view(np.uint64)) for s in part]
        span = [squeeze((most[s] - least[s]).view(np.uint64)) for s in part]
        return arrow([chunk, full, [pack(one[s]) for s in part], [two[s].tobytes() for s in part], low, span], WINDOWS)

    def judge(key, frame):
        """The windows of each chunk that stand in a document with a smaller id than one of the chunk's."""
        first, second = [unpack(b) for b in frame["first"]], [np.frombuffer(b, np.uint32) for b in frame["second"]]
        least = [unsqueeze(b).view(np.int64) for b in frame["least"]]
        most = [a + unsqueeze(b).view(np.int64) for a, b in zip(least, frame["most"])]
        one, two, ids = np.concatenate(first), np.concatenate(second), np.concatenate(least)
        order = np.lexsort((ids, two, one))
        at = runs(one[order], two[order])
        lowest = np.empty_like(ids)
        lowest[order] = np.repeat(ids[order][at], np.diff(np.append(at, len(ids))))
        rows, k = [], 0
        for chunk, a, b, m in zip(frame["chunk"], first, second, most):
            low = lowest[k : k + len(a)]
            k += len(a)
            if (keep := low < m).any():
                rows.append((chunk, pack(a[keep]), b[keep].tobytes(), squeeze(low[keep].view(np.uint64))))
        return pd.DataFrame(rows, columns=["chunk", "first", "second", "least"])

    asked = dealt.groupBy("chunk").applyInArrow(lean(probe), ddl(PROBES))
    anchors = asked.groupBy("shard").applyInPandas(lean(meet), "chunk int, anchors binary")
    near = dealt.groupBy("chunk").cogroup(anchors.groupBy("chunk")).applyInArrow(lean(extend), ddl(WINDOWS))
    return dealt, near.groupBy("shard").applyInPandas(lean(judge), "chunk int, first binary, second binary, least binary")


def removed_words(texts: list, doc_ids: list, right: pd.DataFrame, window: int) -> tuple[Words, np.ndarray]:
    """The words of a chunk's texts, and which of them repeated windows cover."""
    p = Passages(texts, window, 62)
    w = p.words
    gone = np.zeros(len(w.hash) + 1, np.int64)
    if len(right):
        a = np.concatenate([unpack(x) for x in right["first"]])
        b = np.concatenate([np.frombuffer(x, np.uint32) for x in right["second"]])
        low = np.concatenate([unsqueeze(x).view(np.int64) for x in right["least"]])
        order = np.lexsort((b, a))
        a, b, low = a[order], b[order], low[order]
        one, two = p.windows()
        at = np.searchsorted(a, one)
        ids = ids_of(doc_ids)[w.doc[: len(one)]]
        hit = np.zeros(len(one), bool)
        for step in range(int(np.max(np.diff(np.append(runs(a), len(a)))))):  # windows that share their first hash; almost always one
            k = np.minimum(at + step, len(a) - 1)
            hit |= (a[k] == one) & (b[k] == two) & (low[k] < ids)
        start = np.flatnonzero(hit & p.fits())
        np.add.at(gone, start, 1)
        np.subtract.at(gone, start + window, 1)
    return w, np.cumsum(gone[:-1]) > 0


def kept_texts(w: Words, gone: np.ndarray) -> list[bytes]:
    """Of each text the words that stay, joined by one space."""
    buf = np.frombuffer(w.data, np.uint8).copy()
    buf[w.end] = 0x20
    start, end = w.start[~gone], w.end[~gone] + 1
    mark = np.zeros(len(buf) + 1, np.int8)
    mark[start] += 1
    mark[end] -= 1
    data = buf[np.cumsum(mark[:-1], dtype=np.int8) > 0].tobytes()
    limits = np.concatenate([[0], np.cumsum(np.bincount(w.doc[~gone], (end - start).astype(np.float64), len(w.first) - 1).astype(np.int64))]).tolist()
    return [data[a : b - 1] if b > a else b"" for a, b in zip(limits[:-1], limits[1:])]


def _rows(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def find_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row."""
    dealt, shared = _scan(_rows(docs), window)

    def finish(left, right):
        w, gone = removed_words(left["text"].tolist(), left["doc_id"].tolist(), right, window)
        n = np.diff(w.first)
        lost = np.bincount(w.doc[gone], minlength=len(n))
        return pd.DataFrame({"doc_id": left["doc_id"], "n_words": n, "n_removed": lost, "kept_sha256": [hashlib.sha256(t).hexdigest() for t in kept_texts(w, gone)]})

    out = dealt.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInPandas(lean(finish), "doc_id string, n_words long, n_removed long, kept_sha256 string")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows with their repeated words removed from ``text``; texts without repeats stay as they are, and texts of which nothing stays go.

    All other columns are carried along unchanged, in their own types; ``n_chars``, if there is one, is counted anew.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    # they travel as one value, so that none of their names can clash, and as Arrow, so that no type is changed
    carried = F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)])
    rows = _rows(docs, carried.alias("others"))
    dealt, shared = _scan(rows, window)

    def finish(left, right):
        import pyarrow as pa

        texts = left["text"].to_pylist()
        w, gone = removed_words(texts, left["doc_id"].to_pylist(), right.to_pandas(), window)
        lost = np.bincount(w.doc[gone], minlength=len(texts)) > 0
        cleaned = kept_texts(w, gone)
        text = [b.decode("utf-8", "surrogatepass") if cut else t for t, b, cut in zip(texts, cleaned, lost)]
        stays = ~lost | np.array([len(b) > 0 for b in cleaned], bool)
        out = left.select(["doc_id", "text", "others"])
        out = out.set_column(1, "text", pa.array(text, out.schema.field("text").type))
        return out.filter(pa.array(stays))

    kinds = {f.name: f.dataType for f in docs.schema}
    names = ["doc_id", "text", "others"]
    schema = T.StructType([T.StructField(c, rows.schema[c].dataType) for c in names])
    out = dealt.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(lean(finish), schema)
    cols = {"doc_id": F.col("doc_id").cast(kinds["doc_id"]), "text": F.col("text").cast(kinds["text"])}
    cols |= {c: F.col(f"others.c{k}") for k, c in enumerate(others)}
    if "n_chars" in cols:
        cols["n_chars"] = F.length("text").cast(kinds["n_chars"])
    return out.select(*[cols[c].alias(c) for c in docs.columns])
