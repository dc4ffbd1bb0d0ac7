"""Order-preserving packing of tokenised documents into windows.

The documents of a partition, in their order, form one stream of tokens. Windows of at most ``window`` tokens cut it where the
sum of padding and truncation penalties is least: a cut at a document's end is free, at a sentence's end costs ``SENTENCE``
tokens, and in a stretch without sentence ends, every ``STRIDE`` tokens, ``HARD``. With f(j) the least cost up to cut j at
token p(j), f(j) = min f(i) + p(i) over cuts i at most a window back, + window - p(j) + penalty; a monotone queue holds that
minimum, so the work is linear. A window whose length is a power of two needs no padding.

The stream is handled in runs of about RUN tokens; the last two windows of a run are planned again with the next one, so memory
is bounded, and a partition has one loose end. Nothing is shuffled; a lost task is read and packed again.

Nulls: a null text is empty; an empty document is its end token. Very long texts are cut like others. Repeated rows and equal
or missing ids: each row is a document. Empty table: empty result. Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, only

WINDOW = 2048
SENTENCE, HARD, STRIDE = 1, 12, 16
RUN = 1 << 19
END_ID = 1


def tokenizer(path: str, pattern: str):
    """The byte-level BPE whose ranks are in ``path``."""
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), ranks


def plan(cuts: np.ndarray, penalties: np.ndarray, exact: np.ndarray, window: int = WINDOW) -> tuple[list[int], float]:
    """Indices of the cuts that the best plan uses, from 0 to the last, and its cost. Neighbouring cuts are at most a window apart.

    ``exact`` marks the cuts at which windows of a power of two may end.
    """
    p, pen, ex = cuts.tolist(), penalties.tolist(), exact.tolist()
    f, back = [0.0] * len(p), [0] * len(p)
    queue: deque[int] = deque([0])
    where = {x: k for k, x in enumerate(p)}
    powers = [1 << k for k in range(window.bit_length())]
    for j in range(1, len(p)):
        here = p[j]
        while p[queue[0]] < here - window:
            queue.popleft()
        i = queue[0]
        best = f[i] + p[i] + window - here
        if ex[j]:
            for size in powers:
                k = where.get(here - size)
                if k is not None and f[k] < best:
                    best, i = f[k], k
        f[j] = best + pen[j]
        back[j] = i
        value = f[j] + here
        while queue and f[queue[-1]] + p[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    path, j = [len(p) - 1], len(p) - 1
    while j:
        j = back[j]
        path.append(j)
    return path[::-1], f[-1]


def candidate_cuts(doc_ends: np.ndarray, sentence_ends: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions at which a run may be cut, their penalties, and whether a power of two may end there."""
    total = int(doc_ends[-1])
    natural = np.union1d(np.concatenate([[0], doc_ends]), sentence_ends)
    gaps = np.diff(natural)
    long = np.flatnonzero(gaps > 2 * STRIDE)
    more = [natural[k] + np.arange(STRIDE, gaps[k] - STRIDE // 2, STRIDE) for k in long]
    if last:  # so that the loose end can be made of powers of two
        more.append(total - np.arange(STRIDE, min(total, WINDOW + 1), STRIDE))
    cuts = np.union1d(natural, np.concatenate(more)) if more else natural
    at_doc = np.isin(cuts, doc_ends)
    penalties = np.where(at_doc, 0, np.where(np.isin(cuts, natural), SENTENCE, HARD)).astype(float)
    penalties[0] = 0
    return cuts, penalties, at_doc | (last & (cuts > total - WINDOW - 1))


def pack_stream(docs, n_first: int = 0, window: int = WINDOW):
    """Pieces of documents from (doc_id, ids, ends-of-sentences mask), as (doc_id, start, ids, doc_tokens, n_window, offset)."""
    held: list[list] = []  # doc_id, ids, mask, tokens packed before
    size, n = 0, n_first

    def flush(last: bool):
        nonlocal held, size, n
        ids = np.concatenate([d[1][d[3] :] for d in held])
        ends = np.cumsum([len(d[1]) - d[3] for d in held])
        marks = np.flatnonzero(np.concatenate([d[2][d[3] :] for d in held])) + 1
        cuts, penalties, exact = candidate_cuts(ends, marks, last)
        path, _ = plan(cuts, penalties, exact, window)
        limits = cuts[path if last else path[: max(1, len(path) - 2)]]
        stop = limits[-1]
        starts = ends - np.diff(ends, prepend=0)
        edges = np.union1d(limits, np.append(starts[starts < stop], stop)) if stop else np.zeros(1, np.int64)
        doc = np.searchsorted(ends, edges[:-1], "right")
        win = np.searchsorted(limits, edges[:-1], "right") - 1
        for a, b, d, w in zip(edges[:-1].tolist(), edges[1:].tolist(), doc.tolist(), win.tolist()):
            name, whole, _, done = held[d]
            yield name, a - int(starts[d]) + done, ids[a:b], len(whole), n + w, a - int(limits[w])
        n += len(limits) - 1
        rest = int(np.searchsorted(ends, stop, "right"))
        if rest < len(held):
            held[rest][3] += int(stop - starts[rest])
        held = held[rest:]
        size -= int(stop)

    for name, ids, mask in docs:
        held.append([name, ids, mask, 0])
        size += len(ids)
        if size > RUN:
            yield from flush(False)
    if held:
        yield from flush(True)


def crc32(ids: np.ndarray) -> int:
    """Of the ids as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def pack_documents(docs: DataFrame, ranks_path: str, pattern: str, digest=None, digest_type: str = "array<int>") -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset for each piece.

    ``digest`` turns a piece's ids into the value of column ``ids``, of type ``digest_type``; without it that is the ids.
    ``ranks_path`` is a file on each executor.
    """

    def run(frames):
        from pyspark import TaskContext

        coder, ranks = tokenizer(ranks_path, pattern)
        stops = np.zeros(max(ranks.values()) + 2, bool)
        for piece, k in ranks.items():
            stops[k] = piece[-1:] in (b".", b"!", b"?", b"\n")

        def tokenised():
            for frame in batches(frames, 1_000_000):
                for name, text in zip(frame["doc_id"], frame["text"]):
                    ids = np.array([*coder.encode_ordinary(text or ""), END_ID], np.uint32)
                    yield name, ids, stops[ids]

        first = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        for name, start, ids, whole, seq, offset in pack_stream(tokenised(), first):
            rows.append((name, start, len(ids), digest(ids) if digest else ids.astype(np.int32), whole, seq, offset))
            if len(rows) >= 1_000:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)

    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    out = only(docs, doc_id="string", text="string").mapInPandas(run, f"doc_id string, start long, length long, ids {digest_type}, doc_tokens long, sequence_id long, offset long")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
