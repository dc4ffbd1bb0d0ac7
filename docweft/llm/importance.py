"""Importance resampling towards a target corpus, by hashed n-gram features.

A text is read as the bytes of its Arrow UTF-8 buffer, all rows of a batch at once, by a byte automaton: a table of 256 entries
folds A-Z and another one classifies each byte; where the class changes from one byte to the next, or a row begins, a word begins
or ends. A table-driven CRC-32 then advances over all words at the same time, byte k of each word in step k; words are in order
of falling length, so those still being read are a prefix. What is left of words beyond STEPS bytes is finished one by one. A run of n
words goes on from the state after n - 1 of them, by a space and the next word.

A feature is a run of 1 to ``n`` words; its bucket is its CRC-32 modulo ``buckets``. Each task adds up its buckets, so at most
``buckets`` rows a task are shuffled. A bucket's gain is floor(1000 * ln of the ratio of its smoothed shares), target over raw;
the gains (``buckets`` numbers, whatever the input) go to all tasks, which read the texts again and add up each document's.

The draw is without replacement by Gumbel keys: log weight plus -1000 ln(-ln u), u from the id's SHA-256, the highest tenth of
the documents long enough. Rows are dealt to ranges of the key, ranges are numbered where the one before ends, and only the
ranges that are drawn from are sorted: no task sorts more than a range.

Nulls: a null text has no words; a null source id gets u from "<seed>:" and comes last among ties. Empty texts: 0 features,
weight 0, never drawn if ``least`` > 0. Very long texts: whole. Ties: the smaller id, then the greater weight and the more features;
rows that are equal in all share what their places give, and spread over ranges. Empty documents: empty result; empty target:
gains fall with a bucket's count alone. Further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, only, partitions, release

BUCKETS = 10_000
#: Bytes of a word that all words advance over together.
STEPS = 48
#: Characters that are read at once, and rows of a range.
CHARS, RANGE_ROWS = 4_000_000, 500_000

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[65:91] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> 1), table >> 1)
    return table


_CRC = _crc_table()


class Words:
    """The words of the strings of an Arrow array: ``start`` and ``size`` in ``low``, the folded bytes; ``first`` word of each row, one place more."""

    def __init__(self, texts: pa.Array):
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        limits = np.frombuffer(texts.buffers()[1], kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[limits[0] : limits[-1]]
        limits -= limits[0]
        self.low = _FOLD[raw]
        word = _IN_WORD[raw]
        fresh = np.zeros(len(raw) + 1, bool)  # a row begins here
        fresh[limits] = True
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1] | fresh[1:-1]
        ends[:-1] &= ~word[1:] | fresh[1:-1]
        self.start = np.flatnonzero(begins)
        self.size = np.flatnonzero(ends) + 1 - self.start
        self.first = np.searchsorted(self.start, limits)

    def advance(self, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        """CRC states after the bytes of these words, each from its own state."""
        order = np.argsort(-self.size[words], kind="stable")
        start, size = self.start[words][order], self.size[words][order]
        out = states[order]
        still = np.searchsorted(-size, -np.arange(1, min(STEPS, int(size[0]) if len(size) else 0) + 1), "right")  # words of more than k bytes
        for k, n in enumerate(still.tolist()):
            out[:n] = _CRC[(out[:n] ^ self.low[start[:n] + k]) & 255] ^ (out[:n] >> 8)
        for j in range(int(np.searchsorted(-size, -STEPS, "left"))):
            rest = self.low[start[j] + STEPS : start[j] + size[j]].tobytes()
            out[j] = zlib.crc32(rest, int(out[j]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
        back = np.empty_like(out)
        back[order] = out
        return back

    def features(self, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 1 to n: the words at which a run of so many words begins, and the CRCs of the runs."""
        last = np.repeat(self.first[1:], np.diff(self.first))  # the end of each word's row
        at = np.arange(len(self.start))
        states = np.full(len(at), 0xFFFFFFFF, np.uint32)
        for k in range(n):
            if k:
                more = at + k < last[at]
                at, states = at[more], states[more]
                states = _CRC[(states ^ 32) & 255] ^ (states >> 8)
            states = self.advance(states, at + k)
            yield at, states ^ np.uint32(0xFFFFFFFF)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In runs of about CHARS bytes of text, null texts as empty ones."""
    for batch in batches:
        texts = batch.column("text").fill_null("")
        batch = batch.set_column(batch.schema.get_field_index("text"), "text", texts)
        run = np.cumsum(np.asarray(pc.binary_length(texts), np.int64)) // CHARS
        limits = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(run)]
        for a, b in zip(limits[:-1], limits[1:]):
            if b > a:
                yield batch.slice(a, b - a)
        release()


def bucket_counts(docs: DataFrame, n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """bucket, count of the features in all texts of ``docs``."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in _batches(batches):
            for _, crc in Words(batch.column("text")).features(n):
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    parts = only(docs, text="string").mapInArrow(run, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("count"))


def gains(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain for each of the buckets: floor(1000 * ln((t + 1)(S + buckets) / ((s + 1)(T + buckets))))."""
    counts = bucket_counts(docs, n, buckets).withColumnRenamed("count", "s").join(bucket_counts(target, n, buckets).withColumnRenamed("count", "t"), "bucket", "full")
    every = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(counts, "bucket", "left").fillna(0, ["s", "t"])
    total = lambda c: F.sum(c).over(Window.partitionBy(F.lit(0))).cast("double")  # noqa: E731  of a fixed number of rows
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = ((t + 1) * (total("s") + buckets)) / ((s + 1) * (total("t") + buckets))
    return every.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weigh(docs: DataFrame, gain: np.ndarray, n: int = 1) -> DataFrame:
    """doc_id, n_words, n_features, weight of each row of ``docs``; ``gain`` by bucket."""

    def run(batches):
        for batch in _batches(batches):
            words = Words(batch.column("text"))
            number, weight = np.zeros(len(words.first) - 1, np.int64), np.zeros(len(words.first) - 1, np.int64)
            for at, crc in words.features(n):
                sums = np.concatenate([[0], np.cumsum(gain[crc % np.uint32(len(gain))])])
                limits = np.searchsorted(at, words.first)
                number += np.diff(limits)
                weight += np.diff(sums[limits])
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.diff(words.first)), pa.array(number), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of SHA-256 of ``seed:doc_id``."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS, percent: int = 10, least: int = 20, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row of ``docs``: of the N with at least ``least`` words, percent * N / 100 are drawn.

    ``docs``: doc_id, text. ``target``: text. Ranks are 1, 2, 3, ... by falling score; rows that are not drawn have none.
    """
    gain = np.zeros(buckets, np.int64)
    for row in gains(docs, target, n, buckets).collect():  # one number a bucket
        gain[row.bucket] = row.gain
    scored = cut(weigh(docs, gain, n).withColumns({"score": F.col("weight") + gumbel(F.col("doc_id"), seed), "tie": F.monotonically_increasing_id()}))
    enough = F.col("n_words") >= least
    total = scored.filter(enough).count()
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").desc(), F.col("n_features").desc(), F.col("tie").asc()]
    ranges = max(partitions(docs.sparkSession), math.ceil(total / RANGE_ROWS))
    dealt = cut(scored.filter(enough).repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()))
    line = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = dealt.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(line), F.lit(0)).alias("before"))
    draws = percent * total // 100
    placed = dealt.join(F.broadcast(before), "range")
    place = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(*order))
    columns = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    drawn = placed.filter(F.col("before") < draws).withColumn("rank", place.cast("long")).select(*columns, F.when(F.col("rank") <= draws, F.col("rank")).alias("rank"))
    return drawn.unionByName(placed.filter(F.col("before") >= draws).select(*columns, none)).unionByName(scored.filter(~enough).select(*columns, none))
