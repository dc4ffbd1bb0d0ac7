"""Helpers that the training-data operators share.

* the shared folder that all executors see, and tables cut there;
* vectorised word hashing over whole batches of texts;
* packed key messages for the chunk <-> shard exchanges of the language model and the repeat finder.
"""

from __future__ import annotations

import contextlib
import math
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as all operators count it.
WORD = r"[^\x20\x09-\x0D]+"
MASK = (1 << 64) - 1


# ---------------------------------------------------------------- tables and settings


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or where it is unset and all is on one machine, a folder of this session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = getattr(spark, "_docweft_dir", None)
        if found is None:
            found = spark._docweft_dir = "file://" + tempfile.mkdtemp(prefix="docweft-")
    return found.rstrip("/")


def cut(df: DataFrame, compression: str = "none") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docweft/{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._docweft_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a table that ``cut`` wrote and that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._docweft_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns of ``df`` under names of our own, so that further columns can't clash: ``only(docs, doc_id="long")``."""
    return df.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in columns.items()])


def held_out(doc_id, remainder: int):
    """crc32 of the id as text, modulo 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == remainder, F.lit(False))


# ---------------------------------------------------------------- words

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes: each bit of the input reaches all bits of the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of many texts: ``hash`` of each word (64 bits of xxh3), its byte range in ``data``, and ``first`` word of each text.

    ``first`` has one place more than there are texts. With ``wide``, ``other`` has 64 further bits of each word's digest.
    """

    def __init__(self, texts: list[str | None], lower: bool = False, wide: bool = False):
        import xxhash

        raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        self.data = b" ".join(raw) + b" "
        buf = np.frombuffer(self.data, np.uint8)
        space = _SPACE[buf]
        edge = np.empty(len(buf), bool)
        edge[0] = not space[0]
        np.not_equal(space[1:], space[:-1], out=edge[1:])
        at = np.flatnonzero(edge)
        self.start, self.end = at[::2], at[1::2]
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
        self.first = np.concatenate([[0], np.searchsorted(self.start, ends)])
        self.doc = np.repeat(np.arange(len(raw)), np.diff(self.first))
        parts = (self.data.lower() if lower else self.data).split()  # the same words: bytes are split at the same characters
        if wide:
            both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, parts)), ">u8").reshape(-1, 2).astype(np.uint64)
            self.hash, self.other = np.ascontiguousarray(both[:, 1]), np.ascontiguousarray(both[:, 0])
        else:
            self.hash = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))


def rolling(hashes: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of ``hashes[i:i+width]`` for each i at which it fits."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - width + 1, np.uint64)
    base = np.uint64((0xD6E8FEB86659FD93 * (2 * seed + 1)) & MASK | 3)
    for k in range(width):
        out *= base
        out += hashes[k : len(hashes) - width + 1 + k]
    return mix(out)


def batches(frames, most: int = 2_000_000):
    """Rows of pandas frames again, in runs of about so many characters of text, so that what is made of them stays small."""
    for frame in frames:
        run = (frame["text"].str.len().fillna(0).cumsum() // most).to_numpy()
        limits = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(frame)]
        for a, b in zip(limits[:-1], limits[1:]):
            if b > a:
                yield frame.iloc[a:b]
        release()


def release() -> None:
    """Give freed memory back: a Python worker lives on beside the next stage's, and would keep its peak."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def lean(function):
    """A function of two arguments that gives back its memory when it is done."""

    def run(a, b):
        try:
            return function(a, b)
        finally:
            release()

    return run


# ---------------------------------------------------------------- packed keys


def pack(keys: np.ndarray) -> bytes:
    """Sorted distinct unsigned keys: their number, the first one, then differences byte by byte, of which the high ones compress well."""
    import zstandard

    if not len(keys):
        return b""
    gaps = np.diff(keys)
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    planes = np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    low = max(1, width - 2)  # lower bytes are noise
    head = bytes([width]) + np.array([len(keys), keys[0]], "<u8").tobytes()
    return head + planes[:low].tobytes() + zstandard.ZstdCompressor(1).compress(planes[low:].tobytes())


def unpack(blob: bytes) -> np.ndarray:
    """The keys that ``pack`` was given."""
    import zstandard

    if not blob:
        return np.zeros(0, np.uint64)
    width = blob[0]
    n, first = np.frombuffer(blob, "<u8", 2, 1).tolist()
    low = max(1, width - 2)
    noise = np.frombuffer(blob, np.uint8, low * (n - 1), 17)
    rest = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[17 + low * (n - 1) :], max_output_size=max(1, (width - low) * (n - 1))), np.uint8)
    gaps = np.zeros((n, 8), np.uint8)
    gaps[1:, :low] = noise.reshape(low, n - 1).T
    gaps[1:, low:width] = rest.reshape(width - low, n - 1).T
    gaps = gaps.view("<u8").ravel()
    gaps[0] = first
    return np.cumsum(gaps, dtype=np.uint64)


def squeeze(values: np.ndarray) -> bytes:
    """Small unsigned numbers, compressed; mostly equal ones take next to nothing."""
    import zstandard

    kind = np.uint8 if not len(values) or values.max() < 256 else np.uint32 if values.max() < 1 << 32 else np.uint64
    return bytes([np.dtype(kind).itemsize]) + zstandard.ZstdCompressor(1).compress(values.astype(kind).tobytes())


def unsqueeze(blob: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), f"<u{blob[0]}").astype(np.uint64)


#: Tasks that chunks are dealt to: as many as there are chunks, up to so many.
MOST_TASKS = 50_000
#: Characters of text whose keys one shard adds up, on average.
SHARD_CHARS = 16_000_000


def shards_for(chars: int) -> int:
    """Number of shards; it follows the text, so that a shard's keys stay as many as they are.

    No more messages are sent than there are keys, as a chunk sends nothing to a shard of which it has no key.
    """
    return max(1, math.ceil(chars / SHARD_CHARS))


def shard_bounds(keys: np.ndarray, bits: int, shards: int) -> np.ndarray:
    """Where in sorted keys of so many bits each shard begins, and the end."""
    limits = [min((k << bits) // shards, MASK) for k in range(1, shards)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(limits, np.uint64)), [len(keys)]])


def bits_for(n_keys: int) -> int:
    """Key width at which one in some ten thousand foreign keys is taken for a member."""
    return min(62, max(40, math.ceil(math.log2(max(2, n_keys))) + 14))


def chunked(docs: DataFrame, chars_each: int = 6_000_000) -> tuple[DataFrame, int]:
    """doc_id (as text, null stays null), text and further named columns, dealt to chunks of whole documents; and the number of characters.

    Every user of the chunks names the same exchange, so Spark shuffles the texts once a query.
    """
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    chunks = max(partitions(spark), math.ceil(chars / chars_each))
    # by a hash of id, content and input partition: rows with equal or missing ids spread, and so do repeated rows
    mark = F.xxhash64("doc_id", F.length("text"), F.substring("text", 1, 64), F.spark_partition_id())
    chunk = F.pmod(mark, F.lit(chunks)).cast("int")
    return docs.withColumn("chunk", chunk).repartition(min(chunks, max(partitions(spark), MOST_TASKS)), "chunk"), chars


def ids_of(column) -> np.ndarray:
    """Ids that came as text, as numbers; a missing one stands after all others."""
    return np.array([np.iinfo(np.int64).max if x is None else int(x) for x in column], np.int64)
