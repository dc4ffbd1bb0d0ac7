"""Canonical exact digests of documents, in DataFrame functions only.

A text is normalised (compatibility composition), case-folded, normalised again, and its white space is folded: runs become one
space and the ends are trimmed. Two chained 64-bit xxhash values of the UTF-8 bytes make a digest of 128 bits. Documents meet by
digest, and within equal digests the bytes are compared: distinct canonical texts of one digest get different ordinals.

Documents are put in order by ranges of (id, hash of the text, a random number): rows of one id, or without one, spread over
ranges, and so do repeated rows, which are alike in content and so in result whichever comes first. A range holds ``bucket_rows``
rows, and more in a table that would have more than RANGES of them.

Normalisation and case folding are those of ICU, called by ``java_method`` in the JVM; its classes (com.ibm.icu) come with Spark.

Nulls: a null text counts as empty. Empty text: digest of the empty string. Very long texts: whole. Repeated rows and equal ids:
each row is a document. Null ids: ordered last. Empty table: empty result. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions

#: Bits of the filter that spares texts without a twin the exchange; it has a fixed size (2 MB) for any number of documents.
FILTER_BITS = 1 << 24
BITMAP_BITS = 8 * 4096
#: Ranges of documents at most: their limits and first ids are in the plan, so there is a bound for them.
RANGES = 32_768
#: Rows a range by which its limits are found; they decide on balance only.
PER_RANGE = 8


def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC, white space folded; null stays null. ICU, which Spark brings along, does the work in the JVM."""
    java = lambda *args: F.call_function("java_method", *[F.lit(a) if isinstance(a, (str, bool)) else a for a in args])
    nfkc = lambda c: java("com.ibm.icu.text.Normalizer", "compose", c, True)
    folded = nfkc(java("com.ibm.icu.lang.UCharacter", "foldCase", nfkc(text), True))
    return F.btrim(F.regexp_replace(folded, r"[\s\u0085\p{Z}]+", " "))


def digest(canon: Column) -> Column:
    """128 bits of xxhash in hex."""
    wide = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return F.concat(wide(F.xxhash64(canon)), wide(F.xxhash64(F.lit("docweft"), canon)))


def keyed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """digest, canon of each row."""
    return docs.select(canonical(F.coalesce(F.col(text_col), F.lit(""))).alias("canon")).withColumn("digest", digest(F.col("canon")))


def collisions(keyed: DataFrame, digests: DataFrame | None = None) -> DataFrame:
    """Canonical texts (digest, canon) that share a digest with another one: digest, canon, ordinal (0 for the least). Empty unless 128 bits collide.

    Only digests that occur twice can hold two texts. Their positions in a bitmap of fixed size, broadcast in 4 kB pieces, keep
    the other texts from being shuffled; the pieces' number is bounded by FILTER_BITS, whatever the input. ``digests`` are the
    digests of all rows, where they are there already.
    """
    slot = F.pmod(F.xxhash64("digest"), F.lit(FILTER_BITS))
    twice = (keyed if digests is None else digests).select("digest").groupBy("digest").count().filter("count > 1").select(slot.alias("slot"))
    bitmap = twice.groupBy(F.floor(F.col("slot") / BITMAP_BITS).cast("int").alias("piece")).agg(F.bitmap_construct_agg(F.col("slot") % BITMAP_BITS).alias("bits"))
    at = (F.col("slot") % BITMAP_BITS).cast("int")
    byte = F.conv(F.hex(F.col("bits").substr(F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    kept = (
        keyed.withColumn("slot", slot)
        .withColumn("piece", F.floor(F.col("slot") / BITMAP_BITS).cast("int"))
        .join(F.broadcast(bitmap), "piece")
        .filter(F.call_function("shiftright", byte, at % 8).bitwiseAND(F.lit(1)) == 1)
        .select("digest", "canon")
    )
    texts = kept.distinct()  # by bytes; copies meet before they are shuffled
    several = texts.groupBy("digest").count().filter("count > 1").select("digest")
    return texts.join(several, "digest").withColumn("ordinal", F.row_number().over(Window.partitionBy("digest").orderBy("canon")) - 1)


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with ``fingerprint``: equal for canonically equal texts, and by byte comparison for no others."""
    clash = cut(collisions(keyed(docs, text_col)))
    own = canonical(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.struct("*").alias("row"), own.alias("own")).withColumn("own_digest", digest(F.col("own")))
    out = _with_ordinal(rows, clash, "own_digest", "own", "fingerprint")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "fingerprint"], "fingerprint")


def _with_ordinal(df: DataFrame, clash: DataFrame, digest_col: str, canon_col: str, out: str) -> DataFrame:
    """Append the ordinal of the text within its digest; without collisions there is nothing to join."""
    if clash.isEmpty():
        return df.withColumn(out, F.concat(digest_col, F.lit("-0")))
    c = clash.select(F.col("digest").alias("_d"), F.col("canon").alias("_c"), "ordinal")
    joined = df.join(c, (F.col(digest_col) == F.col("_d")) & (F.col(canon_col) == F.col("_c")), "left")
    return joined.withColumn(out, F.concat_ws("-", digest_col, F.coalesce("ordinal", F.lit(0)).cast("string"))).drop("_d", "_c", "ordinal")


def _sortable(x: Column) -> Column:
    """A long as 16 characters of the same order."""
    return F.lpad(F.hex(x.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")


def _range_of(place: Column, limits: list[str]) -> Column:
    """How many of the sorted limits are not above ``place``, by halving."""
    if not limits:
        return F.lit(0)
    table = F.split(F.lit(",".join(limits)), ",")

    def halve(span, _):
        middle = F.floor((span["low"] + span["high"]) / 2).cast("int")
        below = F.get(table, middle) <= place
        return F.when(span["low"] >= span["high"], span).when(below, F.struct((middle + 1).alias("low"), span["high"].alias("high"))).otherwise(F.struct(span["low"].alias("low"), middle.alias("high")))

    steps = F.array(*[F.lit(0)] * len(limits).bit_length())
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(len(limits)).alias("high")), halve, lambda span: span["low"])


def successors(docs: DataFrame, column: str, ranges: int) -> DataFrame:
    """Append ``next_<column>``: the text of the next row by descending id (nulls last), after the last row that of the first.

    The first row of each range is put behind the last one of the range before as well, so each range finds all successors of
    its rows by itself, and texts are shuffled once.
    """
    rows = docs.withColumn("tie", F.xxhash64(column)).withColumn("salt", F.floor(F.rand(17) * 65536).cast("int"))
    # as text that sorts like the rows: ids, then the text's hash, then the salt
    front = F.concat(F.col("doc_id").isNull().cast("int").cast("string"), _sortable(F.bitwise_not(F.coalesce("doc_id", F.lit(0)))), _sortable(F.col("tie")))
    rows = rows.withColumn("front", front).withColumn("place", F.concat("front", F.lpad(F.hex("salt"), 4, "0")))
    step = max(1, docs.select("doc_id").count() // (PER_RANGE * ranges))
    seen = sorted(r.place for r in rows.select("place").filter(F.pmod(F.xxhash64("place"), F.lit(step)) == 0).collect())
    limits = sorted({seen[len(seen) * k // ranges] for k in range(1, ranges)} if seen else ())
    rows = rows.withColumn("range", _range_of(F.col("place"), limits))
    heads = rows.groupBy("range").agg(F.min("front").alias("head"))
    line = Window.partitionBy(F.lit(0)).orderBy("range")  # one row a range
    last = F.max("range").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select(F.col("range").alias("of"), "head", F.lag("range").over(line).alias("before"), last.alias("last"))
    heads = F.broadcast(heads.select("of", "head", F.coalesce("before", "last").alias("into"), F.col("before").isNull().alias("wraps")))
    copies = rows.join(heads, (F.col("range") == F.col("of")) & (F.col("front") == F.col("head")))
    # rows that are alike throughout can't be told apart, and one of them is enough
    copies = copies.groupBy("into", "wraps").agg(F.first(F.struct("doc_id", column, "tie", "salt")).alias("row"))
    copies = copies.select("row.*", F.col("into").alias("range"), F.when(F.col("wraps"), 2).otherwise(1).alias("extra"))
    both = rows.select("doc_id", column, "tie", "salt", "range", F.lit(0).alias("extra")).unionByName(copies).repartition(ranges, "range")
    order = Window.partitionBy("range").orderBy("extra", F.col("doc_id").desc_nulls_last(), "tie", "salt")
    return both.withColumn(f"next_{column}", F.lead(column).over(order)).filter("extra = 0").drop("extra", "range", "tie", "salt")


def edited_fingerprints(docs: DataFrame, bucket_rows: int = 20_000) -> DataFrame:
    """Fingerprint each text and its edited text: the last half replaced by the start of the next document.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. An exact digest knows
    equal and unequal only, so the likenesses are 1 or 0; they are those of the canonical texts, byte by byte.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = rows.select("doc_id").count()
    paired = successors(rows, "text", min(RANGES, max(partitions(docs.sparkSession), -(-n // bucket_rows))))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.left(F.col("text"), F.length("text") - half), F.left(F.coalesce("next_text", F.lit("")), half))
    out = paired.withColumns({"n_chars": F.length("text").cast("long"), "edited": edited})
    forms = [canonical(F.coalesce(F.col(c), F.lit(""))).alias(f"c{k}") for k, c in enumerate(("text", "edited", "next_text"))]
    out = out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *forms)
    out = out.withColumns({"d0": digest(F.col("c0")), "d1": digest(F.col("c1"))})
    out = out.withColumns({"near_edited": (F.col("c0") == F.col("c1")).cast("double"), "near_next": (F.col("c0") == F.col("c2")).cast("double")}).drop("c2")
    kept = cut(out.drop("c0"), "zstd")
    digests = kept.select(F.col("d0").alias("digest")).unionByName(kept.select(F.col("d1").alias("digest")))
    clash = cut(collisions(keyed(rows).unionByName(kept.select(F.col("c1").alias("canon"), F.col("d1").alias("digest"))), digests))
    if clash.isEmpty():
        done = kept.withColumns({"fingerprint": F.concat("d0", F.lit("-0")), "edited_fingerprint": F.concat("d1", F.lit("-0"))})
    else:
        done = _with_ordinal(_with_ordinal(out, clash, "d0", "c0", "fingerprint"), clash, "d1", "c1", "edited_fingerprint")
    return done.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
