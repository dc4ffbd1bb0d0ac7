"""Small documents with every odd case: nulls, empty and long texts, ties, repeated rows, and columns named like the operators' own."""

from __future__ import annotations

import random
import re

from pyspark.sql import types as T

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *[T.StructField(c, T.StringType()) for c in ("chunk", "score", "node", "rank", "size", "target", "range", "extra", "path", "copies", "_gone", "row", "tie", "digest")],
])


def texts(seed: int = 1, n: int = 60) -> list[str | None]:
    rng = random.Random(seed)
    words = [a + b + c for a in ("ka", "lo", "mi", "Ru") for b in ("ta", "ne", "sö", "") for c in ("s", "n.", "x", "r,")]
    some = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = some(40)
    base = [some(rng.randint(1, 120)) for _ in range(n)]
    out: list[str | None] = list(base)
    out += [base[0], base[0], base[1].upper(), base[2] + "  "]  # copies and nearly
    long = some(300).split(" ")
    for k in range(5):  # near copies
        w = list(long)
        w[10 * k] = "changed"
        out.append(" ".join(w))
    out += [f"{some(20)} {shared}\n{some(15)}" for _ in range(4)]  # a shared passage
    out += [None, "", " \t\n", "one", "x" * 5000, some(9000), "İstanbul ﬁne Å", "i̇stanbul fine Å", "a b c d e f g h i j k l m a b c d e f g h i j k l m"]
    return out


def rows(seed: int = 1, n: int = 60) -> list[tuple]:
    odd = ("c",) * 14
    out = [(k, t, "en" if k % 3 else None, [f"s{k % 4}", "s0", None][0 if k % 5 else 1 + k % 2], len(t or ""), *odd) for k, t in enumerate(texts(seed, n))]
    return out


def documents(spark, seed: int = 1, n: int = 60, unique: bool = False):
    """With repeated rows, equal ids and missing ids, unless ``unique``."""
    r = rows(seed, n)
    if not unique:
        r += [r[3], r[3], (7, "another text with an id that is taken", None, None, None, *[None] * 14), (None, "no id at all here", "en", "s1", 3, *r[0][5:]), (None, None, None, None, None, *[None] * 14)]
    return spark.createDataFrame(r, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall(t or "")
