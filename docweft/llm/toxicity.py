"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text.

Folding: compatibility normalisation, case folding, look-alike letters of other scripts and digits or signs in place of letters
become Latin letters, all else becomes one space. A term is a whole word or a stem (the begin of
a word). Its weight is its log odds ratio. An exception phrase is a term with the word before or after it; inside one, the term
does not count. A text's features are its weighted hits by length, their number (logarithm), and whether there are any; a
logistic function of them is the score.

The lexicon, the phrases and the logistic function are learnt from labelled rows, at most ``FIT_ROWS`` of each label, the first
by a hash of their id: that bound is a parameter. Terms are counted where the texts are, and added up by Spark; what comes together
in one place are signatures of 64 bytes and three features of each row learnt from, and the terms chosen. Document frequencies
count families of near copies once, each with the words of all its members, so that a term does not gain weight by copies.
The logistic function is fitted to the features that one half of the families gets from the terms of the other, both ways, and
its intercept is put right for the shares of both labels' rows that were learnt from. The lexicon has at most ``TERMS`` terms and
``PHRASES`` phrases and is all that is sent to the executors.

Nulls: a null or empty text scores like a text without hits. A null label or id is not learnt from. Very long texts: whole.
Repeated rows: scored alike. Empty table: empty result; without labels of both kinds all scores are 0. Further columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, cut, only
from .jaccard_join import SIGNATURE, shingle_sets, signatures

FIT_ROWS = 4_000
TERMS, PHRASES = 2_000, 2_000
#: A term occurs in so many families of label 1, has so high a log odds ratio, and so high a log likelihood ratio.
SUPPORT, ODDS, EVIDENCE = 4, 2.5, 25.0
STEM = 4
#: Texts that share so many of their shingles of so many words, by signature, with a family's first are of that family.
FAMILY, WIDTH = 0.7, 5

# Letters that look like Latin ones, and digits and signs that stand for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "e", "и": "n", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o",
    "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ѡ": "w", "һ": "h", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʟ": "l", "ꞵ": "b", "ᴏ": "o", "ᴜ": "u", "ᴄ": "c", "ᴛ": "t", "ѵ": "v", "ց": "g", "օ": "o", "ո": "n", "ս": "u",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}

_LOOKALIKES = str.maketrans(LOOKALIKES | dict.fromkeys("\u200b\u200c\u200d\u2060\ufeff\u00ad"))
_DIGITS = str.maketrans(DIGITS)
_RUN = re.compile(r"[0-9@$!|]+")
_OTHER = re.compile(r"[\W\d_]+")
_ASCII_OTHER = str.maketrans({chr(k): " " for k in range(128) if not chr(k).isalpha()})


def _letters(m: re.Match) -> str:
    """Digits and signs next to letters as letters: ``1d10t``, ``$tupid``, ``sc*m3``; but not marks at a word's begin or end."""
    text, a, b = m.string, m.start(), m.end()
    before, after = a > 0 and text[a - 1].isalpha(), b < len(text) and text[b].isalpha()
    marks = "!" in m[0] or "|" in m[0]
    return m[0].translate(_DIGITS) if before and after or (before or after) and not marks else m[0]


def fold(text: str | None) -> str:
    """The words of a text, folded, each between single spaces."""
    if not text:
        return " "
    if text.isascii():
        text = _RUN.sub(_letters, text.lower()).translate(_ASCII_OTHER)
    else:
        text = unicodedata.normalize("NFKC", text).casefold().translate(_LOOKALIKES)
        text = _OTHER.sub(" ", _RUN.sub(_letters, text))
    return f" {' '.join(text.split())} "


def families(marks: list[bytes], tokens: np.ndarray) -> list[int]:
    """The number of each text's family of near copies, in order of the families' first marks; texts of one mark are equal."""
    order = np.array(sorted(range(len(marks)), key=marks.__getitem__), np.int64)
    out, n = np.zeros(len(marks), np.int64), 0
    while len(order):
        alike = (tokens[order] == tokens[order[0]]).mean(axis=1) >= FAMILY
        out[order[alike]] = n
        order, n = order[~alike], n + 1
    return out.tolist()


def _folded(rows: DataFrame) -> DataFrame:
    """toxic, the folded text, its mark and its signature."""

    def run(frames):
        import xxhash

        for frame in batches(frames):
            texts = [fold(t) for t in frame["text"]]
            tokens = signatures(shingle_sets(texts, WIDTH)).astype(np.uint8)
            yield pd.DataFrame({"toxic": frame["toxic"], "text": texts, "mark": [xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts], "tokens": [t.tobytes() for t in tokens]})

    return rows.mapInPandas(run, "toxic int, text string, mark binary, tokens binary")


def _with_families(rows: DataFrame) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """The rows with ``family``, its ``size`` in texts, and ``half``; and the number of families by label and half."""

    def run(frame):
        tokens = np.frombuffer(b"".join(frame["tokens"]), np.uint8).reshape(-1, SIGNATURE)
        family = pd.Series(families(frame["mark"].tolist(), tokens))
        return pd.DataFrame({"y": frame["toxic"].to_numpy(), "m": frame["mark"].to_numpy(), "family": family, "size": family.map(family.value_counts()), "half": family % 2})

    texts = rows.groupBy("toxic", "mark").agg(F.first("tokens").alias("tokens"))  # as many as FIT_ROWS allows
    found = cut(texts.groupBy("toxic").applyInPandas(run, "y int, m binary, family long, size long, half int"))
    n = {(r.y, r.half): r.n for r in found.groupBy("y", "half").agg(F.count_distinct("family").alias("n")).collect()}
    few = F.broadcast(found)  # as many as FIT_ROWS allows of each label
    return rows.join(few, (F.col("toxic") == F.col("y")) & (F.col("mark") == F.col("m"))).select("toxic", "text", "family", "size", "half"), n


def _counts(rows: DataFrame) -> DataFrame:
    """stem, term, and the number of families that have it: t0, t1 of label 1 in either half, c0, c1 of label 0."""

    def run(frames):
        seen: Counter = Counter()
        for frame in batches(frames):
            for y, folded, family, size, half in zip(*[frame[c].tolist() for c in ("toxic", "text", "family", "size", "half")]):
                own = set(folded.split())
                stems = {w[:k] for w in own for k in range(STEM, min(len(w), 12) + 1)}
                group = (y, half, family if size > 1 else -1)  # texts that are a family by themselves are counted here
                seen.update((group, False, w) for w in own)
                seen.update((group, True, w) for w in stems)
            if len(seen) > 500_000:
                yield table(seen)
                seen.clear()
        yield table(seen)

    def table(seen):
        return pd.DataFrame([(*g, stem, w, n) for (g, stem, w), n in seen.items()], columns=["toxic", "half", "family", "stem", "term", "n"])

    each = rows.mapInPandas(run, "toxic int, half int, family long, stem boolean, term string, n long")
    each = each.groupBy("stem", "term", "toxic", "half", "family").agg(F.when(F.col("family") < 0, F.sum("n")).otherwise(1).alias("n"))
    n = lambda y, half: F.coalesce(F.sum(F.when((F.col("toxic") == y) & (F.col("half") == half), F.col("n"))), F.lit(0))
    return each.groupBy("stem", "term").agg(n(1, 0).alias("t0"), n(1, 1).alias("t1"), n(0, 0).alias("c0"), n(0, 1).alias("c1"))


def _choose_terms(counts: DataFrame, halves: tuple[int, ...], n: dict[tuple[int, int], int]) -> list[tuple[str, float]]:
    """Patterns (" word " or " stem") and weights, from the families of these halves."""
    nt, nc = (sum(n.get((y, h), 0) for h in halves) for y in (1, 0))
    if not nt or not nc:
        return []
    t, c = (sum((F.col(f"{x}{h}") for h in halves), F.lit(0)) for x in "tc")
    own = counts.select("stem", "term", t.cast("double").alias("t"), c.cast("double").alias("c")).filter(F.col("t") >= SUPPORT)
    # a stem that nearly always goes on in one way says no more than its continuation, or the whole word
    longer = own.filter("stem").select(F.expr("left(term, length(term) - 1)").alias("begin"), "t").groupBy("begin").agg(F.max("t").alias("longer"))
    word = own.filter("not stem").select(F.col("term").alias("word"), F.col("t").alias("whole"))
    t, c = F.col("t"), F.col("c")
    weight = F.log((t + 0.5) / (nt + 1)) - F.log((c + 0.5) / (nc + 1))
    part = lambda k, m, p: F.when(k > 0, k * F.log(p)).otherwise(0) + F.when(k < m, (m - k) * F.log(1 - p)).otherwise(0)
    both = (t + c) / (nt + nc)
    # log likelihood ratio of the two rates
    evidence = 2 * (part(t, nt, t / nt) + part(c, nc, c / nc) - part(t, nt, both) - part(c, nc, both))
    good = own.withColumns({"weight": weight, "evidence": evidence}).filter((F.col("weight") >= ODDS) & (F.col("evidence") >= EVIDENCE))
    good = good.join(longer, F.col("stem") & (F.col("term") == F.col("begin")), "left").join(word, F.col("stem") & (F.col("term") == F.col("word")), "left")
    good = good.filter(~F.col("stem") | ((F.coalesce("longer", F.lit(0)) < 0.9 * t) & (F.coalesce("whole", F.lit(0)) < 0.9 * t)))
    pattern = F.concat(F.lit(" "), "term", F.when(F.col("stem"), "").otherwise(" "))
    found = good.select(pattern.alias("pattern"), "weight", "evidence").orderBy(F.desc("evidence"), "pattern").limit(4 * TERMS).collect()
    kept: dict[str, float] = {}
    for r in found:
        if not any(r.pattern[:k] in kept for k in range(STEM + 1, len(r.pattern))):
            kept[r.pattern] = r.weight
    return sorted(kept.items(), key=lambda x: (-x[1], x[0]))[:TERMS]


class Lexicon:
    """Terms, exception phrases and the logistic function; small enough to send to each task."""

    def __init__(self, terms: list[tuple[str, float]], phrases: list[str], model: list[float]):
        import ahocorasick

        self.terms, self.phrases, self.model = dict(terms), phrases, model
        self.matches = ahocorasick.Automaton()
        for pattern, weight in terms:
            self.matches.add_word(pattern, (len(pattern), weight))
        for phrase in phrases:
            self.matches.add_word(phrase, (len(phrase), 0.0))
        self.any = bool(terms)
        if self.any:
            self.matches.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """Begin, end and weight of each term outside exception phrases."""
        if not self.any:
            return []
        terms, spared = [], []
        for end, (length, weight) in self.matches.iter(folded):
            (terms if weight else spared).append((end + 1 - length, end + 1, weight))
        return [h for h in terms if not any(a <= h[0] and h[1] <= b for a, b, _ in spared)] if spared else terms

    def features(self, folded: str) -> tuple[float, float, float]:
        hits = self.hits(folded)
        if not hits:
            return 0.0, 0.0, 0.0
        total = sum(w for _, _, w in hits)
        return min(20.0, 100 * total / folded.count(" ")), math.log1p(total), 1.0

    def scores(self, features: np.ndarray) -> np.ndarray:
        if not self.model:
            return np.zeros(len(features))
        z = self.model[0] + features @ np.array(self.model[1:])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def neighbours(lexicon: Lexicon, folded: str) -> list[str]:
    """Each term of a text with the word before it, and with the word after it."""
    around = set()
    for a, b, _ in lexicon.hits(folded):
        end = b if folded[b - 1] == " " else folded.index(" ", b) + 1
        before = folded.rfind(" ", 0, a)
        after = folded.find(" ", end)
        if before >= 0:
            around.add(folded[before:end])
        if after >= 0:
            around.add(folded[a : after + 1])
    return sorted(around)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> list[float]:
    """By Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(b)), x.T @ (y - p) - ridge * b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b.tolist()


def sample(ids: DataFrame, docs: DataFrame, fit_rows: int) -> DataFrame:
    """toxic, text of at most ``fit_rows`` labelled rows of each label, by a hash of their ids."""
    first = [ids.filter(F.col("toxic") == y).withColumn("order", F.md5(F.col("id").cast("string"))).orderBy("order", "id").limit(fit_rows).select("id", "toxic") for y in (0, 1)]
    chosen = F.broadcast(first[0].union(first[1]))  # 2 * fit_rows rows at most
    return only(docs, doc_id="long", text="string").join(chosen, F.col("doc_id") == F.col("id")).select("toxic", "text")


def train(labelled: DataFrame, docs: DataFrame, fit_rows: int = FIT_ROWS) -> Lexicon:
    """Learn from the labelled rows (doc_id, toxic) of the documents."""
    ids = labelled.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).filter("id is not null and toxic in (0, 1)")
    labels = {r.toxic: r["count"] for r in ids.groupBy("toxic").count().collect()}
    if len(labels) < 2:
        return Lexicon([], [], [])
    rows, n = _with_families(cut(_folded(sample(ids, docs, fit_rows))))
    counts = cut(_counts(rows).filter(F.col("t0") + F.col("t1") >= SUPPORT))
    every = Lexicon(_choose_terms(counts, (0, 1), n), [], [])
    other = [Lexicon(_choose_terms(counts, (1 - half,), n), [], []) for half in (0, 1)]

    def read(frames):
        for frame in batches(frames):
            found = [other[h].features(t) for h, t in zip(frame["half"], frame["text"])]
            yield pd.DataFrame({"toxic": frame["toxic"], "x": found, "around": [neighbours(every, t) for t in frame["text"]]})

    seen = cut(rows.select("toxic", "text", "half").mapInPandas(read, "toxic int, x array<double>, around array<string>"))
    points = seen.select("toxic", "x").collect()  # 2 * fit_rows at most
    if len({r.toxic for r in points}) < 2:  # labels without documents teach nothing
        return Lexicon([], [], [])
    model = fit_logistic(np.array([r.x for r in points]).reshape(-1, 3), np.array([r.toxic for r in points], float))
    # rows of each label were learnt from in different shares
    model[0] += sum((1 if y else -1) * math.log(labels[y] / min(labels[y], fit_rows)) for y in (0, 1))
    # terms with a neighbour that stand in more texts of label 0 than of label 1, and in three at least
    phrases = seen.select("toxic", F.explode("around").alias("phrase")).groupBy("phrase").agg(F.sum(1 - F.col("toxic")).alias("clean"), F.sum("toxic").alias("bad"))
    phrases = phrases.filter("clean >= 3 and clean > bad").orderBy(F.desc("clean"), "phrase").limit(PHRASES).collect()
    return Lexicon(list(every.terms.items()), [r.phrase for r in phrases], model)


def scorer(lexicon: Lexicon, text: Column) -> Column:
    """The score of a text, 0 to 1."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(lexicon.scores(np.array([lexicon.features(fold(t)) for t in texts]).reshape(-1, 3)))

    return F.pandas_udf(run, "double")(text.cast("string"))


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows with ``score``."""
    return docs.withColumn("score", scorer(lexicon, F.col("text")))


def keep_clean(docs: DataFrame, lexicon: Lexicon, most: float = 0.5) -> DataFrame:
    """The rows whose score is below ``most``."""
    return docs.filter(scorer(lexicon, F.col("text")) < most)
