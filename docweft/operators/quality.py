"""Filters with reasons, local checks of extractions, scores and statuses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def reject_reason(df: DataFrame, text: Column, phrases: list[str], least: int = 15) -> DataFrame:
    """The rows with ``reason``: too short, or the first excluded phrase; null for rows that stay."""
    reason = F.when(F.length(F.trim(X.text_or_empty(text))) < least, "too short")
    for p in phrases:
        reason = reason.when(F.contains(F.lower(text), F.lit(p)), f"excluded: {p}")
    return df.withColumn("reason", reason)


# Fixed value: a numbered heading that a text begins with.
HEADING = r"^\s*[0-9]+(?:\.[0-9]+){0,2}[.):\-\s]+[^\n]{1,120}\n+"


# White space or not, as SQL has it.
_GAP, _WORD = f"[{X.SPACE}]", f"[^{X.SPACE}]"


def _flat(c: Column) -> Column:
    return F.lower(X.collapse(c))


def source_side(df: DataFrame, text: str) -> DataFrame:
    """``df`` with what a source is checked by instead of its text; a numbered heading at its begin doesn't count.

    The source is a column of its own before it is searched: expressions with lambdas share no parts, so each would make it anew.
    """
    df = df.withColumn(text, X.strip(F.col(text)))
    bare = X.strip(F.regexp_replace(text, HEADING, ""))
    df = df.withColumn("_source", F.when(F.left(text, F.lit(1)).between("0", "9"), bare).otherwise(F.col(text)))
    source = F.col("_source")
    first, last = X.edge_sentences(source)
    own = {
        "s_empty": F.col(text) == "", "s_flat": _flat(source), "s_numbers": X.numbers(source),
        "s_equations": F.transform(X.equations(source), _flat), "s_terms": F.transform(X.key_terms(source), F.lower),
        "s_last": _flat(F.left(last, F.lit(50))), "s_first": _flat(F.left(first, F.lit(40))),
    }
    return df.withColumns(own).drop(text, "_source")


def extracted_side(df: DataFrame, text: str) -> DataFrame:
    """``df`` with what an extraction is checked by instead of its text: of its long sentences about five, evenly spread, by their first five words.

    The sentences are a column of their own before some are taken, so that the text is searched once and not for each sentence.
    """
    df = df.withColumn(text, X.strip(F.col(text)))
    long = rf"\A{_GAP}*+(?:{_WORD}++{_GAP}++){{7}}{_WORD}"
    df = df.withColumn("_long", F.filter(X.stretches(F.col(text)), lambda s: s.rlike(long)))
    df = df.withColumn("_step", F.greatest(F.lit(1), F.floor(F.size("_long") / 5).cast("int")))
    head = lambda s: _flat(F.regexp_extract(s, rf"\A{_GAP}*+((?:{_WORD}++{_GAP}++){{4}}{_WORD}++)", 1))
    heads = F.transform(F.filter("_long", lambda s, i: i % F.col("_step") == 0), head)
    own = {"e_low": F.lower(text), "e_heads": F.filter(heads, lambda h: F.length(h) > 10)}
    return df.withColumns(own).drop(text, "_long", "_step")


def local_checks(df: DataFrame) -> DataFrame:
    """The rows with ``failures`` and ``score`` from both sides' columns: word ratio, numbers, equations, key terms, last and first sentence, sampled sentences.

    Numbers are looked for as substrings. The flat extraction is made here, so that its text is shuffled once. Of many numbers or equations those that
    the extraction has as its own meet in one hash set; only the others are looked for in its text.
    """
    df = df.withColumn("e_flat", X.collapse(F.col("e_low")))
    lost = lambda s: (F.length(s) > 15) & ~F.contains(F.col("e_flat"), s)
    others = lambda s, own: F.when(F.size(s) > 50, F.array_except(s, own)).otherwise(F.col(s))
    numbers, equations = others("s_numbers", X.numbers(F.col("e_low"))), others("s_equations", F.transform(X.equations(F.col("e_low")), _flat))
    tests = {
        "word count": X.collapsed_words(F.col("e_flat")) / F.greatest(X.collapsed_words(F.col("s_flat")), F.lit(1)) < 0.7,
        "numbers missing": F.exists(numbers, lambda n: ~F.contains(F.col("e_low"), n)),
        "equations missing": F.exists(equations, lambda q: ~F.contains(F.col("e_flat"), q)),
        "key terms missing": F.exists("s_terms", lambda t: ~F.contains(F.col("e_low"), t)),
        "last sentence missing": lost(F.col("s_last")), "opening missing": lost(F.col("s_first")),
        "not in source": F.exists("e_heads", lambda h: ~F.contains(F.col("s_flat"), h)),
    }
    found = F.array_compact(F.array(*[F.when(test, name) for name, test in tests.items()]))
    empty = F.col("s_empty") | (F.col("e_low") == "")
    failures = F.when(F.col("s_empty"), F.array(F.lit("no source text"))).when(F.col("e_low") == "", F.array(F.lit("empty extraction"))).otherwise(found)
    df = df.withColumn("failures", failures)
    return df.withColumn("score", F.when(empty, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), 1 - 0.2 * F.size("failures")), 6)))


def status_case(*cases: tuple[Column, str], default: str) -> Column:
    """The status of the first case that holds."""
    first, *rest = cases
    return reduce(lambda w, c: w.when(c[0], c[1]), rest, F.when(*first)).otherwise(default)
