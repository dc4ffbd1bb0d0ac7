"""Column functions: normalisers, keys, extraction, detection. All stay in the JVM; null texts count as empty where a key is made."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that don't count as tokens of a title.
STOPWORDS = "a an and are as at be by for from in is it of on or that the this to was were with".split()
# Patterns of numbers, equations, capitalised phrases, quoted terms and sentences.
NUMBER = r"[0-9]+\.?[0-9]*"
EQUATION = r"[A-Za-z_]+\s*[=<>]\s*[A-Za-z0-9\s+\-*/^().]+"
PHRASE = r"[A-Z][a-z]+(?:[ \t]+[A-Z][a-z]+)+"
QUOTED = r"\"([^\"]{3,30})\""
SENTENCE = r"[^.!?]+[.!?]+"
# The same stretches as these patterns find, for a search that never looks twice at a character: runs are not given back, and a run of letters
# is tried at its begin (or where the last equation ended) only. SQL keeps the plain patterns, as its engine has no such runs.
SPACE = r" \t\n\f\r"
EQUATION_ONCE = rf"(?:\G|(?<![A-Za-z_]))[A-Za-z_]++[{SPACE}]*+[=<>][{SPACE}]*[A-Za-z0-9{SPACE}+\-*/^().]+"
PHRASE_ONCE = r"[A-Z][a-z]++(?:[ \t]++[A-Z][a-z]++)++"
SENTENCE_ONCE = r"\G[.!?]*+([^.!?]++[.!?]++)"
LAST_SENTENCE = r"(?s)\A(?:.*[.!?])?([^.!?]++[.!?]++)[^.!?]*+\z"
ROMAN = ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x"]


def chain(c: Column, *steps: tuple[str, str]) -> Column:
    """Replace each pattern in turn, everywhere."""
    return reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), steps, c)


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.trim(c, F.lit(" \t\n\f\r"))


def collapse(c: Column) -> Column:
    """White space runs as one space. Single spaces are left alone, not replaced by themselves."""
    return F.regexp_replace(c, rf"[{SPACE}](?:(?<! )[{SPACE}]*+|[{SPACE}]++)", " ")


# ---------------------------------------------------------------- keys


def fingerprint_key(c: Column, most: int = 240) -> Column:
    """The text in lower case without TeX commands, symbols and punctuation, as far as it counts for the fingerprint."""
    tex = [(r"\\[a-zA-Z]+\{[^}]*\}", " "), (r"\\[a-zA-Z]+", " "), (r"\\[^a-zA-Z]", " "), (r"[$]+", " "), ("[{}]", " ")]
    return F.left(F.trim(chain(F.lower(text_or_empty(c)), *tex, ("[^a-z0-9 ]+", " "), (" +", " "))), F.lit(most))


def fingerprint(c: Column) -> Column:
    """Hash of the leading normalised characters; all texts without any share one."""
    return F.sha1(fingerprint_key(c))


def squash(c: Column) -> Column:
    """White space runs as one space, ends stripped, lower case."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def block_hash(kind: Column, *fields: Column) -> Column:
    """Hash of a block's kind and fields; null when all fields are empty."""
    body = F.concat_ws("|", *[squash(text_or_empty(f)) for f in fields])
    return F.when(F.regexp_replace(body, "[| ]+", "") != "", F.sha1(F.concat_ws("|", kind, body)))


def title_key(c: Column) -> Column:
    return F.regexp_replace(squash(c), r"[ .:\-—]+$", "")


def match_key(c: Column) -> Column:
    return F.regexp_replace(squash(c), r"^[.,;:!?'\"()\[\]]+|[.,;:!?'\"()\[\]]+$", "")


def heading_key(c: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def furniture_key(c: Column) -> Column:
    """Running headers without their page numbers."""
    return chain(squash(c), (r"^([0-9]+ )+", ""), (r"( [0-9]+)+$", ""))


def question_number(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"^q\.?\s*", ""), r"^[().\[\]{}]+|[().\[\]{}]+$", "")


def question_ref(c: Column) -> Column:
    """``Question 3`` and ``Q. 3`` as q3, ``Example 5`` as example5."""
    return chain(F.lower(F.trim(c)), (r"^(question|q)[. ]*([0-9]+)$", "q$2"), (r"^(example|exercise)[. ]*([0-9]+)$", "$1$2"))


def label_key(c: Column) -> Column:
    return F.regexp_extract(chain(F.lower(c), (r"^(figure|fig)[. ]*", "")), r"[0-9]+(?:\.[0-9]+)*[a-z]?", 0)


def slug_parts(c: Column) -> Column:
    """parent, kind, num of ``parent-kind-num``."""
    p = r"^(.*)-(example|exercise|question|section)-([0-9]+)$"
    return F.struct(F.regexp_extract(c, p, 1).alias("parent"), F.regexp_extract(c, p, 2).alias("kind"), F.regexp_extract(c, p, 3).alias("num"))


def lookup(c: Column, table: dict[str, str], default: str) -> Column:
    """An alias map with a default."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.element_at(m, c), F.lit(default))


# ---------------------------------------------------------------- extraction


def word_total(c: Column) -> Column:
    """Number of words between white space."""
    return F.size(F.filter(F.split(text_or_empty(c), r"\s+"), lambda w: w != ""))


def collapsed_words(c: Column) -> Column:
    """Number of words of a text whose white space is single spaces between words."""
    return F.when(c == "", 0).otherwise(F.octet_length(c) - F.octet_length(F.replace(c, F.lit(" "), F.lit(""))) + 1)


def numbers(c: Column) -> Column:
    return F.sort_array(F.array_distinct(F.regexp_extract_all(text_or_empty(c), F.lit(NUMBER), F.lit(0))))


def equations(c: Column) -> Column:
    c = text_or_empty(c)
    signs = reduce(lambda x, s: x | F.contains(c, F.lit(s)), "<>", F.contains(c, F.lit("=")))
    found = F.transform(F.when(signs, F.regexp_extract_all(c, F.lit(EQUATION_ONCE), F.lit(0))).otherwise(F.array()), lambda e: strip(e))
    return F.sort_array(F.array_distinct(F.filter(found, lambda e: (F.length(e) > 3) & (F.length(e) < 100))))


def key_terms(c: Column, most: int = 20) -> Column:
    """Capitalised phrases, then quoted terms, in order, the first 20."""
    c = text_or_empty(c)
    phrases = F.filter(F.regexp_extract_all(c, F.lit(PHRASE_ONCE), F.lit(0)), lambda t: F.length(t) > 5)
    quoted = F.when(F.contains(c, F.lit('"')), F.regexp_extract_all(c, F.lit(QUOTED), F.lit(1))).otherwise(F.array())
    return F.slice(F.array_distinct(F.concat(phrases, quoted)), 1, most)


def stretches(c: Column) -> Column:
    """Stretches up to a run of end marks, white space before them included. Each begins where the last one ended, so that what follows the last mark is searched once."""
    return F.regexp_extract_all(text_or_empty(c), F.lit(SENTENCE_ONCE), F.lit(1))


def sentences(c: Column) -> Column:
    """Stretches up to a run of end marks without white space at both ends; none is empty, as it has its marks."""
    return F.transform(stretches(c), lambda s: strip(s))


def edge_sentences(c: Column) -> tuple[Column, Column]:
    """The first and the last sentence, empty if there is none; the others are not cut."""
    return strip(F.regexp_extract(c, SENTENCE_ONCE, 1)), strip(F.regexp_extract(c, LAST_SENTENCE, 1))


def token_set(c: Column) -> Column:
    """Distinct tokens of two characters and more that are no stop words."""
    tokens = F.split(F.lower(text_or_empty(c)), "[^a-z0-9]+")
    return F.array_except(F.array_distinct(F.filter(tokens, lambda t: F.length(t) >= 2)), F.array(*map(F.lit, STOPWORDS)))


def long_tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit("[a-z0-9]{4,}"), F.lit(0)))


def char_windows(c: Column, size: int = 10, step: int = 1) -> Column:
    """Windows of so many characters, one each ``step``, in one pass; none begins within a character of two UTF-16 units."""
    return F.regexp_extract_all(text_or_empty(c), F.lit(rf"(?s)(?=(.{{{size}}})).{{1,{step}}}"), F.lit(1))


def window_times(df: DataFrame, key: str, part: str, size: int = 10, step: int = 5) -> DataFrame:
    """key, times: how often each window of ``part`` occurs in it, one window each ``step`` characters; texts without windows are left out."""
    rows = df.select(key, F.posexplode(char_windows(F.col(part), size)).alias("_at", "_window")).filter(F.col("_at") % step == 0)
    counted = rows.groupBy(key, "_window").agg(F.count("*").alias("_n"))
    return counted.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_window", "_n"))).alias("times"))


def containment(times: Column, whole: Column, size: int = 10) -> Column:
    """Share of the windows of ``times``, a column of a table that was joined, that stand in ``whole``; null without windows.

    The windows of ``whole`` meet those of ``times`` in one hash set, outside of any lambda.
    """
    found = F.array_intersect(F.map_keys(times), char_windows(whole, size))
    add = lambda total, n: total + n
    every = F.aggregate(F.map_values(times), F.lit(0).cast("long"), add)
    return F.aggregate(found, F.lit(0).cast("long"), lambda total, w: total + F.element_at(times, w)) / every


def coverage(part: Column, whole: Column) -> Column:
    """Share of the tokens of ``part`` that ``whole`` has; 1 without tokens."""
    p = token_set(part)
    return F.when(F.size(p) > 0, F.size(F.array_intersect(p, token_set(whole))) / F.size(p)).otherwise(1.0)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 when both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def token_budget(words: Column) -> Column:
    """A step function of the number of words."""
    return F.when(words <= 200, 2048).when(words <= 800, 4096).when(words <= 2000, 8192).otherwise(16384)


def markup_text(html: Column) -> Column:
    """What a reader sees of a page: no head, script, style, comments or tags."""
    return F.trim(chain(text_or_empty(html), (r"(?s)<!--.*?-->", " "), (r"(?s)<script[^>]*>.*?</script>", " "), (r"(?s)<style[^>]*>.*?</style>", " "), (r"<[^>]+>", " "), (r"\s+", " ")))


def natural_order(c: Column) -> Column:
    """Order of question numbers in the merge: numbers as numbers, Roman i to x, other by code point above 1000; blank last."""
    romans = F.create_map(*[F.lit(x) for k, r in enumerate(ROMAN) for x in (r, k + 1)])
    parts = F.filter(F.split(F.lower(F.trim(text_or_empty(c))), "[^a-z0-9]+"), lambda p: p != "")
    key = F.transform(parts, lambda p: F.coalesce(F.when(p.rlike("^[0-9]{1,9}$"), p.cast("int")), F.element_at(romans, p), F.ascii(p) + 1000))
    return F.when(F.size(parts) == 0, F.array(F.lit(1_000_000_000))).otherwise(key)


def export_order(c: Column) -> Column:
    """Order in the export: first number, then text; without a number last."""
    first = F.regexp_extract(text_or_empty(c), "[0-9]{1,9}", 0)
    return F.struct(F.when(first != "", first.cast("int")).otherwise(1_000_000_000).alias("n"), text_or_empty(c).alias("t"))


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of boxes x0, y0, x1, y1; 0 when the union is empty."""
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    area = lambda r: F.greatest(F.lit(0.0), r["x1"] - r["x0"]) * F.greatest(F.lit(0.0), r["y1"] - r["y0"])
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[text_or_empty(p.cast("string")) for p in parts]), 256)
