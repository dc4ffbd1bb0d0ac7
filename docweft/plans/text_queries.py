"""Queries over whole texts: fingerprints, extraction, filters, quality of extraction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import quality
from ..sources.tables import table
from .registry import query

FP_SQL = r"""left(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')),
 '\\[a-zA-Z]+\{[^}]*\}', ' ', 'g'), '\\[a-zA-Z]+', ' ', 'g'), '\\[^a-zA-Z]', ' ', 'g'), '[$]+', ' ', 'g'), '[{}]', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')), 240)"""
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "]"
TOKENS_SQL = f"list_filter(list_distinct(list_filter(string_split_regex(lower(coalesce({{0}}, '')), '[^a-z0-9]+'), lambda t: length(t) >= 2)), lambda t: NOT list_contains({STOP_SQL}, t))"
WORDS_SQL = r"len(list_filter(string_split_regex(coalesce({0}, ''), '\s+'), lambda w: w <> ''))"
#: Each document beside the one before it stands for a text and its extraction.
PAIRS_SQL = "SELECT a.doc_id, coalesce(a.text, '') AS src, coalesce(b.text, '') AS ext FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1"


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def pairs(spark: SparkSession, d: str, of: Callable[[Column], Column] = lambda text: text) -> DataFrame:
    """doc_id, src, ext: the texts, or what ``of`` makes of them, so that no more is shuffled."""
    docs = documents(spark, d)
    part = of(X.text_or_empty(F.col("text")))
    return docs.select("doc_id", part.alias("src")).join(docs.select((F.col("doc_id") - 1).alias("doc_id"), part.alias("ext")), "doc_id")


def token_pairs(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, share: of each document's tokens those that the next one has; 1 without tokens."""
    tokens = documents(spark, d).select("doc_id", X.token_set(F.col("text")).alias("src"))
    other = documents(spark, d).select((F.col("doc_id") - 1).alias("doc_id"), X.token_set(F.col("text")).alias("ext"))
    n = F.size("src")
    return tokens.join(other, "doc_id").select("doc_id", F.when(n > 0, F.size(F.array_intersect("src", "ext")) / n).otherwise(1.0).alias("share"))


def keep_first(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select("doc_id", "source", "lang", X.fingerprint(F.col("text")).alias("fp"))
    first = Window.partitionBy("source", "fp").orderBy(F.col("lang").asc_nulls_last(), "doc_id")
    return docs.withColumn("keep", F.row_number().over(first) == 1)


@query(f"""SELECT doc_id, source, fp, row_number() OVER (PARTITION BY source, fp ORDER BY lang NULLS LAST, doc_id) = 1 AS keep
FROM (SELECT doc_id, source, lang, sha1({FP_SQL}) AS fp FROM documents)""")
def dedup_fingerprint(spark, d):
    """Of each source's documents with one fingerprint the first is kept."""
    return keep_first(spark, d).select("doc_id", "source", "fp", "keep")


@query(f"""SELECT source, count(*) AS n, count(DISTINCT fp) AS n_kept, count(*) - count(DISTINCT fp) AS n_dropped
FROM (SELECT source, sha1({FP_SQL}) AS fp FROM documents) GROUP BY source""")
def dedup_stats(spark, d):
    """Kept and dropped documents of each source: fingerprints are counted before sources, so both steps combine map-side."""
    each = documents(spark, d).select("source", X.fingerprint(F.col("text")).alias("fp")).groupBy("source", "fp").agg(F.count("*").alias("n"))
    return each.groupBy("source").agg(F.sum("n").alias("n"), F.count("*").alias("n_kept"), (F.sum("n") - F.count("*")).alias("n_dropped"))


@query(r"""SELECT hash, count(*) AS n, min(conv_id) AS first_conv FROM (
 SELECT conv_id, CASE WHEN regexp_replace(body, '[| ]+', '', 'g') <> '' THEN sha1(role || '|' || body) END AS hash
 FROM (SELECT *, lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS body FROM conversations)) WHERE hash IS NOT NULL GROUP BY hash HAVING count(*) > 1""")
def block_hash_dups(spark, d):
    """Blocks of one kind and text that occur more than once; empty blocks never match."""
    rows = table(spark, d, "conversations").select("conv_id", X.block_hash(F.col("role"), F.col("text")).alias("hash")).filter("hash is not null")
    return rows.groupBy("hash").agg(F.count("*").alias("n"), F.min("conv_id").alias("first_conv")).filter("n > 1")


EXCLUDED = ["all rights reserved", "licensed under", "lorem ipsum", "terms of use"]
REASON_SQL = "CASE WHEN length(trim(coalesce(text, ''))) < 15 THEN 'too short' " + " ".join(f"WHEN contains(lower(text), '{p}') THEN 'excluded: {p}'" for p in EXCLUDED) + " END"


@query(f"SELECT doc_id, reason IS NULL AS kept, reason FROM (SELECT doc_id, {REASON_SQL} AS reason FROM documents)")
def structural_filter_split(spark, d):
    """Both outputs of the structural filter: kept, or rejected with the reason."""
    return quality.reject_reason(documents(spark, d), F.col("text"), EXCLUDED).select("doc_id", F.col("reason").isNull().alias("kept"), "reason")


@query(f"SELECT reason, count(*) AS n FROM (SELECT {REASON_SQL} AS reason FROM documents) WHERE reason IS NOT NULL GROUP BY reason")
def excluded_phrase_reason(spark, d):
    """How many documents each reason rejects."""
    return quality.reject_reason(documents(spark, d), F.col("text"), EXCLUDED).filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


@query(rf"""SELECT doc_id, len(v) AS n, array_to_string(v, ',') AS numbers FROM (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(coalesce(text, ''), '{X.NUMBER}'))) AS v FROM documents)""")
def extract_numbers(spark, d):
    """Distinct numbers of each text."""
    v = X.numbers(F.col("text"))
    return documents(spark, d).select("doc_id", F.size(v).cast("long").alias("n"), F.array_join(v, ",").alias("numbers"))


@query(rf"""SELECT doc_id, len(v) AS n, array_to_string(v, ';') AS equations FROM (SELECT doc_id, list_sort(list_distinct(list_filter(list_transform(
 regexp_extract_all(coalesce(text, ''), '{X.EQUATION}'), lambda e: regexp_replace(e, '^\s+|\s+$', '', 'g')), lambda e: length(e) > 3 AND length(e) < 100))) AS v FROM documents)""")
def extract_equations(spark, d):
    """Distinct equations of each text."""
    v = X.equations(F.col("text"))
    return documents(spark, d).select("doc_id", F.size(v).cast("long").alias("n"), F.array_join(v, ";").alias("equations"))


@query(rf"""WITH t AS (SELECT doc_id, list_concat(list_filter(regexp_extract_all(coalesce(text, ''), '{X.PHRASE}'), lambda t: length(t) > 5), regexp_extract_all(coalesce(text, ''), '{X.QUOTED.replace(chr(92) + '"', '"')}', 1)) AS v FROM documents),
u AS (SELECT doc_id, unnest(v) AS term, generate_subscripts(v, 1) AS k FROM t), f AS (SELECT doc_id, term, min(k) AS k FROM u GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS nth FROM f)
SELECT doc_id, count(*) AS n, string_agg(term, ';' ORDER BY k) AS terms FROM r WHERE nth <= 20 GROUP BY doc_id""")
def extract_key_terms(spark, d):
    """Capitalised phrases and quoted terms of each text that has some."""
    v = X.key_terms(F.col("text"))
    return documents(spark, d).select("doc_id", v.alias("v")).filter(F.size("v") > 0).select("doc_id", F.size("v").cast("long").alias("n"), F.array_join("v", ";").alias("terms"))


@query(rf"""SELECT doc_id, len(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '{X.SENTENCE}'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')) AS n_sentences FROM documents""")
def sentence_counts(spark, d):
    """Sentences of each text."""
    return documents(spark, d).select("doc_id", F.size(X.sentences(F.col("text"))).cast("long").alias("n_sentences"))


@query(f"SELECT doc_id, len({TOKENS_SQL.format('text')}) AS n_tokens FROM documents")
def token_set_size(spark, d):
    """Distinct tokens of each text without stop words."""
    return documents(spark, d).select("doc_id", F.size(X.token_set(F.col("text"))).cast("long").alias("n_tokens"))


@query(f"""SELECT doc_id, n_words, CAST(CASE WHEN n_words <= 200 THEN 2048 WHEN n_words <= 800 THEN 4096 WHEN n_words <= 2000 THEN 8192 ELSE 16384 END AS INTEGER) AS budget
FROM (SELECT doc_id, {WORDS_SQL.format('text')} AS n_words FROM documents)""")
def token_budget(spark, d):
    """The step function of words that sets an answer's length."""
    n = X.word_total(F.col("text"))
    return documents(spark, d).select("doc_id", n.cast("long").alias("n_words"), X.token_budget(n).alias("budget"))


@query(f"""SELECT source, lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum({WORDS_SQL.format('text')}) AS BIGINT) AS words, round(sum(length(text)) / count(*), 6) AS density FROM documents GROUP BY source, lang""")
def text_density(spark, d):
    """Characters and words of each source and language, and characters a document."""
    docs = documents(spark, d).select("source", "lang", F.length("text").alias("c"), X.word_total(F.col("text")).alias("w"))
    return docs.groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("c").alias("chars"), F.sum("w").alias("words"), F.round(F.sum("c") / F.count("*"), 6).alias("density"))


@query(f"""SELECT doc_id, round({WORDS_SQL.format('ext')} / greatest({WORDS_SQL.format('src')}, 1), 9) AS ratio FROM ({PAIRS_SQL})""")
def word_ratio_pairs(spark, d):
    """Words of the extraction by words of the source."""
    return pairs(spark, d).select("doc_id", F.round(X.word_total(F.col("ext")) / F.greatest(X.word_total(F.col("src")), F.lit(1)), 9).alias("ratio"))


@query(r"""WITH i AS (SELECT item_id, text AS item FROM benchmark), p AS (SELECT d.doc_id, i.item_id, i.item, d.text FROM documents d JOIN i ON i.item_id = d.doc_id % (SELECT count(*) FROM benchmark)),
w AS (SELECT *, CASE WHEN length(item) >= 10 THEN list_transform(range(1, length(item) - 8, 5), lambda k: substring(item, k, 10)) ELSE [] END AS v FROM p)
SELECT doc_id, item_id, CASE WHEN len(v) > 0 THEN round(len(list_filter(v, lambda x: contains(text, x))) / len(v), 9) END AS share FROM w""")
def ngram_containment(spark, d):
    """Share of a benchmark item's character windows in the document that it is dealt to."""
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("item"))
    n = items.count()
    items = items.select("item_id").join(X.window_times(items, "item_id", "item"), "item_id", "left")
    docs = documents(spark, d).withColumn("item_id", F.col("doc_id") % max(n, 1))
    return docs.join(items, "item_id").select("doc_id", "item_id", F.round(X.containment(F.col("times"), F.col("text")), 9).alias("share"))


@query(f"""SELECT doc_id, round(CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 1 END, 9) AS share FROM (SELECT doc_id, {TOKENS_SQL.format('src')} AS a, {TOKENS_SQL.format('ext')} AS b FROM ({PAIRS_SQL}))""")
def token_coverage(spark, d):
    """Share of the source's tokens in the extraction: texts are cut to tokens once, and tokens meet, not texts."""
    return token_pairs(spark, d).select("doc_id", F.round("share", 9).alias("share"))


QUOTED_SQL = X.QUOTED.replace(chr(92) + '"', '"')
SENTENCES_SQL = rf"list_filter(list_transform(regexp_extract_all({{0}}, '{X.SENTENCE}'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"
TERMS_SQL = rf"list_concat(list_filter(regexp_extract_all(src, '{X.PHRASE}'), lambda t: length(t) > 5), regexp_extract_all(src, '{QUOTED_SQL}', 1))"


@query(rf"""WITH p AS ({PAIRS_SQL}), h AS (SELECT doc_id, regexp_replace(src, '^\s+|\s+$', '', 'g') AS src0, regexp_replace(ext, '^\s+|\s+$', '', 'g') AS ext FROM p),
t AS (SELECT doc_id, src0, ext, regexp_replace(regexp_replace(src0, '{quality.HEADING}', ''), '^\s+|\s+$', '', 'g') AS src FROM h),
q AS (SELECT *, lower(regexp_replace(src, '\s+', ' ', 'g')) AS fs, lower(regexp_replace(ext, '\s+', ' ', 'g')) AS fe, {SENTENCES_SQL.format('src')} AS ss,
  list_filter({SENTENCES_SQL.format('ext')}, lambda s: {WORDS_SQL.format('s')} >= 8) AS ls, {TERMS_SQL} AS ts FROM t),
c AS (SELECT doc_id, src0 = '' AS e1, ext = '' AS e2,
  {WORDS_SQL.format('ext')} / greatest({WORDS_SQL.format('src')}, 1) < 0.7 AS f1,
  len(list_filter(list_distinct(regexp_extract_all(src, '{X.NUMBER}')), lambda n: NOT contains(ext, n))) > 0 AS f2,
  len(list_filter(list_transform(regexp_extract_all(src, '{X.EQUATION}'), lambda e: regexp_replace(e, '^\s+|\s+$', '', 'g')), lambda e: length(e) > 3 AND length(e) < 100 AND NOT contains(fe, lower(regexp_replace(e, '\s+', ' ', 'g'))))) > 0 AS f3,
  len(list_filter(list_filter(ts, lambda t, i: list_position(ts, t) = i)[1:20], lambda t: NOT contains(lower(ext), lower(t)))) > 0 AS f4,
  CASE WHEN len(ss) > 0 THEN length(fl) > 15 AND NOT contains(fe, fl) ELSE false END AS f5,
  CASE WHEN len(ss) > 0 THEN length(ff) > 15 AND NOT contains(fe, ff) ELSE false END AS f6,
  len(list_filter(list_transform(list_filter(range(1, len(ls) + 1), lambda i: (i - 1) % greatest(1, len(ls) // 5) = 0), lambda i: lower(array_to_string(list_filter(string_split_regex(ls[i], '\s+'), lambda w: w <> '')[1:5], ' '))),
    lambda s: length(s) > 10 AND NOT contains(fs, s))) > 0 AS f7
 FROM (SELECT *, lower(regexp_replace(left(ss[len(ss)], 50), '\s+', ' ', 'g')) AS fl, lower(regexp_replace(left(ss[1], 40), '\s+', ' ', 'g')) AS ff FROM q)),
n AS (SELECT doc_id, e1 OR e2 AS none, f1::INT + f2::INT + f3::INT + f4::INT + f5::INT + f6::INT + f7::INT AS n FROM c)
SELECT doc_id, CAST(CASE WHEN none THEN 1 ELSE n END AS INTEGER) AS n_failures, round(CASE WHEN none THEN 0 ELSE greatest(0, 1 - 0.2 * n) END, 6)::DOUBLE AS score FROM n""")
def qc_local_score(spark, d):
    """The seven local checks of an extraction against its source: failures, and a score that falls by 0.2 for each."""
    text = X.text_or_empty(F.col("text"))
    left = quality.source_side(documents(spark, d).select("doc_id", text.alias("text")), "text")
    right = quality.extracted_side(documents(spark, d).select((F.col("doc_id") - 1).alias("doc_id"), text.alias("text")), "text")
    checked = quality.local_checks(left.join(right, "doc_id"))
    return checked.select("doc_id", F.size("failures").alias("n_failures"), "score")


@query(f"""SELECT doc_id, round(s, 9) AS share, CASE WHEN s >= 0.95 THEN 'verbatim' WHEN s >= 0.85 THEN 'paraphrased' ELSE 'not_verbatim' END AS fidelity, CASE WHEN s >= 0.95 THEN 'verbatim' WHEN s >= 0.8 THEN 'paraphrased' ELSE 'not_verbatim' END AS verifier
FROM (SELECT doc_id, CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 1 END AS s FROM (SELECT doc_id, {TOKENS_SQL.format('src')} AS a, {TOKENS_SQL.format('ext')} AS b FROM ({PAIRS_SQL})))""")
def verdict_thresholds(spark, d):
    """Verdicts by threshold; the two callers use different ones."""
    s = F.col("s")
    verdict = lambda low: F.when(s >= 0.95, "verbatim").when(s >= low, "paraphrased").otherwise("not_verbatim")
    rows = token_pairs(spark, d).withColumnRenamed("share", "s")
    return rows.select("doc_id", F.round("s", 9).alias("share"), verdict(0.85).alias("fidelity"), verdict(0.80).alias("verifier"))


@query(r"""SELECT page_id, length(v) AS n_chars, sha1(v) AS hash FROM (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<script[^>]*>.*?</script>', ' ', 'g'), '(?s)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS v FROM pages)""")
def html_searchable_text(spark, d):
    """What a reader sees of each page."""
    v = X.markup_text(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.length(v).cast("long").alias("n_chars"), F.sha1(v).alias("hash"))


@query(r"""SELECT page_id, label, pos FROM (SELECT page_id, regexp_extract(html, '<h1>([^<]*)', 1) AS label, CAST(strpos(html, '<h1>') AS INTEGER) AS pos FROM pages) WHERE label <> ''""")
def page_label_finder(spark, d):
    """The printed heading of each page and its place."""
    rows = table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<h1>([^<]*)", 1).alias("label"), F.instr("html", "<h1>").alias("pos"))
    return rows.filter("label <> ''")


@query(r"""WITH l AS (SELECT DISTINCT page_id, regexp_replace(regexp_replace(lower(trim(regexp_replace(regexp_extract(html, '<title>([^<]*)', 1), '\s+', ' ', 'g'))), '^([0-9]+ )+', ''), '( [0-9]+)+$', '') AS k, split_part(split_part(url, '//', 2), '/', 1) AS host FROM pages)
SELECT host, k, count(*) AS n_pages FROM l GROUP BY host, k HAVING count(*) >= 3""")
def furniture_repeat(spark, d):
    """Titles, without numbers at their ends, that a host's pages repeat: running heads are on three pages at least."""
    key = X.furniture_key(F.regexp_extract("html", "<title>([^<]*)", 1))
    rows = table(spark, d, "pages").select("page_id", key.alias("k"), F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1)).alias("host")).distinct()
    return rows.groupBy("host", "k").agg(F.count("*").alias("n_pages")).filter("n_pages >= 3")


@query("SELECT doc_id, sha256(coalesce(text, '') || '|' || coalesce(lang, '') || '|' || coalesce(source, '') || '|v1') AS key FROM documents")
def cache_key_sha256(spark, d):
    """The composite key under which a result of a text and its settings is stored."""
    return documents(spark, d).select("doc_id", X.cache_key(F.col("text"), F.col("lang"), F.col("source"), F.lit("v1")).alias("key"))


@query(f"""WITH t AS (SELECT doc_id, source, {TOKENS_SQL.format('text')} AS v FROM documents), i AS (SELECT item_id, {TOKENS_SQL.format('text')} AS v FROM benchmark),
a AS (SELECT doc_id, len(v) AS n, unnest(v) AS t FROM t), b AS (SELECT item_id, len(v) AS n, unnest(v) AS t FROM i),
c AS (SELECT a.doc_id, b.item_id, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS j FROM a JOIN b USING (t) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY j DESC, item_id) AS nth FROM c)
SELECT t.doc_id, CASE WHEN j >= 0.04 THEN item_id END AS item_id, CASE WHEN j >= 0.04 THEN round(j, 9) END AS j FROM t LEFT JOIN r ON r.doc_id = t.doc_id AND nth = 1""")
def jaccard_assign(spark, d):
    """Each document to the benchmark item with the most similar tokens, if they are similar enough, otherwise to none."""
    from ..operators.joins import jaccard_top1

    docs = documents(spark, d).select("doc_id", X.token_set(F.col("text")).alias("tokens"))
    items = table(spark, d, "benchmark").select("item_id", X.token_set(F.col("text")).alias("tokens"))
    return jaccard_top1(docs, items, "doc_id", "item_id", 0.04).withColumn("j", F.round("j", 9))
