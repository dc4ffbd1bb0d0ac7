"""The training-data queries and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, fingerprint, hamming, importance, jaccard_join, mixing, ngram_lm, packing, repeats, token_count, toxicity, warc
from .common import held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest sign codes of each vector whose id is divisible by 50, among all vectors."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), hamming.sign_code(F.col("embedding")).alias("code"))
    return hamming.search(rows, rows.filter("id % 50 = 0"), 10)


HAMMING_SQL = """
WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings WHERE len(embedding) > 0),
d AS (SELECT q.vec_id AS query_id, r.vec_id AS neighbor_id, CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN q.bits[i] <> r.bits[i] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
      FROM b q JOIN b r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbor_id, distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM d) WHERE rank <= 10
"""


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, sources weighing 5, 2, 1 in turn; within a source odds double from 8, 64 and 512 words on."""
    docs = table(spark, sf_dir, "documents")
    size = mixing.word_count(F.col("text"))
    odds = F.when(size < 8, 1.0).when(size < 64, 2.0).when(size < 512, 4.0).otherwise(8.0)
    return mixing.mix(docs.withColumn("_odds", odds), odds_col="_odds").select("doc_id", "size", "source_size", "target", "taken")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; labels are learnt from those whose crc32 modulo 5 is not 0."""
    docs, out = table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 0)
    lexicon = toxicity.train(table(spark, sf_dir, "labels").filter(~out), docs)
    scored = toxicity.score(docs.select("doc_id", "text"), lexicon)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, five words a shingle, similarity of 0.8 or more."""
    return jaccard_join.link_documents(table(spark, sf_dir, "documents"))


def byte_bpe() -> tuple[str, str]:
    """The file of ranks and the pattern that splits a text before it: the vocabulary of byte_bpe_50k.json.

    The ids are those that the library ``tokenizers`` gives with that file, where a special token's string in a text is ordinary
    text (``encode_special_tokens``), as the tokenizers' README sets it; tiktoken takes less time for them.
    """
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, in windows of 2048 tokens."""
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), *byte_bpe(), digest=packing.crc32, digest_type="long")
    return pieces.select("doc_id", "start", "length", F.col("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; those whose crc32 modulo 5 is 1 are held out."""
    out = held_out(F.col("doc_id"), 1)
    scores = ngram_lm.score(table(spark, sf_dir, "documents"), ~out)
    return scores.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with the pieces and scores of the 32k vocabulary taken as a unigram model (its own BPE merges count differently)."""
    import public_tokenizers

    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, windows of 13 words."""
    return repeats.find_repeats(table(spark, sf_dir, "documents"))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and their edited texts."""
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def crawl_records(pages: DataFrame) -> DataFrame:
    """Two records of each page: its full response, and a later revisit whose validators agree, contradict or are missing."""
    url = F.when(F.col("page_id") % 7 == 0, F.regexp_replace("url", "[#?].*$", "")).otherwise(F.col("url"))
    date = lambda c: F.concat(F.lit("day "), (c / 86400).cast("long").cast("string"))
    t, u = F.col("page_id") * 600, F.col("page_id") * 600 + 300 + (F.col("page_id") % 5) * 86400
    tag, text = F.concat(F.lit('"'), F.md5("html"), F.lit('"')), F.length("html").cast("string")
    full = F.map_from_arrays(
        F.array(*map(F.lit, ["content-type", "content-length", "date", "etag", "last-modified", "set-cookie"])),
        F.array(F.lit("text/html"), text, date(t), F.when(F.col("page_id") % 3 != 1, tag), date(t), F.lit("a=1")),
    )
    etag = F.when(F.col("page_id") % 11 == 0, F.lit('"other"')).when(F.col("page_id") % 4 == 0, F.concat(F.lit("W/"), tag)).when(F.col("page_id") % 4 == 1, tag)
    again = F.map_from_arrays(
        F.array(*map(F.lit, ["date", "etag", "last-modified", "cache-control", "set-cookie", "x-cache"])),
        F.array(date(u), etag, F.when(F.col("page_id") % 2 == 0, date(t)), F.lit("max-age=60"), F.lit("a=2"), F.lit("hit")),
    )
    some = lambda m: F.map_filter(m, lambda _, v: v.isNotNull())
    name = lambda x: F.concat(F.lit(x), F.col("page_id").cast("string"))
    return pages.select(F.inline(F.array(
        F.struct(name("full-").alias("record_id"), F.col("url").alias("url"), t.alias("ts"), F.lit(200).alias("status"), some(full).alias("headers")),
        F.struct(name("again-").alias("record_id"), url.alias("url"), u.alias("ts"), F.lit(304).alias("status"), some(again).alias("headers")),
    )))


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The revisits among all pages' records, with their merged headers as lines."""
    found = warc.resolve_revisits(crawl_records(table(spark, sf_dir, "pages")))
    lines = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return found.select("record_id", "url_key", "ts", "target_id", "verdict", lines.alias("headers"))


WARC_SQL = r"""
WITH p AS (
  SELECT page_id, url, CASE WHEN page_id % 7 = 0 THEN regexp_replace(url, '[#?].*$', '') ELSE url END AS url2, page_id * 600 AS t, page_id * 600 + 300 + (page_id % 5) * 86400 AS u,
    '"' || md5(html) || '"' AS tag, CAST(length(html) AS VARCHAR) AS size FROM pages),
rec AS (
  SELECT 'full-' || page_id AS record_id, url, t AS ts, 200 AS status, CASE WHEN page_id % 3 <> 1 THEN tag END AS etag, 'day ' || (t // 86400) AS lm, 'day ' || (t // 86400) AS date, size FROM p
  UNION ALL
  SELECT 'again-' || page_id, url2, u, 304, CASE WHEN page_id % 11 = 0 THEN '"other"' WHEN page_id % 4 = 0 THEN 'W/' || tag WHEN page_id % 4 = 1 THEN tag END,
    CASE WHEN page_id % 2 = 0 THEN 'day ' || (t // 86400) END, 'day ' || (u // 86400), NULL FROM p),
a AS (SELECT *, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS x FROM rec),
b AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(x, '^[^/?]*')), ':(80|443)$', ''), '^(www|m)\.', '') AS host, regexp_replace(x, '^[^/?]*', '') AS rest FROM a),
c AS (SELECT *, regexp_replace(regexp_extract(rest, '^[^?]*'), '/+$', '') AS path,
        regexp_replace(regexp_replace(regexp_replace(rest, '^[^?]*', ''), '(^[?]|&)(utm_[a-z]+|ref|gclid|fbclid)=[^&]*', '', 'g'), '^[?&]+', '') AS query FROM b),
k AS (SELECT record_id, host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS url_key, ts, status, etag, lm, date, size FROM c),
m AS (SELECT n.record_id, n.url_key, n.ts, n.etag AS e2, n.lm AS l2, n.date AS d2, f.record_id AS target_id, f.etag AS e1, f.lm AS l1, f.size AS size,
        row_number() OVER (PARTITION BY n.record_id ORDER BY f.ts DESC NULLS LAST, f.record_id DESC) AS nth
      FROM k n LEFT JOIN k f ON f.status = 200 AND f.url_key = n.url_key AND f.ts <= n.ts WHERE n.status = 304),
v AS (SELECT *, CASE WHEN target_id IS NULL THEN 'missing'
        WHEN e1 IS NOT NULL AND e2 IS NOT NULL THEN CASE WHEN regexp_replace(e1, '^W/', '') = regexp_replace(e2, '^W/', '') THEN 'resolved' ELSE 'changed' END
        WHEN l1 IS NOT NULL AND l2 IS NOT NULL THEN CASE WHEN l1 = l2 THEN 'resolved' ELSE 'changed' END ELSE 'unchecked' END AS verdict FROM m WHERE nth = 1)
SELECT record_id, url_key, ts, target_id, verdict, CASE WHEN verdict IN ('resolved', 'unchecked') THEN concat_ws(chr(10), 'cache-control: max-age=60', 'content-length: ' || size, 'content-type: text/html', 'date: ' || d2,
  'etag: ' || coalesce(e2, e1), 'last-modified: ' || coalesce(l2, l1), 'set-cookie: a=1') END AS headers FROM v
"""


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, drawn towards all benchmark texts by words in 10,000 buckets."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


IMPORTANCE_SQL = r"""
WITH bit AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc),
low AS (SELECT 0 AS kind, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
        UNION ALL SELECT 1, NULL, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
w AS (SELECT kind, doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM low),
u AS (SELECT DISTINCT word, hex(encode(word)) AS h FROM w),
b AS (SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
        lambda c, x: xor(crc[(xor(c, x) & 255) + 1], c >> 8))) % 10000 AS bucket FROM u, bit),
f AS (SELECT kind, doc_id, bucket FROM w JOIN b USING (word)),
n AS (SELECT bucket, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM f GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln(((t::DOUBLE + 1) * ((SELECT count(*) FROM f WHERE kind = 0)::DOUBLE + 10000)) / ((s::DOUBLE + 1) * ((SELECT count(*) FROM f WHERE kind = 1)::DOUBLE + 10000)))) AS BIGINT) AS gain FROM n),
d AS (SELECT doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN g USING (bucket) WHERE kind = 0 GROUP BY doc_id),
s AS (SELECT documents.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || documents.doc_id), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
      FROM documents LEFT JOIN d USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS total FROM s WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN rank <= 10 * total // 100 THEN rank END AS rank FROM s LEFT JOIN r USING (doc_id)
"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, phrases of 2 to 4 words that occur 30 times or more."""
    return collocations.mine(table(spark, sf_dir, "documents"))


COLLOCATIONS_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
o AS (SELECT lang, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])) AS gram FROM w, (SELECT unnest([1, 2, 3, 4]) AS k)),
g AS (SELECT lang, gram, count(*) AS f FROM o GROUP BY lang, gram),
f AS (SELECT * FROM g WHERE f >= 30 OR len(gram) = 1),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len(gram) = 1 GROUP BY lang),
c AS (SELECT lang, gram, f AS a FROM f WHERE len(gram) >= 2 AND f >= 30),
h AS (SELECT lang, gram[i:j] AS part, a FROM (SELECT lang, gram, a, i, unnest(range(i + 1, len(gram) + 1)) AS j FROM (SELECT *, unnest(range(1, len(gram))) AS i FROM c)) WHERE j - i + 1 < len(gram)),
s AS (SELECT lang, part AS gram, max(a) AS longer FROM h GROUP BY lang, part),
k AS (SELECT c.*, unnest(range(1, len(c.gram))) AS k FROM c LEFT JOIN s ON s.lang = c.lang AND s.gram = c.gram WHERE longer IS NULL OR 100 * longer < 80 * a),
x AS (SELECT k.lang, k.gram, a, k, l.f AS l, r.f AS r, CAST(2000000::HUGEINT * a // (l.f + r.f) AS BIGINT) AS score FROM k
      JOIN f l ON l.lang = k.lang AND l.gram = k.gram[1:k] JOIN f r ON r.lang = k.lang AND r.gram = k.gram[k + 1:]),
b AS (SELECT *, array_to_string(gram, ' ') AS phrase FROM x QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b JOIN n USING (lang) QUALIFY rank <= 2000
"""


def byte_bpe_file() -> str:
    """The tokenizer's file with its merges, on each executor."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again; a special token's string in a text is that token, as the library has it by default."""
    path = byte_bpe_file()
    both = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return both.select("doc_id", F.floor(F.length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_hamming_topk, op2_mixing, op3_toxicity, op4_jaccard_join, op5_packing, op6_lm_scoring, op7_token_counts, op8_substring_dedup, op9_fingerprint, op10_warc_revisits, op11_importance, op12_collocations, op13_bpe, pipeline)}


MIXING_SQL = """
WITH counted AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sized AS (SELECT *, CASE WHEN size < 8 THEN 1.0::DOUBLE WHEN size < 64 THEN 2.0::DOUBLE WHEN size < 512 THEN 4.0::DOUBLE ELSE 8.0::DOUBLE END AS wish FROM counted),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS nth FROM sized GROUP BY source),
b AS (SELECT *, CASE (nth - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 3.0::DOUBLE * source_size AS bound FROM per),
r AS (SELECT *, coalesce(sum(bound) OVER (ORDER BY bound / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bounds,
        sum(weight) OVER (ORDER BY bound / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
        CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM b),
t AS (SELECT source, source_size, coalesce(least(bound, weight * (SELECT max((total - bounds) / open) FROM r WHERE bound / weight > (total - bounds) / open)), bound) AS target FROM r),
g AS (SELECT source, wish, sum(size) AS words FROM sized WHERE size > 0 GROUP BY ALL),
v AS (SELECT g.source, wish, (t.target - 3.0::DOUBLE * coalesce(sum(words) OVER (PARTITION BY g.source ORDER BY wish DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(wish * words) OVER (PARTITION BY g.source ORDER BY wish DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM g JOIN t ON t.source IS NOT DISTINCT FROM g.source),
l AS (SELECT source, max(level) AS level FROM v WHERE level * wish <= 3 GROUP BY source),
s AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CASE WHEN t.target > 0 THEN least(coalesce(l.level * d.wish, 3.0::DOUBLE), 3.0::DOUBLE) ELSE 0 END AS share,
        (('0x' || substr(md5('17:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
      FROM sized d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN l ON l.source IS NOT DISTINCT FROM d.source),
k AS (SELECT *, floor(share) AS whole, share - floor(share) AS p FROM s),
o AS (SELECT *, CASE WHEN p <= 0 THEN 1.0::DOUBLE ELSE (u / (1 - u)) / (p / (1 - p)) END AS odds, share < 3 AND size > 0 AS can,
        sum(whole * size) OVER (PARTITION BY source) AS sure FROM k),
w AS (SELECT *, sum(CASE WHEN can THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY odds, doc_id, size ROWS UNBOUNDED PRECEDING) AS run FROM o)
SELECT doc_id, size, source_size, target, CAST((whole + CASE WHEN can AND p > 0 AND run - size / 2.0 <= target - sure THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM w
"""


JACCARD_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) ELSE [array_to_string(ws, ' ')] END)) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE k >= 0.8 * (x.n + y.n - k) - 1e-9),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT c.doc_id, c.class_id, coalesce(d.n, 0) AS n_links FROM (SELECT a AS doc_id, min(b) AS class_id FROM r GROUP BY a) c LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY a) d ON d.a = c.doc_id
"""

REPEATS_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
m AS (SELECT win, min(doc_id) AS low FROM g GROUP BY win),
gone AS (SELECT DISTINCT doc_id, i + k AS j FROM (SELECT g.doc_id, g.i, unnest(range(13)) AS k FROM g JOIN m ON m.win = g.win AND m.low < g.doc_id)),
u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM w),
k AS (SELECT u.doc_id, count(*) AS n, count(gone.j) AS lost, string_agg(word, ' ' ORDER BY u.j) FILTER (gone.j IS NULL) AS kept FROM u LEFT JOIN gone ON gone.doc_id = u.doc_id AND gone.j = u.j GROUP BY u.doc_id)
SELECT w.doc_id, coalesce(n, 0) AS n_words, coalesce(lost, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_hamming_topk": HAMMING_SQL, "op2_mixing": MIXING_SQL, "op4_jaccard_join": JACCARD_SQL, "op8_substring_dedup": REPEATS_SQL, "op10_warc_revisits": WARC_SQL, "op11_importance": IMPORTANCE_SQL, "op12_collocations": COLLOCATIONS_SQL}
