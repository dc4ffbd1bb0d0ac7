"""Collocations: phrases that occur oftener together than their parts let expect, by suffix automata of word sequences.

Texts are lower-cased in A-Z and split at punctuation and line ends into pieces, those at blanks and tabs into words. All is counted
for each language (null: ``und``). A word is 64 bits of xxh3, seeded by its language; the table of all words shows whether two words
share a value, and if any do, the next seed is taken, so that counts are exact.

A task reads its shard in runs of about CHARS characters and builds a generalised suffix automaton over the pieces of a run: a state is a
set of substrings that end at the same places, its count is the number of those, its suffix link leads to the state of the longest
suffix that ends in more places. The links form the suffix tree of the reversed pieces, so the automaton is built by ranking
reversed contexts, one word deeper a level, and only as deep as phrases are long. States are enumerated, each with its lengths and count,
and Spark adds the counts of all shards.

Three readings, each with what the one before has shown: words; pairs of words that are frequent; longer phrases in stretches where each
pair is frequent. A phrase as frequent as ``least`` has no part that is rarer, so nothing is lost. Which words and pairs are frequent
is broadcast as a bitmap of one bit a hash value: its size follows their number up to BITS, beyond which it only lets more pass, as counts
are compared with ``least`` in the end.

Subsumption follows suffix links: a phrase is dropped for the phrase that is one word longer at either end. A longer one still that
holds it is no more frequent than the one between, which holds it too, so no further pairs need be looked at.

Nulls: a null text is empty; null languages count as ``und``. Empty texts and pieces: no words. Very long texts: whole. Ties: by phrase in byte order
at last. Repeated rows and equal or missing ids: each row counts. Empty table: empty result. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, cut, drop_cut, only, partitions, release

WORDS = 4
#: Characters of a run, and bits of the bitmaps at most and for each value.
CHARS, BITS, BITS_EACH = 4_000_000, 1 << 28, 16
#: Bits in one value of ``bitmap_construct_agg``.
PIECE_BITS = 8 * 4096
_DELIMITERS = b".,;:!?\n\x0b\x0c\r"
_TO_BREAK = bytes.maketrans(b".,;:!?", b"\n" * 6)
_BREAK, _SPACE = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[list(_DELIMITERS)] = True
_SPACE[[9, 32, *_DELIMITERS]] = True


class Run:
    """The words of many texts: ``hash``, and ``fresh`` where one begins a piece. ``langs`` are the texts' languages."""

    def __init__(self, texts: list[str | None], langs: list[str | None], seed: int):
        import xxhash

        order = sorted(range(len(texts)), key=lambda k: langs[k] or "und")
        raw = [b"" if texts[k] is None else texts[k].encode("utf-8", "surrogatepass").lower() for k in order]
        names = [langs[k] if langs[k] is not None else "und" for k in order]
        data = b"\n".join(raw) + b"\n"
        buf = np.frombuffer(data, np.uint8)
        word = ~_SPACE[buf]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        start = np.flatnonzero(begins)
        piece = np.cumsum(_BREAK[buf])[start]
        self.words = data.translate(_TO_BREAK).split()  # the same words: bytes are split at blanks, tabs and line ends
        self.fresh = np.diff(piece, prepend=-1) > 0
        first = np.searchsorted(start, np.cumsum([len(r) + 1 for r in raw]))  # the end of each text
        del buf, word, begins, start, piece
        self.lang: list[tuple[str, int, int]] = []  # language, its first word, the end of its words
        self.hash = np.zeros(len(self.words), np.uint64)
        begin = 0
        for name in dict.fromkeys(names):
            end = int(first[len(names) - 1 - names[::-1].index(name)])
            own = xxhash.xxh3_64_intdigest(name.encode(), seed)
            self.hash[begin:end] = np.fromiter((xxhash.xxh3_64_intdigest(w, own) for w in self.words[begin:end]), np.uint64, end - begin)
            self.lang.append((name, begin, end))
            begin = end


class SuffixAutomaton:
    """Of sequences of words, as deep as ``depth``; ``words``: their hashes, ``fresh``: where a sequence begins.

    State k: ``end`` of its first occurrence, ``count`` of the places where its substrings end, its ``longest`` and, by its link, its
    ``shortest`` substring. ``link`` is -1 for the root.
    """

    def __init__(self, words: np.ndarray, fresh: np.ndarray, depth: int):
        at = np.arange(len(words))
        room = at - np.maximum.accumulate(np.where(fresh, at, 0)) + 1 if len(words) else at  # words of the sequence up to here
        alphabet, rank = np.unique(words, return_inverse=True)
        node, parents, ends, counts, lengths, base = rank, [], [], [], [], 0
        for k in range(1, depth + 1):
            if k > 1:  # one word further back
                inside = room[at] >= k
                at, node = at[inside], node[inside]
                key = (node - base).astype(np.uint64) * np.uint64(len(alphabet)) + rank[at - k + 1].astype(np.uint64)
                base += len(counts[-1])
            else:
                key = rank.astype(np.uint64)
            names, first, inverse, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            parents.append(node[first] if k > 1 else np.full(len(names), -1))
            node = base + inverse
            ends.append(at[first])
            counts.append(count)
            lengths.append(np.full(len(names), k))
        parent, end, count, length = map(np.concatenate, (parents, ends, counts, lengths))
        # a node whose one extension is as frequent ends where that does: both are one state
        below = parent >= 0
        merged = np.zeros(len(count), bool)
        merged[parent[below][count[below] == count[parent[below]]]] = True
        top = parent.copy()  # of each node, the nearest node on its way to the root that is a state of its own
        for _ in range(depth - 1):
            again = (top >= 0) & merged[np.maximum(top, 0)]
            top[again] = parent[top[again]]
        states = np.flatnonzero(~merged)
        number = np.full(len(count) + 1, -1)
        number[states] = np.arange(len(states))
        self.end, self.count, self.longest = end[states], count[states], length[states]
        self.link = number[top[states]]
        self.shortest = np.where(self.link >= 0, self.longest[np.maximum(self.link, 0)], 0) + 1

    def substrings(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """end, length, count of all substrings of at least so many words: those of each state, which all have its count."""
        low = np.maximum(self.shortest, least)
        n = np.maximum(self.longest - low + 1, 0)
        state = np.repeat(np.arange(len(n)), n)
        length = low[state] + np.arange(len(state)) - np.repeat(np.cumsum(n) - n, n)
        return self.end[state], length, self.count[state]


def _in_bitmap(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _pair_slot(first, second, mask: int):
    """Of a pair's hash values, in numpy or as columns."""
    if isinstance(first, np.ndarray):
        return ((first >> np.uint64(29)) ^ second) & np.uint64(mask)
    return F.shiftrightunsigned(first, 29).bitwiseXOR(second).bitwiseAND(F.lit(mask))


def _bitmap(values: DataFrame, slot) -> tuple[np.ndarray, int]:
    """A bitmap of ``slot(mask)`` of the rows, of bounded size, and the mask."""
    n = values.count()
    mask = min(BITS, max(PIECE_BITS, 1 << (n * BITS_EACH).bit_length())) - 1
    rows = values.select(slot(mask).alias("slot"))
    pieces = rows.groupBy(F.floor(F.col("slot") / PIECE_BITS).alias("piece")).agg(F.bitmap_construct_agg(F.col("slot") % PIECE_BITS).alias("bits"))
    bits = np.zeros((mask + 1) // 8, np.uint8)
    for row in pieces.toLocalIterator():  # BITS / 8 bytes in all, at most
        bits[row.piece * 4096 : (row.piece + 1) * 4096] = np.frombuffer(row.bits, np.uint8)
    return bits, mask


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _read(docs: DataFrame, columns: str, seed: int, of_run) -> DataFrame:
    """What ``of_run`` makes of the runs of each task: Arrow columns."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(frames):
        chars, texts, langs = 0, [], []
        for batch in frames:
            frame = batch.to_pandas()
            for part in batches([frame], CHARS):
                texts += part["text"].tolist()
                langs += [x if isinstance(x, str) else None for x in part["lang"]]
                chars += int(part["text"].str.len().fillna(0).sum())
                if chars >= CHARS:
                    yield pa.record_batch(of_run(Run(texts, langs, seed)), names=names)
                    chars, texts, langs = 0, [], []
                    release()
        if texts:
            yield pa.record_batch(of_run(Run(texts, langs, seed)), names=names)
        texts, langs = [], []
        release()

    return only(docs, text="string", lang="string").mapInArrow(run, columns)


def word_counts(docs: DataFrame, seed: int = 0) -> DataFrame:
    """w, lang, word, n, clash: how often each word occurs, and for each language a row of the word '' that has their sum.

    ``clash`` says that another word has the same value ``w``.
    """

    def of_run(run: Run):
        import xxhash

        names, first, count = np.unique(run.hash, return_index=True, return_counts=True)
        words = [run.words[k].decode("utf-8", "surrogatepass") for k in first.tolist()]
        ends = np.array([end for _, _, end in run.lang])
        langs = np.array([name for name, _, _ in run.lang], object)[np.searchsorted(ends, first, "right")].tolist() if len(first) else []
        sums = [(xxhash.xxh3_64_intdigest(b"", xxhash.xxh3_64_intdigest(name.encode(), seed)), name, end - begin) for name, begin, end in run.lang]
        values = np.concatenate([names, np.array([w for w, _, _ in sums], np.uint64)])
        return [_signed(values), pa.array(langs + [x for _, x, _ in sums], pa.string()), pa.array(words + [""] * len(sums), pa.string()), pa.array(np.concatenate([count, [n for _, _, n in sums]]).astype(np.int64))]

    name = F.struct("lang", "word")
    rows = _read(docs, "w long, lang string, word string, n long", seed, of_run)
    found = rows.groupBy("w").agg(F.min(name).alias("name"), F.max(name).alias("other"), F.sum("n").alias("n"))
    return found.select("w", "name.lang", "name.word", "n", (F.col("name") != F.col("other")).alias("clash"))


def phrase_counts(docs: DataFrame, least: int, most: int = WORDS) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """words (w, lang, word, n) and phrases (gram, f), each as frequent as ``least``, and the tables to drop when they are read.

    ``words`` also has the rows of the sums. ``gram`` are the values of 1 to ``most`` words.
    """
    seed = 0
    words = cut(word_counts(docs, seed).filter(f"n >= {least} or clash or word = ''"))
    while not words.filter("clash").isEmpty():
        drop_cut(words)
        seed += 1
        words = cut(word_counts(docs, seed).filter(f"n >= {least} or clash or word = ''"))
    single = words.filter(f"word <> '' and n >= {least}")
    bits, mask = _bitmap(single, lambda m: F.col("w").bitwiseAND(F.lit(m)))
    shared = docs.sparkSession.sparkContext.broadcast((bits, mask))

    def pairs(run: Run):
        bits, mask = shared.value
        often = _in_bitmap(bits, run.hash & np.uint64(mask))
        # a sequence also begins after a word that is rare
        fresh = run.fresh | np.concatenate([[True], ~often[:-1]])[: len(often)]
        words, fresh = run.hash[often], fresh[often]
        end, _, count = SuffixAutomaton(words, fresh, 2).substrings(2)
        return [_signed(words[end - 1]), _signed(words[end]), pa.array(count.astype(np.int64))]

    two = _read(docs, "w1 long, w2 long, n long", seed, pairs).groupBy("w1", "w2").agg(F.sum("n").alias("f"))
    two = cut(two.filter(f"f >= {least}"))
    bits2, mask2 = _bitmap(two, lambda m: _pair_slot(F.col("w1"), F.col("w2"), m))
    shared2 = docs.sparkSession.sparkContext.broadcast((bits2, mask2))
    longer = [f"w{k}" for k in range(1, most + 1)]

    def phrases(run: Run):
        bits, mask = shared2.value
        joined = np.zeros(len(run.hash), bool)  # with the word before, as a pair that may be frequent
        joined[1:] = ~run.fresh[1:] & _in_bitmap(bits, _pair_slot(run.hash[:-1], run.hash[1:], mask))
        kept = joined.copy()
        kept[:-1] |= joined[1:]
        words, fresh = run.hash[kept], ~joined[kept]
        end, length, count = SuffixAutomaton(words, fresh, most).substrings(3)
        columns = [pa.array(words[np.minimum(end - length + 1 + k, len(words) - 1)].view(np.int64), mask=length <= k) for k in range(most)]
        return [*columns, pa.array(count.astype(np.int64))]

    tables = [words, two]
    grams = [single.select(F.array("w").alias("gram"), F.col("n").alias("f"))]
    if most >= 2:
        grams.append(two.select(F.array("w1", "w2").alias("gram"), "f"))
    if most >= 3:
        many = _read(docs, ", ".join(f"{c} long" for c in longer) + ", n long", seed, phrases).groupBy(*longer).agg(F.sum("n").alias("f"))
        many = cut(many.filter(f"f >= {least}"))
        tables.append(many)
        grams.append(many.select(F.array_compact(F.array(*longer)).alias("gram"), "f"))
    found = grams[0]
    for more in grams[1:]:
        found = found.unionByName(more)
    return words, found, tables


def mine(docs: DataFrame, least: int = 30, top: int = 2000, most: int = WORDS, percent: int = 80) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language the first ``top`` phrases of 2 to ``most`` words.

    ``docs``: text, lang. a, l, r: occurrences of the phrase and of the parts of its lowest-scoring cut; score: floor(2000000 a / (l + r)).
    A phrase is left out if a longer one that holds it has ``percent`` of its occurrences.
    """
    words, grams, tables = phrase_counts(docs, least, most)
    words = words.withColumnRenamed("n", "f")
    phrases = grams.filter(F.size("gram") > 1).withColumnRenamed("f", "a")
    # suffix link and prefix of each phrase: the phrases that it may take the place of
    held = phrases.filter(F.size("gram") > 2).select(F.explode(F.array(F.expr("slice(gram, 2, size(gram) - 1)"), F.expr("slice(gram, 1, size(gram) - 1)"))).alias("gram"), F.col("a").alias("longer"))
    held = held.groupBy("gram").agg(F.max("longer").alias("longer"))
    kept = phrases.join(held, "gram", "left").filter(f"longer is null or 100 * longer < {percent} * a").select("gram", "a")

    parts = F.expr("flatten(transform(sequence(1, size(gram) - 1), k -> array(named_struct('k', k, 'left', true, 'part', slice(gram, 1, k)), named_struct('k', k, 'left', false, 'part', slice(gram, k + 1, size(gram) - k)))))")
    asked = kept.select("gram", "a", F.inline(parts))
    told = asked.join(grams.withColumnRenamed("gram", "part"), "part")
    cuts = [(F.max(F.when((F.col("k") == k) & F.col("left"), F.col("f"))).alias(f"l{k}"), F.max(F.when((F.col("k") == k) & ~F.col("left"), F.col("f"))).alias(f"r{k}")) for k in range(1, most)]
    told = told.groupBy("gram", "a").agg(*[c for pair in cuts for c in pair])
    score = lambda k: F.expr(f"(cast(a as decimal(20, 0)) * 2000000) div (cast(l{k} as decimal(20, 0)) + r{k})")
    best = F.array_min(F.array_compact(F.array(*[F.when(F.col(f"l{k}").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, most)])))
    scored = told.select("gram", "a", best.alias("b")).select("gram", "a", "b.l", "b.r", "b.score")
    first = words.select(F.col("w").alias("_w"), "lang")
    scored = cut(scored.join(first, F.col("_w") == F.get("gram", F.lit(0))).drop("_w"))

    # ranks in shares of a language first, with all ties, then among what is left
    share = F.pmod(F.xxhash64("gram"), F.lit(partitions(docs.sparkSession)))
    by_score = [F.col("score").desc(), F.col("a").desc()]
    some = scored.withColumn("share", share).withColumn("nth", F.rank().over(Window.partitionBy("lang", "share").orderBy(*by_score))).filter(f"nth <= {top}")
    spelt = some.select("lang", "share", "gram", "a", "l", "r", "score", F.posexplode("gram").alias("at", "w")).join(words.select("w", "word"), "w")
    spelt = spelt.groupBy("lang", "share", "gram", "a", "l", "r", "score").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    some = spelt.withColumn("nth", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*by_score, "phrase"))).filter(f"nth <= {top}")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by_score, "phrase")).cast("long")).filter(f"rank <= {top}")
    sums = words.filter("word = ''").select("lang", F.col("f").alias("n"))
    return ranked.join(F.broadcast(sums) if sums.count() <= 10_000 else sums, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
