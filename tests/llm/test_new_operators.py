"""Importance resampling, collocations and BPE against brute force, with all odd cases."""

import codecs
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from docweft.llm import bpe, collocations, importance
from docweft.llm.queries import byte_bpe_file

from . import data

LOW = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
COLUMNS = ("doc_id", "n_features", "weight", "score", "rank")


def some(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


# ---------------------------------------------------------------- 11


def plain_features(text, n):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def plain_resample(docs, target, n, percent=10, least=20):
    features = [(d, *plain_features(t, n)) for d, t in docs]
    raw, want = Counter(b for _, _, f in features for b in f), Counter(b for t in target for b in plain_features(t, n)[1])
    s, t = sum(raw.values()), sum(want.values())
    gain = [math.floor(1000 * math.log(((want[b] + 1) * (s + 10_000)) / ((raw[b] + 1) * (t + 10_000)))) for b in range(10_000)]
    rows = []
    for d, n_words, f in features:
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words])
    enough = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], -r[1]))
    ranks = {id(r): k + 1 for k, r in enumerate(enough[: percent * len(enough) // 100])}
    return sorted(((*r[:4], ranks.get(id(r))) for r in rows), key=str)


@pytest.mark.parametrize("n, percent", [(1, 10), (2, 50)])
def test_resampling(spark, n, percent):
    docs = data.documents(spark)
    target = spark.createDataFrame([("lotas LOTAS mines x",), (None,), ("",), (data.texts()[3],)], "text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = plain_resample(rows, [r.text for r in target.collect()], n, percent)
    assert some(importance.resample(docs, target, n, percent=percent), *COLUMNS) == want


def test_resampling_in_many_ranges(spark, monkeypatch):
    """Ranges of few rows, and a third of all rows alike."""
    monkeypatch.setattr(importance, "RANGE_ROWS", 10)
    rows = [(k, f"{'kata ' * 25}{k % 7}") for k in range(100)] + [(5, "lone " * 30)] * 50
    target = spark.createDataFrame([("lone kata",)], "text string")
    got = some(importance.resample(spark.createDataFrame(rows, "doc_id long, text string"), target, percent=40), *COLUMNS)
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 61))
    assert [r[:4] for r in got] == [r[:4] for r in plain_resample(rows, ["lone kata"], 1, 40)]


def test_resampling_of_nothing(spark):
    target = spark.createDataFrame([], "text string")
    assert importance.resample(data.empty(spark), target).collect() == []
    rows = [(1, "a b"), (2, None)]
    assert some(importance.resample(spark.createDataFrame(rows, "doc_id long, text string"), target, least=1), *COLUMNS) == plain_resample(rows, [], 1, least=1)


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_automaton_reads_words_as_bytes(kind):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aZé 9-_\n\x00漢") for _ in range(rng.randint(0, 200))) for _ in range(80)] + ["w" * 500, "", "ab" * 40 + " c"]
    for part in (pa.array(texts, kind), pa.array(["skipped", *texts], kind).slice(1)):
        words = importance.Words(part)
        for k, (at, crc) in enumerate(words.features(2)):
            limits = np.searchsorted(at, words.first)
            for j, text in enumerate(texts):
                w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOW))
                want = [zlib.crc32(" ".join(w[i : i + k + 1]).encode()) for i in range(len(w) - k)]
                assert crc[limits[j] : limits[j + 1]].tolist() == want


# ---------------------------------------------------------------- 12


def plain_phrases(docs, least, top=2000, most=4):
    f = defaultdict(Counter)
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            for k in range(1, most + 1):
                f["und" if lang is None else lang].update(w[i : i + k] for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        n = sum(c for g, c in count.items() if len(g) == 1)
        often = {g: a for g, a in count.items() if len(g) > 1 and a >= least}
        longer = Counter()
        for g, a in often.items():
            for part in {g[i:j] for i in range(len(g)) for j in range(i + 2, len(g) + 1) if j - i < len(g)}:
                longer[part] = max(longer[part], a)
        rows = []
        for g, a in often.items():
            if 100 * longer[g] < 80 * a or not longer[g]:
                score, _, l, r = min((math.floor(Fraction(2_000_000 * a, count[g[:k]] + count[g[k:]])), k, count[g[:k]], count[g[k:]]) for k in range(1, len(g)))
                rows.append((-score, -a, " ".join(g).encode(), l, r))
        out += [(lang, k + 1, p.decode(), -a, l, r, n, -s) for k, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out, key=str)


PHRASE_COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize("chars, least, top", [(6_000_000, 2, 2000), (500, 3, 7)])
def test_collocations(spark, monkeypatch, chars, least, top):
    """In one run a task and in many, with phrases that cross texts, pieces and languages if anything were mixed up."""
    monkeypatch.setattr(collocations, "CHARS", chars)
    docs = data.documents(spark)
    rng = random.Random(7)
    more = [(" ".join(rng.choice(["to", "be", "or", "not", "é.", "A"]) for _ in range(rng.randint(0, 30))), rng.choice(["en", "fr", None, "und"])) for _ in range(200)]
    docs = docs.unionByName(spark.createDataFrame(more, "text string, lang string"), allowMissingColumns=True)
    want = plain_phrases([(r.lang, r.text) for r in docs.collect()], least, top)
    assert want and some(collocations.mine(docs, least, top), *PHRASE_COLUMNS) == want


def test_collocations_of_nothing(spark):
    assert collocations.mine(data.empty(spark)).collect() == []
    assert collocations.mine(spark.createDataFrame([(None, None), ("", "en"), ("once", "en")], "text string, lang string")).collect() == []


def test_automaton_counts_ends(spark):
    """Each substring is in one state, whose count is that of its places; a state's link is its longest suffix that ends elsewhere too."""
    rng = random.Random(1)
    words = np.array([rng.randrange(3) for _ in range(300)], np.uint64)
    fresh = np.array([k == 0 or rng.random() < 0.1 for k in range(300)])
    want, begin = Counter(), 0
    for k in range(300):
        begin = k if fresh[k] else begin
        want.update(tuple(words[j : k + 1].tolist()) for j in range(max(begin, k - 3), k + 1))
    automaton = collocations.SuffixAutomaton(words, fresh, 4)
    end, length, count = automaton.substrings(1)
    got = Counter({tuple(words[e - n + 1 : e + 1].tolist()): c for e, n, c in zip(end.tolist(), length.tolist(), count.tolist())})
    assert got == want and len(end) == len(want)
    for k, link in enumerate(automaton.link.tolist()):
        if link >= 0:
            n = int(automaton.longest[link])
            a, b = (int(automaton.end[x]) for x in (k, link))
            assert words[a - n + 1 : a + 1].tolist() == words[b - n + 1 : b + 1].tolist() and automaton.count[link] > automaton.count[k]


# ---------------------------------------------------------------- 13


@pytest.fixture(scope="module")
def merges():
    return bpe.Merges(byte_bpe_file())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(byte_bpe_file())
    found.no_truncation()
    found.no_padding()
    return found


def odd_texts():
    rng = random.Random(11)
    letters = "aeiourstn'  \n\t.,0123é漢字🙂 　‍ߊ़"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 300))) for _ in range(300)]
    return made + [t or "" for t in data.texts()] + ["<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext", "I'll don't 'S", "\r\n \r\n", "\x00\x1c\x85"]


def test_ids_are_the_library_s(spark, library):
    texts = odd_texts()
    encoded = bpe.encode(spark.createDataFrame([*enumerate(texts), (None, None)], "doc_id long, text string"), byte_bpe_file())
    rows = {r.doc_id: (np.frombuffer(r.ids, "<u4").tolist(), r.text) for r in bpe.decode(encoded, byte_bpe_file()).collect()}
    assert rows.pop(None) == ([], "") and len(rows) == len(texts)
    for k, text in enumerate(texts):
        ids = library.encode(text, add_special_tokens=False).ids
        assert rows[k] == (ids, library.decode(ids, skip_special_tokens=False)), text


def test_long_pieces_in_constant_memory(merges, library):
    """One piece of hundreds of thousands of bytes: the window stays small, the ids are those of the whole."""
    rng = random.Random(2)
    for text in ("a" * 100_000, "".join(rng.choice("etaoinshr") for _ in range(60_000)), "-=" * 40_000, "é" * 30_000):
        raw, coder, out = text.encode(), bpe.Transducer(merges), []
        for k in range(0, len(raw), 1000):
            out += coder.feed(raw[k : k + 1000])
            assert len(coder.held) <= 2 * coder.window
        assert out + coder.finish() == library.encode(text, add_special_tokens=False).ids


def test_lookahead_suffices(merges, monkeypatch):
    """Windows of the least size emit what the whole gives, fed byte by byte."""
    rng = random.Random(4)
    raw = "".join(rng.choice("the andring") for _ in range(4 * merges.lookahead)).replace(" ", "").encode()
    coder = bpe.Transducer(merges)
    coder.window = merges.lookahead + 1
    out = [t for k in range(len(raw)) for t in coder.feed(raw[k : k + 1])]
    assert out + coder.finish() == merges.merge(raw)


def test_slices_and_tables_give_the_same(merges, library, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE", 50)
    monkeypatch.setattr(bpe, "KEPT_PIECES", 40)
    coder, texts = bpe.Encoder(merges), odd_texts()
    for text, packed in zip(texts, coder.many(texts)):
        assert np.frombuffer(packed, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_special_strings_as_text(merges, library):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(byte_bpe_file())
    plain.encode_special_tokens = True
    [packed] = bpe.Encoder(merges, special=False).many(["a<|endoftext|>b"])
    assert np.frombuffer(packed, "<u4").tolist() == plain.encode("a<|endoftext|>b", add_special_tokens=False).ids


def test_decoder_carries_unfinished_characters(merges, library):
    ids = library.encode("漢字🙂 é", add_special_tokens=False).ids
    decoder = bpe.Decoder(merges)
    assert "".join([*(decoder.feed([i]) for i in ids), decoder.finish()]) == "漢字🙂 é"
    cut = bpe.Decoder(merges)
    raw = b"".join(merges.token[i] for i in ids[:2])
    assert cut.feed(ids[:2]) + cut.finish() == codecs.decode(raw, "utf-8", "replace")


def test_bpe_of_nothing(spark):
    encoded = bpe.encode(data.empty(spark), byte_bpe_file())
    assert encoded.collect() == [] and bpe.decode(encoded, byte_bpe_file()).collect() == []
    rows = spark.createDataFrame([(1, None), (2, bytearray(np.array([257, 999_999], "<u4").tobytes()))], "doc_id long, ids binary")
    assert {r.doc_id: r.text for r in bpe.decode(rows, byte_bpe_file()).collect()} == {1: "", 2: bpe.Merges(byte_bpe_file()).token[257].decode()}
