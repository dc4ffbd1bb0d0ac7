"""The training-data operators against brute force, with all odd cases."""

import hashlib
import math
import unicodedata
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from docweft.llm import fingerprint, graph, hamming, jaccard_join, mixing, ngram_lm, repeats, token_count, toxicity, warc
from docweft.llm.common import held_out

from . import data

LOW = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
BIG = 1 << 63


def some(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


# ---------------------------------------------------------------- 1


@pytest.mark.parametrize("part", [10_000, 3])
def test_hamming_is_exact(spark, monkeypatch, part):
    """With whole segment values, and with values of which each part holds few codes."""
    import random

    monkeypatch.setattr(hamming, "PART", part)

    rng = random.Random(5)
    near = rng.getrandbits(64)
    codes = [rng.getrandbits(64) for _ in range(150)] + [near] * 30 + [near ^ (1 << k) for k in range(20)]
    signed = [c - (1 << 64) if c >= BIG else c for c in codes]
    df = spark.createDataFrame([(k, c, "x") for k, c in enumerate(signed)] + [(None, 1, "x"), (999, None, "x")], "id long, code long, d string")
    got = defaultdict(list)
    for r in hamming.search(df, df.filter("id % 50 = 0"), 5).collect():
        got[r.query_id].append((r["rank"], r.neighbor_id, r.distance))
    for q in range(0, 200, 50):
        want = sorted((bin(codes[q] ^ c).count("1"), k) for k, c in enumerate(codes) if k != q)[:5]
        assert sorted(got[q]) == [(n + 1, k, d) for n, (d, k) in enumerate(want)]
    assert set(got) == {0, 50, 100, 150}


def test_hamming_small_tables(spark):
    df = spark.createDataFrame([(0, 5), (1, 5), (2, 4)], "id long, code long")
    assert some(hamming.search(df, df.filter("id = 0"), 5), "query_id", "rank", "neighbor_id", "distance") == [(0, 1, 1, 0), (0, 2, 2, 1)]
    assert hamming.search(df.limit(0), df.limit(0), 5).count() == 0


def test_hamming_probes_alone_answer(spark):
    """Each query is done by its segment radius: the covered distance reaches its kth neighbour, and no radius before covers it."""
    import random

    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(4)]
    codes = {c for b in base for c in [b, *[b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(20)]]} | {rng.getrandbits(64) for _ in range(300)}
    signed = sorted(c - (1 << 64) if c >= BIG else c for c in codes)
    df = spark.createDataFrame([(c, 1, k) for k, c in enumerate(signed)], "code long, copies long, first long")
    queries = signed[::20]
    rows = hamming.nearest_codes(df, spark.createDataFrame([(q,) for q in queries], "q long"), 6).collect()
    m = len(hamming.segments(64, len(signed), 6))
    found, radius = defaultdict(list), {}
    for r in rows:
        found[r.q].append(r.d)
        radius[r.q] = r.radius
    for q in queries:
        want = sorted((q ^ c).bit_count() if (q ^ c) >= 0 else ((q ^ c) + (1 << 64)).bit_count() for c in signed)[:6]
        assert sorted(found[q]) == want
        assert want[-1] <= m * radius[q] + m - 1 and (radius[q] == 0 or want[-1] > m * (radius[q] - 1))
    assert len(set(radius.values())) > 1


def test_hamming_repeated_rows(spark):
    """Repeated rows and ids: each counts; a row is no neighbour of rows with its own id."""
    df = spark.createDataFrame([(0, 5), (0, 5), (1, 5), (1, 5), (2, 7)], "id long, code long")
    got = some(hamming.search(df, df.filter("id = 2"), 3), "query_id", "rank", "neighbor_id", "distance")
    assert got == [(2, 1, 0, 1), (2, 2, 0, 1), (2, 3, 1, 1)]


def test_sign_code(spark):
    df = spark.createDataFrame([([1.0, -1.0, 0.0, float("nan")] + [2.0] * 60,), (None,), ([],)], "v array<double>")
    assert [r[0] for r in df.select(hamming.sign_code(F.col("v"))).collect()] == [((1 << 63) | ((1 << 60) - 1)) - (1 << 64), None, None]


# ---------------------------------------------------------------- 2


def water(sizes: dict, weights=(5.0, 2.0, 1.0), most=3.0) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, capped = float(sum(sizes.values())), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        free = sum(w[s] for s in names if s not in capped)
        above = {s for s in names if s not in capped and left * w[s] / free > most * sizes[s]}
        if not above:
            return {s: most * sizes[s] if s in capped else left * w[s] / free for s in names}
        capped |= above


def test_mixing(spark):
    docs = data.documents(spark)
    got = mixing.mix(docs).collect()
    want = Counter()
    for r in docs.collect():
        want[r.source] += len(data.words(r.text))
    targets, taken, most = water(want), Counter(), Counter()
    for r in got:
        assert r.source_size == want[r.source] and r.target == pytest.approx(targets[r.source])
        assert r.taken == r["copies"] * r["size"] and r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r["size"])
    assert len(got) == docs.count()
    for s in want:
        assert abs(taken[s] - targets[s]) <= 2 * most[s] / 2 + 1e-6
    again = some(mixing.mix(docs.repartition(5)), "doc_id", "size", "taken")
    assert again == some(mixing.mix(docs), "doc_id", "size", "taken")


def test_mixing_takes_rows(spark):
    docs = data.documents(spark, unique=True)
    copies = {r.doc_id: r["copies"] for r in mixing.mix(docs).collect()}
    out = mixing.take(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({k: n for k, n in copies.items() if n})


def test_mixing_odds_and_empty(spark):
    docs = spark.createDataFrame([(k, "w " * 10, "a" if k < 50 else "b", 1.0 + 9 * (k % 2)) for k in range(100)], "doc_id long, text string, source string, odds double")
    got = mixing.mix(docs, odds_col="odds").groupBy("source", (F.col("doc_id") % 2).alias("p")).agg(F.sum("taken").alias("t")).collect()
    t = {(r.source, r.p): r.t for r in got}
    assert t["b", 1] > 4 * t["b", 0]
    assert mixing.mix(data.empty(spark)).count() == 0 and mixing.take(data.empty(spark)).count() == 0


def test_mixing_odds_meet_targets_and_probabilities(spark):
    """Over many seeds a document's mean copies are min(3, level * odds), whole copies are certain, and targets are met."""
    rows = [(k, "w " * 5, "abc"[k % 3 if k < 90 else 0], float(2 ** (k % 4))) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, odds double").cache()
    copies, n = Counter(), 12
    for seed in range(n):
        got = mixing.mix(docs, odds_col="odds", seed=seed).collect()
        taken = Counter()
        for r in got:
            copies[r.doc_id] += r["copies"]
            taken[r.source] += r.taken
        assert all(abs(taken[r.source] - r.target) <= 2.5 + 1e-9 for r in got)
    target = {r.source: r.target for r in got}
    for s in "abc":
        own = [(k, w) for k, _, source, w in rows if source == s]
        low, high = 0.0, 10.0
        for _ in range(60):  # by halving, where the operator uses running sums
            level = (low + high) / 2
            low, high = (level, high) if sum(5 * min(3.0, level * w) for _, w in own) < target[s] else (low, level)
        for w in {w for _, w in own}:
            mean = sum(copies[k] for k, x in own if x == w) / n / sum(x == w for _, x in own)
            assert mean == pytest.approx(min(3.0, level * w), abs=0.25)
            assert all(copies[k] >= n * math.floor(min(3.0, level * w) + 1e-9) for k, x in own if x == w)


# ---------------------------------------------------------------- 3


def test_folding():
    assert toxicity.fold("You 1D10T, $tupid  сlown!! l0ser! a​b") == " you idiot stupid clown loser ab "
    assert toxicity.fold("in 1999 costs $5") == " in costs " and toxicity.fold(None) == " " and toxicity.fold("ﬁne Été") == " fine été "


def test_toxicity_learns_and_spares(spark):
    import random

    rng = random.Random(3)
    clean = ["the", "of", "tale", "river", "stone", "walk", "green", "house", "paper", "light"]
    text = lambda bad: " ".join(rng.choice(clean) for _ in range(40)) + (" you vilethug and grubhead" if bad == 1 else " the harmless vilethug beetle" if bad == 2 else "")
    rows = [(k, text([0, 1, 2, 0][k % 4]), int(k % 4 == 1)) for k in range(400)]
    docs = spark.createDataFrame([(k, t, "x") for k, t, _ in rows] + [(None, None, "x"), (1000, "", "x"), (1001, "you V1LETHUG and grubhеad", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(None, 1), (7, None)], "doc_id long, toxic int").filter(~held_out(F.col("doc_id"), 0))
    lexicon = toxicity.train(labels, docs)
    got = {r.doc_id: r.score for r in toxicity.score(docs.select("doc_id", "text"), lexicon).collect()}
    assert all((got[k] >= 0.5) == bool(y) for k, _, y in rows)
    assert got[None] < 0.5 and got[1000] < 0.5 and got[1001] >= 0.5
    kept = toxicity.keep_clean(docs, lexicon)
    assert kept.columns == docs.columns and kept.count() == 302
    nothing = toxicity.train(labels.limit(0), docs)
    assert {r.score for r in toxicity.score(docs.select("text"), nothing).collect()} == {0.0}
    assert toxicity.keep_clean(docs.limit(0), lexicon).count() == 0


def filler(rng, n=30):
    return " ".join(f"{a}{b}" for a, b in zip(rng.choices(["ka", "lo", "mi", "ru"], k=n), rng.choices(["ta", "ne", "so", "pi", "du"], k=n)))


def learnt(spark, texts, labels):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    return toxicity.train(spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int"), docs), docs


def test_toxicity_keeps_terms_beside_a_frequent_one(spark):
    """A term of one text in fifty beside one of every other text; words of one family of near copies count once."""
    import random

    rng = random.Random(6)
    copy = filler(rng, 200)
    toxic = [filler(rng) + (" vilethug" if k % 2 else "") + (" grubhead" if k % 50 == 0 else "") for k in range(1000)]
    toxic += [f"{filler(rng, 20)} {copy} onlyhere {filler(rng, 20)}" for _ in range(40)]
    lexicon, _ = learnt(spark, toxic + [filler(rng) for _ in range(1000)], [1] * len(toxic) + [0] * 1000)
    found = {p.strip() for p in lexicon.terms}
    assert {"vilethug", "grubhead"} <= found and "onlyhere" not in found


def test_toxicity_learns_behind_a_common_header_and_footer(spark):
    """Whatever texts have in common, all of them are learnt from; so the toxic ones are found."""
    import random

    rng = random.Random(8)
    header, footer = filler(rng, 30), filler(rng, 30)
    texts = [f"{header} {filler(rng, 80)}{' vilethug' if k % 2 else ''} {filler(rng, 80)} {footer}" for k in range(200)]
    lexicon, docs = learnt(spark, texts, [k % 2 for k in range(200)])
    assert list(lexicon.terms) == [" vilethug "]
    got = {r.doc_id: r.score for r in toxicity.score(docs, lexicon).collect()}
    assert all((got[k] >= 0.5) == bool(k % 2) for k in got)


@pytest.mark.parametrize("place", [lambda k: k % 2, lambda k: k < 100, lambda k: k % 4 == 0], ids=["parity", "first", "quarter"])
def test_toxicity_does_not_depend_on_the_order_of_ids(spark, place):
    import random

    rng = random.Random(4)
    labels = [int(place(k)) for k in range(300)]
    lexicon, docs = learnt(spark, [filler(rng) + (" you vilethug" if y else "") for y in labels], labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, lexicon).collect()}
    assert [int(got[k] >= 0.5) for k in range(300)] == labels


def brute_score(lexicon, text):
    """By looking for each pattern in the folded text."""
    folded = toxicity.fold(text)
    every = lambda p: [k for k in range(len(folded)) if folded.startswith(p, k)]
    spared = [(k, k + len(p)) for p in lexicon.phrases for k in every(p)]
    total = sum(w for p, w in lexicon.terms.items() for k in every(p) if not any(a <= k and k + len(p) <= b for a, b in spared))
    x = [min(20.0, 100 * total / folded.count(" ")), math.log1p(total), 1.0] if total else [0.0] * 3
    return 1 / (1 + math.exp(-(lexicon.model[0] + sum(a * b for a, b in zip(lexicon.model[1:], x)))))


def test_toxicity_against_brute_force(spark):
    """Terms by counting sets of words, and scores by plain search; repeated rows, very long, empty and null texts among them."""
    import random

    rng = random.Random(11)
    bad = ["vilethug", "grubhead", "slimemaw"]
    texts, labels = [], []
    for k in range(400):
        y = int(k % 4 == 0)
        more = [rng.choice(bad), *rng.sample(["rare1", "xx" + rng.choice("abc")], rng.randint(0, 2))] if y else ["tiny", "grubhead"] if k % 100 == 1 else []
        texts.append(f"{filler(rng, rng.randint(5, 60))} {' '.join(more)} {filler(rng, 9)}")
        labels.append(y)
    lexicon, _ = learnt(spark, texts, labels)
    have = [Counter(), Counter()]
    for t, y in zip(texts, labels):
        words = set(toxicity.fold(t).split())
        have[y].update({f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in range(toxicity.STEM, min(12, len(w)) + 1)})
    nt, nc = sum(labels), 400 - sum(labels)

    def clear(p):
        t, c = have[1][p], have[0][p]
        loglik = lambda k, n, q: (k * math.log(q) if k else 0) + ((n - k) * math.log(1 - q) if n > k else 0)
        q = (t + c) / (nt + nc)
        evidence = 2 * (loglik(t, nt, t / nt) + loglik(c, nc, c / nc) - loglik(t, nt, q) - loglik(c, nc, q))
        return t >= 4 and math.log((t + 0.5) / (nt + 1) / ((c + 0.5) / (nc + 1))) >= toxicity.ODDS and evidence >= toxicity.EVIDENCE

    assert {p for p in have[1] if p.endswith(" ") and clear(p)} == {p for p in lexicon.terms if p.endswith(" ")}
    odd = [None, "", " ", texts[0], texts[0], "a VILETHUG! " * 5000, "gru bhead grubheads", "tiny grubhead tiny", filler(rng, 20_000) + " slimemaw"]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, lexicon).collect()}
    assert all(got[k] == pytest.approx(brute_score(lexicon, t)) for k, t in enumerate(odd))
    assert any(len(p.split()) == 2 for p in lexicon.phrases)


# ---------------------------------------------------------------- 4


def shingles(t, n=5):
    w = data.words((t or "").translate(LOW))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def brute_links(docs):
    sets = [shingles(r.text) for r in docs]
    root = list(range(len(docs)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    n = Counter()
    for i, j in combinations(range(len(docs)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            n[i] += 1
            n[j] += 1
            root[max(top(i), top(j))] = min(top(i), top(j))
    ids = defaultdict(list)
    for k, r in enumerate(docs):
        ids[top(k)].append(r.doc_id)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted(((r.doc_id, least[top(k)], n[k]) for k, r in enumerate(docs)), key=str)


def test_jaccard_join(spark):
    docs = data.documents(spark).cache()
    assert some(jaccard_join.link_documents(docs), "doc_id", "class_id", "n_links") == brute_links(docs.collect())


def test_jaccard_join_splits_buckets_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    docs = data.documents(spark, 4, 30).cache()
    assert some(jaccard_join.link_documents(docs, recall=0.9999), "doc_id", "class_id", "n_links") == brute_links(docs.collect())


def crowd(seed, pairs):
    """Texts of ten passages, each of which stands in a fifth of all; two and two have nine in common, others mostly one to three."""
    import random

    rng = random.Random(seed)
    pool = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(30)) for _ in range(50)]
    out = []
    for _ in range(pairs):
        *nine, last, other = rng.sample(pool, 11)
        out += [" ".join([*nine, last]), " ".join([*nine, other])]
    return out


def test_jaccard_join_keeps_its_recall_where_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL", 3)
    texts = crowd(1, 600)
    assert all(0.8 < len(a & b) / len(a | b) < 0.83 for a, b in zip(map(shingles, texts[::2]), map(shingles, texts[1::2])))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).cache()
    found = {r.doc_id: r.class_id for r in jaccard_join.link_documents(docs).collect()}
    assert sum(found[k + 1] == found[k] for k in range(0, len(texts), 2)) >= 0.99 * 600


def test_jaccard_keep_one(spark):
    docs = data.documents(spark, unique=True).cache()
    out = jaccard_join.keep_one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(k for k, c, _ in brute_links(docs.collect()) if k == c)
    assert jaccard_join.link_documents(data.empty(spark)).count() == 0 and jaccard_join.keep_one_of_each(data.empty(spark)).count() == 0


def test_jaccard_keeps_one_of_repeated_rows_and_ids(spark):
    """Equal rows, one id with two texts, missing ids, and columns named like the operator's own: of each class one row stays."""
    docs = data.documents(spark).cache()
    rows = docs.collect()
    out = jaccard_join.keep_one_of_each(docs)
    assert out.columns == docs.columns
    sets = [shingles(r.text) for r in rows]
    root = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            a, b = root[i], root[j]
            root = [min(a, b) if x in (a, b) else x for x in root]
    classes = defaultdict(set)
    for r, c in zip(rows, root):
        classes[c].add((BIG if r.doc_id is None else r.doc_id, r.text or ""))
    kept = [(BIG if r.doc_id is None else r.doc_id, r.text or "") for r in out.collect()]
    assert len(kept) == len(classes) and all(sum(k in c for k in kept) == 1 for c in classes.values())
    assert sorted(k for k, _ in kept) == sorted(min(c)[0] for c in classes.values())


def test_jaccard_long_texts_in_one_group(spark, monkeypatch):
    """Near copies of long texts: blocks are cut by shingles, and links are exact."""
    import random

    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 9_000)
    rng = random.Random(3)
    long = filler(rng, 4000).split()
    texts = [" ".join("changed" if k % 400 == 7 * n else w for k, w in enumerate(long)) for n in range(8)] + ["short one"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").cache()
    assert some(jaccard_join.link_documents(docs), "doc_id", "class_id", "n_links") == brute_links(docs.collect())


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}


def test_bucket_parts():
    import numpy as np

    assert jaccard_join.roots(5, np.array([1, 3]), np.array([0, 4])).tolist() == [0, 0, 2, 3, 3]
    sets = [np.array([1, 2, 3], np.uint64), np.array([2, 3, 4], np.uint64), np.array([9], np.uint64), np.array([], np.uint64)]
    assert jaccard_join.intersections(sets, None).tolist() == [[3, 2, 0, 0], [2, 3, 0, 0], [0, 0, 0, 0], [0, 0, 0, 0]] or jaccard_join.intersections(sets, None)[0, 1] == 2
    assert jaccard_join.find_links(sets, None, 0.5).tolist() == [[False, True, False, False], [True, False, False, False], [False] * 4, [False] * 4]


# ---------------------------------------------------------------- 6


def brute_lm(texts, learn, order):
    """Of each text: tokens, known tokens, and log10 of the base's and the model's probability, from counts of tuples."""
    tokens = [["<s>", *data.words((t or "").translate(LOW)), None] for t in texts]
    c = Counter(tuple(t[k : k + n]) for t, y in zip(tokens, learn) if y for n in range(1, order + 1) for k in range(len(t) - n + 1))
    total = sum(v for g, v in c.items() if len(g) == 1 and g != ("<s>",))
    z = total + 0.5 * (sum(len(g) == 1 and g != ("<s>",) for g in c) + 1)

    def p(history, w):
        if not history:
            return (c[(w,)] + 0.5) / z
        if not c[history]:
            return p(history[1:], w)
        a, b = ngram_lm.MASS[len(history) - 1]
        m = 1 / (1 + a * c[history] ** b)
        return (1 - m) * c[(*history, w)] / c[history] + m * p(history[1:], w)

    out = []
    for t in tokens:
        score = sum(math.log10(p(tuple(t[max(0, k - order + 1) : k]), t[k])) for k in range(1, len(t)))
        out.append((len(t) - 1, sum(c[(w,)] > 0 for w in t[1:]), total, round(sum(math.log10(p((), w)) for w in t[1:]), 6), round(score, 6)))
    return out


def test_lm(spark, monkeypatch):
    monkeypatch.setattr(ngram_lm, "STRETCH", 7)  # so that texts are read in several stretches
    docs = data.documents(spark)
    out = held_out(F.col("doc_id"), 1)
    rows = docs.collect()
    learn = [r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 != 1 for r in rows]
    want = [(r.doc_id, *x) for r, x in zip(rows, brute_lm([r.text for r in rows], learn, ngram_lm.ORDER))]
    got = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in ngram_lm.score(docs, ~out).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_lm_without_training(spark):
    docs = data.documents(spark, n=3)
    got = ngram_lm.score(docs, F.lit(False)).collect()
    assert len(got) == docs.count() and all(r.train_tokens == 0 and r.n_known == 0 and r.score == r.base_score for r in got)
    assert ngram_lm.score(data.empty(spark), F.lit(True)).count() == 0


def reading(train, texts, order=3):
    """The automaton for ``texts`` learnt from ``train``, and their log10 weights by token."""
    import numpy as np

    learnt = ngram_lm.Stream(train, 60, order)
    known = dict(zip(*(x.tolist() for x in learnt.distinct(np.ones(len(train), bool)))))
    words = Counter(w for t in train for w in [*t.split(), None])
    s = ngram_lm.Stream(texts, 60, order)
    keys, _ = s.distinct(np.zeros(len(texts), bool))
    machine = ngram_lm.Automaton(s, keys, np.array([known.get(k, 0) for k in keys.tolist()], np.uint64), sum(words.values()), len(words))
    return machine, machine.read(s)


def test_lm_states_sum_to_one():
    """After any history the known words, the end and the one unknown place have probability 1."""
    train = ["a b a c", "b a", "c c c a", "a b c"]
    for history in ("", "a", "a b", "c c", "b zz", "zz a", "a b a", "c b"):
        n = len(history.split())
        total = sum(10 ** reading(train, [f"{history} {word}".strip()])[1][n + 1] for word in ("a", "b", "c", "zz"))
        total += 10 ** reading(train, [history])[1][n + 1]
        assert total == pytest.approx(1.0), history


def test_lm_failure_arcs():
    """States are n-grams seen in training; failure arcs lead to suffixes and at last to the root."""
    machine, _ = reading(["a b a c", "b a"], ["a b a zz a b"])
    # begin mark, a, b; begin a, a b, b a
    assert len(machine.fail) == 1 + 3 + 3
    assert machine.fail[0] == 0 and all(machine.fail[1:4] == 0) and all(machine.fail[4:] > 0)


def test_lm_knows_what_was_seen_twice():
    """By token a held-out copy of a text seen twice is likelier than one seen once, and that than an unseen one."""
    import random

    rng = random.Random(1)
    texts = [filler(rng, 60) for _ in range(60)]
    _, once = reading(texts, texts[:1])
    _, twice = reading([*texts, texts[0]], texts[:1])
    _, never = reading(texts[1:], texts[:1])
    assert twice.sum() > once.sum() + 1 > never.sum() + 2


# ---------------------------------------------------------------- 7


def test_token_counts_match_the_library():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = token_count.read_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    library = Tokenizer(models.Unigram([("<unk>", min(s for _, s in vocabulary)), *vocabulary], 0, True))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    counter = token_count.Counter(vocabulary)
    rng = random.Random(2)
    samples = [t or "" for t in data.texts()] + ["".join(rng.choice("ab ▁é😀\n<0x4") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    for t in samples:
        assert counter.of_text(t) == len(library.encode(t).ids), repr(t)


def test_token_counts_ties():
    """Equal scores: the match that begins first wins; unknown runs count once without byte pieces."""
    c = token_count.Counter([("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁", -1.0)])
    assert c.of_text("ab") == 2 and c.of_text("zzz") == 2 and c.of_text(None) == 0 and token_count.Counter([]).of_text("xy") == 1


def test_token_counts_table(spark):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = data.documents(spark)
    counter = token_count.Counter(token_count.read_vocabulary(path))
    want = sorted(((r.doc_id, len(r.text or ""), counter.of_text(r.text)) for r in docs.collect()), key=str)
    assert some(token_count.count_tokens(docs, path), "doc_id", "n_chars", "n_tokens") == want
    assert token_count.count_tokens(data.empty(spark), path).count() == 0


# ---------------------------------------------------------------- 8


def brute_repeats(rows):
    key = lambda d: BIG if d is None else d
    low = {}
    for r in rows:
        w = data.words(r.text)
        for k in range(len(w) - 12):
            x = tuple(w[k : k + 13])
            low[x] = min(low.get(x, BIG + 1), key(r.doc_id))
    out = []
    for r in rows:
        w = data.words(r.text)
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if low[tuple(w[k : k + 13])] < key(r.doc_id):
                gone[k : k + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((r.doc_id, len(w), sum(gone), kept))
    return out


def test_repeats(spark):
    docs = data.documents(spark).cache()
    want = sorted(((d, n, g, hashlib.sha256(k.encode()).hexdigest()) for d, n, g, k in brute_repeats(docs.collect())), key=str)
    assert sum(w[2] for w in want) > 100
    assert some(repeats.find_repeats(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == want


def test_repeats_rows(spark):
    docs = data.documents(spark, unique=True).cache()
    whole = {r.doc_id: r.text for r in docs.collect()}
    want = [(d, (k if g else whole[d])) for d, n, g, k in brute_repeats(docs.collect()) if k or not g]
    out = repeats.remove_repeats(docs)
    assert out.schema == docs.schema and some(out, "doc_id", "text") == sorted(want, key=str)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) and (r.chunk, r.source) == ("c", {x.doc_id: x.source for x in docs.collect()}[r.doc_id]) for r in out.collect())
    assert repeats.find_repeats(data.empty(spark)).count() == 0 and repeats.remove_repeats(data.empty(spark)).count() == 0


def test_words_made_to_collide_are_told_apart():
    """Two different words of 1,024 letters that a polynomial hash modulo a power of two takes for one."""
    from docweft.llm.common import Words

    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    w = Words([f"{word} {word.translate(str.maketrans('ab', 'ba'))} {word}"], wide=True)
    assert w.hash[0] != w.hash[1] and w.hash[0] == w.hash[2] and w.other[0] != w.other[1]


def test_repeats_keep_other_columns_as_they_are(spark):
    """Microseconds, maps with number keys, nested values; a third of the ids are missing."""
    docs = data.documents(spark).select("doc_id", "text").withColumn("doc_id", F.when(F.xxhash64("text") % 3 != 0, F.col("doc_id")))
    docs = docs.withColumns({
        "at": F.expr("timestamp'2024-05-06 07:08:09.123456'"), "m": F.expr("map(7, 'x')"), "n": F.expr("named_struct('others', array(1.5d), 'c0', null)"), "chunk": F.lit(1), "b": F.expr("x'00ff'"),
    })
    out = repeats.remove_repeats(docs)
    assert out.columns == docs.columns
    whole = docs.drop("doc_id", "text").first()
    assert all(r["at"] == whole["at"] and r["m"] == {7: "x"} and r["n"] == whole["n"] and r["b"] == whole["b"] for r in out.collect())
    want = [(d, k) for d, _, g, k in brute_repeats(docs.collect()) if g and k]
    got = Counter((r.doc_id, r.text) for r in out.collect())
    assert want and all(got[x] for x in want)


# ---------------------------------------------------------------- 9


def canon(t):
    f = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold())
    return " ".join(f.split())


def digest(t):
    b = canon(t).encode()
    first = xxhash.xxh64_intdigest(b, 42)
    second = xxhash.xxh64_intdigest(b, xxhash.xxh64_intdigest(b"docweft", 42))
    return f"{first:016x}{second:016x}-0"


def test_fingerprints(spark):
    docs = data.documents(spark, unique=True)
    got = {r.doc_id: r for r in fingerprint.edited_fingerprints(docs, bucket_rows=7).collect()}
    whole = {r.doc_id: r.text or "" for r in docs.collect()}
    order = sorted(whole, reverse=True)
    assert len(got) == len(whole)
    for k, d in enumerate(order):
        t, nxt = whole[d], whole[order[(k + 1) % len(order)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (digest(t), digest(edited))
        assert (r.near_edited, r.near_next) == (float(digest(t) == digest(edited)), float(digest(t) == digest(nxt)))


def test_fingerprints_odd_rows(spark):
    docs = data.documents(spark)
    assert fingerprint.edited_fingerprints(docs, bucket_rows=5).count() == docs.count()
    assert fingerprint.edited_fingerprints(data.empty(spark)).count() == 0
    one = docs.filter("doc_id = 17")
    assert fingerprint.edited_fingerprints(one).first().near_next == 1.0
    assert fingerprint.fingerprints(docs).columns == [*docs.columns, "fingerprint"]


def test_fingerprints_compare_bytes(spark, monkeypatch):
    """With a digest that always collides, texts are told apart by their bytes."""
    monkeypatch.setattr(fingerprint, "digest", lambda c: F.concat(F.lit("d"), F.left(c, F.lit(0))))
    docs = spark.createDataFrame([(1, "B"), (2, "a"), (3, "A "), (4, "c")], "doc_id long, text string")
    assert some(fingerprint.fingerprints(docs), "doc_id", "fingerprint") == [(1, "d-1"), (2, "d-0"), (3, "d-0"), (4, "d-2")]


def test_edited_fingerprints_compare_bytes(spark, monkeypatch):
    """Edited texts too are told apart by their bytes, among themselves and from the documents'."""
    monkeypatch.setattr(fingerprint, "digest", lambda c: F.concat(F.lit("d"), F.left(c, F.lit(0))))
    docs = spark.createDataFrame([(4, "ab"), (3, "cd"), (2, "AC"), (1, "ab")], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprint.edited_fingerprints(docs, bucket_rows=2).collect()}
    texts = {4: ("ab", "ac"), 3: ("cd", "ca"), 2: ("ac", "aa"), 1: ("ab", "aa")}
    name = {}
    for k, (own, edited) in texts.items():
        for text, found in ((own, got[k].fingerprint), (edited, got[k].edited_fingerprint)):
            assert name.setdefault(text, found) == found
        assert (got[k].near_edited, got[k].near_next) == (0.0, float(k == 1))
    assert len(set(name.values())) == len(name) == 5


def test_fingerprints_of_repeated_and_missing_ids(spark):
    """A third of all rows are one row without id, a third one id with many texts; ranges stay small, and successors are right."""
    rows = [(None, "same")] * 90 + [(50, f"text {k % 45}") for k in range(90)] + [(k, f"own {k}") for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = fingerprint.edited_fingerprints(docs, bucket_rows=10).collect()
    assert len(got) == 270
    assert sum(r.near_next for r in got if r.doc_id is None) == 89
    assert sum(r.near_next for r in got if r.doc_id == 50) == 45
    halves = {r.doc_id: r.edited_sha256 for r in got if r.doc_id in (89, 49, 0)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert halves == {89: sha("ownown"), 49: sha("ownown"), 0: sha("ownsa")}


# ---------------------------------------------------------------- 10


def test_revisits(spark):
    full, again = 200, 304
    rows = [
        ("f1", "http://www.A.org/x/#top", 10, full, {"etag": '"1"', "content-type": "t", "date": "d1"}),
        ("f2", "https://a.org/x?utm_source=q", 20, full, {"etag": '"2"', "content-type": "t", "last-modified": "m"}),
        ("f2b", "https://a.org/x", 20, full, {"etag": '"2"', "content-type": "u"}),
        ("r1", "http://a.org/x", 15, again, {"etag": 'W/"1"', "date": "d2", "set-cookie": "no"}),
        ("r2", "http://a.org/x", 20, again, {"etag": '"9"'}),
        ("r3", "http://m.a.org:80/x", 30, again, None),
        ("r4", "http://a.org/y", 30, again, {"etag": '"1"'}),
        ("r5", "http://a.org/x", 5, again, {}),
        ("r5", "http://a.org/x", 5, again, {}),
        ("n1", None, 5, again, {}), ("n2", "http://a.org/x", None, again, {}), ("n3", "http://a.org/x", 7, None, {}),
    ]
    df = spark.createDataFrame([(*r, "z") for r in rows], "record_id string, url string, ts long, status int, headers map<string,string>, range string")
    got = {r.record_id: (r.target_id, r.verdict, r.headers) for r in warc.resolve_revisits(df).collect()}
    assert got == {
        "r1": ("f1", "resolved", {"etag": 'W/"1"', "content-type": "t", "date": "d2"}), "r2": ("f2b", "changed", None),
        "r3": ("f2b", "unchecked", {"etag": '"2"', "content-type": "u"}), "r4": (None, "missing", None), "r5": (None, "missing", None),
    }
    assert warc.resolve_revisits(df).count() == 6 and warc.resolve_revisits(df.limit(0)).count() == 0


def test_revisits_of_very_long_urls(spark):
    long = "http://a.org/" + "x" * 200_000
    rows = [("f", long + "#part", 1, 200, {"etag": "e"}), ("r", long, 2, 304, {"etag": "e"}), ("f2", long + "?utm_source=" + "y" * 100_000, 3, 200, {"etag": "e"}), ("r2", long, 4, 304, None)]
    df = spark.createDataFrame(rows, "record_id string, url string, ts long, status int, headers map<string,string>")
    assert {r.record_id: (r.target_id, r.verdict) for r in warc.resolve_revisits(df).collect()} == {"r": ("f", "resolved"), "r2": ("f2", "unchecked")}


def test_revisits_against_brute_force(spark):
    import random

    rng = random.Random(8)
    rows = [(f"{'f' if k % 3 else 'r'}{k}", f"http://h/{rng.choice('aaab')}", rng.randint(0, 500), 200 if k % 3 else 304, {"etag": "e"}) for k in range(900)]
    got = {r.record_id: r.target_id for r in warc.resolve_revisits(spark.createDataFrame(rows, "record_id string, url string, ts long, status int, headers map<string,string>")).collect()}
    for name, url, ts, status, _ in rows:
        if status == 304:
            want = max(((t, n) for n, u, t, s, _ in rows if s == 200 and u == url and t <= ts), default=(0, None))[1]
            assert got[name] == want
