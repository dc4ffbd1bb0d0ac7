"""What keeps queries within their limits on large tables: plans and kernels that meet no more rows than they must."""

import itertools
import random
import time
from difflib import SequenceMatcher

import duckdb
import numpy as np
import pandas as pd
import pytest

from docweft.functions import similarity
from docweft.llm import jaccard_join
from docweft.operators import kernels
from docweft.plans import library

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return library.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_reference_match_broadcasts_no_stretches(spark):
    joins = [line for line in plan(spark, "reference_match").splitlines() if "BroadcastHashJoin" in line]
    assert all("LeftSemi" in line for line in joins), joins


def test_texts_of_common_words_share_no_stretch():
    rng = random.Random(1)
    words = [a + b for a in ("th", "an", "in", "re", "on", "st") for b in ("e", "er", "es", "ing", "ion", "ed")]
    texts = ["".join(rng.choice(words) + " " for _ in range(60)) for _ in range(200)] + ["", "x" * 39, "\U0001d538" * 41]
    marks = similarity._marks(texts, 40)
    assert [len(m) for m in marks[-3:]] == [0, 0, 1]
    for text, own in zip(texts[:200], marks):
        assert len(own) < len(text) / 6
        for at in (0, 17, len(text) - 40):  # whatever has a needle has its mark
            assert set(similarity._marks([text[at : at + 40]], 40)[0]) <= set(own)
    assert sum(bool(set(a) & set(b)) for a, b in itertools.combinations(map(set, marks[:200]), 2)) < 400


def test_iou_pairs_are_not_shuffled(spark):
    assert "Exchange" not in plan(spark, "iou_pairs").split("Join")[0]


def test_equal_boxes_are_not_compared():
    boxes = [(0.0, 0.0, 9.0, 4.0), (0.0, 40.0, 9.0, 44.0), (0.0, 5.0, 9.0, 9.0)] * 5_000 + [(3.0, 3.0, 3.0, 3.0)] * 2
    begin = time.process_time()
    assert kernels.box_clusters(boxes) == [0, 1, 0] * 5_000 + [15_000, 15_001]
    assert time.process_time() - begin < 5


def test_similarities_of_long_texts_are_quick():
    rng = random.Random(2)
    a, b = ("".join(rng.choice("abcdefghijklmnop ") for _ in range(20_000)) for _ in range(2))
    begin = time.process_time()
    assert 0 < similarity.matching_ratio(a, b) < 1
    assert similarity.matching_ratio(a[:9_000], "-" + a[:9_000]) == 18_000 / 18_001
    assert similarity.window_share(a + a, a) > 0.99 and similarity.longest_common_length(a + "\U0001d538" + b, b + a) == 20_000
    assert time.process_time() - begin < 10


@pytest.mark.parametrize("alphabet", ["ab", "abc d", "abcdefghijklmnop \U0001d538"])
def test_matching_ratio_is_that_of_the_library(alphabet):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(rng.randrange(n)))
    for n in (4, 30, 130, 450):
        for _ in range(40):
            a, b, c = text(n), text(n), text(n)
            a, b = rng.choice([(a, b), (a + c, b + c), (c + a, c), (a + c + b, b + c + a)])
            assert similarity.matching_ratio(a, b) == SequenceMatcher(None, a, b, autojunk=False).ratio(), (a, b)


@pytest.mark.parametrize("bounds", [(1 << 17, 1 << 22), (300, 40), (1, 1)])
def test_ratios_of_many_pairs_are_those_of_each(monkeypatch, bounds):
    monkeypatch.setattr(similarity, "TOGETHER", bounds[0])
    monkeypatch.setattr(similarity, "PLACES", bounds[1])
    rng = random.Random(4)
    text = lambda: "".join(rng.choice(rng.choice(["a", "ab", "abc d\n", "xy\U0001d538"])) for _ in range(rng.choice([0, 1, 3, 9, 40])))
    pairs = [(text(), text()) for _ in range(400)] + [(None, None), (None, "x"), ("ab" * 300, "ba" * 300)]
    pairs += [(a + b, b + c + a) for (a, _), (b, c) in zip(pairs[:200], pairs[100:300])]
    got = similarity.matching_ratios(*zip(*pairs))
    assert got == [SequenceMatcher(None, a or "", b or "", autojunk=False).ratio() for a, b in pairs]


def test_ratios_of_titles_take_little_time_and_shuffle_no_text(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(900)]
    title = lambda: " ".join(rng.choice(words) for _ in range(120))
    a, b = ([title() for _ in range(400)] for _ in range(2))
    begin = time.process_time()
    one = [similarity._matched(x, y) for x, y in zip(a[:50], b)]
    middle = time.process_time()
    ratios = similarity.matching_ratios(a, b)
    assert time.process_time() - middle < 4 * (middle - begin)  # half of what the pairs take one by one
    assert [2.0 * n / (len(x) + len(y)) for n, x, y in zip(one, a, b)] == ratios[:50]
    joined = plan(spark, "sequence_ratio").split("Join")[1]
    assert all("substring_index" in side for side in joined.split("Exchange")[1:]), joined


def test_contracted_edges_keep_the_components(spark):
    edges = [(f"n{a}", f"l{(a * k) % 9}") for a in range(100) for k in range(1, 9)] + [("x", "y"), ("y", "z"), ("l3", "l4")]
    got = [tuple(r) for r in jaccard_join.contracted(spark.createDataFrame(edges, "a string, b string")).collect()]
    names = sorted({n for e in edges for n in e})
    root = lambda pairs: jaccard_join.roots(len(names), np.array([names.index(p[0]) for p in pairs]), np.array([names.index(p[1]) for p in pairs])).tolist()
    assert root(got) == root(edges) and len(got) < 100 + 9 * 9 + 3


def same_as_sql(spark, folder, name, texts):
    """The rows of a query over documents of these texts; the query's SQL has the same."""
    pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "lang": "en", "source": "s"}).to_parquet(f"{folder}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    found = duck.execute(library.SQL[name])
    columns = [x[0] for x in found.description]
    got = sorted(tuple(r[c] for c in columns) for r in library.QUERIES[name](spark, str(folder)).collect())
    assert got == [pytest.approx(r) for r in sorted(found.fetchall())]
    return got


TEXT_QUERIES = ["qc_local_score", "extract_numbers", "extract_equations", "extract_key_terms", "sentence_counts", "stride_sample"]


@pytest.mark.parametrize("name", TEXT_QUERIES)
def test_odd_texts_give_what_sql_gives(spark, tmp_path, name):
    rng = random.Random(4)
    bits = ["a", "b_c", "_", "=", " = ", "<", ">\n", "12", "3.5", ".", "!", "?", "...", " ", "  ", "\t", "\n", " \r\n", "\f", "\x0b", "\u2028", "\u00a0", "Ab", "Ab Cd", "Xyz Ghi", '"', '"one two"', "-", "(x+1)", "\u00e9", "\U0001d538", "word word word ", "Some long words here. "]
    texts = [None, "", " ", ".", "...", "1. Head\n\n", "1.2) Head\nText of it. ", "a = b_c = d", "x=1 y<2z>3", "end of it \u2028", "Text. no mark", "No mark", "\x0b1. Head\nOne two."]
    for most in (4, 20, 90):
        for _ in range(120):
            one = "".join(rng.choice(bits) for _ in range(rng.randrange(most)))
            texts += [one, rng.choice(["", "2.1 Title\n"]) + one.replace(rng.choice(bits), rng.choice(bits), 2)]
    many = " ".join(f"{k} n{k} = {k}" for k in range(10, 80))
    texts += [many, many.replace("10", "110"), many, many.replace("10", "1_0"), many, many.replace(" = ", " =  "), many, many.replace("n33 = 33", "n34 = 33")]
    assert same_as_sql(spark, tmp_path, name, texts)


def test_long_runs_in_texts_are_searched_once(spark, tmp_path):
    texts = ["word " * 20 + "x" * 150_000 + " 1 = 2", "Abc " * 100_000, "One two three. " + "no mark " * 40_000, "y" * 150_000 + " <"]
    texts += [" ".join(str(100_000 + 7 * k) for k in range(18_000)) + " done", " ".join(f"x{k} = {k}." for k in range(9_000))]
    texts = [t + " end." * (k % 2) for t in texts for k in range(4)]
    begin = time.monotonic()
    assert len(same_as_sql(spark, tmp_path, "qc_local_score", texts)) == len(texts) - 1
    assert time.monotonic() - begin < 20


def test_a_source_is_made_once_for_all_its_checks(spark):
    p = plan(spark, "qc_local_score")
    assert p.count("[.):") == 1 and "split(" not in p
