"""Order-dependent kernels and text functions against plain versions."""

from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docweft.functions import repair, similarity
from docweft.functions import text as X
from docweft.operators import kernels

short = st.text(alphabet="abc ", max_size=30)


@given(short, short)
@settings(max_examples=200, deadline=None)
def test_longest_common_substring(a, b):
    want = SequenceMatcher(None, a, b, autojunk=False).find_longest_match().size
    assert similarity.longest_common_length(a, b) == want


def test_longest_common_substring_of_words_made_to_collide():
    """Two different words of letters a and b that any polynomial hash with a power of two as its modulus takes for one."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    want = SequenceMatcher(None, word, other, autojunk=False).find_longest_match().size
    assert similarity.longest_common_length(word, other) == want < 2048


@given(short, short)
def test_window_share(a, b):
    own = [a[k : k + 10] for k in range(0, len(a) - 9, 5)]
    want = sum(w in b for w in own) / len(own) if own else 0.0
    assert similarity.window_share(a, b) == want


def test_greedy_pairs_takes_greater_indices_first():
    assert kernels.greedy_pairs([(0.9, 0, 0), (0.9, 0, 1), (0.8, 1, 1), (0.7, 1, 0), (0.5, 2, 2)], 0.6) == [(0.9, 0, 1), (0.7, 1, 0)]


def test_match_texts_reports_missed_and_invented():
    assert kernels.match_texts(["a cat sat", "zzz"], ["a cat sat.", "other"]) == [(0, 0, 18 / 19), (None, 1, 0.0), (1, None, 0.0)]


def test_boxes():
    boxes = [(0, 0, 10, 10), (0, 0, 9, 10), (50, 50, 60, 60)]
    assert kernels.overlap(boxes[0], boxes[1]) == 0.9
    assert kernels.overlap((0, 0, 0, 0), (0, 0, 0, 0)) == 0.0
    assert kernels.match_boxes([boxes[1], None, boxes[2]], [boxes[2], boxes[0]]) == [(0, 1), (1, 0)]
    assert kernels.box_clusters([(0, 0, 10, 5), (0, 6, 10, 11), (100, 0, 110, 5)]) == [0, 0, 2]


def test_claims_and_cursors():
    assert kernels.claim_chips([("1", "a"), ("", "b"), ("9", "c")], [("2", "b-1"), ("1", "z")]) == [1, 0, None]
    assert kernels.anchor_pages(["two", "one", "none"], ["one", "two"]) == [(1, "forward"), (0, "anywhere"), (None, "phantom")]
    assert kernels.chunk_by_titles("A x B y", ["A", "missing", "B"]) == [(0, 4, True), (None, None, False), (4, 7, True)]


def test_edits():
    ops = [("remove", "a", None), ("edit", "b", "B"), ("insert", "n", "B"), ("move", "c", "0"), ("remove", "x", None), ("insert", "z", "gone")]
    assert kernels.fold_edits(["a", "b", "c"], ops) == (["c", "B", "n", "z"], ["remove: unknown x"])


def test_figures():
    blocks = [{"text": "see Figure 2 here", "page": 1}, {"text": "some long anchor text", "page": 2}]
    figures = [{"id": "f", "label": "figure 2"}, {"id": "g", "anchor": "long anchor text", "position": "below"}, {"id": "h", "page": 2}, {"id": "i", "page": 9}]
    assert kernels.place_figures(blocks, figures) == [("f", 0, "label"), ("g", 0, "anchor"), ("h", 1, "page"), ("i", None, "unattached")]


def test_json_parsing():
    assert repair.parse_json('{"a": 1}') == '{"a": 1}'
    assert repair.parse_json('```json\n{"a": 1,}\n```') == '{"a": 1}'
    assert repair.parse_json('Here it is: [1, 2] ok') == "[1, 2]"
    assert repair.parse_json('{"a": "} {"}') == '{"a": "} {"}'
    assert repair.parse_json(r'{"f": "\alpha"}') == r'{"f": "\\alpha"}'
    assert repair.parse_json("no json") is None and repair.parse_json(None) is None
    assert repair.parse_json('Here is the answer:\n{"a": 1, "b": [2, 3]}') == '{"a": 1, "b": [2, 3]}'
    assert repair.parse_json('```json\n{"pdf_type": "digital", "estimated_pages": 10}\n```') == '{"estimated_pages": 10, "pdf_type": "digital"}'
    assert repair.first_json('{"msg": "value has } inside"}') == '{"msg": "value has } inside"}'
    assert repair.first_json('x {"a": ]} y') == '{"a": ]}' and repair.first_json("[1, {2]}") == "[1, {2]" and repair.first_json('{"a": "open}') is None


def test_rewriting():
    assert repair.restore_controls("\times \frac") == (r"\times \frac", 2)
    assert repair.match_text("1. Été = α_2") == "ete equals alpha 2"
    assert repair.balance_braces("{a{b}") == ("{a{b}}", True) and repair.balance_braces("a}") == ("a}", False)
    assert repair.wrap_formula("$x{2$") == "$x{2}$"
    assert repair.tabular_rows(r"\begin{tabular}{cc} a & b \\ c & d \end{tabular}") == [["a", "b"], ["c", "d"]]
    found = repair.markdown_segments("intro\n| a | b |\n|---|---|\n| 1 | 2 |\nend")
    assert [s["kind"] for s in found] == ["text", "table", "text"] and found[1]["rows"] == [["1", "2"]]


@pytest.mark.parametrize("size, step", [(1, 1), (3, 1), (4, 2), (2, 5), (40, 20)])
def test_char_windows(spark, size, step):
    texts = ["", "ab", "abcd", "a\n\U0001d538c\U0001d539de", "xy\U0001f600" * 33, "q" * 99]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.char_windows(F.col("t"), size, step).alias("w")).collect()
    assert {r.t: r.w for r in got} == {t: [t[k : k + size] for k in range(0, len(t) - size + 1, step)] for t in texts}
