"""Packing: an exact round trip, and the plan against the best of all plans."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docweft.llm import packing

from . import data

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@given(st.lists(st.integers(1, 6), min_size=1, max_size=10), st.data())
@settings(max_examples=200, deadline=None)
def test_plan_is_best(steps, draw):
    cuts = np.concatenate([[0], np.cumsum(steps)])
    penalties = np.array([0.0] + [draw.draw(st.sampled_from([0.0, 1.0, 5.0])) for _ in steps])
    exact = np.array([False] + [draw.draw(st.booleans()) for _ in steps])
    window = 8
    best = [0.0] + [float("inf")] * len(steps)
    for j in range(1, len(cuts)):
        for i in range(j):
            n = cuts[j] - cuts[i]
            if n <= window:
                pad = 0 if exact[j] and n & (n - 1) == 0 else window - n
                best[j] = min(best[j], best[i] + pad + penalties[j])
    path, cost = packing.plan(cuts, penalties, exact, window)
    assert abs(cost - best[-1]) < 1e-9 and path[0] == 0 and path[-1] == len(cuts) - 1
    assert all(0 < cuts[b] - cuts[a] <= window for a, b in zip(path, path[1:]))


def check(docs, pieces, texts):
    """Each id in one piece, in order; windows gapless and at most 2048 long."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    want = sorted(tuple(t.encode(x or "", add_special_tokens=False).ids + [1]) for x in texts)
    by_window, whole = defaultdict(list), []
    for p in pieces:
        by_window[p.sequence_id].append(p)
    run: dict = {}
    for s in sorted(by_window):
        at = 0
        for p in sorted(by_window[s], key=lambda p: p.offset):
            assert p.offset == at and len(p.ids) == p.length > 0
            at += p.length
            part = s >> 32
            run.setdefault(part, []).append(p)
        assert at <= 2048
    for part in run.values():
        ids: list = []
        for p in part:
            assert p.start == len(ids)
            ids += p.ids
            if len(ids) == p.doc_tokens:
                whole.append(tuple(ids))
                ids = []
        assert not ids
    assert sorted(whole) == want


def test_round_trip(spark, monkeypatch):
    docs = data.documents(spark).cache()
    pieces = packing.pack_documents(docs, RANKS, PATTERN).collect()
    check(docs, pieces, [r.text for r in docs.collect()])


def test_short_runs_give_the_same_pieces_of_documents():
    """The stream is planned in runs; with runs of any size each id lies in one piece."""
    rng = np.random.default_rng(1)
    docs = [(str(k), rng.integers(0, 9, n).astype(np.uint32), rng.random(n) < 0.1) for k, n in enumerate(rng.integers(1, 3000, 60).tolist())]
    old = packing.RUN
    try:
        packing.RUN = 5_000
        pieces = list(packing.pack_stream(iter(docs)))
    finally:
        packing.RUN = old
    joined = defaultdict(list)
    for name, start, ids, whole, seq, offset in pieces:
        assert start == sum(len(x) for x in joined[name]) and len(ids)
        joined[name].append(ids)
    assert all((np.concatenate(joined[name]) == ids).all() for name, ids, _ in docs)
    size = defaultdict(int)
    for _, _, ids, _, seq, offset in pieces:
        assert size[seq] == offset
        size[seq] += len(ids)
    full = sum(len(ids) for _, ids, _ in docs)
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in size.values())
    assert max(size.values()) <= 2048 and padding < 0.1 * full


def test_digest_and_empty(spark):
    docs = data.documents(spark, n=5)
    a = packing.pack_documents(docs, RANKS, PATTERN, digest=packing.crc32, digest_type="long").collect()
    b = packing.pack_documents(docs, RANKS, PATTERN).collect()
    key = lambda r: (r.sequence_id, r.offset)
    assert [r.ids for r in sorted(a, key=key)] == [zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in sorted(b, key=key)]
    assert packing.pack_documents(data.empty(spark), RANKS, PATTERN).count() == 0
