"""Queries without SQL, over a whole test table, against plain versions written for the test."""

import json
import re
from collections import defaultdict
from difflib import SequenceMatcher

import pytest

from docweft.functions import text as X
from docweft.plans import library
from docweft.sources.tables import table

SF = "/root/testdata/sf0.001"
SHORT = 1_500  # characters up to which the quadratic plain versions are run


def result(spark, name):
    return library.QUERIES[name](spark, SF).collect()


def rows(spark, name, *columns):
    return table(spark, SF, name).select(*columns).collect()


@pytest.fixture(scope="module")
def pairs(spark):
    text = {r.doc_id: r.text or "" for r in rows(spark, "documents", "doc_id", "text")}
    return {k: (t, text[k + 1]) for k, t in text.items() if k + 1 in text}


@pytest.fixture(scope="module")
def turns(spark):
    out = defaultdict(list)
    for r in sorted(rows(spark, "conversations", "conv_id", "turn", "role", "text"), key=lambda r: (r.conv_id, r.turn)):
        out[r.conv_id].append(r)
    return out


def common(a, b):
    return SequenceMatcher(None, a, b, autojunk=False).find_longest_match().size


def ratio(a, b):
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def test_lcs_ratio(spark, pairs):
    got = {r.doc_id: r.ratio for r in result(spark, "lcs_ratio")}
    assert got.keys() == pairs.keys()
    some = {k: p for k, p in pairs.items() if max(map(len, p)) <= SHORT}
    assert len(some) > 20
    for k, (a, b) in some.items():
        assert got[k] == pytest.approx(common(a, b) / len(a) if a else 0.0, abs=1e-8)


def test_sequence_ratio(spark, pairs):
    got = {r.doc_id: r.ratio for r in result(spark, "sequence_ratio")}
    assert got.keys() == pairs.keys()
    for k, (a, b) in pairs.items():
        a, b = a.split("\n")[0], b.split("\n")[0]
        if max(len(a), len(b)) <= SHORT:
            assert got[k] == pytest.approx(ratio(a, b), abs=1e-8)


def test_fidelity_report(spark, pairs):
    got = {r.doc_id: r for r in result(spark, "fidelity_report")}
    assert got.keys() == pairs.keys()
    words = lambda t: {w for w in re.split("[^a-z0-9]+", t.lower()) if len(w) > 1} - set(X.STOPWORDS)
    for k, (a, b) in pairs.items():
        if max(len(a), len(b)) > SHORT:
            continue
        lcs = common(a, b) / len(a) if a else 0.0
        windows = [a[i : i + 10] for i in range(0, len(a) - 9, 5)]
        share = sum(w in b for w in windows) / len(windows) if windows else 0.0
        lost = any(n not in b for n in re.findall(r"[0-9]+\.?[0-9]*", a))
        options = ("(a)" in a) == ("(a)" in b)
        covered = len(words(a) & words(b)) / len(words(a)) if words(a) else 1.0
        score = 0.4 * (1 if lcs >= 0.85 else lcs) + 0.2 * (1 if share >= 0.8 else share) + 0.15 * (not lost) + 0.1 * options + 0.1 * (1 if covered >= 0.9 else covered) + 0.05 * bool(re.search(r"[.!?]\s*\Z", a))
        assert got[k].score == pytest.approx(score, abs=1e-6), k
        assert got[k].status == ("failed" if lcs < 0.85 else "flagged" if lost or not options else "passed")


def test_greedy_match(spark, turns):
    got = defaultdict(set)
    for r in result(spark, "greedy_match"):
        got[r.conv_id].add((r.found, r.truth, r.ratio))
    for conv, t in turns.items():
        a, b = [r for r in t if r.role == "assistant"], [r for r in t if r.role == "user"]
        score = {(i, j): ratio(x.text or "", y.text or "") for i, x in enumerate(a) for j, y in enumerate(b)}
        want, left, right = set(), set(range(len(a))), set(range(len(b)))
        while score:
            (i, j), s = max(score.items(), key=lambda x: (x[1], x[0]))
            if s < 0.3:
                break
            want.add((a[i].turn, b[j].turn, round(s, 9)))
            left.discard(i)
            right.discard(j)
            score = {k: v for k, v in score.items() if k[0] != i and k[1] != j}
        want |= {(None, b[j].turn, 0.0) for j in right} | {(a[i].turn, None, 0.0) for i in left}
        assert got[conv] == want


@pytest.fixture(scope="module")
def boxes(spark):
    out = defaultdict(dict)
    for r in rows(spark, "part", "p_partkey", "p_brand", "p_size"):
        k = r.p_partkey
        x, y = k % 7 * 10.0, k % 11 * 4.0
        out[f"{r.p_brand}-{r.p_size}"][k] = (x, y, x + 12 + k % 3, y + 5)
    return out


def area(b):
    return max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1])


def overlap(a, b):
    both = area((max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])))
    if min(a[2], b[2]) <= max(a[0], b[0]) or min(a[3], b[3]) <= max(a[1], b[1]):
        both = 0.0
    return both / (area(a) + area(b) - both)


def test_greedy_iou(spark, boxes):
    got = {(r.page, r.box): r.image for r in result(spark, "greedy_iou")}
    want = {}
    for page, found in boxes.items():
        free = sorted(k for k in found if k % 2 == 0)
        for k in sorted(k for k in found if k % 2):
            best = max(free, key=lambda i: (overlap(found[k], found[i]), -i), default=None)
            if best is not None and overlap(found[k], found[best]) > 0.3:
                want[page, k] = best
                free.remove(best)
    assert got == want


def test_box_clusters(spark, boxes):
    def near(a, b):
        width, height = max(a[2] - a[0], b[2] - b[0]), max(a[3] - a[1], b[3] - b[1])
        narrow = min(a[2] - a[0], b[2] - b[0])
        return (
            max(a[1], b[1]) - min(a[3], b[3]) <= 0.5 * height and width <= 2 * narrow and abs((a[0] + a[2]) / 2 - (b[0] + b[2]) / 2) <= 0.35 * width
            and min(a[2], b[2]) - max(a[0], b[0]) >= 0.55 * narrow
        )

    got = {r.id: r.cluster for r in result(spark, "box_clusters")}
    for found in boxes.values():
        left = set(found)
        while left:
            cluster, edge = set(), {min(left)}
            while edge:
                cluster |= edge
                edge = {k for k in left - cluster if any(near(found[k], found[i]) for i in edge)}
            assert {got[k] for k in cluster} == {min(cluster)}
            left -= cluster


@pytest.fixture(scope="module")
def lines(spark):
    out = defaultdict(list)
    for r in sorted(rows(spark, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"), key=tuple):
        out[r.l_orderkey].append(r)
    return out


def test_chip_question_claim(spark, lines):
    got = defaultdict(list)
    for r in result(spark, "chip_question_claim"):
        got[r.l_orderkey].append((r.chip, -1 if r.question is None else r.question))
    for order, own in lines.items():
        free, want = [r for r in own if r.l_linenumber % 2 == 0], []
        for c in [r for r in own if r.l_linenumber % 2]:
            hits = [q for q in free if q.l_suppkey % 4 == c.l_suppkey % 4] or [q for q in free if q.l_returnflag == c.l_returnflag]
            want.append((c.l_linenumber, hits[0].l_linenumber if hits else -1))
            if hits:
                free.remove(hits[0])
        assert sorted(got[order]) == sorted(want)


def test_anchor_cursor(spark, turns):
    got = {(r.conv_id, r.turn): (r.page, r.kind) for r in result(spark, "anchor_cursor")}
    for conv, t in turns.items():
        pages, cursor = [(r.text or "").lower() for r in t], 0
        for r in t:
            title = (r.text or "").split("\n")[0].strip().lower()
            hits = [k for k, p in enumerate(pages) if title in p]
            forward = [k for k in hits if k >= cursor]
            want = (forward[0], "forward") if forward else (hits[0], "anywhere") if hits else (None, "phantom")
            cursor = forward[0] if forward else cursor
            assert got[conv, r.turn] == want


def test_chunk_by_heading(spark):
    got = defaultdict(list)
    for r in sorted(result(spark, "chunk_by_heading"), key=lambda r: (r.doc_id, r.nth)):
        got[r.doc_id].append((r.begin, r.end, r.found))
    for r in rows(spark, "documents", "doc_id", "text"):
        text = r.text or ""
        headings, at, places = text.split("\n"), 0, []
        for h in headings:
            k = text.find(h, at) if h else -1
            places.append(None if k < 0 else k)
            at = at if k < 0 else k + 1
        ends = [min((p for p in places[n + 1 :] if p is not None), default=len(text)) for n in range(len(places))]
        assert got[r.doc_id] == [(p, None if p is None else e, p is not None) for p, e in zip(places, ends)]


def test_draft_op_fold(spark, lines):
    got = {r.l_orderkey: (r["items"], r.n_errors) for r in result(spark, "draft_op_fold")}
    for order, own in lines.items():
        names = [f"{r.l_linenumber}-{r.l_partkey}" for r in own]
        draft, errors = list(names), 0
        for name, r in zip(names, own):
            target, op = (name if r.l_partkey % 5 else "gone"), r.l_partkey % 4
            if op == 2:
                place = draft.index(names[0]) + 1 if names[0] in draft else len(draft)
                draft = [*draft[:place], target, *draft[place:]]
            elif target not in draft:
                errors += 1
            else:
                place = draft.index(target)
                rest = draft[:place] + draft[place + 1 :]
                draft = rest if op == 0 else [*draft[:place], f"{name}!", *draft[place + 1 :]] if op == 1 else [target, *rest]
        assert got[order] == (",".join(draft), errors)


def test_figure_placement(spark, turns):
    got = {(r.conv_id, r.figure): (r.block, r.method) for r in result(spark, "figure_placement")}
    for conv, t in turns.items():
        texts = [(r.text or "").lower() for r in t]
        for r in t:
            if r.turn % 3:
                continue
            label, anchor = f"figure {r.turn}", " ".join((r.text or "").split()[-4:]).lower()
            named = [k for k, x in enumerate(texts) if label in x]
            anchored = [k for k, x in enumerate(texts) if len(anchor) >= 10 and anchor in x]
            paged = [k for k, x in enumerate(t) if x.turn // 2 == r.turn // 2]
            if named:
                want = named[0], "label"
            elif anchored:
                want = (max(0, anchored[0] - 1) if r.turn % 2 else anchored[0]), "anchor"
            else:
                want = (paged[-1], "page") if paged else (None, "unattached")
            assert got[conv, r.turn] == want


def test_markdown_table_parse(spark):
    got = defaultdict(list)
    for r in sorted(result(spark, "markdown_table_parse"), key=lambda r: (r.doc_id, r.nth)):
        got[r.doc_id].append(r)
    divider = re.compile(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")
    for r in rows(spark, "documents", "doc_id", "text"):
        own = (r.text or "").split("\n")
        tables = sum("|" in a and "-" in b and "|" in b and bool(divider.match(b)) for a, b in zip(own, own[1:]))
        assert sum(s.kind == "table" for s in got[r.doc_id]) == tables
        if not tables and (r.text or "").strip():
            assert [s.kind for s in got[r.doc_id]] == ["text"]


def test_json_repair(spark):
    got = {r.event_id: r.json for r in result(spark, "json_repair")}
    for r in rows(spark, "events", "event_id", "props"):
        assert got[r.event_id] == (None if r.props is None else json.dumps(json.loads(r.props), ensure_ascii=False, sort_keys=True))


def test_match_normalise(spark):
    got = {r.item_id: r.key for r in result(spark, "match_normalise")}
    for r in rows(spark, "benchmark", "item_id", "text"):
        if r.text.isascii() and not re.search(r"[\\+=<>*/^_$-]", r.text):
            bare = re.sub(r"^\s*\(?\d+[.)]\s*", "", r.text)
            assert got[r.item_id] == " ".join(re.sub("[^a-z0-9]+", " ", bare.lower()).split())


def test_final_merge_doc(spark, turns):
    got = {r.conv_id: r.markdown for r in result(spark, "final_merge_doc")}
    wrap = {"system": "## {}", "user": "**{}**"}
    for conv, t in turns.items():
        runs = []
        for r in t:
            if r.turn % 8 == 7 or (r.turn % 4 == 3 and r.text is None):
                continue
            text = " ".join(w[:1].title() + w[1:].lower() for w in (r.text or "").split(" ")) if r.turn % 4 == 3 else r.text or ""
            if runs and runs[-1][0] == r.role:
                runs[-1][1].append(text)
            else:
                runs.append((r.role, [text]))
        want = "\n\n".join(wrap.get(role, "{}").format("\n".join(x)) for role, x in runs)
        assert (got[conv] if runs else "") == want


def test_text_repairs(spark):
    for r in result(spark, "text_repairs"):
        assert r.restored == f"a \\frac{{1}}{{2}} and \\times {r.k}" and r.wrapped == f"$\\frac{{{r.k}}}{{2}}$"
        assert json.loads(r.cells) == [["a", str(r.k)], ["c", "d"]]


def test_figure_cascade(spark):
    from tests import test_placement as plain

    assert plain.as_dict(library.QUERIES["figure_cascade"](spark, SF)) == plain.both(spark, plain.figure_tables(spark, SF))
