"""The cascade of figures against a plain version, over whole tables and for odd rows."""

import random
import re
import unicodedata
from collections import Counter, defaultdict
from functools import cache

import pytest
from pyspark.sql import functions as F

from docweft.functions import repair as R
from docweft.operators import placement as P
from docweft.plans import library
from docweft.plans.placement_queries import figure_tables
from docweft.sources.tables import table, written

SF = "/root/testdata/sf0.001"


@cache
def pattern(label):
    return re.compile(r"\b(?:figures?\s*(?:no\.?)?|figs?\.?)[\s._:\-]*[(\[]?\s*" + re.escape(label) + r"(?!\w)", re.I)


def names(text, label):
    """Where a text names a label, in any of the usual forms."""
    if not label:
        return None
    found = pattern(label).search(text) if text and label in text.lower() else None
    return found.start() if found else None


def number(label):
    found = re.search(r"\d+(?:\.\d+)*[a-z]?", (label or "").lower())
    return found.group() if found else ""


def stretches(a):
    if len(a) <= 30:
        return [a] if a else []
    if len(a) <= 40:
        return [a, a[:30]]
    return list(dict.fromkeys([a[:60], a[:30], *[a[s : s + 40] for s in range(0, len(a) - 39, 20)], a[-40:]]))


def bare(n):
    return re.sub(r"^q\.?\s*", "", (n or "").strip().lower()).strip("().[]{} \t")


class Plain:
    """One book at a time, every figure against everything."""

    def __init__(self, sections, blocks, questions, key):
        self.sections = sorted(sections, key=lambda s: (s.place, s.section))
        self.blocks, self.key = defaultdict(list), key
        for b in sorted(blocks, key=lambda b: b.block):
            self.blocks[b.section].append(b)
        self.questions = sorted(questions, key=lambda q: (q.place, q.question))

    def home(self, f):
        if any(s.section == f.section for s in self.sections):
            return f.section
        ranged = [s for s in self.sections if s.page_start is not None and s.page_end is not None]
        if f.page is None or not ranged:
            return None
        inside = [s for s in ranged if s.page_start <= f.page <= s.page_end]
        if inside:
            return min(inside, key=lambda s: s.page_end - s.page_start).section
        return min(ranged, key=lambda s: max(s.page_start - f.page, f.page - s.page_end)).section

    def place(self, f):
        return (self.ask if (f.context or "").lower() == "question" else self.theory)(f, self.home(f), number(f.label), (f.anchor or "").strip())

    def ask(self, f, home, label, anchor):
        first = lambda test: next((q for q in self.questions if test(q)), None)
        alone = lambda test: (lambda hits: hits[0] if len(hits) == 1 else None)([q for q in self.questions if test(q)])
        body = "solution" if f.body_type == "solution" else "question"
        want, ident = bare(f.question_no), bare(f.question_ref or f.question_no)
        by_uuid = alone(lambda q: f.section_uuid is not None and q.section_uuid == f.section_uuid)
        tries = [
            ("question_label", first(lambda q: names(q.raw_text, label) is not None or names(q.solution_text, label) is not None)),
            ("question_number", None if label else first(lambda q: want and bare(q.number) == want)),
            ("labelled_of_section_id" if label else "question_of_section_id", by_uuid),
            ("identifier_in_section", first(lambda q: ident and q.section == home and bare(q.number) == ident)),
            ("identifier_in_book", first(lambda q: ident and bare(q.number) == ident)),
            ("identifier_in_slug", first(lambda q: ident and (q.section or "").lower().endswith((f"-{ident}", f"::{ident}")))),
            ("only_question", alone(lambda q: home is not None and q.section == home)),
        ]
        method, q = next(((m, q) for m, q in tries if q), (None, None))
        if q is None:
            return ("section_end" if home else "unattached", home, None, None, None, None)
        if method == "question_label":
            body = "question" if names(q.raw_text, label) is not None else "solution"
        text = (q.solution_text if body == "solution" else q.raw_text) or ""
        at = names(text, label)
        if at is None and anchor and method not in ("question_label", "question_number", "question_of_section_id"):
            at = next((text.index(n) for n in (anchor[:60], anchor[:30]) if n in text), None)
        return method, q.section, q.question, body, None, len(text) if at is None else at

    def theory(self, f, home, label, anchor):
        if home is None:
            return "unattached", None, None, None, None, None
        hit = method = where = None
        if label:
            mine = self.blocks[home]
            figs = [b for b in mine if b.kind == "figure" and (label in (number(b.label), number(b.text)) or names(b.label, label) is not None or names(b.text, label) is not None)]
            texts = [b for b in mine if names(b.text, label) is not None]
            hit = next(iter(figs + texts), None)
            method, where = "label", home
            if hit is None:
                every = [(s, b) for s in self.sections for b in self.blocks[s.section]]
                # the index knows a mention by two parts at most
                pool = [(s, b) for s, b in every if b.kind == "figure" and label in (number(b.label), number(b.text))]
                pool = pool or [(s, b) for s, b in every if b.kind != "figure" and label.count(".") < 2 and label in self.known(b.text)]
                paged = [(s, b) for s, b in pool if None not in (f.page, s.page_start, s.page_end) and s.page_start <= f.page <= s.page_end]
                if pool:
                    method = "label_on_page" if paged else "label_elsewhere"
                    where, hit = (lambda s, b: (s.section, b))(*(paged or pool)[0])
        wanted = stretches(self.key[anchor]) if anchor else []
        has = lambda texts, some: next((k for n in some for k, t in enumerate(texts) if n in t), None)
        if hit is None and wanted:
            for s in [home, *[s.section for s in self.sections if s.section != home]]:
                k = has([self.key[b.text] for b in self.blocks[s]], wanted if s == home else [n for n in wanted if len(n) >= 40])
                if k is not None:
                    hit, where, method = self.blocks[s][k], s, "anchor" if s == home else "anchor_elsewhere"
                    break
        if hit is None:
            return "section_end", home, None, None, None, None
        above = (f.anchor_position or "").lower() == "above"
        item = has([self.key[x] for x in hit.items], wanted) if hit.items and len(hit.items) > 1 else None
        if item is not None:
            return method, where, None, None, hit.block, len("\n".join(hit.items[: item + above]))
        return method, where, None, None, hit.block if above else max(0, hit.block - 1), None

    @staticmethod
    @cache
    def known(text):
        return {m.group(1).lower() for m in re.finditer(r"\b(?:figures?\s*(?:no\.?)?|figs?\.?)[\s._:\-]*[(\[]?\s*(\d+(?:\.\d+)?[a-z]?)(?!\w)", text or "", re.I)}


def both(spark, tables):
    rows = {n: [r for r in t.collect()] for n, t in tables.items()}
    texts = {r.text for r in rows["blocks"]} | {x for r in rows["blocks"] for x in r["items"] or []} | {(r.anchor or "").strip() for r in rows["figures"]}
    frame = spark.createDataFrame([(t,) for t in texts if t is not None], "t string").select("t", R.match_key("t").alias("k"))
    key = {r.t: r.k or "" for r in frame.collect()} | {None: ""}
    want = {}
    for book in {r.book for r in rows["figures"]}:
        part = {n: [r for r in rows[n] if r.book == book] for n in rows}
        fields = lambda b: type("Block", (), b.asDict())
        plain = Plain(part["sections"], [fields(b) for b in part["blocks"]], part["questions"], key)
        for f in part["figures"]:
            want[book, f.figure] = plain.place(f)
    return want


def as_dict(df):
    got = {}
    for r in df.collect():
        assert (r.book, r.figure) not in got
        got[r.book, r.figure] = (r.method, r.section, r.question, r.target, r.block, r.char_offset)
    return got


def test_whole_table(spark):
    want = both(spark, figure_tables(spark, SF))
    got = as_dict(library.QUERIES["figure_cascade"](spark, SF))
    wrong = {k: (got.get(k), w) for k, w in want.items() if got.get(k) != w}
    assert not wrong, (len(wrong), len(want), list(wrong.items())[:8])
    assert got.keys() == want.keys()
    seen = Counter(r[0] for r in got.values())
    assert {"question_label", "question_number", "labelled_of_section_id", "identifier_in_book", "only_question", "label", "label_elsewhere", "anchor", "anchor_elsewhere", "section_end"} <= set(seen), seen


F_SCHEMA = "book string, figure string, context string, section string, section_uuid string, page int, label string, question_no string, question_ref string, body_type string, anchor string, anchor_position string"
S_SCHEMA = "book string, section string, place int, page_start int, page_end int"
B_SCHEMA = "book string, section string, block int, kind string, label string, text string, items array<string>"
Q_SCHEMA = "book string, question string, place int, number string, section string, section_uuid string, raw_text string, solution_text string"


@pytest.mark.parametrize("empty", ["none", "sections", "blocks", "questions", "figures"])
def test_odd_rows(spark, empty):
    figures = [
        ("b", "1", None, "a", None, None, None, None, None, None, None, None), ("b", "2", "question", "x", None, 3, "fig. (1.2)", None, None, None, "", "above"),
        ("b", "3", "theory", None, None, 100, "Figure 1", None, None, None, "one", "above"), ("b", "4", "question", "a", "u", None, None, "Q. 2", "Example 5", "solution", "日本", None),
        ("b", "5", "theory", "a", None, None, None, None, None, None, "x", "below"), ("b", "6", "question", None, None, None, None, None, None, None, None, None),
        ("b", "7", "theory", "c", None, 5, "Figure 9.1.2", None, None, None, "w " * 50, "above"), ("b", "8", "question", "c", None, 5, "2", None, "5", None, "stem of", None),
        ("c", "9", "question", "c", None, 5, None, None, "7", None, "stem of", None),
    ]
    sections = [("b", "a", 1, None, None), ("b", "c", 2, 4, 6), ("b", "d", 3, 4, 5), ("c", "k-example-7", 1, 1, 1)]
    blocks = [("b", "a", 0, "text", None, None, None), ("b", "a", 1, "text", None, "", [None, "", "x y"]), ("b", "a", 2, None, None, "one, two x y", ["one", "two", "x y"]), ("b", "c", 0, "text", None, "see Fig. 1.2 one", []), ("b", "c", 1, "figure", "Figure 1", None, None), ("b", "d", 0, "text", None, "ww " + "w " * 60, None)]
    questions = [("b", "p", 1, None, None, None, None, None), ("b", "q", 2, "Q2.", "a", "u", "stem of figure 1.2", None), ("b", "r", 3, "", "c", "u", "the stem of", "by Figure no. 1.25"), ("c", "s", 1, None, "k-example-7", None, "stem", "")]
    rows = {"figures": (figures, F_SCHEMA), "sections": (sections, S_SCHEMA), "blocks": (blocks, B_SCHEMA), "questions": (questions, Q_SCHEMA)}
    tables = {n: spark.createDataFrame([] if n == empty else r, s) for n, (r, s) in rows.items()}
    got = as_dict(P.place_figures(**tables))
    assert got == both(spark, tables)
    assert len(got) == (0 if empty == "figures" else len(figures))


def test_needles(spark):
    texts = ["", "a", "x" * 31, "abcdefghij" * 7, "lorem ipsum dolor sit amet consectetur ad 1"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", P.needles(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in got} == {t: stretches(t) for t in texts}


def test_stretches():
    for t in ["", "a", "x" * 31, "x" * 40, "abcdefghij" * 7, "lorem ipsum dolor sit amet consectetur ad 1", "w " * 90]:
        assert P.stretches(t) == stretches(t)


def test_match_text_is_that_of_its_steps():
    def plain(text):
        t = re.sub(r"\\([A-Za-z]+)", r" \1 ", re.sub(r"^\s*\(?[0-9]{1,3}[.)]\s+", "", text))
        for sign, word in (R.SIGNS | R.OPERATORS).items():
            t = t.replace(sign, f" {word} ")
        t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
        return " ".join(re.sub(r"[^\w\s]|_", " ", t.replace("^", "")).lower().split())

    rnd = random.Random(6)
    signs = "Aa \\^_(1.)=≠+ΣσςßÉe\u0301\u0327한İ＾\t\n\x85\xa0日²½𝔘α→"
    for _ in range(20_000):
        text = "".join(rnd.choice(signs) for _ in range(rnd.randrange(14)))
        assert R.match_text(text) == plain(text), text


def test_no_text_is_kept_twice(spark, monkeypatch):
    """Tables between the steps hold fewer characters than the documents."""
    sizes = []

    def measured(df):
        out = written(df)
        texts = [F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c, kind in out.dtypes if kind == "string"]
        sizes.append(out.agg(F.sum(sum(texts, F.lit(0)))).first()[0] or 0)
        return out

    monkeypatch.setattr(P, "written", measured)
    P.place_figures(**figure_tables(spark, SF)).count()
    whole = table(spark, SF, "documents").agg(F.sum(F.length("text"))).first()[0]
    assert sum(sizes) < whole, (sizes, whole)


def test_containing(spark):
    """Stretches of all lengths are found, and texts that are only similar to a needle give no row."""
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abcdefg hij𝔘é") for _ in range(n))
    common = word(25)
    texts = [("b" if k % 3 else "c", f"s{k % 7}", k, word(rnd.randrange(0, 120)) + common + word(rnd.randrange(0, 120))) for k in range(150)]
    texts += [("b", "short", 1, word(39)), ("b", "none", 2, None), ("b", "empty", 3, "")]
    needles = {common + word(n) for n in range(15, 36)}
    for _, _, _, key in texts[:150]:
        n = min(len(key), rnd.randrange(40, 61))
        at = rnd.randrange(0, len(key) - n + 1)
        needles |= {key[at : at + n]} if n >= 40 else set()
    wanted = spark.createDataFrame([("b", n) for n in needles] + [("c", n) for n in needles], "book string, needle string")
    frame = spark.createDataFrame(texts, "book string, section string, block int, key string")
    want = {}
    for book, section, block, key in texts:
        for n in needles:
            if key and n in key:
                want[book, n, section] = min(block, want.get((book, n, section), block))
    rows = P.containing(wanted, frame).collect()
    assert {(r.book, r.needle, r.section): r.block for r in rows} == want
    assert len(rows) == len(want) > 120
    assert P.containing(wanted.limit(0), frame).count() == 0


def test_crowded_section(spark):
    """A section with many figures is searched in several tasks, with the same result."""
    words = [f"block number {k} of a section that all figures name" for k in range(30)]
    texts = spark.createDataFrame([("b", "s", k, w) for k, w in enumerate(words)] + [("b", "t", 0, "alone"), ("b", None, 1, "x"), (None, "s", 2, words[3])], "book string, section string, block int, key string")
    sought = [("b", str(k), "s", words[k % 30][: 12 + k % 9] if k % 4 else f"no such text, and {k} times nothing at all of it") for k in range(200)] + [("b", "x", "t", "alone"), ("b", "y", "u", "alone")]
    sought = spark.createDataFrame(sought, "book string, figure string, home string, key string")
    one, many = ({(r.figure, r.home): (r.block, tuple(r.needles or ())) for r in P.in_section(sought, texts, n).collect()} for n in (1_000, 7))
    assert one == many and len(one) == 202
    assert one["x", "t"] == (0, ()) and one["y", "u"] == (None, ()) and one["29", "s"][0] == 2 and one["4", "s"][0] is None and one["4", "s"][1]


def test_split_lists(spark):
    lists = [(1, ["a", "", "ccc", None]), (2, []), (3, None), (4, ["x", "y"]), (5, ["", "z"])]
    figures = [(1, 0, 1), (1, 1, 2), (1, 2, 900), (1, 3, None), (1, 4, -3), (2, 0, 4), (3, 0, None), (5, 0, 0), (5, 1, 1), (9, 0, 1)]
    got = defaultdict(list)
    out = P.split_lists(spark.createDataFrame(lists, "list int, items array<string>"), spark.createDataFrame(figures, "list int, figure int, offset int"))
    for r in out.collect():
        got[r.list].append((r.part, r.nth, r.start, r.last, r.content, r.figure))
    assert sorted(got[1]) == [(0, 0, 1, False, "a", None), (0, 1, None, None, None, 0), (0, 2, None, None, None, 4), (1, 0, 2, False, "", None), (1, 1, None, None, None, 1),
                              (2, 0, 3, True, "ccc\n", None), (2, 1, None, None, None, 2), (2, 2, None, None, None, 3)]
    assert got[2] == got[3] == got[9] == [(0, 1, None, None, None, 0)]
    assert got[4] == [(0, 0, 1, True, "x\ny", None)]
    assert sorted(got[5]) == [(0, 0, 1, False, "", None), (0, 1, None, None, None, 0), (1, 0, 2, True, "z", None), (1, 1, None, None, None, 1)]
