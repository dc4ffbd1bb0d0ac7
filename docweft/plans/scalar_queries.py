"""Queries over the rules on blocks, labels, numbers and formulas. Their inputs are made from keys, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import blocks as B
from ..functions import repair
from ..functions import rules as R
from ..functions import text as X
from ..sources.tables import table
from .registry import query


def quoted(x) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


def sql_lookup(x: str, names: dict[str, str], default: str) -> str:
    whens = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in names.items())
    return f"CASE {x} {whens} ELSE {quoted(default)} END"


def pick(values, k):
    """The value whose turn it is for this key."""
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


def parts(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"))


RAW_TYPES = [*B.BLOCK_TYPES, *B.BLOCK_ALIASES, "Body", " TEXT ", "widget", None]
NAMES = {t: t for t in B.BLOCK_TYPES} | B.BLOCK_ALIASES


@query(f"""WITH r AS (SELECT p_partkey AS k, {sql_list(RAW_TYPES)}[p_partkey % {len(RAW_TYPES)} + 1] AS raw FROM part)
SELECT k, raw, {sql_lookup('lower(trim(raw))', NAMES, 'p')} AS type, NOT coalesce(list_contains({sql_list(NAMES)}, lower(trim(raw))), false) AS coerced FROM r""")
def block_types(spark, d):
    """Names of block types as canonical ones; unknown ones become paragraphs, and are marked."""
    raw = parts(spark, d).select("k", pick(RAW_TYPES, F.col("k")).alias("raw"))
    return raw.select("k", "raw", B.block_type(F.col("raw")).alias("type"), B.is_coerced(F.col("raw")).alias("coerced"))


RAW_SECTIONS = [*B.SECTION_TYPES, *B.SECTION_ALIASES, "Unit", "TOPIC", "other"]


@query(f"""WITH r AS (SELECT p_partkey AS k, {sql_list(RAW_SECTIONS)}[p_partkey % {len(RAW_SECTIONS)} + 1] AS raw FROM part)
SELECT k, raw, CASE WHEN list_contains({sql_list(B.SECTION_TYPES)}, raw) THEN raw ELSE {sql_lookup('lower(raw)', B.SECTION_ALIASES, 'subsection')} END AS type FROM r""")
def section_types(spark, d):
    """Names of section types as canonical ones."""
    raw = parts(spark, d).select("k", pick(RAW_SECTIONS, F.col("k")).alias("raw"))
    return raw.select("k", "raw", B.section_type(F.col("raw")).alias("type"))


TONES, TONGUES = [*B.OLD_TONES, "academic_rigorous", None, "own"], ["en", "hi", "fr", None, "de"]


@query(f"""WITH r AS (SELECT p_partkey AS k, {sql_list(TONES)}[p_partkey % {len(TONES)} + 1] AS tone, {sql_list(TONGUES)}[p_partkey % {len(TONGUES)} + 1] AS language FROM part)
SELECT k, {sql_lookup('tone', B.OLD_TONES, '')} || CASE WHEN list_contains({sql_list(B.OLD_TONES)}, tone) THEN '' ELSE coalesce(tone, '') END AS tone,
CASE WHEN language IS NULL THEN '' WHEN language IN ('en', 'hi') THEN language ELSE 'en' END AS language, 'keep' AS other, 3::INTEGER AS n FROM r""")
def legacy_params(spark, d):
    """Stored parameters with old tones renamed and languages of no use replaced; other keys stay, empty ones go."""
    k = F.col("k")
    raw = F.create_map(F.lit("tone"), pick(TONES, k), F.lit("language"), pick(TONGUES, k), F.lit("other"), F.lit("keep"))
    m = F.col("m")
    rows = parts(spark, d).select("k", B.legacy_params(raw).alias("m"))
    get = lambda name: F.coalesce(F.element_at(m, name), F.lit("")).alias(name)
    return rows.select("k", get("tone"), get("language"), get("other"), F.size(m).alias("n"))


LABEL_FORMS = ["Figure {n}", "Fig. {n} Discharge tube", "(FIGURE {n})", "fig no. {n}a", "Table {n}", "no number", "{n}b caption"]
LABEL_SQL = "(SELECT p_partkey AS k, (p_partkey % 23) || '.' || (p_partkey % 7) AS n FROM part)"
LABEL_TEXT = f"replace({sql_list(LABEL_FORMS)}[k % {len(LABEL_FORMS)} + 1], '{{n}}', n)"


def labels(spark, d):
    k = F.col("k")
    number = F.concat_ws(".", k % 23, k % 7)
    return parts(spark, d).select("k", F.replace(pick(LABEL_FORMS, k), F.lit("{n}"), number).alias("label"))


@query(rf"""WITH l AS (SELECT k, {LABEL_TEXT} AS label FROM {LABEL_SQL}), m AS (SELECT k, label, lower(regexp_extract(regexp_replace(trim(label), '(?i)(^|[^a-z0-9_])(?:figures?|figs?\.?|fig\s*no\.?|table)\s*', '\1', 'g'), '(?i)\d+(?:\.\d+)*[a-z]?')) AS number FROM l)
SELECT k, label, number, CASE WHEN number = '' THEN '' ELSE 'figure ' || number || '|fig ' || number || '|fig. ' || number || '|(fig ' || number || ')|(figure ' || number || ')|(fig. ' || number || ')' END AS variants FROM m""")
def figure_labels(spark, d):
    """A figure's number from its label, and how texts may name it."""
    rows = labels(spark, d).withColumn("number", B.figure_number(F.col("label")))
    return rows.select("k", "label", "number", F.when(F.col("number") == "", "").otherwise(F.array_join(B.label_variants(F.col("number")), "|")).alias("variants"))


CHIP_LABELS = ["Exercise {a}({r})", "Example {a}.{b}", "Question", "EXAMPLE {a} [{r}]", None]
CHIP_NUMBERS = ["{b}", None, "Q {a}", "{a}(iii)"]
CHIP_KINDS = ["example_ref", "exercise_ref", "question_ref", "p"]
CHIP_SQL = f"""(SELECT k, {sql_list(CHIP_KINDS)}[k % 4 + 1] AS kind, replace(replace(replace({sql_list(CHIP_LABELS)}[k % 5 + 1], '{{a}}', a), '{{b}}', b), '{{r}}', r) AS label,
 replace(replace({sql_list(CHIP_NUMBERS)}[k % 7 % 4 + 1], '{{a}}', a), '{{b}}', b) AS number, 'unit-' || a || '-example-' || b AS section
 FROM (SELECT p_partkey AS k, CAST(p_partkey % 9 AS VARCHAR) AS a, CAST(p_partkey % 5 AS VARCHAR) AS b, {sql_list(B.ROMANS)}[p_partkey % 16 + 1] AS r FROM part))"""
ROMAN_SQL = f"list_position({sql_list(B.ROMANS)}, lower(regexp_extract({{0}}, '(?i)(\\d+)\\s*[\\(\\[]\\s*([ivx]+)\\s*[\\)\\]]', 2)))"
SUB_SQL = f"CASE WHEN coalesce({ROMAN_SQL}, 0) > 0 THEN regexp_extract({{0}}, '(?i)(\\d+)\\s*[\\(\\[]\\s*([ivx]+)\\s*[\\)\\]]', 1) || '.' || {ROMAN_SQL} END"
NUM_SQL = r"nullif(regexp_extract({0}, '\d+(?:\.\d+)*'), '')"


@query(f"""SELECT k, {SUB_SQL.format('label')} AS part, CASE WHEN kind <> 'p' THEN coalesce({SUB_SQL.format('label')}, {SUB_SQL.format('number')}, {NUM_SQL.format('number')}, {NUM_SQL.format('label')}, {NUM_SQL.format('section')}) END AS chip,
coalesce({NUM_SQL.format('number')}, {NUM_SQL.format('label')}, {NUM_SQL.format("string_split(section, '-')[-1]")}, {NUM_SQL.format('section')}) AS question FROM {CHIP_SQL}""")
def chip_numbers(spark, d):
    """The numbers that reference blocks and questions go by, with parts in Roman numerals as decimals."""
    k = F.col("k")
    a, b = (k % 9).cast("string"), (k % 5).cast("string")
    roman = F.get(F.array(*map(F.lit, B.ROMANS)), (k % 16).cast("int"))
    fill = lambda c: F.replace(F.replace(F.replace(c, F.lit("{a}"), a), F.lit("{b}"), b), F.lit("{r}"), roman)
    fill2 = lambda c: F.replace(F.replace(c, F.lit("{a}"), a), F.lit("{b}"), b)
    rows = parts(spark, d).select(
        "k", pick(CHIP_KINDS, k).alias("kind"), fill(pick(CHIP_LABELS, k)).alias("label"), fill2(pick(CHIP_NUMBERS, k % 7)).alias("number"), F.concat(F.lit("unit-"), a, F.lit("-example-"), b).alias("section")
    )
    kind, label, number, section = (F.col(c) for c in ("kind", "label", "number", "section"))
    return rows.select("k", B.subquestion(label).alias("part"), B.chip_number(kind, label, number, section).alias("chip"), B.question_own_number(number, label, section).alias("question"))


LINE_FORMS = ["EXAMPLE {n}.1 Find", "  Q.{n} What", "Question {n}: why", "{n}. Show that", "1.5 metres", "Practice Problem {n}", "Worked example {n}", "(a) part"]
MARK_SQL = "coalesce(" + ", ".join(f"nullif(regexp_extract(line, {quoted(p)}, 1), '')" for p in B.QUESTION_MARKS) + ")"


@query(f"""WITH t AS (SELECT p_partkey AS k, list_transform(range(0, 6), lambda i: replace({sql_list(LINE_FORMS)}[(p_partkey + i * i) % {len(LINE_FORMS)} + 1], '{{n}}', CAST((p_partkey + i) % 4 + 1 AS VARCHAR))) AS lines FROM part),
l AS (SELECT k, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM t), m AS (SELECT k, {MARK_SQL} AS no, min(i) AS i FROM l GROUP BY ALL)
SELECT t.k, count(no) AS n, coalesce(string_agg(no, ',' ORDER BY i) FILTER (no IS NOT NULL), '') AS numbers FROM t LEFT JOIN m ON m.k = t.k GROUP BY t.k""")
def printed_questions(spark, d):
    """Question numbers printed at the begins of lines: how many, and which, in order."""
    forms = F.array(*map(F.lit, LINE_FORMS))
    k = F.col("k")
    line = lambda i: F.replace(F.element_at(forms, ((k + i * i) % len(LINE_FORMS) + 1).cast("int")), F.lit("{n}"), ((k + i) % 4 + 1).cast("string"))
    rows = parts(spark, d).select("k", F.concat_ws("\n", *[line(i) for i in range(6)]).alias("text"))
    found = B.printed_questions(F.col("text"))
    return rows.select("k", F.size(found).cast("long").alias("n"), F.array_join(found, ",").alias("numbers"))


EQUATIONS = ["E = 931.5 MeV", "F = ma", "1 u = 1.66 × 10^{-27} kg", "$\\frac{a}{b} = c$", "The mass of a proton = 1.0 u", "H2SO4", "CaCl2", "sin x + cos y", "x^2 + 1", "plain words here and there", "C6H12O6 + O2"]
UNIT_SQL, WORDS_SQL = quoted(B.UNIT), sql_list(B.MATH_WORDS)


@query(f"""WITH e AS (SELECT p_partkey AS k, {sql_list(EQUATIONS)}[p_partkey % {len(EQUATIONS)} + 1] AS eq FROM part), b AS (SELECT *, trim(rtrim(ltrim(trim(eq), '$'), '$')) AS bare FROM e)
SELECT k, eq, regexp_matches(eq, {quoted(B.MATH_SIGN)}) AS math, len(regexp_extract_all(eq, {quoted(B.ELEMENT)})) >= 3 AND regexp_matches(eq, '[0-9]') AS formula,
len(list_filter(regexp_extract_all(bare, '[A-Za-z]{{3,}}'), lambda w: NOT list_contains({WORDS_SQL}, lower(w)))) >= 3 OR (regexp_matches(bare, {quoted(B.POWER_OF_TEN)}) AND regexp_matches(bare, {UNIT_SQL}))
OR (contains(bare, '=') AND regexp_matches(bare, {UNIT_SQL}) AND regexp_matches(bare, '[0-9]+\\.[0-9]+|[0-9]{{2,}}')) AS prose FROM b""")
def equation_tests(spark, d):
    """Whether a text has signs of mathematics, is a chemical formula, or an equation that is prose."""
    rows = parts(spark, d).select("k", pick(EQUATIONS, F.col("k")).alias("eq"))
    e = F.col("eq")
    return rows.select("k", "eq", B.has_math(e).alias("math"), B.is_formula(e).alias("formula"), B.is_prose_equation(e).alias("prose"))


QUESTIONS = ["What is x? (A) one, (B) two, (C) three (D) four", "Pick (1) red (2) blue", "No options (a) here (b) there", "Only (A) one", "Stem\n(A) first line\nsecond (B) other"]
SOLUTIONS = ["Ans. (B)\nBecause of this.", "Answer: 5\n\n. Then more", "(c)\nrest", "We see that x = 1.", "", "  ans: 7  "]


@query(f"""WITH q AS (SELECT p_partkey AS k, {sql_list(QUESTIONS)}[p_partkey % {len(QUESTIONS)} + 1] AS q, {sql_list(SOLUTIONS)}[p_partkey % {len(SOLUTIONS)} + 1] AS s FROM part),
o AS (SELECT k, q, trim(regexp_replace(q, '(?s)\\(([A-D1-4])\\).*$', '')) AS stem, regexp_extract_all(q, '\\(([A-D1-4])\\)', 1) AS letters, regexp_split_to_array(q, '\\([A-D1-4]\\)')[2:] AS bodies, regexp_replace(s, '^\\s+|\\s+$', '', 'g') AS s FROM q),
a AS (SELECT *, trim(split_part(s, chr(10), 1)) AS line FROM o)
SELECT k, stem, CASE WHEN len(letters) >= 2 THEN array_to_string(list_transform(list_zip(letters, bodies), lambda z: z[1] || '=' || trim(rtrim(regexp_replace(rtrim(z[2]), '\\(+$', ''), ', '))), '|') ELSE '' END AS options,
CASE WHEN regexp_matches(line, '(?i)^(ans\\.?:?|answer:?\\.?|\\([a-d]\\))') THEN line ELSE '' END AS answer,
CASE WHEN regexp_matches(line, '(?i)^(ans\\.?:?|answer:?\\.?|\\([a-d]\\))') THEN ltrim(substr(s, length(line) + 1), chr(10) || ' .:') ELSE s END AS solution FROM a""")
def question_parts(spark, d):
    """Questions cut into stem and options, solutions into answer and the rest."""
    k = F.col("k")
    rows = parts(spark, d).select("k", pick(QUESTIONS, k).alias("q"), pick(SOLUTIONS, k).alias("s"))
    options = F.array_join(F.transform(B.options(F.col("q")), lambda o: F.concat(o["letter"], F.lit("="), o["body"])), "|")
    both = B.answer_and_solution(F.col("s"))
    return rows.select("k", B.stem(F.col("q")).alias("stem"), options.alias("options"), both["answer"].alias("answer"), both["solution"].alias("solution"))


BROKEN = '[{"text": "part {k}", "bbox_2d": [{k}, 2, -3, 40]}, {"text": "part {k}", "bbox_2d": [{k}, 2, -3, 40]} {"text":"b","bbox_2d":[1,2,3,4], "x": 1'


@query(f"""WITH t AS (SELECT p_partkey AS k, replace({quoted(BROKEN)}, '{{k}}', CAST(p_partkey AS VARCHAR)) AS t FROM part),
m AS (SELECT DISTINCT k, unnest(regexp_extract_all(t, {quoted(B.LABEL_BOX)}, 1)) AS text, {', '.join(f"CAST(unnest(regexp_extract_all(t, {quoted(B.LABEL_BOX)}, {g})) AS INTEGER) AS {n}" for g, n in zip(range(2, 6), ('x0', 'y0', 'x1', 'y1')))} FROM t)
SELECT * FROM m""")
def label_salvage(spark, d):
    """Labels with their boxes out of broken JSON, each once."""
    rows = parts(spark, d).select("k", F.replace(F.lit(BROKEN), F.lit("{k}"), F.col("k").cast("string")).alias("t"))
    return rows.select("k", F.inline(B.label_boxes(F.col("t"))))


@query("SELECT p_partkey AS k, 'Write ' || p_size || ' notes on ' || p_name || ' for {reader}.' AS prompt FROM part")
def template_render(spark, d):
    """A prompt with known names filled in and unknown ones left as they are."""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_name", "p_size")
    return rows.select("k", B.filled(F.lit("Write {n} notes on {topic} for {reader}."), {"n": F.col("p_size").cast("string"), "topic": F.col("p_name")}).alias("prompt"))


@query("""WITH u AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderkey % 5 - 1 AS INTEGER) END AS expected, CAST(o_orderkey % 3 AS INTEGER) AS got FROM orders)
SELECT k, expected, got, coalesce(expected > 0 AND got < expected, false) AS incomplete FROM u""")
def completeness(spark, d):
    """Units with fewer questions than expected; without an expectation none is incomplete."""
    k = F.col("o_orderkey")
    u = table(spark, d, "orders").select(k.alias("k"), F.when(k % 5 > 0, (k % 5 - 1).cast("int")).alias("expected"), (k % 3).cast("int").alias("got"))
    return u.withColumn("incomplete", B.is_incomplete(F.col("expected"), F.col("got")))


@query("""WITH o AS (SELECT o_custkey AS book, o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'A.' || o_orderkey % 4 ELSE (o_orderkey % 3) || '.' || (o_orderkey % 17) END AS num FROM orders),
p AS (SELECT *, list_transform(string_split(num, '.'), lambda x: {'w': CASE WHEN regexp_matches(x, '^[0-9]+$') THEN 0 ELSE 1 END, 'n': CASE WHEN regexp_matches(x, '^[0-9]+$') THEN CAST(x AS BIGINT) ELSE 0 END, 't': CASE WHEN regexp_matches(x, '^[0-9]+$') THEN '' ELSE lower(x) END}) AS key FROM o)
SELECT k, num, row_number() OVER (PARTITION BY book ORDER BY key, k) AS place FROM p""")
def dotted_order(spark, d):
    """Examples of a book in order of their dotted numbers, parts compared as numbers, words after numbers."""
    k = F.col("o_orderkey")
    num = F.when(k % 11 == 0, F.concat(F.lit("A."), (k % 4).cast("string"))).otherwise(F.concat_ws(".", k % 3, k % 17))
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("book"), k.alias("k"), num.alias("num"))
    place = F.row_number().over(Window.partitionBy("book").orderBy(B.dotted_order(F.col("num")), "k"))
    return rows.select("k", "num", place.alias("place"))


SETS = [["theory"], ["questions"], ["figures", "theory"], ["theory", "questions"], [], None, ["Theory"], ["questions", "figures", "questions"]]
SETS_SQL = "[" + ", ".join("NULL" if s is None else sql_list(s) if s else "[]::VARCHAR[]" for s in SETS) + "]"


@query(f"""WITH s AS (SELECT p_partkey AS k, {SETS_SQL}[p_partkey % {len(SETS)} + 1] AS t FROM part)
SELECT k, CASE WHEN t IS NULL THEN 'missing' WHEN len(t) = 0 THEN 'empty' WHEN len(list_filter(t, lambda x: x NOT IN ('theory', 'questions', 'figures'))) > 0 THEN 'unknown'
WHEN array_to_string(list_sort(list_distinct(t)), '+') NOT IN ('theory', 'questions', 'figures+theory', 'figures+questions') THEN 'combination' END AS problem,
coalesce(list_has_any(t, ['theory', 'figures']), false) AS has_theory_or_figures, coalesce(list_has_all(['theory', 'figures'], t), false) AS only_theory_or_figures FROM s""")
def content_type_sets(spark, d):
    """What is wrong with a section's set of content types, and tests for overlap and subset."""
    arrays = F.array(*[F.lit(None).cast("array<string>") if s is None else F.array(*map(F.lit, s)).cast("array<string>") for s in SETS])
    rows = parts(spark, d).select("k", F.get(arrays, (F.col("k") % len(SETS)).cast("int")).alias("t"))
    both = F.array(F.lit("theory"), F.lit("figures"))
    overlap, rest = F.arrays_overlap("t", both), F.size(F.array_except("t", both)) == 0
    return rows.select("k", B.content_verdict(F.col("t")).alias("problem"), F.coalesce(overlap, F.lit(False)).alias("has_theory_or_figures"), F.coalesce(F.when(F.col("t").isNotNull(), rest), F.lit(False)).alias("only_theory_or_figures"))


SLUGS = ["unit-example-3", "example-7", "unit-exercise-2", "unit-text-1", "unit-practice-9"]
HEADS = ["EXAMPLE 3", "Worked Example", "WORKED EXAMPLE 2", "Text", "Solved problems", "PRACTICE set", "Illustration 4", "resolved"]
SECTION_KINDS = ["example", " Example ", None, "exercise"]


@query(f"""WITH s AS (SELECT p_partkey AS k, {sql_list(SLUGS)}[p_partkey % 5 + 1] AS slug, {sql_list(HEADS)}[p_partkey % 8 + 1] AS title, {sql_list(SECTION_KINDS)}[p_partkey % 7 % 4 + 1] AS kind FROM part)
SELECT k, regexp_matches(lower(slug), '-(example|exercise|problem|practice|question)-') OR regexp_matches(title, '^(EXAMPLE |EXERCISE |WORKED EXAMPLE|PROBLEM |PRACTICE )') AS question_section,
regexp_matches(lower(slug), '-example-|^example-') OR regexp_matches(lower(title), '^(example |worked example)') AS worked,
coalesce(lower(trim(kind)) = 'example', false) OR regexp_matches(title, '(?i)(^|[^A-Za-z0-9_])(worked\\s+example|solved\\s+example|example|solved|illustration)([^A-Za-z0-9_]|$)')
OR regexp_matches(slug, '(?i)(^|[^A-Za-z0-9_])(worked\\s+example|solved\\s+example|example|solved|illustration)([^A-Za-z0-9_]|$)') AS solution_due FROM s""")
def section_predicates(spark, d):
    """Whether a section is one of questions, a worked example, or one that must have printed solutions."""
    k = F.col("k")
    rows = parts(spark, d).select("k", pick(SLUGS, k).alias("slug"), pick(HEADS, k).alias("title"), pick(SECTION_KINDS, k % 7).alias("kind"))
    slug, title, kind = F.col("slug"), F.col("title"), F.col("kind")
    return rows.select("k", B.is_question_section(slug, title).alias("question_section"), B.is_worked_example(slug, title).alias("worked"), B.implies_solution(title, slug, kind).alias("solution_due"))


TEX = ["\\angleBAC = \\angle B", "$x^2 \\times y_1$", "\\frac{1}{2} \\foo{z} α ≤ β", "plain – text ‘q’", "\\triangleABC\\alpha\\beta", "∑ x → ∞ ½"]
GLYPH_SQL = "{}"
for _a, _b in B.GLYPHS.items():
    GLYPH_SQL = f"replace({GLYPH_SQL}, {quoted(_a)}, {quoted(_b)})"
WORD_SQL = "|".join(B.TEX_WORDS)


@query(f"""WITH t AS (SELECT p_partkey AS k, {sql_list(TEX)}[p_partkey % {len(TEX)} + 1] AS t FROM part), g AS (SELECT k, t, {GLYPH_SQL.format("replace(t, '½', '1⁄2')")} AS g FROM t),
c AS (SELECT k, t, regexp_replace(regexp_replace(regexp_replace(g, '[$]+', ' ', 'g'), '\\\\([a-zA-Z]+)', ' \\\\\\1 ', 'g'), '(?i)\\\\({WORD_SQL}) ', ' \\1 ', 'g') AS c FROM g)
SELECT k, regexp_replace(t, '\\\\(angle|triangle)([A-Za-z])', '\\\\\\1 \\2', 'g') AS spaced,
lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(c, '\\\\[a-zA-Z]+ ', ' ', 'g'), '[{{}}]', ' ', 'g'), '[\\^_]', '', 'g'), '\\s+', ' ', 'g'))) AS compared FROM c""")
def formula_text(spark, d):
    """Commands that stuck to a letter set apart, and formulas as the words by which they are compared with page text."""
    rows = parts(spark, d).select("k", pick(TEX, F.col("k")).alias("t"))
    return rows.select("k", B.spaced_commands(F.col("t")).alias("spaced"), B.page_text(F.col("t")).alias("compared"))


SIGNS_SQL = "regexp_replace(t, '\\\\([a-zA-Z]+)', '\\\\\\1' || chr(1), 'g')"
for _a, _b in B.TEX_SIGNS.items():
    SIGNS_SQL = f"regexp_replace({SIGNS_SQL}, '\\\\{_a}\\x01\\s?(?:\\{{\\}})?', {quoted(_b)}, 'g')"
FORMULAS = ["\\theta{} + \\alpha\\beta", "\\frac{180-2\\theta}{2}", "x \\in A \\int f", "\\infty \\unknown{x}", "a \\leq b \\Rightarrow c", "no command"]


@query(f"WITH t AS (SELECT p_partkey AS k, {sql_list(FORMULAS)}[p_partkey % {len(FORMULAS)} + 1] AS t FROM part) SELECT k, t, replace({SIGNS_SQL}, chr(1), '') AS signs FROM t")
def export_signs(spark, d):
    """Formulas for an export that knows signs but no commands."""
    rows = parts(spark, d).select("k", pick(FORMULAS, F.col("k")).alias("t"))
    return rows.select("k", "t", B.export_signs(F.col("t")).alias("signs"))


STATES = ["pending", "running", "done", "failed", "needs_review", "partial"]


def state_sql(n: int) -> str:
    return f"{sql_list(STATES)}[c_custkey // {n} % 6 + 1]"


@query(f"""WITH b AS (SELECT c_custkey AS book, ['done', 'done', {", ".join(map(quoted, STATES))}][c_custkey % 8 + 1] AS s, {state_sql(3)} AS t, {state_sql(5)} AS q, {state_sql(7)} AS f, c_custkey % 2 AS tries, c_custkey % 3 > 0 AS fin FROM customer),
r AS (SELECT *, (SELECT count(*) FROM b WHERE t = 'running') - (t = 'running')::INT AS running, t IN ('done', 'needs_review', 'partial') OR q IN ('done', 'partial') OR f IN ('done', 'partial') AS advanced FROM b)
SELECT book, CASE WHEN s = 'pending' AND NOT advanced THEN 'dispatch_analyse' WHEN s = 'failed' AND tries < 1 THEN 'retry_analyse' WHEN NOT (s IN ('done', 'needs_review') OR (s = 'pending' AND advanced)) THEN 'no_action'
WHEN t = 'pending' THEN CASE WHEN running >= 5 THEN 'no_action' ELSE 'dispatch_theory' END WHEN t = 'running' THEN 'no_action' WHEN t = 'failed' THEN CASE WHEN tries < 1 THEN 'retry_theory' ELSE 'finalize' END WHEN NOT fin THEN 'no_action'
WHEN q = 'failed' AND tries < 1 THEN 'retry_questions' WHEN f = 'failed' AND tries < 1 THEN 'retry_figures' WHEN q = 'pending' AND f = 'pending' THEN 'dispatch_both' WHEN q = 'pending' THEN 'dispatch_questions' WHEN f = 'pending' THEN 'dispatch_figures'
WHEN q <> 'running' AND f <> 'running' THEN 'finalize' ELSE 'no_action' END AS action FROM r""")
def next_actions(spark, d):
    """The next step of each book by the states of its stages, with self-healing, retries and a bound on books at theory at once."""
    k = F.col("book")
    state = lambda n: F.get(F.array(*map(F.lit, STATES)), (F.floor(k / n) % 6).cast("int"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("book"))
    b = b.select("book", pick(["done", "done", *STATES], k).alias("schema"), state(3).alias("theory"), state(5).alias("questions"), state(7).alias("figures"), (k % 2).alias("tries"), (k % 3 > 0).alias("fin"))
    at_it = b.agg(F.count_if(F.col("theory") == "running").alias("n")).first()["n"]
    others = F.lit(at_it) - F.when(F.col("theory") == "running", 1).otherwise(0)
    names = ["schema", "theory", "questions", "figures"]
    return b.select("book", R.next_action({n: F.col(n) for n in names}, {n: F.col("tries") for n in names}, F.col("fin"), others).alias("action"))


@query("""WITH j AS (SELECT event_id, user_id, event_type, ts, epoch(ts) AS t, (SELECT max(epoch(ts)) FROM events) - 900 AS cut FROM events)
SELECT event_id, coalesce((event_type = 'click' AND CASE WHEN event_id % 3 > 0 THEN t > cut ELSE t - 60 > cut END) OR (event_type = 'view' AND t > cut), false) AS fresh FROM j""")
def fresh_jobs(spark, d):
    """Jobs that are alive: running with a fresh heartbeat, or freshly started without one, or freshly queued."""
    e = table(spark, d, "events").select("event_id", "event_type", F.unix_timestamp("ts").cast("double").alias("t"))
    cut = e.crossJoin(F.broadcast(e.agg(F.max("t").alias("top"))))  # one row
    state = F.when(F.col("event_type") == "click", "running").when(F.col("event_type") == "view", "queued")
    beat = F.when(F.col("event_id") % 3 > 0, F.col("t"))
    return cut.select("event_id", R.freshness(state, beat, F.col("t") - 60, F.col("t"), F.col("top") - 900).alias("fresh"))


@query(r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t, trim(regexp_extract(coalesce(text, ''), '^[^.!?\n]*')) AS title FROM documents), w AS (SELECT doc_id, t, string_split_regex(title, ' +') AS w FROM t)
SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(lower(t), '[a-z0-9]{4,}'))) AS INTEGER) AS n_tokens, CAST(len(list_distinct([array_to_string(w, ' '), array_to_string(w[1:8], ' '), array_to_string(w[1:5], ' '), array_to_string(w[1:3], ' ')])) AS INTEGER) AS n_needles,
array_to_string(w[1:3], ' ') AS shortest, length(regexp_replace(t, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')) AS n_safe, trim(t) <> '' AS has_text,
CAST(CASE WHEN length(t) >= 40 THEN (length(t) - 40) // 20 + 1 ELSE 0 END AS INTEGER) AS n_windows, trim(regexp_replace(regexp_replace('{{fig: ' || doc_id || '}} seen {{fig:b}} here', '\{\{fig:[^}]*\}\}', '', 'g'), ' +', ' ', 'g')) AS bare FROM w""")
def text_helpers(spark, d):
    """Match tokens, needles, windows of 40 characters by 20, text safe for XML, and text without figure placeholders."""
    t = X.text_or_empty(F.col("text"))
    rows = table(spark, d, "documents").select("doc_id", t.alias("t"), F.trim(F.regexp_extract(t, r"^[^.!?\n]*", 0)).alias("title"))
    needles, t = R.needles(F.col("title")), F.col("t")
    marked = F.concat(F.lit("{{fig: "), F.col("doc_id").cast("string"), F.lit("}} seen {{fig:b}} here"))
    return rows.select(
        "doc_id", F.size(X.long_tokens(t)).alias("n_tokens"), F.size(needles).alias("n_needles"), F.element_at(needles, -1).alias("shortest"), F.length(R.xml_safe(t)).cast("long").alias("n_safe"),
        R.solution_flag(t).alias("has_text"), F.size(X.char_windows(t, 40, 20)).alias("n_windows"), R.placeholder_free(marked).alias("bare"),
    )


@query()
def text_repairs(spark, d):
    """Escapes that became control characters restored, formulas wrapped, and the cells of TeX tables."""
    k = F.col("k").cast("string")
    rows = parts(spark, d).select(
        "k", F.concat(F.lit("a \x0crac{1}{2} and \times "), k).alias("bad"), F.concat(F.lit("\\frac{"), k, F.lit("}{2")).alias("formula"),
        F.concat(F.lit("\\hline a & "), k, F.lit(" \\\\ c & d \\\\")).alias("tab"),
    )
    restored = repair.each(lambda t: repair.restore_controls(t)[0], T.StringType(), "bad")
    wrapped = repair.each(repair.wrap_formula, T.StringType(), "formula")
    cells = repair.each(repair.tabular_rows, T.ArrayType(T.ArrayType(T.StringType())), "tab")
    return rows.select("k", restored.alias("restored"), wrapped.alias("wrapped"), F.to_json(cells).alias("cells"))
