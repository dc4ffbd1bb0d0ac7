"""Predicates and classifications of titles, blocks, units and stages, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and patterns by which titles and texts are told apart. SQL engines without look-around can run them all.
NON_QUESTION = ["summary", "key points", "introduction", "table of contents", "glossary", "index", "appendix", "references", "answers", "preface"]
GENERIC = ["introduction", "summary", "conclusion", "exercises", "examples", "questions", "overview", "notes", "review"]
PUZZLE = "(crossword|word search|puzzle|riddle)"
INDIVIDUAL = r"^(q\.?|question|ex\.?|example|problem|exercise) *[0-9]+[.:)]?( |$)"
SOLUTION_START = r"^(sol\.?|solution|ans\.?|answer)[ .:]"
ACTIVITY = "(activity|experiment|project|lab work)"
KINDS = [("worked", "example"), ("example", "example"), ("exercise", "exercise"), ("problem", "exercise"), ("review", "question"), ("question", "question")]
MATH = r"(\\[a-z]+|[=<>^]|[0-9] *[+*/] *[0-9])"
TYPES = {"multiple choice": "mcq", "true or false": "tf", "fill": "blank", "short": "short", "long": "long", "numerical": "numeric"}


def any_of(c: Column, words: list[str]) -> Column:
    """Whether the text holds one of the words."""
    return F.lower(c).rlike("|".join(words))


def kind_of_title(c: Column, default: str = "section") -> Column:
    """The first rule whose word the title holds."""
    first, *rest = KINDS
    out = F.when(F.contains(F.lower(c), F.lit(first[0])), first[1])
    for word, kind in rest:
        out = out.when(F.contains(F.lower(c), F.lit(word)), kind)
    return out.otherwise(default)


def question_kind(c: Column) -> Column:
    """A question's type as a kind: other by default, exercise for none."""
    out = F.when(c.isNull(), "exercise")
    for word, kind in TYPES.items():
        out = out.when(F.contains(F.lower(c), F.lit(word)), kind)
    return out.otherwise("other")


def is_individual(c: Column) -> Column:
    """Whether a title is that of one question."""
    return F.lower(F.trim(c)).rlike(INDIVIDUAL)


def solution_bleed(text: Column, title: Column) -> Column:
    """A text that begins as a solution, but for activities."""
    return F.lower(text).rlike(SOLUTION_START) & ~any_of(title, [ACTIVITY])


def route(script: Column, equations: Column, density: Column, scanned: Column) -> Column:
    """The reader of a document: the first rule that holds."""
    return F.when(script.isin("hi", "ta", "bn"), "A").when((equations > 0) & (density > 0.3), "B").when(scanned, "C").otherwise("D")


def unit_class(expected: Column, got: Column, failed: Column) -> Column:
    return F.when(failed, "failed").when(got == 0, "empty").when(got < expected, "partial").otherwise("complete")


def next_action(stage: dict[str, Column], tries: dict[str, Column], finalized: Column, running: Column, most_tries: int = 1, most_running: int = 5) -> Column:
    """What a book needs next, from the states of its stages (schema, theory, questions, figures): the first rule that holds.

    A schema that is pending although later stages have got on counts as done. Theory waits while ``running`` other books are at it.
    """
    schema, theory, questions, figures = (stage[s] for s in ("schema", "theory", "questions", "figures"))
    advanced = theory.isin("done", "needs_review", "partial") | questions.isin("done", "partial") | figures.isin("done", "partial")
    again = lambda s: (stage[s] == "failed") & (F.coalesce(tries[s], F.lit(0)) < most_tries)
    schema_pending = (schema == "pending") & ~advanced
    ready = schema.isin("done", "needs_review") | ((schema == "pending") & advanced)
    over = ["done", "failed", "partial", "needs_review"]
    return (
        F.when(schema_pending, "dispatch_analyse").when(again("schema"), "retry_analyse").when(~ready, "no_action")
        .when((theory == "pending") & (running >= most_running), "no_action").when(theory == "pending", "dispatch_theory").when(theory == "running", "no_action")
        .when(again("theory"), "retry_theory").when(theory == "failed", "finalize").when(~finalized, "no_action")
        .when(again("questions"), "retry_questions").when(again("figures"), "retry_figures")
        .when((questions == "pending") & (figures == "pending"), "dispatch_both").when(questions == "pending", "dispatch_questions").when(figures == "pending", "dispatch_figures")
        .when(questions.isin(over) & figures.isin(over), "finalize").otherwise("no_action")
    )


def solution_flag(text: Column) -> Column:
    """A solution is there if its text is not blank."""
    return F.coalesce(F.trim(text) != "", F.lit(False))


def freshness(state: Column, beat: Column, started: Column, created: Column, cut: Column) -> Column:
    """Running with a fresh heartbeat, or freshly started without one, or freshly queued."""
    running = (state == "running") & F.when(beat.isNotNull(), beat > cut).otherwise(started > cut)
    return F.coalesce(running | ((state == "queued") & (created > cut)), F.lit(False))


def padded_end(end: Column, next_start: Column) -> Column:
    """The end of a slice with one page more, but not beyond the next start."""
    return F.least(end + 1, F.coalesce(next_start, end + 1))


def safe_name(c: Column) -> Column:
    return F.left(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_"), F.lit(80))


def xml_safe(c: Column) -> Column:
    """Without the control characters that XML forbids."""
    return F.regexp_replace(c, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")


def topic(c: Column) -> Column:
    """What follows the last `` of `` of a title, up to a connector."""
    after = F.element_at(F.split(c, " of "), -1)
    return F.when(F.contains(c, F.lit(" of ")), F.left(F.trim(F.regexp_replace(after, " (and|in|on|with|for|by|from) .*$", "")), F.lit(80)))


def needles(c: Column) -> Column:
    """A title, then its first 8, 5 and 3 words, each once."""
    w = F.split(F.trim(c), " +")
    return F.array_distinct(F.array(F.array_join(w, " "), *[F.array_join(F.slice(w, 1, n), " ") for n in (8, 5, 3)]))


def render(kind: Column, text: Column) -> Column:
    """A block as Markdown."""
    return F.when(kind == "system", F.concat(F.lit("### "), text)).when(kind == "user", F.concat(F.lit("> "), text)).otherwise(text)


def placeholder_free(c: Column) -> Column:
    """Without figure placeholders."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\{\{fig:[^}]*\}\}", ""), " +", " "))
