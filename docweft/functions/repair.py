"""Tolerant parsing of model output, and rewriting of formulas and Unicode text."""

from __future__ import annotations

import json
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FENCE = re.compile(r"^\s*```[A-Za-z]*\s*|\s*```\s*$")
_LONE = re.compile(r'\\(?!["\\/bfnrtu])')
_TRAILING = re.compile(r",(\s*[}\]])")
# What control characters stand for when an escape of a TeX command was decoded.
CONTROLS = {"\b": r"\b", "\f": r"\f", "\t": r"\t", "\v": r"\v", "\a": r"\a"}
# Signs of mathematics and their words.
SIGNS = {"α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "θ": "theta", "λ": "lambda", "μ": "mu", "π": "pi", "ρ": "rho", "σ": "sigma", "φ": "phi", "ω": "omega", "Δ": "delta", "Ω": "omega", "∞": "infinity"}
OPERATORS = {"+": "plus", "=": "equals", "<": "less", ">": "greater", "×": "times", "÷": "divided", "≤": "leq", "≥": "geq", "±": "pm", "→": "to", "√": "sqrt"}


_TOKEN = re.compile(r'(?s)"(?:[^"\\]|\\.)*(?:"|$)|[{}\[\]]')


def first_json(text: str) -> str | None:
    """The first object or array, up to the bracket that closes it; only brackets of its own kind count, and none inside strings."""
    begin = min((k for k in (text.find("{"), text.find("[")) if k >= 0), default=None)
    if begin is None:
        return None
    opening, closing, depth = text[begin], "}" if text[begin] == "{" else "]", 0
    for token in _TOKEN.finditer(text, begin):
        depth += (token[0] == opening) - (token[0] == closing)
        if not depth:
            return text[begin : token.end()]
    return None


def parse_json(raw: str | None) -> str | None:
    """Canonical JSON of model output, or null: fences go, the first balanced value counts, lone backslashes and trailing commas are repaired."""
    found = first_json(_FENCE.sub("", raw or ""))
    if found is None:
        return None
    for text in (found, _LONE.sub(r"\\\\", found), _TRAILING.sub(r"\1", _LONE.sub(r"\\\\", found))):
        try:
            return json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True)
        except ValueError:
            continue
    return None


def restore_controls(text: str | None) -> tuple[str | None, int]:
    """Control characters before a letter back to the escapes that they came from, and how many."""
    if text is None:
        return None, 0
    return re.subn(r"[\x07\x08\x09\x0b\x0c](?=[a-z])", lambda m: CONTROLS[m[0]], text)


class _Matched(dict):
    """What a character becomes in a text for matching, worked out once: accents go, what is no letter or digit becomes a space."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        word = (SIGNS | OPERATORS).get(c)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).replace("^", "")
        self[code] = f" {word} " if word else re.sub(r"[^\w\s]|_", " ", plain)
        return self[code]


_MATCHED = _Matched()
_ITEM_NUMBER, _COMMAND = re.compile(r"^\s*\(?[0-9]{1,3}[.)]\s+"), re.compile(r"\\([A-Za-z]+)")
_RUNS = re.compile(r"[\x00-\x7f]+|[^\x00-\x7f]+")  # ASCII by itself is translated quicker


def match_text(text: str | None) -> str:
    """A text for matching: list number off, TeX commands, signs and operators as words, accents off, lower case."""
    t = _ITEM_NUMBER.sub("", text or "")
    if "\\" in t:
        t = _COMMAND.sub(r" \1 ", t)
    t = t.translate(_MATCHED) if t.isascii() else "".join([run.translate(_MATCHED) for run in _RUNS.findall(t)])
    return " ".join(t.lower().split())


def balance_braces(text: str | None, most: int = 2) -> tuple[str | None, bool]:
    """A formula with up to ``most`` missing closing braces added, and whether it is balanced then."""
    if text is None:
        return None, False
    missing = text.count("{") - text.count("}")
    return (text + "}" * missing, True) if 0 <= missing <= most else (text, False)


def wrap_formula(text: str | None) -> str | None:
    """A formula in one pair of dollars."""
    if text is None:
        return None
    inner = re.sub(r"^(\$+|\\\(|\\\[)|(\$+|\\\)|\\\])$", "", text.strip()).strip()
    for sign, word in SIGNS.items():
        inner = inner.replace(sign, f"\\{word} ")
    return f"${balance_braces(inner)[0]}$"


def markdown_segments(text: str | None) -> list[dict]:
    """Text and tables of a Markdown text in order: a table is a line of cells, a divider and lines of cells."""
    out, lines, k = [], (text or "").split("\n"), 0
    cells = lambda s: [c.strip() for c in s.strip().strip("|").split("|")]
    while k < len(lines):
        if "|" in lines[k] and k + 1 < len(lines) and re.fullmatch(r"\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*", lines[k + 1]):
            head, rows, k = cells(lines[k]), [], k + 2
            while k < len(lines) and "|" in lines[k]:
                rows.append(cells(lines[k]))
                k += 1
            out.append({"kind": "table", "text": None, "headers": head, "rows": rows})
            continue
        if out and out[-1]["kind"] == "text":
            out[-1]["text"] += "\n" + lines[k]
        else:
            out.append({"kind": "text", "text": lines[k], "headers": None, "rows": None})
        k += 1
    return [s for s in out if s["kind"] == "table" or s["text"].strip()]


def tabular_rows(text: str | None) -> list[list[str]]:
    """Cells of a TeX tabular body."""
    body = re.sub(r"\\(begin|end)\{tabular\}(\{[^}]*\})?|\\hline", "", text or "")
    return [[c.strip() for c in row.split("&")] for row in body.split(r"\\") if row.strip()]


def each(function, kind: T.DataType, c) -> Column:
    """A plain function over a column, in Arrow batches."""
    return F.pandas_udf(lambda x: x.map(function).astype(object), kind, F.PandasUDFType.SCALAR)(c)


SEGMENT = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("headers", T.ArrayType(T.StringType())), T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType()))),
])


def parsed(raw) -> Column:
    return each(parse_json, T.StringType(), raw)


def match_key(text) -> Column:
    return each(match_text, T.StringType(), text)


def segments(text) -> Column:
    return each(markdown_segments, T.ArrayType(SEGMENT), text)
