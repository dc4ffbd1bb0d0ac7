"""Matching and composition whose result depends on order: one group at a time, in an explicit total order.

Groups are pages, sections, images or documents, so they fit a task. Each function is plain Python over one group.
"""

from __future__ import annotations

import itertools
from operator import attrgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import matching_ratios


#: Rows that share a call, on average.
BUNDLE = 5_000


def by_group(df: DataFrame, key: str, order: list[str], function, schema: str) -> DataFrame:
    """The function over each group: it gets the key and the group's rows, in order, as tuples, and returns tuples of ``schema``.

    Many small groups share a call, as a call costs more than a group: about BUNDLE rows, however many there are in all.
    """
    bundles = -(-df.select(key).count() // BUNDLE) or 1
    names = [field.split()[0] for field in schema.split(", ")]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop(columns="_bundle").sort_values([key, *order])
        rows = frame.itertuples(index=False, name="Row")
        out = [row for k, group in itertools.groupby(rows, attrgetter(key)) for row in function(k, list(group))]
        return pd.DataFrame({name: pd.Series([row[i] for row in out], dtype=object) for i, name in enumerate(names)})

    return df.withColumn("_bundle", F.pmod(F.xxhash64(key), F.lit(bundles))).groupBy("_bundle").applyInPandas(run, schema)


def greedy_pairs(scores: list[tuple[float, int, int]], least: float) -> list[tuple[float, int, int]]:
    """One-to-one pairs by falling score; of equal scores the greater indices first."""
    left, right, out = set(), set(), []
    for score, i, j in sorted((s for s in scores if s[0] >= least), reverse=True):
        if i not in left and j not in right:
            left.add(i)
            right.add(j)
            out.append((score, i, j))
    return out


def match_texts(found: list[str], truth: list[str], least: float = 0.6) -> list[tuple[int | None, int | None, float]]:
    """(found, truth, ratio) of each pair; then truths without a match (missed) and findings without one (invented)."""
    every = list(itertools.product(range(len(found)), range(len(truth))))
    ratios = matching_ratios([found[i] for i, _ in every], [truth[j] for _, j in every])
    pairs = greedy_pairs([(ratio, i, j) for ratio, (i, j) in zip(ratios, every)], least)
    i, j = {p[1] for p in pairs}, {p[2] for p in pairs}
    return [(p[1], p[2], p[0]) for p in pairs] + [(None, k, 0.0) for k in range(len(truth)) if k not in j] + [(k, None, 0.0) for k in range(len(found)) if k not in i]


def overlap(a, b) -> float:
    """Intersection over union of boxes (x0, y0, x1, y1)."""
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(0.0, w) * max(0.0, h)
    union = max(0.0, a[2] - a[0]) * max(0.0, a[3] - a[1]) + max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1]) - both
    return both / union if union > 0 else 0.0


def match_boxes(wanted: list, images: list, least: float = 0.3) -> list[tuple[int, int]]:
    """Each wanted box in turn to the unused image that it overlaps most, above ``least``; one without a box to the first unused."""
    free, out = list(range(len(images))), []
    for i, box in enumerate(wanted):
        if box is None:
            best = free[0] if free else None
        else:
            score, best = max(((overlap(box, images[k]), -k) for k in free), default=(0.0, 0))
            best = -best if score > least else None
        if best is not None:
            free.remove(best)
            out.append((i, best))
    return out


def box_clusters(boxes: list[tuple[float, float, float, float]]) -> list[int]:
    """The first member of each box's cluster: neighbours are lines of like width, one under the other.

    Equal boxes are neighbours and count once; a box meets those whose centre is near enough for its width.
    """
    root = list(range(len(boxes)))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    first, kept = {}, []
    for k, box in enumerate(boxes):
        if box[2] - box[0] > 0:  # others have no neighbours
            root[k] = first.setdefault(box, k) if box[3] >= box[1] else k
            if root[k] == k:
                kept.append(k)
    at = np.array(kept, np.int64)
    x0, y0, x1, y1 = np.array([boxes[k] for k in kept], float).reshape(-1, 4).T
    order = np.argsort(x0 + x1, kind="stable")
    at, x0, y0, x1, y1 = at[order], x0[order], y0[order], x1[order], y1[order]
    wide, high, centre = x1 - x0, y1 - y0, x0 + x1
    # centres are within 0.35 of the wider one, which is at most twice as wide
    ends = np.searchsorted(centre, centre + 1.4001 * wide, "right")
    for i in range(len(at)):
        j = slice(i + 1, ends[i])
        h, w, narrow = np.maximum(high[i], high[j]), np.maximum(wide[i], wide[j]), np.minimum(wide[i], wide[j])
        near = np.maximum(y0[i], y0[j]) - np.minimum(y1[i], y1[j]) <= 0.5 * h
        near &= (w / narrow <= 2) & (np.abs(x0[i] + x1[i] - x0[j] - x1[j]) / 2 <= 0.35 * w)
        near &= np.minimum(x1[i], x1[j]) - np.maximum(x0[i], x0[j]) >= 0.55 * narrow
        for k in at[j][near].tolist():
            a, b = top(int(at[i])), top(k)
            if a != b:
                root[max(a, b)] = min(a, b)
    return [top(k) for k in range(len(boxes))]


def claim_chips(chips: list[tuple[str, str]], questions: list[tuple[str, str]]) -> list[int | None]:
    """For each chip (number, section) the question (number, section) that it claims: equal numbers first, then an equal or enclosing section."""
    free, out = list(range(len(questions))), []
    for number, section in chips:
        hit = next((k for k in free if number and questions[k][0] == number), None)
        if hit is None:
            hit = next((k for k in free if questions[k][1] == section or questions[k][1].startswith(f"{section}-")), None)
        if hit is not None:
            free.remove(hit)
        out.append(hit)
    return out


def anchor_pages(titles: list[str], pages: list[str]) -> list[tuple[int | None, str]]:
    """The page of each title: the first that has it from the last hit on, else anywhere, else none (phantom)."""
    low, cursor, out = [p.lower() for p in pages], 0, []
    for title in titles:
        t = title.lower()
        hit = next((k for k in range(cursor, len(low)) if t in low[k]), None)
        if hit is not None:
            cursor = hit
            out.append((hit, "forward"))
            continue
        hit = next((k for k in range(min(cursor, len(low))) if t in low[k]), None)
        out.append((hit, "phantom" if hit is None else "anywhere"))
    return out


def chunk_by_titles(text: str, titles: list[str]) -> list[tuple[int | None, int | None, bool]]:
    """Begin, end and whether found, of each title's chunk: titles are searched in turn, a chunk ends at the next found title."""
    found, cursor = [], 0
    for title in titles:
        at = text.find(title, cursor) if title else -1
        found.append(at if at >= 0 else None)
        cursor = at + 1 if at >= 0 else cursor
    out = []
    for k, at in enumerate(found):
        later = next((x for x in found[k + 1 :] if x is not None), len(text))
        out.append((at, later if at is not None else None, at is not None))
    return out


def fold_edits(items: list[str], ops: list[tuple[str, str | None, str | None]]) -> tuple[list[str], list[str]]:
    """The list after (op, id, argument) in turn, and errors: remove, edit, insert (after an anchor, else at the end), move (to an index)."""
    out, errors = list(items), []
    for op, name, arg in ops:
        if op == "insert":
            at = out.index(arg) + 1 if arg in out else len(out)
            out.insert(at, name)
        elif name not in out:
            errors.append(f"{op}: unknown {name}")
        elif op == "remove":
            out.remove(name)
        elif op == "edit":
            out[out.index(name)] = arg
        elif op == "move":
            out.remove(name)
            out.insert(max(0, min(int(arg), len(out))), name)
        else:
            errors.append(f"unknown {op}")
    return out, errors


def place_figures(blocks: list[dict], figures: list[dict]) -> list[tuple[str, int | None, str]]:
    """figure, block index and method: a text that names the label, else the anchor's words, else the page's last block, else unattached."""
    out = []
    for f in figures:
        label, anchor, page = f.get("label"), f.get("anchor"), f.get("page")
        hit = next((k for k, b in enumerate(blocks) if label and label.lower() in (b["text"] or "").lower()), None)
        method = "label"
        if hit is None and anchor and len(anchor) >= 10:
            hits = [k for k, b in enumerate(blocks) if anchor.lower() in (b["text"] or "").lower()]
            hit, method = (hits[0] if hits else None), "anchor"
            if hit is not None and f.get("position") == "below":
                hit = max(0, hit - 1)
        if hit is None:
            hit, method = next((k for k in range(len(blocks) - 1, -1, -1) if blocks[k]["page"] == page), None), "page"
        out.append((f["id"], hit, method if hit is not None else "unattached"))
    return out
