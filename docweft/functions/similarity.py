"""Similarities of texts that SQL has no function for, as plain functions and vectorised UDFs."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _common_by_names(a: str, b: str) -> int:
    """Length of the longest common substring.

    Stretches are named by doubling: the name of one of length 2n is the place of its two halves' names among all that occur, so
    equal names are equal stretches, whatever the texts. The greatest power of two at which both texts share a stretch is then
    extended by smaller powers.
    """
    codes = np.frombuffer((a + b).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    cut = len(a)

    def names(left: np.ndarray, right: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Names of the stretches of length n in either text, from those of two parts of them."""
        pair = np.concatenate([left[0] << np.int64(32) | right[0], left[1] << np.int64(32) | right[1]])
        found = np.unique(pair, return_inverse=True)[1]
        return found[: len(left[0])], found[len(left[0]) :]

    def shared(pair: tuple[np.ndarray, np.ndarray]) -> bool:
        return bool(len(pair[0]) and len(pair[1]) and np.isin(pair[0], pair[1]).any())

    levels = [(codes[:cut], codes[cut:])]
    if not shared(levels[0]):
        return 0
    n = 1
    while 2 * n <= min(len(a), len(b)):
        x, y = levels[-1]
        doubled = names((x[:-n], y[:-n]), (x[n:], y[n:]), 2 * n)
        if not shared(doubled):
            break
        levels.append(doubled)
        n *= 2
    best, length = levels[-1], n
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        if length + step > min(len(a), len(b)):
            continue
        x, y = levels[k]
        longer = names(tuple(t[: len(t) - step] for t in best), (x[length:], y[length:]), length + step)
        if shared(longer):
            best, length = longer, length + step
    return length


#: Length of the shortest stretches that are looked for by digests.
LEAST = 4


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Digests of stretches from those of their two parts, which may overlap."""
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x632BE59BD9B4E019) + (a >> np.uint64(29)))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _spread(of: np.ndarray, size: int, both) -> np.ndarray:
    """``both`` over each run of ``size``, by doubling; the two parts of a run may overlap."""
    n = 1
    while n < size:
        step = min(n, size - n)
        of, n = both(of[: max(0, len(of) - step)], of[step:]), n + step
    return of


def _shared(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places ``i`` and ``j`` whose digests in x and y both have; a table of bits leaves few to compare."""
    bits = np.uint64(64 - max(10, (8 * max(len(i), len(j))).bit_length()))
    u, v = x[i], y[j]
    seen = np.zeros(1 << (64 - int(bits)), bool)
    seen[v >> bits] = True
    keep = seen[u >> bits]
    i, u = i[keep], u[keep]
    seen[:] = False
    seen[u >> bits] = True
    keep = seen[v >> bits]
    j, v = j[keep], v[keep]
    if not len(i) or not len(j):
        return i[:0], j[:0]
    both = np.intersect1d(u, v)
    within = lambda d: both[np.minimum(np.searchsorted(both, d), len(both) - 1)] == d
    return (i[within(u)], j[within(v)]) if len(both) else (i[:0], j[:0])


def longest_common_length(a: str, b: str) -> int:
    """Length of the longest common substring.

    Stretches are known by digests of lengths 1, 2, 4, ...; only places whose stretch the other text has are looked at for longer
    ones, first by doubling, then by smaller powers of two. Equal stretches have equal digests, so none is missed, and what is found is compared
    itself; should digests have misled, `_common_by_names` decides.
    """
    short, other = (a, b) if len(a) <= len(b) else (b, a)
    if short in other:
        return len(short)
    # digests of stretches of each length, by the place of their begin
    levels = [[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) for t in (a, b)]]
    n, i, j = 1, np.arange(len(a)), np.arange(len(b))
    while 2 * n <= len(short):
        longer = [_joined(x[:-n], x[n:]) for x in levels[-1]]
        if 2 * n >= LEAST:  # shorter ones are shared by nearly all texts
            p, q = _shared(longer[0], i[i < len(longer[0])], longer[1], j[j < len(longer[1])])
            if not len(p):
                break
            i, j = p, q
        levels.append(longer)
        n *= 2
    if n < LEAST:
        return _common_by_names(a, b)
    here, length = [levels[-1][0][i], levels[-1][1][j]], n
    step = n
    while step > 1:
        step //= 2
        level = levels[step.bit_length() - 1]
        x, y = i + length < len(level[0]), j + length < len(level[1])
        p, q = i[x], j[y]
        u, v = _joined(here[0][x], level[0][p + length]), _joined(here[1][y], level[1][q + length])
        if not len(u) or not len(v):
            continue
        x, y = _shared(u, np.arange(len(u)), v, np.arange(len(v)))
        if len(x):
            i, j, here, length = p[x], q[y], [u[x], v[y]], length + step
    k = int(i[0])
    return length if a[k : k + length] in b else _common_by_names(a, b)


def lcs_share(a: str | None, b: str | None, of_shorter: bool = False) -> float:
    """Longest common substring by the length of ``a``, or of the shorter one; 0 if there is nothing to divide by."""
    a, b = a or "", b or ""
    by = min(len(a), len(b)) if of_shorter else len(a)
    return longest_common_length(a, b) / by if by else 0.0


def window_share(a: str | None, b: str | None, size: int = 10, step: int = 5) -> float:
    """Share of the windows of ``a``, one each ``step``, that stand in ``b``; 0 without windows. The work is linear in both."""
    a, b = a or "", b or ""
    at = np.arange(0, len(a) - size + 1, step)
    if not len(at):
        return 0.0
    digests = [_spread(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), size, _joined) for t in (a, b)]
    i, j = _shared(digests[0], at, digests[1], np.arange(len(digests[1])))
    every = {b[k : k + size] for k in j.tolist()}  # digests only leave out what can't be equal
    return sum(a[k : k + size] in every for k in i.tolist()) / len(at)


def _matched(a: str, b: str) -> int:
    """Characters that ``SequenceMatcher`` without junk matches: the longest common stretch, then those to both sides. Its memory is linear.

    Places are found by stretches of 8 characters (fewer for short texts), and of 4, 2 and 1 only where nothing longer is shared, so few places meet.
    """
    index: dict[int, dict[str, list[int]]] = {}
    size = len(a) * len(b)
    todo, matched = [(0, len(a), 0, len(b), 8 if size > 100_000 else 4 if size > 10_000 else 2)], 0
    while todo:
        a0, a1, b0, b1, k = todo.pop()
        while k > min(a1 - a0, b1 - b0):
            k //= 2
        if not k:
            continue
        if k not in index:
            places = index[k] = {}
            for j in range(len(b) - k + 1):
                places.setdefault(b[j : j + k], []).append(j)
        places, best, run, last = index[k], 0, {}, b1 - k
        for i in range(a0, a1 - k + 1):
            found, own = places.get(a[i : i + k]), {}
            if found:
                for x in range(bisect_left(found, b0), len(found)):
                    j = found[x]
                    if j > last:
                        break
                    n = own[j] = run.get(j - 1, 0) + 1
                    if n > best:
                        best, at, to = n, i - n + 1, j - n + 1
            run = own
        if best:
            size = best + k - 1
            matched += size
            todo += [(a0, at, b0, to, k), (at + size, a1, to + size, b1, k)]
        elif k > 1:
            todo.append((a0, a1, b0, b1, k // 2))
    return matched


#: Characters of the pairs that are matched together, shared places that are held at once, and the length from which a text is matched by itself.
TOGETHER, PLACES, TOO_LONG = 1 << 17, 1 << 22, 1 << 20
#: Lengths of the stretches by which common ones are found, one after the other.
SEEDS = (4, 2, 1)


def _ranges(begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of ranges one after the other, and for each the index of its range."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(of)) + (begin - np.cumsum(sizes) + sizes)[of], of


def _meet(codes: tuple[np.ndarray, np.ndarray], boxes: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Places of stretches of k characters in the boxes of b, by digest; of each stretch of a its first of them, how many it meets, its place, and the box of each place of a."""
    owner, packed, lows = np.zeros(len(codes[0]), np.int64), [], []
    for text, begin, end in zip(codes, boxes[[0, 2]], boxes[[1, 3]]):
        at, box = _ranges(begin, np.maximum(0, end - begin - k + 1))
        size = max(0, len(text) - k + 1)
        digest = text[:size].copy()
        for x in range(1, k):
            digest *= np.uint64(0x9E3779B97F4A7C15)
            digest += text[x : size + x]
        digest = (digest[at] + box.astype(np.uint64) * np.uint64(0x94D049BB133111EB)) * np.uint64(0xBF58476D1CE4E5B9)
        digest = (digest ^ (digest >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        if not packed:
            owner[at] = box
        lows.append((np.uint64(1) << np.uint64(len(text).bit_length())) - np.uint64(1))
        packed.append((digest, at.astype(np.uint64)))
    low = max(lows)
    x, y = (np.sort(digest & ~low | at) for digest, at in packed)
    first = np.searchsorted(y, x & ~low)
    return y & low, first, np.searchsorted(y, x | low, "right") - first, (x & low).astype(np.int64), owner


def _segments(codes: tuple[np.ndarray, np.ndarray], boxes: np.ndarray, met: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """Box, place in a, place in b and length of all longest common stretches of at least k characters within boxes."""
    there, first, n, i, owner = met
    some = n > 0
    first, n, i = first[some], n[some], i[some]
    i = np.repeat(i, n)
    j = there[_ranges(first, n)[0]].astype(np.int64)
    box = owner[i]
    same = (j >= boxes[2][box]) & (j + k <= boxes[3][box])  # digests only leave out what can't be equal
    for x in range(k):
        same &= codes[0][i + x] == codes[1][np.minimum(j + x, len(codes[1]) - 1)]
    size, shift = len(codes[0]), np.int64(len(codes[0]).bit_length())
    line = np.sort((j - i + size << shift | i)[same])
    i = line & ((np.int64(1) << shift) - 1)
    box = owner[i]
    begins = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1] + 1) | (box[1:] != box[:-1])])[: len(line)])
    return box[begins], i[begins], ((line >> shift) - size + i)[begins], np.diff(np.append(begins, len(line))) + k - 1


def _split(boxes: np.ndarray, segments: tuple[np.ndarray, ...], k: int, matched: np.ndarray) -> np.ndarray:
    """Adds the matched characters of boxes (a0, a1, b0, b1, pair) to ``matched`` of their pairs; the boxes that are left share no k characters.

    Each box is split at its longest segment, the first in a and then in b of equal ones, and the others are cut to both sides,
    for all boxes at once.
    """
    rest, (box, i, j, n) = [], segments
    bits, ones = np.int64(21), np.int64((1 << 21) - 1)
    while True:
        best = np.zeros(boxes.shape[1], np.int64)
        np.maximum.at(best, box, (n << 2 * bits) | (ones - i << bits) | (ones - j))
        rest.append(boxes[:, best == 0])
        if not len(box):
            return np.concatenate(rest, axis=1)
        some = best > 0
        box, boxes, best = (np.cumsum(some) - 1)[box], boxes[:, some], best[some]
        a0, a1, b0, b1, pair = boxes
        length, x, y = best >> 2 * bits, ones - (best >> bits & ones), ones - (best & ones)
        np.add.at(matched, pair, length)
        count = boxes.shape[1]
        boxes = np.concatenate([np.stack([a0, x, b0, y, pair]), np.stack([x + length, a1, y + length, b1, pair])], axis=1)
        before, behind = x[box] - i, y[box] - j
        size = length[box]
        left = np.minimum(n, np.minimum(before, behind))
        cut = np.maximum(0, np.maximum(before, behind) + size)
        p, q = left >= k, n - cut >= k
        box, i, j, n = (np.concatenate(c) for c in ((box[p], box[q] + count), (i[p], (i + cut)[q]), (j[p], (j + cut)[q]), (left[p], (n - cut)[q])))
        keep = (boxes[0] < boxes[1]) & (boxes[2] < boxes[3])
        box, boxes = (np.cumsum(keep) - 1)[box], boxes[:, keep]


def _matched_together(a: list[str], b: list[str]) -> np.ndarray:
    """`_matched` of many pairs at once: their common stretches are sought and split together, in arrays."""
    codes = tuple(np.frombuffer("".join(t).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) for t in (a, b))
    ends = [np.cumsum([len(x) for x in t], dtype=np.int64) for t in (a, b)]
    begins = [np.concatenate([[0], e[:-1]]) for e in ends]
    matched = np.zeros(len(a), np.int64)
    boxes = np.stack([begins[0], ends[0], begins[1], ends[1], np.arange(len(a))])
    for k in SEEDS:
        boxes = boxes[:, (boxes[0] < boxes[1]) & (boxes[2] < boxes[3])]
        todo, left = [boxes] if boxes.shape[1] else [], []
        while todo:
            some = todo.pop()
            met = _meet(codes, some, k)
            if met[2].sum() > PLACES:
                if some.shape[1] == 1:  # texts that repeat few stretches
                    a0, a1, b0, b1, pair = some[:, 0].tolist()
                    matched[pair] += _matched(a[pair][a0 - begins[0][pair] : a1 - begins[0][pair]], b[pair][b0 - begins[1][pair] : b1 - begins[1][pair]])
                else:
                    half = some.shape[1] // 2
                    todo += [some[:, :half], some[:, half:]]
                continue
            left.append(_split(some, _segments(codes, some, met, k), k, matched))
        boxes = np.concatenate(left, axis=1) if left else boxes[:, :0]
    return matched


def matching_ratios(a: list[str | None], b: list[str | None]) -> list[float]:
    """Twice the matched characters by all characters of each pair, as ``SequenceMatcher`` without junk: the longest common stretch, then those to both sides."""
    pairs = [(x or "", y or "") for x, y in zip(a, b)]
    out = [1.0 if x == y else 0.0 for x, y in pairs]
    todo, size = [], 0

    def run() -> None:
        for k, n in zip(todo, _matched_together([pairs[k][0] for k in todo], [pairs[k][1] for k in todo]).tolist()):
            out[k] = 2.0 * n / (len(pairs[k][0]) + len(pairs[k][1]))

    for k, (x, y) in enumerate(pairs):
        if x == y or not x or not y:
            continue
        if max(len(x), len(y)) >= TOO_LONG:
            out[k] = 2.0 * _matched(x, y) / (len(x) + len(y))
            continue
        if todo and size + len(x) + len(y) > TOGETHER:
            run()
            todo, size = [], 0
        todo.append(k)
        size += len(x) + len(y)
    if todo:
        run()
    return out


def matching_ratio(a: str | None, b: str | None) -> float:
    """`matching_ratios` of one pair."""
    return matching_ratios([a], [b])[0]


def lcs_ratio(a, b) -> Column:
    """``lcs_share`` of two columns."""
    return F.pandas_udf(lambda x, y: pd.Series([lcs_share(*p) for p in zip(x, y)], dtype=float), T.DoubleType(), F.PandasUDFType.SCALAR)(a, b)


def window_ratio(a, b) -> Column:
    """``window_share`` of two columns."""
    return F.pandas_udf(lambda x, y: pd.Series([window_share(*p) for p in zip(x, y)], dtype=float), T.DoubleType(), F.PandasUDFType.SCALAR)(a, b)


def sequence_ratio(a, b) -> Column:
    """``matching_ratios`` of two columns."""
    return F.pandas_udf(lambda x, y: pd.Series(matching_ratios(x.tolist(), y.tolist()), index=x.index, dtype=float), T.DoubleType(), F.PandasUDFType.SCALAR)(a, b)


def _marks(texts: list[str], width: int) -> list[np.ndarray]:
    """Of each text the digests of stretches of half of ``width`` characters that are least within any ``width`` characters; none if it is shorter."""
    sizes = np.array([len(t) for t in texts], np.int64)
    digest = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    if len(digest) < width:
        return [np.zeros(0, np.int64)] * len(texts)

    least = _spread(_spread(digest, width // 2, _joined), width - width // 2 + 1, np.minimum)
    ends = np.cumsum(sizes)
    row = np.repeat(np.arange(len(texts)), sizes)[: len(least)]
    kept = np.arange(len(least)) + width <= ends[row]
    kept[1:] &= (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    return np.split(least[kept].view(np.int64), np.cumsum(np.bincount(row[kept], minlength=len(texts)))[:-1])


def least_stretches(c, width: int) -> Column:
    """``_marks`` of a column: texts that share ``width`` characters share one of them."""
    return F.pandas_udf(lambda x: pd.Series(_marks(x.fillna("").tolist(), width), dtype=object), T.ArrayType(T.LongType()), F.PandasUDFType.SCALAR)(c)


#: Bits of a bitmap for each digest, and of the largest one.
EACH_BITS, MOST_BITS, PIECE_BITS = 64, 1 << 29, 1 << 15
#: Digest bits by which a digest finds its three places in a bitmap.
PROBES = (0, 18, 35)
#: Marks a needle that ends with its beginning.
_WHOLE = np.uint64(0x94D049BB133111EB)
#: Characters that are looked at at once.
_AT_ONCE = 1 << 17


def _stretches(texts: list[str], width: int) -> np.ndarray:
    """Digests of all stretches of ``width`` characters of the texts laid end to end."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    return _spread(codes, width, _joined) if len(codes) >= width else codes[:0]


def _needles(texts: list[str], width: int) -> list[np.ndarray]:
    """Of each text of at least ``width`` characters the digest of its beginning, and its own."""
    sizes = np.array([len(t) for t in texts], np.int64)
    digests, ends = _stretches(texts, width), np.cumsum(sizes)
    first, last = digests[ends - sizes], digests[ends - width]
    whole = np.where(sizes > width, _joined(first, last), first ^ _WHOLE)
    return list(np.stack([first, whole], 1).view(np.int64))


def needle_digests(c, width: int) -> Column:
    """``_needles`` of a column of texts that have ``width`` characters at least."""
    return F.pandas_udf(lambda x: pd.Series(_needles(x.tolist(), width), index=x.index, dtype=object), T.ArrayType(T.LongType()), F.PandasUDFType.SCALAR)(c)


def bitmap(digests: DataFrame) -> np.ndarray:
    """The column ``digest`` as bits, three for each; made in pieces by Spark, of bounded size in all."""
    n = digests.count()
    bits = min(MOST_BITS, max(PIECE_BITS, 1 << (EACH_BITS * n).bit_length()))
    places = F.array(*[F.call_function("shiftrightunsigned", F.col("digest"), F.lit(k)).bitwiseAND(F.lit(bits - 1)) for k in PROBES])
    at = digests.select(F.explode(places).alias("at"))
    pieces = at.groupBy(F.floor(F.col("at") / PIECE_BITS).cast("int").alias("piece")).agg(F.bitmap_construct_agg(F.col("at") % PIECE_BITS).alias("bits"))
    out = np.zeros((bits // PIECE_BITS, PIECE_BITS // 8), np.uint8)
    for piece, found in pieces.collect():  # of bounded size
        out[piece] = np.frombuffer(found, np.uint8)
    return out.ravel()


def _in_bitmap(bits: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """Places of the digests that the bitmap may have."""
    mask, kept = np.uint64(8 * len(bits) - 1), None
    for k in PROBES:
        at = (digests if kept is None else digests[kept]) >> np.uint64(k) & mask
        hit = np.flatnonzero(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
        kept = hit if kept is None else kept[hit]
    return kept


def needle_hits(texts: list[str], bits: np.ndarray, width: int, most: int) -> Iterator[tuple[int, str]]:
    """(index of a text, stretch of ``width`` to ``most`` characters): all stretches whose digests are in a bitmap of `needle_digests`."""
    begin = 0
    while begin < len(texts):
        stop, size = begin, 0
        while stop < len(texts) and (stop == begin or size + len(texts[stop]) <= _AT_ONCE):
            size, stop = size + len(texts[stop]), stop + 1
        some = texts[begin:stop]
        ends = np.cumsum([len(t) for t in some])
        digests = _stretches(some, width)

        def within(at: np.ndarray, n: int) -> Iterator[tuple[int, str]]:
            row = np.searchsorted(ends, at, "right")
            keep = at + n <= ends[row]
            for k, r in zip(at[keep].tolist(), row[keep].tolist()):
                k -= int(ends[r]) - len(some[r])
                yield begin + r, some[r][k : k + n]

        at = _in_bitmap(bits, digests)
        yield from within(at[_in_bitmap(bits, digests[at] ^ _WHOLE)], width)
        for n in range(width + 1, most + 1):
            at = at[at + n - width < len(digests)]
            yield from within(at[_in_bitmap(bits, _joined(digests[at], digests[at + n - width]))], n)
        begin = stop
