"""Encoding and decoding with a byte-level BPE, as streaming transducers.

**Lookahead.** Merges run by rank. Whether two neighbouring pieces u and v join at a place depends on the right only if v's end is
merged across before: by a merge (u', v') of lower rank, with u' a suffix of v. So the bytes to the right of a place that can
decide about it are at most

    reach(u, v) = len(v) + max of reach(u', v') over merges of lower rank with u' a suffix of v,

and the greatest reach of all merges is the list's sufficient lookahead (for the 50,000 merges of the byte-level file: 827).
Read by rising rank, each merge needs the suffixes of one piece, so it is worked out in a moment.

**Encoding.** A text is cut at its special tokens, then by the tokenizer's pattern. A piece is a stream of bytes: the transducer
holds a window, merges in it, and emits the tokens that end at least a lookahead before the window's end; nothing that follows
can change them, and what comes after a stable end does not depend on what stood before. It never holds more than a few
lookaheads, however long a piece is. A short piece is one window: those of a batch that are new are merged at once, each by one
pair a round, and the ids of pieces are remembered in a table of bounded size.

**Decoding.** Tokens become bytes, bytes become text in a state machine that carries an unfinished character from one token to the
next; bytes that are no UTF-8 become U+FFFD as the tokenizer's own decoder has it.

Nulls: a null text is empty and has no ids; null ids decode to the empty text. Unknown ids are skipped. Very long texts: whole, in
slices of about SLICE characters that end before white space, where a piece always ends. Repeated rows and equal or
missing ids: each row is a document. Empty table: empty result. Further columns are ignored. Nothing is shuffled.
"""

from __future__ import annotations

import codecs
import heapq
import json
from collections.abc import Iterator
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import only, release

#: How the byte-level tokenizers split a text before they merge; words first, which no other alternative can begin.
PATTERN = r" ?\p{L}+|'s|'t|'re|'ve|'m|'ll|'d| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that are split at once; rows of this size together are one batch.
SLICE = 1_000_000
#: Pieces that are remembered, and the longest of them.
KEPT_PIECES, KEPT_LENGTH = 400_000, 40
#: Symbols up to which the least rank is searched for in a list, and not in a heap.
SHORT = 64


def alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in a byte-level vocabulary: themselves where printable, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merges:
    """The merge list of a tokenizer file, as ids: ``rank`` of a pair, ``joined`` by rank, ``token`` bytes by id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = alphabet()
        raw = lambda piece: bytes(byte[c] for c in piece)
        model = spec["model"]
        ids = {raw(piece): k for piece, k in model["vocab"].items()}
        pairs = [tuple(map(raw, m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        self.pairs = pairs
        self.of_byte = [ids[bytes([b])] for b in range(256)]
        self.rank = {(ids[a], ids[b]): k for k, (a, b) in enumerate(pairs)}
        self.joined = [ids[a + b] for a, b in pairs]
        self.token = {k: piece for piece, k in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens", [])):
            raise ValueError("added tokens that take white space or whole words aren't known here")
        self.token |= {k: content.encode() for content, k in self.special.items()}
        self.base = max(self.token) + 1
        keys = np.array([a * self.base + b for a, b in self.rank], np.int64)
        self._order = np.argsort(keys)
        self._keys = keys[self._order]

    @cached_property
    def lookahead(self) -> int:
        """Bytes to the right of a place that decide whether a token ends there."""
        reach: dict[bytes, int] = {}  # by left piece, the greatest so far
        most = 0
        for left, right in self.pairs:
            far = len(right) + max((reach.get(right[k:], 0) for k in range(len(right))), default=0)
            reach[left] = max(reach.get(left, 0), far)
            most = max(most, far)
        return most

    def merge(self, data: bytes) -> list[int]:
        """Ids of these bytes alone: the pair of least rank is joined, the first of equal ones, until none is left."""
        ids = [self.of_byte[b] for b in data]
        return self._merge_short(ids) if len(ids) <= SHORT else self._merge_long(ids)

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each piece alone, of all pieces together: in a round each joins the first of its pairs of least rank."""
        none = len(self.joined)
        joined, out = np.array([*self.joined, 0], np.int64), [b""] * len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        name = np.flatnonzero(size)
        ids, size = np.array(self.of_byte, np.int64)[np.frombuffer(b"".join(pieces), np.uint8)], size[name]
        rank = np.full(len(ids), none)
        self._look(ids, rank, np.arange(len(ids) - 1))
        while len(name):
            end = np.cumsum(size)
            rank[end - 1] = none  # a piece's last symbol has no right neighbour
            least = np.minimum.reduceat(rank, end - size)
            over = least == none
            if over.any():
                packed = ids.astype("<u4").tobytes()
                for k, a, b in zip(name[over].tolist(), (4 * (end - size)[over]).tolist(), (4 * end[over]).tolist()):
                    out[k] = packed[a:b]
            hit = np.flatnonzero(rank == np.repeat(np.where(over, -1, least), size))
            own = np.searchsorted(end, hit, "right")
            hit = hit[np.diff(own, prepend=-1) > 0]
            ids[hit] = joined[rank[hit]]
            stay = np.repeat(~over, size)
            stay[hit + 1] = False
            at = (np.cumsum(stay) - 1)[hit]
            ids, rank, name, size = ids[stay], rank[stay], name[~over], size[~over] - 1
            self._look(ids, rank, np.concatenate([at[at < len(ids) - 1], at[at > 0] - 1]))
        return out

    def _look(self, ids: np.ndarray, rank: np.ndarray, at: np.ndarray) -> None:
        """Set the ranks of the pairs that begin at these places."""
        pair = ids[at] * self.base + ids[at + 1]
        k = np.minimum(np.searchsorted(self._keys, pair), len(self._keys) - 1)
        rank[at] = np.where(self._keys[k] == pair, self._order[k], len(self.joined))

    def _merge_short(self, ids: list[int]) -> list[int]:
        rank, none = self.rank, len(self.joined)
        ranks = [rank.get(pair, none) for pair in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == none:
                break
            k = ranks.index(least)
            ids[k : k + 2] = [self.joined[least]]
            del ranks[k]
            if k:
                ranks[k - 1] = rank.get((ids[k - 1], ids[k]), none)
            if k < len(ranks):
                ranks[k] = rank.get((ids[k], ids[k + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        rank, size = self.rank, len(ids)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = [(rank[p], k) for k, p in enumerate(zip(ids, ids[1:])) if p in rank]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            j = after[k]
            if ids[k] < 0 or j == size or rank.get((ids[k], ids[j])) != r:  # joined otherwise meanwhile
                continue
            ids[k], ids[j] = self.joined[r], -1
            after[k] = after[j]
            if after[k] < size:
                before[after[k]] = k
            for a in (before[k], k):
                if a >= 0 and after[a] < size and (new := rank.get((ids[a], ids[after[a]]))) is not None:
                    heapq.heappush(heap, (new, a))
        return [i for i in ids if i >= 0]


class Transducer:
    """Bytes in, tokens out as soon as they are stable."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.window = 4 * merges.lookahead
        self.held = b""

    def feed(self, data: bytes) -> list[int]:
        """The tokens that no further byte can change."""
        out: list[int] = []
        for at in range(0, len(data), self.window):
            self.held += data[at : at + self.window]
            if len(self.held) < self.window:
                continue
            sure, end = len(self.held) - self.merges.lookahead, 0
            for token in self.merges.merge(self.held):
                if end + len(self.merges.token[token]) > sure:
                    break
                end += len(self.merges.token[token])
                out.append(token)
            self.held = self.held[end:]
        return out

    def finish(self) -> list[int]:
        out, self.held = self.merges.merge(self.held), b""
        return out


class Encoder(dict):
    """Packed ids (little-endian, 32 bits) of a piece; remembers what it has seen. ``special``: whether special tokens' strings stand for them."""

    def __init__(self, merges: Merges, special: bool = True):
        import regex

        self.merges = merges
        self.pieces = regex.compile(PATTERN)
        self.edge = regex.compile(r"\S(?=\s)")
        names = sorted(merges.special, key=len, reverse=True) if special else []
        self.marks = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def __missing__(self, piece: str) -> bytes:
        """Of a piece too long to be remembered."""
        coder, step = Transducer(self.merges), 4096
        parts = [coder.feed(piece[k : k + step].encode("utf-8", "surrogatepass")) for k in range(0, len(piece), step)]
        return b"".join(np.array(p, "<u4").tobytes() for p in [*parts, coder.finish()])

    def learn(self, pieces: set[str]) -> None:
        """Remember all of these that aren't too long."""
        new = [p for p in pieces if p not in self and len(p) <= KEPT_LENGTH]
        if len(self) + len(new) > KEPT_PIECES:
            self.clear()
            new = [p for p in pieces if len(p) <= KEPT_LENGTH]
        self.update(zip(new, self.merges.merge_many([p.encode("utf-8", "surrogatepass") for p in new])))

    def slices(self, text: str) -> Iterator[str]:
        """The text in parts that end where a piece ends: between a visible character and white space."""
        at = 0
        while len(text) - at > SLICE:
            edge = self.edge.search(text, at + SLICE)
            if not edge:
                break
            yield text[at : edge.end()]
            at = edge.end()
        yield text[at:] if at else text

    def stream(self, text: str) -> Iterator[bytes]:
        """Packed ids of the whole text, slice after slice."""
        for k, part in enumerate(self.marks.split(text) if self.marks else [text]):
            if k % 2:
                yield np.array([self.merges.special[part]], "<u4").tobytes()
                continue
            for cut in self.slices(part):
                for run in [self.pieces.findall(cut)] if len(cut) <= 2 * SLICE else self._runs(cut):
                    self.learn(set(run))
                    yield b"".join(map(self.__getitem__, run))

    def _runs(self, text: str) -> Iterator[list[str]]:
        """The pieces of a slice without white space far and wide."""
        found = self.pieces.finditer(text)
        while run := [m.group() for m in islice(found, 100_000)]:
            yield run

    def many(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text; the new pieces of all short ones are learnt together."""
        plain = [len(t) <= SLICE and not (self.marks and self.marks.search(t)) for t in texts]
        split = [self.pieces.findall(t) if p else None for t, p in zip(texts, plain)]
        self.learn(set().union(*(s for s in split if s)))
        return [b"".join(self.stream(t)) if s is None else b"".join(map(self.__getitem__, s)) for t, s in zip(texts, split)]


class Decoder:
    """Ids in, text out; an unfinished character waits for its bytes."""

    def __init__(self, merges: Merges):
        self.token = merges.token
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        return self.state.decode(b"".join([self.token.get(k, b"") for k in ids]))

    def finish(self) -> str:
        return self.state.decode(b"", True)


def _runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """In runs of about SLICE bytes of the column."""
    for batch in batches:
        run = np.cumsum(np.asarray(pc.binary_length(batch.column(column)).fill_null(0), np.int64)) // SLICE
        limits = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(run)]
        for a, b in zip(limits[:-1], limits[1:]):
            if b > a:
                yield batch.slice(a, b - a)
        release()


def encode(docs: DataFrame, path: str, special: bool = True) -> DataFrame:
    """doc_id, ids for each row of ``docs`` (doc_id, text): the ids packed as little-endian unsigned 32-bit numbers.

    ``path`` is the tokenizer's file on each executor. With ``special`` the string of a special token in a text is that token,
    as the file's library has it by default; without, it is ordinary text.
    """

    def run(batches):
        coder = Encoder(Merges(path), special)
        for batch in _runs(batches, "text"):
            ids = coder.many([t or "" for t in batch.column("text").to_pylist()])
            yield pa.record_batch([batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, text for each row of ``encoded`` (doc_id, ids as ``encode`` packs them); special tokens are their strings."""

    def run(batches):
        merges = Merges(path)
        for batch in _runs(batches, "ids"):
            texts = []
            for packed in batch.column("ids"):
                decoder, ids = Decoder(merges), np.frombuffer(packed.as_py() or b"", "<u4")
                parts = [decoder.feed(ids[k : k + SLICE].tolist()) for k in range(0, len(ids), SLICE)]
                texts.append("".join(parts) + decoder.finish())
            yield pa.record_batch([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return only(encoded, doc_id="long", ids="binary").mapInArrow(run, "doc_id long, ids binary, text string")
