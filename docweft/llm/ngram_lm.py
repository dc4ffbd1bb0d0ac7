"""Scoring texts with a weighted backoff automaton of smoothed n-grams.

States are the root and the n-grams of up to ORDER - 1 tokens seen in training; a text begins in the state of its begin mark. A
state h has an arc for each token w seen after it, of weight log p(w|h), to the longest state that ends in w, and a failure arc
to the state of its longest proper suffix h', of weight log m(h), with the mass m(h) = 1 / (1 + A c(h)^B) of what was not seen
after h. So p(w|h) = (1 - m(h)) c(h,w) / c(h) + m(h) p(w|h'); the root has an arc for each word, of weight log p(w) with
p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)), in which all unknown words share one place: each state's probabilities sum to 1.
A text is read once from left to right; the state is carried on, and a token without an arc goes along failure arcs until it
has one. Texts, and stretches of long ones, are read side by side; as a state depends on the last ORDER - 1 tokens, a stretch begins
so many tokens before its own first.

The model is never in one place. Documents are dealt to chunks; a chunk sends the sorted hashes of its distinct n-grams, with
their training counts, to shards by hash range; each shard adds up and returns the totals of just those keys, in order. From them
the chunk builds the part of the automaton that its own texts can reach, and reads them. A key is sent once a chunk however often
it occurs, so common words and pairs are no hot spots. Chunks and shards both follow the amount of text, so none grows with it.

Nulls: a null text is empty; an empty text has the end token only. Very long texts: whole. Repeated rows and equal ids: each row
is a text; a null id is never held out. Empty table: empty result; without training texts N = V = 0 and p = 1. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, batches, bits_for, chunked, lean, mix, pack, shard_bounds, shards_for, squeeze, unpack, unsqueeze

ORDER = 3
#: Mass of the unseen after histories of one token, of two tokens, ...: A, B.
MASS = ((0.25, 0.2), (0.3, 0.4))
#: Tokens of a text that are read in one stretch.
STRETCH = 512
_END, _BEGIN = np.uint64(0x51ED270B3A2C7F11), np.uint64(0x2545F4914F6CDD1D)


class Stream:
    """Tokens of a chunk's texts, each between the begin mark and the end token, and the keys of their n-grams."""

    def __init__(self, texts, bits: int, order: int = ORDER):
        w = Words(list(texts), lower=True)
        n = np.diff(w.first)
        self.order = order
        self.first = np.concatenate([[0], np.cumsum(n + 2)])
        self.token = np.empty(self.first[-1], np.uint64)
        inner = np.ones(len(self.token), bool)
        inner[self.first[:-1]] = inner[self.first[1:] - 1] = False
        self.token[inner] = w.hash
        self.token[self.first[:-1]], self.token[self.first[1:] - 1] = _BEGIN, _END
        self.at = np.arange(len(self.token)) - np.repeat(self.first[:-1], n + 2)  # place within the text, 0 for the mark
        self.keys, gram = [], mix(self.token ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        for k in range(order):  # n-grams by their ends; those that would begin before the text have no meaning and are left out later
            self.keys.append(gram >> np.uint64(64 - bits))
            gram = mix(np.concatenate([[np.uint64(0)], gram[:-1]]) * np.uint64(0x9E3779B97F4A7C15) + self.token) if len(gram) else gram

    def valid(self, k: int) -> np.ndarray:
        """Ends of the n-grams of k + 1 tokens."""
        return self.at >= k

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums over each text's tokens, without its begin mark."""
        return np.add.reduceat(np.where(self.at > 0, values, 0), self.first[:-1]) if len(self.first) > 1 else np.zeros(0)

    def distinct(self, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys in order, and how often training texts have each."""
        flag = np.repeat(train, np.diff(self.first)).astype(np.uint64)
        keys = np.concatenate([(key << np.uint64(1) | flag)[self.valid(k)] for k, key in enumerate(self.keys)])
        keys.sort()
        key = keys >> np.uint64(1)
        at = np.flatnonzero(np.diff(key, prepend=~key[:1]))
        return key[at], np.add.reduceat(keys & np.uint64(1), at) if len(at) else at.astype(np.uint64)


class Automaton:
    """The part of the backoff automaton that a stream's texts can reach, from the training counts of its keys."""

    def __init__(self, s: Stream, keys: np.ndarray, counts: np.ndarray, n_train: int, n_distinct: int):
        total = max(n_train + 0.5 * (n_distinct + 1), 0.5)
        ends = s.token == _END
        state = np.zeros(len(s.token), np.int64)  # of the longest history so far that ends here; the root is 0
        known = np.ones(0, bool)
        self.fail, self.mass = [np.zeros(1, np.int64)], [np.zeros(1)]
        froms, words, weights, targets = [], [], [], []
        n_states = 1
        for k in range(s.order):
            valid = np.flatnonzero(s.valid(k))
            _, where, which = np.unique(s.keys[k][valid], return_index=True, return_inverse=True)
            where = valid[where]
            count = counts[np.searchsorted(keys, s.keys[k][where])].astype(np.float64)
            each = np.full(len(s.token), -1)  # n-gram of k + 1 tokens that ends here
            each[valid] = which
            if k == 0:
                p = (count + 0.5) / total
                self.word, self.count = each, count
            else:
                seen = np.flatnonzero((count > 0) & (history_state[before[where - 1]] > 0))
                where_seen = where[seen]
                h = history_state[before[where_seen - 1]]
                m = np.concatenate(self.mass)[h]
                p_seen = (1 - m) * np.minimum(1.0, count[seen] / history_count[before[where_seen - 1]]) + m * p[before[where_seen]]
                froms.append(h)
                words.append(self.word[where_seen])
                weights.append(np.log10(p_seen))
                p = np.zeros(len(where))
                p[seen] = p_seen
                known = np.zeros(len(where), bool)
                known[seen] = True
            if k == 0:
                known = count > 0
            # n-grams that may be histories are states; their failure arcs lead to the states of their suffixes
            own = np.zeros(len(where), np.int64)
            if k < s.order - 1:
                fresh = np.flatnonzero(known & ~ends[where])
                own[fresh] = n_states + np.arange(len(fresh))
                n_states += len(fresh)
                self.fail.append(history_state[before[where[fresh]]] if k else np.zeros(len(fresh), np.int64))
                a, b = MASS[min(k, len(MASS) - 1)]
                self.mass.append(1 / (1 + a * count[fresh] ** b))
            target = own if k == 0 else np.where(own > 0, own, 0)
            if k and k == s.order - 1:  # the longest n-grams lead to the states of their suffixes
                target = history_state[before[where]]
            if k:
                targets.append(target[seen])
            else:
                self.root_target, self.root_weight = own, np.log10(p)
            before, history_state, history_count = each, own, count
        self.fail, self.mass = np.concatenate(self.fail), np.log10(np.maximum(np.concatenate(self.mass), 1e-300))
        self.n_words = max(1, len(self.root_weight))
        arc = np.concatenate(froms) * self.n_words + np.concatenate(words) if froms else np.zeros(0, np.int64)
        order = np.argsort(arc)
        none = [np.zeros(0)]
        self.arc, self.weight = arc[order], np.concatenate(weights or none)[order]
        self.target = np.concatenate(targets or none)[order].astype(np.int64)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state after each word, and the weight of the way there: failure arcs until there is an arc for the word."""
        weight, after = np.zeros(len(state)), np.zeros(len(state), np.int64)
        left = np.arange(len(state))
        while len(left):
            at_root = state[left] == 0
            done = left[at_root]
            weight[done] += self.root_weight[word[done]]
            after[done] = self.root_target[word[done]]
            left = left[~at_root]
            if not len(left) or not len(self.arc):
                if len(left):
                    weight[left] += self.mass[state[left]]
                    state[left] = self.fail[state[left]]
                    continue
                break
            key = state[left] * self.n_words + word[left]
            at = np.minimum(np.searchsorted(self.arc, key), len(self.arc) - 1)
            hit = self.arc[at] == key
            done = left[hit]
            weight[done] += self.weight[at[hit]]
            after[done] = self.target[at[hit]]
            left = left[~hit]
            weight[left] += self.mass[state[left]]
            state[left] = self.fail[state[left]]
        return after, weight

    def read(self, s: Stream) -> np.ndarray:
        """The log10 weight of each token's step; 0 for the begin marks."""
        out = np.zeros(len(s.token))
        warm = s.order - 1
        # stretches of texts: where each begins to read, where it begins to count, and where it ends
        own = np.flatnonzero((s.at > 0) & ((s.at - 1) % STRETCH == 0))
        begin = own - np.minimum(warm, s.at[own] - 1)
        ends = np.minimum(own + STRETCH, np.repeat(s.first[1:], np.diff(s.first))[own]) if len(own) else own
        order = np.argsort(begin - ends, kind="stable")  # longest first
        own, begin, ends = own[order], begin[order], ends[order]
        length = ends - begin
        state = np.where(s.at[begin] == 1, self.root_target[self.word[begin - 1]], 0) if len(own) else own
        for t in range(int(length.max(initial=0))):
            n = int(np.searchsorted(-length, -t))  # those that still read
            here = begin[:n] + t
            after, weight = self.step(state[:n].copy(), self.word[here])
            counts = here >= own[:n]
            out[here[counts]] = weight[counts]
            state[:n] = after
        return out


def vocabulary(docs: DataFrame, shards: int) -> tuple[int, int]:
    """Number of tokens and of distinct tokens of the training texts: runs of texts send each distinct word's hash once, to shards."""

    def distinct(frames):
        seen, n = np.zeros(0, np.uint64), 0
        fresh: list[np.ndarray] = []
        for frame in batches(frames):
            w = Words(frame["text"].tolist(), lower=True)
            n += len(w.hash) + len(frame)
            fresh.append(np.unique(w.hash))
            if sum(map(len, fresh)) > 2_000_000:
                seen, fresh = np.unique(np.concatenate([seen, *fresh])), []
            if len(seen) > 4_000_000:
                yield sent(seen, n)
                seen, n = seen[:0], 0
        seen = np.unique(np.concatenate([seen, *fresh]))
        if n:
            yield sent(seen, n)

    def sent(seen, n):
        keys = np.unique(np.append(seen, _END)) >> np.uint64(1)
        at = shard_bounds(keys, 63, shards)
        full = np.flatnonzero(np.diff(at))
        return pd.DataFrame({"shard": full, "keys": [pack(keys[at[k] : at[k + 1]]) for k in full], "n": [n, *[0] * (len(full) - 1)]})

    def add(key, frame):
        return pd.DataFrame({"n": [frame["n"].sum()], "words": [len(np.unique(np.concatenate([unpack(b) for b in frame["keys"]])))]})

    each = docs.filter("train").select("text").mapInPandas(distinct, "shard int, keys binary, n long")
    found = each.groupBy("shard").applyInPandas(lean(add), "n long, words long").agg(F.sum("n").alias("tokens"), F.sum("words").alias("words")).first()
    return found["tokens"] or 0, found["words"] or 0


def score(docs: DataFrame, is_train: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each row; the model learns from those with ``is_train``."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), is_train.alias("train"))
    dealt, chars = chunked(rows)
    bits, shards = bits_for(ORDER * chars // 6), shards_for(chars)
    n_train, n_distinct = vocabulary(rows, shards)

    def ask(key, frame):
        keys, counts = Stream(frame["text"], bits).distinct(frame["train"].to_numpy(bool))
        at = shard_bounds(keys, bits, shards)
        full = np.flatnonzero(np.diff(at))
        part = [slice(at[k], at[k + 1]) for k in full]
        return pd.DataFrame({"chunk": key[0], "shard": full, "keys": [pack(keys[x]) for x in part], "counts": [squeeze(counts[x]) for x in part]})

    def answer(key, frame):
        sent = [unpack(b) for b in frame["keys"]]
        keys = np.concatenate(sent)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        at = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
        totals = np.add.reduceat(np.concatenate([unsqueeze(b) for b in frame["counts"]])[order], at)
        keys = keys[at]
        return pd.DataFrame({"chunk": frame["chunk"], "shard": key[0], "totals": [squeeze(totals[np.searchsorted(keys, k)]) for k in sent]})

    def read(left, right):
        s = Stream(left["text"], bits)
        keys, _ = s.distinct(left["train"].to_numpy(bool))
        at = shard_bounds(keys, bits, shards)
        counts = np.zeros(len(keys), np.uint64)
        for k, blob in zip(right["shard"], right["totals"]):
            counts[at[k] : at[k + 1]] = unsqueeze(blob)
        machine = Automaton(s, keys, counts, n_train, n_distinct)
        known = (machine.count[machine.word] > 0).astype(np.int64)
        return pd.DataFrame({
            "doc_id": left["doc_id"], "n_tokens": np.diff(s.first) - 1, "n_known": s.per_text(known), "train_tokens": n_train,
            "base_score": s.per_text(machine.root_weight[machine.word]), "score": s.per_text(machine.read(s)),
        })

    asked = dealt.groupBy("chunk").applyInPandas(lean(ask), "chunk int, shard int, keys binary, counts binary")
    told = asked.groupBy("shard").applyInPandas(lean(answer), "chunk int, shard int, totals binary")
    columns = "doc_id string, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(lean(read), columns)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
