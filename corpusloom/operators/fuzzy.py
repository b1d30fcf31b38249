"""The most similar term of a dictionary for each of many words, by Ratcliff-Obershelp ratio, with few ratios computed.

A ratio is 2 M / (length + length), where the M matched characters are a common subsequence and a part of the letters that
both texts have. So M is at most the letters they share with repetition, and at most their longest common subsequence. Both bounds
are computed for a whole batch of words and a term at once: the first from counts of letters, the second for the words that pass it
by 64-bit words that hold one row of the table. Ratios are computed from the highest bound down, and none that can't win.
(Letter pairs bound nothing at 0.6: ``abc`` and ``axbyc`` share none and have a ratio of 0.75.)
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_EPS = 1e-9


def _codes(words: list[str]) -> np.ndarray:
    """Code points, one row a word, zeros after its end."""
    longest = max(map(len, words), default=0)
    return np.array([w.ljust(longest, "\0") for w in words], f"<U{max(1, longest)}").view(np.uint32).reshape(len(words), -1)


def _common(places: np.ndarray, masks: np.ndarray, length: int) -> np.ndarray:
    """Longest common subsequence of each row with a term of ``length`` letters; ``masks`` has the term's places of each letter."""
    v = np.full(len(places), ~np.uint64(0))
    for column in places.T:
        u = v & masks[column]
        v = (v + u) | (v - u)
    return length - np.bitwise_count(v & np.uint64((1 << length) - 1)).astype(np.int64)


def longest(terms: list[str], least: float) -> float:
    """No longer word reaches ``least`` with one of the terms."""
    return max(map(len, terms), default=0) * (2 - least) / max(least, _EPS) + 1


def _matched(x: str, y: str) -> int:
    """Matched characters of two short texts, as difflib counts them: the longest common piece, the first in ``x`` and then in ``y``, and the same on both sides of it."""
    for k in range(min(len(x), len(y)), 0, -1):
        at, place = len(x), -1
        for j in range(len(y) - k + 1):
            i = x.find(y[j : j + k], 0, at + k - 1)  # only before the place found
            if i >= 0:
                at, place = i, j
        if place >= 0:
            return k + (_matched(x[:at], y[:place]) if at and place else 0) + _matched(x[at + k :], y[place + k :])
    return 0


class Dictionary:
    """Terms in their order; equal terms count once, at their first place."""

    def __init__(self, terms: list[str], least: float) -> None:
        self.least, self.terms = least, list(terms)
        self.letters = np.unique(np.concatenate([_codes([t])[0] for t in terms] or [np.zeros(0, np.uint32)]))
        size = len(self.letters)
        self.counts = np.zeros((len(terms), size + 1), np.int16)
        self.masks = np.zeros((len(terms), size + 1), np.uint64)
        for k, t in enumerate(terms):
            for i, at in enumerate(self._places(_codes([t]))[0][: len(t)]):
                self.counts[k, at] += 1
                self.masks[k, at] |= np.uint64(1 << i) if i < 64 else np.uint64(0)

        self.packs = self._packed()

    def _packed(self) -> list[tuple[np.ndarray, int, int, list[tuple[int, int]]]]:
        """Terms of up to 62 letters side by side in 64-bit words, each with a bit above it that stops a carry: masks, those bits, the others, terms with their first bit."""
        packs, free = [], 0
        for k, t in enumerate(self.terms):
            if len(t) > 62:
                continue
            if len(t) + 1 > free:
                packs.append([np.zeros(self.masks.shape[1], np.uint64), 0, 0, []])
                free = 64
            at, pack = 64 - free, packs[-1]
            pack[0] |= self.masks[k] << np.uint64(at)
            pack[1] |= 1 << (at + len(t))
            pack[2] |= ((1 << len(t)) - 1) << at
            pack[3].append((k, at))
            free -= len(t) + 1
        return [tuple(p) for p in packs]

    def _places(self, codes: np.ndarray) -> np.ndarray:
        """Numbers of letters; those in no term have the last."""
        at = np.searchsorted(self.letters, codes)
        return np.where((at < len(self.letters)) & (self.letters[np.minimum(at, len(self.letters) - 1)] == codes), at, len(self.letters))

    def bounds(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``word, term, bound`` of the pairs whose ratio may reach ``least``."""
        if not words or not self.terms:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        lengths = np.array([len(w) for w in words])
        near = np.nonzero(lengths <= longest(self.terms, self.least))[0]
        places = self._places(_codes([words[i] for i in near]))
        n, size = len(near), len(self.letters) + 1
        counts = np.bincount((np.arange(n)[:, None] * size + places).ravel(), minlength=n * size).reshape(n, size).astype(np.int16)
        counts[:, -1] = 0
        common = {}
        for masks, stops, bits, held in self.packs:  # the common subsequences with all terms of a word at once
            v = np.full(n, bits, np.uint64)
            for column in places.T:
                u = v & masks[column]
                v = ((v + u) | (v - u)) & np.uint64(~stops & (1 << 64) - 1)
            for k, at in held:
                size_k = len(self.terms[k])
                common[k] = size_k - np.bitwise_count(v & np.uint64(((1 << size_k) - 1) << at)).astype(np.int64)
        found = []
        for k, t in enumerate(self.terms):
            if k in common:
                total, shared = lengths[near] + len(t), common[k]
                own = np.nonzero(shared >= self.least * total / 2 - _EPS)[0]
                found.append((near[own], np.full(len(own), k), np.where(total[own] > 0, 2 * shared[own] / np.maximum(total[own], 1), 1.0)))
                continue
            total = lengths[near] + len(t)
            need = self.least * total / 2 - _EPS
            own = np.nonzero(np.minimum(lengths[near], len(t)) >= need)[0]
            has = np.nonzero(self.counts[k])[0]
            shared = np.minimum(counts[np.ix_(own, has)], self.counts[k, has]).sum(1, dtype=np.int64)
            own, shared = own[shared >= need[own]], shared[shared >= need[own]]
            if len(t) < 64 and len(own):
                shared = np.minimum(shared, _common(places[own], self.masks[k], len(t)))
                own, shared = own[shared >= need[own]], shared[shared >= need[own]]
            found.append((near[own], np.full(len(own), k), np.where(total[own] > 0, 2 * shared / np.maximum(total[own], 1), 1.0)))
        return tuple(np.concatenate(x) for x in zip(*found))

    def best(self, words: list[str]) -> tuple[list[int], int]:
        """Of each word the first of its most similar terms (-1 if none reaches ``least``), and how many ratios were computed."""
        word, term, bound = self.bounds(words)
        out, calls = [-1] * len(words), 0
        reached = [0.0] * len(words)
        for k in np.lexsort((term, -bound, word)).tolist():
            w, t = int(word[k]), int(term[k])
            if bound[k] < reached[w] - _EPS or (out[w] >= 0 and bound[k] <= reached[w] + _EPS and t > out[w]):
                continue
            x, y = words[w], self.terms[t]
            if x and y and (y in x or x in y):  # the shorter is matched whole
                r = 2.0 * min(len(x), len(y)) / (len(x) + len(y))
            elif x and y and len(y) < 200:
                r, calls = 2.0 * _matched(x, y) / (len(x) + len(y)), calls + 1
            else:  # difflib leaves out what is frequent in longer texts
                r, calls = difflib.SequenceMatcher(None, x, y).ratio(), calls + 1
            if r >= self.least and (r > reached[w] or (r == reached[w] and t < out[w])):
                out[w], reached[w] = t, r
        return out, calls


class Votes:
    """Votes of texts for the domains of their most similar terms. What a word or pair votes for is kept for the next text, up to ``held`` of them."""

    def __init__(self, terms: list[str], domains: list[str], least: float, held: int = 500_000) -> None:
        self.known, self.held, self.names = Dictionary(terms, least), held, sorted(set(domains))
        self.domain = np.array([self.names.index(d) for d in domains], np.int64)
        self.longest = longest(terms, least)
        self.seen: dict[str, int] = {}

    def _grams(self, words: list[str]) -> tuple[list[str], int]:
        """The words and then the pairs that are short enough, in order, and how many are words."""
        most = self.longest
        short = [w for w in words if len(w) <= most]
        return short + [f"{a} {b}" for a, b in zip(words, words[1:]) if len(a) + len(b) < most], len(short)

    def of(self, texts: list[list[str]]) -> list[dict[str, tuple[int, int]]]:
        """For each text, given as its words, the votes of each domain and the place of the first among words and pairs."""
        if len(self.seen) > self.held:
            self.seen.clear()
        grams = [self._grams(words) for words in texts]
        new = list(set().union(*(g for g, _ in grams)) - self.seen.keys())
        self.seen.update(zip(new, self.known.best(new)[0]))
        out = []
        for g, n in grams:
            term = np.fromiter(map(self.seen.__getitem__, g), np.int64, len(g))
            at = np.flatnonzero(term >= 0)
            domain = self.domain[term[at]]
            votes = np.bincount(domain, np.where(at < n, 1, 2), len(self.names)).astype(np.int64)
            kinds, first = np.unique(domain, return_index=True)
            out.append({self.names[k]: (int(votes[k]), int(at[i])) for k, i in zip(kinds.tolist(), first.tolist())})
        return out


def domain_votes(texts: DataFrame, terms: list[str], domains: list[str], least: float = 0.6, at_once: int = 200) -> DataFrame:
    """``content_id, nicho, votos, place`` of ``texts (content_id, words)``; a narrow step, ``at_once`` texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes = Votes(terms, domains, least)
        for b in batches:
            for i in range(0, b.num_rows, at_once):
                part = b.slice(i, at_once)
                found = [(k, d, n, p) for k, v in enumerate(votes.of(part.column(1).to_pylist())) for d, (n, p) in v.items()]
                ks, ds, ns, ps = zip(*found) if found else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(ks, pa.int64())), pa.array(ds, pa.string()), pa.array(ns, pa.int64()), pa.array(ps, pa.int64())], ["content_id", "nicho", "votos", "place"])

    kind = texts.schema["content_id"].dataType.simpleString()
    return texts.select("content_id", "words").mapInArrow(run, f"content_id {kind}, nicho string, votos long, place long")
