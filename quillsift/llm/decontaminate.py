"""Benchmark decontamination with a BM25 index and block-max WAND.

Test items are held in an inverted index. A posting's impact is the item's BM25
weight for the term as a share of the item's score for itself, so one threshold
from 0 to 1 suits all items. Every document is cut into passages of two halves,
each half as long as the longest item and shared with the next passage, so that
every copy of an item lies whole in some passage. Every passage is a query:

1. Blocks of items whose summed block maxima can't reach the threshold are
   dropped, for all passages of a document at once. Terms found in very many
   items count here by the greatest share they have in any one item.
2. Passages with blocks left are run through WAND with block maxima, which
   returns every item at or above the threshold.
3. An item found is verified: five-word shingles of the item (its question, all
   but the last sentence, and its answer, the last one) must be in the passage
   to ``min_overlap``, and some of the answer, unless nearly all of the item is.

Items are gathered to the driver in blocks of ``block_items``; a larger benchmark
is run block by block over the corpus. Document frequencies, the mean length and
the length of passages are those of all items, and scores are exact sums, so that
the size of a block bears on neither scores nor matches.

Defined results: null, empty and short documents are passages of their own, and
match nothing if they hold no word of an item; items that are null or have no
word match nothing; an item of fewer than five words is one shingle. Repeated
documents and items give repeated matches, one row each pair of row and item. An
empty table on either side gives no match. Texts of any length are read whole, in
runs of passages, so that memory grows with the words of a text and not with their
number times the items'. Columns beyond those named are kept by ``with_matches``, which
replaces the one that it is told to fill.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm.common import small_batches

_PLAIN = bytes(32 if b < 128 and not chr(b).isalnum() else b for b in range(256))
_SENTENCES = re.compile(r"(?<=[.!?])\s+")
SHINGLE = 5
#: Sums, and postings, that are held at once for one text.
CELLS = 1 << 20


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_PLAIN).split()


def shingles(words: list) -> set[tuple]:
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


@dataclass
class Statistics:
    """Of all items: how many have a word, their words, the longest one's, and how many items hold each word."""

    n: int = 0
    words: int = 0
    longest: int = 1
    frequency: Counter = field(default_factory=Counter)

    def add(self, text: str) -> None:
        words = words_of(text)
        if words:
            self.n, self.words, self.longest = self.n + 1, self.words + len(words), max(self.longest, len(words))
            self.frequency.update(set(words))


class Index:
    """Postings by term, with impacts, block maxima and a bound for frequent terms."""

    def __init__(self, items: list[tuple[int, str]], threshold: float, every: Statistics | None = None, block: int = 4, spare: float = 0.3, k1: float = 0.9, b: float = 0.4):
        """``every``: the statistics of the whole benchmark, of which ``items`` may be a part; by default those of ``items``."""
        held = [(i, w, t) for i, t in items if (w := words_of(t))]
        if every is None:
            every = Statistics()
            for _, t in items:
                every.add(t)
        self.ids = [i for i, _, _ in held]
        self.threshold, self.block = threshold, block
        self.longest = every.longest
        self.vocabulary: dict[bytes, int] = {}
        frequency, mean = every.frequency, every.words / max(1, every.n)
        postings: dict[int, list[tuple[int, float]]] = {}
        for k, (_, words, _) in enumerate(held):
            weights = {
                w: math.log(1 + (every.n - frequency[w] + 0.5) / (frequency[w] + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(words) / mean))
                for w, tf in Counter(words).items()
            }
            own = math.fsum(weights.values())
            for w, x in weights.items():
                postings.setdefault(self.vocabulary.setdefault(w, len(self.vocabulary)), []).append((k, x / own))
        terms = range(len(self.vocabulary))
        self.items = [[k for k, _ in postings[t]] for t in terms]
        self.impacts = [[x for _, x in postings[t]] for t in terms]
        self.most = [max(x) for x in self.impacts]
        self.maxima: list[dict[int, float]] = []
        for t in terms:
            top: dict[int, float] = {}
            for k, x in postings[t]:
                top[k // block] = max(top.get(k // block, 0), x)
            self.maxima.append(top)
        # the terms of most items are left out of the sums, as long as what they add to any item stays small
        rest, self.common, self.spare = np.zeros(len(held) + 1), set(), 0.0
        for t in sorted(terms, key=lambda t: (-len(self.items[t]), t)):
            rest[self.items[t]] += self.impacts[t]
            if rest.max() > threshold * spare:
                break
            self.common.add(t)
            self.spare = float(rest.max())
        flat = [[] if t in self.common else sorted(self.maxima[t].items()) for t in terms]
        self.at = np.cumsum([0] + [len(x) for x in flat])
        self.flat_block = np.array([k for x in flat for k, _ in x], dtype=np.int64)
        self.flat_max = np.array([m for x in flat for _, m in x])
        self.blocks = len(held) // block + 1
        names = lambda words: [self.vocabulary[w] for w in words]
        self.whole = [shingles(names(w)) for _, w, _ in held]
        self.answer = []
        for _, words, text in held:
            parts = _SENTENCES.split(text.strip())
            last = words_of(parts[-1]) if len(parts) > 1 else []
            self.answer.append(set(names(last)))

    def live(self, terms: np.ndarray) -> np.ndarray:
        """Passages (by their first half) of a document in which some block may reach the threshold.

        Passages are taken in runs, so that neither their sums by block nor the
        postings that are added up at once exceed ``CELLS``, however long the text is.
        """
        halves = max(1, -(-len(terms) // self.longest))
        step = max(1, CELLS // self.blocks)
        found = [first + self._live(terms[first * self.longest : (first + step + 1) * self.longest], min(step, halves - first)) for first in range(0, halves, step)]
        return np.concatenate(found)

    def _live(self, terms: np.ndarray, passages: int) -> np.ndarray:
        half, size = self.longest, len(self.vocabulary)
        where = np.flatnonzero(terms >= 0)
        if not len(where):
            return where
        cell = (where // half) * size + terms[where]
        cell = np.unique(np.concatenate([cell, cell[where >= half] - size]))  # a term counts once in each passage
        passage, t = cell // size, cell % size
        passage, t = passage[passage < passages], t[passage < passages]
        n = self.at[t + 1] - self.at[t]
        total, sums = np.r_[0, np.cumsum(n)], np.zeros(passages * self.blocks)
        begin = 0
        while begin < len(t):  # postings of a bounded number at a time
            end = max(begin + 1, int(np.searchsorted(total, total[begin] + CELLS, "right")) - 1)
            own = n[begin:end]
            pick = np.repeat(self.at[t[begin:end]] - np.r_[0, np.cumsum(own)[:-1]], own) + np.arange(own.sum())
            sums += np.bincount(np.repeat(passage[begin:end], own) * self.blocks + self.flat_block[pick], self.flat_max[pick], len(sums))
            begin = end
        most = sums.reshape(passages, self.blocks).max(axis=1)
        return np.flatnonzero((most + self.spare >= self.threshold - 1e-9) & (np.bincount(passage, minlength=passages) > 0))

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """All items whose score for the distinct terms reaches the threshold, by WAND with block maxima."""
        theta, found = self.threshold - 1e-9, []
        cursors = [[self.items[t][0], 0, t] for t in terms]
        while cursors:
            cursors.sort()
            total, pivot = 0.0, -1
            for j, (_, _, t) in enumerate(cursors):
                total += self.most[t]
                if total >= theta:
                    pivot = j
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // self.block
            if sum(self.maxima[t].get(block, 0.0) for _, _, t in cursors[: pivot + 1]) < theta:
                goal = (block + 1) * self.block  # nothing in this block up to the next list's item
                if pivot + 1 < len(cursors):
                    goal = min(goal, cursors[pivot + 1][0])
                self._forward(cursors, pivot, max(goal, item + 1))
            elif cursors[0][0] == item:
                score = math.fsum(self.impacts[t][k] for _, k, t in cursors[: pivot + 1])
                if score >= theta:
                    found.append((item, score))
                self._forward(cursors, pivot, item + 1)
            else:
                self._forward(cursors, pivot, item)
        return found

    def _forward(self, cursors: list, pivot: int, goal: int) -> None:
        """Move the first lists on to ``goal``; drop those that end."""
        for j in range(pivot, -1, -1):
            now, k, t = cursors[j]
            if now < goal:
                k = bisect_left(self.items[t], goal, k)
                if k == len(self.items[t]):
                    del cursors[j]
                else:
                    cursors[j] = [self.items[t][k], k, t]

    def matches(self, text: str | None, min_overlap: float) -> dict[int, tuple[float, float]]:
        """Verified items of one text: position in ids -> (score, share of its shingles)."""
        get = self.vocabulary.get
        terms = np.array([get(w, -1) for w in words_of(text)], dtype=np.int64)
        best: dict[int, tuple[float, float]] = {}
        for h in self.live(terms) if len(terms) else ():
            passage = terms[h * self.longest : (h + 2) * self.longest].tolist()
            here = shingles(passage)
            for item, score in self.search(sorted({t for t in passage if t >= 0})):
                whole = self.whole[item]
                short = len(next(iter(whole))) < SHINGLE
                n = len(next(iter(whole)))
                have = {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)} if short else here
                share = len(whole & have) / len(whole)
                answer = self.answer[item]
                answered = not answer or len(answer & set(passage)) >= 0.5 * len(answer)
                if share >= min_overlap and (answered or share >= 0.9) and (share, score) > best.get(item, (0, 0))[::-1]:
                    best[item] = (score, share)
        return best


MATCHES = "array<struct<item_id: bigint, score: double, overlap: double>>"


def with_matches(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, min_overlap: float = 0.8, block_items: int = 20000, into: str = "matches") -> DataFrame:
    """Add ``into``, the items found in each row's text, without moving the texts; it replaces a column so named."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.withColumn(into, F.array().cast(MATCHES))
    items = benchmark.filter(F.col("text").isNotNull()).select("item_id", "text").orderBy("item_id", "text")
    every = Statistics()
    for r in items.toLocalIterator():
        every.add(r["text"])

    def add(out: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
        index = spark.sparkContext.broadcast(Index(items, threshold, every))  # of block_items items at most

        @F.pandas_udf(MATCHES)
        def scan(texts: pd.Series) -> pd.Series:
            ix = index.value
            return pd.Series([
                [{"item_id": ix.ids[k], "score": score, "overlap": share} for k, (score, share) in sorted(ix.matches(t, min_overlap).items())]
                for t in texts
            ])

        return out.withColumn(into, F.concat(into, scan("text")))

    block: list[tuple[int, str]] = []
    for r in items.toLocalIterator():
        block.append((r["item_id"], r["text"]))
        if len(block) == block_items:
            docs, block = add(docs, block), []
    return add(docs, block) if block else docs


def contaminated(docs: DataFrame, benchmark: DataFrame, **limits) -> DataFrame:
    """(doc_id, item_id, score, overlap) of every document and the items found in it."""
    found = with_matches(docs.select("doc_id", "text"), benchmark, **limits)
    return found.select("doc_id", F.inline("matches"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` in which no item is found."""
    own = "_quillsift_matches"
    return with_matches(docs, benchmark, into=own, **limits).filter(F.size(own) == 0).drop(own)
