"""Periodic runs of words, found in a suffix tree of each text.

The suffix tree is held as its intervals: the suffixes are sorted (by doubling, in
which only groups that aren't single yet are sorted again), and every run of sorted
suffixes with a common prefix is a node whose leaves are that run. From each leaf the
walk goes up the tree, and skips every node in whose largest child it comes: so a
leaf is looked at once for each smaller half, log n times at most. At a node of depth
d, the suffix d words before or after the leaf's is looked up: if it is a leaf of the
node too, but of another child, the two are a branching tandem repeat, two equal
blocks of d words which the word after them doesn't go on.

A repeat is rotated to the left as long as the words d apart agree, and repeats that
become the same stretch are merged, the least period standing. These are the maximal
runs.

Texts are independent. Many are put in one tree, whose words are told apart by text,
so that no repeat crosses texts and numpy works on long arrays.

Defined results: null and empty texts, and those of white space only, have no words,
no runs and an empty collapsed text. Repeated rows stay apart. Columns ``n_words``,
``runs`` and ``collapsed`` replace any so named; all others stay as they are. Texts
are read whole; memory grows with the longest text and not with the table. An empty
table has an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillsift.llm.common import small_batches

#: Words that share a tree, unless one text has more.
TREE_WORDS = 150_000

Prepare = Callable[[list[bytes], "int | None"], list[bytes]]


def sorted_suffixes(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Order of all suffixes, and for each k the classes of the 2^k symbols from every place on.

    ``symbols`` are numbers; the end counts as less than any. Classes are the place
    of the first suffix of a class in the order.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    new = np.r_[True, symbols[order[1:]] != symbols[order[:-1]]] if n else np.zeros(0, dtype=bool)
    rank = np.empty(n, dtype=np.int32)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    levels, width = [rank], 1
    sizes = np.bincount(rank, minlength=n) if n else np.zeros(0, dtype=np.int64)
    active = np.flatnonzero(sizes[rank] > 1)
    while len(active):
        after = active + width
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[active].astype(np.int64) * (n + 1) + second
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        old = rank[active]
        group = np.flatnonzero(np.r_[True, old[1:] != old[:-1]])
        offset = np.arange(len(active)) - np.repeat(group, np.diff(np.r_[group, len(active)]))
        new = np.r_[True, key[1:] != key[:-1]]
        first = np.flatnonzero(new)
        rank = rank.copy()
        rank[active] = (old + offset)[first][np.cumsum(new) - 1]
        levels.append(rank)
        width *= 2
        active = active[np.repeat(np.diff(np.r_[first, len(active)]) > 1, np.diff(np.r_[first, len(active)]))]
    order = np.empty(n, dtype=np.int64)
    order[rank] = np.arange(n)
    return order, levels


def common_prefixes(left: np.ndarray, right: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Length of the longest common prefix of the suffixes at ``left`` and ``right``, which differ in each pair."""
    n = len(levels[0])
    length = np.zeros(len(left), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = left + length, right + length
        same = (a < n) & (b < n)
        same[same] = levels[k][a[same]] == levels[k][b[same]]
        length[same] += 1 << k
    return length


def common_suffixes(left: np.ndarray, right: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """How many symbols before ``left`` and before ``right`` agree."""
    length = np.zeros(len(left), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = left - length - (1 << k), right - length - (1 << k)
        same = (a >= 0) & (b >= 0)
        same[same] = levels[k][a[same]] == levels[k][b[same]]
        length[same] += 1 << k
    return length


def _smaller(lcp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place in ``at``: the last before it whose value isn't greater, and the first after it whose value is less.

    The ends of ``lcp`` are less than all others, so both exist.
    """
    least = [lcp.astype(np.int32)]  # of 2^k values from every place on
    while len(least[-1]) > (1 << (len(least) - 1)):
        w = 1 << (len(least) - 1)
        least.append(np.minimum(least[-1][:-w], least[-1][w:]))
    low, high, own = at.copy(), at + 1, lcp[at]
    for k in range(len(least) - 1, -1, -1):
        w, here = 1 << k, least[k]
        fits = low - w >= 0
        fits[fits] = here[low[fits] - w] > own[fits]
        low[fits] -= w
        fits = high < len(here)
        fits[fits] = here[high[fits]] >= own[fits]
        high[fits] += w
    return low - 1, high


def branching_repeats(order: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Start and block length of every branching tandem repeat, each once."""
    n, rank = len(order), levels[-1]
    none = np.zeros(0, dtype=np.int64)
    if n < 2:
        return none, none
    # lcp[s]: of the suffixes at places s - 1 and s; -1 beyond the ends
    lcp = np.r_[-1, common_prefixes(order[:-1], order[1:], levels), -1]
    some = np.flatnonzero(lcp > 0)
    low, high = np.zeros(n + 1, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
    low[some], high[some] = _smaller(lcp, some)
    # the leftmost place of equal prefixes stands for the node
    node = np.arange(n + 1)
    tied = some[lcp[low[some]] == lcp[some]]
    node[tied] = low[tied]
    while (node[node] != node).any():
        node = node[node]
    first, last = low[node], high - 1  # leaves of the node at each place
    above = lambda a, b: np.where(np.maximum(lcp[a], lcp[b]) > 0, node[np.where(lcp[a] >= lcp[b], a, b)], -1)
    inner = np.flatnonzero((node == np.arange(n + 1)) & (lcp > 0))
    parent = np.full(n + 1, -1, dtype=np.int64)
    parent[inner] = above(first[inner], last[inner] + 1)
    size = last - first + 1
    # the largest child of each node, and for every node the top of the chain of largest children it ends
    held = inner[parent[inner] >= 0]
    by = held[np.lexsort((size[held], parent[held]))]
    heavy = by[np.r_[parent[by[1:]] != parent[by[:-1]], True]] if len(by) else by
    top = np.arange(n + 1)
    top[heavy] = parent[heavy]
    while (top[top] != top).any():
        top = top[top]
    leaf = np.arange(n)
    at = above(leaf, leaf + 1)
    live = at >= 0
    leaf, at = leaf[live], at[live]
    child_first, child_last = leaf, leaf
    starts, blocks = [none], [none]
    while len(leaf):
        place, depth = order[leaf], lcp[at]
        for other in (place + depth, place - depth):
            ok = (other >= 0) & (other < n)
            r = rank[other[ok]]
            met = (r >= first[at[ok]]) & (r <= last[at[ok]]) & ((r < child_first[ok]) | (r > child_last[ok]))
            starts.append(np.minimum(place[ok][met], other[ok][met]))
            blocks.append(depth[ok][met])
        child = top[at]
        live = parent[child] >= 0
        leaf, child = leaf[live], child[live]
        at, child_first, child_last = parent[child], first[child], last[child]
    key = np.unique(np.concatenate(starts) * (n + 1) + np.concatenate(blocks))
    return key // (n + 1), key % (n + 1)


def maximal_runs(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and least period of every maximal run of two periods or more, by start and period."""
    order, levels = sorted_suffixes(symbols)
    start, period = branching_repeats(order, levels)
    end = start + 2 * period
    start = start - common_suffixes(start, start + period, levels)
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    one = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])] if len(start) else np.zeros(0, dtype=bool)
    start, end, period = start[one], end[one], period[one]
    by = np.lexsort((period, start))
    return start[by], (end - start)[by], period[by]


def runs_of_texts(texts: list[list[bytes]], min_words: int = 12) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of ``min_words`` words or more of each text."""
    known: dict[bytes, int] = {}
    coded = [np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words)) for words in texts]
    begins = np.r_[0, np.cumsum([len(c) for c in coded])]
    symbols = np.concatenate([c + i * len(known) for i, c in enumerate(coded)]) if coded else np.zeros(0, dtype=np.int64)
    start, length, period = maximal_runs(symbols)
    long = length >= min_words
    start, length, period = start[long], length[long], period[long]
    text = np.searchsorted(begins, start, "right") - 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for t, s, n, q in zip(text.tolist(), (start - begins[text]).tolist(), length.tolist(), period.tolist(), strict=True):
        out[t].append((s, n, q))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run has after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    for s, n, q in runs:
        depth[s + q] += 1
        depth[s + n] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]


def find_runs(docs: DataFrame, prepare: Prepare | None = None, min_words: int = 12) -> DataFrame:
    """``docs`` without text, but with n_words, runs (array of start, length and period, by start and period) and the collapsed text.

    Words are ``[^\\x20\\x09-\\x0D]+``; ``prepare`` may change a document's words, given its doc_id, before they are searched.
    """
    small_batches(docs.sparkSession)
    own = ("text", "n_words", "runs", "collapsed")
    kept = [c for c in docs.columns if c not in own]
    cell = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def worked(b: pa.RecordBatch, texts: list[list[bytes]]) -> pa.RecordBatch:
            every = runs_of_texts(texts, min_words)
            flat = [r for runs in every for r in runs]
            cells = pa.StructArray.from_arrays([pa.array([r[k] for r in flat], pa.int64()) for k in range(3)], fields=list(cell))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(r) for r in every])], pa.int32()), cells)
            left = pa.array([b" ".join(collapse(w, r)) for w, r in zip(texts, every, strict=True)], pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([b.column("rest"), pa.array([len(w) for w in texts], pa.int64()), lists, left], ["rest", *own[1:]])

        for b in batches:
            texts, size, begin = [], 0, 0
            ids = b.column("id")
            for k, text in enumerate(b.column("text")):
                words = (text.as_py() or "").encode("utf-8", "replace").split()  # bytes are split at ASCII white space alone
                texts.append(words if prepare is None else prepare(words, ids[k].as_py()))
                size += len(texts[-1])
                if size >= TREE_WORDS:
                    yield worked(b.slice(begin, k + 1 - begin), texts)
                    texts, size, begin = [], 0, k + 1
            if texts:
                yield worked(b.slice(begin), texts)

    # other columns go along in one, whatever their names
    rest = F.struct(*(f"`{c.replace('`', '``')}`" for c in kept)).alias("rest")
    given = docs.select(rest, F.col("doc_id").alias("id"), "text")
    schema = StructType.fromDDL("n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
    return given.mapInArrow(found, StructType([given.schema["rest"], *schema])).select("rest.*", *own[1:])


def periodic_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of the contract: every tenth document, by the hash of its id, ends in a repeated stretch.

    A document without an id keeps its words.
    """
    import zlib

    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]
