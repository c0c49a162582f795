"""Removal of long repeated byte strings with suffix arrays.

Every byte covered by a string of ``width`` bytes that also starts anywhere else,
in another document or in the same one, is removed. Matches are judged on the
input and never cross documents.

Sharding by content. The least hash of the grams inside a window of ``width``
bytes depends on the window alone, so equal windows have equal least hashes.
Runs of neighbouring windows with one least hash are *pieces*, and pieces with
that hash are a *class*: equal windows always meet in one class. Pieces equal by a
128-bit digest are carried once, with the number of their places as a weight. A
class of one distinct piece that can't repeat inside itself is settled by that
number: with one place it has no repeat, with more it is one group, and the piece
is removed whole. The pieces of all other classes are fetched and put in suffix
arrays, whose groups repeat if their weights exceed one.

Suffix arrays. Classes are packed in shards of about ``shard_bytes``. A shard's
suffixes are sorted by Larsson-Sadakane refinement in numpy: groups of equal
prefixes are split by the ranks of the suffixes one prefix length further on,
and sorted groups drop out. Kasai's common prefixes (in Phi order: a value is one
less than its predecessor's unless the bytes before differ) give the groups of
windows that agree on ``width`` bytes.

Classes larger than a shard are split into several shards, each sorted on its
own, and each pair of them is merged by binary search of the windows of one in the
suffix array of the other. As pairs grow with the square of a class, one of more
than ``paired`` shards is first cut anew by the least hash of another hash
function, up to ``levels`` times, which parts windows that share a gram but not
their surroundings; what is still large then is merged pair by pair all the same.

Texts are written once, dealt out evenly by a row number and bucketed, so that the
fetch of pieces and the removal join that table without moving the texts again.

Defined results: a null text is empty, as is an empty table's result; texts shorter
than ``width`` lose nothing; copies of a longer text lose everything. Rows that
repeat a doc_id stay separate. Texts of any length are read whole; a piece of very
many windows is carried in parts. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.llm.common import bucketed, materialize, small_batches

GRAM = 32
#: Windows of a piece, at most; longer runs are carried as several pieces of one class.
MOST_WINDOWS = 500_000
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def gram_hashes(data: np.ndarray, gram: int = GRAM, seed: int = 0) -> np.ndarray:
    up, down = _power(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(data * up, out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1]
    h ^= np.uint64(seed * 0xD6E8FEB86659FD93 % 2**64)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def sliding_least(h: np.ndarray, w: int) -> np.ndarray:
    """Least of every run of w values, from the running minima of blocks of w."""
    n = len(h) - w + 1
    blocks = -(-len(h) // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(h)] = h
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def pieces(data: bytes, width: int, seed: int = 0) -> tuple[np.ndarray, ...]:
    """Start, windows, class, two halves of a digest, may repeat in itself: of each run of windows with one least hash."""
    arr = np.frombuffer(data, dtype=np.uint8)
    gram = min(GRAM, width)
    h, w = gram_hashes(arr, gram, seed), width - gram + 1
    least = sliding_least(h, w)
    starts = np.r_[0, np.flatnonzero(least[1:] != least[:-1]) + 1]
    sizes = np.diff(np.r_[starts, len(least)])
    if sizes.max() > MOST_WINDOWS:
        parts = -(-sizes // MOST_WINDOWS)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = np.repeat(starts, parts) + nth * MOST_WINDOWS
        sizes = np.minimum(np.repeat(sizes, parts) - nth * MOST_WINDOWS, MOST_WINDOWS)
    values, which = np.unique(least[starts], return_inverse=True)
    at = np.flatnonzero(h <= values[-1])
    slot = np.minimum(np.searchsorted(values, h[at]), len(values) - 1)
    hit = values[slot] == h[at]
    codes = np.sort(slot[hit] * (len(h) + 1) + at[hit])  # places of the least grams, by gram
    first = which * (len(h) + 1) + starts
    twice = np.searchsorted(codes, first + sizes + w - 2, "right") - np.searchsorted(codes, first, "left") > 1
    view, digest = memoryview(data), xxhash.xxh3_128_digest
    digests = b"".join([digest(view[a:b]) for a, b in zip(starts.tolist(), (starts + sizes + width - 1).tolist(), strict=True)])
    d = np.frombuffer(digests, dtype="<i8").reshape(-1, 2)
    return starts, sizes, least[starts].view(np.int64), d[:, 0], d[:, 1], twice


def prefix_keys(data: np.ndarray, size: int = 7) -> np.ndarray:
    """The first ``size`` bytes, up to 7, of every suffix as one number; the end of the text sorts first."""
    padded = np.zeros(len(data) + size - 1, dtype=np.uint64)
    padded[: len(data)] = data
    padded[: len(data)] += np.uint64(1)
    key = np.zeros(len(data), dtype=np.uint64)
    for k in range(size):
        key = key * np.uint64(257) + padded[k : k + len(data)]
    return key


def _packed_order(high: np.ndarray, low: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """``high`` and ``low`` (below 2**bits), sorted by high and then low, as whole numbers if they fit."""
    if not len(high) or int(high.max()).bit_length() + bits <= 63:
        both = (high.astype(np.int64) << bits) | low
        both.sort()
        return both >> bits, both & ((1 << bits) - 1)
    by = np.argsort(high, kind="stable")
    return high[by], low[by]


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Larsson-Sadakane: refine groups of equal prefixes by the ranks h further on, doubling h."""
    n = len(data)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    bits, h, small = n.bit_length(), 5, np.int32 if n < 2**31 - 1 else np.int64
    sorted_keys, order = _packed_order(prefix_keys(data, h).astype(np.int64), np.arange(n), bits)
    order = order.astype(small)
    new = np.empty(n, dtype=bool)
    new[0] = True
    np.not_equal(sorted_keys[1:], sorted_keys[:-1], out=new[1:])
    slots = np.arange(n, dtype=small)
    group = np.maximum.accumulate(slots * new)
    rank = np.empty(n + 1, dtype=small)
    rank[order], rank[n] = group, -1
    while True:
        shared = ~new
        shared[:-1] |= shared[1:]  # of groups of two or more; sorted groups drop out
        slots, group = slots[shared], group[shared]
        if not len(slots):
            return order.astype(np.int64)
        members, new = order[slots], new[shared]
        nth = np.cumsum(new, dtype=np.int64)  # groups, numbered without gaps, need fewer bits
        further = rank[np.minimum(members + small(min(h, n)), n)]
        nth <<= bits
        nth |= further + small(1)
        by, members = _packed_order(nth, members, bits)
        members = members.astype(small)
        order[slots] = members
        new = np.empty(len(by), dtype=bool)
        new[0] = True
        np.not_equal(by[1:], by[:-1], out=new[1:])
        group = np.maximum.accumulate(slots * new)
        rank[members] = group
        h *= 2


def common_prefixes(data: np.ndarray, order: np.ndarray, keys: np.ndarray | None = None) -> np.ndarray:
    """Kasai's common prefix of each suffix with the one before it in ``order``, in that order; 0 for the first."""
    n = len(data)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    keys = prefix_keys(data) if keys is None else keys
    keys = np.r_[keys, np.uint64(0)]
    phi = np.empty(n, dtype=np.int64)
    phi[order[0]], phi[order[1:]] = -1, order[:-1]
    i = np.arange(n)
    fresh = (i == 0) | (phi <= 0) | (data[i - 1] != data[np.maximum(phi, 1) - 1])
    at = np.flatnonzero(fresh & (phi >= 0))
    length = np.zeros(n, dtype=np.int64)
    going = at
    while len(going):
        a, b = np.minimum(going + length[going], n), np.minimum(phi[going] + length[going], n)
        going = going[(keys[a] == keys[b]) & (a < n) & (b < n)]
        length[going] += 7
    for _ in range(7):
        a, b = at + length[at], phi[at] + length[at]
        ok = (a < n) & (b < n)
        ok[ok] = data[a[ok]] == data[b[ok]]
        at = at[ok]
        length[at] += 1
    since = np.maximum.accumulate(np.where(fresh, i, 0))
    return (length[since] - (i - since))[order]


class Shard:
    """Windows of packed pieces, sorted; weights are the places of each piece."""

    def __init__(self, parts: list[bytes], weights: np.ndarray, width: int):
        self.width, self.data = width, np.frombuffer(b"".join(parts), dtype=np.uint8)
        self.sizes = np.array([len(p) for p in parts], dtype=np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.keys = prefix_keys(self.data)
        self.order = suffix_array(self.data)
        prefix = common_prefixes(self.data, self.order, self.keys)
        inside = np.arange(len(self.data)) - np.repeat(self.begin, self.sizes)
        self.valid = inside + width <= np.repeat(self.sizes, self.sizes)  # windows that end in their own piece
        self.group = np.cumsum(prefix < width) - 1
        weight = np.repeat(np.asarray(weights, dtype=np.float64), self.sizes) * self.valid
        self.members = np.bincount(self.group, weight[self.order], self.group[-1] + 1 if len(self.group) else 0)

    def repeated(self) -> np.ndarray:
        """Mask of the windows that start at two places or more."""
        out = np.zeros(len(self.data), dtype=bool)
        out[self.order] = self.members[self.group] > 1
        return out & self.valid

    def found_in(self, other: Shard) -> np.ndarray:
        """Mask of the windows that another shard holds too, by binary search in its suffix array."""
        mine = np.flatnonzero(self.valid)
        lo, hi = np.zeros(len(mine), dtype=np.int64), np.full(len(mine), len(other.order))
        same = np.zeros(len(mine), dtype=bool)
        while (lo < hi).any():
            open_ = np.flatnonzero(lo < hi)
            mid = (lo[open_] + hi[open_]) // 2
            sign = self._compare(mine[open_], other, other.order[mid])
            equal = sign == 0
            same[open_[equal]] = other.members[other.group[mid[equal]]] > 0
            lo[open_[equal]] = hi[open_[equal]]
            lo[open_[sign > 0]] = mid[sign > 0] + 1
            hi[open_[sign < 0]] = mid[sign < 0]
        out = np.zeros(len(self.data), dtype=bool)
        out[mine[same]] = True
        return out

    def _compare(self, mine: np.ndarray, other: Shard, theirs: np.ndarray) -> np.ndarray:
        """-1, 0, 1 by the first ``width`` bytes; a text that ends sorts first."""
        sign, going = np.zeros(len(mine), dtype=np.int8), np.arange(len(mine))
        for k in range(0, self.width, 7):
            k = min(k, self.width - 7) if self.width >= 7 else 0
            a, b = mine[going] + k, theirs[going] + k
            x = self.keys[np.minimum(a, len(self.keys) - 1)] * (a < len(self.keys))
            y = other.keys[np.minimum(b, len(other.keys) - 1)] * (b < len(other.keys))
            if self.width < 7:
                cut = np.uint64(257 ** (7 - self.width))
                x, y = x // cut, y // cut
            sign[going] = np.where(x < y, -1, np.where(x > y, 1, 0))
            going = going[x == y]
            if not len(going):
                break
        return sign


def _runs(mask: np.ndarray, shard: Shard, ids: pd.DataFrame) -> pd.DataFrame:
    """(cls, d1, d2, from, to): bytes of pieces covered by runs of marked windows."""
    on = np.flatnonzero(mask)
    piece = np.searchsorted(shard.begin, on, "right") - 1
    breaks = (on[1:] > on[:-1] + shard.width) | (piece[1:] != piece[:-1])
    first = np.flatnonzero(np.r_[len(on) > 0, breaks][: len(on)])
    last = np.r_[first[1:], len(on)][: len(first)] - 1
    who, at = piece[first], shard.begin[piece[first]]
    out = ids.iloc[who][["cls", "d1", "d2"]].reset_index(drop=True)
    return out.assign(**{"from": on[first] - at, "to": on[last] - at + shard.width})


RUN = "cls long, d1 long, d2 long, from long, to long"


def _sort_packed(parts: DataFrame, width: int, shard_bytes: int) -> DataFrame:
    """Whole classes, packed in shards, each in one suffix array."""

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def flush(frame: pd.DataFrame) -> pd.DataFrame:
            shard = Shard(list(frame["piece"]), frame["c"].to_numpy(), width)
            return _runs(shard.repeated(), shard, frame)

        for pdf in batches:
            held.append(pdf)
            size += int(pdf["piece"].str.len().sum())
            if size >= shard_bytes:
                whole = pd.concat(held, ignore_index=True)
                tail = whole["cls"] == whole["cls"].iat[-1]
                if not tail.all():
                    yield flush(whole[~tail].reset_index(drop=True))
                held = [whole[tail]]
                size = int(held[0]["piece"].str.len().sum())
        if held:
            yield flush(pd.concat(held, ignore_index=True))

    return parts.repartition("cls").sortWithinPartitions("cls").mapInPandas(packed, RUN)


def _merge_pairs(parts: DataFrame, width: int) -> DataFrame:
    """Classes of several shards: every shard by itself, and every two of one class merged."""

    def merge_pair(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [pdf[pdf["side"] == s].reset_index(drop=True) for s in (0, 1)]
        shards = [Shard(list(s["piece"]), s["c"].to_numpy(), width) for s in sides if len(s)]
        if key[1] == key[2]:
            return _runs(shards[0].repeated(), shards[0], sides[0])
        if len(shards) < 2:
            return pd.DataFrame(columns=["cls", "d1", "d2", "from", "to"])
        return pd.concat([_runs(shards[i].found_in(shards[1 - i]), shards[i], sides[i]) for i in (0, 1)])

    pairs = F.expr("transform(sequence(0L, shards - 1), x -> struct(least(x, i) AS a, greatest(x, i) AS b, int(x < i) AS side))")
    dealt = parts.withColumn("i", F.pmod("d1", "shards")).withColumn("_p", F.explode(pairs))
    return dealt.select("cls", "d1", "d2", "c", "piece", "_p.*").groupBy("cls", "a", "b").applyInPandas(merge_pair, RUN)


def _open_classes(known: DataFrame, size: Column, shard_bytes: int) -> DataFrame:
    """cls and its number of shards, of the classes that need a suffix array; known: distinct pieces with places c and multi."""
    kinds = known.groupBy("cls").agg(F.count("*").alias("p"), F.max("multi").alias("any"), F.sum(size).alias("bytes"))
    return kinds.filter("p > 1 OR any").select("cls", F.ceil(F.col("bytes") / shard_bytes).alias("shards"))


def _whole(known: DataFrame, size: Column) -> DataFrame:
    """Runs of the pieces that have several places: all of each."""
    return known.filter("c > 1").select("cls", "d1", "d2", F.lit(0).cast("long").alias("from"), size.cast("long").alias("to"))


def _cut_table(rows: list[tuple[np.ndarray, ...]], who: list[int], ids: pa.RecordBatch, more: dict[str, pa.Array] | None = None) -> pa.RecordBatch:
    """pieces() of several texts, with the columns ``ids`` of the row that each belongs to."""
    start, n, cls, d1, d2, multi = (np.concatenate(x) for x in zip(*rows, strict=True))
    at = pa.array(np.repeat(who, [len(r[0]) for r in rows]))
    named = {"start": start, "n": n, "cls": cls, "d1": d1, "d2": d2}
    cols = {k: ids.column(k).take(at) for k in ids.schema.names} | {k: pa.array(v.astype(np.int64)) for k, v in named.items()}
    return pa.RecordBatch.from_pydict(cols | {"multi": pa.array(multi)} | (more or {}))


def _recut(parts: DataFrame, width: int, shard_bytes: int, paired: int, level: int, levels: int) -> DataFrame:
    """Runs of large classes by classes of their pieces' windows under another hash."""

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.RecordBatch.from_pydict({"p0": batch.column("cls"), "p1": batch.column("d1"), "p2": batch.column("d2"), "c": batch.column("c")})
            for k, raw in enumerate(batch.column("piece").to_pylist()):
                cut = pieces(raw, width, level)
                parts_ = pa.array([raw[a : a + n + width - 1] for a, n in zip(cut[0].tolist(), cut[1].tolist(), strict=True)], pa.binary())
                yield _cut_table([cut], [k], ids, {"piece": parts_})

    schema = "p0 long, p1 long, p2 long, c long, start long, n long, cls long, d1 long, d2 long, multi boolean, piece binary"
    made = materialize(parts.select("cls", "d1", "d2", "c", "piece").mapInArrow(again, schema))
    known = materialize(made.groupBy("cls", "d1", "d2").agg(F.sum("c").alias("c"), F.max("multi").alias("multi"), F.first("piece").alias("piece")))
    kinds = materialize(_open_classes(known, F.length("piece"), shard_bytes))
    found = resolved(known.join(kinds, "cls").drop("multi"), kinds, width, shard_bytes, paired, level, levels)
    found = found.unionAll(_whole(known, F.length("piece")))
    here = made.select("p0", "p1", "p2", "start", "cls", "d1", "d2").join(materialize(found), ["cls", "d1", "d2"])
    return here.select(F.col("p0").alias("cls"), F.col("p1").alias("d1"), F.col("p2").alias("d2"), (F.col("start") + F.col("from")).alias("from"), (F.col("start") + F.col("to")).alias("to"))


def resolved(parts: DataFrame, kinds: DataFrame, width: int, shard_bytes: int, paired: int, level: int = 0, levels: int = 4) -> DataFrame:
    """Repeated runs of the pieces ``parts`` (cls, d1, d2, c, shards, piece) of the classes ``kinds`` (cls, shards)."""
    parts = materialize(parts)
    paired = paired if level < levels else 2**62
    runs = _sort_packed(parts.filter("shards <= 1").select("cls", "d1", "d2", "c", "piece"), width, shard_bytes)
    runs = runs.unionAll(_merge_pairs(parts.filter((F.col("shards") > 1) & (F.col("shards") <= paired)), width))
    if not kinds.filter(F.col("shards") > paired).isEmpty():
        runs = runs.unionAll(_recut(parts.filter(F.col("shards") > paired), width, shard_bytes, paired, level + 1, levels))
    return runs


def repeated_runs(texts: DataFrame, width: int = 400, shard_bytes: int = 1_400_000, paired: int = 4) -> DataFrame:
    """(rid, spans): the repeated bytes of each row, as pairs of first and past-the-last offset.

    ``texts`` holds rid (unique) and raw (``width`` bytes or more), and is read twice.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, who, n = [], [], 0
            for k, raw in enumerate(batch.column("raw")):
                rows.append(pieces(raw.as_buffer(), width))
                who.append(k)
                n += len(rows[-1][0])
                if n > 100_000 or k == batch.num_rows - 1:
                    yield _cut_table(rows, who, batch.select(["rid"]))
                    rows, who, n = [], [], 0

    made = materialize(texts.select("rid", "raw").mapInArrow(cut, "rid long, start long, n long, cls long, d1 long, d2 long, multi boolean"))
    place = [F.first(x).alias(x) for x in ("rid", "start", "n")]  # of one and the same row
    known = materialize(made.groupBy("cls", "d1", "d2").agg(F.count("*").alias("c"), F.max("multi").alias("multi"), *place))
    kinds = materialize(_open_classes(known, F.col("n") + (width - 1), shard_bytes))
    fetch = known.join(kinds, "cls")
    refs = fetch.groupBy("rid").agg(F.collect_list(F.struct("cls", "d1", "d2", "c", "shards", "start", "n")).alias("refs"))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [f.name for f in batch.column("refs").type.value_type]
            for raw, mine in zip(batch.column("raw"), batch.column("refs"), strict=True):
                raw, own = raw.as_py(), mine.values
                field = {k: own.field(i) for i, k in enumerate(names)}
                at, n = field["start"].to_numpy().tolist(), field["n"].to_numpy().tolist()
                for lo in range(0, len(at), 10_000):
                    hi = min(lo + 10_000, len(at))
                    parts = pa.array([raw[a : a + k + width - 1] for a, k in zip(at[lo:hi], n[lo:hi], strict=True)], pa.binary())
                    yield pa.RecordBatch.from_pydict({k: field[k].slice(lo, hi - lo) for k in ("cls", "d1", "d2", "c", "shards")} | {"piece": parts})

    parts = texts.select("rid", "raw").join(refs, "rid").select("raw", "refs").mapInArrow(slices, "cls long, d1 long, d2 long, c long, shards long, piece binary")
    runs = resolved(parts, kinds, width, shard_bytes, paired).unionAll(_whole(known, F.col("n") + (width - 1)))
    runs = materialize(runs.groupBy("cls", "d1", "d2").agg(F.collect_set(F.struct("from", "to")).alias("runs")))
    moved = F.transform("runs", lambda r: F.struct((F.col("start") + r["from"]).alias("a"), (F.col("start") + r["to"]).alias("b")))
    return made.select("rid", "start", "cls", "d1", "d2").join(runs, ["cls", "d1", "d2"]).groupBy("rid").agg(F.flatten(F.collect_list(moved)).alias("spans"))


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, width: int = 400, shard_bytes: int = 1_400_000, paired: int = 4) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes) and text of every row.

    ``text`` is ``kept`` as a string; a character cut in two by a removal is U+FFFD in it.
    """
    small_batches(docs.sparkSession)
    raw = F.coalesce("text", F.lit("")).cast("binary")
    keyed = docs.select("doc_id", raw.alias("raw"))
    numbered = keyed.filter(F.length("raw") >= width).withColumn("rid", F.monotonically_increasing_id())
    texts = bucketed(numbered, "rid")
    found = texts.join(repeated_runs(texts, width, shard_bytes, paired), "rid", "left")

    @F.pandas_udf("n_removed long, n_spans long, kept_sha256 string, kept binary, text string")
    def drop(raws: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for raw, own in zip(raws, spans, strict=True):
            cuts = merged_spans([(s["a"], s["b"]) for s in own]) if own is not None else []
            edges = [0, *(x for cut in cuts for x in cut), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if cuts else raw
            rows.append((len(raw) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), kept, kept.decode("utf-8", "replace")))
        return pd.DataFrame(rows, columns=["n_removed", "n_spans", "kept_sha256", "kept", "text"])

    cut = found.withColumn("_r", drop("raw", "spans")).select("doc_id", F.length("raw").cast("long").alias("n_bytes"), "_r.*")
    none = F.lit(0).cast("long")
    short = keyed.filter(F.length("raw") < width).select(
        "doc_id", F.length("raw").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"),
        F.sha2("raw", 256).alias("kept_sha256"), F.col("raw").alias("kept"), F.col("raw").cast("string").alias("text"),
    )
    return short.unionByName(cut)
