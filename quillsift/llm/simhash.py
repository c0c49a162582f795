"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints hang in a binary trie by their bits. Two nodes of one depth are
walked together: the walk goes on to the pairs of their children, adds up the
bits in which the two paths differ, and is cut off as soon as these exceed the
budget. What reaches the leaves is exactly the pairs within the budget.

To deal the walk out over a cluster, each fingerprint hangs in ``budget + 1``
tries, whose bits are rotated so that another block of bits comes first in each.
Two fingerprints within the budget agree on one whole block at least, so in that
trie their walk starts at one node below the block with no error spent. The
subtrees below the blocks are walked apart from one another; a pair of nodes
with more than ``leaf_rows`` fingerprints is dealt out further, as the pairs of
its descendants four levels down.

Copies share a fingerprint and count once in the tries. A walk returns only a
spanning star of each component it finds, never all pairs of a group.

Defined results: a null or empty text, or one of white space only, has
fingerprint zero and is linked like any other; a text of fewer words than a
shingle is one shingle. Rows that repeat a doc_id are kept and share its
component. A row without an id gets the least id of its component, null if it
has none. The columns fingerprint and component_id replace any so named; others are
not looked at. An empty table has an empty result. Whole texts are read, whatever
their length.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm.common import materialize, small_batches
from quillsift.llm.components import components

SEED = 42
LOW_BITS = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | None, width: int = 3) -> np.ndarray:
    """XXH64 of every run of ``width`` words, lower-cased in A-Z only, joined by one space."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # splits at the ASCII white space alone
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        hashes = [digest(b" ".join(words), SEED)] if words else []
    else:
        hashes = [digest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(width)), strict=False)]
    return np.array(hashes, dtype=np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """64 bits, each 1 if set in over half the hashes."""
    n = len(hashes)
    if not n:
        return 0
    starts = np.arange(0, n, 255)  # as many as one byte can count
    result = 0
    for bit in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & LOW_BITS, starts)
        counts = sums.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for byte in np.flatnonzero(2 * counts > n):
            result |= 1 << (8 * int(byte) + bit)
    return result


def with_fingerprint(docs: DataFrame, width: int = 3) -> DataFrame:
    """Add the 64-bit fingerprint of the whole text as a long named fp."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def fingerprints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(shingle_hashes(t, width)) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.withColumn("fp", fingerprints("text"))


def walk(fps: np.ndarray, starts: Iterable[tuple[int, int, int, int, int, int]], budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions within the budget, in portions.

    ``fps``: unsigned 64-bit numbers, ascending within every node. ``starts``:
    (lo1, hi1, lo2, hi2, depth, differing bits so far) of pairs of nodes, whose
    members are runs of positions that agree on the first ``depth`` bits; a node
    paired with itself stands for the pairs inside it.
    """
    begin = np.array(list(starts), dtype=np.int64).reshape(-1, 6)
    stack = [(int(d), begin[begin[:, 4] == d][:, [0, 1, 2, 3, 5]]) for d in np.unique(begin[:, 4])]
    ones: dict[int, np.ndarray] = {}
    while stack:
        depth, pairs = stack.pop()
        own = pairs[:, 0] == pairs[:, 2]
        small = (pairs[:, 1] - pairs[:, 0] == 1) & (pairs[:, 3] - pairs[:, 2] == 1)
        ready = pairs[small & ~own]
        if len(ready):  # paths without branches are compared at once
            near = np.bitwise_count(fps[ready[:, 0]] ^ fps[ready[:, 2]]) <= budget + (ready[:, 4] * 0)
            shared = ready[near]
            yield shared[:, 0], shared[:, 2]
        pairs, own = pairs[~small], own[~small]
        if not len(pairs) or depth == 64:
            continue
        if len(pairs) > 500_000:
            half = len(pairs) // 2
            stack += [(depth, pairs[:half]), (depth, pairs[half:])]
            continue
        if depth not in ones:
            ones[depth] = np.concatenate([[0], np.cumsum((fps >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)])
        c, (lo1, hi1, lo2, hi2, diff) = ones[depth], pairs.T
        mid1, mid2 = hi1 - (c[hi1] - c[lo1]), hi2 - (c[hi2] - c[lo2])
        children = [(lo1, mid1, lo2, mid2, diff), (mid1, hi1, mid2, hi2, diff), (lo1, mid1, mid2, hi2, diff + 1)]
        made = [np.stack(x, axis=1) for x in children]
        made.append(np.stack((mid1, hi1, lo2, mid2, diff + 1), axis=1)[~own])
        below = np.concatenate(made)
        below = below[(below[:, 0] < below[:, 1]) & (below[:, 2] < below[:, 3]) & (below[:, 4] <= budget)]
        stack.append((depth + 1, below))


def least_labels(n: int, edges: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least position that each of n positions is linked to."""
    label = np.arange(n)
    for u, v in edges:
        while len(u):
            lu, lv = label[u], label[v]
            apart = lu != lv
            if not apart.any():
                break
            u, v, lu, lv = u[apart], v[apart], lu[apart], lv[apart]
            np.minimum.at(label, np.maximum(lu, lv), np.minimum(lu, lv))
            while (label != label[label]).any():
                label = label[label]
    return label


def _stars(frame: pd.DataFrame, budget: int, blocks: list[tuple[int, int]]) -> pd.DataFrame:
    """Links (u, v) from whole groups (rot, depth, a, b), sorted by these, side and rotated fingerprint."""
    fps = frame["rfp"].to_numpy().view(np.uint64)
    keys = frame[["rot", "depth", "a", "b"]].to_numpy()
    new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(frame) else np.array([], dtype=int)
    ends = np.r_[new[1:], len(frame)]
    sides = np.r_[0, np.cumsum(frame["side"].to_numpy())]
    starts = []
    for lo, hi in zip(new, ends, strict=True):
        mid = hi - (sides[hi] - sides[lo])
        d, diff = frame["depth"].iat[lo], frame["diff"].iat[lo]
        if keys[lo, 2] == keys[lo, 3]:
            starts.append((lo, hi, lo, hi, d, diff))
        elif lo < mid < hi:
            starts.append((lo, mid, mid, hi, d, diff))
    label = least_labels(len(frame), walk(fps, starts, budget))
    at = np.flatnonzero(label != np.arange(len(frame)))
    shift = np.array([s for s, _ in blocks], dtype=np.uint64)[frame["rot"].to_numpy()]
    plain = (fps >> shift) | np.where(shift > 0, fps << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    return pd.DataFrame({"u": plain[at].view(np.int64), "v": plain[label[at]].view(np.int64)})


def links(fps: DataFrame, budget: int = 2, leaf_rows: int = 8192) -> DataFrame:
    """Links (u, v) that connect just what chains of pairs within ``budget`` bits connect; fps: distinct longs fp."""
    spark = fps.sparkSession
    width, over = divmod(64, budget + 1)
    sizes = [width + (i < over) for i in range(budget + 1)]
    blocks = [(sum(sizes[:i]), sizes[i]) for i in range(budget + 1)]
    turned = [
        F.struct(
            F.lit(i).alias("rot"), F.lit(n).alias("depth"),
            (F.shiftleft("fp", s).bitwiseOR(F.shiftrightunsigned("fp", 64 - s)) if s else F.col("fp")).alias("rfp"),
        )
        for i, (s, n) in enumerate(blocks)
    ]
    hung = fps.select(F.inline(F.array(*turned))).withColumn("a", F.expr("shiftrightunsigned(rfp, 64 - depth)"))
    node, cols = ["rot", "depth", "a", "b"], ["rot", "depth", "a", "b", "side", "diff", "rfp", "n"]

    def counted(rows: DataFrame) -> DataFrame:
        """Rows of nodes with two or more, with their number: pre-aggregated, and joined so that a large node can be split."""
        held = materialize(rows.groupBy(*node).agg(F.count("*").alias("n")).filter("n > 1"))
        return materialize(rows.join(held, node).select(cols))

    met = hung.withColumns({"b": F.col("a"), "side": F.lit(0), "diff": F.lit(0)})
    now = counted(met)
    light = [now.filter(F.col("n") <= leaf_rows)]
    heavy = now.filter(F.col("n") > leaf_rows)
    while not heavy.isEmpty():
        step = F.least(F.lit(4), F.lit(64) - F.col("depth"))
        bits = F.expr("shiftrightunsigned(rfp, 64 - depth - step) & (shiftleft(1L, step) - 1)")
        down = heavy.withColumn("step", step).withColumn("x", bits).withColumn("y", F.explode(F.expr("sequence(0L, shiftleft(1L, step) - 1)")))
        down = down.withColumn("diff", (F.col("diff") + F.expr("bit_count(x ^ y)")).cast("int")).filter(F.col("diff") <= budget)
        first = F.when(F.col("a") == F.col("b"), F.least("x", "y")).when(F.col("side") == 0, F.col("x")).otherwise(F.col("y"))
        second = F.when(F.col("a") == F.col("b"), F.greatest("x", "y")).when(F.col("side") == 0, F.col("y")).otherwise(F.col("x"))
        side = F.when(F.col("a") == F.col("b"), (F.col("x") > F.col("y")).cast("int")).otherwise(F.col("side"))
        down = down.select(
            "rot", (F.col("depth") + F.col("step")).alias("depth"), F.expr("shiftleft(a, step)").bitwiseOR(first).alias("a"),
            F.expr("shiftleft(b, step)").bitwiseOR(second).alias("b"), side.alias("side"), "diff", "rfp",
        )
        down = counted(down)
        light.append(down.filter(F.col("n") <= leaf_rows))
        heavy = down.filter(F.col("n") > leaf_rows)
    leaves = light[0]
    for more in light[1:]:
        leaves = leaves.unionAll(more)
    order = ["rot", "depth", "a", "b", "side", "rfp"]
    leaves = leaves.repartition("rot", "depth", "a", "b").sortWithinPartitions(*order)

    def joined(batches):
        held, rows = [], 0
        for pdf in batches:
            held.append(pdf)
            rows += len(pdf)
            if rows < 4 * leaf_rows:
                continue
            whole = pd.concat(held, ignore_index=True)
            last = whole[["rot", "depth", "a", "b"]].iloc[-1]
            tail = int((whole[["rot", "depth", "a", "b"]] == last).all(axis=1).sum())  # a group may go on in the next batch
            if tail < rows:
                yield _stars(whole.iloc[: rows - tail], budget, blocks)
            held, rows = [whole.iloc[rows - tail :]], tail
        if rows:
            yield _stars(pd.concat(held, ignore_index=True), budget, blocks)

    small_batches(spark)
    return leaves.drop("n").mapInPandas(joined, "u long, v long")


def classes(prints: DataFrame, budget: int = 2, leaf_rows: int = 8192) -> DataFrame:
    """(fp, root, component_id) for the distinct fingerprints of ``prints`` (doc_id, fp); root names the component."""
    groups = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = components(links(groups.select("fp"), budget, leaf_rows))
    member = groups.join(roots.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("v", "fp"))
    least = member.groupBy("root").agg(F.min("rep").alias("component_id"))
    return member.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, budget: int = 2, width: int = 3, leaf_rows: int = 8192) -> DataFrame:
    """doc_id, h (hash of the text), fp, root and component_id of every row of ``docs`` (doc_id, text)."""
    named = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    prints = materialize(with_fingerprint(named, width).drop("text"))
    return prints.join(classes(prints, budget, leaf_rows), "fp").select("doc_id", "h", "fp", "root", "component_id")


def deduplicate(docs: DataFrame, budget: int = 2, width: int = 3) -> DataFrame:
    """One row of each component: the one with the least id (of repeated ids, with the least hash of its text)."""
    return least_rows(docs, near_duplicates(docs, budget, width))


def least_rows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Of ``docs``, the row with the least id of each root in ``found`` (root, doc_id, h)."""
    rows = found.groupBy("root", "doc_id", "h").agg(F.count("*").alias("copies"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "copies")).alias("best")
    keep = materialize(rows.groupBy("root").agg(best).select(F.col("best.doc_id").alias("_d"), F.col("best.h").alias("_h"), F.col("best.copies").alias("_c")))
    mine = docs.withColumn("_t", F.xxhash64("text"))
    chosen = lambda k: mine.join(k, mine["doc_id"].eqNullSafe(k["_d"]) & (mine["_t"] == k["_h"]), "left_semi")
    single = chosen(keep.filter("_c = 1")).select(docs.columns)
    again = keep.filter("_c > 1")  # rows that repeat both id and text
    if again.isEmpty():
        return single
    # rows alike in both are merged before the shuffle, however many they are
    one = chosen(again).groupBy("doc_id", "_t").agg(F.min(F.struct(*docs.columns)).alias("_row"))
    return single.unionAll(one.select("_row.*"))


def hex_print(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
