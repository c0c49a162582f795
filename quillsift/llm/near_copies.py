"""Near copies: SimHash tries first, then whatever their error budget can't reach.

Documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more
are linked, and chains of links are groups. The tries' walk over SimHash
fingerprints finds pairs within a few bits, which is most copies with a small
edit; pairs at 0.8 differ in some ten of 64 bits, and a walk within so many bits
meets nearly all pairs. So the operator works in two steps, and every link is
verified by the exact similarity of the whole sets:

1. Pairs found by the tries' walk, and pairs of each set with that set, of those that
   have one of its eight min-hashes, which has the fewest rare shingles, join nearly
   all of a group of any size at a linear cost.
2. Sets of different groups are compared wherever they can be at the threshold. All
   shingles stand in one order, those that are frequent in a sample last. Two sets at
   or above the threshold share many of the first of each (its prefix: a fifth of the
   set and ``shared_least`` more, of which they share so many), whatever the order, so
   that the sample bears on the cost alone and never on the result. A set with fewer
   prefix shingles in common with sets of other groups than that is left out, twice,
   as fewer are in common then. This takes no pairs, and long texts that share a
   phrase by chance go with it. What a set has in common is then put in the order of
   its exact count, and the last of it, all but one of what a pair must share, is left
   out too. At each shingle all sets are first compared with one, of whose prefix
   least stands alone: this joins most groups, at a linear cost. Sets that still share
   a shingle with another group are compared, if as many follow as the threshold
   needs, and if the parities of their shingles' hashes in 512 cells differ no more
   than the sets may. A pair is taken once.

Defined results: rows without a word form one group; a text of fewer words than
a shingle is one shingle; rows that repeat a doc_id share its group; an empty table
has no rows. Columns beyond doc_id and text are not looked at. Whole texts are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsift.llm.common import discard, materialize, small_batches
from quillsift.llm.components import components
from quillsift.llm.simhash import SEED, least_rows, links, shingle_hashes, simhash

WIDTH = 5
#: The threshold is 4 / 5, in integers so that it is exact.
NUM, DEN = 4, 5
#: Documents (a 32nd of all, if more) whose shingles are counted for the order, the count that makes one frequent, and how many may be.
SAMPLE, FREQUENT, MOST = 8_000, 4, 500_000


#: A pair shares one shingle in so many of the set, at least, within the prefixes.
PART = 40

#: Bits in which fingerprints of the tries' walk may differ.
BUDGET = 2
#: Bits of the map of texts that are looked for.
BITS = 1 << 24
#: Cells of the parities, of those that candidates are tried by once more, and odd factors of the min-hashes, fixed values.
CELLS, WIDE = 512, 8192
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD)


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes(text, WIDTH))


def shared_least(n: int) -> int:
    """How many of its prefix's shingles a set of n shares at the threshold, if its prefix ends first in the order."""
    return 1 + n // PART


def prefix(own: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """The shingles of which a set at the threshold must share some, and how many of all aren't frequent; ``own`` and ``frequent`` ascend."""
    size = len(own) - -(-NUM * len(own) // DEN) + shared_least(len(own))
    if not len(frequent):
        return own[:size], len(own)
    at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
    weight = np.where(frequent[at] == own, counts[at], 0)
    return own[np.lexsort((own, weight))][:size], int((weight == 0).sum())


def parities(own: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """Whether an odd number of shingles falls in each cell, as longs: sets differ in as many shingles as cells, or more."""
    odd = np.bincount((own >> np.uint64(40)).astype(np.int64) % cells, minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def min_hashes(own: np.ndarray) -> np.ndarray:
    """The least and the greatest hash, and the least under each of some other orders."""
    if not len(own):
        return own.view(np.int64)
    return np.array([own[0], own[-1], *((own * np.uint64(f)).min() for f in FACTORS)], dtype=np.uint64).view(np.int64)


def _frequent(docs: DataFrame, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles of a sample of the documents, ascending, with their counts."""
    share = min(1.0, max(sample / max(1, docs.count()), 1 / 32))
    some = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30))).select("text")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 100):
                sets = [shingle_set(t) for t in pdf["text"].iloc[lo : lo + 100]]
                s, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pd.DataFrame({"s": s.view(np.int64), "n": n.astype(np.int64)})

    total = some.mapInPandas(counted, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
    found = total.orderBy(F.desc("n"), "s").limit(MOST).toPandas()
    s = found["s"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(s)
    return s[order], found["n"].to_numpy(dtype=np.int64)[order]


def _prints(docs: DataFrame, sample: int) -> DataFrame:
    """doc_id, h (hash of the text), fp, g (hash of the set of shingles), n (its size), how many are rare, its min-hashes, prefix and parities."""
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, sample))

    @F.pandas_udf("fp long, g long, n long, rare long, lows array<long>, prefix array<long>, odd array<long>")
    def printed(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            every = shingle_hashes(t, WIDTH)
            own = np.unique(every)
            fp, g = (np.uint64(x).view(np.int64) for x in (simhash(every), xxhash.xxh64_intdigest(own.tobytes(), SEED)))
            first, rare = prefix(own, *frequent.value)
            rows.append((fp, g, len(own), rare, min_hashes(own), first.view(np.int64), parities(own)))
        return pd.DataFrame(rows, columns=["fp", "g", "n", "rare", "lows", "prefix", "odd"])

    return materialize(docs.select("doc_id", F.xxhash64("text").alias("h"), printed("text").alias("p")).select("doc_id", "h", "p.*"))


def _possible(x: str, y: str, odd: Callable[[str, int], Column] = lambda x, i: F.col(f"{x}.odd")[i]) -> Column:
    """Whether sets x and y (structs of g, n and odd) can be at the threshold, by their sizes and parities."""
    n = F.col(f"{x}.n") + F.col(f"{y}.n")
    apart = sum(F.bit_count(odd(x, i).bitwiseXOR(odd(y, i))) for i in range(CELLS // 64))
    return ((NUM + DEN) * F.least(f"{x}.n", f"{y}.n") >= NUM * n) & ((NUM + DEN) * apart <= (DEN - NUM) * n)


def _enough_from(x: str, y: str) -> Column:
    """Whether the sets can share enough, if ``left`` of the shingles they may share stand from here on.

    Of what two sets share, all but those behind the prefix that ends first is in both prefixes.
    """
    n, most = F.col(f"{x}.n") + F.col(f"{y}.n"), F.least(f"{x}.left", f"{y}.left") + F.greatest(f"{x}.behind", f"{y}.behind")
    return ((NUM + DEN) * F.least(f"{x}.n", f"{y}.n") >= NUM * n) & ((NUM + DEN) * most >= NUM * n)


#: In SQL: four fifths of a set of n, rounded up (what it may be linked with has so many or more), how many stand behind its prefix, and how many a pair shares at least.
_MOST = f"(({NUM} * n + {DEN - 1}) div {DEN})"
_BEHIND, _NEED = f"{_MOST} - 1 - n div {PART}", f"1 + {_MOST} div {PART}"


def _in_common(places: DataFrame, rounds: int) -> DataFrame:
    """The places (g, c, n, s) that sets of different groups c have in common, with the count k of the shingle and m of the set.

    Sets with fewer than they need are left out, and what is in common is counted again; no pairs are made.
    """
    for _ in range(rounds):
        mixed = places.groupBy("s").agg(F.count("*").alias("k"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi")
        common = materialize(places.select("g", "c", "n", "s").join(materialize(mixed.select("s", "k")), "s"))
        enough = common.groupBy("g", "n").agg(F.count("*").alias("m")).filter(f"m >= {_NEED}")
        places = materialize(common.join(materialize(enough.select("g", "m")), "g"))
        discard(common)
    return places


def _leading(common: DataFrame) -> DataFrame:
    """g, c, n, s, left, behind, alone and before: the places at which sets must meet, in the order of their counts.

    ``left``: how many of the set's places stand from s on, s included. ``behind``: how
    many of the set stand behind its prefix; ``alone``: how many of the prefix no
    other group has; ``before``: the places just before s. Sets that share one of those have met there.
    """
    order = Window.partitionBy("g").orderBy("k", "s")
    before = F.array_compact(F.array(*(F.lag("s", i).over(order) for i in (1, 2, 3))))
    found = common.withColumns({"left": F.col("m") - F.row_number().over(order) + 1, "behind": F.expr(_BEHIND), "alone": F.expr(f"n - ({_BEHIND}) - m"), "before": before})
    return found.filter(f"left >= {_NEED}").drop("k", "m")


def _hub_pairs(leading: DataFrame) -> DataFrame:
    """Pairs (u, v) of g: each set with that one at each of its places of whose prefix least stands alone, which others are edited copies of."""
    own = F.struct("alone", "g", "n", "left", "behind", "c")
    hubs = materialize(leading.groupBy("s").agg(F.min(own).alias("y")))
    met = leading.select("s", own.alias("x")).join(hubs, "s").filter("x.c <> y.c").filter(_enough_from("x", "y"))
    return met.select(F.least("x.g", "y.g").alias("u"), F.greatest("x.g", "y.g").alias("v")).distinct()


def _among(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose h isn't one of ``wanted``: by a bitmap of fixed size, so that few texts are shuffled in vain."""
    bit = F.col("h").bitwiseAND(BITS - 1)
    words = wanted.groupBy(F.shiftright(bit, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 AS int))")).alias("b")).toPandas()
    made = np.zeros(BITS // 64, dtype=np.int64)
    made[words["w"].to_numpy(dtype=np.int64)] = words["b"].to_numpy(dtype=np.int64)
    held = rows.sparkSession.sparkContext.broadcast(made)

    @F.pandas_udf("boolean")
    def marked(h: pd.Series) -> pd.Series:
        at = h.to_numpy(dtype=np.int64) & (BITS - 1)
        return pd.Series((held.value[at >> 6] >> (at & 63)) & 1 == 1)

    return rows.filter(marked("h"))


def _similar(docs: DataFrame, alike: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (u, v) of g at the threshold or above, by their whole sets, made of the texts again."""
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("g")).distinct().join(alike.select("g", "h"), "g")
    wanted = materialize(wanted)
    texts = _among(docs.select(F.xxhash64("text").alias("h"), "text"), wanted).join(wanted, "h").groupBy("h", "g").agg(F.first("text").alias("text"))

    @F.pandas_udf("own array<long>, wide binary")
    def own(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t) for t in texts]
        return pd.DataFrame({"own": [x.view(np.int64) for x in sets], "wide": [parities(x, WIDE).tobytes() for x in sets]})

    @F.pandas_udf("boolean")
    def within(a: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=bool)
        x, y = (np.frombuffer(b"".join(c), dtype="<u8").reshape(-1, WIDE // 64) for c in (a, b))
        apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
        return pd.Series((NUM + DEN) * apart <= (DEN - NUM) * n.to_numpy())

    sets = materialize(texts.select("g", own("text").alias("x")).select("g", F.size("x.own").alias("n"), "x.own", "x.wide"))
    to = lambda k, *cols: sets.select(F.col("g").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in cols))
    near = pairs.join(to("u", "n", "wide"), "u").join(to("v", "n", "wide"), "v")
    near = materialize(near.filter(within("wide_u", "wide_v", F.col("n_u") + F.col("n_v"))).select("u", "v"))
    both = F.size("own_u") + F.size("own_v")
    shared = F.size(F.array_intersect("own_u", "own_v"))
    found = materialize(near.join(to("u", "own"), "u").join(to("v", "own"), "v").filter((NUM + DEN) * shared >= NUM * both).select("u", "v"))
    discard(sets)
    return found


def _first_pairs(alike: DataFrame, budget: int) -> DataFrame:
    """Pairs (u, v) of g: by the tries' walk over fingerprints, and with the set of fewest rare shingles of each min-hash.

    That set is the one that the others of a group are edited copies of, if it is there.
    """
    member = F.struct("rare", "g", "n", "odd")
    named = materialize(alike.groupBy("fp").agg(F.min("g").alias("g")))
    near = links(named.select("fp"), budget)
    to = lambda k: named.select(F.col("fp").alias(k), F.col("g").alias(f"g_{k}"))
    walked = near.join(to("u"), "u").join(to("v"), "v").select(F.col("g_u").alias("a"), F.col("g_v").alias("b"))
    same = alike.select("fp", "g").join(named.withColumnRenamed("g", "b"), "fp").select(F.col("g").alias("a"), "b")
    rows = alike.select(member.alias("x"), F.posexplode("lows").alias("i", "low"))
    least = rows.groupBy("i", "low").agg(F.count("*").alias("c"), F.min("x").alias("y")).filter("c > 1")
    met = rows.join(materialize(least.select("i", "low", "y")), ["i", "low"]).filter("x.g <> y.g").filter(_possible("x", "y"))
    pairs = walked.unionAll(same).filter("a <> b").unionAll(met.select(F.col("x.g").alias("a"), F.col("y.g").alias("b")))
    return materialize(pairs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())


def near_copies(docs: DataFrame, sample: int = SAMPLE, budget: int = BUDGET) -> DataFrame:
    """doc_id, h (hash of the text) and root (names the group) of every row of ``docs`` (doc_id, text)."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    made = _prints(docs, sample)
    kept = [F.first(c).alias(c) for c in ("n", "rare", "fp", "lows", "prefix", "odd")]
    alike = materialize(made.groupBy("g").agg(F.min("h").alias("h"), *kept).withColumn("n", F.col("n").cast("int")))
    prints = materialize(made.select("doc_id", "h", "g"))
    discard(made)
    first = _first_pairs(alike, budget)
    found = _similar(docs, alike, first)
    named = lambda links: alike.join(roots := components(links), alike["g"] == roots["u"], "left").select(*alike.columns, F.coalesce("v", "g").alias("c"))
    common = _in_common(named(found).select("g", "c", "n", F.explode("prefix").alias("s")), 2)
    # sets are linked with one of each of their places first, which takes no pairs among the others and joins most groups
    hubs = materialize(_hub_pairs(materialize(_leading(common))).join(first, ["u", "v"], "left_anti"))
    found = materialize(found.unionAll(_similar(docs, alike, hubs)))
    now = materialize(named(found).select("g", "c", *(F.col("odd")[i].alias(f"o{i}") for i in range(CELLS // 64))))
    rest = materialize(_leading(_in_common(common.drop("c").join(now.select("g", "c"), "g"), 1)))
    discard(common)
    # all else of a set is joined to its places alone, by narrow rows
    apart = materialize(rest.drop("c", "alone").join(now, "g"))
    discard(rest)
    near = (F.col("x.s") == F.col("y.s")) & (F.col("x.g") < F.col("y.g")) & (F.col("x.c") != F.col("y.c"))
    near = near & _enough_from("x", "y") & ~F.arrays_overlap("x.before", "y.before") & _possible("x", "y", lambda x, i: F.col(f"{x}.o{i}"))
    # a pair that shares several may meet at some of them; what holds at a later one holds at the first
    met = materialize(apart.alias("x").join(apart.alias("y"), near).select(F.col("x.g").alias("u"), F.col("y.g").alias("v")).distinct())
    discard(apart)
    pairs = materialize(met.join(first.unionAll(hubs), ["u", "v"], "left_anti"))
    more = _similar(docs, alike, pairs)
    roots = components(found.unionAll(more))
    return prints.join(roots, prints["g"] == roots["u"], "left").select("doc_id", "h", F.coalesce("v", "g").alias("root"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies: the one with the least id."""
    return least_rows(docs, near_copies(docs))
