"""Mixing sources to target weights by entropy balancing.

The rates at which documents are taken minimise their entropy distance from 1,
under one token constraint a source and the bounds 0 and ``most`` on every rate.
The convex dual has one multiplier a source, and the optimal rates are
exponential tilts of the sizes::

    rate = most * t / (most - 1 + t),   t = exp(multiplier * size / mean size of the source)

The multipliers are found by distributed Newton steps, guarded by bisection: each
step is one pre-aggregated sum over a histogram of sizes, in exact decimals, so
that reruns agree to the last digit whatever the order of tasks.

Rates are rounded into whole copies by systematic rounding along the sizes: the
copies taken up to any size differ from the sum of the rates by less than one,
so a source's words miss its target by less than its longest document. Documents
of one size are ranked by a hash of their id inside salted cells, so that many
equal documents are dealt over many tasks. A few rounds then add or drop one copy a
source, of the size nearest what its target still lacks.

Tables of a row a source are held by the driver if there are few sources, and
written otherwise; what is computed is the same.

Defined results: documents without words are never taken; a source without
words, or an empty table, takes nothing. The null source is one source, after
all others. Rows that repeat an id are separate documents, told apart by their
texts if ``docs`` has them. Texts of any length are counted whole. Columns named
like the results are replaced. Multipliers that don't settle are an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillsift.llm.common import WORD, materialize

#: Documents of a cell of equal size and source that are ranked together, about.
CELL_ROWS = 50_000


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


#: Rows of a table that the driver may hold.
FEW = 10_000


def _kept(df: DataFrame) -> DataFrame:
    """``df`` computed once: held by the driver if it has few rows, written else."""
    rows = df.limit(FEW + 1).toArrow()
    return df.sparkSession.createDataFrame(rows, df.schema) if rows.num_rows <= FEW else materialize(df)


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, source_size, target of sources (source, source_size).

    Weights repeat in the order of the sources' code points. Filling stops each
    target at ``most`` times the source's size; with a common level L, a target
    is the lesser of L * weight and that bound, so sources fill up in the order
    of bound over weight, and L follows from running sums.
    """
    ordered = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sources.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1)).cast("double"))
    everything = Window.partitionBy()
    filling = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), "source")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    onward = filling.rowsBetween(0, Window.unboundedFollowing)
    levels = (
        ranked.withColumn("_cap", (F.col("source_size") * most).cast("double"))
        .withColumn("_all", F.sum("source_size").over(everything).cast("double"))
        .withColumn("_level", (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(onward))
    )
    # the first source, in the order of filling, that its level doesn't fill fixes the level of all after it
    open_level = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), "_level"))).over(everything)["_level"]
    return levels.select("source", "source_size", F.least(F.coalesce(open_level, F.col("_level")) * F.col("_w"), "_cap").alias("target"))


def _rate(size: Column, lam: Column, mean: Column, most: int) -> Column:
    """The bounded tilt; the exponent is kept where exp neither overflows nor vanishes."""
    t = F.exp(F.least(F.greatest(lam * size / mean, F.lit(-60.0)), F.lit(60.0)))
    return F.when(F.col("_full"), F.lit(float(most))).otherwise(most * t / (most - 1 + t))


def multipliers(cells: DataFrame, goals: DataFrame, most: int = 3, rounds: int = 100, close: float = 1e-7) -> DataFrame:
    """goals with the multiplier lam of each source and _full where the target is the bound itself."""
    state = goals.withColumns({
        "_full": F.col("target") >= most * F.col("source_size"), "mean": F.greatest(F.col("source_size") / F.greatest("n_docs", F.lit(1)), F.lit(1e-9)),
        "lam": F.lit(0.0), "lo": F.lit(-1e6), "hi": F.lit(1e6), "off": F.col("target").cast("double"),
    })
    state = _kept(state)
    for _ in range(rounds):
        at = cells.join(state, F.expr("source <=> key"))
        rate = _rate(F.col("size"), F.col("lam"), F.col("mean"), most)
        words = (F.col("n") * F.col("size")).cast("double")
        slope = rate * (most - rate) / most * F.col("size") / F.col("mean")
        exact = lambda c: F.sum(F.round(c, 6).cast("decimal(38,6)"))
        sums = at.groupBy("key").agg(exact(words * rate).alias("got"), exact(words * slope).alias("slope"))
        got, by = F.col("got").cast("double"), F.col("slope").cast("double")
        lo, hi = F.when(got < F.col("target"), F.col("lam")).otherwise(F.col("lo")), F.when(got > F.col("target"), F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") + (F.col("target") - got) / F.greatest(by, F.lit(1e-9))
        middle = F.when(lo <= -1e6, F.least(2 * hi, F.lit(-1.0))).when(hi >= 1e6, F.greatest(2 * lo, F.lit(1.0))).otherwise((lo + hi) / 2)
        bold = F.abs(newton - F.col("lam")) <= F.greatest(F.lit(2.0), F.abs(F.col("lam")))
        moved = F.when((newton > lo) & (newton < hi) & bold, newton).otherwise(middle)
        done = F.col("_full") | F.col("got").isNull() | (F.abs(got - F.col("target")) <= close * F.col("target") + 1e-4)
        nxt = state.withColumnRenamed("key", "key0").join(sums, F.expr("key0 <=> key"), "left").drop("key").withColumnRenamed("key0", "key")
        state = _kept(nxt.select(
            "key", "source_size", "n_docs", "target", "_full", "mean", F.when(done, F.col("lam")).otherwise(moved).alias("lam"),
            F.when(done, F.col("lo")).otherwise(lo).alias("lo"), F.when(done, F.col("hi")).otherwise(hi).alias("hi"),
            F.when(done, F.lit(0.0)).otherwise(F.abs(got - F.col("target"))).alias("off"),
        ))
        if state.filter("off > 0").isEmpty():
            return state
    raise RuntimeError("the multipliers of some sources did not settle")


def _settle(dealt: DataFrame, most: int, rounds: int = 8) -> DataFrame:
    """Move each source's words nearer its target, one copy a round: the cell whose size is nearest what is missing."""
    gaps = dealt.groupBy(F.col("_s").alias("_o")).agg((F.first("target") - F.sum(F.col("_got") * F.col("_n"))).alias("_gap"))
    gaps, moves = _kept(gaps), None
    for _ in range(rounds):
        now = _moved(dealt, moves).join(gaps, F.expr("_s <=> _o"))
        room = F.when(F.col("_gap") > 0, F.col("_got") < most * F.col("n")).otherwise(F.col("_got") > 0) & (F.col("_n") > 0)
        left = F.abs(F.abs("_gap") - F.col("_n"))
        best = F.min(F.struct(left.alias("left"), F.col("_n").alias("size"), F.col("_k").alias("salt"), F.signum("_gap").cast("long").alias("by"))).alias("_p")
        pick = _kept(now.filter(room & (left < F.abs("_gap"))).groupBy(F.col("_s").alias("_q")).agg(best).select("_q", "_p.size", "_p.salt", "_p.by"))
        if pick.isEmpty():
            break
        moves = pick if moves is None else _kept(moves.unionAll(pick).groupBy("_q", "size", "salt").agg(F.sum("by").alias("by")))
        step = F.coalesce(F.col("by") * F.col("size"), F.lit(0))
        gaps = _kept(gaps.join(pick, F.expr("_o <=> _q"), "left").select("_o", (F.col("_gap") - step).alias("_gap")))
    return _moved(dealt, moves)


def _moved(dealt: DataFrame, moves: DataFrame | None) -> DataFrame:
    if moves is None:
        return dealt
    met = dealt.join(moves, F.expr("_s <=> _q AND _n = size AND _k = salt"), "left")
    return met.withColumn("_got", F.col("_got") + F.coalesce("by", F.lit(0))).drop("_q", "size", "salt", "by")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, sized: DataFrame | None = None) -> DataFrame:
    """Add size, source_size, target, rate, copies and taken to every row of ``docs`` (doc_id, source, text).

    ``sized``: the same rows as (doc_id, source, size), if they are at hand, from
    which the sums are made; the size of ``docs`` is then counted from the text
    only where ``docs`` has no column size.
    """
    results = ["size", "source_size", "target", "rate", "copies", "taken"]
    # which document of a size and source; of rows that repeat an id, the texts tell
    own = F.xxhash64("doc_id", *(c for c in docs.columns if c == "text" and sized is None))
    if sized is None:
        docs = docs.drop(*results).withColumn("size", word_count())
        sized = materialize(docs.select("doc_id", "source", "size", own.alias("_own")))
    else:
        sized = sized.withColumn("_own", own)
    docs = docs.drop(*(r for r in results if r != "size"))
    n = sized.count()
    salts = lambda h: F.pmod(F.xxhash64(h, F.lit("salt")), F.lit(max(1, -(-n // CELL_ROWS))))
    cells = materialize(sized.withColumn("salt", salts(F.col("_own"))).groupBy("source", "size", "salt").agg(F.count("*").alias("n")))
    totals = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    goals = targets(totals.select("source", "source_size"), weights, most).join(
        totals.select(F.col("source").alias("key"), "n_docs"), F.expr("source <=> key")
    )
    state = multipliers(
        cells.groupBy("source", "size").agg(F.sum("n").alias("n")), goals.select("key", "source_size", "n_docs", F.col("target").cast("double").alias("target")), most
    )
    # copies of a cell: the whole numbers that the running sum of its source's rates passes in it. The sum runs over
    # the sizes of a source first, then over the cells of one size, so that no task holds all cells of a source.
    rate = F.when(F.col("size") == 0, F.lit(0.0)).otherwise(_rate(F.col("size"), F.col("lam"), F.col("mean"), most))
    dealt = cells.join(state.select("key", "source_size", "target", "_full", "mean", "lam"), F.expr("source <=> key"))
    dealt = dealt.withColumn("rate", rate).withColumn("_part", (F.col("rate") * F.col("n")).cast("decimal(38,9)"))
    whole = lambda c: F.floor(c + F.lit("0.5").cast("decimal(2,1)")).cast("long")
    sums = dealt.groupBy(F.col("source").alias("_o"), F.col("size").alias("_z")).agg(F.sum("_part").alias("_own"))
    by_size = Window.partitionBy("_o").orderBy("_z").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.select("_o", "_z", (F.sum("_own").over(by_size) - F.col("_own")).alias("_before"))
    in_size = Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, 0)
    dealt = dealt.join(sums, F.expr("source <=> _o AND size = _z")).withColumn("_up", F.col("_before") + F.sum("_part").over(in_size))
    dealt = dealt.withColumn("_got", whole(F.col("_up")) - whole(F.col("_up") - F.col("_part")))
    dealt = materialize(dealt.select(
        F.col("source").alias("_s"), F.col("size").alias("_n"), F.col("salt").alias("_k"), "source_size", "target", "rate", "n", "_got",
    ))
    dealt = materialize(_settle(dealt, most)).withColumn("_each", F.expr("_got div n")).withColumn("_more", F.col("_got") % F.col("n")).drop("n", "_got")
    # one key without nulls for the ranks and the join, so that the rows are dealt out once for both
    key = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))
    here = docs.withColumns({"_src": key("source"), "_own": own}).withColumn("_salt", salts(F.col("_own")))
    rank = F.row_number().over(Window.partitionBy("_src", "size", "_salt").orderBy("_own", "doc_id"))
    dealt = dealt.withColumn("_s", key("_s")).toDF(*("_src" if c == "_s" else "size" if c == "_n" else "_salt" if c == "_k" else c for c in dealt.columns))
    out = here.withColumn("_rank", rank).join(dealt, ["_src", "size", "_salt"])
    copies = F.least(F.col("_each") + (F.col("_rank") <= F.col("_more")).cast("long"), F.lit(most)).cast("long")
    out = out.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(*docs.columns, *(r for r in results if r not in docs.columns))
