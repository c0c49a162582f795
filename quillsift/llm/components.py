"""Connected components of a distributed edge table by alternating stars.

Each round links every node's larger neighbours to its least neighbour, then its
smaller ones, until the edges are stars. A node's least neighbour is a
pre-aggregated minimum, written before it is joined to the links, so that the links
of a node with very many can be split over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm.common import materialize


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")))
    linked = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """From edges (u, v) to (u, v) with v the least node reachable, for every node that isn't its own.

    Both columns are of one comparable type. Self links and repeated links are
    allowed; no edges give an empty result.
    """
    now = materialize(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    mark = _mark(now)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        then = materialize(_small_star(materialize(_large_star(now))))
        new = _mark(then)
        if new == mark:
            return then
        now, mark = then, new
    else:
        raise RuntimeError("components did not settle")
    return now
