"""Connected components by alternating large-star and small-star steps.

Both steps need only, per node, the least of its neighbours: a plain aggregate
(combined before the shuffle) and an equi-join.  The aggregate of a table of
more than one partition is stored before the join, so that Spark can split hot
nodes.  No neighbour list is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcast.llm._shared import discard, materialize, snug


def _each(df: DataFrame, *pairs: tuple) -> DataFrame:
    """A row (u, v) for each of the given pairs of columns.  Unlike a union it keeps the partitioning of ``df``."""
    rows = F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs])
    return df.select(F.explode(rows).alias("e")).select("e.u", "e.v")


def _star(edges: DataFrame, large: bool, stored: bool) -> DataFrame:
    both = _each(edges, ("u", "v"), ("v", "u"))
    near = both if large else both.where("v < u")
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if stored:
        least, _ = materialize(least, "least")
    joined = near.join(least, "u")
    out = _each(joined.where("v > u"), ("v", "m")) if large else _each(joined, ("v", "m"), ("u", "m"))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, per: int = 500_000) -> DataFrame:
    """``(u, v)`` undirected edges -> ``(node, comp)`` with the least node of each component; isolated nodes are absent.  ``per``: edges of a partition."""
    spark = edges.sparkSession
    now, path = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        stamp = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        now = snug(now, stamp[0], per)
        if stamp == before:
            break
        before = stamp
        big = stamp[0] > per
        new, fresh = materialize(_star(_star(now, True, big), False, big), "edges")
        discard(spark, path)
        now, path = new, fresh
    out = _each(now, ("u", "v"), ("v", "v")).distinct()
    return snug(out.select(F.col("u").alias("node"), F.col("v").alias("comp")), 2 * stamp[0], per)
