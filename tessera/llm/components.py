"""Connected components of a graph that no machine holds: alternating large and small stars.

Every step is a sum by key (combined before the shuffle) and an equi-join that adaptive execution
can split, so a vertex with very many neighbours lands in no single task.  Each round is written to
the shared folder; only counts come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = common.cut(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
    out = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return _then(out.distinct(), "large", least)


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = common.cut(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    again = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _then(again.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small", least)


def _then(out: DataFrame, name: str, *used: DataFrame) -> DataFrame:
    """Written, and with it what only this step has read deleted."""
    out = common.cut(out, name)
    for df in used:
        common.drop_cut(df)
    return out


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v long.  One row (vertex, root) for each vertex but the roots; a root is the least vertex of its component.

    Repeated edges, edges to oneself and either direction are one; no edges, no rows."""
    edges = common.cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        large = _large_star(edges)
        common.drop_cut(edges)
        edges = _small_star(large)
        common.drop_cut(large)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == tuple(now):
            return edges.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
        state = tuple(now)
