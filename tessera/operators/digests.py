"""Fingerprints of ranges of ids, in a tree: where two copies of a table differ, without comparing their rows.

A leaf is a range of LEAF ids: how many rows it has and two sums over hashes of them, so the order of
rows and files doesn't matter.  A node of a higher level has FAN nodes below it and a fingerprint of
theirs.  A tree is a small table (level, range, rows, sum, mix) that is kept with a copy.  ``drift``
compares two trees from the top and goes down only below nodes that differ, so equal copies cost one
comparison and a planted change about as many as there are levels.  Trees are kept: ``drift`` reads
one level after the other, and writes which nodes differ before it goes on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import written

LEAF, FAN = 4_096, 16
TREE = ("level", "range", "rows", "sum", "mix")


def _summed(row: Column) -> list[Column]:
    return [F.sum(row.cast("decimal(38,0)")).alias("sum"), F.bit_xor(row).alias("mix")]


def tree(table: DataFrame, key: str = "id", leaf: int = LEAF, fan: int = FAN, levels: int = 8) -> DataFrame:
    """level (0: leaves), range, rows, sum, mix of every node; ``levels`` is the same for all copies, so their trees can be compared."""
    columns = sorted(c for c in table.columns)
    rows = table.select((F.floor(F.col(key) / leaf)).cast("long").alias("range"), F.xxhash64(*columns).alias("h"))
    level = rows.groupBy("range").agg(F.count("*").alias("rows"), *_summed(F.col("h"))).select(F.lit(0).alias("level"), "range", "rows", "sum", "mix")
    out = level
    for n in range(1, levels):
        level = level.groupBy(F.floor(F.col("range") / fan).cast("long").alias("range")).agg(F.sum("rows").alias("rows"), *_summed(F.xxhash64("range", "rows", "sum", "mix")))
        level = level.select(F.lit(n).alias("level"), "range", "rows", "sum", "mix")
        out = out.unionByName(level)
    return out


def _unlike(a: DataFrame, b: DataFrame) -> DataFrame:
    """range, rows and other_rows of the nodes that one of two levels has and the other hasn't, or has otherwise."""
    named = b.select(F.col("range"), F.col("rows").alias("other_rows"), F.col("sum").alias("other_sum"), F.col("mix").alias("other_mix"))
    same = F.col("rows").eqNullSafe(F.col("other_rows")) & F.col("sum").eqNullSafe(F.col("other_sum")) & F.col("mix").eqNullSafe(F.col("other_mix"))
    return a.join(named, "range", "full").filter(~same).select("range", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("other_rows", F.lit(0)).alias("other_rows"))


def drift(a: DataFrame, b: DataFrame, leaf: int = LEAF, fan: int = FAN, levels: int = 8) -> DataFrame:
    """first, last (ids), rows, other_rows of the leaves that differ."""
    at = lambda t, n: t.filter(F.col("level") == n).select("range", "rows", "sum", "mix")
    unlike = written(_unlike(at(a, levels - 1), at(b, levels - 1)), "drift")
    for n in range(levels - 2, -1, -1):
        if not unlike.limit(1).count():
            break
        above = unlike.select(F.col("range").alias("above"))
        below = lambda t: t.join(above, F.floor(F.col("range") / fan).cast("long") == F.col("above"), "left_semi")  # noqa: E731, B023
        unlike = written(_unlike(below(at(a, n)), below(at(b, n))), "drift")
    return unlike.select((F.col("range") * leaf).alias("first"), ((F.col("range") + 1) * leaf - 1).alias("last"), "rows", "other_rows")


def drifted(a: DataFrame, b: DataFrame, ranges: DataFrame, key: str = "id", leaf: int = LEAF) -> DataFrame:
    """Rows of the drifted ranges that only one copy has: its columns and ``copy`` (1 or 2)."""
    where = ranges.select(F.floor(F.col("first") / leaf).cast("long").alias("__range"))
    part = lambda t: t.join(where, F.floor(F.col(key) / leaf).cast("long") == F.col("__range"), "left_semi").select(a.columns)
    one, two = part(a), part(b)
    return one.exceptAll(two).withColumn("copy", F.lit(1)).unionByName(two.exceptAll(one).withColumn("copy", F.lit(2)))
