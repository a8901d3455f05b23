"""How a table lies in its files, so that a range of any of several columns reads few of them.

``interleaved`` gives each row a place on a curve through several columns: every column's rank is cut
to BITS bits by approximate quantiles, and the bits of all ranks are interleaved, the highest first.
Rows that are near on the curve are near in every column, so the row groups of a table written in
that order each span a small part of each column and Parquet's statistics leave most of them out.
Equality on other columns is left to Bloom filters in the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, ERROR = 6, 0.002
#: Bytes of a row group: small, as a group is the least that is read; and the fewest bytes that a row has, by which Bloom filters are sized.
GROUP, ROW = 1 << 20, 64


def _rank(df: DataFrame, column: str, bounds: list[float], out: str) -> DataFrame:
    """How many of the sorted bounds (2 ** BITS - 1 of them) lie below a value, by halving; so a value that very many rows have is apart from those above it."""
    held = F.array(*[F.lit(float(b)) for b in bounds])
    df = df.withColumn(out, F.lit(0))
    for bit in range(BITS - 1, -1, -1):
        step = 1 << bit
        more = F.element_at(held, F.col(out) + step) < F.col(column)
        df = df.withColumn(out, F.col(out) + F.when(more, step).otherwise(0))
    return df


def interleaved(df: DataFrame, columns: list[str], out: str = "place") -> DataFrame:
    """The rows with their place on the curve through numeric columns; null is less than all values."""
    probabilities = [k / (1 << BITS) for k in range(1, 1 << BITS)]
    lows = df.agg(*[F.min(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    names, values = [f"__rank{i}" for i in range(len(columns))], [f"__value{i}" for i in range(len(columns))]
    rows = df.select("*", *[F.coalesce(F.col(c).cast("double"), F.lit(float(low or 0) - 1)).alias(v) for c, v, low in zip(columns, values, lows, strict=True)])
    found = rows.select(*values).approxQuantile(values, probabilities, ERROR)
    for v, n, bounds in zip(values, names, found, strict=True):
        rows = _rank(rows, v, bounds, n) if bounds else rows.withColumn(n, F.lit(0))  # an empty table has no bounds
    place: Column = F.lit(0).cast("long")
    for bit in range(BITS):
        for i, n in enumerate(names):
            taken = F.shiftright(F.col(n), bit).bitwiseAND(F.lit(1)).cast("long")
            place = place.bitwiseOR(F.shiftleft(taken, bit * len(names) + len(names) - 1 - i))
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], place.alias(out))


def keep(df: DataFrame, path: str, columns: list[str], sought: tuple[str, ...] = (), group: int = GROUP) -> DataFrame:
    """Write a table along the curve, with Bloom filters on the columns that are looked up by value, and read it back.

    A filter is sized for the values that a row group may have; Parquet's own size is for a large group, 1 MB."""
    rows = interleaved(df, columns, "__place")
    out = rows.repartitionByRange("__place").sortWithinPartitions("__place").drop("__place").write.option("parquet.block.size", group).option("parquet.block.row.check.min", 1_000)
    for c in sought:
        out = out.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", max(1, group // ROW))
    out.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
