"""Pages far down a sorted list without sorting the list.

``window`` finds which values a page is made of: counts of the sort key in CELLS cells of its range,
again within the cell where the page begins and ends, until few rows are left or all have one value;
then the same by id among rows of one value.  Each step reads one narrow column within bounds that
reach the files' statistics, and at most CELLS rows come to the driver.  What is sorted in the end is
the rows of the last cells, not the corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = 1_024
#: Rows that may be sorted for a page besides its own.
FEW = 20_000


def _narrowed(rows: DataFrame, column: str, skip: int, take: int, few: int) -> tuple[Column | None, int]:
    """A condition on a numeric column (no nulls) that all rows of the page meet, and how many rows that meet it come before the page, in falling order."""
    where, bound = F.lit(True), None
    while True:
        n, low, high = rows.filter(where).agg(F.count("*"), F.min(column), F.max(column)).first()
        if n <= few + take or low == high:
            return bound, skip
        width = (high - low) / CELLS
        cell = F.floor((F.col(column) - F.lit(low)) / F.lit(float(width)))
        found = rows.filter(where).groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()  # at most CELLS + 1 rows
        before, first, last = 0, None, None
        for c in sorted(found, key=lambda c: -c["cell"]):
            if first is None and before + c["n"] > skip:
                first, skipped = c, before
            before += c["n"]
            if first is not None:
                last = c
                if before >= skip + take:
                    break
        if first is None:  # beyond the end
            return F.lit(False), 0
        if last["low"] == low and first["high"] == high and sum(c["n"] for c in found if last["cell"] <= c["cell"] <= first["cell"]) == n:
            return bound, skip  # nothing is left out any more
        skip -= skipped
        bound = (F.col(column) <= first["high"]) & (F.col(column) >= last["low"])
        where = bound


def window(rows: DataFrame, column: str, skip: int, take: int, tie: str = "id", few: int = FEW) -> tuple[DataFrame, int]:
    """Rows among which the page is, and how many of them come before it, in the order of ``column`` (falling, nulls last) and ``tie`` (falling)."""
    there, absent = F.col(column).isNotNull(), F.col(column).isNull()
    known, nulls = rows.filter(there), rows.filter(absent)
    n = known.count()
    if skip >= n:
        where, rest = _narrowed(nulls, tie, skip - n, take, few)
        return rows.filter(absent if where is None else absent & where), rest
    where, rest = _narrowed(known, column, skip, take, few)
    there = there if where is None else there & where
    if rows.filter(there).select(column).distinct().limit(2).count() == 1:
        tied, rest = _narrowed(rows.filter(there), tie, rest, take, few)
        there = there if tied is None else there & tied
    if skip + take > n:  # the page goes on among the rows without a value
        below, _ = _narrowed(nulls, tie, 0, skip + take - n, few)
        there = there | (absent if below is None else absent & below)
    return rows.filter(there), rest


def after(rows: DataFrame, column: str, value, tie_value, tie: str = "id") -> DataFrame:
    """Rows that come after one with these values: the next page of a reader that has the last one's end."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return rows.filter(F.col(column).isNull() & (F.col(tie) < tie_value))
    return rows.filter((F.col(column) < value) | ((F.col(column) == value) & (F.col(tie) < tie_value)) | F.col(column).isNull())
