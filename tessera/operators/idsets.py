"""Sets of ids, WORD ids to a row, that tables are cut by without a shuffle of their rows.

A row is a stretch of WORD ids and the bits of those that are in the set; a stretch without any has
none.  So a set of most records has a WORDth of their rows, and one of few records no more rows than
ids.  It is written where it is made: Spark then knows its size and sends it to all tasks as long as
spark.sql.autoBroadcastJoinThreshold allows, and shuffles by stretch beyond that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import store

#: Ids of a row: the bits of a long, as a power of two.
SHIFT = 6
WORD = 1 << SHIFT


def _bit(key: str):
    return F.col(key).bitwiseAND(F.lit(WORD - 1)).cast("int")


def made(ids: DataFrame, key: str = "id") -> DataFrame:
    """The set of the ids of some rows; null is none."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), _bit(key))
    rows = ids.filter(F.col(key).isNotNull()).groupBy(F.shiftright(key, SHIFT).alias("__word"))
    return store.written(rows.agg(F.bit_or(bit).alias("__bits")), "ids")


def within(table: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """The rows whose id is in the set."""
    return table.join(held, _found(key), "left_semi")


def without(table: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """The rows whose id isn't in the set; a null id is in none."""
    return table.join(held, _found(key), "left_anti")


def _found(key: str):
    return (F.shiftright(key, SHIFT) == F.col("__word")) & (F.bit_get("__bits", _bit(key)) == 1)
