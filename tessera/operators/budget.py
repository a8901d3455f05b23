"""Budgets over ordered rows: how many fit, and which of the oldest must go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within(df: DataFrame, size: Column, budget: int, order: list[Column], by: list[str]) -> DataFrame:
    """Rows of each group, in order, while their sizes together stay within the budget; the first always."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = df.withColumn("__used", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__n", F.row_number().over(w))
    return rows.filter((F.col("__used") <= budget) | (F.col("__n") == 1)).drop("__used", "__n")


def evict(df: DataFrame, size: Column, budget: int, oldest_first: list[Column], by: list[str], may_go: Column, left_behind: int = 0) -> DataFrame:
    """Adds evicted: the oldest rows that may go, just as many that the group fits the budget; each leaves ``left_behind`` of its size."""
    g, w = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(*oldest_first).rowsBetween(Window.unboundedPreceding, -1)
    freed = F.when(may_go, F.greatest(size - left_behind, F.lit(0))).otherwise(0)
    rows = df.withColumn("__over", F.sum(size).over(g) - budget).withColumn("__freed", F.coalesce(F.sum(freed).over(w), F.lit(0)))
    return rows.withColumn("evicted", may_go & (freed > 0) & (F.col("__over") > F.col("__freed"))).drop("__over", "__freed")
