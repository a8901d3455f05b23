"""Approximate counts of distinct records that can be added up over any window of months.

A sketch (HyperLogLog, 2 ** PRECISION registers, a standard error of about 0.8 %) is kept for each
bucket of an axis and month; the records of a bucket in a window are estimated from the union of its
months' sketches, without reading a record again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Corpus
from . import dims as D

PRECISION = 14


def monthly(corpus: Corpus, axis: str) -> DataFrame:
    """bucket, month (null: no date), sketch of the records that each bucket of an axis has in each month."""
    rows = D.placed(corpus, corpus.cve, {"bucket": D.dim(axis), "month": D.dim("month")})
    return rows.groupBy("bucket", "month").agg(F.hll_sketch_agg("id", PRECISION).alias("sketch"))


def estimated(sketches: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """bucket, records: about how many records each bucket has in the months from first to last; months without a date only count where there is no bound."""
    if first is not None:
        sketches = sketches.filter(F.col("month") >= first)
    if last is not None:
        sketches = sketches.filter(F.col("month") <= last)
    return sketches.groupBy("bucket").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("records"))
