"""What a chart needs from cells: a matrix, its order and caps, gaps of time, partial buckets, labels."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import times
from . import dims as D

#: Series of an identity axis that are shown, and buckets that gap filling may make.
SERIES_SHOWN, FILL_MOST = 8, 5_000
# Labels of codes and of what is absent.
LABELS = {
    "severity": {0: "NONE", 1: "LOW", 2: "MEDIUM", 3: "HIGH", 4: "CRITICAL"},
    "cvssVersion": {2: "CVSS 2.0", 30: "CVSS 3.0", 31: "CVSS 3.1", 4: "CVSS 4.0"},
    "ssvcExpl": {0: "none", 1: "poc", 2: "active"},
    "ssvcAuto": {0: "no", 1: "yes"},
    "ssvcImpact": {0: "partial", 1: "total"},
    "kev": {1: "In KEV", 0: "Not in KEV"},
    "kevRansomware": {1: "Known", 0: "Unknown (per CISA)", 2: "Not in KEV"},
    "state": {1: "PUBLISHED", 2: "REJECTED"},
}
ABSENT = {"severity": "(not scored)", "cvssVersion": "(no CVSS)", "ssvcExpl": "(not assessed)", "ssvcAuto": "(not assessed)", "ssvcImpact": "(not assessed)", "kevRansomware": "(not stated by CISA)"}
NONE_RECORDED = "(none recorded)"


def bucket_label(dimension: str, bucket: Column, label: Column) -> Column:
    """The words for a bucket; what is absent is told by why."""
    out = F.when(bucket.isNull(), ABSENT.get(dimension, NONE_RECORDED))
    for code, word in LABELS.get(dimension, {}).items():
        out = out.when(bucket == code, word)
    return out.otherwise(label)


def series_order(cells: DataFrame, dimension: str) -> DataFrame:
    """series, total, place: severities from the gravest, absence last; identities by size; codes by their order."""
    d = D.dim(dimension)
    totals = cells.groupBy("series").agg(F.sum("cves").alias("total"))
    if dimension == "severity":
        order = [F.desc_nulls_last("series")]
    elif d.kind == D.IDENTITY:
        order = [F.desc("total"), F.asc_nulls_last("series")]
    else:
        order = [F.asc(D.order_of(d, F.col("series"))), F.asc_nulls_last("series")]
    return totals.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # cells have few series


def capped(cells: DataFrame, dimension: str, most: int = SERIES_SHOWN) -> tuple[DataFrame, DataFrame]:
    """The cells of the series that are shown, and one row telling how many are not (only identities are cut)."""
    order = series_order(cells, dimension)
    if D.dim(dimension).kind != D.IDENTITY:
        return cells, order.agg(F.lit(0).cast("long").alias("dropped_series"))
    kept = order.filter(F.col("place") <= most).select(F.col("series").alias("keep"))
    shown = cells.join(F.broadcast(kept), F.col("series").eqNullSafe(F.col("keep")), "left_semi")
    return shown, order.agg(F.coalesce(F.sum((F.col("place") > most).cast("long")), F.lit(0)).alias("dropped_series"))


def rows_shown(cells: DataFrame, dimension: str, most: int) -> tuple[DataFrame, DataFrame]:
    """The cells of the rows that are shown, with the place of each row, and one row telling how many are not.

    Rows keep the order of the report: time and codes in their own, identities by size."""
    d = D.dim(dimension)
    totals = cells.groupBy("bucket").agg(F.sum("cves").alias("total"))
    first = [F.desc("total")] if d.kind == D.IDENTITY else [F.asc_nulls_first(D.order_of(d, F.col("bucket")))]
    placed = totals.withColumn("place", F.row_number().over(Window.orderBy(*first, F.asc_nulls_first("bucket"))))  # a report has few rows
    kept = placed.filter(F.col("place") <= most).select(F.col("bucket").alias("keep"), "place")
    shown = cells.join(F.broadcast(kept), F.col("bucket").eqNullSafe(F.col("keep"))).drop("keep")
    return shown, placed.agg(F.coalesce(F.sum((F.col("place") > most).cast("long")), F.lit(0)).alias("dropped_rows"))


def matrix(cells: DataFrame, series: list | None = None) -> DataFrame:
    """A row for each bucket and a column for each series, zero where there is no cell.  Known series spare a pass."""
    named = cells.withColumn("s", F.coalesce(F.col("series").cast("string"), F.lit("null")))
    pivot = named.groupBy("bucket").pivot("s", [str(s) if s is not None else "null" for s in series] if series is not None else None)
    return pivot.agg(F.sum("cves")).fillna(0)


def row_totals(cells: DataFrame) -> DataFrame:
    return cells.groupBy("bucket").agg(F.sum("cves").alias("total"))


_STEP = {"year": "interval 1 year", "quarter": "interval 3 months", "month": "interval 1 month", "week": "interval 7 days"}
_SHAPE = {"year": r"^\d{4}$", "quarter": r"^\d{4}-Q[1-4]$", "month": r"^\d{4}-\d{2}$", "week": r"^\d{4}-\d{2}-\d{2}$"}


def bucket_start(bucket: Column, grain: str) -> Column:
    """The first day of a bucket; null if the key isn't one of the grain."""
    day = {
        "year": F.concat(bucket, F.lit("-01-01")),
        "quarter": F.concat(F.substring(bucket, 1, 4), F.lit("-"), F.lpad(((F.substring(bucket, 7, 1).try_cast("int") - 1) * 3 + 1).cast("string"), 2, "0"), F.lit("-01")),
        "month": F.concat(bucket, F.lit("-01")),
        "week": bucket,
    }[grain]
    return F.when(bucket.rlike(_SHAPE[grain]), F.try_to_date(day, "yyyy-MM-dd"))


def bucket_of(day: Column, grain: str) -> Column:
    return {"year": F.date_format(day, "yyyy"), "quarter": F.concat(F.date_format(day, "yyyy"), F.lit("-Q"), F.quarter(day).cast("string")), "month": F.date_format(day, "yyyy-MM"), "week": F.date_format(day, "yyyy-MM-dd")}[grain]


def _first_day(day: dt.date, grain: str) -> dt.date:
    if grain == "week":
        return times.monday(day)
    return day.replace(day=1, month={"year": 1, "quarter": (day.month - 1) // 3 * 3 + 1, "month": day.month}[grain])


def fill_gaps(counts: DataFrame, grain: str, low: dt.date | None = None, high: dt.date | None = None, cut: bool = False, most: int = FILL_MOST) -> DataFrame:
    """bucket, cves with a zero for each bucket in between, out to the window's edges where given.

    The lower edge is left alone if the counts were cut there.  Nothing is filled if there is no row, a
    key isn't of the grain, or more than ``most`` buckets would come of it; a null bucket stays, first."""
    known = counts.filter(F.col("bucket").isNotNull()).withColumn("day", bucket_start(F.col("bucket"), grain))
    ends = known.agg(F.min("day").alias("a"), F.max("day").alias("b"), F.sum(F.col("day").isNull().cast("long")).alias("odd"), F.count("*").alias("n"))
    a = F.col("a") if low is None or cut else F.least("a", F.lit(_first_day(low, grain)))
    b = F.col("b") if high is None else F.greatest("b", F.lit(_first_day(high, grain)))
    days = ends.filter((F.col("n") > 0) & (F.col("odd") == 0)).select(F.expr("1").alias("x"), a.alias("a"), b.alias("b"))
    size = {"year": 365, "quarter": 90, "month": 28, "week": 7}[grain]
    days = days.filter(F.datediff("b", "a") / size <= most).select(F.explode(F.sequence("a", "b", F.expr(_STEP[grain]))).alias("day"))
    axis = days.select(bucket_of(F.col("day"), grain).alias("bucket"))
    return axis.join(counts, "bucket", "full").select("bucket", F.coalesce("cves", F.lit(0)).cast("long").alias("cves")).orderBy(F.asc_nulls_first("bucket"))


def partial_flags(counts: DataFrame, grain: str, low: dt.date | None, high: dt.date | None) -> DataFrame:
    """Adds partial: whether the window begins or ends inside the bucket; and the label that says so."""
    start = bucket_start(F.col("bucket"), grain)
    after = F.date_add(start, 7) if grain == "week" else F.add_months(start, {"year": 12, "quarter": 3, "month": 1}[grain])
    end = F.date_sub(after, 1)
    flag = F.lit(False)
    if low is not None:
        flag = flag | ((start < F.lit(low)) & (end >= F.lit(low)))
    if high is not None:
        flag = flag | ((start <= F.lit(high)) & (end > F.lit(high)))
    flag = F.coalesce(flag, F.lit(False))
    return counts.withColumn("partial", flag).withColumn("label", F.concat(F.coalesce("bucket", F.lit(NONE_RECORDED)), F.when(flag, " (partial)").otherwise("")))


def time_span(low: dt.date | None, high: dt.date | None, first: dt.date, last: dt.date) -> tuple[dt.date, dt.date, bool]:
    """A window clamped into the days that are covered, and whether its lower edge was set."""
    a = min(max(low or first, first), last)
    b = max(min(high or last, last), a)
    return a, b, low is not None
