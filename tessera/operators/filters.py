"""Filters of a report, as conditions and semi-joins on the records."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import LISTED, NOT_ASSESSED, NOT_LISTED, PUBLISHED, RANSOMWARE_KNOWN, RANSOMWARE_NOT_LISTED, RANSOMWARE_UNKNOWN, REJECTED, CatalogMissing, Corpus
from . import search

Names = tuple[str, ...] | list[str] | None
Codes = tuple[int, ...] | list[int] | None


@dataclass(frozen=True)
class Filters:
    state: str | None = None  # published (also if unknown), rejected, all
    text: str | None = None
    cve_id: str | None = None
    cna: Names = None
    vendor: Names = None
    product: Names = None
    cwe: Names = None
    host: Names = None
    severity: Codes = None
    cvss_version: Codes = None
    ssvc_expl: Codes = None
    ssvc_auto: Codes = None
    ssvc_impact: Codes = None
    kev: Codes = None
    kev_ransomware: Codes = None
    score_min: float | None = None
    score_max: float | None = None
    published_from: float | None = None
    published_to: float | None = None
    updated_from: float | None = None
    updated_to: float | None = None
    year_from: float | None = None
    year_to: float | None = None
    kev_added_from: float | None = None
    kev_added_to: float | None = None
    kev_due_from: float | None = None
    kev_due_to: float | None = None
    extra: dict = field(default_factory=dict, compare=False, repr=False)


#: Code axes: the filter's field and the record's column.
CODE_AXES = {"severity": "cvss_sev", "cvss_version": "cvss_ver", "ssvc_expl": "ssvc_expl", "ssvc_auto": "ssvc_auto", "ssvc_impact": "ssvc_impact"}
RANGES = {"score": "cvss_score", "published": "published", "updated": "updated", "year": "year"}
KEV_RANGES = {"kev_added": "added_at", "kev_due": "due_at"}
#: Axes that are asked by name.
NAMED = ("cna", "vendor", "product", "cwe", "host")
KEV_DIMS = {"kev", "kevRansomware"}


def uses_kev(filters: Filters, *dimensions: str | None) -> bool:
    return bool(filters.kev or filters.kev_ransomware or any(_bounded(filters, k) for k in KEV_RANGES) or KEV_DIMS & set(dimensions))


def require_kev(corpus: Corpus, filters: Filters, *dimensions: str | None) -> None:
    if uses_kev(filters, *dimensions) and not corpus.has("kev"):
        raise CatalogMissing("this question needs the catalog of exploited records, and none is loaded")


def _finite(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)


def _bounded(filters: Filters, name: str) -> bool:
    return _finite(getattr(filters, f"{name}_from", None)) or _finite(getattr(filters, f"{name}_to", None))


def _range(column: str, low, high) -> list[Column]:
    return [F.col(column) >= low] * _finite(low) + [F.col(column) <= high] * _finite(high)


def codes_in(column: str, codes: Codes) -> Column | None:
    """One of the codes; NOT_ASSESSED stands for null.  No code, no condition."""
    if not codes:
        return None
    known = [c for c in codes if c != NOT_ASSESSED]
    arms = [F.col(column).isin(known)] * bool(known) + [F.col(column).isNull()] * (NOT_ASSESSED in codes)
    return reduce(lambda a, b: a | b, arms)


def normal_cwe(name: str) -> str:
    name = name.strip().lower()
    return f"cwe-{name}" if name.isdigit() else name


def keys_of(axis: str, names: Names) -> list[str]:
    """Lower-cased names that aren't blank."""
    shape = normal_cwe if axis == "cwe" else lambda n: n.strip().lower()
    return [shape(n) for n in names or [] if n.strip()]


def lookup(corpus: Corpus, axis: str) -> DataFrame:
    """id and lower-cased name of an axis."""
    table = getattr(corpus, axis)
    return table.select("id", F.lower("cwe" if axis == "cwe" else "name").alias("name_key"))


def resolved(corpus: Corpus, axis: str, names: Names) -> DataFrame | None:
    """ids of the names; None if no name is given, an empty table if none is known."""
    keys = keys_of(axis, names)
    return lookup(corpus, axis).filter(F.col("name_key").isin(keys)).select("id") if keys else None


def unmatched(corpus: Corpus, axis: str, names: Names) -> DataFrame:
    """Names that the corpus doesn't have."""
    keys = keys_of(axis, names)
    known = lookup(corpus, axis).select("name_key")
    return known.sparkSession.createDataFrame([(k,) for k in keys], "name_key string").join(known, "name_key", "left_anti")


def _linked(corpus: Corpus, axis: str, ids: DataFrame) -> DataFrame:
    """Records (id) that one of the axis' ids is linked with."""
    if axis == "product":
        return corpus.cve_prod.join(ids.withColumnRenamed("id", "product_id"), "product_id", "left_semi").select(F.col("cve_id").alias("id"))
    if axis == "vendor":
        products = corpus.product.join(ids.withColumnRenamed("id", "vendor_id"), "vendor_id", "left_semi").select("id")
        return _linked(corpus, "product", products)
    if axis == "cwe":
        return corpus.cve_cwe.join(ids.withColumnRenamed("id", "cwe_id"), "cwe_id", "left_semi").select(F.col("cve_id").alias("id"))
    urls = corpus.url.join(ids.withColumnRenamed("id", "host_id"), "host_id", "left_semi").select(F.col("id").alias("url_id"))
    return corpus.cve_ref.join(urls, "url_id", "left_semi").select(F.col("cve_id").alias("id"))


def conditions(filters: Filters) -> list[Column]:
    """What the record's own columns tell."""
    out = []
    if filters.state != "all":
        out.append(F.col("state") == (REJECTED if filters.state == "rejected" else PUBLISHED))
    if (filters.cve_id or "").strip():
        out.append(F.col("cve_id") == filters.cve_id.strip().upper())  # as identifiers are kept, so that the files' statistics serve
    out += [c for axis, column in CODE_AXES.items() if (c := codes_in(column, getattr(filters, axis))) is not None]
    out += _range("cvss_score", filters.score_min, filters.score_max)
    for name in ("published", "updated", "year"):
        out += _range(name, getattr(filters, f"{name}_from"), getattr(filters, f"{name}_to"))
    return out


def _overlay(corpus: Corpus, records: DataFrame, filters: Filters) -> DataFrame:
    kev = corpus.kev.filter(F.col("cve_id").isNotNull())
    ids = kev.select(F.col("cve_id").alias("id"))
    if filters.kev:
        listed, absent = LISTED in filters.kev, NOT_LISTED in filters.kev
        if not listed and not absent:
            records = records.filter(F.lit(False))
        elif listed != absent:
            records = records.join(ids, "id", "left_semi" if listed else "left_anti")
    if filters.kev_ransomware:
        codes = set(filters.kev_ransomware)
        arms = []
        if known := sorted(codes & {RANSOMWARE_UNKNOWN, RANSOMWARE_KNOWN}):
            arms.append(F.col("kev_cve").isNotNull() & F.col("kev_ransomware").isin(known))
        if NOT_ASSESSED in codes:
            arms.append(F.col("kev_cve").isNotNull() & F.col("kev_ransomware").isNull())
        if RANSOMWARE_NOT_LISTED in codes:
            arms.append(F.col("kev_cve").isNull())
        if arms:
            side = kev.select(F.col("cve_id").alias("id"), F.col("cve").alias("kev_cve"), F.col("ransomware").alias("kev_ransomware"))
            records = records.join(side, "id", "left").filter(reduce(lambda a, b: a | b, arms)).drop("kev_cve", "kev_ransomware")
        else:
            records = records.filter(F.lit(False))
    bounds = [c for name, column in KEV_RANGES.items() for c in _range(column, getattr(filters, f"{name}_from"), getattr(filters, f"{name}_to"))]
    if bounds:  # a bound on the entry means that there is one
        records = records.join(kev.filter(reduce(lambda a, b: a & b, bounds)).select(F.col("cve_id").alias("id")), "id", "left_semi")
    return records


def matching(corpus: Corpus, filters: Filters) -> DataFrame:
    """The records that all filters let through; what can't be resolved lets nothing through.

    Whether an axis knows any of its names is asked of its names at once, before links are read or written."""
    require_kev(corpus, filters)
    known = {a: ids for a in NAMED if (ids := resolved(corpus, a, getattr(filters, a))) is not None}
    records = corpus.cve
    if any(ids.isEmpty() for ids in known.values()):
        return records.filter(F.lit(False))
    for c in conditions(filters):
        records = records.filter(c)
    if (filters.text or "").strip():
        records = search.restrict(corpus, records, filters.text)
    for axis, ids in known.items():
        if axis == "cna":
            records = records.join(ids.withColumnRenamed("id", "cna_id"), "cna_id", "left_semi").select(corpus.cve.columns)
        else:
            records = records.join(_linked(corpus, axis, ids), "id", "left_semi")
    return _overlay(corpus, records, filters) if uses_kev(filters) else records
