"""The axes that reports group by: key, label, order, and the joins that they need."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import times
from ..model import CVSS_VERSIONS, LISTED, NOT_LISTED, RANSOMWARE_KNOWN, RANSOMWARE_NOT_LISTED, RANSOMWARE_UNKNOWN, SEVERITIES, Corpus

TIME, CODE, FIXED, IDENTITY = "time", "code", "fixed", "identity"


@dataclass(frozen=True)
class Dim:
    """join: the link or overlay that the key comes from; names: bucket and label of each identity; listed: whether a bucket without a name is left out.

    most: how many buckets there can be by the codes of the data model, absence included; an axis that may show so many needs no narrowing."""

    name: str
    kind: str
    key: Callable[[], Column]
    order: Callable[[Column], Column] | None = None  # of the key
    join: str | None = None
    names: Callable[[Corpus], DataFrame] | None = None
    listed: bool = True
    most: int | None = None

    @property
    def multiplies(self) -> bool:
        """Whether a record can be in more than one bucket."""
        return self.join in MULTIPLYING


def _version_order(key: Column) -> Column:
    out = F.when(key == CVSS_VERSIONS[0], 0)
    for i, v in enumerate(CVSS_VERSIONS[1:], 1):
        out = out.when(key == v, i)
    return out.when(key.isNotNull(), len(CVSS_VERSIONS)).otherwise(len(CVSS_VERSIONS) + 1)


def _absent_last(key: Column) -> Column:
    return F.coalesce(key, F.lit(99))


def _member() -> Column:
    return F.when(F.col("kev_cve").isNull(), NOT_LISTED).otherwise(LISTED)


def _ransomware() -> Column:
    return F.when(F.col("kev_cve").isNull(), RANSOMWARE_NOT_LISTED).otherwise(F.col("kev_ransomware"))


def _ransomware_order(key: Column) -> Column:
    return F.when(key == RANSOMWARE_KNOWN, 0).when(key == RANSOMWARE_UNKNOWN, 1).when(key == RANSOMWARE_NOT_LISTED, 2).otherwise(99)


def _names(table: str, label: str = "name") -> Callable[[Corpus], DataFrame]:
    return lambda corpus: getattr(corpus, table).select(F.col("id").alias("bucket"), F.col(label).alias("label"))


def _products(corpus: Corpus) -> DataFrame:
    vendor = corpus.vendor.select(F.col("id").alias("vendor_id"), F.col("name").alias("vendor_name"))
    return corpus.product.join(vendor, "vendor_id").select(F.col("id").alias("bucket"), F.concat("vendor_name", F.lit(" / "), "name").alias("label"))


def _weaknesses(corpus: Corpus) -> DataFrame:
    return corpus.cwe.select(F.col("id").alias("bucket"), F.concat("cwe", F.lit(" \u2014 "), "descr").alias("label"))


DIMS = {
    d.name: d
    for d in (
        Dim("year", TIME, times.year_of),
        Dim("quarter", TIME, times.quarter_of),
        Dim("month", TIME, times.month_of),
        Dim("week", TIME, times.week_of),
        Dim("severity", CODE, lambda: F.col("cvss_sev"), most=len(SEVERITIES) + 1),
        Dim("cvssVersion", FIXED, lambda: F.col("cvss_ver"), order=_version_order, most=len(CVSS_VERSIONS) + 1),
        Dim("ssvcExpl", FIXED, lambda: F.col("ssvc_expl"), order=_absent_last, most=4),
        Dim("ssvcAuto", FIXED, lambda: F.col("ssvc_auto"), order=_absent_last, most=3),
        Dim("ssvcImpact", FIXED, lambda: F.col("ssvc_impact"), order=_absent_last, most=3),
        Dim("kev", FIXED, _member, order=lambda key: 1 - key, join="kev", most=2),
        Dim("kevRansomware", FIXED, _ransomware, order=_ransomware_order, join="kev", most=4),
        Dim("state", CODE, lambda: F.col("state"), most=2),
        Dim("cna", IDENTITY, lambda: F.col("cna_id"), names=_names("cna"), listed=False),
        Dim("vendor", IDENTITY, lambda: F.col("vendor_id"), join="vendor", names=_names("vendor")),
        Dim("product", IDENTITY, lambda: F.col("product_id"), join="product", names=_products),
        Dim("cwe", IDENTITY, lambda: F.col("cwe_id"), join="cwe", names=_weaknesses),
        Dim("host", IDENTITY, lambda: F.col("host_id"), join="host", names=_names("host")),
    )
}
#: Joins that can give a record more than one row.
MULTIPLYING = {"vendor", "product", "cwe", "host"}


def dim(name: str) -> Dim:
    if name not in DIMS:
        raise ValueError(f"not a dimension: {name}")
    return DIMS[name]


def order_of(d: Dim, key: Column) -> Column:
    return d.order(key) if d.order else key


def join(corpus: Corpus, records: DataFrame, group: str) -> DataFrame:
    """Records with the columns of the overlay or of their assigner.  Which side to broadcast is left to Spark, which knows the sizes."""
    if group == "kev":
        kev = corpus.kev.filter(F.col("cve_id").isNotNull()).select(F.col("cve_id").alias("id"), F.col("cve").alias("kev_cve"), F.col("ransomware").alias("kev_ransomware"))
        return records.join(kev, "id", "left")
    return records.join(corpus.cna.select(F.col("id").alias("cna_id"), F.col("name").alias("cna_name")), "cna_id", "left")


def links(corpus: Corpus, group: str) -> DataFrame:
    """id of a record and the keys of what it is linked with: ids only, names come later."""
    if group == "product":
        return corpus.cve_prod.select(F.col("cve_id").alias("id"), "product_id")
    if group == "vendor":
        return corpus.cve_prod.select(F.col("cve_id").alias("id"), "product_id").join(corpus.product.select(F.col("id").alias("product_id"), "vendor_id"), "product_id")
    if group == "cwe":
        return corpus.cve_cwe.select(F.col("cve_id").alias("id"), "cwe_id")
    if group == "host":
        return corpus.cve_ref.select(F.col("cve_id").alias("id"), "url_id").join(corpus.url.select(F.col("id").alias("url_id"), "host_id"), "url_id").select("id", "host_id")
    raise ValueError(group)


def placed(corpus: Corpus, records: DataFrame, dims: dict[str, Dim], tops: dict[str, DataFrame] | None = None) -> DataFrame:
    """id and a column for the key of each of ``dims``; each link is joined once, so vendor and product on two axes come from one.

    ``tops``: buckets (a column ``top``) that an axis is narrowed to before it is joined with others."""
    groups = list(dict.fromkeys(d.join for d in dims.values() if d.join))
    if "vendor" in groups and "product" in groups:
        groups.remove("product")  # vendor's links have the product too
    if "kev" in groups:
        records = join(corpus, records, "kev")
    out = {n: d.key().alias(n) for n, d in dims.items() if not d.multiplies}
    rows = records.select("id", *out.values())
    for group in groups:
        if group == "kev":
            continue
        mine = {n: d for n, d in dims.items() if d.join == group or (d.multiplies and d.join not in groups)}
        link = links(corpus, group).select("id", *[d.key().alias(n) for n, d in mine.items()])
        for n in mine:
            if tops and n in tops:
                link = narrowed(link, n, tops[n])
        rows = rows.join(link, "id")
    return rows


def narrowed(rows: DataFrame, name: str, top: DataFrame) -> DataFrame:
    """Rows whose bucket is one of ``top``, which has at most as many rows as an axis may show."""
    return rows.join(F.broadcast(top), F.col(name).eqNullSafe(F.col("top")), "left_semi")


def repeats(dims: list[Dim]) -> bool:
    """Whether a record may be in one bucket (or cell) by several links: by its products in a vendor, by its references in a host.

    Links are unique, so a record is in a product or a weakness once."""
    names = {d.name for d in dims}
    return "host" in names or ("vendor" in names and "product" not in names)


def counted(dims: list[Dim]) -> Column:
    """Records: counted once each where a link may repeat them."""
    return (F.count_distinct("id") if repeats(dims) else F.count("*")).alias("cves")


def known(corpus: Corpus, counts: DataFrame, d: Dim, name: str = "bucket") -> DataFrame:
    """Counts of the buckets that have a name, where one is asked for."""
    if not (d.names and d.listed):
        return counts
    return counts.join(d.names(corpus).select(F.col("bucket").alias(name)), name, "left_semi")


def labelled(corpus: Corpus, rows: DataFrame, d: Dim, bucket: str = "bucket", label: str = "label") -> DataFrame:
    """The rows of a bounded result with the label of each bucket."""
    if not d.names:
        return rows.withColumn(label, F.col(bucket).cast("string"))
    names = d.names(corpus).select(F.col("bucket").alias(bucket), F.col("label").alias(label))
    return rows.join(names, bucket, "left")
