"""The catalog of exploited records: reading, validation, order, and the overlay table."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import times
from ..streaming.changes import Refused, resolve

# Bounds of a catalog and the words of its ransomware field.
MOST_BYTES, MOST_ENTRIES = 32 * 1024 * 1024, 100_000
RANSOMWARE = {"Known": 1, "Unknown": 0}
ENTRY = "cveID string, vendorProject string, product string, vulnerabilityName string, dateAdded string, shortDescription string, requiredAction string, dueDate string, knownRansomwareCampaignUse string, notes string, cwes array<string>"


def header(blob: bytes, now: dt.datetime) -> dict:
    """The catalog as parsed JSON, once it has the shape and size of one."""
    if len(blob) > MOST_BYTES:
        raise Refused("the catalog is too large")
    try:
        catalog = json.loads(blob)
    except ValueError as e:
        raise Refused(f"the catalog isn't JSON: {e}") from None
    entries = catalog.get("vulnerabilities") if isinstance(catalog, dict) else None
    if not isinstance(entries, list) or not entries:
        raise Refused("the catalog has no entries")
    if len(entries) > MOST_ENTRIES or catalog.get("count") != len(entries):
        raise Refused("the catalog's count isn't that of its entries")
    if T.plausible_version(catalog.get("catalogVersion", "")) is None:
        raise Refused("the catalog's version can't be read")
    try:
        released = dt.datetime.fromisoformat(catalog["dateReleased"].replace("Z", "+00:00"))
    except (KeyError, ValueError, AttributeError):
        raise Refused("the catalog's release date can't be read") from None
    if released.replace(tzinfo=released.tzinfo or dt.UTC) > now + dt.timedelta(days=1):
        raise Refused("the catalog is released in the future")
    return catalog


def entries(spark: SparkSession, catalog: dict) -> DataFrame:
    rows = [tuple(e.get(c.split()[0]) if isinstance(e, dict) else None for c in ENTRY.replace("array<string>", "x").split(", ")) for e in catalog["vulnerabilities"]]
    return spark.createDataFrame(rows, ENTRY)


def invalid(rows: DataFrame) -> DataFrame:
    """problem, cve of entries that a catalog may not have."""
    bad_id = ~F.coalesce(T.is_cve_id(F.col("cveID"), "catalog"), F.lit(False))
    problem = F.when(bad_id, "bad id").when(times.day_seconds(F.col("dateAdded")).isNull(), "unreal date added").when(times.day_seconds(F.col("dueDate")).isNull(), "unreal due date")
    one = rows.select(problem.alias("problem"), F.col("cveID").alias("cve")).filter("problem is not null")
    return one.unionByName(rows.groupBy(F.col("cveID").alias("cve")).count().filter("count > 1").select(F.lit("id twice").alias("problem"), "cve"))


def overlay(rows: DataFrame, cve: DataFrame) -> DataFrame:
    """The kev table: one row an entry, with the id of the record where there is one."""
    code = F.when(F.col("knownRansomwareCampaignUse") == "Known", 1).when(F.col("knownRansomwareCampaignUse") == "Unknown", 0)
    kev = rows.select(
        F.col("cveID").alias("cve"), F.lit(None).cast("long").alias("cve_id"), F.col("vendorProject").alias("vendor"), "product", F.col("vulnerabilityName").alias("name"), F.col("shortDescription").alias("descr"), F.col("requiredAction").alias("action"),
        F.col("dateAdded").alias("added"), times.day_seconds(F.col("dateAdded")).alias("added_at"), F.col("dueDate").alias("due"), times.day_seconds(F.col("dueDate")).alias("due_at"), code.alias("ransomware"), "notes", F.coalesce("cwes", F.array().cast("array<string>")).alias("cwes"),
    )
    return resolve(kev, cve)


def load(spark: SparkSession, blob: bytes, cve: DataFrame, now: dt.datetime) -> DataFrame:
    rows = entries(spark, header(blob, now))
    if bad := invalid(rows).limit(1).collect():
        raise Refused(f"the catalog has an entry it may not have: {bad[0].asDict()}")
    return overlay(rows, cve)


def is_newer(incoming: str, held: str | None) -> bool:
    """Whether a catalog may replace the one that is held: not an older one; a version that can't be ordered is replaced."""
    new, old = T.plausible_version(incoming or ""), T.plausible_version(held or "")
    if new is None:
        return False
    if old is None:
        return True
    width = max(len(new), len(old))
    return new + (0,) * (width - len(new)) >= old + (0,) * (width - len(old))


def histogram(kev: DataFrame) -> DataFrame:
    return kev.groupBy("ransomware").agg(F.count("*").alias("entries")).orderBy(F.asc_nulls_last("ransomware"))


def unmatched(kev: DataFrame) -> DataFrame:
    return kev.agg(F.sum(F.col("cve_id").isNull().cast("long")).alias("unmatched"))


def sample(cve: DataFrame, size: int, version: str = "2026.01.01") -> dict:
    """A catalog for trials: the records with the least ids, and two that no corpus has."""
    ids = [r["cve_id"] for r in cve.orderBy("id").limit(size).collect()] + ["CVE-1999-0000", "CVE-1999-00000"]
    entry = lambda k, i: dict(cveID=i, vendorProject="Vendor", product="Product", vulnerabilityName=f"Name {k}", dateAdded="2025-01-02", shortDescription="d", requiredAction="a", dueDate="2025-01-23", knownRansomwareCampaignUse=("Known", "Unknown", "?")[k % 3], notes="n; https://example.org/", cwes=["CWE-79"])
    return {"title": "sample", "catalogVersion": version, "dateReleased": "2026-01-01T00:00:00Z", "count": len(ids), "vulnerabilities": [entry(k, i) for k, i in enumerate(ids)]}
