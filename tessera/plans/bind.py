"""The corpus over the driver's tables: each role of the data model from one of them.

``SQL`` is the same binding for DuckDB, for the oracles.  orders are the records, customer assigns
them, lineitem links them with part (products, by brand), supplier (urls, by nation) and weaknesses;
documents are their texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times
from ..model import DERIVED, Corpus, Made
from ..model import once as made_once
from ..operators import bitmaps, layout, search
from ..sources import store


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: By application and folder: the bound tables as written.
_BOUND: dict[tuple[str, str], dict[str, DataFrame]] = {}
#: How each table is laid out: the column that its files are ranges of, if its readers look for ranges.
ORDER = {"cve_cwe": "cve_id", "cve_ref": "cve_id", "cve_prod": "cve_id", "cve_ver": "cve_id", "cve_text": "cve_id"}
#: Links that are grouped when they are bound.
GROUPED = ("cve_cwe", "cve_ref", "cve_prod")

#: Records lie along a curve through the columns that ranges are asked of, and are found by value with Bloom filters.
CURVE, SOUGHT = ["published", "cvss_score", "cna_id"], ("cve_id", "id")


def kept(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """A table that is made and written when it is first asked for."""
    held = _BOUND.setdefault((spark.sparkContext.applicationId, sf_dir), {})
    if name not in held:
        held[name] = store.written(make(), name)
    return held[name]


def once(spark: SparkSession, sf_dir: str, name: str, make):
    """What ``make`` gives, made when it is first asked for in an application."""
    held = _BOUND.setdefault((spark.sparkContext.applicationId, sf_dir), {})
    if name not in held:
        held[name] = make()
    return held[name]


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """The corpus as it is after a load: each table, and the index of the texts, is written when it is first asked for and read from there on."""
    held = _BOUND.setdefault((spark.sparkContext.applicationId, sf_dir), {})
    # Links are dealt in ranges of the record before they are grouped: a range then has all rows of a group, and they are shuffled once.
    source = views(spark, sf_dir, lambda df: df.repartitionByRange("cve_id"))

    def table(name: str):
        def get() -> DataFrame:
            if name not in held:
                df = getattr(source, name)
                path = f"{store.shared_dir(spark)}/bound-{uuid.uuid4().hex}/{name}"
                if name == "cve":
                    held[name] = layout.keep(df, path, CURVE, SOUGHT)
                else:
                    if name in ORDER:
                        df = (df if name in GROUPED else df.repartitionByRange(ORDER[name])).sortWithinPartitions(ORDER[name])
                    df.write.parquet(path)
                    held[name] = spark.read.schema(df.schema).parquet(path)
            return held[name]

        return get

    def postings() -> DataFrame:
        if "postings" not in held:
            held["postings"] = search.build(table("cve_text")(), "cve_id", list(search.FIELDS), f"{store.shared_dir(spark)}/bound-{uuid.uuid4().hex}/postings")
        return held["postings"]

    def axis(name: str) -> DataFrame | None:
        tables = Corpus(**{f.name: table(f.name) for f in fields(Corpus) if f.name not in DERIVED})
        if not bitmaps.dense(tables, name):
            return None
        df, at = bitmaps.axis(tables, name), f"{store.shared_dir(spark)}/bound-{uuid.uuid4().hex}/{name}"
        df.repartitionByRange("chunk").sortWithinPartitions("chunk", "bucket").write.parquet(at)
        return spark.read.schema(df.schema).parquet(at)

    def bits() -> Made:
        if "bits" not in held:
            held["bits"] = Made({n: lambda n=n: axis(n) for n in bitmaps.AXES})
        return held["bits"]

    return Corpus(**{f.name: table(f.name) for f in fields(Corpus) if f.name not in DERIVED}, postings=postings, bits=bits)


#: Characters of an identifier before its number, and digits that the binding leaves of that.
HEAD, DIGITS = len("CVE-1999-"), 7


def whole(c: Corpus) -> Corpus:
    """The corpus with all digits of the key in its identifiers, as deltas speak of records by identifier; the binding leaves seven, which longer keys share."""

    def named(df: DataFrame, identifier: str, key: Column) -> DataFrame:
        return df.withColumn(identifier, F.when(key < 10**DIGITS, F.col(identifier)).otherwise(F.concat(F.substring(identifier, 1, HEAD), key.cast("string"))))

    # An entry of the overlay has its key in its name, also where it names no record.
    return c.having(cve=made_once(lambda: named(c.cve, "cve_id", F.col("id"))), kev=made_once(lambda: named(c.kev, "cve", F.expr("cast(substring(name, 2) as bigint)"))))


def shown(identifier: Column) -> Column:
    """A whole identifier as the binding has it."""
    return F.substring(identifier, 1, HEAD + DIGITS)


def views(spark: SparkSession, sf_dir: str, dealt: Callable[[DataFrame], DataFrame] = lambda df: df) -> Corpus:
    """The binding itself; a table's plan is made when it is asked for.  ``dealt``: how links lie before they are grouped."""
    t = lambda name: load(spark, sf_dir, name)
    key = F.col("o_orderkey")
    at = times.seconds("o_orderdate")
    severity = F.expr("case o_orderpriority when '1-URGENT' then 4 when '2-HIGH' then 3 when '3-MEDIUM' then 2 when '5-LOW' then 1 end")
    cve = lambda: t("orders").select(
        key.alias("id"),
        F.concat(F.lit("CVE-"), F.date_format("o_orderdate", "yyyy"), F.lit("-"), F.lpad(key.cast("string"), 7, "0")).alias("cve_id"),
        (F.lit(1990) + key % 12).cast("int").alias("year"),
        F.when(F.col("o_orderstatus") == "P", 2).otherwise(1).alias("state"),
        F.when(key % 17 != 0, F.col("o_custkey")).alias("cna_id"),
        F.when(key % 97 != 0, at).alias("published"),
        (at + (key % 400) * 86_400).alias("updated"),
        F.expr("case o_orderkey % 5 when 0 then 2 when 1 then 30 when 2 then 31 when 3 then 4 end").alias("cvss_ver"),
        F.when(severity.isNotNull(), F.col("o_totalprice")).alias("cvss_score"),
        severity.alias("cvss_sev"),
        F.concat(F.lit("CVSS:"), key.cast("string")).alias("cvss_vec"),
        (at - 86_400).alias("reserved"),
        F.when(key % 4 != 3, key % 4).cast("int").alias("ssvc_expl"),
        F.when(key % 3 != 2, key % 3).cast("int").alias("ssvc_auto"),
        F.when(key % 7 < 5, key % 2).cast("int").alias("ssvc_impact"),
    )
    items, part, supplier = (lambda: t("lineitem")), (lambda: t("part")), (lambda: t("supplier"))
    order, brand = F.col("l_orderkey").alias("cve_id"), F.regexp_extract("p_brand", r"(\d+)", 1).cast("long")
    kev_key = F.col("o_orderkey")
    text = lambda: t("documents").select(
        F.col("doc_id").alias("cve_id"),
        F.when(F.col("doc_id") % 23 != 0, F.col("text")).alias("descr"),
        F.col("source").alias("title"),
        F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("reason"),
    )
    status = F.min(F.expr("case l_returnflag when 'A' then 1 when 'R' then 3 end")).cast("int").alias("default_status")
    versions = lambda: items().select(
        order,
        F.col("l_partkey").alias("product_id"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(2).alias("status"),
        F.col("l_linenumber").cast("string").alias("version"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_shipdate").cast("date").cast("string")).alias("lt"),
        F.lit(None).cast("string").alias("lte"),
        (F.col("l_linenumber") % 3).cast("long").alias("vtype"),
    )
    weaknesses = lambda: supplier().select((F.col("s_suppkey") % 20).alias("id")).distinct()
    named = lambda df, prefix, name: df.withColumn(name, F.concat(F.lit(prefix), F.col("id").cast("string")))
    overlay = lambda: t("orders").filter(kev_key % 7 == 0).select(
        F.concat(F.lit("CVE-"), F.date_format("o_orderdate", "yyyy"), F.lit("-"), F.lpad(kev_key.cast("string"), 7, "0")).alias("cve"),
        F.when(kev_key % 35 != 0, kev_key).alias("cve_id"),
        F.lit("v").alias("vendor"),
        F.lit("p").alias("product"),
        F.concat(F.lit("n"), kev_key.cast("string")).alias("name"),
        F.lit("d").alias("descr"),
        F.lit("patch").alias("action"),
        F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 10), "yyyy-MM-dd").alias("added"),
        (at + 10 * 86_400).alias("added_at"),
        F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 31), "yyyy-MM-dd").alias("due"),
        (at + 31 * 86_400).alias("due_at"),
        F.expr("case o_orderkey % 3 when 0 then 1 when 1 then 0 end").cast("int").alias("ransomware"),
        F.lit("note; https://example.org/n").alias("notes"),
        F.array(F.lit("CWE-1")).alias("cwes"),
    )
    return Corpus(
        cve=lambda: cve(),
        cve_text=lambda: text(),
        cve_cwe=lambda: dealt(items().select(order, (F.col("l_suppkey") % 20).alias("cwe_id"))).distinct(),
        cve_ref=lambda: dealt(items().select(order, F.col("l_suppkey").alias("url_id"))).distinct(),
        cve_prod=lambda: dealt(items().select(order, F.col("l_partkey").alias("product_id"), "l_returnflag")).groupBy("cve_id", "product_id").agg(status),
        cve_ver=lambda: versions(),
        cna=lambda: t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")),
        cwe=lambda: named(named(weaknesses(), "CWE-", "cwe"), "Weakness ", "descr"),
        vendor=lambda: part().select(brand.alias("id"), F.col("p_brand").alias("name")).distinct(),
        product=lambda: part().select(F.col("p_partkey").alias("id"), brand.alias("vendor_id"), F.col("p_name").alias("name")),
        host=lambda: t("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")),
        url=lambda: named(supplier().select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("host_id")), "https://example.org/", "url").select("id", "url", "host_id"),
        vtype=lambda: spark.sql("SELECT * FROM VALUES (0L, 'semver'), (1L, 'custom'), (2L, 'git') AS t(id, name)"),
        kev=lambda: overlay(),
    )


SQL = """
cve AS (SELECT o_orderkey id, 'CVE-' || strftime(o_orderdate, '%Y') || '-' || lpad(o_orderkey::VARCHAR, 7, '0') cve_id,
  (1990 + o_orderkey % 12)::INT "year", CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END state,
  CASE WHEN o_orderkey % 17 <> 0 THEN o_custkey END cna_id,
  CASE WHEN o_orderkey % 97 <> 0 THEN epoch(o_orderdate)::BIGINT END published,
  epoch(o_orderdate)::BIGINT + (o_orderkey % 400) * 86400 updated,
  CASE o_orderkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 30 WHEN 2 THEN 31 WHEN 3 THEN 4 END cvss_ver,
  CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_totalprice END cvss_score,
  CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2 WHEN '5-LOW' THEN 1 END cvss_sev,
  'CVSS:' || o_orderkey::VARCHAR cvss_vec, epoch(o_orderdate)::BIGINT - 86400 reserved,
  CASE WHEN o_orderkey % 4 <> 3 THEN (o_orderkey % 4)::INT END ssvc_expl, CASE WHEN o_orderkey % 3 <> 2 THEN (o_orderkey % 3)::INT END ssvc_auto,
  CASE WHEN o_orderkey % 7 < 5 THEN (o_orderkey % 2)::INT END ssvc_impact FROM orders),
cve_text AS (SELECT doc_id cve_id, CASE WHEN doc_id % 23 <> 0 THEN text END descr, source title, CASE WHEN doc_id % 2 = 0 THEN lang END reason FROM documents),
cve_cwe AS (SELECT DISTINCT l_orderkey cve_id, l_suppkey % 20 cwe_id FROM lineitem),
cve_ref AS (SELECT DISTINCT l_orderkey cve_id, l_suppkey url_id FROM lineitem),
cve_prod AS (SELECT l_orderkey cve_id, l_partkey product_id, min(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 3 END) default_status FROM lineitem GROUP BY 1, 2),
cve_ver AS (SELECT l_orderkey cve_id, l_partkey product_id, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 2 END status, l_linenumber::VARCHAR version,
  CASE WHEN l_linenumber % 2 = 0 THEN strftime(l_shipdate, '%Y-%m-%d') END lt, NULL::VARCHAR lte, (l_linenumber % 3)::BIGINT vtype FROM lineitem),
cna AS (SELECT c_custkey id, c_name AS name FROM customer),
cwe AS (SELECT DISTINCT s_suppkey % 20 id, 'CWE-' || (s_suppkey % 20)::VARCHAR cwe, 'Weakness ' || (s_suppkey % 20)::VARCHAR descr FROM supplier),
vendor AS (SELECT DISTINCT regexp_extract(p_brand, '(\\d+)', 1)::BIGINT id, p_brand AS name FROM part),
product AS (SELECT p_partkey id, regexp_extract(p_brand, '(\\d+)', 1)::BIGINT vendor_id, p_name AS name FROM part),
host AS (SELECT n_nationkey::BIGINT id, n_name AS name FROM nation),
url AS (SELECT s_suppkey id, 'https://example.org/' || s_suppkey::VARCHAR url, s_nationkey::BIGINT host_id FROM supplier),
vtype AS (SELECT * FROM (VALUES (0, 'semver'), (1, 'custom'), (2, 'git')) t(id, name)),
kev AS (SELECT 'CVE-' || strftime(o_orderdate, '%Y') || '-' || lpad(o_orderkey::VARCHAR, 7, '0') cve, CASE WHEN o_orderkey % 35 <> 0 THEN o_orderkey END cve_id,
  'v' vendor, 'p' product, 'n' || o_orderkey::VARCHAR AS name, 'd' descr, 'patch' "action", strftime(o_orderdate + INTERVAL 10 DAY, '%Y-%m-%d') added, epoch(o_orderdate)::BIGINT + 864000 added_at,
  strftime(o_orderdate + INTERVAL 31 DAY, '%Y-%m-%d') due, epoch(o_orderdate)::BIGINT + 31 * 86400 due_at,
  CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END ransomware, 'note; https://example.org/n' notes, ['CWE-1'] cwes FROM orders WHERE o_orderkey % 7 = 0)
"""


def oracle(select: str) -> str:
    """DuckDB SQL over the bound tables; ``select`` may begin with further ``name AS (...),`` parts ended by a line with SELECT."""
    head, mark, body = select.partition("\nSELECT ")
    if mark and " AS (" in head:
        return f"WITH {SQL.strip()},\n{head.strip().rstrip(',')}\nSELECT {body}"
    return f"WITH {SQL.strip()}\n{select.strip()}"
