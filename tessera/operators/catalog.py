"""Vendor and product pickers: how much each name stands for, and search among the names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Corpus
from . import names


def products(corpus: Corpus) -> DataFrame:
    """id, vendor_id, name and how many records each product has."""
    n = corpus.cve_prod.groupBy("product_id").agg(F.count("*").alias("records"))
    return corpus.product.join(n.withColumnRenamed("product_id", "id"), "id", "left").select("id", "vendor_id", "name", F.coalesce("records", F.lit(0)).cast("long").alias("records"))


def vendors(corpus: Corpus) -> DataFrame:
    """A vendor counts what its products count."""
    n = products(corpus).groupBy("vendor_id").agg(F.sum("records").alias("records"))
    return corpus.vendor.join(n.withColumnRenamed("vendor_id", "id"), "id", "left").select("id", "name", F.coalesce("records", F.lit(0)).cast("long").alias("records"))


def tier(name: Column, text: str) -> Column:
    """3: the same; 2: begins so; 1: has it; 0: hasn't."""
    name, text = F.lower(name), text.strip().lower()
    return F.when(name == text, 3).when(name.startswith(text), 2).when(F.instr(name, text) > 0, 1).otherwise(0)


def search_vendors(corpus: Corpus, text: str, limit: int = 25, index: DataFrame | None = None) -> DataFrame:
    """``index``: the pieces of the vendors' names, if they are kept; then only what has the text is counted."""
    if index is not None:
        some = names.having(index, corpus.vendor, text)
        corpus = corpus.having(vendor=some, product=corpus.product.join(some.select(F.col("id").alias("vendor_id")), "vendor_id", "left_semi").select(corpus.product.columns))
        corpus = corpus.having(cve_prod=_of(corpus))
    found = vendors(corpus).withColumn("tier", tier(F.col("name"), text)).filter(F.col("tier") > 0)
    return found.orderBy(F.desc("tier"), F.desc("records"), "name", "id").limit(limit).select("id", "name", "records", "tier")


def _of(corpus: Corpus) -> DataFrame:
    """The links of the products that there are."""
    return corpus.cve_prod.join(corpus.product.select(F.col("id").alias("product_id")), "product_id", "left_semi").select(corpus.cve_prod.columns)


def search_products(corpus: Corpus, text: str, vendor_ids: list[int] | None = None, limit: int = 25, index: DataFrame | None = None) -> DataFrame:
    """Products by lower-cased name, those of all vendors (or the given ones) together; ``index``: the pieces of their names, if they are kept."""
    if index is not None:
        corpus = corpus.having(product=names.having(index, corpus.product, text))
        corpus = corpus.having(cve_prod=_of(corpus))
    found = products(corpus)
    if vendor_ids is not None:
        found = found.filter(F.col("vendor_id").isin(vendor_ids))
    merged = found.groupBy(F.lower("name").alias("key")).agg(F.min("name").alias("name"), F.sum("records").alias("records"), F.count_distinct("vendor_id").alias("vendors"))
    merged = merged.withColumn("tier", tier(F.col("key"), text)).filter(F.col("tier") > 0)
    return merged.orderBy(F.desc("tier"), F.desc("records"), "key").limit(limit).select("name", "records", "vendors", "tier")
