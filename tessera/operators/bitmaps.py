"""Which records each bucket of an axis has, as bitmaps: counts of distinct records without a DISTINCT.

An axis whose links may give a record several buckets (a vendor, a weakness, a host) is kept as one
bitmap for each bucket and chunk of CHUNK ids that has any.  A record is a bit, however often it is
linked, so a cell of a cross-tab is the number of bits that its two buckets' bitmaps and that of the
matching records have in common, chunk by chunk; only chunks are joined, and no links are brought
together with links.

Bitmaps pay where buckets are full: an axis is kept if its bitmaps have DENSE records each on
average.  Others (products, of which a chunk has a few records each) are counted by their links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Corpus
from . import dims as D

#: Ids of one bitmap, as Spark's functions have it, and the records that bitmaps of a kept axis have on average.
CHUNK, DENSE = 32_768, 64
AXES = ("vendor", "cwe", "host")


def packed(rows: DataFrame, *by: str) -> DataFrame:
    """by, chunk, bits of the ids of some rows."""
    chunk = F.bitmap_bucket_number("id").alias("chunk")
    return rows.groupBy(*by, chunk).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))


def _links(corpus: Corpus, axis: str) -> DataFrame:
    d = D.dim(axis)
    return D.links(corpus, d.join).select("id", d.key().alias("bucket"))


def dense(corpus: Corpus, axis: str) -> bool:
    links = _links(corpus, axis)
    n, bitmaps = links.agg(F.count("*"), F.approx_count_distinct(F.struct("bucket", F.bitmap_bucket_number("id")))).first()
    return n >= DENSE * bitmaps > 0


def axis(corpus: Corpus, name: str) -> DataFrame:
    """bucket, chunk, bits of an axis."""
    return packed(_links(corpus, name), "bucket")


def maintain(bits: dict[str, DataFrame], after: Corpus, ids: DataFrame) -> dict[str, DataFrame]:
    """Kept axes after some records (id) have changed: the chunks that hold any are made anew."""
    chunks = ids.select(F.bitmap_bucket_number("id").alias("chunk")).distinct()
    out = {}
    for name, df in bits.items():
        links = _links(after, name).withColumn("chunk", F.bitmap_bucket_number("id")).join(chunks, "chunk", "left_semi")
        out[name] = df.join(chunks, "chunk", "left_anti").select("bucket", "chunk", "bits").unionByName(packed(links, "bucket"))
    return out


def meet(a: DataFrame, b: DataFrame, *by: str) -> DataFrame:
    """by, chunk, bits: what the bitmaps of two tables have in common, for each pair of them of one chunk."""
    other = b.withColumnRenamed("bits", "bits_b")
    pairs = a.join(other, "chunk").select(*by, "chunk", F.explode(F.array("bits", "bits_b")).alias("bits"))
    return pairs.groupBy(*by, "chunk").agg(F.bitmap_and_agg("bits").alias("bits"))


def counted(rows: DataFrame, *by: str) -> DataFrame:
    """by, cves: how many records the bitmaps have; none that has none."""
    return rows.groupBy(*by).agg(F.sum(F.bitmap_count("bits")).alias("cves")).filter("cves > 0")


def usable(corpus: Corpus, axes: list[D.Dim]) -> bool:
    """Whether all axes of these that may give a record several buckets are kept, and there is one."""
    many = [d for d in axes if d.multiplies]
    return bool(many) and corpus.has("bits") and all(d.name in corpus.bits for d in many)


def placed(corpus: Corpus, records: DataFrame, d: D.Dim, name: str, found: DataFrame) -> DataFrame:
    """name, chunk, bits of an axis over the matching records: kept bitmaps cut by those of the records (``found``), others made of the records."""
    if d.multiplies:
        return meet(corpus.bits[d.name].select(F.col("bucket").alias(name), "chunk", "bits"), found, name)
    return packed(D.placed(corpus, records, {name: d}), name)
