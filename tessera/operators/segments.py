"""An index of texts in segments that are never changed: a delta adds one, and small ones are merged.

A segment is a folder with ``postings`` (in the order of the terms), ``docs`` (doc, tokens: how long
each document is) and ``touched`` (doc): the documents that it speaks for, changed or gone.  What
older segments have of these no longer counts.  The first segment speaks for all there is and has no
``touched``.  The list of segments, oldest first, is kept by whoever owns the index.

``merged`` puts the newest segments together while they are no smaller than a FAN-th of the one
before them, so a posting is written again about log(size) times over its life, and a search reads
about as many segments.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import search

FOLDER, FAN = "index", 4
DOCS = "doc long, tokens long"


def _put(path: str, write: Callable[[str], DataFrame], docs: DataFrame, touched: DataFrame | None) -> dict:
    at = f"{FOLDER}/{uuid.uuid4().hex}"
    kept = write(f"{path}/{at}/postings")
    docs.write.parquet(f"{path}/{at}/docs")
    if touched is not None:
        touched.distinct().write.parquet(f"{path}/{at}/touched")
    return {"at": at, "rows": kept.count(), "whole": touched is None}


def segment(path: str, texts: DataFrame, id_column: str, touched: DataFrame | None = None, columns: tuple[str, ...] = search.FIELDS) -> dict:
    """Write a segment of these texts; ``touched``: the documents it speaks for (a column doc), all if None."""
    tokens = reduce(lambda a, b: a + b, [F.size(search.tokens(F.col(c))) for c in columns])
    docs = texts.select(F.col(id_column).cast("long").alias("doc"), tokens.cast("long").alias("tokens"))
    return _put(path, lambda to: search.build(texts, id_column, list(columns), to), docs, touched)


def _sound(spark: SparkSession, path: str, segments: list[dict], part: str, schema: str) -> DataFrame:
    """Rows of all segments that no later one speaks for."""
    rows = None
    for i, s in enumerate(segments):
        mine = spark.read.schema(schema).parquet(f"{path}/{s['at']}/{part}").withColumn("__segment", F.lit(i))
        rows = mine if rows is None else rows.unionByName(mine)
    later = [spark.read.schema("doc long").parquet(f"{path}/{s['at']}/touched").withColumn("__last", F.lit(i)) for i, s in enumerate(segments) if not s["whole"]]
    if later and len(segments) > 1:
        last = reduce(DataFrame.unionByName, later).groupBy("doc").agg(F.max("__last").alias("__last"))
        rows = rows.join(last, "doc", "left").filter(F.col("__last").isNull() | (F.col("__segment") >= F.col("__last")))
    return rows.select([c.split()[0] for c in schema.split(", ")])


def postings(spark: SparkSession, path: str, segments: list[dict]) -> DataFrame:
    """The postings that count, as ``search.find`` reads them; a search for terms reads their rows of each segment."""
    return _sound(spark, path, segments, "postings", search.INDEX)


def docs(spark: SparkSession, path: str, segments: list[dict]) -> DataFrame:
    """doc, tokens of the documents that there are."""
    return _sound(spark, path, segments, "docs", DOCS)


def merged(spark: SparkSession, path: str, segments: list[dict], fan: int = FAN) -> list[dict]:
    """The list after the newest segments have been put together where they are of a size; folders that it no longer names are left to their owner."""
    at, rows = len(segments), 0
    for i in range(len(segments) - 1, -1, -1):
        if i < len(segments) - 1 and rows * fan < segments[i]["rows"]:
            break
        at, rows = i, rows + segments[i]["rows"]
    if len(segments) - at < 2:
        return segments
    part = segments[at:]
    touched = None
    if not part[0]["whole"]:
        touched = reduce(DataFrame.unionByName, [spark.read.schema("doc long").parquet(f"{path}/{s['at']}/touched") for s in part])
    return [*segments[:at], _put(path, lambda to: search.keep(postings(spark, path, part), to), docs(spark, path, part), touched)]
