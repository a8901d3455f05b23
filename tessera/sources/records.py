"""Raw records from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import etl


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, text of every record file below the folder; files of other names are left alone."""
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "CVE-*.json").option("wholetext", True)
    return read.text(path).selectExpr("_metadata.file_path path", "value text")


def records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Projections, and what was skipped with the reason."""
    good, skipped = etl.parsed(files(spark, path))
    return etl.normalized(good), skipped
