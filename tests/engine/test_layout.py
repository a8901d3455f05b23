"""What a range reads of a table that lies along the curve, and fingerprints of ranges."""

import glob
import os
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.operators import digests, layout


def groups(path):
    """Row groups of all files: (rows, {column: (least, greatest)})."""
    out = []
    for f in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            rg = meta.row_group(g)
            stats = {rg.column(c).path_in_schema: rg.column(c).statistics for c in range(rg.num_columns)}
            out.append((rg.num_rows, {k: (s.min, s.max) if s is not None and s.has_min_max else None for k, s in stats.items()}))
    return out


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('layout')}/t"
    rng = random.Random(9)
    rows = [(i, f"CVE-{i}", rng.choice([None, rng.randrange(10**9)]), rng.random() * 10, rng.randrange(400), "x" * 40) for i in range(60_000)]
    df = spark.createDataFrame(rows, "id long, name string, published long, score double, cna long, pad string")
    return rows, layout.keep(df, path, ["published", "score", "cna"], ("name",), 64 << 10), path


def test_a_range_of_any_column_reads_few_row_groups(written):
    rows, df, path = written
    found = groups(path)
    assert sum(n for n, _ in found) == len(rows) and len(found) >= 30
    for column, low, high in (("published", 0, 5 * 10**7), ("score", 2.0, 2.5), ("cna", 30, 45)):
        read = sum(n for n, s in found if s[column] and s[column][0] <= high and s[column][1] >= low)
        assert read <= 0.45 * len(rows), (column, read)
    # Both at once: what is left is the product.
    read = sum(n for n, s in found if s["score"][0] <= 2.5 and s["score"][1] >= 2.0 and s["cna"][0] <= 45 and s["cna"][1] >= 30)
    assert read <= 0.2 * len(rows)
    assert sorted(map(tuple, df.collect()), key=str) == sorted(rows, key=str)
    assert df.filter("score between 2.0 and 2.5 and cna = 31").count() == sum(2.0 <= r[3] <= 2.5 and r[4] == 31 for r in rows)


def test_filters_are_of_the_size_of_their_groups(written):
    _, df, path = written
    files = [(os.path.getsize(f), pq.ParquetFile(f).metadata) for f in glob.glob(f"{path}/*.parquet")]
    data = sum(m.row_group(g).column(c).total_compressed_size for _, m in files for g in range(m.num_row_groups) for c in range(m.num_columns))
    assert sum(n for n, _ in files) < 2 * data
    assert df.filter("name = 'CVE-77'").count() == 1


def test_places_and_odd_columns(spark):
    df = spark.createDataFrame([(i, None, float(i % 7)) for i in range(200)], "a long, b long, `c.d` double").withColumnRenamed("c.d", "cd")
    got = layout.interleaved(df, ["a", "b", "cd"])
    assert got.columns == ["a", "b", "cd", "place"] and got.filter("place is null").count() == 0
    ranks = {r.a: r.place for r in layout.interleaved(df, ["a"]).collect()}
    assert ranks[0] == 0 and ranks[199] == 63 and all(ranks[i] <= ranks[i + 1] for i in range(199))
    assert layout.interleaved(df.limit(0), ["a"]).count() == 0


def copies(spark, n=50_000):
    df = spark.range(n).select("id", (F.col("id") * 7).alias("v"), F.when(F.col("id") % 3 != 0, F.col("id").cast("string")).alias("s"))
    return df, df.filter("id <> 17").withColumn("v", F.when(F.col("id").isin(9_000, 9_001, 49_999), -1).otherwise(F.col("v"))).unionByName(spark.createDataFrame([(10**7, 1, "new")], "id long, v long, s string"))


def test_drift_names_the_ranges_and_the_rows(spark):
    a, b = copies(spark)
    one, two = digests.tree(a, leaf=100).cache(), digests.tree(b.orderBy(F.desc("v")).repartition(7), leaf=100).cache()
    got = sorted(map(tuple, digests.drift(one, two, leaf=100).collect()))
    assert got == [(0, 99, 100, 99), (9_000, 9_099, 100, 100), (49_900, 49_999, 100, 100), (10**7, 10**7 + 99, 0, 1)]
    rows = digests.drifted(a, b, digests.drift(one, two, leaf=100), leaf=100).select("id", "copy").collect()
    assert sorted(map(tuple, rows)) == [(17, 1), (9_000, 1), (9_000, 2), (9_001, 1), (9_001, 2), (49_999, 1), (49_999, 2), (10**7, 2)]
    assert digests.drift(one, digests.tree(a.repartition(3), leaf=100), leaf=100).count() == 0
    none = digests.tree(a.limit(0), leaf=100)
    assert digests.drift(none, none, leaf=100).count() == 0 and digests.drift(one, none, leaf=100).count() == 500


def test_the_top_is_all_that_equal_copies_compare(spark):
    t = digests.tree(copies(spark)[0], leaf=100)
    levels = {r.level: r.n for r in t.groupBy("level").agg(F.count("*").alias("n")).collect()}
    assert levels[0] == 500 and levels[1] == 32 and levels[7] == 1
