"""The files of a generation follow its bytes, not its buckets."""

import os

from pyspark.sql import functions as F

from tessera.streaming import buckets as B


def test_many_buckets_share_files(spark, tmp_path):
    links = spark.range(1, 2_001).select(F.col("id").alias("cve_id"), (F.col("id") % 7).alias("cwe_id"))
    made = B._write(links, str(tmp_path), "cve_cwe", 2)
    assert len(made) == 1_001 and len({*made.values()}) == 1
    assert sum(n.endswith(".parquet") for _, _, names in os.walk(tmp_path) for n in names) < 20
    for wanted in ({b: f for b, f in made.items() if int(b) % 3 == 0}, {b: f for b, f in made.items() if 10 <= int(b) < 20 or int(b) == 40}):
        found = B._read(spark, str(tmp_path), "cve_cwe", wanted, 2)
        assert sorted(r.cve_id for r in found.collect()) == [i for i in range(1, 2_001) if str(i // 2) in wanted]
