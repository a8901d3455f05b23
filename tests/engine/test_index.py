"""How the index is made: without a shuffle of tokens, in ranges, and only where a text has words."""

from pyspark.sql import functions as F

from tessera.operators import search

from .corpus import make

COLUMNS = ["descr", "title"]


def test_a_text_without_words_asks_for_no_index(spark):
    def never():
        raise AssertionError("the index was asked for")

    c = make(spark).having(postings=never)
    assert search.restrict(c, c.cve, "!!!").count() == 0


def test_tokens_are_grouped_where_they_stand(spark):
    table = spark.createDataFrame([(1, "b a b, a c", "a"), (2, "", None), (3, None, "Été b")], "cve_id long, descr string, title string")
    index = search.postings(table, "cve_id", COLUMNS)
    assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()
    found = sorted((r.term, r.doc, r.field, r.places) for r in index.collect())
    assert found == [("a", 1, "descr", [1, 3]), ("a", 1, "title", [0]), ("b", 1, "descr", [0, 2]), ("b", 3, "title", [1]), ("c", 1, "descr", [4]), ("ete", 3, "title", [0])]


def test_files_are_ranges_of_terms_and_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "RANGE", 100)
    monkeypatch.setattr(search, "DRAWN", 40)
    table = spark.range(200).select(F.col("id").alias("cve_id"), F.concat(F.lit("common w"), F.col("id") % 7, F.lit(" x"), "id").alias("descr"), F.lit("t").alias("title"))
    kept = search.build(table, "cve_id", COLUMNS, f"{tmp_path}/index")
    assert search.drift(kept, search.postings(table, "cve_id", COLUMNS)).count() == 0
    key = F.struct("term", "doc")
    files = kept.groupBy(F.input_file_name()).agg(F.min(key).alias("a"), F.max(key).alias("b"), F.count("*").alias("n")).orderBy("a").collect()
    assert len(files) > 4 and all(x.b < y.a for x, y in zip(files, files[1:], strict=False)) and max(f.n for f in files) < 400
