"""Kept indexes of names against plain search, and after changes."""

import random

import pytest

from tessera.operators import names

TEXTS = ["a", "ab", "abc", "b c", " ABCA ", "é", "é b", "", "%", "_", "x" * 20, "abcabcabcabcabcabc", "'", "zz"]


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, name string, records long")


@pytest.fixture(scope="module")
def some():
    rng = random.Random(8)
    return [(i, "".join(rng.choice("abcAB é%_") for _ in range(rng.randint(0, 24))), rng.randint(0, 5)) for i in range(1, 700)] + [(900, "abcabcabcabcabcabcabc", 2), (901, None, 1), (902, "ABC", 0), (903, "abc ", 9)]


def clean(name):
    return (name or "").lower().strip(" ")


def ahead(rows, text, limit):
    t = text.strip().lower()
    found = [(i, n, r, 3 if clean(n) == t else 2) for i, n, r in rows if n is not None and t and clean(n).startswith(t)]
    return sorted(found, key=lambda x: (-x[3], -x[2], x[1], x[0]))[:limit]


def test_what_a_name_has_in_it(spark, tmp_path, some):
    df = table(spark, some)
    index = names.keep_grams(df, f"{tmp_path}/g")
    for text in TEXTS:
        t = text.strip().lower()
        want = {i for i, n, _ in some if not t or (n is not None and t in clean(n))}
        assert {r.id for r in names.having(index, df, text).collect()} == want, text
    plan = names.having(index, df, "abca")._jdf.queryExecution().toString()
    assert "In(gram" in plan
    changed, gone = [(5, "new name", 1), (2_000, "another", 1)], [(7,)]
    kept = names.maintain_grams(index, table(spark, changed), spark.createDataFrame(gone, "id long"))
    after = [r for r in some if r[0] not in (5, 7)] + changed
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, names.grams(table(spark, after)).collect()))


def test_beginnings_and_type_ahead(spark, tmp_path, some):
    df = table(spark, some)
    kept = names.keep_beginnings(df, f"{tmp_path}/b")
    for text in TEXTS:
        for limit in (3, 25, 60):
            got = [tuple(r) for r in names.type_ahead(kept, df, text, limit).collect()]
            assert got == (ahead(some, text, limit) if text.strip() else []), (text, limit)
    assert kept.groupBy("prefix").count().agg({"count": "max"}).first()[0] <= names.BEST
    after = [(i, "abc" + (n or "") if i % 9 == 0 else n, r + (i % 4 == 0)) for i, n, r in some if i % 13]
    touched = spark.createDataFrame([(i,) for i, _, _ in some if i % 9 == 0 or i % 4 == 0 or i % 13 == 0], "id long")
    now = names.maintain_beginnings(kept, df, table(spark, after), touched)
    assert sorted(map(tuple, now.collect())) == sorted(map(tuple, names.beginnings(table(spark, after)).collect()))


def test_empty_tables(spark):
    none = table(spark, [])
    assert names.grams(none).count() == 0 and names.beginnings(none).count() == 0
    assert names.having(names.grams(none), none, "a").count() == 0 and names.type_ahead(names.beginnings(none), none, "a").count() == 0
