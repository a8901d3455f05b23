"""A page that is sought is the page that an offset gives."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import paging
from tessera.operators import reports as R
from tessera.operators.filters import Filters

from .corpus import make


@pytest.fixture(scope="module")
def lists(spark):
    rng = random.Random(6)
    values = [(i, rng.choice([None, 7.0, 7.0, 7.0, rng.random() * 10, rng.random() * 1e9, -3.5]), rng.choice([None, 5, 5, rng.randrange(-(10**12), 10**12)])) for i in range(5_000)]
    return values, spark.createDataFrame(values, "id long, score double, at long").repartition(5).cache()


def page(rows, column, skip, take):
    k = 1 if column == "score" else 2
    order = sorted(rows, key=lambda r: (r[k] is not None, r[k] if r[k] is not None else 0, r[0]), reverse=True)
    return [r[0] for r in order[skip : skip + take]]


def test_pages_of_every_kind(lists):
    rows, df = lists
    for column in ("score", "at"):
        k = 1 if column == "score" else 2
        known = sum(r[k] is not None for r in rows)
        for skip, take in ((0, 10), (700, 40), (2_500, 300), (known - 5, 20), (known + 50, 10), (4_990, 50), (9_999, 5), (0, 5_000)):
            for few in (0, 30):
                found, rest = paging.window(df, column, skip, take, few=few)
                got = [r.id for r in found.orderBy(F.desc_nulls_last(column), F.desc("id")).offset(rest).limit(take).collect()]
                assert got == page(rows, column, skip, take), (column, skip, take, few)


def test_few_rows_are_left_to_sort(lists):
    rows, df = lists
    found, _ = paging.window(df, "at", 2_000, 20, few=30)
    assert found.count() <= 200
    ties, _ = paging.window(df.filter("score = 7.0"), "score", 900, 20, few=30)
    assert ties.count() <= 200


def test_reading_on_from_the_last_row(lists):
    rows, df = lists
    out, value, tie = [], None, None
    page_ = df.orderBy(F.desc_nulls_last("score"), F.desc("id")).limit(600).collect()
    while page_:
        out += [r.id for r in page_]
        value, tie = page_[-1].score, page_[-1].id
        page_ = paging.after(df, "score", value, tie).orderBy(F.desc_nulls_last("score"), F.desc("id")).limit(600).collect()
    assert out == page(rows, "score", 0, len(rows))


def test_lists_of_records(spark, monkeypatch):
    c = make(spark)
    want = [r.cve for r in R.rows(c, Filters(state="all")).collect()]
    assert [r.cve for r in R.rows(c, Filters(state="all"), 2, after=(c.cve.filter(F.col("cve_id") == want[1]).first().published, 1_000)).collect()][1:] == want[2:4]
    monkeypatch.setattr(R, "FAR", 1)
    for sort in ("published", "updated", "score", "cve"):
        every = [r.cve for r in R.rows(c, Filters(state="all"), 10, 0, sort).collect()]
        for skip in range(6):
            assert [r.cve for r in R.rows(c, Filters(state="all"), 2, skip, sort).collect()] == every[skip : skip + 3]
