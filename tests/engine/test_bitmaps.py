"""Counts from kept bitmaps are the counts from links, also after a delta."""

import pytest
from pyspark.sql import functions as F

from tessera.model import Made
from tessera.operators import bitmaps
from tessera.operators import dims as D
from tessera.operators import reports as R
from tessera.operators.filters import Filters
from tessera.plans import bind
from tessera.streaming import changes as C

from .corpus import make
from .test_buckets import next_one


def with_bits(c):
    return c.having(bits={a: bitmaps.axis(c, a) for a in bitmaps.AXES})


@pytest.fixture(scope="module")
def both(spark):
    """The corpus of five with far ids as well: links of a second chunk, and repeated ones of one vendor and one host."""
    c = make(spark)
    far = lambda df, key: df.unionByName(df.withColumn(key, F.col(key) + 100_000))
    c = c.having(
        cve=c.cve.unionByName(c.cve.withColumns({"id": F.col("id") + 100_000, "cve_id": F.concat("cve_id", F.lit("9"))})),
        **{n: far(getattr(c, n), "cve_id") for n in ("cve_prod", "cve_cwe", "cve_ref")},
    )
    return c, with_bits(c)


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(("a", "b"), [("vendor", "cwe"), ("cwe", "host"), ("host", "severity"), ("severity", "vendor"), ("kev", "cwe"), ("vendor", "product")])
def test_cross_tabs_agree(both, a, b):
    plain, kept = both
    filters = Filters(severity=(4,), state="all")
    assert rows(R.cross(kept, filters, a, b)) == rows(R.cross(plain, filters, a, b))
    assert rows(R.cross(kept, Filters(), a, b, 1, 2)) == rows(R.cross(plain, Filters(), a, b, 1, 2))


def test_groups_agree_and_read_no_links(both):
    plain, kept = both
    for a in bitmaps.AXES:
        assert rows(R.group(kept, Filters(state="all"), a)) == rows(R.group(plain, Filters(state="all"), a))
    assert rows(R.group(kept, Filters(cve_id="CVE-1-1"), "vendor")) == []


def test_bitmaps_follow_a_delta_and_go_with_their_links(spark):
    c = with_bits(make(spark))
    after, delta = next_one(make(spark), 1)
    got = C.apply(c, delta)
    assert set(got.bits) == set(bitmaps.AXES)
    for a, df in got.bits.items():
        want = bitmaps.axis(after, a)
        assert sorted(map(str, rows(df.select(want.columns)))) == sorted(map(str, rows(want)))
    assert c.having(cve_prod=c.cve_prod.limit(1)).bits is None and c.having(cna=c.cna).bits is not None


def test_only_full_axes_are_kept(spark, monkeypatch):
    c = make(spark)
    assert not bitmaps.dense(c, "vendor")
    monkeypatch.setattr(bitmaps, "DENSE", 1)
    assert bitmaps.dense(c, "vendor") and not bitmaps.dense(c.having(cve_prod=c.cve_prod.limit(0)), "vendor")


def test_an_axis_is_made_when_it_is_asked_for(spark):
    c, asked = make(spark), []
    lazy = c.having(bits=Made({a: lambda a=a: asked.append(a) or (bitmaps.axis(c, a) if a != "cwe" else None) for a in bitmaps.AXES}))
    assert bitmaps.usable(lazy, [D.dim("vendor")]) and not bitmaps.usable(lazy, [D.dim("cwe")]) and asked == ["vendor", "cwe"]


def test_links_are_shuffled_once(spark):
    c = bind.views(spark, "/root/testdata/sf0.001", lambda df: df.repartitionByRange("cve_id"))
    for name in bind.GROUPED:
        plan = getattr(c, name).sortWithinPartitions("cve_id")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1, plan
