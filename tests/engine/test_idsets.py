"""Sets of ids, and what they spare a delta."""

from tessera.operators import idsets
from tessera.sources import store
from tessera.streaming import changes as C

from .corpus import make


def test_a_set_has_its_ids_only(spark):
    held = [-130, -64, -63, -1, 0, 1, 62, 63, 64, 65, 4_095, (1 << 53) - 1, 1 << 62]
    asked = sorted({i + d for i in held for d in (-64, -1, 0, 1, 64)})
    ids = spark.createDataFrame([(i,) for i in held * 3] + [(None,)], "id long")
    rows = spark.createDataFrame([(i, str(i)) for i in asked] + [(None, "none")], "key long, name string")
    made = idsets.made(ids)
    assert made.count() == len({i >> 6 for i in held})
    for threshold in ("10m", "-1"):  # sent to all tasks, and shuffled
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            assert sorted(r.key for r in idsets.within(rows, made, "key").collect()) == held
            assert sorted(r.name for r in idsets.without(rows, made, "key").collect()) == sorted(["none", *(str(i) for i in asked if i not in held)])
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert idsets.within(rows, idsets.made(ids.limit(0)), "key").count() == 0
    assert idsets.without(rows, idsets.made(ids.limit(0)), "key").count() == len(asked) + 1


def test_links_are_not_shuffled_by_a_delta(spark):
    """Once the ids are too many to be sent as rows, links stay where they lie all the same."""
    base, n = make(spark), 60_000
    cve = spark.range(1, n + 1).selectExpr("id", "concat('CVE-2020-', lpad(id, 7, '0')) cve_id", *[f"cast(null as {f.dataType.simpleString()}) {f.name}" for f in base.cve.schema if f.name not in ("id", "cve_id")])
    links = spark.range(1, n + 1).selectExpr("id cve_id", "id % 7 product_id", "cast(1 as int) default_status")
    cve, links = store.written(cve, "cve"), store.written(links, "links")
    held = base.having(cve=cve, cve_prod=links, kev=None)
    after = held.having(cve=cve.filter("id % 13 <> 5"), cve_prod=links.filter("cve_id % 13 <> 5 and (cve_id % 6 <> 0 or product_id > 0)"))
    changes = cve.filter("id % 13 = 5").selectExpr("cve_id", "'deleted' kind").union(cve.filter("id % 13 <> 5 and id % 6 = 0").selectExpr("cve_id", "'changed' kind"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "40k")
    try:
        got = C.apply(held, C.extract(held, after, changes, 1, 2, {})).cve_prod
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan, plan
        assert sorted(map(tuple, got.collect())) == sorted((i, i % 7, 1) for i in range(1, n + 1) if i % 13 != 5 and (i % 6 or i % 7))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
