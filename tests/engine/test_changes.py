import datetime as dt
import json

import pytest

from tessera.operators import etl
from tessera.sources import kev as K
from tessera.sources import records
from tessera.streaming import changes as C
from tessera.streaming import streams

from .corpus import make


def record(n, **own):
    meta = {"cveId": f"CVE-2026-{n}", "state": "PUBLISHED", "assignerShortName": "acme", "datePublished": "2026-01-02T00:00:00Z", "dateUpdated": "2026-01-03T00:00:00.000Z"} | own.pop("meta", {})
    cna = {"title": f"T{n}", "descriptions": [{"lang": "en", "value": "one"}, {"lang": "en-GB", "value": "two"}, {"lang": "fr", "value": "non"}], "affected": [{"vendor": "V", "product": "gizmo", "defaultStatus": "unknown", "versions": [{"status": "affected", "version": "1"}] * 2}], "references": [{"url": "https://A.example:8080/x"}, {"url": "javascript:x"}], "problemTypes": [{"descriptions": [{"cweId": "CWE-79", "description": "XSS"}]}], "metrics": [{"cvssV3_1": {"baseScore": 7.5, "baseSeverity": "HIGH", "vectorString": "v"}}]} | own.pop("cna", {})
    return {"cveMetadata": meta, "containers": {"cna": cna, "adp": own.pop("adp", [])}}


def projections(spark, *rows):
    raw = spark.createDataFrame([(f"p{i}", r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(rows)], "path string, text string")
    good, skipped = etl.parsed(raw)
    return etl.normalized(good), skipped


class Store:
    """Generations on disk, as a run has them: each is built from the one before."""

    def __init__(self, spark, tmp_path):
        self.spark, self.path, self.corpus, self.marks, self.n = spark, str(tmp_path), None, None, 0

    def build(self, *rows):
        self.n += 1
        projections(self.spark, *rows)[0].write.parquet(f"{self.path}/projection/{self.n}")
        self.projection = self.spark.read.parquet(f"{self.path}/projection/{self.n}")
        corpus, self.marks = etl.build(self.projection, self.corpus, self.marks)
        C.save(corpus, f"{self.path}/built", self.n)
        self.corpus = C.load(self.spark, f"{self.path}/built", self.n)
        return self.corpus


V1 = (record(1001, adp=[{"metrics": [{"other": {"type": "ssvc", "content": {"options": [{"Exploitation": "poc"}, {"Automatable": "yes"}]}}}]}]), record(1002, meta={"state": "REJECTED"}, cna={"affected": [], "descriptions": [], "rejectedReasons": [{"lang": "en", "value": "dup"}], "metrics": []}))
V2 = (record(1001, cna={"affected": [{"vendor": "V", "product": "gadget", "defaultStatus": "affected"}, {"vendor": "V", "product": "gizmo", "defaultStatus": "unaffected"}, {"vendor": "V", "product": "gizmo", "defaultStatus": "unknown"}]}), record(1003, cna={"references": [{"url": "https://b.example/"}]}))


def test_normalize(spark):
    df, skipped = projections(spark, *V1, "not json", json.dumps({"cveMetadata": {"cveId": "CVE-1"}}), json.dumps(V1[0]))
    rows = {r.cve_id: r for r in df.collect()}
    a, b = rows["CVE-2026-1001"], rows["CVE-2026-1002"]
    assert (a.descr, a.cvss_ver, a.cvss_score, a.cvss_sev, a.ssvc_expl, a.ssvc_auto, a.ssvc_impact) == ("one\ntwo", 31, 7.5, 3, 1, 1, None)
    assert [tuple(p) for p in a.products] == [("V", "gizmo", 3)] and len(a.versions) == 2 and a.refs == ["https://A.example:8080/x", "javascript:x"]
    assert (b.state, b.reason, b.descr, b.cvss_ver) == (2, "dup", None, None)
    assert sorted(tuple(r) for r in skipped.collect()) == [("p2", "not a record"), ("p3", "no usable id"), ("p4", "id seen before")]


def by_name(corpus):
    """The corpus without ids."""
    c = corpus
    name = dict((r.id, r.cve_id) for r in c.cve.collect())
    vendor = {r.id: r.name for r in c.vendor.collect()}
    product = {r.id: (vendor[r.vendor_id], r.name) for r in c.product.collect()}
    url = {r.id: r.url for r in c.url.collect()}
    return {
        "cve": sorted((r.cve_id, r.state, r.cvss_score, r.updated) for r in c.cve.collect()),
        "prod": sorted((name[r.cve_id], *product[r.product_id], r.default_status) for r in c.cve_prod.collect()),
        "ref": sorted((name[r.cve_id], url[r.url_id]) for r in c.cve_ref.collect()),
        "ver": sorted((name[r.cve_id], *product[r.product_id], r.status, r.version) for r in c.cve_ver.collect()),
        "text": sorted((name[r.cve_id], r.descr, r.title, r.reason) for r in c.cve_text.select("cve_id", "descr", "title", "reason").collect()),
    }


def test_ids_are_stable_and_never_given_again(spark, tmp_path):
    store = Store(spark, tmp_path)
    one, marks = store.build(*V1), store.marks
    again = store.build(*V1)
    assert store.marks.high == marks.high and etl.fingerprint(again.product) == etl.fingerprint(one.product)
    two = store.build(*V2)
    old, new = ({r.name: r.id for r in c.product.collect()} for c in (one, two))
    assert new["gizmo"] == old["gizmo"] and new["gadget"] == marks.high["product"] + 1
    assert {r.cve_id: r.id for r in two.cve.collect()}["CVE-2026-1001"] == {r.cve_id: r.id for r in one.cve.collect()}["CVE-2026-1001"]
    # Hosts that go and return get new ids.
    store.build(record(1003, cna={"references": []}))
    assert min(r.id for r in store.build(*V2).host.collect()) > max(r.id for r in two.host.collect())


@pytest.fixture(scope="module")
def step(spark, tmp_path_factory):
    """Two generations and the delta between them."""
    store = Store(spark, tmp_path_factory.mktemp("store"))
    one, p1, marks = store.build(*V1), store.projection, store.marks
    two = store.build(*V2)
    changes = C.diff(etl.content_hash(p1), etl.content_hash(store.projection))
    return one, two, changes, C.extract(one, two, changes, 1, 2, marks.high)


def test_syncing_equals_loading_anew(spark, tmp_path, step):
    one, two, changes, delta = step
    assert {tuple(r) for r in changes.collect()} == {("CVE-2026-1001", "changed"), ("CVE-2026-1002", "deleted"), ("CVE-2026-1003", "added")}
    copy, deltas = f"{tmp_path}/copy", f"{tmp_path}/deltas"
    C.save(one, copy, 1)
    C.write_delta(delta, deltas)
    assert C.sync(spark, copy, deltas, [(1, 2)], 2) == [2] and C.current(spark, copy) == 2
    assert by_name(C.load(spark, copy)) == by_name(two)
    assert C.sync(spark, copy, deltas, [(1, 2)], 2) == []
    with pytest.raises(C.Refused):
        C.check(delta, C.load(spark, copy), 2)


def test_bad_deltas_are_refused(step):
    one, _, changes, delta = step
    C.check(delta, one, 1)
    holes = C.Delta(1, 2, {**delta.lookups, "product": delta.lookups["product"].limit(0)}, delta.tables, delta.gone)
    twice = C.Delta(1, 2, delta.lookups, {**delta.tables, "cve": delta.tables["cve"].unionAll(delta.tables["cve"])}, delta.gone)
    for bad in (holes, twice):
        with pytest.raises(C.Refused):
            C.check(bad, one, 1)
    with pytest.raises(C.Refused):
        C.guard_deletions(changes, 2)
    C.guard_deletions(changes, 2, 0.5)
    with pytest.raises(C.Refused):
        C.cross_check(records=(1, 2))


def test_a_run_that_breaks_off_leaves_the_current_revision(spark, tmp_path, step):
    one, two, _, delta = step
    copy, deltas = f"{tmp_path}/copy", f"{tmp_path}/deltas"
    C.save(one, copy, 1)
    broken = two.having(host=two.host.selectExpr("raise_error('lost') id", "name"))
    with pytest.raises(Exception, match="lost"):
        C.save(broken, copy, 2)
    assert C.current(spark, copy) == 1 and by_name(C.load(spark, copy)) == by_name(one)
    assert len(C.tidy(spark, copy)) == 1 and by_name(C.load(spark, copy)) == by_name(one)
    # A table that isn't what the envelope says is refused before anything is applied.
    C.write_delta(delta, deltas)
    with pytest.raises(C.Refused):
        C.write_delta(delta, deltas)
    spark.createDataFrame([("CVE-2026-9999",)], "cve_id string").write.mode("append").parquet(f"{deltas}/from=1/to=2/gone")
    with pytest.raises(C.Refused, match="gone isn't"):
        C.sync(spark, copy, deltas, [(1, 2)], 2)
    assert C.current(spark, copy) == 1


def test_the_index_follows_a_delta(spark, step):
    from tessera.operators import search

    one, two, _, delta = step
    index = lambda c: search.postings(c.cve_text, "cve_id", list(search.FIELDS))
    after = C.apply(one.having(postings=index(one)), delta)
    assert search.drift(after.postings, index(after)).count() == 0


def test_a_table_of_the_result_asks_for_its_own_only(spark):
    def never():
        raise AssertionError("asked for")

    c = make(spark).having(**{n: never for n in (*C.LOOKUPS, *C.LINKS, "postings")})
    changes = spark.createDataFrame([("CVE-2021-44228", "deleted"), ("CVE-2022-0002", "changed")], "cve_id string, kind string")
    after = C.apply(c, C.extract(c, c, changes, 1, 2, {}))
    assert after.cve.count() == 4 and K.unmatched(after.kev).first().unmatched == 2


def test_a_build_interns_what_is_asked_for(spark, monkeypatch):
    asked, plain = [], etl._space
    monkeypatch.setattr(etl, "_space", lambda seed, table, *more: asked.append(table) or plain(seed, table, *more))
    c, marks = etl.build(projections(spark, *V1)[0])
    assert c.url.join(c.host.selectExpr("id host_id", "name"), "host_id").count() > 0 and set(asked) == {"host", "url"}
    assert marks.high["host"] == c.host.count() and len(asked) == 2


def test_saved_links_are_shuffled_once(spark):
    c = make(spark)
    for name in C.LINK_KEYS:
        df = C.laid(name, getattr(c, name).union(getattr(c, name)))
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
        assert sorted(map(str, df.collect())) == sorted(map(str, getattr(c, name).collect()))


def test_sync_plans():
    assert C.plan_sync([(1, 2), (2, 3)], 1, 3) == [(1, 2), (2, 3)]
    assert C.plan_sync([(1, 3), (1, 2), (2, 4)], 1, 4) == [(1, 2), (2, 4)]
    assert C.plan_sync([(1, 2), (1, 3), (2, 4), (3, 4)], 1, 4) == [(1, 3), (3, 4)]
    assert C.plan_sync([], 4, 4) == [] and C.plan_sync([(1, 2)], 2, 3) is None
    assert C.untiled([(1, 3), (1, 2), (2, 4)], 4) == [3] and C.retained([1, 2, 3, 4], 2, 1) == [1, 3, 4]


def test_promotion(spark):
    c = make(spark)
    assert C.promotable(c, 1, 2, "notice") == [] and C.promotable(c, 3, 2, " ") == ["no notice", "revision beyond the head"]


NOW = dt.datetime(2026, 2, 1, tzinfo=dt.UTC)


def test_catalog(spark):
    c = make(spark)
    catalog = K.sample(c.cve, 3)
    kev = K.load(spark, json.dumps(catalog).encode(), c.cve, NOW)
    assert kev.count() == 5 and K.unmatched(kev).first().unmatched == 2
    assert {r.ransomware: r.entries for r in K.histogram(kev).collect()} == {1: 2, 0: 2, None: 1}
    entry = catalog["vulnerabilities"]
    for bad in (
        {**catalog, "count": 4}, {**catalog, "vulnerabilities": [], "count": 0}, {**catalog, "dateReleased": "2027-01-01T00:00:00Z"}, {**catalog, "catalogVersion": "x"},
        {**catalog, "vulnerabilities": [*entry[:4], entry[0]]}, {**catalog, "vulnerabilities": [*entry[:4], {**entry[4], "dateAdded": "2026-02-30"}]}, {**catalog, "vulnerabilities": [*entry[:4], {**entry[4], "cveID": "CVE-1"}]},
    ):
        with pytest.raises(C.Refused):
            K.load(spark, json.dumps(bad).encode(), c.cve, NOW)
    with pytest.raises(C.Refused):
        K.load(spark, b"{", c.cve, NOW)
    assert K.is_newer("2026.02.01", "2026.01.31") and K.is_newer("2026.1.1", "2026.01.01") and not K.is_newer("2025.12.31", "2026.01.01") and K.is_newer("2026.1", "odd") and not K.is_newer("odd", None)


def test_record_files(spark, tmp_path):
    folder = tmp_path / "cves" / "2026" / "1xxx"
    folder.mkdir(parents=True)
    (folder / "CVE-2026-1001.json").write_text(json.dumps(V1[0]))
    (folder / "CVE-2026-1002.json").write_text("[]")
    (folder / "delta.json").write_text("{}")
    good, skipped = records.records(spark, str(tmp_path))
    assert [r.cve_id for r in good.collect()] == ["CVE-2026-1001"] and [r.reason for r in skipped.collect()] == ["not a record"]


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([(i % 5, dt.datetime(2024, 1, 1 + i), "a") for i in range(10)], "event_id long, ts timestamp_ntz, event_type string")
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    seen = []
    for _ in range(2):  # the second run has nothing new
        streams.each_batch_once(stream, f"{tmp_path}/ck", lambda df, n: seen.append((n, df.count())), lambda: max([n for n, _ in seen], default=-1)).awaitTermination()
    assert seen == [(0, 10)]
    want = {("2024-01-01", 7), ("2024-01-08", 3)}
    assert {(r.bucket, r.events) for r in streams.counts_by_window(events).collect()} == want
    q = streams.counts_by_window(stream).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.bucket, r.events) for r in spark.sql("select * from w").collect()} == want
    assert streams.deduplicated(events).count() == 5
