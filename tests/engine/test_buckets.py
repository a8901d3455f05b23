"""Revisions in buckets, the stream of deltas, segments of the index, and what rotation deletes."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tessera.model import SCHEMAS
from tessera.operators import search, segments
from tessera.sources import store
from tessera.streaming import buckets as B
from tessera.streaming import changes as C

from .corpus import make

HIGH = dict.fromkeys(C.LOOKUPS, 10**9)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def same(a, b):
    return all(rows(getattr(a, n).select(getattr(b, n).columns)) == rows(getattr(b, n)) for n in [*SCHEMAS] if n != "kev") and rows(a.kev.drop("cwes")) == rows(b.kev.drop("cwes"))


def next_one(c, rev):
    """The next revision: record 1 is rescored and loses its links, 2 goes, a new one (40 + rev) comes with a text, and a weakness is described anew."""
    new = c.cve.filter("id = 4").withColumns({"id": F.lit(40 + rev).cast("long"), "cve_id": F.lit(f"CVE-2025-00{40 + rev}")})
    cve = c.cve.filter("id <> 2").withColumn("cvss_score", F.when(F.col("id") == 1, F.lit(float(rev))).otherwise(F.col("cvss_score"))).unionByName(new)
    text = c.cve_text.filter("cve_id not in (1, 2)").unionByName(c.cve_text.sparkSession.createDataFrame([(40 + rev, f"fresh overflow {rev}", None, None), (1, f"rewritten {rev}", "the title", None)], SCHEMAS["cve_text"]))
    tables = {n: getattr(c, n).filter("cve_id not in (1, 2)") for n in C.LINKS if n != "cve_text"}
    cwe = c.cwe.withColumn("descr", F.when(F.col("id") == 2, F.lit(f"told {rev}")).otherwise(F.col("descr")))
    after = c.having(cve=cve, cve_text=text, cwe=cwe, **tables)
    after = after.having(kev=C.resolve(c.kev, cve))
    changes = [("CVE-2021-44228", "changed"), (f"CVE-2025-00{40 + rev}", "added")] + [("CVE-2022-0002", "deleted")] * (c.cve.filter("id = 2").count())
    delta = C.extract(c, after, c.cve.sparkSession.createDataFrame(changes, "cve_id string, kind string"), rev, rev + 1, HIGH)
    return after, delta


@pytest.fixture(scope="module")
def chain(spark, tmp_path_factory):
    """Four revisions of the five records and the deltas between them, on disk."""
    deltas = str(tmp_path_factory.mktemp("deltas"))
    out = [make(spark)]
    for rev in (1, 2, 3):
        after, delta = next_one(out[-1], rev)
        C.write_delta(delta, deltas)
        out.append(after)
    return out, deltas


def test_a_delta_rewrites_the_buckets_it_touches(spark, tmp_path, chain):
    revisions, deltas = chain
    path = f"{tmp_path}/copy"
    B.create(revisions[0], path, 1, width=2)
    before = B.manifest(spark, path)["tables"]
    assert same(B.load(spark, path), revisions[0])
    done = B.advance(spark, path, C.read_delta(spark, deltas, 1, 2))
    # Records 1, 2 and 41: buckets 0, 1 and 20; weakness 2: bucket 1; the overlay, as a record of it went.
    assert done == B.Advanced(2, {n: [0, 1, 20] for n in ("cve", *C.LINKS)} | {"cwe": [1], "kev": [0]}, 2, 1, 1)
    after = B.manifest(spark, path)["tables"]
    assert {n for n in before if before[n] == after[n]} == {"cna", "vendor", "product", "host", "url", "vtype"}
    assert before["cve"]["2"] == after["cve"]["2"] and before["cve"]["0"] != after["cve"]["0"]
    assert same(B.load(spark, path), revisions[1]) and same(B.load(spark, path, 1), revisions[0])
    with pytest.raises(C.Refused):  # again, or one that begins elsewhere
        B.advance(spark, path, C.read_delta(spark, deltas, 1, 2))
    assert B.current(spark, path) == 2


def test_of_two_writers_one_is_refused(spark, tmp_path, chain):
    revisions, deltas = chain
    path = f"{tmp_path}/copy"
    B.create(revisions[0], path, 1)
    told = B.manifest(spark, path)
    delta = C.read_delta(spark, deltas, 1, 2)
    assert store.put_new(spark, f"{path}/log/{2:020d}", json.dumps(told | {"rev": 2}))  # the other one is first
    with pytest.raises(C.Refused):
        B._commit(spark, path, told | {"rev": 2})
    with pytest.raises(C.Refused):
        B.advance(spark, path, delta)
    assert not store.put_new(spark, f"{path}/log/{2:020d}", "x") and json.loads(store.get(spark, f"{path}/log/{2:020d}"))["rev"] == 2
    with pytest.raises(C.Refused):
        B.create(revisions[0], path, 1)


def test_stream_applies_each_delta_once_in_any_order_and_after_a_crash(spark, tmp_path, chain, monkeypatch):
    revisions, deltas = chain
    path, arrive, check = f"{tmp_path}/copy", f"{tmp_path}/in", f"{tmp_path}/ck"
    os.makedirs(arrive)

    def deliver(a, b):
        import shutil

        shutil.copytree(f"{deltas}/from={a}/to={b}", f"{arrive}/from={a}/to={b}")

    B.create(revisions[0], path, 1, width=2, indexed=True)
    deliver(2, 3)
    B.follow(spark, path, arrive, check).awaitTermination()
    assert B.current(spark, path) == 1  # it waits for the one before it
    deliver(1, 2)
    # The step commits both revisions, then the process dies before the stream's checkpoint knows of it.
    put = store.put

    def dies(spark, at, text):
        if at.endswith("/waiting"):
            raise RuntimeError("lost")
        put(spark, at, text)

    monkeypatch.setattr(store, "put", dies)
    with pytest.raises(Exception, match="lost"):
        B.follow(spark, path, arrive, check).awaitTermination()
    assert B.current(spark, path) == 3
    monkeypatch.setattr(store, "put", put)
    written = sorted(os.listdir(f"{path}/cve"))
    B.follow(spark, path, arrive, check).awaitTermination()
    assert B.current(spark, path) == 3 and sorted(os.listdir(f"{path}/cve")) == written
    deliver(3, 4)
    B.follow(spark, path, arrive, check).awaitTermination()
    copy = B.load(spark, path)
    assert B.current(spark, path) == 4 and same(copy, revisions[3])
    assert search.drift(copy.postings, search.postings(revisions[3].cve_text, "cve_id", list(search.FIELDS))).count() == 0
    assert [r.doc for r in search.find(copy.postings, "rewritten").collect()] == [1]


def test_a_refused_delta_stops_the_stream_before_it(spark, tmp_path, chain):
    revisions, _ = chain
    path, deltas = f"{tmp_path}/copy", f"{tmp_path}/in"
    B.create(revisions[0], path, 1)
    after, good = next_one(revisions[0], 1)
    C.write_delta(good, deltas)
    bad = next_one(after, 2)[1]
    C.write_delta(C.Delta(2, 3, bad.lookups, {**bad.tables, "cve": bad.tables["cve"].unionAll(bad.tables["cve"])}, bad.gone), deltas)
    for _ in range(2):
        with pytest.raises(Exception, match="contradicts itself"):
            B.follow(spark, path, deltas, f"{tmp_path}/ck").awaitTermination()
        assert B.current(spark, path) == 2 and same(B.load(spark, path), after)


def test_rotation_deletes_what_nothing_kept_names(spark, tmp_path, chain):
    import shutil

    revisions, published = chain
    path, deltas = f"{tmp_path}/copy", f"{tmp_path}/deltas"
    shutil.copytree(published, deltas)
    B.create(revisions[0], path, 1, width=2, indexed=True)
    for a in (1, 2, 3):
        B.advance(spark, path, C.read_delta(spark, deltas, a, a + 1))
    assert B.rotate(spark, path, deltas, 2) == ([3, 4], [(3, 4)]) and B.published(spark, deltas) == [(3, 4)]
    assert same(B.load(spark, path), revisions[3]) and same(B.load(spark, path, 3), revisions[2])
    for table in ("cve", "cwe", "kev", segments.FOLDER):
        named = {f.split("/")[1] for r in (3, 4) for f in ([s["at"] for s in B.manifest(spark, path, r)["index"]] if table == segments.FOLDER else B.manifest(spark, path, r)["tables"][table].values())}
        assert set(os.listdir(f"{path}/{table}")) == named
    assert B.rotate(spark, path, deltas, 1, protected=3) == ([3, 4], [(3, 4)])
    with pytest.raises(C.Refused):
        B.load(spark, path, 1)


def test_segments_are_merged_by_size_and_speak_for_their_documents(spark, tmp_path):
    table = lambda rows: spark.createDataFrame(rows, "cve_id long, descr string, title string")
    path = str(tmp_path)
    truth = {i: (f"word{i % 7} common text", "t") for i in range(200)}
    held = [segments.segment(path, table([(i, *x) for i, x in truth.items()]), "cve_id")]
    sizes = []
    for step in range(9):
        changed = {i: (f"step{step} common", None) for i in range(step * 3, step * 3 + 4)}
        gone = [150 + step]
        truth.update(changed)
        truth.pop(gone[0])
        touched = spark.createDataFrame([(i,) for i in [*changed, *gone]], "doc long")
        held = segments.merged(spark, path, [*held, segments.segment(path, table([(i, *x) for i, x in changed.items()]), "cve_id", touched)])
        sizes.append(len(held))
        rebuilt = search.postings(table([(i, *x) for i, x in truth.items()]), "cve_id", list(search.FIELDS))
        assert search.drift(segments.postings(spark, path, held), rebuilt).count() == 0
        assert {r.doc: r.tokens for r in segments.docs(spark, path, held).collect()} == {i: len(a.split()) + (b is not None) for i, (a, b) in truth.items()}
    assert max(sizes) <= 4 and 1 < min(sizes) and held[0]["whole"]
    # A term is still found by the statistics of each segment.
    plan = segments.postings(spark, path, held).filter("term = 'common'")._jdf.queryExecution().toString()
    assert plan.count("EqualTo(term,common)") == len(held)


def test_reach():
    assert B.reached([(3, 4), (1, 2), (2, 3), (6, 7)], 1) == 4 and B.reached([], 5) == 5 and B.reached([(1, 9), (9, 12), (2, 3)], 1) == 12
