"""Deltas over tables whose keys have more digits than the binding leaves in an identifier."""

import os

import duckdb
import pytest

from tessera.plans import bind, catalogue
from tessera.plans import catalogue_store as S
from tessera.streaming import changes as C

from ..oracle import TABLES, agree

SF = "/root/testdata/sf0.001"
FIRST, SHIFTS = 200, (0, 1_000_000, 10_000_000)


@pytest.fixture(scope="module")
def long_keys(tmp_path_factory):
    """The first orders three times, so that records of the first and the last tenth of the ids, and of the last among themselves, share identifiers."""
    path, con = str(tmp_path_factory.mktemp("long")), duckdb.connect()
    for t in TABLES:
        if key := {"orders": "o_orderkey", "lineitem": "l_orderkey"}.get(t):
            rows = " UNION ALL ".join(f"SELECT * REPLACE ({key} + {n} AS {key}) FROM '{SF}/{t}.parquet' WHERE {key} < {FIRST}" for n in SHIFTS)
            con.execute(f"COPY ({rows}) TO '{path}/{t}.parquet' (FORMAT parquet)")
        else:
            os.symlink(f"{SF}/{t}.parquet", f"{path}/{t}.parquet")
    return path


def test_whole_identifiers_name_a_record_each(spark, long_keys):
    c = bind.corpus(spark, long_keys)
    whole = bind.whole(c)
    assert c.cve.select("cve_id").distinct().count() < whole.cve.select("cve_id").distinct().count() == FIRST * len(SHIFTS)
    for a, b in ((whole.cve.select("id", bind.shown(whole.cve.cve_id)), c.cve.select("id", "cve_id")), (whole.kev.select("name", bind.shown(whole.kev.cve)), c.kev.select("name", "cve"))):
        assert not a.exceptAll(b).count() and not b.exceptAll(a).count()
    assert whole.kev.join(whole.cve, [whole.kev.cve == whole.cve.cve_id, whole.kev.cve_id == whole.cve.id], "left_semi").count() == whole.kev.filter("cve_id is not null").count()


def test_deltas_over_long_keys_are_sound(spark, long_keys):
    before, *deltas = S._steps(bind.corpus(spark, long_keys))
    for delta in deltas:
        assert delta.tables["cve"].count() and not C.problems(delta).count() and not C.pairing(delta, before).count()


def test_the_stream_applies_deltas_over_long_keys(spark, long_keys):
    for name in ("delta_stream_lookups", "delta_stream", "delta_stream_overlay"):
        agree(catalogue.queries()[name](spark, long_keys), catalogue.oracle_sql()[name], long_keys)


@pytest.mark.parametrize("name", ["delta_apply_records", "delta_apply_links", "delta_apply_overlay", "closure_missing", "delta_problems", "delta_pairing", "delta_sync"])
def test_other_deltas_over_long_keys_agree_with_their_sql(spark, long_keys, name):
    agree(catalogue.queries()[name](spark, long_keys), catalogue.oracle_sql()[name], long_keys)
