import pytest

from tessera.plans import catalogue, catalogue_more, catalogue_store

from ..oracle import agree

SF = "/root/testdata/sf0.001"
# One of each kind, besides all of the two modules below that take no long; the driver holds all of them against their SQL.
LONG = {"delta_sync", "pending_run", "hosted_copy", "revision_round_trip", "guard_limits", "kev_feed", "guards", "delta_apply_buckets", "delta_stream", "delta_stream_lookups", "delta_stream_overlay", "fts_segments", "id_drift"}
CHOSEN = ["flt_combined_and", "flt_overlay_attr_arms", "flt_text", "rows_full_kev", "grp_week", "grp_product", "grp_time_cap_recent", "x_vendor_cwe", "x_kevRansomware_ssvcExpl", "bq_product_drilldown", "detail_versions", "coverage_extents", "fts_phrase", "fts_maintain", "catalog_product_group", "gap_fill_window", "csv_guard", "etl_star_links", "intern_new_ids", "delta_apply_links", "closure_missing", "sql_window", "token_eviction"]


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


@pytest.mark.parametrize("name", [*CHOSEN, *sorted({**catalogue_more.QUERIES, **catalogue_store.QUERIES}.keys() - LONG)])
def test_query_agrees_with_its_sql(spark, name):
    agree(catalogue.queries()[name](spark, SF), catalogue.oracle_sql()[name], SF)
