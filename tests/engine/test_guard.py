"""What ad-hoc SQL may be made of: one accepted call of each function that a user of the data expects, and what a query may cost."""

import pytest

from tessera.plans import guard

from .corpus import make

TS = "timestamp_seconds(published)"
ACCEPTED = [
    "substring(cve_id, 1, 3)", "instr(cve_id, '-')", "length(cve_id)", "upper(cve_id)", "lower(cve_id)", "trim(cve_id)", "ltrim(cve_id)", "rtrim(cve_id)", "replace(cve_id, 'a', 'b')",
    "format_string('%d', id)", "hex(id)", "unhex('41')", "char(65)", "ascii('a')", "coalesce(cvss_sev, 0)", "ifnull(cvss_sev, 0)", "nullif(state, 2)", "if(state = 1, 'a', 'b')",
    "abs(id)", "round(cvss_score, 1)", "sign(id)", "least(id, 2)", "greatest(id, 2)", "cve_id rlike 'x'", "cve_id ilike 'x%'", "get_json_object('{}', '$.a')", "from_json('[1]', 'array<int>')",
    f"year({TS})", f"date_format({TS}, 'yyyy-MM')", f"date_add(to_date({TS}), 3)", f"date_sub({TS}, 3)", f"datediff({TS}, {TS})", f"extract(year FROM {TS})", "from_unixtime(published)", f"unix_timestamp({TS})",
    f"date_trunc('week', {TS})", f"trunc({TS}, 'MM')", f"quarter({TS})", f"month({TS})", f"weekofyear({TS})", f"dayofweek({TS})", f"last_day({TS})", f"add_months({TS}, 1)", f"months_between({TS}, {TS})",
    "make_date(2024, 2, 29)", "to_timestamp('2024-01-01')", "try_to_timestamp('x')", "current_date()", "now()", f"{TS} + interval 1 day", f"unix_seconds({TS})", f"next_day({TS}, 'MON')", f"timestampadd(DAY, 1, {TS})",
    "row_number() OVER (ORDER BY id)", "rank() OVER (ORDER BY id)", "dense_rank() OVER (ORDER BY id)", "ntile(2) OVER (ORDER BY id)", "lag(id) OVER (ORDER BY id)", "lead(id) OVER (ORDER BY id)",
    "first_value(id) OVER (ORDER BY id)", "last_value(id) OVER (ORDER BY id)", "nth_value(id, 2) OVER (ORDER BY id)", "typeof(id)", "sha2(cve_id, 256)", "uuid()", "bitmap_bit_position(id)",
]
AGGREGATES = ["count(*)", "sum(id)", "coalesce(sum(cast(id AS double)), 0.0)", "avg(id)", "min(id)", "max(id)", "listagg(cve_id, ',')", "to_json(collect_list(id))", "count(*) FILTER (WHERE state = 1)", "approx_count_distinct(id)", "hll_sketch_estimate(hll_sketch_agg(id))", "bitmap_count(bitmap_construct_agg(bitmap_bit_position(id)))", "percentile(id, 0.5)", "max_by(id, state)"]
PIPES = ["FROM cve |> WHERE state = 1 |> SELECT id", "FROM cve |> AGGREGATE count(*) AS n GROUP BY state |> ORDER BY n |> LIMIT 2", "FROM cve |> EXTEND id + 1 AS k |> DROP state |> AS t |> JOIN vendor v ON v.id = t.id |> SELECT k"]
REFUSED = ["FROM cve |> WHERE java_method('java.lang.System', 'nanoTime') > 0", "FROM text.`/etc/hostname`", "FROM other |> SELECT 1", "SELECT input_file_name() FROM cve", "SELECT spark_partition_id() FROM cve", "SELECT current_user()", "SELECT raise_error('x')", "SELECT from_avro(x, 'y') FROM cve", "SELECT aes_decrypt(cve_id, 'k') FROM cve"]


@pytest.fixture(scope="module")
def corpus(spark):
    return make(spark)


def together(functions):
    return f"SELECT {', '.join(f'{f} AS x{i}' for i, f in enumerate(functions))} FROM cve"


@pytest.mark.parametrize("statement", [together(ACCEPTED), together(AGGREGATES), *PIPES])
def test_accepted(spark, corpus, statement):
    guard.frame(spark, corpus, statement)


@pytest.mark.parametrize("statement", REFUSED)
def test_refused(spark, corpus, statement):
    with pytest.raises(guard.Denied):
        guard.frame(spark, corpus, statement)


def test_date_functions_answer(spark, corpus):
    got = guard.run(spark, corpus, f"SELECT year({TS}) y, date_format({TS}, 'yyyy-MM-dd') d FROM cve WHERE id = 1")
    assert got.rows == [(2021, "2021-12-10")]


def test_what_a_query_may_cost(spark, corpus, tmp_path):
    tables = {}
    for n in ("cve", "cve_prod", "cve_ref", "host"):
        getattr(corpus, n).write.parquet(f"{tmp_path}/{n}")
        tables[n] = spark.read.parquet(f"{tmp_path}/{n}")
    c = corpus.having(**tables)
    nested = lambda sql: guard.cost(guard.frame(spark, c, sql)).nested
    assert nested("SELECT * FROM cve_prod p JOIN cve_ref r ON p.cve_id = r.cve_id AND p.product_id < r.url_id") == []
    assert len(nested("SELECT * FROM cve_prod CROSS JOIN cve_ref")) == 1 and len(nested("SELECT * FROM cve_prod p JOIN cve_ref r ON p.cve_id < r.cve_id")) == 1
    assert len(nested("SELECT id, (SELECT count(*) FROM cve_prod p CROSS JOIN cve_ref) FROM cve")) == 1
    for bad, limits in (("SELECT * FROM cve_prod CROSS JOIN cve_ref", {"nested": 10}), ("SELECT * FROM cve", {"read": 10})):
        with pytest.raises(guard.Denied):
            guard.afford(guard.frame(spark, c, bad), **limits)
    assert len(guard.run(spark, c, "SELECT c.id FROM cve c CROSS JOIN host").rows) == 10
    with pytest.raises(guard.Denied):
        guard.run(spark, c, "SELECT id FROM cve", read=10)


def test_what_is_told_of_limits_holds_of_more_records_than_a_hosted_query_may_have(spark, monkeypatch):
    from tessera.plans.catalogue_more import _guarded

    monkeypatch.setitem(guard.HOSTED, "rows", 3)
    told = dict(_guarded(make(spark)))
    assert told["hosted"] == "True" and told["cells"] == "[50, 4]"
