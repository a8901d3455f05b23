import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import times
from tessera.operators import budget, catalog, chart, search
from tessera.operators import reports as R
from tessera.operators.filters import Filters
from tessera.plans import guard, report, tools
from tessera.sources import sinks

from .corpus import make


@pytest.fixture(scope="module")
def corpus(spark):
    return make(spark)


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


def test_text_functions(spark):
    assert one(spark, T.strip_controls, "a\u0000\u202eb\nc\u200e\u061c") == "a b c\u200e\u061c"
    assert one(spark, T.strip_invisible, "a\u200bb\u2028\u202f\U000e0041c") == "a b   c"
    assert one(spark, T.csv_field, '=1+"x"') == "\"'=1+\"\"x\"\"\"" and one(spark, T.csv_field, None) == '""'
    assert one(spark, T.csv_field, "a\r\nb") == '"a b"' and one(spark, T.csv_field, "\u0001=cmd") == '" =cmd"'
    assert one(spark, T.sheet_cell, "-x\ty") == "'-x y" and one(spark, T.sheet_cell, "-5.2") == "'-5.2"
    assert one(spark, lambda c: T.sheet_cell(c, True), "-5.2") == "-5.2"
    assert one(spark, T.host, "HTTPS://u@Ex.org:8/p?q") == "u@ex.org:8" and one(spark, T.host, "javascript:x") == ""
    assert one(spark, T.safe_url, "javascript:alert(1)") is None and one(spark, T.safe_url, "http://a/b") == "http://a/b"
    assert one(spark, T.json_list, "[\"a\"]") == ["a"] and one(spark, T.json_list, "{") == []
    assert [tuple(x) for x in one(spark, T.notes, "a; see https://x/y now ;;")] == [("a", None), ("see https://x/y now", "https://x/y")]
    assert one(spark, times.day_seconds, "2024-02-30") is None and one(spark, times.day_seconds, "1969-12-31") == -86_400
    assert one(spark, times.iso_seconds, "2024-01-01T00:00:00Z") == 1_704_067_200 and one(spark, times.iso_seconds, "x") is None
    slash = chr(92)
    for text, good in (("plain", True), ("{s}ud83d{s}ude00", True), ("{s}ud83d x", False), ("{s}ude00", False), ("{s}{s}ud83d", True), ("{s}{s}{s}ud83d", False), ("{s}u00e9", True)):
        assert one(spark, T.storable, text.replace("{s}", slash)) is good, text


def test_search_terms():
    term = search.Term
    assert search.parse('"a b"* c*') == [term(("a", "b")), term(("c",), True)] and search.parse("!! --") is None
    assert search.fold("\u00c9l e\u0301t\u00e9 Vi\u1ec7t \u03ac \u010d\u017e") == ["el", "ete", "viet", "\u03b1", "cz"]


def test_index_finds_what_the_texts_have(spark, tmp_path):
    rows = [(1, "The quick brown fox", "on the hill"), (2, "quick, brown foxes e\u0301t\u00e9", None), (3, None, "brown quick"), (4, "the the quick-brown", "x")]
    table = spark.createDataFrame(rows, "cve_id long, descr string, title string")
    index = search.keep(search.postings(table, "cve_id", ["descr", "title"]), str(tmp_path / "i"), 3)
    for text in ("quick", "the hill", '"quick brown"', "quick-brown", "fox*", '"the quick"', '"quick brown fox"', "brown fo*", "ete", "\u00c9T\u00c9", "the-the*", '"hill the"', "nothing", "!!"):
        want = {r.cve_id for r in search.search(table, text, ["descr", "title"]).collect()}
        assert {r.doc for r in search.find(index, text).collect()} == want, text
    plan = index.filter("term = 'quick'")._jdf.queryExecution().toString()
    assert "EqualTo(term,quick)" in plan


def test_driver_functions():
    assert times.lenient_day("2025-02", True) == dt.date(2025, 2, 28) and times.lenient_day("20250304") == dt.date(2025, 3, 4) and times.lenient_day("2025-13") is None
    assert times.span(dt.date(2024, 1, 1), dt.date(2024, 1, 8), "week") == 2 and times.coarsen(dt.date(2000, 1, 1), dt.date(2024, 1, 1), "week", 300) == "month"
    assert times.years_back(dt.date(2024, 2, 29), 1) == dt.date(2023, 2, 27) and times.age_phrase(90_000) == "1 day old" and times.is_stale(3 * 86_400)
    assert times.freshness(100, 50)["age"] == 0 and not times.freshness(1, 5 * 86_400, times.KEV_STALE)["stale"] and times.freshness(None, 1) is None
    assert T.short_count(1_234_000) == "1.2M" and T.nice_ticks(7)[-1] >= 7 and T.slug("A b/c!") == "a-b-c" and T.inline("a = ? and b = '?'", ["o'x"]) == "a = 'o''x' and b = '?'"


def test_reports():
    value = {"v": 1, "title": "t", "rows": "month", "series": "severity", "filters": {"severity": [4, -1], "vendor": ["x"], "score_min": 7}}
    r = report.parse(value)
    assert report.from_fragment(report.to_fragment(r)) == r and report.row_cap(r) == 250
    for bad in ({**value, "v": 2}, {**value, "rows": "x"}, {**value, "series": "month"}, {**value, "more": 1}, {**value, "filters": {"nope": 1}}, {**value, "filters": {"severity": [9]}}, {**value, "filters": {"vendor": ["x"] * 201}}, {**value, "limit": 0}, []):
        with pytest.raises(report.Invalid):
            report.parse(bad)
    f = Filters(severity=(0, 4, -1), vendor=("a", "b"), published_from=1_704_067_200, published_to=1_704_067_200 + 86_399, score_min=7.0)
    assert report.from_form(report.to_form(f)) == f and len(report.chips(f)) == 5
    shelf = report.Shelf(most_recent=1)
    assert shelf.save(r) and shelf.save(r) and len(shelf.saved) == 1
    shelf.visit(r)
    assert len(shelf.recent) == 1


def test_guard(spark, corpus):
    got = guard.run(spark, corpus, "WITH t AS (SELECT state, count(*) n FROM cve GROUP BY state) SELECT * FROM t ORDER BY state")
    assert got.rows == [(1, 4), (2, 1)] and not got.truncated
    assert guard.run(spark, corpus, "SELECT id FROM cve", rows=2).truncated
    big = guard.run(spark, corpus, "SELECT repeat('x', 100) FROM cve", chars=150)
    assert len(big.rows) == 1 and big.overflowed
    assert guard.run(spark, corpus, "SELECT x FROM (SELECT array(1, 2) a) LATERAL VIEW explode(a) t AS x").rows == [(1,), (2,)]
    assert guard.run(spark, corpus, "SELECT x FROM cve LATERAL VIEW OUTER posexplode(array(id)) t AS p, x WHERE x = 3").rows == [(3,)]
    assert guard.run(spark, corpus, "SELECT a.id, b.id FROM cve a JOIN cve b ON a.id = b.id ORDER BY a.id").rows[0] == (1, 1)
    wide = guard.run(spark, corpus, "SELECT collect_list(descr) l, map('a', 'b') m, named_struct('x', 1) s, encode('abc', 'UTF-8') b FROM cve_text", cell=40)
    assert [len(x) for x in wide.rows[0]] == [40, 9, 7, 6]
    some = guard.run(spark, corpus, "SELECT repeat('x', 100) t FROM cve ORDER BY id", chars=250)
    assert len(some.rows) == 2 and some.truncated and some.overflowed
    for bad in (
        "DROP TABLE cve", "INSERT INTO cve SELECT * FROM cve", "SELECT * FROM text.`/etc/hostname`", "SELECT java_method('java.lang.System', 'nanoTime')", "SELECT (SELECT reflect('java.lang.System', 'nanoTime'))",
        "SET a=b", "CREATE TEMP VIEW v AS SELECT 1", "EXPLAIN SELECT 1", "SHOW TABLES", "SELECT 1; SELECT 2", "SELECT * FROM other", "SELECT * FROM cve WHERE EXISTS (SELECT 1 FROM secret)", "CACHE TABLE cve", "WITH t AS (SELECT * FROM secret) SELECT 1 FROM t",
        "SELECT IDENTIFIER('java_method')('java.lang.System', 'getProperty', 'user.dir')", "SELECT * FROM IDENTIFIER('cve')", "SELECT try_reflect('java.lang.System', 'nanoTime')", "SELECT input_file_name() FROM cve", "SELECT raise_error('x')", "SELECT * FROM sql_keywords()",
        "SELECT * FROM read_files('/etc')", "SELECT system.builtin.java_method('java.lang.System', 'nanoTime')", "SELECT current_user()", "SELECT x FROM (SELECT 1 a) LATERAL VIEW reflect('a', 'b') t AS x", "EXECUTE IMMEDIATE 'SELECT 1'", "BEGIN SELECT 1; END", "TABLE secret", "SELECT nope(1)",
    ):
        with pytest.raises(guard.Denied):
            guard.run(spark, corpus, bad)


def test_tools(spark, corpus):
    call = tools.parse_call("aggregate", '{"rows": "severity", "severity": "critical, medium", "kev": ["listed"]}')
    answer = tools.run(spark, corpus, call)
    assert sorted(r[::2][:2] for r in answer.rows) == [(2, 1), (4, 2)]
    assert "severity" not in tools.describe(answer) and tools.describe(answer).startswith("bucket\t")
    assert tools.run(spark, corpus, tools.parse_call("kev_lookup", {"cve": "CVE-2021-44228"}))["entry"].rows
    assert len(tools.run(spark, corpus, tools.parse_call("search_records", {"vendor": "Cisco"})).rows) == 2
    assert tools.run(spark, corpus, tools.parse_call("sql", {"query": "SELECT max(cvss_score) FROM cve"})).rows == [(10.0,)]
    assert tools.compute("return sum(r[0] for r in rows)", guard.Answer(["n"], [(1,), (2,)], False, False))[:2] == ("ok", "3")
    assert tools.compute("while True: pass", None, 0.5)[0] == "error"
    assert tools.unmatched_names(corpus, Filters(vendor=("Cisco", "Nobody"))) == {"vendor": ["nobody"]}
    for bad in (("nope", {}), ("sql", {}), ("sql", {"query": "x", "more": 1}), ("aggregate", {"rows": "x"}), ("search_records", {"severity": "awful"}), ("aggregate", "{")):
        with pytest.raises(tools.BadCall):
            tools.parse_call(*bad)


def cells(spark):
    rows = [("2025-01", 4, 10), ("2025-01", 2, 30), ("2025-01", None, 60), ("2025-02", 4, 5), ("2025-02", 3, 15)]
    return spark.createDataFrame(rows, "bucket string, series int, cves long")


def test_charts(spark):
    assert [r.series for r in chart.series_order(cells(spark), "severity").orderBy("place").collect()] == [4, 3, 2, None]
    assert {r.bucket: (r["4"], r["3"], r["null"]) for r in chart.matrix(cells(spark)).collect()} == {"2025-01": (10, 0, 60), "2025-02": (5, 15, 0)}
    counts = spark.createDataFrame([("2025-01", 1), ("2025-02", 2), ("2025-05", 3)], "bucket string, cves long")
    filled = lambda *a, **k: [(r.bucket, r.cves) for r in chart.fill_gaps(counts, "month", *a, **k).collect()]
    assert filled() == [("2025-01", 1), ("2025-02", 2), ("2025-03", 0), ("2025-04", 0), ("2025-05", 3)]
    assert filled(dt.date(2024, 11, 9), dt.date(2025, 6, 1))[::7] == [("2024-11", 0), ("2025-06", 0)]
    assert filled(dt.date(2024, 11, 9), cut=True)[0] == ("2025-01", 1) and len(filled(most=3)) == 3
    assert chart.fill_gaps(counts.limit(0), "month", dt.date(2024, 1, 1)).count() == 0
    odd = counts.unionByName(spark.createDataFrame([("soon", 1)], counts.schema))
    assert chart.fill_gaps(odd, "month").count() == 4
    null = counts.unionByName(spark.createDataFrame([(None, 9)], counts.schema))
    assert chart.fill_gaps(null, "month").first().cves == 9
    flags = {r.bucket: r.partial for r in chart.partial_flags(counts, "month", dt.date(2025, 1, 1), dt.date(2025, 5, 30)).collect()}
    assert flags == {"2025-01": False, "2025-02": False, "2025-05": True}
    assert chart.time_span(None, dt.date(2030, 1, 1), dt.date(2020, 1, 1), dt.date(2025, 1, 1)) == (dt.date(2020, 1, 1), dt.date(2025, 1, 1), False)


def test_exports_and_pickers(spark, corpus):
    text = "".join(sinks.csv_text(sinks.records(corpus, Filters()).select("cve", "cna"), {"made by": "x\ny"}))
    assert text.startswith("# made by: x y\r\n\"cve\",\"cna\"\r\n") and text.count("\r\n") == 6
    import json

    assert len(json.loads("".join(sinks.json_text(R.group(corpus, Filters(), "severity"), {"title": "t"})))["rows"]) == 3
    with pytest.raises(ValueError):
        sinks.cells(R.cross(corpus, Filters(), "year", "severity"), True, cap=1)
    assert [r.name for r in catalog.search_vendors(corpus, "cisco").collect()] == ["Cisco"]
    assert catalog.search_products(corpus, "ios").first().records == 2
    html = sinks.html_rows(spark.createDataFrame([("<b>",)], "a string")).first().line
    assert html == "<tr><td>&lt;b&gt;</td></tr>"


def test_budgets(spark):
    df = spark.createDataFrame([("c", i, n, r) for i, (n, r) in enumerate([(900, "tool"), (10, "user"), (20, "tool"), (30, "tool")])], "c string, i int, n int, r string")
    assert [r.i for r in budget.within(df, F.col("n"), 100, [F.asc("i")], ["c"]).collect()] == [0]
    gone = budget.evict(df, F.col("n"), 55, [F.asc("i")], ["c"], F.col("r") == "tool", 1)
    assert {r.i: r.evicted for r in gone.collect()} == {0: True, 1: False, 2: True, 3: False}
