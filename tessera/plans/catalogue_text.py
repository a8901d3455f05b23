"""Search, pickers, charts, exports, functions and budgets."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import times
from ..operators import budget, catalog, chart, search
from ..operators import reports as R
from ..operators.filters import Filters
from ..sources import sinks
from .bind import corpus, load, oracle
from .catalogue_reports import TOKENED, TOKENS, cross_sql, group_sql

QUERIES, ORACLES = {}, {}


def add(name, query, sql):
    QUERIES[name] = lambda spark, sf, q=query: q(corpus(spark, sf))
    ORACLES[name] = oracle(sql)


def raw(name, query, sql):
    """A query over the driver's tables as they are."""
    QUERIES[name], ORACLES[name] = query, sql


# --- full text -----------------------------------------------------------------------------------
_ids = lambda text: lambda c: search.find(c.postings, text).select(F.col("doc").alias("cve_id"))
_has = lambda w: f"(list_contains(d, '{w}') OR list_contains(t, '{w}'))"
_pad = lambda c, w: f"instr(' ' || array_to_string({c}, ' ') || ' ', '{w}') > 0"
add("fts_and", _ids("the of"), f"{TOKENED}\nSELECT cve_id FROM tok WHERE {_has('the')} AND {_has('of')}")
add("fts_phrase", _ids('"on the"'), f"{TOKENED}\nSELECT cve_id FROM tok WHERE {_pad('d', ' on the ')} OR {_pad('t', ' on the ')}")
add("fts_hyphen_is_phrase", _ids("In-the"), f"{TOKENED}\nSELECT cve_id FROM tok WHERE {_pad('d', ' in the ')} OR {_pad('t', ' in the ')}")
add("fts_prefix", _ids("er*"), f"{TOKENED}\nSELECT cve_id FROM tok WHERE {_pad('d', ' er')} OR {_pad('t', ' er')}")
add(
    "fts_accents",
    _ids("él É*"),
    f"{TOKENED}\nSELECT cve_id FROM tok WHERE ({_pad('d', ' el ')} OR {_pad('t', ' el ')}) AND ({_pad('d', ' e')} OR {_pad('t', ' e')})",
)
add(
    "fts_star_after_a_quote",
    _ids('"the o"* in'),
    f"{TOKENED}\nSELECT cve_id FROM tok WHERE ({_pad('d', ' the o ')} OR {_pad('t', ' the o ')}) AND {_has('in')}",
)
add("fts_phrase_prefix", _ids("on-th* the"), f"{TOKENED}\nSELECT cve_id FROM tok WHERE ({_pad('d', ' on th')} OR {_pad('t', ' on th')}) AND {_has('the')}")
add(
    "fts_without_index",
    lambda c: search.search(c.cve_text, '"on the" er*', ["descr", "title"]).select("cve_id"),
    f"{TOKENED}\nSELECT cve_id FROM tok WHERE ({_pad('d', ' on the ')} OR {_pad('t', ' on the ')}) AND ({_pad('d', ' er')} OR {_pad('t', ' er')})",
)
add("fts_across_columns", _ids("the src7"), f"{TOKENED}\nSELECT cve_id FROM tok WHERE {_has('the')} AND {_has('src7')}")
add("fts_no_token_false", _ids("!!!"), "SELECT cve_id FROM cve_text WHERE false")
add(
    "fts_count",
    lambda c: _ids("the AND of".replace(" AND", ""))(c).agg(F.count("*").alias("hits")),
    f"{TOKENED}\nSELECT count(*) hits FROM tok WHERE {_has('the')} AND {_has('of')}",
)
add(
    "fts_ranked_join",
    lambda c: _ids("the to")(c).join(c.cve.selectExpr("id cve_id", "cve_id name", "cvss_score"), "cve_id").orderBy(F.desc_nulls_last("cvss_score"), "cve_id").limit(25).select("name", "cvss_score"),
    f"""{TOKENED}
SELECT c.cve_id AS name, c.cvss_score FROM tok JOIN cve c ON c.id = tok.cve_id WHERE {_has('the')} AND {_has('to')}
ORDER BY c.cvss_score DESC NULLS LAST, c.id LIMIT 25""",
)
add(
    "fts_typeahead",
    lambda c: search.type_ahead(c.cna, "customer 0000*", 25),
    "SELECT id, name FROM cna WHERE lower(name) LIKE 'customer#0000%' ORDER BY name, id LIMIT 25",
)
add(
    "fts_postings",
    lambda c: search.postings(c.cve_text, "cve_id", ["title"]).select("term", "doc", F.size("places").alias("n")),
    f"SELECT term, cve_id AS doc, count(*)::INT n FROM (SELECT cve_id, unnest({TOKENS.format('title')}) term FROM cve_text) GROUP BY 1, 2",
)
add(
    "fts_index_lookup",
    lambda c: search.lookup(search.postings(c.cve_text, "cve_id", ["descr"]), ["the", "with"]),
    f"{TOKENED}\nSELECT cve_id AS doc FROM tok WHERE list_contains(d, 'the') AND list_contains(d, 'with')",
)


def _maintained(c):
    text = c.cve_text.select("cve_id", "title")
    old = text.filter("cve_id % 3 <> 0").withColumn("title", F.concat("title", F.lit(" old")))
    changed, gone = text.filter("cve_id % 3 = 0 or cve_id % 5 = 0"), text.filter("cve_id % 7 = 0 and cve_id % 3 <> 0 and cve_id % 5 <> 0").select("cve_id")
    return search.maintain(search.postings(old, "cve_id", ["title"]), changed, gone, "cve_id", ["title"]).groupBy("term").agg(F.count("*").alias("docs"))


add(
    "fts_maintain",
    _maintained,
    f"""now AS (SELECT cve_id, CASE WHEN cve_id % 3 = 0 OR cve_id % 5 = 0 THEN title ELSE title || ' old' END title FROM cve_text
WHERE cve_id % 3 = 0 OR cve_id % 5 = 0 OR cve_id % 7 <> 0)
SELECT term, count(*) docs FROM (SELECT DISTINCT cve_id, unnest({TOKENS.format('title')}) term FROM now) GROUP BY 1""",
)


def _drifted(c):
    """The kept index, of which some documents are taken out and to which a false row is added, against one made anew."""
    kept = c.postings.filter("field = 'title' and doc % 10 <> 3")
    false = c.cve.sparkSession.createDataFrame([("false", 1, "title", [0])], search.INDEX)
    return search.drift(kept.unionByName(false), search.postings(c.cve_text, "cve_id", ["title"])).select("term", "doc")


add(
    "fts_drift",
    _drifted,
    f"SELECT DISTINCT unnest({TOKENS.format('title')}) term, cve_id AS doc FROM cve_text WHERE cve_id % 10 = 3 UNION ALL SELECT 'false', 1",
)

# --- pickers -------------------------------------------------------------------------------------
_PRODUCTS = "pr AS (SELECT p.id, p.vendor_id, p.name, coalesce(n, 0)::BIGINT records FROM product p LEFT JOIN (SELECT product_id, count(*) n FROM cve_prod GROUP BY 1) x ON x.product_id = p.id)"
_TIER = "CASE WHEN lower({0}) = '{1}' THEN 3 WHEN starts_with(lower({0}), '{1}') THEN 2 WHEN contains(lower({0}), '{1}') THEN 1 ELSE 0 END"
add("catalog_products", catalog.products, f"{_PRODUCTS}\nSELECT id, vendor_id, name, records FROM pr")
add(
    "catalog_vendors",
    catalog.vendors,
    f"{_PRODUCTS}\nSELECT v.id, v.name, coalesce(sum(pr.records), 0)::BIGINT records FROM vendor v LEFT JOIN pr ON pr.vendor_id = v.id GROUP BY 1, 2",
)
add(
    "catalog_vendor_rank",
    lambda c: catalog.search_vendors(c, " BRAND#1", 10),
    f"""{_PRODUCTS}
SELECT id, name, records, {_TIER.format('name', 'brand#1')} tier FROM (SELECT v.id, v.name, coalesce(sum(pr.records), 0)::BIGINT records FROM vendor v
LEFT JOIN pr ON pr.vendor_id = v.id GROUP BY 1, 2) WHERE contains(lower(name), 'brand#1') ORDER BY tier DESC, records DESC, name, id LIMIT 10""",
)
add(
    "catalog_product_group",
    lambda c: catalog.search_products(c, "ring", None, 40),
    f"""{_PRODUCTS}
SELECT name, records, vendors, {_TIER.format('k', 'ring')} tier
FROM (SELECT lower(name) k, min(name) AS name, sum(records)::BIGINT records, count(DISTINCT vendor_id) vendors FROM pr GROUP BY 1)
WHERE contains(k, 'ring') ORDER BY tier DESC, records DESC, k LIMIT 40""",
)
add(
    "catalog_product_of_vendors",
    lambda c: catalog.search_products(c, "red", [11, 12], 15),
    f"""{_PRODUCTS}
SELECT name, records, vendors, {_TIER.format('k', 'red')} tier
FROM (SELECT lower(name) k, min(name) AS name, sum(records)::BIGINT records, count(DISTINCT vendor_id) vendors FROM pr WHERE vendor_id IN (11, 12)
GROUP BY 1) WHERE contains(k, 'red') ORDER BY tier DESC, records DESC, k LIMIT 15""",
)

# --- charts --------------------------------------------------------------------------------------
_MS = cross_sql("month", "severity", "c.state = 1")
_month = lambda c: R.cross(c, Filters(), "month", "severity")


def _cells(sql, out):
    """A query over the cells of a cross-tab's SQL."""
    head, _, body = sql.rpartition("\nSELECT ")
    return f"{head},\nq AS (SELECT {body})\nSELECT {out}"


add(
    "pivot_month_severity",
    lambda c: chart.matrix(_month(c), [4, 3, 2, 1, None]).select("bucket", F.col("4").alias("critical"), F.col("3").alias("high"), F.col("2").alias("medium"), F.col("1").alias("low"), F.col("null").alias("not_scored")),
    _cells(_MS, "bucket, sum(CASE WHEN series = 4 THEN cves ELSE 0 END)::BIGINT critical, sum(CASE WHEN series = 3 THEN cves ELSE 0 END)::BIGINT high, sum(CASE WHEN series = 2 THEN cves ELSE 0 END)::BIGINT medium, sum(CASE WHEN series = 1 THEN cves ELSE 0 END)::BIGINT low, sum(CASE WHEN series IS NULL THEN cves ELSE 0 END)::BIGINT not_scored FROM q GROUP BY 1"),
)
add(
    "series_order_severity",
    lambda c: chart.series_order(_month(c), "severity"),
    _cells(_MS, "series, sum(cves)::BIGINT total, row_number() OVER (ORDER BY series DESC NULLS LAST)::INT place FROM q GROUP BY 1"),
)
_VC = cross_sql("year", "vendor", "c.state = 1")
add(
    "series_order_identity",
    lambda c: chart.series_order(R.cross(c, Filters(), "year", "vendor"), "vendor"),
    _cells(_VC, "series, sum(cves)::BIGINT total, row_number() OVER (ORDER BY sum(cves) DESC, series)::INT place FROM q GROUP BY 1"),
)
add(
    "series_cap_totals",
    lambda c: chart.row_totals(chart.capped(R.cross(c, Filters(), "year", "vendor"), "vendor")[0]),
    _cells(_VC, "bucket, sum(cves)::BIGINT total FROM q WHERE series IN (SELECT series FROM q GROUP BY 1 ORDER BY sum(cves) DESC, series LIMIT 8) GROUP BY 1"),
)
add(
    "series_cap_dropped",
    lambda c: chart.capped(R.cross(c, Filters(), "year", "vendor"), "vendor")[1],
    _cells(_VC, "greatest(count(DISTINCT series) - 8, 0) dropped_series FROM q"),
)
_sparse = Filters(vendor=["Brand#11"], severity=[4], kev=[1])
_SPARSE = "c.state = 1 AND cvss_sev = 4 AND EXISTS (SELECT 1 FROM kev k WHERE k.cve_id = c.id) AND EXISTS (SELECT 1 FROM cve_prod x JOIN product p ON p.id = x.product_id JOIN vendor v ON v.id = p.vendor_id WHERE x.cve_id = c.id AND lower(v.name) = 'brand#11')"
add("gap_fill_week", lambda c: chart.fill_gaps(R.group(c, _sparse, "week").select("bucket", "cves"), "week"), f"""g AS ({group_sql("week", _SPARSE, 400)}),
axis AS (SELECT strftime(unnest(generate_series(min(bucket)::DATE::TIMESTAMP, max(bucket)::DATE::TIMESTAMP, INTERVAL 7 DAY)), '%Y-%m-%d') bucket FROM g)
SELECT coalesce(a.bucket, g.bucket) bucket, coalesce(g.cves, 0) cves FROM axis a FULL JOIN g ON g.bucket = a.bucket""")
add(
    "gap_fill_window",
    lambda c: chart.fill_gaps(R.group(c, _sparse, "month").select("bucket", "cves"), "month", dt.date(1994, 5, 20), dt.date(2002, 2, 3)),
    f"""g AS ({group_sql("month", _SPARSE, 400)}),
axis AS (SELECT strftime(unnest(generate_series(TIMESTAMP '1994-05-01', TIMESTAMP '2002-02-01', INTERVAL 1 MONTH)), '%Y-%m') bucket)
SELECT coalesce(a.bucket, g.bucket) bucket, coalesce(g.cves, 0) cves FROM axis a FULL JOIN g ON g.bucket = a.bucket""",
)
add(
    "partial_flag",
    lambda c: chart.partial_flags(R.group(c, Filters(published_from=883_612_800 + 86_400 * 9), "month").select("bucket", "cves"), "month", dt.date(1998, 1, 10), dt.date(2001, 7, 15)),
    f"""SELECT bucket, cves, coalesce(bucket IN ('1998-01', '2001-07'), false) "partial", coalesce(bucket, '(none recorded)') ||
CASE WHEN bucket IN ('1998-01', '2001-07') THEN ' (partial)' ELSE '' END AS label
FROM ({group_sql("month", f"c.state = 1 AND c.published >= {883_612_800 + 86_400 * 9}", 400)})""",
)
add(
    "bucket_labels",
    lambda c: R.cross(c, Filters(), "severity", "kevRansomware").select(chart.bucket_label("severity", F.col("bucket"), F.col("label")).alias("row_label"), chart.bucket_label("kevRansomware", F.col("series"), F.col("series_label")).alias("column_label"), "cves"),
    _cells(cross_sql("severity", "kevRansomware", "c.state = 1"), "CASE bucket WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH' WHEN 4 THEN 'CRITICAL' ELSE '(not scored)' END row_label, CASE series WHEN 1 THEN 'Known' WHEN 0 THEN 'Unknown (per CISA)' WHEN 2 THEN 'Not in KEV' ELSE '(not stated by CISA)' END column_label, cves FROM q"),
)

# --- exports -------------------------------------------------------------------------------------
_LIST = "e AS (SELECT c.cve_id cve, c.state, n.name cna, t.title FROM cve c LEFT JOIN cna n ON n.id = c.cna_id LEFT JOIN cve_text t ON t.cve_id = c.id WHERE c.state = 1 ORDER BY c.published DESC NULLS LAST, c.id DESC LIMIT 50000)"
_CLEAN = "regexp_replace(coalesce({0}::VARCHAR, ''), '[\\x00-\\x1F\\x7F\\x{{80}}-\\x{{9F}}\\x{{202A}}-\\x{{202E}}\\x{{2066}}-\\x{{2069}}]+', ' ', 'g')"


def _guarded(c):
    clean = _CLEAN.format(c)
    return f"(CASE WHEN regexp_matches({clean}, '^[=+\\-@]') THEN chr(39) ELSE '' END || {clean})"


def _field(c):
    return f"chr(34) || replace({_guarded(c)}, chr(34), chr(34) || chr(34)) || chr(34)"


# Text with what an export must not let through, and with marks that it must keep.
_ODD = ["=", '"', "\n=", "\x01@x", "+\r\n", "\u202e-\u2069", "\u200e\u061c"]
_ODD_SQL = "CASE doc_id % 7 " + " ".join(f"WHEN {k} THEN {' || '.join(f'chr({ord(ch)})' for ch in x)}" for k, x in enumerate(_ODD)) + " END"


def _odd(column):
    return F.concat(F.element_at(F.array(*[F.lit(x) for x in _ODD]), (F.col("doc_id") % 7 + 1).cast("int")), column)


_export = lambda c: sinks.records(c, Filters()).select("cve", "state", "cna", "title")
add("csv_guard", lambda c: sinks.csv_lines(_export(c)), f"{_LIST}\nSELECT {' || chr(44) || '.join(map(_field, ('cve', 'state', 'cna', 'title')))} line FROM e")
raw(
    "csv_guard_text",
    lambda spark, sf: sinks.csv_lines(load(spark, sf, "documents").select("doc_id", _odd(F.col("text")).alias("x"))),
    f"SELECT {_field('doc_id')} || ',' || {_field('x')} line FROM (SELECT doc_id, {_ODD_SQL} || text x FROM documents)",
)
raw(
    "sheet_cells",
    lambda spark, sf: sinks.sheet_rows(load(spark, sf, "documents").select((-F.col("doc_id")).alias("n"), _odd(F.col("text")).alias("x"))),
    f"SELECT (-doc_id)::VARCHAR || chr(9) || {_guarded('x')} line FROM (SELECT doc_id, {_ODD_SQL} || text x FROM documents)",
)
add(
    "json_rows",
    lambda c: sinks.json_rows(_export(c)),
    f"""{_LIST}
SELECT '{{"cve":"' || cve || '","state":' || state || ',"cna":' || coalesce('"' || cna || '"', 'null') || ',"title":' || coalesce('"' || title || '"', 'null') || '}}' "row"
FROM e""",
)
add(
    "sheet_rows",
    lambda c: sinks.sheet_rows(R.group(c, Filters(), "severity").select("label", "cves")),
    f"SELECT coalesce(label, '') || chr(9) || cves::VARCHAR line FROM ({group_sql('severity', 'c.state = 1', 400)})",
)
add(
    "export_cells",
    lambda c: sinks.cells(R.cross(c, Filters(), "year", "severity"), True),
    _cells(cross_sql("year", "severity", "c.state = 1"), "label, series_label, cves FROM q"),
)

# --- functions -----------------------------------------------------------------------------------
raw(
    "host_extract",
    lambda spark, sf: load(spark, sf, "pages").select("page_id", T.host(F.col("url")).alias("host")),
    "SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) host FROM pages",
)
raw(
    "safe_url",
    lambda spark, sf: load(spark, sf, "pages").select("page_id", T.safe_url(F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("javascript:"), "url")).otherwise(F.col("url"))).isNotNull().alias("safe")),
    "SELECT page_id, page_id % 5 <> 0 safe FROM pages",
)
raw(
    "time_buckets",
    lambda spark, sf: load(spark, sf, "events").withColumn("s", times.seconds("ts")).select("event_id", "s", times.year_of("s").alias("y"), times.quarter_of("s").alias("q"), times.month_of("s").alias("m"), times.week_of("s").alias("w")),
    """SELECT event_id, epoch(date_trunc('second', ts))::BIGINT s, strftime(ts, '%Y') y, strftime(ts, '%Y') || '-Q' || quarter(ts)::VARCHAR q, strftime(ts, '%Y-%m') m, strftime(date_trunc('week', ts), '%Y-%m-%d') w
FROM events""",
)
raw(
    "iso_seconds",
    lambda spark, sf: load(spark, sf, "events").select("event_id", times.iso_seconds(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 2 == 0, "Z").otherwise("+02:00"))).alias("s"), times.day_seconds(F.when(F.col("event_id") % 3 == 0, "2024-02-31").otherwise(F.date_format("ts", "yyyy-MM-dd"))).alias("d")),
    """SELECT event_id, epoch(date_trunc('second', ts))::BIGINT - CASE WHEN event_id % 2 = 0 THEN 0 ELSE 7200 END s,
CASE WHEN event_id % 3 <> 0 THEN epoch(ts::DATE)::BIGINT END d FROM events""",
)
raw(
    "json_props",
    lambda spark, sf: load(spark, sf, "events")
    .select("event_id", F.from_json("props", "k int")["k"].alias("k"), T.json_list(F.expr("case event_id % 3 when 0 then concat('[\"', event_type, '\",\"x\"]') when 1 then '[]' else props end")).alias("l"))
    .select("event_id", "k", F.size("l").alias("n"), F.get("l", F.lit(0)).alias("first")),
    """SELECT event_id, (props->>'k')::INT k, CASE event_id % 3 WHEN 0 THEN 2 ELSE 0 END n, CASE event_id % 3 WHEN 0 THEN event_type END "first" FROM events""",
)
raw(
    "strip_controls",
    lambda spark, sf: load(spark, sf, "documents").select("doc_id", T.strip_controls(_odd(F.col("text"))).alias("x")),
    f"SELECT doc_id, {_CLEAN.format('x')} x FROM (SELECT doc_id, {_ODD_SQL} || text x FROM documents)",
)
raw(
    "strip_invisible",
    lambda spark, sf: load(spark, sf, "documents").select("doc_id", T.strip_invisible(F.concat(_odd(F.col("text")), F.lit("\u200b\u2028\u2029\u202f\ufeff\U000e0041"))).alias("x")),
    f"""SELECT doc_id, replace(replace({_CLEAN.format('x')}, chr(8206), ' '), chr(1564), ' ') || '      ' x
FROM (SELECT doc_id, {_ODD_SQL} || text x FROM documents)""",
)
raw(
    "version_order",
    lambda spark, sf: load(spark, sf, "lineitem").selectExpr("l_orderkey", "concat(l_linenumber, '.', cast(l_quantity as int), '.', l_suppkey) v").groupBy("l_orderkey").agg(F.max_by("v", T.version_key(F.col("v"))).alias("latest")),
    """SELECT l_orderkey, arg_max(v, k) latest
FROM (SELECT l_orderkey, l_linenumber::VARCHAR || '.' || l_quantity::INT::VARCHAR || '.' || l_suppkey::VARCHAR v, l_linenumber::BIGINT * 1000000000 + l_quantity::INT * 10000000 + l_suppkey k
FROM lineitem) GROUP BY 1""",
)
raw(
    "token_estimate",
    lambda spark, sf: load(spark, sf, "conversations").select("conv_id", "turn", T.tokens_estimate(F.col("text")).alias("n")),
    "SELECT conv_id, turn, ceil(length(text) / 2.0)::BIGINT n FROM conversations",
)

# --- budgets -------------------------------------------------------------------------------------
raw(
    "char_budget_window",
    lambda spark, sf: budget.within(load(spark, sf, "conversations"), F.length("text"), 600, [F.asc("turn"), F.asc("text")], ["conv_id"]).select("conv_id", "turn"),
    """SELECT conv_id, turn FROM (SELECT *, sum(length(text)) OVER w u, row_number() OVER w n FROM conversations WINDOW w AS (PARTITION BY conv_id
ORDER BY turn, text ROWS UNBOUNDED PRECEDING)) WHERE u <= 600 OR n = 1""",
)
raw(
    "token_eviction",
    lambda spark, sf: budget.evict(load(spark, sf, "conversations"), T.tokens_estimate(F.col("text")), 400, [F.asc("turn"), F.asc("text")], ["conv_id"], F.col("role") != "user", 10).select("conv_id", "turn", "evicted"),
    """SELECT conv_id, turn, role <> 'user' AND f > 0 AND surplus > coalesce(before, 0) evicted
FROM (SELECT *, sum(n) OVER (PARTITION BY conv_id) - 400 surplus, sum(f) OVER (PARTITION BY conv_id
ORDER BY turn, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) before
FROM (SELECT *, CASE WHEN role <> 'user' THEN greatest(n - 10, 0) ELSE 0 END f FROM (SELECT *, ceil(length(text) / 2.0)::BIGINT n
FROM conversations)))""",
)
