"""Filters, lists, groups, cross-tabs, fixed and acceptance queries, extents and details."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..model import NOT_ASSESSED
from ..operators import reports as R
from ..operators.dims import DIMS, IDENTITY, TIME
from ..operators.filters import Filters, matching
from .bind import corpus, oracle

QUERIES, ORACLES = {}, {}


def add(name, query, sql):
    QUERIES[name] = lambda spark, sf, q=query: q(corpus(spark, sf))
    ORACLES[name] = oracle(sql)


# --- filters -------------------------------------------------------------------------------------
T1998, T1999 = 883_612_800, 915_148_800  # 1998-01-01, 1999-01-01


def flt(name, filters, where):
    add(f"flt_{name}", lambda c, f=filters: matching(c, f).select("id", "cve_id", "cvss_score"), f"SELECT c.id, c.cve_id, c.cvss_score FROM cve c WHERE {where}")


KEV_OF = "SELECT 1 FROM kev k WHERE k.cve_id = c.id"
PROD_OF = "SELECT 1 FROM cve_prod x JOIN product p ON p.id = x.product_id JOIN vendor v ON v.id = p.vendor_id WHERE x.cve_id = c.id"
REF_OF = "SELECT 1 FROM cve_ref r JOIN url u ON u.id = r.url_id JOIN host h ON h.id = u.host_id WHERE r.cve_id = c.id"
CWE_OF = "SELECT 1 FROM cve_cwe x JOIN cwe w ON w.id = x.cwe_id WHERE x.cve_id = c.id"

for _name, _filters, _where in (
    ("state_default", Filters(), "state = 1"),
    ("state_unknown_is_default", Filters(state="no such"), "state = 1"),
    ("state_rejected", Filters(state="rejected"), "state = 2"),
    ("state_all", Filters(state="all"), "true"),
    ("id_ci", Filters(state="all", cve_id="  cve-2000-0000007 "), "lower(cve_id) = 'cve-2000-0000007'"),
    ("code_in", Filters(severity=[3, 4]), "state = 1 AND cvss_sev IN (3, 4)"),
    ("code_none", Filters(severity=[]), "state = 1"),
    ("code_version", Filters(cvss_version=[30, 31]), "state = 1 AND cvss_ver IN (30, 31)"),
    ("nullable_in", Filters(ssvc_expl=[2, NOT_ASSESSED]), "state = 1 AND (ssvc_expl = 2 OR ssvc_expl IS NULL)"),
    ("nullable_only", Filters(ssvc_auto=[NOT_ASSESSED]), "state = 1 AND ssvc_auto IS NULL"),
    ("ssvc_impact", Filters(ssvc_impact=[1]), "state = 1 AND ssvc_impact = 1"),
    ("range_score", Filters(score_min=100_000, score_max=200_000), "state = 1 AND cvss_score >= 100000 AND cvss_score <= 200000"),
    ("range_score_not_finite", Filters(score_min=float("nan"), score_max=150_000), "state = 1 AND cvss_score <= 150000"),
    ("range_published", Filters(published_from=T1998, published_to=T1999), f"state = 1 AND published >= {T1998} AND published <= {T1999}"),
    ("range_updated", Filters(updated_from=T1999), f"state = 1 AND updated >= {T1999}"),
    ("range_year", Filters(year_from=1995, year_to=1997), 'state = 1 AND "year" BETWEEN 1995 AND 1997'),
    ("cna", Filters(cna=["customer#000000007", "Customer#000000010"]), "state = 1 AND cna_id IN (SELECT id FROM cna WHERE lower(name) IN ('customer#000000007', 'customer#000000010'))"),
    ("vendor_exists", Filters(vendor=["brand#12"]), f"state = 1 AND EXISTS ({PROD_OF} AND lower(v.name) = 'brand#12')"),
    ("product_exists", Filters(state="all", product=["Small Ring", "red widget"]), f"EXISTS ({PROD_OF} AND lower(p.name) IN ('small ring', 'red widget'))"),
    ("cwe_exists", Filters(cwe=["7", "CWE-3"]), f"state = 1 AND EXISTS ({CWE_OF} AND w.cwe IN ('CWE-7', 'CWE-3'))"),
    ("host_exists", Filters(host=["nation_3", "NATION_5"]), f"state = 1 AND EXISTS ({REF_OF} AND lower(h.name) IN ('nation_3', 'nation_5'))"),
    ("unresolved_false", Filters(vendor=["no such vendor"]), "false"),
    ("blank_names_no_clause", Filters(vendor=["  "], severity=[4]), "state = 1 AND cvss_sev = 4"),
    ("partial_resolution", Filters(vendor=["Brand#11", "no such"]), f"state = 1 AND EXISTS ({PROD_OF} AND lower(v.name) = 'brand#11')"),
    ("combined_and", Filters(severity=[4], vendor=["Brand#11"], host=["nation_3"], score_min=50_000), f"state = 1 AND cvss_sev = 4 AND cvss_score >= 50000 AND EXISTS ({PROD_OF} AND lower(v.name) = 'brand#11') AND EXISTS ({REF_OF} AND lower(h.name) = 'nation_3')"),
    ("overlay_listed", Filters(kev=[1]), f"state = 1 AND EXISTS ({KEV_OF})"),
    ("overlay_not_listed", Filters(kev=[0]), f"state = 1 AND NOT EXISTS ({KEV_OF})"),
    ("overlay_both", Filters(kev=[0, 1]), "state = 1"),
    ("overlay_unknown_code", Filters(kev=[9]), "false"),
    ("overlay_attr", Filters(kev_ransomware=[1]), f"state = 1 AND EXISTS ({KEV_OF} AND k.ransomware = 1)"),
    ("overlay_attr_not_stated", Filters(kev_ransomware=[NOT_ASSESSED]), f"state = 1 AND EXISTS ({KEV_OF} AND k.ransomware IS NULL)"),
    ("overlay_attr_arms", Filters(kev_ransomware=[0, 2]), f"state = 1 AND (EXISTS ({KEV_OF} AND k.ransomware = 0) OR NOT EXISTS ({KEV_OF}))"),
    ("overlay_attr_unknown_code", Filters(kev_ransomware=[7]), "false"),
    ("overlay_added_range", Filters(kev_added_from=T1998, kev_added_to=T1999), f"state = 1 AND EXISTS ({KEV_OF} AND k.added_at BETWEEN {T1998} AND {T1999})"),
    ("overlay_due_range", Filters(state="all", kev_due_to=T1998), f"EXISTS ({KEV_OF} AND k.due_at <= {T1998})"),
    ("text", Filters(state="all", text="the of"), "id IN (SELECT cve_id FROM hits2)"),
    ("text_no_token_false", Filters(text="!!! --"), "false"),
):
    flt(_name, _filters, _where)
TOKENS = "list_filter(string_split_regex(strip_accents(lower(coalesce({0}, ''))), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
TOKENED = f"tok AS (SELECT cve_id, {TOKENS.format('descr')} d, {TOKENS.format('title')} t FROM cve_text)"
HITS = f"{TOKENED},\nhits2 AS (SELECT cve_id FROM tok WHERE (list_contains(d, 'the') OR list_contains(t, 'the')) AND (list_contains(d, 'of') OR list_contains(t, 'of')))"
ORACLES["flt_text"] = oracle(f"{HITS}\nSELECT c.id, c.cve_id, c.cvss_score FROM cve c WHERE id IN (SELECT cve_id FROM hits2)")

# --- lists ---------------------------------------------------------------------------------------
LIST = "SELECT c.cve_id cve, c.state, c.published, c.updated, c.cvss_ver, c.cvss_score, c.cvss_sev, n.name cna, substr(t.descr, 1, 400) description FROM cve c LEFT JOIN cna n ON n.id = c.cna_id LEFT JOIN cve_text t ON t.cve_id = c.id WHERE {0} ORDER BY {1} LIMIT {2} OFFSET {3}"
add("rows_published", lambda c: R.rows(c, Filters()), LIST.format("state = 1", "published DESC NULLS LAST, c.id DESC", 501, 0))
add("rows_updated", lambda c: R.rows(c, Filters(), 50, 0, "updated"), LIST.format("state = 1", "updated DESC NULLS LAST, c.id DESC", 51, 0))
add(
    "rows_score_nulls_last",
    lambda c: R.rows(c, Filters(state="all", published_from=T1998), 5_000, 0, "score"),
    LIST.format(f"published >= {T1998}", "cvss_score DESC NULLS LAST, c.id DESC", 5001, 0),
)
add("rows_cve", lambda c: R.rows(c, Filters(state="all", cvss_version=[4]), 100, 0, "cve"), LIST.format("cvss_ver = 4", "c.cve_id DESC", 101, 0))
add("rows_offset", lambda c: R.rows(c, Filters(), 20, 1000, "no such sort"), LIST.format("state = 1", "published DESC NULLS LAST, c.id DESC", 21, 1000))
add(
    "rows_full_kev",
    lambda c: R.rows(c, Filters(severity=[4]), 300, 0, "score", full=True, kev=True),
    """SELECT c.cve_id cve, c.state, c.published, c.updated, c.cvss_ver, c.cvss_score, c.cvss_sev, n.name cna, t.descr description, t.title, t.reason, c.cvss_vec, c.reserved, c.ssvc_expl, c.ssvc_auto, c.ssvc_impact,
CASE WHEN k.cve IS NULL THEN 0 ELSE 1 END kev_listed, k.added kev_added, k.due kev_due,
CASE WHEN k.cve IS NULL THEN '' WHEN k.ransomware = 1 THEN 'Known' WHEN k.ransomware = 0 THEN 'Unknown (per CISA)' ELSE 'not stated by CISA' END kev_ransomware, k.name kev_name, k.action kev_action
FROM cve c LEFT JOIN cna n ON n.id = c.cna_id LEFT JOIN cve_text t ON t.cve_id = c.id LEFT JOIN kev k ON k.cve_id = c.id
WHERE state = 1 AND cvss_sev = 4 ORDER BY cvss_score DESC NULLS LAST, c.id DESC LIMIT 301""",
)
add(
    "count_matches",
    lambda c: R.count(c, Filters(severity=[1, 2], kev=[1])),
    f"SELECT count(*) matches FROM cve c WHERE state = 1 AND cvss_sev IN (1, 2) AND EXISTS ({KEV_OF})",
)

# --- groups and cross-tabs -----------------------------------------------------------------------
_MOMENT = "make_timestamp(c.published * 1000000)"
_WEEK = f"strftime(date_trunc('week', {_MOMENT}), '%Y-%m-%d')"
KEYS = {
    "year": f"strftime({_MOMENT}, '%Y')", "quarter": f"strftime({_MOMENT}, '%Y') || '-Q' || quarter({_MOMENT})::VARCHAR", "month": f"strftime({_MOMENT}, '%Y-%m')", "week": _WEEK,
    "severity": "c.cvss_sev", "cvssVersion": "c.cvss_ver", "ssvcExpl": "c.ssvc_expl", "ssvcAuto": "c.ssvc_auto", "ssvcImpact": "c.ssvc_impact",
    "kev": "CASE WHEN k.cve IS NULL THEN 0 ELSE 1 END", "kevRansomware": "CASE WHEN k.cve IS NULL THEN 2 ELSE k.ransomware END", "state": "c.state",
    "cna": "c.cna_id", "vendor": "v.id", "product": "p.id", "cwe": "w.id", "host": "h.id",
}
LABELS = {"cna": "n.name", "vendor": "v.name", "product": "v.name || ' / ' || p.name", "cwe": "w.cwe || ' — ' || w.descr", "host": "h.name"}
JOINS = {
    "kev": "LEFT JOIN kev k ON k.cve_id = c.id", "cna": "LEFT JOIN cna n ON n.id = c.cna_id",
    "prod": "JOIN cve_prod cp ON cp.cve_id = c.id JOIN product p ON p.id = cp.product_id JOIN vendor v ON v.id = p.vendor_id",
    "cwe": "JOIN cve_cwe cx ON cx.cve_id = c.id JOIN cwe w ON w.id = cx.cwe_id", "ref": "JOIN cve_ref r ON r.cve_id = c.id JOIN url u ON u.id = r.url_id JOIN host h ON h.id = u.host_id",
}
JOIN_OF = {"kev": "kev", "kevRansomware": "kev", "cna": "cna", "vendor": "prod", "product": "prod", "cwe": "cwe", "host": "ref"}
ORDERS = {
    "cvssVersion": "CASE {0} WHEN 2 THEN 0 WHEN 30 THEN 1 WHEN 31 THEN 2 WHEN 4 THEN 3 ELSE CASE WHEN {0} IS NULL THEN 5 ELSE 4 END END",
    "ssvcExpl": "coalesce({0}, 99)", "ssvcAuto": "coalesce({0}, 99)", "ssvcImpact": "coalesce({0}, 99)", "kev": "1 - {0}",
    "kevRansomware": "CASE {0} WHEN 1 THEN 0 WHEN 0 THEN 1 WHEN 2 THEN 2 ELSE 99 END",
}


def _label(d):
    return LABELS.get(d, f"CAST({KEYS[d]} AS VARCHAR)")


def _from(*dims):
    return "FROM cve c " + " ".join(JOINS[g] for g in dict.fromkeys(JOIN_OF[d] for d in dims if d in JOIN_OF))


def _count(*dims):
    return "count(DISTINCT c.id)" if any(JOIN_OF.get(d) in ("prod", "cwe", "ref") for d in dims) else "count(*)"


def group_sql(d, where, limit):
    base = f"SELECT {KEYS[d]} bucket, max({_label(d)}) AS label, {_count(d)} cves {_from(d)} WHERE {where} GROUP BY 1"
    if DIMS[d].kind == TIME:
        order = "bucket DESC NULLS LAST"
    elif d in ORDERS:
        order = f"{ORDERS[d].format('bucket')}, bucket NULLS FIRST"
    else:
        order = "bucket DESC NULLS LAST" if d == "state" else "cves DESC, bucket NULLS FIRST"
    return f"SELECT * FROM ({base}) ORDER BY {order} LIMIT {limit + 1}"


def cross_sql(a, b, where, rows=400, series=24):
    top = lambda d, n: f"SELECT bucket FROM (SELECT {KEYS[d]} bucket, {_count(d)} cves {_from(d)} WHERE {where} GROUP BY 1) ORDER BY {'bucket DESC NULLS LAST' if DIMS[d].kind == TIME else 'cves DESC, bucket NULLS FIRST'} LIMIT {n}"
    first = "sum(cves) OVER (PARTITION BY bucket) DESC, bucket NULLS FIRST" if DIMS[a].kind == IDENTITY else f"{ORDERS.get(a, '{0}').format('bucket')} NULLS FIRST, bucket NULLS FIRST"
    second = "cves DESC, series NULLS FIRST" if DIMS[b].kind == IDENTITY else f"{ORDERS.get(b, '{0}').format('series')} NULLS FIRST, series NULLS FIRST"
    return f"""top_rows AS ({top(a, rows)}), top_series AS ({top(b, series)}),
cells AS (SELECT {KEYS[a]} bucket, max({_label(a)}) AS label, {KEYS[b]} series, max({_label(b)}) series_label, {_count(a, b)} cves {_from(a, b)} WHERE {where}
  AND EXISTS (SELECT 1 FROM top_rows t WHERE t.bucket IS NOT DISTINCT FROM {KEYS[a]}) AND EXISTS (SELECT 1 FROM top_series t WHERE t.bucket IS NOT DISTINCT FROM {KEYS[b]}) GROUP BY 1, 3)
SELECT bucket, label, series, series_label, cves FROM cells ORDER BY {first}, {second} LIMIT {min(rows * series, 3000) + 1}"""


for _d in DIMS:
    add(f"grp_{_d}", partial(R.group, filters=Filters(), dimension=_d), group_sql(_d, "c.state = 1", 400))
add("grp_all_states", partial(R.group, filters=Filters(state="all"), dimension="state"), group_sql("state", "true", 400))
add("grp_time_cap_recent", partial(R.group, filters=Filters(), dimension="month", limit=12), group_sql("month", "c.state = 1", 12))
add("grp_limit_topk", partial(R.group, filters=Filters(severity=[4]), dimension="product", limit=10), group_sql("product", "c.state = 1 AND cvss_sev = 4", 10))
add(
    "grp_filtered_by_vendor",
    partial(R.group, filters=Filters(vendor=["Brand#11"]), dimension="product"),
    group_sql("product", f"c.state = 1 AND EXISTS ({PROD_OF.replace(' p ', ' p1 ').replace('p.', 'p1.').replace(' v ', ' v1 ').replace('v.', 'v1.')} AND lower(v1.name) = 'brand#11')", 400),
)
for _a, _b, _f, _w, _n, _m in (
    ("month", "severity", Filters(), "c.state = 1", 400, 24),
    ("week", "severity", Filters(), "c.state = 1", 52, 24),
    ("year", "severity", Filters(state="all"), "true", 400, 24),
    ("quarter", "kev", Filters(), "c.state = 1", 400, 24),
    ("vendor", "severity", Filters(), "c.state = 1", 400, 24),
    ("product", "severity", Filters(), "c.state = 1", 30, 24),
    ("vendor", "product", Filters(), "c.state = 1", 400, 24),
    ("vendor", "cwe", Filters(), "c.state = 1", 400, 24),
    ("cwe", "vendor", Filters(), "c.state = 1", 5, 7),
    ("cna", "cvssVersion", Filters(), "c.state = 1", 40, 24),
    ("host", "severity", Filters(), "c.state = 1", 400, 24),
    ("host", "cwe", Filters(severity=[4]), "c.state = 1 AND cvss_sev = 4", 400, 24),
    ("kev", "severity", Filters(state="all"), "true", 400, 24),
    ("kevRansomware", "ssvcExpl", Filters(), "c.state = 1", 400, 24),
    ("state", "cvssVersion", Filters(state="all"), "true", 400, 24),
    ("severity", "ssvcAuto", Filters(), "c.state = 1", 2, 2),
    ("ssvcImpact", "month", Filters(), "c.state = 1", 400, 6),
):
    add(f"x_{_a}_{_b}", partial(R.cross, filters=_f, by=_a, series=_b, rows=_n, series_limit=_m), cross_sql(_a, _b, _w, _n, _m))
add("x_one_axis", partial(R.cross, filters=Filters(), by="severity", series=None), group_sql("severity", "c.state = 1", 400))

# --- the ten fixed shapes and the acceptance questions ---------------------------------------------
_cve = lambda c: c.cve.filter("state = 1")


def _links(c):
    product, vendor = c.product.selectExpr("id product_id", "vendor_id", "name product"), c.vendor.selectExpr("id vendor_id", "name vendor")
    return c.cve_prod.selectExpr("cve_id id", "product_id").join(product, "product_id").join(vendor, "vendor_id")


def _drilldown(c):
    links = _links(c)
    top = links.groupBy("vendor_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "vendor_id").limit(1).select("vendor_id")
    return links.join(F.broadcast(top), "vendor_id", "left_semi").join(_cve(c).select("id"), "id").groupBy("product_id").agg(F.max("product").alias("product"), F.count("*").alias("cves")).orderBy(F.desc("cves"), "product_id").limit(25).select("product", "cves")


def _hosts(c):
    refs = c.cve_ref.join(c.url.selectExpr("id url_id", "host_id"), "url_id").join(c.host.selectExpr("id host_id", "name host"), "host_id")
    return refs.groupBy("host_id").agg(F.max("host").alias("host"), F.count_distinct("cve_id").alias("cves")).orderBy(F.desc("cves"), "host_id").limit(25).select("host", "cves")


add(
    "bq_point_lookup",
    lambda c: c.cve.filter("cve_id = 'CVE-2000-0000007'").select("cve_id", "year", "cvss_score", "cvss_vec"),
    "SELECT cve_id, \"year\", cvss_score, cvss_vec FROM cve WHERE cve_id = 'CVE-2000-0000007'",
)
add(
    "bq_severity_by_year",
    lambda c: _cve(c).filter("cvss_sev is not null").groupBy("year", "cvss_sev").agg(F.count("*").alias("cves")).orderBy(F.desc("year"), F.desc("cvss_sev")),
    'SELECT "year", cvss_sev, count(*) cves FROM cve WHERE state = 1 AND cvss_sev IS NOT NULL GROUP BY 1, 2',
)
add(
    "bq_cna_year_cvss",
    lambda c: _cve(c).filter("cvss_score >= 70000").join(c.cna.selectExpr("id cna_id", "name cna"), "cna_id").groupBy("cna_id", "year").agg(F.max("cna").alias("cna"), F.count("*").alias("cves")).orderBy(F.desc("cves"), "cna_id", "year").limit(50).select("cna", "year", "cves"),
    '''SELECT cna, "year", cves FROM (SELECT c.cna_id, max(n.name) cna, c."year", count(*) cves FROM cve c JOIN cna n ON n.id = c.cna_id
WHERE c.state = 1 AND c.cvss_score >= 70000 GROUP BY c.cna_id, c."year") ORDER BY cves DESC, cna_id, "year" LIMIT 50''',
)
add(
    "bq_vendor_severity_2y",
    lambda c: _links(c).join(_cve(c).filter(f"published >= {T1999}").select("id", "cvss_sev"), "id").groupBy("vendor_id", "product_id", "cvss_sev").agg(F.max("vendor").alias("vendor"), F.max("product").alias("product"), F.count("*").alias("cves")).orderBy(F.desc("cves"), "product_id", F.asc_nulls_first("cvss_sev")).limit(100).select("vendor", "product", "cvss_sev", "cves"),
    f"""SELECT vendor, product, cvss_sev, cves FROM (SELECT v.id v, p.id p, max(v.name) vendor, max(p.name) product, c.cvss_sev, count(*) cves FROM cve c
JOIN cve_prod cp ON cp.cve_id = c.id JOIN product p ON p.id = cp.product_id JOIN vendor v ON v.id = p.vendor_id
WHERE c.state = 1 AND c.published >= {T1999} GROUP BY v.id, p.id, c.cvss_sev) ORDER BY cves DESC, p, cvss_sev NULLS FIRST LIMIT 100""",
)
add(
    "bq_product_drilldown",
    _drilldown,
    """SELECT product, cves FROM (SELECT p.id, max(p.name) product, count(*) cves FROM cve_prod cp JOIN product p ON p.id = cp.product_id
JOIN cve c ON c.id = cp.cve_id WHERE c.state = 1 AND p.vendor_id = (SELECT p2.vendor_id FROM cve_prod cp2 JOIN product p2 ON p2.id = cp2.product_id
GROUP BY 1 ORDER BY count(*) DESC, p2.vendor_id LIMIT 1) GROUP BY p.id) ORDER BY cves DESC, id LIMIT 25""",
)
add(
    "bq_cwe_top",
    lambda c: c.cve_cwe.join(_cve(c).selectExpr("id cve_id"), "cve_id").groupBy("cwe_id").agg(F.count("*").alias("cves")).join(c.cwe.selectExpr("id cwe_id", "cwe", "descr"), "cwe_id").orderBy(F.desc("cves"), "cwe_id").limit(25).select("cwe", "descr", "cves"),
    """SELECT cwe, descr, cves FROM (SELECT w.id, max(w.cwe) cwe, max(w.descr) descr, count(*) cves FROM cve_cwe x JOIN cwe w ON w.id = x.cwe_id
JOIN cve c ON c.id = x.cve_id WHERE c.state = 1 GROUP BY w.id) ORDER BY cves DESC, id LIMIT 25""",
)
add(
    "bq_reference_hosts",
    _hosts,
    """SELECT host, cves FROM (SELECT h.id, max(h.name) host, count(DISTINCT r.cve_id) cves FROM cve_ref r JOIN url u ON u.id = r.url_id
JOIN host h ON h.id = u.host_id GROUP BY h.id) ORDER BY cves DESC, id LIMIT 25""",
)

_WORD = "CASE c.cvss_sev WHEN 0 THEN 'NONE' WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH' WHEN 4 THEN 'CRITICAL' ELSE '(not scored)' END"
_word = lambda: F.expr(_WORD.replace("c.cvss_sev", "series")).alias("series")
add(
    "truth_severity_over_time",
    lambda c: R.cross(c, Filters(), "month", "severity").select("bucket", _word(), "cves"),
    f"SELECT {KEYS['month']} bucket, {_WORD} series, count(*) cves FROM cve c WHERE c.state = 1 GROUP BY 1, 2",
)
add(
    "truth_vendor_product_severity",
    lambda c: R.cross(c, Filters(published_from=T1999), "product", "severity").select(F.col("label").alias("bucket"), _word(), "cves"),
    f"{cross_sql('product', 'severity', f'c.state = 1 AND c.published >= {T1999}').replace('SELECT bucket, label, series, series_label, cves FROM cells', f'SELECT label AS bucket, {_WORD.replace('c.cvss_sev', 'series')} series, cves FROM (SELECT *, series s2 FROM cells)')}".replace("sum(cves) OVER (PARTITION BY bucket) DESC", "sum(cves) OVER (PARTITION BY bucket) DESC"),
)
add(
    "truth_critical_by_cna",
    lambda c: R.group(c, Filters(severity=[4]), "cna").filter("bucket is not null").select(F.col("label").alias("bucket"), "cves"),
    f"SELECT label AS bucket, cves FROM ({group_sql('cna', 'c.state = 1 AND cvss_sev = 4', 400)}) WHERE bucket IS NOT NULL",
)
add(
    "truth_top_cwes",
    lambda c: R.group(c, Filters(), "cwe").select(F.col("label").alias("bucket"), "cves"),
    """SELECT w.cwe || ' — ' || max(w.descr) bucket, count(DISTINCT c.id) cves FROM cve c JOIN cve_cwe x ON x.cve_id = c.id JOIN cwe w ON w.id = x.cwe_id
WHERE c.state = 1 GROUP BY w.id, w.cwe""",
)
add(
    "truth_kev_by_year",
    lambda c: R.group(c, Filters(kev=[1]), "year").select("bucket", "cves"),
    f"SELECT {KEYS['year']} bucket, count(*) cves FROM cve c WHERE c.state = 1 AND EXISTS ({KEV_OF}) GROUP BY 1",
)
add(
    "truth_vendor_criticals",
    lambda c: R.count(c, Filters(vendor=["BRAND#12"], severity=[4])),
    f"SELECT count(DISTINCT c.id) matches FROM cve c WHERE c.state = 1 AND c.cvss_sev = 4 AND EXISTS ({PROD_OF} AND lower(v.name) = 'brand#12')",
)
add(
    "truth_kev_listed",
    lambda c: R.detail(c, "cve-2000-0000007", ("exists",))["exists"].join(c.kev.selectExpr("cve_id id", "cve"), "id", "left").select("id", F.col("cve").isNotNull().cast("int").alias("listed")),
    """SELECT c.id, CASE WHEN k.cve IS NULL THEN 0 ELSE 1 END listed FROM cve c LEFT JOIN kev k ON k.cve_id = c.id WHERE lower(c.cve_id) = 'cve-2000-0000007'""",
)
add(
    "truth_highest_score",
    lambda c: _cve(c).groupBy("cvss_score").agg(F.count("*").alias("n")).filter("cvss_score is not null").orderBy(F.desc("cvss_score")).limit(1).select(F.col("cvss_score").alias("top"), "n"),
    "SELECT max(cvss_score) top, count(*) n FROM cve WHERE state = 1 AND cvss_score = (SELECT max(cvss_score) FROM cve WHERE state = 1)",
)
add(
    "truth_share_of_latest",
    lambda c: _cve(c).filter("cvss_sev = 4").orderBy(F.desc_nulls_last("published"), F.desc("id")).limit(200).agg(F.round(F.sum(F.expr("case when cvss_score >= 150000 then 1 else 0 end")) / F.count("*"), 2).alias("share")),
    """SELECT round(sum(CASE WHEN cvss_score >= 150000 THEN 1 ELSE 0 END)::DOUBLE / count(*), 2) "share" FROM (SELECT cvss_score FROM cve
WHERE state = 1 AND cvss_sev = 4 ORDER BY published DESC NULLS LAST, id DESC LIMIT 200)""",
)

# --- extents and details -----------------------------------------------------------------------------
add(
    "coverage_extents",
    R.coverage,
    '''SELECT a.*, k.*
FROM (SELECT count(*) records, min(published) published_min, max(published) published_max, min(updated) updated_min, max(updated) updated_max, min("year") year_min, max("year") year_max
FROM cve) a, (SELECT count(*) kev_records, min(added_at) kev_added_min, max(added_at) kev_added_max, min(due_at) kev_due_min, max(due_at) kev_due_max, sum(CASE WHEN cve_id IS NULL THEN 1 ELSE 0 END)::BIGINT kev_unmatched
FROM kev) k''',
)
_ID = "lower(c.cve_id) = (SELECT lower(cve_id) FROM cve WHERE id = 7)"


def _part(name):
    def query(c):
        # The identifier is part of the question; here it is that of record 7.
        return R.detail(c, next(iter(c.cve.filter("id = 7").select("cve_id").take(1)))["cve_id"].lower(), (name,))[name]

    return query


add(
    "detail_record",
    _part("record"),
    f'''SELECT c.cve_id, c.state, c."year", c.published, c.updated, c.cvss_ver, c.cvss_score, c.cvss_sev, c.cvss_vec, n.name cna, t.descr, t.title, t.reason, c.reserved, c.ssvc_expl, c.ssvc_auto, c.ssvc_impact
FROM cve c LEFT JOIN cna n ON n.id = c.cna_id LEFT JOIN cve_text t ON t.cve_id = c.id WHERE {_ID}''',
)
add("detail_cwes", _part("cwes"), f"SELECT w.cwe, w.descr FROM cve c JOIN cve_cwe x ON x.cve_id = c.id JOIN cwe w ON w.id = x.cwe_id WHERE {_ID}")
add(
    "detail_products",
    _part("products"),
    f"""SELECT v.name vendor, p.name product, cp.default_status FROM cve c JOIN cve_prod cp ON cp.cve_id = c.id JOIN product p ON p.id = cp.product_id LEFT
JOIN vendor v ON v.id = p.vendor_id WHERE {_ID}""",
)
add(
    "detail_versions",
    _part("versions"),
    f"""SELECT v.name vendor, p.name product, cv.status, cv.version, cv.lt, cv.lte, t.name vtype, cp.default_status FROM cve c
JOIN cve_ver cv ON cv.cve_id = c.id LEFT JOIN product p ON p.id = cv.product_id LEFT JOIN vendor v ON v.id = p.vendor_id LEFT
JOIN vtype t ON t.id = cv.vtype LEFT JOIN cve_prod cp ON cp.cve_id = c.id AND cp.product_id = cv.product_id WHERE {_ID}""",
)
add(
    "detail_refs",
    _part("refs"),
    f"""SELECT u.url, h.name host FROM cve c JOIN cve_ref r ON r.cve_id = c.id JOIN url u ON u.id = r.url_id LEFT JOIN host h ON h.id = u.host_id WHERE {_ID}""",
)
add(
    "detail_kev",
    lambda c: _part("kev")(c).drop("cwes"),
    f"SELECT k.added, k.due, k.name, k.descr, k.action, k.ransomware, k.notes, k.vendor, k.product FROM cve c JOIN kev k ON k.cve_id = c.id WHERE {_ID}",
)
