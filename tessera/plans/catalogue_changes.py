"""ETL, interning, change capture, the overlay, guarded SQL and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..model import once
from ..operators import etl, filters, idsets
from ..operators import reports as R
from ..sources import kev as K
from ..sources import store
from ..sources.sinks import digests
from ..streaming import changes as C
from ..streaming import streams
from . import guard
from .bind import SQL, corpus, kept, load, oracle, shown, whole
from .catalogue_reports import KEV_OF, cross_sql
from .report import parse, run

QUERIES, ORACLES = {}, {}


def add(name, query, sql):
    QUERIES[name] = lambda spark, sf, q=query: q(corpus(spark, sf))
    ORACLES[name] = oracle(sql)


def raw(name, query, sql):
    QUERIES[name], ORACLES[name] = query, sql


# --- normalize -----------------------------------------------------------------------------------
_DAY = "date_format(o_orderdate, 'yyyy-MM-dd')"
PATH = "concat('records/', o_orderkey % 10, '/', o_orderkey) path"
RAW = f"""to_json(struct(
  struct(concat(if(o_orderkey % 11 = 0, 'cve', 'CVE'), '-', 1999 + (o_orderkey - o_orderkey % 50 div 49) % 9, '-', lpad(o_orderkey - o_orderkey % 50 div 49, 7, '0')) cveId, if(o_orderstatus = 'P', 'REJECTED', 'PUBLISHED') state, concat('cna', o_custkey % 40) assignerShortName,
    concat({_DAY}, 'T01:02:03Z') datePublished, if(o_orderkey % 8 = 0, 'not a date', concat({_DAY}, 'T00:00:00+01:00')) dateUpdated) cveMetadata,
  struct(struct(concat('Title ', o_orderkey) title, array(struct('de' lang, 'nein' value), struct('en-US' lang, o_orderpriority value), struct('en' lang, o_orderstatus value)) descriptions,
      array(struct(concat('v', o_orderkey % 7) vendor, 'p1' product, if(o_orderkey % 2 = 0, 'unaffected', 'unknown') defaultStatus, array(struct('affected' status, '1.0' version, '2.0' lessThan)) versions),
            struct(concat('v', o_orderkey % 7) vendor, 'p1' product, if(o_orderkey % 3 = 0, 'affected', 'odd word') defaultStatus, array(struct('what' status, '*' version, string(null) lessThan)) versions)) affected,
      array(struct(array(struct(concat('cwe-', o_orderkey % 5) cweId, 'd' description)) descriptions)) problemTypes, array(struct(concat('https://Host', o_orderkey % 6, '.org/x') url), struct(concat('https://Host', o_orderkey % 6, '.org/x') url), struct('nothing' url)) references,
      array(struct(struct(string(floor(o_totalprice % 10)) baseScore, 'HIGH' baseSeverity, 'AV:N' vectorString) cvssV3_0),
            struct(struct(if(o_orderkey % 4 = 0, 'high', '7.5') baseScore, 'high' baseSeverity, 'V31' vectorString) cvssV3_0)) metrics) cna,
    array(struct(array(struct(struct('ssvc' type, struct(array(map('Exploitation', if(o_orderkey % 3 = 0, 'poc', 'odd')), map('Automatable', 'yes')) options) content) other,
      if(o_orderkey % 5 = 0, struct('9.9' baseScore, 'CRITICAL' baseSeverity, 'V4' vectorString), null) cvssV4_0)) metrics)) adp) containers)) text"""


def raw_records(spark, sf):
    """The records as they come from their files: path and text, in two files a core, as a clone's many files would be dealt."""
    return kept(spark, sf, "raw-records", lambda: load(spark, sf, "orders").selectExpr(PATH, RAW).repartition(2 * spark.sparkContext.defaultParallelism))


_GOOD = "o AS (SELECT *, o_orderkey - (o_orderkey % 50) // 49 k FROM orders), g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY 'CVE-' || (1999 + k % 9) || '-' || lpad(k::VARCHAR, 7, '0') ORDER BY 'records/' || (o_orderkey % 10) || '/' || o_orderkey) n FROM o))"
_CVE = "'CVE-' || (1999 + k % 9) || '-' || lpad(k::VARCHAR, 7, '0')"


def _projections(spark, sf):
    return etl.normalized(etl.parsed(raw_records(spark, sf))[0])


raw(
    "etl_scalars",
    lambda s, sf: _projections(s, sf).select("cve_id", "year", "state", "cna", "published", "updated", "descr", "title"),
    f"""WITH {_GOOD} SELECT {_CVE} cve_id, (1999 + k % 9)::INT "year",
CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END state, 'cna' || (o_custkey % 40) cna, epoch(o_orderdate::DATE)::BIGINT + 3723 published,
CASE WHEN o_orderkey % 8 <> 0 THEN epoch(o_orderdate::DATE)::BIGINT - 3600 END updated, o_orderpriority || chr(10) || o_orderstatus descr, 'Title ' || o_orderkey title
FROM g WHERE n = 1""",
)
raw(
    "cvss_preference_pick",
    lambda s, sf: _projections(s, sf).select("cve_id", "cvss_ver", "cvss_score", "cvss_sev", "cvss_vec"),
    f"""WITH {_GOOD} SELECT {_CVE} cve_id, CASE WHEN o_orderkey % 5 = 0 THEN 4 ELSE 30 END cvss_ver,
CASE WHEN o_orderkey % 5 = 0 THEN 9.9 ELSE floor(o_totalprice % 10)::DOUBLE END cvss_score, CASE WHEN o_orderkey % 5 = 0 THEN 4 ELSE 3 END cvss_sev,
CASE WHEN o_orderkey % 5 = 0 THEN 'V4' ELSE 'AV:N' END cvss_vec FROM g WHERE n = 1""",
)
raw(
    "ssvc_merge",
    lambda s, sf: _projections(s, sf).select("cve_id", "ssvc_expl", "ssvc_auto", "ssvc_impact"),
    f"WITH {_GOOD} SELECT {_CVE} cve_id, CASE WHEN o_orderkey % 3 = 0 THEN 1 END ssvc_expl, 1 ssvc_auto, NULL::INT ssvc_impact FROM g WHERE n = 1",
)
raw(
    "default_status_resolve",
    lambda s, sf: _projections(s, sf).select("cve_id", F.explode("products").alias("p")).select("cve_id", "p.*"),
    f"""WITH {_GOOD} SELECT {_CVE} cve_id, 'v' || (o_orderkey % 7) vendor, 'p1' product,
CASE WHEN o_orderkey % 3 = 0 THEN 1 WHEN o_orderkey % 2 = 0 THEN 2 ELSE 3 END default_status FROM g WHERE n = 1""",
)
raw(
    "etl_versions_bag",
    lambda s, sf: _projections(s, sf).select("cve_id", F.explode("versions").alias("v")).select("cve_id", "v.status", "v.version", "v.lt"),
    f"WITH {_GOOD} SELECT {_CVE} cve_id, s status, v version, l lt FROM g, (VALUES (1, '1.0', '2.0'), (0, '*', NULL)) t(s, v, l) WHERE n = 1",
)
raw(
    "etl_refs_distinct",
    lambda s, sf: _projections(s, sf).select("cve_id", F.explode("refs").alias("url")),
    f"""WITH {_GOOD} SELECT {_CVE} cve_id, u url FROM g, LATERAL (SELECT unnest(['https://Host' || (o_orderkey % 6) || '.org/x', 'nothing']) u) WHERE n = 1""",
)
raw(
    "etl_cwes",
    lambda s, sf: _projections(s, sf).select("cve_id", F.explode("cwes").alias("w")).select("cve_id", "w.cwe", "w.descr"),
    f"WITH {_GOOD} SELECT {_CVE} cve_id, 'CWE-' || (o_orderkey % 5) cwe, 'd' descr FROM g WHERE n = 1",
)
raw(
    "dedup_keep_first",
    lambda s, sf: etl.parsed(raw_records(s, sf))[1],
    f"WITH {_GOOD} SELECT 'records/' || (o_orderkey % 10) || '/' || o_orderkey \"path\", 'id seen before' reason FROM g WHERE n > 1",
)
raw(
    "etl_quarantine",
    lambda s, sf: etl.parsed(load(s, sf, "events").selectExpr("cast(event_id as string) path", "case event_id % 3 when 0 then props when 1 then substring(props, 1, 3) else concat('{\"cveMetadata\":{\"cveId\":\"CVE-2020-', 1000000 + event_id, '\"}}') end text"))[1],
    "SELECT event_id::VARCHAR \"path\", 'not a record' reason FROM events WHERE event_id % 3 <> 2",
)
raw(
    "etl_star_links",
    lambda s, sf: (lambda c: c.cve_prod.join(c.product.selectExpr("id product_id", "vendor_id", "name product"), "product_id").join(c.vendor.selectExpr("id vendor_id", "name vendor"), "vendor_id").join(c.cve.selectExpr("id", "cve_id c"), F.col("cve_id") == F.col("id")).select(F.col("c").alias("cve"), "vendor", "product", "default_status"))(etl.build(_projections(s, sf))[0]),
    f"""WITH {_GOOD} SELECT {_CVE} cve, 'v' || (o_orderkey % 7) vendor, 'p1' product,
CASE WHEN o_orderkey % 3 = 0 THEN 1 WHEN o_orderkey % 2 = 0 THEN 2 ELSE 3 END default_status FROM g WHERE n = 1""",
)
raw(
    "etl_star_hosts",
    lambda s, sf: (lambda c: c.url.join(c.host.selectExpr("id host_id", "name host"), "host_id", "left").select("url", "host"))(etl.build(_projections(s, sf))[0]),
    f"""WITH {_GOOD} SELECT DISTINCT 'https://Host' || (o_orderkey % 6) || '.org/x' url, 'host' || (o_orderkey % 6) || '.org' host FROM g WHERE n = 1
UNION ALL SELECT 'nothing', NULL""",
)

# --- interning -----------------------------------------------------------------------------------
_SEED = "seed AS (SELECT c_custkey AS id, c_name AS k FROM customer WHERE c_custkey % 3 = 0)"
_seed = lambda s, sf: load(s, sf, "customer").filter("c_custkey % 3 = 0").selectExpr("c_custkey id", "c_name k")
raw(
    "intern_first_ids",
    lambda s, sf: etl.intern(None, load(s, sf, "part").selectExpr("p_type k"), "k", 0),
    "SELECT row_number() OVER (ORDER BY md5(k), k) AS id, k, true fresh FROM (SELECT DISTINCT p_type k FROM part)",
)
raw(
    "intern_new_ids",
    lambda s, sf: etl.intern(_seed(s, sf), load(s, sf, "customer").filter("c_custkey % 5 <> 0").selectExpr("c_name k"), "k", 1_000_000),
    f"""WITH {_SEED}, used AS (SELECT DISTINCT c_name k FROM customer WHERE c_custkey % 5 <> 0) SELECT seed.id, k, false fresh FROM used JOIN seed USING (k)
UNION ALL SELECT 1000000 + row_number() OVER (ORDER BY md5(k), k), k, true FROM used WHERE k NOT IN (SELECT k FROM seed)""",
)
raw(
    "intern_moved",
    lambda s, sf: C.moved(load(s, sf, "supplier").selectExpr("s_suppkey id", "s_name name", "if(s_suppkey % 4 = 0, null, 'd') descr"), load(s, sf, "supplier").selectExpr("s_suppkey id", "s_name name", "if(s_suppkey % 6 = 0, 'new', 'd') descr")),
    """SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 6 = 0 THEN 'new' ELSE 'd' END descr FROM supplier
WHERE s_suppkey % 4 = 0 OR s_suppkey % 6 = 0""",
)


def _marks(spark, sf):
    """The mark of a table is its greatest id, or what was recorded before if that is greater; an empty table keeps what was recorded."""
    ids = load(spark, sf, "supplier").selectExpr("s_suppkey id")
    found = [("table", etl.high_water(ids)), ("recorded", etl.high_water(ids, 10**9)), ("lower", etl.high_water(ids, 1)), ("empty", etl.high_water(ids.limit(0), 7))]
    return spark.createDataFrame(found, "what string, high long")


raw(
    "high_water",
    _marks,
    "SELECT unnest(['table', 'lower']) what, max(s_suppkey) high FROM supplier UNION ALL SELECT * FROM (VALUES ('recorded', 1000000000), ('empty', 7))",
)

# --- change capture ------------------------------------------------------------------------------
_old = lambda s, sf: load(s, sf, "orders").filter("o_orderkey % 10 <> 3").selectExpr("o_orderkey cve_id", "md5(concat(o_orderpriority, if(o_orderkey % 4 = 0, 'old', ''))) hash")
_new = lambda s, sf: load(s, sf, "orders").filter("o_orderkey % 10 <> 7").selectExpr("o_orderkey cve_id", "md5(o_orderpriority) hash")
_diff = lambda kind: lambda s, sf: C.diff(_old(s, sf), _new(s, sf)).filter(F.col("kind") == kind).select("cve_id")
raw("diff_added", _diff("added"), "SELECT o_orderkey cve_id FROM orders WHERE o_orderkey % 10 = 3")
raw("diff_changed", _diff("changed"), "SELECT o_orderkey cve_id FROM orders WHERE o_orderkey % 10 NOT IN (3, 7) AND o_orderkey % 4 = 0")
raw("diff_deleted", _diff("deleted"), "SELECT o_orderkey cve_id FROM orders WHERE o_orderkey % 10 = 7")
_commit = lambda s, sf: C.commit_state(_old(s, sf).withColumn("rev", F.lit(1)), s.createDataFrame([(-5, 1), (7, 1)], "cve_id long, rev int"), _new(s, sf), C.diff(_old(s, sf), _new(s, sf)), 2)
raw(
    "apply_delta_state",
    lambda s, sf: _commit(s, sf)[0],
    """SELECT o_orderkey cve_id, md5(o_orderpriority) hash, CASE WHEN o_orderkey % 10 = 3 OR o_orderkey % 4 = 0 THEN 2 ELSE 1 END rev FROM orders
WHERE o_orderkey % 10 <> 7""",
)
raw(
    "tombstones",
    lambda s, sf: _commit(s, sf)[1],
    """SELECT o_orderkey cve_id, 2 rev FROM orders WHERE o_orderkey % 10 = 7 UNION ALL SELECT -5, 1 UNION ALL SELECT 7, 1 WHERE 7 NOT IN (SELECT o_orderkey
FROM orders WHERE o_orderkey % 10 = 7)""",
)
raw(
    "content_hash_changed",
    lambda s, sf: C.diff(etl.content_hash(load(s, sf, "orders").selectExpr("o_orderkey cve_id", "o_orderpriority a", "o_totalprice b")), etl.content_hash(load(s, sf, "orders").selectExpr("if(o_orderkey % 9 = 0, null, o_totalprice) b", "o_orderpriority a", "o_orderkey cve_id"))),
    "SELECT o_orderkey cve_id, 'changed' kind FROM orders WHERE o_orderkey % 9 = 0",
)


def _delta(c):
    before = c
    cve = c.cve.filter("id % 13 <> 5").withColumn("cvss_score", F.when(F.col("id") % 6 == 0, F.lit(1.0)).otherwise(F.col("cvss_score")))
    ids = once(lambda: idsets.made(cve))
    # The next revision: some records gone, some rescored, their links cut to the even products.
    after = c.having(cve=cve, cve_prod=once(lambda: idsets.within(c.cve_prod, ids(), "cve_id").filter("cve_id % 6 <> 0 or product_id % 2 = 0")), kev=None)
    changes = c.cve.filter("id % 13 = 5").selectExpr("cve_id", "'deleted' kind").unionByName(cve.filter("id % 6 = 0").selectExpr("cve_id", "'changed' kind"))
    return before, after, C.extract(before, after, changes, 1, 2, {"cna": 10**9, "product": 10**9, "cwe": 10**9, "vendor": 10**9, "host": 10**9, "url": 10**9, "vtype": 10**9})


def _applied(c):
    """The copy after the delta, its identifiers whole."""
    c = whole(c)
    return C.apply(c, _delta(c)[2])


def _cut(cve):
    """Records with the identifiers of the tables."""
    return cve.withColumn("cve_id", shown(F.col("cve_id")))


add(
    "delta_apply_records",
    lambda c: _cut(_applied(c).cve).select("id", "cve_id", "cvss_score"),
    "SELECT id, cve_id, CASE WHEN id % 6 = 0 THEN 1.0 ELSE cvss_score END cvss_score FROM cve WHERE id % 13 <> 5",
)
add(
    "delta_apply_links",
    lambda c: _applied(c).cve_prod,
    """SELECT cve_id, product_id, default_status FROM cve_prod WHERE cve_id % 13 <> 5 AND (cve_id % 6 <> 0 OR product_id % 2 = 0) AND cve_id IN (SELECT id
FROM cve)""",
)
add(
    "delta_apply_overlay",
    lambda c: K.unmatched(C.resolve(c.kev, _cut(_applied(c).cve))),  # by the identifiers of the tables, as in the SQL
    "SELECT sum(CASE WHEN cve NOT IN (SELECT cve_id FROM cve WHERE id % 13 <> 5) THEN 1 ELSE 0 END)::BIGINT unmatched FROM kev",
)
add(
    "closure_missing",
    lambda c: C.closure(_delta(whole(c))[2], c.having(product=c.product.filter("id % 50 <> 0"))).groupBy("table", "column").agg(F.count("*").alias("n")),
    """SELECT 'cve_prod' "table", 'product_id' "column", count(DISTINCT product_id) n FROM cve_prod
WHERE cve_id % 6 = 0 AND cve_id % 13 <> 5 AND product_id % 2 = 0 AND product_id % 50 = 0
UNION ALL SELECT 'cve_ver', 'product_id', count(DISTINCT product_id) FROM cve_ver WHERE cve_id % 6 = 0 AND cve_id % 13 <> 5 AND product_id % 50 = 0""",
)


def from_one(c):
    """The corpus with all ids one greater, as ids begin with 1 in a delta, and with whole identifiers."""
    c = whole(c)
    up = lambda df: df.select([(F.col(n) + 1).alias(n) if t == "bigint" and (n == "id" or n.endswith("_id") or n == "vtype") else F.col(n) for n, t in df.dtypes])
    return c.having(kev=None, postings=None, **{n: once(lambda n=n: up(getattr(c, n))) for n in ("cve", *C.LINKS, *C.LOOKUPS)})


def _faulty(c):
    """A delta with a fault of each kind planted in it."""
    c = from_one(c)
    good = _delta(c)[2]
    cve, prod = good.tables["cve"], good.tables["cve_prod"]
    bad_id = cve.filter("id = 24").withColumns({"id": F.lit(0).cast("long"), "cve_id": F.lit("no id")})
    cve = cve.filter("id <> 54").unionByName(cve.filter("id = 12")).unionByName(bad_id).withColumn("state", F.when(F.col("id") != 36, F.col("state")))
    prod = prod.unionByName(prod.filter("cve_id = 30")).unionByName(prod.filter("cve_id = 48").limit(1).withColumn("product_id", F.lit(-3).cast("long")))
    vendor = c.vendor.filter("id = 11").unionByName(c.vendor.filter("id = 11").withColumn("name", F.lit("twin")))
    gone = good.gone.unionByName(c.cve.filter("id = 12").select("cve_id"))
    return C.Delta(1, 2, good.lookups | {"vendor": vendor}, good.tables | {"cve": cve, "cve_prod": prod}, gone)


add(
    "delta_problems",
    lambda c: C.problems(_faulty(c)).distinct(),
    """one AS (SELECT id + 1 AS id, cve_id FROM cve), p AS (SELECT cve_id + 1 cve_id, product_id + 1 product_id FROM cve_prod WHERE product_id % 2 = 1),
lost AS (SELECT cve_id, 'cve_text' t FROM cve_text UNION SELECT cve_id, 'cve_cwe' FROM cve_cwe UNION SELECT cve_id, 'cve_ref' FROM cve_ref
UNION SELECT cve_id - 1, 'cve_prod' FROM p UNION SELECT cve_id, 'cve_ver' FROM cve_ver)
SELECT 'record twice' problem, cve_id "key" FROM one WHERE id = 12
UNION SELECT 'record id twice', '12' UNION SELECT 'both changed and deleted', cve_id FROM one WHERE id = 12
UNION SELECT 'identifier out of bounds', 'no id'
UNION SELECT 'cve lacks a value', '36' UNION SELECT 'cve_prod out of bounds', '48' FROM p WHERE cve_id = 48 UNION SELECT 'vendor twice', '11'
UNION SELECT 'cve_prod twice', '30' FROM p WHERE cve_id = 30 UNION SELECT t || ' of no record here', '54' FROM lost WHERE cve_id = 53""",
)
add(
    "delta_pairing",
    lambda c: (lambda c: C.pairing(_delta(c)[2], c.having(cve=c.cve.withColumn("id", F.when(F.col("id") == 12, -12).otherwise(F.col("id"))))))(whole(c)).select("id", "cve_id", "old_id"),
    "SELECT id, cve_id, -id old_id FROM cve WHERE id = 12 AND id % 6 = 0 AND id % 13 <> 5",
)


def _digests(spark, sf):
    """The manifest of files whose bytes are known: each region's name and a line feed."""
    path = f"{store.shared_dir(spark)}/files-{uuid.uuid4().hex}"
    load(spark, sf, "region").select("r_name").write.option("maxRecordsPerFile", 1).text(path)
    found = digests(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path))
    return found.filter("bytes > 0").select("bytes", "sha256")


raw("snapshot_digests", _digests, "SELECT strlen(r_name)::BIGINT + 1 bytes, sha256(r_name || chr(10)) sha256 FROM region")


# --- the overlay -----------------------------------------------------------------------------------
add("kev_histogram", lambda c: K.histogram(c.kev), "SELECT ransomware, count(*) entries FROM kev GROUP BY 1")
add("kev_unmatched", lambda c: K.unmatched(c.kev), "SELECT sum(CASE WHEN cve_id IS NULL THEN 1 ELSE 0 END)::BIGINT unmatched FROM kev")
_ENTRIES = ("case id % 6 when 0 then 'CVE-20-1' else cve_id end cveID", "'v' vendorProject", "'p' product", "'n' vulnerabilityName", "case id % 4 when 0 then '2024-02-30' else '2024-02-29' end dateAdded", "'d' shortDescription", "'a' requiredAction", "'2024-03-05' dueDate", "case id % 3 when 0 then 'Known' when 1 then 'Unknown' else 'else' end knownRansomwareCampaignUse", "'n' notes", "cast(null as array<string>) cwes")
add(
    "kev_validate",
    lambda c: K.invalid(c.cve.selectExpr(*_ENTRIES)).filter("problem <> 'id twice'").groupBy("problem").agg(F.count("*").alias("n")),
    "SELECT CASE WHEN id % 6 = 0 THEN 'bad id' ELSE 'unreal date added' END problem, count(*) n FROM cve WHERE id % 6 = 0 OR id % 4 = 0 GROUP BY 1",
)
add(
    "kev_apply",
    lambda c: K.overlay(c.cve.filter("id % 10 = 1").selectExpr(*[e.replace("case id % 6 when 0 then 'CVE-20-1' else cve_id end", "case id % 20 when 1 then cve_id else concat(cve_id, '9') end") for e in _ENTRIES]), c.cve).select("cve", "cve_id", "added_at", "due_at", "ransomware", F.size("cwes").alias("n")),
    """SELECT CASE WHEN id % 20 = 1 THEN cve_id ELSE cve_id || '9' END cve, CASE WHEN id % 20 = 1 THEN id END cve_id,
CASE WHEN id % 4 <> 0 THEN 1709164800 END::BIGINT added_at, 1709596800::BIGINT due_at, CASE id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END ransomware, 0 n
FROM cve WHERE id % 10 = 1""",
)

# --- composite operations ------------------------------------------------------------------------------
_REPORT = {"v": 1, "title": "t", "rows": "vendor", "series": "severity", "filters": {"severity": [4, 3], "kev": [1]}, "chart": "table"}
_W = f"c.state = 1 AND cvss_sev IN (3, 4) AND EXISTS ({KEV_OF})"
add("report_cells", lambda c: run(c, parse(_REPORT))[0], cross_sql("vendor", "severity", _W.replace(" k ", " k0 ").replace("k.", "k0."), 250, 24))
add("report_count", lambda c: run(c, parse(_REPORT))[1], f"SELECT count(*) matches FROM cve c WHERE {_W}")
add("search_unmatched", lambda c: filters.unmatched(c, "vendor", ["Brand#11", "nobody", " NONE "]), "SELECT unnest(['nobody', 'none']) name_key")
add(
    "rows_search",
    lambda c: R.rows(c, filters.Filters(state="all", text="the", severity=[4]), 100, 0, "score").select("cve", "cvss_score"),
    """SELECT c.cve_id cve, c.cvss_score FROM cve c JOIN cve_text t ON t.cve_id = c.id WHERE cvss_sev = 4
AND (list_contains(string_split_regex(strip_accents(lower(coalesce(descr, ''))), '[^\\p{L}\\p{N}]+'), 'the') OR list_contains(string_split_regex(lower(coalesce(title, '')), '[^\\p{L}\\p{N}]+'), 'the'))
ORDER BY c.cvss_score DESC NULLS LAST, c.id DESC LIMIT 101""",
)

# --- guarded SQL -----------------------------------------------------------------------------------


def sql(name, text, duck=None):
    QUERIES[f"sql_{name}"] = lambda spark, sf, t=text: guard.frame(spark, corpus(spark, sf), t)
    ORACLES[f"sql_{name}"] = oracle(duck or text)


sql(
    "window",
    """SELECT cna_id, id, row_number() OVER (PARTITION BY cna_id ORDER BY cvss_score DESC NULLS LAST, id) AS rn, lag(id) OVER (PARTITION BY cna_id
ORDER BY id) AS before FROM cve""",
)
sql("union", "SELECT id AS k FROM vendor UNION SELECT id AS k FROM host")
sql("union_all", "SELECT id AS k FROM vendor UNION ALL SELECT id AS k FROM host")
sql("intersect", "SELECT id AS k FROM vendor INTERSECT SELECT id AS k FROM host")
sql("except", "SELECT id AS k FROM host EXCEPT SELECT id AS k FROM vendor")
sql(
    "cte_filter_agg",
    """WITH t AS (SELECT cvss_sev, count(*) FILTER (WHERE state = 2) AS rejected, count(*) AS n FROM cve GROUP BY cvss_sev)
SELECT cvss_sev, rejected, n FROM t WHERE n > 10""",
    """t AS (SELECT cvss_sev, count(*) FILTER (WHERE state = 2) rejected, count(*) n FROM cve GROUP BY cvss_sev)
SELECT cvss_sev, rejected, n FROM t WHERE n > 10""",
)
sql(
    "exists_scalar",
    """SELECT v.id, v.name, (SELECT count(*) FROM product p WHERE p.vendor_id = v.id) AS products FROM vendor v WHERE EXISTS (SELECT 1 FROM product p
WHERE p.vendor_id = v.id AND p.id < 40)""",
)
sql("rollup", "SELECT state, cvss_sev, count(*) AS n FROM cve GROUP BY ROLLUP (state, cvss_sev)")
sql(
    "group_concat",
    "SELECT vendor_id, listagg(name, ',') WITHIN GROUP (ORDER BY id) AS names FROM product GROUP BY vendor_id",
    "SELECT vendor_id, string_agg(name, ',' ORDER BY id) AS names FROM product GROUP BY vendor_id",
)
sql(
    "functions",
    """SELECT id, substring(cve_id, 5, 4) AS y, instr(cve_id, '-') AS dash, upper(cvss_vec) AS u, coalesce(cvss_sev, -1) AS s, nullif(state, 2) AS st, greatest(id, 100) AS g, format_string('%05d', id) AS f
FROM cve""",
    """SELECT id, substring(cve_id, 5, 4) AS y, instr(cve_id, '-')::INT AS dash, upper(cvss_vec) AS u, coalesce(cvss_sev, -1) AS s, nullif(state, 2) AS st, greatest(id, 100) AS g, printf('%05d', id) AS f
FROM cve""",
)
_WALK = """t(id, name, depth) AS (SELECT id, name, 0 FROM host WHERE id = (SELECT min(id) FROM host)
UNION ALL SELECT h.id, h.name, t.depth + 1 FROM t JOIN host h ON h.id = t.id * 2 OR h.id = t.id + 3 WHERE t.depth < 4) SELECT id, name, depth FROM t"""
sql("recursive", f"WITH RECURSIVE {_WALK}")
ORACLES["sql_recursive"] = f"WITH RECURSIVE {SQL.strip()},\n{_WALK}"

# --- streams (an addition, no counterpart in the data model) -----------------------------------------
raw(
    "events_by_week",
    lambda s, sf: streams.counts_by_window(load(s, sf, "events")),
    "SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') bucket, event_type, count(*) events FROM events GROUP BY 1, 2",
)
raw(
    "events_dedup",
    lambda s, sf: streams.deduplicated(load(s, sf, "events").unionByName(load(s, sf, "events"))).groupBy("event_type").agg(F.count("*").alias("n")),
    "SELECT event_type, count(DISTINCT event_id) n FROM events GROUP BY 1",
)
