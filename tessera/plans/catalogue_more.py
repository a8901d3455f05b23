"""Storage of revisions, deltas and indexes, lineage, search in one call, tools, saved reports, dates and scores."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import times
from ..model import CatalogMissing
from ..operators import budget, chart, etl, filters
from ..operators import reports as R
from ..operators.filters import Filters
from ..sources import kev as K
from ..sources import records, sinks, store
from ..streaming import changes as C
from . import guard, report, tools
from . import score as S
from .bind import corpus, load, oracle, views
from .catalogue_changes import _delta, raw_records, from_one
from .catalogue_reports import KEV_OF, cross_sql, group_sql

QUERIES, ORACLES = {}, {}


def add(name, query, sql, over=corpus):
    QUERIES[name] = lambda spark, sf, q=query: q(over(spark, sf))
    ORACLES[name] = oracle(sql)


def raw(name, query, sql):
    QUERIES[name], ORACLES[name] = query, sql


def told(name, schema, query, sql, over=corpus):
    """A query whose answer is made of single values: rows of this schema."""
    QUERIES[name] = lambda spark, sf, q=query: spark.createDataFrame(q(over(spark, sf)), schema)
    ORACLES[name] = oracle(sql)


def folder(spark) -> str:
    return f"{store.shared_dir(spark)}/try-{uuid.uuid4().hex}"


def half_up(number: str) -> float:
    """Two places, a half away from zero, as SQL rounds."""
    return float(Decimal(number).quantize(Decimal("0.01"), ROUND_HALF_UP))


def refused(act) -> str:
    """Why something isn't done; empty if it is."""
    try:
        act()
    except (C.Refused, CatalogMissing, guard.Denied, ValueError) as e:
        return type(e).__name__
    return ""


# --- revisions and deltas on disk ----------------------------------------------------------------------
# Queries that save the whole corpus do so from the given tables (``views``), and read what they saved.


def _saved(c):
    path = folder(c.cve.sparkSession)
    C.save(c.having(kev=None, postings=None), path, 3)
    return C.load(c.cve.sparkSession, path, 3)


add(
    "revision_round_trip",
    lambda c: _saved(c).cve_prod,
    "SELECT cve_id, product_id, default_status FROM cve_prod",
)


def _published(c):
    """A delta that is written, read with all its checks, and applied by a sync that moves the pointer."""
    spark = c.cve.sparkSession
    copy, deltas = folder(spark), folder(spark)
    C.save(from_one(c), copy, 1)
    small = C.load(spark, copy, 1)
    delta = _delta(small)[2]
    ids = delta.tables["cve"].selectExpr("id cve_id")
    links = {n: t.join(ids, "cve_id", "left_semi").select(t.columns) for n, t in delta.tables.items() if n != "cve"}
    C.write_delta(C.Delta(1, 2, delta.lookups, {"cve": delta.tables["cve"]} | links, delta.gone), deltas)
    C.sync(spark, copy, deltas, [(1, 2)], 2)
    C.tidy(spark, copy)
    return C.load(spark, copy, 2)


add(
    "delta_sync",
    lambda c: _published(c).cve.select("id", "cvss_score"),
    "SELECT id + 1 AS id, CASE WHEN (id + 1) % 6 = 0 THEN 1.0 ELSE cvss_score END cvss_score FROM cve WHERE (id + 1) % 13 <> 5",
    views,
)


def _resumed(c):
    """A pinned run that is finished after a break, and asked again."""
    spark = c.cve.sparkSession
    copy, deltas = folder(spark), folder(spark)
    C.save(c.having(kev=None, postings=None), copy, 1)
    small = C.load(spark, copy, 1)
    after = small.having(cve=small.cve.filter("id <> 7"))
    changes = small.cve.filter("id = 7").selectExpr("cve_id", "'deleted' kind")
    high = {n: 10**9 for n in C.LOOKUPS}
    C.begin(spark, copy, 1, 2, 1_700_000_000, high, changes)
    again = refused(lambda: C.begin(spark, copy, 1, 2, 0, high, changes))
    first = C.resume(spark, copy, small, after, deltas)
    second = C.resume(spark, copy, small, after, deltas)
    gone = C.read_delta(spark, deltas, 1, 2).gone.count()
    return [("pinned twice", again), ("resumed", str(first)), ("resumed again", str(second)), ("current", str(C.current(spark, copy))), ("gone", str(gone))]


told(
    "pending_run",
    "what string, answer string",
    _resumed,
    "SELECT * FROM (VALUES ('pinned twice', 'Refused'), ('resumed', '2'), ('resumed again', 'None'), ('current', '2'), ('gone', '1')) t(what, answer)",
    views,
)


def _envelopes(c):
    columns = {n: {"columns": [x.split()[0] for x in C.shape(n).split(", ")], "rows": 0, "digest": ""} for n in [*C.LOOKUPS, "cve", *C.LINKS, "gone"]}
    good = {"from": 1, "to": 2, "generated": 0, "tables": columns}
    short = columns | {"cve": {**columns["cve"], "columns": columns["cve"]["columns"][1:]}}
    cases = [("good", good), ("key", {**good, "more": 1}), ("type", {**good, "to": "2"}), ("sign", {**good, "from": -1}), ("table", {**good, "tables": {k: v for k, v in columns.items() if k != "cve_ref"}}), ("arity", {**good, "tables": short}), ("other", {**good, "from": 0}), ("list", [])]
    return [(n, refused(lambda e=e: C.validate(json.loads(json.dumps(e)), 1, 2))) for n, e in cases]


told(
    "delta_envelope",
    "what string, answer string",
    _envelopes,
    "SELECT unnest(['key', 'type', 'sign', 'table', 'arity', 'other', 'list']) what, 'Refused' answer UNION ALL SELECT 'good', ''",
)


def _lineage(c):
    """Fingerprints of the lookups' ids: those of the corpus, and of one whose assigners begin elsewhere."""
    seed = {n: etl.fingerprint(getattr(c, n).select("id", "name")) for n in ("cna", "vendor", "host")}
    sibling = seed | {"cna": etl.fingerprint(c.cna.select((F.col("id") + 1).alias("id"), "name"))}
    held = {"token": "t", "space": {"3": seed}}
    cases = [
        ("same", lambda: C.check_lineage(held, "t", True, 3, seed)),
        ("no token", lambda: C.check_lineage(held, None, True)),
        ("other token", lambda: C.check_lineage(held, "u", True)),
        ("unknown", lambda: C.check_lineage({"token": None, "space": {}}, "t", True)),
        ("adopted", lambda: C.check_lineage({"token": None, "space": {}}, "t", True, adopt=True)),
        ("first", lambda: C.check_lineage({"token": None, "space": {}}, "t", False)),
        ("unrecorded", lambda: C.check_lineage(held, "t", True, 2, seed)),
        ("sibling", lambda: C.check_lineage(held, "t", True, 3, sibling)),
    ]
    return [(n, refused(f)) for n, f in cases]


told(
    "id_lineage",
    "what string, answer string",
    _lineage,
    """SELECT unnest(['no token', 'other token', 'unknown', 'unrecorded', 'sibling']) what, 'Refused' answer
UNION ALL SELECT unnest(['same', 'adopted', 'first']), ''""",
)


def _prints(c):
    """Fingerprints don't depend on the order or the files of a table, and tell one changed value."""
    t = c.vendor
    same = etl.fingerprint(t) == etl.fingerprint(t.orderBy(F.desc("name")).repartition(3))
    other = etl.fingerprint(t) == etl.fingerprint(t.withColumn("name", F.when(F.col("id") == 11, "x").otherwise(F.col("name"))))
    return [("reordered", same), ("changed", other)]


told("id_fingerprint", "what string, same boolean", _prints, "SELECT * FROM (VALUES ('reordered', true), ('changed', false)) t(what, same)")


def _guards(c):
    changes = c.cve.selectExpr("cve_id", "case when id % 5 = 0 then 'deleted' else 'changed' end kind")
    n = c.cve.count()
    return [
        ("too many", refused(lambda: C.guard_deletions(changes, n))),
        ("few enough", refused(lambda: C.guard_deletions(changes, n, 0.9))),
        ("no limit", refused(lambda: C.guard_deletions(changes, n, 1))),
        ("passes differ", refused(lambda: C.cross_check(records=(1, 2)))),
        ("no catalog", refused(lambda: filters.require_kev(c.having(kev=None), Filters(kev=(1,))))),
        ("wrong revision", refused(lambda: C.check(_delta(c)[2], c, 9))),
    ]


told(
    "guards",
    "what string, answer string",
    _guards,
    """SELECT *
FROM (VALUES ('too many', 'Refused'), ('few enough', ''), ('no limit', 'ValueError'), ('passes differ', 'Refused'), ('no catalog', 'CatalogMissing'), ('wrong revision', 'Refused')) t(what, answer)""",
)


def _planned(c):
    """Of each revision of a graph over the ids of weaknesses (each leads to the next, some to the fourth after it) the way to the last one, and what a rotation keeps."""
    ids = sorted(r["id"] for r in c.cwe.select("id").collect())  # a manifest's revisions
    head = ids[-1]
    edges = [(a, a + 1) for a in ids if a < head] + [(a, a + 4) for a in ids if a % 3 == 0 and a + 4 <= head and a != 6]
    plans = [(r, C.plan_sync(edges, r, head)) for r in ids]
    kept, serve, floor = C.rotation(ids, edges, 5)
    return [(r, len(p), p[0][1] - r if p else 0, r in kept, sum(e[0] == r for e in serve), r >= floor) for r, p in plans]


told(
    "sync_plan",
    "rev long, files int, first_step long, kept boolean, deltas int, served boolean",
    _planned,
    """edge AS (SELECT id a, id + 1 b FROM cwe WHERE id < (SELECT max(id) FROM cwe)
UNION ALL SELECT id, id + 4 FROM cwe WHERE id % 3 = 0 AND id + 4 <= (SELECT max(id) FROM cwe) AND id <> 6),
way AS (SELECT * FROM (WITH RECURSIVE w(rev, pos, n, step) AS (SELECT id, id, 0, 0::BIGINT FROM cwe
UNION ALL SELECT w.rev, e.b, n + 1, CASE WHEN n = 0 THEN e.b - e.a ELSE step END FROM w JOIN edge e ON e.a = w.pos) SELECT rev, pos, n, step FROM w)),
done AS (SELECT rev, n, max(step) step FROM way WHERE pos = (SELECT max(id) FROM cwe) GROUP BY rev, n),
best AS (SELECT rev, min(n) n, arg_min(step, n) step FROM done GROUP BY rev)
SELECT rev, n::INT files, step first_step, rev > (SELECT max(id) - 5 FROM cwe) kept, (SELECT count(*) FROM edge WHERE a = rev AND a > (SELECT max(id) - 5 FROM cwe))::INT deltas, rev > (SELECT max(id) - 5 FROM cwe) served FROM best""",
)
told(
    "promotion_gate",
    "what string",
    lambda c: [(x,) for x in C.promotable(c.having(host=c.host.withColumn("more", F.lit(1)), kev=None), 9, 5, " ")],
    "SELECT unnest(['table host has other columns', 'no notice', 'revision beyond the head']) what",
)


def _texts_kept(spark, sf):
    """The given tables, with the texts and their index as they are bound: many tasks work on them."""
    bound = corpus(spark, sf)
    return views(spark, sf).having(cve_text=lambda: bound.cve_text, postings=lambda: bound.postings)


add(
    "hosted_copy",
    lambda c: (lambda h: h.postings.filter("term = 'the'").select("doc").distinct())(C.hosted(c, folder(c.cve.sparkSession), 1)),
    """SELECT cve_id AS doc FROM cve_text
WHERE regexp_matches(' ' || lower(coalesce(descr, '') || ' ' || coalesce(title, '')) || ' ', '[^\\p{L}\\p{N}]the[^\\p{L}\\p{N}]')""",
    _texts_kept,
)


def _listed(spark, sf):
    """Record files in folders, found by their names and read whole."""
    path = folder(spark)
    for r in load(spark, sf, "nation").select("n_nationkey").collect():  # 25 rows
        k = r["n_nationkey"]
        store.put(spark, f"{path}/{k % 3}/{'CVE-1-' if k % 5 else 'other-'}{k}.json", json.dumps({"n": k}))
    return records.files(spark, path).select(F.get_json_object("text", "$.n").cast("long").alias("n"))


raw("record_files", _listed, "SELECT n_nationkey::BIGINT n FROM nation WHERE n_nationkey % 5 <> 0")
raw(
    "etl_storable",
    lambda s, sf: etl.parsed(raw_records(s, sf).withColumn("text", F.expr(r"case cast(regexp_extract(path, '(\\d+)$', 1) as int) % 4 when 0 then replace(text, 'Title ', '\\ud83d ') when 1 then replace(text, 'Title ', '\\ud83d\\ude00 ') else text end")))[1].filter("reason = 'text that can\\'t be stored'"),
    "SELECT 'records/' || (o_orderkey % 10) || '/' || o_orderkey \"path\", 'text that can''t be stored' reason FROM orders WHERE o_orderkey % 4 = 0",
)

# --- search, tools and reports ---------------------------------------------------------------------------
_ASKED = Filters(severity=[4], vendor=["Brand#11", "nobody"])
_WHERE = "c.state = 1 AND cvss_sev = 4 AND EXISTS (SELECT 1 FROM cve_prod x JOIN product q ON q.id = x.product_id JOIN vendor w ON w.id = q.vendor_id WHERE x.cve_id = c.id AND lower(w.name) = 'brand#11')"
add("search_groups", lambda c: R.search(c, _ASKED, "year").rows, group_sql("year", _WHERE, 400))
add("search_matches", lambda c: R.search(c, _ASKED).matches, f"SELECT count(*) matches FROM cve c WHERE {_WHERE}")
add("search_names", lambda c: R.search(c, _ASKED, counted=False).unmatched["vendor"], "SELECT 'nobody' name_key")


def _call(c, tool, args):
    """What a tool answers from, as Spark has it."""
    return tools.frame(c, tools.parse_call(tool, args)).select("bucket", "cves")


add(
    "tool_aggregate",
    lambda c: _call(c, "aggregate", {"rows": "year", "severity": "critical"}),
    f"SELECT bucket, cves FROM ({group_sql('year', 'c.state = 1 AND cvss_sev = 4', 400)})",
)
told(
    "tool_windows",
    "what string, answer string",
    lambda c: [
        ("arguments", refused(lambda: tools.parse_call("aggregate", {"rows": "x"}))),
        ("listed", str(tools.run(c.cve.sparkSession, c, tools.parse_call("kev_lookup", {"cve": "cve-0000-0"}))["known"])),
        ("window", str(len(tools.describe(guard.Answer(["a"], [("x" * 500,)] * 99, True, False), 7).splitlines()))),
        ("compute", tools.compute("return sum(r[0] for r in rows)", guard.Answer(["n"], [(1,), (2,)], False, False))[1]),
    ],
    "SELECT * FROM (VALUES ('arguments', 'BadCall'), ('listed', 'False'), ('window', '9'), ('compute', '3')) t(what, answer)",
)


def _guarded(c):
    run = lambda sql, **k: guard.run(c.cve.sparkSession, c, sql, **k)
    deny = lambda sql: refused(lambda: guard.inspect(c.cve.sparkSession, sql, set(c.tables())))
    wide = run("SELECT collect_list(cve_id) l, encode('ab', 'UTF-8') b FROM cve GROUP BY id div 4096", cell=50)
    over = run("SELECT repeat('x', 100) FROM cve", chars=450)
    return [
        ("rows", str(len(run("SELECT id FROM cve", rows=5).rows))),
        ("truncated", str(run("SELECT id FROM cve", rows=5).truncated)),
        ("cells", str([len(x) for x in wide.rows[0]])),
        ("characters", f"{len(over.rows)} {over.truncated} {over.overflowed}"),
        ("hosted", str(len(run("SELECT id FROM cve", **guard.HOSTED).rows) == min(c.cve.count(), guard.HOSTED["rows"]))),
        ("generators", str(run("SELECT x FROM (SELECT array(1, 2) a) LATERAL VIEW explode(a) t AS x").rows)),
        ("reflection", deny("SELECT java_method('java.lang.System', 'nanoTime')")),
        ("computed name", deny("SELECT IDENTIFIER('java_method')('java.lang.System', 'nanoTime')")),
        ("computed table", deny("SELECT * FROM IDENTIFIER('other')")),
        ("long", deny("SELECT 1 -- " + "x" * 70_000)),
    ]


told(
    "guard_limits",
    "what string, answer string",
    _guarded,
    """SELECT *
FROM (VALUES ('rows', '5'), ('truncated', 'True'), ('cells', '[50, 4]'), ('characters', '4 True True'), ('hosted', 'True'), ('generators', '[(1,), (2,)]'), ('reflection', 'Denied'), ('computed name', 'Denied'), ('computed table', 'Denied'), ('long', 'Denied')) t(what, answer)""",
)


def _reports(c):
    """Each vendor's report: whether it comes back whole from its fragment and its form, its file's name, and its name inside a statement."""
    out, shelf = [], report.Shelf(most_recent=2)
    for r in c.vendor.orderBy("id").collect():  # 25 names
        value = {"v": 1, "title": r["name"], "rows": "month", "series": "severity", "filters": {"severity": [r["id"] % 5, -1], "vendor": [r["name"]], "score_min": r["id"] % 10}}
        made = report.parse(value)
        f = Filters(severity=(r["id"] % 5, -1), vendor=(r["name"],), published_from=1_704_067_200 + 86_400 * r["id"], score_min=float(r["id"] % 10))
        for _ in range(2):
            shelf.save(made)
            shelf.visit(made)
        refusal = refused(lambda value=value: report.parse({**value, "more": 1}))
        out.append((r["id"], report.from_fragment(report.to_fragment(made)) == made, report.from_form(report.to_form(f)) == f, T.slug(r["name"] + "/x!"), T.inline("a = ? and b = '?'", [r["name"] + "'"]), refusal, len(shelf.saved), len(shelf.recent)))
    return out


told(
    "report_forms",
    "id long, fragment boolean, form boolean, slug string, inlined string, unknown_key string, saved int, recent int",
    _reports,
    """SELECT id, true fragment, true form, lower(replace(name, '#', '-')) || '-x' slug, 'a = ''' || name || ''''''' and b = ''?''' inlined, 'Invalid' unknown_key,
row_number() OVER (ORDER BY id)::INT saved, least(row_number() OVER (ORDER BY id), 2)::INT recent FROM vendor""",
)

# --- scores ------------------------------------------------------------------------------------------------


def _scored(c):
    spark = c.cve.sparkSession
    truth = R.group(c, Filters(), "year").select("bucket", "cves")
    few = truth.orderBy("bucket").limit(3)
    wrong = few.withColumn("cves", F.col("cves") + 1)
    ask = S.Question("by year", ("aggregate", "sql"), S.CELLS, ("year",))
    n = S.Question("how many", ("aggregate",))
    one = R.count(c, Filters())
    cases = [
        ("subset", S.score(ask, [S.Step("aggregate", True, few, "year")], truth)),
        ("wrong cells", S.score(ask, [S.Step("aggregate", True, wrong, "month")], truth)),
        ("last answer counts", S.score(ask, [S.Step("aggregate", True, wrong), S.Step("sql", True, few)], truth)),
        ("other tool", S.score(ask, [S.Step("compute", True, few)], truth)),
        ("exact", S.score(n, [S.Step("aggregate", True, one)], one)),
        ("inexact", S.score(n, [S.Step("aggregate", True, spark.createDataFrame([(0,)], "matches long"))], one)),
    ]
    return [(k, s.tool, s.axes, s.data, s.emitted) for k, s in cases]


told(
    "scores",
    "what string, tool boolean, axes boolean, data boolean, emitted int",
    _scored,
    """SELECT *
FROM (VALUES ('subset', true, true, true, 3), ('wrong cells', true, false, false, 3), ('last answer counts', true, false, true, 3), ('other tool', false, NULL, false, NULL), ('exact', true, NULL, true, NULL), ('inexact', true, NULL, false, NULL)) t(what, tool, axes, data, emitted)""",
)
add(
    "truth_search_and_code",
    lambda c: R.count(c, Filters(text="the", severity=[4])),
    """SELECT count(*) matches FROM cve c JOIN cve_text t ON t.cve_id = c.id
WHERE c.state = 1 AND c.cvss_sev = 4 AND regexp_matches(' ' || lower(coalesce(descr, '')) || ' ' || lower(coalesce(title, '')) || ' ', '[^\\p{L}\\p{N}]the[^\\p{L}\\p{N}]')""",
)
told(
    "truth_compute_share",
    "share double",
    lambda c: [
        (
            half_up(
                tools.compute(
                    "return sum(d['cvss_score'] >= 150000 for d in data) / len(data)",
                    guard.run(c.cve.sparkSession, c, "SELECT cvss_score FROM cve WHERE state = 1 AND cvss_sev = 4 AND cvss_score IS NOT NULL ORDER BY published DESC NULLS LAST, id DESC LIMIT 200"),
                )[1]
            ),
        )
    ],
    """SELECT round(sum(CASE WHEN cvss_score >= 150000 THEN 1 ELSE 0 END)::DOUBLE / count(*), 2) "share" FROM (SELECT cvss_score FROM cve
WHERE state = 1 AND cvss_sev = 4 AND cvss_score IS NOT NULL ORDER BY published DESC NULLS LAST, id DESC LIMIT 200)""",
)

# --- charts, exports, the overlay ------------------------------------------------------------------------
_YV = cross_sql("vendor", "severity", "c.state = 1")
_CELLS = f"{_YV.rpartition(chr(10) + 'SELECT ')[0]},\nq AS (SELECT {_YV.rpartition(chr(10) + 'SELECT ')[2]})"
_vendors = lambda c: R.cross(c, Filters(), "vendor", "severity")
add(
    "chart_rows_shown",
    lambda c: chart.rows_shown(_vendors(c), "vendor", 5)[0].groupBy("bucket", "place").agg(F.sum("cves").alias("total")),
    f"""{_CELLS}
SELECT bucket, row_number() OVER (ORDER BY sum(cves) DESC, bucket)::INT place, sum(cves)::BIGINT total FROM q GROUP BY 1 QUALIFY place <= 5""",
)
add(
    "chart_rows_dropped",
    lambda c: chart.rows_shown(_vendors(c), "vendor", 5)[1],
    f"{_CELLS}\nSELECT greatest(count(DISTINCT bucket) - 5, 0) dropped_rows FROM q",
)
told(
    "export_disclosure",
    "line string",
    lambda c: [(x.strip(),) for x in list(sinks.export(c, Filters(severity=[4]), {"made": "a\nb"}, most=7))[:3]],
    """n AS (SELECT count(*) n FROM cve WHERE state = 1 AND cvss_sev = 4)
SELECT '# made: a b' line UNION ALL SELECT '# records: 7 of ' || n FROM n UNION ALL SELECT '# truncated: the first 7'""",
)


def _catalog(c):
    """The sample catalog as a feed's bytes, read, checked, ordered and laid over the records."""
    spark, now = c.cve.sparkSession, dt.datetime(2026, 6, 1, tzinfo=dt.UTC)
    sample = K.sample(c.cve, 3)
    blob = json.dumps(sample).encode()
    twice = {**sample, "vulnerabilities": sample["vulnerabilities"] + sample["vulnerabilities"][:1], "count": 6}
    return [
        ("loaded", str(K.load(spark, blob, c.cve, now).filter("cve_id is not null").count())),
        ("twice", str([r["problem"] for r in K.invalid(K.entries(spark, twice)).collect()])),
        ("count", refused(lambda: K.header(json.dumps({**sample, "count": 1}).encode(), now))),
        ("future", refused(lambda: K.header(blob, dt.datetime(2025, 1, 1, tzinfo=dt.UTC)))),
        ("newer", str(K.is_newer("2026.01.02", "2026.01.01"))),
        ("older", str(K.is_newer("2025.12.31.9", "2026.01.01"))),
    ]


told(
    "kev_feed",
    "what string, answer string",
    _catalog,
    """SELECT *
FROM (VALUES ('loaded', '3'), ('twice', '[''id twice'']'), ('count', 'Refused'), ('future', 'Refused'), ('newer', 'True'), ('older', 'False')) t(what, answer)""",
)
add(
    "overlay_needed",
    lambda c: R.count(c, Filters(kev=[1], severity=[4])),
    f"SELECT count(*) matches FROM cve c WHERE c.state = 1 AND cvss_sev = 4 AND EXISTS ({KEV_OF})",
)

# --- dates and small functions ---------------------------------------------------------------------------
raw(
    "day_ends",
    lambda s, sf: load(s, sf, "events").select("event_id", times.day_end(times.day_seconds(F.date_format("ts", "yyyy-MM-dd"))).alias("last")),
    "SELECT event_id, epoch(ts::DATE)::BIGINT + 86399 \"last\" FROM events",
)
raw(
    "notes_split",
    lambda s, sf: load(s, sf, "pages").select("page_id", F.explode(T.notes(F.concat(F.lit("first;; see "), "url", F.lit(" now ;")))).alias("n")).select("page_id", "n.text", "n.url"),
    "SELECT page_id, 'first' \"text\", NULL url FROM pages UNION ALL SELECT page_id, 'see ' || url || ' now', url FROM pages",
)


def _days(c):
    return c.cve.select(times.moment("published").cast("date").alias("today")).filter("today is not null").distinct()


_DAYS = "days AS (SELECT DISTINCT make_timestamp(published * 1000000)::DATE today FROM cve WHERE published IS NOT NULL)"
_LOW, _HIGH = dt.date(1997, 6, 1), dt.date(2000, 2, 10)
add(
    "date_shortcuts",
    lambda c: times.ranges(_days(c), times.SHORTCUTS, F.lit(_LOW), F.lit(_HIGH)),
    f"""{_DAYS},
r AS (SELECT today, '30d' AS name, today - 29 "first", today "last" FROM days UNION ALL SELECT today, '90d', today - 89, today FROM days
UNION ALL SELECT today, '12m', (today - INTERVAL 12 MONTH)::DATE + 1, today FROM days UNION ALL SELECT today, '24m', (today - INTERVAL 24 MONTH)::DATE + 1, today FROM days
UNION ALL SELECT today, 'ytd', date_trunc('year', today)::DATE, today FROM days UNION ALL SELECT today, 'prev-year', (date_trunc('year', today) - INTERVAL 1 YEAR)::DATE, date_trunc('year', today)::DATE - 1 FROM days)
SELECT today, name, greatest("first", DATE '{_LOW}') "first", least("last", DATE '{_HIGH}') "last" FROM r WHERE "first" <= DATE '{_HIGH}' AND "last" >= DATE '{_LOW}'
UNION ALL SELECT today, 'all', NULL, NULL FROM days""",
)
add(
    "date_quick_ranges",
    lambda c: times.opened(_days(c)),
    f"""{_DAYS}
SELECT today, n::VARCHAR || 'y' AS name, date_trunc('week', today - to_years(n::INT))::DATE "first" FROM days, (VALUES (10), (5), (2), (1)) v(n)
UNION ALL SELECT today, 'ytd', date_trunc('year', today)::DATE FROM days UNION ALL SELECT today, 'all', NULL FROM days""",
)


def _spans(c):
    """Of each year of the records: the days that its number means, the buckets from its first day to the last of all, the grain for so many, and how old it is then."""
    years = sorted(r["y"] for r in c.cve.select(times.year_of().alias("y")).distinct().collect() if r["y"])  # as many as there are years
    last = times.lenient_day(years[-1], True)
    at = lambda day: dt.datetime.combine(day, dt.time(), dt.UTC).timestamp()
    out = []
    for y in years:
        first = times.lenient_day(y)
        age = times.freshness(at(first), at(last))
        days = [first, times.lenient_day(f"{y}-2", True), times.lenient_day(f"{y}0304"), times.lenient_day(f"{y}-13")]
        out.append((y, *days, *[times.span(first, last, g) for g in ("week", "month", "quarter", "year")], times.coarsen(first, last, "week", 60), age["phrase"], age["stale"]))
    return out


told(
    "date_arithmetic",
    "y string, first date, february date, march date, nothing date, weeks int, months int, quarters int, years int, grain string, age string, stale boolean",
    _spans,
    """d AS (SELECT DISTINCT strftime(make_timestamp(published * 1000000), '%Y') y FROM cve WHERE published IS NOT NULL),
e AS (SELECT y, (y || '-01-01')::DATE f, (max(y) OVER () || '-12-31')::DATE l FROM d),
n AS (SELECT *, (date_diff('day', date_trunc('week', f), date_trunc('week', l)) // 7 + 1)::INT w, (date_diff('month', f, l) + 1)::INT m, (date_diff('quarter', f, l) + 1)::INT q, (date_diff('year', f, l) + 1)::INT k FROM e)
SELECT y, f "first", last_day((y || '-02-01')::DATE) february, (y || '-03-04')::DATE march, NULL::DATE nothing, w AS "weeks", m AS "months", q AS "quarters", k AS "years",
CASE WHEN w <= 60 THEN 'week' WHEN m <= 60 THEN 'month' WHEN q <= 60 THEN 'quarter' ELSE 'year' END grain, date_diff('day', f, l) || ' days old' age, true stale FROM n""",
)
raw(
    "budget_of_rows",
    lambda s, sf: budget.within(load(s, sf, "conversations"), F.length("text"), 100, [F.asc("turn"), F.asc("text")], ["conv_id"]).groupBy("conv_id").agg(F.count("*").alias("n")),
    """SELECT conv_id, count(*) n FROM (SELECT *, sum(length(text)) OVER w u, row_number() OVER w r FROM conversations WINDOW w AS (PARTITION BY conv_id
ORDER BY turn, text ROWS UNBOUNDED PRECEDING)) WHERE u <= 100 OR r = 1 GROUP BY 1""",
)
