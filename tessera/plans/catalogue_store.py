"""Revisions in buckets, deltas as a stream, ranked search, sketches, and the gate before ad-hoc SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import catalog, digests, names, paging, ranking, search, sketches
from ..operators import reports as R
from ..operators.filters import Filters
from ..sources import store
from ..streaming import buckets as B
from ..streaming import changes as C
from . import bind, guard
from .bind import corpus, kept, oracle
from .catalogue_changes import from_one
from .catalogue_reports import TOKENED, TOKENS

QUERIES, ORACLES = {}, {}


def add(name, query, sql):
    """A query of the corpus, the session and the folder of the tables."""
    QUERIES[name] = lambda spark, sf, q=query: q(corpus(spark, sf), spark, sf)
    ORACLES[name] = oracle(sql)


# --- deltas -------------------------------------------------------------------------------------------
WIDTH = 1_024
_HIGH = dict.fromkeys(C.LOOKUPS, 10**9)


def _based(c):
    """The corpus with ids from one on and identifiers that name a record each, and its overlay."""
    return from_one(c).having(kev=bind.whole(c).kev.withColumn("cve_id", F.col("cve_id") + 1))


def _steps(c):
    """Two deltas: the first is about the lowest tenth of the ids, with new texts, the second about the highest, with a weakness told anew."""
    one = _based(c)
    top = one.cve.agg(F.max("id")).first()[0]
    low, high = top // 10, top - top // 10

    def step(before, rev, where, score, **more):
        gone, changed = where & (F.col("id") % 13 == 5), where & (F.col("id") % 6 == 0)
        cve = before.cve.filter(~gone).withColumn("cvss_score", F.when(changed, F.lit(score)).otherwise(F.col("cvss_score")))
        changes = before.cve.filter(gone).selectExpr("cve_id", "'deleted' kind").unionByName(cve.filter(changed).selectExpr("cve_id", "'changed' kind"))
        after = before.having(cve=cve, kev=None, **more)
        return after, C.extract(before, after, changes, rev, rev + 1, _HIGH)

    renewed = one.cve_text.withColumn("descr", F.when((F.col("cve_id") <= low) & (F.col("cve_id") % 6 == 0), F.concat(F.lit("renewed entry "), F.col("cve_id"))).otherwise(F.col("descr")))
    two, first = step(one, 1, F.col("id") <= low, 1.0, cve_text=renewed)
    told = two.cwe.withColumn("descr", F.when(F.col("id") == 4, F.lit("told anew")).otherwise(F.col("descr")))
    _, second = step(two, 2, F.col("id") > high, 2.0, cwe=told)
    return one, first, second


_LOW, _HI = "((SELECT max(id) + 1 FROM cve) // 10)", "((SELECT max(id) + 1 FROM cve) - (SELECT max(id) + 1 FROM cve) // 10)"
_AFTER = f"""gone AS (SELECT id + 1 AS id FROM cve WHERE id + 1 <= {_LOW} AND (id + 1) % 13 = 5),
hit AS (SELECT id + 1 AS id FROM cve WHERE id + 1 <= {_LOW} AND ((id + 1) % 13 = 5 OR (id + 1) % 6 = 0)),"""
_NAMES = ("cve", *C.LINKS)


def _applied(c, spark, sf):
    """table, bucket, n: the buckets that a delta has rewritten, and the rows that they have after it."""
    path = f"{store.shared_dir(spark)}/buckets-{uuid.uuid4().hex}"
    one, first, _ = _steps(c)
    B.create(one, path, 1, WIDTH)
    C.write_delta(first, f"{path}-deltas")  # once, as its checks read it often
    done = B.advance(spark, path, C.read_delta(spark, f"{path}-deltas", 1, 2))
    after, out = B.load(spark, path), None
    for name, touched in done.buckets.items():
        rows = getattr(after, name).select(B._bucket(name, WIDTH).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
        told = spark.createDataFrame([(b,) for b in touched], "bucket long")
        rows = rows.join(told, "bucket", "left_semi").select(F.lit(name).alias("table"), "bucket", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


def _rows_of(name):
    key, table = ("id", "cve") if name == "cve" else ("cve_id", name)
    return f"SELECT '{name}' t, ({key} + 1) // {WIDTH} b FROM {table} WHERE {key} + 1 NOT IN (SELECT id FROM gone)"


add(
    "delta_apply_buckets",
    _applied,
    f"""{_AFTER}
held AS ({' UNION ALL '.join(map(_rows_of, _NAMES))}),
moved AS (SELECT 1 FROM kev k JOIN cve c ON c.cve_id = k.cve JOIN hit ON hit.id = c.id + 1
  WHERE (k.cve_id IS NOT NULL) = (hit.id IN (SELECT id FROM gone)))
SELECT t "table", b::BIGINT bucket, count(*) n FROM held WHERE b IN (SELECT id // {WIDTH} FROM hit) GROUP BY ALL
UNION ALL SELECT 'kev', 0, (SELECT count(*) FROM kev) WHERE EXISTS (SELECT 1 FROM moved)""",
)


def _followed(c, spark, sf):
    """Where the copy and the deltas are after a stream has applied two: the later one came first and waited, then the stream was started again."""

    def run():
        at = f"{store.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
        one, first, second = _steps(c)
        B.create(one, f"{at}/copy", 1, indexed=True)
        for delta in (second, first):
            C.write_delta(delta, f"{at}/deltas")
            B.follow(spark, f"{at}/copy", f"{at}/deltas", f"{at}/checkpoint").awaitTermination()
        return at

    return bind.once(spark, sf, "streamed", run)


def _streamed(c, spark, sf):
    """The copy after the two deltas."""
    return B.load(spark, f"{_followed(c, spark, sf)}/copy", 3)


def _overlaid(c, spark, sf):
    """The copy's overlay by the identifiers of the tables.  Where records share one, an entry is told once for each of them that a delta speaks of, its own by the copy, as in the join of the SQL."""
    at, told = f"{_followed(c, spark, sf)}/deltas", None
    for a, b in B.published(spark, at):
        here = lambda name: spark.read.schema(C.shape(name)).parquet(f"{at}/from={a}/to={b}/{name}")  # noqa: B023, E731
        rows = here("cve").select("cve_id", "id").unionByName(here("gone").withColumn("id", F.lit(None).cast("long")))
        told = rows if told is None else told.unionByName(rows)
    told = told.select(bind.shown(F.col("cve_id")).alias("cve"), F.col("cve_id").alias("whole"), "id")
    entries = _streamed(c, spark, sf).kev.select(bind.shown(F.col("cve")).alias("cve"), F.col("cve").alias("entry"), "cve_id")
    return entries.join(told, "cve", "left").select("cve", F.when(F.col("whole") != F.col("entry"), F.col("id")).otherwise(F.col("cve_id")).alias("cve_id"))


add(
    "delta_stream",
    lambda c, spark, sf: _streamed(c, spark, sf).cve.select("id", "cvss_score"),
    f"""SELECT id + 1 AS id, CASE WHEN (id + 1) % 6 = 0 AND id + 1 <= {_LOW} THEN 1.0 WHEN (id + 1) % 6 = 0 AND id + 1 > {_HI} THEN 2.0 ELSE cvss_score END cvss_score
FROM cve WHERE NOT ((id + 1) % 13 = 5 AND (id + 1 <= {_LOW} OR id + 1 > {_HI}))""",
)
add(
    "delta_stream_lookups",
    lambda c, spark, sf: _streamed(c, spark, sf).cwe.select("id", "descr"),
    "SELECT id + 1 AS id, CASE WHEN id + 1 = 4 THEN 'told anew' ELSE descr END descr FROM cwe",
)
add(
    "delta_stream_overlay",
    _overlaid,
    f"""changed AS (SELECT cve_id, id + 1 AS id, (id + 1) % 13 = 5 gone FROM cve WHERE (id + 1 <= {_LOW} OR id + 1 > {_HI}) AND ((id + 1) % 13 = 5 OR (id + 1) % 6 = 0))
SELECT k.cve, CASE WHEN d.gone THEN NULL WHEN d.id IS NOT NULL THEN d.id ELSE k.cve_id + 1 END cve_id FROM kev k LEFT JOIN changed d ON d.cve_id = k.cve""",
)
add(
    "fts_segments",
    lambda c, spark, sf: _streamed(c, spark, sf).postings.groupBy("term").agg(F.count_distinct("doc").alias("docs"), F.sum(F.size("places")).alias("places")),
    f"""now AS (SELECT cve_id + 1 cve_id, CASE WHEN cve_id + 1 <= {_LOW} AND (cve_id + 1) % 6 = 0 THEN 'renewed entry ' || (cve_id + 1) ELSE descr END descr, title FROM cve_text
  WHERE NOT ((cve_id + 1) % 13 = 5 AND (cve_id + 1 <= {_LOW} OR cve_id + 1 > {_HI}))),
tok AS (SELECT cve_id, unnest({TOKENS.format('descr')}) term FROM now UNION ALL SELECT cve_id, unnest({TOKENS.format('title')}) FROM now)
SELECT term, count(DISTINCT cve_id) docs, count(*) places FROM tok GROUP BY 1""",
)

# --- drift --------------------------------------------------------------------------------------------------
LEAF = 256


def _drift(c, spark, sf, rows=False):
    """Two copies of the records, of which one has lost some, has others changed and one too many."""
    other = c.cve.filter("id % 2003 <> 11").withColumn("cvss_score", F.when(F.col("id") % 4001 == 13, F.lit(-1.0)).otherwise(F.col("cvss_score")))
    other = other.unionByName(c.cve.filter("id = 1").withColumn("id", F.lit(10**9).cast("long")))
    one = kept(spark, sf, "cve_digests", lambda: digests.tree(c.cve, leaf=LEAF))
    two = kept(spark, sf, "other_digests", lambda: digests.tree(other, leaf=LEAF))
    found = digests.drift(one, two, leaf=LEAF)
    return digests.drifted(c.cve, other, found, leaf=LEAF).select("id", "copy") if rows else found


_OTHER = """other AS (SELECT id, CASE WHEN id % 4001 = 13 THEN -1.0 ELSE cvss_score END s FROM cve WHERE id % 2003 <> 11 UNION ALL SELECT 1000000000, cvss_score FROM cve WHERE id = 1),
lone AS (SELECT id, 1 "copy" FROM (SELECT id, cvss_score s FROM cve EXCEPT SELECT id, s FROM other) UNION ALL SELECT id, 2 FROM (SELECT id, s FROM other EXCEPT SELECT id, cvss_score FROM cve))"""
add(
    "id_drift",
    _drift,
    f"""{_OTHER},
leaf AS (SELECT DISTINCT id // {LEAF} b FROM lone)
SELECT b * {LEAF} "first", b * {LEAF} + {LEAF - 1} "last", (SELECT count(*) FROM cve WHERE id // {LEAF} = b) "rows", (SELECT count(*) FROM other WHERE id // {LEAF} = b) other_rows FROM leaf""",
)
add("id_drift_rows", lambda c, spark, sf: _drift(c, spark, sf, True), f'{_OTHER}\nSELECT id, "copy" FROM lone')

# --- ranked search ----------------------------------------------------------------------------------------


def _lengths(c, spark, sf):
    docs = kept(spark, sf, "lengths", lambda: ranking.lengths(c.cve_text, "cve_id", list(search.FIELDS)))
    return docs, kept(spark, sf, "extents", lambda: ranking.extents(docs))


def _best(text, k, weights=None):
    def run(c, spark, sf):
        docs, sizes = _lengths(c, spark, sf)
        return ranking.best(c.postings, docs, text, k, weights, sizes)

    return run


def _score(often, weights=(1.0, 1.0)):
    """SQL of the formula; ``often``: for each term, how often a list of tokens has it."""
    f = [f"({weights[0]} * {x.format('d')} + {weights[1]} * {x.format('t')})" for x in often]
    m = [f"count(*) FILTER (WHERE {x.format('d')} + {x.format('t')} > 0) m{i}" for i, x in enumerate(often)]
    parts = [f"greatest(ln((n - m{i} + 0.5) / (m{i} + 0.5)), 1e-6) * {x} * 2.2 / ({x} + 1.2 * (0.25 + 0.75 * size / average))" for i, x in enumerate(f)]
    return f"""{TOKENED},
told AS (SELECT count(*)::DOUBLE n, sum(len(d) + len(t)) / count(*)::DOUBLE average, {', '.join(m)} FROM tok),
sized AS (SELECT *, len(d) + len(t) size FROM tok)
SELECT cve_id AS doc, round({' + '.join(parts)}, 6) score FROM sized, told WHERE {' AND '.join(f'{x} > 0' for x in f)}"""


_WORD = "len(list_filter({{}}, lambda x: x = '{0}'))"
_FOLLOW = "len(list_filter(range(1, len({{0}})), lambda i: {{0}}[i] = '{0}' AND {{0}}[i + 1] = '{1}'))"
_BEGIN = "len(list_filter({{}}, lambda x: starts_with(x, '{0}')))"
add("fts_bm25_top", _best("the of", 50), _score([_WORD.format("the"), _WORD.format("of")]) + "\nORDER BY score DESC, doc LIMIT 50")
add("fts_bm25_phrase", _best('"on the" er*', 40), _score([_FOLLOW.format("on", "the"), _BEGIN.format("er")]) + "\nORDER BY score DESC, doc LIMIT 40")
add("fts_bm25_weights", _best("src7", 30, {"title": 3.0, "descr": 0.5}), _score([_WORD.format("src7")], (0.5, 3.0)) + "\nORDER BY score DESC, doc LIMIT 30")


def _texts(c, text):
    return c.cve_text.join(search.find(c.postings, text).select(F.col("doc").alias("cve_id")), "cve_id", "left_semi").select("cve_id", "descr")


_PIECES = f"""{TOKENED},
piece AS (SELECT cve_id, regexp_extract_all(descr, '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}\\p{{Mn}}]*') w, string_split_regex(descr, '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}\\p{{Mn}}]*') g FROM cve_text
  WHERE cve_id IN (SELECT cve_id FROM tok WHERE list_contains(d, 'the') OR list_contains(t, 'the'))),
flagged AS (SELECT *, list_transform(w, lambda x: strip_accents(lower(x)) = 'the') f FROM piece),
marked AS (SELECT *, list_transform(range(1, len(w) + 1), lambda i: CASE WHEN f[i] AND (i = 1 OR NOT f[i - 1]) THEN '[' ELSE '' END || w[i] || CASE WHEN f[i] AND (i = len(w) OR NOT f[i + 1]) THEN ']' ELSE '' END) x FROM flagged)"""
add(
    "fts_highlight",
    lambda c, spark, sf: ranking.highlight(_texts(c, "the"), "descr", "the", "shown").select("cve_id", "shown"),
    f"""{_PIECES}
SELECT cve_id, CASE WHEN w IS NOT NULL THEN coalesce(array_to_string(list_transform(range(1, len(w) + 1), lambda i: g[i] || x[i]), ''), '') || g[len(g)] END shown FROM marked""",
)
add(
    "fts_snippet",
    lambda c, spark, sf: ranking.snippet(_texts(c, "the"), "descr", "the", "shown", 12, ("", "", "…")).select("cve_id", "shown"),
    f"""{_PIECES},
hits AS (SELECT cve_id, unnest(list_filter(range(1, len(w) + 1), lambda i: f[i])) h FROM flagged),
rich AS (SELECT a.cve_id, a.h, count(*) n FROM hits a JOIN hits b ON b.cve_id = a.cve_id AND b.h >= a.h AND b.h < a.h + 12 GROUP BY ALL),
start AS (SELECT cve_id, h - 1 s FROM rich QUALIFY row_number() OVER (PARTITION BY cve_id ORDER BY n DESC, h) = 1),
cut AS (SELECT marked.*, least(coalesce(s, 0), greatest(len(w) - 12, 0))::BIGINT s FROM marked LEFT JOIN start USING (cve_id))
SELECT cve_id, CASE WHEN w IS NOT NULL THEN CASE WHEN s > 0 THEN '…' ELSE g[1] END || coalesce(array_to_string(list_transform(range(s + 1, least(s + 12, len(w)) + 1), lambda i: CASE WHEN i = s + 1 THEN '' ELSE g[i] END || w[i]), ''), '')
|| CASE WHEN s + 12 < len(w) THEN '…' WHEN len(w) = 0 THEN '' ELSE g[len(g)] END END shown FROM cut""",
)

# --- names and pages ------------------------------------------------------------------------------------------
_PRODUCTS = "pr AS (SELECT p.id, p.vendor_id, p.name, coalesce(n, 0)::BIGINT records FROM product p LEFT JOIN (SELECT product_id, count(*) n FROM cve_prod GROUP BY 1) x ON x.product_id = p.id)"
_TIER = "CASE WHEN lower({0}) = '{1}' THEN 3 WHEN starts_with(lower({0}), '{1}') THEN 2 WHEN contains(lower({0}), '{1}') THEN 1 ELSE 0 END"


def _grams(spark, sf, table, name):
    return bind.once(spark, sf, f"grams_{name}", lambda: names.keep_grams(table, f"{store.shared_dir(spark)}/bound-{uuid.uuid4().hex}/grams_{name}"))


def _found(name, text, vendor_ids=None, limit=25):
    def run(c, spark, sf):
        index = _grams(spark, sf, getattr(c, name), name)
        return catalog.search_vendors(c, text, limit, index) if name == "vendor" else catalog.search_products(c, text, vendor_ids, limit, index)

    return run


def _products_sql(text, limit, where=""):
    return f"""{_PRODUCTS}
SELECT name, records, vendors, {_TIER.format('k', text)} tier
FROM (SELECT lower(name) k, min(name) AS name, sum(records)::BIGINT records, count(DISTINCT vendor_id) vendors FROM pr {where} GROUP BY 1)
WHERE contains(k, '{text}') ORDER BY tier DESC, records DESC, k LIMIT {limit}"""


add("catalog_index_products", _found("product", " Ring", None, 40), _products_sql("ring", 40))
add("catalog_index_of_vendors", _found("product", "red", [11, 12], 15), _products_sql("red", 15, "WHERE vendor_id IN (11, 12)"))
add("catalog_index_short", _found("product", "O", None, 30), _products_sql("o", 30))
add("catalog_index_long", _found("product", "d ring", None, 30), _products_sql("d ring", 30))
add(
    "catalog_index_vendors",
    _found("vendor", "and#1", None, 10),
    f"""{_PRODUCTS}
SELECT id, name, records, {_TIER.format('name', 'and#1')} tier FROM (SELECT v.id, v.name, coalesce(sum(pr.records), 0)::BIGINT records FROM vendor v
LEFT JOIN pr ON pr.vendor_id = v.id GROUP BY 1, 2) WHERE contains(lower(name), 'and#1') ORDER BY tier DESC, records DESC, name, id LIMIT 10""",
)


def _assigners(c):
    n = c.cve.filter("cna_id is not null").groupBy(F.col("cna_id").alias("id")).agg(F.count("*").alias("records"))
    return c.cna.join(n, "id", "left").select("id", "name", F.coalesce("records", F.lit(0)).cast("long").alias("records"))


def _ahead(text, limit=25, changed=False):
    """Type-ahead over the kept beginnings; ``changed``: after every tenth name has got another one and every eleventh went."""

    def run(c, spark, sf):
        before = kept(spark, sf, "assigners", lambda: _assigners(c))
        index = bind.once(spark, sf, "beginnings", lambda: names.keep_beginnings(before, f"{store.shared_dir(spark)}/bound-{uuid.uuid4().hex}/beginnings"))
        if not changed:
            return names.type_ahead(index, before, text, limit)
        after = before.filter("id % 11 <> 0").withColumn("name", F.when(F.col("id") % 10 == 0, F.concat(F.lit("Customs "), "name")).otherwise(F.col("name")))
        touched = before.filter("id % 10 = 0 or id % 11 = 0").select("id")
        return names.type_ahead(names.maintain_beginnings(index, before, after, touched), after, text, limit)

    return run


_ASSIGNERS = "a AS (SELECT cna.id, name, count(c.id) records FROM cna LEFT JOIN cve c ON c.cna_id = cna.id GROUP BY ALL)"
_AHEAD = "SELECT id, name, records, CASE WHEN lower(name) = '{0}' THEN 3 ELSE 2 END tier FROM {1} WHERE starts_with(lower(name), '{0}') ORDER BY tier DESC, records DESC, name, id LIMIT {2}"
add("fts_typeahead_kept", _ahead("Customer#0000"), f"{_ASSIGNERS}\n{_AHEAD.format('customer#0000', 'a', 25)}")
add("fts_typeahead_whole", _ahead("customer#000000012"), f"{_ASSIGNERS}\n{_AHEAD.format('customer#000000012', 'a', 25)}")
add(
    "fts_typeahead_maintained",
    _ahead("custom", 25, True),
    f"""{_ASSIGNERS},
b AS (SELECT id, CASE WHEN id % 10 = 0 THEN 'Customs ' || name ELSE name END AS name, records FROM a WHERE id % 11 <> 0)
{_AHEAD.format('custom', 'b', 25)}""",
)


def _sought(sort, skip, take=100):
    """A page of the list of all records, sought with so few rows left to sort that every table is narrowed."""

    def run(c, spark, sf):
        found, rest = paging.window(c.cve, sort, skip(c), take, few=50)
        return found.orderBy(F.desc_nulls_last(sort), F.desc("id")).offset(rest).limit(take).select("id", sort)

    return run


_MIDDLE = lambda c: c.cve.count() // 2
for _sort in ("published", "updated"):
    add(f"rows_seek_{_sort}", _sought(_sort, _MIDDLE), f"SELECT id, {_sort} FROM cve ORDER BY {_sort} DESC NULLS LAST, id DESC LIMIT 100 OFFSET (SELECT count(*) // 2 FROM cve)")
add("rows_seek_nulls", _sought("cvss_score", lambda c: c.cve.filter("cvss_score is not null").count() - 40), "SELECT id, cvss_score FROM cve ORDER BY cvss_score DESC NULLS LAST, id DESC LIMIT 100 OFFSET (SELECT count(cvss_score) - 40 FROM cve)")
add(
    "rows_after",
    lambda c, spark, sf: R.rows(c, Filters(), 50, sort="score", after=(100_000.0, 0)).select("cve", "cvss_score"),
    "SELECT cve_id cve, cvss_score FROM cve WHERE state = 1 AND (cvss_score < 100000 OR cvss_score IS NULL) ORDER BY cvss_score DESC NULLS LAST, id DESC LIMIT 51",
)

# --- sketches ----------------------------------------------------------------------------------------------


def _within(c, spark, sf):
    """Whether the estimates of a window are within 2 % of the exact counts, beside these."""
    kept_ = kept(spark, sf, "host_sketches", lambda: sketches.monthly(c, "host"))
    about = sketches.estimated(kept_, "1996-03", "1999-10").withColumnRenamed("records", "about")
    exact = _exact(c).join(about, "bucket", "full")
    return exact.select("bucket", "records", (F.abs(F.col("about") - F.col("records")) <= 0.02 * F.col("records") + 0.5).alias("near"))


def _exact(c):
    links = c.cve_ref.join(c.url.select(F.col("id").alias("url_id"), "host_id"), "url_id")
    inside = c.cve.filter("published >= 825638400 and published < 941414400").select(F.col("id").alias("cve_id"))
    return links.join(inside, "cve_id", "left_semi").groupBy(F.col("host_id").alias("bucket")).agg(F.count_distinct("cve_id").alias("records"))


add(
    "hosts_about",
    _within,
    """SELECT u.host_id bucket, count(DISTINCT r.cve_id) records, true near FROM cve_ref r JOIN url u ON u.id = r.url_id JOIN cve c ON c.id = r.cve_id
WHERE c.published >= 825638400 AND c.published < 941414400 GROUP BY 1""",
)

# --- the gate before ad-hoc SQL ------------------------------------------------------------------------------


def _gated(c, spark, sf):
    """What statements answer that join by keys, and which are refused before they run."""
    statements = {
        "equal keys": "SELECT count(*) n FROM cve_prod p JOIN cve_ref r ON p.cve_id = r.cve_id",
        "all pairs": "SELECT count(*) n FROM cve_prod CROSS JOIN cve_ref",
        "unequal keys": "SELECT count(*) n FROM cve_prod p JOIN cve_ref r ON p.cve_id < r.cve_id",
        "a small side": "SELECT count(*) n FROM cve CROSS JOIN host",
        "much to read": "SELECT count(*) n FROM cve_ver",
    }
    out = None
    for what, sql in statements.items():
        rows = guard.frame(spark, c, sql)
        try:
            guard.afford(rows, 1_000 if what == "much to read" else guard.MOST_READ, 2_000)
            rows = rows.select(F.lit(what).alias("what"), "n")
        except guard.Denied:
            rows = c.host.limit(1).select(F.lit(what).alias("what"), F.lit(None).cast("long").alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


add(
    "guard_cost",
    _gated,
    """SELECT 'equal keys' what, count(*) n FROM cve_prod p JOIN cve_ref r ON p.cve_id = r.cve_id
UNION ALL SELECT 'a small side', (SELECT count(*) FROM cve) * (SELECT count(*) FROM host)
UNION ALL SELECT unnest(['all pairs', 'unequal keys', 'much to read']), NULL""",
)


def sql(name, text, duck):
    QUERIES[f"sql_{name}"] = lambda spark, sf, t=text: guard.frame(spark, corpus(spark, sf), t)
    ORACLES[f"sql_{name}"] = oracle(duck)


sql(
    "dates",
    """SELECT date_format(timestamp_seconds(published), 'yyyy-MM') AS m, year(timestamp_seconds(updated)) AS y, dayofweek(timestamp_seconds(published)) AS w, count(*) AS n,
min(date_add(to_date(timestamp_seconds(published)), 3)) AS d, max(date_diff(to_date(timestamp_seconds(updated)), to_date(timestamp_seconds(published)))) AS span_days,
max(extract(quarter FROM timestamp_seconds(updated))) AS q, min(date_trunc('month', timestamp_seconds(published))) < timestamp '1996-01-01' AS early FROM cve GROUP BY 1, 2, 3""",
    """SELECT strftime(make_timestamp(published * 1000000), '%Y-%m') m, year(make_timestamp(updated * 1000000))::INT y, (dayofweek(make_timestamp(published * 1000000)) + 1)::INT w, count(*) n,
min(make_timestamp(published * 1000000)::DATE + 3) d, max(date_diff('day', make_timestamp(published * 1000000)::DATE, make_timestamp(updated * 1000000)::DATE))::INT span_days,
max(quarter(make_timestamp(updated * 1000000)))::INT q, min(date_trunc('month', make_timestamp(published * 1000000))) < timestamp '1996-01-01' early FROM cve GROUP BY 1, 2, 3""",
)
sql(
    "pipes",
    "FROM cve |> WHERE state = 1 |> EXTEND cvss_score * 2 AS twice |> AGGREGATE count(*) AS n, max(twice) AS most GROUP BY cvss_sev |> WHERE n > 3",
    "SELECT cvss_sev, count(*) n, max(cvss_score * 2) most FROM cve WHERE state = 1 GROUP BY 1 HAVING count(*) > 3",
)
sql(
    "sketch_readers",
    "SELECT state, sum(bitmap_count(b)) AS n FROM (SELECT state, bitmap_bucket_number(id) AS k, bitmap_construct_agg(bitmap_bit_position(id)) AS b FROM cve GROUP BY 1, 2) GROUP BY 1",
    "SELECT state, count(DISTINCT id) n FROM cve GROUP BY 1",
)
