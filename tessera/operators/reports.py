"""Record lists, counts, grouped counts, cross-tabs, extents and details.

Everything is lazy.  A limited result has one row more than its limit, which tells that it was cut.
Ties are broken by the bucket (or the id), so results are the same on every run.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import CatalogMissing, Corpus, Made, once
from . import bitmaps as B
from . import dims as D
from . import paging
from .filters import Filters, matching, require_kev, unmatched

# The caps of the surface.
ROWS_DEFAULT, ROWS_MAX, OFFSET_MAX = 500, 5_000, 1_000_000
GROUPS, SERIES, CELLS = 400, 24, 3_000
DETAIL_CAPS = {"cwes": 64, "products": 400, "versions": 800, "refs": 400}
#: From this offset on a page is sought by counts of its sort key instead of sorting all that comes before it.
FAR = 50_000
SORTS = {
    "published": [F.desc_nulls_last, "published"],
    "updated": [F.desc_nulls_last, "updated"],
    "score": [F.desc_nulls_last, "cvss_score"],
    "cve": [F.desc_nulls_last, "cve_id"],
}


def clamp(value, default: int, most: int) -> int:
    try:
        n = math.trunc(float(value))
    except (TypeError, ValueError, OverflowError):
        return default
    return default if n < 1 else min(n, most)


def clamp_offset(value) -> int:
    try:
        return max(0, min(math.trunc(float(value)), OFFSET_MAX))
    except (TypeError, ValueError, OverflowError):
        return 0


def _sorted(records: DataFrame, sort: str | None) -> list[Column]:
    how, column = SORTS.get(sort, SORTS["published"])
    return [how(column)] + [F.desc("id")] * (column != "cve_id")


def rows(corpus: Corpus, filters: Filters, limit=None, offset=0, sort: str | None = None, full: bool = False, kev: bool = False, after: tuple | None = None) -> DataFrame:
    """The matching records; ``full`` adds the columns of an export, ``kev`` those of the overlay.

    ``after``: the sort column's value and the id of the last record that was read; the page goes on from there, without an offset."""
    n, skip = clamp(limit, ROWS_DEFAULT, ROWS_MAX), clamp_offset(offset)
    found, column = matching(corpus, filters), SORTS.get(sort, SORTS["published"])[1]
    if after is not None:
        found, skip = paging.after(found, column, *after), 0
    elif skip >= FAR and column != "cve_id":
        found, skip = paging.window(found, column, skip, n + 1)
    # The page is cut first: the wide columns are joined to its few rows only.
    page = found.orderBy(*_sorted(found, sort)).limit(skip + n + 1)
    if skip:  # by number, as joins behind an offset lose the order in Spark 4.1
        page = page.withColumn("__place", F.row_number().over(Window.orderBy(*_sorted(found, sort)))).filter(F.col("__place") > skip).drop("__place")
    page = D.join(corpus, page, "cna")
    text = corpus.cve_text.select(F.col("cve_id").alias("id"), "descr", "title", "reason")
    page = page.join(text, "id", "left")
    description = F.col("descr") if full else F.substring("descr", 1, 400)
    out = [F.col("cve_id").alias("cve"), "state", "published", "updated", "cvss_ver", "cvss_score", "cvss_sev", F.col("cna_name").alias("cna"), description.alias("description")]
    if full:
        out += ["title", "reason", "cvss_vec", "reserved", "ssvc_expl", "ssvc_auto", "ssvc_impact"]
    if full and kev:
        if corpus.kev is None:
            raise CatalogMissing("no catalog is loaded")
        k = corpus.kev.filter(F.col("cve_id").isNotNull()).select(F.col("cve_id").alias("id"), F.col("cve").alias("kev_cve"), F.col("added").alias("kev_added"), F.col("due").alias("kev_due"), F.col("ransomware").alias("kev_ransomware"), F.col("name").alias("kev_name"), F.col("action").alias("kev_action"))
        page = page.join(k, "id", "left")
        words = F.when(F.col("kev_cve").isNull(), "").when(F.col("kev_ransomware") == 1, "Known").when(F.col("kev_ransomware") == 0, "Unknown (per CISA)").otherwise("not stated by CISA")
        out += [F.col("kev_cve").isNotNull().cast("int").alias("kev_listed"), "kev_added", "kev_due", words.alias("kev_ransomware"), "kev_name", "kev_action"]
    return page.orderBy(*_sorted(page, sort)).select(*out)


class Found:
    """What a search gives: a list or groups (``rows``), how many records match (``matches``), and the names that the corpus doesn't have, by axis (``unmatched``).

    Each is made when it is asked for, so a part asks for its own tables only."""

    def __init__(self, rows: Callable[[], DataFrame], matches: Callable[[], DataFrame] | None, unmatched: Mapping[str, DataFrame]):
        self._rows, self._matches, self.unmatched = once(rows), once(matches or (lambda: None)), unmatched

    @property
    def rows(self) -> DataFrame:
        return self._rows()

    @property
    def matches(self) -> DataFrame | None:
        return self._matches()


def search(corpus: Corpus, filters: Filters, by: str | None = None, limit=None, offset=0, sort: str | None = None, counted: bool = True) -> Found:
    require_kev(corpus, filters, by)  # what can't be asked is told at once
    if by:
        D.dim(by)
    names = Made({a: lambda a=a: unmatched(corpus, a, getattr(filters, a)) for a in ("cna", "vendor", "product", "cwe", "host") if getattr(filters, a)})
    return Found(lambda: group(corpus, filters, by, limit) if by else rows(corpus, filters, limit, offset, sort), (lambda: count(corpus, filters)) if counted else None, names)


def count(corpus: Corpus, filters: Filters) -> DataFrame:
    return matching(corpus, filters).agg(F.count("*").alias("matches"))


def _buckets(corpus: Corpus, records: DataFrame, d: D.Dim) -> DataFrame:
    if B.usable(corpus, [d]):
        counts = B.counted(B.placed(corpus, records, d, "bucket", B.packed(records)), "bucket")
    else:
        counts = D.placed(corpus, records, {"bucket": d}).groupBy("bucket").agg(D.counted([d]))
    return D.known(corpus, counts, d)


def _largest(d: D.Dim, bucket: str) -> list[Column]:
    """Which buckets are kept when there are too many: the latest of a time axis, else the largest."""
    return [F.desc_nulls_last(bucket)] if d.kind == D.TIME else [F.desc("cves"), F.asc_nulls_first(bucket)]


def group(corpus: Corpus, filters: Filters, dimension: str, limit=None) -> DataFrame:
    """bucket, label, cves.  On a time axis the latest buckets are kept and the row too many comes last."""
    require_kev(corpus, filters, dimension)
    d, n = D.dim(dimension), clamp(limit, GROUPS, GROUPS)
    counts = _buckets(corpus, matching(corpus, filters), d)
    if d.kind == D.TIME:
        kept = counts.orderBy(F.desc_nulls_last("bucket")).limit(n + 1)
        place = F.row_number().over(Window.orderBy(F.desc_nulls_last("bucket")))  # over n + 1 rows
        kept = kept.withColumn("place", place).orderBy(F.col("place") > n, F.asc_nulls_first("bucket"))
        return D.labelled(corpus, kept, d).select("bucket", "label", "cves")
    if d.kind == D.FIXED:
        order = [F.asc(D.order_of(d, F.col("bucket"))), F.asc_nulls_first("bucket")]
    elif dimension == "state":
        order = [F.desc_nulls_last("bucket")]
    else:
        order = [F.desc("cves"), F.asc_nulls_first("bucket")]
    kept = counts.orderBy(*order).limit(n + 1)
    return D.labelled(corpus, kept, d).orderBy(*order).select("bucket", "label", "cves") if d.names else D.labelled(corpus, kept, d).select("bucket", "label", "cves")


def _top(corpus: Corpus, counts: DataFrame, d: D.Dim, name: str, n: int) -> DataFrame:
    return D.known(corpus, counts, d, name).orderBy(*_largest(d, name)).limit(n).select(F.col(name).alias("top"))


def cross(corpus: Corpus, filters: Filters, by: str, series: str | None, rows=None, series_limit=None) -> DataFrame:
    """bucket, label, series, series_label, cves.

    Each axis is narrowed to its largest (latest) buckets over its own links; these are at most GROUPS
    and SERIES rows, so they are broadcast to pick the cells.  Axes that are kept as bitmaps are
    narrowed, met and counted as such.  Of others, where a record is in one bucket of the other axis
    only, an axis' counts are the sums of the cells, which are then counted once for all; where it may
    be in several, links are narrowed before they are joined with one another."""
    if series is None:
        return group(corpus, filters, by, rows)
    if by == series:
        raise ValueError("the two axes must differ")
    require_kev(corpus, filters, by, series)
    a, b = D.dim(by), D.dim(series)
    n, m = clamp(rows, GROUPS, GROUPS), clamp(series_limit, SERIES, SERIES)
    cap = min(n * m, CELLS)
    records = matching(corpus, filters)
    axes = {"bucket": a, "series": b}
    # Code axes that may show all their codes aren't narrowed.
    narrow = {name: k for name, d, k in (("bucket", a, n), ("series", b, m)) if d.most is None or d.most > k}
    alone = lambda name: D.placed(corpus, records, {name: axes[name]}).groupBy(name).agg(D.counted([axes[name]]))
    if B.usable(corpus, [a, b]):
        found, sides = B.packed(records), {}
        for name, d in axes.items():
            sides[name] = B.placed(corpus, records, d, name, found)
            if name in narrow:
                sides[name] = D.narrowed(sides[name], name, _top(corpus, B.counted(sides[name], name), d, name, narrow[name]))
        cells = B.counted(B.meet(sides["bucket"], sides["series"], "bucket", "series"), "bucket", "series")
    elif a.multiplies and b.multiplies:
        tops = {name: _top(corpus, alone(name), axes[name], name, k) for name, k in narrow.items()}
        cells = D.placed(corpus, records, axes, tops).groupBy("bucket", "series").agg(D.counted([a, b]))
    else:
        cells = every = D.placed(corpus, records, axes).groupBy("bucket", "series").agg(D.counted([a, b]))
        for name, k in narrow.items():
            # An axis whose buckets all records have is counted by itself if the other one's links leave records out.
            other = b if name == "bucket" else a
            counts = alone(name) if other.multiplies else every.groupBy(name).agg(F.sum("cves").alias("cves"))
            cells = D.narrowed(cells, name, _top(corpus, counts, axes[name], name, k))
    if a.kind == D.IDENTITY:
        cells = cells.withColumn("total", F.sum("cves").over(Window.partitionBy("bucket")))
        order = [F.desc("total"), F.asc_nulls_first("bucket")]
    else:
        order = [F.asc_nulls_first(D.order_of(a, F.col("bucket"))), F.asc_nulls_first("bucket")]
    order += [F.desc("cves"), F.asc_nulls_first("series")] if b.kind == D.IDENTITY else [F.asc_nulls_first(D.order_of(b, F.col("series"))), F.asc_nulls_first("series")]
    kept = cells.orderBy(*order).limit(cap + 1)
    table = D.labelled(corpus, D.labelled(corpus, kept, a), b, "series", "series_label")
    return (table.orderBy(*order) if a.names or b.names else table).select("bucket", "label", "series", "series_label", "cves")


def coverage(corpus: Corpus) -> DataFrame:
    """Extents of the record, one row."""
    out = corpus.cve.agg(F.count("*").alias("records"), *[f(c).alias(f"{c}_{n}") for c in ("published", "updated", "year") for n, f in (("min", F.min), ("max", F.max))])
    if corpus.kev is not None:
        k = corpus.kev.agg(F.count("*").alias("kev_records"), F.min("added_at").alias("kev_added_min"), F.max("added_at").alias("kev_added_max"), F.min("due_at").alias("kev_due_min"), F.max("due_at").alias("kev_due_max"), F.sum(F.col("cve_id").isNull().cast("long")).alias("kev_unmatched"))
        out = out.join(F.broadcast(k))  # one row each
    return out


def _one(corpus: Corpus, cve_id: str) -> DataFrame:
    # Identifiers are kept in upper case, so the argument is put in it and the filter reaches the files.
    return corpus.cve.filter(F.col("cve_id") == cve_id.strip().upper()).limit(1)


def detail(corpus: Corpus, cve_id: str, parts: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
    """The parts of one record, each with one row beyond its cap; those named in ``parts`` if not all, and only their tables are asked for."""
    one = _one(corpus, cve_id)
    ids = one.select("id")
    text = lambda: corpus.cve_text.select(F.col("cve_id").alias("id"), "descr", "title", "reason")
    product = lambda: corpus.product.select(F.col("id").alias("product_id"), "vendor_id", F.col("name").alias("product"))
    vendor = lambda: corpus.vendor.select(F.col("id").alias("vendor_id"), F.col("name").alias("vendor"))
    links = lambda: corpus.cve_prod.withColumnRenamed("cve_id", "id")
    cap = {k: n + 1 for k, n in DETAIL_CAPS.items()}
    makers = {
        "record": lambda: D.join(corpus, one, "cna").join(text(), "id", "left").select("cve_id", "state", "year", "published", "updated", "cvss_ver", "cvss_score", "cvss_sev", "cvss_vec", F.col("cna_name").alias("cna"), "descr", "title", "reason", "reserved", "ssvc_expl", "ssvc_auto", "ssvc_impact"),
        "cwes": lambda: corpus.cve_cwe.withColumnRenamed("cve_id", "id").join(ids, "id").select(F.col("cwe_id").alias("w")).join(corpus.cwe, F.col("w") == F.col("id")).select("cwe", "descr").orderBy("cwe").limit(cap["cwes"]),
        "products": lambda: links().join(ids, "id").join(product(), "product_id").join(vendor(), "vendor_id", "left").select("vendor", "product", "default_status").orderBy(F.asc_nulls_first("vendor"), F.asc_nulls_first("product")).limit(cap["products"]),
        "versions": lambda: corpus.cve_ver.withColumnRenamed("cve_id", "id").join(ids, "id").join(links(), ["id", "product_id"], "left").join(product(), "product_id", "left").join(vendor(), "vendor_id", "left").join(corpus.vtype.select(F.col("id").alias("vtype"), F.col("name").alias("vtype_name")), "vtype", "left").select("vendor", "product", "status", "version", "lt", "lte", F.col("vtype_name").alias("vtype"), "default_status").orderBy(*[F.asc_nulls_first(c) for c in ("vendor", "product", "status", "version", "lt", "lte")]).limit(cap["versions"]),
        "refs": lambda: corpus.cve_ref.withColumnRenamed("cve_id", "id").join(ids, "id").select(F.col("url_id")).join(corpus.url.select(F.col("id").alias("url_id"), "url", "host_id"), "url_id").join(corpus.host.select(F.col("id").alias("host_id"), F.col("name").alias("host")), "host_id", "left").select("url", "host").orderBy(F.asc_nulls_first("host"), "url").limit(cap["refs"]),
        "exists": lambda: ids,
    }
    out = {k: make() for k, make in makers.items() if parts is None or k in parts}
    if (parts is None or "kev" in parts) and corpus.kev is not None:
        out["kev"] = corpus.kev.withColumnRenamed("cve_id", "id").join(ids, "id").select("added", "due", "name", "descr", "action", "ransomware", "notes", "cwes", "vendor", "product").limit(1)
    return out


def cut_off(df: DataFrame, limit: int) -> tuple[list, bool]:
    """The rows within a limit, and whether there were more."""
    found = df.take(limit + 1)
    return found[:limit], len(found) > limit
