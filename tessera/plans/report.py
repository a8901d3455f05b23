"""Report definitions: validation, permalinks, the form that edits filters, and running them."""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame

from ..functions import text as T
from ..functions import times
from ..model import Corpus
from ..operators import reports
from ..operators.dims import DIMS
from ..operators.filters import Filters

VERSION = 1
CHARTS = ("bar", "line", "area", "table")
# Caps of a definition.
MOST_NAMES, MOST_TITLE, TABLE_ROWS, CHART_ROWS = 200, 200, 250, 12
CODES = {"severity": {0, 1, 2, 3, 4, -1}, "cvss_version": {2, 30, 31, 4, -1}, "ssvc_expl": {0, 1, 2, -1}, "ssvc_auto": {0, 1, -1}, "ssvc_impact": {0, 1, -1}, "kev": {0, 1}, "kev_ransomware": {0, 1, 2, -1}}
NAMES = ("cna", "vendor", "product", "cwe", "host")
BOUNDS = tuple(f.name for f in fields(Filters) if f.name.endswith(("_from", "_to", "_min", "_max")))


@dataclass(frozen=True)
class Report:
    title: str
    filters: Filters
    rows: str
    series: str | None = None
    chart: str = "table"
    sort: str | None = None
    limit: int | None = None
    v: int = VERSION


class Invalid(ValueError):
    """The definition isn't one that this build runs."""


def parse_filters(value) -> Filters:
    if value is None:
        return Filters()
    if not isinstance(value, dict):
        raise Invalid("filters must be an object")
    known = {f.name for f in fields(Filters)} - {"extra"}
    if odd := sorted(set(value) - known):
        raise Invalid(f"unknown filter: {odd[0]}")
    out = {}
    for k, x in value.items():
        if x is None:
            continue
        if k in NAMES:
            if not isinstance(x, list) or not all(isinstance(n, str) for n in x) or len(x) > MOST_NAMES:
                raise Invalid(f"{k} must be a list of at most {MOST_NAMES} names")
            out[k] = tuple(x)
        elif k in CODES:
            if not isinstance(x, list) or not all(type(c) is int and c in CODES[k] for c in x):
                raise Invalid(f"{k} must be a list of its codes")
            out[k] = tuple(dict.fromkeys(x))
        elif k in BOUNDS:
            if isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x):
                raise Invalid(f"{k} must be a finite number")
            out[k] = x
        elif not isinstance(x, str):
            raise Invalid(f"{k} must be text")
        else:
            out[k] = x
    if out.get("state") not in (None, "published", "rejected", "all"):
        raise Invalid("state must be published, rejected or all")
    return Filters(**out)


def parse(value) -> Report:
    if not isinstance(value, dict):
        raise Invalid("a report is an object")
    if value.get("v") != VERSION:
        raise Invalid(f"version {value.get('v')!r} isn't {VERSION}")
    if odd := sorted(set(value) - {f.name for f in fields(Report)}):
        raise Invalid(f"unknown field: {odd[0]}")
    title, rows, series = value.get("title", ""), value.get("rows"), value.get("series")
    if not isinstance(title, str) or len(title) > MOST_TITLE:
        raise Invalid(f"the title must be text of at most {MOST_TITLE} characters")
    if rows not in DIMS:
        raise Invalid(f"not a dimension: {rows!r}")
    if series is not None and series not in DIMS:
        raise Invalid(f"not a dimension: {series!r}")
    if rows == series:
        raise Invalid("the two axes must differ")
    chart, sort, limit = value.get("chart", "table"), value.get("sort"), value.get("limit")
    if chart not in CHARTS:
        raise Invalid(f"not a chart: {chart!r}")
    if sort is not None and sort not in reports.SORTS:
        raise Invalid(f"not a sort: {sort!r}")
    if limit is not None and (type(limit) is not int or not 1 <= limit <= reports.GROUPS):
        raise Invalid(f"the limit must be from 1 to {reports.GROUPS}")
    return Report(title, parse_filters(value.get("filters")), rows, series, chart, sort, limit)


def as_value(report: Report) -> dict:
    out = {k: v for k, v in asdict(report).items() if v is not None}
    out["filters"] = {k: list(v) if isinstance(v, tuple) else v for k, v in out["filters"].items() if v is not None and k != "extra"}
    return out


def to_fragment(report: Report) -> str:
    return T.to_fragment(as_value(report))


def from_fragment(text: str) -> Report:
    value = T.from_fragment(text)
    if value is None:
        raise Invalid("not a permalink of a report")
    return parse(value)


def row_cap(report: Report) -> int:
    return report.limit if report.limit is not None else TABLE_ROWS if report.chart == "table" else CHART_ROWS


def run(corpus: Corpus, report: Report) -> tuple[DataFrame, DataFrame]:
    """The cells, and how many records match."""
    return reports.cross(corpus, report.filters, report.rows, report.series, row_cap(report)), reports.count(corpus, report.filters)


# --- the form ------------------------------------------------------------------------------------------


def to_form(filters: Filters) -> dict[str, str]:
    """Filters as the fields of a form: names by line, codes in their order, instants as days."""
    out = {}
    for f in fields(Filters):
        x = getattr(filters, f.name)
        if f.name == "extra" or x is None:
            continue
        if f.name in NAMES:
            out[f.name] = "\n".join(x)
        elif f.name in CODES:
            out[f.name] = ",".join(map(str, sorted(x, key=lambda c: (c == -1, c))))
        elif f.name in BOUNDS and not f.name.startswith(("score", "year")):
            out[f.name] = dt.datetime.fromtimestamp(x, dt.UTC).date().isoformat()
        else:
            out[f.name] = str(x)
    return out


def from_form(form: dict[str, str]) -> Filters:
    out = {}
    for k, x in form.items():
        if not x.strip():
            continue
        if k in NAMES:
            out[k] = tuple(n.strip() for n in x.split("\n") if n.strip())
        elif k in CODES:
            out[k] = tuple(sorted({int(c) for c in x.split(",")}, key=lambda c: (c == -1, c)))
        elif k in BOUNDS and k.startswith(("score", "year")):
            out[k] = float(x) if k.startswith("score") else int(float(x))
        elif k in BOUNDS:
            day = times.lenient_day(x, end=k.endswith("_to"))
            if day is not None:
                at = int(dt.datetime(day.year, day.month, day.day, tzinfo=dt.UTC).timestamp())
                out[k] = at + times.DAY - 1 if k.endswith("_to") else at
        else:
            out[k] = x
    return Filters(**out)


def chips(filters: Filters) -> list[str]:
    """One short text for each filter that is set."""
    return [f"{k.replace('_', ' ')}: {v.replace(chr(10), ', ')}" for k, v in to_form(filters).items()]


@dataclass
class Shelf:
    """Saved reports and recent ones, each once by its permalink, the latest first."""

    most_saved: int = 100
    most_recent: int = 20

    def __post_init__(self):
        self.saved: list[str] = []
        self.recent: list[str] = []

    def save(self, report: Report) -> bool:
        fragment = to_fragment(report)
        if fragment not in self.saved and len(self.saved) >= self.most_saved:
            return False
        self.saved = [fragment, *(f for f in self.saved if f != fragment)]
        return True

    def visit(self, report: Report) -> None:
        fragment = to_fragment(report)
        self.recent = [fragment, *(f for f in self.recent if f != fragment)][: self.most_recent]


