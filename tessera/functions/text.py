"""Cleaning, guarding and parsing of text, as column expressions and for single values."""

from __future__ import annotations

import base64
import json
import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Control and direction characters, characters that show nothing, and leads that a spreadsheet reads as a formula.
CONTROLS = r"[\u0000-\u001F\u007F-\u009F\u202A-\u202E\u2066-\u2069]+"
INVISIBLE = r"[\u061C\u200B-\u200F\u2028\u2029\u202F\u2060-\u2064\uFEFF\x{E0000}-\x{E007F}]"
FORMULA = r"^[=+\-@\t\r]"
CVE_ID = {"corpus": r"^CVE-\d{4}-\d{4,19}$", "catalog": r"^CVE-\d{4}-\d{4,12}$"}


def strip_controls(c: Column) -> Column:
    """Runs of control and direction characters become one blank."""
    return F.regexp_replace(c, CONTROLS, " ")


def strip_invisible(c: Column) -> Column:
    """For text that a model reads: each character besides that shows nothing becomes a blank, too."""
    return F.regexp_replace(strip_controls(c), INVISIBLE, " ")


def _guarded(c: Column) -> Column:
    return F.when(c.rlike(FORMULA), F.concat(F.lit("'"), c)).otherwise(c)


def csv_field(c: Column) -> Column:
    """On one line, always quoted, quotes doubled, and an apostrophe before what would be a formula; null is empty."""
    guarded = _guarded(strip_controls(F.coalesce(c, F.lit(""))))
    return F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))


def sheet_cell(c: Column, number: bool = False) -> Column:
    """A cell for a spreadsheet: on one line, formulas guarded; a column of numbers is as it is."""
    c = F.coalesce(c, F.lit(""))
    return c if number else _guarded(strip_controls(c))


def storable(c: Column) -> Column:
    """Whether raw JSON has no escape of half a character (an unpaired surrogate), which no text can hold."""
    escape = r"(?<!\\)(?:\\\\)*\\u"
    high, low = r"[dD][89abAB][0-9a-fA-F]{2}", r"[dD][c-fC-F][0-9a-fA-F]{2}"
    pairs = F.regexp_replace(c, rf"({escape}){high}\\u{low}", "")
    lone = ~F.coalesce(pairs.rlike(rf"{escape}[dD][89a-fA-F][0-9a-fA-F]{{2}}"), F.lit(False))
    return F.when(F.contains(c, F.lit("\\u")), lone).otherwise(True)  # most texts have no escape at all


def host(url: Column) -> Column:
    """What stands between :// and the next / ? or #, lower-cased, with user and port; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1))


def safe_url(url: Column) -> Column:
    """The url if it is http or https with a host, else null."""
    return F.when(url.rlike(r"(?i)^https?://[^/?#\s]+[^\s]*$"), url)


def json_list(c: Column) -> Column:
    """A list of strings from JSON; empty if it isn't one."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def notes(c: Column, most: int = 24, length: int = 512) -> Column:
    """Parts between semicolons with the first url of each."""
    parts = F.slice(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != ""), 1, most)
    return F.transform(parts, lambda x: F.struct(F.substring(x, 1, length).alias("text"), F.nullif(F.regexp_extract(x, r"(?i)(https?://\S+)", 1), F.lit("")).alias("url")))


def version_key(c: Column) -> Column:
    """Numbers of a dotted version, which compare as versions do."""
    return F.transform(F.split(c, r"\."), lambda x: F.coalesce(x.try_cast("long"), F.lit(0)))


def tokens_estimate(c: Column) -> Column:
    return F.ceil(F.length(c) / 2)


def is_cve_id(c: Column, layer: str = "corpus") -> Column:
    return c.rlike(CVE_ID[layer])


def english(descriptions: Column) -> Column:
    """Values whose language begins with en, joined by line feeds; null if there is none."""
    values = F.transform(F.filter(descriptions, lambda d: F.lower(d["lang"]).startswith("en") & d["value"].isNotNull()), lambda d: d["value"])
    return F.when(F.size(values) > 0, F.array_join(values, "\n"))


def plausible_version(text: str, least_year: int = 2021, most_year: int = 2100) -> tuple[int, ...] | None:
    """Numbers of a release such as 2026.08.08; None if it doesn't begin with a likely year."""
    if not re.fullmatch(r"\d{1,6}(\.\d{1,6}){0,7}", text or ""):
        return None
    out = tuple(map(int, text.split(".")))
    return out if least_year <= out[0] <= most_year else None


def short_count(n: float) -> str:
    for size, unit in ((1e9, "B"), (1e6, "M"), (1e3, "k")):
        if abs(n) >= size:
            x = n / size
            return f"{x:.0f}{unit}" if abs(x) >= 100 or x == int(x) else f"{x:.1f}{unit}"
    return f"{n:g}"


def nice_ticks(top: float, about: int = 5) -> list[float]:
    """Round steps from zero up to at least ``top``."""
    if top <= 0:
        return [0, 1]
    raw = top / max(1, about)
    size = 10 ** math.floor(math.log10(raw))
    step = next(s * size for s in (1, 2, 5, 10) if s * size >= raw)
    step = max(1, step)
    return [k * step for k in range(math.ceil(top / step) + 1)]


def slug(title: str, most: int = 60) -> str:
    return re.sub(r"[^a-z0-9]+", "-", title.lower()).strip("-")[:most].strip("-") or "report"


def inline(sql: str, values: list) -> str:
    """SQL to be read by people: each ? outside quotes replaced by its value."""
    def literal(v):
        return "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    rest = iter(values)
    return re.sub(r"'(?:[^']|'')*'|\?", lambda m: literal(next(rest)) if m[0] == "?" else m[0], sql)


FRAGMENT_MOST = 16_384


def to_fragment(value) -> str:
    return base64.urlsafe_b64encode(json.dumps(value, ensure_ascii=False, separators=(",", ":")).encode()).decode().rstrip("=")


def from_fragment(text: str):
    """The value of a fragment; None if it is too long or not one."""
    if len(text) > FRAGMENT_MOST:
        return None
    try:
        return json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
    except ValueError:
        return None
