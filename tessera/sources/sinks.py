"""Exports: CSV with a preamble, JSON, spreadsheet text, and the caps that they keep."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..model import Corpus
from ..operators import reports
from ..operators.filters import Filters

EXPORT_MOST = 50_000
NUMBERS = {"tinyint", "smallint", "int", "bigint", "float", "double", "decimal"}


def csv_lines(df: DataFrame) -> DataFrame:
    """line: each row as a CSV line with guarded fields."""
    return df.select(F.concat_ws(",", *[T.csv_field(F.col(f"`{c}`").cast("string")) for c in df.columns]).alias("line"))


def csv_header(df: DataFrame) -> str:
    return ",".join('"' + c.replace('"', '""') + '"' for c in df.columns)


def csv_text(df: DataFrame, about: dict[str, str]) -> Iterator[str]:
    """A CSV file piece by piece: # lines that tell what it is, the header, the rows, ended by CRLF."""
    for k, v in about.items():
        clean = " ".join(str(v).split())
        yield f"# {k}: {clean}\r\n"
    yield csv_header(df) + "\r\n"
    for row in csv_lines(df).toLocalIterator():
        yield row["line"] + "\r\n"


def json_rows(df: DataFrame) -> DataFrame:
    """row: each row as a JSON object, nulls included."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"))


def json_text(df: DataFrame, about: dict) -> Iterator[str]:
    """One JSON object piece by piece: what it is, then the rows."""
    yield json.dumps(about, ensure_ascii=False)[:-1] + (", " if about else "") + '"rows": ['
    for i, row in enumerate(json_rows(df).toLocalIterator()):
        yield ("," if i else "") + "\n" + row["row"]
    yield "\n]}\n"


def sheet_rows(df: DataFrame) -> DataFrame:
    """line: cells between tabs."""
    return df.select(F.concat_ws("\t", *[_cell(c, t) for c, t in df.dtypes]).alias("line"))


def _cell(name: str, kind: str) -> Column:
    return T.sheet_cell(F.col(f"`{name}`").cast("string"), kind.split("(")[0] in NUMBERS)


def html_rows(df: DataFrame) -> DataFrame:
    def cell(c: str, kind: str) -> Column:
        x = _cell(c, kind)
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            x = F.replace(x, F.lit(a), F.lit(b))
        return F.concat(F.lit("<td>"), x, F.lit("</td>"))

    return df.select(F.concat(F.lit("<tr>"), *[cell(c, t) for c, t in df.dtypes], F.lit("</tr>")).alias("line"))


def records(corpus: Corpus, filters: Filters, sort: str | None = None, most: int = EXPORT_MOST) -> DataFrame:
    """All matching records in order, up to the cap; ``export`` tells besides how many there are."""
    found = reports.matching(corpus, filters)
    page = found.orderBy(*reports._sorted(found, sort)).limit(most)
    text = corpus.cve_text.select(F.col("cve_id").alias("id"), "descr", "title", "reason")
    page = reports.D.join(corpus, page, "cna").join(text, "id", "left")
    return page.orderBy(*reports._sorted(page, sort)).select(F.col("cve_id").alias("cve"), "state", "published", "updated", "cvss_ver", "cvss_score", "cvss_sev", F.col("cna_name").alias("cna"), F.col("descr").alias("description"), "title", "reason")


def export(corpus: Corpus, filters: Filters, about: dict[str, str] | None = None, sort: str | None = None, most: int = EXPORT_MOST) -> Iterator[str]:
    """A CSV file of the matching records piece by piece, whose preamble tells how many match and how many are given."""
    total = reports.count(corpus, filters).first()["matches"]
    told = {"records": f"{min(total, most)} of {total}"} | ({"truncated": f"the first {most}"} if total > most else {})
    yield from csv_text(records(corpus, filters, sort, most), (about or {}) | told)


def cells(cross: DataFrame, two_axes: bool, cap: int = reports.CELLS) -> DataFrame:
    """Labels and counts of a report; refuses two axes whose cells were cut."""
    if two_axes and len(cross.take(cap + 1)) > cap:
        raise ValueError("more cells than an export may have: narrow the report")
    return cross.select("label", *(["series_label"] if two_axes else []), "cves")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def digests(df_files: DataFrame) -> DataFrame:
    """path, size and sha256 of files read as binaryFile: the manifest of a snapshot."""
    return df_files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
