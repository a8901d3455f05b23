"""A surface of six tools over the corpus: arguments are parsed strictly, results come in bounded windows."""

from __future__ import annotations

import json
import subprocess
import sys
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession

from ..functions import times
from ..model import SEVERITIES, Corpus
from ..operators import reports
from ..operators.dims import DIMS
from ..operators.filters import Filters, require_kev, unmatched
from . import guard
from .report import NAMES

TOOLS = ("aggregate", "search_records", "cve_detail", "kev_lookup", "sql", "compute")
# What of a result is told.
MOST_CELLS, MOST_ROWS, MOST_CELL, MOST_TEXT = 240, 50, 200, 12_000
COMPUTE_SECONDS, COMPUTE_LOG = 10, 20
WORDS = {
    "severity": {k.lower(): v for k, v in SEVERITIES.items()} | {"not scored": -1},
    "cvss_version": {"2": 2, "2.0": 2, "3.0": 30, "3.1": 31, "4": 4, "4.0": 4},
    "ssvc_expl": {"none": 0, "poc": 1, "active": 2, "not assessed": -1},
    "ssvc_auto": {"no": 0, "yes": 1, "not assessed": -1},
    "ssvc_impact": {"partial": 0, "total": 1, "not assessed": -1},
    "kev": {"listed": 1, "not listed": 0},
    "kev_ransomware": {"unknown": 0, "known": 1, "not listed": 2, "not stated": -1},
}


class BadCall(ValueError):
    """The arguments aren't those of the tool."""


def _list(x) -> list[str]:
    if isinstance(x, str):
        return [p.strip() for p in x.split(",") if p.strip()]
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return [f"{x:g}"]
    if isinstance(x, list) and all(isinstance(p, (str, int, float)) for p in x):
        return [str(p).strip() for p in x]
    raise BadCall("a list of words is expected")


def parse_filters(args: dict) -> Filters:
    known = {f.name: f for f in fields(Filters) if f.name != "extra"}
    out = {}
    for k, x in args.items():
        if k not in known:
            raise BadCall(f"unknown argument: {k}")
        if x is None:
            continue
        if k in NAMES:
            out[k] = tuple(_list(x))
        elif k in WORDS:
            codes = [WORDS[k].get(w.lower()) for w in _list(x)]
            if None in codes:
                raise BadCall(f"{k}: one of {', '.join(WORDS[k])} is expected")
            out[k] = tuple(codes)
        elif k.endswith(("_from", "_to")) and not k.startswith("year"):
            day = times.lenient_day(str(x), end=k.endswith("_to"))
            if day is None:
                raise BadCall(f"{k}: a day is expected")
            out[k] = (day - times.dt.date(1970, 1, 1)).days * times.DAY
        elif k.startswith(("score", "year")):
            try:
                out[k] = float(x)
            except (TypeError, ValueError):
                raise BadCall(f"{k}: a number is expected") from None
        else:
            out[k] = str(x)
    return Filters(**out)


def parse_call(name: str, args) -> dict:
    """The call as plain data; unknown tools and arguments are refused."""
    if name not in TOOLS:
        raise BadCall(f"unknown tool: {name}")
    if isinstance(args, str):
        try:
            args = json.loads(args)
        except ValueError:
            raise BadCall("the arguments aren't JSON") from None
    if not isinstance(args, dict):
        raise BadCall("the arguments are an object")
    args = dict(args)
    take = lambda k, needed=False: args.pop(k) if k in args else (_missing(k) if needed else None)
    if name == "aggregate":
        call = {"rows": take("rows", True), "series": take("series"), "limit": take("limit")}
        for k in ("rows", "series"):
            if call[k] is not None and call[k] not in DIMS:
                raise BadCall(f"{k}: one of {', '.join(DIMS)} is expected")
        return {"tool": name, **call, "filters": parse_filters(args)}
    if name == "search_records":
        return {"tool": name, "sort": take("sort"), "limit": take("limit"), "filters": parse_filters(args)}
    call = {k: take(k, True) for k in {"cve_detail": ["cve"], "kev_lookup": ["cve"], "sql": ["query"], "compute": ["code"]}[name]}
    if args:
        raise BadCall(f"unknown argument: {sorted(args)[0]}")
    return {"tool": name, **call}


def _missing(k):
    raise BadCall(f"{k} is needed")


def frame(corpus: Corpus, call: dict) -> DataFrame:
    """What a call that counts or lists records answers from."""
    if call["tool"] == "aggregate":
        require_kev(corpus, call["filters"], call["rows"], call["series"])
        return reports.cross(corpus, call["filters"], call["rows"], call["series"], call["limit"])
    return reports.rows(corpus, call["filters"], call["limit"] or MOST_ROWS, 0, call["sort"])


def run(spark: SparkSession, corpus: Corpus, call: dict, last: guard.Answer | None = None):
    """What a parsed call gives: an Answer, or tables by name for a record's detail."""
    answer = _answer
    tool = call["tool"]
    if tool in ("aggregate", "search_records"):
        return answer(frame(corpus, call), MOST_CELLS if tool == "aggregate" else MOST_ROWS)
    if tool == "cve_detail":
        return {k: answer(df, 50) for k, df in reports.detail(corpus, call["cve"]).items()}
    if tool == "kev_lookup":
        require_kev(corpus, Filters(kev=(1,)))
        parts = reports.detail(corpus, call["cve"])
        return {"known": bool(parts["exists"].take(1)), "entry": answer(parts["kev"], 1)}
    if tool == "sql":
        return guard.run(spark, corpus, call["query"])
    return compute(call["code"], last)


def _answer(df, n: int) -> guard.Answer:
    rows, cut = reports.cut_off(df, n)
    return guard.Answer(df.columns, [tuple(r) for r in rows], cut, False)


def unmatched_names(corpus: Corpus, filters: Filters) -> dict[str, list[str]]:
    """Names of each axis that the corpus doesn't have; at most as many as were asked for."""
    return {a: found for a in NAMES if getattr(filters, a) and (found := sorted(r["name_key"] for r in unmatched(corpus, a, getattr(filters, a)).collect()))}


def describe(answer: guard.Answer, rows: int = MOST_ROWS) -> str:
    """The result as text: so many rows, each cell cut, the whole cut at its bound; what is left out is told."""
    lines = ["\t".join(answer.columns)]
    size, told = len(lines[0]), 0
    for r in answer.rows[:rows]:
        line = "\t".join(("" if x is None else str(x))[:MOST_CELL].replace("\t", " ").replace("\n", " ") for x in r)
        if told and size + len(line) + 1 > MOST_TEXT:
            break
        lines.append(line[:MOST_TEXT])
        size, told = size + len(line) + 1, told + 1
    if told < len(answer.rows) or answer.truncated:
        lines.append(f"({told} of {'more than ' * answer.truncated}{len(answer.rows)} rows)")
    return "\n".join(lines)


_RUNNER = """
import json, sys
code, columns, rows, most_log, most = json.loads(sys.stdin.read())
log = []
scope = {"columns": columns, "rows": [tuple(r) for r in rows], "data": [dict(zip(columns, r)) for r in rows], "log": lambda *a: log.append(" ".join(map(str, a))) if len(log) < most_log else None}
try:
    exec("def __body():\\n" + "\\n".join("    " + x for x in code.splitlines() or ["pass"]), scope)
    out = ["ok", json.dumps(scope["__body"](), default=str)[:most], log]
except Exception as e:
    out = ["error", f"{type(e).__name__}: {e}"[:most], log]
sys.__stdout__.write("\\n" + json.dumps(out))
"""


def compute(code: str, last: guard.Answer | None, seconds: float = COMPUTE_SECONDS) -> tuple[str, str, list[str]]:
    """Run a function body over the last result in a process of its own, with a deadline and without the driver's environment.

    This is no security boundary: it keeps runaway code off the driver, not hostile code out."""
    given = json.dumps([code, last.columns if last else [], last.rows if last else [], COMPUTE_LOG, MOST_TEXT], default=str)
    try:
        done = subprocess.run([sys.executable, "-I", "-c", _RUNNER], input=given, capture_output=True, text=True, timeout=seconds, env={}, check=False)
        return tuple(json.loads(done.stdout.rpartition("\n")[2]))
    except subprocess.TimeoutExpired:
        return "error", "it took too long", []
    except ValueError:
        return "error", "it gave no result", []
