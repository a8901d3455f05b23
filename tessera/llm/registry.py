"""The queries and the SQL of this subpackage."""

from __future__ import annotations

from . import chat, decontaminate, fingerprint, langid, language_model, lines, packing, repeats, simhash, spelling, substrings, warc, whitening

MODULES = (decontaminate, fingerprint, langid, language_model, lines, packing, repeats, simhash, substrings, warc, spelling, whitening, chat)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in getattr(m, "ORACLES", {}).items()}
