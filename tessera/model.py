"""Codes, sentinels and table shapes of the record corpus."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields
from types import FunctionType

from pyspark.sql import DataFrame

# Stored codes of the data model.
PUBLISHED, REJECTED = 1, 2
SEVERITIES = {"NONE": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
CVSS_VERSIONS = (2, 30, 31, 4)
NOT_ASSESSED = -1
LISTED, NOT_LISTED = 1, 0
RANSOMWARE_KNOWN, RANSOMWARE_UNKNOWN, RANSOMWARE_NOT_LISTED = 1, 0, 2

SCHEMAS = {
    "cve": "id long, cve_id string, year int, state int, cna_id long, published long, updated long, cvss_ver int, cvss_score double, cvss_sev int, cvss_vec string, reserved long, ssvc_expl int, ssvc_auto int, ssvc_impact int",
    "cve_text": "cve_id long, descr string, title string, reason string",
    "cve_cwe": "cve_id long, cwe_id long",
    "cve_ref": "cve_id long, url_id long",
    "cve_prod": "cve_id long, product_id long, default_status int",
    "cve_ver": "cve_id long, product_id long, status int, version string, lt string, lte string, vtype long",
    "cna": "id long, name string",
    "cwe": "id long, cwe string, descr string",
    "vendor": "id long, name string",
    "product": "id long, vendor_id long, name string",
    "host": "id long, name string",
    "url": "id long, url string, host_id long",
    "vtype": "id long, name string",
    "kev": "cve string, cve_id long, vendor string, product string, name string, descr string, action string, added string, added_at long, due string, due_at long, ransomware int, notes string, cwes array<string>",
}


#: What is made of the tables and kept beside them.
DERIVED = ("postings", "bits")
#: What bitmaps are made of.
LINKED = {"cve_prod", "cve_cwe", "cve_ref", "product", "url"}


def once(make: Callable) -> Callable:
    """A function that makes something when it is first called, and gives the same from then on."""
    held: list = []

    def get():
        if not held:
            held.append(make())
        return held[0]

    return get


class Made(Mapping):
    """Things by name.  One that is given as a function is made when it is first asked for; one that is None then isn't there."""

    def __init__(self, makers: Mapping):
        held = makers._makers if isinstance(makers, Made) else makers
        self._makers = {n: once(v) if isinstance(v, FunctionType) else v for n, v in held.items()}

    def __getitem__(self, name: str):
        value = self._makers[name]
        value = value() if isinstance(value, FunctionType) else value
        if value is None:
            raise KeyError(name)
        return value

    def __iter__(self):
        return (n for n in self._makers if n in self)

    def __len__(self) -> int:
        return sum(1 for _ in self)

    def __or__(self, other: Mapping) -> Made:
        return Made(self._makers | (other._makers if isinstance(other, Made) else dict(other)))


@dataclass(frozen=True)
class Corpus:
    """The tables of one revision; kev is None until a catalog is loaded, postings until the texts are indexed, bits (bitmaps by axis) until they are made.

    A table may be given as a function, which is called when the table is asked for and should then give the same DataFrame each time."""

    cve: DataFrame
    cve_text: DataFrame
    cve_cwe: DataFrame
    cve_ref: DataFrame
    cve_prod: DataFrame
    cve_ver: DataFrame
    cna: DataFrame
    cwe: DataFrame
    vendor: DataFrame
    product: DataFrame
    host: DataFrame
    url: DataFrame
    vtype: DataFrame
    kev: DataFrame | None = None
    postings: DataFrame | None = None
    bits: Mapping[str, DataFrame] | None = None

    def __getattribute__(self, name: str):
        value = object.__getattribute__(self, name)
        return value() if isinstance(value, FunctionType) else value

    def having(self, **changed) -> Corpus:
        """The corpus with other tables; those that weren't asked for yet stay so.  Bitmaps go with the links that they were made of."""
        stale = {"bits": None} if LINKED & set(changed) else {}
        return Corpus(**({f.name: object.__getattribute__(self, f.name) for f in fields(self)} | stale | changed))

    def has(self, name: str) -> bool:
        """Whether a table is there or can be made, without asking for it."""
        return object.__getattribute__(self, name) is not None

    def made(self, name: str) -> bool:
        """Whether a table is there, without asking for it."""
        value = object.__getattribute__(self, name)
        return value is not None and not isinstance(value, FunctionType)

    def tables(self) -> dict[str, DataFrame]:
        """The tables of the data model; the index and the bitmaps are none of them."""
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name not in DERIVED and getattr(self, f.name) is not None}


class CatalogMissing(RuntimeError):
    """The overlay is asked for, but no catalog is loaded."""
