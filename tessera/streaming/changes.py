"""Change capture between revisions: diff, state, deltas, their checks, and applying them.

A delta is a set of tables: the new or changed rows of each lookup, the whole rows of changed
records, and the ids that go.  Applying replaces records whole: what a delta doesn't state of a
record is absent.  Revisions are directories of tables; a pointer written last makes one current.
"""

from __future__ import annotations

import json
import uuid
from collections import deque
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import DERIVED, SCHEMAS, Corpus, Made, once
from ..operators import bitmaps, idsets, search
from ..operators.etl import fingerprint
from ..sources import store

LOOKUPS = ("cna", "cwe", "vendor", "product", "host", "url", "vtype")
LINKS = ("cve_text", "cve_cwe", "cve_ref", "cve_prod", "cve_ver")
#: table, column, and the lookup that it refers to.
REFERENCES = (("cve", "cna_id", "cna"), ("cve_cwe", "cwe_id", "cwe"), ("cve_ref", "url_id", "url"), ("cve_prod", "product_id", "product"), ("cve_ver", "product_id", "product"), ("cve_ver", "vtype", "vtype"), ("product", "vendor_id", "vendor"), ("url", "host_id", "host"))
MOST_DELETED = 0.001
MOST_INT = (1 << 53) - 1


class Refused(ValueError):
    """A change that would damage the copy it is meant for."""


def diff(state: DataFrame, scanned: DataFrame, key: str = "cve_id") -> DataFrame:
    """key, kind: added, changed or deleted.  Both sides: key, hash."""
    old, new = state.select(key, F.col("hash").alias("old")), scanned.select(key, F.col("hash").alias("new"))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return old.join(new, key, "full").select(key, kind.alias("kind")).filter("kind is not null")


def guard_deletions(changes: DataFrame, corpus_rows: int, limit: float = MOST_DELETED) -> None:
    if not 0 <= limit < 1:
        raise ValueError("the limit must be at least 0 and less than 1")
    deleted = changes.filter("kind = 'deleted'").count()
    if deleted > corpus_rows * limit:
        raise Refused(f"{deleted} of {corpus_rows} records would be deleted")


def cross_check(**pairs: tuple[int, int]) -> None:
    """Two passes over the same input must agree."""
    for name, (a, b) in pairs.items():
        if a != b:
            raise Refused(f"{name}: one pass has {a}, the other {b}")


def commit_state(state: DataFrame, tombstones: DataFrame, scanned: DataFrame, changes: DataFrame, rev: int, key: str = "cve_id") -> tuple[DataFrame, DataFrame]:
    """State (key, hash, rev) and tombstones (key, rev) after a run; the tombstone of a record that returns is kept."""
    touched = changes.select(key).distinct()
    fresh = scanned.join(changes.filter("kind <> 'deleted'").select(key), key, "left_semi").select(key, "hash", F.lit(rev).alias("rev"))
    dead = changes.filter("kind = 'deleted'").select(key, F.lit(rev).alias("rev"))
    return state.join(touched, key, "left_anti").select(key, "hash", "rev").unionByName(fresh), tombstones.join(dead, key, "left_anti").select(key, "rev").unionByName(dead)


@dataclass(frozen=True)
class Delta:
    start: int
    end: int
    lookups: Mapping[str, DataFrame]
    tables: Mapping[str, DataFrame]  # cve and LINKS
    gone: DataFrame  # cve_id (the identifier)
    about: dict = field(default_factory=dict)


def moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of a lookup that keep their id with other content."""
    columns = [c for c in after.columns if c != "id"]
    old = before.select("id", *[F.col(c).alias(f"old_{c}") for c in columns])
    changed = F.lit(False)
    for c in columns:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
    return after.join(old, "id").filter(changed).select("id", *columns)


def extract(before: Corpus, after: Corpus, changes: DataFrame, start: int, end: int, floors: dict[str, int]) -> Delta:
    """What leads from one revision to the next; floors: the high-water marks of the first.

    Only the tables that are asked for of the delta are asked for of the two revisions.  Identifiers
    are looked up once; records and links are cut by the set of the ids found."""
    upsert = changes.filter("kind <> 'deleted'").select("cve_id")
    ids = once(lambda: idsets.made(after.cve.select("id", "cve_id").join(upsert, "cve_id", "left_semi")))

    def lookup(name: str) -> DataFrame:
        table = getattr(after, name)
        new = table.filter(F.col("id") > floors.get(name, 0))
        return new.unionByName(moved(getattr(before, name), table).join(new.select("id"), "id", "left_anti").select(table.columns))

    def links(name: str) -> DataFrame:
        return idsets.within(getattr(after, name), ids(), "cve_id")

    lookups = Made({n: lambda n=n: lookup(n) for n in LOOKUPS})
    tables = Made({"cve": lambda: idsets.within(after.cve, ids(), "id")} | {n: lambda n=n: links(n) for n in LINKS})
    return Delta(start, end, lookups, tables, changes.filter("kind = 'deleted'").select("cve_id"))


def closure(delta: Delta, held: Corpus | None) -> DataFrame:
    """table, column, id of references that neither the delta nor the copy has."""
    out = None
    for table, column, lookup in REFERENCES:
        rows = delta.lookups[table] if table in LOOKUPS else delta.tables[table]
        wanted = rows.select(F.col(column).alias("id")).filter(F.col("id").isNotNull()).distinct()
        missing = wanted.join(delta.lookups[lookup].select("id"), "id", "left_anti")
        if held is not None:
            missing = missing.join(getattr(held, lookup).select("id"), "id", "left_anti")
        missing = missing.select(F.lit(table).alias("table"), F.lit(column).alias("column"), "id")
        out = missing if out is None else out.unionByName(missing)
    return out


#: Columns that a row must have, and those of the links that make a row the same as another.
NEEDED = {"cve": ("id", "cve_id", "state"), "cve_text": ("cve_id",), "cve_cwe": ("cve_id", "cwe_id"), "cve_ref": ("cve_id", "url_id"), "cve_prod": ("cve_id", "product_id"), "cve_ver": ("cve_id", "product_id"), "cna": ("id", "name"), "cwe": ("id", "cwe"), "vendor": ("id", "name"), "product": ("id", "vendor_id", "name"), "host": ("id", "name"), "url": ("id", "url"), "vtype": ("id", "name")}
LINK_KEYS = {"cve_text": ("cve_id",), "cve_cwe": ("cve_id", "cwe_id"), "cve_ref": ("cve_id", "url_id"), "cve_prod": ("cve_id", "product_id")}
MOST_ID = 64


def problems(delta: Delta) -> DataFrame:
    """What is wrong with a delta by itself: problem, key."""
    cve = delta.tables["cve"]
    told = lambda df, problem, key: df.select(F.lit(problem).alias("problem"), F.col(key).cast("string").alias("key"))
    twice = lambda df, *key: df.groupBy(*key).count().filter("count > 1")
    parts = [
        told(twice(cve, "cve_id"), "record twice", "cve_id"),
        told(twice(cve, "id"), "record id twice", "id"),
        told(twice(delta.gone, "cve_id"), "deleted twice", "cve_id"),
        told(cve.join(delta.gone, "cve_id", "left_semi"), "both changed and deleted", "cve_id"),
        told(cve.filter(~F.col("cve_id").rlike(r"^CVE-\d{4}-\d{4,55}$") | (F.length("cve_id") > MOST_ID) | (F.col("id") < 1) | (F.col("id") > MOST_INT)), "identifier out of bounds", "cve_id"),
    ]
    for name, t in {**delta.lookups, **delta.tables}.items():
        key = "id" if "id" in t.columns else "cve_id"
        missing = [F.col(c).isNull() for c in NEEDED[name]]
        parts.append(told(t.filter(_any(missing)), f"{name} lacks a value", key))
        numbers = [c for c, kind in t.dtypes if kind in ("bigint", "int") and (c == "id" or c.endswith("_id"))]
        if name != "cve":
            parts.append(told(t.filter(_any([(F.col(c) < 1) | (F.col(c) > MOST_INT) for c in numbers])), f"{name} out of bounds", key))
    for name, t in delta.lookups.items():
        parts.append(told(twice(t, "id"), f"{name} twice", "id"))
    for name, columns in LINK_KEYS.items():
        parts.append(told(twice(delta.tables[name], *columns), f"{name} twice", "cve_id"))
    for name in LINKS:  # links come with their record
        parts.append(told(delta.tables[name].select("cve_id").distinct().join(cve.select(F.col("id").alias("cve_id")), "cve_id", "left_anti"), f"{name} of no record here", "cve_id"))
    return reduce(DataFrame.union, parts)


def _any(conditions: list) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def pairing(delta: Delta, held: Corpus) -> DataFrame:
    """Identifiers that the delta and the copy give different ids, or ids that they give different identifiers."""
    new, old = delta.tables["cve"].select("id", "cve_id"), held.cve.select(F.col("id").alias("old_id"), F.col("cve_id").alias("old_cve"))
    a = new.join(old, F.col("cve_id") == F.col("old_cve")).filter("id <> old_id")
    b = new.join(old, F.col("id") == F.col("old_id")).filter("cve_id <> old_cve")
    return a.select("id", "cve_id", "old_id", "old_cve").unionByName(b.select("id", "cve_id", "old_id", "old_cve"))


def check(delta: Delta, held: Corpus, rev: int) -> None:
    if delta.start != rev:
        raise Refused(f"the copy is at revision {rev}, the delta begins at {delta.start}")
    if delta.end <= delta.start:
        raise Refused("a delta must lead to a later revision")
    for name, found in (("the delta contradicts itself", problems(delta)), ("ids don't pair", pairing(delta, held)), ("references lead nowhere", closure(delta, held))):
        if row := found.limit(1).collect():
            raise Refused(f"{name}: {row[0].asDict()}")


def apply(held: Corpus, delta: Delta) -> Corpus:
    """The copy after the delta: lookups put in place, changed records replaced whole, deleted ones gone.

    Only the tables that are asked for of the result are asked for of the copy and the delta."""

    def lookup(name: str) -> DataFrame:
        table, rows = getattr(held, name), delta.lookups[name]
        return table.join(rows.select("id"), "id", "left_anti").select(table.columns).unionByName(rows.select(table.columns))

    def records(name: str) -> DataFrame:
        table, key = getattr(held, name), "id" if name == "cve" else "cve_id"
        return idsets.without(table, touched(), key).unionByName(delta.tables[name].select(table.columns))

    @once
    def ids() -> DataFrame:
        gone = held.cve.select("id", "cve_id").join(delta.gone, "cve_id", "left_semi").select("id")
        return gone.unionByName(delta.tables["cve"].select("id"))

    touched = once(lambda: idsets.made(ids()))
    makers = {n: lambda n=n: lookup(n) for n in LOOKUPS} | {n: lambda n=n: records(n) for n in ("cve", *LINKS)}
    if held.has("kev"):  # the overlay follows the records' ids
        makers["kev"] = lambda: resolve(held.kev, after.cve)
    if held.has("postings"):  # and so does the index
        makers["postings"] = lambda: search.maintain(held.postings, delta.tables["cve_text"], ids().distinct().withColumnRenamed("id", "cve_id"), "cve_id", list(search.FIELDS))
    after = held.having(**{n: once(make) for n, make in makers.items()})
    return after.having(bits=once(lambda: bitmaps.maintain(held.bits, after, ids().distinct()))) if held.made("bits") else after


def resolve(kev: DataFrame, cve: DataFrame) -> DataFrame:
    """The overlay with the ids of the records it names; entries that name no record stay, with a null id."""
    return kev.drop("cve_id").join(cve.select(F.col("cve_id").alias("cve"), F.col("id").alias("cve_id")), "cve", "left").select(kev.columns)


# --- revisions on disk -------------------------------------------------------------------------------

#: What files of a table are ranges of.
LAYOUT = {"cve": ("cve_id",), "postings": ("term", "doc")} | {n: ("cve_id",) for n in LINKS}


def laid(name: str, df: DataFrame) -> DataFrame:
    """A table in its ranges, without repeated links: these are in one range, so a single shuffle serves both."""
    order = LAYOUT.get(name)
    if order:
        df = df.repartitionByRange(*order)
    if name in LINK_KEYS:
        df = df.dropDuplicates(list(LINK_KEYS[name]))
    return df.sortWithinPartitions(*order) if order else df


def save(corpus: Corpus, path: str, rev: int) -> None:
    """Write a revision into a folder of its own, sorted and without repeated links, then let the pointer name it.

    The pointer is replaced by a rename, so there is a current revision at any time, and a run that
    breaks off leaves nothing but a folder that no pointer names."""
    spark, at = corpus.cve.sparkSession, f"rev={rev}-{uuid.uuid4().hex}"
    tables = corpus.tables() | ({"postings": corpus.postings} if corpus.postings is not None else {})
    for name, df in tables.items():
        laid(name, df).write.parquet(f"{path}/{at}/{name}")
    store.put(spark, f"{path}/current", json.dumps({"rev": rev, "at": at, "tables": sorted(tables)}))


def _pointer(spark: SparkSession, path: str) -> dict:
    text = store.get(spark, f"{path}/current")
    if text is None:
        raise Refused(f"nothing is current at {path}")
    return json.loads(text)


def current(spark: SparkSession, path: str) -> int:
    return _pointer(spark, path)["rev"]


def load(spark: SparkSession, path: str, rev: int | None = None) -> Corpus:
    """The current revision; with ``rev`` it must be that one."""
    pointer = _pointer(spark, path)
    if rev is not None and rev != pointer["rev"]:
        raise Refused(f"revision {pointer['rev']} is current, not {rev}")
    return Corpus(**{n: spark.read.parquet(f"{path}/{pointer['at']}/{n}") for n in pointer["tables"]})


def tidy(spark: SparkSession, path: str) -> list[str]:
    """Delete the folders of revisions that the pointer doesn't name: older ones and those of runs that broke off."""
    keep = _pointer(spark, path)["at"]
    gone = [n for n in store.names(spark, path) if n.startswith("rev=") and n != keep]
    for n in gone:
        store.delete(spark, f"{path}/{n}")
    return gone


ENVELOPE = {"from", "to", "generated", "tables"}


def write_delta(delta: Delta, path: str) -> None:
    """The tables of a delta, and last the envelope that tells each one's columns, rows and digest; a delta that has an envelope is never written again."""
    spark, at = delta.gone.sparkSession, f"{path}/from={delta.start}/to={delta.end}"
    if store.exists(spark, f"{at}/envelope"):
        raise Refused(f"the delta {delta.start}-{delta.end} is published already")
    told = {}
    for name, df in {**delta.lookups, **delta.tables, "gone": delta.gone}.items():
        df = df.select([F.col(c.split()[0]).cast(c.split()[1]) for c in shape(name).split(", ")])
        df.write.mode("overwrite").parquet(f"{at}/{name}")
        back = spark.read.schema(df.schema).parquet(f"{at}/{name}")
        told[name] = {"columns": back.columns, "rows": back.count(), "digest": fingerprint(back)}
    store.put(spark, f"{at}/envelope", json.dumps({"from": delta.start, "to": delta.end, "generated": delta.about.get("generated", 0), "tables": told}))


def shape(name: str) -> str:
    return "cve_id string" if name == "gone" else SCHEMAS[name]


def validate(envelope, start: int, end: int) -> dict:
    """The envelope, once it is exactly what one may be."""
    if not isinstance(envelope, dict) or set(envelope) != ENVELOPE:
        raise Refused("the envelope has keys too many or too few")
    for key, least in (("from", 0), ("to", 1), ("generated", 0)):
        value = envelope[key]
        if not isinstance(value, int) or isinstance(value, bool) or not least <= value <= MOST_INT:
            raise Refused(f"the envelope's {key} is no revision or time")
    if (envelope["from"], envelope["to"]) != (start, end):
        raise Refused("the envelope is another delta's")
    tables = envelope["tables"]
    if not isinstance(tables, dict) or set(tables) != {*LOOKUPS, "cve", *LINKS, "gone"}:
        raise Refused("the delta has tables too many or too few")
    for name, told in tables.items():
        if not isinstance(told, dict) or set(told) != {"columns", "rows", "digest"} or told["columns"] != [c.split()[0] for c in shape(name).split(", ")]:
            raise Refused(f"{name} has columns too many, too few or in another order")
    return envelope


def read_delta(spark: SparkSession, path: str, start: int, end: int) -> Delta:
    """The delta, once its envelope is valid and each table is what the envelope says."""
    at = f"{path}/from={start}/to={end}"
    text = store.get(spark, f"{at}/envelope")
    if text is None:
        raise Refused(f"no delta leads from {start} to {end}")
    try:
        envelope = validate(json.loads(text), start, end)
    except json.JSONDecodeError as e:
        raise Refused(f"the envelope isn't JSON: {e}") from None
    out = {}
    for name, told in envelope["tables"].items():
        found = spark.read.parquet(f"{at}/{name}")
        if [f"{c} {t}" for c, t in found.dtypes] != [f"{c} {t}" for c, t in spark.createDataFrame([], shape(name)).dtypes]:
            raise Refused(f"{name} has columns too many, too few or of another type")
        if found.count() != told["rows"] or fingerprint(found) != told["digest"]:
            raise Refused(f"{name} isn't what the envelope says")
        out[name] = found
    return Delta(start, end, {n: out[n] for n in LOOKUPS}, {n: out[n] for n in ("cve", *LINKS)}, out["gone"], {"generated": envelope["generated"]})


# --- publishing, once ---------------------------------------------------------------------------------


def begin(spark: SparkSession, path: str, start: int, end: int, generated: int, floors: dict[str, int], changes: DataFrame) -> dict:
    """Pin what a run is about to publish, before it publishes anything; a run that is pinned already must be finished first."""
    if store.exists(spark, f"{path}/pending"):
        raise Refused("a run is pending: resume it first")
    at = f"{path}/changes-{uuid.uuid4().hex}"
    changes.write.parquet(at)
    pending = {"from": start, "to": end, "generated": generated, "floors": floors, "changes": at}
    store.put(spark, f"{path}/pending", json.dumps(pending))
    return pending


def resume(spark: SparkSession, path: str, before: Corpus, after: Corpus, deltas: str) -> int | None:
    """Finish the pending run from its pin: the delta unless it is out already, then the revision, then the pin goes.  None if nothing is pending.

    Run again after a crash at any point, it publishes the same delta, as the pin holds all that decides it."""
    text = store.get(spark, f"{path}/pending")
    if text is None:
        return None
    pin = json.loads(text)
    start, end = pin["from"], pin["to"]
    if not store.exists(spark, f"{deltas}/from={start}/to={end}/envelope"):
        delta = extract(before, after, spark.read.parquet(pin["changes"]), start, end, pin["floors"])
        write_delta(Delta(delta.start, delta.end, delta.lookups, delta.tables, delta.gone, {"generated": pin["generated"]}), deltas)
    if not store.exists(spark, f"{path}/current") or current(spark, path) < end:
        save(after, path, end)
    store.delete(spark, f"{path}/pending")
    store.delete(spark, pin["changes"])
    return end


# --- lineage of ids -------------------------------------------------------------------------------------


def ledger(spark: SparkSession, path: str) -> dict:
    """What was published: the id space's token, and by revision the fingerprint of its ids."""
    return json.loads(store.get(spark, f"{path}/ledger") or '{"token": null, "space": {}}')


def record(spark: SparkSession, path: str, token: str, rev: int, prints: dict[str, str]) -> None:
    held = ledger(spark, path)
    if held["space"].get(str(rev), prints) != prints:
        raise Refused(f"revision {rev} is recorded with other ids")
    store.put(spark, f"{path}/ledger", json.dumps({"token": token, "space": held["space"] | {str(rev): prints}}))


def check_lineage(held: dict, token: str | None, published: bool, seed_rev: int | None = None, seed: dict[str, str] | None = None, adopt: bool = False) -> None:
    """Refuse a corpus whose ids aren't those that the copies out there have.

    ``published``: whether anything is published; ``seed``: fingerprints of the corpus it was built from, at ``seed_rev``."""
    known, recorded = held["token"], held["space"]
    built_on = None if seed is None or seed_rev is None else (str(seed_rev), seed)
    rules = {
        "its id space has a name": bool(token),
        "the name is that of what is published": not known or not token or known == token,
        "what is published has a name, or this one is adopted expressly": bool(known) or not published or adopt,
        "the revision that it was built on is recorded": built_on is None or not recorded or built_on[0] in recorded,
        "that revision is recorded with the same ids": built_on is None or recorded.get(built_on[0], built_on[1]) == built_on[1],
    }
    broken = [rule for rule, holds in rules.items() if not holds]
    if broken:
        raise Refused(f"the ids don't continue those published: not so that {'; '.join(broken)}")


def sync(spark: SparkSession, copy: str, deltas: str, edges: list[tuple[int, int]], head: int) -> list[int]:
    """Bring a copy to the head, one delta after another; each is checked whole before its revision becomes current."""
    rev, done = current(spark, copy), []
    plan = plan_sync(edges, rev, head)
    if plan is None:
        raise Refused(f"no deltas lead from revision {rev} to {head}: the snapshot must be loaded anew")
    for start, end in plan:
        held, delta = load(spark, copy, start), read_delta(spark, deltas, start, end)
        check(delta, held, start)
        save(apply(held, delta), copy, end)
        done.append(end)
    return done


def plan_sync(edges: list[tuple[int, int]], rev: int, head: int) -> list[tuple[int, int]] | None:
    """The fewest deltas from rev to head, longer steps first among equals; [] if there already, None if there is no way."""
    if rev == head:
        return []
    out: dict[int, list[int]] = {}
    for a, b in edges:
        if a < b <= head:
            out.setdefault(a, []).append(b)
    came, queue = {rev: None}, deque([rev])
    while queue:
        at = queue.popleft()
        for b in sorted(out.get(at, []), reverse=True):
            if b not in came:
                came[b] = at
                queue.append(b)
    if head not in came:
        return None
    path = []
    while came[head] is not None:
        path.append((came[head], head))
        head = came[head]
    return path[::-1]


def untiled(edges: list[tuple[int, int]], head: int) -> list[int]:
    """Revisions that some delta names and from which no chain reaches the head."""
    return sorted(r for r in {x for e in edges for x in e} if plan_sync(edges, r, head) is None)


def retained(revisions: list[int], keep: int, protected: int | None = None) -> list[int]:
    """Revisions to keep: the latest ones and the protected one."""
    return sorted({*sorted(revisions)[-keep:], *([protected] if protected in revisions else [])})


def rotation(snapshots: list[int], deltas: list[tuple[int, int]], generations: int = 2, protected: int | None = None) -> tuple[list[int], list[tuple[int, int]], int]:
    """Snapshots and deltas to keep, and the floor: the oldest revision that is still served.

    Deltas that begin below the floor serve no copy any more; one from the floor on stays even if a snapshot overtakes it."""
    kept = retained(snapshots, generations, protected)
    floor = min(kept, default=0)
    return kept, sorted(e for e in deltas if e[0] >= floor), floor


def promotable(corpus: Corpus, rev: int, head: int, notice: str) -> list[str]:
    """Why a staged copy may not become current; nothing if it may."""
    missing = [f.name for f in fields(Corpus) if f.name not in ("kev", *DERIVED) and getattr(corpus, f.name) is None]
    unlike = []
    for name in SCHEMAS:
        df = None if name in missing else getattr(corpus, name)
        if df is not None and df.dtypes != df.sparkSession.createDataFrame([], SCHEMAS[name]).dtypes:
            unlike.append(f"table {name} has other columns")
    return [*(f"table {n} is missing" for n in missing), *unlike, *(["no notice"] * (not notice.strip())), *(["revision beyond the head"] * (rev > head or rev < 1)), *(["no record"] * (not missing and not unlike and corpus.cve.limit(1).count() == 0))]


def hosted(corpus: Corpus, path: str, rev: int) -> Corpus:
    """A copy for a server that only reads: all tables, the overlay and the index of the texts, made once and published as one revision."""
    if corpus.postings is None:
        corpus = corpus.having(postings=search.postings(corpus.cve_text, "cve_id", list(search.FIELDS)))
    save(corpus, path, rev)
    return load(corpus.cve.sparkSession, path, rev)
