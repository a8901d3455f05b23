"""Revisions whose tables lie in buckets of ids, so that a delta rewrites what it touches and nothing else.

A bucket is a range of WIDTH ids: of a record's in the records and their links, of its own in a
lookup.  The overlay, which is bounded (100,000 entries), is one bucket.  A bucket's rows are those of
its ids in the folder of some generation, in files that hold many buckets in the order of their ids,
so the number of files follows the bytes and not the buckets; a revision is a small file in ``log``
that names the folder of every bucket, and the segments of the index of the texts.  ``advance``
writes the touched buckets into a new generation and then the new revision's file, which must not be
there yet: that rename is the commit.  So readers have a whole revision at any time, a run that breaks off leaves folders that no
revision names, and of two writers one is refused.

What a delta costs: the ids of all records and lookups are read (two columns) to check it, the
buckets that hold changed ids are read and written, and the revision's file lists all buckets.
``rotate`` deletes revisions that aren't kept, the folders that only they named, and deltas that
begin below the oldest kept one.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import SCHEMAS, Corpus
from ..operators import segments as S
from ..sources import store
from . import changes as C

WIDTH = 65_536
#: The column whose ranges are a table's buckets.
KEYS = {"cve": "id"} | dict.fromkeys(C.LINKS, "cve_id") | dict.fromkeys(C.LOOKUPS, "id")
#: Ids that are dealt to one task together when a generation is written, and bytes of a row group of its files.
BLOCK, GROUP = 65_536, 8 << 20
#: Runs of buckets up to which they are asked for by their ids' ranges.
MOST_RUNS = 64
#: Deltas that one step of a stream takes.
STEP_FILES = 64


@dataclass(frozen=True)
class Advanced:
    """What a delta did: the revision it led to, the buckets written by table, and how many records it changed, of these how many were new, and how many it took away."""

    rev: int
    buckets: dict[str, list[int]]
    upserts: int
    inserts: int
    deletes: int


def _bucket(name: str, width: int) -> Column:
    key = KEYS.get(name)
    return (F.floor(F.col(key) / width) if key else F.lit(0)).cast("long")


def _revisions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n) for n in store.names(spark, f"{path}/log") if n.isdigit())


def manifest(spark: SparkSession, path: str, rev: int | None = None) -> dict:
    """The file of a revision, the latest one if none is named."""
    held = _revisions(spark, path)
    if not held or (rev is not None and rev not in held):
        raise C.Refused(f"no revision{'' if rev is None else f' {rev}'} at {path}")
    return json.loads(store.get(spark, f"{path}/log/{held[-1] if rev is None else rev:020d}"))


def current(spark: SparkSession, path: str) -> int:
    return manifest(spark, path)["rev"]


def _commit(spark: SparkSession, path: str, told: dict) -> None:
    if not store.put_new(spark, f"{path}/log/{told['rev']:020d}", json.dumps(told)):
        raise C.Refused(f"another run has published revision {told['rev']}")


def _write(df: DataFrame, path: str, name: str, width: int) -> dict[str, str]:
    """Write rows into a new generation, in the order of their ids; its folder for each bucket that has rows.  Large blocks of ids are dealt to several tasks, small ones share one."""
    at, key, spark = f"{name}/{uuid.uuid4().hex}", KEYS.get(name), df.sparkSession
    if key:
        block = F.floor(F.col(key) / max(width, BLOCK))
        df = df.withColumn("__block", block).hint("rebalance", "__block").sortWithinPartitions(key).drop("__block")
    df.write.option("parquet.block.size", GROUP).parquet(f"{path}/{at}")
    found = spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{at}").select(_bucket(name, width)).distinct().collect()
    return {str(b): at for b in sorted(r[0] for r in found)}


def _runs(buckets: list[int]) -> list[tuple[int, int]]:
    """First and last of each run of buckets that follow one another."""
    out: list[tuple[int, int]] = []
    for b in sorted(buckets):
        if out and b == out[-1][1] + 1:
            out[-1] = (out[-1][0], b)
        else:
            out.append((b, b))
    return out


def _read(spark: SparkSession, path: str, name: str, folders: dict[str, str], width: int) -> DataFrame:
    """Rows of some buckets, by the folder of each; of a folder only what these buckets have, by the statistics of its files."""
    held: dict[str, list[int]] = {}
    for b, at in folders.items():
        held.setdefault(at, []).append(int(b))
    out = None
    for at, buckets in held.items():
        rows = spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{at}")
        if key := KEYS.get(name):
            runs = _runs(buckets)
            rows = rows.filter((F.col(key) >= runs[0][0] * width) & (F.col(key) < (runs[-1][1] + 1) * width))
            if len(runs) > MOST_RUNS:
                rows = rows.filter(_bucket(name, width).isin(buckets))
            elif len(runs) > 1:
                rows = rows.filter(reduce(lambda x, y: x | y, [(F.col(key) >= lo * width) & (F.col(key) < (hi + 1) * width) for lo, hi in runs]))
        out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], SCHEMAS[name]) if out is None else out


def create(corpus: Corpus, path: str, rev: int, width: int = WIDTH, indexed: bool = False) -> None:
    """Write a first revision whole; ``indexed``: with an index of its texts."""
    spark = corpus.cve.sparkSession
    if _revisions(spark, path):
        raise C.Refused(f"there are revisions at {path}")
    tables = {}
    for name, df in corpus.tables().items():
        if name in C.LINK_KEYS:
            df = df.dropDuplicates(list(C.LINK_KEYS[name]))
        tables[name] = _write(df, path, name, width)
    index = [S.segment(path, corpus.cve_text, "cve_id")] if indexed else None
    _commit(spark, path, {"rev": rev, "width": width, "tables": tables, "index": index})


def load(spark: SparkSession, path: str, rev: int | None = None) -> Corpus:
    """A revision as a corpus, the latest one if none is named."""
    told = manifest(spark, path, rev)
    postings = S.postings(spark, path, told["index"]) if told["index"] else None
    return Corpus(**{n: _read(spark, path, n, folders, told["width"]) for n, folders in told["tables"].items()}, postings=postings)


def _touched(rows: DataFrame, name: str, width: int) -> list[int]:
    """Buckets of some rows; there are no more of them than a revision's file names."""
    return sorted(r[0] for r in rows.select(_bucket(name, width)).distinct().collect())


def advance(spark: SparkSession, path: str, delta: C.Delta) -> Advanced:
    """Apply a delta to the latest revision, once it has been checked whole: the touched buckets, the overlay's ids and the index follow."""
    told = manifest(spark, path)
    held, width = load(spark, path, told["rev"]), told["width"]
    C.check(delta, held, told["rev"])
    new = store.written(delta.tables["cve"].select("id", "cve_id").join(held.cve.select("id", F.lit(True).alias("held")), "id", "left"), "upserts")
    gone = store.written(held.cve.join(delta.gone, "cve_id", "left_semi").select("id", "cve_id"), "deletes")
    ids = new.select("id").unionByName(gone.select("id")).distinct()
    counts = new.agg(F.count("*").alias("n"), F.count_if(F.col("held").isNull()).alias("inserts")).first()
    tables, written = dict(told["tables"]), {}

    def replace(name: str, key: str, out: DataFrame, rows: DataFrame, where: list[int]) -> None:
        """Buckets ``where`` without the rows of ``out`` and with ``rows``."""
        if not where:
            return
        touched = set(where)
        old = _read(spark, path, name, {str(b): tables[name][str(b)] for b in where if str(b) in tables[name]}, width)
        kept = old.join(out.select(F.col(out.columns[0]).alias(key)), key, "left_anti").select(old.columns)
        made = _write(kept.unionByName(rows.select(old.columns)), path, name, width)
        tables[name] = {b: f for b, f in tables[name].items() if int(b) not in touched} | made
        written[name] = where

    records = _touched(ids, "cve", width)
    for name in ("cve", *C.LINKS):
        replace(name, KEYS[name], ids, delta.tables[name], records)
    for name, rows in delta.lookups.items():
        replace(name, "id", rows.select("id"), rows, _touched(rows, name, width))
    if "kev" in tables:
        now = new.select(F.col("cve_id").alias("cve"), F.col("id").alias("now")).unionByName(gone.select(F.col("cve_id").alias("cve"), F.lit(None).cast("long").alias("now")))
        moved = held.kev.join(now, "cve").select(*[F.col("now").alias("cve_id") if c == "cve_id" else F.col(c) for c in held.kev.columns])
        # Entries whose record changes its id; the overlay's key is the identifier.
        changed = moved.join(held.kev.select("cve", F.col("cve_id").alias("was")), "cve").filter(~F.col("cve_id").eqNullSafe(F.col("was"))).select(held.kev.columns)
        if changed.limit(1).count():
            replace("kev", "cve", changed.select("cve"), changed, [0])
    index = told["index"]
    if index is not None:
        index = S.merged(spark, path, [*index, S.segment(path, delta.tables["cve_text"], "cve_id", ids.select(F.col("id").alias("doc")))])
    _commit(spark, path, told | {"rev": delta.end, "tables": tables, "index": index})
    return Advanced(delta.end, written, counts["n"], counts["inserts"], gone.count())


def rotate(spark: SparkSession, path: str, deltas: str, generations: int = 2, protected: int | None = None) -> tuple[list[int], list[tuple[int, int]]]:
    """Keep the latest revisions and the protected one; delete the others' files, the folders that no kept revision names, and deltas that begin below the oldest kept revision.  What is left: revisions, deltas."""
    edges = published(spark, deltas)
    kept, serve, _ = C.rotation(_revisions(spark, path), edges, generations, protected)
    for rev in _revisions(spark, path):
        if rev not in kept:
            store.delete(spark, f"{path}/log/{rev:020d}")
    named = set()
    for rev in kept:
        told = manifest(spark, path, rev)
        named |= {f for folders in told["tables"].values() for f in folders.values()} | {s["at"] for s in told["index"] or []}
    for table in [*SCHEMAS, S.FOLDER]:
        for n in store.names(spark, f"{path}/{table}"):
            if f"{table}/{n}" not in named:
                store.delete(spark, f"{path}/{table}/{n}")
    for a, b in edges:
        if (a, b) not in serve:
            store.delete(spark, f"{deltas}/from={a}/to={b}")
    return kept, serve


def published(spark: SparkSession, deltas: str) -> list[tuple[int, int]]:
    """from, to of the deltas that have an envelope."""
    found = [(a, b) for a in store.names(spark, deltas) if a.startswith("from=") for b in store.names(spark, f"{deltas}/{a}")]
    return sorted((int(a[5:]), int(b[3:])) for a, b in found if store.exists(spark, f"{deltas}/{a}/{b}/envelope"))


# --- deltas as they arrive ------------------------------------------------------------------------------


def reached(edges: list[tuple[int, int]], rev: int) -> int:
    """The latest revision that deltas lead to from this one."""
    at = {rev}
    for a, b in sorted(edges):  # a delta leads upwards, so one pass is enough
        if a in at:
            at.add(b)
    return max(at)


def follow(spark: SparkSession, path: str, deltas: str, checkpoint: str, files: int = STEP_FILES) -> StreamingQuery:
    """Apply deltas as a stream of their envelopes, each once, whatever the order that they arrive in.

    A delta that leads on from the latest revision is applied and committed; one that begins later
    waits for what comes before it, in a small file beside the log, and one that begins earlier has
    been overtaken.  The log tells what is done, so a step that is run again, after a crash between
    its commits and the checkpoint's, does nothing twice.  A delta that is refused stops the stream
    at the revision before it."""
    source = spark.readStream.schema("value string").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "envelope").option("maxFilesPerTrigger", files).text(deltas)
    edges = source.select(F.get_json_object("value", "$.from").cast("long").alias("start"), F.get_json_object("value", "$.to").cast("long").alias("end"))

    def step(batch: DataFrame, _: int) -> None:
        waiting = {tuple(e) for e in json.loads(store.get(spark, f"{path}/waiting") or "[]")} | {(r["start"], r["end"]) for r in batch.collect()}  # at most ``files`` rows
        rev = current(spark, path)
        for start, end in C.plan_sync(sorted(waiting), rev, reached(sorted(waiting), rev)) or []:
            rev = advance(spark, path, C.read_delta(spark, deltas, start, end)).rev
        store.put(spark, f"{path}/waiting", json.dumps(sorted(e for e in waiting if e[0] >= rev)))

    return edges.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start()
