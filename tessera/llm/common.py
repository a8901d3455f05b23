"""Pieces that the operators of this subpackage share.

Words everywhere are runs of bytes other than ASCII white space (``[^\\x20\\x09-\\x0D]+``), which is
exactly what ``bytes.split()`` yields.  Heavy operators move numpy arrays packed into binary
columns (one row per block and shard) instead of one row per word, so that the JVM handles
thousands of blobs rather than billions of small rows.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import delete, shared_dir

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Bytes of text that one block of documents holds on average, and the rows that Arrow sends at once.
BLOCK_BYTES = 8_000_000
BATCH_ROWS = 2_000


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, and bound the rows of an Arrow batch."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), ROOT) if x)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def home(spark: SparkSession) -> str:
    """This subpackage's part of the application's shared folder."""
    return f"{shared_dir(spark)}/llm"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{home(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_at = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete the table that ``cut`` wrote, once nothing will read it any more."""
    delete(df.sparkSession, df.cut_at)


def release(spark: SparkSession) -> None:
    """Delete all that this subpackage has cut in this application; results that read it can't be computed any more."""
    delete(spark, home(spark))


def blocks_for(docs: DataFrame, column: str = "text", each: int = BLOCK_BYTES) -> int:
    """How many blocks (or shards) of about ``each`` bytes the whole column needs."""
    total = docs.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0
    return max(1, math.ceil(total / each))


def blocked(docs: DataFrame, blocks: int, rest: list[str] | None = None) -> DataFrame:
    """doc_id, text (UTF-8, null: empty, compressed for the shuffle; ``unpacked`` reads it), h (a hash of both) and the block that a document belongs to; ``rest``: columns to carry along in a struct of that name.

    Blocks are ranges of h, so rows of one id, or of none, spread over all blocks, and the order of blocks is that of h."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
        *([F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest")] if rest else []),
    ).withColumn("h", F.xxhash64("doc_id", "text"))
    rows = rows.withColumn("block", F.shiftright((F.shiftright("h", 32) + F.lit(1 << 31)) * F.lit(blocks), 32).cast("int"))
    return rows.mapInArrow(_packed, ddl(rows))


def _packed(batches):
    import zstandard

    compress = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, "text", pa.array(map(compress, batch.column(at).to_pylist()), pa.binary()))


def unpacked(column) -> list[bytes]:
    import zstandard

    return list(map(zstandard.ZstdDecompressor().decompress, column.to_pylist()))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def combine(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """The name of an ordered pair."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + mix(b + np.uint64(salt)))


_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_LONG = 256


def word_hashes(texts: list[bytes], lower: bool = False, each: int = 300_000) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one text after another, and how many each has.

    Words are hashed eight bytes at a time, all words of about ``each`` bytes of text at once;
    ``lower`` lower-cases A-Z."""
    found, counts, at = [], np.zeros(len(texts), np.int64), 0
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, each + (ends[at - 1] if at else 0))))
        raw = b"\n".join([b"", *texts[at:end], b" " * 8])
        raw = np.frombuffer(raw.lower() if lower else raw, np.uint8)
        space = (raw == 32) | (raw - np.uint8(9) < 5)
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        start, n = edges[::2], edges[1::2] - edges[::2]
        eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
        h = mix((eight[start] & _BYTES[np.minimum(n, 8)]) + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        left, done = np.flatnonzero((n > 8) & (n <= _LONG)), 8
        while len(left):
            h[left] = mix(h[left] * np.uint64(0xC2B2AE3D27D4EB4F) + (eight[start[left] + done] & _BYTES[np.minimum(n[left] - done, 8)]))
            done += 8
            left = left[n[left] > done]
        for i in np.flatnonzero(n > _LONG).tolist():
            h[i] = xxhash.xxh64_intdigest(raw[start[i] : start[i] + n[i]].tobytes())
        found.append(h)
        counts[at:end] = np.diff(np.searchsorted(start, np.r_[1, 1 + np.cumsum(lengths[at:end] + 1)]))
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64), counts


def binaries(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def column_bytes(column) -> list[bytes]:
    """Values of an Arrow string or binary column as bytes (null: empty)."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def split_by(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order that groups ``keys`` (uint64) by shard, and the bounds of the groups."""
    tagged = np.sort(keys % np.uint64(shards) << np.uint64(32) | np.arange(len(keys), dtype=np.uint64))
    bounds = np.searchsorted(tagged, np.arange(shards + 1, dtype=np.uint64) << np.uint64(32))
    return (tagged & np.uint64(0xFFFFFFFF)).astype(np.int64), bounds


def classes(lanes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of equal rows of ``lanes`` (uint64, one row each): the class of each row, of each class the row with the least ``doc``, and whether another doc has it too.

    Rows are ordered by a hash and then compared; if rows of one hash differ, they are ordered by all they hold."""
    n = len(lanes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    h = np.zeros(n, np.uint64)
    for k in range(lanes.shape[1]):
        h = combine(h, lanes[:, k], k)
    order = np.lexsort((doc, h))
    same = h[order[1:]] == h[order[:-1]]
    equal = (lanes[order[1:]] == lanes[order[:-1]]).all(axis=1)
    if (same & ~equal).any():
        order = np.lexsort((doc, *lanes.T))
        equal = (lanes[order[1:]] == lanes[order[:-1]]).all(axis=1)
    first = np.flatnonzero(np.r_[True, ~equal])
    of = np.empty(n, np.int64)
    of[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, n]))
    last = np.r_[first[1:], n] - 1
    return of, order[first], doc[order[first]] != doc[order[last]]


def lanes_of(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of uint64, padded with zeros."""
    out = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    out[:, : rows.shape[1]] = rows
    return out.view("<u8")


def small(x: np.ndarray, size: int) -> np.ndarray:
    """The low bytes of uint64 numbers, a row each."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]


def large(x: np.ndarray) -> np.ndarray:
    """The numbers of ``small``."""
    return lanes_of(x).reshape(-1)


def shard_of(route: np.ndarray, shards: int) -> np.ndarray:
    """The shard that ``split_by`` of the mixed ``route`` puts each entry in."""
    return (mix(route) % np.uint64(shards)).astype("<u4")


def runs(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run-length coding: the value of each run of equal values, and its length."""
    if not len(doc):
        return doc, np.zeros(0, np.int64)
    at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    return doc[at], np.diff(np.r_[at, len(doc)])


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def grouped(df: DataFrame, key: str, fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    def run(rows: pa.Table) -> pa.Table:  # of one argument, whatever ``fn`` may take besides
        return fn(rows)

    return df.groupBy(key).applyInArrow(run, schema)
