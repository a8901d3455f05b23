"""Blocks of documents that ask shards of a key space, without a shuffle row for each key.

Documents lie in blocks by a hash of doc_id and text; a block deals what it asks, each thing once,
to shards in arrays, one row a block and shard; a shard sees what all blocks dealt to it and
answers each block in the order in which it asked.  As a block names a thing once, however many of
its documents have it, what a third of all documents have is one entry a block in its shard.  The
shuffle of the texts by block, and that of each kind of answers, is the same subplan each time,
which Spark runs once and reuses.

Defined cases: a null text is empty; rows with the same id, or with none, lie in different blocks
unless their texts are equal too, and are ordered by the hash; a block without answers, and a table
without rows, give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ANSWER = "block int, shard int, answer binary"
_ANSWER = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("answer", pa.binary())])
#: Stands for a null doc_id: after all others.
NULL_ID = np.iinfo(np.int64).max


def in_order(docs: pa.Table) -> tuple[list[int], list[bytes], list[int]]:
    """doc_ids and texts of a block, always in the same order, and which rows they are."""
    ids = [NULL_ID if d is None else d for d in docs.column("doc_id").to_pylist()]
    texts, h = common.unpacked(docs.column("text")), docs.column("h").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i], h[i], texts[i]))
    return [ids[i] for i in order], [texts[i] for i in order], order


def shown_ids(ids: list[int]) -> pa.Array:
    return pa.array([None if d == NULL_ID else d for d in ids], pa.int64())


def chunks(texts: list[bytes], size: int):
    """Bounds of runs of texts of about ``size`` bytes."""
    at = 0
    while at < len(texts):
        end, n = at, 0
        while end < len(texts) and (end == at or n + len(texts[end]) < size):
            n += len(texts[end])
            end += 1
        yield at, end
        at = end


def empty(schema: str) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema)).empty_table()


def dealt(*names: str) -> str:
    """The schema of ``deal`` with these columns."""
    return "shard int, block int, n int" + "".join(f", {n} binary" for n in names)


def deal(block: int, route: np.ndarray, shards: int, names: tuple[str, ...], *columns: np.ndarray) -> pa.Table:
    """What is asked, in rows of ``dealt(*names)``: the columns (arrays with a row for each entry, or lists of bytes) cut up by the shard that ``route`` (uint64) tells."""
    kinds = [pa.int32()] * 3 + [pa.binary()] * len(names)
    schema = pa.schema(list(zip(["shard", "block", "n", *names], kinds, strict=True)))
    order, bounds = common.split_by(common.mix(route), shards)
    columns = [c if isinstance(c, list) else np.ascontiguousarray(c[order]) for c in columns]
    rows = []
    for s in np.flatnonzero(np.diff(bounds)).tolist():
        a, b = int(bounds[s]), int(bounds[s + 1])
        rows.append((s, block, b - a, *[pack(c[a:b]) if isinstance(c, np.ndarray) else b"\n".join([c[i] for i in order[a:b].tolist()]) for c in columns]))
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else schema.empty_table()


def pack(x: np.ndarray) -> bytes:
    """An array for the shuffle: bits eight to a byte; numbers byte by byte, all first bytes together, then all second ones, which compresses better."""
    if x.dtype == bool:
        return np.packbits(x).tobytes()
    size = x[:1].nbytes
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes() if 1 < size <= 8 else x.tobytes()


def unpack(raw: bytes, n: int, kind) -> np.ndarray:
    """The n items that ``pack`` made ``raw`` of."""
    if kind is bool:
        return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)
    kind = np.dtype(kind)
    if not 1 < kind.itemsize <= 8:
        return np.frombuffer(raw, kind)
    rows = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T)
    return rows if kind.subdtype and kind.base == np.uint8 else rows.view(kind.base).reshape(n, *kind.shape) if kind.subdtype else rows.view(kind).reshape(n)


class Shard:
    """What the blocks dealt to one shard: a property for each column of a kind (dtype; bytes: a list)."""

    def __init__(self, rows: pa.Table, **kinds):
        sizes = rows.column("n").to_numpy().astype(np.int64)
        self.block, self.shard, self.bounds = rows.column("block").to_pylist(), rows.column("shard").to_pylist(), np.r_[0, np.cumsum(sizes)]
        self.of = np.repeat(np.arange(len(sizes)), sizes)  # the row that each entry came with
        for name, kind in kinds.items():
            raw = rows.column(name).to_pylist()
            if kind is bytes:
                value = [x for r in raw for x in r.split(b"\n")]
            else:
                parts = [unpack(r, n, kind) for r, n in zip(raw, sizes.tolist(), strict=True)]
                value = np.concatenate(parts) if parts else unpack(b"", 0, kind)
            setattr(self, name, value)

    def answers(self, of: Callable[[int, int], bytes]) -> pa.Table:
        """``of(a, b)``: the answer to the entries from a to b; an empty one isn't sent."""
        return answer_table((b, s, of(lo, hi)) for b, s, lo, hi in zip(self.block, self.shard, self.bounds[:-1].tolist(), self.bounds[1:].tolist(), strict=True))


def answer_table(rows) -> pa.Table:
    rows = [r for r in rows if r[2]]
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ANSWER, strict=True)], schema=_ANSWER) if rows else _ANSWER.empty_table()


def read(answers: list[dict], route: np.ndarray, shards: int, kind) -> np.ndarray:
    """The answers (made by ``pack``) to what was dealt by ``route``, in its order; zero where a shard sent none."""
    order, bounds = common.split_by(common.mix(route), shards)
    out = np.zeros((len(route), *np.dtype(kind).shape), np.dtype(kind).base)
    for a in answers:
        lo, hi = int(bounds[a["shard"]]), int(bounds[a["shard"] + 1])
        out[order[lo:hi]] = unpack(a["answer"], hi - lo, kind)
    return out


def together(docs: DataFrame, count: int, answers: dict[str, DataFrame], fn: Callable[[pa.Table, dict], pa.Table], schema: str) -> DataFrame:
    """``fn`` with the rows of each block and, for each kind of answers, the list of those to the block; ``count``: of blocks.  The answers to a block are small against its texts."""
    names, nothing = list(answers), empty(schema)
    rows = docs.sparkSession.range(count).select(F.col("id").cast("int").alias("block"))
    for name in names:  # left joins keep the partitioning by block
        rows = rows.join(answers[name].groupBy("block").agg(F.collect_list(F.struct("shard", "answer")).alias(name)), "block", "left")

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        if not texts.num_rows:  # a block that no document fell into
            return nothing
        lists = {n: (found.column(n)[0].as_py() if found.num_rows else None) or [] for n in names}
        return fn(texts, lists)

    return docs.groupBy("block").cogroup(rows.groupBy("block")).applyInArrow(run, schema)


NAMED = ("keys", "many")


def shared(hot: int):
    """A shard function that answers a byte for each key (6 bytes, and a bit that tells whether two documents of the block have it): 0 if one document has it, 1 if more have, 2 if more than ``hot`` blocks have it."""

    def run(rows: pa.Table) -> pa.Table:
        s = Shard(rows, keys=np.dtype(("u1", 6)), many=bool)
        _, at, blocks = np.unique(common.large(s.keys), return_inverse=True, return_counts=True)
        several = np.bincount(at, s.many, len(blocks)) > 0
        told = np.where(blocks > hot, 2, np.where(several | (blocks > 1), 1, 0)).astype(np.uint8)[at] if len(at) else np.zeros(0, np.uint8)
        return s.answers(lambda a, b: told[a:b].tobytes() if told[a:b].any() else b"")

    return run
