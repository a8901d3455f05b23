"""Removal of repeated byte strings by bucket-pointer refinement.

Every byte is covered that lies in a string of ``LENGTH`` bytes that also starts in a document with
a smaller doc_id; covered bytes go.  Strings are judged on the input.

The suffixes to be sorted are sparse.  Each string of ``LENGTH`` bytes has an anchor, the q-gram of
least hash in it, so equal strings have the same anchor at the same place.  Spark brings the
anchors of one q-gram together: these are the initial buckets, in shards.  Buckets that only one
document has are left alone.  For the others a block sends the bytes around each anchor, equal ones
once, with the least document that has them.

In a shard every place around an anchor has a bucket pointer: where, in the order of all the
shard's suffixes by their first ``STEP`` bytes, the suffixes begin that agree with it there.  A
bucket of more than one suffix is refined by sorting it on the pointers at a later offset; what
comes out are smaller buckets whose pointers, updated at once, serve the next refinement at the
next offset, so the depth doubles from one to the next.  Suffixes that are alone in their bucket,
and places that no string of an anchor needs, are sorted no further.  At full depth a bucket is the
suffixes that agree on all ``LENGTH`` bytes.  Bytes are compared throughout, never hashes.

The strings of an anchor that more than ``HOT`` blocks have are dealt one by one, by a hash of all
their bytes, so that no shard gathers the surroundings of a frequent q-gram.

Defined cases: a null text is empty; null doc_ids come after all others, so that such a document
loses what any other has and takes nothing from another null; rows of the same doc_id don't cover
each other; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, common

LENGTH, Q, STEP = 50, 16, 8
HOT = 1_000
CHUNK, PIECE = 250_000, 1 << 22
ROWS = 8_192
KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _eight(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place, as a number."""
    return np.ndarray((max(0, len(raw) - 7),), "<u8", raw, strides=(1,))


def anchors(raw: np.ndarray, starts: np.ndarray, length: int = LENGTH, q: int = Q) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, bucket and span of each anchor; raw has documents that begin at ``starts`` one after another (the last of ``starts`` is the end).

    Strings with the same anchor follow one another: ``span`` has where the first and the last of
    them start.  Strings that cross documents belong to no anchor."""
    n = len(raw) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros((0, 2), np.int64)
    if n > PIECE:  # one very long text: pieces of strings, whose places fit below the hash
        found = [anchors(raw[a : a + PIECE + length - 1], np.unique(np.clip(starts - a, 0, PIECE + length - 1)), length, q) for a in range(0, n, PIECE)]
        shift = range(0, n, PIECE)
        return np.concatenate([x[0] + a for x, a in zip(found, shift, strict=True)]), np.concatenate([x[1] for x in found]), np.concatenate([x[2] + a for x, a in zip(found, shift, strict=True)])
    eight = _eight(raw)
    gram = common.combine(eight[: len(raw) - q + 1], eight[q - 8 : len(raw) - 7], 3)
    least = gram & ~np.uint64(0xFFFFFF) | np.arange(len(gram), dtype=np.uint64)  # the place breaks ties to the left
    width, have = length - q + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    at = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    crosses = np.zeros(n, bool)
    for e in starts[1:-1]:
        crosses[max(0, e - length + 1) : e] = True
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (crosses[1:] != crosses[:-1])])
    span = np.c_[new, np.r_[new[1:], n] - 1][~crosses[new]]
    at = at[span[:, 0]]
    return at, gram[at], span


def _entry(length: int, q: int) -> np.dtype:
    """Which strings of an anchor are meant (from least to most bytes before it), and the bytes around it."""
    return np.dtype([("least", "u1"), ("most", "u1"), ("around", "u1", 2 * length - q)])


class Block:
    def __init__(self, docs: pa.Table, length: int, q: int):
        self.ids, self.texts, _ = blocks.in_order(docs)
        self.number, self.length, self.q = docs.column("block")[0].as_py(), length, q
        self.starts = np.r_[0, np.cumsum([len(t) for t in self.texts])].astype(np.int64)
        self.parts, owner = [], np.array(self.ids, np.int64)
        for a, b in blocks.chunks(self.texts, CHUNK):
            raw = np.frombuffer(b"".join(self.texts[a:b]), np.uint8)
            base = int(self.starts[a])
            starts = self.starts[a : b + 1] - base
            at, key, span = anchors(raw, starts, length, q)
            self.parts.append((raw, base, at, key, span, owner[a + np.searchsorted(starts, at, "right") - 1]))
        self.key, self.doc = (np.concatenate([x[k] for x in self.parts]) if self.parts else np.zeros(0, kind) for k, kind in ((3, np.uint64), (5, np.int64)))
        # The distinct keys: which each anchor has, and whether two documents have it.
        self.of, one, self.several = common.classes(self.key[:, None], self.doc)
        self.keys = self.key[one]

    def around(self, told: np.ndarray):
        """Of the anchors that other documents have: where they stand in the block, their keys, documents and entries; of those told 2 for each string."""
        kind, reach, out, k = _entry(self.length, self.q), self.length - self.q, [], 0
        for raw, base, at, key, span, doc in self.parts:
            mine, k = told[k : k + len(at)], k + len(at)
            if not mine.any():
                continue
            padded = np.r_[np.zeros(reach, np.uint8), raw, np.zeros(reach, np.uint8)]
            view = np.lib.stride_tricks.sliding_window_view(padded, 2 * self.length - self.q)
            for hot in (False, True):
                which = np.flatnonzero(mine == 1 + hot)
                least, most = at[which] - span[which, 1], at[which] - span[which, 0]
                if hot:
                    many = most - least + 1
                    which = np.repeat(which, many)
                    least = most = np.repeat(least, many) + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
                rows = np.zeros(len(which), kind)
                rows["least"], rows["most"], rows["around"] = least, most, view[at[which]]
                # Bytes of none of the anchor's strings are blanked: they don't matter.
                column = np.arange(2 * self.length - self.q, dtype=np.uint8)
                rows["around"] *= (column >= reach - rows["most"][:, None]) & (column < reach + self.length - rows["least"][:, None])
                keys = key[which]
                if hot:
                    keys = np.zeros(len(rows), np.uint64)
                    for lane in common.lanes_of(rows.view(np.uint8).reshape(len(rows), kind.itemsize)).T:
                        keys = common.combine(keys, lane, 11)
                out.append((base + at[which], keys, doc[which], rows))
        return [np.concatenate([x[k] for x in out]) for k in range(4)] if out else [np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, kind)]


def _ask(length: int, q: int, shards: int):
    def run(docs: pa.Table) -> pa.Table:
        b = Block(docs, length, q)
        return blocks.deal(b.number, b.keys, shards, blocks.NAMED, common.small(b.keys, 6), b.several)

    return run


_SHOWN = ("entry", "doc")


def _entries(b: Block, found: dict, shards: int):
    """Of the shared anchors: where they stand, their documents and rows, which entry each is of, and of each entry the row that stands for it and its key, in the order of their places."""
    at, key, doc, rows = b.around(blocks.read(found["asked"], b.keys, shards, np.uint8)[b.of])
    of, one, _ = common.classes(common.lanes_of(rows.view(np.uint8).reshape(len(rows), rows.dtype.itemsize)), doc)
    order = np.argsort(one)
    place = np.empty(len(one), np.int64)
    place[order] = np.arange(len(one))
    return at, doc, rows, place[of], one[order], key[one[order]]


def _show(length: int, q: int, shards: int):
    """What is around the shared anchors, equal surroundings once, with the least document that has them."""

    def run(docs: pa.Table, found: dict) -> pa.Table:
        b = Block(docs, length, q)
        _, doc, rows, _, one, route = _entries(b, found, shards)
        return blocks.deal(b.number, route, shards, _SHOWN, rows[one], doc[one])

    return run


def refine(around: np.ndarray, wanted: np.ndarray, length: int) -> np.ndarray:
    """Bucket pointers at full depth of the suffixes that are ``wanted`` (a mask over rows and columns of ``around``); equal pointers, equal strings of ``length`` bytes."""
    n, width = around.shape
    steps, depth = [], STEP
    while depth < length:
        steps.append(min(depth, length - depth))
        depth += steps[-1]
    # The places whose pointers a refinement reads: those it refines, and the later offsets.
    needed = [wanted]
    for step in reversed(steps):
        last = needed[-1].copy()
        last[:, step:] |= needed[-1][:, :-step]
        needed.append(last)
    needed.reverse()
    flat = np.r_[np.ascontiguousarray(around).reshape(-1), np.zeros(STEP, np.uint8)]
    place = np.flatnonzero(needed[0])
    gram = np.ndarray((n * width,), "<u8", flat, strides=(1,))[place].byteswap()  # the order of the bytes
    pointer = np.zeros(n * width, np.uint64)
    place, head = _ordered(place, gram)
    pointer[place] = head
    for step, need in zip(steps, needed[1:], strict=True):
        if not len(place):
            break
        # Buckets of one suffix are done.
        alone = np.r_[head[1:] != head[:-1], True] & np.r_[True, head[1:] != head[:-1]]
        place = place[~alone]
        place = place[need.reshape(-1)[place]]
        now = pointer[place]
        place, order_head = _ordered(place, now << np.uint64(32) | pointer[place + step])
        now = pointer[place]
        bucket = np.flatnonzero(np.r_[True, now[1:] != now[:-1]]) if len(place) else place
        start = np.repeat(bucket, np.diff(np.r_[bucket, len(place)])).astype(np.uint64)
        head = now + order_head - start  # where in its old bucket the new one begins
        pointer[place] = head
    return pointer.reshape(n, width)


def _ordered(place: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of ``by``, and for each where in that order the equal ones begin."""
    order = np.argsort(by, kind="stable")
    by = by[order]
    first = np.flatnonzero(np.r_[True, by[1:] != by[:-1]]) if len(by) else order
    return place[order], np.repeat(first, np.diff(np.r_[first, len(by)])).astype(np.uint64)


def _covered(length: int, q: int):
    """Answers a bit for each string shown: whether a document before the block's first with it has it."""
    kind, reach = _entry(length, q), length - q

    def run(rows: pa.Table) -> pa.Table:
        s = blocks.Shard(rows, entry=kind, doc=np.dtype("<i8"))
        strings = np.zeros(len(s.entry), np.uint64)  # a bit for each string before the anchor
        gram = np.ascontiguousarray(s.entry["around"][:, reach : reach + q])
        # Entries of one anchor lie together; an entry of a single string is told by the string.
        bucket, _, _ = common.classes(common.lanes_of(gram), s.doc)
        order = np.argsort(bucket, kind="stable")
        heads = np.flatnonzero(np.r_[True, bucket[order[1:]] != bucket[order[:-1]]])
        at = 0
        while at < len(order):  # whole buckets, about ROWS entries at a time
            k = int(np.searchsorted(heads, at + ROWS))
            end = int(heads[k]) if k < len(heads) else len(order)
            which, at = order[at:end], end
            strings[which] = _late(s.entry[which], s.doc[which], length, reach)
        return s.answers(lambda a, b: blocks.pack(strings[a:b]) if strings[a:b].any() else b"")

    return run


def _late(entry: np.ndarray, doc: np.ndarray, length: int, reach: int) -> np.ndarray:
    before = np.arange(reach, -1, -1)  # of the columns where strings start
    wanted = np.zeros(entry["around"].shape, bool)
    wanted[:, : reach + 1] = (before >= entry["least"][:, None]) & (before <= entry["most"][:, None])
    row, column = np.nonzero(wanted)
    pointer = refine(entry["around"], wanted, length)[row, column]
    order = np.lexsort((doc[row], pointer))
    first = np.flatnonzero(np.r_[True, pointer[order[1:]] != pointer[order[:-1]]])
    least = np.empty(len(row), np.int64)
    least[order] = np.repeat(doc[row[order[first]]], np.diff(np.r_[first, len(row)]))
    late = np.flatnonzero(least < doc[row])
    bits = np.zeros(len(entry), np.uint64)
    np.bitwise_or.at(bits, row[late], np.uint64(1) << before[column[late]].astype(np.uint64))
    return bits


def _remove(length: int, q: int, shards: int):
    def run(docs: pa.Table, found: dict) -> pa.Table:
        b = Block(docs, length, q)
        at, doc, rows, entry, one, route = _entries(b, found, shards)
        late = blocks.read(found["covered"], route, shards, np.dtype("<u8"))[entry]
        bit = np.uint64(1)
        every = ((bit << (rows["most"].astype(np.uint64) + bit)) - bit) & ~((bit << rows["least"].astype(np.uint64)) - bit)
        # The block's first document with these bytes loses what came before it, the others lose all.
        strings = np.where(doc == doc[one][entry], late, every)
        ids, texts, starts = b.ids, b.texts, b.starts
        depth = np.zeros(starts[-1] + 1, np.int32)
        for o in range(length - q + 1):
            start = at[(strings >> np.uint64(o) & np.uint64(1)).astype(bool)] - o
            # A string starts at most once, so plain indexing counts right.
            depth[start] += 1
            depth[start + length] -= 1
        gone = np.cumsum(depth[:-1]) > 0
        kept, removed, spans = [], [], []
        for i, t in enumerate(texts):
            g = gone[starts[i] : starts[i + 1]]
            n = int(g.sum())
            removed.append(n)
            spans.append(int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if n else 0)
            kept.append(np.frombuffer(t, np.uint8)[~g].tobytes() if n else t)
        return pa.table({"doc_id": blocks.shown_ids(ids), "n_bytes": pa.array(np.diff(starts), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept": pa.array(kept, pa.binary())})

    return run


def remove(docs: DataFrame, length: int = LENGTH, q: int = Q, block_bytes: int = common.BLOCK_BYTES, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (runs of removed bytes), kept (the remaining bytes, which need not be whole characters)."""
    if not 8 <= q <= 16 or not q < length <= q + 62:
        raise ValueError("q must be 8 to 16, and length q + 1 to q + 62")
    common.prepare(docs.sparkSession)
    count = common.blocks_for(docs, each=block_bytes)
    shards = count
    texts = common.blocked(docs, count)
    asked = common.grouped(common.grouped(texts, "block", _ask(length, q, shards), blocks.dealt(*blocks.NAMED)), "shard", blocks.shared(hot), blocks.ANSWER)
    shown = blocks.together(texts, count, {"asked": asked}, _show(length, q, shards), blocks.dealt(*_SHOWN))
    covered = common.grouped(shown, "shard", _covered(length, q), blocks.ANSWER)
    return blocks.together(texts, count, {"asked": asked, "covered": covered}, _remove(length, q, shards), KEPT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(common.table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op8_substrings": query}
ORACLES = {
    "op8_substrings": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) h, strlen(coalesce(text, ''))::BIGINT n FROM documents),
s AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) g FROM d, LATERAL (SELECT unnest(range(n - 49)) i)),
f AS (SELECT g, min(doc_id) least FROM s GROUP BY 1),
c AS (SELECT doc_id, i FROM s JOIN f USING (g) WHERE least < doc_id),
-- Strings that start at most 50 apart cover one run of bytes.
r AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) run FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END new FROM c)),
spans AS (SELECT doc_id, run, min(i) a, max(i) + 50 b FROM r GROUP BY 1, 2),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) last FROM spans),
k AS (SELECT gaps.doc_id, sum(b - a)::BIGINT gone, count(*) spans, string_agg(substr(h, 2 * last + 1, 2 * (a - last)), '' ORDER BY a) front, max(b) stop FROM gaps JOIN d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, n n_bytes, coalesce(gone, 0) n_removed, coalesce(spans, 0) n_spans, sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(stop, 0) + 1))) kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""
}
