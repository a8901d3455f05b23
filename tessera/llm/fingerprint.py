"""Document fingerprints from closed syncmers.

A closed syncmer is a run of ``K`` bytes whose least inner run of ``S`` bytes (by hash) stands at
its first or last place.  Whether a run is chosen depends on its own bytes alone, so an anchor
survives any edit that doesn't touch it.  A fingerprint keeps the chosen runs whose hashes lie below
a share 1 / ``PART`` of all hashes, or the ``SIZE`` with the least ones where that are more, and
where each first stands; so it grows with the text, and both rules say of the union of two texts
what they would keep of it.  Two fingerprints are as alike as the share of these hashes of their
union that both have at consistent places (the offsets differ by the same amount, give or take
``TOLERANCE`` bytes).

``edited`` walks documents in descending doc_id, each with the next one, in one range-wise shuffle:
bounds are approximate quantiles of doc_id, and the first document of each range is also sent to
the range before it, so that no order over all rows is needed.

Defined cases: a null text is empty and has an empty fingerprint, alike only to an empty one; a
text without a syncmer has one anchor, its own hash; null doc_ids come last, equal doc_ids in the
order of their texts; the next document of an only row is itself; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

K, S, SIZE, TOLERANCE = 16, 5, 48, 16
PART = 16
BELOW = (1 << 32) // PART
#: Ranges of doc_id: about RANGE_BYTES of text each, at most MAX_RANGES of them (rows stream through a range, so a larger one needs no more memory).
RANGE_BYTES, MAX_RANGES, FAN = 2_000_000, 16_384, 128
CHUNK = 300_000

Print = tuple[list[int], list[int]]  # hashes in rising order, the place of each


def _anchors(texts: list[bytes]) -> list[Print]:
    lengths = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer(b"".join(texts) + bytes(K), np.uint8)
    n = len(raw) - K
    starts = np.r_[0, np.cumsum(lengths)]
    out: list[Print] = [([], [])] * len(texts)
    if n >= K:
        eight = np.ndarray((n + K - 7,), "<u8", raw, strides=(1,))
        h = ((eight & np.uint64(2 ** (8 * S) - 1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)
        w, m, least = K - S + 1, n - K + 1, h
        have = 1
        while have < w:  # least of `have` neighbours, doubled until it spans w
            step = min(have, w - have)
            least = np.minimum(least[: len(least) - step], least[step:])
            have += step
        chosen = (h[:m] == least[:m]) | (h[w - 1 : w - 1 + m] == least[:m])
        for e in starts[1:-1]:
            chosen[max(0, e - K + 1) : e] = False
        at = np.flatnonzero(chosen)
        doc = np.searchsorted(starts, at, "right") - 1
        name = common.combine(eight[at], eight[at + 8], 9) >> np.uint64(32)
        key = doc.astype(np.uint64) << np.uint64(32) | name
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        key, place = key[new], at[order[new]]
        doc = (key >> np.uint64(32)).astype(np.int64)
        bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
        name, place = (key & np.uint64(0xFFFFFFFF)).tolist(), place.tolist()
        for i, (a, b, s) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), starts.tolist(), strict=False)):
            b = min(b, max(a + SIZE, bisect_left(name, BELOW, a, b)))
            out[i] = (name[a:b], [p - s for p in place[a:b]])
    return [p if p[0] or not t else ([xxhash.xxh32_intdigest(t)], [0]) for p, t in zip(out, texts, strict=True)]


def prints(texts: list[bytes]) -> list[Print]:
    out, at = [], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < CHUNK):
            size += len(texts[end])
            end += 1
        out += _anchors(texts[at:end])
        at = end
    return out


def encode(p: Print) -> str:
    return base64.b64encode(np.array([*p[0], *p[1]], "<u4").tobytes()).decode()


def decode(s: str) -> Print:
    x = np.frombuffer(base64.b64decode(s), "<u4").tolist()
    return x[: len(x) // 2], x[len(x) // 2 :]


def likeness(a: Print, b: Print) -> float:
    if a[0] == b[0]:
        return 1.0 if a[1] == b[1] or not a[0] else likeness_at(a, b)
    return likeness_at(a, b) if a[0] and b[0] else 0.0


def likeness_at(a: Print, b: Print) -> float:
    union = sorted({*a[0], *b[0]})
    union = union[: max(SIZE, bisect_left(union, BELOW))]
    places, last = dict(zip(*a, strict=True)), union[-1]
    shift = sorted(places[h] - p for h, p in zip(*b, strict=True) if h <= last and h in places)
    best = low = 0
    for high, x in enumerate(shift):
        while x - shift[low] > TOLERANCE:
            low += 1
        best = max(best, high - low + 1)
    return best / len(union)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint of each whole text."""
    common.prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            found = [encode(p) for p in prints(common.column_bytes(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def _ranges(docs: DataFrame, ranges: int):
    """The number of the range of doc_id, counted from the largest ids; null ids have the last."""
    if ranges < 2:
        return F.when(F.col("doc_id").isNull(), 1).otherwise(0)
    splits = docs.stat.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.1 / ranges)
    splits = sorted({int(x) for x in splits})
    groups = [splits[i : i + FAN] for i in range(0, len(splits), FAN)] or [[]]
    # Two steps of at most FAN and ranges / FAN comparisons find how many splits lie at or below the id.
    below = lambda known: F.size(F.filter(known, lambda x: x <= F.col("doc_id")))
    coarse = below(F.array(*[F.lit(g[-1]).cast("long") for g in groups[:-1]])) if len(groups) > 1 else F.lit(0)
    fine = F.array(*[F.array(*[F.lit(x).cast("long") for x in g]) for g in groups])
    return F.when(F.col("doc_id").isNull(), len(splits) + 1).otherwise(len(splits) - (coarse * FAN + below(F.element_at(fine, coarse + 1)))).cast("int")


def _walk(batches):
    """Rows come by range in descending doc_id, the first row of the next range last (extra)."""
    held, kept = [], None

    def done(rows):
        texts, edits, out = [], [], []
        for (doc, text), nxt in rows:
            s = text.decode("utf-8", "replace")
            cut = len(s) // 3
            edited = (s[: len(s) - cut] + nxt.decode("utf-8", "replace")[:cut]).encode() if cut else text
            texts.append(text)
            edits.append(edited)
            out.append((doc, len(s), hashlib.sha256(edited).hexdigest()))
        own = prints([*texts, *edits, rows[-1][1]])
        first, second, after = own[: len(rows)], own[len(rows) : -1], own[-1:]
        columns = list(zip(*out, strict=True))
        nexts = [p if rows[i][1] is rows[i + 1][0][1] else prints([rows[i][1]])[0] for i, p in enumerate(first[1:])] + after
        columns += [list(map(encode, first)), list(map(encode, second)), list(map(likeness, first, second)), list(map(likeness, first, nexts))]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    for batch in batches:
        texts = common.column_bytes(batch.column("text"))
        for doc, text, r, extra in zip(batch.column("doc_id").to_pylist(), texts, batch.column("range").to_pylist(), batch.column("extra").to_pylist(), strict=True):
            if kept is not None and kept[0] == r:
                held.append((kept[1], text))
            kept = (None, None) if extra else (r, (doc, text))
            if len(held) >= 200 or sum(len(x[0][1]) for x in held[-20:]) > 4_000_000:
                yield done(held)
                held = []
    if held:
        yield done(held)


WALKED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    spark = docs.sparkSession
    common.prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    ranges = min(MAX_RANGES, common.blocks_for(docs, each=range_bytes))
    placed = docs.withColumn("range", _ranges(docs, ranges))
    # The largest id of each range: at most MAX_RANGES rows.
    tops = sorted((r["range"], r["top"]) for r in placed.groupBy("range").agg(F.max("doc_id").alias("top")).collect())
    if not tops:
        return spark.createDataFrame([], WALKED)
    before = [(own, top, tops[i - 1][0]) for i, (own, top) in enumerate(tops)]  # the first range comes after the last
    before = spark.createDataFrame(before, "range int, top long, target int")
    extra = placed.join(F.broadcast(before), "range").filter(F.col("doc_id").eqNullSafe(F.col("top"))).groupBy("target").agg(F.min("text").alias("text"))
    rows = placed.select("doc_id", "text", "range", F.lit(False).alias("extra")).unionByName(extra.select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("target").alias("range"), F.lit(True).alias("extra")))
    dealt = rows.repartition(max(1, math.ceil(ranges / 4)), "range").sortWithinPartitions("range", "extra", F.desc_nulls_last("doc_id"), "text")
    return dealt.mapInArrow(_walk, WALKED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited(common.table(spark, sf_dir, "documents"))


QUERIES = {"op9_fingerprint": query}
