"""Benchmark passages in documents, found by the q-gram lemma and verified by banded alignment.

Texts are normalised (A-Z lower case, runs of white space one blank).  The passages of an item are
its LENGTH bytes from every byte on, so each excerpt of LENGTH bytes is one, whatever its offset;
an item of Q to LENGTH bytes is one passage.  A document has a passage if some region of it is at
most ``budget`` edits away: BUDGET of the passage's length, rounded down (none
below 16 bytes, where an edit may leave no q-gram).  LENGTH is the shortest
excerpt of a longer item that is looked for.

A passage of m bytes and a region within k edits share at least m - q + 1 - k q of the q-grams of
the passage, on diagonals that differ by at most k.  So a stretch of a document is left alone if it
has fewer q-grams of any item; in the others, hits are laid in overlapping bands of 2 (k + 1)
diagonals for each item, and the passages that have the bound of them in a band are aligned in it.

The items are broadcast in slices of at most SLICE_BYTES, whatever their number, one at a time.

Result of ``regions``: a row for each item and region (overlapping ones of an item joined): doc_id,
item_id, start and stop (bytes of the document's UTF-8), passages, edits (of the best one).

Defined cases: null and empty texts have no region; items that are null or shorter than Q
bytes when normalised are not looked for; repeated rows give their regions once each; a null doc_id
is kept; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, common

Q = 8  # a q-gram is a number of 8 bytes
LENGTH, BUDGET = 80, 0.08
SLICE_BYTES = 4_000_000
CHUNK = 400_000
#: Hits that are looked at together, and bytes of an item (longer ones in parts).
MOST, ITEM_BYTES = 2_000_000, 4_096
REGIONS = "doc_id long, item_id long, start long, stop long, passages long, edits long"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32


def normalise(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The normalised bytes and the place of each in the text."""
    raw = _FOLD[np.frombuffer(text, np.uint8)]
    keep = np.flatnonzero(np.r_[True, (raw[1:] != 32) | (raw[:-1] != 32)]) if len(raw) else np.zeros(0, np.int64)
    return raw[keep], keep


def budget(length: int) -> int:
    return min(int(BUDGET * length), max(0, (length - Q) // Q))


def bound(length: int) -> int:
    return max(1, length - Q + 1 - budget(length) * Q)


def whole(items: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    """The items that are looked for, normalised."""
    found = [(item, normalise(text)[0].tobytes().strip()) for item, text in items]
    return [(item, text) for item, text in found if len(text) >= Q]


def parts_of(found: list[tuple[int, bytes]], size: int) -> list[tuple[int, bytes]]:
    """Long items in parts that have all their passages, so that what one gives is bounded."""
    return [(item, text[a : a + size + LENGTH - 1]) for item, text in found for a in range(0, max(1, len(text) - LENGTH + 1), size)]


def passages(items: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    return [(item, text[a : a + LENGTH]) for item, text in whole(items) for a in range(max(0, len(text) - LENGTH) + 1)]


def _eight(raw: np.ndarray) -> np.ndarray:
    return np.ndarray((max(0, len(raw) - 7),), "<u8", np.ascontiguousarray(raw), strides=(1,))


class Index:
    """q-grams of normalised items: where each occurs."""

    def __init__(self, found: list[tuple[int, bytes]]):
        found = parts_of(found, ITEM_BYTES)
        self.items, self.texts = [i for i, _ in found], [t for _, t in found]
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.lengths = np.minimum(self.sizes, LENGTH)  # of the passages
        self.budgets = np.array([budget(n) for n in self.lengths.tolist()], np.int64)
        self.bounds = np.array([bound(n) for n in self.lengths.tolist()], np.int64)
        grams = [np.frombuffer(t, np.uint8) for t in self.texts]
        code = np.concatenate([_eight(g) for g in grams]) if grams else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(grams)), np.maximum(self.sizes - Q + 1, 0))
        place = np.concatenate([np.arange(len(g) - Q + 1) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(code, kind="stable")
        self.code, self.item, self.place = code[order], item[order], place[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self._slot(self.code)] = True
        self.least = int(self.bounds.min()) if grams else 1
        self.window = int((self.lengths + self.budgets).max()) - Q + 1 if grams else 1

    @staticmethod
    def _slot(code: np.ndarray) -> np.ndarray:
        return (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)

    def hits(self, text: np.ndarray, most: int):
        """(place in the text, item, place in the item) of q-grams in stretches that have enough of them.

        In lots of about ``most`` hits: parts of the text that overlap by a window, and of these, if
        one window has more, parts of the items; every region lies whole in a lot."""
        code = _eight(text)
        if not len(code) or not len(self.code):
            return
        maybe = self.maybe[self._slot(code)]
        at = self._dense(np.flatnonzero(maybe))
        at = at[self.code[np.minimum(np.searchsorted(self.code, code[at]), len(self.code) - 1)] == code[at]]
        at = self._dense(at)
        low, high = np.searchsorted(self.code, code[at], "left"), np.searchsorted(self.code, code[at], "right")
        total = np.r_[0, np.cumsum(high - low)]
        begin = 0
        while begin < len(at):
            end = max(int(np.searchsorted(total, total[begin] + most, "right")) - 1, begin + 1)
            stop = max(end, int(np.searchsorted(at, at[end - 1] + self.window)))  # what a region that begins here may reach
            lot, first, last = at[begin:stop], low[begin:stop], high[begin:stop]
            begin = end
            many = last - first
            if many.sum() <= 4 * most:
                yield self._expanded(lot, first, many)
                continue
            # Postings of a q-gram come in the order of their items.
            step = max(1, len(self.items) * 2 * most // int(many.sum()))
            for i in range(0, len(self.items), step):
                a = first + self._before(first, last, i)
                b = first + self._before(first, last, i + step)
                if (b > a).any():
                    yield self._expanded(lot, a, b - a)

    def _before(self, first: np.ndarray, last: np.ndarray, item: int) -> np.ndarray:
        """How many postings of each q-gram are of items before this one."""
        return np.array([np.searchsorted(self.item[a:b], item) for a, b in zip(first.tolist(), last.tolist(), strict=True)], np.int64)

    def _expanded(self, at: np.ndarray, low: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        which = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return np.repeat(at, many), self.item[which], self.place[which]

    def _dense(self, at: np.ndarray) -> np.ndarray:
        """Of these places those that lie with ``least`` of them in some window."""
        n = self.least
        if len(at) < n:
            return at[:0]
        full = np.flatnonzero(at[n - 1 :] - at[: len(at) - n + 1] < self.window)  # from here n places lie in a window
        mark = np.zeros(len(at) + 1, np.int64)
        np.add.at(mark, full, 1)
        np.add.at(mark, full + n, -1)
        return at[np.cumsum(mark[:-1]) > 0]


def align(patterns: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edits of each pattern (N x m) against the best part of its text, and the diagonal that the best path ends on; texts is N x (m + W - 1), W diagonals wide.  Cells off the band don't count."""
    n, m = patterns.shape
    width = texts.shape[1] - m + 1
    step = np.arange(width)
    cost = np.zeros((n, width), np.int64)  # a region may start on any diagonal
    for i in range(m):
        best = cost + (texts[:, i : i + width] != patterns[:, i : i + 1])
        best[:, :-1] = np.minimum(best[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(best - step, axis=1) + step
    return cost.min(1), cost.argmin(1)


def _candidates(index: Index, at: np.ndarray, item: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, start in the item, first diagonal of the band) of the passages that have enough hits in a band."""
    band = (at - place + (1 << 36)) // (index.budgets[item] + 1)  # diagonals may be negative
    key = item.astype(np.int64) << 37 | band
    key, place = np.r_[key, key - 1], np.r_[place, place]
    order = np.lexsort((place, key))
    key, place = key[order], place[order]
    item = key >> 37
    last = np.arange(len(key)) + index.bounds[item] - 1
    full = np.flatnonzero(last < len(key))
    last = last[full]
    span = (index.lengths - Q)[item]
    good = (key[last] == key[full]) & (place[last] - place[full] <= span[full])
    full, last = full[good], last[good]
    key, item = key[full], item[full]
    low = np.maximum(place[last] - span[full], 0)
    high = np.minimum(place[full], (index.sizes - index.lengths)[item])
    # Both rise within a band: what the one before has had already is left out.
    again = np.flatnonzero(key[1:] == key[:-1]) + 1
    low[again] = np.maximum(low[again], high[again - 1] + 1)
    many = np.maximum(high - low + 1, 0)
    start = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    item, band = np.repeat(item, many), np.repeat(key & ((1 << 37) - 1), many)
    return item, start, band * (index.budgets[item] + 1) - (1 << 36) + start


def _verify(index: Index, text: np.ndarray, found: np.ndarray, begin: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(item, start in the item, start, stop, edits) of the passages that hold; first: first diagonal of each band."""
    out = []
    by_length = defaultdict(list)
    padded_at = 4 * LENGTH
    padded = np.r_[np.zeros(padded_at, np.uint8), text, np.zeros(padded_at, np.uint8)]
    for p, s, d in zip(found.tolist(), begin.tolist(), first.tolist(), strict=True):
        m, k = int(index.lengths[p]), int(index.budgets[p])
        pattern = index.texts[p][s : s + m]
        at = text[max(0, d - k) : max(0, d + 2 * (k + 1) + k + m)].tobytes().find(pattern)
        if at >= 0:
            out.append((p, s, max(0, d - k) + at, max(0, d - k) + at + m, 0))
        elif k:
            by_length[m].append((p, s, d, pattern))
    for m, rows in by_length.items():
        k = budget(m)
        width = 2 * (k + 1) + 2 * k
        for a in range(0, len(rows), 2_000):
            part = rows[a : a + 2_000]
            patterns = np.array([np.frombuffer(x, np.uint8) for *_, x in part])
            texts = np.array([padded[padded_at + d - k : padded_at + d - k + m + width - 1] for _, _, d, _ in part])
            edits, end = align(patterns, texts)
            back, start = align(patterns[:, ::-1], texts[:, ::-1])
            for (p, s, d, _), e, c, x in zip(part, edits.tolist(), end.tolist(), start.tolist(), strict=True):
                if e <= k:
                    low, high = d - k + (width - 1 - x), d - k + c + m
                    out.append((p, s, max(0, low), min(len(text), max(high, low + m - k)), e))
    return out


def find(index: Index, text: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(item, start, stop, passages, edits) in a normalised text, which zero bytes may divide; no region goes over one."""
    held = {}  # of what lots have in common, the best region of each passage and end
    for lot in index.hits(text, MOST):
        if len(lot[0]):
            for p, s, start, stop, edits in _verify(index, text, *_candidates(index, *lot)):
                held[p, s, start, stop] = min(edits, held.get((p, s, start, stop), edits))
    zeros = np.r_[-1, np.flatnonzero(text == 0), len(text)]
    by_item = defaultdict(list)
    for (p, s, start, stop), edits in held.items():
        part = int(np.searchsorted(zeros, (start + stop) // 2, "right"))
        start, stop = max(start, int(zeros[part - 1]) + 1), min(stop, int(zeros[min(part, len(zeros) - 1)]))
        if start < stop:
            by_item[index.items[p], part].append((start, stop, (p, s), edits))
    out = []
    for (item, _), rows in by_item.items():
        rows.sort()
        joined: list[list] = []
        for start, stop, p, edits in rows:
            if joined and start <= joined[-1][1]:
                joined[-1][1], joined[-1][3] = max(joined[-1][1], stop), min(joined[-1][3], edits)
                joined[-1][2].add(p)
            else:
                joined.append([start, stop, {p}, edits])
        out += [(item, a, b, len(ps), e) for a, b, ps, e in joined]
    return sorted(out)


def _scan(shared):
    def run(batches):
        index = Index(shared.value)
        for batch in batches:
            texts, ids, rows = common.column_bytes(batch.column("text")), batch.column("doc_id").to_pylist(), []
            for a, b in blocks.chunks(texts, CHUNK):
                parts = [normalise(t) for t in texts[a:b]]
                starts = np.r_[0, np.cumsum([len(p) + 1 for p, _ in parts])]
                joined = np.concatenate([x for p, _ in parts for x in (np.where(p == 0, 1, p).astype(np.uint8), np.zeros(1, np.uint8))])
                for item, start, stop, n, edits in find(index, joined):
                    i = int(np.searchsorted(starts, (start + stop) // 2, "right")) - 1
                    place = parts[i][1]
                    start, stop = max(0, start - int(starts[i])), min(len(place), stop - int(starts[i]))
                    if start < stop:
                        rows.append((ids[a + i], item, int(place[start]), int(place[stop - 1]) + 1, n, edits))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "item_id", "start", "stop", "passages", "edits"])

    return run


def _drop(shared):
    def run(batches):
        index = Index(shared.value)
        for batch in batches:
            texts, bad = common.column_bytes(batch.column("__text")), np.zeros(batch.num_rows, bool)
            for a, b in blocks.chunks(texts, CHUNK):
                parts = [normalise(t)[0] for t in texts[a:b]]
                starts = np.r_[0, np.cumsum([len(p) + 1 for p in parts])]
                joined = np.concatenate([x for p in parts for x in (np.where(p == 0, 1, p).astype(np.uint8), np.zeros(1, np.uint8))])
                for _, start, stop, _, _ in find(index, joined):
                    bad[a + int(np.searchsorted(starts, (start + stop) // 2, "right")) - 1] = True
            yield pa.RecordBatch.from_arrays([batch.column("__row").filter(pa.array(~bad))], ["__row"])

    return run


def slices(benchmark: DataFrame, size: int = SLICE_BYTES):
    """Items of the benchmark, normalised, in lists of about ``size`` bytes; the rows stream through the driver."""
    out, held = [], 0
    rows = benchmark.select(F.col("item_id").cast("long"), "text").filter(F.col("text").isNotNull()).orderBy("item_id", "text")
    for item, text in rows.toLocalIterator():
        more = whole([(item, text.encode())])
        out += more
        held += sum(len(t) for _, t in more)
        if held >= size:
            yield out
            out, held = [], 0
    if out:
        yield out


def regions(docs: DataFrame, benchmark: DataFrame, size: int = SLICE_BYTES) -> DataFrame:
    spark = docs.sparkSession
    common.prepare(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    parts = last = None
    for part in slices(benchmark, size):
        if last is not None:
            parts = common.cut(parts, "regions")
            last.destroy()
        last = spark.sparkContext.broadcast(part)
        found = texts.mapInArrow(_scan(last), REGIONS)
        parts = found if parts is None else parts.unionByName(found)
    return parts if parts is not None else spark.createDataFrame([], REGIONS)


def clean(docs: DataFrame, benchmark: DataFrame, size: int = SLICE_BYTES) -> DataFrame:
    """The documents that hold no passage of the benchmark, as they are."""
    spark = docs.sparkSession
    common.prepare(spark)
    last = None
    for part in slices(benchmark, size):
        if last is not None:  # one slice at a time is held by the driver and the workers
            docs = common.cut(docs, "clean")
            last.destroy()
        last = spark.sparkContext.broadcast(part)
        rows = docs.select(F.struct("*").alias("__row"), F.coalesce("text", F.lit("")).cast("binary").alias("__text"))
        docs = rows.mapInArrow(_drop(last), common.ddl(rows.select("__row"))).select("__row.*")
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = regions(common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "benchmark"))
    return found


QUERIES = {"op10_decontamination": query}
