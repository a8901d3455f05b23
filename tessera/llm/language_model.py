"""Language-model scores from a log-frequency Bloom filter.

Counts of words are exact; counts of word pairs are quantised on a log scale and kept in a Bloom
filter: a pair seen c times is entered with each of the levels 1 to 1 + log2(c), and its count is
read back by probing level after level until one is missing.  A level stands for its least count,
so what a context's successors are given is never more than it was seen.  A text's probability is
the product over its tokens w, each after its predecessor h, of

    (c(h, w) + MASS * p(w)) / (c(h) + MASS + noise),    p(w) = (c(w) + 1) / (N + V + 1)

with c(h, w) from the filter, never above c(h) or c(w); the first token follows an end.  ``noise``
is what pairs that were never seen, but that the filter takes for seen, add to a context: the
filter's rate of false answers, measured by how full it is, times V.  So the probabilities of what
may follow a context come to one at most, but for chance in which pairs are taken for seen.

The filter grows with the corpus.  It is cut by key into segments; as many segments as fit into
ROUND_BYTES are broadcast at a time.  Further segments take further rounds, each of which writes
its parts of the sums to the shared folder before its broadcast is destroyed, so neither the driver
nor a worker holds more than a round.  Rounds read documents with the counts of their tokens from a
table, so a round costs another pass over the texts but no shuffle of them.

Defined cases: a null text is empty, so it is the end token alone; a null doc_id is not held out;
repeated rows count as often as they occur; without training tokens the base score is zero; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, common

FOLDS, HELD_FOLD = 7, 2
MASS = 300.0
PROBES, BITS = 9, 14
#: Smaller blocks than elsewhere: a worker holds the broadcast part of the filter besides.
BLOCK_BYTES = 4_000_000
#: The most that is broadcast at a time.
ROUND_BYTES = 64_000_000
CHUNK = 1_500_000  # bytes of text that are scored at a time
END = np.uint64(0x5EED5EED5EED5EED)

COUNTED = "block int, shard int, answer binary, tokens long, types long"
_COUNTED = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("answer", pa.binary()), ("tokens", pa.int64()), ("types", pa.int64())])
FILTER, TOTAL = -1, -2  # instead of a block
PART = "block int, row int, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_FOLD


class Tokens:
    """The tokens of texts, one text after another, each ended by END, and what stands before each."""

    def __init__(self, texts: list[bytes]):
        words, counts = common.word_hashes(texts, lower=True)
        self.sizes = counts + 1
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.words = np.insert(words, np.cumsum(counts), END)
        self.before = np.r_[END, self.words[:-1]]  # texts end with END

    def pairs(self) -> np.ndarray:
        return common.combine(self.before, self.words, 17) >> np.uint64(16)


class Block(Tokens):
    def __init__(self, docs: pa.Table):
        ids, self.texts, _ = blocks.in_order(docs)
        self.number = docs.column("block")[0].as_py()
        self.ids = [None if d == blocks.NULL_ID else d for d in ids]
        self.held = np.array([is_held_out(d) for d in self.ids], bool)
        super().__init__(self.texts)
        self.trains = np.repeat(~self.held, self.sizes)


_DEALT = ("keys", "counts")


def _deal(shards: int):
    """Words of a block with how often they are trained on go to shards 0 to shards - 1, trained pairs to those above."""

    def run(docs: pa.Table) -> pa.Table:
        b = Block(docs)
        number = b.number
        words, at = np.unique(b.words, return_inverse=True)
        counts = np.bincount(at, b.trains, len(words)).astype("<u8")
        pairs, many = np.unique(b.pairs()[b.trains], return_counts=True)
        of_words = blocks.deal(number, words, shards, _DEALT, words, counts)
        of_pairs = blocks.deal(number, pairs, shards, _DEALT, common.small(pairs, 6), many.astype("<u4"))
        above = pa.array(of_pairs.column("shard").to_numpy() + shards, pa.int32())
        return pa.concat_tables([of_words, of_pairs.set_column(0, of_words.schema.field("shard"), above)])

    return run


def level(counts: np.ndarray) -> np.ndarray:
    """The quantised count: 1 for 1, 2 for 2 and 3, 3 for 4 to 7 and so on."""
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)


def count_of(levels: np.ndarray) -> np.ndarray:
    """What a level stands for: its least count."""
    return np.where(levels > 0, np.exp2(levels - 1.0), 0.0)


def bit_places(keys: np.ndarray, levels: np.ndarray, probe: int, bits: np.ndarray | int) -> np.ndarray:
    h = common.combine(keys, levels.astype(np.uint64), 23)
    low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
    place = (low + high * np.uint64(probe)) & np.uint64(0xFFFFFFFF)
    return place * np.asarray(bits, np.uint64) >> np.uint64(32)


def segment(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """The filter of these pairs."""
    top = level(counts)
    bits = max(64, int(top.sum()) * BITS)
    bits = min(-(-bits // 8) * 8, 1 << 32)
    places = np.zeros(bits, bool)
    at = 1
    while len(keys):
        for probe in range(PROBES):
            places[bit_places(keys, np.full(len(keys), at), probe, bits)] = True
        at += 1
        keys, top = keys[top >= at], top[top >= at]
    return np.packbits(places, bitorder="little").tobytes()


def _count(shards: int):
    """Answers with the counts of words; rows of FILTER have a segment, how many of its bits are set and how many there are."""

    def run(rows: pa.Table) -> pa.Table:
        shard = rows.column("shard")[0].as_py()
        if shard < shards:
            s = blocks.Shard(rows, keys=np.dtype("<u8"), counts=np.dtype("<u8"))
            words, at = np.unique(s.keys, return_inverse=True)
            total = np.bincount(at, s.counts, len(words)).astype("<u8")
            answer = total[at]
            out = [(b, shard, blocks.pack(answer[lo:hi]), 0, 0) for b, lo, hi in zip(s.block, s.bounds[:-1].tolist(), s.bounds[1:].tolist(), strict=True)]
            out.append((TOTAL, shard, b"", int(total.sum()), int((total > 0).sum())))
        else:
            s = blocks.Shard(rows, keys=np.dtype(("u1", 6)), counts=np.dtype("<u4"))
            pairs, at = np.unique(common.large(s.keys), return_inverse=True)
            raw = segment(pairs, np.bincount(at, s.counts, len(pairs)))
            full = int(np.bitwise_count(np.frombuffer(raw, np.uint8)).sum())
            out = [(FILTER, shard - shards, raw, full, 8 * len(raw))]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _COUNTED, strict=True)], schema=_COUNTED)

    return run


class Filter:
    """Segments of the filter by shard; pairs of shards that it doesn't hold have level 0."""

    def __init__(self, sizes: list[tuple[int, int]], raw: bytes, shards: int):
        """sizes: shard and bytes of the segments that stand in ``raw`` one after another."""
        self.raw, self.shards = np.frombuffer(raw, np.uint8), shards
        self.bits, self.base = np.zeros(shards, np.uint64), np.zeros(shards, np.uint64)
        at = 0
        for s, n in sizes:
            self.bits[s], self.base[s] = n * 8, at * 8
            at += n

    def levels(self, keys: np.ndarray) -> np.ndarray:
        shard = (common.mix(keys) % np.uint64(self.shards)).astype(np.int64)
        bits, base = self.bits[shard], self.base[shard]
        out = np.zeros(len(keys), np.int64)
        left, at = np.flatnonzero(bits), 1
        while len(left):
            levels = np.full(len(left), at)
            for probe in range(PROBES):
                place = base[left] + bit_places(keys[left], levels, probe, bits[left])
                hit = (self.raw[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                left, levels = left[hit], levels[hit]
            out[left] = at
            at += 1
        return out


def parts_of(seen: np.ndarray, p: np.ndarray, context: np.ndarray, noise: float) -> tuple[np.ndarray, np.ndarray]:
    """log10 of a token's probability in two parts: as if its pair had not been seen, and what its count adds."""
    smooth = MASS * p
    return np.log10(smooth / (context + MASS + noise)), np.log10((seen + smooth) / smooth)


PREPARED = "block int, row int, doc_id long, held_out boolean, text binary, counts binary"


def _prepare(shards: int):
    """Each document with how often each of its tokens is trained on: all that a round needs of it."""

    def run(docs: pa.Table, found: dict) -> pa.Table:
        import zstandard

        compress = zstandard.ZstdCompressor(level=1).compress
        b = Block(docs)
        words, at = np.unique(b.words, return_inverse=True)
        mine = blocks.read(found["words"], words, shards, np.dtype("<u8"))[at]
        counts = [compress(blocks.pack(mine[lo : lo + n])) for lo, n in zip(b.starts.tolist(), b.sizes.tolist(), strict=True)]
        columns = [np.full(len(b.ids), b.number), np.arange(len(b.ids)), b.ids, b.held, list(map(compress, b.texts)), counts]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("block", "row", "doc_id", "held_out", "text", "counts"), columns, kinds, strict=True)})

    return run


def _score(filters, shards: int, tokens: int, types: int, noise: float, first: bool):
    def run(batches):
        f = Filter(*filters.value, shards)
        for whole in batches:
            texts, counts = common.unpacked(whole.column("text")), common.unpacked(whole.column("counts"))
            for a, z in blocks.chunks(texts, CHUNK):
                t, batch = Tokens(texts[a:z]), whole.slice(a, z - a)
                mine = np.concatenate([blocks.unpack(c, n, "<u8") for c, n in zip(counts[a:z], t.sizes.tolist(), strict=True)]).astype(np.float64)
                context = np.r_[mine[-1], mine[:-1]]  # a text ends with END, which is what the first token follows
                p = (mine + 1) / (tokens + types + 1)
                pairs, which = np.unique(t.pairs(), return_inverse=True)
                seen = np.minimum(count_of(f.levels(pairs))[which], np.minimum(context, mine))
                unseen, more = parts_of(seen, p, context, noise)
                total = lambda x, starts=t.starts: np.add.reduceat(x, starts)
                zero = np.zeros(z - a)
                columns = [t.sizes, total((mine > 0).astype(np.int64)), total(np.log10(p)) if first else zero, total(more + unseen if first else more)]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
                keep = ["block", "row", "doc_id", "held_out"]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [*keep, "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, block_bytes: int = BLOCK_BYTES, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    common.prepare(spark)
    shards = common.blocks_for(docs, each=block_bytes)
    texts = common.blocked(docs, shards)
    counted = common.cut(common.grouped(common.grouped(texts, "block", _deal(shards), blocks.dealt(*_DEALT)), "shard", _count(shards), COUNTED), "counts")
    sums = lambda what: counted.filter(F.col("block") == what).agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("types"), F.lit(0)).alias("v")).first()
    total, filled = sums(TOTAL), sums(FILTER)
    false = (filled["n"] / filled["v"]) ** PROBES if filled["v"] else 0.0
    noise = total["v"] * false / max(1 - 2 * false, 0.5)  # a false answer at one level is followed by one at the next as rarely
    sizes = sorted((r["shard"], r["size"]) for r in counted.filter(F.col("block") == FILTER).select("shard", F.octet_length("answer").alias("size")).collect())
    rounds, size = [[]], 0
    for s, n in sizes:
        if rounds[-1] and size + n > round_bytes:
            rounds.append([])
            size = 0
        rounds[-1].append(s)
        size += n
    answers = counted.filter("block >= 0").select("block", "shard", "answer")
    # The rounds read this, without another shuffle.
    prepared = common.cut(blocks.together(texts, shards, {"words": answers}, _prepare(shards), PREPARED), "prepared")
    parts = []
    for k, held in enumerate(rounds):
        sizes_of, raw = [], bytearray()
        if held:  # a segment at a time, so that the driver holds little more than the round
            for r in counted.filter((F.col("block") == FILTER) & F.col("shard").between(held[0], held[-1])).select("shard", "answer").toLocalIterator():
                sizes_of.append((r["shard"], len(r["answer"])))
                raw += r["answer"]
        shared = spark.sparkContext.broadcast((sizes_of, bytes(raw)))
        del raw
        part = prepared.mapInArrow(_score(shared, shards, total["n"], total["v"], noise, k == 0), PART)
        if len(rounds) > 1:  # a round at a time
            part = common.cut(part, "scores")
            shared.destroy()
        parts.append(part)
    out = reduce(DataFrame.unionByName, parts)
    if len(rounds) > 1:
        out = out.groupBy("block", "row").agg(*[F.first(c).alias(c) for c in ("doc_id", "held_out", "n_tokens", "n_known")], F.sum("base_score").alias("base_score"), F.sum("score").alias("score"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total["n"]).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"))


QUERIES = {"op4_language_model": query}
