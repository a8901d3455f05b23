"""Sequence packing by minimum bin slack.

``pack(docs)`` tokenises whole documents, cuts full windows off each document and packs what
remains: for each window, a bitset subset-sum dynamic program over the multiset of remaining
lengths finds the filling closest to capacity, and backtracking gives how many pieces of each
length it takes; the same filling is reused while the counts last.  Pieces whose best filling stays
short (the last of a shard) are poured into full sequences and a tail cut at powers of two.

Result of ``pack``: one row per piece with doc_id, start (ids of the document before it), length,
ids (little-endian uint32), doc_tokens, sequence_id and offset.

Defined cases: a null or empty text is the end id alone; a null doc_id is packed like any other;
repeated rows are packed as often as they occur; an empty table gives no rows; further columns are
ignored.  Nothing is padded.  Shards are made by a hash of a piece's document, place and ids, so rows
without an id spread over all of them.  Rows that are equal in id and text more than CROWD times are
also told apart by how often their task has had them before, so they spread as well; equal rows may
stand for one another, so a task that is run again deals them alike.
"""

from __future__ import annotations

import struct
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CAPACITY = 4096
END = 2
#: Bytes of text whose pieces a shard holds on average.
SHARD_BYTES = 8_000_000
#: Equal rows beyond which they are dealt out, and how many such rows may be told to all workers (8 bytes each): with more, only the larger crowds are.
CROWD, MOST_CROWDS = 256, 100_000
VOCABULARY = "word_bpe_49k.json"
LATIN = "\u0250"
# The public byte-level alphabet: printable Latin-1 stands for itself, other bytes for the characters from U+0100 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_ALPHABET = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}

PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"
PACKED = PIECES + ", sequence_id long, offset long"


class ChunkTokenizer(dict):
    """Ids (little-endian uint32) of words, learned as they come: the pre-tokenizer never crosses ASCII
    white space, so a word's ids don't depend on its neighbours.  Remembers two generations of at
    most about ``limit`` words."""

    #: Punctuation that may be taken off the end of a word of letters: it is a piece of its own there.
    TAIL = b".,;:!?)"

    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole, self.limit, self.old = Tokenizer.from_file(path), limit, {}
        self.piece = self.whole.model.tokenize

    def __missing__(self, w: bytes) -> bytes:
        ids = self.old.get(w)
        if ids is None:
            core = w.rstrip(self.TAIL)
            s = core.decode("utf-8", "replace")
            low = s.lower()
            if s.isalpha() and max(s) < LATIN and max(low) < LATIN:
                # Letters below U+0250, in lower case too, are one piece and in normal form: only case and the byte alphabet are left to do.
                s = low
                low = s.encode()
                ids = self.get(low)
                if ids is None:
                    ids = self[low] = array("I", [t.id for t in self.piece(s if s.isascii() else low.decode("latin-1").translate(BYTE_ALPHABET))]).tobytes()
                if len(core) < len(w):
                    ids += self[w[len(core) :]]
            else:
                ids = array("I", self.whole.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()
        self[w] = ids
        return ids

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
        get = self.__getitem__
        return [b"".join(map(get, t.split())) for t in texts]


_TOKENIZERS: dict[str, ChunkTokenizer] = {}


def tokenizer(vocabulary: str) -> ChunkTokenizer:
    if vocabulary not in _TOKENIZERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        path = vocabulary
        if not os.path.isabs(path):
            import public_tokenizers

            path = public_tokenizers.path(vocabulary)
        _TOKENIZERS[vocabulary] = ChunkTokenizer(path)
    return _TOKENIZERS[vocabulary]


def _cut_documents(vocabulary: str, capacity: int, end: int):
    tail = struct.pack("<I", end)

    def run(batches):
        model, seen = tokenizer(vocabulary), Counter()
        for batch in batches:
            ids_of, texts, crowds = batch.column("doc_id").to_pylist(), common.column_bytes(batch.column("text")), batch.column("crowd").to_pylist()
            for at in range(0, len(texts), 256):
                rows = []
                for doc, crowd, ids in zip(ids_of[at : at + 256], crowds[at : at + 256], model.encode(texts[at : at + 256]), strict=True):
                    ids += tail
                    n, turn = len(ids) // 4, 0
                    if crowd is not None:
                        turn = seen[crowd] = seen[crowd] + 1
                    rows += [(doc, s, min(capacity, n - s), n, ids[4 * s : 4 * (s + capacity)], turn) for s in range(0, n, capacity)]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "start", "length", "doc_tokens", "ids", "turn"])

    return run


def fillings(counts: dict[int, int], capacity: int):
    """Empties ``counts`` (length -> how many) into windows; yields (times, {length: how many}).

    Each window holds the longest piece left; the bitset has a bit for each sum that can be reached,
    and the search ends as soon as the window can be full."""
    full = (1 << (capacity + 1)) - 1
    lengths = sorted(counts, reverse=True)
    while lengths:
        first = lengths[0]
        reach, steps = 1 << first, []
        for length in lengths:
            left, k = min(counts[length] - (length == first), (capacity - first) // length), 1
            while left > 0:
                k = min(k, left)
                steps.append((length, k, reach))
                reach |= (reach << (length * k)) & full
                left, k = left - k, 2 * k
            if reach >> capacity & 1:
                break
        total = reach.bit_length() - 1
        use = {first: 1}
        for length, k, before in reversed(steps):
            if not before >> total & 1:
                use[length] = use.get(length, 0) + k
                total -= length * k
        times = min(counts[n] // k for n, k in use.items())
        for n, k in use.items():
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
                lengths.remove(n)
        yield times, use


def powers(total: int, capacity: int) -> list[int]:
    """Lengths of the sequences that hold ``total`` ids without padding."""
    return [total] if total == capacity else [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]


def plan(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(piece, start in it, length, sequence, offset) for pieces of these lengths."""
    where: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        where.setdefault(n, []).append(i)
    for stack in where.values():
        stack.reverse()
    windows, rest = [], []
    for times, use in fillings({n: len(x) for n, x in where.items()}, capacity):
        for _ in range(times):
            pieces = [where[n].pop() for n, k in use.items() for _ in range(k)]
            if sum(lengths[i] for i in pieces) == capacity:
                windows.append((pieces, [capacity]))
            else:
                rest += pieces
    total = sum(lengths[i] for i in rest)
    windows.append((rest, [capacity] * (total // capacity) + powers(total % capacity, capacity)))
    out, sequence = [], 0
    for pieces, sizes in windows:
        at = 0
        for i in pieces:
            start = 0
            while start < lengths[i]:
                take = min(lengths[i] - start, sizes[0] - at)
                out.append((i, start, take, sequence, at))
                start, at = start + take, at + take
                if at == sizes[0]:
                    sizes.pop(0)
                    sequence, at = sequence + 1, 0
    return out


def _pack_shard(capacity: int):
    def run(pieces: pa.Table) -> pa.Table:
        if not pieces.num_rows:
            return pa.table({n: pa.array([], t) for n, t in (("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64()))})
        shard = pieces.column("shard")[0].as_py()
        pieces = pieces.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids", "ascending")])
        rows = list(zip(*(pieces.column(c).to_pylist() for c in ("doc_id", "start", "length", "doc_tokens", "ids")), strict=True))
        out = []
        for i, start, take, sequence, at in plan([r[2] for r in rows], capacity):
            doc, s, _, n, ids = rows[i]
            out.append((doc, s + start, take, n, ids[4 * start : 4 * (start + take)], (shard << 32) + sequence, at))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"), zip(*out, strict=True), kinds, strict=True)})

    return run


def _told_apart(texts: DataFrame) -> DataFrame:
    """The rows with ``crowd``: a hash of those of which there are very many, else null."""
    h = F.xxhash64("doc_id", "text")
    crowds, most = common.cut(texts.groupBy(h.alias("crowd")).agg(F.count("*").alias("n")).filter(F.col("n") > CROWD), "crowds"), CROWD
    while (n := crowds.filter(F.col("n") > most).count()) > MOST_CROWDS:
        most *= 2
    if not n:
        return texts.withColumn("crowd", F.lit(None).cast("long"))
    return texts.join(F.broadcast(crowds.filter(F.col("n") > most).select("crowd")), h == F.col("crowd"), "left")


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end: int = END, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    common.prepare(docs.sparkSession)
    shards = common.blocks_for(docs, each=shard_bytes)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    pieces = _told_apart(texts).mapInArrow(_cut_documents(vocabulary, capacity, end), PIECES + ", turn long")
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "ids", "turn"), F.lit(shards)).cast("int")).drop("turn")
    return common.grouped(pieces, "shard", _pack_shard(capacity), PACKED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(common.table(spark, sf_dir, "documents")))


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op6_packing": query}
