"""Line deduplication by an exact set-similarity join.

Lines are compared by the sets of their words (A-Z lower-cased).  A line goes if some earlier line
(by doc_id, then place) has a Jaccard similarity of ``SIMILARITY`` or more with it; all lines are
judged on the input, so the result doesn't depend on the order of work.

Words are ordered by rarity: by how often the corpus has them (counted over all documents in a
table of 2^20 slots of their hashes, which is small enough to broadcast), then by hash.  Two
similar lines of a and b words share one of the first n - ceil(SIMILARITY n) + 1 words of each in
this order, so

1. lines with the same text are one line, the first: a block asks for each of its distinct lines
   once, by 128 bits of a hash;
2. each line goes to the groups of its prefix words with its size, the place of the word and a
   128-bit picture of its set; the length filter, the positional filter and the difference of the
   pictures tell which lines of a group may have a similar one there;
3. only those go to the same groups again, word for word, where Jaccard is verified, the closest in
   order first; a line that is removed is compared no further as the later one.

No step makes all pairs of a group: in a group of like lines the first comparison settles both.
Lines of up to three words are only similar when equal, and are grouped by the whole set.

Defined cases: a line of fewer than MIN_WORDS words (one without a word) always stays; a null text is one empty line;
null doc_ids come after all others, rows of equal doc_ids in the order of a hash of their texts; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, common

SIMILARITY, MIN_WORDS = 0.8, 1
SLOTS, SLICES = 1 << 20, 32
CHUNK = 400_000
#: Smaller blocks than elsewhere: lines are held as objects.
BLOCK_BYTES = 4_000_000
KEPT = "doc_id long, n_lines long, n_removed long, kept binary"
#: Lines that are made into sets at once; from FULL words on a size isn't told.
LINES, FULL = 1 << 12, 65_535


def rarity(docs: DataFrame) -> np.ndarray:
    """A code from 0 to 4095 for each slot of the words' hashes that rises with how often they occur.

    Each task has one vector of all slots; these are added up in two steps, the first over about the root of the number of tasks."""
    def count(batches):
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            texts = common.column_bytes(batch.column("text"))
            for a, b in blocks.chunks(texts, 8_000_000):
                words, _ = common.word_hashes(texts[a:b], lower=True)
                counts += np.bincount((words & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        if counts.any():
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([math.isqrt(part)] * SLICES, pa.int32()), common.binaries(np.split(counts, SLICES))], ["slice", "part", "counts"])

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(SLOTS // SLICES, np.int64)
        for x in rows.column("counts"):
            total += np.frombuffer(x.as_buffer(), np.int64)
        return pa.table({"slice": rows.column("slice")[:1], "part": rows.column("part")[:1], "counts": common.binaries([total])})

    texts = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    kind = "slice int, part int, counts binary"
    parts = common.grouped(texts.mapInArrow(count, kind).withColumn("both", F.struct("slice", "part")), "both", add, kind)
    counts = np.zeros(SLOTS, np.int64)
    for r in common.grouped(parts, "slice", add, kind).collect():
        counts[r["slice"] * (SLOTS // SLICES) : (r["slice"] + 1) * (SLOTS // SLICES)] = np.frombuffer(bytes(r["counts"]), np.int64)
    return np.minimum(4095, np.log2(counts + 1) * 100).astype(np.uint16)


def _worded(line: bytes) -> bool:
    return bool(line.strip()) if MIN_WORDS == 1 else len(line.split(None, MIN_WORDS)) >= MIN_WORDS


class Block:
    """Lines of a block's documents, in order; equal ones, but those without a word, have the place of the first."""

    def __init__(self, docs: pa.Table):
        self.ids, self.texts, self.rows = blocks.in_order(docs)
        self.lines = [t.split(b"\n") for t in self.texts]
        self.starts = np.r_[0, np.cumsum([len(x) for x in self.lines])].astype(np.int64)
        self.number = docs.column("block")[0].as_py()
        self.flat = [x for part in self.lines for x in part]

    @cached_property
    def places(self) -> dict[bytes, int]:
        """Where each distinct line is first."""
        return dict(zip(reversed(self.flat), range(len(self.flat) - 1, -1, -1), strict=True))

    @cached_property
    def first(self) -> np.ndarray:
        return np.fromiter(map(self.places.__getitem__, self.flat), np.int64, len(self.flat))

    @cached_property
    def known(self) -> np.ndarray:
        """The distinct lines that are compared."""
        return np.sort(np.fromiter((i for x, i in self.places.items() if _worded(x)), np.int64))

    def docs(self) -> np.ndarray:
        return np.repeat(np.array(self.ids, np.int64), np.diff(self.starts))


_TEXT = ("name", "doc", "line")


def _ask(shards: int):
    """Which lines are the first with their text?"""

    def run(docs: pa.Table) -> pa.Table:
        b = Block(docs)
        name = np.frombuffer(b"".join([xxhash.xxh3_128_digest(b.flat[i]) for i in b.known.tolist()]), "<u8").reshape(-1, 2)
        return blocks.deal(b.number, name[:, 0], shards, _TEXT, name, b.docs()[b.known], b.known.astype("<u4"))

    return run


def _firsts(rows: pa.Table) -> pa.Table:
    """Answers with the lines that are not."""
    s = blocks.Shard(rows, name=np.dtype(("<u8", 2)), doc=np.dtype("<i8"), line=np.dtype("<u4"))
    block = np.array(s.block, np.int64)[s.of]
    order = np.lexsort((s.line, block, s.doc, s.name[:, 1], s.name[:, 0]))
    first = np.ones(len(order), bool)
    first[order[1:][(s.name[order[1:]] == s.name[order[:-1]]).all(axis=1)]] = False
    return s.answers(lambda a, b: s.line[a:b][~first[a:b]].tobytes())


def sets_of(lines: list[bytes], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words of each line in order of rarity (12 bits of code, 40 bits of hash), one line after another, and where each line begins (and the end).  At most LINES lines."""
    h, counts = common.word_hashes(lines, lower=True)
    line = np.repeat(np.arange(len(lines), dtype=np.uint64), counts)
    code = codes[(h & np.uint64(SLOTS - 1)).astype(np.int64)].astype(np.uint64)
    key = np.sort(line << np.uint64(52) | code << np.uint64(40) | h >> np.uint64(24))
    if len(key):
        key = key[np.r_[True, key[1:] != key[:-1]]]
    starts = np.searchsorted(key, np.arange(len(lines) + 1, dtype=np.uint64) << np.uint64(52)) if len(lines) < LINES else np.r_[np.searchsorted(key, np.arange(len(lines), dtype=np.uint64) << np.uint64(52)), len(key)]
    return key & np.uint64((1 << 52) - 1), starts


def _lots(lines: list[bytes]):
    """Bounds of runs of at most LINES lines of about CHUNK bytes."""
    ends = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)))
    at, before = 0, 0
    while at < len(lines):
        end = max(at + 1, min(at + LINES, int(np.searchsorted(ends, before + CHUNK))))
        yield at, end
        at, before = end, int(ends[end - 1])


def pictures(rank: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """128 bits for each set: whether an odd number of its words fall on the bit.  Two pictures differ in no more bits than the sets differ in words."""
    bit, half = np.uint64(1) << (rank & np.uint64(63)), (rank >> np.uint64(6) & np.uint64(1)).astype(bool)
    both = [np.where(half == side, bit, np.uint64(0)) for side in (False, True)]
    return np.stack([np.bitwise_xor.reduceat(x, starts[:-1]) if len(rank) else x for x in both], axis=1)


def _prefixes(sizes: np.ndarray) -> np.ndarray:
    return sizes - np.ceil(SIMILARITY * sizes - 1e-9).astype(np.int64) + 1


def _count(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the sizes."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def keys_of(rank: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, key, place) of each entry of the lines in groups."""
    sizes = np.diff(starts)
    many = np.where(sizes > 3, _prefixes(sizes), 1)
    line, place = np.repeat(np.arange(len(sizes)), many), _count(many)
    key = rank[starts[line] + place]
    small = np.flatnonzero(sizes <= 3)  # each has one entry
    if len(small):
        # Sums of the words' names, taken from a running sum (wrapping) over the words of these lines only.
        own = rank[np.repeat(starts[small], sizes[small]) + _count(sizes[small])]
        ends = np.cumsum(sizes[small])
        sums = np.r_[np.uint64(0), np.cumsum(common.mix(own))]
        whole = sums[ends] - sums[ends - sizes[small]]
        key[(np.cumsum(many) - many)[small]] = common.mix(whole + np.uint64(3)) >> np.uint64(12)
    return line, key, place


_OFFER = ("key", "line", "size", "place", "picture")


def _lines(answers: list[dict]) -> np.ndarray:
    return np.frombuffer(b"".join(a["answer"] for a in answers), "<u4")


def _offer(shared, shards: int):
    """First lines to the groups of their prefix words."""

    def run(docs: pa.Table, found: dict) -> pa.Table:
        b, codes = Block(docs), shared.value
        mine = np.zeros(len(b.flat), bool)
        mine[b.known] = True
        mine[_lines(found["repeats"])] = False
        mine = np.flatnonzero(mine)
        own, out = [b.flat[i] for i in mine.tolist()], []
        for lo, hi in _lots(own):
            rank, starts = sets_of(own[lo:hi], codes)
            line, key, place = keys_of(rank, starts)
            short = lambda x: np.minimum(x, FULL).astype("<u2")
            out.append((key, mine[lo:hi][line].astype("<u4"), short(np.diff(starts)[line]), short(place), pictures(rank, starts)[line]))
        if not out:
            out = [(np.zeros(0, np.uint64), *[np.zeros(0, t) for t in ("<u4", "<u2", "<u2", ("<u8", 2))])]
        key, *rest = (np.concatenate(x) for x in zip(*out, strict=True))
        return blocks.deal(b.number, key, shards, _OFFER, common.small(key, 7), *rest)  # keys have 52 bits

    return run


_ASKED = np.dtype([("key", "<u8"), ("line", "<u4")])


def _may_match(rows: pa.Table) -> pa.Table:
    """Answers with the (key, line) that may have a similar line in the group of the key."""
    s = blocks.Shard(rows, key=np.dtype(("u1", 7)), line=np.dtype("<u4"), size=np.dtype("<u2"), place=np.dtype("<u2"), picture=np.dtype(("<u8", 2)))
    keys = common.large(s.key)
    order = np.lexsort((s.size, keys))
    key, size = keys[order], s.size[order].astype(np.int64)
    rest = size - s.place[order]
    one, other = np.ascontiguousarray(s.picture[order].T)
    n = len(key)
    flagged = np.zeros(n, bool)
    group = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1 if n else np.zeros(0, np.int64)
    unflagged = np.bincount(group)
    # Sizes rise in a group; what is left of a set from its place on bounds the size of the later one, and so where to stop.
    most = np.where(size >= SIMILARITY * FULL - 1e-9, FULL, (rest + 1e-6) * ((1 + SIMILARITY) / SIMILARITY) - size).astype(np.int64)
    last = np.searchsorted(group << 16 | size, group << 16 | np.clip(most, 0, FULL), "right") - 1
    i, d = np.flatnonzero(last > np.arange(n)), 1
    while len(i):
        j = i + d
        both = size[i] + size[j]
        need = np.ceil(SIMILARITY / (1 + SIMILARITY) * both - 1e-9).astype(np.int64)
        fit = np.flatnonzero((rest[j] >= need) | (size[j] == FULL))
        x, y = i[fit], j[fit]
        good = np.bitwise_count(one[x] ^ one[y]).astype(np.int64) + np.bitwise_count(other[x] ^ other[y]) <= (both - 2 * need)[fit]
        good |= size[y] == FULL
        new = np.unique(np.r_[x[good], y[good]])
        new = new[~flagged[new]]
        flagged[new] = True
        np.subtract.at(unflagged, group[new], 1)
        d += 1
        i = i[(last[i] >= i + d) & (unflagged[group[i]] > 0)]  # a group of flagged lines only has nothing left to tell
    found = np.zeros(n, bool)
    found[order] = flagged
    out = np.zeros(n, _ASKED)
    out["key"], out["line"] = keys, s.line
    return s.answers(lambda a, b: out[a:b][found[a:b]].tobytes())


_SHOW = ("key", "doc", "line", "which", "text")


def _show(shards: int):
    """Those lines to the same groups, word for word; a line goes to a shard once, for all its groups there."""

    def run(docs: pa.Table, found: dict) -> pa.Table:
        b = Block(docs)
        asked = np.frombuffer(b"".join(a["answer"] for a in found["offers"]), _ASKED)
        order, bounds = common.split_by(common.mix(asked["key"]), shards)
        lines, doc, rows = asked["line"].astype(np.int64), b.docs(), []
        shown, at = np.unique(lines, return_inverse=True)
        texts = [b" ".join(dict.fromkeys(b.flat[i].lower().split())) for i in shown.tolist()]  # once for all shards
        for s in np.flatnonzero(np.diff(bounds)).tolist():
            o = order[bounds[s] : bounds[s + 1]]
            own, which = np.unique(at[o], return_inverse=True)
            text = b"\n".join([texts[k] for k in own.tolist()])
            rows.append((s, b.number, len(o), *map(blocks.pack, (asked["key"][o], doc[lines[o]], asked["line"][o], which.astype("<u4"))), text))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), nothing.schema, strict=True)], schema=nothing.schema) if rows else nothing

    nothing = blocks.empty(blocks.dealt(*_SHOW))
    return run


def _pieces(texts: pa.Array, mark: str) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts between the marks, and how many each text has."""
    parts = pc.split_pattern(texts, mark)
    return parts.flatten(), pc.list_value_length(parts).to_numpy().astype(np.int64)


def _similar(rows: pa.Table) -> pa.Table:
    """Answers with the lines that have an earlier similar one."""
    s = blocks.Shard(rows, key=np.dtype("<u8"), doc=np.dtype("<i8"), line=np.dtype("<u4"), which=np.dtype("<u4"))
    texts, each = _pieces(rows.column("text").cast(pa.large_binary()).combine_chunks(), "\n")
    text = (np.cumsum(each) - each)[s.of] + s.which  # the set of each entry
    words, sizes = _pieces(texts, " ")
    starts = np.r_[0, np.cumsum(sizes)]
    words = words.dictionary_encode().indices.to_numpy().astype(np.uint64)  # words have numbers by what they are, not by a hash
    order = np.lexsort((s.line, np.array(s.block, np.int64)[s.of], s.doc, s.key))
    key = s.key[order]
    n = len(key)
    gone = np.zeros(n, bool)  # by place in the order
    i, d = np.arange(n), 1
    while len(i):
        i = i[i + d < n]
        i = i[key[i] == key[i + d]]
        todo = i[~gone[i + d]]
        a, b = text[order[todo]], text[order[todo + d]]
        fit = np.minimum(sizes[a], sizes[b]) >= SIMILARITY * np.maximum(sizes[a], sizes[b]) - 1e-9
        todo, a, b = todo[fit], a[fit], b[fit]
        for lo, hi in _bounded(sizes[a] + sizes[b]):
            same, total = _overlap(words, starts, a[lo:hi], b[lo:hi]), sizes[a[lo:hi]] + sizes[b[lo:hi]]
            gone[todo[lo:hi][same >= SIMILARITY * (total - same) - 1e-9] + d] = True
        # A group is done when all but its first line are gone.
        left = np.flatnonzero(~gone)
        last = np.searchsorted(key[left], key[i], "right")
        i = i[left[last - 1] > i + d] if len(left) else i[:0]
        d += 1
    late = np.zeros(n, bool)
    late[order] = gone
    return s.answers(lambda a, b: s.line[a:b][late[a:b]].tobytes())


def _bounded(work: np.ndarray, most: int = 4_000_000):
    """Bounds of runs of about so much work."""
    lot = np.cumsum(work) // most
    cuts = np.r_[0, np.flatnonzero(lot[1:] != lot[:-1]) + 1, len(work)]
    yield from zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if len(work) else ()


def _overlap(words: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words the sets a and b of each pair share."""
    rows = np.r_[a, b]
    n = (starts[rows + 1] - starts[rows]).astype(np.int64)
    pair = np.repeat(np.r_[np.arange(len(a)), np.arange(len(b))], n).astype(np.uint64)
    w = words[np.repeat(starts[rows], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    both = np.sort(pair << np.uint64(40) | w)
    return np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(40)).astype(np.int64), minlength=len(a))


def _remove(docs: pa.Table, found: dict) -> pa.Table:
    b = Block(docs)
    gone = b.first != np.arange(len(b.flat))  # equal to an earlier line of the block, or to one that goes
    worded = np.zeros(len(b.flat), bool)
    worded[b.known] = True
    gone &= worded[b.first]
    first = np.zeros(len(b.flat), bool)
    first[_lines(found["repeats"])] = True
    first[_lines(found["similar"])] = True
    gone |= first[b.first]
    removed, kept = [], []
    for t, lines, s in zip(b.texts, b.lines, b.starts.tolist(), strict=False):
        g = gone[s : s + len(lines)]
        removed.append(int(g.sum()))
        kept.append(b"\n".join(x for x, y in zip(lines, g.tolist(), strict=True) if not y) if removed[-1] else t)
    rest = {"rest": docs.column("rest").take(pa.array(b.rows, pa.int64()))} if "rest" in docs.column_names else {}
    return pa.table({"doc_id": blocks.shown_ids(b.ids), "n_lines": pa.array([len(x) for x in b.lines], pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary())} | rest)


def dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES, rest: list[str] | None = None) -> DataFrame:
    """doc_id, n_lines, n_removed, kept (the remaining lines, UTF-8); ``rest``: columns to carry along in a struct of that name."""
    common.prepare(docs.sparkSession)
    count = common.blocks_for(docs, each=block_bytes)
    shards = -(-count // 4)
    codes = docs.sparkSession.sparkContext.broadcast(rarity(docs))
    texts = common.blocked(docs, count, rest)
    repeats = common.grouped(common.grouped(texts, "block", _ask(shards), blocks.dealt(*_TEXT)), "shard", _firsts, blocks.ANSWER)
    offered = blocks.together(texts, count, {"repeats": repeats}, _offer(codes, shards), blocks.dealt(*_OFFER))
    offers = common.grouped(offered, "shard", _may_match, blocks.ANSWER)
    shown = blocks.together(texts, count, {"offers": offers}, _show(shards), blocks.dealt(*_SHOW))
    similar = common.grouped(shown, "shard", _similar, blocks.ANSWER)
    kept = KEPT + (f", rest {docs.select(F.struct(*[F.col(f'`{c}`') for c in rest]).alias('s')).schema['s'].dataType.simpleString()}" if rest else "")
    return blocks.together(texts, count, {"repeats": repeats, "similar": similar}, _remove, kept)


def clean(docs: DataFrame) -> DataFrame:
    """The documents without those lines, their other columns as they are but for n_chars; a document that has lost all its words goes."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = dedup(docs, rest=rest).filter((F.col("n_removed") == 0) | F.col("kept").cast("string").rlike("[^ \t-\r]"))
    text = F.col("kept").cast("string")
    other = {c: F.col(f"rest.`{c}`") for c in rest}
    if "n_chars" in other:
        other["n_chars"] = F.when(F.col("n_removed") > 0, F.length(text)).otherwise(other["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return found.select([{"doc_id": F.col("doc_id"), "text": text, **other}[c].alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op3_lines": query}
ORACLES = {
    "op3_lines": r"""WITH l AS (SELECT doc_id, unnest(t) line, generate_subscripts(t, 1) i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) t FROM documents)),
k AS (SELECT doc_id, i, line, doc_id * 1000000 + i AS place, list_sort(list_distinct(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'))) s FROM l),
f AS (SELECT *, row_number() OVER (ORDER BY first) id FROM (SELECT s, len(s) n, min(place) first FROM k WHERE len(s) > 0 GROUP BY s)),
w AS (SELECT id, n, unnest(s) word FROM f),
d AS (SELECT word, count(*) df FROM w GROUP BY 1),
r AS (SELECT id, n, word, row_number() OVER (PARTITION BY id ORDER BY df, word) rank FROM w JOIN d USING (word)),
p AS (SELECT id, n, word FROM r WHERE rank <= n - ceil(0.8 * n - 1e-9) + 1),
c AS (SELECT DISTINCT a.id x, b.id y FROM p a JOIN p b ON b.word = a.word AND b.id < a.id WHERE a.n >= 0.8 * b.n - 1e-9 AND b.n >= 0.8 * a.n - 1e-9),
v AS (SELECT x, y FROM c JOIN w a ON a.id = x JOIN w b ON b.id = y AND b.word = a.word GROUP BY x, y, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9),
-- Sets are numbered by their first line, so a lesser number is an earlier line.
e AS (SELECT f.s, f.first, count(y) > 0 late FROM f LEFT JOIN v ON x = id GROUP BY ALL),
g AS (SELECT doc_id, i, line, coalesce(late OR first < place, false) gone FROM k LEFT JOIN e ON e.s = k.s)
SELECT doc_id, count(*) n_lines, sum(gone::INT)::BIGINT n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) kept_sha256 FROM g GROUP BY 1"""
}
