"""Removal of repeated passages by recompression.

Every word is covered that lies in a window of ``WINDOW`` consecutive words whose sequence also
starts in a document with a smaller doc_id; covered words go.  Windows are judged on the input.

Recompression rewrites the words of a document in rounds.  In each round a run of equal symbols is
taken together, then neighbours (a, b) where a coin of a says 0 and that of b says 1; what was
taken together gets a name.  Spark gives the names: every block asks for its distinct runs and
pairs, the shard that is responsible for one sees all blocks that have it and numbers it, so equal
strings have the same symbols inside in all documents.  What only one document has gets the name
0 and is taken together with nothing any more: no window around it can be repeated.  With each
symbol goes the span of words that fixed it; equal windows have equal symbols where the span lies
inside them.  Symbols carried on are the alphabet of the next round, up to ROUNDS; further ones
would be fixed by more words than a window has.

A window is known by one of the last round's symbols that are fixed inside it (or by itself where
there is none, as in one long run); it is left alone if one of them has the name 0.  Blocks ask
which of these keys two documents share; for these they show the words around the symbol, all
windows of it at once and equal surroundings once a block, and windows are compared word by word.
A key that more than ``HOT`` blocks have is split: its windows go to shards one by one.

The alphabet of the first round are 39 bits of a hash of each word.  Words that collide there would
share symbols, and are told apart when windows are compared.

Defined cases: a null text has no words; null doc_ids come after all others, so that such a
document loses what any other has and takes nothing from another null; rows of the same doc_id
don't cover each other; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, common

WINDOW, ROUNDS = 13, 2
HOT = 1_000
#: Smaller blocks than elsewhere: the symbols of all rounds are held at once.
BLOCK_BYTES = 4_000_000
KEPT = "doc_id long, n_words long, n_removed long, kept binary"
WORD = np.uint64(1) << np.uint64(39)  # names of words lie from here on, others below
LONGEST = 254  # of a run; longer ones are cut
LOT = 1 << 18  # windows that are compared at a time


class Symbols:
    """name, start and end (in words), and the span [low, high) of words that fixes each symbol."""

    def __init__(self, name: np.ndarray, doc: np.ndarray):
        self.name, self.doc = name, doc
        self.start = np.arange(len(name))
        self.end = self.start + 1
        self.low, self.high = self.start, self.end

    def _around(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether a neighbour to the right is in the same document; how far left and right one reaches by looking at a neighbour (past the document where there is none)."""
        same = self.doc[1:] == self.doc[:-1]
        left = np.r_[-1, np.where(same, self.low[:-1], self.start[1:] - 1)]
        right = np.r_[np.where(same, self.high[1:], self.end[:-1] + 1), self.end[-1] + 1]
        return same, left, right

    def rewrite(self, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A round: takes runs and then pairs together.  Which symbols want a name, and what each stands for: name and length of its first run, and of its second (0 if there is none)."""
        if not len(self.name):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        same, left, right = self._around()
        new = np.r_[True, (self.name[1:] != self.name[:-1]) | ~same | (self.name[1:] == 0)]
        first = np.flatnonzero(new)
        place = np.arange(len(new)) - np.repeat(first, np.diff(np.r_[first, len(new)]))
        first = np.flatnonzero(place % LONGEST == 0)
        many = np.diff(np.r_[first, len(new)])
        last = first + many - 1
        # Where a long run is cut depends on where it begins, however far that is.
        self.low, self.high = np.where(place[first] > 0, -1, np.minimum(self.low[first], left[first])), np.maximum(self.high[last], right[last])
        self.start, self.end, self.doc, self.name = self.start[first], self.end[last], self.doc[first], self.name[first]
        run = self.name | many.astype(np.uint64) << np.uint64(40)
        same, left, right = self._around()
        alive = self.name > 0
        coin = (common.mix(run + np.uint64(number + 2)) & np.uint64(1)).astype(bool)
        pair = same & ~coin[:-1] & coin[1:] & alive[:-1] & alive[1:]
        begins, ends = np.r_[pair, False], np.r_[False, pair]
        # A symbol that stays alone is fixed by the neighbour that it could have been joined with.
        low = np.where(coin & ~ends, np.minimum(self.low, left), self.low)
        high = np.where(~coin & ~begins, np.maximum(self.high, right), self.high)
        at = np.flatnonzero(begins)
        end = self.end.copy()
        end[at], high[at], low[at] = self.end[at + 1], np.maximum(self.high[at], self.high[at + 1]), np.minimum(self.low[at], self.low[at + 1])
        keep = ~ends
        wanted = (begins | (many > 1)) & alive & keep
        which = np.flatnonzero(wanted)
        second = np.where(begins[which], run[np.minimum(which + 1, len(run) - 1)], np.uint64(0))
        where = np.cumsum(keep) - 1
        self.name, self.start, self.end, self.low, self.high, self.doc = self.name[keep], self.start[keep], end[keep], low[keep], high[keep], self.doc[keep]
        return where[which], run[which], second


_POWER = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(words: np.ndarray, window: int) -> np.ndarray:
    n = max(0, len(words) - window + 1)
    out = np.zeros(n, np.uint64)
    for k in range(window):
        out = (out + words[k : k + n]) * _POWER
    return common.mix(out)


def anchors(s: Symbols, words: np.ndarray, doc: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Start of each window that may be repeated, and the key that it is known by."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = (s.high - s.low <= window) & (s.low >= 0) & (s.high <= len(words))
    low, high, name = s.low[inside], s.high[inside], s.name[inside]
    # The name together with the words that fix it says more than the name alone.
    total = np.r_[np.uint64(0), np.cumsum(common.mix(words))]
    key = common.combine(name, total[high] - total[low], 91)
    place = np.arange(n)
    first, last = np.searchsorted(low, place, "left"), np.searchsorted(high, place + window, "right")  # spans rise from symbol to symbol
    dead = np.r_[0, np.cumsum(name == 0)]
    may = (doc[:n] == doc[window - 1 :]) & ((last <= first) | (dead[np.maximum(last, first)] == dead[first]))
    at = np.flatnonzero(may)
    first, last = first[at], last[at]
    best = np.full(len(at), np.iinfo(np.uint64).max)
    key = np.r_[key, np.iinfo(np.uint64).max]
    which, step = np.flatnonzero(first < last), 0
    while len(which):
        best[which] = np.minimum(best[which], key[first[which] + step])
        step += 1
        which = which[first[which] + step < last[which]]
    alone = first >= last
    best[alone] = common.mix(window_hashes(words, window)[at[alone]] + np.uint64(5))
    return at, best


class Block:
    """The words of a block's documents, and how they are rewritten by the names given so far."""

    def __init__(self, docs: pa.Table, window: int):
        self.ids, self.texts, _ = blocks.in_order(docs)
        self.number, self.window = docs.column("block")[0].as_py(), window
        self.hashes, counts = common.word_hashes(self.texts)
        self.starts = np.r_[0, np.cumsum(counts)].astype(np.int64)
        self.place = np.repeat(np.arange(len(self.ids)), counts)
        self.owner = np.array(self.ids, np.int64)

    def rewritten(self, found: dict, shards: int, rounds: int, wish: bool = False):
        """The symbols after so many rounds, whose names were found; with ``wish`` also what wants a name in the round after: distinct (first, second), and whether two documents have them."""
        s = Symbols(self.hashes >> np.uint64(25) | WORD, self.place)
        for r in range(rounds + wish):
            at, first, second = s.rewrite(r)
            of, head, many = common.classes(np.c_[first, second], self.owner[s.doc[at]])
            first, second = first[head], second[head]
            route = common.combine(first, second, r)
            if r == rounds:
                return route, first, second, many
            names = common.large(blocks.read(found[f"round{r}"], route, shards, np.dtype(("u1", 5))))
            s.name = s.name.copy()
            s.name[at] = names[of]
        return s

    def windows(self, found: dict, shards: int, rounds: int):
        """Runs of windows of a document that are known by the same key: first window, how many, the key; and of the distinct keys which each has, and whether two documents have it."""
        at, key = anchors(self.rewritten(found, shards, rounds), self.hashes, self.place, self.window)
        new = np.r_[True, (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1) | (self.place[at[1:]] != self.place[at[:-1]])] if len(at) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        self.first, self.many, self.key = at[head], np.diff(np.r_[head, len(at)]), key[head]
        self.doc = self.owner[self.place[self.first]] if len(head) else np.zeros(0, np.int64)
        of, one, several = common.classes(self.key[:, None], self.doc)
        return of, self.key[one], several

    def words(self) -> list[bytes]:
        return [w for t in self.texts for w in t.split()]


def _wish(window: int, shards: int, rounds: int):
    """What wants a name in the round after ``rounds`` ones."""

    def run(docs: pa.Table, found: dict | None = None) -> pa.Table:
        b = Block(docs, window)
        route, first, second, many = b.rewritten(found or {}, shards, rounds, wish=True)
        length = lambda x: (x >> np.uint64(40)).astype("u1")
        return blocks.deal(b.number, route, shards, _WISH, common.small(first, 5), common.small(second, 5), length(first), length(second), many)

    return run


_WISH = ("first", "second", "length", "length2", "many")


def _name(shards: int, rounds: int, number: int):
    """Numbers what was asked for: 0 for what one document has, else a number that nothing else has, in any shard or round."""

    def run(rows: pa.Table) -> pa.Table:
        five = np.dtype(("u1", 5))
        s = blocks.Shard(rows, first=five, second=five, length="u1", length2="u1", many=bool)
        lanes = np.c_[common.large(s.first) | s.length.astype(np.uint64) << np.uint64(40), common.large(s.second) | s.length2.astype(np.uint64) << np.uint64(40)]
        # An entry that two documents of a block have counts as two blocks.
        of, head, several = common.classes(lanes, s.of)
        several = several | (np.bincount(of, s.many, len(head)) > 0)
        name = ((np.cumsum(several) - 1) * shards + rows.column("shard")[0].as_py()) * rounds + number + 1
        if len(name) and name.max() >= 1 << 39:
            raise OverflowError("more names than 39 bits can tell")
        names = np.where(several, name, 0).astype(np.uint64)[of]
        return s.answers(lambda a, b: blocks.pack(common.small(names[a:b], 5)) if names[a:b].any() else b"")

    return run


def _ask(window: int, shards: int, rounds: int):
    def run(docs: pa.Table, found: dict) -> pa.Table:
        b = Block(docs, window)
        _, keys, several = b.windows(found, shards, rounds)
        return blocks.deal(b.number, keys, shards, blocks.NAMED, common.small(keys, 6), several)

    return run


_SHOWN = ("around", "doc", "state")


def _show(window: int, shards: int, rounds: int):
    """The words around the keys that are shared, and for the block itself where they stand."""

    def run(docs: pa.Table, found: dict) -> pa.Table:
        b = Block(docs, window)
        of, keys, _ = b.windows(found, shards, rounds)
        told = blocks.read(found["asked"], keys, shards, np.uint8)[of]
        open_ = np.flatnonzero(told)
        if not len(open_):
            return blocks.deal(b.number, np.zeros(0, np.uint64), shards, _SHOWN, [], np.zeros(0, np.int64), np.zeros(0, np.uint8))
        hot = told[open_] == 2
        first, many, key, doc = (np.r_[x[open_][~hot], y] for x, y in _split(b, open_[hot]))
        words = b.words()
        around = [b" ".join(words[a : a + n + window - 1]) for a, n in zip(first.tolist(), many.tolist(), strict=True)]
        known: dict[bytes, int] = {}
        entry = np.fromiter((known.setdefault(x, len(known)) for x in around), np.int64, len(around))
        least = np.full(len(known), np.iinfo(np.int64).max)
        np.minimum.at(least, entry, doc)
        head = np.zeros(len(known), np.int64)
        head[entry] = np.arange(len(entry))
        dealt = blocks.deal(b.number, key[head], shards, _SHOWN, list(known), least, np.zeros(len(known), np.uint8))
        # The state goes with the entries to a shard that sends it back as it is.
        state = _state(first, many, entry, doc == least[entry]), blocks.pack(common.shard_of(key[head], shards))
        own = pa.table([[b.number % shards] * 2, [b.number] * 2, [0, -1], [b""] * 2, [b""] * 2, list(state)], schema=dealt.schema)
        return pa.concat_tables([dealt, own])

    return run


def _split(b: Block, hot: np.ndarray):
    """The columns of runs, and what the runs of ``hot`` keys are as windows one by one."""
    many = b.many[hot]
    first = np.repeat(b.first[hot], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    key = common.mix(window_hashes(b.hashes, b.window)[first] + np.uint64(7)) if len(first) else np.zeros(0, np.uint64)
    return (b.first, first), (b.many, np.ones(len(first), np.int64)), (b.key, key), (b.doc, np.repeat(b.doc[hot], many))


STATE, ROUTE = -1, -2  # instead of a shard


def _state(first: np.ndarray, many: np.ndarray, entry: np.ndarray, least: np.ndarray) -> bytes:
    """Runs of windows: first window and how many, which entry they are, and whether their document is the entry's least one.  Differences are small numbers, which compress."""
    step = lambda x: np.diff(x.astype("<u4"), prepend=np.uint32(0))
    return b"".join([*map(blocks.pack, (step(first), many.astype("<u4"), step(entry))), least.astype("u1").tobytes()])


def _runs(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(raw) // 13
    first, many, entry = (blocks.unpack(raw[4 * n * k : 4 * n * (k + 1)], n, "<u4") for k in range(3))
    whole = lambda x: np.cumsum(x, dtype=np.uint32).astype(np.int64)
    return whole(first), many.astype(np.int64), whole(entry), np.frombuffer(raw, np.uint8, n, 12 * n)


def _covered(window: int):
    """Answers a bit for each window shown: whether a document before the block's first with it has it."""

    def run(rows: pa.Table) -> pa.Table:
        n = rows.column("n").to_numpy()
        back = [(b, STATE if k == 0 else ROUTE, x) for b, k, x in zip(*(rows.filter(pa.array(n <= 0)).column(c).to_pylist() for c in ("block", "n", "state")), strict=True)]
        rows = rows.filter(pa.array(n > 0))
        if not rows.num_rows:
            return blocks.answer_table(back)
        s = blocks.Shard(rows, around=bytes, doc=np.dtype("<i8"))
        names: dict[bytes, int] = {}
        split = [x.split() for x in s.around]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        words = np.fromiter((names.setdefault(w, len(names)) for x in split for w in x), np.uint64)
        del split
        many = sizes - window + 1
        of = np.repeat(np.arange(len(sizes)), many)
        at = np.repeat(np.cumsum(sizes) - sizes, many) + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        late = _late(words, at, s.doc[of], window)
        ends = np.r_[0, np.cumsum(many)][s.bounds]
        found = ((b, k, np.packbits(late[lo:hi]).tobytes()) for b, k, lo, hi in zip(s.block, s.shard, ends[:-1].tolist(), ends[1:].tolist(), strict=True) if late[lo:hi].any())
        return blocks.answer_table([*back, *found])

    return run


def _late(words: np.ndarray, at: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """Whether an equal window has a lesser document; windows are compared word by word, those of one hash at a time."""
    h = window_hashes(words, window)[at]
    order = np.argsort(h)
    heads = np.flatnonzero(np.r_[True, h[order[1:]] != h[order[:-1]]]) if len(order) else order
    late, lo = np.zeros(len(at), bool), 0
    while lo < len(order):
        k = int(np.searchsorted(heads, lo + LOT))
        hi = int(heads[k]) if k < len(heads) else len(order)
        part, lo = order[lo:hi], hi
        lanes = np.stack([words[at[part] + k] for k in range(window)], axis=1)
        of, head, _ = common.classes(lanes, doc[part])
        late[part] = doc[part[head]][of] < doc[part]
    return late


def _remove(window: int, shards: int):
    def run(docs: pa.Table, found: dict) -> pa.Table:
        ids, texts, _ = blocks.in_order(docs)
        split = [t.split() for t in texts]
        starts = np.r_[0, np.cumsum([len(w) for w in split])].astype(np.int64)
        depth = np.zeros(starts[-1] + 1, np.int32)
        for first in _gone(found["covered"], shards):
            np.add.at(depth, first, 1)
            np.add.at(depth, first + window, -1)
        keep = np.cumsum(depth[:-1]) == 0
        removed = np.diff(np.r_[0, np.cumsum(~keep)][starts])
        kept = [b" ".join(words if not n else [w for w, k in zip(words, keep[s : s + len(words)].tolist(), strict=True) if k]) for words, s, n in zip(split, starts.tolist(), removed.tolist(), strict=False)]
        return pa.table({"doc_id": blocks.shown_ids(ids), "n_words": pa.array(np.diff(starts), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary())})

    return run


def _gone(answers: list[dict], shards: int):
    """First words of the windows that go, in lots."""
    own = {a["shard"]: a["answer"] for a in answers if a["shard"] < 0}
    if not own:
        return
    first, windows, of, least = _runs(own[STATE])
    shard = blocks.unpack(own[ROUTE], len(own[ROUTE]) // 4, "<u4")
    many = np.zeros(len(shard), np.int64)
    many[of] = windows
    order = np.argsort(shard, kind="stable")
    bounds = np.searchsorted(shard[order], np.arange(shards + 1))
    bits = np.zeros(int(many.sum()), bool)
    begin = np.cumsum(many) - many
    for a in answers:
        if a["shard"] >= 0:
            entry = order[bounds[a["shard"]] : bounds[a["shard"] + 1]]
            n = many[entry]
            where = np.repeat(begin[entry], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            bits[where] = np.unpackbits(np.frombuffer(a["answer"], np.uint8), count=len(where)).astype(bool)
    for lo in range(0, len(first), LOT):
        part = slice(lo, lo + LOT)
        n = windows[part]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        # The block's first document with these words loses what came before it, the others lose all.
        gone = np.repeat(least[part] == 0, n) | bits[np.repeat(begin[of[part]], n) + step]
        yield (np.repeat(first[part], n) + step)[gone]


def remove(docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, rounds: int = ROUNDS, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the remaining words joined by blanks, UTF-8)."""
    common.prepare(docs.sparkSession)
    count = common.blocks_for(docs, each=block_bytes)
    shards = count
    texts = common.blocked(docs, count)
    names: dict[str, DataFrame] = {}
    for r in range(rounds):
        wish = _wish(window, shards, r)
        asked = blocks.together(texts, count, names, wish, blocks.dealt(*_WISH)) if names else common.grouped(texts, "block", wish, blocks.dealt(*_WISH))
        names = names | {f"round{r}": common.grouped(asked, "shard", _name(shards, rounds, r), blocks.ANSWER)}
    asked = common.grouped(blocks.together(texts, count, names, _ask(window, shards, rounds), blocks.dealt(*blocks.NAMED)), "shard", blocks.shared(hot), blocks.ANSWER)
    shown = blocks.together(texts, count, names | {"asked": asked}, _show(window, shards, rounds), blocks.dealt(*_SHOWN))
    covered = common.grouped(shown, "shard", _covered(window), blocks.ANSWER)
    return blocks.together(texts, count, {"covered": covered}, _remove(window, shards), KEPT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(common.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op2_recompression": query}
ORACLES = {
    "op2_recompression": r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws FROM documents),
p AS (SELECT doc_id, unnest(ws) word, generate_subscripts(ws, 1) i FROM w),
g AS (SELECT *, string_agg(word, ' ') OVER n gram, count(*) OVER n size FROM p WINDOW n AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
f AS (SELECT gram, min(doc_id) least FROM g WHERE size = 13 GROUP BY 1),
c AS (SELECT g.doc_id, g.i, g.word, max(CASE WHEN size = 13 AND least < g.doc_id THEN 1 ELSE 0 END) OVER (PARTITION BY g.doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) gone FROM g LEFT JOIN f ON f.gram = g.gram AND size = 13),
d AS (SELECT doc_id, count(*) n, sum(gone)::BIGINT r, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) kept FROM c GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT n_words, coalesce(r, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 FROM w LEFT JOIN d ON d.doc_id = w.doc_id"""
}
