"""SimHash fingerprints and near-duplicate groups found with BK-trees.

``fingerprints`` takes the majority of each bit over the XXH64 (seed 42) of all word shingles of a
text.  ``link`` joins fingerprints that differ in at most ``RADIUS`` bits.  Equal fingerprints are
one vertex.  The 64 bits are cut in BANDS bands; two fingerprints within the radius agree on at
least BANDS - RADIUS of them, so the fingerprints of a shard are those that share such a choice of
bands, and each shard has a BK-tree: children hang at their integer Hamming distance to the parent
and a search follows only the edges within the radius.  A shard's tree goes to the one task that
searches it and not to all workers, as together the trees grow with the corpus and have no bound.
A search leaves out subtrees that the query is joined with already, so a dense group costs no
square of its size; what leaves a shard is a star for each of its groups, never all pairs.

``clean`` keeps one document of each group of near-duplicates: documents are linked if their sets
of NEAR_WORDS-word shingles have a Jaccard similarity of SIMILARITY.  A vertex is a distinct set of
shingles, and its NEAR_SEEDS independent fingerprints are of the distinct shingles, so a line that
is repeated over and over decides no more bits than another.  At 0.8 two fingerprints differ in about
10 of 64 bits (3 more or less).  Candidates are those within NEAR_RADIUS bits in the tree of one of
the NEAR_BANDS bands of one of the fingerprints; a tree offers a minimum spanning forest of what it
has within the radius, so a group costs as many candidates as it has members in a tree, not their
square.  A candidate whose fingerprints differ in more than NEAR_SHARE of all bits is dropped, the
others are verified on the shingles of the whole texts, and only verified links make groups: equal
fingerprints alone link nothing.  A link is lost where no tree has both (about 3 of 1,000 links at
just 0.8, and more of those of very short texts), or where in all trees that have them the two are
joined by closer pairs of which one fails.

Defined cases: a text that is null or has no word has fingerprint zero and is linked like any
other; a text of fewer words than a shingle is one shingle; null doc_ids take part but are no
component_id (null if a component has no other); repeated rows are equal copies; rows of one doc_id
with unlike texts are linked with what their texts are like, not with each other; an empty table
gives no rows; further columns are ignored, and ``clean`` keeps them as they are, whatever they are
called or hold.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

SEED, WORDS, RADIUS, BANDS = 42, 4, 4, 6
#: Of near-duplicates: words of a shingle, similarity, and what finds the candidates.
NEAR_WORDS, SIMILARITY = 5, 0.8
NEAR_RADIUS, NEAR_BANDS, NEAR_SEEDS, NEAR_SHARE = 16, 4, 21, 0.27
#: Fingerprints that a shard holds on average.
SHARD_ROWS = 300_000
STEP = 200_000  # queries at a time


def hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """XXH64 of each shingle of a text, which is lower-cased (A-Z) here."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(found) - words + 1)
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)]), ">u8").astype(np.uint64)


def majority(found: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    n = len(found)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 4096):
        part = found[k : k + 4096].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big") if n else 0


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Unsigned."""
    return majority(hashes(text, words))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""
    common.prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in common.column_bytes(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def masks(radius: int = RADIUS, bands: int = BANDS) -> list[int]:
    cuts = [round(64 * i / bands) for i in range(bands + 1)]
    band = [(1 << b) - (1 << a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return [sum(x) for x in combinations(band, bands - radius)]


class Forest:
    """BK-trees over ``fp``, one for each value of ``key`` (which must be sorted)."""

    def __init__(self, key: np.ndarray, fp: np.ndarray, radius: int):
        n = len(fp)
        self.fp, self.radius = fp, radius
        self.parent, self.edge, self.levels, links = np.full(n, -1), np.zeros(n, np.int64), [], []
        rest = np.arange(n)  # in the order of their subtree
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if n else rest
        at = np.repeat(first, np.diff(np.r_[first, n]))  # the node that each of the rest has come to
        self.root = at.copy()
        self.levels.append(first)
        inner = np.ones(n, bool)
        inner[first] = False
        rest, at = rest[inner], at[inner]
        while len(rest):
            d = np.bitwise_count(fp[rest] ^ fp[at]).astype(np.int64)
            links.append(np.c_[rest, at][d <= radius])
            slot = at * 65 + d
            order = np.argsort(slot, kind="stable")
            rest, slot = rest[order], slot[order]
            first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
            node = rest[first]
            self.parent[node], self.edge[node] = slot[first] // 65, slot[first] % 65
            self.levels.append(node)
            at = np.repeat(node, np.diff(np.r_[first, len(rest)]))
            inner = np.ones(len(rest), bool)
            inner[first] = False
            rest, at = rest[inner], at[inner]
        self.links = np.concatenate(links) if links else np.zeros((0, 2), np.int64)
        child = np.flatnonzero(self.parent >= 0)
        slot = self.parent[child] * 65 + self.edge[child]
        order = np.argsort(slot, kind="stable")
        self.child, self.slot = child[order], slot[order]

    def groups(self) -> np.ndarray:
        """The least index of what each fingerprint is linked with, directly or by others of its tree."""
        n = len(self.fp)
        label = merged(n, self.links)
        low, high = label.copy(), label.copy()  # over whole subtrees
        for nodes in self.levels[:0:-1]:
            np.minimum.at(low, self.parent[nodes], low[nodes])
            np.maximum.at(high, self.parent[nodes], high[nodes])
        found = [self.links]
        for a in range(0, n, STEP):
            query = np.arange(a, min(n, a + STEP))
            node = self.root[query]
            while len(query):
                open_ = (low[node] != label[query]) | (high[node] != label[query])
                query, node = query[open_], node[open_]
                d = np.bitwise_count(self.fp[query] ^ self.fp[node]).astype(np.int64)
                near = d <= self.radius
                found.append(np.c_[query, node][near])
                lo = np.searchsorted(self.slot, node * 65 + np.maximum(d - self.radius, 0), "left")
                hi = np.searchsorted(self.slot, node * 65 + np.minimum(d + self.radius, 64), "right")
                many = hi - lo
                query = np.repeat(query, many)
                node = self.child[np.repeat(lo, many) + np.arange(len(query)) - np.repeat(np.cumsum(many) - many, many)]
        return merged(n, np.concatenate(found))


    def spanning(self) -> np.ndarray:
        """Pairs within the radius that join all that are joined by any: the closest first, as many as there are places less groups."""
        n = len(self.fp)
        label, out = np.arange(n), []
        whole = self.radius
        for r in sorted({*range(0, whole, 4), whole}):
            self.radius = r
            # Until nothing new is found: what a wave finds is taken only where it joins two groups.
            found = self._pairs(label, r)
            if not len(found):
                continue
            d = np.bitwise_count(self.fp[found[:, 0]] ^ self.fp[found[:, 1]])
            found = found[np.argsort(d, kind="stable")]
            taken = kruskal(label, found)
            out.append(taken)
            label = merged(n, np.concatenate(out))
        self.radius = whole
        return np.concatenate(out) if out else np.zeros((0, 2), np.int64)

    def _pairs(self, label: np.ndarray, radius: int) -> np.ndarray:
        """Pairs within the radius of different labels."""
        n = len(self.fp)
        low, high = label.copy(), label.copy()  # over whole subtrees
        for nodes in self.levels[:0:-1]:
            np.minimum.at(low, self.parent[nodes], low[nodes])
            np.maximum.at(high, self.parent[nodes], high[nodes])
        out = []
        for a in range(0, n, STEP):
            query = np.arange(a, min(n, a + STEP))
            node = self.root[query]
            while len(query):
                open_ = (low[node] != label[query]) | (high[node] != label[query])
                query, node = query[open_], node[open_]
                d = np.bitwise_count(self.fp[query] ^ self.fp[node]).astype(np.int64)
                near = (d <= radius) & (label[query] != label[node]) & (query > node)
                if near.any():
                    # Of those of a query the closest one to each group.
                    out.append(closest(query[near], node[near], d[near], label))
                lo = np.searchsorted(self.slot, node * 65 + np.maximum(d - radius, 0), "left")
                hi = np.searchsorted(self.slot, node * 65 + np.minimum(d + radius, 64), "right")
                many = hi - lo
                query = np.repeat(query, many)
                node = self.child[np.repeat(lo, many) + np.arange(len(query)) - np.repeat(np.cumsum(many) - many, many)]
        return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def closest(query: np.ndarray, node: np.ndarray, d: np.ndarray, label: np.ndarray) -> np.ndarray:
    order = np.lexsort((d, label[node], query))
    q, g = query[order], label[node[order]]
    return np.c_[query, node][order[np.r_[True, (q[1:] != q[:-1]) | (g[1:] != g[:-1])]]]


def kruskal(label: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Of these pairs, in this order, those that join two groups."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while x in up:
            if up[x] in up:
                up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for a, b in pairs.tolist():
        x, y = top(int(label[a])), top(int(label[b]))
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append((a, b))
    return np.array(out, np.int64).reshape(-1, 2)


def merged(n: int, pairs: np.ndarray) -> np.ndarray:
    """Labels of connected components: the least index of each."""
    label = np.arange(n)
    while len(pairs):
        a, b = label[pairs[:, 0]], label[pairs[:, 1]]
        pairs = pairs[a != b]
        a, b = label[pairs[:, 0]], label[pairs[:, 1]]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def _deal(shards: int, chosen: list[tuple[str, int]]):
    """Entries of each choice (a fingerprint's column, the bits that a tree agrees on)."""

    def run(batches):
        for batch in batches:
            vertex = batch.column("vertex").to_numpy()
            rows = []
            for c, (column, mask) in enumerate(chosen):
                fp = batch.column(column).to_numpy().view(np.uint64)
                order, bounds = common.split_by(common.mix((fp & np.uint64(mask)) + np.uint64(c)), shards)
                f, v = fp[order], vertex[order]
                rows += [(s, c, f[a:b].tobytes(), v[a:b].tobytes()) for s, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)) if b > a]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["shard", "choice", "fps", "vertices"])

    return run


def _search(radius: int, chosen: list[tuple[str, int]], forest: bool = False):
    def run(rows: pa.Table) -> pa.Table:
        u, v = [], []
        choice = rows.column("choice").to_numpy() if rows.num_rows else np.zeros(0, np.int32)
        for c in np.unique(choice).tolist():
            part = rows.filter(pa.array(choice == c))
            fp = np.frombuffer(b"".join(part.column("fps").to_pylist()), np.uint64)
            vertex = np.frombuffer(b"".join(part.column("vertices").to_pylist()), np.int64)
            key = fp & np.uint64(chosen[c][1])
            order = np.lexsort((vertex, key))
            key, fp, vertex = key[order], fp[order], vertex[order]
            same = np.zeros(len(key), bool)  # a tree of one has no links
            same[1:] = key[1:] == key[:-1]
            same[:-1] |= same[1:]
            key, fp, vertex = key[same], fp[same], vertex[same]
            trees = Forest(key, fp, radius)
            if forest:
                pairs = trees.spanning()
            else:
                label = trees.groups()
                joined = np.flatnonzero(label != np.arange(len(label)))
                pairs = np.c_[joined, label[joined]]
            u.append(vertex[pairs[:, 0]])
            v.append(vertex[pairs[:, 1]])
        return pa.table({"u": np.concatenate([*u, np.zeros(0, np.int64)]), "v": np.concatenate([*v, np.zeros(0, np.int64)])})

    return run


def search(vertices: DataFrame, columns: list[str], key: str, radius: int, bands: int, agree: int, shard_rows: int, forest: bool = False) -> DataFrame:
    """Links (u, v: values of ``key``) among vertices by any of their fingerprints ``columns``."""
    chosen = [(c, m) for c in columns for m in masks(bands - agree, bands)]
    shards = max(1, -(-vertices.count() * len(chosen) // shard_rows))
    dealt = vertices.select(*columns, F.col(key).alias("vertex")).mapInArrow(_deal(shards, chosen), "shard int, choice int, fps binary, vertices binary")
    return common.grouped(dealt, "shard", _search(radius, chosen, forest), "u long, v long")


def joined(vertices: DataFrame, edges: DataFrame, key: str = "fp") -> DataFrame:
    """One row (key, group: the least key linked with it, component_id) for each of ``vertices`` (key, least: the least doc_id that has it): the least doc_id of all that it is linked with.

    Components are of keys; whose doc_ids they have is looked up afterwards, so rows of one doc_id link nothing."""
    roots = common.cut(components(edges), "roots")  # of all but the roots themselves
    own = roots.select("root").distinct().select(F.col("root").alias("vertex"), "root")
    member = roots.unionByName(own)
    least = member.join(vertices.select(F.col(key).alias("vertex"), "least"), "vertex").groupBy("root").agg(F.min("least").alias("component_id"))
    found = member.join(least, "root").select(F.col("vertex").alias(key), "root", "component_id")
    out = vertices.join(found, key, "left")
    return common.cut(out.select(key, F.coalesce("root", key).alias("group"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id")), "components")


def link(prints: DataFrame, radius: int = RADIUS, bands: int = BANDS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """prints: doc_id, fp.  One row (fp, component_id) for each fingerprint; exact, as two fingerprints within the radius agree on bands - radius bands."""
    vertices = common.cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "vertices")
    return joined(vertices, search(vertices.select("fp"), ["fp"], "fp", radius, bands, bands - radius, shard_rows)).select("fp", "component_id")


def groups(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id of every document."""
    common.prepare(docs.sparkSession)
    prints = common.cut(fingerprints(docs, words), "prints")
    return prints.join(link(prints, radius), "fp")


# --- near-duplicates by similarity -------------------------------------------------------------------


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    return np.unique(hashes(text, words))


def several(found: np.ndarray, seeds: int) -> np.ndarray:
    """Fingerprints of distinct shingles under several hashes of their hashes."""
    counts = np.zeros(64 * seeds, np.int64)
    salt = np.arange(seeds, dtype=np.uint64)
    for k in range(0, len(found), 4096):
        part = common.mix(found[k : k + 4096, None] + salt).astype(">u8").view(np.uint8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(found)).view(">u8").astype(np.uint64)


def profiles(docs: DataFrame, words: int, seeds: int) -> DataFrame:
    """doc_id, row (a hash of the text), vertex (a hash of its set of shingles), fp0, fp1 and so on."""
    names = ["vertex", *[f"fp{k}" for k in range(seeds)]]

    def run(batches):
        for batch in batches:
            found = np.zeros((len(names), batch.num_rows), np.uint64)
            for i, t in enumerate(common.column_bytes(batch.column("text"))):
                h = shingle_hashes(t, words)
                found[0, i] = xxhash.xxh64_intdigest(h.tobytes())
                found[1:, i] = several(h, seeds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), *[pa.array(f.view(np.int64)) for f in found]], ["doc_id", "row", *names])

    rows = docs.select(_id().alias("doc_id"), _row().alias("row"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, row long" + "".join(f", {c} long" for c in names))


def _id():
    return F.col("doc_id").cast("long")


def _row():
    """Tells rows of one id apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _sketches(words: int):
    def run(batches):
        for batch in batches:
            found = [shingle_hashes(t, words).tobytes() for t in common.column_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("vertex"), pa.array(found, pa.binary())], ["vertex", "shingles"])

    return run


def _alike(similarity: float):
    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = same >= similarity * (len(x) + len(y) - same) - 1e-9
            out = batch.select(["u", "v"]).filter(pa.array(keep))
            if out.num_rows:
                yield out

    return run


def similar(docs: DataFrame, words: int = NEAR_WORDS, similarity: float = SIMILARITY, radius: int = NEAR_RADIUS, seeds: int = NEAR_SEEDS, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, DataFrame]:
    """Groups of documents whose shingles have a Jaccard similarity of ``similarity``: doc_id, row (a hash), vertex of all rows, and vertex, group, component_id of all vertices."""
    spark = docs.sparkSession
    common.prepare(spark)
    prints, names = common.cut(profiles(docs, words, seeds), "prints"), [f"fp{k}" for k in range(seeds)]
    # Of each vertex the row whose text is looked at: one with an id, if there is one.
    one = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("one")
    vertices = common.cut(prints.groupBy("vertex").agg(F.min("doc_id").alias("least"), one, *[F.first(n).alias(n) for n in names]), "vertices")
    edges = search(vertices.select("vertex", *names), names, "vertex", radius, NEAR_BANDS, 1, shard_rows, forest=True)
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    # All fingerprints together tell chance from likeness.
    side = lambda end: vertices.select(F.col("vertex").alias(end), F.array(*names).alias(f"{end}_fps"))
    apart = F.aggregate(F.zip_with("u_fps", "v_fps", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    edges = common.cut(edges.join(side("u"), "u").join(side("v"), "v").filter(apart <= int(NEAR_SHARE * 64 * seeds)).select("u", "v"), "candidates")
    # The shingles of one text of each vertex that has a candidate.
    wanted = edges.select(F.col("u").alias("vertex")).unionByName(edges.select(F.col("v").alias("vertex"))).distinct()
    chosen = vertices.join(wanted, "vertex", "left_semi").select("vertex", "one.doc_id", "one.row")
    texts = docs.select(_id().alias("t_id"), _row().alias("t_row"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    sketch = chosen.join(texts, chosen["doc_id"].eqNullSafe(texts["t_id"]) & (chosen["row"] == texts["t_row"])).select("vertex", "text")
    sketch = common.cut(sketch.mapInArrow(_sketches(words), "vertex long, shingles binary").groupBy("vertex").agg(F.min("shingles").alias("shingles")), "shingles")
    pairs = edges.join(sketch.select(F.col("vertex").alias("u"), F.col("shingles").alias("a")), "u").join(sketch.select(F.col("vertex").alias("v"), F.col("shingles").alias("b")), "v")
    alike = common.cut(pairs.select("u", "v", "a", "b").mapInArrow(_alike(similarity), "u long, v long"), "alike")
    return prints, joined(vertices, alike, "vertex")


def clean(docs: DataFrame, words: int = NEAR_WORDS, similarity: float = SIMILARITY, radius: int = NEAR_RADIUS) -> DataFrame:
    """One document of each group of near-duplicates, as it is: that with the least doc_id (null after all others), of equal ids the one with the least hash of its text, of rows equal in id and text the one whose JSON is least."""
    prints, linked = similar(docs, words, similarity, radius)
    # Rows of one id may be in several groups, so the group is named by its least row.
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    first = prints.join(linked.select("vertex", "group"), "vertex").groupBy("group").agg(F.min(order).alias("first"))
    key = [F.col("first.none").alias("none"), F.coalesce("first.doc_id", F.lit(0)).alias("id"), F.col("first.row").alias("row")]
    # Which of them stand for several equal rows: only these are brought together.
    many = prints.groupBy("doc_id", "row").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "row", F.lit(True).alias("many"))
    stay = common.cut(first.select(*key).distinct().join(many, ["none", "id", "row"], "left"), "stay")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), _id().isNull().alias("none"), F.coalesce(_id(), F.lit(0)).alias("id"), _row().alias("row"))
    kept = rows.join(stay, ["none", "id", "row"])
    again = kept.filter("many").groupBy("none", "id", "row").agg(F.min_by("d", F.to_json("d")).alias("d"))
    return kept.filter("many is null").select("d").unionByName(again.select("d")).select("d.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op7_simhash": query}
