import random

import numpy as np
import xxhash

from tessera.llm import common, simhash
from tessera.llm.components import components

from .helpers import documents


def brute_print(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints):
    """prints: {doc: fp}; the least doc of each component by plain search."""
    out, left = {}, set(prints)
    while left:
        start = min(left)
        stack = [start]
        left.discard(start)
        while stack:
            a = stack.pop()
            out[a] = start
            near = [b for b in left if bin(prints[a] ^ prints[b]).count("1") <= 4]
            left.difference_update(near)
            stack += near
    return out


def test_fingerprint():
    rng = random.Random(1)
    for n in (0, 1, 3, 4, 5, 60, 6000):
        t = "".join(rng.choice(["The", "Élan", "of", "a,b", "x"]) + rng.choice([" ", "\n\t", "  "]) for _ in range(n))
        assert simhash.fingerprint(t.encode()) == brute_print(t)


def test_spark_has_the_same_shingle_hash(spark):
    assert spark.sql("select xxhash64('a b c d') h").first().h % 2**64 == xxhash.xxh64_intdigest("a b c d", 42)


def cloud(rng, n):
    """Random fingerprints, chains of close ones and a dense ball."""
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(n):
        x = rng.choice(out)
        for _ in range(rng.randrange(7)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    center = rng.getrandbits(64)
    return out + [center ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(n)]


def test_forest_finds_all_components():
    rng = random.Random(2)
    fp = np.unique(np.array(cloud(rng, 150), np.uint64))
    rng = np.random.default_rng(1)
    fp = fp[rng.permutation(len(fp))]
    label = simhash.Forest(np.zeros(len(fp)), fp, 4).groups()
    want = brute_groups(dict(enumerate(fp.tolist())))
    assert label.tolist() == [want[i] for i in range(len(fp))]


def test_bands_lose_no_pair():
    rng = random.Random(3)
    for _ in range(2000):
        x = 0
        for _ in range(4):
            x |= 1 << rng.randrange(64)
        assert any(not x & m for m in simhash.masks())


def test_link_against_brute_force(spark):
    rng = random.Random(4)
    prints = {10 * i + 3: f for i, f in enumerate(cloud(rng, 200))}
    prints |= {5000 + i: prints[3] for i in range(50)}
    df = spark.createDataFrame([(d, int(np.uint64(f).view(np.int64))) for d, f in prints.items()], "doc_id long, fp long")
    want = brute_groups(prints)
    got = {r.doc_id: r.component_id for r in df.join(simhash.link(df, shard_rows=2000), "fp").collect()}
    assert got == want


def test_rows_of_one_id_link_nothing(spark):
    prints = [(3, 0b1), (5, 0b11), (5, 0x7FFF0000FFFF0000), (1 << 62, 0x0F0F0F0F00000000), ((1 << 62) + 5, 0x0F0F0F0F00000001), (None, 0x0F0F0F0F00000003), (None, 0x00000000F0F0F0F0)]
    df = spark.createDataFrame(prints, "doc_id long, fp long")
    got = {r.fp: r.component_id for r in simhash.link(df).collect()}
    big = 1 << 62
    assert [got[f] for _, f in prints] == [3, 3, 5, big, big, big, None]


def shingles(text, words=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def brute_near(rows, similarity=0.8):
    """rows: list of text.  The least index of each one's group, by plain search among those that share a shingle, and how many links there are."""
    sets = list(map(shingles, rows))
    where, up, links = {}, list(range(len(rows))), 0

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in enumerate(sets):
        shared = {}
        for g in s or [None]:
            for j in where.setdefault(g, []):
                shared[j] = shared.get(j, 0) + 1
            where[g].append(i)
        for j, n in shared.items():
            if not s or n >= similarity * (len(s) + len(sets[j]) - n) - 1e-9:
                links += 1
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(rows))], links


def test_spanning_forest_joins_what_is_within_the_radius():
    rng = random.Random(12)
    fp = np.unique(np.array(cloud(rng, 120), np.uint64))
    fp = fp[np.random.default_rng(1).permutation(len(fp))]
    for radius in (4, 14):
        pairs = simhash.Forest(np.zeros(len(fp)), fp, radius).spanning()
        assert (np.bitwise_count(fp[pairs[:, 0]] ^ fp[pairs[:, 1]]) <= radius).all()
        near = [(i, j) for i in range(len(fp)) for j in range(i) if bin(int(fp[i]) ^ int(fp[j])).count("1") <= radius]
        want = simhash.merged(len(fp), np.array(near))
        assert simhash.merged(len(fp), pairs).tolist() == want.tolist()
        assert len(pairs) == len(fp) - len(set(want.tolist()))


def test_near_duplicates_against_brute_force(spark):
    """Documents of the small tables, and copies with more and more words changed: no clean document goes, and few groups are missed."""
    rng = random.Random(13)
    rows = [r.text for r in common.table(spark, "/root/testdata/sf0.01", "documents").orderBy("doc_id").collect()]
    for t in rows[:120]:
        w = (t or "").split()
        if len(w) > 60:
            for _ in range(max(1, int(len(w) * rng.choice([0.005, 0.01, 0.02])))):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            rows.append(" ".join(w))
    want, links = brute_near(rows)
    kept = {r.doc_id for r in simhash.clean(documents(spark, rows)).collect()}
    first = set(want)
    assert first <= kept  # nothing goes that is like nothing before it
    gone, should = len(rows) - len(kept), len(rows) - len(first)
    print(f"{links} links, {should} documents to go, {gone} gone")
    assert should > 150 and gone >= 0.97 * should


def test_a_repeated_line_makes_no_documents_alike(spark):
    """Most of each text is one line over and over, which decides every bit of a fingerprint of all shingles; the texts have nothing else in common."""
    rng = random.Random(21)
    rows = ["na " * 700 + " ".join(f"own{rng.randrange(10**6)}" for _ in range(600)) for _ in range(6)]
    assert sorted(r.doc_id for r in simhash.clean(documents(spark, rows)).collect()) == list(range(6))


def test_equal_fingerprints_are_verified(spark, monkeypatch):
    """All texts have one fingerprint: only those that are alike are linked."""
    monkeypatch.setattr(simhash, "several", lambda found, seeds: np.zeros(seeds, np.uint64))
    rows = [" ".join(f"t{i}w{k}" for k in range(40)) for i in range(20)] + [" ".join([*(f"t3w{k}" for k in range(40)), "end"])]
    kept = sorted(r.doc_id for r in simhash.clean(documents(spark, rows)).collect())
    assert set(range(20)) <= set(kept)


def test_links_found_by_similarity(spark):
    """Pairs of texts of a known Jaccard similarity, each pair unlike the others: how many are found by class of similarity."""
    rng = random.Random(22)
    rows, classes = [], {}
    for n in range(1_200):
        size = rng.choice([80, 200, 600])
        base = [f"w{rng.randrange(3_000)}" for _ in range(size)]
        other = list(base)
        for _ in range(rng.randint(1, max(1, size // 45))):
            other[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
        a, b = shingles(" ".join(base)), shingles(" ".join(other))
        like = len(a & b) / len(a | b)
        if like >= 0.8:
            classes[len(rows)] = "0.80-0.85" if like < 0.85 else "0.85-0.90" if like < 0.9 else "0.90-1.00"
        rows += [" ".join(base), " ".join(other)]
    kept = {r.doc_id for r in simhash.clean(documents(spark, rows)).collect()}
    found = {}
    for i, c in classes.items():
        n, hit = found.get(c, (0, 0))
        found[c] = n + 1, hit + (i + 1 not in kept)
    print(found)
    assert all(i in kept for i in range(0, len(rows), 2)) and all(i + 1 in kept for i in range(0, len(rows), 2) if i not in classes)
    assert all(n >= 80 for n, _ in found.values())
    assert all(hit >= 0.98 * n for n, hit in found.values())


def test_columns_of_any_name_and_kind_stay(spark):
    rows = [(1, "a b c d e f", 5, 6, 7, {"k": 1}), (1, "a b c d e f", 5, 6, 7, {"k": 1}), (2, "a b c d e f", 8, 9, 9, None), (3, None, 1, 1, 1, {"z": 2}), (None, "other words of it all", 0, 0, 0, {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id int, __row int, d int, m map<string,int>").withColumnRenamed("d", "row.d")
    kept = simhash.clean(docs)
    assert kept.schema == docs.schema
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted([rows[0], rows[3], rows[4]], key=str)


def test_a_dense_group_leaves_one(spark):
    rng = random.Random(14)
    base = [f"w{rng.randrange(500)}" for _ in range(300)]
    rows = []
    for _ in range(400):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        rows.append(" ".join(w))
    assert [r.doc_id for r in simhash.clean(documents(spark, rows)).collect()] == [0]


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 300)] + [(999, 998), (998, 999), (5, 5)]
    got = {r.vertex: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {100 + i: 100 for i in range(1, 300)} | {999: 998}


def test_documents(spark):
    rng = random.Random(6)
    base = [rng.choice(["alpha", "beta", "gamma", "delta", "the", "of"]) + str(rng.randrange(50)) for _ in range(400)]
    near = [*base]
    near[200] = "other"
    texts = [" ".join(base), None, " ".join(near), "", "one two", " ".join(base).upper(), (None, " ".join(base)), (77, "one two"), (77, "one two"), (None, "alone here now then")]
    docs = documents(spark, texts)
    rows = [r for r in simhash.groups(docs).collect()]
    assert len(rows) == len(texts)
    prints = {r.doc_id: int(np.int64(r.fp).view(np.uint64)) for r in rows if r.doc_id is not None}
    assert prints == {r.doc_id: brute_print(r.text) for r in docs.collect() if r.doc_id is not None}
    want = brute_groups(prints)
    for r in rows:
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id]
    assert sorted(str(r.component_id) for r in rows if r.doc_id is None) == ["0", "None"]
    assert simhash.groups(documents(spark, [])).count() == 0


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents").collect()
    prints = {r.doc_id: brute_print(r.text) for r in docs}
    want = brute_groups(prints)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.query(spark, sf).collect()} == {d: (f"{f:016x}", want[d]) for d, f in prints.items()}
