import hashlib
import math
import random
import struct
import time

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard

from tessera.llm import blocks, common, lines

from .helpers import documents


def text_hash(row):
    """Rows of one id come in the order of Spark's xxhash64 of id and text."""
    seed = 42 if row[0] is None else xxhash.xxh64_intdigest(struct.pack("<q", row[0]), 42)
    h = xxhash.xxh64_intdigest((row[1] or "").encode(), seed)
    return h - (1 << 64) * (h >> 63)


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, text_hash(r)))
    seen, out = [], []
    for d, t in rows:
        parts = (t or "").encode().split(b"\n")
        kept = []
        for x in parts:
            w = x.lower().split()
            s = frozenset(w)
            if len(w) < lines.MIN_WORDS:
                kept.append(x)
                continue
            if not any(len(s & o) >= 0.8 * len(s | o) - 1e-9 for o in seen):
                kept.append(x)
            seen.append(s)
        out.append((d, len(parts), len(parts) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest()))
    return sorted(out, key=str)


def digest(df):
    return sorted(((r.doc_id, r.n_lines, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in df.collect()), key=str)


def make(seed, n):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", "a"] * 20 + [f"w{i}" for i in range(200)] + ["É", "X"]
    known = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 5, 8, 20, 60]))] for _ in range(40)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(rng.randrange(6)):
            w = list(rng.choice(known)) if rng.random() < 0.6 else [rng.choice(vocabulary) for _ in range(rng.randrange(9))]
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rng.random() < 0.3 and rng.shuffle(w)
            text.append((" " if rng.random() < 0.9 else "\t ").join(w).upper() if rng.random() < 0.2 else " ".join(w))
        rows.append((rng.randrange(10**6) * 3 - 10**5, "\n".join(text)))
    return rows + [(1, None), (2, ""), (2, "\n\n"), (None, rows[0][1]), (None, "null null null id here"), (5, rows[1][1]), (5, rows[1][1])]


@pytest.mark.parametrize("size", [800, 10**9])
def test_against_brute_force(spark, size):
    rows = make(size, 150)
    assert digest(lines.dedup(documents(spark, rows), size)) == brute(rows)


def test_a_dense_group_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"v{i}" for i in range(40)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(40)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    assert digest(lines.dedup(documents(spark, rows))) == brute(rows)


def test_long_lines_and_empty_tables(spark):
    rows = [(1, "long line é " * 50_000 + " ".join(f"u{i}" for i in range(20_000))), (2, " ".join(f"u{i}" for i in range(20_000)))]
    assert digest(lines.dedup(documents(spark, rows))) == brute(rows)
    assert lines.dedup(documents(spark, [])).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in common.table(spark, sf, "documents").collect()]
    assert sorted(map(tuple, lines.query(spark, sf).collect()), key=str) == brute(rows)


def test_short_lines_and_lines_without_blanks(spark):
    rows = [(1, "a\n\nb c\n今日は良い天気です。\nx y"), (2, "A\n\nc b\n今日は良い天気です。\nx z"), (3, "b c\n \na\nnew")]
    got = {r.doc_id: bytes(r.kept).decode() for r in lines.dedup(documents(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "\nx z", 3: " \nnew"}


def offered(key, size, place, picture):
    """One row of what a block offers, line by line."""
    n = len(key)
    packed = map(blocks.pack, (common.small(key.astype("<u8"), 7), np.arange(n, dtype="<u4"), size.astype("<u2"), place.astype("<u2"), picture.astype("<u8")))
    return pa.table({"shard": pa.array([0], pa.int32()), "block": pa.array([0], pa.int32()), "n": pa.array([n], pa.int32())} | {k: pa.array([v], pa.binary()) for k, v in zip(lines._OFFER, packed, strict=True)})


def may_match(*columns):
    return {x for a in lines._may_match(offered(*columns)).column("answer").to_pylist() for x in np.frombuffer(a, lines._ASKED)["line"].tolist()}


def test_what_may_match_is_what_the_filters_leave():
    rng = np.random.default_rng(4)
    for _ in range(30):
        n = 60
        size = rng.choice([4, 5, 9, 10, 11, 12, 100, 110, 125, 126, 52_427, 52_428, 60_000, lines.FULL], n)
        place = rng.integers(0, size // 5 + 1)
        key, base = rng.integers(0, 5, n), rng.integers(0, 1 << 63, (3, 2), np.uint64)
        picture = base[rng.integers(0, 3, n)] ^ (np.uint64(1) << rng.integers(0, 64, (n, 2)).astype(np.uint64))
        want, may = set(), set()
        for i in range(n):
            for j in range(n):
                a, b = sorted((int(size[i]), int(size[j])))
                if i == j or key[i] != key[j] or a < 0.8 * b - 1e-9:
                    continue
                need = math.ceil(0.8 / 1.8 * (a + b) - 1e-9)
                differ = sum(bin(int(x)).count("1") for x in picture[i] ^ picture[j])
                if b == lines.FULL or min(size[i] - place[i], size[j] - place[j]) >= need and differ <= a + b - 2 * need:
                    want |= {i, j}
                elif b > 52_427:  # such long lines may be told without need
                    may |= {i, j}
        got = may_match(key, size, place, picture)
        assert want <= got <= want | may


def seconds(*columns):
    best = math.inf
    for _ in range(3):
        start = time.process_time()
        may_match(*columns)
        best = min(best, time.process_time() - start)
    return best


def test_a_large_group_does_not_cost_a_pass_over_the_shard_for_each_of_its_lines():
    rng = np.random.default_rng(5)
    large, rest, alike = 3000, 300_000, np.arange(1000)

    def columns(key):
        return key, np.full(len(key), 100), np.zeros(len(key), int), rng.integers(0, 1 << 63, (len(key), 2), np.uint64)

    group = np.zeros(large, int)
    pairs = np.repeat(np.arange(1, rest // 2 + 1), 2)
    both = columns(np.r_[group, pairs])
    both[3][1000 + 2 * alike] = both[3][alike]  # each so far apart as no other pair
    assert may_match(*both) == {*alike.tolist(), *(1000 + 2 * alike).tolist()}
    assert seconds(*both) < 2 * (seconds(*(x[:large] for x in both)) + seconds(*(x[large:] for x in both)))


def test_a_line_is_made_into_words_once_for_all_shards(spark):
    text = " ".join(f"w{i}" for i in range(40)).encode()

    class Text(bytes):
        made = 0

        def lower(self):
            Text.made += 1
            return bytes(self).lower()

    class Counted(lines.Block):
        def __init__(self, docs):
            super().__init__(docs)
            self.flat = [Text(x) for x in self.flat]

    docs = pa.table({"doc_id": [1], "text": pa.array([zstandard.compress(text)], pa.binary()), "h": [1], "block": pa.array([0], pa.int32())})
    asked = np.zeros(20, lines._ASKED)
    asked["key"] = np.arange(20)
    show = lines._show(8)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(lines, "Block", Counted)
        rows = show(docs, {"offers": [{"shard": 0, "answer": asked.tobytes()}]})
    assert rows.num_rows > 1 and set(rows.column("text").to_pylist()) == {text} and Text.made == 1
