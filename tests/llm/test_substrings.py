import hashlib
import random

import numpy as np

from tessera.llm import common, substrings

from .helpers import documents


def brute(rows, length):
    first, big = {}, float("inf")
    raw = [(d, (t or "").encode()) for d, t in rows]
    for d, t in raw:
        for i in range(len(t) - length + 1):
            k = t[i : i + length]
            first[k] = min(first.get(k, big), big if d is None else d)
    out = []
    for d, t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if first[t[i : i + length]] < (big if d is None else d):
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def digest(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in df.collect()), key=str)


def test_every_string_has_one_anchor_that_its_bytes_decide():
    rng = random.Random(1)
    core = bytes(rng.choice(b"ab") for _ in range(120))
    found = []
    for left, right in ((b"", b"zz"), (b"abba" * 9, b""), (b"a" * 50, b"b" * 50)):
        raw = np.frombuffer(left + core + right, np.uint8)
        at, key, span = substrings.anchors(raw, np.array([0, len(raw)]), 50, 16)
        assert span[0, 0] == 0 and span[-1, 1] == len(raw) - 50 and (span[1:, 0] == span[:-1, 1] + 1).all()
        by = {}
        for a, k, (lo, hi) in zip(at, key, span, strict=True):
            for s in range(lo, hi + 1):
                assert s <= a <= s + 34
                by[s - len(left)] = (a - len(left), k)
        found.append({s: by[s] for s in range(len(core) - 49)})
    assert found[0] == found[1] == found[2]


def test_a_very_long_text_is_taken_in_pieces(monkeypatch):
    raw = np.random.default_rng(5).integers(97, 99, 1000).astype(np.uint8)
    starts = np.array([0, 300, 330, 1000])
    flat = lambda x: sorted((s, a, k) for a, k, (lo, hi) in zip(*x, strict=True) for s in range(lo, hi + 1))
    want = flat(substrings.anchors(raw, starts))
    monkeypatch.setattr(substrings, "PIECE", 97)
    assert flat(substrings.anchors(raw, starts)) == want


def test_refined_buckets_are_the_classes_of_whole_strings():
    rng = np.random.default_rng(2)
    for length, width in ((50, 84), (20, 32), (33, 50), (9, 12)):
        around = rng.integers(97, 99, (40, width)).astype(np.uint8)
        around[20:] = around[:20]
        around[20:, width * 2 // 3] += 1
        around[5:9] = 97
        wanted = np.zeros((40, width), bool)
        wanted[:, : width - length + 1] = rng.random((40, width - length + 1)) < 0.8
        got = substrings.refine(around, wanted, length)
        names = {}
        for i, j in zip(*np.nonzero(wanted), strict=True):
            assert names.setdefault(around[i, j : j + length].tobytes(), got[i, j]) == got[i, j]
        assert len(set(names.values())) == len(names)
        # Buckets follow one another in the order of their strings.
        assert [names[x] for x in sorted(names)] == sorted(names.values())


def test_against_brute_force(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    passages = [text(rng.randrange(20, 150)) for _ in range(8)]
    rows = []
    for _ in range(100):
        t = ""
        for _ in range(rng.randrange(4)):
            t += text(rng.randrange(40)) + (rng.choice(passages) if rng.random() < 0.7 else "ab" * rng.randrange(60))
        rows.append((rng.randrange(10**6) * 7 - 10**6, t))
    rows += [(5, None), (6, ""), (None, passages[0] * 2), (None, "xyz" * 30), (40, rows[3][1]), (40, rows[3][1]), (41, "é" * 30_000), (42, "a" * 50), (43, "a" * 49)]
    rows += [(None, f"{i} {passages[1]} {i}") for i in range(40)]
    for length, q, size, hot in ((50, 16, 1500, 1000), (50, 16, 10**9, 1000), (20, 8, 3000, 1000), (50, 16, 1500, 1)):
        assert digest(substrings.remove(documents(spark, rows), length, q, size, hot)) == brute(rows, length)


def test_empty_tables(spark):
    assert substrings.remove(documents(spark, [])).count() == 0
    assert digest(substrings.remove(documents(spark, [None, ""]))) == brute([(0, None), (1, "")], 50)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in common.table(spark, sf, "documents").collect()]
    assert sorted(map(tuple, substrings.query(spark, sf).collect()), key=str) == brute(rows, 50)
