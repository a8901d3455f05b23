import hashlib
import random

import numpy as np

from tessera.llm import common, repeats

from .helpers import documents


def test_word_hashes():
    texts = [b"", b" a  b\ta ", b"A\xc3\x89 " + b"x" * 300 + b" " + b"y" * 17, b"\n", b"a b" + b"z" * 8]
    for size in (5, 10**6):
        for lower in (False, True):
            h, counts = common.word_hashes(texts, lower, size)
            words = [w for t in texts for w in (t.lower() if lower else t).split()]
            assert counts.tolist() == [len(t.split()) for t in texts] and len(h) == len(words)
            assert len(set(h.tolist())) == len(set(words)) and len(set(zip(h.tolist(), words, strict=True))) == len(set(words))


def brute(rows, window):
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    big = float("inf")
    for d, w in split:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, big), big if d is None else d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (big if d is None else d):
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return sorted(out, key=str)


def digest(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in df.collect()), key=str)


def rewritten(docs, rounds):
    """The last round's symbols of each document, with names that a dictionary gives to what two documents have."""
    found = [repeats.Symbols(w >> np.uint64(25) | repeats.WORD, np.zeros(len(w), np.int64)) for w in docs]
    for r in range(rounds):
        asked = [s.rewrite(r) for s in found]
        pairs = [set(zip(x.tolist(), y.tolist(), strict=True)) for _, x, y in asked]
        names = {p: i * rounds + r + 1 for i, p in enumerate(sorted(pairs[0] & pairs[1]))}
        for s, (at, x, y) in zip(found, asked, strict=True):
            s.name[at] = [names.get(p, 0) for p in zip(x.tolist(), y.tolist(), strict=True)]
    return found


def test_windows_of_equal_strings_are_known_by_the_same_key():
    rng = random.Random(1)
    np.seterr(over="ignore")
    known = symbols = 0
    for _ in range(80):
        core = [rng.randrange(3 if rng.random() < 0.5 else 50) for _ in range(30)] if rng.random() < 0.8 else [7] * 400 + list(range(20))
        sides = [[[rng.randrange(4) for _ in range(rng.randrange(20))] for _ in "ab"] for _ in "cd"]
        docs = [common.mix(np.array(left + core + right, np.uint64)) for left, right in sides]
        keys = []
        for words, s, (left, _) in zip(docs, rewritten(docs, 2), sides, strict=True):
            at, key = repeats.anchors(s, words, np.zeros(len(words), np.int64), 13)
            inner = {a - len(left): k for a, k in zip(at.tolist(), key.tolist(), strict=True) if len(left) <= a <= len(left) + len(core) - 13}
            assert sorted(inner) == list(range(len(core) - 12))
            keys.append(inner)
            known, symbols = known + len(set(inner.values())), symbols + len(inner)
        assert keys[0] == keys[1]
    assert known < symbols / 2


def test_a_symbol_of_one_document_rules_its_windows_out():
    words = [common.mix(np.arange(a, a + 60, dtype=np.uint64)) for a in (0, 1000)]
    for w, s in zip(words, rewritten(words, 2), strict=True):
        assert (s.name[(s.end - s.start) > 1] == 0).all() and (s.end - s.start > 1).any()
        at, _ = repeats.anchors(s, w, np.zeros(60, np.int64), 13)
        assert len(at) < 40


def test_windows_are_compared_by_their_words(monkeypatch):
    rng = np.random.default_rng(3)
    words = rng.integers(0, 3, 400).astype(np.uint64)
    at, doc = np.arange(0, 390, 3), rng.integers(0, 9, 130)
    want = [any(doc[j] < doc[i] and (words[at[i] : at[i] + 5] == words[at[j] : at[j] + 5]).all() for j in range(130)) for i in range(130)]
    assert repeats._late(words, at, doc, 5).tolist() == want
    monkeypatch.setattr(repeats, "LOT", 7)
    assert repeats._late(words, at, doc, 5).tolist() == want
    monkeypatch.setattr(repeats, "window_hashes", lambda w, n: np.zeros(len(w), np.uint64))
    monkeypatch.setattr(common, "combine", lambda a, b, salt: np.zeros(len(a), np.uint64))
    assert repeats._late(words, at, doc, 5).tolist() == want


def test_against_brute_force(spark):
    rng = random.Random(2)
    passages = [[rng.choice("abcdefghij") * rng.randrange(1, 3) for _ in range(rng.randrange(5, 40))] for _ in range(8)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randrange(4)):
            words += [rng.choice("abcdefghij") for _ in range(rng.randrange(12))]
            words += rng.choice(passages) if rng.random() < 0.7 else ["run"] * rng.randrange(30)
        rows.append((rng.randrange(10**6) * 7 - 10**6, rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [(5, None), (6, ""), (None, " ".join(passages[0] * 2)), (None, "x y z " * 9), (40, rows[3][1]), (40, rows[3][1]), (41, "é " * 20_000), (42, "x " * 255 + "é " * 300)] + [(None, f"{passages[1]} {i}".replace("'", "")) for i in range(40)]
    for window, size, hot in ((13, 600, 1000), (13, 10**9, 1000), (3, 2000, 1000), (13, 600, 1)):
        assert digest(repeats.remove(documents(spark, rows), window, size, hot=hot)) == brute(rows, window)


def test_empty_table(spark):
    assert repeats.remove(documents(spark, [])).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in common.table(spark, sf, "documents").collect()]
    assert sorted(map(tuple, repeats.query(spark, sf).collect()), key=str) == brute(rows, 13)
