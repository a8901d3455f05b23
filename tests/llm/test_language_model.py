import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import common
from tessera.llm import language_model as lm

from .helpers import documents


def brute(rows):
    """Base columns by definition, and the score with quantised counts of pairs but no false ones."""
    split = [(d, (t or "").encode().lower().split() + [None]) for d, t in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    words, pairs = Counter(), Counter()
    for (_, w), h in zip(split, held, strict=True):
        if not h:
            words.update(w)
            pairs.update(zip([None, *w], w, strict=False))
    n, v = sum(words.values()), len(words)
    level = {c: float(lm.count_of(lm.level(np.array([c])))[0]) for c in {0, *pairs.values()}}
    seen = lambda a, x: min(level[pairs[a, x]], words[a], words[x])
    out = []
    for (d, w), h in zip(split, held, strict=True):
        p = [(words[x] + 1) / (n + v + 1) for x in w]
        score = sum(math.log10((seen(a, x) + lm.MASS * q) / (words[a] + lm.MASS)) for a, x, q in zip([None, *w], w, p, strict=False))
        out.append((d, h, len(w), sum(words[x] > 0 for x in w), n, sum(map(math.log10, p)), score))
    return out


def compare(got, want, near):
    key = lambda r: (str(r[0]), r[2], r[5])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9)
        assert g[6] == pytest.approx(w[6], rel=near, abs=0.5)


def rows_of(seed):
    rng = random.Random(seed)
    phrase = [rng.choice("abcdefgh") * 2 for _ in range(30)]
    rows = [(i * 13, " ".join(rng.choice([phrase, [rng.choice(["A", "b", "cé", f"w{rng.randrange(300)}"]) for _ in range(25)]])[: rng.randrange(30)])) for i in range(150)]
    return rows + [(7, None), (8, ""), (None, "null id"), (7, "twice"), (7, "twice"), (10**9, "long é " * 20_000)]


def test_against_brute_force_in_one_round_and_in_many(spark):
    rows = rows_of(1)
    for size, bound in ((10**9, 10**9), (2_000, 400)):
        compare(lm.score(documents(spark, rows), size, bound).collect(), brute(rows), 0.06)


def test_filter_gives_levels_and_few_false_ones():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 48, 20_000).astype(np.uint64)
    counts = rng.integers(1, 40, 20_000)
    raw = lm.segment(keys, counts)
    f = lm.Filter([(0, len(raw))], raw, 1)
    assert (f.levels(keys) >= lm.level(counts)).all() and (f.levels(keys) == lm.level(counts)).mean() > 0.95
    assert (f.levels(rng.integers(0, 1 << 48, 20_000).astype(np.uint64)) > 0).mean() < 0.05
    assert lm.level(np.array([1, 2, 3, 4, 7, 8])).tolist() == [1, 2, 2, 3, 3, 4]
    assert (lm.level(lm.count_of(np.arange(1, 20))) == np.arange(1, 20)).all() and lm.count_of(np.zeros(1)) == 0


def test_probabilities_after_a_context_come_to_one_at_most():
    """Over the whole vocabulary and an unknown word, for frequent and rare contexts, with what the filter takes for seen by mistake."""
    rng = np.random.default_rng(5)
    words = rng.integers(1, 1 << 60, 3_000).astype(np.uint64)
    text = words[np.minimum(rng.zipf(1.3, 60_000), 3_000) - 1]
    text[:18] = np.tile(np.r_[words[2_999], words[[2_998] * 2], words[2_999], words[[2_997] * 2]], 3)
    counts = dict(zip(*(x.tolist() for x in np.unique(text, return_counts=True)), strict=True))
    key = lambda h, w: common.combine(h, w, 17) >> np.uint64(16)
    pairs, many = np.unique(key(text[:-1], text[1:]), return_counts=True)
    raw = lm.segment(pairs, many)
    f = lm.Filter([(0, len(raw))], raw, 1)
    false = (np.bitwise_count(np.frombuffer(raw, np.uint8)).sum() / (8 * len(raw))) ** lm.PROBES
    known = np.array(list(counts), np.uint64)
    c = np.array([*counts.values(), 0.0])
    p = (c + 1) / (c.sum() + len(known) + 1)
    masses = []
    for h in [*known[np.argsort(-c[:-1])[:20]], *known[:200]]:
        context = float(counts[int(h)])
        seen = np.r_[np.minimum(lm.count_of(f.levels(key(np.full(len(known), h), known))), np.minimum(context, c[:-1])), 0]
        a, b = lm.parts_of(seen, p, np.full(len(p), context), len(known) * false)
        masses.append(float((10 ** (a + b)).sum()))
    assert max(masses) < 1.05 and np.mean(masses) < 1.005 and min(masses) > 0.5


def test_no_training_rows_and_empty_tables(spark):
    held = next(i for i in range(100) if lm.is_held_out(i))
    compare(lm.score(documents(spark, [(held, "a b a")])).collect(), brute([(held, "a b a")]), 1e-6)
    assert lm.score(documents(spark, [])).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in common.table(spark, sf, "documents").collect()]
    got = lm.query(spark, sf).collect()
    compare(got, brute(rows), 0.05)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
