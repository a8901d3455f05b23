import random

import numpy as np

from tessera.llm import common
from tessera.llm import decontaminate as dc

from .helpers import documents


def distance(pattern, text):
    """Least edits of the whole pattern against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def brute(docs, items):
    found = dc.passages([(i, t.encode()) for i, t in items if t])
    out = set()
    for d, t in docs:
        norm = dc.normalise((t or "").encode())[0].tobytes()
        out |= {(d, i) for i, p in found if distance(p, norm) <= dc.budget(len(p))}
    return out


def edit(rng, text, n):
    for _ in range(n):
        i = rng.randrange(len(text))
        text = rng.choice([text[:i] + text[i + 1 :], text[:i] + rng.choice("xyz") + text[i:], text[:i] + rng.choice("xyz") + text[i + 1 :]])
    return text


def words(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "é"]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_against_brute_force(spark):
    rng = random.Random(1)
    items = [(i, words(rng, rng.randrange(5, 40))) for i in range(8)] + [(90, None), (91, "too short")]
    docs = []
    for i in range(60):
        t = words(rng, rng.randrange(30))
        for _ in range(rng.randrange(3)):
            leak = rng.choice(items[:8])[1]
            a = rng.randrange(max(1, len(leak) // 3))
            leak = edit(rng, leak[a:], rng.randrange(12))
            t += "\n" + rng.choice([leak, leak.upper().replace("É", "é"), leak.replace(" ", "\n\t ")]) + " " + words(rng, rng.randrange(20))
        docs.append((i, t))
    docs += [(100, None), (101, ""), (None, items[3][1]), (102, items[4][1]), (102, items[4][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert len(want) > 20
    for size in (10**6, 200):
        got = dc.regions(documents(spark, docs), bench, size).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want
        text = dict(docs)
        for r in got:
            assert 0 <= r.start < r.stop <= len((text[r.doc_id] or "").encode()) and r.stop - r.start >= 25
    assert sum(r.doc_id == 102 for r in got) == 2


def test_lemma_bound_and_alignment():
    rng = random.Random(2)
    for _ in range(200):
        p = words(rng, 20).encode()[:80]
        t = edit(rng, p.decode("utf-8", "ignore"), rng.randrange(9)).encode()
        k = distance(p, t)
        if k <= dc.budget(len(p)):
            pad = np.zeros(60, np.uint8)
            text = np.r_[pad, np.frombuffer(t, np.uint8), pad]
            found = dc.find(dc.Index([(1, p)]), text)
            assert [(x[0], x[4]) for x in found] == [(1, k)] and found[0][1] >= 54 and found[0][2] <= 66 + len(t)


def test_hits_in_lots_and_items_in_parts_change_nothing(monkeypatch):
    rng = random.Random(6)
    item = words(rng, 60).encode()
    items = [(1, b"a" * 100), (2, item), (3, b"ab" * 45), (4, item[100:200])]
    texts = [b"a" * 160, item[50:200] + b"a" * 90, b"ba" * 60, words(rng, 100).encode() + item[120:210], b"x" * 79 + b"a" * 79]
    find = lambda: [dc.find(dc.Index(dc.whole(items)), np.frombuffer(t, np.uint8)) for t in texts]
    regions = lambda found: [sorted({(i, a, b, e) for i, a, b, _, e in f}) for f in found]
    want = regions(find())
    assert all(want)
    monkeypatch.setattr(dc, "MOST", 400)
    assert regions(find()) == want
    monkeypatch.setattr(dc, "ITEM_BYTES", 50)
    got = regions(find())
    assert [{i for i, *_ in f} for f in got] == [{i for i, *_ in f} for f in want]


def test_extra_columns_with_any_name(spark):
    bench = spark.createDataFrame([(1, "a passage of the benchmark that is long enough to be looked for")], "item_id long, text string")
    docs = documents(spark, ["xx a passage of the benchmark that is long enough to be looked for", "none"]).selectExpr("*", "'x' row", "'y' rest", "'z' shard", "1 range", "'q' h")
    assert [r.doc_id for r in dc.regions(docs, bench).collect()] == [0]
    assert dc.clean(docs, bench).collect() == docs.filter("doc_id = 1").collect()


def test_empty_tables(spark):
    bench = spark.createDataFrame([(1, "a passage of the benchmark that is long enough to be looked for")], "item_id long, text string")
    assert dc.regions(documents(spark, []), bench).count() == 0
    assert dc.regions(documents(spark, ["x y", None]), bench.limit(0)).count() == 0


def test_query_finds_planted_items_and_no_clean_document(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: dc.normalise(r.text.encode())[0].tobytes() for r in common.table(spark, sf, "documents").collect()}
    items = [dc.normalise(r.text.encode())[0].tobytes().strip() for r in common.table(spark, sf, "benchmark").collect()]
    want = {d for d, t in docs.items() if any(i in t for i in items)}
    assert {r.doc_id for r in dc.query(spark, sf).collect()} == want


def test_excerpts_at_every_offset_and_short_items(spark):
    """Against plain edits of the excerpt that was planted, not of passages()."""
    rng = random.Random(4)
    item = "".join(rng.choice("abcdefghij klmno") for _ in range(300)).replace("  ", "xy").strip()
    short = ["What is the capital of Peru?", "Name 3 primes."]
    docs = [item[a : a + 80] for a in range(len(item) - 79)]
    docs += ["zz " * 30 + edit(rng, item[a : a + 80], 3) + " zz" * 30 for a in range(0, len(item) - 79, 7)]
    n = len(docs)
    docs += ["zz what  is the\ncapital of peru? zz", "zz what is teh capital of peru? zz", "so name 3 primes. zz", "zz what is the capital? zz", "name 4 primes.", item[:40] + "zz"]
    bench = spark.createDataFrame([(0, item), (1, short[0]), (2, short[1])], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.regions(documents(spark, docs), bench).collect()}
    assert got == {(i, 0) for i in range(n)} | {(n, 1), (n + 1, 1), (n + 2, 2)}
    assert [r.doc_id for r in dc.clean(documents(spark, docs), bench).orderBy("doc_id").collect()] == [n + 3, n + 4, n + 5]
