import random
import re
import zlib
from collections import Counter

import pytest

from tessera.llm import spelling

from .helpers import documents


def counted(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(n):
    out = {}
    form = {}
    for w in n:
        near = [o for o in n if one_edit(w, o)]
        best = min(near, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
        out[w] = len(near)
    rows = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n[w], out[w], n[form[w]] if form[w] else None))
    return sorted(rows, key=str)


def shown(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def mangled(rng, w):
    i = rng.randrange(len(w) + 1)
    return rng.choice([w[:i] + rng.choice("abÿÀ") + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice("abÿÀ") + w[i + 1 :]])


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(7, 12))) for _ in range(60)]
    words = [w for w in base for _ in range(40)] + [mangled(rng, rng.choice(base)) for _ in range(3_000)] + [mangled(rng, mangled(rng, rng.choice(base))) for _ in range(1_500)]
    rng.shuffle(words)
    rows = [(i, " ".join(words[k : k + 50])) for i, k in enumerate(range(0, len(words), 50))]
    return [*rows, (None, "Letters Letters letters"), (3, None), (3, ""), (4, "1234 ---"), *[(5, "sameword sameword")] * 3, (6, "x" * 50_000 + " " + "x" * 50_000), (7, "STRASSE straße Straße STRASSE ÀÉÎÕÜ×÷ ÀÉÎÕÜ×÷")]


def test_words_forms_and_roots_by_brute_force(spark, texts):
    n = counted(texts)
    table = spelling.words(documents(spark, texts))
    assert {r.word: r.n for r in table.collect()} == n
    assert shown(spelling.forms(table)) == expected(n)


def test_crowded_segments_are_cut_until_few_pairs_are_left(spark, texts):
    """Each key is cut as far as it goes; nothing is lost and nothing comes twice."""
    n = counted(texts)
    table = spark.createDataFrame(list(n.items()), "word string, n long")
    want = sorted((a, b) for a in n for b in n if one_edit(a, b))
    for pairs in (0, 40, 10**9):
        assert sorted((r.word, r.other) for r in spelling.near(table, pairs=pairs).collect()) == want


def test_a_segment_of_very_many_words_gives_no_square_of_them(spark):
    """3,000 words share their first half; candidates are those whose rest agrees in part as well."""
    rng = random.Random(2)
    tails = {"".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3_000)}
    n = {"prefix" + t: 2 for t in tails}
    table = spark.createDataFrame(list(n.items()), "word string, n long")
    got = spelling.near(table)
    deletions = {}
    for w in n:
        for i in range(len(w)):
            deletions.setdefault((i, w[:i] + w[i + 1 :]), []).append(w)
    want = {(a, b) for g in deletions.values() for a in g for b in g if a != b}
    assert {(r.word, r.other) for r in got.collect()} == want


def test_chains_ties_and_empty_tables(spark):
    n = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 2_000, "aaabbbb": 20_000, "aabbbbb": 200_000, "aaaaaac": 20, "zzzzzzz": 5, "zzzzzzy": 49}
    table = spark.createDataFrame(list(n.items()), "word string, n long")
    assert shown(spelling.forms(table)) == expected(n)
    assert spelling.forms(table.limit(0)).count() == 0
    assert spelling.words(documents(spark, [(1, None)]).limit(0)).count() == 0
