import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import fingerprint as fp

from .helpers import documents


def brute(text):
    """Closed syncmers by definition: place of each chosen run of K bytes."""
    def h(x):
        return (int.from_bytes(x, "little") * 0x9E3779B97F4A7C15) % 2**64 >> 32

    out = []
    for i in range(len(text) - fp.K + 1):
        inner = [h(text[i + j : i + j + fp.S]) for j in range(fp.K - fp.S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append(i)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=90), min_size=1, max_size=4))
def test_anchors_are_the_closed_syncmers(texts):
    for text, (names, places) in zip(texts, fp.prints(texts), strict=True):
        chosen = brute(text)
        assert names == sorted(set(names))
        if chosen:
            first = {}
            for i in chosen:
                first.setdefault(text[i : i + fp.K], i)
            assert len(names) == min(fp.SIZE, len(first)) and set(places) <= set(first.values())
        else:
            assert places == ([0] if text else [])


def test_anchors_do_not_depend_on_context():
    rng = random.Random(3)
    core = bytes(rng.randrange(97, 123) for _ in range(300))
    for left, right in ((b"", b"xyz"), (b"abcdefg", b""), (b"q" * 31, b"r" * 40)):
        got = [i - len(left) for i in brute(left + core + right)]
        assert [i for i in got if 0 <= i <= 300 - fp.K] == brute(core)


def test_likeness():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    a, b = (" ".join(word() for _ in range(400)).encode() for _ in "ab")
    pa, pb, pc = fp.prints([a, b, a[: len(a) * 2 // 3] + b[: len(a) // 3]])
    assert fp.likeness(pa, pa) == 1 and fp.likeness(pa, pb) < 0.05 and 0.3 < fp.likeness(pa, pc) < 0.75
    assert fp.decode(fp.encode(pa)) == pa
    assert fp.likeness(([], []), ([], [])) == 1 and fp.likeness(([], []), pa) == 0


def full_likeness(a, b):
    """By all syncmers of both texts."""
    x, y = ({t[i : i + fp.K]: i for i in reversed(brute(t))} for t in (a, b))
    shift = sorted(x[g] - y[g] for g in x if g in y)
    best = max((sum(0 <= s - t <= fp.TOLERANCE for s in shift) for t in shift), default=0)
    return best / max(1, len({*x, *y}))


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    out = []
    for i, (doc, text) in enumerate(rows):
        text, nxt = text or "", rows[(i + 1) % len(rows)][1] or ""
        cut = len(text) // 3
        changed = text[: len(text) - cut] + nxt[:cut]
        p, q, n = fp.prints([text.encode(), changed.encode(), nxt.encode()])
        out.append((doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), fp.encode(p), fp.encode(q), fp.likeness(p, q), fp.likeness(p, n)))
    return sorted(out, key=str)


def test_edited_against_a_plain_walk(spark):
    rng = random.Random(5)
    text = lambda: "".join(rng.choice("abcdé ñ\n界") for _ in range(rng.choice([0, 1, 2, 5, 50, 900])))
    rows = [(rng.choice([i * i, i * 10**12]), text()) for i in range(120)] + [(None, "null id"), (None, None), (7, "twice"), (7, "twice"), (7, "thrice"), (-5, None), (10**15, "é" * 200_000)]
    for size in (3_000, 10**9):
        got = fp.edited(documents(spark, rows), range_bytes=size).collect()
        assert sorted(map(tuple, got), key=str) == expected(rows)


def test_likeness_is_near_that_of_all_syncmers():
    """The error of the kept share, by length: what the README states."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    for n, most in ((300, 0.05), (2_000, 0.06), (20_000, 0.05)):
        errors = []
        for share in (0.1, 0.4, 0.8):
            a, b = (" ".join(word() for _ in range(n // 5)).encode()[:n] for _ in "ab")
            b = a[: int(n * share)] + b[int(n * share) :]
            errors.append(abs(fp.likeness(*fp.prints([a, b])) - full_likeness(a, b)))
        print(n, errors)
        assert max(errors) <= most


def test_few_rows(spark):
    assert fp.edited(documents(spark, [])).count() == 0
    for rows in ([(3, "only one row")], [(3, None)], [(None, "x")]):
        assert list(map(tuple, fp.edited(documents(spark, rows)).collect())) == expected(rows)


def test_equal_texts_have_equal_fingerprints(spark):
    got = fp.fingerprints(documents(spark, ["a b c " * 99, "a b c " * 99, "", None])).collect()
    assert len({r.fingerprint for r in got}) == 2
