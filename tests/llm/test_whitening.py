import numpy as np
import pytest

from tessera.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], SCHEMA)


def expected(vectors, most=8):
    x = np.floor(1024 * np.array(vectors, np.float32).astype(float)) + 100_000
    n = len(x)
    v = (x - x.mean(0)).T @ (x - x.mean(0)) / n
    values, components = np.linalg.eigh(v)
    order = np.argsort(-values)[:most]
    return x, values[order], components.T[order], np.trace(v)


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(3)
    return (rng.normal(size=(400, 12)) @ rng.normal(size=(12, 12)) * 0.3).astype(np.float32)


def test_against_numpy_with_rows_that_go(spark, cloud):
    bad = [None, [], [None] * 12, [float("nan")] * 12, [float("inf")] + [0.0] * 11, [1e30] * 12, [0.5] * 11]
    rows = [(i, v.tolist()) for i, v in enumerate(cloud)] + [(1000 + i, v) for i, v in enumerate(bad)] + [(7, cloud[7].tolist()), (None, cloud[9].tolist())]
    got = whitening.report(frame(spark, rows)).collect()
    used = [*cloud, cloud[7], cloud[9]]
    x, values, components, trace = expected(used)
    n = len(used)
    assert len(got) == n * 8 and {r.n for r in got} == {n}
    assert {r.vec_id for r in got} == {*range(400), None}
    deviation = ((n * x - x.sum(0)) ** 2).sum(1)
    white = (x - x.mean(0)) @ components.T / np.sqrt(values)
    sign = {}
    for r in sorted(got, key=lambda r: (r.vec_id is None, r.vec_id or 0)):
        at = 401 if r.vec_id is None else r.vec_id
        assert r.deviation == int(deviation[at])
        want = white[at, r.component - 1]
        sign.setdefault(r.component, np.sign(want * r.whitened))
        assert abs(sign[r.component] * r.whitened - want) < 1e-9
        assert abs(r.explained - values[r.component - 1] / trace) < 1e-12
        assert r.identity_error < 1e-10


def test_pairs_are_dealt_in_several_aggregations(spark, cloud, monkeypatch):
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(cloud)])
    one = whitening.fit(whitening.vectors(df))
    monkeypatch.setattr(whitening, "PAIRS", 10)
    many = whitening.fit(whitening.vectors(df))
    assert np.allclose(one.values, many.values, rtol=1e-12) and one.sums == many.sums


def test_far_means_lose_no_digits(spark):
    """Entries far from zero with small spread: sums are centred before they are multiplied."""
    rng = np.random.default_rng(1)
    x = (1e6 + rng.normal(size=(300, 3))).tolist()
    w = whitening.fit(spark.createDataFrame([(i, [int(1024 * c) for c in v]) for i, v in enumerate(x)], "vec_id long, x array<long>"))
    ints = np.array([[int(1024 * c) for c in v] for v in x], float)
    want = np.linalg.eigvalsh(np.cov(ints.T, bias=True))[::-1]
    assert np.allclose(w.values, want, rtol=1e-9)


def test_what_has_no_direction_gives_no_rows(spark):
    assert whitening.report(frame(spark, [])).collect() == []
    assert whitening.report(frame(spark, [(1, None), (2, [])])).collect() == []
    assert whitening.report(frame(spark, [(1, [1.0, 2.0])])).collect() == []
    assert whitening.report(frame(spark, [(i, [1.0, 2.0]) for i in range(5)])).collect() == []
    line = whitening.report(frame(spark, [(i, [float(i), 0.0]) for i in range(5)])).collect()
    assert {r.component for r in line} == {1} and len(line) == 5


def test_lengths_and_wide_deviations(spark):
    """The length that most vectors have counts; a deviation that no long holds is null."""
    rows = [(1, [1.0, 2.0]), (2, [2.0, 1.0]), (3, [1.0, 2.0, 3.0]), (4, [4e8, -4e8]), (5, [1.0, 7.0])]
    got = whitening.report(frame(spark, rows)).collect()
    assert {r.vec_id for r in got} == {1, 2, 4, 5} and all(r.deviation is None for r in got if r.vec_id == 4)
