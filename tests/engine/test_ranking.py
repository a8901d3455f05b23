"""Ranked results against the formula in plain Python, and what is shown of a text."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import ranking, search

FIELDS = ["descr", "title"]


def occurrences(tokens, term):
    n = 0
    for i in range(len(tokens) - len(term.words) + 1):
        part = tokens[i : i + len(term.words)]
        n += part[:-1] == list(term.words[:-1]) and (part[-1].startswith(term.words[-1]) if term.prefix else part[-1] == term.words[-1])
    return n


def expected(rows, text, k, weights):
    terms = search.parse(text)
    tokens = {i: {f: search.fold(x or "") for f, x in zip(FIELDS, texts, strict=True)} for i, *texts in rows}
    size = {i: sum(map(len, t.values())) for i, t in tokens.items()}
    had = [sum(any(occurrences(t, term) for t in fields.values()) for fields in tokens.values()) for term in terms]
    n, average = len(rows), max(sum(size.values()), 1) / len(rows)
    out = []
    for i, fields in tokens.items():
        f = [sum(weights.get(name, 1.0) * occurrences(t, term) for name, t in fields.items()) for term in terms]
        if all(f):
            idf = [max(math.log((n - m + 0.5) / (m + 0.5)), 1e-6) for m in had]
            out.append((i, round(sum(w * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * size[i] / average)) for w, x in zip(idf, f, strict=True)), 6)))
    return sorted(out, key=lambda r: (-r[1], r[0]))[:k]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(4)
    vocabulary = ["alpha", "beta", "gamma", "delta", "eta", "theta", "iota", "Été", "alphabet"]
    rows = [(i * 997, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40))), rng.choice([None, "alpha beta", "iota"])) for i in range(400)]
    rows += [(10**9, None, None), (10**9 + 1, "", ""), (10**9 + 2, "only-once rarely", "Rarely")]
    return rows, spark.createDataFrame(rows, "cve_id long, descr string, title string")


def test_best_is_the_formula(spark, texts):
    rows, table = texts
    index = search.postings(table, "cve_id", FIELDS)
    docs = ranking.lengths(table, "cve_id", FIELDS)
    sizes = ranking.extents(docs)
    for text, k, weights in (("alpha", 10, {}), ("alpha beta", 7, {"title": 5.0}), ('"beta gamma" alph*', 12, {}), ("et*", 5, {}), ("rarely", 3, {}), ("alpha", 1000, {}), ("nowhere", 5, {}), ("ete theta", 9, {"descr": 0.5})):
        for known in (None, sizes):
            got = [(r.doc, r.score) for r in ranking.best(index, docs, text, k, weights, known).collect()]
            want = expected(rows, text, k, weights)
            assert [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=2e-6), text
            assert len({g[0] for g in got} ^ {w[0] for w in want}) <= 2 and (len(got) < 20 or got[0] == want[0])
    assert ranking.best(index, docs, "!!").collect() == [] and ranking.best(index.limit(0), docs.limit(0), "alpha").collect() == []


def test_bounds_leave_most_documents_unread(spark, texts, monkeypatch):
    """Documents whose bound is too low aren't joined with their lengths: no best one is lost by that."""
    rows, table = texts
    index, docs = search.postings(table, "cve_id", FIELDS), ranking.lengths(table, "cve_id", FIELDS)
    whole = [tuple(r) for r in ranking.best(index, docs, "theta", 400).collect()]
    monkeypatch.setattr(ranking, "RANGE", 5_000)
    for k in (1, 5, 50):
        assert [tuple(r) for r in ranking.best(index, docs, "theta", k).collect()] == whole[:k]


def shown(spark, text, query, how, **more):
    df = spark.createDataFrame([(text, "x")], "descr string, __words string")
    (row,) = how(df.drop("__words"), "descr", query, "out", **more).collect()
    return row.out


def test_highlight_and_snippet(spark):
    high, cut = ranking.highlight, ranking.snippet
    assert shown(spark, "The Été, été and summer.", "ete", high) == "The [Été, été] and summer."
    assert shown(spark, "a quick-brown fox; brown", '"quick brown"', high) == "a [quick-brown] fox; brown"
    assert shown(spark, "(parsers parse)", "pars*", high, marks=("<b>", "</b>")) == "(<b>parsers parse</b>)"
    assert shown(spark, "nothing here", "!!", high) == "nothing here" and shown(spark, "", "x", high) == "" and shown(spark, None, "x", high) is None
    assert shown(spark, " ?!", "x", high) == " ?!" and shown(spark, " ?!", "x", cut) == " ?!"
    long = " ".join(f"w{i}" for i in range(50)).replace("w20", "hit").replace("w23", "hit").replace("w40", "hit")
    assert shown(spark, long, "hit", cut, words=5) == "…[hit] w21 w22 [hit] w24…"
    assert shown(spark, long, "w49", cut, words=3) == "…w47 w48 [w49]" and shown(spark, long, "none", cut, words=2) == "w0 w1…"
    assert shown(spark, "(one, two!)", "two", cut) == "(one, [two]!)"
    many = "x " * 5_000 + "goal goal"
    assert shown(spark, many, "goal", cut, words=4) == "…x x [goal goal]"


def test_lengths(spark, texts):
    rows, table = texts
    got = {r.doc: r.tokens for r in ranking.lengths(table, "cve_id", FIELDS).collect()}
    assert got == {i: len(search.fold(a or "")) + len(search.fold(b or "")) for i, a, b in rows}
    n = ranking.extents(ranking.lengths(table, "cve_id", FIELDS)).agg(F.sum("docs"), F.sum("tokens")).first()
    assert tuple(n) == (len(rows), sum(got.values()))
