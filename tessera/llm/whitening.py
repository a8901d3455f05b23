"""Whitening of embeddings: decorrelated components of unit variance.

``fit`` makes two passes over the vectors: sums of every dimension, then, centred by them, the sums
of the products of every pair of dimensions of the upper triangle, as generated SQL expressions of
one aggregation (of PAIRS pairs each, so 64 dimensions take one and more dimensions more passes).
Only these sums reach the driver, d (d + 1) / 2 numbers whatever the rows are; there they are put
together to the covariance, which LAPACK decomposes.  ``whiten`` projects each vector on the
components, again as SQL expressions of one column each.

Each entry c of a vector becomes the long x = floor(1024 * c) + 100000, so sums are exact and the
result doesn't hang on how rows are dealt; only the products' sums are of doubles.

Defined cases: vectors that are null, empty, or have a null, infinite or not-a-number entry go, and
so do those with an entry whose x is beyond LARGEST, which no long could hold the sums of, and those
of another length than most have (of equally frequent lengths the longest stays); repeated rows
count as often as they stand; null vec_ids stay null; components with an eigenvalue of no more than
TINY of the trace have no direction of their own and are left out, so equal vectors, a single one
and an empty table give no rows; a deviation that no long holds is null; further columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
LARGEST = 1 << 40
#: Pairs of dimensions of one aggregation, and the share of the trace below which an eigenvalue is none.
PAIRS, TINY = 2_500, 1e-12


def vectors(rows: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """key, x (array of longs) of the vectors that have finite entries, all of the length that most have."""
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * SCALE) < LARGEST)
    c = F.transform(F.col(f"`{column}`"), lambda e: e.cast("double"))
    sound = rows.select(F.col(f"`{key}`").alias(key), c.alias("c")).filter((F.size("c") > 0) & F.forall("c", entry))
    lengths = sound.groupBy(F.size("c").alias("length")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "length")).alias("most")).first()["most"]
    return sound.filter(F.size("c") == (lengths["length"] if lengths else 0)).select(key, F.transform("c", lambda e: F.floor(e * SCALE) + SHIFT).alias("x"))


@dataclass(frozen=True)
class Whitening:
    """n vectors, their sums by dimension (exact), the components (rows, unit length) with their eigenvalues in falling order, and the trace of the covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def means(self) -> list[float]:
        return [s / self.n for s in self.sums]


def _sums(rows: DataFrame, expressions: list[str]) -> list:
    return list(rows.selectExpr(*expressions).first())


def covariance(rows: DataFrame, columns: list[str], means: list[float], n: int) -> np.ndarray:
    """The covariance (divisor n) of columns of doubles, each centred before it is multiplied."""
    d = len(columns)
    centred = rows.selectExpr(*[f"{c} - {m!r}D AS d{i}" for i, (c, m) in enumerate(zip(columns, means, strict=True))])
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    out = np.zeros((d, d))
    for at in range(0, len(pairs), PAIRS):
        part = pairs[at : at + PAIRS]
        found = _sums(centred, [f"sum(d{i} * d{j}) AS s{k}" for k, (i, j) in enumerate(part)])
        for (i, j), s in zip(part, found, strict=True):
            out[i, j] = out[j, i] = s / n
    return out


def fit(x: DataFrame, column: str = "x") -> Whitening | None:
    """The whitening of vectors of longs; None if there are none."""
    first = x.select(F.size(column).alias("d")).first()
    if first is None:
        return None
    d = first["d"]
    n, *sums = _sums(x, ["count(*) AS n", *[f"sum(cast({column}[{i}] AS decimal(19, 0))) AS s{i}" for i in range(d)]])
    sums = [int(s) for s in sums]
    matrix = covariance(x, [f"{column}[{i}]" for i in range(d)], [s / n for s in sums], n)
    values, vectors_ = np.linalg.eigh(matrix)
    values, components = values[::-1], vectors_.T[::-1]
    # Of the two signs the one that makes the largest entry positive.
    components = components * np.sign(components[np.arange(d), np.abs(components).argmax(axis=1)])[:, None]
    trace = float(np.trace(matrix))
    real = values > TINY * trace
    return Whitening(n, sums, components[real], values[real], trace)


def _projected(w: Whitening, k: int, column: str) -> str:
    """(x - mean) on a component, over the root of its eigenvalue."""
    terms = [f"({column}[{i}] - {m!r}D) * {float(v)!r}D" for i, (m, v) in enumerate(zip(w.means, w.components[k], strict=True))]
    return f"({' + '.join(terms)}) / {float(np.sqrt(w.values[k]))!r}D"


def _deviation(w: Whitening, column: str = "x") -> Column:
    """The sum over dimensions of (n * x - S) squared, in exact longs."""
    squares = [f"try_multiply(try_subtract(try_multiply({w.n}L, {column}[{i}]), {s}), try_subtract(try_multiply({w.n}L, {column}[{i}]), {s}))" for i, s in enumerate(map(_long, w.sums))]
    out = squares[0]
    for s in squares[1:]:
        out = f"try_add({out}, {s})"
    return F.expr(out)


def _long(s: int) -> str:
    return f"{s}L" if abs(s) < 1 << 63 else "cast(null AS bigint)"


def whiten(x: DataFrame, w: Whitening, most: int = COMPONENTS, column: str = "x") -> DataFrame:
    """The rows with w1, w2 and so on: their first ``most`` whitened components."""
    return x.selectExpr("*", *[f"{_projected(w, k, column)} AS w{k + 1}" for k in range(min(most, len(w.values)))])


def identity_error(white: DataFrame, components: int, n: int) -> float:
    """How far the covariance of the whitened components is from the identity, at its largest entry."""
    names = [f"w{k + 1}" for k in range(components)]
    means = [s / n for s in _sums(white, [f"sum({c}) AS s{i}" for i, c in enumerate(names)])]
    return float(np.abs(covariance(white, names, means, n) - np.eye(components)).max())


def report(rows: DataFrame, most: int = COMPONENTS, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """A row for each sound vector and each of its first components: key, component, n, deviation, whitened, explained, identity_error."""
    kind = dict(rows.dtypes)[key]
    x = vectors(rows, key, column)
    w = fit(x)
    if w is None or not len(w.values):
        return rows.sparkSession.createDataFrame([], f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    k = min(most, len(w.values))
    white = whiten(x, w, k).withColumn("deviation", _deviation(w))
    error = identity_error(white, k, w.n)
    each = F.array(*[F.struct(F.lit(i + 1).alias("component"), F.col(f"w{i + 1}").alias("whitened"), F.lit(float(w.values[i] / w.trace)).alias("explained")) for i in range(k)])
    return white.select(key, "deviation", F.explode(each).alias("c")).select(key, "c.component", F.lit(w.n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(error).alias("identity_error"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(common.table(spark, sf_dir, "embeddings"))


QUERIES = {"op12_whitening": query}
