"""Whitening against numpy's own eigenvalues, exact sums, and odd inputs."""

import math

import numpy as np
import pytest

from riskframe.llm import whitening
from riskframe.llm.queries import QUERIES


@pytest.mark.parametrize("rank, width", [(1, 1), (3, 7), (7, 7), (40, 33), (200, 64)])
def test_cholesky_and_jacobi_equal_eigenvalues(rank, width):
    rng = np.random.default_rng(rank)
    rows = rng.standard_normal((rank, width)) * 10.0 ** rng.uniform(-3, 3, width)
    scatter = rows.T @ rows
    factor = whitening.pivoted_cholesky(scatter)
    assert factor.shape[1] <= min(rank, width)
    assert np.abs(factor @ factor.T - scatter).max() <= 1e-12 * np.abs(scatter).max()
    # Triangular in the order of pivots: every column is the last one of some row, its pivot.
    last = {int(np.flatnonzero(r)[-1]) for r in factor if r.any()}
    assert last == set(range(factor.shape[1]))
    values, vectors = whitening.principal(scatter, 1)
    want = np.linalg.eigvalsh(scatter)[::-1][: len(values)]
    assert np.allclose(values, want, rtol=1e-9, atol=1e-13 * want[0])
    assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-9
    big = values > 1e-9 * values[0]
    assert np.allclose((scatter @ vectors[big].T).T, vectors[big] * values[big, None], rtol=0, atol=1e-11 * values[0])


def test_equal_eigenvalues_and_nothing():
    values, vectors = whitening.principal(np.eye(6) * 5, 5)
    assert np.allclose(values, 1) and np.allclose(vectors @ vectors.T, np.eye(6))
    assert whitening.principal(np.zeros((3, 3)), 2)[0].tolist() == []
    assert whitening.principal(np.zeros((0, 0)), 1)[0].tolist() == []


def expected(vectors, components=4):
    """Per distinct row: exact deviations, and eigenvalues by numpy."""
    x = np.array([[math.floor(256 * c) for c in v] for v in vectors], np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    deviation = ((n * x - s).astype(object) ** 2).sum(axis=1)
    centred = fit - s / n
    values, own = np.linalg.eigh(centred.T @ centred / n)
    values, own = values[::-1][:components], own[:, ::-1][:, :components]
    return n, deviation, (x - s / n) @ own / np.sqrt(values), values / (centred**2).sum() * n


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_query_equals_numpy(spark, folder):
    got = QUERIES["op12_whitening"](spark, folder).toPandas()
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    n, deviation, coordinates, explained = expected(rows["embedding"])
    assert len(got) == 4 * len(rows) and set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-9
    for c in range(4):
        part = got[got["component"] == c + 1].set_index("vec_id").loc[rows["vec_id"]]
        assert part["deviation"].tolist() == [int(d) for d in deviation]
        sign = np.sign((part["whitened"].to_numpy() * coordinates[:, c]).sum())
        assert np.allclose(part["whitened"], sign * coordinates[:, c], atol=1e-6)
        assert np.allclose(part["explained"], explained[c], rtol=1e-9)


def test_odd_rows(spark):
    nan, inf, big = float("nan"), float("inf"), 2**60 + 1
    rows = [(big, [1.0, 2.0]), (big + 2, [1.0, 2.0]), (None, [3.0, -4.0]), (5, [0.0, -0.0]), (5, [0.0, -0.0]), (6, None), (7, [nan, 1.0]), (8, [inf, 1.0]),
            (9, [None, 1.0]), (10, []), (11, [1.0, 2.0, 3.0]), (11, [1.0, 2.0, 3.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS component", "2 AS _x", "3 AS whitened")
    got = whitening.whiten(docs).collect()
    assert len(got) == 5 * 2 + 2 * 3
    pairs = [r for r in got if r.n == 3]
    assert {r.vec_id for r in pairs} == {big, big + 2, None, 5}
    x = np.array([[256, 512], [768, -1024], [0, 0]])
    for r in pairs:
        own = {big: x[0], big + 2: x[0], None: x[1], 5: x[2]}[r.vec_id]
        assert r.deviation == ((3 * own - x.sum(axis=0)) ** 2).sum() and r.identity_error < 1e-12
    assert abs(sum(r.explained for r in pairs if r.vec_id is None) - 1) < 1e-12
    alone = [r for r in got if r.n == 1]
    assert {(r.vec_id, r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in alone} == {(11, c, 0, None, 0.0, None) for c in (1, 2, 3)}
    assert whitening.whiten(docs.where("false")).collect() == []
    assert whitening.whiten(docs.where("vec_id IN (6, 10)")).collect() == []


def test_large_entries(spark):
    """Whole numbers beyond what a product of longs holds: sums stay exact, squares beyond a long are null."""
    rows = [(1, [1e16, 1.0]), (2, [-1e16, 2.0]), (3, [5e15, 3.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 6 and all(r.deviation is None for r in got)
    middling = [(1, [1e5, 1.0]), (2, [-1e5, 2.0])]
    got = whitening.whiten(spark.createDataFrame(middling, "vec_id long, embedding array<double>")).collect()
    assert {r.deviation for r in got} == {(2 * 25600000) ** 2 + 256**2}
