"""Whitening against numpy's eigenvectors, with odd rows, repeated values and missing rank."""

import numpy as np
import pytest

from shelfspark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, label int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(5)


def held(spark, vectors, components=8, extra=()):
    rows = whitening.scaled(table(spark, [*enumerate(vectors.tolist()), *extra]))
    model = whitening.fit(rows, components)
    x = np.floor(1024 * vectors.astype(np.float32).astype(float)) + 100_000
    c = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(c.T @ c / len(x))
    assert (model.n, model.sums.tolist()) == (len(x), x.sum(axis=0).tolist())
    return rows, model, x, c, values[::-1], vectors[:, ::-1].T


@pytest.mark.parametrize("dims", [1, 3, 12, 40])
def test_components_equal_numpy(spark, dims):
    r = np.random.default_rng(dims)
    vectors = r.standard_normal((300, dims)) * np.linspace(1, 0.1, dims) @ np.linalg.qr(
        r.standard_normal((dims, dims)))[0]
    odd = [(900, None), (901, [None] * dims), (902, [float("nan")] * dims), (903, [float("-inf")] * dims),
           (904, []), (905, [1.0] * (dims + 1))]
    rows, model, x, c, values, want = held(spark, vectors, extra=odd)
    k = min(8, dims)
    np.testing.assert_allclose(model.values, values[:k], rtol=1e-10)
    for got, unit in zip(model.components, want):
        np.testing.assert_allclose(got * np.sign(got @ unit), unit, atol=1e-9)
    assert model.trace == pytest.approx(values.sum(), rel=1e-12)
    assert whitening.identity_error(rows, model) < 1e-9
    t = len(x) * x.astype(int) - x.astype(int).sum(axis=0)
    out = whitening.whiten(rows, model).collect()
    assert len(out) == len(x)
    for row in out:
        assert int(row["deviation"]) == sum(int(v) ** 2 for v in t[row["vec_id"]])
        np.testing.assert_allclose(row["whitened"], model.components @ c[row["vec_id"]]
                                   / np.sqrt(model.values), atol=1e-9)


def test_repeated_values_and_missing_rank(spark):
    grid = np.vstack([np.eye(6), -np.eye(6)] * 4)  # one eigenvalue, six times
    _, model, _, _, values, _ = held(spark, grid)
    np.testing.assert_allclose(model.values, values, rtol=1e-9)
    np.testing.assert_allclose(model.components @ model.components.T, np.eye(6), atol=1e-10)
    flat = np.repeat(np.arange(20.0)[:, None], 5, axis=1)  # rank one
    rows, model, *_ = held(spark, flat)
    assert len(model.values) == 1 and whitening.identity_error(rows, model) < 1e-9


def test_wide_numbers_stay_exact(spark):
    big = [[1e12, -1e12], [2e12, 5.0], [0.5, 7e11]]
    rows = whitening.scaled(spark.createDataFrame(list(enumerate(big)), "vec_id long, embedding array<double>"))
    model = whitening.fit(rows)
    x = [[int(np.floor(1024 * v)) + 100_000 for v in row] for row in big]
    sums = [sum(c) for c in zip(*x)]
    for row in whitening.whiten(rows, model).collect():
        assert int(row["deviation"]) == sum((3 * v - s) ** 2 for v, s in zip(x[row["vec_id"]], sums))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (1, [1.0, 2.0])]])
def test_nothing_to_learn(spark, rows):
    kept = whitening.scaled(table(spark, rows))
    model = whitening.fit(kept)
    out = whitening.whiten(kept, model).collect()
    assert [r["whitened"] for r in out] == [[]] * sum(v is not None for _, v in rows)
