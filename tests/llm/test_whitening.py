"""Whitening against a library's eigenvectors and whole-number sums."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wiresift.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def matrices():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 7, 20, 64):
        a = rng.standard_normal((n, n))
        q, _ = np.linalg.qr(a)
        yield from (a + a.T, a @ a.T, np.eye(n) * 3, np.zeros((n, n)), np.ones((n, n)),
                    q @ np.diag([1.0] * (n // 2) + [2.0] * (n - n // 2)) @ q.T,
                    q @ np.diag(10.0 ** -np.arange(n)) @ q.T, q @ np.diag(1 + 1e-9 * np.arange(n)) @ q.T)


def test_components():
    for a in matrices():
        a = (a + a.T) / 2
        values, vectors = whitening.components_of(a)
        size = max(np.linalg.norm(a), 1e-300)
        assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-14 * size
        assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() < 1e-13
        assert np.abs(a @ vectors - vectors * values).max() <= 1e-14 * size


def test_polar_factor():
    rng = np.random.default_rng(3)
    for n in (1, 4, 30):
        a = rng.standard_normal((n, n))
        a = a + a.T
        values, vectors = np.linalg.eigh(a)
        assert np.abs(whitening.polar(a) - vectors @ np.diag(np.sign(values)) @ vectors.T).max() < 1e-11


def test_exact_products():
    rng = random.Random(5)
    for most in (3, 10 ** 6, 2 ** 49):
        y = np.array([[rng.randint(-most, most) for _ in range(4)] for _ in range(50)], np.int64)
        wide = y.astype(object)
        assert whitening.products(y) == (wide.T @ wide).tolist()


def slow(vectors, components, scale=64):
    x = np.array([[int(np.floor(scale * float(np.float32(c)))) for c in v] for v in vectors], object) + whitening.OFFSET
    n, s = len(x), x.sum(axis=0)
    deviation = ((n * x - s) ** 2).sum(axis=1)
    centred = ((n * x - s) / n).astype(float)
    values, q = np.linalg.eigh(centred.T @ centred / n)
    values, q = values[::-1], q[:, ::-1]
    return deviation, centred @ q[:, :components] / np.sqrt(values[:components]), values / values.sum()


@pytest.mark.parametrize(("n", "dims", "components"), [(300, 6, 6), (5000, 40, 32)])
def test_rows(spark, n, dims, components):
    rng = np.random.default_rng(n)
    vectors = rng.standard_normal((n, dims)) @ rng.standard_normal((dims, dims)) + 3
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], SCHEMA).repartition(3)
    got = whitening.whiten(df, components).toPandas()
    deviation, z, explained = slow(vectors, components)
    table = got.pivot(index="vec_id", columns="component", values="whitened").loc[range(n)].to_numpy()
    assert table.shape == (n, components) and (got["n"] == n).all()
    assert np.abs(np.abs(table) - np.abs(z)).max() < 1e-8
    # One sign a component, the same for all rows.
    assert all(np.abs(table[:, k] * np.sign(table[0, k] * z[0, k]) - z[:, k]).max() < 1e-8 for k in range(components))
    first = got[got["component"] == 1].set_index("vec_id").loc[range(n)]
    assert first["deviation"].tolist() == deviation.tolist()
    shares = got[got["vec_id"] == 0].sort_values("component")["explained"].to_numpy()
    assert np.abs(shares / explained[:components] - 1).max() < 1e-9
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 3.0], 0), (1, [1.0, 2.0, 3.0], 0), (None, [0.0, 1.0, 5.0], 0), (2, None, 0), (3, [nan, 1.0, 1.0], 0),
            (4, [1.0, inf, 1.0], 0), (5, [None, 1.0, 1.0], 0), (6, [], 0), (7, [2.0], 0), (8, [4.0, -3.0, 3.0], 0),
            (9, [1e30, 0.0, 0.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    clashing = df.withColumns({c: F.lit("x") for c in ("x", "n", "component", "deviation", "whitened", "i", "s")})
    got = whitening.whiten(clashing, 3).toPandas()
    kept = [v + [0.0] * (3 - len(v)) for i, v, _ in rows if i not in (2, 3, 4, 5, 9)]
    deviation, z, _ = slow(kept, 3)
    assert len(got) == 3 * len(kept) and sorted(got[got["component"] == 1]["deviation"]) == sorted(deviation)
    assert np.abs(np.sort(np.abs(got["whitened"])) - np.sort(np.abs(z.ravel()))).max() < 1e-9
    # A component that does not vary gives no rows; so nothing is left of one row, of equal rows and of none.
    flat = spark.createDataFrame([(i, [float(i), 1.0], 0) for i in range(9)], SCHEMA)
    assert {r.component for r in whitening.whiten(flat).collect()} == {1}
    for few in (df.where("vec_id = 1"), df.where("vec_id = 8"), df.where("vec_id = 3"), df.limit(0)):
        assert whitening.whiten(few).count() == 0
    assert whitening.whiten(df.limit(0)).columns == got.columns.tolist()


def test_large_numbers(spark):
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-1e9, 1e9), rng.uniform(-5, 5)], 0) for i in range(200)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).toPandas()
    x = np.array([[int(np.floor(64 * c)) + whitening.OFFSET for c in v] for _, v, _ in rows], object)
    want = ((200 * x - x.sum(axis=0)) ** 2).sum(axis=1).tolist()
    first = got[got["component"] == 1].set_index("vec_id").loc[range(200)]["deviation"]
    assert [None if np.isnan(d) else int(d) for d in first] == [None if d >= 2 ** 63 else int(float(d)) for d in want]
