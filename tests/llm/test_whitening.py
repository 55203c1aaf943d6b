import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import whitening as w
from tests.conftest import SMALL

VECTORS = "vec_id long, embedding array<float>"


def brute_force(rows, components=16):
    """The contract by whole matrices: per usable row (vec_id, deviation, whitened), and the leading eigenvalues' shares."""
    usable = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = {k: [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for k, (_, v) in enumerate(usable)}
    fit = np.array(sorted({tuple(v) for v in x.values()}), dtype=np.int64)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (n * fit - sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = []
    for k, (i, _) in enumerate(usable):
        apart = [n * int(a) - int(s) for a, s in zip(x[k], sums, strict=True)]
        out.append((i, sum(a * a for a in apart), (np.array(apart) / n) @ vectors / np.sqrt(values)))
    return n, values / np.sum(centred * centred) * n, out


def run(df, settings=w.Settings()):
    vectors = w.integer_vectors(df, settings=settings)
    return w.whitened(vectors, w.fitted(vectors, settings))


def made(rng, n, d):
    return [(k, [float(np.float32(c)) for c in rng.standard_normal(d) * np.linspace(0.3, 2, d)]) for k in range(n)]


def compared(df, rows, components=16):
    n, shares, expected = brute_force(rows, components)
    found = run(df, w.Settings(components=components)).collect()
    k = len(shares)
    assert len(found) == len(expected) * k
    assert {r["n"] for r in found} == {n} and max(r["identity_error"] for r in found) < 1e-9
    by_component = {c: sorted((r for r in found if r["component"] == c), key=lambda r: r["vec_id"]) for c in range(1, k + 1)}
    for c, mine in by_component.items():
        theirs = np.array([e[2][c - 1] for e in expected])
        own = np.array([r["whitened"] for r in mine])
        sign = np.sign(own @ theirs)
        assert np.allclose(own, sign * theirs, atol=1e-8)
        assert [r["deviation"] for r in mine] == [e[1] for e in expected]
        assert all(abs(r["explained"] / shares[c - 1] - 1) < 1e-9 for r in mine)


def test_equals_whole_matrices_on_a_given_table(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.orderBy("vec_id").collect()]
    compared(df, rows)


def test_repeated_vectors_count_once_in_the_fit_and_stay_in_the_result(spark):
    rng = np.random.default_rng(3)
    rows = made(rng, 60, 5)
    # A third of all rows holds one vector; others differ by less than the grid.
    rows += [(100 + k, rows[0][1]) for k in range(30)]
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    compared(df, rows, 3)


def test_unusable_rows_go_and_other_columns_may_clash(spark):
    rng = np.random.default_rng(4)
    rows = made(rng, 40, 4)
    bad = [(200, None), (201, [1.0, None, 2.0, 3.0]), (202, [1.0, float("nan"), 0.0, 0.0]), (203, [float("inf")] + [0.0] * 3), (204, []),
           (205, [3e38, 0.0, 0.0, 0.0]), (206, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad, VECTORS).withColumns({c: F.lit(1) for c in ("x", "n", "component", "whitened", "i")})
    compared(df, rows, 4)


def test_null_and_repeated_ids_keep_their_rows(spark):
    rows = [(k % 3 or None, v) for k, v in made(np.random.default_rng(5), 30, 3)]
    found = run(spark.createDataFrame(rows, VECTORS)).collect()
    assert len(found) == 90 and sum(r["vec_id"] is None for r in found) == 30


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5, 2.0])], [(k, [1.0, 1.0]) for k in range(5)]])
def test_nothing_varies(spark, rows):
    result = run(spark.createDataFrame(rows, VECTORS))
    assert result.count() == 0
    assert result.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_a_table_of_low_rank_has_as_many_components(spark):
    rng = np.random.default_rng(6)
    rows = [(k, [float(a), float(a) * 2, float(b), 1.0]) for k, (a, b) in enumerate(rng.integers(-9, 9, (50, 2)))]
    found = run(spark.createDataFrame(rows, VECTORS))
    assert sorted(r[0] for r in found.select("component").distinct().collect()) == [1, 2]
    assert found.agg(F.max("identity_error")).first()[0] < 1e-9


def test_large_deviations_are_exact_or_null():
    x = np.array([[2**40, 0], [0, 2**20]])
    assert w._deviations(x, np.zeros(2, np.int64), [1, 2], 4) == [None, 1 + (2**22 - 2) ** 2]


@pytest.mark.parametrize("d,spread", [(40, 1.0), (300, 0.0), (300, 3.0)])
def test_the_search_finds_the_largest_in_any_dimension(d, spread):
    """Wide spaces make it cut back its subspace and lock pairs on the way."""
    rng = np.random.default_rng(d)
    c = rng.standard_normal((4 * d, d)) * np.linspace(1, 1 + spread, d)
    v = c.T @ c / len(c)
    widths = []

    def product(block):
        widths.append(block.shape[1])
        return v @ block

    found = w.jacobi_davidson(product, d)
    values, vectors = np.linalg.eigh(v)
    assert np.allclose(found.values, values[::-1][:16], rtol=1e-13)
    assert np.abs(np.abs(np.sum(found.vectors * vectors[:, ::-1][:, :16], axis=0)) - 1).max() < 1e-12
    assert found.residuals.max() <= 8 * math.sqrt(d) * w.EPS * found.values[0]
    assert max(widths) <= 20 and found.products == len(widths)


def test_repeated_eigenvalues():
    turn = np.linalg.qr(np.random.default_rng(1).standard_normal((50, 50)))[0]
    values = np.array([9.0] * 5 + [4.0] * 5 + [2.0] * 20 + [1.0] * 20)
    found = w.jacobi_davidson(lambda b: turn @ (values[:, None] * (turn.T @ b)), 50)
    assert np.allclose(found.values, values[:16], rtol=1e-13)
    assert np.allclose(found.vectors.T @ found.vectors, np.eye(16), atol=1e-13)


def test_minres_solves_symmetric_systems_column_by_column():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    right = np.concatenate([rng.standard_normal((30, 3)), np.zeros((30, 1))], axis=1)
    x = w.minres(lambda t: a @ t, right, 80, 1e-12)
    assert np.allclose(a @ x, right, atol=1e-8) and not x[:, 3].any()


def test_sums_over_many_tasks_meet_in_a_few(spark):
    rows = made(np.random.default_rng(8), 200, 6)
    df = spark.createDataFrame(rows, VECTORS)
    vectors = w.integer_vectors(df)
    fit = w.fit_list(vectors, 6, w.Settings(fan_in=2))
    spread = w.Fit(fit.vectors.repartition(9), 9, 6, fit.n, fit.sums, 2)
    block = np.random.default_rng(9).standard_normal((6, 2))
    x = np.array([r["x"] for r in fit.vectors.collect()], dtype=np.float64)
    c = x - x.mean(axis=0)
    assert np.allclose(spread.product(block), c.T @ (c @ block) / len(c))
