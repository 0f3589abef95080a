import numpy as np
import pytest
from tallyloom.llm import whitening

VECTORS = "vec_id long, embedding array<float>, x string, n int"


def answer(spark, tmp_path, rows):
    spark.createDataFrame(rows, VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    return whitening.op11_whitening(spark, str(tmp_path))


def expected(vectors, k=16):
    """Each distinct vector once, a dense covariance and a dense eigensolver."""
    x = np.floor(np.float64(vectors) * 64).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = (n * fit - s) / n
    values, basis = np.linalg.eigh(c.T @ c / n)
    return x, n, s, values[::-1][:k], basis[:, ::-1][:, :k], values.sum()


def check(out, vectors, k=16):
    x, n, s, values, basis, trace = expected(vectors, k)
    frame = out.toPandas().sort_values(["vec_id", "component"])
    k = min(k, x.shape[1])
    assert len(frame) == len(x) * k and frame.component.tolist() == list(range(1, k + 1)) * len(x)
    assert (frame.n == n).all() and frame.deviation.tolist() == np.repeat(((n * x - s) ** 2).sum(1), k).tolist()
    np.testing.assert_allclose(frame.explained, np.tile(values / trace, len(x)), rtol=1e-10)
    assert frame.identity_error.nunique() == 1 and frame.identity_error[0] < 1e-9
    mine, want = frame.whitened.to_numpy().reshape(len(x), k), (n * x - s) / n @ basis / np.sqrt(values)
    signs = np.sign((mine * want).sum(0))
    np.testing.assert_allclose(mine * signs, want, atol=1e-7)


def test_query_matches_a_dense_solver(spark, data):
    vectors = np.stack(spark.read.parquet(f"{data}/embeddings.parquet").orderBy("vec_id").toPandas().embedding)
    check(whitening.op11_whitening(spark, data), vectors)


def test_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(1)
    vectors = (rng.standard_normal((150, 24)) * np.linspace(3, 0.1, 24) + 50).astype(np.float32)
    vectors[100:] = vectors[7]  # a third of all rows are one vector
    rows = [(i, v.tolist(), "a", 1) for i, v in enumerate(vectors)]
    bad = [(900, None), (901, []), (902, [1.0] * 23), (903, [float("nan")] + [1.0] * 23), (904, [float("inf")] * 24), (905, [None] + [1.0] * 23)]
    check(answer(spark, tmp_path / "odd", rows + [(i, v, "b", 2) for i, v in bad]), vectors)
    again = answer(spark, tmp_path / "null", rows + [(None, rows[3][1], "c", 3), rows[5]])
    assert again.filter("vec_id is null").count() == 16 and again.filter("vec_id = 5").count() == 32 and again.first().n == 100


@pytest.mark.parametrize("rows,k", [([], 0), ([[1.0, 2.0]] * 3, 0), ([[1.0, 2.0], [3.0, 5.0]], 1), ([[0.0], [1.0], [5.0]], 1)])
def test_few_vectors(spark, tmp_path, rows, k):
    out = answer(spark, tmp_path, [(i, v, "", 0) for i, v in enumerate(rows)])
    assert out.columns == [c.split()[0] for c in whitening.WHITENED.split(", ")] and out.count() == len(rows) * k


@pytest.mark.parametrize("d,k", [(3, 16), (64, 16), (400, 16), (400, 5)])
def test_jacobi_davidson_reaches_double_precision(d, k):
    rng = np.random.default_rng(d + k)
    basis = np.linalg.qr(rng.standard_normal((d, d)))[0]
    for spectrum in (np.linspace(1, 100, d), np.geomspace(1e-8, 1, d), np.r_[np.full(d // 2, 2.0), np.full(d - d // 2, 7.0)], np.ones(d)):
        a = (basis * spectrum) @ basis.T
        products = []
        values, vectors, residuals = whitening.jacobi_davidson(lambda b, a=a: products.append(b.shape) or a @ b, d, k)
        k_ = min(k, d)
        np.testing.assert_allclose(values, np.sort(spectrum)[::-1][:k_], rtol=0, atol=1e-12 * spectrum.max())
        assert np.abs(vectors.T @ vectors - np.eye(k_)).max() < 1e-12
        assert np.linalg.norm(a @ vectors - vectors * values, axis=0).max() <= 1e-12 * spectrum.max() and len(products) < 600


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((40, 40))
    a = a + a.T
    b = rng.standard_normal((40, 6))
    b[:, 2] = 0
    x = whitening.minres(lambda v: a @ v, b, steps=120, enough=1e-12)
    np.testing.assert_allclose(a @ x, b, atol=1e-6)


def test_deviation_beyond_doubles_is_exact(spark):
    model = whitening.Whitening(1_000_000, np.array([1, 2], np.int64), np.eye(2), np.ones(2), 2.0, 0.0, np.zeros(2))
    rows = spark.createDataFrame([(1, [1300, -2000])], "vec_id long, x array<long>")
    assert {r.deviation for r in whitening.whiten(rows, model).collect()} == {(1_300_000_000 - 1) ** 2 + (2_000_000_002) ** 2}
