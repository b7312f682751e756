import numpy as np
from pyspark.sql import functions as F

from tallygrid.llm import whitening
from tallygrid.llm.whitening import chebyshev, leading, lower_bound, op13_whitening, whiten

KINDS = "vec_id long, embedding array<float>"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if x is None else [None if v is None else float(v) for v in x]) for i, x in rows], KINDS)


def brute(rows, components=4):
    """Rows, n, deviations, whitened coordinates and shares by a full eigendecomposition."""
    dim = max((len(x) for _, x in rows), default=0)
    x = np.array([[*np.floor(256 * np.asarray(v, np.float32).astype(float)), *[0] * (dim - len(v))] for _, v in rows]) + 0
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(0)
    v = (fit - fit.mean(0)).T @ (fit - fit.mean(0)) / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, total, strict=True)) for row in x]
    return n, deviation, (x - fit.mean(0)) @ axes / np.sqrt(values), values / np.trace(v)


def check(rows, found, close=1e-8):
    n, deviation, whitened, share = brute(rows)
    found = sorted(found, key=lambda r: (r.component, r.deviation, r.whitened))
    assert {r.n for r in found} == {n} and all(r.identity_error <= 1e-9 for r in found)
    for k in range(whitened.shape[1]):
        mine = [r for r in found if r.component == k + 1]
        assert len(mine) == len(rows)
        ids = {i: (d, w) for (i, _), d, w in zip(rows, deviation, whitened[:, k], strict=True)}
        signs = {round(r.whitened / ids[r.vec_id][1]) for r in mine if abs(ids[r.vec_id][1]) > 1e-3}
        assert signs in ({1}, {-1})
        for r in mine:
            assert r.deviation == ids[r.vec_id][0] and abs(r.whitened - signs.copy().pop() * ids[r.vec_id][1]) < close
            assert abs(r.explained - share[k]) < 1e-12


def vectors(count, dim, seed=1):
    rng = np.random.default_rng(seed)
    scale = np.linspace(0.5, 0.1, dim)
    return [(k, (rng.normal(0.1, 1, dim) * scale).tolist()) for k in range(count)]


def test_agrees_with_a_full_decomposition_in_many_dimensions(spark):
    rows = vectors(700, 48)
    rows += [(1000 + k, rows[5][1]) for k in range(400)]  # copies count once
    df = frame(spark, rows).withColumns({c: F.lit("x") for c in ("x", "n", "component", "whitened", "at", "task")})
    check(rows, whiten(df).collect())


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [*vectors(50, 6), (60, [0.5]), (61, []), (62, [-0.0] * 6)]
    bad = [(70, None), (71, [nan] * 6), (72, [None] * 6), (73, [inf] * 6), (74, [3e38] * 6)]
    check(rows, whiten(frame(spark, rows + bad)).collect())
    again = whiten(frame(spark, [*rows, (None, rows[0][1]), rows[0]])).collect()
    assert sum(r.vec_id is None for r in again) == 4 and sum(r.vec_id == 0 for r in again) == 8


def test_few_dimensions_and_no_variance(spark):
    rows = [(1, [0.5, 0.25]), (2, [0.25, 0.5]), (3, [0.1, 0.9])]
    check(rows, whiten(frame(spark, rows)).collect())
    for none in ([], [(1, None)], [(1, [0.5, 0.25])], [(1, [0.5]), (2, [0.5])], [(1, []), (2, [])]):
        assert whiten(frame(spark, none)).collect() == []
    flat = whiten(frame(spark, [(k, [k / 10, 0.5, 0.25]) for k in range(30)])).collect()
    assert {r.component for r in flat} == {1}


def test_sums_over_many_tasks(spark, monkeypatch):
    """More tasks than the driver adds up by itself."""
    monkeypatch.setattr(whitening, "GROUP", 3)
    rows = vectors(300, 30, seed=4)
    check(rows, whiten(frame(spark, rows).repartition(20)).collect())


def test_deviation_beyond_64_bits_is_null(spark):
    found = whiten(frame(spark, [(k, [k * 1e12, k * 1e3]) for k in range(5)])).collect()
    assert any(r.deviation is None for r in found) and all(r.identity_error < 1e-4 for r in found)


def test_filter_damps_its_interval_and_the_bound_holds():
    rng = np.random.default_rng(2)
    values = np.concatenate([np.linspace(1, 2, 30), [3.0, 3.1, 4.0]])
    axes = np.linalg.qr(rng.standard_normal((33, 33)))[0]
    matrix = axes * values @ axes.T
    low = lower_bound(lambda q: matrix @ q, 33, 8, rng)
    assert 0.5 < low <= 1.0 + 1e-9
    filtered = axes.T @ chebyshev(lambda q: matrix @ q, axes, 1.0, 2.0, 4.0, 8)
    assert abs(filtered[32, 32] - 1) < 1e-9 and np.abs(np.diag(filtered)[:30]).max() < 1e-4


def test_close_eigenvalues_are_certified():
    values = np.concatenate([np.linspace(1, 1.3, 60), [1.301, 1.302, 1.303, 1.304]])
    axes = np.linalg.qr(np.random.default_rng(6).standard_normal((64, 64)))[0]
    matrix = axes * values @ axes.T

    class Known:
        dim = 64

        def covariance_times(self, q):
            return matrix @ q

        def variances(self):
            return np.diag(matrix)

    found = leading(Known(), 4)
    assert np.abs(found.values - values[::-1][:4]).max() < 1e-12 and found.residual < 1e-11
    assert np.abs(np.abs((found.vectors * axes[:, ::-1][:, :4]).sum(0)) - 1).max() < 1e-9


def test_query_agrees_with_a_full_decomposition(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check(rows, op13_whitening(spark, sf_dir).collect())
