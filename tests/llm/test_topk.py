import numpy as np
import pytest
from pyspark.sql import functions as F

from check_oracle import compare, connect
from tallygrid.llm import topk
from tallygrid.llm.topk import cuts, features, search_block, top_products

KINDS = "vec_id long, embedding array<float>"


def brute(rows, top=20, every=20, steps=64):
    usable = {(i, tuple(np.floor(np.float64(np.float32(v)) * steps) for v in x))
              for i, x in rows if i is not None and x is not None and all(v is not None and np.isfinite(v) for v in x)}
    found = {}
    for q, a in usable:
        if q % every == 0:
            pairs = [(-int(sum(u * v for u, v in zip(a, b, strict=False))), i) for i, b in usable if i != q]
            found[q] = sorted(found.get(q, []) + sorted(pairs)[:top])[:top]
    return {(q, k + 1, i, -s) for q, pairs in found.items() for k, (s, i) in enumerate(pairs)}


def top(spark, rows, extra=(), **more):
    df = spark.createDataFrame([(i, None if x is None else [None if v is None else float(v) for v in x]) for i, x in rows], KINDS)
    found = top_products(df.withColumns({c: F.lit("x") for c in extra}), **more).collect()
    assert len(found) == len({tuple(r) for r in found})
    return {tuple(r) for r in found}


def vectors(count, dim, seed=1, scale=0.2):
    rng = np.random.default_rng(seed)
    return [(k, rng.normal(0, scale, dim).tolist()) for k in range(count)]


def test_agrees_with_all_products_over_many_blocks(spark):
    rows = vectors(2500, 16)
    assert top(spark, rows, query_block=16 * 40, vector_block=16 * 600) == brute(rows)


def test_hot_vector_ties_and_odd_rows(spark):
    """Copies of one vector, by far more than an answer holds, tie; the smaller ids win."""
    nan, inf = float("nan"), float("inf")
    same = [0.5, -0.25, 0.75]
    rows = [(k, same) for k in range(300)] + [(k, same) for k in range(40)] + [(400 + k, x) for k, (_, x) in enumerate(vectors(60, 3))]
    rows += [(1000, None), (1020, [nan, 0, 0]), (1040, [None, 0, 0]), (1060, [inf, 1, 1]), (1080, [-inf, 1, 1]), (None, same)]
    rows += [(1100, []), (1120, [0.5]), (1140, [0.5, 1, 1, 4]), (1160, [0, 0, 0]), (-20, same), (1181, [3e38, 0, 0])]
    rows += [(1200, same), (1200, [-0.5, 0.25, -0.75])]
    rows += [(1300 + k, [-0.0, 0.0, 0.0]) for k in range(30)]
    clashing = ("x", "v1", "v2", "ids", "rank", "score", "row", "column", "query_id", "pairs", "least", "_rank")
    # The immense vector takes no part.
    assert top(spark, rows, extra=clashing) == brute([r for r in rows if r[0] != 1181])


def test_fewer_rows_than_asked_and_empty_table(spark):
    rows = vectors(7, 4)
    assert top(spark, rows) == brute(rows) and len(top(spark, rows)) == 6
    assert top(spark, rows[:1]) == set() and top(spark, []) == set()
    assert top(spark, [(1, [1.0])]) == set()


def test_bounds_hold_and_tighten():
    rng = np.random.default_rng(3)
    q, x = rng.integers(-40, 40, (30, 24)), rng.integers(-40, 40, (500, 24))
    last = np.inf
    for n in cuts(24):
        bound = features(q, n) @ features(x, n).T
        assert (bound >= q @ x.T - 1e-6).all() and bound.mean() < last
        last = bound.mean()


@pytest.mark.parametrize("spread", [1.0, 0.05])
def test_a_block_with_few_and_with_many_survivors(spread):
    """Around a few centres most pairs are ruled out early; without centres hardly any."""
    rng = np.random.default_rng(5)
    x = (rng.normal(0, 1, (40, 32))[rng.integers(0, 40, 5000)] * (spread < 1) + rng.normal(0, spread, (5000, 32))) * 64
    x = np.floor(x).astype(np.int64)
    q, least = x[:50], rng.permutation(5000)
    best = search_block(q, x, least, 20)
    scores = q @ x.T
    for k in range(len(q)):
        order = np.lexsort((least, -scores[k]))[:20]
        assert (best.row[k] == order).all() and (best.score[k] == scores[k, order]).all()


def test_products_beyond_doubles():
    big = np.array([[1 << 40, 3], [-(1 << 40), 5]], np.int64)
    small = np.array([[1 << 20, 1]], np.int64)
    assert topk.exact_products(big, small).tolist() == [[(1 << 60) + 3], [-(1 << 60) + 5]]
    with pytest.raises(OverflowError):
        topk.exact_products(big, big)


def test_query_agrees_with_its_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    assert compare(spark, connect(sf_dir), sf_dir, "op12_topk") is None
