import numpy as np
import pytest

from tallygrid.llm import quality
from tests.llm.rows import ODD, by_id, documents

SF = "/root/testdata/sf0.01"


def test_rules_find_a_conjunction():
    rng = np.random.default_rng(0)
    x = rng.random((800, 3))
    y = ((x[:, 0] > 0.4) & (x[:, 2] <= 0.7)).astype(float)
    model = quality.train(x, y, np.ones(800), names=["f", "g", "h"])
    total = model.bias + sum(w * quality._holds(rule, x, ["f", "g", "h"]) for rule, w in model.rules)
    assert np.mean((total > 0) == y) > 0.98
    assert model.rules and all(len(rule) <= 3 for rule, _ in model.rules)


def test_lasso_reaches_its_conditions():
    """At the optimum no weight can move without loss."""
    rng = np.random.default_rng(1)
    r = (rng.random((300, 12)) < 0.5).astype(float)
    y = (r[:, 0] + r[:, 3] + rng.random(300) > 1.2).astype(float)
    bias, w = quality.lasso_logistic(r, y, np.ones(300), 0.01, rounds=4000)
    slope = r.T @ (quality.sigmoid(bias + r @ w) - y) / 300
    assert np.all(np.abs(slope[w == 0]) <= 0.0101)
    np.testing.assert_allclose(slope[w != 0], -0.01 * np.sign(w[w != 0]), atol=1e-3)


def test_compiled_rules_equal_the_rules(spark):
    rules = [((("chars", True, 2.0), ("symbols", False, 0.1)), 1.5), ((("different_words", False, 0.9),), -2.0)]
    model = quality.Ensemble(0.25, rules)
    docs = documents(spark, ODD)
    stats = quality.with_statistics(docs, ["doc_id"]).collect()
    x = np.array([[r[s] for s in quality.STATISTICS] for r in stats])
    total = 0.25 + sum(w * quality._holds(rule, x, quality.STATISTICS) for rule, w in rules)
    got = by_id(quality.score_documents(docs, model), "score")
    wanted = sorted(zip([r.doc_id for r in stats], quality.sigmoid(total), strict=True), key=str)
    assert sorted(round(s, 9) for _, s in got) == sorted(round(float(s), 9) for _, s in wanted)


def test_statistics(spark):
    r = quality.with_statistics(documents(spark, [(1, "Aa b! b\n#1 c.")]), ["doc_id"]).first()
    assert (round(np.expm1(r.chars)), round(np.expm1(r.words)), round(np.expm1(r.lines))) == (13, 5, 2)
    assert (r.capitals, r.marks, r.symbols, r.digits) == (1 / 13, 1 / 13, 1 / 13, 1 / 13)
    assert (r.stops, r.different_words) == (1 / 5, 1.0)


def test_odd_rows(spark):
    docs = documents(spark, ODD)
    model = quality.fit(docs, spark.createDataFrame([(8, 1), (13, 0), (None, 1), (4, None)], "doc_id long, quality int"))
    rows = by_id(quality.score_documents(docs, model), "score", "predicted")
    assert len(rows) == len(ODD) and all(0 <= s <= 1 for _, s, _ in rows)
    assert quality.score_documents(docs.limit(0), model).count() == 0


def test_no_labels(spark):
    docs = documents(spark, ODD)
    model = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {s for _, s in by_id(quality.score_documents(docs, model), "score")} == {0.5}


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in quality.op4_quality(spark, SF).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in rows) / len(rows) > 0.88


def test_no_python_in_the_scoring_plan(spark):
    model = quality.Ensemble(0.0, [((("chars", True, 2.0),), 1.0)])
    plan = quality.score_documents(documents(spark, ODD), model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
