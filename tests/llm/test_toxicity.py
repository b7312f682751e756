import os

import numpy as np
import pytest

from tallygrid.llm import toxicity
from tests.llm.rows import ODD, by_id, documents, words

SF = "/root/testdata/sf0.1"


def made(seed, toxic, lang="en"):
    line = words(seed, 60).split()
    if toxic:
        line[7], line[31] = ("vile", "scumbag") if lang == "en" else (f"gemein{seed}", f"gemein{seed % 7}")
    return " ".join(line)


@pytest.fixture(scope="module")
def model():
    rows = [(made(k, k % 2, "de" if k % 3 == 0 else "en"), "de" if k % 3 == 0 else "en", k % 2) for k in range(400)]
    return toxicity.fit_rows([r[0] for r in rows], [r[1] for r in rows], np.array([float(r[2]) for r in rows]))


def test_learns_words_and_beginnings(model):
    texts = [made(1000 + k, k % 2, "de" if k % 3 == 0 else "en") for k in range(120)]
    score = toxicity.scores(model, texts, toxicity.Hasher())
    assert np.mean((score >= toxicity.CUT) == (np.arange(120) % 2 == 1)) > 0.95


def test_groups_do_not_matter(model):
    texts = [made(k, k % 2) for k in range(20)] + ["", words(3, 4000)]
    once = toxicity.scores(model, texts, toxicity.Hasher())
    often = toxicity.scores(model, texts, toxicity.Hasher(most=10), most=1)
    np.testing.assert_allclose(once, often, rtol=1e-5)


def test_stretches_of_a_long_text_give_its_score(model):
    """A word that only counts beside the next one is found at the border of two stretches, too."""
    text = words(9, 5000)
    whole = toxicity.scores(model, [text, "x", text + " vile scumbag"], toxicity.Hasher())
    for most in (3, 100, 4999, 5000, 5001):
        parts = toxicity.scores(model, [text, "x", text + " vile scumbag"], toxicity.Hasher(), most=most)
        np.testing.assert_allclose(parts, whole, rtol=1e-5)
    for n in range(12):
        line = words(1, n).split()
        for most in (1, 2, 3, 5):
            cut = list(toxicity.stretches(" ".join(line), most))
            assert sum(own for _, own in cut) == n
            at = 0
            for some, own in cut:
                assert some == line[at : at + len(some)] and own <= len(some) <= own + 2
                at += own


def test_pooling_against_windows(model):
    """The largest response of every filter, window by window."""
    hasher = toxicity.Hasher()
    text = made(5, True)
    numbers, lengths = hasher.words([text])
    vectors = np.concatenate([model.table[hasher.parts].sum(1)[numbers], np.zeros((2, toxicity.DIM))])
    pooled = []
    for kernel, shift in zip(model.kernels, model.biases, strict=True):
        w = len(kernel)
        responses = [np.einsum("wd,wdf->f", vectors[t : t + w], kernel) + shift for t in range(len(numbers))]
        pooled.append(np.maximum(np.max(responses, axis=0), 0))
    wanted = toxicity.sigmoid(np.concatenate(pooled) @ model.out + model.bias)
    assert toxicity.probabilities(model, numbers, lengths, hasher.parts)[0] == pytest.approx(float(wanted), rel=1e-3)


def test_odd_rows(spark, model):
    docs = documents(spark, ODD)
    rows = by_id(toxicity.score_documents(docs, model), "score", "predicted")
    assert len(rows) == len(ODD) and all(0 <= s <= 1 and p == (s >= toxicity.CUT) for _, s, p in rows)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == sum(p == 0 for _, _, p in rows)
    assert toxicity.drop_toxic(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("labels", [[], [(1, 0), (9, 0)], [(1, None), (None, 1)]])
def test_too_few_labels(spark, labels):
    docs = documents(spark, ODD)
    model = toxicity.fit_tables(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert toxicity.score_documents(docs, model).where("predicted = 1").count() == 0


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in toxicity.op9_toxicity(spark, SF).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in rows) / len(rows) > 0.95


def test_a_class_of_long_texts_only_is_learnt(spark):
    """Texts over the limit give a stretch, and copies of one id do not fill the sample."""
    toxic = " ".join(["vile"] * 3000)
    rows = [(k, toxic if k % 2 else words(k, 40)) for k in range(60)] + [(2, words(2, 40))] * 300
    labels = [(k, k % 2) for k in range(60)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    sample = toxicity.bounded_sample(docs, table.where("toxic = 0"), ["text", "lang"], 20, 100).collect()
    assert len({r.doc_id for r in sample}) == len(sample) == 20
    model = toxicity.fit(docs, table, per_class=20, max_chars=1000)
    assert model.constant is None
    found = {r.doc_id: r.predicted for r in toxicity.score_documents(docs, model).collect()}
    assert sum(found[i] == y for i, y in labels) > 55


def test_the_driver_does_not_train(spark, monkeypatch):
    docs = documents(spark, [(k, made(k, k % 2)) for k in range(80)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)], "doc_id long, toxic int")
    driver, train = os.getpid(), toxicity.train

    def elsewhere(*args):
        assert os.getpid() != driver
        return train(*args)

    monkeypatch.setattr(toxicity, "train", elsewhere)
    model = toxicity.fit(docs, labels)
    assert model.constant is None
    monkeypatch.undo()
    rows = sorted(((made(k, k % 2), k) for k in range(80)), key=lambda r: (toxicity.zlib.crc32(str(r[1]).encode()), r[0]))
    here = toxicity.fit_rows([t for t, _ in rows], [None] * 80, np.array([k % 2 for _, k in rows], np.float64))
    np.testing.assert_allclose(model.out, here.out, rtol=1e-4)


def test_every_labelled_row_and_word_is_learnt(spark, monkeypatch):
    """No text is left out beyond a number of rows, nor cut; rows that come twice count once."""
    rows = [(k, made(k % 300, k % 2)) for k in range(3200)] + [(3200, words(7, 30_000))]
    docs = spark.createDataFrame([(*r, None) for r in rows + rows[:50]], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(3201)] * 2, "doc_id long, toxic int")
    given = []
    monkeypatch.setattr(toxicity, "fit_blocks", lambda blocks: given.extend(blocks.collect()))
    toxicity.fit(docs, labels, rows=1000)
    sizes = np.concatenate([np.frombuffer(r.sizes, np.int64) for r in given])
    assert len({r.block for r in given}) == 7 and sum(r.n for r in given) == len(sizes) == 3201
    assert sum(r.n_toxic for r in given) == 1600
    assert sizes.sum() == sum(len(r.words) // 4 for r in given) == 3200 * 60 + 30_000


def test_blocks_learn_together(spark, monkeypatch):
    """Many blocks give a model like that of one, and the same one however they are dealt over tasks."""
    rows = [(k, made(k, k % 2)) for k in range(900)]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(900)], "doc_id long, toxic int")
    found, real = [], toxicity.fit_blocks
    monkeypatch.setattr(toxicity, "fit_blocks", lambda blocks: found.append(blocks) or real(blocks))
    model = toxicity.fit(docs, labels, rows=250)
    assert found[0].count() == 4
    score = toxicity.scores(model, [made(2000 + k, k % 2) for k in range(200)], toxicity.Hasher())
    assert np.mean((score >= toxicity.CUT) == (np.arange(200) % 2 == 1)) > 0.95
    other = real(found[0].repartition(3))
    for name, value in vars(model).items():
        for a, b in zip(value if isinstance(value, list) else [value], vars(other)[name] if isinstance(value, list) else [vars(other)[name]], strict=True):
            np.testing.assert_array_equal(a, b)


def test_long_texts_train_by_pieces(model):
    coded = [np.arange(n) % 40 for n in (0, 1, 7, 300)]
    parts = np.random.default_rng(0).integers(0, toxicity.ROWS, (40, toxicity.PARTS))
    laid, begin, end = toxicity._laid_out(np.concatenate(coded), np.array([len(c) for c in coded]))
    whole = toxicity._best_places(model, laid, begin, end, parts)
    for piece in (1, 2, 5, 100):
        for a, b in zip(whole, toxicity._best_places(model, laid, begin, end, parts, piece), strict=True):
            np.testing.assert_allclose(a, b, rtol=1e-4)
    p, _ = toxicity.judged(model, coded, parts)
    np.testing.assert_allclose(toxicity.judged(model, coded, parts, most=3)[0], p, rtol=1e-5)


def test_steps_of_scores_give_the_threshold():
    rng = np.random.default_rng(3)
    p = np.concatenate([rng.beta(1, 8, 400), rng.beta(6, 2, 60)])
    y = np.repeat([0.0, 1.0], [400, 60])
    step = np.floor(toxicity.logit(p) * toxicity.STEP).astype(int)
    steps = toxicity.pd.DataFrame({"step": step, "n": 1, "n_toxic": y.astype(int), "low": p, "high": p})
    assert toxicity.step_threshold(steps) == pytest.approx(toxicity.best_threshold(p, y), abs=2e-3)


def test_likely_rows_hold_all_that_have_a_key(spark):
    rows = spark.range(40_000).selectExpr("string(id) AS key", "id AS v")
    others = spark.range(0, 40_000, 7).selectExpr("string(id) AS key")
    found = {int(r.key) for r in toxicity.likely(rows, others, 5715).collect()}
    assert set(range(0, 40_000, 7)) <= found and len(found) < 0.3 * 40_000
    assert toxicity.likely(rows, others.limit(0), 0).count() == 0
