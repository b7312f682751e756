import itertools

import numpy as np
import pytest

from tallygrid.llm import langid
from tests.llm.rows import ODD, by_id, documents, words

SF = "/root/testdata/sf0.01"


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(0)
    scores, lengths = rng.normal(size=(4, 2, 3)).astype(np.float32), np.array([4, 3])
    starts, moves = rng.normal(size=3), rng.normal(size=(3, 3))
    total, pairs, every = langid.forward_backward(scores, lengths, starts, moves, each=True)
    all_pairs = np.zeros((3, 3))
    for k, n in enumerate(lengths):
        weights, marginal = 0.0, np.zeros((n, 3))
        joint = np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            w = starts[path[0]] + sum(scores[t, k, x] for t, x in enumerate(path))
            w = np.exp(w + sum(moves[a, b] for a, b in itertools.pairwise(path)))
            weights += w
            for t, x in enumerate(path):
                marginal[t, x] += w
            for a, b in itertools.pairwise(path):
                joint[a, b] += w
        np.testing.assert_allclose(total[k], (marginal / weights).sum(0), rtol=1e-4)
        np.testing.assert_allclose(every[:n, k], marginal / weights, rtol=1e-3, atol=1e-5)
        all_pairs += joint / weights
    np.testing.assert_allclose(pairs, all_pairs, rtol=1e-4)


def test_features_belong_to_the_word():
    alone, _ = langid.features(["haus"])
    rows, begin = langid.features(["maison", "haus", "a"])
    assert sorted(rows[begin[1] : begin[2]]) == sorted(alone)


@pytest.fixture(scope="module")
def field(spark):
    return langid.fit(spark.read.parquet(f"{SF}/documents.parquet"), per_language=60)


def test_code_switching(field):
    words = [w for w in ["the", "that", "with", "was", "for", "que", "del", "para", "los", "con"]]
    share, _ = langid.shares(field, [" ".join(words)])
    found = dict(zip(field.languages, share[0], strict=True))
    assert found["en"] > 0.3 and found["es"] > 0.3


def test_odd_rows(spark, field):
    docs = documents(spark, ODD)
    rows = by_id(langid.identify(docs, field), "lang_pred", "score")
    assert len(rows) == len(ODD)
    assert all(0 <= s <= 1 for _, _, s in rows)
    assert {(i, p) for i, p, _ in rows if p == "und"} == {(1, "und"), (2, "und"), (3, "und"), (13, "und"), (None, "und")}
    assert langid.identify(docs.limit(0), field).count() == 0


def test_nothing_to_learn(spark):
    docs = documents(spark, [(1, "some text"), (2, None)])
    assert by_id(langid.identify(docs, langid.fit(docs)), "lang_pred", "score") == [(1, "und", 0.0), (2, "und", 0.0)]


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [r for r in langid.op2_language(spark, SF).collect() if r.held_out and docs[r.doc_id]]
    assert len(rows) > 250
    assert sum(r.lang_pred == docs[r.doc_id] for r in rows) / len(rows) > 0.98


@pytest.mark.parametrize("text", ["²½Ⅷ①", "① 2 ½", "٣ 12 _", "\u0301", "😀 !"])
def test_numbers_and_marks_are_no_letters(spark, field, text):
    docs = documents(spark, [(1, text)])
    assert by_id(langid.identify(docs, field), "lang_pred", "score") == [(1, "und", 0.0)]
    assert langid.label_runs(docs, field).count() == 0


def spliced(spark):
    """An English and a Spanish stretch of the given documents."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 400").collect()
    one = {lang: next(r.text[:300] for r in sorted(rows, key=lambda r: r.doc_id) if r.lang == lang) for lang in ("en", "es")}
    return f"{one['en']} 12, {one['es']}", len(one["en"])


def test_runs_of_a_spliced_text(spark, field):
    text, border = spliced(spark)
    found = langid.label_runs(documents(spark, [(7, text), (None, None)]), field).collect()
    runs = sorted((r.start, r.end, r.language, r.probability) for r in found)
    assert all(r.doc_id == 7 for r in found) and runs[0][0] == 0
    assert all(a[1] <= b[0] and a[2] != b[2] for a, b in itertools.pairwise(runs))
    assert all(text[a].isalpha() and text[b - 1].isalpha() and 0 < p <= 1 + 1e-6 for a, b, _, p in runs)
    share = {x: sum(min(b, border) - a for a, b, lang, _ in runs if lang == x and a < border) for x in ("en", "es")}
    after = {x: sum(b - max(a, border) for a, b, lang, _ in runs if lang == x and b > border) for x in ("en", "es")}
    assert share["en"] > 0.8 * border and after["es"] > 0.8 * (len(text) - border)


def test_runs_agree_with_the_language_of_the_document(spark, field):
    texts = [t for _, t in ODD if t] + [spliced(spark)[0]]
    share, lengths, runs = langid.runs_of(field, texts)
    np.testing.assert_allclose(share, langid.shares(field, texts)[0])
    for k, n in enumerate(lengths):
        assert bool(runs[k]) == bool(n)
        assert [texts[k][r["start"] : r["end"]] for r in runs[k]] == [texts[k][r["start"] : r["end"]].strip() for r in runs[k]]


def test_languages_of_long_texts_only_are_learnt(spark):
    """Each draw takes a stretch of a text over the limit, and repeated ids count once."""
    rows = [(k, words(k, 4000, 50) if k % 2 else " ".join(f"x{w}" for w in words(k, 60).split()), "aa" if k % 2 else "bb") for k in range(40)]
    rows += [(1, rows[1][1], "aa")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    field = langid.fit(docs, per_language=15, max_chars=500)
    assert field.languages == ["aa", "bb"]
