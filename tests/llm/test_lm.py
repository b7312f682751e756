import collections
import math
import os

import numpy as np
import pytest

from tallygrid.llm import lm
from tests.llm.rows import ODD, documents, words


def tokens(text):
    return [*(text or "").encode().lower().split(), b"\n"]


class Exact:
    """Counts without a filter."""

    def __init__(self, texts):
        self.c, self.pairs, self.h = collections.Counter(), collections.Counter(), collections.Counter()
        for t in texts:
            w = tokens(t)
            self.c.update(w)
            self.pairs.update(zip([b"s", *w], w, strict=False))
        for (v, _), n in self.pairs.items():
            self.h[v] += n
        self.n, self.v = sum(self.c.values()), len(self.c)

    def p(self, w):
        return (self.c[w] + 0.5) / (self.n + 0.5 * (self.v + 1))

    def base(self, text):
        return sum(math.log10(self.p(w)) for w in tokens(text))

    def score(self, text):
        w = tokens(text)
        steps = zip([b"s", *w], w, strict=False)
        return sum(math.log10((self.pairs[s] + lm.PRIOR * self.p(s[1])) / (self.h[s[0]] + lm.PRIOR)) for s in steps)


DOCS = [(k, words(k, 40 + k % 60, 60)) for k in range(200)]


@pytest.mark.parametrize(
    "options", [{}, {"frequent": 10}, {"frequent": 0}, {"frequent": 10, "max_broadcast": 1500, "tokens_per_shard": 1000}]
)
def test_base_is_exact_and_score_is_near(spark, options):
    train = DOCS[:150]
    exact = Exact([t for _, t in train])
    rows = lm.score_documents(documents(spark, [*DOCS, *ODD]), documents(spark, train), **options).collect()
    assert len(rows) == len(DOCS) + len(ODD)
    wanted = collections.defaultdict(list)
    for i, t in [*DOCS, *ODD]:
        wanted[i].append(t)
    for r in rows:
        fits = [t for t in wanted[r.doc_id] if len(tokens(t)) == r.n_tokens and abs(exact.base(t) - r.base_score) < 1e-6 * abs(r.base_score)]
        assert fits and r.train_tokens == exact.n
        assert r.n_known == sum(exact.c[w] > 0 for w in tokens(fits[0]))
        # Quantised counts are off by up to sqrt(2); wrong hits of the filter are few.
        assert abs(exact.score(fits[0]) - r.score) < 0.16 * r.n_tokens + 1


@pytest.mark.parametrize("options", [{}, {"frequent": 1}, {"frequent": 0}, {"max_broadcast": 1}])
def test_scores_after_training_on_a_few_words(spark, options):
    """Most shards of the filter are empty then."""
    train = [(1, "a b a")]
    exact = Exact([t for _, t in train])
    texts = dict([(k, words(k, 30, 60)) for k in range(10)] + [(10, "a b"), (11, "b b x a")])
    rows = lm.score_documents(documents(spark, list(texts.items())), documents(spark, train), **options).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.score == pytest.approx(exact.score(texts[r.doc_id]), abs=0.02)


def test_rounds_do_not_matter(spark):
    docs, train = documents(spark, DOCS), documents(spark, DOCS[:150])
    some = {"frequent": 20, "tokens_per_shard": 1000}
    once = {r.doc_id: r for r in lm.score_documents(docs, train, **some).collect()}
    for r in lm.score_documents(docs, train, max_broadcast=2000, **some).collect():
        assert (r.n_tokens, r.n_known) == (once[r.doc_id].n_tokens, once[r.doc_id].n_known)
        assert r.base_score == pytest.approx(once[r.doc_id].base_score, rel=1e-9)
        assert r.score == pytest.approx(once[r.doc_id].score, rel=1e-9)


def test_one_round_of_shards_is_held_at_a_time(spark, monkeypatch):
    kind, sent, alive = type(spark.sparkContext), [], []

    def broadcast(self, value, send=kind.broadcast):
        out = send(self, value)
        if all(isinstance(k, int) for k in value):
            sent.append(out)
            alive.append(sum(os.path.exists(b._path) for b in sent))
        return out

    monkeypatch.setattr(kind, "broadcast", broadcast)
    lm.score_documents(documents(spark, DOCS), documents(spark, DOCS), max_broadcast=2000, tokens_per_shard=1000)
    assert len(alive) > 2 and set(alive) == {1}


def test_filter_holds_levels():
    rng = np.random.default_rng(0)
    ngrams = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    counts = rng.integers(1, 40, 5000)
    shard = lm._build(ngrams, counts)
    found = lm._levels(shard, ngrams)
    assert (found >= np.frexp(counts.astype(float))[1]).all()
    assert (found > np.frexp(counts.astype(float))[1]).mean() < 0.06
    assert (lm._levels(shard, rng.integers(0, 1 << 63, 5000, dtype=np.uint64)) > 0).mean() < 0.06


def test_nothing_to_learn_and_no_rows(spark):
    docs = documents(spark, [(1, "a b"), (2, None)])
    rows = {r.doc_id: r for r in lm.score_documents(docs, docs.limit(0)).collect()}
    assert (rows[1].n_tokens, rows[1].n_known, rows[1].train_tokens, rows[1].base_score) == (3, 0, 0, 0.0)
    assert lm.score_documents(docs.limit(0), docs).count() == 0
