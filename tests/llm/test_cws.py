import collections
import hashlib

import numpy as np
import pytest

from tallygrid.llm import cws
from tests.llm.rows import LONG, ODD, documents, words


def weighted_jaccard(a, b):
    a, b = collections.Counter(a.split()), collections.Counter(b.split())
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def ordered(docs):
    """Different documents by descending id, null last."""
    return sorted({(i, t or "") for i, t in docs}, key=lambda r: (r[0] is None, -(r[0] or 0)))


def edit(docs):
    rows, out = ordered(docs), {}
    for k, (i, t) in enumerate(rows):
        follower = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        out[i, len(t)] = t[: len(t) - half] + follower[:half], follower, t
    return out


DOCS = [(k * 7, words(k, 30 + 11 * k, 60)) for k in range(30)] + [(1000, ""), (1001, "a" + "ü" * 7), (-5, "x y z"), (None, "last one")]


def test_edited_texts_and_likeness(spark):
    rows = cws.edited_fingerprints(documents(spark, DOCS)).collect()
    wanted, errors = edit(DOCS), []
    assert len(rows) == len(DOCS)
    for r in rows:
        text, follower, own = wanted[r.doc_id, r.n_chars]
        assert r.edited_sha256 == hashlib.sha256(text.encode()).hexdigest()
        errors += [r.near_edited - weighted_jaccard(own, text), r.near_next - weighted_jaccard(own, follower)]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert abs(np.mean(errors)) < 0.05 and np.max(np.abs(errors)) < 0.4


def test_collisions_follow_the_weights(spark):
    """Weights 1 to 9 of shared words, many documents: the mean likeness is the similarity."""
    docs, similar = [], []
    for k in range(60):
        a = " ".join(f"a{k}_{j} " * (1 + j % 9) for j in range(20))
        b = " ".join(f"a{k}_{j} " * (1 + (j * 2) % 9) for j in range(20))
        docs += [(2 * k + 1, a), (2 * k, b)]
        similar.append(weighted_jaccard(a, b))
    near = {r.doc_id: r.near_next for r in cws.edited_fingerprints(documents(spark, docs)).collect()}
    got = np.mean([near[2 * k + 1] for k in range(60)])
    assert abs(got - np.mean(similar)) < 4 * np.sqrt(0.25 / 60 / cws.SAMPLES)


def test_odd_rows(spark):
    rows = cws.edited_fingerprints(documents(spark, [r for r in ODD if r[0] is not None])).collect()
    assert len(rows) == len(ODD) - 2
    prints = collections.defaultdict(set)
    texts = dict(ODD)
    for r in rows:
        prints[texts[r.doc_id]].add(r.fingerprint)
        assert (r.fingerprint == "") == (not (texts[r.doc_id] or "").strip(" \t\n\r"))
    assert all(len(p) == 1 for p in prints.values())
    assert {r.doc_id: r.n_chars for r in rows}[11] == len(LONG)
    assert cws.edited_fingerprints(documents(spark, ODD).limit(0)).count() == 0


def test_single_document_follows_itself(spark):
    r = cws.edited_fingerprints(documents(spark, [(3, "one two three four")])).first()
    assert r.edited_sha256 == hashlib.sha256(b"one two tone two t").hexdigest() and r.near_next == 1.0


def test_fingerprints_alone(spark):
    df = documents(spark, ODD)
    alone = {(r.doc_id, r.fingerprint) for r in cws.fingerprints(df).collect()}
    assert alone == {(r.doc_id, r.fingerprint) for r in cws.edited_fingerprints(df).collect()}


@pytest.mark.parametrize("function", [cws.edited_fingerprints, cws.fingerprints])
def test_no_python(spark, function):
    plan = function(documents(spark, DOCS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_likeness_tells_near_from_far():
    """Standard errors of a likeness of 0.5 and of 0.8."""
    assert np.sqrt(0.5 * 0.5 / cws.SAMPLES) < 0.07 and np.sqrt(0.8 * 0.2 / cws.SAMPLES) < 0.055


def test_words_ruled_out_do_not_matter(spark):
    """Few words are drawn, and the samples are those of all words, also where none came low enough."""
    texts = cws._keyed(documents(spark, [*DOCS, *ODD, (77, "a " * 5000 + "b c")]).distinct())
    by_key = lambda df: sorted(map(tuple, df.drop("sure").collect()), key=str)
    full = by_key(cws._packed(texts, cws.KEY, None))
    for reach in (0.5, 3.0, cws.REACH):
        assert by_key(cws._samples(texts, cws.KEY, reach)) == full
    assert cws._packed(texts, cws.KEY, 0.5).where("NOT sure").count() > 10
    long = cws._keyed(documents(spark, [(1, LONG)]))
    drawn = cws._weighted_words(long, cws.KEY, cws.REACH).withColumn("g", cws.F.lit(0))
    assert drawn.select(cws.F.avg(cws._may_win(0).cast("double"))).first()[0] < 0.1
