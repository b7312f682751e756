import itertools
import math
import random
from types import SimpleNamespace

import numpy as np
import pytest

from tallygrid.llm import minhash
from tests.llm.rows import ODD, documents, words


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute(docs, width, percent):
    """Least id of everything that links reach, from exact sets of all pairs."""
    sets = [shingles(t, width) for _, t in docs]
    parent = list(range(len(docs)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(range(len(docs)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    out = []
    for k, (i, _) in enumerate(docs):
        name = least.get(root(k)) if sets[k] else i
        out.append((i, len(sets[k]), name, not sets[k] or i == name))
    return sorted(out, key=str)


def found(spark, docs, width, percent):
    rows = minhash.near_duplicates(documents(spark, docs), width, percent).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows), key=str)


def edited(text, seed, count):
    draw, w = random.Random(seed), text.split()
    for _ in range(count):
        w[draw.randrange(len(w))] = f"new{draw.randrange(10**6)}"
    return " ".join(w)


def chains(seed):
    """Copies around the limit, copies of copies, and groups that touch."""
    docs = []
    for g in range(6):
        text = words(seed * 100 + g, 150, 5000)
        for k in range(12):
            text = edited(text if k % 3 else words(seed * 100 + g, 150, 5000), seed * 1000 + g * 20 + k, k % 7)
            docs.append(text)
    random.Random(seed).shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_against_all_pairs(spark, width, percent):
    docs = chains(1)
    assert found(spark, docs, width, percent) == brute(docs, width, percent)


def test_large_group_around_the_limit(spark, monkeypatch):
    """Many copies, of which a part is linked, in blocks of a few."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    base = words(5, 120, 5000)
    docs = [(k, edited(base, k, k % 12)) for k in range(150)]
    assert found(spark, docs, 3, 85) == brute(docs, 3, 85)


def test_odd_rows(spark):
    assert found(spark, ODD, 3, 85) == brute(ODD, 3, 85)
    docs = documents(spark, ODD)
    kept = minhash.drop_near_duplicates(docs, 3, 85)
    assert kept.columns == docs.columns
    # Of 8, 9, 9 and 10 only 8 stays; texts without words are no duplicates.
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in ODD if i not in (6, 9, 10))
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_share_of_equal_minima_is_the_similarity():
    a, b = minhash.Shingler(1)(words(1, 3000, 10**6)), minhash.Shingler(1)(words(2, 1000, 10**6))
    m = minhash.signatures([a, np.concatenate([a[:1500], b]), a[:0]])
    assert abs((m[0] == m[1]).mean() - 1500 / 4000) < 0.15
    assert (m[2] == m[2].max()).all()


def test_components_of_a_long_path(spark):
    edges = [(k, k + 1) for k in range(200)] + [(300, 301), (301, 302), (300, 302)]
    links = spark.createDataFrame(edges, "a long, b long")
    got = {r.c: r.component for r in minhash.components(links).collect()}
    assert got == {**{k: 0 for k in range(201)}, 300: 300, 301: 300, 302: 300}


@pytest.mark.parametrize("limit", [0.80, 0.85])
def test_the_estimate_hardly_ever_rules_out_a_link_at_the_limit(limit):
    n = minhash.HASHES
    lost = sum(
        math.comb(n, k) * limit**k * (1 - limit) ** (n - k) for k in range(n + 1) if k / n < limit - minhash.MARGIN
    )
    assert lost < 1e-9


def test_full_sets_decide_on_a_pair_with_few_equal_minima():
    def block(c, members, minima):
        return SimpleNamespace(
            c=[c], component=[c], n=np.array([len(members)]), minima=np.array([minima]), sets=[np.array(members)]
        )

    minima = np.arange(minhash.HASHES)
    other = np.where(minima < 80, minima, -1)
    one, two = block(1, range(90), minima), block(2, range(100), other)
    assert minhash._between(one, two, 85) == [(1, 2)]


def plans_of(monkeypatch):
    """Gets the name and the plan of everything that is stored."""
    plans, store = [], minhash.stored

    def noted(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return store(df, name)

    monkeypatch.setattr(minhash, "stored", noted)
    return plans


def test_a_round_of_components_is_three_shuffles_without_a_join(spark, monkeypatch):
    """The driver keeps what it plans; rounds of nine shuffles and four joins filled its memory."""
    plans = plans_of(monkeypatch)
    minhash.components(spark.createDataFrame([(k, k + 1) for k in range(20)], "a long, b long"))
    rounds = [p for name, p in plans if name == "stars"]
    assert len(rounds) > 2
    assert all("Join" not in p and p.count("Exchange") <= 3 for p in rounds)


def test_stars_are_found_to_be_components_in_one_round(spark, monkeypatch):
    plans = plans_of(monkeypatch)
    edges = [(0, k) for k in range(1, 9)] + [(20, 10), (30, 10), (10, 10)]
    got = minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r.c, r.component) for r in got} == {(k, 0) for k in range(9)} | {(k, 10) for k in (10, 20, 30)}
    assert len(got) == 12 and len(plans) == 2


def test_no_step_plans_what_lies_before_it_again(spark, monkeypatch):
    plans = plans_of(monkeypatch)
    minhash.near_duplicates(documents(spark, chains(3)), 3, 85)
    assert max(p.count("Exchange") for _, p in plans) <= 16
