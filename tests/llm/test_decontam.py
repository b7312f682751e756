import hashlib
import re

import pytest

from tallygrid.llm import decontam
from tests.llm.rows import ODD, documents, words

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, n=10):
    out = []
    for i, text in docs:
        w, hit, ids = split(text), set(), set()
        for item, t in items:
            v = split(t)
            size = min(n, len(v))
            for a in range(len(v) - size + 1 if v else 0):
                for k in range(len(w) - size + 1):
                    if w[k : k + size] == v[a : a + size]:
                        hit.update(range(k, k + size))
                        if item is not None:
                            ids.add(str(item))
        joined = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(ids), joined, bool(hit)))
    return sorted(out, key=str)


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def found(spark, docs, items, **options):
    df = documents(spark, docs)
    keyed = df.select("doc_id", *decontam._keyed(df))
    got = keyed.join(decontam.contamination(df, items_of(spark, items), **options), ["h1", "h2"]).drop("h1", "h2")
    return sorted((tuple(r) for r in got.collect()), key=str)


PASSAGE = words(7, 37, 40)
ITEMS = [(1, PASSAGE), (2, PASSAGE.upper()), (11, "one"), (3, None), (4, ""), (5, "..."), (None, words(8, 20)), (6, words(9, 10))]
DOCS = [
    (101, words(1, 30) + " " + PASSAGE + " " + words(2, 30)), (102, PASSAGE.replace(" ", ", ").upper()),
    (103, " ".join(PASSAGE.split()[5:14])), (104, " ".join(PASSAGE.split()[5:15])), (105, PASSAGE + " " + PASSAGE),
    (106, words(8, 20) + " one ONE"), (107, "x " + words(9, 10) + " " + words(9, 9)),
]


def test_against_all_windows(spark):
    assert found(spark, DOCS + ODD, ITEMS) == brute(DOCS + ODD, ITEMS)


def test_without_broadcast(spark, monkeypatch):
    whole = decontam.hits
    monkeypatch.setattr(decontam, "hits", lambda docs, items, n: whole(docs, items, n, max_broadcast=0))
    small = [r for r in DOCS + ODD if r[0] != 11]
    assert found(spark, small, ITEMS) == brute(small, ITEMS)


@pytest.mark.parametrize("items", [[], [(3, None), (4, "")]])
def test_no_windows(spark, items):
    assert found(spark, DOCS, items) == brute(DOCS, items)


def test_dropped_documents(spark):
    docs = documents(spark, DOCS + ODD)
    kept = decontam.drop_contaminated(docs, items_of(spark, ITEMS))
    assert kept.columns == docs.columns
    clean = sorted(str(r[0]) for r in brute(DOCS + ODD, ITEMS) if not r[5])
    assert sorted(str(r.doc_id) for r in kept.collect()) == clean
    assert decontam.drop_contaminated(docs.limit(0), items_of(spark, ITEMS)).count() == 0
    assert "Python" not in kept._jdf.queryExecution().executedPlan().toString()
