"""The pipeline against a plain version of every stage."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer as Library

import __spark_entry__ as registry
import corpus_pipeline
from tallygrid.llm import bpe, toxicity
from tallygrid.session import stored
from tests.llm import test_decontam, test_linededup, test_minhash
from tests.llm.rows import ODD, documents

SF = "/root/testdata/sf0.001"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents before and after every stage, each written and read again."""
    out, docs = tmp_path_factory.mktemp("stages"), table(spark, "documents")
    found = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{out}/{k}")
        docs = spark.read.parquet(f"{out}/{k}")
        found.append(docs)
    return found


def texts(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(df.columns == stages[0].columns for df in stages[1:-1])
    assert {"doc_id", "ids", "n_tokens"} <= set(stages[-1].columns)


def test_toxic_documents_go(spark, stages):
    model = toxicity.fit_tables(stages[0], table(spark, "labels"))
    rows = texts(stages[0])
    score = toxicity.scores(model, [t for _, t in rows], toxicity.Hasher())
    assert texts(stages[1]) == [r for r, s in zip(rows, score, strict=True) if s < toxicity.CUT]


def test_repeated_lines_go(stages):
    wanted = test_linededup.brute(texts(stages[1]), 50)
    before = dict(texts(stages[1]))
    assert texts(stages[2]) == sorted((i, t) for i, t in wanted.items() if t == before[i] or t.strip())
    assert all(r.n_chars == len(r.text) for r in stages[2].collect())


def test_one_of_each_group_stays(stages):
    kept = {i for i, _, _, stays in test_minhash.brute(texts(stages[2]), 5, 80) if stays}
    assert texts(stages[3]) == [r for r in texts(stages[2]) if r[0] in kept]


def test_benchmark_texts_go(spark, stages):
    items = [(r.item_id, r.text) for r in table(spark, "benchmark").collect()]
    windows = {tuple(w[k : k + 10]) for _, t in items for w in [test_decontam.split(t)] for k in range(len(w) - 9)}
    assert all(len(test_decontam.split(t)) >= 10 for _, t in items)
    clean = []
    for i, t in texts(stages[3]):
        w = test_decontam.split(t)
        if not any(tuple(w[k : k + 10]) in windows for k in range(len(w) - 9)):
            clean.append((i, t))
    assert texts(stages[4]) == clean


def test_tokens(stages):
    library = Library.from_file(bpe.tokenizer_file())
    rows = stages[5].collect()
    assert sorted(r.doc_id for r in rows) == [i for i, _ in texts(stages[4])]
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(r.text, add_special_tokens=False).ids


def test_run_equals_the_stages(spark, stages):
    assert sorted(corpus_pipeline.run(spark, SF).select("doc_id", "ids_sha256").collect()) == sorted(
        stages[5].select("doc_id", "ids_sha256").collect()
    )


def test_every_operator_is_registered():
    names = [k for k in registry.queries() if k.startswith("op")]
    assert sorted(int(k[2:].split("_")[0]) for k in names) == list(range(1, 14))
    assert "pipeline" in registry.queries()


def written(spark, path, docs, labels=(), items=()):
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_odd_rows(spark, tmp_path):
    hidden = ["_gone", "_split", "_words", "_score", "_x", "_lines_gone_", "kept_"]
    item = " ".join(f"q{k}" for k in range(30))
    rows = [*ODD, (20, f"before {item} after"), (21, "x" * 100_000), (22, None), (23, "line one two\n" * 3)]
    docs = documents(spark, rows).withColumns({c: F.lit("clash") for c in hidden})
    sf_dir = written(spark, tmp_path, docs, items=[(1, item), (2, None), (None, "a b"), (3, "")])
    given, left = docs.columns, spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert left.columns == given
        left = stored(stage(spark, left, sf_dir), f"odd-{k}")
    found = left.collect()
    left = sorted(((r.doc_id, r.text) for r in found), key=str)
    # The near copy 10 and the exact copies 9 of 8 go, so does 6, which is 5 in other letters, and the contaminated 20.
    gone = {6, 9, 10, 20}
    assert left == sorted(((i, t) for i, t in rows if i not in gone), key=str)
    assert {r.n_tokens for r in found if not r.text} == {0}


def test_empty_tables(spark, tmp_path):
    docs = documents(spark, [], extra=False)
    sf_dir = written(spark, tmp_path, docs)
    assert corpus_pipeline.run(spark, sf_dir).count() == 0
