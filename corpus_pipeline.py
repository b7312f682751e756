"""Pipeline that prepares the documents for training, stage by stage.

Every stage takes the documents that the one before kept and returns them with the columns of
``documents``; the last returns their tokens instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallygrid.llm import bpe, decontam, linededup, minhash, toxicity
from tallygrid.llm.common import table
from tallygrid.session import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject; it learns from ``labels``."""
    return toxicity.drop_toxic(docs, toxicity.fit_tables(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs of 50 words or more; what is left empty goes."""
    return linededup.drop_repeated_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of its five-word shingles, link by link."""
    return minhash.drop_near_duplicates(docs, width=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of ten words of ``benchmark`` occurs."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``text``, token ids and digests of the documents that are left."""
    return bpe.with_tokens(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("tokens", tokens),
]

ORACLE_SQL = None  # the classifier and the tokenizer are not expressible in SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents after all stages; each stage is written to the shared folder and read again.

    Every stage takes rows in any state. A null or empty text has no words: it is neither toxic, unless the classifier
    finds texts without words so, nor a duplicate, contaminated or changed, and has no tokens. Null ids are ids like any other.
    Rows of equal id and text are one document: they stay or go together. Of equal texts under several ids the
    least id stays. Texts of any length count whole. Further columns stay up to the last stage, whatever their
    names; ``n_chars`` is counted anew where a text is shortened. An empty table gives an empty one, and without
    ``labels`` of both classes no document is toxic.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{k}-{name.replace(' ', '-')}")
    return docs
