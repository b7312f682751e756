"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"  # ASCII white space, which separates words


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Python workers get whole texts in batches of ``rows`` for the rest of the session, so that a batch and what is made
    of it stay small; a number that is not Spark's own is left as it is."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(setting) == "10000":
        spark.conf.set(setting, str(rows))


def whole_text(text: str = "text") -> Column:
    """The text, a null as the empty text."""
    return F.coalesce(F.col(text), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(doc_id: Column, folds: int) -> Column:
    """Fold of a document: crc32 of its id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % folds


def held_out(doc_id: Column, folds: int, fold_no: int) -> Column:
    """Whether the document lies in the held-out fold; a null id never does."""
    return F.coalesce(fold(doc_id, folds) == fold_no, F.lit(False))


def stretch(text: Column, max_chars: int) -> Column:
    """The text, of one longer than ``max_chars`` a stretch of that length from a place that its hash names."""
    begin = F.pmod(F.xxhash64(text, F.lit(29)), F.length(text) - F.lit(max_chars) + 1).cast("int") + 1
    return F.when(F.length(text) <= max_chars, text).otherwise(F.substr(text, begin, F.lit(max_chars)))


def one_text_each(docs: DataFrame, keys: DataFrame, by: list[str], columns: list[str], max_chars: int | None) -> DataFrame:
    """A row of ``docs`` with a text for each of the ``keys`` (few rows, with the columns ``by``): of several with one key the
    one whose text has the least hash."""
    text = F.col("text") if max_chars is None else stretch(F.col("text"), max_chars)
    others = [c for c in columns if c != "text"]
    given = docs.where("text IS NOT NULL").select(*by, F.xxhash64("text").alias("_hash"), F.struct(text.alias("text"), *others).alias("_row"))
    found = given.join(keys.select(*by), by).groupBy(*by).agg(F.min_by("_row", F.struct("_hash", "_row.text")).alias("_row"))
    return found.select(*by, *[F.col(f"_row.{c}").alias(c) for c in columns if c not in by])


def bounded_sample(
    docs: DataFrame, keys: DataFrame, columns: list[str], rows: int, max_chars: int | None = None
) -> DataFrame:
    """At most ``rows`` documents of those in ``keys`` (``doc_id`` and more), one row for each id, with
    their ``columns``, the text among them.

    The ids that have a text are drawn in the order of a hash, so the choice does not depend on the partitioning
    nor on the length of the texts. Of a text longer than ``max_chars`` comes a stretch of that length, so the size
    of the sample is bounded, too; without ``max_chars`` texts come whole.
    """
    order = F.xxhash64("doc_id", F.lit(17))
    there = docs.select("doc_id").where("text IS NOT NULL").distinct()
    chosen = keys.select("doc_id").distinct().join(there, "doc_id", "left_semi").orderBy(order, "doc_id").limit(rows)
    return one_text_each(docs, F.broadcast(chosen), ["doc_id"], columns, max_chars)


def groups_by_size(lengths: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring rows whose lengths add up to about ``size``."""
    start = total = 0
    for k, n in enumerate(lengths):
        if total and total + n > size:
            yield start, k
            start, total = k, 0
        total += int(n)
    if start < len(lengths):
        yield start, len(lengths)


def sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x, dtype=np.float64)))


def logit(p):
    return np.log(p) - np.log1p(-p)


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join in which a null key equals a null key; the key columns are those of ``left``."""
    other = right.withColumnsRenamed({k: f"_right{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right{k}")) for k in keys]
    return left.join(other, same, how).drop(*[f"_right{k}" for k in keys])
