"""Close ledgers as their files arrive in a folder."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallygrid.functions.numbers import clean_amount
from tallygrid.operators.close_rules import DEFAULTS, Thresholds
from tallygrid.operators.concepts import concept_totals
from tallygrid.operators.letters import letter_bodies
from tallygrid.sources.ledgers import (
    CSV_OPTIONS,
    DAMAGE,
    KEEP_LINE,
    LABEL_HEADER,
    LINE,
    checked_lines,
    damage,
    file_client,
    file_path,
    kept_line,
)
from tallygrid.sources.letters import write_letters
from tallygrid.streaming.totals_store import BUCKETS, FAN, TotalsStore, client_totals


def ledger_stream(
    spark: SparkSession,
    path: str,
    years: tuple[int, int],
    client: Column | None = None,
    files_per_batch: int = 10_000,
    same_names: bool = False,
    damaged: str = "fail",
) -> DataFrame:
    """Stream of wide lines ``(client, file, own_file, label, current, previous)`` from new files.

    ``own_file`` tells that the client is named by its file and so may have only one. Damaged lines stop the
    query, are left out or keep the fields that the header names, see :func:`checked_lines`.

    A stream needs its schema in advance, so the years are given; a file with other
    headers stops the query.
    """
    names = [LABEL_HEADER, *[f"AÑO {y}" for y in years]]
    raw = (
        spark.readStream.schema(", ".join(f"`{n}` string" for n in [*names, LINE]))
        .options(**CSV_OPTIONS, **KEEP_LINE, enforceSchema="false", maxFilesPerTrigger=files_per_batch)
        .csv(path)
    )
    label, current, previous = (F.col(f"`{n}`") for n in names)
    lines = raw.select(
        (client if client is not None else file_client()).alias("client"),
        file_path().alias("file"),
        F.lit(client is None and not same_names).alias("own_file"),
        label.alias("label"),
        clean_amount(current).alias("current"),
        clean_amount(previous).alias("previous"),
        damage(kept_line(names), len(names)).alias(DAMAGE),
        LINE,
    )
    return checked_lines(lines, damaged)


def close_arrivals(
    lines: DataFrame,
    out: str,
    checkpoint: str,
    letters: str | None = None,
    years: tuple[int, int] | None = None,
    thresholds: Thresholds = DEFAULTS,
    buckets: int = BUCKETS,
    fan: int = FAN,
) -> StreamingQuery:
    """Keep the totals of each micro-batch in the store below ``out`` and stop when the folder is read. With
    ``letters``, the letters of the clients in the batch are written below that folder, from all their files
    so far. Run again with the same checkpoint to take up new files.

    Totals are kept by client and file (see :class:`TotalsStore`). A file lies whole in one batch, so a batch
    that is repeated, also after a lost checkpoint and with other batch limits, only replaces what it wrote
    before. Of the earlier totals a batch reads the buckets of its clients. ``buckets`` should exceed the clients
    of a batch by far; a store keeps the number it was made with.
    """
    if letters and not years:
        raise ValueError("letters name their years")

    run = "r" + hashlib.md5(checkpoint.encode()).hexdigest()[:16]

    def close(batch: DataFrame, batch_id: int) -> None:
        totals = concept_totals(batch, F.col("current"), F.col("previous"), by=("client", "file", "own_file"))
        store = TotalsStore(batch.sparkSession, out, buckets)
        here = store.add(totals, run, batch_id)
        if letters:
            bodies = letter_bodies(client_totals(store.current(here)), years, thresholds)
            write_letters(bodies, letters, mode="replace")
        store.compact(fan)

    return (
        lines.writeStream.foreachBatch(close)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def arrived_totals(spark: SparkSession, out: str, clients: DataFrame | None = None) -> DataFrame:
    """Totals of all batches by client, or of those in ``clients``, whose buckets alone are read."""
    return client_totals(TotalsStore(spark, out).current(clients))
