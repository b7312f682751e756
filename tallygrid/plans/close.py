"""The closing job: a folder of ledgers in, totals and letters out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.functions.numbers import clean_amount
from tallygrid.operators.close_rules import DEFAULTS, Thresholds
from tallygrid.operators.concepts import concept_totals
from tallygrid.operators.letters import letter_bodies
from tallygrid.sources.ledgers import one_file_each, read_ledgers, write_quarantine, year_columns
from tallygrid.sources.letters import write_letters, write_packed_letters


def folder_totals(
    spark: SparkSession,
    path: str,
    years: tuple[int, int],
    client: Column | None = None,
    same_names: bool = False,
    damaged: str = "fail",
) -> DataFrame:
    """Concept totals of every ledger in a folder, straight from the wide lines.

    Clients are named by their files. If one name stands for files in several folders, the
    result raises an error, unless ``same_names`` says that these are one client's books.
    ``damaged`` lines fail the job, are left out or kept, see :func:`read_ledgers`.
    """
    checked = client is None and not same_names
    wide = read_ledgers(spark, path, client, with_path=True, damaged=damaged)
    columns = year_columns(wide)
    missing = [y for y in years if y not in columns]
    if missing:
        raise ValueError(f"no column for {missing} in {wide.columns}")
    current, previous = (clean_amount(F.col(f"`{columns[y]}`")) for y in years)
    if not checked:
        return concept_totals(wide, current, previous)
    ends = [F.min("path").alias("_first"), F.max("path").alias("_last")]
    hashed = wide.withColumn("path", F.xxhash64("path"))
    totals = concept_totals(hashed, current, previous, also=ends, keep=["path"])
    name = one_file_each(F.col("client"), F.col("_first"), F.col("_last"))
    return totals.withColumn("client", name).drop("_first", "_last")


def close_folder(
    spark: SparkSession,
    path: str,
    out: str,
    years: tuple[int, int],
    thresholds: Thresholds = DEFAULTS,
    same_names: bool = False,
    quarantine: str | None = None,
    packs: int | None = None,
) -> None:
    """Write one letter per client of a folder of ledgers, a file for each or, for very many clients, in
    ``packs`` files.

    A damaged line fails the job; with ``quarantine`` it is kept below that folder and the letters are
    written without it.
    """
    if quarantine:
        write_quarantine(spark, path, quarantine)
    totals = folder_totals(spark, path, years, same_names=same_names, damaged="leave_out" if quarantine else "fail")
    bodies = letter_bodies(totals, years, thresholds)
    if packs:
        write_packed_letters(bodies, out, packs)
    else:
        write_letters(bodies, out)
