"""Lines that cannot be read as the header says."""

import pytest
from pyspark.sql import functions as F

from tallygrid.operators.concepts import to_summary
from tallygrid.plans.close import close_folder, folder_totals
from tallygrid.sources.ledgers import (
    damaged_counts,
    damaged_lines,
    read_ledgers,
    read_mixed_ledgers,
    to_long,
    write_quarantine,
)
from tallygrid.streaming.arrivals import arrived_totals, close_arrivals, ledger_stream
from tests.ledger_files import FILLED, FILLED_SUMMARY, write

YEARS = (2025, 2024)
HEADER = "Cuenta de Pérdidas y Ganancias;AÑO 2025;AÑO 2024"
BAD = {
    "6230 Prof;10,00;9,00;77,00;x": ("fields", 5),
    "6230 Prof;10,00;9,00;": ("fields", 4),
    '"6230 a; b";1;2;3': ("fields", 4),
    '6230 x;"10,00;9,00': ("quote", 3),
}
GOOD = ["6230 A;1;2", ";;", "", "6230 B;5,00", "6230 C", '"6230 D; E";7;8', '6230 5" pipe;1;1', '"6230 ""quoted"" F";1;1']


@pytest.fixture
def folder(spark, tmp_path):
    write(tmp_path / "in", "good.csv", FILLED)
    write(tmp_path / "in", "a.csv", "\n".join([HEADER, *GOOD, *BAD]) + "\n")
    return write(tmp_path / "in", "b+ %.csv", "\n".join([HEADER, next(iter(BAD)), "6230 A;1;2"]) + "\n")


def test_damaged_lines_fail_the_job(spark, folder):
    for job in (
        lambda: read_ledgers(spark, folder).count(),
        lambda: read_ledgers(spark, folder).select("client").collect(),
        lambda: read_mixed_ledgers(spark, folder).count(),
        lambda: folder_totals(spark, folder, YEARS).collect(),
    ):
        with pytest.raises(Exception, match="damaged ledger line"):
            job()
    with pytest.raises(ValueError):
        read_ledgers(spark, folder, damaged="ignore")


def test_damaged_lines_are_named(spark, folder):
    found = damaged_lines(spark, folder)
    rows = found.collect()
    assert {r.line: (r.reason, r.fields) for r in rows if r.client == "a"} == BAD
    assert {(r.client, r.line) for r in rows if r.client != "a"} == {("b+ %", next(iter(BAD)))}
    counts = {(r.client, r.path.rpartition("/")[2], r.reason): r.n for r in damaged_counts(found).collect()}
    assert counts == {("a", "a.csv", "fields"): 3, ("a", "a.csv", "quote"): 1, ("b+ %", "b+%20%25.csv", "fields"): 1}


def test_the_other_lines_stay(spark, folder):
    for long in (
        to_long(read_ledgers(spark, folder, damaged="leave_out")),
        read_mixed_ledgers(spark, folder, damaged="leave_out"),
    ):
        sums = {
            (r.client, r.year): float(r.amount)
            for r in long.where("client <> 'good'").groupBy("client", "year").agg(F.sum("amount").alias("amount")).collect()
        }
        assert sums == {("a", 2025): 15.0, ("a", 2024): 12.0, ("b+ %", 2025): 1.0, ("b+ %", 2024): 2.0}
    kept = to_long(read_ledgers(spark, folder, damaged="keep")).where("client = 'b+ %' AND year = 2025")
    assert sorted(float(r.amount) for r in kept.collect()) == [1.0, 10.0]


def test_damaged_lines_of_files_cut_over_tasks(spark, folder):
    settings = {"spark.sql.files.maxPartitionBytes": "100", "spark.sql.files.openCostInBytes": "0"}
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        assert damaged_lines(spark, folder).count() == 5
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_quarantine_beside_the_letters(spark, folder, tmp_path):
    counts = write_quarantine(spark, folder, str(tmp_path / "kept"))
    assert {r.client: r["sum(n)"] for r in counts.groupBy("client").sum("n").collect()} == {"a": 4, "b+ %": 1}
    close_folder(spark, folder, str(tmp_path / "out"), YEARS, quarantine=str(tmp_path / "quarantine"))
    assert spark.read.parquet(str(tmp_path / "quarantine")).count() == 5
    assert spark.read.text(str(tmp_path / "out"), wholetext=True).select("client").distinct().count() == 3
    with pytest.raises(Exception, match="damaged ledger line"):
        close_folder(spark, folder, str(tmp_path / "strict"), YEARS)


def test_sound_files_have_no_damaged_lines(spark, tmp_path):
    path = write(tmp_path / "in", "good.csv", FILLED)
    assert damaged_lines(spark, path).count() == 0
    got = to_summary(folder_totals(spark, path, YEARS), YEARS).collect()
    assert {r.concept: (r.y2025, r.y2024) for r in got} == FILLED_SUMMARY


def test_damaged_lines_of_a_stream(spark, folder, tmp_path):
    with pytest.raises(Exception, match="damaged ledger line"):
        close_arrivals(ledger_stream(spark, folder, YEARS), str(tmp_path / "o1"), str(tmp_path / "p1")).awaitTermination()
    lines = ledger_stream(spark, folder, YEARS, damaged="leave_out")
    close_arrivals(lines, str(tmp_path / "o2"), str(tmp_path / "p2")).awaitTermination()
    got = {r.client: float(r.profesionales_cur) for r in arrived_totals(spark, str(tmp_path / "o2")).collect()}
    assert got["a"] == 15.0 and got["b+ %"] == 1.0
