import pytest
from pyspark.sql import functions as F

from tallygrid.operators.concepts import to_summary
from tallygrid.plans.close import close_folder, folder_totals
from tallygrid.streaming.arrivals import arrived_totals, close_arrivals, ledger_stream
from tallygrid.streaming.totals_store import TotalsStore, client_totals
from tests.ledger_files import EMPTY, FILLED, FILLED_SUMMARY, write

YEARS = (2025, 2024)


def as_set(summary):
    return {tuple(r) for r in summary.collect()}


def test_stream_agrees_with_batch_and_takes_up_new_files(spark, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "progress")

    def run():
        lines = ledger_stream(spark, path, YEARS, files_per_batch=1)
        close_arrivals(lines, out, checkpoint).awaitTermination()
        return as_set(to_summary(arrived_totals(spark, out), YEARS))

    path = write(tmp_path / "in", "a.csv", FILLED)
    write(tmp_path / "in", "b.csv", EMPTY)
    assert run() == as_set(to_summary(folder_totals(spark, path, YEARS), YEARS))
    assert run() == as_set(to_summary(folder_totals(spark, path, YEARS), YEARS))
    write(tmp_path / "in", "late.csv", FILLED)
    got = run()
    assert got == as_set(to_summary(folder_totals(spark, path, YEARS), YEARS))
    assert {("late", c, *v) for c, v in FILLED_SUMMARY.items()} < got


def test_stream_writes_the_letters_of_the_batch_job(spark, tmp_path):
    path = write(tmp_path / "in", "a.csv", FILLED)
    write(tmp_path / "in", "b.csv", EMPTY)
    streamed, batch = str(tmp_path / "streamed"), str(tmp_path / "batch")
    lines = ledger_stream(spark, path, YEARS, files_per_batch=1)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "progress")
    close_arrivals(lines, out, checkpoint, streamed, YEARS).awaitTermination()
    close_folder(spark, path, batch, YEARS)
    read = [spark.read.text(p, wholetext=True).select("client", "value") for p in (streamed, batch)]
    assert as_set(read[0]) == as_set(read[1]) and read[0].count() == 2
    with pytest.raises(ValueError):
        close_arrivals(lines, out, checkpoint, streamed)


def test_repeated_batch_replaces_its_own_output(spark, tmp_path):
    path = write(tmp_path / "in", "a.csv", FILLED)
    out = str(tmp_path / "out")
    for attempt in ("one", "two"):  # a lost checkpoint replays batch 0
        lines = ledger_stream(spark, path, YEARS)
        close_arrivals(lines, out, str(tmp_path / attempt)).awaitTermination()
    assert as_set(to_summary(arrived_totals(spark, out), YEARS)) == {("a", c, *v) for c, v in FILLED_SUMMARY.items()}


HEADER = "Cuenta de Pérdidas y Ganancias;AÑO 2025;AÑO 2024\n"


def sales(folder, name, amount):
    return write(folder, name, f"{HEADER}1. Importe neto de la cifra de negocios;{amount};1\n")


@pytest.mark.parametrize("runs", [(1,), (10,), (1, 10), (10, 1)])
def test_client_with_files_in_several_batches_and_runs(spark, tmp_path, runs):
    """One letter, with the rate of all files, also when batches are cut anew after a lost checkpoint."""
    out, letters = str(tmp_path / "out"), str(tmp_path / "letters")
    path = sales(tmp_path / "in", "a.csv", "400.000")
    sales(tmp_path / "in", "b.csv", "700.000")
    for n, limit in enumerate(runs):
        lines = ledger_stream(spark, path, YEARS, F.lit("one"), files_per_batch=limit)
        close_arrivals(lines, out, str(tmp_path / f"progress{n}"), letters, YEARS).awaitTermination()
    assert arrived_totals(spark, out).first().ventas_cur == 1_100_000
    found = spark.read.text(letters, wholetext=True).collect()
    assert len(found) == 1 and "25%" in found[0].value and "23%" not in found[0].value
    # A file that arrives on another day changes the letter of its client only.
    sales(tmp_path / "in", "c.csv", "1.000")
    lines = ledger_stream(spark, path, YEARS, F.lit("one"))
    close_arrivals(lines, out, str(tmp_path / "progress0"), letters, YEARS).awaitTermination()
    assert arrived_totals(spark, out).first().ventas_cur == 1_101_000


def test_same_name_in_two_folders_is_an_error(spark, tmp_path):
    for part in "xy":
        sales(tmp_path / "in" / part, "datos.csv", "600.000")
    for allowed in (False, True):
        out = str(tmp_path / f"out{allowed}")
        lines = ledger_stream(spark, str(tmp_path / "in" / "*"), YEARS, same_names=allowed)
        close_arrivals(lines, out, str(tmp_path / f"progress{allowed}")).awaitTermination()
        if allowed:
            assert arrived_totals(spark, out).first().ventas_cur == 1_200_000
        else:
            with pytest.raises(Exception, match="two ledgers are named datos"):
                arrived_totals(spark, out).collect()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def arrive(spark, tmp_path, count, **more):
    """Files of ``count`` clients, one in each batch; returns the folder of the store."""
    path = ""
    for k in range(count):
        path = sales(tmp_path / "in", f"c{k:02}.csv", str(k + 1))
    out = str(tmp_path / "out")
    lines = ledger_stream(spark, path, YEARS, files_per_batch=1)
    close_arrivals(lines, out, str(tmp_path / "progress"), **more).awaitTermination()
    return out


def test_a_batch_reads_the_buckets_of_its_clients(spark, tmp_path):
    out = arrive(spark, tmp_path, 5, buckets=64)
    store = TotalsStore(spark, out)
    assert store.buckets == 64
    one = spark.createDataFrame([("c03",), ("new",)], "client string")
    found = store.current(one)
    numbers = sorted({r.b for r in one.select(store.bucket().alias("b")).collect()})
    plan = plan_of(found)
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "bucket") and all(str(n) in plan for n in numbers)
    read = {r.b for r in store.rows(numbers).select(F.col("bucket").alias("b"), F.input_file_name()).distinct().collect()}
    assert read <= set(numbers) and len(read) < store.rows().select("bucket").distinct().count()
    assert [(r.client, r.ventas_cur) for r in client_totals(found).collect()] == [("c03", 4)]
    # A later run with another number of buckets finds what is there.
    assert TotalsStore(spark, out, buckets=8).buckets == 64


def test_parts_are_merged_by_levels(spark, tmp_path, fan=2):
    out = arrive(spark, tmp_path, 6, buckets=4, fan=fan)
    store = TotalsStore(spark, out)
    counts = {level: len(store.parts(level)) for level in store.levels()}
    assert max(counts.values()) < fan and max(counts) >= 2
    assert {r.client: int(r.ventas_cur) for r in arrived_totals(spark, out).collect()} == {f"c{k:02}": k + 1 for k in range(6)}


def test_parts_beside_what_they_were_merged_into_change_nothing(spark, tmp_path, monkeypatch):
    """As after a failure between the two steps of a merge."""
    monkeypatch.setattr("tallygrid.streaming.totals_store.delete", lambda spark, path: None)
    out = arrive(spark, tmp_path, 4, buckets=4, fan=4)
    store = TotalsStore(spark, out)
    assert len(store.parts(0)) == 4 and len(store.parts(1)) == 1
    assert {r.client: int(r.ventas_cur) for r in arrived_totals(spark, out).collect()} == {f"c{k:02}": k + 1 for k in range(4)}


def test_a_file_that_comes_again_after_a_merge_replaces_its_totals(spark, tmp_path):
    out = arrive(spark, tmp_path, 4, buckets=4, fan=2)
    sales(tmp_path / "in", "c01.csv", "50")
    lines = ledger_stream(spark, str(tmp_path / "in"), YEARS)
    close_arrivals(lines, out, str(tmp_path / "again"), fan=2).awaitTermination()
    assert {r.client: int(r.ventas_cur) for r in arrived_totals(spark, out).collect()} == {"c00": 1, "c01": 50, "c02": 3, "c03": 4}


def test_two_stores_in_one_folder_are_an_error(spark, tmp_path):
    for n in (4, 8):
        (tmp_path / "out" / f"of={n}").mkdir(parents=True)
    with pytest.raises(ValueError):
        TotalsStore(spark, str(tmp_path / "out"))
