"""Letters of many clients in few files."""

import pytest

from tallygrid.plans.close import close_folder
from tallygrid.sources.files import sizes
from tallygrid.sources.letters import find_letter, read_packed_letters, wrap_letter, write_packed_letters
from tests.ledger_files import EMPTY, FILLED, write

YEARS = (2025, 2024)


def bodies(spark, count):
    return spark.createDataFrame([(f"clienté {k}", f"Año {k}\nñandú €\n" * (k % 7)) for k in range(count)], "client string, body string")


def test_every_letter_comes_back(spark, tmp_path):
    df, path = bodies(spark, 500), str(tmp_path / "packs")
    write_packed_letters(df, path, packs=4)
    wanted = {(r.client, r.letter) for r in df.select("client", wrap_letter("body").alias("letter")).collect()}
    assert {tuple(r) for r in read_packed_letters(spark, path).collect()} == wanted
    assert len([f for f in sizes(spark, f"{path}/letters") if f.endswith(".txt")]) == 4
    index = {r.client: r for r in spark.read.parquet(f"{path}/index").collect()}
    assert len(index) == 500
    for client in ("clienté 0", "clienté 6", "clienté 499"):
        assert [tuple(r) for r in find_letter(spark, path, client).collect()] == [x for x in wanted if x[0] == client]
    assert find_letter(spark, path, "nobody").collect() == []


def test_letters_are_read_by_many_tasks(spark, tmp_path):
    """A pack can be cut anywhere; no letter is lost or doubled."""
    df, path = bodies(spark, 300), str(tmp_path / "packs")
    write_packed_letters(df, path, packs=1)
    settings = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "0"}
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        found = read_packed_letters(spark, path)
        assert found.rdd.getNumPartitions() > 10
        assert sorted(r.client for r in found.collect()) == sorted(f"clienté {k}" for k in range(300))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_a_letter_with_a_mark_is_an_error(spark, tmp_path):
    for body in ("a\x1eb", "a\x1fb"):
        with pytest.raises(Exception, match="holds a separator"):
            write_packed_letters(spark.createDataFrame([("a", body)], "client string, body string"), str(tmp_path / "p"), 2)


def test_folder_into_packs(spark, tmp_path):
    write(tmp_path / "in", "filled.csv", FILLED)
    path = write(tmp_path / "in", "empty.csv", EMPTY)
    close_folder(spark, path, str(tmp_path / "packs"), YEARS, packs=3)
    close_folder(spark, path, str(tmp_path / "files"), YEARS)
    files = {(r.client, r.value.rstrip("\n")) for r in spark.read.text(str(tmp_path / "files"), wholetext=True).collect()}
    assert {tuple(r) for r in read_packed_letters(spark, str(tmp_path / "packs")).collect()} == files
