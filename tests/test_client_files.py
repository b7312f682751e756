import os
import threading

import pytest

from tallygrid.plans import tables
from tallygrid.sources.files import one_listing
from tallygrid.sources.ledgers import LABEL_HEADER, read_ledgers
from tallygrid.sources.letters import write_letters


def test_client_files_are_renamed_many_at_a_time(spark, monkeypatch, tmp_path):
    lines = [(k, k % 7, k % 5, 1, 10.5, "A", "F", "1996-01-02") for k in range(200)]
    schema = (
        "l_orderkey long, l_suppkey long, l_partkey long, l_linenumber long, l_extendedprice double, "
        "l_returnflag string, l_linestatus string, l_shipdate string"
    )
    items = spark.createDataFrame(lines, schema).selectExpr("* except (l_shipdate)", "date(l_shipdate) AS l_shipdate")
    items.write.parquet(str(tmp_path / "lineitem.parquet"))
    threads, real = set(), tables._hadoop

    def recorded(spark, path):
        files, maker = real(spark, path)
        return files, lambda p: (threads.add(threading.get_ident()), maker(p))[1]

    monkeypatch.setattr(tables, "_hadoop", recorded)
    monkeypatch.setattr(tables, "RENAMES", 2)
    path = tables.write_client_files(spark, str(tmp_path))
    wanted = {f"{2 * (k % 7) + k % 2}.csv" for k in range(200)}
    assert {name for name in os.listdir(path) if not name.startswith(".")} == wanted
    assert len(threads) >= 2


def ledgers(folder, n):
    folder.mkdir()
    for k in range(n):
        (folder / f"{k}.csv").write_text(f"{LABEL_HEADER};AÑO 2025;AÑO 2024\n6400 SUELDOS;{k},00;1,00\n", encoding="utf-8")
    return f"{folder}/*.csv"


def test_a_folder_is_listed_once(spark, tmp_path):
    """Over 32 files that a pattern names would be listed by Spark jobs, each file by itself."""
    jobs = {}
    for n in (3, 40):
        path = ledgers(tmp_path / f"f{n}", n)
        spark.sparkContext.setJobGroup(f"{tmp_path}{n}", "")
        rows = read_ledgers(spark, path)
        jobs[n] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"{tmp_path}{n}"))
        assert sorted(int(r.client) for r in rows.collect()) == list(range(n))
    spark.sparkContext.setJobGroup("", "")
    assert jobs[3] == jobs[40]


def test_other_patterns_are_left_to_spark(spark, tmp_path):
    path = ledgers(tmp_path / "flat", 2)
    (tmp_path / "flat" / "0.txt").write_text("no ledger")
    assert one_listing(spark, path) == (f"{tmp_path}/flat", {"pathGlobFilter": "*.csv"})
    assert sorted(r.client for r in read_ledgers(spark, path).collect()) == ["0", "1"]
    for same in (f"{tmp_path}/flat/1.csv", f"{tmp_path}/fl*/*.csv", f"{tmp_path}/flat/*.tsv", f"{tmp_path}/none/*.csv", [path], str(tmp_path)):
        assert one_listing(spark, same) == (same, {})
    ledgers(tmp_path / "flat" / "sub", 3)
    assert one_listing(spark, path) == (path, {})
    assert sorted(r.client for r in read_ledgers(spark, path).collect()) == ["0", "1"]
    with pytest.raises(Exception, match="(?i)path"):
        read_ledgers(spark, f"{tmp_path}/flat/*.tsv")


def test_letters_are_written_by_many_tasks(spark, tmp_path):
    few = spark.range(64).selectExpr("id AS client", "concat('letter ', id) AS body").groupBy("client").agg({"body": "min"})
    write_letters(few.withColumnRenamed("min(body)", "body"), str(tmp_path / "out"))
    written = [f for _, _, files in os.walk(tmp_path / "out") for f in files if f.startswith("part-")]
    assert len(written) == 64 and len({f[:10] for f in written}) > 3
