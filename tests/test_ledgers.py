import json
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallygrid.operators.concepts import (
    CONCEPTS,
    Concept,
    concept_summary,
    account_totals,
    concepts_from_json,
    summary_by_label,
    pattern_total,
    to_summary,
    year_totals,
)
from tallygrid.plans.close import close_folder, folder_totals
from tallygrid.sources.ledgers import (
    amount_quality,
    land_bucketed,
    land_ledgers,
    open_bucketed,
    read_landed,
    read_ledgers,
    read_mixed_ledgers,
    to_long,
    trim_header,
    year_columns,
)
from tests.ledger_files import EMPTY, FILLED, FILLED_SUMMARY, write

YEARS = (2025, 2024)


def as_dict(summary):
    return {(r.client, r.concept): (r.y2025, r.y2024) for r in summary.collect()}


@pytest.fixture
def folder(tmp_path):
    write(tmp_path / "in", "filled.csv", FILLED)
    return write(tmp_path / "in", "empty 100%+.csv", EMPTY, bom=False)


def test_scan_reads_text_columns_and_names_clients(spark, folder):
    wide = read_ledgers(spark, folder)
    assert wide.columns == ["client", "label", "AÑO 2025", "AÑO 2024"]
    assert {t for _, t in wide.dtypes} == {"string"}
    assert year_columns(wide) == {2025: "AÑO 2025", 2024: "AÑO 2024"}
    counts = {r.client: r["count"] for r in wide.groupBy("client").count().collect()}
    assert counts == {"filled": 33, "empty 100%+": 33}
    assert wide.filter("label IS NULL").count() == 2
    assert wide.filter("label LIKE ' D)%'").count() == 1


def test_summary_of_the_filled_ledger(spark, folder):
    expected = {("filled", c): v for c, v in FILLED_SUMMARY.items()}
    expected |= {("empty 100%+", c): (0.0, 0.0) for c in FILLED_SUMMARY}
    assert as_dict(to_summary(folder_totals(spark, folder, YEARS), YEARS)) == expected
    assert as_dict(concept_summary(to_long(read_ledgers(spark, folder)), YEARS)) == expected
    assert as_dict(concept_summary(read_mixed_ledgers(spark, folder), YEARS)) == expected


def test_file_split_over_tasks(spark, folder):
    """One ledger file may be large enough for many tasks."""
    settings = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0"}
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        assert read_ledgers(spark, folder).select(F.spark_partition_id()).distinct().count() > 8
        totals = folder_totals(spark, folder, YEARS)
        for summary in (to_summary(totals, YEARS), concept_summary(read_mixed_ledgers(spark, folder), YEARS)):
            got = as_dict(summary)
            assert {c: got[("filled", c)] for c in FILLED_SUMMARY} == FILLED_SUMMARY
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


# Section lines and the account lines that make them up, by number of the data line.
SECTIONS = {2: [3], 4: [5, 6], 7: range(8, 18), 18: range(19, 23), 23: [24], 25: [26], 28: [29]}


@pytest.mark.parametrize("column", [1, 2])
def test_sections_equal_their_accounts(column):
    lines = [line.split(";") for line in FILLED.splitlines()]

    def amount(n):
        return Decimal(lines[n][column].replace(",", "."))

    for section, accounts in SECTIONS.items():
        assert amount(section) == sum(amount(n) for n in accounts)


def test_whole_numbers_are_not_read_as_floats(spark, tmp_path):
    path = write(tmp_path / "in", "a.csv", "Cuenta de Pérdidas y Ganancias ; AÑO 2025;AÑO 2024 \n;;\n6230 X;5305;10\n")
    assert as_dict(to_summary(folder_totals(spark, path, YEARS), YEARS))[("a", "Profesionales (6230)")] == (5305.0, 10.0)


@pytest.mark.parametrize(
    "header",
    [
        "Cuenta de Pérdidas y Ganancias;AÑO 2025;AÑO 2024;",
        '"Cuenta de Pérdidas y Ganancias"; AÑO 2025 ;"AÑO 2024";"a; b"',
        " Cuenta de Pérdidas y Ganancias ;AÑO 2025;AÑO 2024",
    ],
)
def test_header_layouts(spark, tmp_path, header):
    path = write(tmp_path / "in", "a.csv", f"{header}\n6230;1.000,5;2\n")
    expected = {2025: 1000.5, 2024: 2.0}
    for long in (to_long(read_ledgers(spark, path)), read_mixed_ledgers(spark, path)):
        assert {r.year: float(r.amount) for r in long.collect()} == expected


def test_repeated_header_is_a_line(spark, tmp_path):
    header = "Cuenta de Pérdidas y Ganancias;AÑO 2025;AÑO 2024"
    again = "Cuenta de Pérdidas y Ganancias;AÑO 2023;AÑO 2022"
    path = write(tmp_path / "in", "a.csv", f"{header}\n6230;1;2\n{header}\n{again}\n6230;3;4\n")
    for long in (to_long(read_ledgers(spark, path)), read_mixed_ledgers(spark, path)):
        sums = as_dict(concept_summary(long, YEARS))
        assert sums[("a", "Profesionales (6230)")] == (4.0, 6.0)
        assert long.count() == 8


def test_folder_without_a_ledger_is_an_error(spark, tmp_path):
    path = write(tmp_path / "in", "a.csv", "x;y\n1;2\n")
    for read in (read_ledgers, read_mixed_ledgers):
        with pytest.raises(ValueError):
            read(spark, path)


def test_trim_header(spark):
    assert trim_header(spark.range(1).toDF("  a b ")).columns == ["a b"]


def test_other_header_fails_instead_of_mixing_years(spark, tmp_path):
    write(tmp_path / "in", "a.csv", "Cuenta de Pérdidas y Ganancias;AÑO 2025;AÑO 2024\n6230;1;2\n")
    path = write(tmp_path / "in", "b.csv", "Cuenta de Pérdidas y Ganancias;AÑO 2024;AÑO 2023\n6230;3;4\n")
    with pytest.raises(Exception, match="CSV header does not conform"):
        folder_totals(spark, path, YEARS).collect()
    with pytest.raises(ValueError):
        folder_totals(spark, path, (2031, 2030))


def test_mixed_headers(spark, tmp_path):
    write(tmp_path / "in", "a.csv", "Cuenta de Pérdidas y Ganancias;AÑO 2025;AÑO 2024\n6230;1;2\n;;\n")
    write(tmp_path / "in", "b.csv", "Cuenta de Pérdidas y Ganancias;AÑO 2024;AÑO 2023\n6230;3;4\n6231;5;\n")
    path = write(tmp_path / "in", "c.csv", '"Cuenta de Pérdidas y Ganancias" ; AÑO 2025 ;nota;AÑO 2026\n6230;1,5;x;7\n')
    rows = read_mixed_ledgers(spark, path).filter("label IS NOT NULL").collect()
    got = sorted((r.client, r.label, r.year, float(r.amount)) for r in rows)
    assert got == [
        ("a", "6230", 2024, 2.0), ("a", "6230", 2025, 1.0),
        ("b", "6230", 2023, 4.0), ("b", "6230", 2024, 3.0), ("b", "6231", 2023, 0.0), ("b", "6231", 2024, 5.0),
        ("c", "6230", 2025, 1.5), ("c", "6230", 2026, 7.0),
    ]


def lines(spark, rows):
    return spark.createDataFrame(
        [(c, label, y, Decimal(str(a))) for c, label, y, a in rows],
        "client string, label string, year int, amount decimal(28,6)",
    )


def test_amount_quality(spark, tmp_path):
    rows = ["6230;1,234.56;abc", "6230;1.234,56;", "x;-;-12,345,678.9", ";;", "y;1_0; 5 "]
    header = "Cuenta de Pérdidas y Ganancias;AÑO 2025;AÑO 2024"
    path = write(tmp_path / "in", "a.csv", "\n".join([header, *rows]))
    write(tmp_path / "in", "b.csv", FILLED)
    got = {r.client: (r.unreadable, r.english) for r in amount_quality(read_ledgers(spark, path)).collect()}
    # -12,345,678.9 is both: with every comma a decimal point it is no number.
    assert got == {"a": (3, 2), "b": (0, 0)}


def test_landed_ledger_reads_only_the_years_it_needs(spark, tmp_path):
    path = str(tmp_path / "landed")
    land_ledgers(lines(spark, [("a", "6230", y, y) for y in (2022, 2023, 2024, 2025)]), path)
    landed = spark.read.parquet(path)
    summary = concept_summary(landed, YEARS, prune=True)
    scan = summary._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [year" in scan.replace("isnotnull(", "")
    assert as_dict(summary)[("a", "Profesionales (6230)")] == (2025.0, 2024.0)


def test_pattern_total(spark):
    df = lines(spark, [("a", "6230 X", 2025, 1.25), ("a", "16230", 2024, 2), ("a", None, 2025, 9), ("b", "7", 2025, 4)])
    got = pattern_total(df, "6230", YEARS)
    assert {r.client: (float(r["cur"]), float(r["prev"])) for r in got.collect()} == {"a": (1.25, 2.0), "b": (0.0, 0.0)}


def test_anchored_summary(spark):
    df = lines(spark, [("a", " 6400 S", 2025, 1), ("a", "16400", 2025, 2)])
    assert as_dict(concept_summary(df, YEARS, anchored=True))[("a", "Salarios")] == (1.0, 0.0)
    assert as_dict(concept_summary(df, YEARS))[("a", "Salarios")] == (3.0, 0.0)


def test_concepts_may_overlap(spark):
    df = lines(spark, [("a", "6230 640", 2025, 5)])
    got = as_dict(concept_summary(df, YEARS))
    assert got[("a", "Salarios")] == got[("a", "Profesionales (6230)")] == (5.0, 0.0)


def test_client_of_other_years_has_zeros(spark):
    df = lines(spark, [("a", "6230", 2025, 1), ("b", "6230", 2019, 5)])
    for summary in (concept_summary, summary_by_label):
        got = as_dict(summary(df, YEARS))
        assert got[("b", "Profesionales (6230)")] == (0.0, 0.0) and len(got) == 20
        assert {c for c, _ in as_dict(summary(df, YEARS, prune=True))} == {"a"}


@pytest.mark.parametrize("size", [5, 26, 230])
def test_pattern_table_of_any_length(spark, size):
    patterns = concepts_from_json(json.dumps({f"c{n}": f"^{n} " for n in range(size)}))
    df = lines(spark, [(c, f"{n} x", 2025, n) for n in range(size) for c in "ab"] + [("c", None, 2024, 1)])
    expected = {(c, f"c{n}"): (float(n) if c in "ab" else 0.0, 0.0) for n in range(size) for c in "abc"}
    assert as_dict(summary_by_label(df, YEARS, concepts=patterns)) == expected
    if size < 100:
        assert as_dict(concept_summary(df, YEARS, concepts=patterns)) == expected


def test_both_summaries_agree(spark, folder, monkeypatch):
    long = to_long(read_ledgers(spark, folder))
    short = as_dict(concept_summary(long, YEARS))
    monkeypatch.setattr("tallygrid.operators.concepts.PATTERNS_PER_PASS", 4)
    assert as_dict(summary_by_label(long, YEARS)) == short
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert as_dict(summary_by_label(long, YEARS)) == short
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_summary_by_label_reads_the_lines_once_more(spark, tmp_path):
    """One scan for the distinct labels, stored before, and one for the amounts."""
    land_ledgers(lines(spark, [("a", "6230", 2025, 1)]), str(tmp_path / "landed"))
    plan = plan_of(summary_by_label(spark.read.parquet(str(tmp_path / "landed")), YEARS))
    # Long locations are cut short in the text of a plan, so scans are told apart by what they read.
    assert plan.count("FileScan parquet") == 2 and plan.count("amount#") > 0
    assert len(re.findall(r"ReadSchema: struct<client:string,label:string,amount", plan)) == 1


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_folder_totals_are_added_up_in_hash_tables(spark, folder):
    plan = plan_of(folder_totals(spark, folder, YEARS))
    assert plan.count("HashAggregate") == 2 and "SortAggregate" not in plan


def test_mixed_headers_are_read_without_a_join(spark, tmp_path):
    write(tmp_path / "in", "a+ [1] {x}.csv", "Cuenta de Pérdidas y Ganancias;AÑO 2025;AÑO 2024\n6230;1;2\n")
    write(tmp_path / "in", "b %41.csv", "Cuenta de Pérdidas y Ganancias;AÑO 2025;AÑO 2024\n6230;3;4\n")
    path = write(tmp_path / "in", "c.csv", "Cuenta de Pérdidas y Ganancias;AÑO 2020;AÑO 2019\n6230;5;6\n")
    (tmp_path / "in" / "empty.csv").write_text("")
    every = read_mixed_ledgers(spark, path)
    plan = plan_of(every)
    assert "Join" not in plan and plan.count("FileScan csv") == 2
    got = sorted((r.client, r.year, float(r.amount)) for r in every.collect())
    assert got == [("a+ [1] {x}", 2024, 2.0), ("a+ [1] {x}", 2025, 1.0), ("b %41", 2024, 4.0), ("b %41", 2025, 3.0),
                   ("c", 2019, 6.0), ("c", 2020, 5.0)]
    some = read_mixed_ledgers(spark, path, years=[2025])
    assert plan_of(some).count("FileScan csv") == 1  # files of other years are not read
    assert sorted((r.client, float(r.amount)) for r in some.collect()) == [("a+ [1] {x}", 1.0), ("b %41", 3.0)]
    with pytest.raises(ValueError):
        read_mixed_ledgers(spark, path, years=[1999])
    write(tmp_path / "in", "d.csv", "no;header\n1;2\n")
    with pytest.raises(ValueError, match="have no header"):
        read_mixed_ledgers(spark, path)


def bucketed(spark, tmp_path, rows, buckets=8):
    name, path = f"landed_{tmp_path.name.replace('-', '_')}", str(tmp_path / "landed")
    land_bucketed(lines(spark, rows), name, path, buckets)
    return name, path


def test_totals_of_a_bucketed_ledger_need_no_shuffle(spark, tmp_path):
    rows = [(f"c{k % 97}", "6230 X", 2024 + k % 2, k) for k in range(970)]
    name, path = bucketed(spark, tmp_path, rows)
    found = concept_summary(read_landed(spark, name, path), YEARS)
    assert "Exchange" not in plan_of(found) and "Bucketed: true" in plan_of(found)
    assert as_dict(found) == as_dict(concept_summary(lines(spark, rows), YEARS))
    # The same files under another name, as in a session that did not write them.
    open_bucketed(spark, f"{name}_again", path, 8)
    again = concept_summary(read_landed(spark, f"{name}_again", path), YEARS, prune=True)
    assert "Exchange" not in plan_of(again) and as_dict(again) == as_dict(found)


def test_a_client_that_fills_a_bucket_is_read_by_many_tasks(spark, tmp_path):
    rows = [("hot" if k % 20 else f"c{k}", "6230 X", 2025, k) for k in range(20_000)]
    name, path = bucketed(spark, tmp_path, rows)
    found = concept_summary(read_landed(spark, name, path, most=2.0), YEARS)
    assert "partial_sum" in plan_of(found) and plan_of(found).count("Exchange hashpartitioning") == 1
    assert as_dict(found) == as_dict(concept_summary(lines(spark, rows), YEARS))


@pytest.mark.parametrize("text", ["{}", "[]", '{"a": 1}', '{"a": "1", "a": "2"}', '{"a": null}'])
def test_pattern_table_is_checked(text):
    with pytest.raises(ValueError):
        concepts_from_json(text)


def test_account_totals(spark):
    rows = [("a", " 6230 X", 2025, 1), ("a", "6239 Y", 2024, 2), ("a", "62 Z", 2025, 9), ("b", None, 2025, 9), ("b", "7000", 2019, 3)]
    got = {(r.client, r.account, r.y2025, r.y2024) for r in account_totals(lines(spark, rows), YEARS).collect()}
    assert got == {("a", "623", 1.0, 2.0), ("b", "700", 0.0, 0.0)}
    assert {r.account for r in account_totals(lines(spark, rows), YEARS, digits=4).collect()} == {"6230", "6239", "7000"}


def test_one_name_for_two_files_is_an_error(spark, tmp_path):
    for part in "xy":
        write(tmp_path / "in" / part, "datos.csv", FILLED)
    path = str(tmp_path / "in" / "*")
    with pytest.raises(Exception, match="two ledgers are named datos"):
        folder_totals(spark, path, YEARS).collect()
    one = folder_totals(spark, str(tmp_path / "in" / "x"), YEARS).first()
    both = folder_totals(spark, path, YEARS, same_names=True).first()
    assert both.gastos_cur == 2 * one.gastos_cur != 0


def test_hot_client_is_added_up_before_the_shuffle(spark):
    """One client holds most lines: at most one row per task and client is moved."""
    rows = spark.range(0, 90_000, 1, 9).select(
        F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 7)).alias("client"),
        F.lit("6230 X").alias("label"),
        F.lit(2025).alias("year"),
        F.lit("0.01").cast("decimal(38,6)").alias("amount"),
    )
    totals = year_totals(rows, YEARS)
    plan = totals._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_sum" in plan
    assert {r.client: r.profesionales_cur for r in totals.collect()}["hot"] == Decimal("810")


def test_keys_of_concepts_are_unique():
    assert len({c.key for c in CONCEPTS}) == len({c.name for c in CONCEPTS}) == 10
    assert all(isinstance(c, Concept) for c in CONCEPTS)


def test_close_folder_writes_a_letter_per_client(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    close_folder(spark, folder, out, YEARS)
    letters = spark.read.text(out, wholetext=True).collect()
    assert sorted(r.client for r in letters) == ["empty 100%+", "filled"]
    assert all(r.value.startswith("Estimado cliente,\n\n[RESULTADO E IMPUESTO]\n") for r in letters)
