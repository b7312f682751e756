"""Profit-and-loss ledgers from semicolon CSV files, one file per client."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrid.functions.numbers import clean_amount, is_english, is_unreadable
from tallygrid.sources.files import one_listing, sizes

# The header of a ledger file.
LABEL_HEADER = "Cuenta de Pérdidas y Ganancias"
YEAR_HEADER = r"AÑO (\d{4})"

CSV_OPTIONS = {"sep": ";", "header": "true", "encoding": "UTF-8", "escape": '"'}


def file_client() -> Column:
    """Client named by the ledger file: the file name without ``.csv``."""
    # file_name is URI-encoded except that a plus sign stays a plus sign.
    name = F.url_decode(_plus_kept(F.col("_metadata.file_name")))
    return F.regexp_replace(name, r"(?i)\.csv$", "")


def file_path() -> Column:
    """Full path of the ledger file a line comes from."""
    return F.col("_metadata.file_path")


def one_file_each(client: Column, first: Column, last: Column) -> Column:
    """The client, or an error if its name stands for several files.

    ``first`` and ``last`` are the least and the greatest hash of the paths of its lines: numbers, unlike
    texts, are added up in a hash table. Two different paths share a hash once in 10^19.
    """
    text = F.concat(F.lit("two ledgers are named "), client.cast("string"), F.lit(" in different folders"))
    return F.when(first != last, F.raise_error(text).cast("string")).otherwise(client)


def read_ledgers(
    spark: SparkSession,
    path: str | list[str],
    client: Column | None = None,
    with_path: bool = False,
    damaged: str = "fail",
) -> DataFrame:
    """Wide ledger lines: ``client``, ``label`` and one text column per year; ``path`` if asked for.

    Every column is read as text: with inferred types a column of whole numbers
    would turn 5305 into 5305.0 and, once the points are dropped, into 53050.
    All files must share one header; a file with another fails the job instead of
    putting amounts under the wrong year. See :func:`read_mixed_ledgers` for those.

    A line with fewer fields than the header is filled up with nulls. A line with more fields, or with a
    quote that is never closed, is damaged, and which amount belongs to which year is unknown: it fails the
    job, is left out (``damaged="leave_out"``; :func:`damaged_lines` has these lines) or keeps the fields
    that the header names (``"keep"``).
    """
    lines = _read_lines(spark, path, client, first_header(spark, path))
    named = checked_lines(lines, damaged)
    return named if with_path else named.drop("path")


def _read_lines(spark: SparkSession, path: str | list[str], client: Column | None, names: list[str]) -> DataFrame:
    """Lines of files that share the header ``names``, with ``path`` and what :func:`checked_lines` needs."""
    schema = T.StructType([T.StructField(name, T.StringType()) for name in [*names, LINE]])
    where, some = one_listing(spark, path)
    raw = spark.read.schema(schema).options(**CSV_OPTIONS, **KEEP_LINE, **some, enforceSchema="false").csv(where)
    named = raw.select(
        (client if client is not None else file_client()).alias("client"),
        *[f"`{name}`" for name in names if name.strip()],
        file_path().alias("path"),
        damage(kept_line(names), len(names)).alias(DAMAGE),
        LINE,
    )
    return trim_header(named).withColumnRenamed(LABEL_HEADER, "label")


# The reader keeps the text of a line whose number of fields differs from the header's, if it parses all fields.
LINE, DAMAGE = "_line", "_damage"
KEEP_LINE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": LINE, "columnPruning": "false"}


def kept_line(names: Sequence[str]) -> Column:
    """The text of a line that the reader kept. A read needs another column beside it: the first."""
    return F.when(F.col(f"`{names[0]}`").isNotNull() | F.col(LINE).isNotNull(), F.col(LINE))


def field_count(line: Column) -> Column:
    """Fields of a line; separators inside quotes are no separators."""
    bare = F.regexp_replace(line, '"[^"]*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(";"), F.lit(""))) + 1


def damage(line: Column, width: int) -> Column:
    """Why a line cannot be trusted: ``quote`` (opened and not closed) or ``fields`` (more than ``width``).

    ``line`` is null for lines of ``width`` fields. Shorter lines are no damage: null.
    """
    bare = F.regexp_replace(line, '"[^"]*"', "")
    return F.when(bare.rlike(r'(^|;)\s*"'), "quote").when(field_count(line) > width, "fields")


def checked_lines(lines: DataFrame, damaged: str) -> DataFrame:
    """Lines without the two columns of the check: damaged ones fail the job, are left out or kept."""
    bad = F.col(DAMAGE).isNotNull()
    if damaged == "fail":
        text = F.concat(F.lit("damaged ledger line ("), DAMAGE, F.lit(") of "), F.col("client").cast("string"), F.lit(": "), LINE)
        lines = lines.where(F.when(bad, F.raise_error(text).cast("boolean")).otherwise(True))
    elif damaged == "leave_out":
        lines = lines.where(~bad)
    elif damaged != "keep":
        raise ValueError(f"damaged is fail, leave_out or keep, not {damaged!r}")
    return lines.drop(DAMAGE, LINE)


def damaged_lines(spark: SparkSession, path: str | list[str], client: Column | None = None) -> DataFrame:
    """The damaged lines of ledgers that share one header: ``client``, ``path``, ``reason`` (``fields`` or
    ``quote``), ``fields`` and the ``line`` as it is written."""
    lines = _read_lines(spark, path, client, first_header(spark, path))
    return lines.where(F.col(DAMAGE).isNotNull()).select(
        "client", "path", F.col(DAMAGE).alias("reason"), field_count(F.col(LINE)).alias("fields"), F.col(LINE).alias("line")
    )


def damaged_counts(damaged: DataFrame) -> DataFrame:
    """Number of damaged lines of each client, file and reason."""
    return damaged.groupBy("client", "path", "reason").agg(F.count("*").alias("n"))


def write_quarantine(
    spark: SparkSession, path: str | list[str], out: str, client: Column | None = None, mode: str = "errorifexists"
) -> DataFrame:
    """Keep the damaged lines as Parquet below ``out``; returns their numbers by client, file and reason."""
    damaged_lines(spark, path, client).write.mode(mode).parquet(out)
    return damaged_counts(spark.read.parquet(out))


def header_line() -> Column:
    """A line of text without the byte order mark a file may start with."""
    return F.regexp_replace("value", "^\ufeff", "")


def is_header(line: Column) -> Column:
    return line.rlike(rf'^\s*"?\s*{LABEL_HEADER}\s*"?\s*(;|$)')


def split_header(line: Column, width: int) -> Column:
    """The names in a header line, read by the CSV parser; missing ones are null."""
    schema = ", ".join(f"c{k} string" for k in range(width))
    parsed = F.from_csv(line, F.lit(schema), {k: v for k, v in CSV_OPTIONS.items() if k in ("sep", "escape")})
    return F.array(*[parsed[f"c{k}"] for k in range(width)])


def first_header(spark: SparkSession, path: str | list[str]) -> list[str]:
    """Column names of the first file found.

    Left to itself, the CSV reader would look at every file of the folder one by one
    on the driver before it takes the names from the first.
    """
    where, some = one_listing(spark, path)
    found = spark.read.options(**some).text(where).select(header_line().alias("line")).filter(is_header(F.col("line"))).first()
    if found is None:
        raise ValueError(f"no file under {path} has a header starting with {LABEL_HEADER!r}")
    return _names_in(spark, found.line)


def _names_in(spark: SparkSession, line: str) -> list[str]:
    width = re.sub('"[^"]*"', "", line).count(";") + 1
    names = spark.range(1).select(split_header(F.lit(line), width).alias("names")).first().names
    return [name or "" for name in names]


def trim_header(df: DataFrame) -> DataFrame:
    """Strip blanks round the column names."""
    return df.toDF(*[c.strip() for c in df.columns])


def year_columns(wide: DataFrame) -> dict[int, str]:
    """Year -> column name, found by the header pattern."""
    found = {c: re.fullmatch(YEAR_HEADER, c) for c in wide.columns}
    return {int(m.group(1)): c for c, m in found.items() if m}


def to_long(wide: DataFrame, keys: Sequence[str] = ("client",)) -> DataFrame:
    """One row per line and year: keys, ``label``, ``year``, ``amount``."""
    years = year_columns(wide)
    if not years:
        raise ValueError(f"no column named like {YEAR_HEADER!r} in {wide.columns}")
    cells = [F.struct(F.lit(y).alias("year"), F.col(f"`{c}`").alias("amount_text")) for y, c in years.items()]
    long = wide.select(*keys, "label", F.inline(F.array(*cells)))
    return long.select(
        *keys, "label", F.col("year").cast("int").alias("year"), clean_amount("amount_text").alias("amount")
    )


def amount_quality(wide: DataFrame, keys: Sequence[str] = ("client",)) -> DataFrame:
    """Amount texts per client that :func:`clean_amount` reads without complaint though
    they are no Spanish numbers: ``unreadable`` (made 0) and ``english`` layout."""
    texts = [F.col(f"`{c}`") for c in year_columns(wide).values()]

    def count(wrong: Callable[[Column], Column]) -> Column:
        return F.sum(sum((wrong(t).cast("int") for t in texts), F.lit(0)))

    return wide.groupBy(*keys).agg(
        count(is_unreadable).alias("unreadable"), count(is_english).alias("english")
    )


def land_ledgers(long: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Keep long lines as Parquet, a folder per year, for ledgers read more than once.

    Each task writes one file per year it holds; nothing is shuffled.
    """
    long.write.mode(mode).partitionBy("year").parquet(path)


def land_bucketed(long: DataFrame, name: str, path: str, buckets: int) -> None:
    """Keep long lines as the table ``name``, whose files below ``path`` are dealt by client into ``buckets``.

    Totals by client of such a table need no shuffle (:func:`read_landed`). Lines are shuffled once, here; a
    client that holds much of the data is split over several files of its bucket.
    """
    dealt = long.hint("rebalance", "client")
    dealt.write.partitionBy("year").bucketBy(buckets, "client").option("path", path).saveAsTable(name)


def open_bucketed(spark: SparkSession, name: str, path: str, buckets: int) -> None:
    """Name the files of :func:`land_bucketed` in a session whose catalog does not know them."""
    columns = ", ".join(f"`{c}` {kind}" for c, kind in spark.read.parquet(path).dtypes)
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet OPTIONS (path '{path}') PARTITIONED BY (year) "
        f"CLUSTERED BY (client) INTO {buckets} BUCKETS"
    )
    spark.catalog.recoverPartitions(name)


def read_landed(spark: SparkSession, name: str, path: str, most: float = 4.0) -> DataFrame:
    """Lines of a bucketed table, read by buckets unless the largest holds ``most`` times the mean.

    A scan by buckets takes each bucket in one task. Where one client makes a bucket that large, its files
    are better read by many tasks, which add up what they read before it is shuffled.
    """
    found: dict[str, int] = {}
    for file, size in sizes(spark, path).items():
        if bucket := re.search(r"_(\d{5})(\.|$)", file.rpartition("/")[2]):
            found[bucket[1]] = found.get(bucket[1], 0) + size
    uneven = found and max(found.values()) > most * sum(found.values()) / len(found)
    return spark.read.parquet(path) if uneven else spark.table(name)


def read_mixed_ledgers(
    spark: SparkSession,
    path: str | list[str],
    client: Column | None = None,
    years: Sequence[int] | None = None,
    damaged: str = "fail",
) -> DataFrame:
    """Long ledger lines from files whose headers name different years; of ``years`` only, if given.

    Files are grouped by their header, found by :func:`headers_of`, and each group is read with its own
    columns, so nothing is joined and groups or columns of other years are not read. The names of
    the files of each group are on the driver, as they are for any read of a folder; the plan has a scan
    for each different header. ``damaged`` is that of :func:`read_ledgers`.
    """
    groups = headers_of(spark, path)
    if not groups:
        raise ValueError(f"no file under {path} has a header starting with {LABEL_HEADER!r}")
    parts = []
    for names, files in sorted(groups.items()):
        wanted = [y for y in _years_of(names) if years is None or y in years]
        if wanted:
            wide = checked_lines(_read_lines(spark, [_as_glob(f) for f in files], client, list(names)), damaged)
            parts.append(to_long(wide.select("client", "label", *[f"`AÑO {y}`" for y in wanted])))
    if not parts:
        raise ValueError(f"no file under {path} has a column for {years}")
    return reduce(DataFrame.unionByName, parts)


def _years_of(names: Sequence[str]) -> list[int]:
    found = [re.fullmatch(YEAR_HEADER, name.strip()) for name in names]
    return [int(m.group(1)) for m in found if m]


def headers_of(spark: SparkSession, path: str | list[str]) -> dict[tuple[str, ...], list[str]]:
    """The files of each different header, by the names in it.

    A header repeated further down a file is one of its lines; the first one counts. It lies in the first
    block of its file, so lines of other blocks are not searched. A file without any is an error, unless
    it is empty.
    """
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    headers = (
        spark.read.text(path)
        .filter("_metadata.file_block_start = 0")
        .select(F.url_decode(_plus_kept(file_path())).alias("path"), header_line().alias("line"), place.alias("place"))
        .filter(is_header(F.col("line")))
        .groupBy("path")
        .agg(F.min_by("line", "place").alias("line"))
    )
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path")  # lists, reads nothing
    found = files.join(headers, "path", "left").groupBy("line").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    groups: dict[tuple[str, ...], list[str]] = {}
    for row in found.collect():
        if row.line is None:
            raise ValueError(f"{len(row.paths)} files have no header starting with {LABEL_HEADER!r}, first {row.paths[0]}")
        groups.setdefault(tuple(_names_in(spark, row.line)), []).extend(row.paths)
    return groups


def _plus_kept(path: Column) -> Column:
    """URI text in which a plus sign stays one when it is decoded."""
    return F.replace(path, F.lit("+"), F.lit("%2B"))


def _as_glob(path: str) -> str:
    """A path that stands for itself where patterns are read."""
    return re.sub(r"([{}\[\]*?\\])", r"\\\1", path)
