"""Inputs of the registered queries: the given tables and ledgers derived from them."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.functions.numbers import clean_amount, spanish_number
from tallygrid.session import scratch_dir
from tallygrid.sources.ledgers import CSV_OPTIONS, LABEL_HEADER

YEARS = (2025, 2024)

# Labels of the derived ledger. One account label is in capitals to test that case
# is folded beyond ASCII, one has a leading blank.
LABELS = (
    "1. Importe neto de la cifra de negocios",
    "6230    SERVICIOS PROFESIONALES INDEP.",
    "6280    SUMINISTROS",
    "6400    SUELDOS",
    "6210    ARRENDAMIENTOS",
    "8. AMORTIZACIÓN DE INMOVILIZADO",
    "6420    SEG. SOCIAL",
    "7. Otros gastos de explotación",
    "15. Gastos financieros",
    "Impuesto sobre sociedades",
    " D) RESULTADO DEL EJERCICIO",
)
SALARY_LABELS = (3, 6)
OTHER_LABEL = "6290    OTROS SERVICIOS"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _label_number() -> Column:
    return (F.col("l_orderkey") + F.col("l_linenumber")) % len(LABELS)


def ledger_text(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Every line item as a ledger line: ``client``, ``label``, ``year``, Spanish text.

    Suppliers with an even key pay no salaries, so that every rule has both outcomes.
    Only sales and some results are positive. ``more`` names further columns of the line items.
    """
    k = _label_number()
    label = F.when(
        (F.col("l_suppkey") % 2 == 0) & k.isin(*SALARY_LABELS), OTHER_LABEL
    ).otherwise(F.get(F.array(*[F.lit(x) for x in LABELS]), k.cast("int")))
    gain = (k == 0) | ((k == len(LABELS) - 1) & (F.col("l_partkey") % 3 != 0))
    signed = F.when(gain, F.col("l_extendedprice")).otherwise(-F.col("l_extendedprice"))
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") * 2 + F.col("l_orderkey") % 2).alias("client"),
        F.concat("l_returnflag", "l_linestatus").alias("branch"),
        label.alias("label"),
        F.when(F.year("l_shipdate") % 2 == 1, YEARS[0]).otherwise(YEARS[1]).alias("year"),
        spanish_number(signed).alias("amount_text"),
        *more,
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived ledger with its text parsed back into amounts."""
    return ledger_text(spark, sf_dir).select(
        "client", "branch", "label", "year", clean_amount("amount_text").alias("amount")
    )


_WRITTEN: dict[tuple, str] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, write) -> str:
    """Path of files that are the input of several queries and written once in an application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN or not _exists(spark, _WRITTEN[key]):
        path = scratch_dir(spark, name)
        write(path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def _hadoop(spark: SparkSession, path: str):
    """The file system of a path, and a maker of its paths."""
    maker = spark._jvm.org.apache.hadoop.fs.Path
    return maker(path).getFileSystem(spark._jsc.hadoopConfiguration()), maker


def _exists(spark: SparkSession, path: str) -> bool:
    files, maker = _hadoop(spark, path)
    return files.exists(maker(path))


def _wide(spark: SparkSession, sf_dir: str, client: str, years: tuple[int, ...] = YEARS) -> DataFrame:
    return ledger_text(spark, sf_dir).select(
        F.col(client).alias("client"),
        F.col("label").alias(LABEL_HEADER),
        *[F.when(F.col("year") == y, F.col("amount_text")).alias(f"AÑO {y}") for y in years],
    )


def _write_csv(wide: DataFrame, path: str, mode: str = "errorifexists") -> None:
    options = {**CSV_OPTIONS, "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    wide.write.mode(mode).partitionBy("client").options(**options).csv(path)


def write_ledger_files(spark: SparkSession, sf_dir: str) -> str:
    """Write the derived ledger as CSV files, a folder per branch; returns the path."""
    return _once(spark, sf_dir, "ledgers", lambda path: _write_csv(_wide(spark, sf_dir, "branch"), path))


def write_mixed_files(spark: SparkSession, sf_dir: str) -> str:
    """The same with two headers: some branches have the earlier year first."""

    def write(path: str) -> None:
        for years, which in ((YEARS, "client < 'N'"), (YEARS[::-1], "client >= 'N'")):
            _write_csv(_wide(spark, sf_dir, "branch", years).where(which), path, "append")

    return _once(spark, sf_dir, "mixed-ledgers", write)


RENAMES = 16  # at a time


def write_client_files(spark: SparkSession, sf_dir: str) -> str:
    """Write one file per client, ``<client>.csv``, as the closing job gets them; returns the path.

    Spark names the files of a folder itself, so each is renamed once it is written: many at a time, as a store
    answers each request late, and without deleting the folder of each.
    """

    def write(path: str) -> None:
        parts = scratch_dir(spark, "client-parts")
        _write_csv(_wide(spark, sf_dir, "client").repartition("client"), parts)
        files, maker = _hadoop(spark, path)
        files.mkdirs(maker(path))

        def named(found) -> None:
            old = found.getPath()
            new = f"{path}/{old.getParent().getName().removeprefix('client=')}.csv"
            if not files.rename(old, maker(new)):
                raise OSError(f"{old.toString()} was not renamed to {new}")

        with ThreadPool(RENAMES) as pool:
            pool.map(named, files.globStatus(maker(f"{parts}/client=*/*.csv")), 32)
        files.delete(maker(parts), True)

    return _once(spark, sf_dir, "client-ledgers", write)


DAMAGED_EVERY = 17


def write_damaged_files(spark: SparkSession, sf_dir: str) -> str:
    """The derived ledger as text files, a folder per branch, with a field too many in some lines; returns the path."""

    def write(path: str) -> None:
        lines = ledger_text(spark, sf_dir, "l_orderkey", "l_partkey")
        damaged = (F.col("l_orderkey") + F.col("l_partkey")) % DAMAGED_EVERY == 0
        amounts = [F.when(F.col("year") == y, F.col("amount_text")).otherwise("") for y in YEARS]
        surplus = F.when(damaged, ";77,00").otherwise("")
        rows = lines.select("branch", F.lit(1).alias("place"), F.concat(F.concat_ws(";", "label", *amounts), surplus).alias("value"))
        header = ";".join([LABEL_HEADER, *[f"AÑO {y}" for y in YEARS]])
        heads = rows.select("branch").distinct().select("branch", F.lit(0).alias("place"), F.lit(header).alias("value"))
        # A file begins with its header: the lines of a branch are one file.
        placed = rows.unionByName(heads).repartition("branch").sortWithinPartitions("branch", "place")
        placed.select(F.col("branch").alias("client"), "value").write.partitionBy("client").text(path)

    return _once(spark, sf_dir, "damaged-ledgers", write)


def folder_client() -> Column:
    """Client named by the folder a file lies in."""
    return F.regexp_extract("_metadata.file_path", "/client=([^/]+)/", 1)


def ledger_sql(more: str = "") -> str:
    """The derived ledger as a SQL query, with amounts as numbers."""
    more = f", {more}" if more else ""
    labels = ", ".join(f"'{x}'" for x in LABELS)
    k = f"(l_orderkey + l_linenumber) % {len(LABELS)}"
    return f"""
        SELECT l_suppkey * 2 + l_orderkey % 2 AS client, l_returnflag || l_linestatus AS branch,
               CASE WHEN l_suppkey % 2 = 0 AND {k} IN {SALARY_LABELS} THEN '{OTHER_LABEL}'
                    ELSE ([{labels}])[{k} + 1] END AS label,
               CASE WHEN year(l_shipdate) % 2 = 1 THEN {YEARS[0]} ELSE {YEARS[1]} END AS year,
               CAST(l_extendedprice AS DECIMAL(18,2))
                 * CASE WHEN {k} = 0 OR ({k} = {len(LABELS) - 1} AND l_partkey % 3 <> 0)
                        THEN 1 ELSE -1 END AS amount{more}
        FROM lineitem"""
