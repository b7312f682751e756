"""Letter files: one text file per client."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallygrid.functions.columns import as_column
from tallygrid.session import stored

# Greeting and farewell round the body of a letter.
GREETING = "Estimado cliente,"
FAREWELL = "Un saludo."
BODY_FAREWELL = "Un saludo y gracias."


def wrap_letter(body: Column | str) -> Column:
    """Greeting, body and farewell; a body that already says farewell gets no second."""
    body = as_column(body)
    farewell = F.when(F.rtrim(body).endswith(BODY_FAREWELL), "").otherwise(f"\n\n{FAREWELL}")
    return F.concat(F.lit(f"{GREETING}\n\n"), body, farewell)


def write_letters(bodies: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write ``(client, body)`` as UTF-8 text below ``path/client=<client>/``.

    The mode ``replace`` overwrites the letters of these clients and leaves the others. The
    executors write; Spark ends each file with a line feed. For millions of clients see
    :func:`write_packed_letters`.
    """
    letters = bodies.select("client", wrap_letter("body").alias("letter"))
    # Letters are little data, which adaptive execution would hand to few tasks, but a file each: all cores write.
    letters = letters.repartition(bodies.sparkSession.sparkContext.defaultParallelism, "client")
    some = {"partitionOverwriteMode": "dynamic" if mode == "replace" else "static"}
    mode = "overwrite" if mode == "replace" else mode
    letters.write.mode(mode).options(**some).partitionBy("client").text(path)


# What ends a letter in a pack and what stands between client and letter.
RECORD_END, UNIT_END = "\x1e", "\x1f"


def write_packed_letters(bodies: DataFrame, path: str, packs: int, mode: str = "errorifexists") -> None:
    """Write ``(client, body)`` as ``packs`` text files and an index of where each letter lies.

    A pack ``<path>/letters/pack=<p>/*.txt`` holds the letters of the clients whose hash is ``p``, each as client,
    separator, letter and end mark. The index ``<path>/index`` has ``client``, ``pack``, and ``start`` and ``size``
    of the letter in bytes. :func:`read_packed_letters` reads all letters, in as many tasks as the packs
    have blocks, and :func:`find_letter` the one of a client.
    """
    text = F.concat(F.col("client").cast("string"), F.lit(UNIT_END), wrap_letter("body"))
    # A mark inside a letter would cut it in two.
    marks = F.length(F.regexp_replace(text, f"[^{RECORD_END}{UNIT_END}]", "")) != 1
    checked = F.when(marks, F.raise_error(F.concat(F.lit("a letter holds a separator: "), text))).otherwise(text)
    pack = F.pmod(F.xxhash64(F.col("client").cast("string")), F.lit(packs)).cast("int")
    records = bodies.select("client", pack.alias("pack"), checked.cast("string").alias("record"))
    order = Window.partitionBy("pack").orderBy("client")
    size = F.octet_length("record")
    ends = F.sum(size + 1).over(order)  # each record is followed by its end mark
    # Letters are written in the order in which the places are counted; stored, so that both are one order.
    placed = stored(
        records.withColumn("end", ends).withColumn("size", size.cast("long")).withColumn("start", F.col("end") - size - 1),
        "packed-letters",
    )
    name = F.octet_length(F.concat(F.col("client").cast("string"), F.lit(UNIT_END)))
    index = placed.select("client", "pack", (F.col("start") + name).alias("start"), (F.col("size") - name).alias("size"))
    index.sort("client").write.mode(mode).parquet(f"{path}/index")
    written = placed.select("pack", "start", "record").repartition(packs, "pack").sortWithinPartitions("pack", "start")
    written.select("pack", F.col("record").alias("value")).write.mode(mode).option("lineSep", RECORD_END).partitionBy(
        "pack"
    ).text(f"{path}/letters")


def read_packed_letters(spark: SparkSession, path: str) -> DataFrame:
    """``client`` and ``letter`` of every letter in the packs."""
    records = spark.read.option("lineSep", RECORD_END).text(f"{path}/letters")
    parts = F.split("value", UNIT_END)
    return records.select(F.get(parts, F.lit(0)).alias("client"), F.get(parts, F.lit(1)).alias("letter"))


def find_letter(spark: SparkSession, path: str, client: str | int) -> DataFrame:
    """``client`` and ``letter`` of one client: a row of the index, then its place in one pack."""
    found = spark.read.parquet(f"{path}/index").where(F.col("client") == client).select("client", "pack", "start", "size")
    place = found.first()
    if place is None:
        return found.select("client", F.lit("").alias("letter"))
    content = spark.read.format("binaryFile").load(f"{path}/letters/pack={place.pack}")
    letter = F.substring("content", place.start + 1, place["size"]).cast("string")
    return content.select(F.lit(place.client).alias("client"), letter.alias("letter"))
