"""A store of totals by client and file that a batch reads in part.

Rows lie in ``<path>/of=<buckets>/level=<l>/part=<name>/bucket=<b>``, where the bucket is a hash of the client
modulo their number, which the path keeps. A batch adds a part of level 0 and reads, of all parts, the
folders of its clients' buckets only. ``FAN`` parts of a level are merged into one of the next, so a row is
written again once for each level, not once for each batch, and the number of parts stays small.

Nothing depends on the moment at which a part appears or goes: of the rows of a client and file the one
written last counts, wherever it lies. A part that is written twice, or is there beside the part that it was
merged into, changes no result.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.sources.files import children, delete
from tallygrid.sources.ledgers import one_file_each

BUCKETS, FAN = 256, 8
PLACE = ("of", "level", "part", "bucket")
STAMP = ("written", "run", "batch")  # the row that is greatest in these counts
OWN = ("client", "file", "own_file")


class TotalsStore:
    """``buckets`` is taken when the store is new; later the number it was made with holds."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        made = [name for name in children(spark, path) if name.startswith("of=")]
        if len(made) > 1:
            raise ValueError(f"{path} holds several stores: {made}")
        self.spark, self.buckets = spark, int(made[0].removeprefix("of=")) if made else buckets
        self.path = f"{path}/of={self.buckets}"

    def bucket(self, client: Column | str = "client") -> Column:
        return F.pmod(F.xxhash64(F.col(client).cast("string") if isinstance(client, str) else client), F.lit(self.buckets)).cast("int")

    def parts(self, level: int) -> list[str]:
        return [n for n in children(self.spark, f"{self.path}/level={level}") if n.startswith("part=")]

    def levels(self) -> list[int]:
        names = children(self.spark, self.path)
        return sorted(int(n.removeprefix("level=")) for n in names if n.startswith("level="))

    def _write(self, rows: DataFrame, level: int, part: str) -> str:
        path = f"{self.path}/level={level}/part={part}"
        # Rows of a bucket go to one file unless they are many.
        rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        return path

    def add(self, totals: DataFrame, run: str, batch: int) -> DataFrame:
        """Keep the totals of a batch; returns its rows. A repeated batch replaces its part."""
        stamped = totals.withColumns({
            "written": F.lit(time.time_ns()), "run": F.lit(run), "batch": F.lit(batch).cast("long"),
            "bucket": self.bucket(),
        })
        return self.spark.read.parquet(self._write(stamped, 0, f"{run}-{batch:010d}"))

    def rows(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets, whose folders alone are read."""
        found = self.spark.read.parquet(self.path)
        return found if buckets is None else found.where(F.col("bucket").isin(*sorted(buckets)))

    def current(self, clients: DataFrame | None = None) -> DataFrame:
        """The row that counts for each client and file; of ``clients`` if given.

        The numbers of their buckets, as many as the store has at most, come to the driver.
        """
        if clients is None:
            return latest(self.rows())
        named = clients.select("client", self.bucket().alias("bucket"))
        buckets = [r.bucket for r in named.select("bucket").distinct().collect()]
        return latest(self.rows(buckets).join(named.select("client").distinct(), "client", "left_semi"))

    def compact(self, fan: int = FAN) -> None:
        """Merge the parts of each level that has ``fan`` of them or more into one of the next level."""
        for level in self.levels():
            names = self.parts(level)
            while len(names) >= fan:
                some, names = names[:fan], names[fan:]
                paths = [f"{self.path}/level={level}/{n}" for n in some]
                merged = latest(self.spark.read.option("basePath", self.path).parquet(*paths), keep=("bucket", *STAMP))
                self._write(merged, level + 1, f"m{uuid.uuid4().hex}")
                for path in paths:  # the merged part is whole by now
                    delete(self.spark, path)


def latest(rows: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Of the rows of each client and file the one written last, without its place in the store."""
    kept = [c for c in rows.columns if c not in ("client", "file", *PLACE, *STAMP)] + list(keep)
    stamp = F.struct(*[F.col(c) for c in STAMP])
    last = rows.groupBy("client", "file").agg(F.max_by(F.struct(*kept), stamp).alias("v"))
    return last.select("client", "file", "v.*")


def client_totals(rows: DataFrame) -> DataFrame:
    """Totals by client over its files. A client that is named by its file raises an error if files in
    several folders have that name."""
    amounts = [c for c in rows.columns if c not in OWN]
    file = F.xxhash64("file")
    totals = rows.groupBy("client").agg(
        *[F.sum(c).alias(c) for c in amounts],
        F.max(F.col("own_file").cast("int")).alias("_own"), F.min(file).alias("_first"), F.max(file).alias("_last"),
    )
    name = one_file_each(F.col("client"), F.col("_first"), F.when(F.col("_own") == 1, F.col("_last")))
    return totals.withColumn("client", name).select("client", *amounts)
