"""Session helpers shared by the tests, the bench and the jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tallygrid", master: str | None = None, **conf) -> SparkSession:
    """Session with the settings the operators rely on; ``conf`` overrides them.

    On a cluster leave ``master`` unset and let spark-submit choose it, as well
    as executor sizes and ``spark.sql.shuffle.partitions``.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Join by hash where every partition of the smaller side is measured to be small,
        # instead of sorting the lines.
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; a cluster
    without it is an error, because executors do not share a local disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="tallygrid-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` to the shared folder now, with ``options`` of the writer, and read it back.

    The plan then starts at the files: nothing before them is computed twice or lost
    with an executor, and Spark knows their size when it chooses a join.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)
