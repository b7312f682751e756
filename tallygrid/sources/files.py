"""What a job asks of the file system: lists and deletions, on any store that Spark reads."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession


def _hadoop(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder in alphabetical order; none if it is not there."""
    files, place = _hadoop(spark, path)
    if not files.exists(place):
        return []
    return sorted(x.getPath().getName() for x in files.listStatus(place))


def list_in_few_tasks(spark: SparkSession) -> None:
    """Let Spark list many folders or files in a few tasks for each core for the rest of the session, not in one task for
    each of them; a number that is not Spark's own is left as it is."""
    setting = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    if spark.conf.get(setting) == "10000":
        spark.conf.set(setting, str(4 * spark.sparkContext.defaultParallelism))


def one_listing(spark: SparkSession, path: str | list[str]) -> tuple[str | list[str], dict[str, str]]:
    """What to read instead of a pattern of file names, and the options that go with it: its folder, if this holds files
    only, so that Spark lists the folder once and not each file by itself. Anything else stays as it is."""
    list_in_few_tasks(spark)
    folder, _, name = path.rpartition("/") if isinstance(path, str) else ("", "", "")
    if not folder or not re.search(r"[*?{\[]", name) or re.search(r"[*?{}\[\]\\]", folder):
        return path, {}
    files, place = _hadoop(spark, folder)
    if not files.exists(place) or files.getContentSummary(place).getDirectoryCount() != 1:
        return path, {}
    found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path))
    return (folder, {"pathGlobFilter": name}) if found is not None and len(found) else (path, {})


def sizes(spark: SparkSession, path: str) -> dict[str, int]:
    """Bytes of all files below a folder by their path."""
    files, place = _hadoop(spark, path)
    found, left = {}, files.listFiles(place, True)
    while left.hasNext():
        one = left.next()
        found[one.getPath().toString()] = one.getLen()
    return found


def delete(spark: SparkSession, path: str) -> None:
    files, place = _hadoop(spark, path)
    files.delete(place, True)
