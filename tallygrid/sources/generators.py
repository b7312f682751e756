"""Integer ranges and generated grids."""

from __future__ import annotations

import secrets
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.functions.columns import as_column
from tallygrid.functions.numbers import is_even

# Cells that one row hands over at a time when many grids are generated at once.
BLOCK = 1 << 16


def int_range(spark: SparkSession, x: int, y: int) -> DataFrame:
    """The integers from x to y, both included; none when x > y."""
    return spark.range(x, y + 1).select(F.col("id").alias("x"))


def pares(spark: SparkSession, x: int, y: int) -> DataFrame:
    """The even integers from x to y."""
    return int_range(spark, x, y).filter(is_even("x"))


def range_list(x: Column | str, y: Column | str) -> Column:
    """List form of :func:`int_range`, with bounds taken from the row.

    ``sequence`` alone would count down when x > y.
    """
    x, y = as_column(x), as_column(y)
    return F.when(x <= y, F.sequence(x.cast("bigint"), y.cast("bigint"))).otherwise(
        F.array().cast("array<bigint>")
    )


def pares_list(x: Column | str, y: Column | str) -> Column:
    return F.filter(range_list(x, y), is_even)


def uniform(seed: int, *keys: Column | str) -> Column:
    """Uniform number in [0, 1) that depends on the seed and the keys only.

    Unlike ``rand`` it does not depend on the partition or on the order of rows, so
    a task that runs again after a lost executor gives the same values. It is made of the
    first 52 bits of an MD5 sum, which other engines can compute, too.
    """
    text = F.concat_ws(",", F.lit(seed).cast("string"), *[as_column(k).cast("string") for k in keys])
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
    return bits.cast("double") * F.lit(2.0**-52)


def grid_cells(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    """Coordinates of one rows x cols grid. One range, split evenly over tasks."""
    rows, cols = max(rows, 0), max(cols, 0)
    return spark.range(rows * cols).selectExpr(
        f"id div {max(cols, 1)} AS i", f"id % {max(cols, 1)} AS j"
    )


def make_constant_matrix(spark: SparkSession, rows: int, cols: int, value) -> DataFrame:
    return grid_cells(spark, rows, cols).withColumn("v", F.lit(value))


def make_random_matrix(
    spark: SparkSession, rows: int, cols: int, seed: int | None = None
) -> DataFrame:
    """Uniform values; without a seed each call draws other values."""
    if seed is None:
        seed = secrets.randbits(62)
    return grid_cells(spark, rows, cols).withColumn("v", uniform(seed, "i", "j"))


def grid_cells_per_row(
    shapes: DataFrame, keys: Sequence[str], rows: str = "rows", cols: str = "cols"
) -> DataFrame:
    """Coordinates of one grid per row of ``shapes``; all its columns are kept.

    Each row first becomes blocks of cells and the blocks are spread over the
    tasks, so that one huge grid does not end up in a single task.
    """
    size = f"CAST(`{rows}` AS BIGINT) * CAST(`{cols}` AS BIGINT)"
    # Blocks are listed in two steps, so that no list grows with a single grid beyond BLOCK
    # entries until it has BLOCK ** 3 cells.
    last = f"({size} - 1) div {BLOCK}"
    blocks = (
        shapes.filter((F.col(rows) > 0) & (F.col(cols) > 0))
        .withColumn("_group", F.expr(f"explode(sequence(0L, {last} div {BLOCK}))"))
        .withColumn(
            "_block", F.expr(f"explode(sequence(_group * {BLOCK}, least(_group * {BLOCK} + {BLOCK} - 1, {last})))")
        )
        .repartition(*keys, "_block")
    )
    start = F.col("_block") * BLOCK
    end = F.least(start + BLOCK, F.expr(size)) - 1
    cells = blocks.withColumn("_cell", F.explode(F.sequence(start, end)))
    return cells.select(
        *shapes.columns,
        F.expr(f"_cell div `{cols}`").alias("i"),
        (F.col("_cell") % F.col(cols)).cast("bigint").alias("j"),
    )
