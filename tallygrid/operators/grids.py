"""Grids as cells ``(i, j, v)``: direct neighbours and smoothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.functions.columns import as_column

# Side of the square tiles in which cells meet their neighbours. A tile is the
# largest group that one task must sort; its border adds 4/TILE to the shuffle.
TILE = 128
# Columns of a stretch of an array row.
CHUNK = 1 << 13


def in_grid(i: Column, j: Column, rows: Column, cols: Column) -> Column:
    return (i >= 0) & (i < rows) & (j >= 0) & (j < cols)


# Steps to the neighbours in their order: up, down, left, right.
STEPS = ((-1, 0), (1, 0), (0, -1), (0, 1))


def valid_neighbors(
    i: Column | str, j: Column | str, rows: Column | str | int, cols: Column | str | int
) -> Column:
    """Array of the direct neighbours inside the grid, in the order of the steps."""
    i, j, rows, cols = (as_column(c) for c in (i, j, rows, cols))
    around = F.array(*[F.struct((i + di).alias("i"), (j + dj).alias("j")) for di, dj in STEPS])
    return F.filter(around, lambda c: in_grid(c["i"], c["j"], rows, cols))


def get_valid_neighbors(
    cells: DataFrame, rows: Column | str | int, cols: Column | str | int, keep: Sequence[str] = ("i", "j")
) -> DataFrame:
    """One row per cell and neighbour: ``pos`` (place in the list), ``ni``, ``nj``.

    Row form of :func:`valid_neighbors`; without an array to filter it stays in
    generated code.
    """
    i, j, rows, cols = F.col("i"), F.col("j"), as_column(rows), as_column(cols)
    inside = [in_grid(i + di, j + dj, rows, cols) for di, dj in STEPS]
    pos, around = F.lit(0), []
    for (di, dj), ok in zip(STEPS, inside):
        around.append(F.struct(pos.alias("pos"), (i + di).alias("ni"), (j + dj).alias("nj"), ok.alias("ok")))
        pos = pos + F.when(ok, 1).otherwise(0)
    return cells.select(*keep, F.inline(F.array(*around))).filter("ok").drop("ok")


def _origin(c: str, size: int) -> Column:
    """First coordinate of the tile that holds coordinate ``c``."""
    return F.col(c) - F.pmod(F.col(c), F.lit(size))


def average_matrix(cells: DataFrame, keys: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """Each cell becomes the mean of itself and its direct neighbours.

    Cells go to square tiles, border cells also to the tile next door, and windows
    inside a tile find the neighbours. That is one shuffle of barely more rows than
    the grid has, and no group grows with the length of a row or column. Values are
    added in a fixed order: self, up, down, left, right. Missing cells count as
    outside the grid. ``keys`` name the grid when there are several.
    """
    placed = cells.select(
        *keys,
        F.col("i").cast("bigint").alias("i"),
        F.col("j").cast("bigint").alias("j"),
        F.col("v").cast("double").alias("v"),
        _origin("i", tile).alias("oi"),
        _origin("j", tile).alias("oj"),
    )
    i, j, oi, oj = (F.col(c) for c in ("i", "j", "oi", "oj"))

    def copy(ti: Column, tj: Column, own: bool, wanted: Column) -> Column:
        return F.struct(ti.alias("ti"), tj.alias("tj"), F.lit(own).alias("own"), wanted.alias("wanted"))

    # Five candidates and a filter stay in generated code, unlike a filtered array.
    copies = F.array(
        copy(oi, oj, True, F.lit(True)),
        copy(oi - tile, oj, False, i == oi),
        copy(oi + tile, oj, False, i == oi + tile - 1),
        copy(oi, oj - tile, False, j == oj),
        copy(oi, oj + tile, False, j == oj + tile - 1),
    )
    tiles = (
        placed.select(*keys, "i", "j", "v", F.inline(copies))
        .filter("wanted")
        .drop("wanted")
        .repartition(*keys, "ti", "tj")
    )
    down_columns = Window.partitionBy(*keys, "ti", "tj", "j").orderBy("i")
    along_rows = Window.partitionBy(*keys, "ti", "tj", "i").orderBy("j")

    def beside(at: str, step: int, window) -> Column:
        there, value = F.lag(at, step).over(window), F.lag("v", step).over(window)
        return F.when(there == F.col(at) - step, value)

    sides = ["up", "down", "left", "right"]
    met = (
        tiles.withColumns({"up": beside("i", 1, down_columns), "down": beside("i", -1, down_columns)})
        .withColumns({"left": beside("j", 1, along_rows), "right": beside("j", -1, along_rows)})
        .filter("own")
    )
    return met.select(*keys, "i", "j", mean_of("v", sides).alias("v"))


def mean_of(value: Column | str, others: Sequence[Column | str]) -> Column:
    """Mean of a value and of those others that are present, added in that order."""
    others = [as_column(o) for o in others]
    total, count = as_column(value), F.lit(1)
    for other in others:
        total = total + F.coalesce(other, F.lit(0.0))
        count = count + F.when(other.isNull(), 0).otherwise(1)
    return total / count


def average_rows(
    matrix: DataFrame, row: str = "i", values: str = "vs", tile: int = TILE, chunk: int = CHUNK
) -> DataFrame:
    """Smoothing of a dense grid stored as one array per row, numbered without gaps.

    Each row is cut into stretches of ``chunk`` values that know the value on either side, so a window holds
    ``tile`` stretches at most. Where a row, by the first one read, is a single stretch, the rows are shuffled once,
    into bands of ``tile`` rows. Longer rows are shuffled by band and stretch, so that a grid of few rows is
    spread along them, however long they are, and a second shuffle joins the results of a row.
    """
    r, first, v = F.col(row), F.col("first"), F.col(values)

    def copy(band: Column, own: bool, wanted: Column) -> Column:
        return F.struct(band.alias("band"), F.lit(own).alias("own"), wanted.alias("wanted"))

    copies = F.array(
        copy(first, True, F.lit(True)),
        copy(first - tile, False, r == first),
        copy(first + tile, False, r == first + tile - 1),
    )
    stretches = F.transform(
        F.sequence(F.lit(0), F.expr(f"CAST((greatest(size(`{values}`), 1) - 1) div {chunk} AS INT)")),
        lambda c: F.struct(
            F.slice(v, c * chunk + 1, F.lit(chunk)).alias("part"),
            F.get(v, c * chunk - 1).alias("before"),
            F.get(v, (c + 1) * chunk).alias("after"),
        ),
    )
    cut = (
        matrix.select(
            r.cast("bigint").alias(row),
            F.col(values).cast("array<double>").alias(values),
            _origin(row, tile).alias("first"),
        )
        .select(row, "first", F.posexplode(stretches).alias("chunk", "s"))
        .select(row, "chunk", "s.*", F.inline(copies))
        .filter("wanted")
        .drop("wanted")
    )
    some = matrix.select(F.size(values)).first()
    if some and (some[0] or 0) > chunk:
        cut, keys = cut.repartition("band", "chunk"), [row]
    else:
        cut, keys = cut.repartition("band"), ["band", row]
    window = Window.partitionBy("band", "chunk").orderBy(row)

    def beside(step: int) -> Column:
        return F.when(F.lag(row, step).over(window) == r - step, F.lag("part", step).over(window))

    met = cut.withColumns({"up": beside(1), "down": beside(-1)}).filter("own")
    part = F.col("part")
    smooth = F.transform(
        part,
        lambda v, k: mean_of(
            v,
            [
                F.get("up", k),
                F.get("down", k),
                F.when(k == 0, F.col("before")).otherwise(F.get(part, k - 1)),
                F.when(k == F.size(part) - 1, F.col("after")).otherwise(F.get(part, k + 1)),
            ],
        ),
    )
    done = met.select(row, "band", "chunk", smooth.alias("part"))
    parts = F.sort_array(F.collect_list(F.struct("chunk", "part")))
    joined = done.groupBy(*keys).agg(F.flatten(F.transform(parts, lambda x: x.part)).alias(values))
    return joined.select(row, values)


def average_matrix_scatter(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The same smoothing by sending each value to its cell and the four round it.

    It moves five rows per cell, added up in no fixed order, but sorts nothing; rows
    that share a target within a task are added before the shuffle.
    """
    i, j = F.col("i").cast("bigint"), F.col("j").cast("bigint")
    targets = F.array(*[
        F.struct((i + di).alias("i"), (j + dj).alias("j"), F.lit(own).alias("own"))
        for di, dj, own in ((0, 0, True), (-1, 0, False), (1, 0, False), (0, -1, False), (0, 1, False))
    ])
    sent = cells.select(*keys, F.col("v").cast("double").alias("v"), F.inline(targets))
    return (
        sent.groupBy(*keys, "i", "j")
        .agg(F.avg("v").alias("v"), F.max("own").alias("own"))
        .filter("own")
        .select(*keys, "i", "j", "v")
    )


def cells_from_rows(matrix: DataFrame, row: str, values: str, keys: Sequence[str] = ()) -> DataFrame:
    """Cells of a grid stored as one array per row."""
    return matrix.select(
        *keys, F.col(row).cast("bigint").alias("i"), F.posexplode(values).alias("j", "v")
    ).select(*keys, "i", F.col("j").cast("bigint").alias("j"), F.col("v").cast("double").alias("v"))
