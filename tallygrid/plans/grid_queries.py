"""Registered grid queries, each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.operators.grids import (
    average_matrix,
    average_matrix_scatter,
    average_rows,
    cells_from_rows,
    get_valid_neighbors,
)
from tallygrid.plans.tables import table
from tallygrid.sources.generators import (
    grid_cells_per_row,
    make_constant_matrix,
    make_random_matrix,
    uniform,
)


def _embedding_cells(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    return cells_from_rows(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", keys)


def _shape(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """Rows and columns of the embeddings seen as a grid."""
    sizes = table(spark, sf_dir, "embeddings").agg(F.max("vec_id") + 1, F.max(F.size("embedding")))
    return tuple(sizes.first())


def _part_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One grid shape per part; some have no columns."""
    return table(spark, sf_dir, "part").select(
        "p_partkey", "p_retailprice", F.col("p_size").alias("rows"), (F.col("p_partkey") % 7).alias("cols")
    )


def _rounded(cells: DataFrame, *keys: str) -> DataFrame:
    return cells.select(*keys, "i", "j", F.round("v", 6).alias("v"))


def constant_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return make_constant_matrix(spark, *_shape(spark, sf_dir), 7.5)


def constant_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid_cells_per_row(_part_shapes(spark, sf_dir), ["p_partkey"])
    return cells.select("p_partkey", "i", "j", F.col("p_retailprice").alias("v"))


def random_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return make_random_matrix(spark, *_shape(spark, sf_dir), seed=7)


def random_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid_cells_per_row(_part_shapes(spark, sf_dir), ["p_partkey"])
    return cells.select("p_partkey", "i", "j", uniform(7, "p_partkey", "i", "j").alias("v"))


def neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        (F.col("l_linenumber") - 1).alias("i"),
        (F.col("l_quantity") - 1).cast("int").alias("j"),
    )
    return get_valid_neighbors(cells, 7, 50, keep=["l_orderkey", "i", "j"])


def grid_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(average_matrix(_embedding_cells(spark, sf_dir)))


def grid_smooth_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(average_matrix_scatter(_embedding_cells(spark, sf_dir)))


def grid_smooth_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    smooth = average_rows(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return _rounded(cells_from_rows(smooth, "vec_id", "embedding"))


def grid_smooth_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(average_matrix(_embedding_cells(spark, sf_dir, "label"), ["label"]), "label")


QUERIES = {
    "constant_grid": constant_grid,
    "constant_grids": constant_grids,
    "random_grid": random_grid,
    "random_grids": random_grids,
    "neighbors": neighbors,
    "grid_smooth": grid_smooth,
    "grid_smooth_scatter": grid_smooth_scatter,
    "grid_smooth_rows": grid_smooth_rows,
    "grid_smooth_sparse": grid_smooth_sparse,
}


def _uniform_sql(text: str) -> str:
    return f"CAST(('0x' || substr(md5({text}), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496"


_CELLS = """
    cells AS (SELECT label, vec_id AS i, generate_subscripts(embedding, 1) - 1 AS j,
                     unnest(embedding)::DOUBLE AS v FROM embeddings)"""
_SMOOTH = f"""
    WITH {_CELLS}, sides AS (
        SELECT i, j, v, lag(v) OVER c AS up, lead(v) OVER c AS down, lag(v) OVER r AS le, lead(v) OVER r AS ri
        FROM cells WINDOW c AS (PARTITION BY j ORDER BY i), r AS (PARTITION BY i ORDER BY j))
    SELECT i, j, round((v + coalesce(up, 0) + coalesce(down, 0) + coalesce(le, 0) + coalesce(ri, 0))
                       / (1 + (up IS NOT NULL)::INT + (down IS NOT NULL)::INT
                            + (le IS NOT NULL)::INT + (ri IS NOT NULL)::INT), 6) + 0 AS v
    FROM sides"""
_SPARSE = f"""
    WITH {_CELLS}
    SELECT a.label, a.i, a.j, round(avg(b.v), 6) + 0 AS v
    FROM cells a JOIN cells b ON a.label = b.label AND (
        (a.i = b.i AND b.j BETWEEN a.j - 1 AND a.j + 1) OR (a.j = b.j AND (b.i = a.i - 1 OR b.i = a.i + 1)))
    GROUP BY ALL"""
_SHAPE = "(SELECT max(vec_id) + 1 AS m, max(len(embedding)) AS n FROM embeddings)"
_SHAPES = "(SELECT p_partkey, p_retailprice, p_size AS m, p_partkey % 7 AS n FROM part)"

ORACLES = {
    "constant_grid": f"""
        SELECT i, unnest(range(n)) AS j, 7.5::DOUBLE AS v
        FROM (SELECT unnest(range(m)) AS i, n FROM {_SHAPE})""",
    "constant_grids": f"""
        SELECT p_partkey, i, unnest(range(n)) AS j, p_retailprice AS v
        FROM (SELECT p_partkey, p_retailprice, unnest(range(m)) AS i, n FROM {_SHAPES})""",
    "random_grid": f"""
        SELECT i, j, {_uniform_sql("'7,' || i || ',' || j")} AS v
        FROM (SELECT unnest(range(m)) AS i, n FROM {_SHAPE}), LATERAL (SELECT unnest(range(n)) AS j)""",
    "random_grids": f"""
        SELECT p_partkey, i, j, {_uniform_sql("'7,' || p_partkey || ',' || i || ',' || j")} AS v
        FROM (SELECT p_partkey, unnest(range(m)) AS i, n FROM {_SHAPES} WHERE m * n > 0),
             LATERAL (SELECT unnest(range(n)) AS j)""",
    "neighbors": """
        WITH c AS (SELECT l_orderkey, l_linenumber - 1 AS i, (l_quantity - 1)::INT AS j FROM lineitem),
        n AS (SELECT l_orderkey, i, j, [{'a': i - 1, 'b': j}, {'a': i + 1, 'b': j}, {'a': i, 'b': j - 1},
                     {'a': i, 'b': j + 1}].list_filter(lambda p: p.a >= 0 AND p.a < 7 AND p.b >= 0 AND p.b < 50) AS l
              FROM c)
        SELECT l_orderkey, i, j, CAST(pos - 1 AS INT) AS pos, p.a AS ni, p.b AS nj
        FROM (SELECT l_orderkey, i, j, generate_subscripts(l, 1) AS pos, unnest(l) AS p FROM n)""",
    "grid_smooth": _SMOOTH,
    "grid_smooth_scatter": _SMOOTH,
    "grid_smooth_rows": _SMOOTH,
    "grid_smooth_sparse": _SPARSE,
}
