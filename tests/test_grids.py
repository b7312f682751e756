import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrid.operators import grids as G
from tallygrid.sources import generators as S


def cells(spark, matrix):
    rows = [(i, j, float(v)) for i, row in enumerate(matrix) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, "i bigint, j bigint, v double")


def as_dict(df):
    return {(r.i, r.j): r.v for r in df.collect()}


def brute_force(values):
    """Mean of each cell and its neighbours in a dict of cells, in the given order."""
    result = {}
    for (i, j), v in values.items():
        total, count = v, 1
        for at in ((i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)):
            if at in values:
                total, count = total + values[at], count + 1
        result[i, j] = total / count
    return result


EXAMPLE = [[3, 9, 1], [4, 6, 7], [2, 1, 1]]
SMOOTHERS = [G.average_matrix, G.average_matrix_scatter]


@pytest.mark.parametrize("smooth", SMOOTHERS)
def test_example(spark, smooth):
    expected = [[16 / 3, 4.75, 17 / 3], [3.75, 5.4, 3.75], [7 / 3, 2.5, 3.0]]
    got = as_dict(smooth(cells(spark, EXAMPLE)))
    assert got == pytest.approx(as_dict(cells(spark, expected)))


@pytest.mark.parametrize("smooth", SMOOTHERS)
def test_small_grids(spark, smooth):
    assert smooth(cells(spark, [])).collect() == []
    assert as_dict(smooth(cells(spark, [[4.5]]))) == {(0, 0): 4.5}
    constant = as_dict(smooth(S.make_constant_matrix(spark, 5, 4, 0.1)))
    assert list(constant.values()) == pytest.approx([0.1] * 20)


@pytest.mark.parametrize("tile", [1, 2, 3, 7, 128])
@pytest.mark.parametrize("shape", [(13, 17), (1, 30), (30, 1)])
def test_tiles_meet_without_a_seam(spark, tile, shape):
    grid = cells(spark, np.random.default_rng(5).random(shape))
    assert as_dict(G.average_matrix(grid, tile=tile)) == brute_force(as_dict(grid))


def test_forms_agree(spark):
    matrix = np.random.default_rng(6).random((70, 9))
    grid = cells(spark, matrix)
    expected = brute_force(as_dict(grid))
    assert as_dict(G.average_matrix_scatter(grid)) == pytest.approx(expected)
    rows = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(matrix)], "i int, vs array<double>")
    for tile in (1, 16, 128):
        for chunk in (1, 4, 9, G.CHUNK):
            smooth = G.cells_from_rows(G.average_rows(rows, tile=tile, chunk=chunk), "i", "vs")
            assert as_dict(smooth) == expected


@pytest.mark.parametrize("smooth", SMOOTHERS)
def test_missing_cells_and_several_grids(spark, smooth):
    rng = np.random.default_rng(7)
    rows = [(g, i, j, float(rng.random())) for g in ("a", "b") for i in range(12) for j in range(12) if rng.random() < 0.6]
    df = spark.createDataFrame(rows, "g string, i bigint, j bigint, v double")
    got = smooth(df, ["g"])
    for g in ("a", "b"):
        assert as_dict(got.filter(F.col("g") == g)) == pytest.approx(
            brute_force({(i, j): v for h, i, j, v in rows if h == g})
        )


def test_smoothing_shuffles_once(spark):
    for plan in (
        G.average_matrix(S.make_random_matrix(spark, 50, 50)),
        G.average_matrix_scatter(S.make_random_matrix(spark, 50, 50)),
        G.average_rows(spark.range(5).select(F.col("id").alias("i"), F.array(F.lit(1.0)).alias("vs"))),
    ):
        assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_no_tile_grows_with_the_grid(spark):
    """A grid of a single row must not end in a single group."""
    tile, width = 16, 1000
    plan = G.average_matrix(S.make_constant_matrix(spark, 1, width, 1.0), tile=tile)
    assert plan.count() == width
    text = plan._jdf.queryExecution().toString()
    assert "windowspecdefinition(ti" in text and "SinglePartition" not in text


def neighbours(spark, i, j, rows, cols):
    one = spark.createDataFrame([(i, j)], "i int, j int")
    found = G.get_valid_neighbors(one, rows, cols).orderBy("pos").collect()
    assert [r.pos for r in found] == list(range(len(found)))
    listed = one.select(G.valid_neighbors("i", "j", rows, cols).alias("n")).first().n
    assert [tuple(n) for n in listed] == [(r.ni, r.nj) for r in found]
    return [(r.ni, r.nj) for r in found]


def test_neighbours(spark):
    assert neighbours(spark, 0, 0, 3, 3) == [(1, 0), (0, 1)]
    assert neighbours(spark, 1, 1, 3, 3) == [(0, 1), (2, 1), (1, 0), (1, 2)]
    assert neighbours(spark, 2, 2, 3, 3) == [(1, 2), (2, 1)]
    assert neighbours(spark, 0, 0, 1, 1) == []


def test_ranges(spark, one):
    assert [r.x for r in S.int_range(spark, 3, 5).collect()] == [3, 4, 5]
    assert S.int_range(spark, 5, 3).collect() == []
    assert [r.x for r in S.pares(spark, 10, 20).collect()] == [10, 12, 14, 16, 18, 20]
    assert [r.x for r in S.pares(spark, -3, 1).collect()] == [-2, 0]
    assert one(S.pares_list(F.lit(10), F.lit(20))) == [10, 12, 14, 16, 18, 20]
    assert one(S.range_list(F.lit(5), F.lit(3))) == []
    assert one(S.range_list(F.lit(3), F.lit(3))) == [3]


def test_generated_grids(spark):
    assert as_dict(S.make_constant_matrix(spark, 2, 3, 7)) == {(i, j): 7 for i in range(2) for j in range(3)}
    for shape in ((0, 3), (3, 0), (0, 0), (-2, -2)):
        assert S.make_constant_matrix(spark, *shape, 1).collect() == []
    stats = S.make_random_matrix(spark, 200, 300, seed=3).agg(
        F.count("v"), F.countDistinct("v"), F.min("v"), F.max("v"), F.avg("v"), F.stddev("v")
    ).first()
    assert stats[0] == 60_000 and stats[1] > 59_990
    assert 0 <= stats[2] < 0.001 and 0.999 < stats[3] < 1
    assert abs(stats[4] - 0.5) < 0.01 and abs(stats[5] - 12**-0.5) < 0.01


def test_random_values_do_not_depend_on_partitions(spark):
    grid = S.make_random_matrix(spark, 20, 20, seed=1)
    again = S.grid_cells(spark, 20, 20).repartition(7).withColumn("v", S.uniform(1, "i", "j"))
    assert as_dict(grid) == as_dict(again)
    assert as_dict(grid) != as_dict(S.make_random_matrix(spark, 20, 20, seed=2))
    unseeded = S.make_random_matrix(spark, 20, 20)
    assert as_dict(unseeded) == as_dict(unseeded) != as_dict(S.make_random_matrix(spark, 20, 20))


def test_grids_by_row(spark, monkeypatch):
    shapes = spark.createDataFrame(
        [("a", 2, 3), ("b", 0, 5), ("c", 4, 0), ("d", 1, 1), ("e", 40, 30)], "k string, rows int, cols int"
    )
    for block in (S.BLOCK, 1, 7):
        monkeypatch.setattr(S, "BLOCK", block)
        got = {(r.k, r.i, r.j) for r in S.grid_cells_per_row(shapes, ["k"]).collect()}
        assert got == {
            (k, i, j) for k, m, n in (("a", 2, 3), ("d", 1, 1), ("e", 40, 30)) for i in range(m) for j in range(n)
        }


def test_few_long_rows_are_spread_over_many_tasks(spark):
    """200 rows of 10^6 values: stretches, not rows, are dealt to the tasks."""
    rows, width = 200, 1_000_000
    made = spark.range(rows).select(
        F.col("id").alias("i"),
        F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: ((j * 7 + F.col("id") * 3) % 11).cast("double")).alias("vs"),
    )
    smooth = G.average_rows(made)
    assert "hashpartitioning(band" in plan_text(smooth) and "chunk" in plan_text(smooth)
    picks = [0, 1, G.CHUNK - 1, G.CHUNK, G.CHUNK + 1, 499_999, width - 2, width - 1]
    got = {
        (r.i, j): v
        for r in smooth.select("i", F.size("vs").alias("n"), F.array(*[F.get("vs", F.lit(j)) for j in picks]).alias("vs")).collect()
        for j, v in zip(picks, r.vs, strict=True) if r.n == width
    }
    assert len(got) == rows * len(picks)

    def value(i, j):
        return float((j * 7 + i * 3) % 11)

    for (i, j), v in got.items():
        around = [(i, j), (i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)]
        inside = [value(a, b) for a, b in around if 0 <= a < rows and 0 <= b < width]
        assert v == pytest.approx(sum(inside) / len(inside))


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()
