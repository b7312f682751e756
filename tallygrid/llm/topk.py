"""Exact search for the vectors of greatest inner product by statistics of segments.

A vector is cut into 1, 2, 4, ... segments. Of each segment the mean and the deviation are kept, and with
L as its length, L (m_q m_x + d_q d_x) added up over the segments is never below the inner product: it is
half of |q|^2 + |x|^2 less the lower bound of the squared distance, L ((m_q - m_x)^2 + (d_q - d_x)^2). Each
cut is tighter than the one before. A query compares its best scores so far with the bounds of a block,
coarse to fine; pairs that fall below drop out, and those that are left are multiplied out.

Equal vectors are one vector with its smallest ids, as many as a query can be answered with. Queries and
vectors are dealt into a grid of blocks of bounded size; a task holds one block of each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallygrid.llm.common import table
from tallygrid.llm.vectors import key, matrix, whole_numbers
from tallygrid.session import stored

TOP, EVERY, STEPS = 20, 20, 64  # best rows of a query, every which id is a query, steps of a component
QUERY_BLOCK, VECTOR_BLOCK = 1 << 18, 1 << 21  # components in a block, on average
PIECE = 1024  # vectors of a block that are bounded at once
SPARSE = 0.02  # share of pairs below which they are followed one by one
V = ["v1", "v2"]


def features(x: np.ndarray, segments: int) -> np.ndarray:
    """For each segment sqrt(L) times mean and deviation: the product of two such rows bounds the inner product."""
    edges = np.linspace(0, x.shape[1], segments + 1).astype(int)
    out = np.empty((len(x), 2 * segments))
    for k in range(segments):
        part = x[:, edges[k] : edges[k + 1]]
        size = max(part.shape[1], 1)
        mean = part.sum(1) / size
        out[:, 2 * k] = math.sqrt(size) * mean
        out[:, 2 * k + 1] = np.sqrt(((part - mean[:, None]) ** 2).sum(1))
    return out


def cuts(dim: int) -> list[int]:
    """Numbers of segments, coarse to fine; the finest has two components a segment."""
    out, n = [], 1
    while n <= dim // 2:
        out.append(n)
        n *= 2
    return out or [1]


def exact_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of all rows of both, as whole numbers; an error if they do not fit in 64 bits."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most < 2.0**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if most < 2.0**63:
        return q @ x.T
    full = q.astype(object) @ x.astype(object).T
    if full.size and max(abs(int(full.max())), abs(int(full.min()))) >= 1 << 63:
        raise OverflowError("an inner product does not fit in 64 bits")
    return full.astype(np.int64)


class Best:
    """The best scores of every query so far: greater scores first, then smaller least ids."""

    def __init__(self, queries: int, top: int):
        self.top = top
        self.score = np.full((queries, top), np.iinfo(np.int64).min)
        self.least = np.full((queries, top), np.iinfo(np.int64).max)
        self.row = np.full((queries, top), -1, np.int64)

    def limits(self) -> np.ndarray:
        """What a score must reach to count."""
        return self.score[:, -1]

    def add(self, query: np.ndarray, score: np.ndarray, least: np.ndarray, row: np.ndarray) -> None:
        """Take in pairs; a pair comes once."""
        changed = np.unique(query)
        old = self.row[changed].ravel() >= 0
        every = np.concatenate([np.repeat(changed, self.top)[old], query])
        scores = np.concatenate([self.score[changed].ravel()[old], score])
        leasts = np.concatenate([self.least[changed].ravel()[old], least])
        rows = np.concatenate([self.row[changed].ravel()[old], row])
        order = np.lexsort((leasts, -scores, every))
        every, scores, leasts, rows = every[order], scores[order], leasts[order], rows[order]
        start = np.searchsorted(every, every)
        rank = np.arange(len(every)) - start
        keep = rank < self.top
        self.score[every[keep], rank[keep]] = scores[keep]
        self.least[every[keep], rank[keep]] = leasts[keep]
        self.row[every[keep], rank[keep]] = rows[keep]


def search_block(q: np.ndarray, x: np.ndarray, least: np.ndarray, top: int) -> Best:
    """The ``top`` rows of ``x`` for every row of ``q``; ``least`` orders rows of equal score."""
    best, levels = Best(len(q), top), cuts(q.shape[1])
    of_q = {n: features(q, n) for n in levels}
    slack = 1e-9 * (1 + float(np.abs(of_q[levels[0]]).max(initial=0))) ** 2
    for at in range(0, len(x), PIECE):
        part, ids = x[at : at + PIECE], least[at : at + PIECE]
        if at == 0:
            scores = exact_products(q, part)
            for row in range(0, len(q), PIECE):  # to start with, the best of the first vectors
                some = scores[row : row + PIECE]
                order = np.lexsort((np.broadcast_to(ids, some.shape), -some), axis=1)[:, :top]
                n = order.shape[1]
                best.score[row : row + PIECE, :n] = np.take_along_axis(some, order, 1)
                best.least[row : row + PIECE, :n], best.row[row : row + PIECE, :n] = ids[order], order
            continue
        limit = best.limits().astype(np.float64) - slack
        limit -= 1e-9 * np.abs(limit)
        where = None  # pairs that are left, once they are few
        for n in levels:
            of_x = features(part, n)
            if where is None:
                left = of_q[n] @ of_x.T >= limit[:, None]
                if np.count_nonzero(left) < SPARSE * left.size:
                    where = np.nonzero(left)
            else:
                bound = np.einsum("ij,ij->i", of_q[n][where[0]], of_x[where[1]])
                passed = bound >= limit[where[0]]
                where = where[0][passed], where[1][passed]
        if where is None:
            scores = exact_products(q, part)
            where = np.nonzero(left & (scores >= best.limits()[:, None]))
            scores = scores[where]
        else:
            scores = _pair_products(q, part, *where)
        if len(where[0]):
            best.add(where[0], scores, ids[where[1]], where[1] + at)
    return best


def _pair_products(q, x, rows, columns) -> np.ndarray:
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most < 2.0**63:
        return np.einsum("ij,ij->i", q[rows], x[columns])
    return np.array([exact_products(q[[a]], x[[b]])[0, 0] for a, b in zip(rows, columns, strict=True)], np.int64)


def _search(top: int):
    def search(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        kinds = pa.schema([("v1", pa.int64()), ("v2", pa.int64()), ("score", pa.int64()), ("least", pa.int64()), ("ids", pa.list_(pa.int64()))])
        if not len(queries) or not len(vectors):
            return kinds.empty_table()
        q, x = matrix(queries["x"]), matrix(vectors["x"])
        dim = max(q.shape[1], x.shape[1])
        q, x = matrix(queries["x"], dim), matrix(vectors["x"], dim)
        ids = vectors["ids"].combine_chunks()
        least = np.asarray(ids.flatten())[np.asarray(ids.offsets)[:-1] - ids.offsets[0].as_py()]
        best = search_block(q, x, least, top)
        found = best.row >= 0
        who = np.nonzero(found)[0]
        columns = [
            queries["v1"].combine_chunks().take(pa.array(who)), queries["v2"].combine_chunks().take(pa.array(who)),
            pa.array(best.score[found]), pa.array(best.least[found]), ids.take(pa.array(best.row[found])),
        ]
        return pa.Table.from_arrays(columns, schema=kinds)

    return search


def top_products(
    rows: DataFrame,
    top: int = TOP,
    every: int = EVERY,
    steps: int = STEPS,
    query_block: int = QUERY_BLOCK,
    vector_block: int = VECTOR_BLOCK,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the ``top`` rows of greatest inner product for every
    row whose id is divisible by ``every``, ties to the smaller id.

    ``rows`` has ``vec_id`` and ``embedding``; other columns are not read. Components are floor(``steps`` * c).
    Rows with a null id, or whose vector is null or holds null, non-finite or immense components
    (``vectors.whole_numbers``), take no part. Rows of equal id and vector are one row. No row answers a
    query with its own id. Where one id has several vectors, each is a row of its own, and as a query the
    id gets the best of what all of them find. Vectors of different length are filled up with zeros. A
    score beyond 64 bits is an error. An empty table gives no rows.
    """
    given = whole_numbers(rows.where("vec_id IS NOT NULL"), "embedding", steps)
    given = given.select(F.col("vec_id").cast("long").alias("vec_id"), "x", *key()).distinct()
    # Of equal vectors the smallest ids, as many as there can be in an answer; each task sends no more than these.
    first = Window.partitionBy(*V).orderBy("vec_id")
    ranked = given.withColumn("_rank", F.row_number().over(first)).where(f"_rank <= {top + 1}")
    vectors = ranked.groupBy(*V).agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.first("x").alias("x"))
    vectors = stored(vectors, "vectors")
    asked = given.where(f"vec_id % {every} = 0")
    queries = stored(asked.groupBy(*V).agg(F.first("x").alias("x")), "query-vectors")
    n_vectors, dim = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(1))).first()
    down = max(1, math.ceil(queries.count() * dim / query_block))
    spread = math.ceil(2 * rows.sparkSession.sparkContext.defaultParallelism / down)
    across = max(1, math.ceil(n_vectors * dim / vector_block), min(spread, n_vectors // (4 * PIECE)))
    # A block is a hash of the vector, so blocks of many vectors are about as large as the average.
    block_q, block_x = F.pmod(F.col("v1"), F.lit(down)), F.pmod(F.col("v2"), F.lit(across))
    each_x = F.explode(F.sequence(F.lit(0), F.lit(across - 1)))
    each_q = F.explode(F.sequence(F.lit(0), F.lit(down - 1)))
    left = queries.select(*V, "x", block_q.cast("int").alias("row"), each_x.alias("column"))
    right = vectors.select("ids", "x", each_q.alias("row"), block_x.cast("int").alias("column"))
    dealt = [side.repartition(down * across, "row", "column").groupBy("row", "column") for side in (left, right)]
    found = dealt[0].cogroup(dealt[1]).applyInArrow(
        _search(top + 1), "v1 long, v2 long, score long, least long, ids array<long>"
    )
    order = Window.partitionBy(*V).orderBy(F.col("score").desc(), "least")
    best = found.withColumn("_rank", F.row_number().over(order)).where(f"_rank <= {top + 1}")
    pairs = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("less"), i.alias("vec_id")))
    answers = best.groupBy(*V).agg(F.flatten(F.collect_list(pairs)).alias("pairs"))
    answers = stored(answers.select(*V, F.slice(F.array_sort("pairs"), 1, top + 1).alias("pairs")), "answers")
    ids = asked.select(F.col("vec_id").alias("query_id"), *V)
    mine = ids.join(answers, V).select("query_id", F.explode("pairs").alias("x")).select("query_id", "x.*")
    last = Window.partitionBy("query_id").orderBy("less", "vec_id")
    ranks = mine.where("vec_id <> query_id").withColumn("rank", F.row_number().over(last)).where(f"rank <= {top}")
    return ranks.select("query_id", "rank", "vec_id", (-F.col("less")).alias("score"))


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"))


ORACLE = """
    WITH given AS (
        SELECT DISTINCT vec_id, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)) AS x FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
        FROM given q JOIN given c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
    ranked AS (
        SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
        FROM scored)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20"""
