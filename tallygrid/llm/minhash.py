"""Near-duplicate documents by MinHash.

Documents with equal text form a class, and only classes are compared. A class is described by
the minima of ``HASHES`` universal hash functions over its word shingles. Bands of ``ROWS``
minima are the keys of buckets; classes that share a bucket are candidates. The share of equal
minima discards candidates that are far below the limit, the full shingle sets decide on the
rest, and connected components come from alternating large-star and small-star rounds.

No bucket is expanded into pairs. First every member is compared with the least member of its
bucket, which joins a group of copies. Only buckets that still hold several components are
looked at again: their members are dealt into blocks of bounded size, and a task takes two blocks
that meet in a bucket, skips what is connected and passes on only the links that join components.
So every pair in a common bucket is either compared or known to be connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tallygrid.llm.common import groups_by_size, table, text_batches
from tallygrid.session import stored

HASHES, ROWS = 128, 4
BANDS = HASHES // ROWS
MARGIN = 0.25  # so far below the limit the share of equal minima rules a pair out: seven deviations
BLOCK, BLOCK_SHINGLES = 128, 1 << 17  # about so many members and shingles are in a block
_P = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
               0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _P[3]
    x = (x ^ (x >> np.uint64(29))) * _P[4]
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Hashes of the word shingles of texts; remembers the hashes of up to ``most`` words."""

    def __init__(self, width: int, most: int = 150_000):
        self.width, self.most, self.seen = width, most, {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Hashes of all shingles in text order; fewer words than the width make one shingle."""
        words = (text or "").encode("utf-8", "replace").lower().split()
        seen = self.seen
        if len(seen) > self.most:
            seen.clear()
        for word in set(words).difference(seen):
            seen[word] = xxhash.xxh3_64_intdigest(word)
        h = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(h))
        if not width:
            return h
        total = np.full(len(h) - width + 1, width, np.uint64)
        for j in range(width):
            total = total * _P[0] + h[j : len(h) - width + 1 + j] * _P[1 + j % 2]
        return _mixed(total)


def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    a = rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def signatures(shingles: list[np.ndarray]) -> np.ndarray:
    """Minima of all hash functions, one row for each array; an empty one gets the largest value."""
    a, b = _functions()
    out = np.full((len(shingles), HASHES), np.iinfo(np.uint32).max, np.uint32)
    filled = [k for k, s in enumerate(shingles) if len(s)]
    for lo, hi in groups_by_size(np.array([len(shingles[k]) for k in filled]), 50_000):
        rows = filled[lo:hi]
        flat = np.concatenate([shingles[k] for k in rows])
        starts = np.concatenate([[0], np.cumsum([len(shingles[k]) for k in rows])[:-1]])
        for f in range(HASHES):
            values = ((flat * a[f] + b[f]) >> np.uint64(32)).astype(np.uint32)
            out[rows, f] = np.minimum.reduceat(values, starts)
    return out


def _text_classes(docs: DataFrame, width: int) -> DataFrame:
    """A row for each different text: ``c`` (its number), hashes, least id, set size and minima."""

    text_batches(docs.sparkSession)

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(width)
        for batch in batches:
            for lo, hi in groups_by_size(batch["text"].str.len().to_numpy(), 4_000_000):
                part = batch.iloc[lo:hi]
                hashed = [shingler(t) for t in part["text"]]
                minima = signatures(hashed).view(np.int32)
                yield pd.DataFrame({
                    "doc_id": part["doc_id"], "h1": part["h1"], "h2": part["h2"],
                    "n": [len(np.unique(h)) for h in hashed], "minima": [m.tobytes() for m in minima],
                })

    described = _hashed(docs).mapInPandas(describe, "doc_id long, h1 long, h2 long, n long, minima binary")
    classes = described.groupBy("h1", "h2").agg(
        F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("minima").alias("minima")
    )
    return stored(classes.withColumn("c", F.monotonically_increasing_id()), "classes")


def _hashed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h1"),
        F.xxhash64(text, F.lit(1)).alias("h2"), text.alias("text"),
    )


def _buckets(classes: DataFrame) -> DataFrame:
    """``c``, ``band`` and ``key`` of all buckets that a class lies in."""
    keys = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda k: F.xxhash64(k, F.substring("minima", k * (4 * ROWS) + 1, F.lit(4 * ROWS))),
    )
    return classes.where("n > 0").select("c", F.posexplode(keys).alias("band", "key"))


def _alike(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose set sizes and minima do not rule out a similarity of ``percent``."""
    a = classes.select(F.col("c").alias("a"), F.col("n").alias("n_a"), F.col("minima").alias("m_a"))
    b = classes.select(F.col("c").alias("b"), F.col("n").alias("n_b"), F.col("minima").alias("m_b"))
    both = pairs.join(a, "a").join(b, "b").where(_sizes_allow(F.col("n_a"), F.col("n_b"), percent))

    def estimate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                m = [np.frombuffer(b"".join(batch[x]), np.int32).reshape(-1, HASHES) for x in ("m_a", "m_b")]
                yield batch.loc[(m[0] == m[1]).mean(1) >= percent / 100 - MARGIN, ["a", "b"]]

    return both.select("a", "b", "m_a", "m_b").mapInPandas(estimate, "a long, b long")


def _sizes_allow(n_a: Column, n_b: Column, percent: int) -> Column:
    return 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)


def _sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """``c``, ``n``, ``minima`` and the full shingle ``set`` of the classes in ``nodes``."""
    chosen = classes.join(nodes, "c").select("c", "h1", "h2")
    texts = _hashed(docs).drop("doc_id").join(chosen, ["h1", "h2"]).groupBy("c").agg(F.first("text").alias("text"))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(width)
        for batch in batches:
            for lo, hi in groups_by_size(batch["text"].str.len().to_numpy(), 1_000_000):
                part = batch.iloc[lo:hi]
                yield pd.DataFrame({"c": part["c"], "set": [np.unique(shingler(t).view(np.int64)) for t in part["text"]]})

    full = stored(texts.mapInPandas(sets, "c long, set array<long>"), "sets")
    return full.join(classes.select("c", "n", "minima"), "c")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full shingle sets reach the limit."""
    a = sets.select(F.col("c").alias("a"), F.col("n").alias("n_a"), F.col("set").alias("set_a"))
    b = sets.select(F.col("c").alias("b"), F.col("n").alias("n_b"), F.col("set").alias("set_b"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    union = F.col("n_a") + F.col("n_b") - common
    return stored(pairs.join(a, "a").join(b, "b").where(100 * common >= percent * union).select("a", "b"), "links")


def _star_round(edges: DataFrame) -> DataFrame:
    """The edges after a large-star and a small-star; ``b`` is the lesser end of each.

    Each node passes its larger, then its smaller neighbours on to the least node it knows. An edge gives one row in
    either half, and a window finds the least neighbour, so that a round is three shuffles without any join.
    """
    there, back = F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))
    least = F.min("v").over(Window.partitionBy("u"))
    ways = edges.select(F.explode(F.array(there, back)).alias("way")).select("way.*")
    large = ways.withColumn("m", F.least(least, "u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    # Of the edges of a node the one to the least stays, the others go on to it.
    small = large.withColumn("m", least).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("a"), F.col("m").alias("b"))
    return small.distinct()


def components(links: DataFrame) -> DataFrame:
    """``c`` and ``component``, the least number reachable, for every end of a link.

    Rounds of large-star and small-star, until one changes nothing. The links of one node lie in one task. Every round
    is written to the shared folder.
    """
    def state(edges: DataFrame) -> Row:
        return edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first()

    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "stars")
    before, now = None, state(edges)
    while now != before:
        edges, before = stored(_star_round(edges), "stars"), now
        now = state(edges)
    return edges.select(F.col("a").alias("c"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("c"), F.col("b").alias("component")).distinct()
    )


def _rest(buckets: DataFrame, stars: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components that meet in a bucket, at least enough to join what is linked.

    A cluster is what buckets connect, linked or not; all members of a bucket are in one cluster.
    Blocks lie within a cluster. A component that fills blocks of its own has only these, so that
    blocks which need no comparison with each other are many where a group is large. What several
    of the steps below need is stored, because the plans would repeat all that lies before it.
    """
    placed = components(stars).withColumnRenamed("component", "cluster").join(found, "c", "left")
    placed = stored(placed.withColumn("component", F.coalesce("component", "c")), "clusters")
    several = placed.groupBy("cluster").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    placed = placed.join(several.where("low <> high").select("cluster"), "cluster").join(sets.select("c", "n"), "c")
    placed = stored(placed, "mixed-clusters")
    sizes = placed.groupBy("cluster", "component").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    kind = F.when((F.col("members") >= BLOCK) | (F.col("shingles") >= BLOCK_SHINGLES), F.col("component")).otherwise(-1)
    kinds = stored(sizes.withColumn("kind", kind), "kinds")
    parts = F.ceil(F.greatest(F.sum("members") / BLOCK, F.sum("shingles") / BLOCK_SHINGLES)).alias("parts")
    kinds = kinds.join(kinds.groupBy("cluster", "kind").agg(parts), ["cluster", "kind"])
    block = F.xxhash64("cluster", "kind", F.pmod(F.xxhash64("c", F.lit(3)), F.col("parts")))
    members = stored(placed.drop("n").join(kinds.select("cluster", "component", "kind", "parts"), ["cluster", "component"])
                     .select("c", "component", block.alias("block")), "members")
    there = buckets.join(members, "c").groupBy("band", "key", "block").agg(
        F.min("component").alias("low"), F.max("component").alias("high")
    )
    mixed = there.groupBy("band", "key").agg(F.min("low").alias("lo"), F.max("high").alias("hi")).where("lo <> hi")
    there = there.join(mixed.select("band", "key"), ["band", "key"])
    one = there.select("band", "key", *[F.col(x).alias(f"{x}_a") for x in ("block", "low", "high")])
    other = there.select("band", "key", *[F.col(x).alias(f"{x}_b") for x in ("block", "low", "high")])
    differ = F.least("low_a", "low_b") != F.greatest("high_a", "high_b")
    meeting = one.join(other, ["band", "key"]).where((F.col("block_a") <= F.col("block_b")) & differ)
    meeting = stored(meeting.select("block_a", "block_b").distinct(), "meeting")
    rows = stored(members.join(sets, "c").groupBy("block").agg(
        F.collect_list(F.struct("c", "component", "n", "minima", "set")).alias("rows")
    ), "blocks")
    twice = meeting.join(rows.select(F.col("block").alias("block_a"), F.col("rows").alias("rows_a")), "block_a")
    twice = twice.join(rows.select(F.col("block").alias("block_b"), F.col("rows").alias("rows_b")), "block_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = _between(_Block(batch.column("rows_a")[k]), _Block(batch.column("rows_b")[k]), percent)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)] or [pa.array([], pa.int64())] * 2, names=["a", "b"])

    return stored(twice.select("rows_a", "rows_b").mapInArrow(compare, "a long, b long"), "more-links")


class _Block:
    """Members of a block as arrays."""

    def __init__(self, rows: pa.ListScalar):
        values = rows.values
        self.c, self.component, self.n = (values.field(x).to_numpy(zero_copy_only=False) for x in ("c", "component", "n"))
        self.minima = np.frombuffer(b"".join(values.field("minima").to_pylist()), np.int32).reshape(-1, HASHES)
        self.sets = [s.values.to_numpy() for s in values.field("set")]


def _between(one: _Block, other: _Block, percent: int) -> list[tuple[int, int]]:
    """Links that join components, by exact sets of all pairs that minima and sizes do not rule out."""
    parent: dict[int, int] = {}

    def root(k: int) -> int:
        while parent.get(k, k) != k:
            k = parent[k]
        return k

    out = []
    for i in range(len(one.c)):
        fit = (one.minima[i] == other.minima).mean(1) >= percent / 100 - MARGIN
        fit &= 100 * np.minimum(other.n, one.n[i]) >= percent * np.maximum(other.n, one.n[i])
        for j in np.flatnonzero(fit):
            a, b = root(int(one.component[i])), root(int(other.component[j]))
            if a != b:
                common = len(np.intersect1d(one.sets[i], other.sets[j], assume_unique=True))
                if 100 * common >= percent * (int(one.n[i]) + int(other.n[j]) - common):
                    parent[max(a, b)] = min(a, b)
                    out.append((int(one.c[i]), int(other.c[j])))
    return out


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` for every row of ``docs``.

    Two documents are linked when ``100 * common >= percent * union`` holds for their sets of
    shingles of ``width`` words; A-Z count as a-z and white space separates words. A component is
    named by its least id and only that document is kept. Texts without words, nulls included, are
    linked with nothing. A null id is never the least; a component of null ids only has a null
    name and its rows are kept, as is a document without words. Rows with the same id each come
    out. Further columns are not read; an empty table gives none.
    """
    classes = _text_classes(docs, width)
    buckets = _buckets(classes)
    centers = buckets.groupBy("band", "key").agg(F.min("c").alias("a"), F.count("*").alias("members")).where("members > 1")
    stars = buckets.join(centers, ["band", "key"]).where("a <> c").select("a", F.col("c").alias("b")).distinct()
    stars = stored(stars, "candidates")
    sets = _sets(stars.select(F.explode(F.array("a", "b")).alias("c")).distinct(), classes, docs, width)
    links = _links(_alike(stars, classes, percent), sets, percent)
    found = components(links)
    more = _rest(buckets, stars, found, sets, percent)
    if not more.isEmpty():
        found = components(found.select(F.col("c").alias("a"), F.col("component").alias("b")).unionByName(more))
    named = classes.join(found, "c", "left").withColumn("component", F.coalesce("component", "c"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = named.join(least, "component").select("h1", "h2", "n", "component_id")
    rows = _hashed(docs).drop("text").join(of_class, ["h1", "h2"])
    # Texts without words: each such document is alone, though they may form one class.
    alone = F.col("n") == 0
    name = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select(
        "doc_id", "h1", "h2", F.col("n").alias("n_shingles"), name.alias("component_id"),
        (alone | F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group: the rows of ``docs`` that are kept, with all their columns.

    Of several rows with the id and text that is kept, all stay.
    """
    kept = near_duplicates(docs, width, percent).where("kept").select("doc_id", "h1", "h2").distinct()
    text = F.coalesce(F.col("text"), F.lit(""))
    same = [docs["doc_id"].eqNullSafe(kept["doc_id"]), F.xxhash64(text) == kept["h1"], F.xxhash64(text, F.lit(1)) == kept["h2"]]
    return docs.join(kept, same, "left_semi")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return near_duplicates(docs, width=3, percent=85).drop("h1", "h2")


ORACLE = r"""
    WITH RECURSIVE worded AS (
        SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
        FROM documents),
    shingled AS (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
               ELSE list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k : k + 2], ' ')) END) AS s
        FROM worded),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id),
    common AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
        FROM shingled a JOIN shingled b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
    links AS (
        SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
        WHERE 100 * c >= 85 * (x.n + y.n - c)),
    ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (
        SELECT doc_id AS start, doc_id AS other FROM documents
        UNION
        SELECT r.start, l.b FROM reach r JOIN ways l ON l.a = r.other)
    SELECT d.doc_id, CAST(coalesce(max(s.n), 0) AS BIGINT) AS n_shingles, min(r.other) AS component_id,
           d.doc_id = min(r.other) AS kept
    FROM documents d JOIN reach r ON r.start = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id"""
