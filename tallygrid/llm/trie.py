"""Prefix trie of conversations by blocks of turns of fixed length.

Every turn gets the digest of the conversation up to it: the exclusive or, over the turns so far, of two
64-bit hashes of place, role and text. Conversations are grouped by the digests at the ends of whole blocks
of ``BLOCK`` turns (the last block may be shorter). A block that is the only one after its predecessor holds
a single path, whose turns need no grouping; where several blocks follow the same predecessor, their turns
are told apart one by one, a row for each different block, however many conversations share it.

Sums over subtrees need no walk through the tree. A conversation is the smallest member of the nodes on its
path from some depth on, its ``fresh`` depth; every node is fresh in one conversation. What a node saves is
its words in all members but this one, so a subtree saves the words that its members have, at its depth
and below, before their fresh depth: sums over conversations, then over the blocks that share a prefix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallygrid.llm.common import table
from tallygrid.session import stored

BLOCK = 4  # turns of a block
FAMILY, SHARED = 20, 4  # conversations of a family share up to SHARED - 1 turns of the first of them
CHUNK = 4096  # range of ids whose list is one piece of a digest
NODE = ["depth", "a", "b"]  # a node: its depth and the digest of its turns
ROOT = (0, 0, 0)


def _digests() -> list[Column]:
    """Two hashes of a turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return [F.xxhash64(role, text).alias("t1"), F.xxhash64(text, F.lit(1), role).alias("t2"), words.alias("words")]


def rebuilt_turns(conversations: DataFrame) -> DataFrame:
    """``family``, ``conv``, ``depth`` (from 1), ``t1``, ``t2`` and ``words`` of every rebuilt turn.

    Texts are hashed before they are shuffled, and one shuffle by family serves all that follows. A
    conversation, like a document, lies in one task, which spills if it is very long.
    """
    conv = F.col("conv_id").cast("long")
    given = conversations.where("conv_id IS NOT NULL").select(
        (conv - conv % FAMILY).alias("family"), conv.alias("conv"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), *_digests(),
    ).repartition("family")
    inside = Window.partitionBy("family", "conv")
    order = inside.orderBy(F.col("turn").asc_nulls_first(), "role", "t1", "t2")
    turn = F.struct("place", "t1", "t2", "words")
    first = (F.col("conv") == F.col("family")) & (F.col("place") < SHARED)
    placed = given.withColumn("place", F.row_number().over(order).cast("long"))
    lent = F.array_sort(F.collect_list(F.when(first, turn)).over(Window.partitionBy("family")))
    taken = (F.crc32(F.col("conv").cast("string")) % SHARED).cast("int")
    shared = placed.select("family", "conv", turn.alias("own"), lent.alias("lent"), taken.alias("taken"))
    shared = shared.withColumn("lent", F.slice("lent", 1, F.greatest("taken", F.lit(1)))).withColumn(
        "lent", F.when(F.col("taken") > 0, F.col("lent")).otherwise(F.slice("lent", 1, 0))
    )
    kept = F.struct(
        (F.col("own.place") - F.col("taken") + F.size("lent")).alias("place"), "own.t1", "own.t2", "own.words"
    )
    none = F.slice("lent", 1, 0)
    rows = F.concat(
        F.when(F.col("own.place") == 1, F.col("lent")).otherwise(none),
        F.when(F.col("own.place") > F.col("taken"), F.array(kept)).otherwise(none),
    )
    return shared.select("family", "conv", F.explode(rows).alias("x")).select(
        "family", "conv", F.col("x.place").alias("depth"), "x.t1", "x.t2", "x.words"
    )


def block_rows(turns: DataFrame, block: int) -> DataFrame:
    """A row for each block of each conversation: ``conv``, ``k`` (number of the block), the digest before it
    (``a0``, ``b0``), its ``turns`` (depth, a, b, words), their number, the digest at its end, and whether
    the conversation ends with it."""
    order = Window.partitionBy("family", "conv").orderBy("depth")
    so_far = turns.select(
        "family", "conv", "depth", "words",
        F.bit_xor(F.xxhash64("depth", "t1", "t2")).over(order).alias("a"),
        F.bit_xor(F.xxhash64("t2", "depth", "t1")).over(order).alias("b"),
    )
    before = [F.coalesce(F.lag(c).over(order), F.lit(0).cast("long")).alias(f"{c}_") for c in "ab"]
    last = F.lead("depth").over(order).isNull().alias("last")
    found = so_far.select("*", *before, last, F.floor((F.col("depth") - 1) / block).cast("long").alias("k"))
    turn = F.struct("depth", "a", "b", "words", "a_", "b_")
    grouped = found.groupBy("family", "conv", "k").agg(
        F.array_sort(F.collect_list(turn)).alias("turns"), F.max("last").alias("last")
    )
    begin, end = F.get("turns", F.lit(0)), F.element_at("turns", -1)
    plain = F.transform("turns", lambda t: F.struct(t["depth"], t["a"], t["b"], t["words"]))
    return grouped.select(
        "conv", "k", begin["a_"].alias("a0"), begin["b_"].alias("b0"), plain.alias("turns"), "last",
        end["depth"].alias("depth"), end["a"].alias("a"), end["b"].alias("b"),
    )


def _exploded(blocks: DataFrame, *columns) -> DataFrame:
    """A row for each turn of each block: node, parent node, words and place in the block."""
    at = F.col("_at")
    before = F.when(at > 0, F.get("turns", at - 1)).otherwise(
        F.struct(F.lit(0).cast("long").alias("depth"), F.col("a0").alias("a"), F.col("b0").alias("b"), F.lit(0).cast("long").alias("words"))
    )
    rows = blocks.select("*", F.posexplode("turns").alias("_at", "_turn"))
    return rows.select(
        "_turn.depth", "_turn.a", "_turn.b", before["a"].alias("pa"), before["b"].alias("pb"), "_turn.words", *columns
    )


def _digest_of_lists(lists: DataFrame) -> DataFrame:
    """``depth``, ``a``, ``b`` and ``ends_sha256``: the digest of all lists of a node, in the order of ``chunk``.

    SHA-256 takes its input in order, so the pieces of a node meet in one task, which reads them as a
    sorted stream and keeps one state.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, done = None, None, []
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*NODE, "ids")]
            for *key, ids in zip(*columns, strict=True):
                if key != node:
                    if state is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield packed(done)
            done = []
        if state is not None:
            yield packed([(*node, state.hexdigest())])

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [*NODE, "ends_sha256"])

    sorted_ = lists.select(*NODE, "chunk", "ids").repartition(*NODE).sortWithinPartitions(*NODE, "chunk")
    return sorted_.mapInArrow(digest, "depth long, a long, b long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each node of the trie of the rebuilt conversations: ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.

    Of ``conv_id``, ``turn``, ``role`` and ``text`` the last two count as empty where null and a null turn
    comes first. Turns of equal number come by role and then by hashes of their texts; repeated rows are
    turns of their own. Rows without ``conv_id`` belong to no conversation and are not read; further columns
    neither. An empty table has no nodes, not even a root.
    """
    turns = rebuilt_turns(conversations)
    rows = stored(block_rows(turns, block), "trie-rows")
    # Groups of conversations by blocks, and the predecessors that several blocks follow.
    kinds = ["k", "a0", "b0", "turns"]
    blocks = stored(rows.groupBy(*kinds).agg(F.count("*").alias("n"), F.min("conv").alias("rep")), "trie-blocks")
    forks = blocks.groupBy("k", "a0", "b0").agg(F.count("*").alias("_n")).where("_n > 1")
    forks = stored(forks.select("k", "a0", "b0", F.lit(True).alias("fork")), "trie-forks")
    blocks = stored(blocks.join(forks, ["k", "a0", "b0"], "left"), "trie-forked")
    path = [*NODE, "pa", "pb", "words"]
    straight = _exploded(blocks.where("fork IS NULL"), "n", "rep")
    told = _exploded(blocks.where("fork"), "n", "rep").groupBy(*path).agg(F.sum("n").alias("n"), F.min("rep").alias("rep"))
    nodes = stored(straight.unionByName(told), "trie-nodes")
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(
        F.count("*").alias("n_children")
    )
    children = stored(children, "trie-children")
    nodes = stored(nodes.join(children, NODE, "left").na.fill(0, ["n_children"]), "trie-parents")
    # The depth from which a conversation is the smallest member, and whether its end is a leaf.
    fresh = nodes.groupBy(F.col("rep").alias("conv")).agg(
        F.min("depth").alias("fresh"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf")
    )
    sums = _block_sums(rows, fresh, kinds)
    sums = stored(sums.join(forks, ["k", "a0", "b0"], "left"), "trie-sums")
    values = F.transform(
        "turns",
        lambda t: t["words"] * (F.col("n") - F.when(t["depth"] >= F.col("fresh"), F.lit(1)).otherwise(F.lit(0))),
    )
    below = F.aggregate(F.slice("saves", F.col("_at") + 1, F.size("saves")), F.lit(0).cast("long"), lambda s, x: s + x)
    sums = sums.withColumn("saves", values)
    each = ["n_leaves", (F.col("below") + below).alias("saved_tokens")]
    straight = _exploded(sums.where("fork IS NULL"), *each).select(*NODE, "n_leaves", "saved_tokens")
    told = _exploded(sums.where("fork"), *each).groupBy(*NODE).agg(
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")
    )
    totals = straight.unionByName(told)
    root = _root(conversations, children, sums)
    below_root = nodes.join(totals, NODE).select(*path, "n", "rep", "n_children", "n_leaves", "saved_tokens")
    everything = stored(below_root.unionByName(root), "trie-totals")
    parents = everything.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("rep").alias("parent_conv_id"))
    parents = stored(parents, "trie-reps")
    ends = stored(_digest_of_lists(_ends(conversations, rows)), "trie-ends")
    nothing = hashlib.sha256(b"").hexdigest()
    return (
        everything.join(parents, ["depth", "pa", "pb"], "left").join(ends, NODE, "left")
        .select(
            F.col("rep").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children",
            "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
        )
    )


def _block_sums(rows: DataFrame, fresh: DataFrame, kinds: list[str]) -> DataFrame:
    """For each group of conversations by a block: their number, what they save ``below`` the block, their
    leaves, and the ``fresh`` depth of the smallest if it lies in the block or above."""
    words = F.aggregate(
        F.filter("turns", lambda t: t["depth"] < F.coalesce("fresh", F.lit((1 << 63) - 1))),
        F.lit(0).cast("long"),
        lambda s, t: s + t["words"],
    )
    later = Window.partitionBy("conv").orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, -1)
    known = rows.join(fresh, "conv", "left").withColumn("saves", words)
    known = known.withColumn("below", F.coalesce(F.sum("saves").over(later), F.lit(0).cast("long")))
    return known.groupBy(*kinds).agg(
        F.count("*").alias("n"),
        F.sum("below").alias("below"),
        F.sum(F.coalesce("leaf", F.lit(0).cast("long"))).alias("n_leaves"),
        F.sum(F.when(F.col("fresh") <= F.col("depth"), F.col("fresh"))).alias("fresh"),
    )


def _root(conversations: DataFrame, children: DataFrame, sums: DataFrame) -> DataFrame:
    """The root, if there is any conversation."""
    conv = F.col("conv_id").cast("long").alias("conv")
    saved = F.col("below") + F.aggregate("saves", F.lit(0).cast("long"), lambda s, x: s + x)
    members = conversations.where("conv_id IS NOT NULL").select(conv).distinct()
    parts = [
        members.agg(F.count("*").alias("n"), F.min("conv").alias("rep")),
        children.where("depth = 0").agg(F.sum("n_children").alias("n_children")),
        sums.where("k = 0").agg(F.sum("n_leaves").alias("n_leaves"), F.sum(saved).alias("saved_tokens")),
    ]
    one = parts[0]
    for part in parts[1:]:
        one = one.unionByName(part, allowMissingColumns=True)
    zero, null = F.lit(0).cast("long"), F.lit(None).cast("long")
    counts = [F.coalesce(F.max(c), zero).cast("long").alias(c) for c in ("n", "n_children", "n_leaves", "saved_tokens")]
    return one.agg(F.max("rep").alias("rep"), *counts).where("n > 0").select(
        *[F.lit(v).cast("long").alias(c) for c, v in zip(NODE, ROOT, strict=True)], null.alias("pa"), null.alias("pb"),
        zero.alias("words"), "n", "rep", "n_children", F.greatest("n_leaves", F.lit(1).cast("long")).alias("n_leaves"),
        "saved_tokens",
    )


def _ends(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """Ids of the conversations that end at each node, as lists by ranges of ``CHUNK`` ids."""
    conv = F.col("conv_id").cast("long").alias("conv")
    all_ = conversations.where("conv_id IS NOT NULL").select(conv).distinct()
    ending = rows.where("last").select("conv", *NODE)
    root = [F.coalesce(c, F.lit(v).cast("long")).alias(c) for c, v in zip(NODE, ROOT, strict=True)]
    placed = all_.join(ending, "conv", "left").select("conv", *root)
    chunk = F.floor(F.col("conv") / CHUNK).alias("chunk")
    ids = F.transform(F.array_sort(F.collect_list("conv")), lambda x: x.cast("string"))
    return placed.groupBy(*NODE, chunk).agg(F.array_join(ids, ",").alias("ids"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


# crc32 of the decimal id, bit by bit; paths are lists of turns, and a subtree is what starts with a path.
ORACLE = """
    WITH ordered AS (
        SELECT conv_id AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place,
               {'r': coalesce(role, ''), 't': coalesce(text, '')} AS turn
        FROM conversations WHERE conv_id IS NOT NULL),
    own AS (SELECT conv, list(turn ORDER BY place) AS turns FROM ordered GROUP BY conv),
    taken AS (
        SELECT conv, turns, xor(4294967295, list_reduce(
            list_concat([4294967295::BIGINT], list_transform(
                range(1, length(conv::VARCHAR) + 1), lambda i: ascii((conv::VARCHAR)[i])::BIGINT)),
            lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], range(8)),
                lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)))) % 4 AS h
        FROM own),
    rebuilt AS (
        SELECT t.conv, list_concat(coalesce(f.turns, [])[1:t.h], t.turns[t.h + 1:]) AS turns
        FROM taken t LEFT JOIN own f ON f.conv = t.conv - t.conv % 20),
    paths AS (SELECT conv, d AS depth, len(turns) AS size, turns[1:d] AS path
              FROM rebuilt, unnest(range(0, len(turns) + 1)) AS x(d)),
    nodes AS (
        SELECT path, depth, min(conv) AS conv_id, count(*) AS n_convs,
               (count(*) - 1) * CASE WHEN depth = 0 THEN 0
                    ELSE len(regexp_extract_all(path[depth].t, '[^\\x20\\x09-\\x0D]+')) END AS saved,
               sha256(coalesce(string_agg(conv::VARCHAR, ',' ORDER BY conv) FILTER (WHERE size = depth), '')) AS ends_sha256
        FROM paths GROUP BY path, depth),
    kids AS (SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS n_children
             FROM nodes WHERE depth > 0 GROUP BY ALL),
    known AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children
              FROM nodes n LEFT JOIN kids k ON k.depth = n.depth AND k.path = n.path),
    above AS (SELECT u.path[1:d] AS path, d AS depth, sum(u.saved) AS saved_tokens,
                     count(*) FILTER (WHERE u.n_children = 0) AS n_leaves
              FROM known u, unnest(range(0, u.depth + 1)) AS x(d) GROUP BY ALL)
    SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, a.n_leaves,
           a.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
    FROM known n JOIN above a ON a.depth = n.depth AND a.path = n.path
         LEFT JOIN known p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1] AND n.depth > 0"""
