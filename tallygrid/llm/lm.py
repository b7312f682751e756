"""Language-model scores from a log-frequency Bloom filter.

The filter holds quantised counts of bigrams and of rare histories: an n-gram of level q (counts
from 2^(q-1) on) is entered q times, once with each level up to q, and its level is read back by
probing levels until one is missing. Bits are dealt into shards that are built by separate
tasks. Shards are broadcast in rounds of at most ``max_broadcast`` bytes, so the size of what is
sent at once does not grow with the corpus; each bigram lies in one shard and is scored in the
round that holds it.

Words get their exact counts: the ``frequent`` most frequent words are broadcast as sorted hashes,
a table of fixed size, and all others are looked up by a shuffle join.

Probabilities are smoothed by a prior of ``PRIOR`` observations drawn from the single-word model:
p(w | v) = (c(v w) + PRIOR p(w)) / (c(v) + PRIOR).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.llm.common import fold, held_out, table
from tallygrid.session import stored

PRIOR = 200.0
BITS, PROBES = 8, 4  # of each entry
END, START = b"\n", b"\n\n"  # no word holds white space
CHUNK = 6_000_000  # characters handled at once
_P = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _P[2]
    x = (x ^ (x >> np.uint64(29))) * _P[3]
    return x ^ (x >> np.uint64(32))


class Chunk:
    """Tokens of some texts: numbers of different words, and two hashes of each different word."""

    def __init__(self, texts: list[str | None]):
        words = [[*(t or "").encode("utf-8", "replace").lower().split(), END] for t in texts]
        seen: dict[bytes, int] = {START: 0}
        for w in words:
            for x in set(w).difference(seen):
                seen[x] = len(seen)
        self.lengths = np.array([len(w) for w in words], np.int64)
        count = int(self.lengths.sum())
        get = seen.__getitem__
        self.tokens = np.fromiter((n for w in words for n in map(get, w)), np.int64, count)
        digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(w) for w in seen]), "<u8").reshape(-1, 2)
        self.a, self.b = digests[:, 0].astype(np.uint64), digests[:, 1].astype(np.uint64)
        self.begin = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        self.before = np.concatenate([[0], self.tokens[:-1]])
        self.before[self.begin] = 0

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.lengths)), self.lengths)


def _chunks(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, Chunk]]:
    """Parts of the batches of about ``CHUNK`` characters."""
    for batch in batches:
        texts = batch.column(column).to_pylist()
        at = total = 0
        for k, t in enumerate(texts):
            total += len(t or "") + 1
            if total >= CHUNK or k + 1 == len(texts):
                yield batch.slice(at, k + 1 - at), Chunk(texts[at : k + 1])
                at, total = k + 1, 0


def word_counts(docs: DataFrame) -> DataFrame:
    """``a``, ``b`` (hashes of a word) and ``c``, its exact count in all texts, the end included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in _chunks(batches):
            n = np.bincount(x.tokens, minlength=len(x.a))
            there = n > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(v[there].view(np.int64)) for v in (x.a, x.b, n)], names=["a", "b", "c"]
            )

    counted = docs.select("text").mapInArrow(count, "a long, b long, c long")
    return stored(counted.groupBy("a", "b").agg(F.sum("c").alias("c")), "word-counts")


@dataclass
class Words:
    """Frequent words by ascending hash, with their counts; tokens and different words of all."""

    hashes: np.ndarray
    counts: np.ndarray
    tokens: int
    different: int

    def count(self, a: np.ndarray) -> np.ndarray:
        """Counts of words by hash, -1 for a word that is not frequent."""
        if not len(self.hashes):
            return np.full(len(a), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, a), len(self.hashes) - 1)
        return np.where(self.hashes[at] == a, self.counts[at], -1)

    def log_p(self, count):
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.different + 1)))


def frequent_words(counts: DataFrame, most: int) -> Words:
    """The ``most`` most frequent words (a bound of 16 bytes each) and the totals."""
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    top = counts.orderBy(F.desc("c"), "a", "b").limit(most).select("a", "c").toArrow()
    a = top.column("a").to_numpy().view(np.uint64)
    order = np.argsort(a, kind="stable")
    return Words(a[order], top.column("c").to_numpy()[order], int(total.n or 0), int(total.v or 0))


def _ngrams(x: Chunk, known: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bigram hash of every token, its shard, and the hash of its history as an n-gram.

    The bigrams of a rare history lie in the shard of the history, those of a frequent one are
    dealt out by themselves, so that no shard grows with a frequent word.
    """
    history = _mixed(x.a * _P[1])
    bigram = _mixed(x.a[x.before] * _P[0] + x.a[x.tokens])
    dealt = np.where(known[x.before], bigram, history[x.before])
    return bigram, (_mixed(dealt + _P[2]) % np.uint64(shards)).astype(np.int64), history


def _entry(ngrams: np.ndarray, level: int, probe: int, bits: int) -> np.ndarray:
    step = (level * 0x9E3779B97F4A7C15 + probe * 0xC2B2AE3D27D4EB4F) & ((1 << 64) - 1)
    return _mixed(ngrams + np.uint64(step)) % np.uint64(bits)


def _build(ngrams: np.ndarray, counts: np.ndarray) -> bytes:
    """Bits of one shard."""
    levels = np.frexp(counts.astype(np.float64))[1]
    bits = max(64, int(levels.sum()) * BITS)
    out = np.zeros(bits // 8 + 1, np.uint8)
    for level in range(1, int(levels.max(initial=0)) + 1):
        some = ngrams[levels >= level]
        for probe in range(PROBES):
            at = _entry(some, level, probe, bits)
            np.bitwise_or.at(out, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))
    return bits.to_bytes(8, "little") + out.tobytes()


def _levels(shard: bytes | None, ngrams: np.ndarray) -> np.ndarray:
    """Level of each n-gram, 0 where it is missing."""
    found = np.zeros(len(ngrams), np.int64)
    if shard is None:
        return found
    bits, data = int.from_bytes(shard[:8], "little"), np.frombuffer(shard, np.uint8, offset=8)
    left, level = np.arange(len(ngrams)), 1
    while len(left):
        for probe in range(PROBES):
            at = _entry(ngrams[left], level, probe, bits)
            left = left[(data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        found[left] = level
        level += 1
    return found


def _count_of(levels: np.ndarray) -> np.ndarray:
    """Middle count of a level: 1 for the first, else the geometric mean of its bounds."""
    low = np.exp2(np.maximum(levels - 1, 0))
    return np.where(levels == 0, 0.0, np.sqrt(low * (2 * low - 1)))


def filter_shards(docs: DataFrame, words: Words, shards: int) -> DataFrame:
    """``shard`` and its ``bits``. Each task sends one block a shard with the n-grams it counted."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(words))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = Words(**shared.value)
        for _, x in _chunks(batches):
            known = here.count(x.a) >= 0
            bigram, shard, history = _ngrams(x, known, shards)
            rare = ~known[x.before]
            ngrams = np.concatenate([bigram, history[x.before[rare]]])
            where = np.concatenate([shard, shard[rare]])
            order = np.lexsort((ngrams, where))
            ngrams, where = ngrams[order], where[order]
            new = np.flatnonzero(np.concatenate([[True], (ngrams[1:] != ngrams[:-1]) | (where[1:] != where[:-1])])[: len(ngrams)])
            n = np.diff(np.concatenate([new, [len(ngrams)]])).astype("<u4")
            ngrams, where = ngrams[new], where[new]
            at = np.searchsorted(where, np.arange(shards + 1))
            filled = np.flatnonzero(np.diff(at))
            yield pa.RecordBatch.from_arrays([
                pa.array(filled, pa.int64()),
                pa.array([ngrams[at[s] : at[s + 1]].tobytes() for s in filled], pa.binary()),
                pa.array([n[at[s] : at[s + 1]].tobytes() for s in filled], pa.binary()),
            ], names=["shard", "ngrams", "counts"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[tuple[bytes, bytes]]] = {}
        for batch in batches:
            for s, g, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts.setdefault(s, []).append((g, n))
        for s in sorted(parts):
            blocks = parts.pop(s)
            ngrams = np.frombuffer(b"".join(g for g, _ in blocks), "<u8")
            counts = np.frombuffer(b"".join(n for _, n in blocks), "<u4")
            different, where = np.unique(ngrams, return_inverse=True)
            bits = _build(different, np.bincount(where, weights=counts))
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([bits], pa.binary())], names=["shard", "bits"])

    blocks = docs.select("text").mapInArrow(count, "shard long, ngrams binary, counts binary")
    return stored(blocks.repartition(shards, "shard").mapInArrow(build, "shard long, bits binary"), "filter")


SCORED = (
    "rid long, doc_id long, n_tokens long, n_known long, base double, score double, "
    "rare array<struct<a:long,b:long,level:int,n:long,m:long>>"
)


def _score_round(rows: DataFrame, shared: Broadcast, shards: int, data: Broadcast, first: bool) -> DataFrame:
    """Sums over the tokens whose bigram lies in one of the shards of ``data`` (``None`` is an empty one); the counts of tokens and
    the single-word sums come with the ``first`` round. ``rare`` lists the words whose count is
    still to be looked up, with the level of the bigram: ``n`` places for the base, ``m`` for the score."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, number = Words(**shared.value), TaskContext.get().partitionId() << 36
        for batch, x in _chunks(batches):
            counts = here.count(x.a)
            known = counts >= 0
            log_p = here.log_p(np.maximum(counts, 0))
            bigram, shard, history = _ngrams(x, known, shards)
            row, size = x.rows(), len(x.lengths)
            add = lambda v, at: np.bincount(row[at], weights=v, minlength=size)
            order = np.argsort(shard, kind="stable")
            bounds = np.searchsorted(shard[order], np.arange(shards + 1))
            value, levels = np.zeros(len(shard)), np.full(len(shard), -1)
            for s, bits in data.value.items():
                at = order[bounds[s] : bounds[s + 1]]
                v, w = x.before[at], x.tokens[at]
                levels[at] = _levels(bits, bigram[at])
                of_history = np.maximum(counts[v], 0).astype(np.float64)
                rare = ~known[v]
                of_history[rare] = _count_of(_levels(bits, history[v[rare]]))
                # A wrong hit cannot exceed the counts of the words it is made of.
                levels[at] = np.where(of_history > 0, levels[at], 0)
                seen = np.minimum(_count_of(levels[at]), of_history)
                seen = np.where(known[w], np.minimum(seen, counts[w]), seen)
                # What a rare word adds above the fraction line follows by the join.
                above = np.where(known[w], np.log10(seen + PRIOR * 10.0 ** log_p[w]), 0.0)
                value[at] = above - np.log10(of_history + PRIOR)
            every = slice(None)
            tail = ~known[x.tokens]
            listed = np.flatnonzero(tail if first else tail & (levels >= 0))
            key = (row[listed] * len(x.a) + x.tokens[listed]) * 65 + levels[listed] + 1
            pairs, n = np.unique(key, return_counts=True)
            level, pairs = (pairs % 65 - 1).astype(np.int32), pairs // 65
            m = n * (level >= 0)
            owner, word = pairs // len(x.a), pairs % len(x.a)
            lists = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(owner, np.arange(size + 1)).astype(np.int32)),
                pa.StructArray.from_arrays(
                    [pa.array(c) for c in (x.a[word].view(np.int64), x.b[word].view(np.int64), level, n * int(first), m)],
                    names=["a", "b", "level", "n", "m"],
                ),
            )
            rid = np.arange(number, number + size)
            number += size
            base = add(log_p[x.tokens] * known[x.tokens], every)
            yield pa.RecordBatch.from_arrays([
                batch.column("rid") if "rid" in batch.schema.names else pa.array(rid), batch.column("doc_id").cast(pa.int64()),
                pa.array(x.lengths * first), pa.array((add(known[x.tokens].astype(float), every) * first).astype(np.int64)),
                pa.array(base * first), pa.array(add(value, every)), lists,
            ], names=["rid", "doc_id", "n_tokens", "n_known", "base", "score", "rare"])

    return rows.mapInArrow(score, SCORED)


def score_documents(
    docs: DataFrame, training: DataFrame, frequent: int = 1_000_000, max_broadcast: int = 256 << 20,
    tokens_per_shard: int = 4_000_000,
) -> DataFrame:
    """Scores of all rows of ``docs`` by a model of the texts of ``training``.

    Returns ``doc_id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` for
    every row. A null is the empty text, whose only token is the end. Repeated rows are scored
    each and each count in training. Without training texts every word is unknown. Null ids stay
    null, other columns are not read, and an empty table gives none.
    """
    counts = word_counts(training)
    words = frequent_words(counts, frequent)
    shards = max(8, math.ceil(words.tokens / tokens_per_shard))
    bits = filter_shards(training, words, shards)
    sizes = bits.select("shard", F.length("bits").alias("size")).orderBy("shard").collect()
    rounds, total = [[]], 0
    for r in sizes:
        if rounds[-1] and total + r.size > max_broadcast:
            rounds, total = [*rounds, []], 0
        rounds[-1].append(r.shard)
        total += r.size
    rows = docs.select("doc_id", "text")
    if len(rounds) > 1:
        rows = stored(rows.withColumn("rid", F.monotonically_increasing_id()), "rows")
    context, parts = docs.sparkSession.sparkContext, []
    shared = context.broadcast(vars(words))
    for k, group in enumerate(rounds):
        held = {r.shard: bytes(r.bits) for r in bits.where(F.col("shard").isin(group)).collect()} if group else {}
        if k == 0:  # a shard without n-grams has no row
            held |= dict.fromkeys(set(range(shards)).difference(r.shard for r in sizes))
        data = context.broadcast(held)
        parts.append(stored(_score_round(rows, shared, shards, data, k == 0), f"scored-{k}"))
        data.destroy()
    shared.destroy()
    scored = parts[0]
    for part in parts[1:]:
        scored = scored.unionByName(part)
    rare = scored.select("rid", F.explode("rare").alias("x")).select("rid", "x.*")
    c = F.coalesce("c", F.lit(0))
    p = (c + 0.5) / (words.tokens + 0.5 * (words.different + 1))
    low = F.pow(F.lit(2.0), F.col("level") - 1)
    seen = F.when(F.col("level") <= 0, 0.0).otherwise(F.least(F.sqrt(low * (2 * low - 1)), c))
    looked_up = rare.join(counts, ["a", "b"], "left").groupBy("rid").agg(
        F.sum(F.col("n") * F.log10(p)).alias("more_base"), F.sum(F.col("m") * F.log10(seen + PRIOR * p)).alias("more_score"),
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more_known"),
    )
    whole = scored.drop("rare")
    if len(parts) > 1:
        whole = whole.groupBy("rid", "doc_id").agg(*[F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base", "score")])
    joined = whole.join(looked_up, "rid", "left")
    more = lambda name, kind: F.col(name) + F.coalesce(f"more_{name}" if kind is None else kind, F.lit(0))
    return joined.select(
        "doc_id", "n_tokens", more("n_known", "more_known").cast("long").alias("n_known"),
        F.lit(words.tokens).cast("long").alias("train_tokens"), more("base", None).cast("double").alias("base_score"),
        more("score", None).cast("double").alias("score"),
    )


FOLDS, HELD_OUT = 5, 1


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, docs.where(fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    return scored.withColumn("held_out", held_out(F.col("doc_id"), FOLDS, HELD_OUT))
