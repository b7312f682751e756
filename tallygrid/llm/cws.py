"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

A document is a set of words weighted by how often they occur. For each of ``SAMPLES`` hash
functions a word S of weight w draws r and c from Gamma(2, 1) and b from Uniform(0, 1), all from a
hash of the word. With t = floor(ln w / r + b) and ln a = ln c - r (t - b + 1) the word of least a is
sampled, together with its t. Two documents sample the same pair with a probability equal to the
generalised Jaccard similarity of their weights, sum of minima over sum of maxima.

The draws are cut from the bits of one hash. The order of ln a and the identity of the pair share
one 64-bit number, so that all samples of a document are plain minima, added up by partial aggregates.

The least a of a document of W words is about 1 / W, and over ``REACH`` / W once in e^REACH samples.
A lower bound of a, made without logarithms, rules out most words for most samples. Where no word
lies below REACH / W, all words of the document are drawn in full.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallygrid.llm.common import WHITE, table
from tallygrid.session import stored

SAMPLES = 64  # a likeness p has a standard error of sqrt(p (1 - p) / SAMPLES)
BITS = 12  # of each of the five uniform numbers of a draw
LANE = 16  # bits of a sample in the fingerprint; four lanes make a number
REACH = 20.0  # words that cannot come below this share of the whole weight are not drawn at first
LANES = 64 // LANE
PACKED = [f"f{k}" for k in range(SAMPLES // LANES)]
SHA = [f"sha{k}" for k in range(4)]  # a SHA-256 digest as four numbers
KEY = ["id", "none", "h1", "h2"]  # identity of a document without nulls: its id and hashes of its text


def _draw(j: int) -> Column:
    """The bits from which a word draws the j-th sample of lane group ``g``."""
    return F.xxhash64("word", F.col("g") * LANES + j)


def _uniform(j: int, i: int) -> Column:
    """The i-th uniform number of a draw, times the number of steps."""
    return F.shiftrightunsigned(_draw(j), 64 - BITS * (i + 1)).bitwiseAND((1 << BITS) - 1) + F.lit(0.5)


def _sample(j: int) -> Column:
    """One number for a sample: ln a in the high bits, the sampled pair in the low ones."""
    steps = float(1 << BITS)
    both = 2 * math.log(steps)
    r, c = both - F.log(_uniform(j, 0) * _uniform(j, 1)), both - F.log(_uniform(j, 2) * _uniform(j, 3))
    b = _uniform(j, 4) / steps
    t = F.when(F.col("once") == 1, F.lit(0).cast("long")).otherwise(F.floor(F.col("lw") / r + b))  # 0 for ln w = 0
    log_a = F.log(c) - r * (t - b + 1)
    pair = F.hash(_draw(j), t).bitwiseAND((1 << LANE) - 1).cast("long")
    return _ordered(log_a).bitwiseOR(pair)


def _ordered(log_a: Column) -> Column:
    return F.shiftleft((log_a * float(1 << 32)).cast("long"), LANE)


def _may_win(j: int) -> Column:
    """Whether a may be REACH / W or less; ``share`` is REACH w / W.

    With p = exp(-r) and q = exp(-c), products of two uniform numbers, a = c / w * p^x, where x is 1 - b for a word
    that occurs once and 1 at most for others. c is at least 2 (1 - q) / (1 + q), p^x at least p / (p + x (1 - p)).
    """
    steps = float(1 << BITS)
    p, q = _uniform(j, 0) * _uniform(j, 1) / steps**2, _uniform(j, 2) * _uniform(j, 3) / steps**2
    x = 1.0 - F.col("once") * (_uniform(j, 4) / steps)
    return (1.0 - q) * p * 2.0 <= F.col("share") * (q + 1.0) * (p + x * (1.0 - p)) * (1 + 1e-9)


def _weighted_words(texts: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """``word`` (its hash) and log weight ``lw`` of the different words of each text, ``once`` (1 for a word that
    occurs once, or 0), ``share`` (``reach`` times its part of the W words of the text) and ``below`` (the number of reach / W).

    Words are counted inside the row: equal hashes are neighbours once sorted.
    """
    hashes = F.transform(F.filter(F.split("text", WHITE), lambda w: w != ""), lambda w: F.xxhash64(w))
    hashed = texts.select(*keys, F.sort_array(hashes).alias("words"))
    starts = F.filter(
        F.when(F.size("words") > 0, F.sequence(F.lit(0), F.size("words") - 1)),
        lambda k: (k == 0) | (F.get("words", k) != F.get("words", k - 1)),
    )
    run = F.transform("starts", lambda at, k: F.struct(
        F.get("words", at).alias("word"), (F.coalesce(F.get("starts", k + 1), F.size("words")) - at).alias("n")))
    total = F.when(F.size("words") > 0, F.size("words").cast("double"))
    exploded = hashed.withColumn("starts", starts).select(*keys, total.alias("total"), F.explode_outer(run).alias("x"))
    n = F.col("x.n").cast("double")
    return exploded.select(
        *keys, "x.word", F.log(n).alias("lw"), (n == 1).cast("double").alias("once"),
        (n * reach / F.col("total")).alias("share"), _ordered(F.log(reach / F.col("total"))).alias("below"),
    )


def _packed(texts: DataFrame, keys: list[str], reach: float | None, carried: Sequence[str] = ()) -> DataFrame:
    """The samples of each text, and whether all are ``sure``: below what a word that was ruled out may have.
    ``carried`` are numbers that texts of equal keys share; as results, not keys, they are not hashed for each word.

    Each word is met once for every number of the fingerprint. A single row for all samples would need code
    longer than what the JVM compiles.
    """
    words = _weighted_words(texts, [*keys, *carried], reach or REACH).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(len(PACKED) - 1))))
    least = [F.min(F.when(_may_win(j), _sample(j)) if reach else _sample(j)).alias(f"s{j}") for j in range(LANES)]
    same = [F.max(c).alias(c) for c in carried]
    found = words.groupBy(*keys, "g").agg(*least, F.max("below").alias("below"), *same)
    lanes = [F.shiftleft(F.col(f"s{j}").bitwiseAND((1 << LANE) - 1), LANE * j) for j in range(LANES)]
    low = reduce(Column.__and__, [F.coalesce(F.col(f"s{j}") < F.col("below"), F.lit(False)) for j in range(LANES)])
    sure = F.col("below").isNull() | low if reach else F.lit(True)
    numbers = found.select(*keys, *carried, "g", reduce(Column.bitwiseOR, lanes).alias("f"), sure.alias("sure"))
    columns = [F.max(F.when(F.col("g") == k, F.col("f"))).alias(name) for k, name in enumerate(PACKED)]
    return numbers.groupBy(*keys).agg(*same, *columns, F.min("sure").alias("sure"))


def _samples(texts: DataFrame, keys: list[str], reach: float = REACH, carried: Sequence[str] = ()) -> DataFrame:
    """The samples of each text, four in a number; nulls for a text without words."""
    found = stored(_packed(texts, keys, reach, carried), "samples")
    unsure = found.where("NOT sure").select(*keys)
    if unsure.isEmpty():
        return found.drop("sure")
    again = _packed(texts.join(unsure, keys, "left_semi"), keys, None, carried)
    return stored(found.where("sure").unionByName(again).drop("sure"), "samples")


def _printed(names: list[str]) -> Column:
    """The fingerprint as text; empty without words."""
    return F.coalesce(F.lower(F.concat(*[F.lpad(F.hex(F.col(n)), 16, "0") for n in names])), F.lit(""))


def likeness(a: list[str], b: list[str]) -> Column:
    """Share of equal samples; 1 for two texts without words, 0 if only one has none."""
    equal = F.lit(0)
    for x, y in zip(a, b, strict=True):
        different = F.col(x).bitwiseXOR(F.col(y))
        for j in range(LANES):
            lane = F.shiftrightunsigned(different, LANE * j).bitwiseAND((1 << LANE) - 1)
            equal = equal + (lane == 0).cast("int")
    none_a, none_b = F.col(a[0]).isNull(), F.col(b[0]).isNull()
    return F.when(none_a & none_b, 1.0).when(none_a | none_b, 0.0).otherwise(equal / float(SAMPLES))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("id"), F.col("doc_id").isNull().alias("none"),
        F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(1)).alias("h2"), text.alias("text"),
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``fingerprint`` of every row of ``docs``; a text without words (null, empty
    or white space) has the empty fingerprint."""
    keyed = _keyed(docs)
    rows = keyed.drop("text").join(_samples(keyed, KEY), KEY)
    return rows.select(F.when(~F.col("none"), F.col("id")).alias("doc_id"), _printed(PACKED).alias("fingerprint"))


def neighbours(docs: DataFrame) -> DataFrame:
    """Every different document: ``row`` (its number), its key, ``copies``, ``n_chars``, ``next``
    (the number of the next one), and key (``p_*``) and length (``p_chars``) of the one before.

    Documents come by descending id, null last, equal ids by their hashes; the last is followed
    by the first. Only ids, hashes and lengths are sorted: by range over the cluster, then within
    each range, and the ends of the ranges, one row for each, are joined up.
    """
    rows = _keyed(docs).groupBy(*KEY).agg(F.count("*").alias("copies"), F.max(F.length("text")).alias("n_chars"))
    order = [F.col("none"), F.col("id").desc(), F.col("h1"), F.col("h2")]
    ranged = rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    ranged = stored(ranged.withColumn("row", F.monotonically_increasing_id()), "order")
    me = F.struct(*KEY, "n_chars", "row")
    inside = Window.partitionBy("range").orderBy(*order)
    linked = ranged.select("*", F.lead(me).over(inside).alias("next"), F.lag(me).over(inside).alias("previous"))
    at = F.struct("none", -F.col("id"), "h1", "h2")
    ends = ranged.groupBy("range").agg(F.min_by(me, at).alias("first"), F.max_by(me, at).alias("last"))
    around = Window.orderBy("range")  # a row for each range
    everything = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "range",
        F.coalesce(F.lead("first").over(around), F.first("first").over(everything)).alias("after"),
        F.coalesce(F.lag("last").over(around), F.last("last").over(everything)).alias("before"),
    )
    following, leading = F.coalesce("next", "after"), F.coalesce("previous", "before")
    return stored(linked.join(ends, "range").select(
        "row", *KEY, "copies", "n_chars", following["row"].alias("next"),
        leading["n_chars"].alias("p_chars"), *[leading[c].alias(f"p_{c}") for c in KEY],
    ), "neighbours")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """For every row: ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited`` and ``near_next``.

    The edited text has its last ``floor(n_chars / 2)`` characters replaced by the first as many,
    or all, of the next document (see ``neighbours``; a single document follows itself). A null is
    the empty text. Rows with equal id and text are one document and come out as often as they are
    there; a null id is an id like any other. Further columns are not read; an empty table gives none.
    """
    # Equal rows are joined into one before anything is shuffled. Both uses of the texts below
    # need the same columns of them, so that one shuffle serves both.
    one_each = _keyed(docs).groupBy(*KEY).agg(F.first("text").alias("text"))
    placed = one_each.join(neighbours(docs), KEY)
    given = placed.select(
        *[F.col(f"p_{c}").alias(c) for c in KEY], F.expr("substring(text, 1, int(p_chars div 2))").alias("begin")
    )
    kept = F.expr("substring(text, 1, int(n_chars - n_chars div 2))")
    both = placed.select(*KEY, "row", "copies", "n_chars", "next", "text").join(given, KEY)
    edited = both.withColumn("edited", F.concat(kept, "begin"))
    digest = F.sha2(F.col("edited").cast("binary"), 256)
    shas = [F.conv(F.substring(digest, 16 * k + 1, 16), 16, -10).cast("long").alias(name) for k, name in enumerate(SHA)]
    zeros = [F.lit(0).cast("long").alias(name) for name in SHA]
    numbers = ["row", "copies", "n_chars", "next"]
    versions = edited.select(*KEY, *numbers, F.explode(F.array(
        F.struct(F.lit(0).alias("version"), *zeros, F.col("text").alias("text")),
        F.struct(F.lit(1).alias("version"), *shas, F.col("edited").alias("text")),
    )).alias("x")).select("*", "x.*").drop("x")
    found = _samples(versions, [*KEY, "version"], carried=[*numbers, *SHA])
    own = found.where("version = 0").drop("version", *SHA, "h1", "h2")
    changed = found.where("version = 1").select("row", _printed(SHA).alias("sha"), *[F.col(f).alias(f"e_{f}") for f in PACKED])
    following = own.select(F.col("row").alias("next"), *[F.col(f).alias(f"n_{f}") for f in PACKED])
    joined = own.join(changed, "row").join(following, "next")
    names = {p: [f"{p}{f}" for f in PACKED] for p in ("", "e_", "n_")}
    result = joined.select(
        F.when(~F.col("none"), F.col("id")).alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"),
        F.col("sha").alias("edited_sha256"), _printed(names[""]).alias("fingerprint"),
        _printed(names["e_"]).alias("edited_fingerprint"), likeness(names[""], names["e_"]).alias("near_edited"),
        likeness(names[""], names["n_"]).alias("near_next"), "copies",
    )
    again = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return result.withColumn("_copy", again).drop("copies", "_copy")


def op10_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
