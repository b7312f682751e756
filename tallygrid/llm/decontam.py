"""Removal of benchmark text from documents, with DataFrame functions only.

The normalised n-grams (windows) of the benchmark form a hash set, keyed by the word of each
window that is rarest in the benchmark, its anchor. Documents are scanned once: the places of
anchors are found inside the row, and only there a short stretch of words around the place is
compared with the windows of that anchor, first by hash and then word by word.

The set is broadcast when its measured size is below ``max_broadcast``; a larger one is joined by
a shuffle on the anchor, with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallygrid.llm.common import ascii_lower, table
from tallygrid.session import stored

WORDS = 10  # words of a window
# All ASCII characters but letters and digits separate words; capitals count as small letters.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _raw_words(text: str = "text") -> Column:
    """Words of the text as written; a null has none."""
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), BETWEEN), lambda w: w != "")


def _stretch(words: Column, start: Column, n: Column) -> Column:
    """``n`` words from the zero-based ``start`` on, in lower case and joined by blanks."""
    return ascii_lower(F.array_join(F.slice(words, start + 1, n), " "))


def windows(items: DataFrame, n: int = WORDS) -> DataFrame:
    """The different windows of all items: ``anchor``, ``before`` (words of the window before the
    anchor), ``size``, ``hash``, ``window`` and the array ``items`` of the ids that have it."""
    worded = items.select("item_id", _raw_words().alias("words")).where(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(n))
    cut = worded.select(
        "item_id", size.alias("size"),
        F.explode(F.transform(F.sequence(F.lit(0), F.size("words") - size), lambda k: _stretch(F.col("words"), k, size))).alias("window"),
    )
    different = cut.groupBy("window", "size").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    words = worded.select(F.explode("words").alias("word")).select(ascii_lower(F.col("word")).alias("word"))
    often = words.groupBy("word").agg(F.count("*").alias("often"))
    placed = different.select("window", "size", "items", F.posexplode(F.split("window", " ")).alias("before", "word"))
    rarity = F.struct("often", -F.length("word"), "word", "before")
    rarest = placed.join(often, "word").groupBy("window", "size").agg(
        F.first("items").alias("items"), F.min(rarity).alias("rarest")
    )
    return rarest.select(
        F.col("rarest.word").alias("anchor"), F.col("rarest.before").alias("before"), "size",
        F.xxhash64("window").alias("hash"), "window", "items",
    )


def hits(docs: DataFrame, items: DataFrame, n: int = WORDS, max_broadcast: int = 64 << 20) -> DataFrame:
    """A row for each place where a window occurs, and one for each document without any.

    Columns: ``h1`` and ``h2`` (hashes that stand for the text), ``n_words``, ``start``, ``size``
    and ``items``; the last three are null where nothing occurs.
    """
    known = stored(windows(items, n), "windows")
    size = known.agg(
        F.sum(F.length("window") + F.length("anchor") + 64), F.sum(F.size("items") * 16), F.count_distinct("anchor")
    ).first()
    small = (size[0] or 0) + (size[1] or 0) <= max_broadcast
    text = F.coalesce("text", F.lit(""))
    worded = docs.select(F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(1)).alias("h2"), _raw_words().alias("words"))
    places = F.sequence(F.lit(0), F.size("words") - 1)
    if small:
        anchors = [r.anchor for r in known.select("anchor").distinct().collect()]  # bounded like the set itself
        found = F.filter(places, lambda k: ascii_lower(F.get("words", k)).isin(anchors))
    else:
        found = places
    found = F.when(F.size("words") > 0, found)
    around = F.transform(
        found,
        lambda k: F.struct(
            k.alias("at"), F.least(k, F.lit(n - 1)).alias("left"),
            F.slice("words", F.greatest(k - (n - 1), F.lit(0)) + 1, F.least(k, F.lit(n - 1)) + n).alias("near"),
            ascii_lower(F.get("words", k)).alias("word"),
        ),
    )
    scanned = worded.select("h1", "h2", F.size("words").alias("n_words"), F.explode_outer(around).alias("x"))
    begin = F.col("x.left") - F.col("before")
    stretch = _stretch(F.col("x.near"), begin, F.col("size"))
    same = (F.col("x.word") == F.col("anchor")) & (begin >= 0) & (F.xxhash64(stretch) == F.col("hash")) & (stretch == F.col("window"))
    joined = scanned.join(F.broadcast(known) if small else known, same, "left")
    return joined.select(
        "h1", "h2", "n_words", (F.col("x.at") - F.col("before")).alias("start"), "size", "items"
    )


def contamination(docs: DataFrame, items: DataFrame, n: int = WORDS) -> DataFrame:
    """For each different text, named by ``h1`` and ``h2``: ``n_words``, ``n_hit``, ``n_items``,
    ``items_sha256`` and ``contaminated``.

    A null or empty text has no words and is not hit. Items that are null or have no words have no
    windows; an empty table of items hits nothing. Equal items count each by their id, a null id
    is left out. Ties and repeated rows do not matter, because results belong to texts.
    """
    key = ["h1", "h2"]
    # A place is reported by several windows and copies: each stretch counts once.
    found = hits(docs, items, n).groupBy(*key, "n_words", "start", "size").agg(F.first("items").alias("items"))
    order = Window.partitionBy(*key).orderBy("start", "size")
    upto = F.max(F.col("start") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.col("start") + F.col("size") - F.greatest(F.coalesce(upto, F.lit(0)), F.col("start")), F.lit(0))
    per_text = found.withColumn("fresh", fresh).groupBy(*key).agg(
        F.max("n_words").alias("n_words"), F.coalesce(F.sum("fresh"), F.lit(0)).alias("n_hit"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("ids"),
    )
    return per_text.select(
        *key, F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"),
        F.size("ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def _keyed(docs: DataFrame) -> list[Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(1)).alias("h2")]


def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = WORDS) -> DataFrame:
    """The rows of ``docs`` in which no window occurs, with all their columns."""
    clean = contamination(docs, items, n).where("NOT contaminated").select("h1", "h2")
    h1, h2 = _keyed(docs)
    return docs.join(clean, (h1 == clean["h1"]) & (h2 == clean["h2"]), "left_semi")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    return docs.select("doc_id", *_keyed(docs)).join(found, ["h1", "h2"]).drop("h1", "h2")


ORACLE = r"""
    WITH item_words AS (
        SELECT item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
        FROM benchmark WHERE text IS NOT NULL),
    item_windows AS (
        SELECT item_id, least(len(words), 10) AS size,
               unnest(list_transform(range(1, len(words) - least(len(words), 10) + 2),
                      lambda k: array_to_string(words[k : k + least(len(words), 10) - 1], ' '))) AS win
        FROM item_words WHERE len(words) > 0),
    doc_words AS (
        SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
        FROM documents),
    starts AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS k FROM doc_words),
    doc_windows AS (
        SELECT doc_id, k, z.size, array_to_string(words[k : k + z.size - 1], ' ') AS win
        FROM starts, (SELECT DISTINCT size FROM item_windows) z WHERE k + z.size - 1 <= len(words)),
    found AS (
        SELECT DISTINCT d.doc_id, d.k, d.size, i.item_id FROM doc_windows d JOIN item_windows i
        ON d.win = i.win AND d.size = i.size),
    hit AS (
        SELECT doc_id, count(DISTINCT w) AS n FROM (
            SELECT doc_id, unnest(range(k, k + size)) AS w FROM found) GROUP BY doc_id),
    ids AS (
        SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS joined FROM (
            SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id)
    SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit,
           CAST(coalesce(i.n, 0) AS BIGINT) AS n_items, sha256(coalesce(i.joined, '')) AS items_sha256,
           h.n IS NOT NULL AS contaminated
    FROM doc_words w LEFT JOIN hit h USING (doc_id) LEFT JOIN ids i USING (doc_id)"""
