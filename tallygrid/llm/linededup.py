"""Removal of line runs that occurred before, found by a suffix array over line ids.

Every distinct line that is not blank is a letter; a document is a string of such letters. Prefix
doubling ranks all blocks of 1, 2, 4, ... lines: the rank of a block is the place of the pair of
ranks of its halves in sorted order. Blocks that occur once drop out at once, since no repeated
run can contain them. Equal ranks are the longest-common-prefix intervals of the suffix array, so
all places of one run have the same ranks for the two overlapping blocks that cover the run.

Only runs of at least ``min_words`` words count. A maximal repeated run is the union of the
smallest such runs inside it: the ones that cannot be shortened at their end and the ones that
cannot be shortened at their beginning. As every line has a word, they have ``min_words`` lines at
most, so doubling stops there, whatever the size of the corpus. A run that began at an earlier
place, in the order of document id and line, is deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallygrid.llm.common import WHITE, join_null_safe, table
from tallygrid.session import stored

MIN_WORDS = 50
DOC = ["_doc", "_hash"]  # identity of a document: its id and a hash of its text


def _identity() -> list[Column]:
    return [F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_hash")]


def _lines() -> Column:
    return F.split("text", "\n")


def _trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def line_letters(docs: DataFrame) -> DataFrame:
    """A row for each line that is not blank: document, place among these lines, number of the
    line, its words and the two hashes that stand for its text without outer white space."""
    numbered = F.filter(
        F.transform(_lines(), lambda line, k: F.struct(k.alias("no"), _trimmed(line).alias("line"))),
        lambda x: x.line != "",
    )
    return docs.where("text IS NOT NULL").select(*_identity(), F.posexplode(numbered).alias("pos", "x")).select(
        *DOC, "pos", F.col("x.no").alias("no"), F.size(F.split("x.line", WHITE)).alias("words"),
        F.xxhash64("x.line").alias("a"), F.xxhash64("x.line", F.lit(1)).alias("b"),
    )


def _place(pos: str = "pos") -> Column:
    """Places in corpus order; a null id comes first."""
    return F.struct(*DOC, F.col(pos).alias("pos"))


def _ranks(pairs: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Ranks of the pairs that occur at two places or more, ascending in the order of the pairs.

    Pairs are counted where they are and spread by range, so one that is everywhere is a
    single row here.
    """
    repeated = (
        pairs.groupBy(*keys)
        .agg(F.min(_place()).alias("first"), F.max(_place()).alias("last"))
        .where("NOT first <=> last")
    )
    ordered = repeated.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys)
    return stored(ordered.withColumn("rank", F.monotonically_increasing_id()), name)


def block_ranks(letters: DataFrame, min_words: int) -> DataFrame:
    """The repeated lines with the ranks ``r0``, ``r1``, ... of the blocks of 1, 2, ... lines
    that begin there; null where such a block occurs once or the document ends."""
    known = letters.join(_ranks(letters, ["a", "b"], "line-ranks"), ["a", "b"])
    known = known.withColumnRenamed("rank", "r0").drop("a", "b")
    # A document that came in several equal rows has its lines once from here on.
    known = known.repartition(*DOC).groupBy(*DOC, "pos").agg(*[F.first(c).alias(c) for c in ("no", "words", "r0")])
    known, in_order, k = stored(known, "blocks-0"), Window.partitionBy(*DOC).orderBy("pos"), 0
    while 2 << k <= min_words:
        step, half = 1 << k, f"r{k}"
        follows = F.lead("pos", step).over(in_order) == F.col("pos") + step
        pairs = known.withColumn("a", F.col(half)).withColumn(
            "b", F.when(follows, F.lead(half, step).over(in_order))
        )
        both = pairs.where("a IS NOT NULL AND b IS NOT NULL").select(*DOC, "pos", "a", "b")
        ranks = _ranks(both, ["a", "b"], f"ranks-{k + 1}")
        known = pairs.join(ranks, ["a", "b"], "left").withColumnRenamed("rank", f"r{k + 1}").drop("a", "b")
        known, k = stored(known, f"blocks-{k + 1}"), k + 1
    return known


def _smallest_runs(blocks: DataFrame, min_words: int) -> DataFrame:
    """First place and number of lines of all smallest runs within neighbouring repeated lines."""
    in_order = Window.partitionBy(*DOC).orderBy("pos")
    chain = [*DOC, "chain"]
    placed = blocks.select(
        *DOC, "pos", "words", (F.col("pos") - F.row_number().over(in_order)).alias("chain")
    ).withColumn("to", F.sum("words").over(Window.partitionBy(*chain).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.withColumn("from", F.col("to") - F.col("words"))
    ahead = Window.partitionBy(*chain).orderBy("from").rangeBetween(0, min_words - 1)
    behind = Window.partitionBy(*chain).orderBy("to").rangeBetween(1 - min_words, 0)
    runs = placed.select(
        *DOC, "pos",
        F.when(F.sum("words").over(ahead) >= min_words, F.count("*").over(ahead)).alias("down"),
        F.when(F.sum("words").over(behind) >= min_words, F.count("*").over(behind)).alias("up"),
    )
    both = F.array(
        F.struct(F.col("pos").alias("start"), F.col("down").alias("n")),
        F.struct((F.col("pos") - F.col("up") + 1).alias("start"), F.col("up").alias("n")),
    )
    return runs.select(*DOC, F.explode(both).alias("run")).select(
        *DOC, F.col("run.start").cast("int").alias("start"), F.col("run.n").cast("int").alias("n")
    ).where("n IS NOT NULL").distinct()


def deleted_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The lines to delete: document, number ``no`` of the line and its ``words``."""
    blocks = block_ranks(stored(line_letters(docs), "lines"), min_words)
    levels = [c for c in blocks.columns if c[0] == "r" and c[1:].isdigit()]
    runs = _smallest_runs(blocks, min_words).withColumn(
        "level", F.floor(F.log2("n") + 1e-9).cast("int")
    )
    ranks = blocks.select(*DOC, "pos", F.array(*levels).alias("ranks"))

    def with_rank(df: DataFrame, at: Column, name: str) -> DataFrame:
        found = join_null_safe(df.withColumn("pos", at), ranks, [*DOC, "pos"])
        return found.withColumn(name, F.get("ranks", F.col("level"))).drop("pos", "ranks")

    tail = F.col("start") + F.col("n") - F.pow(F.lit(2), F.col("level")).cast("int")
    named = with_rank(with_rank(runs, F.col("start"), "head"), tail, "tail").where(
        "head IS NOT NULL AND tail IS NOT NULL"
    )
    named = stored(named, "runs")
    # Stored, so that the join below deals its rows anew and can split a run that is everywhere.
    first = stored(named.groupBy("n", "head", "tail").agg(F.min(_place("start")).alias("first")), "first-runs")
    later = named.join(first, ["n", "head", "tail"]).where(~_place("start").eqNullSafe(F.col("first")))
    longest = later.groupBy(*DOC, F.col("start").alias("pos")).agg(F.max("n").alias("n"))
    reach = F.max(F.col("pos") + F.col("n")).over(
        Window.partitionBy(*DOC).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    )
    marked = join_null_safe(blocks.select(*DOC, "pos", "no", "words"), longest, [*DOC, "pos"], "left")
    return marked.withColumn("reach", reach).where(F.col("reach") > F.col("pos")).select(*DOC, "no", "words")


def _without(lines: Column, gone: Column) -> Column:
    """The text without the lines of the sorted numbers ``gone``; linear in the number of lines."""
    before = lambda k: F.when(k == 0, F.lit(-1)).otherwise(F.get(gone, k - 1))
    kept = F.transform(gone, lambda no, k: F.slice(lines, before(k) + 2, no - before(k) - 1))
    last = F.get(gone, F.size(gone) - 1)
    tail = F.slice(lines, last + 2, F.greatest(F.size(lines) - last - 1, F.lit(0)))
    return F.array_join(F.concat(F.flatten(kept), tail), "\n")


def remove_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with all its columns, the text without later copies of line runs, and the numbers
    ``_lines_gone`` and ``_words_gone`` of what was deleted (0 if nothing was).

    Blank lines take no part and stay. Lines are compared without outer white space. A null or
    empty text stays as it is. Rows with equal id and text are one document and get the same
    text. Documents come in the order of their ids, a null id first, equal ids by a hash of the
    text; within a document a run may also repeat itself, and then only its beginning stays. An
    empty table gives an empty table. Names of further columns are free, except those of the two numbers.
    """
    # Names of further columns may be those used below.
    prefix = "kept_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    hidden = {c: prefix + c for c in docs.columns if c.startswith("_")}
    if hidden:
        shown = {new: old for old, new in hidden.items()}
        return remove_repeated_lines(docs.withColumnsRenamed(hidden), min_words).withColumnsRenamed(shown)
    gone = deleted_lines(docs, min_words).groupBy(*DOC).agg(
        F.sort_array(F.collect_list("no")).alias("_gone"), F.sum("words").alias("_words")
    )
    joined = join_null_safe(docs.select("*", *_identity()), gone, DOC, "left")
    cut = joined.withColumn("_split", F.when(F.col("_gone").isNotNull(), _lines()))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(_without(F.col("_split"), F.col("_gone")))
    return cut.select(
        *[text.alias("text") if c == "text" else F.col(c) for c in docs.columns],
        F.coalesce(F.size("_gone"), F.lit(0)).alias("_lines_gone"),
        F.coalesce(F.col("_words").cast("long"), F.lit(0)).alias("_words_gone"),
    )


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without later copies of line runs; documents of which nothing is left go.

    A column ``n_chars`` is the length of the text and is counted anew, in the type it has.
    """
    cleaned = remove_repeated_lines(docs, min_words)
    left = (F.col("_lines_gone") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    kinds = dict(docs.dtypes)
    changed = F.when(F.col("_lines_gone") == 0, F.col("n_chars")).otherwise(F.length("text").cast(kinds["n_chars"])) if "n_chars" in kinds else None
    count = [changed.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return cleaned.where(left).select(*count)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated_lines(docs).select(
        "doc_id", "text", F.col("_lines_gone").alias("n_lines_gone"), F.col("_words_gone").alias("n_words_gone")
    )


ORACLE = r"""
    WITH split AS (
        SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
    numbered AS (
        SELECT doc_id, unnest(lines) AS raw, unnest(range(len(lines))) AS no FROM split),
    filled AS (
        SELECT doc_id, no, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line
        FROM numbered),
    counted AS (
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS pos,
               len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
        FROM filled WHERE line <> ''),
    summed AS (
        SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM counted),
    spans AS (
        SELECT doc_id, pos AS start, count(*) OVER w AS n, sum(words) OVER w AS total,
               string_agg(line, chr(10)) OVER w AS run
        FROM summed WINDOW w AS (PARTITION BY doc_id ORDER BY upto - words
                                 RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
        UNION
        SELECT doc_id, pos - count(*) OVER w + 1, count(*) OVER w, sum(words) OVER w,
               string_agg(line, chr(10)) OVER w
        FROM summed WINDOW w AS (PARTITION BY doc_id ORDER BY upto
                                 RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, start) AS copy
        FROM spans WHERE total >= 50),
    gone AS (
        SELECT DISTINCT s.doc_id, s.no, s.words FROM placed p JOIN summed s
        ON s.doc_id = p.doc_id AND s.pos >= p.start AND s.pos < p.start + p.n WHERE p.copy > 1),
    per_doc AS (
        SELECT doc_id, count(*) AS n_lines_gone, sum(words) AS n_words_gone FROM gone GROUP BY doc_id),
    kept AS (
        SELECT n.doc_id, string_agg(n.raw, chr(10) ORDER BY n.no) AS text
        FROM numbered n ANTI JOIN gone g ON g.doc_id = n.doc_id AND g.no = n.no GROUP BY n.doc_id)
    SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text,
           CAST(coalesce(p.n_lines_gone, 0) AS INTEGER) AS n_lines_gone,
           CAST(coalesce(p.n_words_gone, 0) AS BIGINT) AS n_words_gone
    FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN per_doc p USING (doc_id)"""
