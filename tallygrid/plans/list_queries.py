"""Registered list and text queries, each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.functions import numbers, words
from tallygrid.operators.lists import flat_sum, update_salaries
from tallygrid.plans.tables import table
from tallygrid.sources.generators import pares, pares_list

EXACT = "decimal(20,0)"


def text_words() -> Column:
    return F.split("text", " ")


def joined(arr: Column, name: str) -> Column:
    return F.array_join(arr.cast("array<string>"), ",").alias(name)


def add_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", numbers.add("l_quantity", "l_tax").alias("total")
    )


def even_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, last = table(spark, sf_dir, "orders").agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    return pares(spark, first, last)


def even_range_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    evens = pares_list(F.col("p_size"), F.col("p_partkey") % 60)
    return table(spark, sf_dir, "part").select("p_partkey", F.size(evens).alias("n"), joined(evens, "evens"))


def _lineitem_where(spark: SparkSession, sf_dir: str, wanted: Column) -> DataFrame:
    return table(spark, sf_dir, "lineitem").filter(wanted).select("l_orderkey", "l_linenumber", "l_partkey")


def select_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lineitem_where(spark, sf_dir, numbers.is_even("l_partkey"))


def select_mult_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lineitem_where(spark, sf_dir, numbers.is_multiple("l_partkey", 3))


def select_mult_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lineitem_where(spark, sf_dir, numbers.is_multiple("l_partkey", 5))


def bigger_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").filter(numbers.is_bigger("o_totalprice", 250000))
    return orders.select("o_orderkey", "o_totalprice")


def sum_even_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        numbers.sum_even("l_orderkey", EXACT).cast("string").alias("evens"),
        numbers.total_mult_of_3("l_orderkey", EXACT).cast("string").alias("multiples_of_3"),
    )


def nullable_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Labels are added up by document first, so a document with very many labels is
    # one row in the join.
    quality = flat_sum(table(spark, sf_dir, "labels"), "quality", by=["doc_id"])
    documents = table(spark, sf_dir, "documents").select("doc_id", "source")
    return flat_sum(documents.join(quality, "doc_id", "left"), "total", by=["source"])


def _word_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number lists of the size of the data: the word lengths of each document."""
    return table(spark, sf_dir, "documents").select("doc_id", words.make_lengths(text_words()).alias("lengths"))


def list_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = F.col("lengths")
    return _word_lengths(spark, sf_dir).select(
        "doc_id",
        numbers.list_sum(lengths, numbers.is_even).alias("evens"),
        numbers.list_sum(lengths, lambda x: numbers.is_multiple(x, 3)).alias("multiples_of_3"),
        numbers.list_sum(F.transform(lengths, lambda x: F.nullif(x, F.lit(4)))).alias("present"),
    )


def number_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = F.col("lengths")
    return _word_lengths(spark, sf_dir).select(
        "doc_id",
        joined(numbers.select_even(lengths), "evens"),
        joined(numbers.sum_mult_of_3(lengths), "multiples_of_3"),
        joined(numbers.select_mult_5(lengths), "multiples_of_5"),
        joined(F.filter(lengths, lambda x: numbers.is_bigger(x, 9, floating=False)), "bigger"),
    )


def salary_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    revised = update_salaries(table(spark, sf_dir, "customer"), "c_acctbal")
    return revised.select("c_custkey", F.round("revised", 4).alias("revised"))


def salary_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pay = F.transform("embedding", lambda x: F.abs(x.cast("double")) * 20000)
    revised = numbers.update_salaries(pay)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(revised).alias("pos", "x")).select(
        "vec_id", "pos", F.round("x", 4).alias("revised")
    )


def text_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"))


def word_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _word_lengths(spark, sf_dir).select("doc_id", joined(F.col("lengths"), "lengths"))


def characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = words.characters("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(found).alias("n"), F.array_join(found, "|").alias("chars")
    )


def vowel_infix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        words.to_p_sentence("p_name").alias("p_sentence"),
        words.to_consonant("p_name", "l").alias("l_sentence"),
        words.to_consonant("p_name", F.col("p_brand")).alias("brand_sentence"),
        words.dinofauriza("p_name").alias("f_sentence"),
    )


def vowel_infix_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", words.dinofauriza("text").alias("f_text"))


def word_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text_words().alias("words")).select(
        "doc_id",
        joined(words.select_long_words(8, "words"), "long_words"),
        joined(words.select_starts_letter("a", "words"), "letter_words"),
        joined(words.select_contains("en", "words"), "containing"),
        joined(words.select_starts("re", "words"), "prefixed"),
    )


def long_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text_words()).alias("pos", "word"))
    return tokens.filter(words.is_long_word("word", 12))


def _parts_where(spark: SparkSession, sf_dir: str, wanted: Column) -> DataFrame:
    return table(spark, sf_dir, "part").filter(wanted).select("p_partkey", "p_name")


def starts_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts_where(spark, sf_dir, words.starts_with_letter("p_name", "s"))


def contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts_where(spark, sf_dir, words.contains_text("p_name", "ing"))


def starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").filter(words.starts_with("c_mktsegment", "MA"))
    return customers.select("c_custkey", "c_mktsegment")


QUERIES = {
    "add_columns": add_columns,
    "even_range": even_range,
    "even_range_lists": even_range_lists,
    "select_even": select_even,
    "select_mult_3": select_mult_3,
    "select_mult_5": select_mult_5,
    "bigger_orders": bigger_orders,
    "sum_even_by_flag": sum_even_by_flag,
    "nullable_sum": nullable_sum,
    "list_sums": list_sums,
    "number_lists": number_lists,
    "salary_revision": salary_revision,
    "salary_lists": salary_lists,
    "text_lengths": text_lengths,
    "word_lengths": word_lengths,
    "characters": characters,
    "vowel_infix": vowel_infix,
    "vowel_infix_documents": vowel_infix_documents,
    "word_lists": word_lists,
    "long_words": long_words,
    "starts_letter": starts_letter,
    "contains": contains,
    "starts": starts,
}


def _multiples_sql(k: int) -> str:
    return f"SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey % {k} = 0"


def _revised_sql(x: str) -> str:
    return (
        f"round(CASE WHEN {x} < 900 THEN {x} * 1.30::DOUBLE WHEN {x} < 1500 THEN {x} * 1.12::DOUBLE"
        f" WHEN {x} < 6000 THEN {x} ELSE {x} * 2 END, 4) + 0"
    )


def _listed_sql(name: str, condition: str, source: str) -> str:
    return f"array_to_string(list_filter({source}, lambda x: {condition}), ',') AS {name}"


_WORDS = "string_split(text, ' ')"
_LENGTHS = f"list_transform({_WORDS}, lambda w: length(w))"


def _infix_sql(infix: str) -> str:
    return f"regexp_replace(p_name, '([aeiou])', '\\1{infix}\\1', 'g')"


ORACLES = {
    "add_columns": "SELECT l_orderkey, l_linenumber, l_quantity + l_tax AS total FROM lineitem",
    "even_range": """
        SELECT x FROM (SELECT unnest(range(min(o_orderkey), max(o_orderkey) + 1)) AS x FROM orders)
        WHERE x % 2 = 0""",
    "even_range_lists": """
        SELECT p_partkey, len(l)::INTEGER AS n, array_to_string(l, ',') AS evens
        FROM (SELECT p_partkey, list_filter(range(p_size, p_partkey % 60 + 1), lambda x: x % 2 = 0) AS l
              FROM part)""",
    "select_even": _multiples_sql(2),
    "select_mult_3": _multiples_sql(3),
    "select_mult_5": _multiples_sql(5),
    "bigger_orders": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000",
    "sum_even_by_flag": """
        SELECT l_returnflag,
               coalesce(sum(l_orderkey) FILTER (WHERE l_orderkey % 2 = 0), 0)::VARCHAR AS evens,
               coalesce(sum(l_orderkey) FILTER (WHERE l_orderkey % 3 = 0), 0)::VARCHAR AS multiples_of_3
        FROM lineitem GROUP BY 1""",
    "nullable_sum": """
        SELECT source, CAST(coalesce(sum(quality), 0) AS BIGINT) AS total
        FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""",
    "list_sums": f"""
        SELECT doc_id,
               CAST(coalesce(list_sum(list_filter(l, lambda x: x % 2 = 0)), 0) AS BIGINT) AS evens,
               CAST(coalesce(list_sum(list_filter(l, lambda x: x % 3 = 0)), 0) AS BIGINT) AS multiples_of_3,
               CAST(coalesce(list_sum(list_filter(l, lambda x: x <> 4)), 0) AS BIGINT) AS present
        FROM (SELECT doc_id, {_LENGTHS} AS l FROM documents)""",
    "number_lists": f"""
        SELECT doc_id, {_listed_sql("evens", "x % 2 = 0", _LENGTHS)},
               {_listed_sql("multiples_of_3", "x % 3 = 0", _LENGTHS)},
               {_listed_sql("multiples_of_5", "x % 5 = 0", _LENGTHS)},
               {_listed_sql("bigger", "x > 9", _LENGTHS)}
        FROM documents""",
    "salary_revision": f"""
        SELECT c_custkey, {_revised_sql("c_acctbal")} AS revised FROM customer WHERE c_acctbal <> 6000""",
    "salary_lists": f"""
        SELECT vec_id, CAST(pos - 1 AS INTEGER) AS pos, {_revised_sql("x")} AS revised
        FROM (SELECT vec_id, generate_subscripts(pay, 1) AS pos, unnest(pay) AS x
              FROM (SELECT vec_id, list_transform(embedding, lambda e: abs(e::DOUBLE) * 20000) AS pay
                    FROM embeddings))""",
    "text_lengths": "SELECT doc_id, length(text)::INTEGER AS n FROM documents",
    "word_lengths": f"SELECT doc_id, array_to_string({_LENGTHS}, ',') AS lengths FROM documents",
    "characters": """
        SELECT doc_id, length(text)::INTEGER AS n, array_to_string(string_split(text, ''), '|') AS chars
        FROM documents""",
    "vowel_infix": f"""
        SELECT p_partkey, {_infix_sql("p")} AS p_sentence, {_infix_sql("l")} AS l_sentence,
               replace(regexp_replace(p_name, '([aeiou])', '\\1#\\1', 'g'), '#', p_brand) AS brand_sentence,
               {_infix_sql("f")} AS f_sentence
        FROM part""",
    "vowel_infix_documents": """
        SELECT doc_id, regexp_replace(text, '([aeiou])', '\\1f\\1', 'g') AS f_text FROM documents""",
    "word_lists": f"""
        SELECT doc_id, {_listed_sql("long_words", "length(x) >= 8", _WORDS)},
               {_listed_sql("letter_words", "starts_with(x, 'a')", _WORDS)},
               {_listed_sql("containing", "contains(x, 'en')", _WORDS)},
               {_listed_sql("prefixed", "starts_with(x, 're')", _WORDS)}
        FROM documents""",
    "long_words": f"""
        SELECT * FROM (SELECT doc_id, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS pos, unnest(w) AS word
                       FROM (SELECT doc_id, {_WORDS} AS w FROM documents))
        WHERE length(word) >= 12""",
    "starts_letter": "SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 's')",
    "contains": "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ing')",
    "starts": "SELECT c_custkey, c_mktsegment FROM customer WHERE starts_with(c_mktsegment, 'MA')",
}
