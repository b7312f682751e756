"""Documents with everything that can be odd about a row."""

import random

from pyspark.sql import functions as F

# Extra columns under names that the operators use inside or for their results.
CLASHING = [
    "score", "predicted", "n", "c", "h1", "h2", "rank", "words", "lang_pred", "n_tokens", "ids", "minima",
    "start", "size", "weight", "row", "next", "fingerprint", "component_id", "kept", "a", "b", "rid",
]


def words(seed: int, count: int, vocabulary: int = 400) -> str:
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(count))


BASE = words(1, 120)
LONG = words(2, 30_000, 5000)
ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two"), (6, "ONE Two"), (None, "no id here at all"),
    (None, None), (8, BASE), (9, BASE), (9, BASE), (10, BASE + " tail"), (11, LONG), (12, "Ünïcödé ßtraße 日本 😀 x"),
    (13, "!!! ... ???"), (14, "line\n" * 50), (15, "İΣ a\u0085b\x1cc\x00d"), (16, "x" * 3000),
]


def documents(spark, rows, extra=True):
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in CLASHING}) if extra else df


def by_id(df, *columns):
    return sorted(((r["doc_id"], *[r[c] for c in columns]) for r in df.collect()), key=str)


