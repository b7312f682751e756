import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallygrid.functions import words as W
from tallygrid.functions.labels import label_matches
from tallygrid.functions.lists import list_rows


def words(*values):
    return F.lit(list(values)) if values else F.array().cast("array<string>")


def test_word_selectors(one):
    animals = words("alomejor", "madre", "aleatorio", "normal", "a")
    places = words("Calle", "Metro", "Sol", "Colegio", "Pan")
    assert one(W.select_long_words(5, places)) == ["Calle", "Metro", "Colegio"]
    letters = words("alomejor", "puede", "quizás", "alejandro", "")
    assert one(W.select_starts_letter("a", letters)) == ["alomejor", "alejandro"]
    assert one(W.select_starts_letter("al", letters)) == []
    assert one(W.select_starts_letter("", letters)) == []
    assert one(W.select_contains("al", animals)) == ["alomejor", "aleatorio", "normal"]
    assert one(W.select_contains("", animals)) == ["alomejor", "madre", "aleatorio", "normal", "a"]
    assert one(W.select_contains("%", words("100%", "100"))) == ["100%"]
    assert one(W.select_starts("al", animals)) == ["alomejor", "aleatorio"]
    assert one(W.select_starts("", animals)) == ["alomejor", "madre", "aleatorio", "normal", "a"]
    assert one(W.select_long_words(1, words())) == []


def test_lengths_and_characters(one):
    assert one(W.make_lengths(words("hey", "hola", "mundo"))) == [3, 4, 5]
    assert one(W.make_lengths(words())) == []
    assert one(W.make_lengths(words("a😀é"))) == [3]
    assert one(W.characters(F.lit("hola"))) == ["h", "o", "l", "a"]
    assert one(W.characters(F.lit(""))) == []
    assert one(W.characters(F.lit("a😀é"))) == ["a", "😀", "é"]


@pytest.mark.parametrize(
    "text, infix, expected",
    [
        ("Raro", "p", "Raparopo"), ("Basico", "p", "Bapasipicopo"), ("Alamo", "p", "Alapamopo"),
        ("Raro", "l", "Ralarolo"), ("Raro", "f", "Rafarofo"), ("quizás", "l", "quluilizás"),
        ("a", "$1", "a$1a"), ("a", "\\", "a\\a"), ("ab", "xy", "axyab"), ("", "p", ""), ("a", "", "aa"),
    ],
)
def test_vowel_infix(one, spark, text, infix, expected):
    assert one(W.to_consonant(F.lit(text), infix)) == expected
    assert one(W.to_p_sentence(F.lit(text), infix)) == expected
    from_column = spark.createDataFrame([(text, infix)], "t string, c string")
    assert from_column.select(W.to_consonant("t", F.col("c"))).first()[0] == expected


def test_infix_names(one):
    assert one(W.to_p_sentence(F.lit("Raro"))) == "Raparopo"
    assert one(W.dinofauriza(F.lit("Raro"))) == "Rafarofo"


@settings(max_examples=5, deadline=None)
@given(
    st.lists(
        st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\0"), max_size=30),
        min_size=1,
        max_size=40,
    ),
    st.text("plf$\\", max_size=3),
)
def test_infix_length(spark, texts, infix):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", W.to_consonant("t", infix).alias("r"), F.length("t").alias("n")).collect()
    for r in rows:
        vowels = sum(c in "aeiou" for c in r.t)
        assert len(r.r) == len(r.t) + vowels * (1 + len(infix))
        assert r.n == len(r.t)


@pytest.mark.parametrize(
    "label, pattern, anchored, expected",
    [
        ("8. AMORTIZACIÓN DE INMOVILIZADO", "8. Amortización de inmovilizado", False, True),
        ("11. Importe neto", "1. Importe neto", False, True),
        ("11. Importe neto", "1. Importe neto", True, False),
        ("2640 X", "640|642", False, True),
        ("2640 X", "640|642", True, False),
        ("   6420 X", "640|642", True, True),
        ("16230", "6230", False, True),
        (" d) resultado del ejercicio", r"D\) RESULTADO DEL", False, True),
        ("cuenta ٦٢", r"\d\d", False, True),
        ("ÑANDÚ", r"\bñandú\b", False, True),
        (None, "6", False, False),
    ],
)
def test_label_matches(one, label, pattern, anchored, expected):
    assert one(label_matches(F.lit(label).cast("string"), pattern, anchored)) is expected


def test_list_rows_keep_positions(spark):
    df = spark.createDataFrame([(1, ["b", "a"]), (2, [])], "k int, xs array<string>")
    assert [tuple(r) for r in list_rows(df, "xs", ["k"]).collect()] == [(1, 0, "b"), (1, 1, "a")]
