"""Text column functions: predicates, lengths, characters and vowel infixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallygrid.functions.columns import as_column
from tallygrid.functions.lists import keep

# Fixed value: the letters that get an infix; capitals and accented vowels do not.
VOWELS = "aeiou"


def is_long_word(c: Column | str, num: int) -> Column:
    return F.length(as_column(c)) >= num


def starts_with_letter(c: Column | str, letter: str) -> Column:
    """First character equals ``letter``; a longer ``letter`` never matches, nor
    does the empty string."""
    c = as_column(c)
    if len(letter) != 1:
        return c.isNotNull() & F.lit(False)
    return c.startswith(letter)


def contains_text(c: Column | str, sub: str) -> Column:
    return as_column(c).contains(sub)


def starts_with(c: Column | str, prefix: str) -> Column:
    return as_column(c).startswith(prefix)


def select_long_words(num: int, arr: Column | str) -> Column:
    return keep(arr, lambda s: is_long_word(s, num))


def select_starts_letter(letter: str, arr: Column | str) -> Column:
    return keep(arr, lambda s: starts_with_letter(s, letter))


def select_contains(sub: str, arr: Column | str) -> Column:
    return keep(arr, lambda s: contains_text(s, sub))


def select_starts(prefix: str, arr: Column | str) -> Column:
    return keep(arr, lambda s: starts_with(s, prefix))


def make_lengths(arr: Column | str) -> Column:
    """Length in characters of each string of a list."""
    return F.transform(as_column(arr), F.length)


def characters(c: Column | str) -> Column:
    """The characters of a string; the empty string gives an empty list."""
    c = as_column(c)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ""))


def to_consonant(text: Column | str, consonant: Column | str) -> Column:
    """Each vowel ``v`` becomes ``v + consonant + v``.

    ``consonant`` is any literal text, or a column with one per row.
    """
    if isinstance(consonant, str):
        escaped = consonant.replace("\\", "\\\\").replace("$", "\\$")
        infix = F.lit(f"$1{escaped}$1")
    else:
        escaped = F.replace(consonant, F.lit("\\"), F.lit("\\\\"))
        escaped = F.replace(escaped, F.lit("$"), F.lit("\\$"))
        infix = F.concat(F.lit("$1"), escaped, F.lit("$1"))
    return F.regexp_replace(as_column(text), F.lit(f"([{VOWELS}])"), infix)


def to_p_sentence(text: Column | str, consonant: Column | str = "p") -> Column:
    return to_consonant(text, consonant)


def dinofauriza(text: Column | str) -> Column:
    return to_consonant(text, "f")
