"""An index of the texts that patterns require, so that a label is tried on few of many patterns."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.functions.labels import pattern_text

GRAM = 3
# The characters that a pattern without regard to case takes for an ASCII letter.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZİıſK", "abcdefghijklmnopqrstuvwxyziisk"
CLASSES = frozenset("dDwWsSbBhHvVAzZR")  # escapes that stand for a class of characters or a place
FOLD = str.maketrans(UPPER, LOWER)


def required_texts(pattern: str) -> list[list[str]] | None:
    """For each alternative of a pattern the texts that every match holds, in ASCII and small letters.

    What is repeated, optional, grouped or a class of characters requires nothing. None stands for a pattern
    with constructs that change how the rest is read.
    """
    ways: list[list[str]] = [[]]
    run, at = "", 0

    def close() -> None:
        nonlocal run
        if run:
            ways[-1].append(run)
        run = ""

    while at < len(pattern):
        c = pattern[at]
        at += 1
        if c == "\\":
            if at == len(pattern):
                return None
            c = pattern[at]
            at += 1
            if c.isalnum():
                if c not in CLASSES:
                    return None
                close()
                continue
        elif c == "|":
            close()
            ways.append([])
            continue
        elif c == "(":
            close()
            at = _after_group(pattern, at)
            if at < 0:
                return None
            continue
        elif c == "[":
            close()
            at = _after_class(pattern, at)
            if at < 0:
                return None
            continue
        elif c in "*?{":
            run = run[:-1]
            close()
            if c == "{":
                at = pattern.find("}", at) + 1
                if not at:
                    return None
            continue
        elif c in ".^$+)":
            if c == ")":
                return None
            close()
            continue
        folded = c.translate(FOLD)
        if folded.isascii():
            run += folded
        else:
            close()
    close()
    return ways


def _after_class(pattern: str, at: int) -> int:
    """Place after a class of characters that begins before ``at``; -1 if it is not a plain one."""
    start = at
    while at < len(pattern):
        c = pattern[at]
        at += 2 if c == "\\" else 1
        if c in "[&":
            return -1
        if c == "]":
            return -1 if pattern[start : at - 1] in ("", "^") else at
    return -1


def _after_group(pattern: str, at: int) -> int:
    """Place after a group that begins before ``at``; -1 if it is not a plain one."""
    if pattern[at : at + 1] == "?":
        return -1
    while at < len(pattern):
        c = pattern[at]
        at += 1
        if c == "\\":
            if pattern[at : at + 1].isalnum() and pattern[at] not in CLASSES:
                return -1
            at += 1
        elif c in "([":
            at = _after_group(pattern, at) if c == "(" else _after_class(pattern, at)
            if at < 0:
                return -1
        elif c == ")":
            return at
    return -1


def grams(label: Column | str) -> Column:
    """The different runs of ``GRAM`` characters of a label, letters folded."""
    letters = F.split(F.translate(F.col(label) if isinstance(label, str) else label, UPPER, LOWER), "")
    places = F.when(F.size(letters) >= GRAM, F.sequence(F.lit(0), F.size(letters) - GRAM))
    return F.array_distinct(
        F.transform(places, lambda k: F.concat(*[F.coalesce(F.get(letters, k + j), F.lit("")) for j in range(GRAM)]))
    )


def _rows(df: DataFrame, rows: Sequence[dict], schema: str) -> DataFrame:
    """Rows of the program as a table of known, small size."""
    text = F.lit(json.dumps(rows))
    return df.sparkSession.range(1).select(F.inline(F.from_json(text, f"array<struct<{schema}>>")))


def matching_patterns(labels: DataFrame, patterns: Sequence[str], anchored: bool = False) -> tuple[DataFrame, list[int]]:
    """Pairs ``(label, n)`` of the different ``label`` s and the numbers of the patterns that they match, and the numbers of
    the patterns left to be tried on every label because they require no text of ``GRAM`` characters.

    Of what a pattern requires, the run of characters that the fewest labels hold stands for it; the
    number of labels of each run, as many as the patterns have, comes to the driver. A label meets the patterns of
    its own runs, and the pattern decides. Candidates are ordered by pattern, which is then compiled once in a row.
    """
    required = [required_texts(p) for p in patterns]
    of_way = {
        (n, k): sorted({t[j : j + GRAM] for t in texts for j in range(len(t) - GRAM + 1)})
        for n, ways in enumerate(required) if ways is not None for k, texts in enumerate(ways)
    }
    rest = [n for n, ways in enumerate(required) if ways is None or any(not of_way[n, k] for k in range(len(ways)))]
    left = set(rest)
    of_way = {key: runs for key, runs in of_way.items() if key[0] not in left}
    wanted = sorted({g for runs in of_way.values() for g in runs})
    held = labels.select("label", F.explode(grams("label")).alias("gram"))
    known = held.join(_rows(labels, [{"gram": g} for g in wanted], "gram: string"), "gram")
    counts = {r.gram: r["count"] for r in known.groupBy("gram").count().collect()}
    chosen = {(min(runs, key=lambda g: (counts.get(g, 0), g)), n) for (n, _), runs in of_way.items()}
    keys = [{"gram": g, "n": n, "pattern": pattern_text(patterns[n], anchored)} for g, n in sorted(chosen)]
    tried = held.join(_rows(labels, keys, "gram: string, n: int, pattern: string"), "gram").sortWithinPartitions("n")
    found = tried.where(F.regexp_instr("label", F.col("pattern")) > 0).select("label", "n").distinct()
    return found, rest
