"""Concept totals: amounts summed by label pattern for two years."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce
from itertools import batched
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.functions.labels import label_matches
from tallygrid.functions.numbers import AMOUNT_TYPE
from tallygrid.operators.literals import matching_patterns
from tallygrid.session import stored


class Concept(NamedTuple):
    key: str  # column prefix
    name: str  # name shown in summaries
    pattern: str


# The ten concepts of the closing summary and their label patterns.
CONCEPTS = (
    Concept("ventas", "Ventas", "1. Importe neto"),
    Concept("gastos", "Gastos", "7. Otros gastos"),
    Concept("profesionales", "Profesionales (6230)", "6230"),
    Concept("salarios", "Salarios", "640|642"),
    Concept("amortizaciones", "Amortizaciones", "8. Amortización de inmovilizado"),
    Concept("arrendamientos", "Arrendamientos", "621"),
    Concept("suministros", "Suministros", "628"),
    Concept("gastos_financieros", "Gastos financieros", "15. Gastos financieros"),
    Concept("impuesto", "Impuesto", "Impuesto sobre sociedades"),
    Concept("resultado", "Resultado", r"D\) RESULTADO DEL"),
)

# Two more items of a closing mail, and all twelve together.
EXTENDED = (
    *CONCEPTS[:1],
    Concept("aprovisionamientos", "Aprovisionamientos", "4. Aprovisionamientos"),
    *CONCEPTS[1:5],
    Concept("deterioros", "Deterioros", "11. Deterioro"),
    *CONCEPTS[5:],
)


def concepts_named(*keys: str) -> list[Concept]:
    """Some of the ten concepts; patterns that are not asked for are not tried."""
    return [c for c in CONCEPTS if c.key in keys]


# Patterns tried on the distinct labels in one projection.
PATTERNS_PER_PASS = 100


def year_amount(year: int) -> Column:
    """The amount of long lines that belong to ``year``."""
    return F.when(F.col("year") == year, F.col("amount"))


def concept_totals(
    lines: DataFrame,
    current: Column,
    previous: Column,
    by: Sequence[str] = ("client",),
    concepts: Sequence[Concept] = CONCEPTS,
    anchored: bool = False,
    also: Sequence[Column] = (),
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per client with ``<key>_cur`` and ``<key>_prev`` for every concept.

    ``current`` and ``previous`` are the two amounts of a line. A line may count
    for several concepts; a concept without lines is 0. All sums are made in one
    scan, first inside each task and then by client: what is shuffled is one row per
    task and client, also when one client holds much of the data. ``also`` are further
    aggregates over the columns ``keep``, made in the same pass.
    """
    hit = [f"_hit{n}" for n in range(len(concepts))]
    tagged = lines.select(
        "*", *[label_matches("label", c.pattern, anchored).alias(h) for c, h in zip(concepts, hit)]
    )
    # Most lines of a ledger hit nothing; their amounts need not be read from text.
    any_hit = reduce(Column.__or__, [F.col(h) for h in hit])
    flagged = tagged.select(
        *by, *keep, *hit, F.when(any_hit, current).alias("_cur"), F.when(any_hit, previous).alias("_prev")
    )

    def total(amount: str, h: str, name: str) -> Column:
        # A FILTER skips the sum of a line without a hit; sum(when(...)) would read and
        # write back the decimal of every concept for every line.
        found = F.expr(f"sum({amount}) FILTER (WHERE {h} AND {amount} IS NOT NULL)")
        return F.coalesce(found, F.lit(0)).alias(name)

    return flagged.groupBy(*by).agg(
        *[total("_cur", h, f"{c.key}_cur") for c, h in zip(concepts, hit)],
        *[total("_prev", h, f"{c.key}_prev") for c, h in zip(concepts, hit)],
        *also,
    )


def year_totals(
    lines: DataFrame,
    years: tuple[int, int],
    by: Sequence[str] = ("client",),
    concepts: Sequence[Concept] = CONCEPTS,
    anchored: bool = False,
    prune: bool = False,
) -> DataFrame:
    """:func:`concept_totals` of long lines. A client without lines in these years has zeros.

    With ``prune`` other years are filtered out first, so that a table partitioned by year
    reads two of its folders; a client that has lines in other years only is left out then.
    """
    current, previous = (year_amount(y) for y in years)
    return concept_totals(_of_years(lines, years, prune), current, previous, by, concepts, anchored)


def _of_years(lines: DataFrame, years: tuple[int, int], prune: bool) -> DataFrame:
    return lines.filter(F.col("year").isin(*years)) if prune else lines


def pattern_total(
    lines: DataFrame, pattern: str, years: tuple[int, int], by: Sequence[str] = ("client",)
) -> DataFrame:
    """Totals ``cur`` and ``prev`` of the long lines whose label matches one pattern."""
    totals = year_totals(lines, years, by, [Concept("c", "c", pattern)])
    return totals.withColumnsRenamed({"c_cur": "cur", "c_prev": "prev"})


def to_summary(
    totals: DataFrame,
    years: tuple[int, int],
    by: Sequence[str] = ("client",),
    concepts: Sequence[Concept] = CONCEPTS,
) -> DataFrame:
    """Long form of the totals: ``concept`` and one DOUBLE column per year."""
    cur, prev = (f"y{y}" for y in years)
    rows = [
        F.struct(
            F.lit(c.name).alias("concept"),
            F.col(f"{c.key}_cur").cast("double").alias(cur),
            F.col(f"{c.key}_prev").cast("double").alias(prev),
        )
        for c in concepts
    ]
    return totals.select(*by, F.inline(F.array(*rows)))


def concept_summary(
    lines: DataFrame,
    years: tuple[int, int],
    by: Sequence[str] = ("client",),
    concepts: Sequence[Concept] = CONCEPTS,
    anchored: bool = False,
    prune: bool = False,
) -> DataFrame:
    """Summary of long lines; every pattern is tried on every line, in one scan."""
    return to_summary(year_totals(lines, years, by, concepts, anchored, prune), years, by, concepts)


def summary_by_label(
    lines: DataFrame,
    years: tuple[int, int],
    by: Sequence[str] = ("client",),
    concepts: Sequence[Concept] = CONCEPTS,
    anchored: bool = False,
    prune: bool = False,
) -> DataFrame:
    """The result of :func:`concept_summary` for long lists of concepts.

    Patterns are tried on the distinct labels only, in jobs that run now: up to ``PATTERNS_PER_PASS``
    all on every label, of more on each label those whose required text it holds
    (:func:`matching_patterns`). The matches are
    written to a folder ``label-matches-*`` below ``spark.checkpoint.dir``, where they must stay
    until the result is read. The lines are then read once, added up by client and concept, and
    concepts without lines are filled in after the last shuffle.
    """
    lines = _of_years(lines, years, prune)
    labels = lines.select("label").distinct()

    def hits(batch: Sequence[tuple[int, Concept]]) -> Column:
        tried = [F.when(label_matches("label", c.pattern, anchored), F.lit(n)) for n, c in batch]
        return F.array_compact(F.array(*tried))

    everywhere, parts = list(enumerate(concepts)), []
    if len(concepts) > PATTERNS_PER_PASS:
        labels = stored(labels.where("label IS NOT NULL"), "labels")
        found, rest = matching_patterns(labels, [c.pattern for c in concepts], anchored)
        everywhere, parts = [(n, concepts[n]) for n in rest], [found]
    parts += [labels.select("label", F.explode(hits(batch)).alias("n")) for batch in batched(everywhere, PATTERNS_PER_PASS)]
    matched = reduce(DataFrame.unionByName, parts)
    # Stored, so that the lines are shuffled only if the matches are known to be too
    # large to broadcast; adaptive execution then splits a label many lines share.
    matched = stored(matched, "label-matches")
    cur, prev = (f"y{y}" for y in years)
    amounts = lines.select(
        *by, "label", year_amount(years[0]).alias(cur), year_amount(years[1]).alias(prev)
    )
    # A line without a match keeps a row with a null n, which shows that its client exists.
    sums = amounts.join(matched, "label", "left").groupBy(*by, "n").agg(F.sum(cur).alias(cur), F.sum(prev).alias(prev))
    entry = F.struct("n", F.struct(cur, prev).alias("v"))
    known = sums.groupBy(*by).agg(F.collect_list(F.when(F.col("n").isNotNull(), entry)).alias("entries"))
    filled = known.withColumn("found", F.map_from_entries("entries"))
    names = F.array(*[F.lit(c.name) for c in concepts])
    rows = filled.select(*by, "found", F.posexplode(names).alias("n", "concept"))

    def amount(name: str) -> Column:
        nothing = F.lit(0).cast(AMOUNT_TYPE)
        return F.coalesce(F.element_at("found", F.col("n"))[name], nothing).cast("double").alias(name)

    return rows.select(*by, "concept", amount(cur), amount(prev))


def concepts_from_json(text: str) -> list[Concept]:
    """Concepts from a configuration text: an object of concept names and their patterns.

    Configuration is part of the program: the patterns become literals of the plan, since a
    regex taken from a column would be compiled again for every line.
    """

    def once(pairs: list[tuple[str, str]]) -> dict[str, str]:
        if len(dict(pairs)) != len(pairs):
            raise ValueError("every concept needs a name of its own")
        return dict(pairs)

    found = json.loads(text, object_pairs_hook=once)
    if not isinstance(found, dict) or not found or not all(isinstance(p, str) for p in found.values()):
        raise ValueError("concepts are an object of names and patterns")
    return [Concept(f"k{n}", name, pattern) for n, (name, pattern) in enumerate(sorted(found.items()))]


def account_totals(
    lines: DataFrame, years: tuple[int, int], digits: int = 3, by: Sequence[str] = ("client",)
) -> DataFrame:
    """Totals by the root of the account code that a label starts with: ``account`` and one DOUBLE
    column per year. The accounts are those found in the data; labels without a code of
    ``digits`` digits are left out."""
    account = F.regexp_extract("label", rf"^\s*(\d{{{digits}}})", 1).alias("account")
    cur, prev = (f"y{y}" for y in years)
    found = lines.select(*by, account, *[year_amount(y).alias(n) for y, n in zip(years, (cur, prev))])
    sums = found.filter(F.col("account") != "").groupBy(*by, "account").agg(
        *[F.coalesce(F.sum(n), F.lit(0).cast(AMOUNT_TYPE)).cast("double").alias(n) for n in (cur, prev)]
    )
    return sums
