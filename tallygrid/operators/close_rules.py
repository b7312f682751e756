"""Closing rules over concept totals, one row per client.

Every rule is a projection of the totals, so none of them shuffles. Amounts are
compared by size, because expenses are negative in some ledgers and positive in
others; only the result keeps its sign.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.operators.concepts import CONCEPTS

# The reduced tax rate holds below this revenue.
TAX_LIMIT = 1_000_000
REDUCED_RATE, GENERAL_RATE = 0.23, 0.25


@dataclass(frozen=True)
class Thresholds:
    """Limits of the alerts. The rules only speak of "high", "relevant" and
    "significant", so these numbers are our defaults and meant to be set."""

    min_professionals: float = 50_000.0  # fees that count as high
    rent_pct: float = 10.0
    utilities_pct: float = 25.0
    amortization_pct: float = 25.0
    financing_pct: float = 50.0


DEFAULTS = Thresholds()
# Concepts that may be named as the main reason of a change in tax.
DRIVERS = ("ventas", "gastos", "amortizaciones", "gastos_financieros")
RESULT = "resultado"
# Concepts that the alerts and the screening read.
ALERT_KEYS = (
    "profesionales", "salarios", "arrendamientos", "suministros", "amortizaciones", "gastos_financieros"
)


def cur(key: str) -> Column:
    return F.col(f"{key}_cur").cast("double")


def prev(key: str) -> Column:
    return F.col(f"{key}_prev").cast("double")


def change_pct(key: str) -> Column:
    """Year-on-year change in percent, two decimals; null when last year was 0."""
    now, before = cur(key), prev(key)
    delta = now - before if key == RESULT else F.abs(now) - F.abs(before)
    return F.round(F.try_divide(delta, F.abs(before)) * 100, 2)


def tax_rate() -> Column:
    """Rate by revenue; exactly one million pays the general rate."""
    return F.when(cur("ventas") < TAX_LIMIT, REDUCED_RATE).otherwise(GENERAL_RATE)


def margin() -> Column:
    return F.try_divide(cur(RESULT), cur("ventas"))


def effective_rate() -> Column:
    """Tax over the result before tax."""
    tax = F.abs(cur("impuesto"))
    return F.try_divide(tax, cur(RESULT) + tax)


def false_self_employed(t: Thresholds = DEFAULTS) -> Column:
    """High professional fees and no salaries."""
    return (F.abs(cur("profesionales")) > t.min_professionals) & (cur("salarios") == 0)


def _moved(key: str, limit: float) -> Column:
    return F.coalesce(F.abs(change_pct(key)) > limit, F.lit(False))


def rent_alert(t: Thresholds = DEFAULTS) -> Column:
    return _moved("arrendamientos", t.rent_pct)


def utilities_alert(t: Thresholds = DEFAULTS) -> Column:
    return _moved("suministros", t.utilities_pct)


def amortization_alert(t: Thresholds = DEFAULTS) -> Column:
    return _moved("amortizaciones", t.amortization_pct)


def new_assets() -> Column:
    """Amortization grew, so fixed assets were probably bought."""
    return F.abs(cur("amortizaciones")) > F.abs(prev("amortizaciones"))


def financing_alert(t: Thresholds = DEFAULTS) -> Column:
    """Financial cost grew significantly, or appeared."""
    grown = F.coalesce(change_pct("gastos_financieros") > t.financing_pct, F.lit(False))
    return grown | ((prev("gastos_financieros") == 0) & (cur("gastos_financieros") != 0))


def main_driver() -> Column:
    """Name of the driver that moved most; the later name wins a tie."""
    names = {c.key: c.name for c in CONCEPTS}
    moves = [
        F.struct(F.abs(cur(k) - prev(k)).alias("delta"), F.lit(names[k]).alias("concept"))
        for k in DRIVERS
    ]
    return F.array_max(F.array(*moves))["concept"]


def needs_review(t: Thresholds = DEFAULTS) -> Column:
    return (
        false_self_employed(t)
        | rent_alert(t)
        | utilities_alert(t)
        | financing_alert(t)
        | amortization_alert(t)
    )


def screening(t: Thresholds = DEFAULTS) -> Column:
    return F.when(needs_review(t), "review").otherwise("stable")


def with_changes(totals: DataFrame, years: tuple[int, int], by: Sequence[str] = ("client",)) -> DataFrame:
    """Summary table: concept, both amounts and the change in percent."""
    rows = [
        F.struct(
            F.lit(c.name).alias("concept"),
            cur(c.key).alias(f"y{years[0]}"),
            prev(c.key).alias(f"y{years[1]}"),
            change_pct(c.key).alias("change_pct"),
        )
        for c in CONCEPTS
    ]
    return totals.select(*by, F.inline(F.array(*rows)))


def with_alerts(totals: DataFrame, t: Thresholds = DEFAULTS, by: Sequence[str] = ("client",)) -> DataFrame:
    return totals.select(
        *by,
        false_self_employed(t).alias("false_self_employed"),
        rent_alert(t).alias("rent_alert"),
        utilities_alert(t).alias("utilities_alert"),
        new_assets().alias("new_assets"),
        financing_alert(t).alias("financing_alert"),
    )
