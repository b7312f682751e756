"""Operators on lists in row form, one row per element."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrid.functions.numbers import revised_salary, sum_present


def flat_sum(
    df: DataFrame,
    value: str,
    by: Sequence[str] = (),
    ints_only: bool = False,
    total_type: str | None = None,
) -> DataFrame:
    """``total`` of an optional-number column, nulls ignored, 0 when nothing is left.

    ``ints_only`` counts values of integer type and nothing else, so the total of a
    floating or boolean column is 0.
    """
    is_int = isinstance(df.schema[value].dataType, T.IntegralType)
    total = F.lit(0) if ints_only and not is_int else sum_present(value, total_type)
    return df.groupBy(*by).agg(total.alias("total"))


def update_salaries(
    df: DataFrame, pay: str, revised: str = "revised", keep_gap: bool = False
) -> DataFrame:
    """Rows with their revised salary; rows that no tier covers are left out."""
    return df.withColumn(revised, revised_salary(pay, keep_gap)).filter(F.col(revised).isNotNull())
