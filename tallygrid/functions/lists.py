"""List helpers. A list is an array column, or one row per element with its position."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.functions.columns import as_column


def keep(arr: Column | str, wanted: Callable[[Column], Column]) -> Column:
    """The elements for which ``wanted`` is true, in their order."""
    return F.filter(as_column(arr), wanted)


def list_rows(
    df: DataFrame, arr: str, keys: Sequence[str] = (), pos: str = "pos", value: str = "x"
) -> DataFrame:
    """Row form of an array column: one row per element, numbered from 0."""
    return df.select(*keys, F.posexplode(arr).alias(pos, value))
