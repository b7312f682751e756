"""Arguments that may be a column or its name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(c) -> Column:
    """A name becomes that column, a column stays, any other value is a literal."""
    if isinstance(c, Column):
        return c
    return F.col(c) if isinstance(c, str) else F.lit(c)
