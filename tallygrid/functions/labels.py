"""Account label matching."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallygrid.functions.columns import as_column


def pattern_text(pattern: str, anchored: bool = False) -> str:
    """The regex that stands for a label pattern."""
    if anchored:
        pattern = rf"^\s*(?:{pattern})"
    # Without u Java folds the case of ASCII letters only, and without U its classes
    # such as \d and \b know no others.
    return f"(?iuU){pattern}"


def label_matches(label: Column | str, pattern: str, anchored: bool = False) -> Column:
    """Case-insensitive regex search in a label; a null label does not match.

    The search is unanchored, so ``621`` also hits ``16210``. ``anchored`` asks for
    the match at the start of the label instead.
    """
    return F.coalesce(as_column(label).rlike(pattern_text(pattern, anchored)), F.lit(False))
