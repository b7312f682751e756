"""Numeric column functions: amounts in Spanish layout, predicates, totals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallygrid.functions.columns import as_column
from tallygrid.functions.lists import keep

# Money is exact inside the library and turned into DOUBLE only at the output, so
# that sums do not depend on the order in which partitions are merged.
AMOUNT_TYPE = "decimal(38,6)"

# The characters Python's str.strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _plain(text: Column | str) -> Column:
    return F.btrim(F.translate(as_column(text), ",.;", "."), F.lit(WHITESPACE))


def clean_amount(text: Column | str) -> Column:
    """Number text in Spanish layout (``1.234,56``) as an exact decimal.

    Blank, null and unreadable text gives 0, as do ``inf`` and ``nan``. Digits after the
    sixth decimal are rounded. A number of 10^32 or more raises: no amount is lost.
    """
    plain = _plain(text)
    # Python reads 1_000 as 1000. Hardly any text holds an underscore, so this is
    # tried only where the plain text is no number.
    grouped = F.regexp_replace(plain, r"(?<=\d)_(?=\d)", "")
    too_large = F.raise_error(F.concat(F.lit("amount out of range: "), as_column(text)))
    rest = F.when(grouped.rlike(NUMBER), too_large.cast(AMOUNT_TYPE)).otherwise(F.lit(0).cast(AMOUNT_TYPE))
    return F.coalesce(plain.try_cast(AMOUNT_TYPE), grouped.try_cast(AMOUNT_TYPE), rest)


def is_unreadable(text: Column | str) -> Column:
    """Text that holds something but no number, which :func:`clean_amount` makes 0."""
    plain = F.regexp_replace(_plain(text), r"(?<=\d)_(?=\d)", "")
    return F.coalesce((plain != "") & plain.try_cast(AMOUNT_TYPE).isNull(), F.lit(False))


def is_english(text: Column | str) -> Column:
    """Text in English layout (``1,234.56``), which :func:`clean_amount` reads as 1.23456."""
    return F.coalesce(as_column(text).rlike(r"^\s*[+-]?\d{1,3}(,\d{3})+\.\d+\s*$"), F.lit(False))


def spanish_number(c: Column | str, decimals: int = 2) -> Column:
    """The number as Spanish text, the opposite of :func:`clean_amount`."""
    return F.translate(F.format_number(as_column(c), decimals), ",.", ".,")


def add(x: Column | str, y: Column | str, null_on_overflow: bool = False) -> Column:
    """``x + y``; integer overflow raises unless null is asked for."""
    x, y = as_column(x), as_column(y)
    return F.try_add(x, y) if null_on_overflow else x + y


def is_multiple(c: Column | str, k: int) -> Column:
    return as_column(c) % F.lit(k) == 0


def is_even(c: Column | str) -> Column:
    return is_multiple(c, 2)


def is_bigger(c: Column | str, num, floating: bool = True) -> Column:
    """``c > num``. Spark sorts NaN above every number, so NaN is taken out.

    Pass ``floating=False`` for integer columns, which hold no NaN.
    """
    c = as_column(c)
    bigger = c > num
    return bigger & ~F.isnan(c) if floating else bigger


def select_even(arr: Column | str) -> Column:
    return keep(arr, is_even)


def select_multiples(arr: Column | str, k: int) -> Column:
    return keep(arr, lambda x: is_multiple(x, k))


def select_mult_5(arr: Column | str) -> Column:
    return select_multiples(arr, 5)


def sum_mult_of_3(arr: Column | str) -> Column:
    """Despite the name, the multiples of 3 themselves, as users of the list version
    know it; their total is :func:`total_mult_of_3`."""
    return select_multiples(arr, 3)


def select_bigger(num, arr: Column | str) -> Column:
    return keep(arr, lambda x: is_bigger(x, num))


def total_where(
    c: Column | str, wanted: Callable[[Column], Column], total_type: str | None = None
) -> Column:
    """Aggregate: sum of the values that pass ``wanted``; 0 when there is none.

    ``total_type`` widens each value before it is added. A BIGINT sum raises when
    it overflows; ``decimal(20,0)`` input gives an exact sum of up to 30 digits.
    """
    c = as_column(c)
    value = c.cast(total_type) if total_type else c
    return F.coalesce(F.sum(F.when(wanted(c), value)), F.lit(0))


def sum_even(c: Column | str, total_type: str | None = None) -> Column:
    return total_where(c, is_even, total_type)


def total_mult_of_3(c: Column | str, total_type: str | None = None) -> Column:
    return total_where(c, lambda x: is_multiple(x, 3), total_type)


def sum_present(c: Column | str, total_type: str | None = None) -> Column:
    """Aggregate: sum of the values that are not null; 0 when there is none."""
    return total_where(c, lambda x: x.isNotNull(), total_type)


def list_sum(
    arr: Column | str,
    wanted: Callable[[Column], Column] | None = None,
    total_type: str = "bigint",
) -> Column:
    """Sum inside each list, nulls and unwanted values left out; 0 when none is left."""
    chosen = keep(arr, wanted or (lambda x: x.isNotNull()))
    return F.aggregate(
        chosen, F.lit(0).cast(total_type), lambda total, x: (total + x).cast(total_type)
    )


# Salary revision. Tier limits and factors.
LOW_LIMIT, MIDDLE_LIMIT, HIGH_LIMIT = 900, 1500, 6000
LOW_FACTOR, MIDDLE_FACTOR, HIGH_FACTOR = 1.30, 1.12, 2.0


def revised_salary(c: Column | str, keep_gap: bool = False) -> Column:
    """Salary after the revision, as DOUBLE.

    No tier covers a salary of exactly 6000 (nor NaN): the result is null and the
    selectors below drop the row. ``keep_gap`` passes 6000 through unchanged.
    """
    pay = as_column(c).cast("double")
    gap = pay if keep_gap else F.lit(None).cast("double")
    return (
        F.when(F.isnan(pay), F.lit(None))
        .when(pay < LOW_LIMIT, pay * LOW_FACTOR)
        .when(pay < MIDDLE_LIMIT, pay * MIDDLE_FACTOR)
        .when(pay < HIGH_LIMIT, pay)
        .when(pay > HIGH_LIMIT, pay * HIGH_FACTOR)
        .otherwise(gap)
    )


def update_salaries(arr: Column | str, keep_gap: bool = False) -> Column:
    """List form of :func:`revised_salary`."""
    return keep(F.transform(as_column(arr), lambda x: revised_salary(x, keep_gap)), lambda x: x.isNotNull())
