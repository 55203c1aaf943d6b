"""Sums over months, guarded ratios and money texts.

Sums stay decimal (exact in any order); ratios are taken on doubles, or on decimals where they are
rounded next, and only when the divisor is positive, since ANSI mode raises on division by zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.schema import MONTHLY, TOTALS


def strict_total(columns: list[str]) -> Column:
    """SQL ``a + b + …``: NULL as soon as one term is NULL."""
    return F.expr(" + ".join(columns))


def lenient_total(columns: list[str]) -> Column:
    """Sum that reads a NULL term as 0."""
    return F.expr(" + ".join(f"coalesce({c}, 0.00BD)" for c in columns))


def row_total(led: DataFrame, kind: str = "realisasi", through_month: int = 12) -> Column:
    """Per-row total of one monthly kind through a month, strict about NULL.

    A conformed ledger already stores the 12-month totals, so reports over it read one column
    instead of twelve.
    """
    if through_month == 12 and TOTALS[kind] in led.columns:
        return F.col(TOTALS[kind])
    return strict_total(MONTHLY[kind][:through_month])


def zero_if_null(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def ratio(part: Column, whole: Column, scale: float = 1.0) -> Column:
    """``part / whole * scale`` as a double, 0 unless ``whole`` is positive."""
    quotient = part.cast("double") / whole.cast("double")
    if scale != 1.0:
        quotient = quotient * F.lit(float(scale))
    return F.when(whole > 0, quotient).otherwise(F.lit(0.0))


def exact_percent(part: Column, whole: Column) -> Column:
    """``part / whole`` in percent as a decimal, 0 unless ``whole`` is positive.

    For values that get rounded: 2345 of 100000 is 2.345 exactly here, and 2.3449… as a double.
    """
    # Wide enough for sums up to 10^20, and 16 digits behind the point of the quotient.
    wide = "decimal(22,2)"
    quotient = part.cast(wide) / whole.cast(wide) * F.lit(100)
    return F.when(whole > 0, quotient).otherwise(F.lit(0))


def scaled(value: Column, unit: float) -> Column:
    """Money in a larger unit, as a double."""
    return value.cast("double") / F.lit(float(unit))


def _as_decimal(value: Column) -> Column:
    return value.cast("string").try_cast("decimal(38,10)")


def _plain(value: Column, digits: int) -> Column:
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))


def format_currency(value: Column) -> Column:
    """``Rp`` text with 2 decimals and '.' for every separator; non-numeric text is kept."""
    number = _as_decimal(value)
    text = F.replace(
        F.concat(F.lit("Rp "), F.format_number(number, 2)), F.lit(","), F.lit(".")
    )
    return F.when(value.isNull(), F.lit("Rp 0")).otherwise(
        F.coalesce(text, value.cast("string"))
    )


def tenths_half_even(part: Column, whole: Column) -> Column:
    """``|part / whole|`` in tenths of a percent as a whole number, ties to the even one; NULL where ``whole`` is 0.

    The remainder of a whole division decides, so no quotient is cut before it is rounded.
    """
    thousandfold, divisor = F.abs(part) * F.lit(1000), F.nullif(F.abs(whole), F.lit(0))
    rest = thousandfold % divisor
    down = F.try_divide(thousandfold - rest, divisor).try_cast("decimal(38,0)")
    twice = rest * F.lit(2)
    up = (twice > divisor) | ((twice == divisor) & (down % 2 == 1))
    return down + F.when(up, 1).otherwise(0)


def format_percentage(value: Column, total: Column) -> Column:
    """One-decimal percent text, rounded half-even: '0%' for an empty total, 'N/A' for what is not a number."""
    # Numbers are exact to ten decimals; a text total is no number that can be zero.
    part = value.cast("string").try_cast("decimal(30,10)")
    whole = total.cast("string").try_cast("decimal(30,10)")
    blank = total.isNull() | (total.cast("string") == "") | ((whole == 0) & (F.typeof(total) != "string"))
    tenths = tenths_half_even(part, whole)
    sign = F.when((part < 0) != (whole < 0), "-").otherwise("")
    units = ((tenths - tenths % 10) / 10).cast("decimal(38,0)").cast("string")
    text = F.concat(sign, units, F.lit("."), (tenths % 10).cast("decimal(1,0)").cast("string"), F.lit("%"))
    return F.when(F.coalesce(blank, F.lit(False)), F.lit("0%")).otherwise(F.coalesce(text, F.lit("N/A")))


def percent_text(value: Column) -> Column:
    """``12.3%`` from a number that already is a percentage."""
    return F.concat(_plain(value, 1), F.lit("%"))


def billions_text(value: Column) -> Column:
    return F.concat(F.lit("Rp "), _plain(scaled(value, 1e9), 2), F.lit("B"))


def millions_text(value: Column) -> Column:
    return F.concat(F.lit("Rp "), F.format_number(scaled(value, 1e6), 0), F.lit("Jt"))


def listing_text(value: Column) -> Column:
    """Whole-number money for listings, '-' when nothing is budgeted."""
    return F.when(
        value.isNotNull() & (value != 0),
        F.concat(F.lit("Rp "), F.format_number(value, 0)),
    ).otherwise(F.lit("-"))


def full_text(value: Column) -> Column:
    return F.concat(F.lit("Rp "), F.format_number(zero_if_null(value), 2))
