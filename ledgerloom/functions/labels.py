"""Labels, threshold bands, month names and text trimming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.schema import MONTHS

# The dashboard thresholds, as (inclusive lower bound, colour).
OPEN_ISSUE_BANDS = ((3, "yellow"), (5, "red"))
OPEN_ISSUE_BASE = "green"
YTD_BANDS = ((30, "orange"), (60, "yellow"), (80, "green"))
YTD_BASE = "red"
CATEGORY_BANDS = ((30, "yellow"), (60, "green"))
CATEGORY_BASE = "red"
HALF_BANDS = ((50, "#2ecc71"),)
HALF_BASE = "#e74c3c"

# Fixed value: the code points with the Unicode White_Space property.
WHITE_SPACE = "".join(
    map(chr, [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)


def or_label(value: Column, label: str) -> Column:
    """The value, or the label when it is NULL or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(label))


def band(value: Column, steps: Sequence[tuple[float, str]], base: str) -> Column:
    """Name of the highest step whose lower bound the value reaches."""
    named = F
    for limit, name in sorted(steps, reverse=True):
        named = named.when(value >= F.lit(limit), F.lit(name))
    return named.otherwise(F.lit(base))


def month_number(name: Column) -> Column:
    """1–12 for a month name in any case, 0 for an unknown name, NULL for NULL."""
    names = F.expr("array(" + ", ".join(f"'{m}'" for m in MONTHS) + ")")
    return F.array_position(names, F.lower(name)).cast("int")


def strip(value: Column) -> Column:
    """Trim every kind of white space, not blanks alone."""
    return F.btrim(value, F.lit(WHITE_SPACE))


def has_text(value: Column) -> Column:
    return value.isNotNull() & (value != "")
