"""Bring source rows into the analytics shape, with column expressions only.

Two profiles exist because the batch load and the change-feed load disagree on blanks:

==================  =====================================  ==============================
column              ``cli`` (batch)                        ``daemon`` (change feed)
==================  =====================================  ==============================
type, issue status  anything outside the set → first word  only NULL and '' → first word
years               NULL and 0 → 2025                      NULL → 0
latitude/longitude  NULL and 0 → NULL                      kept
==================  =====================================  ==============================

Both turn other NULL texts into '', and NULL or unreadable money into 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.labels import strip
from ledgerloom.functions.money import strict_total
from ledgerloom.schema import (
    DATE_COLUMNS,
    DEFAULT_REGION,
    DEFAULT_UNIT,
    DEFAULT_YEAR,
    INVESTMENT_TYPES,
    ISSUE_STATUSES,
    MONEY,
    MONEY_COLUMNS,
    MONTHLY,
    POINT_COLUMNS,
    SOURCE_LEDGER,
    STAMP_COLUMNS,
    SYNC_COLUMNS,
    TEXT_COLUMNS,
    TOTALS,
    YEAR_COLUMNS,
)

PROFILES = ("cli", "daemon")
DOMAINS = {"type_investasi": INVESTMENT_TYPES, "status_issue": ISSUE_STATUSES}


def _conformed(name: str, profile: str) -> str:
    """SQL of one conformed column."""
    strict = profile == "cli"
    if name in DOMAINS:
        words = ", ".join(f"'{w}'" for w in DOMAINS[name])
        keep = f"{name} IN ({words})" if strict else f"{name} <> ''"
        return f"CASE WHEN {keep} THEN {name} ELSE '{DOMAINS[name][0]}' END"
    if name in YEAR_COLUMNS:
        year = f"CAST({name} AS INT)"
        if strict:
            return f"coalesce(nullif({year}, 0), {DEFAULT_YEAR})"
        return f"coalesce({year}, 0)"
    if name == "jangka_waktu":
        return f"coalesce(CAST({name} AS INT), 0)"
    if name in MONEY_COLUMNS:
        return f"coalesce(try_cast({name} AS {MONEY.simpleString()}), 0.00BD)"
    if name in POINT_COLUMNS:
        return f"nullif(CAST({name} AS DOUBLE), 0D)" if strict else f"CAST({name} AS DOUBLE)"
    if name in DATE_COLUMNS:
        return f"CAST({name} AS DATE)"
    if name in STAMP_COLUMNS:
        return f"CAST({name} AS TIMESTAMP_NTZ)"
    return f"coalesce(CAST({name} AS STRING), '')"


def with_totals(led: DataFrame) -> DataFrame:
    """Store the three 12-month totals, so that reports read one column instead of twelve."""
    return led.withColumns(
        {TOTALS[kind]: strict_total(columns).cast(MONEY) for kind, columns in MONTHLY.items()}
    )


def conform(source: DataFrame, profile: str = "cli") -> DataFrame:
    """The 69 synced columns and 3 totals of the analytics ledger."""
    if profile not in PROFILES:
        raise ValueError(f"unknown profile: {profile}")
    rows = source.selectExpr(*(f"{_conformed(c, profile)} AS {c}" for c in SYNC_COLUMNS))
    return with_totals(rows)


def fill_defaults(rows: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Add the source-table columns a load leaves out, with their defaults.

    A default replaces a *missing column*; an explicit NULL stays, save for budget money, which the
    row model reads as 0.
    """
    rows = rows.withColumn("_now", as_of if as_of is not None else F.current_timestamp())
    defaults = {
        "klaster_regional": f"'{DEFAULT_REGION}'",
        "tahun_rkap": str(DEFAULT_YEAR),
        "satuan_hari": f"'{DEFAULT_UNIT}'",
        "created_at": "_now",
        "updated_at": "_now",
        "metadata": "'{}'",
    }
    budget = {"kebutuhan_dana", "rkap", *MONTHLY["rkap"]}

    def value(name: str) -> str:
        if name not in rows.columns:
            return "0" if name in MONEY_COLUMNS else defaults.get(name, "NULL")
        return f"coalesce({name}, 0)" if name in budget else name

    return rows.selectExpr(
        *(
            f"CAST({value(f.name)} AS {f.dataType.simpleString()}) AS {f.name}"
            for f in SOURCE_LEDGER.fields
        )
    )


def strip_texts(rows: DataFrame) -> DataFrame:
    """Trim white space around every text column of the ledger present in ``rows``."""
    texts = [
        f.name
        for f in rows.schema.fields
        if f.name in TEXT_COLUMNS and isinstance(f.dataType, T.StringType)
    ]
    return rows.withColumns({c: strip(F.col(c)) for c in texts})
