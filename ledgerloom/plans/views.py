"""The five summary views of the conformed ledger, and their readers.

Readers always add up by key again, so they accept both a fresh view and an append-only summary
table that holds several partial rows per key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.labels import has_text
from ledgerloom.functions.money import ratio, row_total
from ledgerloom.operators.filters import for_year, with_issue
from ledgerloom.schema import INVESTMENT_TYPES, MONTH_SHORT, REALISASI_MONTHS

YEAR_REGION = ["tahun_rkap", "klaster_regional"]


def budget_actual(led: DataFrame) -> DataFrame:
    return led.groupBy(*YEAR_REGION).agg(
        F.count("*").alias("project_count"),
        F.sum("rkap").alias("total_rkap"),
        F.sum(row_total(led)).alias("total_realisasi"),
        F.sum("nilai_kontrak").alias("total_nilai_kontrak"),
    )


def progress(led: DataFrame) -> DataFrame:
    return led.groupBy(*YEAR_REGION, "entitas_terminal").agg(
        F.count("*").alias("project_count"),
        F.count_if(has_text(F.col("status_investasi"))).alias("with_status_count"),
    )


def issues(led: DataFrame) -> DataFrame:
    return with_issue(led).groupBy(*YEAR_REGION, "status_issue").agg(
        F.count("*").alias("issue_count")
    )


def monthly(led: DataFrame) -> DataFrame:
    return led.groupBy(*YEAR_REGION).agg(
        *(
            F.expr(f"sum({c}) AS {short}")
            for c, short in zip(REALISASI_MONTHS, MONTH_SHORT, strict=True)
        )
    )


def investment_type(led: DataFrame) -> DataFrame:
    return led.groupBy("tahun_rkap", "type_investasi").agg(
        F.count("*").alias("project_count"),
        F.sum("rkap").alias("total_rkap"),
        F.sum("nilai_kontrak").alias("total_nilai_kontrak"),
    )


VIEWS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "budget_actual": budget_actual,
    "progress": progress,
    "issues": issues,
    "monthly": monthly,
    "investment_type": investment_type,
}
KEYS = {
    "budget_actual": YEAR_REGION,
    "progress": [*YEAR_REGION, "entitas_terminal"],
    "issues": [*YEAR_REGION, "status_issue"],
    "monthly": YEAR_REGION,
    "investment_type": ["tahun_rkap", "type_investasi"],
}


def merged(view: DataFrame, name: str) -> DataFrame:
    """One row per key from any number of partial rows."""
    keys = KEYS[name]
    sums = [c for c in view.columns if c not in keys]
    types = dict(view.dtypes)
    return view.groupBy(*keys).agg(
        *(F.expr(f"CAST(sum({c}) AS {types[c]}) AS {c}") for c in sums)
    )


def _type_rank(value: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, INVESTMENT_TYPES)), value)


def read_budget_actual(view: DataFrame, year: int | None = None) -> DataFrame:
    return (
        merged(for_year(view, year), "budget_actual")
        .withColumn("persen_serapan", ratio(F.col("total_realisasi"), F.col("total_rkap"), 100))
        .orderBy(*YEAR_REGION)
    )


def read_progress(view: DataFrame, year: int | None = None) -> DataFrame:
    return merged(for_year(view, year), "progress")


def read_issues(view: DataFrame, year: int | None = None) -> DataFrame:
    return merged(for_year(view, year), "issues").orderBy(*YEAR_REGION)


def read_monthly(view: DataFrame, year: int | None = None) -> DataFrame:
    return merged(for_year(view, year), "monthly")


def read_investment_type(view: DataFrame, year: int | None = None) -> DataFrame:
    """Ordered by year, then by the declared order of the types."""
    return merged(for_year(view, year), "investment_type").orderBy(
        "tahun_rkap", _type_rank(F.col("type_investasi"))
    )
