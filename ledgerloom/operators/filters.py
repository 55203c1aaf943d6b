"""Optional filters, key lookups and facet values."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.labels import has_text, or_label

FACETS = ("klaster_regional", "entitas_terminal", "type_investasi", "tahun_rkap", "status_issue")


def for_year(led: DataFrame, year: int | None = None) -> DataFrame:
    """One budget year; None and 0 mean all. Prunes partitions of a stored ledger."""
    return led.where(F.col("tahun_rkap") == year) if year else led


def search(
    led: DataFrame,
    region: str | None = None,
    terminal: str | None = None,
    year: int | None = None,
    issue_status: str | None = None,
) -> DataFrame:
    """Rows meeting every given condition; ``terminal`` is a case-blind LIKE substring."""
    if region:
        led = led.where(F.col("klaster_regional") == region)
    if terminal:
        led = led.where(F.col("entitas_terminal").ilike(f"%{terminal}%"))
    if issue_status:
        led = led.where(F.col("status_issue") == issue_status)
    return for_year(led, year)


def equal_to(led: DataFrame, **values: Any) -> DataFrame:
    """Exact matches on any columns; None is no condition."""
    for name, value in values.items():
        if value is not None:
            led = led.where(F.col(name) == value)
    return led


def facet_filter(led: DataFrame, **facets: Any) -> DataFrame:
    """Exact matches on the dashboard facets; empty choices are no condition."""
    unknown = set(facets) - set(FACETS)
    if unknown:
        raise ValueError(f"not a facet: {sorted(unknown)}")
    return equal_to(led, **{k: v or None for k, v in facets.items()}).select("id_root", *FACETS)


def facet_values(led: DataFrame) -> DataFrame:
    """Choices of every facet with their row counts.

    Rows are first counted by facet combination, so only the few combinations are shuffled and
    unpivoted.
    """
    combined = led.groupBy(*FACETS).agg(F.count("*").alias("n"))
    long = combined.select(
        "n",
        F.inline(
            F.array(
                *(
                    F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value"))
                    for f in FACETS
                )
            )
        ),
    )
    return (
        long.where(F.col("value").isNotNull())
        .groupBy("facet", "value")
        .agg(F.sum("n").alias("project_count"))
        .select("facet", "value", or_label(F.col("value"), "N/A").alias("label"), "project_count")
        .orderBy("facet", "value")
    )


def with_issue(led: DataFrame) -> DataFrame:
    return led.where(has_text(F.col("issue_description")))


def by_keys(led: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose id is among ``keys``; repeated keys do not repeat rows."""
    return led.join(keys.select("id_root"), "id_root", "left_semi")
