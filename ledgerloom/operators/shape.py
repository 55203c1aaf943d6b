"""Projections of the ledger: listing, enriched, detail, map and long-by-month shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.labels import has_text, or_label
from ledgerloom.functions.money import full_text, lenient_total, listing_text, row_total
from ledgerloom.schema import MONTH_NAMES, MONTHLY, POINT_COLUMNS, REALISASI_MONTHS

LISTING_COLUMNS = [
    "id_root", "klaster_regional", "entitas_terminal", "project_definition", "type_investasi",
    "tahun_rkap", "status_investasi", "status_issue", "rkap", "nilai_kontrak", "updated_at",
]
ENRICHED_COLUMNS = [
    *LISTING_COLUMNS[:-1], "kebutuhan_dana", "asset_categories",
    "total_realisasi", "latitude", "longitude", "updated_at",
]
HOVER_COLUMNS = ["id_root", "project_definition", "klaster_regional", "status_investasi", "rkap"]


def newest_first() -> list[Column]:
    """Newest rows first, unstamped rows before all; the id settles ties."""
    return [F.col("updated_at").desc_nulls_first(), F.col("id_root").asc_nulls_last()]


def listing(led: DataFrame) -> DataFrame:
    return led.select(*LISTING_COLUMNS)


def listing_texts(led: DataFrame) -> DataFrame:
    """The printed listing: short terminal, whole-number budget, dashes for blanks."""
    return led.select(
        F.col("id_root"),
        F.coalesce(F.col("klaster_regional"), F.lit("")).alias("klaster_regional"),
        F.substring(or_label(F.col("entitas_terminal"), "-"), 1, 20).alias("entitas_terminal"),
        or_label(F.col("type_investasi"), "-").alias("type_investasi"),
        F.col("tahun_rkap"),
        listing_text(F.col("rkap")).alias("rkap_text"),
        or_label(F.col("status_issue"), "-").alias("status_issue"),
    )


def enriched(led: DataFrame, ordered: bool = False) -> DataFrame:
    """Dashboard rows with the strict yearly actual.

    ``ordered`` adds the newest-first sort, a range shuffle of the whole ledger that only a reader
    who pages through it needs.
    """
    rows = led.withColumn("total_realisasi", row_total(led)).select(*ENRICHED_COLUMNS)
    return rows.orderBy(*newest_first()) if ordered else rows


def detail(led: DataFrame) -> DataFrame:
    """The detail card, with the lenient total; issue fields only where an issue is described."""
    has_issue = has_text(F.col("issue_description"))

    def issue(name: str) -> Column:
        return F.when(has_issue, or_label(F.col(name), "-"))

    return led.select(
        "id_root",
        "klaster_regional",
        or_label(F.col("entitas_terminal"), "-").alias("entitas_terminal"),
        F.substring(or_label(F.col("project_definition"), "-"), 1, 100).alias("project_definition"),
        or_label(F.col("type_investasi"), "-").alias("type_investasi"),
        "tahun_rkap",
        or_label(F.col("status_investasi"), "-").alias("status_investasi"),
        full_text(F.col("rkap")).alias("rkap_text"),
        full_text(F.col("kebutuhan_dana")).alias("kebutuhan_text"),
        full_text(F.col("nilai_kontrak")).alias("kontrak_text"),
        full_text(lenient_total(REALISASI_MONTHS)).alias("realisasi_text"),
        issue("status_issue").alias("issue_status"),
        issue("issue_categories").alias("issue_category"),
        F.substring(issue("issue_description"), 1, 200).alias("issue_text"),
        issue("pic").alias("issue_pic"),
    )


def map_points(led: DataFrame) -> DataFrame:
    return led.dropna(subset=POINT_COLUMNS).select(*POINT_COLUMNS, *HOVER_COLUMNS)


def long_months(wide: DataFrame, keys: list[str], kind: str, value: str = "value") -> DataFrame:
    """One row per key and month from the 12 columns of one kind; feed it aggregated rows."""
    entries = ", ".join(
        f"struct({i} AS month_order, '{MONTH_NAMES[i - 1]}' AS month, {c} AS {value})"
        for i, c in enumerate(MONTHLY[kind], start=1)
    )
    return wide.selectExpr(*keys, f"inline(array({entries}))")
