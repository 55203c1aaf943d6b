"""The fixed report catalogue.

Every report is one scan and one partially aggregated ``groupBy`` over few groups, so a hot region
or category shrinks to a row per task before the shuffle. Reports take either ledger form: the
source one sums months strictly (a NULL month drops the row from the sum), the conformed one reads
its stored totals. Money stays decimal; ratios and scaled money are doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import labels
from ledgerloom.functions.money import (
    billions_text,
    exact_percent,
    millions_text,
    percent_text,
    ratio,
    row_total,
    scaled,
    zero_if_null,
)
from ledgerloom.operators.filters import for_year, with_issue
from ledgerloom.operators.shape import long_months, newest_first
from ledgerloom.schema import (
    MONTH_NAMES,
    MONTHS,
    REALISASI_MONTHS,
    RKAP_MONTHS,
    UNDETERMINED,
)

MILLION = 1e6


def _count() -> Column:
    return F.count("*").alias("project_count")


def _is_status(word: str) -> Column:
    return F.count_if(F.col("status_issue") == word)


def _by_name(name: str) -> Column:
    return F.col(name).asc_nulls_last()


# ---- regions -------------------------------------------------------------------------------


def _regional(led: DataFrame) -> DataFrame:
    return led.groupBy("klaster_regional").agg(
        _count(),
        F.sum("rkap").alias("total_rkap"),
        F.sum("nilai_kontrak").alias("total_nilai_kontrak"),
        F.sum(row_total(led)).alias("total_realisasi"),
        _is_status("Open").alias("open_issues"),
        _is_status("Closed").alias("closed_issues"),
    )


def regional_summary(led: DataFrame, year: int | None = None) -> DataFrame:
    return _regional(for_year(led, year)).orderBy(_by_name("klaster_regional"))


def regional_summary_filled(led: DataFrame) -> DataFrame:
    sums = ["total_rkap", "total_nilai_kontrak", "total_realisasi"]
    return (
        _regional(led)
        .withColumns({c: zero_if_null(F.col(c)) for c in sums})
        .orderBy(_by_name("klaster_regional"))
    )


def regional_absorption(led: DataFrame, year: int | None = None) -> DataFrame:
    """Regional summary with the absorbed share of the budget in percent."""
    budget, actual = zero_if_null(F.col("total_rkap")), zero_if_null(F.col("total_realisasi"))
    return (
        _regional(for_year(led, year))
        .withColumn("serapan", ratio(actual, budget, 100))
        .withColumn("serapan_text", percent_text(exact_percent(actual, budget)))
        .orderBy(_by_name("klaster_regional"))
    )


def region_budget_actual(led: DataFrame) -> DataFrame:
    return (
        led.groupBy("klaster_regional")
        .agg(F.sum("rkap").alias("total_rkap"), F.sum(row_total(led)).alias("total_realisasi"))
        .orderBy(_by_name("klaster_regional"))
    )


def open_closed_totals(led: DataFrame) -> DataFrame:
    return led.agg(
        _is_status("Open").alias("open_issues"), _is_status("Closed").alias("closed_issues")
    )


# ---- months --------------------------------------------------------------------------------


def _month_sums(columns: list[str]) -> list[Column]:
    return [F.expr(f"sum({c}) AS {c}") for c in columns]


def monthly_actuals(led: DataFrame) -> DataFrame:
    """One row of 12 zero-filled sums."""
    return led.agg(
        *(
            F.expr(f"coalesce(sum({c}), 0) AS {m}")
            for c, m in zip(REALISASI_MONTHS, MONTHS, strict=True)
        )
    )


def monthly_trend(led: DataFrame) -> DataFrame:
    """Month rows from a single pass: aggregate the 12 columns, then turn the one row."""
    sums = led.agg(*_month_sums(REALISASI_MONTHS))
    return (
        long_months(sums, [], "realisasi")
        .select("month", "month_order", "value")
        .orderBy("month_order")
    )


def s_curve(led: DataFrame, group: str = "klaster_regional") -> DataFrame:
    """Cumulative plan against cumulative actual by month for each group."""
    sums = led.groupBy(group).agg(*_month_sums(RKAP_MONTHS), *_month_sums(REALISASI_MONTHS))
    entries = ", ".join(
        f"struct({i} AS month_order, '{name}' AS month, {plan} AS plan, {actual} AS actual)"
        for i, (name, plan, actual) in enumerate(
            zip(MONTH_NAMES, RKAP_MONTHS, REALISASI_MONTHS, strict=True), start=1
        )
    )
    running = (
        Window.partitionBy(group)
        .orderBy("month_order")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        sums.selectExpr(group, f"inline(array({entries}))")
        .withColumn("cum_plan", F.sum("plan").over(running))
        .withColumn("cum_actual", F.sum("actual").over(running))
        .orderBy(_by_name(group), "month_order")
    )


# ---- categories ----------------------------------------------------------------------------


def _categories(led: DataFrame) -> DataFrame:
    return led.groupBy("asset_categories").agg(
        F.count("*").alias("item_count"),
        zero_if_null(F.sum("kebutuhan_dana")).alias("total_kebutuhan"),
        zero_if_null(F.sum("rkap")).alias("total_rkap"),
        zero_if_null(F.sum(row_total(led))).alias("total_realisasi"),
    )


def category_summary(led: DataFrame) -> DataFrame:
    return _categories(led).orderBy(_by_name("asset_categories"))


def _exact_share() -> Column:
    return exact_percent(F.col("total_realisasi"), F.col("total_rkap"))


def category_achievement(led: DataFrame) -> DataFrame:
    """Achieved percent, rounded half-even to 2 digits."""
    return (
        _categories(led)
        .withColumn("capaian", F.bround(_exact_share(), 2))
        .orderBy(_by_name("asset_categories"))
    )


def category_band(led: DataFrame) -> DataFrame:
    """Achieved percent as number, text and colour."""
    exact = _exact_share()
    return (
        _categories(led)
        .withColumn("cap", ratio(F.col("total_realisasi"), F.col("total_rkap"), 100))
        .withColumn("cap_text", percent_text(exact))
        .withColumn("color", labels.band(exact, labels.HALF_BANDS, labels.HALF_BASE))
        .orderBy(_by_name("asset_categories"))
    )


def _category_sums(led: DataFrame, through_month: int) -> DataFrame:
    month = through_month - 1
    return led.groupBy("asset_categories").agg(
        F.sum("kebutuhan_dana").alias("kebutuhan"),
        F.sum("rkap").alias("budget"),
        F.sum(RKAP_MONTHS[month]).alias("month_budget"),
        F.sum(REALISASI_MONTHS[month]).alias("month_actual"),
        F.sum(row_total(led, "rkap", through_month)).alias("ytd_budget"),
        F.sum(row_total(led, "realisasi", through_month)).alias("ytd_actual"),
    )


def _category_money(transfer: float, estimate: float) -> dict[str, Column]:
    """Table money in millions, from exact sums."""
    budget = F.col("budget").cast("double")
    return {
        "kebutuhan_dana": scaled(F.col("kebutuhan"), MILLION),
        "rkap_awal": scaled(F.col("budget"), MILLION),
        "rkap_transfer": budget * F.lit(transfer) / F.lit(MILLION),
        "bulan_rkap": scaled(F.col("month_budget"), MILLION),
        "bulan_realisasi": scaled(F.col("month_actual"), MILLION),
        "sd_bulan_rkap": scaled(F.col("ytd_budget"), MILLION),
        "sd_bulan_realisasi": scaled(F.col("ytd_actual"), MILLION),
        "taksasi": budget * F.lit(estimate) / F.lit(MILLION),
    }


def category_budget_table(
    led: DataFrame, through_month: int = 10, transfer: float = 0.85, estimate: float = 0.9
) -> DataFrame:
    """The numbered budget table by category; ``capaian`` is a ratio, its colour reads percent."""
    share = ratio(F.col("ytd_actual"), F.col("budget"))
    # One window over all rows, which are the few aggregated categories, never ledger rows.
    number = F.row_number().over(Window.orderBy(_by_name("asset_categories"))).cast("bigint")
    return (
        _category_sums(led, through_month)
        .select(
            number.alias("no"),
            F.col("asset_categories").alias("nama_aktiva"),
            *(c.alias(n) for n, c in _category_money(transfer, estimate).items()),
            share.alias("capaian"),
            labels.band(share * 100, labels.CATEGORY_BANDS, labels.CATEGORY_BASE).alias("color"),
        )
        .orderBy("no")
    )


FOOTER_COLUMNS = (
    "kebutuhan_dana", "rkap_awal", "rkap_transfer", "sd_bulan_rkap", "sd_bulan_realisasi", "taksasi",
)


def category_budget_footer(
    led: DataFrame, through_month: int = 10, transfer: float = 0.85, estimate: float = 0.9
) -> DataFrame:
    """The table's footed columns with their total row.

    The grand total rolls up the few category rows, so the ledger is scanned once.
    """
    sums = ("kebutuhan", "budget", "ytd_budget", "ytd_actual")
    rolled = (
        _category_sums(led, through_month)
        .rollup("asset_categories")
        .agg(
            F.grouping("asset_categories").cast("boolean").alias("is_total"),
            *(F.sum(c).alias(c) for c in sums),
        )
    )
    money = _category_money(transfer, estimate)
    return rolled.select(
        "is_total",
        F.col("asset_categories").alias("nama_aktiva"),
        *(money[c].alias(c) for c in FOOTER_COLUMNS),
    ).orderBy("is_total", F.col("nama_aktiva").asc_nulls_last())


# ---- status and type -----------------------------------------------------------------------


def _status_counts(led: DataFrame) -> DataFrame:
    # Grouped by the raw text: NULL and '' stay two rows that share one label.
    return led.groupBy("status_investasi").agg(F.count("*").alias("jumlah"))


def status_summary(led: DataFrame) -> DataFrame:
    return _ranked_status(led).select("status", "jumlah")


def _ranked_status(led: DataFrame) -> DataFrame:
    return (
        _status_counts(led)
        .withColumn("status", labels.or_label(F.col("status_investasi"), UNDETERMINED))
        .orderBy(F.col("jumlah").desc(), _by_name("status_investasi"))
    )


def status_top(led: DataFrame, n: int = 10) -> DataFrame:
    return _ranked_status(led).limit(n).select("status", "jumlah")


def type_distribution(led: DataFrame) -> DataFrame:
    return led.groupBy("type_investasi").agg(_count(), F.sum("rkap").alias("total_rkap"))


def type_distribution_nonnull(led: DataFrame) -> DataFrame:
    return (
        led.where(F.col("type_investasi").isNotNull())
        .groupBy("type_investasi")
        .agg(_count())
        .orderBy(F.col("project_count").desc(), "type_investasi")
    )


def issue_distribution(led: DataFrame) -> DataFrame:
    return led.groupBy("status_issue").agg(F.count("*").alias("issue_count"))


def issue_with_text(led: DataFrame) -> DataFrame:
    return issue_distribution(with_issue(led))


# ---- single figures ------------------------------------------------------------------------


def ledger_count(led: DataFrame) -> DataFrame:
    return led.agg(_count())


def kpi_totals(led: DataFrame) -> DataFrame:
    """Count, budget, actual and open issues with their warning colour."""
    return led.agg(
        _count(),
        F.sum("rkap").alias("total_rkap"),
        scaled(F.sum("rkap"), MILLION).alias("total_rkap_millions"),
        F.sum(row_total(led)).alias("total_realisasi"),
        _is_status("Open").alias("open_issues"),
    ).withColumn(
        "color",
        labels.band(F.col("open_issues"), labels.OPEN_ISSUE_BANDS, labels.OPEN_ISSUE_BASE),
    )


def kpi_overview(led: DataFrame) -> DataFrame:
    """Overview cards, figures and texts."""
    return (
        led.agg(
            _count(),
            zero_if_null(F.sum("rkap")).alias("total_rkap"),
            zero_if_null(F.sum(row_total(led))).alias("total_realisasi"),
            _is_status("Open").alias("open_issues"),
        )
        .withColumn("pct", ratio(F.col("total_realisasi"), F.col("total_rkap"), 100))
        .withColumns({
            "rkap_text": billions_text(F.col("total_rkap")),
            "realisasi_text": billions_text(F.col("total_realisasi")),
            "pct_text": percent_text(F.col("pct")),
        })
    )


def kpi_investment(led: DataFrame) -> DataFrame:
    """Investment cards, figures and texts."""
    sums = {"total_rkap": F.col("rkap"), "total_kebutuhan": F.col("kebutuhan_dana"),
            "total_realisasi": row_total(led)}
    return (
        led.agg(_count(), *(zero_if_null(F.sum(c)).alias(n) for n, c in sums.items()))
        .withColumn("cap", ratio(F.col("total_realisasi"), F.col("total_rkap"), 100))
        .withColumns({n.replace("total_", "") + "_text": millions_text(F.col(n)) for n in sums})
    )


def ytd_achievement(led: DataFrame, through_month: int = 10) -> DataFrame:
    """Budget share achieved through a month, rounded half-up, with its colour."""
    return (
        led.agg(
            F.sum(row_total(led, "realisasi", through_month)).alias("actual"),
            F.sum("rkap").alias("budget"),
        )
        .select(F.round(exact_percent(F.col("actual"), F.col("budget")), 2).alias("capaian"))
        .withColumn("color", labels.band(F.col("capaian"), labels.YTD_BANDS, labels.YTD_BASE))
    )


def ytd_actual(led: DataFrame, through_month: int = 10) -> DataFrame:
    total = F.sum(row_total(led, "realisasi", through_month))
    return led.agg(scaled(total, MILLION).alias("realisasi_millions"))


# ---- rankings and pages --------------------------------------------------------------------


def latest_page(led: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    return led.orderBy(*newest_first()).offset(offset).limit(limit)


def top_budget(led: DataFrame, n: int = 10) -> DataFrame:
    return (
        led.select("id_root", "project_definition", "klaster_regional", "rkap", "nilai_kontrak")
        .orderBy(F.col("rkap").desc_nulls_first(), F.col("id_root").asc_nulls_last())
        .limit(n)
    )


def first_by_id(led: DataFrame, n: int = 50) -> DataFrame:
    return (
        led.withColumn("total_realisasi", row_total(led))
        .select(
            "id_root", "klaster_regional", "entitas_terminal", "project_definition",
            "type_investasi", "status_issue", "rkap", "total_realisasi",
        )
        .orderBy(_by_name("id_root"))
        .limit(n)
    )
