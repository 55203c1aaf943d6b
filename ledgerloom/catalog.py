"""Every operator and report as a named query over the driver tables.

Each entry takes (spark, sf_dir) and returns a DataFrame over the whole tables. Outputs turn
decimals into doubles and times into zone-less stamps, so that results compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import money
from ledgerloom.operators import changes as ch
from ledgerloom.operators import compare, filters, quality, shape
from ledgerloom.operators.conform import conform, fill_defaults, strip_texts, with_totals
from ledgerloom.plans import load, reports, views
from ledgerloom.schema import (
    CONFORMED_LEDGER,
    MONTHLY,
    POINT_COLUMNS,
    TOTALS,
)
from ledgerloom.session import new_workspace
from ledgerloom.sources import feed as feeds
from ledgerloom.sources import fixture, tables
from ledgerloom.sources.store import LedgerStore
from ledgerloom.streaming import apply, summaries

Query = Callable[[SparkSession, str], DataFrame]
# The stamp the keyed updates write, and the moment that parts old rows from newly stamped ones.
STAMP = "2024-06-01 00:00:00"
LOADED_UNTIL = "1999-01-01 00:00:00"
KEPT_YEAR = 2000
# An id of the project alone, which up to a hundred ledger rows share; every seventh row of a group has none.
SHARED_ID = "CASE WHEN substring(id_root, 11, 2) <> '07' THEN substring(id_root, 1, 10) END"


def comparable(rows: DataFrame) -> DataFrame:
    def column(f: T.StructField) -> str:
        if isinstance(f.dataType, T.DecimalType):
            return f"CAST({f.name} AS DOUBLE) AS {f.name}"
        if isinstance(f.dataType, (T.TimestampType, T.DateType)):
            return f"CAST({f.name} AS TIMESTAMP_NTZ) AS {f.name}"
        return f.name

    return rows.selectExpr(*(column(f) for f in rows.schema.fields))


def _at(text: str, kind: str = "timestamp") -> Column:
    return F.lit(text).cast("timestamp_ntz").cast(kind)


def _on_source(report: Callable[..., DataFrame], **options) -> Query:
    """A report over the source ledger."""
    return lambda spark, sf: comparable(report(fixture.ledger(spark, sf), **options))


def _on_conformed(report: Callable[..., DataFrame], profile: str = "cli", **options) -> Query:
    """A report over the conformed ledger."""
    return lambda spark, sf: comparable(
        report(conform(fixture.ledger(spark, sf), profile), **options)
    )


def _read_partial(view: str, reader: Callable[[DataFrame], DataFrame]) -> Query:
    """A reader over a summary fed in two batches, which leave partial rows of the same keys."""

    def partial_rows(led: DataFrame) -> DataFrame:
        late = F.coalesce(F.col("updated_at") >= _at(LOADED_UNTIL), F.lit(True))
        return reader(views.VIEWS[view](led.where(~late)).unionByName(views.VIEWS[view](led.where(late))))

    return _on_conformed(partial_rows)


def _on_monitoring(report: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: comparable(
        report(fixture.monitoring(spark, sf), fixture.ledger(spark, sf))
    )


def _with_feed(report: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    """A keyed change over the source ledger and the change feed."""
    return lambda spark, sf: comparable(report(fixture.ledger(spark, sf), fixture.feed(spark, sf)))


# ---- reports -------------------------------------------------------------------------------

REPORTS: dict[str, Query] = {
    "regional_summary": _on_source(reports.regional_summary),
    "regional_summary_year": _on_source(reports.regional_summary, year=1996),
    "regional_summary_filled": _on_source(reports.regional_summary_filled),
    "regional_absorption": _on_source(reports.regional_absorption),
    "monthly_actuals": _on_source(reports.monthly_actuals),
    "monthly_trend": _on_source(reports.monthly_trend),
    "category_summary": _on_source(reports.category_summary),
    "category_achievement": _on_source(reports.category_achievement),
    "category_band": _on_source(reports.category_band),
    "status_summary": _on_source(reports.status_summary),
    "status_top10": _on_source(reports.status_top),
    "view_budget_actual": _on_conformed(views.budget_actual),
    "view_progress": _on_conformed(views.progress),
    "view_issues": _on_conformed(views.issues),
    "view_monthly": _on_conformed(views.monthly),
    "view_type": _on_conformed(views.investment_type),
    "read_budget_actual": _on_conformed(
        lambda led: views.read_budget_actual(views.budget_actual(led))
    ),
    "read_budget_actual_year": _on_conformed(
        lambda led: views.read_budget_actual(views.budget_actual(led), 1997)
    ),
    "read_progress": _on_conformed(lambda led: views.read_progress(views.progress(led))),
    "read_issues": _on_conformed(lambda led: views.read_issues(views.issues(led))),
    "read_monthly": _on_conformed(lambda led: views.read_monthly(views.monthly(led))),
    "read_type": _on_conformed(lambda led: views.read_investment_type(views.investment_type(led))),
    "read_budget_actual_partial": _read_partial("budget_actual", views.read_budget_actual),
    "read_progress_partial": _read_partial("progress", views.read_progress),
    "read_issues_partial": _read_partial("issues", views.read_issues),
    "read_monthly_partial": _read_partial("monthly", views.read_monthly),
    "read_type_partial": _read_partial("investment_type", views.read_investment_type),
    "ledger_count": _on_conformed(reports.ledger_count),
    "kpi_totals": _on_conformed(reports.kpi_totals),
    "kpi_overview": _on_source(reports.kpi_overview),
    "kpi_investment": _on_source(reports.kpi_investment),
    "region_budget_actual": _on_conformed(reports.region_budget_actual),
    "region_budget_actual_source": _on_source(reports.region_budget_actual),
    "type_distribution": _on_conformed(reports.type_distribution),
    "type_distribution_source": _on_source(reports.type_distribution),
    "type_distribution_nonnull": _on_source(reports.type_distribution_nonnull),
    "issue_distribution": _on_conformed(reports.issue_distribution),
    "issue_with_text": _on_source(reports.issue_with_text),
    "open_closed_totals": _on_source(reports.open_closed_totals),
    "ytd_achievement": _on_source(reports.ytd_achievement),
    "ytd_actual": _on_source(reports.ytd_actual),
    "category_budget_table": _on_source(reports.category_budget_table),
    "category_budget_footer": _on_source(reports.category_budget_footer),
    "s_curve": _on_source(reports.s_curve),
    "latest_page": _on_source(lambda led: reports.latest_page(shape.listing(led), 100, 100)),
    "top_budget": _on_source(reports.top_budget),
    "first_by_id": _on_conformed(reports.first_by_id),
}

# ---- shapes, filters, conforming -----------------------------------------------------------


def _filtered_listing(led: DataFrame) -> DataFrame:
    found = filters.search(led, region="ASIA", terminal="n_1", year=1996, issue_status="Open")
    return reports.latest_page(shape.listing(found), 20, 5)


def _detail(monitoring: DataFrame, led: DataFrame) -> DataFrame:
    return shape.detail(filters.by_keys(led, monitoring))


def _padded(led: DataFrame) -> DataFrame:
    pad = [F.concat(F.lit("\t "), F.col(c), F.lit("  \n")).alias(c)
           for c in ("entitas_terminal", "asset_categories", "status_investasi")]
    return strip_texts(led.select("id_root", *pad))


def _partial_rows(led: DataFrame) -> DataFrame:
    rows = led.select("id_root", "entitas_terminal", F.nullif("rkap", F.lit(0)).alias("rkap"))
    return fill_defaults(rows, _at(STAMP)).select(
        "id_root", "klaster_regional", "entitas_terminal", "tahun_rkap", "satuan_hari", "rkap",
        "kebutuhan_dana", "nilai_kontrak", "realisasi_januari", "updated_at",
        "metadata",
    )


def _format_money(led: DataFrame) -> DataFrame:
    budget = F.col("rkap")
    return led.select(
        "id_root",
        money.format_currency(budget).alias("currency"),
        money.format_currency(F.col("status_investasi")).alias("currency_of_text"),
        money.billions_text(budget).alias("billions"),
        money.millions_text(budget).alias("millions"),
        money.listing_text(budget).alias("listing"),
        F.substring("project_definition", 1, 10).alias("short_definition"),
    )


def _format_pct(led: DataFrame) -> DataFrame:
    actual = money.row_total(led)
    return led.select(
        "id_root",
        money.format_percentage(actual, F.col("rkap")).alias("of_budget"),
        money.format_percentage(F.col("asset_categories"), F.col("rkap")).alias("of_text"),
    )


SHAPES: dict[str, Query] = {
    "filtered_listing": _on_source(_filtered_listing),
    "listing_texts": _on_source(shape.listing_texts),
    "facet_filter": _on_source(
        filters.facet_filter, klaster_regional="EUROPE", type_investasi="Murni", status_issue=""
    ),
    "facet_values": _on_source(filters.facet_values),
    "filtered_count": _on_source(
        lambda led: reports.ledger_count(
            filters.equal_to(led, klaster_regional="ASIA", status_issue="Open", pic=None)
        )
    ),
    "enriched_listing": _on_source(shape.enriched),
    "enriched_listing_ordered": _on_source(shape.enriched, ordered=True),
    "map_points": _on_source(shape.map_points),
    "project_detail": _on_monitoring(_detail),
    "conform_cli": _on_source(conform),
    "conform_daemon": _on_source(conform, profile="daemon"),
    "computed_totals": _on_source(
        lambda led: with_totals(led).select("id_root", *TOTALS.values())
    ),
    "default_fill": _on_source(_partial_rows),
    "stripped_texts": _on_source(_padded),
    "format_money": _on_source(_format_money),
    "format_pct": _on_source(_format_pct),
}

# ---- keyed changes -------------------------------------------------------------------------


def _insert_outcomes(led: DataFrame) -> DataFrame:
    """As the insert, with some ids gone and some rows sent twice: what becomes of every row."""
    number = F.expr("CAST(split_part(id_root, '-', 2) AS BIGINT)")
    incoming = led.where(F.col("tahun_rkap") >= 1997).withColumn("id_root", F.when(number % 30 != 7, F.col("id_root")))
    sent = incoming.unionByName(incoming.where(number % 30 == 8))
    marked = ch.mark_inserts(led.where(F.col("tahun_rkap") <= 1997), sent)
    return marked.groupBy("tahun_rkap", "outcome").agg(F.count("*").alias("sent_rows"), F.countDistinct("id_root").alias("ids"))


def _upsert_outcomes(led: DataFrame) -> DataFrame:
    """Rows sent with a later, the same or an earlier stamp, or new to the books."""
    number = F.expr("CAST(split_part(id_root, '-', 2) AS BIGINT)")
    shift = (number % 3 - 1).cast("int")
    sent = led.withColumn("updated_at", F.col("updated_at") + F.make_dt_interval(shift))
    marked = ch.mark_upserts(led.where(F.col("tahun_rkap") <= 1997), sent)
    return marked.select("id_root", "outcome")


def _deleted(feed: DataFrame) -> DataFrame:
    return ch.last_operation(feed).where(F.col("operation") == "DELETE")


def _insert_parts(led: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Years up to 1997 are on the books; 1997 and later come in, so 1997 is refused."""
    books = led.where(F.col("tahun_rkap") <= 1997)
    return ch.insert_rows(books, led.where(F.col("tahun_rkap") >= 1997))


def _update_changes(feed: DataFrame) -> DataFrame:
    text = F.col("seq").cast("string")
    operation = F.col("operation")
    return feed.select(
        "id_root", "timestamp", "seq",
        F.when(F.col("seq") % 4 != 0, F.concat(F.lit("pic-"), text)).alias("pic"),
        (F.col("seq") % 365).cast("int").alias("jangka_waktu"),
        F.concat(F.lit("upd "), text).alias("issue_description"),
        F.when(operation == "INSERT", F.array(F.lit("pic"), F.lit("issue_description")))
        .when(operation == "UPDATE", F.array(F.lit("pic"), F.lit("jangka_waktu")))
        .otherwise(F.array().cast("array<string>"))
        .alias("set_columns"),
    )


def _progress_changes(feed: DataFrame) -> DataFrame:
    text = F.col("seq").cast("string")
    return feed.select(
        "id_root", "timestamp", "seq",
        F.when(F.col("seq") % 3 != 0, F.concat(F.lit("prog "), text)).alias("progres_description"),
        F.when(F.col("seq") % 2 != 0, F.concat(F.lit("act "), text)).alias("action_target"),
        F.when(F.col("operation") == "INSERT", "Open")
        .when(F.col("seq") % 5 == 0, "Closed")
        .when(F.col("seq") % 5 == 1, "Pending")
        .alias("status_issue"),
    )


def _set_months(kind: str) -> Query:
    return _with_feed(
        lambda led, feed: ch.set_months(led, feed, kind, _at(STAMP)).select(
            "id_root", *MONTHLY[kind], "updated_at"
        )
    )


def _upsert(led: DataFrame) -> DataFrame:
    """Every row comes in again with its stamp moved by -360 to +330 days."""
    current = conform(led)
    days = F.col("jangka_waktu") - 360
    again = current.withColumn("pic", F.lit("re-synced")).withColumn(
        "updated_at", F.timestamp_add("DAY", days, F.col("updated_at"))
    )
    return ch.upsert(current, again).select("id_root", "tahun_rkap", "rkap", "pic", "updated_at")


def _upsert_new_keys(led: DataFrame) -> DataFrame:
    """Years up to 1997 are on the books; 1996 and later come in twice, re-stamped, so some keys are new and all repeat."""
    current = conform(led)
    again = current.where(F.col("tahun_rkap") >= 1996)
    versions = [
        again.withColumn("pic", F.lit(name)).withColumn("updated_at", F.timestamp_add("DAY", F.lit(days), F.col("updated_at")))
        for name, days in (("first", -30), ("second", 30))
    ]
    merged = ch.upsert(current.where(F.col("tahun_rkap") <= 1997), versions[0].unionByName(versions[1]))
    return merged.select("id_root", "tahun_rkap", "rkap", "pic", "updated_at")


def _change_rejects(led: DataFrame, feed: DataFrame) -> DataFrame:
    """Monthly changes to the books' years, every fiftieth without an id."""
    key = F.when(F.col("seq") % 50 != 0, F.col("id_root"))
    books = led.where(F.col("tahun_rkap") <= KEPT_YEAR)
    refused = ch.refused_changes(books, feed.withColumn("id_root", key), ch.bad_month(), "bad_month")
    return refused.select("id_root", "seq", "reason")


def _changed_ledger(led: DataFrame, feed: DataFrame) -> DataFrame:
    """The source after the feed: monthly actuals set, deleted projects gone."""
    return ch.delete_keys(ch.set_months(led, feed, "realisasi", _at(STAMP)), _deleted(feed))


def _diff_pair(led: DataFrame, feed: DataFrame) -> tuple[DataFrame, DataFrame]:
    return led.where(F.col("tahun_rkap") <= KEPT_YEAR), _changed_ledger(led, feed)


def _snapshot_diff(led: DataFrame, feed: DataFrame) -> DataFrame:
    old, new = _diff_pair(led, feed)
    events = compare.change_events(old, new, _at(STAMP))
    sent = F.get_json_object("payload", "$.id_root")
    return events.select("id_root", "operation", sent.alias("sent_id"))


def _renames(feed: DataFrame) -> DataFrame:
    inserted = ch.last_operation(feed).where(F.col("operation") == "INSERT")
    return inserted.select(
        F.col("id_root").alias("old_id"), F.concat(F.lit("REN-"), "id_root").alias("new_id")
    )


def _on_feed(report: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: comparable(report(fixture.feed(spark, sf)))


def _asked_renames(led: DataFrame) -> DataFrame:
    """Renames of every kind by the project's number: plain ones, chains, swaps, shared and taken names, ids that are not there."""
    number = "CAST(split_part(id_root, '-', 2) AS BIGINT)"
    after, before = fixture.project_id(f"({number} + 1)"), fixture.project_id(f"({number} - 1)")
    kinds = [
        ("0, 5", "id_root", "concat('NEW-', id_root)"), ("1", "id_root", "concat('X-', id_root)"), ("1", "id_root", "concat('Y-', id_root)"),
        ("2", "id_root", f"concat('SHARED-', CAST({number} DIV 100 AS STRING))"), ("4, 6, 8, 10, 11, 12", "id_root", after),
        ("9", "id_root", before), ("14", "id_root", "''"), ("15", "concat('GHOST-', id_root)", "concat('Z-', id_root)"),
        ("16", "id_root", "id_root"), ("17", "CAST(NULL AS STRING)", "id_root"),
    ]
    asked = ", ".join(f"CASE WHEN {number} % 20 IN ({k}) THEN struct({old} AS old_id, {new} AS new_id) END" for k, old, new in kinds)
    return led.selectExpr(f"explode(array({asked})) AS asked").where("asked IS NOT NULL").select("asked.*")


def _renamed_ledger(led: DataFrame) -> DataFrame:
    renames = ch.followed(ch.rename_outcomes(led, _asked_renames(led)))
    return ch.cascade_rename(led.select("id_root", "tahun_rkap"), renames)


def _children(report: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: comparable(
        report(fixture.monitoring(spark, sf), fixture.feed(spark, sf)).select(
            "id", "id_root", "status_monitoring"
        )
    )


def _dedup(feed: DataFrame) -> DataFrame:
    versions = feed.select("id_root", F.col("timestamp").alias("updated_at"), "seq", "nilai")
    return ch.dedup_latest(versions, seq="seq")


CHANGES: dict[str, Query] = {
    "dedup_latest": _on_feed(_dedup),
    "last_operation": _on_feed(
        lambda f: ch.last_operation(f).select("id_root", "operation", "timestamp", "seq")
    ),
    "insert_rows": _on_source(
        lambda led: _insert_parts(led)[0].select("id_root", "tahun_rkap", "type_investasi", "rkap")
    ),
    "insert_outcomes": _on_source(_insert_outcomes),
    "upsert_outcomes": _on_source(_upsert_outcomes),
    "insert_rejects": _on_source(lambda led: _insert_parts(led)[1]),
    "partial_update": _with_feed(
        lambda led, feed: ch.partial_update(
            led, _update_changes(feed), ["pic", "jangka_waktu", "issue_description"], _at(STAMP)
        ).select("id_root", "pic", "jangka_waktu", "issue_description", "updated_at")
    ),
    "progress_update": _with_feed(
        lambda led, feed: ch.update_progress(led, _progress_changes(feed), _at(STAMP)).select(
            "id_root", "progres_description", "action_target", "status_issue", "updated_at"
        )
    ),
    "progress_rejects": _on_feed(
        lambda f: ch.progress_rejects(_progress_changes(f)).select("id_root", "seq", "status_issue")
    ),
    "set_actual": _set_months("realisasi"),
    "set_forecast": _set_months("prognosa"),
    "set_budget": _set_months("rkap"),
    "month_rejects": _on_feed(lambda f: ch.month_rejects(f).select("id_root", "seq", "bulan")),
    "delete_keys": _with_feed(
        lambda led, feed: shape.listing(ch.delete_keys(led, _deleted(feed)))
    ),
    "change_rejects": _with_feed(_change_rejects),
    "upsert": _on_source(_upsert),
    "upsert_new_keys": _on_source(_upsert_new_keys),
    "snapshot_diff": _with_feed(_snapshot_diff),
    "monitoring_orphans": _on_monitoring(
        lambda mon, led: ch.orphans(mon, led).select("id", "id_root")
    ),
    "cascade_delete": _children(lambda mon, feed: ch.cascade_delete(mon, _deleted(feed))),
    "rename_outcomes": _on_source(lambda led: ch.rename_outcomes(led, _asked_renames(led))),
    "renamed_ledger": _on_source(_renamed_ledger),
    "cascade_rename": _children(lambda mon, feed: ch.cascade_rename(mon, _renames(feed))),
}

# ---- quality -------------------------------------------------------------------------------


def _sync_counts(led: DataFrame, feed: DataFrame) -> DataFrame:
    old, new = _diff_pair(led, feed)
    return compare.sync_counts(new, old)


def _sync_diff(led: DataFrame, feed: DataFrame) -> DataFrame:
    old, new = _diff_pair(led, feed)
    return compare.sync_diff(conform(new), conform(old))


def _validate_newest(led: DataFrame) -> DataFrame:
    """The checking command's default: the newest 100 projects, looked up in full."""
    newest = reports.latest_page(shape.listing(led), 100)
    return quality.report(filters.by_keys(led, newest))


QUALITY: dict[str, Query] = {
    "quality_issues": _on_source(lambda led: quality.issues(led).drop("updated_at")),
    "quality_validate": _on_source(
        lambda led: quality.validate(led).select("id_root", "is_valid", "finding_count")
    ),
    "quality_report": _on_source(quality.report),
    "quality_report_lines": _on_source(quality.first_issues),
    "quality_newest": _on_source(_validate_newest),
    "quality_ledger_constraints": _on_source(quality.ledger_violations),
    "quality_ledger_constraint_counts": _on_source(
        lambda led: quality.violation_counts(quality.ledger_violations(led))
    ),
    "quality_ledger_duplicates": _on_source(
        lambda led: quality.ledger_violations(led.withColumn("id_root", F.expr(SHARED_ID)))
    ),
    "monitoring_constraints": _on_monitoring(quality.monitoring_violations),
    "sync_counts": _with_feed(_sync_counts),
    "sync_diff": _with_feed(_sync_diff),
}

# ---- loads and streams ---------------------------------------------------------------------

LOADED_COLUMNS = [
    "id_root", "klaster_regional", "entitas_terminal", "tahun_rkap", "type_investasi", "rkap",
    *TOTALS.values(), *POINT_COLUMNS, "updated_at",
]


def _loaded(store: LedgerStore) -> DataFrame:
    return comparable(store.read().select(*LOADED_COLUMNS))


def full_load(spark: SparkSession, sf: str) -> DataFrame:
    store = LedgerStore(spark, new_workspace(spark, "full"))
    load.load(store, fixture.ledger(spark, sf), full=True)
    return _loaded(store)


def incremental_load(spark: SparkSession, sf: str) -> DataFrame:
    """Load what was stamped up to a moment, then the rest by watermark, deletions included."""
    store = LedgerStore(spark, new_workspace(spark, "incremental"))
    source = fixture.ledger(spark, sf)
    load.load(store, source.where(F.col("updated_at") <= _at(LOADED_UNTIL)))
    load.load(store, source, deleted_keys=_deleted(fixture.feed(spark, sf)))
    return _loaded(store)


def changed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """What was stamped after a moment, from a source that is written in the order of its stamps."""
    path = f"{new_workspace(spark, 'by-time')}/source"
    tables.write_by_time(fixture.ledger(spark, sf), path)
    changed = tables.changed_since(tables.read_ledger(spark, path), _at(LOADED_UNTIL))
    return comparable(changed.select("id_root", "rkap", "updated_at"))


def compacted_load(spark: SparkSession, sf: str) -> DataFrame:
    """As the incremental load, with the change batches folded in."""
    store = LedgerStore(spark, new_workspace(spark, "compacted"))
    source = fixture.ledger(spark, sf)
    load.load(store, source.where(F.col("updated_at") <= _at(LOADED_UNTIL)))
    load.load(store, source, deleted_keys=_deleted(fixture.feed(spark, sf)))
    store.compact()
    return _loaded(store)


def stored_year_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A report of one year from the stored ledger: prunes to that year's partition."""
    store = LedgerStore(spark, new_workspace(spark, "stored"))
    load.load(store, fixture.ledger(spark, sf), full=True)
    return comparable(reports.regional_summary(store.read(), 1998))


def _payloads(events: DataFrame, unit: str = "MICROSECOND", **beside: Column) -> DataFrame:
    """Event rows as JSON texts, their stamps cut to a unit; some views are cut short, some clicks lack an id.

    Columns given by name are kept ``beside`` them.
    """
    whole = feeds.payload(F.col("operation"), F.col("id_root"), F.date_trunc(unit, F.col("timestamp")))
    anonymous = F.to_json(F.struct("operation"))
    kind, number = F.col("event_type"), F.col("event_id")
    text = (
        F.when((kind == "view") & (number % 10 == 0), F.substring(whole, 1, 25))
        .when((kind == "click") & (number % 10 == 1), anonymous)
        .otherwise(whole)
    )
    kept = {name: column.alias(name) for name, column in beside.items()}
    return events.select("event_type", "event_id", *fixture.feed_columns(), *kept.values()).select(
        text.alias("payload"), "seq", *kept
    )


def _payload_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = fixture.table(spark, sf, "events").schema
    events = (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    )
    return _payloads(events)


def _good_feed(spark: SparkSession, sf: str) -> DataFrame:
    """The change feed without the events whose payloads arrive broken."""
    events = fixture.table(spark, sf, "events")
    # The row goes along with its payload, so that the feed is read once and nothing is joined.
    sent = _payloads(events, row=F.struct(*fixture.feed_columns())).where("seq IS NOT NULL")
    return feeds.good(feeds.parse(sent)).select("row.*")


def _run(query) -> None:
    try:
        query.awaitTermination()
    finally:
        query.stop()


def _tail(spark: SparkSession, sf: str, store: LedgerStore, root: str, events: DataFrame | None = None) -> None:
    """Follow the feed to its end, with a checkpoint of its own under ``root``."""

    def read_source() -> DataFrame:
        return _changed_ledger(fixture.ledger(spark, sf), _good_feed(spark, sf))

    _run(
        apply.start_apply(
            store, _payload_stream(spark, sf) if events is None else events, read_source, f"{root}/checkpoint",
            rejects_path=f"{root}/rejects", trigger={"availableNow": True},
        )
    )


def stream_apply(spark: SparkSession, sf: str) -> DataFrame:
    """The stored ledger after the feed was followed to its end."""
    root = new_workspace(spark, "apply")
    store = LedgerStore(spark, f"{root}/store")
    load.full_load(store, fixture.ledger(spark, sf), "daemon")
    _tail(spark, sf, store, root)
    return _loaded(store)


def stream_ties(spark: SparkSession, sf: str) -> DataFrame:
    """As ``stream_apply`` over several micro-batches, with one stamp for all of a month's events, in any order."""
    root = new_workspace(spark, "ties")
    store = LedgerStore(spark, f"{root}/store")
    load.full_load(store, fixture.ledger(spark, sf), "daemon")
    events = _payloads(fixture.table(spark, sf, "events"), "MONTH")
    by_id = events.repartitionByRange(4, F.coalesce(F.get_json_object("payload", "$.id_root"), F.lit("")))
    by_id.select("payload").write.text(f"{root}/in")
    _tail(spark, sf, store, root, feeds.text_stream(spark, f"{root}/in", maxFilesPerTrigger="1"))
    return _loaded(store)


def mixed_writers(spark: SparkSession, sf: str) -> DataFrame:
    """Sync, stream, sync, full load and a stream with a new checkpoint, by turns: the source after the feed."""
    root = new_workspace(spark, "mixed")
    store = LedgerStore(spark, f"{root}/store")
    led = fixture.ledger(spark, sf)
    final = _changed_ledger(led, _good_feed(spark, sf))
    load.load(store, led.where(F.col("updated_at") <= _at(LOADED_UNTIL)), profile="daemon")
    _tail(spark, sf, store, f"{root}/first")
    load.load(store, final, profile="daemon")
    load.load(store, led, full=True, profile="daemon")
    _tail(spark, sf, store, f"{root}/second")
    return _loaded(store)


def stream_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """The payloads the stream skipped, with the reason."""
    root = new_workspace(spark, "rejects")

    def keep(payloads: DataFrame, batch: int) -> None:
        skipped = feeds.rejects(feeds.parse(payloads))
        skipped.write.mode("overwrite").parquet(f"{root}/out/batch={batch}")

    _run(
        _payload_stream(spark, sf).writeStream.foreachBatch(keep)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True).start()
    )
    return spark.read.parquet(f"{root}/out").select("seq", "reason")


def stream_skipped_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Skipped payloads by reason, as the stream's progress counts them and as its default table holds them."""
    root = new_workspace(spark, "skipped")
    store = LedgerStore(spark, f"{root}/store")
    load.full_load(store, fixture.ledger(spark, sf).where(F.col("tahun_rkap") == KEPT_YEAR), "daemon", allow_empty=True)
    query = apply.start_apply(
        store, _payload_stream(spark, sf), lambda: fixture.ledger(spark, sf), f"{root}/checkpoint", trigger={"availableNow": True}
    )
    _run(query)
    seen = spark.createDataFrame(list(apply.observed_counts(query).items()), "reason string, observed long")
    kept = apply.read_skipped(store).groupBy("reason").agg(F.count("*").alias("kept"))
    return seen.where("reason <> 'payloads'").join(kept, "reason", "full_outer")


def _moments(spark: SparkSession, sf: str, drops: int) -> list:
    """Moments that part the feed into drops of about equal size; events of one moment stay together."""
    shares = ", ".join(str(k / drops) for k in range(1, drops))
    return fixture.table(spark, sf, "events").selectExpr(f"percentile_approx(ts, array({shares})) AS at").first()["at"]


def _in_drops(spark: SparkSession, sf: str, moments: list) -> list[DataFrame]:
    """The feed's payloads in the order of time, parted behind each moment."""
    events = fixture.table(spark, sf, "events")
    number = sum((F.col("ts") > F.lit(at)).cast("int") for at in moments)
    return [_payloads(events.where(number == k)).select("payload") for k in range(len(moments) + 1)]


def snapshot_tail(spark: SparkSession, sf: str) -> DataFrame:
    """A snapshot during which half of the feed's changes land, then the tail: the source after the feed.

    The snapshot reads the source as it is before those changes; the tail must bring them, and need not bring what the
    feed held before.
    """
    root = new_workspace(spark, "position")
    store = LedgerStore(spark, f"{root}/store")
    led, good = fixture.ledger(spark, sf), _good_feed(spark, sf)
    moments = _moments(spark, sf, 2)
    early, late = _in_drops(spark, sf, moments)
    early.write.mode("append").text(f"{root}/in")
    reads: list[int] = []

    def read_source() -> DataFrame:
        reads.append(1)
        if len(reads) > 1:
            return _changed_ledger(led, good)
        late.write.mode("append").text(f"{root}/in")
        return _changed_ledger(led, good.where(F.col("timestamp") <= F.lit(moments[0])))

    _run(
        apply.snapshot_then_tail(
            store, feeds.text_stream(spark, f"{root}/in"), read_source, f"{root}/checkpoint", trigger={"availableNow": True}
        )
    )
    return _loaded(store)


def stream_clock(spark: SparkSession, sf: str) -> DataFrame:
    """The feed followed on the one-second clock while it comes in several drops, then a clean stop: the source after the feed."""
    root = new_workspace(spark, "clock")
    store = LedgerStore(spark, f"{root}/store")
    led = fixture.ledger(spark, sf)
    final = _changed_ledger(led, _good_feed(spark, sf))
    load.full_load(store, led, "daemon")
    first, *others = _in_drops(spark, sf, _moments(spark, sf, 3))
    first.write.mode("append").text(f"{root}/in")
    query = apply.start_apply(store, feeds.text_stream(spark, f"{root}/in"), lambda: final, f"{root}/checkpoint")
    try:
        for drop in others:
            query.processAllAvailable()
            drop.write.mode("append").text(f"{root}/in")
    finally:
        apply.finish(query)
    return _loaded(store)


def published_reports(spark: SparkSession, sf: str) -> DataFrame:
    """What readers have while the second publication is being written, and after it: all reports of one ledger each time."""
    root = new_workspace(spark, "published")
    led = conform(fixture.ledger(spark, sf))
    seen: list[DataFrame] = []

    def reading(moment: str) -> DataFrame:
        number = summaries.published(spark, root)
        totals, types = (summaries.read_published(spark, root, name, number) for name in ("totals", "types"))
        return totals.select(
            F.lit(moment).alias("moment"), F.lit("all").alias("type_investasi"), "project_count", "total_rkap"
        ).unionByName(types.select(F.lit(moment).alias("moment"), "type_investasi", "project_count", "total_rkap"))

    def totals(rows: DataFrame) -> DataFrame:
        return rows.agg(F.count("*").alias("project_count"), F.sum("rkap").alias("total_rkap"))

    def types(rows: DataFrame) -> DataFrame:
        # The first report of this publication is written by now.
        if summaries.published(spark, root) is not None:
            seen.append(reading("during"))
        return rows.groupBy("type_investasi").agg(F.count("*").alias("project_count"), F.sum("rkap").alias("total_rkap"))

    reports_ = {"totals": totals, "types": types}
    summaries.publish(led.where(F.col("tahun_rkap") <= 1996), reports_, root)
    summaries.publish(led, reports_, root)
    return comparable(seen[0].unionByName(reading("after")))


# What the insert-fed views read of a ledger row.
SUMMARY_INPUTS = {
    "budget_actual": ["tahun_rkap", "klaster_regional", "rkap", "total_realisasi", "nilai_kontrak"],
    "progress": ["tahun_rkap", "klaster_regional", "entitas_terminal", "status_investasi"],
    "issues": ["tahun_rkap", "klaster_regional", "status_issue", "issue_description"],
    "monthly": ["tahun_rkap", "klaster_regional", *MONTHLY["realisasi"]],
    "investment_type": ["tahun_rkap", "type_investasi", "rkap", "nilai_kontrak"],
}


def _stream_summary(view: str) -> Query:
    """An insert-fed view over several micro-batches: every row once, and the re-synced rows once more."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        root = new_workspace(spark, "summary")
        led, feed = fixture.ledger(spark, sf), fixture.feed(spark, sf)
        resynced = filters.by_keys(
            _changed_ledger(led, feed),
            ch.last_operation(feed).where(F.col("operation") != "DELETE"),
        )
        columns = SUMMARY_INPUTS[view]
        for part in (led, resynced):
            conform(part, "daemon").select(columns).repartition(2).write.mode("append").parquet(f"{root}/inserts")
        schema = T.StructType([f for f in CONFORMED_LEDGER.fields if f.name in columns])
        inserted = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/inserts")
        _run(
            summaries.start_summary(
                inserted, view, f"{root}/out", f"{root}/checkpoint", {"availableNow": True}, fold_every=2
            )
        )
        return comparable(views.merged(summaries.read_summary(spark, f"{root}/out", view), view))

    return run


LOADS: dict[str, Query] = {
    "full_load": full_load,
    "incremental_load": incremental_load,
    "compacted_load": compacted_load,
    "changed_rows": changed_rows,
    "stored_year_summary": stored_year_summary,
    "stream_apply": stream_apply,
    "stream_rejects": stream_rejects,
    "stream_ties": stream_ties,
    "mixed_writers": mixed_writers,
    "stream_skipped_counts": stream_skipped_counts,
    "snapshot_tail": snapshot_tail,
    "stream_clock": stream_clock,
    "published_reports": published_reports,
    "stream_summary": _stream_summary("budget_actual"),
    **{f"stream_summary_{view}": _stream_summary(view) for view in SUMMARY_INPUTS if view != "budget_actual"},
}

QUERIES: dict[str, Query] = {**REPORTS, **SHAPES, **CHANGES, **QUALITY, **LOADS}
