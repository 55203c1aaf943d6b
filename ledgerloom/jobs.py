"""Jobs to submit: load, verify, report on, check and change a ledger.

    spark-submit -m … or: python -m ledgerloom.jobs <job> …

``--source`` is a source ledger (any file format Spark reads), ``--store`` the folder of the
analytics store. Jobs that change the source ledger read a table of changes and write the next
ledger to ``--out``; they never overwrite what they read.
"""

from __future__ import annotations

import argparse
import signal
import threading
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.operators import changes as ch
from ledgerloom.operators import compare, filters, quality, shape
from ledgerloom.operators.conform import fill_defaults, strip_texts
from ledgerloom.plans import load, reports, views
from ledgerloom.session import prepare
from ledgerloom.sources import feed, tables
from ledgerloom.sources.store import LedgerStore
from ledgerloom.streaming import apply, summaries

# Reports by name, over the source ledger and over the stored one.
SOURCE_REPORTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    f.__name__.replace("_", "-"): f
    for f in (
        reports.regional_summary_filled, reports.monthly_actuals, reports.monthly_trend,
        reports.category_summary, reports.category_achievement, reports.category_band,
        reports.category_budget_table, reports.category_budget_footer, reports.status_summary,
        reports.status_top, reports.kpi_overview, reports.kpi_investment, reports.ytd_achievement,
        reports.ytd_actual, reports.open_closed_totals, reports.issue_with_text,
        reports.type_distribution_nonnull, reports.top_budget, reports.s_curve,
        filters.facet_values, shape.map_points,
    )
}
STORE_REPORTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "count": reports.ledger_count,
    "kpi-totals": reports.kpi_totals,
    "region-budget-actual": reports.region_budget_actual,
    "type-distribution": reports.type_distribution,
    "issue-distribution": reports.issue_distribution,
    "first-by-id": reports.first_by_id,
    "budget-actual": lambda led: views.read_budget_actual(views.budget_actual(led)),
    "progress": views.progress,
    "issues": lambda led: views.read_issues(views.issues(led)),
    "monthly": views.monthly,
    "investment-type": lambda led: views.read_investment_type(views.investment_type(led)),
}


def _source(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    return tables.read_ledger(spark, args.source, args.format)


def _store(spark: SparkSession, args: argparse.Namespace) -> LedgerStore:
    return LedgerStore(spark, args.store)


def _changes(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    return spark.read.parquet(args.changes)


def _show(result: DataFrame, most: int = 1000) -> None:
    """Print a report, and say how many rows the print leaves out."""
    result.show(most, truncate=False)
    if (rows := result.count()) > most:
        print(f"{rows - most} more rows; give --out to write them all")


def sync(spark: SparkSession, args: argparse.Namespace) -> None:
    deleted = spark.read.parquet(args.deleted) if args.deleted else None
    result = load.load(_store(spark, args), _source(spark, args), args.full, deleted_keys=deleted)
    print(f"{result.rows} projects loaded, newest stamp {result.watermark}")


def verify(spark: SparkSession, args: argparse.Namespace) -> None:
    store, source = _store(spark, args), _source(spark, args)
    load.verify_counts(store, source).show()
    load.verify_rows(store, source).groupBy("state").count().show()


def validate(spark: SparkSession, args: argparse.Namespace) -> None:
    led = _source(spark, args)
    if args.limit:
        led = filters.by_keys(led, reports.latest_page(shape.listing(led), args.limit))
    quality.report(led).show()
    quality.first_issues(led).show(50, truncate=False)


def summary(spark: SparkSession, args: argparse.Namespace) -> None:
    _show(reports.regional_absorption(_source(spark, args), args.year))


def listing(spark: SparkSession, args: argparse.Namespace) -> None:
    found = filters.search(_source(spark, args), args.region, args.terminal, args.year, args.status)
    shape.listing_texts(reports.latest_page(found, args.limit, args.offset)).show(
        args.limit, truncate=False
    )


def detail(spark: SparkSession, args: argparse.Namespace) -> None:
    keys = spark.createDataFrame([(k,) for k in args.ids], "id_root string")
    shape.detail(filters.by_keys(_source(spark, args), keys)).show(
        len(args.ids), truncate=False, vertical=True
    )


def report(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.name in STORE_REPORTS:
        result = STORE_REPORTS[args.name](filters.for_year(_store(spark, args).read(), args.year))
    else:
        result = SOURCE_REPORTS[args.name](filters.for_year(_source(spark, args), args.year))
    if args.out:
        result.write.mode("overwrite").parquet(args.out)
    else:
        _show(result)


def change(spark: SparkSession, args: argparse.Namespace) -> None:
    led, changes = _source(spark, args), _changes(spark, args)
    refused = ch.refused_changes(led, changes)
    if args.kind == "insert":
        after, refused = ch.insert_rows(led, strip_texts(fill_defaults(changes)))
    elif args.kind == "delete":
        after = ch.delete_keys(led, changes)
    elif args.kind == "update":
        named = [c for c in led.columns if c in changes.columns and c not in ("id_root", "updated_at")]
        after = ch.partial_update(led, changes, named)
    elif args.kind == "progress":
        after = ch.update_progress(led, changes)
        if "status_issue" in changes.columns:
            refused = ch.refused_changes(led, changes, ch.bad_status(), "bad_status")
    else:
        after = ch.set_months(led, changes, args.kind)
        refused = ch.refused_changes(led, changes, ch.bad_month(), "bad_month")
    after.write.mode("errorifexists").parquet(args.out)
    path = args.rejects or f"{args.out}-refused"
    refused.write.mode("errorifexists").parquet(path)
    print(f"{spark.read.schema(refused.schema).parquet(path).count()} changes refused, see {path}")
    if args.feed:
        written = tables.read_ledger(spark, args.out)
        compare.change_events(led, written).select("payload").write.mode("append").text(args.feed)


def _stop_request() -> threading.Event:
    """Set when the process is asked to end."""
    stopping = threading.Event()
    if threading.current_thread() is threading.main_thread():
        for name in (signal.SIGTERM, signal.SIGINT):
            signal.signal(name, lambda *_: stopping.set())
    return stopping


def follow(spark: SparkSession, args: argparse.Namespace) -> None:
    store = _store(spark, args)
    query = apply.snapshot_then_tail(
        store,
        feed.text_stream(spark, args.feed),
        lambda: _source(spark, args),
        args.checkpoint,
        rejects_path=args.rejects,
        trigger={"processingTime": args.every},
        compact_every=args.compact_every,
    )
    beside = []
    if args.reports:
        clock = f"{args.checkpoint}-reports"
        beside.append(summaries.start_refresh(spark, store.look, STORE_REPORTS, args.reports, clock, args.refresh))
    apply.run_until(query, _stop_request(), beside)
    print("payloads:", apply.observed_counts(query))


def refresh(spark: SparkSession, args: argparse.Namespace) -> None:
    store = _store(spark, args)
    query = summaries.start_refresh(
        spark, store.look, STORE_REPORTS, args.out, args.checkpoint, args.every
    )
    query.awaitTermination()


def compact(spark: SparkSession, args: argparse.Namespace) -> None:
    print("years rewritten:", _store(spark, args).compact())


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="ledgerloom")
    jobs = top.add_subparsers(dest="job", required=True)

    def job(run: Callable, source: bool = True, store: bool = False) -> argparse.ArgumentParser:
        sub = jobs.add_parser(run.__name__)
        sub.set_defaults(run=run)
        if source:
            sub.add_argument("--source", required=True)
            sub.add_argument("--format", default="parquet")
        if store:
            sub.add_argument("--store", required=True)
        return sub

    sub = job(sync, store=True)
    sub.add_argument("--full", action="store_true")
    sub.add_argument("--deleted", help="table of id_root that left the source")
    job(verify, store=True)
    sub = job(validate)
    sub.add_argument("--limit", type=int, default=0, help="newest projects only; 0 checks all")
    sub = job(summary)
    sub.add_argument("--year", type=int)
    sub = job(listing)
    for name in ("region", "terminal", "status"):
        sub.add_argument(f"--{name}")
    sub.add_argument("--year", type=int)
    sub.add_argument("--limit", type=int, default=20)
    sub.add_argument("--offset", type=int, default=0)
    sub = job(detail)
    sub.add_argument("ids", nargs="+")
    sub = jobs.add_parser("report")
    sub.set_defaults(run=report)
    sub.add_argument("name", choices=sorted({*SOURCE_REPORTS, *STORE_REPORTS}))
    sub.add_argument("--source")
    sub.add_argument("--format", default="parquet")
    sub.add_argument("--store")
    sub.add_argument("--year", type=int)
    sub.add_argument("--out")
    sub = job(change)
    kinds = ("insert", "update", "progress", "delete", "rkap", "realisasi", "prognosa")
    sub.add_argument("kind", choices=kinds)
    sub.add_argument("--changes", required=True)
    sub.add_argument("--out", required=True)
    sub.add_argument("--feed", help="folder to append the change events to")
    sub.add_argument("--rejects", help="table of the refused changes; beside --out by default")
    sub = job(follow, store=True)
    sub.add_argument("--feed", required=True)
    sub.add_argument("--checkpoint", required=True)
    sub.add_argument("--rejects", help="folder of the skipped payloads; in the store by default")
    sub.add_argument("--reports", help="folder to publish the store's reports to")
    sub.add_argument("--refresh", default="30 seconds", help="how often reports are published, if the ledger has changed")
    sub.add_argument("--every", default="1 second")
    sub.add_argument("--compact-every", type=int, default=100, help="change batches; 0 never")
    sub = job(refresh, source=False, store=True)
    sub.add_argument("--out", required=True)
    sub.add_argument("--checkpoint", required=True)
    sub.add_argument("--every", default="30 seconds")
    job(compact, source=False, store=True)
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    session = prepare(spark or SparkSession.builder.appName("ledgerloom").getOrCreate())
    args.run(session, args)


if __name__ == "__main__":
    main()
