import time

import pytest

from ledgerloom import jobs
from ledgerloom.plans import load
from ledgerloom.session import new_workspace
from ledgerloom.sources import tables
from ledgerloom.sources.store import LedgerStore
from ledgerloom.streaming import summaries
from tests.conftest import rows, stamp

T1 = stamp("2025-01-01T00:00:00")


@pytest.fixture
def paths(spark, make):
    root = new_workspace(spark, "jobs")
    make(
        {"id_root": "A", "klaster_regional": "West", "tahun_rkap": 2025, "rkap": 100, "updated_at": T1},
        {"id_root": "B", "klaster_regional": "East", "tahun_rkap": 2024, "rkap": 50, "updated_at": T1},
    ).write.parquet(f"{root}/source")
    return root


def run(spark, *argv):
    jobs.main(argv, spark)


def test_sync_verify_report_and_compact(spark, paths, capsys):
    where = ("--source", f"{paths}/source", "--store", f"{paths}/store")
    run(spark, "sync", *where)
    run(spark, "verify", *where)
    run(spark, "report", "count", "--store", f"{paths}/store")
    run(spark, "report", "kpi-overview", "--source", f"{paths}/source", "--out", f"{paths}/out")
    run(spark, "compact", "--store", f"{paths}/store")
    out = capsys.readouterr().out
    assert "2 projects loaded" in out and "true" in out and "years rewritten: []" in out
    assert spark.read.parquet(f"{paths}/out").first().project_count == 2


@pytest.mark.parametrize("name", sorted(jobs.STORE_REPORTS))
def test_store_reports_run(spark, make, paths, name):
    run(spark, "sync", "--source", f"{paths}/source", "--store", f"{paths}/store", "--full")
    run(spark, "report", name, "--store", f"{paths}/store", "--year", "2025", "--out", f"{paths}/r")
    assert spark.read.parquet(f"{paths}/r").count() <= 1


@pytest.mark.parametrize("name", sorted(jobs.SOURCE_REPORTS))
def test_source_reports_run(spark, paths, name):
    run(spark, "report", name, "--source", f"{paths}/source", "--out", f"{paths}/r")
    assert spark.read.parquet(f"{paths}/r").count() >= 0


def test_listing_detail_summary_validate(spark, paths, capsys):
    source = ("--source", f"{paths}/source")
    run(spark, "listing", *source, "--region", "West")
    run(spark, "detail", *source, "B")
    run(spark, "summary", *source, "--year", "2025")
    run(spark, "validate", *source, "--limit", "100")
    out = capsys.readouterr().out
    assert "Rp 100" in out and "Rp 50.00" in out and "serapan" in out and "with_issues" in out


def test_change_writes_the_next_ledger_and_its_events(spark, paths):
    spark.createDataFrame([("A", T1, 1, "Mei", 7.0), ("A", T1, 2, "May", 9.0)],
                          "id_root string, timestamp timestamp, seq int, bulan string, nilai double"
                          ).write.parquet(f"{paths}/months")
    spark.createDataFrame([("C", " Pier ")], "id_root string, entitas_terminal string").write.parquet(
        f"{paths}/new")
    spark.createDataFrame([("B",)], "id_root string").write.parquet(f"{paths}/gone")
    steps = [("realisasi", "months", "source", "l1"), ("insert", "new", "l1", "l2"), ("delete", "gone", "l2", "l3")]
    for kind, change, before, after in steps:
        run(spark, "change", kind, "--source", f"{paths}/{before}", "--changes", f"{paths}/{change}",
            "--out", f"{paths}/{after}", "--feed", f"{paths}/feed")
    final = tables.read_ledger(spark, f"{paths}/l3")
    assert rows(final, "id_root", "realisasi_mei", "entitas_terminal", "klaster_regional") == [
        ("A", 7, None, "West"), ("C", 0, "Pier", "Regional 2"),
    ]
    sent = spark.read.json(f"{paths}/feed")
    assert rows(sent, "operation", "id_root") == [("DELETE", "B"), ("INSERT", "C"), ("UPDATE", "A")]


def test_follow_is_wired(spark, paths, monkeypatch):
    started = {}

    class Query:
        recentProgress = ()

    def fake(store, events, read_source, checkpoint, **options):
        started.update(options, isStreaming=events.isStreaming, rows=read_source().count())
        load.load(store, read_source())
        return Query()

    def run_until(query, stopping, beside):
        # Reports come from the clock beside the stream, not from its micro-batches.
        try:
            deadline = time.time() + 90
            while summaries.published(spark, f"{paths}/reports") is None and time.time() < deadline:
                time.sleep(0.2)
        finally:
            beside[0].stop()
        started["waited"] = not stopping.is_set()

    monkeypatch.setattr(jobs.apply, "snapshot_then_tail", fake)
    monkeypatch.setattr(jobs.apply, "run_until", run_until)
    spark.createDataFrame([("{}",)], "value string").write.text(f"{paths}/feed")
    run(spark, "follow", "--source", f"{paths}/source", "--store", f"{paths}/store", "--feed", f"{paths}/feed",
        "--checkpoint", f"{paths}/cp", "--reports", f"{paths}/reports", "--refresh", "1 second")
    assert started["waited"] and started["isStreaming"] and started["rows"] == 2
    assert started["trigger"] == {"processingTime": "1 second"} and "after_batch" not in started
    assert summaries.read_published(spark, f"{paths}/reports", "count").first().project_count == 2
