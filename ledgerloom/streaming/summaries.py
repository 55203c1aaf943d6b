"""Summary tables that grow with inserted rows, and published reports.

The insert-fed form counts a row again each time it is synced again, as summing views over an
append-only table do. Reports over the current ledger (``ledgerloom.plans.views``) do not.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators.changes import newest_per_key
from ledgerloom.plans.views import KEYS, VIEWS
from ledgerloom.sources import files

# ---- insert-fed views ----------------------------------------------------------------------


def start_summary(
    inserted: DataFrame, view: str, out: str, checkpoint: str, trigger: dict | None = None, fold_every: int = 50
) -> StreamingQuery:
    """Maintain one view from a stream of inserted ledger rows.

    State holds one row per group. A micro-batch writes the groups it has changed and no others; of a group's rows
    the last micro-batch's counts. Once ``fold_every`` micro-batches wait, the whole view is written
    beside them, and what the whole view before it covers is dropped.
    """
    spark = inserted.sparkSession

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/batch={batch}")
        wholes, waiting = _parts(spark, out)
        if len(waiting) >= fold_every:
            read_summary(spark, out, view).write.mode("overwrite").parquet(f"{out}/whole/batch={batch}")
            for old in wholes[:-1]:
                files.drop(spark, f"{out}/whole/batch={old}")
            for old in files.finished_batches(spark, out):
                if wholes and old <= wholes[-1]:
                    files.drop(spark, f"{out}/batch={old}")

    return (
        VIEWS[view](inserted)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 second"}))
        .start()
    )


def _parts(spark: SparkSession, out: str) -> tuple[list[int], list[int]]:
    """Micro-batches up to which a whole view is written, and those after the last of them."""
    # Listed in this order, a whole view that is finished in between hides nothing.
    changed = files.finished_batches(spark, out)
    wholes = files.finished_batches(spark, f"{out}/whole")
    return wholes, [b for b in changed if not wholes or b > wholes[-1]]


def read_summary(spark: SparkSession, out: str, view: str) -> DataFrame:
    """The view as of the last finished micro-batch: the last row of each group."""
    wholes, waiting = _parts(spark, out)
    if not (wholes or waiting):
        raise ValueError(f"no finished view under {out}")
    found = [(f"{out}/whole", wholes[-1:]), (out, waiting)]
    rows = [
        spark.read.option("basePath", root).parquet(*(f"{root}/batch={b}" for b in batches))
        for root, batches in found if batches
    ]
    both = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
    return newest_per_key(both, KEYS[view], [F.col("batch").desc()]).drop("batch")


# ---- published reports ---------------------------------------------------------------------

Reports = Mapping[str, Callable[[DataFrame], DataFrame]]


def _numbers(spark: SparkSession, out: str) -> list[int]:
    return sorted(int(n.partition("=")[2]) for n in files.names(spark, out) if n.startswith("publication="))


def publish(led: DataFrame, reports: Reports, out: str, state: str = "") -> int:
    """Write all reports of one ledger as the next publication; returns its number.

    Readers follow one pointer, a row that is written when all reports are there, so what they read under one number
    comes from one ledger, and a publication that dies half-way is never seen. The publication before stays for
    readers that are still at it. ``state`` notes what the ledger was.
    """
    spark = led.sparkSession
    before = published(spark, out)
    number = max(_numbers(spark, out), default=-1) + 1
    for name, report in reports.items():
        report(led).write.parquet(f"{out}/publication={number}/{name}")
    pointer = spark.range(1).select(F.lit(state).alias("state"), F.array(*map(F.lit, sorted(reports))).alias("reports"))
    pointer.coalesce(1).write.parquet(f"{out}/pointer/batch={number}")
    if before is not None:
        for old in _numbers(spark, out):
            if old < before:
                files.drop(spark, f"{out}/pointer/batch={old}")
                files.drop(spark, f"{out}/publication={old}")
    return number


def published(spark: SparkSession, out: str) -> int | None:
    """Number of the publication that readers have now."""
    return max(files.finished_batches(spark, f"{out}/pointer"), default=None)


def published_state(spark: SparkSession, out: str) -> str | None:
    number = published(spark, out)
    return None if number is None else spark.read.parquet(f"{out}/pointer/batch={number}").first()["state"]


def read_published(spark: SparkSession, out: str, name: str, number: int | None = None) -> DataFrame:
    """A report of the current publication, or of one that was looked up before.

    To read several reports of one ledger, look up :func:`published` once and pass its number.
    """
    if number is None:
        number = published(spark, out)
    if number is None:
        raise ValueError(f"nothing is published under {out}")
    return spark.read.parquet(f"{out}/publication={number}/{name}")


def refresh_once(spark: SparkSession, look: Callable[[], tuple[str, DataFrame]], reports: Reports, out: str) -> bool:
    """Publish what one look at the ledger finds, unless that is published already."""
    state, led = look()
    if state and state == published_state(spark, out):
        return False
    publish(led, reports, out, state)
    return True


def start_refresh(
    spark: SparkSession,
    look: Callable[[], tuple[str, DataFrame]],
    reports: Reports,
    out: str,
    checkpoint: str,
    every: str = "30 seconds",
) -> StreamingQuery:
    """Publish the reports again and again, on a clock of Spark's own.

    ``look`` gives the ledger and a name of its state; a state that is published already is not published again ('' always is).
    """
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return (
        ticks.writeStream.foreachBatch(lambda _ticks, _batch: refresh_once(spark, look, reports, out) and None)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=every)
        .start()
    )
