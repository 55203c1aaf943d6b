"""Compare ledgers: change-feed emission from two snapshots, counts and key-by-key differences.

Only the key and an 8-byte row hash are shuffled, never the wide rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_hash(columns: Sequence[str]) -> Column:
    """Hash of the values and of which ones are NULL (hashing alone skips NULLs)."""
    blanks = ", ".join(f"{c} IS NULL" for c in columns)
    return F.expr(f"xxhash64({blanks}, {', '.join(columns)})")


def _hashed(rows: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    return rows.select("id_root", row_hash(columns).alias(name))


def diff(old: DataFrame, new: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per key, how ``new`` departs from ``old``: ``INSERT``, ``UPDATE`` or ``DELETE``.

    ``columns`` defaults to those both sides have; equal rows are left out.
    """
    names = list(columns or [c for c in old.columns if c in new.columns])
    paired = _hashed(old, names, "old_hash").join(_hashed(new, names, "new_hash"), "id_root", "full")
    return paired.select(
        "id_root",
        F.when(F.col("old_hash").isNull(), "INSERT")
        .when(F.col("new_hash").isNull(), "DELETE")
        .when(F.col("old_hash") != F.col("new_hash"), "UPDATE")
        .alias("operation"),
    ).where(F.col("operation").isNotNull())


def change_events(
    old: DataFrame, new: DataFrame, as_of: Column | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    """The change feed between two snapshots, with the JSON text a listener would receive."""
    stamp = as_of if as_of is not None else F.current_timestamp()
    events = diff(old, new, columns).withColumn("timestamp", stamp)
    payload = F.to_json(F.struct("operation", "id_root", "timestamp"))
    return events.withColumn("payload", payload)


def sync_counts(source: DataFrame, target: DataFrame) -> DataFrame:
    """Row counts of both sides in one row."""
    sides = source.select(F.lit("source").alias("side")).unionByName(
        target.select(F.lit("target").alias("side"))
    )
    return sides.agg(
        F.count_if(F.col("side") == "source").alias("source_count"),
        F.count_if(F.col("side") == "target").alias("target_count"),
    ).select(
        "source_count",
        "target_count",
        F.abs(F.col("source_count") - F.col("target_count")).alias("difference"),
        (F.col("source_count") == F.col("target_count")).alias("in_sync"),
    )


def sync_diff(source: DataFrame, target: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Keys missing from, extra in, or changed against the target."""
    state = (
        F.when(F.col("operation") == "INSERT", "missing")
        .when(F.col("operation") == "DELETE", "extra")
        .otherwise("changed")
    )
    return diff(target, source, columns).select("id_root", state.alias("state"))
