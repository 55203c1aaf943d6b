"""Session settings and the shared folder for tables that jobs write."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession


# A ledger row is so wide that one fused method over it can pass the size the JVM still compiles
# (8000 bytes of bytecode); from there on it would be interpreted, several times slower. With this
# limit Spark leaves such a stage unfused and compiles its expressions in pieces.
WIDE_ROW_SETTINGS = {"spark.sql.codegen.hugeMethodLimit": "8000"}
# Parquet notes least and greatest values for stamps of this kind only, and readers skip by them.
STAMP_SETTINGS = {"spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS"}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings wide ledgers want; call it on the cluster's session."""
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    for key, value in (WIDE_ROW_SETTINGS | STAMP_SETTINGS).items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster, pass the cluster's own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ledgerloom")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # Keep the compiled code of many wide plans, not of the last hundred stages only.
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .config("spark.driver.memory", os.environ.get("LEDGER_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


@cache
def _local_fallback() -> str:
    return tempfile.mkdtemp(prefix="ledgerloom-")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    Only a local master may fall back to a temporary folder: on a cluster, executors would each
    see their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return _local_fallback()


def new_workspace(spark: SparkSession, label: str) -> str:
    """A fresh, uniquely named folder under the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
