"""What the operators share: reading tables, tables written between steps, batch sizes, words."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import new_workspace

#: White space that parts words, for Java's and Python's regular expressions alike.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(rows: DataFrame, label: str) -> DataFrame:
    """The rows written to the shared folder and read again: lineage ends here, and a lost
    executor costs no recomputation of what came before."""
    spark = rows.sparkSession
    path = new_workspace(spark, label)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def small_batches(spark: SparkSession, records: int = 512) -> None:
    """Bound what one Arrow batch holds, since a single text can be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows that learning may not see: checksum of the id's text divisible by `folds`."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(True))


def joined_text(parts: Iterable[str]) -> str:
    return "".join(parts)
