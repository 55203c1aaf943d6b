"""Small document tables for the operators' tests."""

from __future__ import annotations

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, **extra):
    """Rows as (doc_id, text[, lang[, source]]); extra columns carry constants under any name."""
    from pyspark.sql import functions as F

    full = []
    for row in rows:
        doc_id, text, lang, source = (*row, *(None, "src0")[len(row) - 2 :]) if len(row) < 4 else row
        full.append((doc_id, text, lang, source, None if text is None else len(text)))
    df = spark.createDataFrame(full, DOCUMENTS)
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


def by_id(df, key="doc_id"):
    """Rows by id, as dictionaries; each id once."""
    rows = [r.asDict() for r in df.collect()]
    found = {r[key]: r for r in rows}
    assert len(found) == len(rows)
    return found
