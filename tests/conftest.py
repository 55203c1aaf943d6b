import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import Row

from ledgerloom.schema import MONEY_COLUMNS, SOURCE_LEDGER
from ledgerloom.session import local_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        4, shuffle_partitions=4,
        **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Source ledger rows from keyword dicts; money given as text or number, the rest NULL."""

    def build(*rows):
        full = []
        for row in rows:
            values = {f.name: None for f in SOURCE_LEDGER.fields}
            values.update(row)
            for c in MONEY_COLUMNS:
                if values[c] is not None:
                    values[c] = Decimal(str(values[c])).quantize(Decimal("0.01"))
            full.append(Row(**values))
        return spark.createDataFrame(full, SOURCE_LEDGER)

    return build


def stamp(text):
    return dt.datetime.fromisoformat(text)


def zeros(prefix_columns, **values):
    """All the given money columns at 0 but for the named ones."""
    return {c: 0 for c in prefix_columns} | values


def rows(df, *columns):
    """Rows as a sorted list of tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: tuple(str(v) for v in r))
