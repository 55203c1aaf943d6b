import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom import schema
from ledgerloom.operators.conform import conform, fill_defaults, strip_texts, with_totals
from tests.conftest import stamp, zeros


def one(df):
    return df.collect()[0]


def test_schema_counts():
    assert len(schema.SOURCE_LEDGER) == 70
    assert len(schema.SYNC_COLUMNS) == 69 == len(set(schema.SYNC_COLUMNS))
    assert len(schema.CONFORMED_LEDGER) == 72
    assert len(schema.MONITORING) == 13
    assert len(schema.MONEY_COLUMNS) == 40
    assert schema.PROGNOSA_MONTHS[-1] == "prognosa_sd_desember"
    with pytest.raises(ValueError):
        schema.month_columns("budget")


def test_conformed_schema_is_declared(make):
    for profile in ("cli", "daemon"):
        got = conform(make({"id_root": "A"}), profile).schema
        assert [(f.name, f.dataType) for f in got] == [
            (f.name, f.dataType) for f in schema.CONFORMED_LEDGER
        ]


def test_batch_profile_replaces_words_outside_the_domain(make):
    led = make(
        {"id_root": "A", "type_investasi": "Multi Year", "status_issue": "Closed"},
        {"id_root": "B", "type_investasi": "Other", "status_issue": ""},
        {"id_root": "C"},
    )
    got = {r.id_root: (r.type_investasi, r.status_issue) for r in conform(led).collect()}
    assert got == {"A": ("Multi Year", "Closed"), "B": ("Murni", "Open"), "C": ("Murni", "Open")}


def test_feed_profile_replaces_blanks_only(make):
    led = make(
        {"id_root": "A", "type_investasi": "Other", "status_issue": "Later"},
        {"id_root": "B", "type_investasi": "", "status_issue": ""},
        {"id_root": "C"},
    )
    got = {r.id_root: (r.type_investasi, r.status_issue) for r in conform(led, "daemon").collect()}
    assert got == {"A": ("Other", "Later"), "B": ("Murni", "Open"), "C": ("Murni", "Open")}


def test_years_by_profile(make):
    led = make({"id_root": "A", "tahun_rkap": 0}, {"id_root": "B"}, {"id_root": "C", "tahun_rkap": 2023})
    cli = {r.id_root: (r.tahun_rkap, r.tahun_usulan) for r in conform(led).collect()}
    daemon = {r.id_root: (r.tahun_rkap, r.tahun_usulan) for r in conform(led, "daemon").collect()}
    assert cli == {"A": (2025, 2025), "B": (2025, 2025), "C": (2023, 2025)}
    assert daemon == {"A": (0, 0), "B": (0, 0), "C": (2023, 0)}


def test_points_by_profile(make):
    led = make({"id_root": "A", "latitude": 0.0, "longitude": 106.8})
    assert one(conform(led))[["latitude"][0]] is None
    assert one(conform(led)).longitude == 106.8
    assert one(conform(led, "daemon")).latitude == 0.0


def test_blank_texts_dates_money_and_duration(make):
    row = one(conform(make({"id_root": "A"})))
    assert (row.pic, row.klaster_regional, row.satuan_hari) == ("", "", "")
    assert row.tanggal_kontrak is None and row.created_at is None
    assert row.jangka_waktu == 0 and row.rkap == 0 and row.total_realisasi == 0


def test_unreadable_money_becomes_zero(make):
    led = make({"id_root": "A"}).withColumn("rkap", F.lit("x")).withColumn("nilai_kontrak", F.lit("12.5"))
    row = one(conform(led))
    assert row.rkap == 0 and row.nilai_kontrak == Decimal("12.50")


def test_stamps_lose_their_zone(make):
    row = one(conform(make({"id_root": "A", "updated_at": stamp("2025-03-01T10:20:30")})))
    assert row.updated_at == dt.datetime(2025, 3, 1, 10, 20, 30)
    assert row.updated_at.tzinfo is None


def test_unknown_profile_is_refused(make):
    with pytest.raises(ValueError):
        conform(make({"id_root": "A"}), "other")


def test_month_total_of_three_months(make):
    months = zeros(schema.REALISASI_MONTHS, realisasi_januari=100, realisasi_februari=200,
                   realisasi_maret=300)
    assert one(with_totals(make({"id_root": "A", **months}))).total_realisasi == 600


def test_total_is_null_when_a_month_is(make):
    months = zeros(schema.REALISASI_MONTHS, realisasi_maret=None)
    assert one(with_totals(make({"id_root": "A", **months}))).total_realisasi is None


def test_defaults_fill_missing_columns_not_nulls(spark):
    rows = spark.createDataFrame([("A", None)], "id_root string, klaster_regional string")
    kept = one(fill_defaults(rows))
    assert kept.klaster_regional is None
    assert (kept.tahun_rkap, kept.satuan_hari, kept.rkap, kept.rkap_januari) == (2025, "Hari", 0, 0)
    assert kept.updated_at is not None and kept.metadata == "{}"
    added = one(fill_defaults(rows.drop("klaster_regional"), F.lit(stamp("2025-01-01T00:00:00"))))
    assert added.klaster_regional == "Regional 2"


def test_null_budget_money_reads_as_zero(spark):
    rows = spark.createDataFrame([("A", None, None)], "id_root string, rkap decimal(18,2), nilai_kontrak decimal(18,2)")
    row = one(fill_defaults(rows))
    assert row.rkap == 0 and row.nilai_kontrak is None


def test_strip_takes_every_white_space(spark):
    rows = spark.createDataFrame([(" \t Pier　 9\r\n", 1)], "entitas_terminal string, tahun_rkap int")
    assert one(strip_texts(rows)).entitas_terminal == "Pier　 9"
