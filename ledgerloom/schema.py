"""Ledger, monitoring and change-event schemas, with the column groups the jobs share."""

from __future__ import annotations

from pyspark.sql import types as T

# Month suffixes, display names and short names, in calendar order.
MONTHS = (
    "januari", "februari", "maret", "april", "mei", "juni",
    "juli", "agustus", "september", "oktober", "november", "desember",
)
MONTH_NAMES = tuple(m.capitalize() for m in MONTHS)
MONTH_SHORT = ("jan", "feb", "mar", "apr", "mei", "jun", "jul", "agu", "sep", "okt", "nov", "des")

# Allowed words, in declaration order (reports sort by it), and defaults.
INVESTMENT_TYPES = ("Murni", "Multi Year", "Carry Forward")
ISSUE_STATUSES = ("Open", "Closed")
MONITORING_STATUSES = ("On Track", "Delayed", "At Risk", "Completed")
DEFAULT_REGION = "Regional 2"
DEFAULT_YEAR = 2025
DEFAULT_UNIT = "Hari"
UNDETERMINED = "Belum Ditentukan"

MONEY = T.DecimalType(18, 2)
PERCENT = T.DecimalType(5, 2)


def month_columns(kind: str) -> list[str]:
    """The 12 monthly columns of ``rkap``, ``realisasi`` or ``prognosa``.

    The December forecast is cumulative and carries its own name.
    """
    if kind not in ("rkap", "realisasi", "prognosa"):
        raise ValueError(f"unknown monthly kind: {kind}")
    names = [f"{kind}_{m}" for m in MONTHS]
    if kind == "prognosa":
        names[-1] = "prognosa_sd_desember"
    return names


RKAP_MONTHS = month_columns("rkap")
REALISASI_MONTHS = month_columns("realisasi")
PROGNOSA_MONTHS = month_columns("prognosa")
MONTHLY = {"rkap": RKAP_MONTHS, "realisasi": REALISASI_MONTHS, "prognosa": PROGNOSA_MONTHS}
TOTALS = {
    "rkap": "total_rkap_bulanan",
    "realisasi": "total_realisasi",
    "prognosa": "total_prognosa",
}

# Maximum text lengths of the source table; None means unlimited.
TEXT_LENGTHS: dict[str, int | None] = {
    "id_root": 50,
    "klaster_regional": 100,
    "entitas_terminal": 200,
    "id_investasi": 100,
    "project_definition": None,
    "asset_categories": 200,
    "type_investasi": 50,
    "status_investasi": 100,
    "progres_description": None,
    "issue_categories": 200,
    "issue_description": None,
    "action_target": None,
    "head_office_support_desc": None,
    "pic": 200,
    "status_issue": 20,
    "judul_kontrak": None,
    "penyedia_jasa": 300,
    "no_kontrak": 200,
    "satuan_hari": 20,
}
TEXT_COLUMNS = list(TEXT_LENGTHS)
DATE_COLUMNS = ["tanggal_kontrak", "tgl_mulai_kontrak", "tanggal_selesai"]
YEAR_COLUMNS = ["tahun_usulan", "tahun_rkap"]
POINT_COLUMNS = ["latitude", "longitude"]
STAMP_COLUMNS = ["created_at", "updated_at"]
MONEY_COLUMNS = [
    "kebutuhan_dana", "rkap", *RKAP_MONTHS,
    "nilai_kontrak", "penyerapan_sd_tahun_lalu",
    *REALISASI_MONTHS, *PROGNOSA_MONTHS,
]

# The 69 synced columns, in table order; the source table adds ``metadata``.
SYNC_COLUMNS = [
    "id_root", "klaster_regional", "entitas_terminal", "id_investasi", "project_definition",
    "asset_categories", "type_investasi", "tahun_usulan", "tahun_rkap", "status_investasi",
    "progres_description", "issue_categories", "issue_description", "action_target",
    "head_office_support_desc", "pic", "status_issue",
    "kebutuhan_dana", "rkap", *RKAP_MONTHS,
    "judul_kontrak", "nilai_kontrak", "penyerapan_sd_tahun_lalu", "penyedia_jasa",
    "no_kontrak", *DATE_COLUMNS[:2], "jangka_waktu", "satuan_hari", DATE_COLUMNS[2],
    *REALISASI_MONTHS, *PROGNOSA_MONTHS,
    *POINT_COLUMNS, *STAMP_COLUMNS,
]


def _type_of(name: str, stamp: T.DataType) -> T.DataType:
    if name in MONEY_COLUMNS:
        return MONEY
    if name in DATE_COLUMNS:
        return T.DateType()
    if name in STAMP_COLUMNS:
        return stamp
    if name in POINT_COLUMNS:
        return T.DoubleType()
    if name in YEAR_COLUMNS or name == "jangka_waktu":
        return T.IntegerType()
    return T.StringType()


SOURCE_LEDGER = T.StructType(
    [T.StructField(c, _type_of(c, T.TimestampType())) for c in SYNC_COLUMNS]
    + [T.StructField("metadata", T.StringType())]
)
CONFORMED_LEDGER = T.StructType(
    [T.StructField(c, _type_of(c, T.TimestampNTZType())) for c in SYNC_COLUMNS]
    + [T.StructField(c, MONEY) for c in TOTALS.values()]
)
MONITORING = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("id_root", T.StringType()),
    T.StructField("tanggal_monitoring", T.DateType()),
    T.StructField("progres_fisik", PERCENT),
    T.StructField("progres_keuangan", PERCENT),
    T.StructField("status_monitoring", T.StringType()),
    T.StructField("catatan", T.StringType()),
    T.StructField("kendala", T.StringType()),
    T.StructField("tindak_lanjut", T.StringType()),
    T.StructField("pic_monitoring", T.StringType()),
    T.StructField("foto_dokumentasi", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])
CHANGE_EVENT = T.StructType([
    T.StructField("operation", T.StringType()),
    T.StructField("id_root", T.StringType()),
    T.StructField("timestamp", T.StringType()),
])
