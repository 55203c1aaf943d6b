"""The driver's order tables read as a ledger: one order is one project.

``FIXTURES.md`` holds the mapping. Only the columns a report asks for are computed: Catalyst drops
unused month sums, and the whole line-item side when no column of it is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.schema import (
    DEFAULT_UNIT,
    MONTHS,
    PERCENT,
    PROGNOSA_MONTHS,
    REALISASI_MONTHS,
    RKAP_MONTHS,
    SOURCE_LEDGER,
)

EVENTS_PER_PROJECT_STEP = 110

# Declared, so that no job runs to read the footers first.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
    "props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _money(name: str) -> str:
    return f"CAST({name} AS DECIMAL(18,2))"


def project_id(key: str) -> str:
    """SQL for ``PRJ-00000042-001``; keys past 8 digits keep all of them."""
    text = f"CAST({key} AS STRING)"
    return (
        f"concat('PRJ-', lpad({text}, greatest(length({text}), 8), '0'), '-00', "
        f"CAST({key} % 3 + 1 AS STRING))"
    )


def _line_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order, by project id: 36 monthly sums, the largest line and the first and last ship date.

    Sums run over whole cents: exact like decimals, but plain longs in the aggregation buffer. An order's few lines lie
    anywhere in the table, so sums made before the shuffle would send nearly a row of 39 values for every line (and
    outgrow a task's memory); the lines themselves are sent, four values each, dealt by the project's id as the
    ledger is, so that what meets the ledger by id finds it dealt and sorted already.
    """
    lines = table(spark, sf_dir, "lineitem").where("l_orderkey IS NOT NULL").selectExpr(
        "l_orderkey",
        f"CAST({_money('l_extendedprice')} * 100 AS BIGINT) AS cents",
        "CAST(l_shipdate AS DATE) AS shipped",
        "CAST(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END + CASE l_linestatus WHEN 'F' THEN 2 WHEN 'O' THEN 4 ELSE 0 END AS INT) AS flags",
    )
    lines = lines.repartition(F.expr(project_id("l_orderkey"))).selectExpr(
        f"{project_id('l_orderkey')} AS l_id", "month(shipped) AS m", "cents", "shipped", "flags"
    )
    conditions = {"rkap": "flags & 1 = 1", "realisasi": "flags & 2 = 2", "prognosa": "flags & 4 = 4"}
    columns = {"rkap": RKAP_MONTHS, "realisasi": REALISASI_MONTHS, "prognosa": PROGNOSA_MONTHS}
    sums = [
        f"sum(CASE WHEN m = {i} AND {condition} THEN cents ELSE 0 END) AS {columns[kind][i - 1]}"
        for kind, condition in conditions.items()
        for i in range(1, len(MONTHS) + 1)
    ]
    spans = ["max(cents) AS largest", "min(shipped) AS shipped_first", "max(shipped) AS shipped_last"]
    return lines.groupBy("l_id").agg(*map(F.expr, sums + spans))


def _as_money(cents: str) -> str:
    return f"coalesce(CAST({cents} * 0.01BD AS DECIMAL(18,2)), 0.00BD)"


def _blank_at(modulus: int, value: str, blank: str = "NULL") -> str:
    return f"CASE WHEN k % {modulus} = 0 THEN {blank} ELSE {value} END"


def _ledger_expressions() -> dict[str, str]:
    """``FIXTURES.md`` section 6; texts carry NULL and '' at some residues of the order key."""
    first, last = "shipped_first", "shipped_last"
    expressions = {
        "id_root": "id_root",
        "klaster_regional": "r_name",
        "entitas_terminal": _blank_at(37, "n_name"),
        "id_investasi": _blank_at(19, "concat('INV-', k)"),
        "project_definition": "concat('Project ', k)",
        "asset_categories": _blank_at(41, "c_mktsegment"),
        "type_investasi": "CASE left(o_orderpriority, 1) WHEN '1' THEN 'Murni' WHEN '2' THEN "
        "'Multi Year' WHEN '3' THEN 'Carry Forward' WHEN '4' THEN '' END",
        "tahun_usulan": _blank_at(29, "year(o_orderdate) - 1"),
        "tahun_rkap": "year(o_orderdate)",
        "status_investasi": "element_at(array('Persiapan', 'Tender', 'Kontrak', 'Selesai', '', NULL), "
        "CAST(k % 6 + 1 AS INT))",
        "progres_description": _blank_at(4, "concat('progress ', k)"),
        "issue_categories": "CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('category ', k % 9) END",
        "issue_description": "CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('issue ', k) END",
        "action_target": _blank_at(13, "concat('action ', k)", "''"),
        "head_office_support_desc": _blank_at(17, "concat('support ', k)"),
        "pic": "CASE k % 23 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('pic ', k % 50) END",
        "status_issue": "CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Closed' END",
        "kebutuhan_dana": f"{_money('o_totalprice')} + {_money('c_acctbal')}",
        "rkap": _blank_at(53, _money("o_totalprice"), "0"),
        "judul_kontrak": _blank_at(3, "concat('contract ', k)"),
        "nilai_kontrak": _as_money("largest"),
        "penyerapan_sd_tahun_lalu": "0",
        "penyedia_jasa": _blank_at(31, "concat('vendor ', k % 100)", "''"),
        "no_kontrak": _blank_at(3, "concat('NO-', k)"),
        "tanggal_kontrak": "CAST(o_orderdate AS DATE)",
        "tgl_mulai_kontrak": _blank_at(11, first, last),
        "jangka_waktu": "k % 24 * 30",
        "satuan_hari": f"'{DEFAULT_UNIT}'",
        "tanggal_selesai": _blank_at(11, last, first),
        "latitude": _blank_at(10, "(c_custkey * 37 % 18000 - 9000) / 100"),
        "longitude": _blank_at(10, "(c_custkey * 53 % 36000 - 18000) / 100"),
        "created_at": "o_orderdate",
        "updated_at": "timestampadd(SECOND, k, o_orderdate)",
        "metadata": "concat('{\"k\": ', k, '}')",
    }
    for i, name in enumerate(RKAP_MONTHS):
        front_loaded = _money("o_totalprice") if i == 0 else "0"
        expressions[name] = _blank_at(7, _as_money(name), front_loaded)
    for name in REALISASI_MONTHS + PROGNOSA_MONTHS:
        expressions[name] = _as_money(name)
    return expressions


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 70-column source ledger."""
    # Customers are joined to the narrow order rows first, and these meet the line sums by the project's id: the wide
    # rows do not move, and come dealt and sorted by the id that changes of the ledger are keyed by.
    orders = (
        table(spark, sf_dir, "orders")
        .withColumnRenamed("o_orderkey", "k")
        .join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"))
        .withColumn("id_root", F.expr(project_id("k")))
    )
    # The few names are looked up last; they would make every order row longer on its way.
    rows = (
        orders.join(_line_totals(spark, sf_dir), F.expr("id_root = l_id"), "left")
        .join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    )
    expressions = _ledger_expressions()
    return rows.selectExpr(
        *(
            f"CAST({expressions[f.name]} AS {f.dataType.simpleString()}) AS {f.name}"
            for f in SOURCE_LEDGER.fields
        )
    )


def monitoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as progress checks of the project their user points to."""
    # Whole cents of a share of the value, so that every engine rounds alike.
    cents = f"CAST({_money('value')} * 100 AS BIGINT)"
    share = f"CAST({cents} DIV {{}} * 0.01BD AS {PERCENT.simpleString()})"
    texts = ("catatan", "kendala", "tindak_lanjut", "pic_monitoring", "foto_dokumentasi")
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS id",
        f"{project_id(f'(user_id * {EVENTS_PER_PROJECT_STEP})')} AS id_root",
        "CAST(ts AS DATE) AS tanggal_monitoring",
        f"{share.format(4)} AS progres_fisik",
        f"{share.format(5)} AS progres_keuangan",
        "CASE event_type WHEN 'view' THEN 'On Track' WHEN 'click' THEN 'Delayed' "
        "WHEN 'error' THEN 'At Risk' WHEN 'purchase' THEN 'Completed' ELSE 'Unknown' END "
        "AS status_monitoring",
        *(f"CAST(NULL AS STRING) AS {c}" for c in texts),
        "CAST(ts AS TIMESTAMP) AS created_at",
        "CAST(ts AS TIMESTAMP) AS updated_at",
    )


def feed_columns() -> list[Column]:
    """Change-feed columns over ``events`` rows, for batch and streaming reads alike.

    Sign-ups spell the month in capitals; clicks on every seventh id misspell it.
    """
    months = ", ".join(f"'{m}'" for m in MONTHS)
    month = (
        f"element_at(array({months}), "
        "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 12 + 1)"
    )
    return [
        F.expr(text)
        for text in (
            "event_id AS seq",
            f"{project_id(f'(user_id * {EVENTS_PER_PROJECT_STEP})')} AS id_root",
            "ts AS timestamp",
            "CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' "
            "ELSE 'UPDATE' END AS operation",
            f"CASE WHEN event_type = 'signup' THEN upper({month}) "
            f"WHEN event_type = 'click' AND event_id % 7 = 0 THEN concat({month}, 'x') "
            f"ELSE {month} END AS bulan",
            f"{_money('value')} AS nilai",
        )
    ]


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change feed with sequence, operation and a monthly amount for the keyed updates."""
    return table(spark, sf_dir, "events").select(*feed_columns())
