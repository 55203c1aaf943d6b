"""SQL equivalents of the catalogue, for a second engine to run on the same tables.

They state the ledger mapping and every query over again as plain SQL, so that they check the
DataFrame code rather than repeat it.
"""

from __future__ import annotations

from ledgerloom.schema import (
    DATE_COLUMNS,
    MONEY_COLUMNS,
    MONTH_NAMES,
    MONTH_SHORT,
    MONTHS,
    POINT_COLUMNS,
    PROGNOSA_MONTHS,
    REALISASI_MONTHS,
    RKAP_MONTHS,
    STAMP_COLUMNS,
    SYNC_COLUMNS,
    TEXT_LENGTHS,
    YEAR_COLUMNS,
)

STAMP = "TIMESTAMP '2024-06-01 00:00:00'"


def _money(x: str) -> str:
    return f"CAST({x} AS DECIMAL(18,2))"


def _plus(columns: list[str], wrap: str = "{}") -> str:
    return "(" + " + ".join(wrap.format(c) for c in columns) + ")"


def _dbl(x: str, name: str) -> str:
    return f"CAST({x} AS DOUBLE) AS {name}"


def _id(key: str) -> str:
    text = f"CAST({key} AS VARCHAR)"
    return (
        f"'PRJ-' || lpad({text}, CAST(greatest(8, length({text})) AS INTEGER), '0') "
        f"|| '-00' || CAST({key} % 3 + 1 AS VARCHAR)"
    )


# ---- the mapping ---------------------------------------------------------------------------

_sums = []
for _i in range(12):
    _m = f"month(l_shipdate) = {_i + 1}"
    for _name, _cond in (
        (RKAP_MONTHS[_i], "l_returnflag <> 'R'"),
        (REALISASI_MONTHS[_i], "l_linestatus = 'F'"),
        (PROGNOSA_MONTHS[_i], "l_linestatus = 'O'"),
    ):
        _sums.append(
            f"sum(CASE WHEN {_m} AND {_cond} THEN {_money('l_extendedprice')} ELSE 0 END) AS {_name}"
        )

LINES = f"""lines AS (
  SELECT l_orderkey, {', '.join(_sums)},
         max({_money('l_extendedprice')}) AS largest, CAST(min(l_shipdate) AS DATE) AS d1,
         CAST(max(l_shipdate) AS DATE) AS d2
  FROM lineitem GROUP BY l_orderkey)"""

_EXPR = {
    "id_root": _id("k"),
    "klaster_regional": "r_name",
    "entitas_terminal": "CASE WHEN k % 37 = 0 THEN NULL ELSE n_name END",
    "id_investasi": "CASE WHEN k % 19 = 0 THEN NULL ELSE 'INV-' || k END",
    "project_definition": "'Project ' || k",
    "asset_categories": "CASE WHEN k % 41 = 0 THEN NULL ELSE c_mktsegment END",
    "type_investasi": "CASE left(o_orderpriority, 1) WHEN '1' THEN 'Murni' WHEN '2' THEN 'Multi Year' "
    "WHEN '3' THEN 'Carry Forward' WHEN '4' THEN '' END",
    "tahun_usulan": "CASE WHEN k % 29 = 0 THEN NULL ELSE CAST(year(o_orderdate) - 1 AS INTEGER) END",
    "tahun_rkap": "CAST(year(o_orderdate) AS INTEGER)",
    "status_investasi": "CASE k % 6 WHEN 0 THEN 'Persiapan' WHEN 1 THEN 'Tender' WHEN 2 THEN 'Kontrak' "
    "WHEN 3 THEN 'Selesai' WHEN 4 THEN '' END",
    "progres_description": "CASE WHEN k % 4 = 0 THEN NULL ELSE 'progress ' || k END",
    "issue_categories": "CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'category ' || (k % 9) END",
    "issue_description": "CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'issue ' || k END",
    "action_target": "CASE WHEN k % 13 = 0 THEN '' ELSE 'action ' || k END",
    "head_office_support_desc": "CASE WHEN k % 17 = 0 THEN NULL ELSE 'support ' || k END",
    "pic": "CASE k % 23 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'pic ' || (k % 50) END",
    "status_issue": "CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Closed' END",
    "kebutuhan_dana": f"{_money('o_totalprice')} + {_money('c_acctbal')}",
    "rkap": f"CASE WHEN k % 53 = 0 THEN 0 ELSE {_money('o_totalprice')} END",
    "judul_kontrak": "CASE WHEN k % 3 = 0 THEN NULL ELSE 'contract ' || k END",
    "nilai_kontrak": "coalesce(largest, 0)",
    "penyerapan_sd_tahun_lalu": "0",
    "penyedia_jasa": "CASE WHEN k % 31 = 0 THEN '' ELSE 'vendor ' || (k % 100) END",
    "no_kontrak": "CASE WHEN k % 3 = 0 THEN NULL ELSE 'NO-' || k END",
    "tanggal_kontrak": "CAST(o_orderdate AS DATE)",
    "tgl_mulai_kontrak": "CASE WHEN k % 11 = 0 THEN d2 ELSE d1 END",
    "jangka_waktu": "CAST(30 * (k % 24) AS INTEGER)",
    "satuan_hari": "'Hari'",
    "tanggal_selesai": "CASE WHEN k % 11 = 0 THEN d1 ELSE d2 END",
    "latitude": "CASE WHEN k % 10 = 0 THEN NULL ELSE ((c_custkey * 37) % 18000 - 9000) / 100 END",
    "longitude": "CASE WHEN k % 10 = 0 THEN NULL ELSE ((c_custkey * 53) % 36000 - 18000) / 100 END",
    "created_at": "o_orderdate",
    "updated_at": "o_orderdate + to_seconds(k)",
    "metadata": "'{\"k\": ' || k || '}'",
}
for _i, _name in enumerate(RKAP_MONTHS):
    _front = _money("o_totalprice") if _i == 0 else "0"
    _EXPR[_name] = f"CASE WHEN k % 7 = 0 THEN {_front} ELSE coalesce({_name}, 0) END"
for _name in REALISASI_MONTHS + PROGNOSA_MONTHS:
    _EXPR[_name] = f"coalesce({_name}, 0)"


def _ledger_column(name: str) -> str:
    expr = _EXPR[name]
    if name in MONEY_COLUMNS:
        expr = _money(expr)
    if name in POINT_COLUMNS:
        expr = f"CAST({expr} AS DOUBLE)"
    return f"{expr} AS {name}"


LED = f"""{LINES},
led AS MATERIALIZED (
  SELECT {', '.join(_ledger_column(c) for c in [*SYNC_COLUMNS, 'metadata'])}
  FROM (SELECT o_orderkey AS k, * FROM orders) o
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN lines ON l_orderkey = k)"""

MON = f"""mon AS MATERIALIZED (
  SELECT event_id AS id, {_id('(user_id * 110)')} AS id_root, CAST(ts AS DATE) AS tanggal_monitoring,
         (CAST(round(value * 100) AS BIGINT) // 4) / 100.0 AS progres_fisik,
         (CAST(round(value * 100) AS BIGINT) // 5) / 100.0 AS progres_keuangan,
         CASE event_type WHEN 'view' THEN 'On Track' WHEN 'click' THEN 'Delayed'
              WHEN 'error' THEN 'At Risk' WHEN 'purchase' THEN 'Completed' ELSE 'Unknown' END
           AS status_monitoring
  FROM events)"""

_MONTH_LIST = "[" + ", ".join(f"'{m}'" for m in MONTHS) + "]"
FEED = f"""feed AS MATERIALIZED (
  SELECT event_id AS seq, {_id('(user_id * 110)')} AS id_root, ts AS timestamp, event_type,
         CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END
           AS operation,
         CASE WHEN event_type = 'click' AND event_id % 7 = 0 THEN 0
              ELSE CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 12 + 1 END AS m,
         {_money('value')} AS nilai
  FROM events),
lastop AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id_root ORDER BY timestamp DESC, seq DESC) AS rn
                 FROM feed) WHERE rn = 1),
gone AS (SELECT id_root FROM lastop WHERE operation = 'DELETE')"""


def _conf_expr(c: str, profile: str) -> str:
    cli = profile == "cli"
    if c in ("type_investasi", "status_issue"):
        words = ("'Murni', 'Multi Year', 'Carry Forward'" if c == "type_investasi" else "'Open', 'Closed'")
        first = words.split(",")[0]
        if cli:
            return f"CASE WHEN {c} IN ({words}) THEN {c} ELSE {first} END"
        return f"CASE WHEN {c} IS NULL OR {c} = '' THEN {first} ELSE {c} END"
    if c in YEAR_COLUMNS:
        return f"CASE WHEN {c} IS NULL OR {c} = 0 THEN 2025 ELSE {c} END" if cli else f"coalesce({c}, 0)"
    if c == "jangka_waktu" or c in MONEY_COLUMNS:
        return f"coalesce({c}, 0)"
    if c in POINT_COLUMNS:
        return f"nullif({c}, 0)" if cli else c
    if c in DATE_COLUMNS or c in STAMP_COLUMNS:
        return c
    return f"coalesce({c}, '')"


_TOTALS = (
    f"CAST({_plus(RKAP_MONTHS)} AS DECIMAL(18,2)) AS total_rkap_bulanan, "
    f"CAST({_plus(REALISASI_MONTHS)} AS DECIMAL(18,2)) AS total_realisasi, "
    f"CAST({_plus(PROGNOSA_MONTHS)} AS DECIMAL(18,2)) AS total_prognosa"
)


def _conf(profile: str = "cli", source: str = "led", name: str = "conf") -> str:
    columns = ", ".join(f"{_conf_expr(c, profile)} AS {c}" for c in SYNC_COLUMNS)
    return f"{name} AS (SELECT *, {_TOTALS} FROM (SELECT {columns} FROM {source}))"


def _q(*ctes: str, select: str) -> str:
    return f"WITH {', '.join(ctes)}\n{select}"


def _led(select: str) -> str:
    return _q(LED, select=select)


def _conformed(select: str, profile: str = "cli") -> str:
    return _q(LED, _conf(profile), select=select)


REAL = _plus(REALISASI_MONTHS)
REAL10, RKAP10 = _plus(REALISASI_MONTHS[:10]), _plus(RKAP_MONTHS[:10])
OPEN = "count(*) FILTER (WHERE status_issue = 'Open') AS open_issues"
CLOSED = "count(*) FILTER (WHERE status_issue = 'Closed') AS closed_issues"
COUNT = "count(*) AS project_count"


def _share(part: str, whole: str, scale: str = " * 100") -> str:
    return (
        f"CASE WHEN {whole} > 0 THEN CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE){scale} "
        f"ELSE 0.0 END"
    )


def _exact(part: str, whole: str, digits: int, half_even: bool) -> str:
    """``part / whole`` in percent, rounded exactly: whole-number arithmetic on cents."""
    n = f"(CAST({part} * 100 AS HUGEINT) * {10 ** (digits + 2)})"
    d = f"CAST({whole} * 100 AS HUGEINT)"
    if half_even:
        up = f"(2 * ({n} % {d}) > {d} OR (2 * ({n} % {d}) = {d} AND ({n} // {d}) % 2 = 1))"
        rounded = f"({n} // {d} + CASE WHEN {up} THEN 1 ELSE 0 END)"
    else:
        rounded = f"((2 * {n} + {d}) // (2 * {d}))"
    return (
        f"CASE WHEN {whole} > 0 THEN CAST({rounded} AS DOUBLE) / {10 ** digits}::DOUBLE ELSE 0.0 END"
    )


def _sum(x: str, name: str) -> str:
    return _dbl(f"sum({x})", name)


def _sum0(x: str, name: str) -> str:
    return _dbl(f"coalesce(sum({x}), 0)", name)


def _band(x: str, steps: list[tuple[int, str]], base: str) -> str:
    whens = " ".join(f"WHEN {x} >= {limit} THEN '{name}'" for limit, name in reversed(steps))
    return f"CASE {whens} ELSE '{base}' END"


REGIONAL = (
    f"klaster_regional, {COUNT}, {_sum('rkap', 'total_rkap')}, "
    f"{_sum('nilai_kontrak', 'total_nilai_kontrak')}, {_sum(REAL, 'total_realisasi')}, {OPEN}, {CLOSED}"
)
CATEGORIES = (
    f"asset_categories, count(*) AS item_count, {_sum0('kebutuhan_dana', 'total_kebutuhan')}, "
    f"{_sum0('rkap', 'total_rkap')}, {_sum0(REAL, 'total_realisasi')}"
)
_CAT = (
    f"(SELECT {CATEGORIES}, coalesce(sum({REAL}), 0) AS x, coalesce(sum(rkap), 0) AS y "
    "FROM led GROUP BY asset_categories)"
)
_CAT_COLUMNS = "asset_categories, item_count, total_kebutuhan, total_rkap, total_realisasi"
_CAT_SHARE = _share("total_realisasi", "total_rkap")
_PCT1 = "replace(format('{{:,.1f}}', {x}), ',', '') || '%'"
_STATUS = "coalesce(nullif(status_investasi, ''), 'Belum Ditentukan') AS status"

V_BUDGET = (
    f"tahun_rkap, klaster_regional, {COUNT}, {_sum('rkap', 'total_rkap')}, "
    f"{_sum('total_realisasi', 'total_realisasi')}, {_sum('nilai_kontrak', 'total_nilai_kontrak')}"
)
V_PROGRESS = (
    f"tahun_rkap, klaster_regional, entitas_terminal, {COUNT}, "
    "count(*) FILTER (WHERE status_investasi <> '') AS with_status_count"
)
V_ISSUES = "tahun_rkap, klaster_regional, status_issue, count(*) AS issue_count"
V_MONTHLY = "tahun_rkap, klaster_regional, " + ", ".join(
    _sum(c, f'"{s}"') for c, s in zip(REALISASI_MONTHS, MONTH_SHORT, strict=True)
)
V_TYPE = (
    f"tahun_rkap, type_investasi, {COUNT}, {_sum('rkap', 'total_rkap')}, "
    f"{_sum('nilai_kontrak', 'total_nilai_kontrak')}"
)

_SQL_BUDGET = _conformed(f"SELECT {V_BUDGET} FROM conf GROUP BY tahun_rkap, klaster_regional")
_SQL_PROGRESS = _conformed(
    f"SELECT {V_PROGRESS} FROM conf GROUP BY tahun_rkap, klaster_regional, entitas_terminal"
)
_SQL_ISSUES = _conformed(
    f"SELECT {V_ISSUES} FROM conf WHERE issue_description <> '' "
    "GROUP BY tahun_rkap, klaster_regional, status_issue"
)
_SQL_MONTHLY = _conformed(f"SELECT {V_MONTHLY} FROM conf GROUP BY tahun_rkap, klaster_regional")
_SQL_TYPE = _conformed(f"SELECT {V_TYPE} FROM conf GROUP BY tahun_rkap, type_investasi")


def _read_budget(where: str = "") -> str:
    return _conformed(
        f"SELECT *, {_share('total_realisasi', 'total_rkap')} AS persen_serapan "
        f"FROM (SELECT {V_BUDGET} FROM conf {where} GROUP BY tahun_rkap, klaster_regional)"
    )


_BUDGET_MONEY = (
    "CAST(sum(kebutuhan_dana) AS DOUBLE) / 1000000.0::DOUBLE AS kebutuhan_dana, "
    "CAST(sum(rkap) AS DOUBLE) / 1000000.0::DOUBLE AS rkap_awal, "
    "CAST(sum(rkap) AS DOUBLE) * 0.85::DOUBLE / 1000000.0::DOUBLE AS rkap_transfer, "
)
_BUDGET_YTD = (
    f"CAST(sum({RKAP10}) AS DOUBLE) / 1000000.0::DOUBLE AS sd_bulan_rkap, "
    f"CAST(sum({REAL10}) AS DOUBLE) / 1000000.0::DOUBLE AS sd_bulan_realisasi, "
    "CAST(sum(rkap) AS DOUBLE) * 0.9::DOUBLE / 1000000.0::DOUBLE AS taksasi"
)
_YTD_SHARE = _share(f"sum({REAL10})", "sum(rkap)", "")

LISTING = (
    "id_root, klaster_regional, entitas_terminal, project_definition, type_investasi, tahun_rkap, "
    f"status_investasi, status_issue, {_dbl('rkap', 'rkap')}, {_dbl('nilai_kontrak', 'nilai_kontrak')}, "
    "updated_at"
)
_NEWEST = "ORDER BY updated_at DESC NULLS FIRST, id_root ASC NULLS LAST"

_ENRICHED = (
    "SELECT id_root, klaster_regional, entitas_terminal, project_definition, type_investasi, "
    f"tahun_rkap, status_investasi, status_issue, {_dbl('rkap', 'rkap')}, "
    f"{_dbl('nilai_kontrak', 'nilai_kontrak')}, {_dbl('kebutuhan_dana', 'kebutuhan_dana')}, "
    f"asset_categories, {_dbl(REAL, 'total_realisasi')}, latitude, longitude, updated_at FROM led"
)

_s_curve_rows = " UNION ALL ".join(
    f"SELECT klaster_regional, {i + 1} AS month_order, '{MONTH_NAMES[i]}' AS month, "
    f"sum({RKAP_MONTHS[i]}) AS p, sum({REALISASI_MONTHS[i]}) AS a FROM led GROUP BY klaster_regional"
    for i in range(12)
)

REPORTS = {
    "regional_summary": _led(f"SELECT {REGIONAL} FROM led GROUP BY klaster_regional"),
    "regional_summary_year": _led(
        f"SELECT {REGIONAL} FROM led WHERE tahun_rkap = 1996 GROUP BY klaster_regional"
    ),
    "regional_summary_filled": _led(
        f"SELECT klaster_regional, {COUNT}, {_sum0('rkap', 'total_rkap')}, "
        f"{_sum0('nilai_kontrak', 'total_nilai_kontrak')}, {_sum0(REAL, 'total_realisasi')}, "
        f"{OPEN}, {CLOSED} FROM led GROUP BY klaster_regional"
    ),
    "regional_absorption": _led(
        f"SELECT * EXCLUDE (x, y), {_share('total_realisasi', 'total_rkap')} AS serapan, "
        f"{_PCT1.format(x=_exact('x', 'y', 1, True))} AS serapan_text "
        f"FROM (SELECT {REGIONAL}, sum({REAL}) AS x, sum(rkap) AS y FROM led GROUP BY klaster_regional)"
    ),
    "monthly_actuals": _led(
        "SELECT " + ", ".join(_sum0(c, m) for c, m in zip(REALISASI_MONTHS, MONTHS, strict=True)) + " FROM led"
    ),
    "monthly_trend": _led(
        " UNION ALL ".join(
            f"SELECT '{MONTH_NAMES[i]}' AS month, {i + 1} AS month_order, "
            f"{_sum(REALISASI_MONTHS[i], 'value')} FROM led"
            for i in range(12)
        )
    ),
    "category_summary": _led(f"SELECT {CATEGORIES} FROM led GROUP BY asset_categories"),
    "category_achievement": _led(
        f"SELECT {_CAT_COLUMNS}, {_exact('x', 'y', 2, True)} AS capaian FROM {_CAT}"
    ),
    "category_band": _led(
        f"SELECT {_CAT_COLUMNS}, {_CAT_SHARE} AS cap, "
        f"{_PCT1.format(x=_exact('x', 'y', 1, True))} AS cap_text, "
        f"CASE WHEN y > 0 AND 2 * x >= y THEN '#2ecc71' ELSE '#e74c3c' END AS color FROM {_CAT}"
    ),
    "status_summary": _led(
        f"SELECT {_STATUS}, jumlah FROM "
        "(SELECT status_investasi, count(*) AS jumlah FROM led GROUP BY status_investasi)"
    ),
    "status_top10": _led(
        f"SELECT {_STATUS}, jumlah FROM "
        "(SELECT status_investasi, count(*) AS jumlah FROM led GROUP BY status_investasi) "
        "ORDER BY jumlah DESC, status_investasi ASC NULLS LAST LIMIT 10"
    ),
    "view_budget_actual": _SQL_BUDGET,
    "view_progress": _SQL_PROGRESS,
    "view_issues": _SQL_ISSUES,
    "view_monthly": _SQL_MONTHLY,
    "view_type": _SQL_TYPE,
    "read_budget_actual": _read_budget(),
    "read_budget_actual_year": _read_budget("WHERE tahun_rkap = 1997"),
    "read_progress": _SQL_PROGRESS,
    "read_issues": _SQL_ISSUES,
    "read_monthly": _SQL_MONTHLY,
    "read_type": _SQL_TYPE,
    "read_budget_actual_partial": _read_budget(),
    "read_progress_partial": _SQL_PROGRESS,
    "read_issues_partial": _SQL_ISSUES,
    "read_monthly_partial": _SQL_MONTHLY,
    "read_type_partial": _SQL_TYPE,
    "ledger_count": _conformed(f"SELECT {COUNT} FROM conf"),
    "kpi_totals": _conformed(
        f"SELECT *, {_band('open_issues', [(3, 'yellow'), (5, 'red')], 'green')} AS color FROM ("
        f"SELECT {COUNT}, {_sum('rkap', 'total_rkap')}, "
        "CAST(sum(rkap) AS DOUBLE) / 1000000.0::DOUBLE AS total_rkap_millions, "
        f"{_sum('total_realisasi', 'total_realisasi')}, {OPEN} FROM conf)"
    ),
    "kpi_overview": _led(
        "SELECT *, 'Rp ' || format('{:.2f}', total_rkap / 1e9) || 'B' AS rkap_text, "
        "'Rp ' || format('{:.2f}', total_realisasi / 1e9) || 'B' AS realisasi_text, "
        "format('{:.1f}', pct) || '%' AS pct_text FROM ("
        f"SELECT *, {_share('total_realisasi', 'total_rkap')} AS pct FROM ("
        f"SELECT {COUNT}, {_sum0('rkap', 'total_rkap')}, {_sum0(REAL, 'total_realisasi')}, {OPEN} FROM led))"
    ),
    "kpi_investment": _led(
        f"SELECT *, {_share('total_realisasi', 'total_rkap')} AS cap, "
        "'Rp ' || format('{:,.0f}', total_rkap / 1e6) || 'Jt' AS rkap_text, "
        "'Rp ' || format('{:,.0f}', total_kebutuhan / 1e6) || 'Jt' AS kebutuhan_text, "
        "'Rp ' || format('{:,.0f}', total_realisasi / 1e6) || 'Jt' AS realisasi_text FROM ("
        f"SELECT {COUNT}, {_sum0('rkap', 'total_rkap')}, {_sum0('kebutuhan_dana', 'total_kebutuhan')}, "
        f"{_sum0(REAL, 'total_realisasi')} FROM led)"
    ),
    "region_budget_actual": _conformed(
        f"SELECT klaster_regional, {_sum('rkap', 'total_rkap')}, "
        f"{_sum('total_realisasi', 'total_realisasi')} FROM conf GROUP BY klaster_regional"
    ),
    "region_budget_actual_source": _led(
        f"SELECT klaster_regional, {_sum('rkap', 'total_rkap')}, {_sum(REAL, 'total_realisasi')} "
        "FROM led GROUP BY klaster_regional"
    ),
    "type_distribution": _conformed(
        f"SELECT type_investasi, {COUNT}, {_sum('rkap', 'total_rkap')} FROM conf GROUP BY type_investasi"
    ),
    "type_distribution_source": _led(
        f"SELECT type_investasi, {COUNT}, {_sum('rkap', 'total_rkap')} FROM led GROUP BY type_investasi"
    ),
    "type_distribution_nonnull": _led(
        f"SELECT type_investasi, {COUNT} FROM led WHERE type_investasi IS NOT NULL GROUP BY type_investasi"
    ),
    "issue_distribution": _conformed(
        "SELECT status_issue, count(*) AS issue_count FROM conf GROUP BY status_issue"
    ),
    "issue_with_text": _led(
        "SELECT status_issue, count(*) AS issue_count FROM led "
        "WHERE issue_description IS NOT NULL AND issue_description <> '' GROUP BY status_issue"
    ),
    "open_closed_totals": _led(f"SELECT {OPEN}, {CLOSED} FROM led"),
    "ytd_achievement": _led(
        f"SELECT capaian, {_band('capaian', [(30, 'orange'), (60, 'yellow'), (80, 'green')], 'red')} AS color "
        f"FROM (SELECT {_exact('x', 'y', 2, False)} AS capaian "
        f"FROM (SELECT sum({REAL10}) AS x, sum(rkap) AS y FROM led))"
    ),
    "ytd_actual": _led(
        f"SELECT CAST(sum({REAL10}) AS DOUBLE) / 1000000.0::DOUBLE AS realisasi_millions FROM led"
    ),
    "category_budget_table": _led(
        "SELECT row_number() OVER (ORDER BY asset_categories ASC NULLS LAST) AS no, "
        f"asset_categories AS nama_aktiva, {_BUDGET_MONEY}"
        "CAST(sum(rkap_oktober) AS DOUBLE) / 1000000.0::DOUBLE AS bulan_rkap, "
        "CAST(sum(realisasi_oktober) AS DOUBLE) / 1000000.0::DOUBLE AS bulan_realisasi, "
        f"{_BUDGET_YTD}, {_YTD_SHARE} AS capaian, "
        f"{_band(f'{_YTD_SHARE} * 100', [(30, 'yellow'), (60, 'green')], 'red')} AS color "
        "FROM led GROUP BY asset_categories"
    ),
    "category_budget_footer": _led(
        f"SELECT FALSE AS is_total, asset_categories AS nama_aktiva, {_BUDGET_MONEY}{_BUDGET_YTD} "
        "FROM led GROUP BY asset_categories UNION ALL "
        f"SELECT TRUE, NULL, {_BUDGET_MONEY}{_BUDGET_YTD} FROM led"
    ),
    "s_curve": _led(
        "SELECT klaster_regional, month_order, month, CAST(p AS DOUBLE) AS plan, CAST(a AS DOUBLE) AS actual, "
        "CAST(sum(p) OVER w AS DOUBLE) AS cum_plan, CAST(sum(a) OVER w AS DOUBLE) AS cum_actual "
        f"FROM ({_s_curve_rows}) WINDOW w AS (PARTITION BY klaster_regional ORDER BY month_order)"
    ),
    "latest_page": _led(f"SELECT {LISTING} FROM led {_NEWEST} LIMIT 100 OFFSET 100"),
    "top_budget": _led(
        f"SELECT id_root, project_definition, klaster_regional, {_dbl('rkap', 'rkap')}, "
        f"{_dbl('nilai_kontrak', 'nilai_kontrak')} FROM led "
        "ORDER BY led.rkap DESC NULLS FIRST, id_root LIMIT 10"
    ),
    "first_by_id": _conformed(
        "SELECT id_root, klaster_regional, entitas_terminal, project_definition, type_investasi, "
        f"status_issue, {_dbl('rkap', 'rkap')}, {_dbl('total_realisasi', 'total_realisasi')} "
        "FROM conf ORDER BY id_root LIMIT 50"
    ),
}

# ---- shapes --------------------------------------------------------------------------------


def _label(c: str, label: str = "-") -> str:
    return f"coalesce(nullif({c}, ''), '{label}')"


def _fmt(x: str, digits: int = 2) -> str:
    return f"format('{{:,.{digits}f}}', CAST({x} AS DOUBLE))"


_FACETS = ["klaster_regional", "entitas_terminal", "type_investasi", "tahun_rkap", "status_issue"]


def _all_columns() -> str:
    parts = [
        _dbl(c, c) if c in MONEY_COLUMNS
        else f"CAST({c} AS TIMESTAMP) AS {c}" if c in DATE_COLUMNS
        else c
        for c in SYNC_COLUMNS
    ]
    parts += [_dbl(c, c) for c in ("total_rkap_bulanan", "total_realisasi", "total_prognosa")]
    return ", ".join(parts)


def _issue(c: str) -> str:
    return f"CASE WHEN issue_description IS NOT NULL AND issue_description <> '' THEN {_label(c)} END"


SHAPES = {
    "filtered_listing": _led(
        f"SELECT {LISTING} FROM led WHERE klaster_regional = 'ASIA' AND entitas_terminal ILIKE '%n_1%' "
        f"AND tahun_rkap = 1996 AND status_issue = 'Open' {_NEWEST} LIMIT 20 OFFSET 5"
    ),
    "listing_texts": _led(
        "SELECT id_root, coalesce(klaster_regional, '') AS klaster_regional, "
        f"left({_label('entitas_terminal')}, 20) AS entitas_terminal, "
        f"{_label('type_investasi')} AS type_investasi, tahun_rkap, "
        f"CASE WHEN rkap IS NULL OR rkap = 0 THEN '-' ELSE 'Rp ' || {_fmt('rkap', 0)} END AS rkap_text, "
        f"{_label('status_issue')} AS status_issue FROM led"
    ),
    "facet_filter": _led(
        f"SELECT id_root, {', '.join(_FACETS)} FROM led "
        "WHERE klaster_regional = 'EUROPE' AND type_investasi = 'Murni'"
    ),
    "facet_values": _led(
        " UNION ALL ".join(
            f"SELECT '{f}' AS facet, CAST({f} AS VARCHAR) AS value, "
            f"{_label(f'CAST({f} AS VARCHAR)', 'N/A')} AS label, {COUNT} "
            f"FROM led WHERE {f} IS NOT NULL GROUP BY {f}"
            for f in _FACETS
        )
    ),
    "filtered_count": _led(
        f"SELECT {COUNT} FROM led WHERE klaster_regional = 'ASIA' AND status_issue = 'Open'"
    ),
    "enriched_listing": _led(_ENRICHED),
    "enriched_listing_ordered": _led(f"{_ENRICHED} {_NEWEST}"),
    "map_points": _led(
        "SELECT latitude, longitude, id_root, project_definition, klaster_regional, status_investasi, "
        f"{_dbl('rkap', 'rkap')} FROM led WHERE latitude IS NOT NULL AND longitude IS NOT NULL"
    ),
    "project_detail": _q(
        LED,
        MON,
        select=f"SELECT id_root, klaster_regional, {_label('entitas_terminal')} AS entitas_terminal, "
        f"left({_label('project_definition')}, 100) AS project_definition, "
        f"{_label('type_investasi')} AS type_investasi, tahun_rkap, "
        f"{_label('status_investasi')} AS status_investasi, "
        f"'Rp ' || {_fmt('rkap')} AS rkap_text, 'Rp ' || {_fmt('kebutuhan_dana')} AS kebutuhan_text, "
        f"'Rp ' || {_fmt('nilai_kontrak')} AS kontrak_text, 'Rp ' || {_fmt(REAL)} AS realisasi_text, "
        f"{_issue('status_issue')} AS issue_status, {_issue('issue_categories')} AS issue_category, "
        f"left({_issue('issue_description')}, 200) AS issue_text, {_issue('pic')} AS issue_pic "
        "FROM led WHERE id_root IN (SELECT id_root FROM mon)",
    ),
    "conform_cli": _conformed(f"SELECT {_all_columns()} FROM conf"),
    "conform_daemon": _conformed(f"SELECT {_all_columns()} FROM conf", "daemon"),
    "computed_totals": _led(
        f"SELECT id_root, {_dbl(_plus(RKAP_MONTHS), 'total_rkap_bulanan')}, "
        f"{_dbl(REAL, 'total_realisasi')}, {_dbl(_plus(PROGNOSA_MONTHS), 'total_prognosa')} FROM led"
    ),
    "default_fill": _led(
        "SELECT id_root, 'Regional 2' AS klaster_regional, entitas_terminal, 2025 AS tahun_rkap, "
        f"'Hari' AS satuan_hari, {_dbl('coalesce(rkap, 0)', 'rkap')}, {_dbl('0', 'kebutuhan_dana')}, "
        f"{_dbl('0', 'nilai_kontrak')}, {_dbl('0', 'realisasi_januari')}, "
        f"{STAMP} AS updated_at, '{{}}' AS metadata FROM led"
    ),
    "stripped_texts": _led(
        "SELECT id_root, entitas_terminal, asset_categories, status_investasi FROM led"
    ),
    "format_money": _led(
        f"SELECT id_root, 'Rp ' || replace({_fmt('rkap')}, ',', '.') AS currency, "
        "CASE WHEN status_investasi IS NULL THEN 'Rp 0' ELSE status_investasi END AS currency_of_text, "
        "'Rp ' || format('{:.2f}', CAST(rkap AS DOUBLE) / 1e9) || 'B' AS billions, "
        "'Rp ' || format('{:,.0f}', CAST(rkap AS DOUBLE) / 1e6) || 'Jt' AS millions, "
        f"CASE WHEN rkap = 0 THEN '-' ELSE 'Rp ' || {_fmt('rkap', 0)} END AS listing, "
        "left(project_definition, 10) AS short_definition FROM led"
    ),
    "format_pct": _led(
        "SELECT id_root, CASE WHEN rkap = 0 THEN '0%' ELSE "
        f"format('{{:.1f}}', CAST({REAL} AS DOUBLE) / CAST(rkap AS DOUBLE) * 100) || '%' END AS of_budget, "
        "CASE WHEN rkap = 0 THEN '0%' ELSE 'N/A' END AS of_text FROM led"
    ),
}

# ---- changes -------------------------------------------------------------------------------


def _last(value: str, where: str, name: str) -> str:
    """Last value of the qualifying changes; boxed, since NULL may be that value."""
    return f"last({{'v': {value}}} ORDER BY timestamp, seq) FILTER (WHERE {where}) AS {name}"


def _merged(box: str, old: str, name: str) -> str:
    return f"CASE WHEN {box} IS NULL THEN {old} ELSE {box}.v END AS {name}"


def _stamped(boxes: list[str]) -> str:
    touched = " OR ".join(f"{b} IS NOT NULL" for b in boxes)
    return f"CASE WHEN {touched} THEN {STAMP} ELSE updated_at END AS updated_at"


def _fold_months(columns: list[str], feed: str = "feed") -> str:
    sums = ", ".join(_last("nilai", f"m = {i + 1}", f"n{i + 1}") for i in range(12))
    return f"fold AS (SELECT id_root AS fid, {sums} FROM {feed} WHERE m > 0 GROUP BY id_root)"


_BOXES = [f"n{i + 1}" for i in range(12)]


def _set_months(columns: list[str]) -> str:
    merged = ", ".join(
        _dbl(f"CASE WHEN n{i + 1} IS NULL THEN {c} ELSE n{i + 1}.v END", c) for i, c in enumerate(columns)
    )
    return _q(
        LED, FEED, _fold_months(columns),
        select=f"SELECT id_root, {merged}, {_stamped(_BOXES)} FROM led LEFT JOIN fold ON id_root = fid",
    )


def _changed(feed: str = "feed", gone: str = "gone") -> str:
    """The ledger after monthly actuals were set and deleted projects left."""
    replaced = ", ".join(
        f"CAST(CASE WHEN n{i + 1} IS NULL THEN {c} ELSE n{i + 1}.v END AS DECIMAL(18,2)) AS {c}"
        for i, c in enumerate(REALISASI_MONTHS)
    )
    return (
        f"{_fold_months(REALISASI_MONTHS, feed)}, changed AS (SELECT led.* REPLACE ({replaced}, {_stamped(_BOXES)}) "
        f"FROM led LEFT JOIN fold ON id_root = fid WHERE id_root NOT IN (SELECT id_root FROM {gone}))"
    )


_BOOKS = "tahun_rkap <= 1997"
_KEPT = "tahun_rkap <= 2000"
_TOUCHED = "id_root IN (SELECT id_root FROM feed WHERE m > 0)"
_GONE = "id_root IN (SELECT id_root FROM gone)"
_KNOWN_TYPE = (
    "CASE WHEN type_investasi IN ('Murni', 'Multi Year', 'Carry Forward') THEN type_investasi END"
)
_CHANGE_STATE = (
    f"CASE WHEN tahun_rkap > 2000 AND NOT {_GONE} THEN '{{new}}' "
    f"WHEN tahun_rkap <= 2000 AND {_GONE} THEN '{{gone}}' "
    f"WHEN tahun_rkap <= 2000 AND {_TOUCHED} THEN '{{changed}}' END"
)

_NUMBER = "CAST(split_part(id_root, '-', 2) AS BIGINT)"


def _project(number: str) -> str:
    return f"'PRJ-' || lpad(CAST({number} AS VARCHAR), CAST(greatest(length(CAST({number} AS VARCHAR)), 8) AS INTEGER), '0') || '-00' || ({number} % 3 + 1)"


_ASKED = f"""numbered AS (SELECT id_root, {_NUMBER} AS n, {_NUMBER} % 20 AS k FROM led),
asked AS (
    SELECT id_root AS old_id, 'NEW-' || id_root AS new_id FROM numbered WHERE k IN (0, 5)
    UNION SELECT id_root, unnest(['X-' || id_root, 'Y-' || id_root]) FROM numbered WHERE k = 1
    UNION SELECT id_root, 'SHARED-' || (n // 100) FROM numbered WHERE k = 2
    UNION SELECT id_root, {_project("(n + 1)")} FROM numbered WHERE k IN (4, 6, 8, 10, 11, 12)
    UNION SELECT id_root, {_project("(n - 1)")} FROM numbered WHERE k = 9
    UNION SELECT id_root, '' FROM numbered WHERE k = 14
    UNION SELECT 'GHOST-' || id_root, 'Z-' || id_root FROM numbered WHERE k = 15
    UNION SELECT id_root, id_root FROM numbered WHERE k = 16
    UNION SELECT NULL, id_root FROM numbered WHERE k = 17
), alone AS (
    SELECT *, CASE WHEN coalesce(old_id, '') = '' OR coalesce(new_id, '') = '' THEN 'missing_id' WHEN old_id = new_id THEN 'same_name'
        WHEN old_id NOT IN (SELECT id_root FROM led) THEN 'unknown_id' END AS r1 FROM asked
), several AS (
    SELECT *, CASE WHEN r1 IS NULL AND count(*) FILTER (WHERE r1 IS NULL) OVER (PARTITION BY old_id) > 1 THEN 'several_names' END AS r2
    FROM alone
), shared AS (
    SELECT *, CASE WHEN r1 IS NULL AND r2 IS NULL AND count(*) FILTER (WHERE r1 IS NULL AND r2 IS NULL) OVER (PARTITION BY new_id) > 1
        THEN 'shared_name' END AS r3 FROM several
), good AS (SELECT old_id, new_id FROM shared WHERE r1 IS NULL AND r2 IS NULL AND r3 IS NULL),
walk AS (
    SELECT old_id AS start, new_id AS goal FROM good
    UNION ALL SELECT w.start, g.new_id FROM walk w JOIN good g ON g.old_id = w.goal WHERE g.old_id <> w.start
), stuck AS (
    SELECT start, goal FROM walk WHERE goal NOT IN (SELECT old_id FROM good) AND goal IN (SELECT id_root FROM led)
), outcomes AS (
    SELECT old_id, new_id, coalesce(r1, r2, r3, CASE WHEN goal = new_id THEN 'name_in_use' WHEN goal IS NOT NULL THEN 'blocked' END) AS reason
    FROM shared LEFT JOIN stuck ON start = old_id AND r1 IS NULL AND r2 IS NULL AND r3 IS NULL
)"""

CHANGES = {
    "dedup_latest": _q(
        FEED, select=f"SELECT id_root, timestamp AS updated_at, seq, {_dbl('nilai', 'nilai')} FROM lastop"
    ),
    "last_operation": _q(FEED, select="SELECT id_root, operation, timestamp, seq FROM lastop"),
    "insert_rows": _led(
        f"SELECT id_root, tahun_rkap, CASE WHEN {_BOOKS} THEN type_investasi ELSE {_KNOWN_TYPE} END "
        f"AS type_investasi, {_dbl('rkap', 'rkap')} FROM led"
    ),
    "insert_rejects": _led(
        "SELECT id_root, 'exists' AS reason, CAST(1 AS BIGINT) AS refused_rows FROM led WHERE tahun_rkap = 1997"
    ),
    "partial_update": _q(
        LED, FEED,
        "fold AS (SELECT id_root AS fid, "
        + _last("CASE WHEN seq % 4 <> 0 THEN 'pic-' || seq END", "operation IN ('INSERT', 'UPDATE')", "bp")
        + ", " + _last("CAST(seq % 365 AS INTEGER)", "operation = 'UPDATE'", "bj")
        + ", " + _last("'upd ' || seq", "operation = 'INSERT'", "bi")
        + " FROM feed GROUP BY id_root)",
        select="SELECT id_root, "
        + ", ".join([_merged("bp", "pic", "pic"), _merged("bj", "jangka_waktu", "jangka_waktu"),
                     _merged("bi", "issue_description", "issue_description"), _stamped(["bp", "bj", "bi"])])
        + " FROM led LEFT JOIN fold ON id_root = fid",
    ),
    "progress_update": _q(
        LED, FEED,
        "chg AS (SELECT *, CASE WHEN operation = 'INSERT' THEN 'Open' WHEN seq % 5 = 0 THEN 'Closed' "
        "WHEN seq % 5 = 1 THEN 'Pending' END AS st FROM feed)",
        "fold AS (SELECT id_root AS fid, "
        + _last("'prog ' || seq", "seq % 3 <> 0", "bp") + ", "
        + _last("'act ' || seq", "seq % 2 <> 0", "ba") + ", "
        + _last("st", "st IS NOT NULL", "bs")
        + " FROM chg WHERE st IS NULL OR st <> 'Pending' GROUP BY id_root)",
        select="SELECT id_root, "
        + ", ".join([_merged("bp", "progres_description", "progres_description"),
                     _merged("ba", "action_target", "action_target"),
                     _merged("bs", "status_issue", "status_issue"), _stamped(["bp", "ba", "bs"])])
        + " FROM led LEFT JOIN fold ON id_root = fid",
    ),
    "progress_rejects": _q(
        FEED,
        select="SELECT id_root, seq, 'Pending' AS status_issue FROM feed "
        "WHERE operation <> 'INSERT' AND seq % 5 = 1",
    ),
    "set_actual": _set_months(REALISASI_MONTHS),
    "set_forecast": _set_months(PROGNOSA_MONTHS),
    "set_budget": _set_months(RKAP_MONTHS),
    "month_rejects": _q(
        FEED,
        select=f"SELECT id_root, seq, list_extract({_MONTH_LIST}, "
        "CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 12 + 1) || 'x' AS bulan "
        "FROM feed JOIN events ON event_id = seq WHERE m = 0",
    ),
    "delete_keys": _q(LED, FEED, select=f"SELECT {LISTING} FROM led WHERE NOT {_GONE}"),
    "upsert": _conformed(
        "SELECT id_root, tahun_rkap, " + _dbl("rkap", "rkap") + ", "
        "CASE WHEN jangka_waktu >= 360 THEN 're-synced' ELSE pic END AS pic, "
        "CASE WHEN jangka_waktu >= 360 THEN updated_at + to_days(jangka_waktu - 360) ELSE updated_at END "
        "AS updated_at FROM conf"
    ),
    "change_rejects": _q(
        LED, FEED,
        "asked AS (SELECT CASE WHEN seq % 50 <> 0 THEN id_root END AS id_root, seq, m FROM feed)",
        select="SELECT id_root, seq, reason FROM (SELECT id_root, seq, CASE WHEN id_root IS NULL THEN 'missing_id' "
        "WHEN m = 0 THEN 'bad_month' WHEN id_root NOT IN (SELECT id_root FROM led WHERE tahun_rkap <= 2000) "
        "THEN 'unknown_id' END AS reason FROM asked) WHERE reason IS NOT NULL",
    ),
    "upsert_new_keys": _conformed(
        "SELECT id_root, tahun_rkap, " + _dbl("rkap", "rkap") + ", "
        "CASE WHEN tahun_rkap >= 1996 THEN 'second' ELSE pic END AS pic, "
        "CASE WHEN tahun_rkap >= 1996 THEN updated_at + to_days(30) ELSE updated_at END AS updated_at FROM conf"
    ),
    "snapshot_diff": _q(
        LED, FEED,
        select="SELECT id_root, operation, id_root AS sent_id FROM (SELECT id_root, "
        + _CHANGE_STATE.format(new="INSERT", gone="DELETE", changed="UPDATE")
        + " AS operation FROM led) WHERE operation IS NOT NULL",
    ),
    "monitoring_orphans": _q(
        LED, MON, select="SELECT id, id_root FROM mon WHERE id_root NOT IN (SELECT id_root FROM led)"
    ),
    "cascade_delete": _q(
        MON, FEED, select=f"SELECT id, id_root, status_monitoring FROM mon WHERE NOT {_GONE}"
    ),
    "insert_outcomes": _led(
        "SELECT tahun_rkap, outcome, count(*) AS sent_rows, count(DISTINCT sent_id) AS ids FROM (SELECT tahun_rkap, sent_id, "
        "CASE WHEN sent_id IS NULL THEN 'missing' WHEN tahun_rkap = 1997 THEN 'exists' WHEN copy = 0 THEN 'added' ELSE 'repeated' END "
        f"AS outcome FROM (SELECT tahun_rkap, CASE WHEN {_NUMBER} % 30 <> 7 THEN id_root END AS sent_id, "
        f"unnest(CASE WHEN {_NUMBER} % 30 = 8 THEN [0, 1] ELSE [0] END) AS copy FROM led WHERE tahun_rkap >= 1997)) "
        "GROUP BY tahun_rkap, outcome"
    ),
    "upsert_outcomes": _led(
        f"SELECT id_root, CASE WHEN tahun_rkap > 1997 THEN 'added' WHEN {_NUMBER} % 3 >= 1 OR updated_at IS NULL THEN 'replaced' "
        "ELSE 'older' END AS outcome FROM led"
    ),
    "rename_outcomes": _q(f"RECURSIVE {LED}", _ASKED, select="SELECT * FROM outcomes"),
    "renamed_ledger": _q(
        f"RECURSIVE {LED}", _ASKED,
        select="SELECT coalesce(o.new_id, l.id_root) AS id_root, tahun_rkap FROM led l "
        "LEFT JOIN (SELECT * FROM outcomes WHERE reason IS NULL) o ON o.old_id = l.id_root",
    ),
    "cascade_rename": _q(
        MON, FEED,
        select="SELECT id, CASE WHEN id_root IN (SELECT id_root FROM lastop WHERE operation = 'INSERT') "
        "THEN 'REN-' || id_root ELSE id_root END AS id_root, status_monitoring FROM mon",
    ),
}

# ---- quality -------------------------------------------------------------------------------

_PLAN = _plus(RKAP_MONTHS, "coalesce({}, 0)")
_ACTUAL = _plus(REALISASI_MONTHS, "coalesce({}, 0)")
CHECKED = (
    f"checked AS (SELECT *, coalesce(rkap, 0) AS b, coalesce(nilai_kontrak, 0) AS c, {_PLAN} AS p, "
    f"{_ACTUAL} AS a FROM led)"
)
_RULES = [
    ("required_id", "ERROR", "id_root IS NULL OR id_root = ''",
     "'[ERROR] Required field ''id_root'' is missing'"),
    ("budget_mismatch", "INFO", "b > 0 AND p > 0 AND abs(b - p) > 0.01",
     f"'RKAP total (' || {_fmt('b')} || ') doesn''t match sum of monthly (' || {_fmt('p')} || "
     f"'), diff: ' || {_fmt('abs(b - p)')}"),
    ("over_budget", "WARNING", "b > 0 AND a > b",
     f"'[WARNING] Realisasi (' || {_fmt('a')} || ') exceeds RKAP (' || {_fmt('b')} || ')'"),
    ("contract_high", "WARNING", "c > 0 AND b > 0 AND c > b * 1.1",
     f"'[WARNING] Contract value (' || {_fmt('c')} || ') is significantly higher than RKAP (' || "
     f"{_fmt('b')} || ')'"),
    ("end_before_start", "ERROR", "tanggal_selesai < tgl_mulai_kontrak",
     "'[ERROR] Contract end date is before start date'"),
    ("start_before_signing", "WARNING", "tgl_mulai_kontrak < tanggal_kontrak",
     "'[WARNING] Contract start date is before contract signing date'"),
]
ISSUES = "issues AS (" + " UNION ALL ".join(
    f"SELECT id_root, updated_at, {i} AS position, '{name}' AS rule, '{severity}' AS severity, "
    f"{message} AS message FROM checked WHERE {condition}"
    for i, (name, severity, condition, message) in enumerate(_RULES)
) + ")"
BAD = "bad AS (SELECT DISTINCT id_root FROM issues WHERE severity = 'ERROR')"


def _quality(select: str, scope: str = "") -> str:
    ctes = [LED] + ([scope] if scope else []) + [
        CHECKED.replace("FROM led", "FROM newest") if scope else CHECKED, ISSUES, BAD
    ]
    return _q(*ctes, select=select)


def _report(table: str) -> str:
    return (
        "SELECT t AS total, t - w AS valid, w AS with_issues, l AS issue_lines, "
        "greatest(l - 50, 0) AS more FROM ("
        f"SELECT (SELECT count(*) FROM {table}) AS t, (SELECT count(*) FROM bad) AS w, "
        "(SELECT count(*) FROM issues WHERE id_root IN (SELECT id_root FROM bad)) AS l)"
    )


def _broken(rules: list[tuple[str, str]], table: str, keys: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {keys}, '{name}' AS rule FROM {table} WHERE {condition}" for name, condition in rules
    )


_LEDGER_RULES = [
    ("id_root_null", "id_root IS NULL"),
    ("type_investasi_domain", "type_investasi NOT IN ('Murni', 'Multi Year', 'Carry Forward')"),
    ("status_issue_domain", "status_issue NOT IN ('Open', 'Closed')"),
    ("latitude_range", "latitude < -90 OR latitude > 90"),
    ("longitude_range", "longitude < -180 OR longitude > 180"),
    ("jangka_waktu_negative", "jangka_waktu < 0"),
] + [(f"{c}_length", f"length({c}) > {n}") for c, n in TEXT_LENGTHS.items() if n]
_LEDGER_BROKEN = _broken(_LEDGER_RULES, "led", "id_root") + (
    " UNION ALL SELECT id_root, 'id_root_duplicate' FROM led GROUP BY id_root HAVING count(*) > 1"
)
_MONITORING_RULES = [
    ("id_root_null", "id_root IS NULL"),
    ("id_root_suffix", "id_root NOT LIKE '%-001'"),
    ("tanggal_null", "tanggal_monitoring IS NULL"),
    ("progres_fisik_range", "progres_fisik < 0 OR progres_fisik > 100"),
    ("progres_keuangan_range", "progres_keuangan < 0 OR progres_keuangan > 100"),
    ("status_domain", "status_monitoring NOT IN ('On Track', 'Delayed', 'At Risk', 'Completed')"),
]

QUALITY = {
    "quality_issues": _quality("SELECT id_root, position, rule, severity, message FROM issues"),
    "quality_validate": _quality(
        "SELECT id_root, id_root NOT IN (SELECT id_root FROM bad) AS is_valid, "
        "CAST(coalesce(n, 0) AS INTEGER) AS finding_count FROM led LEFT JOIN "
        "(SELECT id_root, count(*) AS n FROM issues GROUP BY id_root) USING (id_root)"
    ),
    "quality_report": _quality(_report("led")),
    "quality_report_lines": _quality(
        "SELECT id_root, position, message FROM issues WHERE id_root IN (SELECT id_root FROM bad) "
        "ORDER BY updated_at DESC NULLS FIRST, id_root, position LIMIT 50"
    ),
    "quality_newest": _quality(
        _report("newest"), scope=f"newest AS (SELECT * FROM led {_NEWEST} LIMIT 100)"
    ),
    "quality_ledger_constraints": _led(_LEDGER_BROKEN),
    "quality_ledger_constraint_counts": _led(
        f"SELECT rule, count(*) AS violations FROM ({_LEDGER_BROKEN}) GROUP BY rule"
    ),
    "quality_ledger_duplicates": _q(
        LED,
        "shared AS (SELECT * REPLACE (CASE WHEN substr(id_root, 11, 2) <> '07' THEN left(id_root, 10) END AS id_root) FROM led)",
        select=_broken(_LEDGER_RULES, "shared", "id_root") + " UNION ALL SELECT id_root, 'id_root_duplicate' "
        "FROM shared WHERE id_root IS NOT NULL GROUP BY id_root HAVING count(*) > 1",
    ),
    "monitoring_constraints": _q(
        LED, MON,
        select=_broken(_MONITORING_RULES, "mon", "id, id_root")
        + " UNION ALL SELECT id, id_root, 'id_root_unknown' FROM mon "
        "WHERE id_root NOT IN (SELECT id_root FROM led)",
    ),
    "sync_counts": _q(
        LED, FEED,
        select="SELECT s AS source_count, t AS target_count, abs(s - t) AS difference, s = t AS in_sync "
        f"FROM (SELECT count(*) FILTER (WHERE NOT {_GONE}) AS s, "
        f"count(*) FILTER (WHERE {_KEPT}) AS t FROM led)",
    ),
    "sync_diff": _q(
        LED, FEED,
        select="SELECT id_root, state FROM (SELECT id_root, "
        + _CHANGE_STATE.format(new="missing", gone="extra", changed="changed")
        + " AS state FROM led) WHERE state IS NOT NULL",
    ),
}

# ---- loads and streams ---------------------------------------------------------------------

LOADED = (
    "id_root, klaster_regional, entitas_terminal, tahun_rkap, type_investasi, " + _dbl("rkap", "rkap") + ", "
    + ", ".join(_dbl(c, c) for c in ("total_rkap_bulanan", "total_realisasi", "total_prognosa"))
    + ", latitude, longitude, updated_at"
)
_AFTER_DELETES = _q(LED, FEED, _conf(), select=f"SELECT {LOADED} FROM conf WHERE NOT {_GONE}")
_MALFORMED = "event_type = 'view' AND seq % 10 = 0"
_ANONYMOUS = "event_type = 'click' AND seq % 10 = 1"
GOOD = (
    f"good AS (SELECT * FROM feed WHERE NOT ({_MALFORMED}) AND NOT ({_ANONYMOUS})), "
    "goodgone AS (SELECT id_root FROM (SELECT *, row_number() OVER (PARTITION BY id_root "
    "ORDER BY timestamp DESC, seq DESC) AS place FROM good) WHERE place = 1 AND operation = 'DELETE')"
)

_AFTER_FEED = _q(
    LED, FEED, GOOD, _changed("good", "goodgone"), _conf("daemon", "changed"),
    select=f"SELECT {LOADED} FROM conf",
)


def _fed(view: str, keys: str, condition: str = "true") -> str:
    """A view over every row once and the re-synced rows once more."""
    return _q(
        LED, FEED, _changed(),
        "fed AS (SELECT * FROM led UNION ALL SELECT * FROM changed "
        "WHERE id_root IN (SELECT id_root FROM feed))",
        _conf("daemon", "fed"),
        select=f"SELECT {view} FROM conf WHERE {condition} GROUP BY {keys}",
    )


_MOMENTS = "conf JOIN (VALUES ('during', 1996), ('after', 99999)) m(moment, until) ON tahun_rkap <= until"
_PUBLISHED = _conformed(
    f"SELECT moment, 'all' AS type_investasi, {COUNT}, {_sum('rkap', 'total_rkap')} FROM {_MOMENTS} GROUP BY moment "
    f"UNION ALL SELECT moment, type_investasi, {COUNT}, {_sum('rkap', 'total_rkap')} FROM {_MOMENTS} "
    "GROUP BY moment, type_investasi"
)

LOADS = {
    "full_load": _conformed(f"SELECT {LOADED} FROM conf"),
    "incremental_load": _AFTER_DELETES,
    "compacted_load": _AFTER_DELETES,
    "stored_year_summary": _conformed(
        f"SELECT {REGIONAL} FROM conf WHERE tahun_rkap = 1998 GROUP BY klaster_regional"
    ),
    "changed_rows": _led(
        "SELECT id_root, CAST(rkap AS DOUBLE) AS rkap, updated_at FROM led WHERE updated_at > TIMESTAMP '1999-01-01 00:00:00'"
    ),
    "stream_apply": _AFTER_FEED,
    "stream_ties": _AFTER_FEED,
    "mixed_writers": _AFTER_FEED,
    "snapshot_tail": _AFTER_FEED,
    "stream_clock": _AFTER_FEED,
    "stream_skipped_counts": _q(
        FEED,
        select=f"SELECT 'malformed' AS reason, count(*) FILTER (WHERE {_MALFORMED}) AS observed, "
        f"nullif(count(*) FILTER (WHERE {_MALFORMED}), 0) AS kept FROM feed UNION ALL "
        f"SELECT 'missing_id', count(*) FILTER (WHERE {_ANONYMOUS}), nullif(count(*) FILTER (WHERE {_ANONYMOUS}), 0) FROM feed",
    ),
    "published_reports": _PUBLISHED,
    "stream_rejects": _q(
        FEED,
        select=f"SELECT seq, 'malformed' AS reason FROM feed WHERE {_MALFORMED} "
        f"UNION ALL SELECT seq, 'missing_id' FROM feed WHERE {_ANONYMOUS}",
    ),
    "stream_summary": _fed(V_BUDGET, "tahun_rkap, klaster_regional"),
    "stream_summary_progress": _fed(V_PROGRESS, "tahun_rkap, klaster_regional, entitas_terminal"),
    "stream_summary_issues": _fed(
        V_ISSUES, "tahun_rkap, klaster_regional, status_issue", "issue_description <> ''"
    ),
    "stream_summary_monthly": _fed(V_MONTHLY, "tahun_rkap, klaster_regional"),
    "stream_summary_investment_type": _fed(V_TYPE, "tahun_rkap, type_investasi"),
}

ORACLES: dict[str, str] = {**REPORTS, **SHAPES, **CHANGES, **QUALITY, **LOADS}
