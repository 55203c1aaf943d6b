from decimal import Decimal
from functools import reduce

from pyspark.sql import functions as F

from ledgerloom.operators import filters, shape
from ledgerloom.operators.conform import conform
from ledgerloom.plans import reports, views
from ledgerloom.schema import MONTH_NAMES, REALISASI_MONTHS, RKAP_MONTHS
from ledgerloom.sources import fixture
from tests.conftest import SMALL, rows, stamp, zeros


def project(key, region="West", **more):
    base = {
        "id_root": key, "klaster_regional": region, "tahun_rkap": 2025, "rkap": 100,
        "nilai_kontrak": 10, "kebutuhan_dana": 5,
        **zeros(REALISASI_MONTHS), **zeros(RKAP_MONTHS),
    }
    return base | more


def test_a_null_month_drops_the_row_from_a_strict_sum(make):
    led = make(
        project("A", realisasi_januari=40),
        project("B", realisasi_januari=25, realisasi_mei=None),
    )
    row = reports.regional_summary(led).first()
    assert row.total_realisasi == 40 and row.total_rkap == 200 and row.project_count == 2
    # Month by month, B's January still counts.
    assert reports.monthly_actuals(led).first().januari == 65
    # The lenient detail total reads the missing month as 0.
    assert rows(shape.detail(led), "id_root", "realisasi_text") == [("A", "Rp 40.00"), ("B", "Rp 25.00")]


def test_all_null_sums_stay_null_unless_filled(make):
    led = make(project("A", rkap=None, nilai_kontrak=None, realisasi_juni=None))
    assert reports.regional_summary(led).first().total_rkap is None
    filled = reports.regional_summary_filled(led).first()
    assert (filled.total_rkap, filled.total_nilai_kontrak, filled.total_realisasi) == (0, 0, 0)
    assert reports.regional_absorption(led).first().serapan == 0.0


def test_open_counts_differ_between_source_and_conformed(make):
    led = make(project("A", status_issue="Open"), project("B"), project("C", status_issue="Closed"))
    assert rows(reports.open_closed_totals(led)) == [(1, 1)]
    assert rows(reports.open_closed_totals(conform(led))) == [(2, 1)]


def test_null_and_empty_status_share_a_label_but_not_a_row(make):
    led = make(project("A"), project("B", status_investasi=""), project("C", status_investasi="Tender"),
               project("D", status_investasi="Tender"))
    got = [tuple(r) for r in reports.status_summary(led).collect()]
    assert got == [("Tender", 2), ("Belum Ditentukan", 1), ("Belum Ditentukan", 1)]
    assert [tuple(r) for r in reports.status_top(led, 1).collect()] == [("Tender", 2)]


def test_sort_places_nulls_as_the_source_does(make):
    led = make(
        project("A", updated_at=stamp("2025-01-01T00:00:00"), asset_categories="Z"),
        project("B", rkap=None, asset_categories=None),
        project("C", updated_at=stamp("2025-02-01T00:00:00"), asset_categories="Y", rkap=300),
    )
    assert [r.id_root for r in reports.latest_page(led, 2).collect()] == ["B", "C"]
    assert [r.id_root for r in reports.latest_page(led, 2, 1).collect()] == ["C", "A"]
    assert [r.id_root for r in reports.top_budget(led, 2).collect()] == ["B", "C"]
    table = reports.category_budget_table(led).collect()
    assert [(r.no, r.nama_aktiva) for r in table] == [(1, "Y"), (2, "Z"), (3, None)]


def test_category_ratio_colour_reads_percent(make):
    led = make(project("A", asset_categories="Quay", rkap=1_000_000, realisasi_januari=600_000,
                       realisasi_desember=500_000))
    row = reports.category_budget_table(led).first()
    assert row.capaian == 0.6 and row.color == "green"
    assert row.rkap_transfer == 0.85 and row.taksasi == 0.9 and row.sd_bulan_realisasi == 0.6
    full = reports.category_band(led).first()
    assert (full.cap_text, full.color) == ("110.0%", "#2ecc71")


def test_footer_totals_the_table_in_one_more_row(make):
    led = make(project("A", asset_categories="Quay", rkap=1_000_000),
               project("B", asset_categories=None, rkap=500_000))
    footer = reports.category_budget_footer(led).collect()
    assert [(r.is_total, r.nama_aktiva, r.rkap_awal) for r in footer] == [
        (False, "Quay", 1.0), (False, None, 0.5), (True, None, 1.5),
    ]


def test_rounding_modes(make):
    # 2.345 % rounds half-up to 2.35 in the year-to-date figure, half-even to 2.34 by category.
    led = make(project("A", asset_categories="Quay", rkap=100_000, realisasi_januari=2345))
    assert float(reports.ytd_achievement(led).first().capaian) == 2.35
    assert float(reports.category_achievement(led).first().capaian) == 2.34


def test_kpi_bands_and_texts(make):
    led = make(*(project(k, status_issue="Open", rkap=2_000_000_000) for k in "ABC"))
    assert reports.kpi_totals(led).first().color == "yellow"
    card = reports.kpi_overview(led).first()
    assert (card.rkap_text, card.pct_text, card.open_issues) == ("Rp 6.00B", "0.0%", 3)
    assert reports.kpi_investment(led).first().rkap_text == "Rp 6,000Jt"


def test_empty_ledger_gives_zero_cards(make):
    led = make(project("A")).where("false")
    assert rows(reports.kpi_overview(led), "project_count", "total_rkap", "pct") == [(0, 0, 0.0)]
    assert reports.ytd_achievement(led).first().capaian == 0.0


def test_year_filter_treats_none_and_zero_as_all(make):
    led = make(project("A", tahun_rkap=2024), project("B"))
    assert filters.for_year(led, None).count() == filters.for_year(led, 0).count() == 2
    assert rows(filters.for_year(led, 2024), "id_root") == [("A",)]


def test_search_takes_wildcards_and_any_case(make):
    led = make(project("A", entitas_terminal="Pier 10"), project("B", entitas_terminal="PIER 20"),
               project("C"))
    assert rows(filters.search(led, terminal="pier"), "id_root") == [("A",), ("B",)]
    assert rows(filters.search(led, terminal="r _0"), "id_root") == [("A",), ("B",)]
    assert rows(filters.search(led, terminal="1%"), "id_root") == [("A",)]
    assert filters.search(led).count() == 3
    assert filters.search(led, region="East", terminal="").count() == 0


def test_equal_to_skips_none_only(make):
    led = make(project("A", pic=""), project("B", pic="x"))
    assert filters.equal_to(led, pic=None).count() == 2
    assert rows(filters.equal_to(led, pic=""), "id_root") == [("A",)]


def test_facets(make):
    led = make(project("A", status_issue=""), project("B", status_issue="Open"), project("C"))
    values = {(r.facet, r.value): (r.label, r.project_count) for r in filters.facet_values(led).collect()}
    assert values[("status_issue", "")] == ("N/A", 1)
    assert values[("klaster_regional", "West")] == ("West", 3)
    assert values[("tahun_rkap", "2025")] == ("2025", 3)
    assert ("type_investasi", None) not in values and len(values) == 4
    assert filters.facet_filter(led, status_issue="").count() == 3
    assert filters.facet_filter(led, status_issue="Open", tahun_rkap=2025).count() == 1


def test_key_lookup_ignores_repeats(spark, make):
    led = make(project("A"), project("B"))
    keys = spark.createDataFrame([("A",), ("A",), ("Z",)], "id_root string")
    assert rows(filters.by_keys(led, keys), "id_root") == [("A",)]


def test_detail_hides_issue_fields_without_an_issue(make):
    led = make(
        project("A", project_definition="x" * 150, status_issue="Open"),
        project("B", issue_description="y" * 250, pic="", status_issue="Open"),
    )
    a, b = sorted(shape.detail(led).collect(), key=lambda r: r.id_root)
    assert len(a.project_definition) == 100 and a.issue_status is None and a.issue_text is None
    assert len(b.issue_text) == 200 and b.issue_pic == "-" and b.issue_status == "Open"


def test_map_needs_both_coordinates(make):
    led = make(project("A", latitude=1.0, longitude=2.0), project("B", latitude=1.0))
    assert rows(shape.map_points(led), "id_root") == [("A",)]


# ---- the reports agree with each other ----


def test_trend_equals_twelve_scans(spark):
    led = fixture.ledger(spark, SMALL)
    branches = [
        led.agg(F.sum(c).alias("value")).select(F.lit(n).alias("month"), F.lit(i).alias("month_order"), "value")
        for i, (n, c) in enumerate(zip(MONTH_NAMES, REALISASI_MONTHS, strict=True), start=1)
    ]
    literal = reduce(lambda a, b: a.unionByName(b), branches)
    assert rows(reports.monthly_trend(led)) == rows(literal)


def test_views_add_up_to_the_regional_summary(spark):
    led = conform(fixture.ledger(spark, SMALL))
    columns = ["project_count", "total_rkap", "total_nilai_kontrak", "total_realisasi"]
    rolled = views.budget_actual(led).groupBy("klaster_regional").agg(*(F.sum(c).alias(c) for c in columns))
    assert rows(rolled, "klaster_regional", *columns) == rows(
        reports.regional_summary(led), "klaster_regional", *columns
    )


def test_trend_adds_up_to_the_total(spark):
    led = fixture.ledger(spark, SMALL)
    trend = reports.monthly_trend(led).agg(F.sum("value")).first()[0]
    assert trend == reports.kpi_totals(led).first().total_realisasi


def test_readers_merge_partial_rows(spark, make):
    led = conform(make(project("A", rkap=100, realisasi_mei=50), project("B", rkap=300, realisasi_mei=50)))
    parts = views.budget_actual(led.where("id_root = 'A'")).unionByName(
        views.budget_actual(led.where("id_root = 'B'"))
    )
    got = views.read_budget_actual(parts).collect()
    assert len(got) == 1
    assert (got[0].project_count, got[0].total_rkap, got[0].persen_serapan) == (2, 400, 25.0)


def test_type_reader_sorts_by_declared_order(make):
    led = conform(make(*(project(str(i), type_investasi=t) for i, t in enumerate(
        ["Carry Forward", "Multi Year", "Murni"]))))
    got = [r.type_investasi for r in views.read_investment_type(views.investment_type(led)).collect()]
    assert got == ["Murni", "Multi Year", "Carry Forward"]


def test_s_curve_accumulates(make):
    led = make(project("A", rkap_januari=10, rkap_maret=5, realisasi_februari=4))
    curve = reports.s_curve(led).collect()
    assert [r.month_order for r in curve] == list(range(1, 13))
    assert [r.cum_plan for r in curve][:4] == [Decimal(10), Decimal(10), Decimal(15), Decimal(15)]
    assert [r.cum_actual for r in curve][:3] == [Decimal(0), Decimal(4), Decimal(4)]


def test_readers_add_up_partial_rows_of_the_same_key(make):
    led = make(
        {"id_root": "a", "tahun_rkap": 2024, "klaster_regional": "R", "type_investasi": "Murni", "rkap": 10},
        {"id_root": "b", "tahun_rkap": 2024, "klaster_regional": "R", "type_investasi": "Murni", "rkap": 30},
        {"id_root": "c", "tahun_rkap": 2024, "klaster_regional": None, "type_investasi": "Carry Forward"},
    )
    whole = views.investment_type(led)
    fed = [views.investment_type(led.where(f"id_root = '{i}'")) for i in "abc"]
    partial = fed[0].unionByName(fed[1]).unionByName(fed[2])
    assert partial.count() == 3 and whole.count() == 2
    assert views.read_investment_type(partial).collect() == views.read_investment_type(whole).collect()
    assert [r.type_investasi for r in views.read_investment_type(partial).collect()] == ["Murni", "Carry Forward"]


def test_enriched_rows_come_newest_first_where_asked(make):
    led = make(
        {"id_root": "b", "updated_at": stamp("2024-01-01")}, {"id_root": "a", "updated_at": stamp("2024-01-01")},
        {"id_root": "c", "updated_at": stamp("2024-02-01")}, {"id_root": "d"},
    )
    assert [r.id_root for r in shape.enriched(led, ordered=True).collect()] == ["d", "c", "a", "b"]
