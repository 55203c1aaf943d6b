from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import labels, money


def value_of(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def dec(text):
    return F.lit(Decimal(text))


@pytest.mark.parametrize(
    ("value", "text"),
    [("1000000", "Rp 1.000.000.00"), ("0.125", "Rp 0.12"), ("0.135", "Rp 0.14"), ("-1234.5", "Rp -1.234.50")],
)
def test_currency(spark, value, text):
    assert value_of(spark, money.format_currency(dec(value))) == text


def test_currency_of_null_and_text(spark):
    assert value_of(spark, money.format_currency(F.lit(None).cast("decimal(18,2)"))) == "Rp 0"
    assert value_of(spark, money.format_currency(F.lit("n/a"))) == "n/a"
    assert value_of(spark, money.format_currency(F.lit("1500.5"))) == "Rp 1.500.50"
    assert value_of(spark, money.format_currency(F.lit(2.5))) == "Rp 2.50"


@pytest.mark.parametrize(
    ("part", "whole", "text"),
    [(50, 100, "50.0%"), (50, 0, "0%"), (50, None, "0%"), (1, 400, "0.2%"), (3, 400, "0.8%"),
     (12345, 10, "123450.0%")],
)
def test_percentage(spark, part, whole, text):
    got = money.format_percentage(F.lit(part), F.lit(whole).cast("int"))
    assert value_of(spark, got) == text


def test_percentage_of_no_number(spark):
    assert value_of(spark, money.format_percentage(F.lit(None).cast("int"), F.lit(5))) == "N/A"
    assert value_of(spark, money.format_percentage(F.lit("x"), F.lit(5))) == "N/A"


def test_short_texts(spark):
    assert value_of(spark, money.billions_text(dec("12345678900.00"))) == "Rp 12.35B"
    assert value_of(spark, money.millions_text(dec("1234567890.00"))) == "Rp 1,235Jt"
    assert value_of(spark, money.listing_text(dec("1234567.00"))) == "Rp 1,234,567"
    assert value_of(spark, money.listing_text(dec("0"))) == "-"
    assert value_of(spark, money.listing_text(F.lit(None).cast("decimal(18,2)"))) == "-"


def test_ratio_is_guarded(spark):
    assert value_of(spark, money.ratio(dec("5"), dec("0"), 100)) == 0.0
    assert value_of(spark, money.ratio(dec("5"), dec("-1"), 100)) == 0.0
    assert value_of(spark, money.ratio(dec("5"), dec("8"), 100)) == 62.5


@pytest.mark.parametrize(
    ("value", "name"), [(0, "red"), (29.99, "red"), (30, "orange"), (60, "yellow"), (80, "green"), (200, "green")]
)
def test_bands_include_their_lower_bound(spark, value, name):
    assert value_of(spark, labels.band(F.lit(value), labels.YTD_BANDS, labels.YTD_BASE)) == name


def test_month_number(spark):
    for text, number in (("januari", 1), ("DESEMBER", 12), ("Mei", 5), ("may", 0), ("", 0)):
        assert value_of(spark, labels.month_number(F.lit(text))) == number
    assert value_of(spark, labels.month_number(F.lit(None).cast("string"))) is None


def test_label(spark):
    assert value_of(spark, labels.or_label(F.lit(""), "none")) == "none"
    assert value_of(spark, labels.or_label(F.lit("x"), "none")) == "x"


def test_percentage_at_full_precision(spark):
    assert value_of(spark, money.format_percentage(F.lit("0.00001"), F.lit("0.00004"))) == "25.0%"
    assert value_of(spark, money.format_percentage(F.lit("1"), F.lit("0"))) == "N/A"
    assert value_of(spark, money.format_percentage(F.lit(1), F.lit(0))) == "0%"


def test_percentage_rounds_the_exact_value_and_ties_to_even(spark):
    """Against decimal arithmetic to 28 digits; near-ties lie within the last digits of it."""
    whole = ["117382.22", "3", "-7", "0.01", "800", "16", "99999999999999.99", "123456789.01"]
    part = ["365352.16", "1", "-2", "0", "9.99", "0.5", "1.25", "249.9999999", "99999999999999.99", "0.0001"]
    # Ties at every second tenth, and one cent beside them.
    pairs = [(a, b) for a in part for b in whole]
    pairs += [(str(Decimal(k) / 8 + d), "100") for k in range(0, 60) for d in (Decimal(0), Decimal("0.0000000001"), Decimal("-0.0000000001"))]
    pairs += [(str(Decimal(2 * k + 1) * 5), "10000") for k in range(50)]
    df = spark.createDataFrame(pairs, "a string, b string").selectExpr("CAST(a AS DECIMAL(30,10)) a", "CAST(b AS DECIMAL(30,10)) b")
    for row in df.select("a", "b", money.format_percentage(F.col("a"), F.col("b")).alias("text")).collect():
        # Zero keeps the sign that dividing gives it.
        assert row.text == f"{row.a / row.b * 100:.1f}%", row


def test_percentage_of_wide_numbers(spark):
    assert value_of(spark, money.format_percentage(F.lit("9" * 18), F.lit("0.0000000001"))) == f"{Decimal('9' * 18) * 10**12:.1f}%"
    assert value_of(spark, money.format_percentage(F.lit("-0.01"), F.lit("1000"))) == "-0.0%"
    assert value_of(spark, money.format_percentage(F.lit("abc"), F.lit("0.0"))) == "N/A"
