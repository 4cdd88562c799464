from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from finstrata.operators.units import named_units, rate_periods, solve_units, to_whole_usd

CASES = [
    ("USD", None, "USD", 1), ("iso4217:EUR", "", "EUR", 1), (" usd ", "Net sales (in thousands)", "USD", 1000), ("$", "Net sales - amounts in thousands", "USD", 1000),
    ("USD'000", None, "USD", 1000), ("US$000s", None, "USD", 1000), ("kUSD", "x (in millions)", "USD", 1000), ("TSEK", None, "SEK", 1000), ("MUSD", None, "USD", 10**6),
    ("USDm", None, "USD", 10**6), ("SFr. bn", None, "CHF", 10**9), ("thousands of BRL", None, "BRL", 1000), ("C$ million", None, "CAD", 10**6), ("JPYbn", None, "JPY", 10**9),
    ("shares", "in US dollars", None, 1), ("USD/shares", None, None, 1), ("pure", None, None, 1), ("acre", "Sales in USD millions", None, 10**6),
    (None, "Net sales, in euros", "EUR", 1), (None, "Sales in USD millions", "USD", 10**6), (None, "Sales, thousands of pounds sterling", "GBP", 1000), (None, "Sales (€ thousands)", "EUR", 1000),
    (None, "Sales (R$ billions)", "BRL", 10**9), ("EUR", "Sales to thousands of small accounts, whole currency", "EUR", 1), ("EUR", "Fees on two million cards in issue, full amounts", "EUR", 1),
    ("EUR", "Sales (thousands, except per share data)", "EUR", 1000), ("EUR", "Sales in mio.", "EUR", 10**6), ("EUR", "Sales ('000s)", "EUR", 1000), ("EUR", "Sales (mn)", "EUR", 10**6),
    (None, None, None, 1), ("", "", None, 1),
]


def test_units_that_text_names(spark):
    df = spark.createDataFrame([(i, u, c) for i, (u, c, _, _) in enumerate(CASES)], "i int, unit string, caption string").withColumn("scale", F.lit("clash"))
    got = {r.i: (r.currency, r.scale) for r in named_units(df, F.col("unit"), F.col("caption")).collect()}
    for i, (u, c, currency, scale) in enumerate(CASES):
        assert got[i][0] == currency, (u, c, got[i])
        if currency:
            assert got[i][1] == scale, (u, c, got[i])


def test_conversion_at_the_last_known_rate(spark):
    rates = spark.createDataFrame(
        [("EUR", date(2020, 1, 3), Decimal("1.1")), ("EUR", date(2020, 1, 10), None), ("EUR", date(2020, 3, 6), Decimal("1.2")), (None, date(2020, 1, 1), Decimal("9"))],
        "currency string, obs_date date, value decimal(18,6)",
    )
    rows = spark.createDataFrame(
        [(1, "EUR", 1000, Decimal("2.5"), date(2020, 1, 3)), (2, "EUR", 1, Decimal("2.5"), date(2020, 3, 5)), (3, "EUR", 1, Decimal("-2.5"), date(2020, 3, 6)), (4, "EUR", 1, Decimal("1"), date(2020, 1, 2)),
         (5, "USD", 1000, Decimal("0.0005"), date(1990, 1, 1)), (6, "EUR", 1, Decimal("1"), None), (7, "EUR", 1, None, date(2020, 5, 5)), (8, None, 1, Decimal("1"), date(2020, 5, 5)), (9, "EUR", 10**9, Decimal("5.5"), date(2031, 7, 1))],
        "i int, currency string, scale long, value decimal(24,4), d date",
    ).withColumn("rate", F.lit("clash")).withColumn("from_date", F.lit("clash"))
    got = {r.i: r.amount_usd for r in to_whole_usd(rows, "value", "d", rate_periods(rates, "currency", "obs_date", "value")).collect()}
    assert got == {1: 2750, 2: 3, 3: -3, 5: 1, 7: None, 9: 6_600_000_000}
    assert to_whole_usd(rows.limit(0), "value", "d", rate_periods(rates, "currency", "obs_date", "value")).count() == 0


def test_identity_picks_one_factor_or_none(spark):
    rows = [(1, 1000.0, 1_020_000.0), (2, 1000.0, 990.0), (3, 5.0, 5_100_000.0), (4, 1000.0, 2_000_000.0), (5, None, 1.0), (6, 0.0, 1.0), (7, 10.0, -5.0)]
    df = spark.createDataFrame(rows, "i int, x double, y double")
    got = {r.i: (r.factor, r.solutions) for r in solve_units(df, "x", F.col("y"), [1, 1000, 10**6]).collect()}
    assert got == {1: (1000, 1), 2: (1, 1), 3: (10**6, 1), 4: (None, 0), 5: (None, 0), 6: (None, 0), 7: (None, 0)}
    two = {r.i: (r.factor, r.solutions) for r in solve_units(df, "x", F.col("y"), [1000, 1010]).collect()}
    assert two[1] == (None, 2)  # not unique: flagged, not converted
