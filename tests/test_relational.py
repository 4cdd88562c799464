from datetime import date

import pytest
from pyspark.sql import functions as F

from finstrata.operators import relational as R


def test_where_all_leaves_out_what_is_none(spark):
    df = spark.createDataFrame([(1, "a", date(2020, 1, 1)), (2, "b", date(2020, 6, 1)), (3, None, None)], "i int, s string, d date")
    ids = lambda **k: sorted(r.i for r in R.where_all(df, **k).collect())
    assert ids(i=None, s=None) == [1, 2, 3]
    assert ids(s=["a", "b"]) == [1, 2] and ids(d=(None, "2020-01-01")) == [1] and ids(d=("2020-01-01", "2020-06-01")) == [1, 2] and ids(i=3) == [3]


def test_like_patterns_stand_for_themselves(spark):
    df = spark.createDataFrame([("50% off",), ("500 off",), ("a_b",), ("aXb",), ("c\\d",), (None,)], "s string")
    hits = lambda t: [r.s for r in df.filter(R.contains_text(F.col("s"), t)).collect()]
    assert hits("50%") == ["50% off"] and hits("A_B") == ["a_b"] and hits("c\\d") == ["c\\d"]


def test_whole_words(spark):
    df = spark.createDataFrame([("First Bank",), ("Bankers",), ("BANK, N.A.",), ("e-bank2",)], "s string")
    assert [r.s for r in df.filter(R.whole_word(F.col("s"), "bank")).collect()] == ["First Bank", "BANK, N.A."]


def test_two_quarter_activity(spark):
    rows = [(1, 7, "2024-09-30", 1000, 1_000_000), (1, 7, "2024-12-31", 1500, 1_650_000), (2, 7, "2024-09-30", 1000, 1_000_000), (2, 7, "2024-12-31", 600, 660_000), (3, 7, "2024-12-31", 750, 825_000), (4, 8, "2024-06-30", 5, 5)]
    df = spark.createDataFrame(rows, "h long, s long, d string, shares long, value long").withColumn("d", F.to_date("d"))
    r = R.period_activity(df, ["s"], "h", "d", "2024-12-31", "2024-09-30", ["shares", "value"]).collect()
    assert len(r) == 1 and (r[0].current_shares, r[0].previous_shares, r[0].current_value, r[0].previous_value, r[0].current_filers, r[0].previous_filers) == (2850, 2000, 3_135_000, 2_000_000, 3, 2)
    c = R.churn(df, "s", "h", "d", "2024-12-31", "2024-09-30").first()
    assert (c.new_filers, c.sold_out_filers, c.kept_filers) == (1, 0, 2)


def test_carry_forward_and_gone(spark):
    rows = [(1, "a", "2024-09-30"), (1, "b", "2024-09-30"), (1, "a", "2024-12-31"), (2, "a", "2024-09-30")]
    df = spark.createDataFrame(rows, "h long, s string, d string").withColumn("d", F.to_date("d"))
    got = sorted((r.h, r.s, str(r.d)) for r in R.carry_forward(df, "h", "d", "2024-12-31", "2024-09-30").collect())
    assert got == [(1, "a", "2024-12-31"), (2, "a", "2024-09-30")]
    assert [tuple(r) for r in R.gone_among_filers(df, "s", "h", "d", "2024-12-31", "2024-09-30").select("h", "s").collect()] == [(1, "b")]


def test_percentiles_and_composite(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 20.0), (4, None), (5, 40.0)], "i int, v double")
    assert {r.i: r.p for r in R.with_percentile(df, "v", "p").collect()} == {1: 0.0, 2: 50.0, 3: 50.0, 4: None, 5: 100.0}
    many = spark.range(3000).withColumn("v", (F.col("id") * 7919 % 1500).cast("double")).withColumn("p", F.lit("clash"))
    for chunks in (2, 256):
        got = {r.v: r.p for r in R.with_percentile(many, "v", "p", chunks).collect()}
        assert len(got) == 1500 and all(got[float(k)] == pytest.approx((2 * k + 0.5) / 2999 * 100) for k in range(1500))
    assert R.with_percentile(df.filter("i = 1"), "v", "p").first().p == 50.0 and R.with_percentile(df.limit(0), "v", "p").count() == 0
    assert R.with_percentile(df.filter("i = 4"), "v", "p").first().p is None
    c = spark.createDataFrame([(100.0, None), (50.0, 0.0), (None, None)], "a double, b double").select(R.weighted_composite({"a": 0.7, "b": 0.3}).alias("c"))
    assert [r.c for r in c.collect()] == [pytest.approx(100.0), pytest.approx(35.0), None]


def test_tiers_and_pages(spark):
    df = spark.createDataFrame([(i,) for i in range(5)], "i int")
    assert sorted(r.i for r in R.resolve_tiers([R.never(df), df.filter("i < 2").union(df.filter("i < 2")), df], "i").collect()) == [0, 1]
    assert [r.i for r in R.page(df, ["i"], 2, 1).collect()] == [1, 2] and R.page(df, ["i"], -5, -5).count() == 1
