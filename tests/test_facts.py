import random
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from finstrata.operators import facts as X


def test_pick_best(spark):
    rows = [
        (1, "Rev", "10-K", date(2023, 1, 1), date(2023, 12, 31), date(2024, 2, 1), "a", 10), (1, "Rev", "10-K", date(2023, 1, 1), date(2023, 12, 31), date(2024, 5, 1), "b", 11),
        (1, "Sales", "10-K", date(2023, 1, 1), date(2023, 12, 31), date(2024, 6, 1), "c", 12), (1, "Rev", "8-K", date(2023, 1, 1), date(2023, 12, 31), date(2024, 7, 1), "d", 13),
        (1, "Rev", "10-K", date(2020, 1, 1), date(2024, 12, 31), date(2025, 1, 1), "e", 14), (1, "Other", "10-K", None, date(2025, 1, 1), None, "f", 15), (2, "Rev", "10-K", None, date(2023, 1, 1), None, "g", 16),
    ]
    df = spark.createDataFrame(rows, "k int, concept string, form string, period_start date, period_end date, filed date, accession string, v int")
    pick = lambda **kw: {r.k: r.v for r in X.pick_best(df, ["k"], ["Rev", "Sales"], ["10-K", "8-K"], **kw).collect()}
    assert pick() == {1: 11, 2: 16} and pick(as_first_reported=True)[1] == 10


def test_fourth_quarters(spark):
    rows = [(1, "FY", date(2023, 1, 1), date(2023, 12, 31), 100), (1, "FY", date(2023, 10, 1), date(2023, 12, 31), 30), (2, "FY", date(2023, 10, 1), date(2023, 12, 31), 9)]
    df = spark.createDataFrame(rows, "k int, fiscal_period string, period_start date, period_end date, v int")
    assert [(r.k, r.v) for r in X.with_fourth_quarters(df, ["k"]).filter("fiscal_period = 'Q4'").collect()] == [(1, 30)]


def test_reconcile(spark):
    m = spark.createDataFrame([(1, "a", "f1", 60), (1, "b", "f1", 40), (1, "a", "f2", 70), (2, "a", "f1", 5), (2, "a", "f2", 6), (2, "b", "f1", 1)], "k int, member string, filing string, v long")
    t = spark.createDataFrame([(1, 100), (2, 0)], "k int, t long")
    got = sorted((r.k, r.member, r.v, r.reconciled) for r in X.reconcile(m, t, ["k"], "v", "t", "filing").collect())
    assert got == [(1, "a", 60, True), (1, "b", 40, True), (2, "a", 6, False), (2, "b", 1, False)]


def test_subsets_as_brute_force():
    import itertools

    r = random.Random(1)
    for _ in range(300):
        vs, t = [r.randrange(-9, 20) for _ in range(r.randrange(1, 8))], r.randrange(-5, 40)
        got = X.subset_with_sum(vs, t)
        want = any(sum(c) == t for n in range(1, len(vs) + 1) for c in itertools.combinations(vs, n))
        assert (got is not None) == (want and not (t == 0 and got is None)) or (t == 0 and got is None and want)
        if got:
            assert sum(vs[i] for i in got) == t
    assert X.subset_with_sum(list(range(1, 40)), -1) is None and X.subset_with_sum([5, 2, 3], 5, 2) == [1, 2]
    with pytest.raises(X.Unfinished):
        X.subset_with_sum([2] * 40, 41, most_nodes=5000)


def test_rollups(spark):
    rows = [(1, y, m, v) for y in (1, 2) for m, v in (("a", 10.0 * y), ("b", 5.0), ("c", 7.0), ("sum", 10.0 * y + 12))] + [(2, 1, "a", 1.0), (2, 1, "b", 2.0), (2, 1, "ab", 3.0), (3, 1, None, None)]
    df = spark.createDataFrame(rows, "k int, p int, m string, v double")
    got = X.without_rollups(df, ["k"], "p", "m", "v")
    assert {(r.k, r.m) for r in got.collect()} == {(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (2, "ab"), (3, None)} and got.filter("not searched").count() == 0
    wide = spark.createDataFrame([(1, 1, f"m{i}", float(i)) for i in range(13)], "k int, p int, m string, v double")
    assert [r.searched for r in X.without_rollups(wide, ["k"], "p", "m", "v").collect()] == [False] * 13  # left whole and told
    assert X.without_rollups(df.limit(0), ["k"], "p", "m", "v").count() == 0


def test_schemes(spark):
    rows = [(1, m, v, 60.0) for m, v in (("a", 10.0), ("b", 20.0), ("c", 30.0), ("x", 25.0), ("y", 35.0))]  # two schemes of one total
    rows += [(2, m, v, 60.0) for m, v in (("a", 10.0), ("b", 50.0))] + [(3, m, v, 60.0) for m, v in (("a", 10.0), ("b", 50.0), ("c", 7.0))] + [(4, None, None, None)]
    df = spark.createDataFrame(rows, "k int, m string, v double, t double").withColumn("collapsed", F.lit("clash"))
    got = X.collapse_schemes(df, ["k"], "m", "v", "t").collect()
    assert {(r.k, r.m) for r in got} == {(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (3, "a"), (3, "b"), (3, "c"), (4, None)}
    assert {r.k for r in got if r.collapsed} == {1} and all(r.searched for r in got)
    assert X.collapse_schemes(df.limit(0), ["k"], "m", "v", "t").count() == 0


def test_scale_errors_statement_margin_ratio(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([100.0, 120_000.0, 110.0, 0.0001, 130.0, None])], "k int, p int, v double")
    assert [r.scale_error for r in X.scale_errors(df, ["k"], "p", "v").orderBy("p").collect()] == [None, 1000, None, 1_000_000, None, None]
    f = spark.createDataFrame([(1, "Sales", date(2023, 1, 1), 5), (1, "Cost", date(2023, 1, 1), 3), (1, "Revenue", date(2022, 1, 1), 9)], "k int, concept string, period_end date, value int")
    got = X.statement(f, [("Revenue", ["Revenue", "Sales"]), ("Cost", ["Cost"])], ["k"]).orderBy("line_no").collect()
    assert [(r.line, r.concept, r.value) for r in got] == [("Revenue", "Sales", 5), ("Cost", "Cost", 3)]
    a, b = spark.createDataFrame([(1, 200.0), (2, 0.0)], "k int, value double"), spark.createDataFrame([(1, 50.0), (2, 1.0)], "k int, value double")
    assert [(r.k, r.margin) for r in X.margins(a, b, ["k"]).collect()] == [(1, 25.0)]
    texts = ["Each ADS represents two ordinary shares", "each American Depositary Share representing 1,000 Class A ordinary shares", "one ADR represents one-half ordinary", "no ratio", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(X.depositary_ratio(F.col("t")).alias("r")).collect()
    assert [r.r for r in got] == [Decimal(2), Decimal(1000), Decimal("0.5"), None, None]
