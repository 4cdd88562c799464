import math
from datetime import date, timedelta

from pyspark.sql import functions as F

from finstrata.operators import series as S


def _bars(spark, closes, key=1):
    rows = [(key, date(2024, 1, 1) + timedelta(i), round(c * 10000), round((c + 1) * 10000), round((c - 1) * 10000), 100 + i) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "k long, d date, close long, high long, low long, volume long")


def test_moving_average(spark):
    got = lambda cs, n: [r.m for r in _bars(spark, cs).select("d", S.sma(F.col("close"), ["k"], "d", n).alias("m")).orderBy("d").collect()]
    assert got([10, 20, 30], 3) == [None, None, 200000]
    assert got([2, 4, 6, 8, 10], 3) == [None, None, 40000, 60000, 80000]
    assert got([1], 3) == [None] and got([], 3) == []


def test_half_even(spark):
    rows = [(5, 2, 2), (7, 2, 4), (-5, 2, -2), (-7, 2, -4), (10, 4, 2), (11, 4, 3), (9, 3, 3), (-1, 3, 0)]
    df = spark.createDataFrame(rows, "t long, n long, want long").withColumn("got", S.half_even(F.col("t"), F.col("n")))
    assert all(r.got == r.want for r in df.collect())


def test_smoothers_by_hand(spark):
    closes = [100 + 0.05 * i + 3 * math.sin(i / 12) for i in range(80)]
    got = S.smoothers(_bars(spark, closes), ["k"], "d").orderBy("d").collect()
    units = [round(c * 10000) for c in closes]

    def ema(xs, n):
        out, e = [None] * (n - 1), round(sum(xs[:n]) / n)
        out.append(e)
        for x in xs[n:]:
            e = round((2 * x + (n - 1) * e) / (n + 1))
            out.append(e)
        return out

    e12, e26 = ema(units, 12), ema(units, 26)
    assert [r.ema12 for r in got] == e12 and [r.ema26 for r in got] == e26
    macd = [a - b for a, b in zip(e12[25:], e26[25:])]
    assert [r.macd for r in got][25:] == macd
    assert [r.signal for r in got][33:] == ema(macd, 9)[8:]
    up, down = [max(b - a, 0) for a, b in zip(units, units[1:])], [max(a - b, 0) for a, b in zip(units, units[1:])]
    u, d = sum(up[:14]) / 14, sum(down[:14]) / 14
    want = [None] * 14 + [round(100 - 100 / (1 + u / d), 2) if d else 100.0]
    for a, b in zip(up[14:], down[14:]):
        u, d = (u * 13 + a) / 14, (d * 13 + b) / 14
        want.append(round(100 - 100 / (1 + u / d), 2) if d else 100.0)
    assert [r.rsi14 for r in got] == want
    assert [r.atr14 for r in got][:13] == [None] * 13 and got[13].atr14 == 20000
    assert S.smoothers(_bars(spark, []), ["k"], "d").count() == 0
    assert all(r.ema12 is None and r.rsi14 is None for r in S.smoothers(_bars(spark, [1, 2, 3]), ["k"], "d").collect())


def test_returns_streaks_drawdown(spark):
    b = _bars(spark, [90, 100, 102, 104, 106, 108, 110])
    assert [r.r for r in b.select("d", S.trailing_return("close", ["k"], "d", 5).alias("r")).orderBy("d").collect()][-1] == 10.0
    s = S.streaks(_bars(spark, [5, 6, 7, 7, 6, 5, 6]), "close", ["k"], "d").orderBy("d").collect()
    assert [r.streak for r in s] == [0, 1, 2, 0, -1, -2, 1]
    assert S.drawdowns(_bars(spark, [100, 120, 90, 130, 117]), "close", ["k"], "d").first().max_drawdown == 25.0


def test_as_of_join(spark):
    px = spark.createDataFrame([(1, date(2024, 1, 2), 5), (1, date(2024, 1, 5), 6), (1, date(2024, 1, 6), None)], "k long, d date, p long")
    ev = spark.createDataFrame([(1, 1, date(2024, 1, 1)), (2, 1, date(2024, 1, 2)), (3, 1, date(2024, 1, 4)), (4, 1, date(2024, 1, 9)), (5, 2, date(2024, 1, 9))], "e int, k long, t date")
    assert {r.e: r.p for r in S.as_of_join(ev, px, ["k"], "t", "d", "p").collect()} == {1: None, 2: 5, 3: 5, 4: 6, 5: None}


def test_split_factor_is_strict(spark):
    splits = spark.createDataFrame([(1, date(2024, 1, 10), 2, 1), (1, date(2024, 2, 10), 3, 2), (1, date(2024, 3, 10), 5, 0)], "k long, effective_date date, numerator int, denominator int")
    rows = spark.createDataFrame([(1, 1, date(2024, 1, 9)), (2, 1, date(2024, 1, 10)), (3, 1, date(2024, 2, 10)), (4, 2, date(2024, 1, 1))], "i int, k long, d date")
    assert {r.i: float(r.factor) for r in S.split_factor(rows, splits, "k", "d", "i").collect()} == {1: 3.0, 2: 1.5, 3: 1.0, 4: 1.0}


def test_average_cross(spark):
    b = _bars(spark, [5, 4, 3, 2, 1, 9, 9, 9]).withColumns({"fast": S.sma(F.col("close"), ["k"], "d", 2), "slow": S.sma(F.col("close"), ["k"], "d", 3)})
    r = S.crosses(b, "fast", "slow", ["k"], "d").first()
    assert (r["cross"], r.cross_date) == ("golden", date(2024, 1, 6))
