"""Ordered-series operators over bars.

Prices are handled as whole ten-thousandths, so that sums are exact and rounding half to even
is the same everywhere. Windows serve all but the recursive smoothers, which fold along the
series in a vectorised kernel; a series of daily bars is bounded by its days.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finstrata.core.scans import chunked_scan
from finstrata.core.streams import stream_groups
from finstrata.operators.known_at import day_number

UNIT = 10_000


def units(c: Column | str) -> Column:
    """A price in whole ten-thousandths."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,4)").__mul__(UNIT).cast("bigint")


def half_even(total: Column, n: int | Column) -> Column:
    """total / n rounded half to even, for whole numbers; n > 0."""
    n = F.lit(n) if isinstance(n, int) else n
    q = ((total - F.pmod(total, n)) / n).cast("bigint")
    r = F.pmod(total, n)
    up = (2 * r > n) | ((2 * r == n) & (F.pmod(q, F.lit(2)) == 1))
    return q + F.when(up, 1).otherwise(0)


def _w(keys: list[str], order: str):
    return Window.partitionBy(*keys).orderBy(order)


def _full(value: Column, keys: list[str], order: str, n: int) -> Column:
    """``value`` once n bars are there, else null."""
    return F.when(F.row_number().over(_w(keys, order)) >= n, value)


def sma(c: Column, keys: list[str], order: str, n: int) -> Column:
    """Mean of the last n values in units, null until there are n."""
    total = F.sum(c).over(_w(keys, order).rowsBetween(-(n - 1), 0))
    return _full(half_even(total, n), keys, order, n)


def bollinger(df: DataFrame, c: str, keys: list[str], order: str, n: int = 20, k: float = 2.0) -> DataFrame:
    """Adds the middle band in units, upper and lower band, %B and bandwidth (population deviation)."""
    w = _w(keys, order).rowsBetween(-(n - 1), 0)
    x = F.col(c).cast("double") / UNIT
    mean, dev = F.avg(x).over(w), F.stddev_pop(x).over(w)
    out = df.withColumns({"_m": _full(mean, keys, order, n), "_s": _full(dev, keys, order, n)})
    width = 2 * k * F.col("_s")
    low = F.col("_m") - k * F.col("_s")
    return out.withColumns({
        "middle": sma(F.col(c), keys, order, n), "upper": F.round(F.col("_m") + k * F.col("_s"), 3), "lower": F.round(low, 3),
        "percent_b": F.when(width > 1e-9, F.round((x - low) / width, 3) + 0.0), "bandwidth": F.when(F.col("_m") != 0, F.round(width / F.col("_m"), 4)),
    }).drop("_m", "_s")


def stochastic(df: DataFrame, keys: list[str], order: str, n: int = 14, d: int = 3) -> DataFrame:
    """Adds percent_k (in ten-thousandths of a percent, 50 when flat) and percent_d, its mean."""
    w = _w(keys, order).rowsBetween(-(n - 1), 0)
    hi, lo = F.max("high").over(w), F.min("low").over(w)
    k = F.when(hi == lo, F.lit(50 * UNIT).cast("bigint")).otherwise(half_even((F.col("close") - lo) * 100 * UNIT, F.when(hi == lo, F.lit(1)).otherwise(hi - lo)))
    with_k = df.withColumn("percent_k", _full(k, keys, order, n))
    known = F.count("percent_k").over(_w(keys, order).rowsBetween(-(d - 1), 0))
    total = F.sum("percent_k").over(_w(keys, order).rowsBetween(-(d - 1), 0))
    return with_k.withColumn("percent_d", F.when(known == d, half_even(total, d)))


def obv(keys: list[str], order: str) -> Column:
    """Running volume, signed by the close's move; 0 at the first bar."""
    w = _w(keys, order)
    move = F.col("close") - F.lag("close").over(w)
    # nested windows aren't allowed, so callers add the signed volume first
    return F.when(move > 0, F.col("volume")).when(move < 0, -F.col("volume")).otherwise(F.lit(0))


def on_balance_volume(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    signed = df.withColumn("_signed", obv(keys, order))
    return signed.withColumn("obv", F.sum("_signed").over(_w(keys, order).rowsBetween(Window.unboundedPreceding, 0))).drop("_signed")


def trailing_return(c: str, keys: list[str], order: str, n: int) -> Column:
    """Percent change over n bars; null without a positive base."""
    return percent_change(F.col(c), F.lag(c, n).over(_w(keys, order)))


def percent_change(now: Column, base: Column) -> Column:
    """Change in percent, rounded half to even at 2 places from whole units; null without a positive base."""
    return F.when(base > 0, half_even((now - base) * 10_000, F.when(base > 0, base)) / 100.0)


def with_calendar_returns(df: DataFrame, c: str, keys: list[str], order: str) -> DataFrame:
    prev = df.withColumn("_prev", F.lag(c).over(_w(keys, order)))
    out = prev
    for part, name in (("month", "mtd"), ("year", "ytd")):
        w = Window.partitionBy(*keys, F.trunc(F.col(order), part)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        base = F.first("_prev").over(w)
        out = out.withColumn(name, percent_change(F.col(c), base))
    return out.drop("_prev")


def streaks(df: DataFrame, c: str, keys: list[str], order: str) -> DataFrame:
    """Adds the signed length of the run of moves in one direction that each bar ends."""
    w = _w(keys, order)
    sign = df.withColumn("_sign", F.coalesce(F.signum((F.col(c) - F.lag(c).over(w)).cast("double")), F.lit(0.0)).cast("int"))
    brk = sign.withColumn("_new", (F.col("_sign") != F.coalesce(F.lag("_sign").over(w), F.lit(9))).cast("int"))
    run = brk.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(order))
    return run.withColumn("streak", n * F.col("_sign")).drop("_sign", "_new", "_run")


def crosses(df: DataFrame, fast: str, slow: str, keys: list[str], order: str, within: int = 5) -> DataFrame:
    """The latest cross of two averages within each series' last ``within`` pairs of bars."""
    w = _w(keys, order)
    pairs = df.withColumns({"_pf": F.lag(fast).over(w), "_ps": F.lag(slow).over(w), "_back": F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))})
    golden = (F.col("_pf") <= F.col("_ps")) & (F.col(fast) > F.col(slow))
    death = (F.col("_pf") >= F.col("_ps")) & (F.col(fast) < F.col(slow))
    hits = pairs.filter((F.col("_back") <= within) & (golden | death)).withColumn("cross", F.when(golden, "golden").otherwise("death"))
    return hits.groupBy(*keys).agg(F.max_by("cross", order).alias("cross"), F.max(order).alias("cross_date"))


def drawdowns(df: DataFrame, c: str, keys: list[str], order: str) -> DataFrame:
    """The deepest fall from a running peak of each series, in percent."""
    peak = F.max(c).over(_w(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_peak", peak).groupBy(*keys).agg(
        F.round(F.max(F.when(F.col("_peak") > 0, (F.col("_peak") - F.col(c)) * 100.0 / F.col("_peak"))), 4).alias("max_drawdown")
    )


def year_range(df: DataFrame, keys: list[str], order: str, days: int = 365) -> DataFrame:
    """Adds the high and low of the last ``days`` days, and whether the series is shorter than that."""
    day = F.unix_date(F.col(order))
    w = Window.partitionBy(*keys).orderBy(day).rangeBetween(-days, 0)
    first = F.min(order).over(Window.partitionBy(*keys))
    return df.withColumns({
        "high_52w": F.max("high").over(w), "low_52w": F.min("low").over(w), "is_short": F.date_diff(F.col(order), first) < days,
    })


def vwap_distance(df: DataFrame, keys: list[str], order: str, most: int = 65, least: int = 20) -> DataFrame:
    """Last close against the volume-weighted close of the last ``most`` bars, where there are enough."""
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    last = df.withColumn("_back", back).filter(F.col("_back") <= most)
    x = F.col("close") * F.col("volume").cast("decimal(20,0)")
    g = last.groupBy(*keys).agg(F.sum(x).alias("cv"), F.sum("volume").alias("v"), F.avg("close").alias("m"), F.max_by("close", order).alias("c"), F.count("*").alias("n"))
    vwap = F.when(F.col("v") > 0, F.col("cv").cast("double") / F.col("v")).otherwise(F.col("m"))
    return g.filter(F.col("n") >= least).select(*keys, F.round(F.col("c") / vwap - 1, 6).alias("above_vwap"))


def _ema(x: np.ndarray, n: int) -> list[int | None]:
    """EMA in units: seeded by the mean of n, each step rounded half to even and fed back."""
    out: list[int | None] = [None] * len(x)
    if len(x) < n:
        return out

    def div(a: int, b: int) -> int:
        q, r = divmod(a, b)
        return q + (2 * r > b or (2 * r == b and q % 2 == 1))

    e = div(int(x[:n].sum()), n)
    out[n - 1] = e
    for i in range(n, len(x)):
        e = div(2 * int(x[i]) + (n - 1) * e, n + 1)
        out[i] = e
    return out


def _wilder(x: np.ndarray, n: int) -> np.ndarray:
    """Wilder's smoothing: seeded by the mean of the first n, unrounded after."""
    out = np.full(len(x), np.nan)
    if len(x) < n:
        return out
    a = float(np.mean(x[:n]))
    out[n - 1] = a
    for i in range(n, len(x)):
        a = (a * (n - 1) + float(x[i])) / n
        out[i] = a
    return out


def smoothers(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, date, ema12, ema26, macd, signal, histogram, rsi14, atr14) by one fold a series.

    Bars need close, high and low in units. Prices come back in units, RSI rounded to 2 places,
    ATR to units. Rows with a null close are left out; null highs or lows make the range unknown,
    which counts as the close.
    """
    kinds = dict(df.dtypes)

    def fold(tbl: pa.Table, starts: np.ndarray) -> pa.Table:
        ends = np.append(starts[1:], tbl.num_rows)
        close, high, low = (tbl.column(k).to_numpy() for k in ("close", "high", "low"))
        e12: list = []
        e26: list = []
        sig: list = []
        rsi, atr = np.full(len(close), np.nan), np.full(len(close), np.nan)
        for a, b in zip(starts.tolist(), ends.tolist()):
            c = close[a:b]
            x, y = _ema(c, 12), _ema(c, 26)
            line = [p - q for p, q in zip(x, y) if p is not None and q is not None]
            s = _ema(np.array(line, dtype=np.int64), 9)
            e12 += x
            e26 += y
            sig += [None] * (len(c) - len(line)) + s
            move = np.diff(c).astype(float)
            up, down = _wilder(np.maximum(move, 0), 14), _wilder(np.maximum(-move, 0), 14)
            with np.errstate(invalid="ignore", divide="ignore"):
                r = np.where(down == 0, 100.0, 100 - 100 / (1 + up / down))
            r[np.isnan(up)] = np.nan
            rsi[a + 1 : b] = r
            prev = np.concatenate(([c[0]], c[:-1])) if len(c) else c
            tr = np.maximum(high[a:b] - low[a:b], np.maximum(np.abs(high[a:b] - prev), np.abs(low[a:b] - prev))).astype(float)
            if len(c):
                tr[0] = high[a] - low[a]
            atr[a:b] = _wilder(tr, 14)
        macd = [p - q if p is not None and q is not None else None for p, q in zip(e12, e26)]
        none = lambda v: pa.array(v, pa.int64())
        cols = {k: tbl.column(k) for k in [*keys, order]}
        return pa.table(cols | {
            "ema12": none(e12), "ema26": none(e26), "macd": none(macd), "signal": none(sig),
            "histogram": none([m - s if m is not None and s is not None else None for m, s in zip(macd, sig)]),
            "rsi14": pa.array(np.round(rsi, 2), pa.float64(), from_pandas=True), "atr14": pa.array(np.round(atr, 0), pa.float64(), from_pandas=True),
        })

    bars = df.filter(F.col("close").isNotNull()).select(*keys, order, "close", F.coalesce("high", "close").alias("high"), F.coalesce("low", "close").alias("low"))
    head = ", ".join(f"{k} {kinds[k]}" for k in [*keys, order])
    return stream_groups(bars, keys, [order], fold, f"{head}, ema12 bigint, ema26 bigint, macd bigint, signal bigint, histogram bigint, rsi14 double, atr14 double")


def as_of_join(events: DataFrame, prices: DataFrame, keys: list[str], at: str, date: str, value: str, days: int = 64) -> DataFrame:
    """Each event with the last value on or before its day: one union, scanned in chunks of ``days`` days.

    No range join, and a hot key's rows are cut into chunks of time. Of several values on a day the greatest
    counts. An event without an earlier value, key or time keeps a null. ``value`` must not be a column of ``events``.
    """
    kind = dict(prices.dtypes)[value]
    whole = F.col(at).isNotNull()
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    row = F.struct(*events.columns)
    left = events.filter(whole).select(*keys, day_number(F.col(at)).alias("_t"), F.lit(1).alias("_kind"), row.alias("_row"), F.lit(None).cast(kind).alias(value))
    known = prices.filter(F.col(value).isNotNull() & F.col(date).isNotNull())
    right = known.select(*keys, day_number(F.col(date)).alias("_t"), F.lit(0).alias("_kind"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), value)
    both = chunked_scan(left.unionByName(right), keys, F.floor(F.col("_t") / days), ["_t", "_kind"], {
        "_last": ("max_upto", F.when(F.col("_kind") == 0, F.struct(F.col("_t").alias("t"), F.col(value).alias("v")))),
    })
    found = both.filter(F.col("_kind") == 1).select("_row.*", F.col("_last")["v"].alias(value))
    return found.unionByName(events.filter(~F.coalesce(whole, F.lit(False))).withColumn(value, F.lit(None).cast(kind)))


def split_factor(rows: DataFrame, splits: DataFrame, key: str, as_of: str, row_id: str) -> DataFrame:
    """Adds ``factor``: the product of numerator/denominator of later splits (strictly), as decimal.

    Ratios are multiplied as decimals, not by logarithms. Splits with a zero part are left out.
    """
    s = splits.filter((F.col("numerator") > 0) & (F.col("denominator") > 0)).select(
        F.col(key).alias("_k"), "effective_date", (F.col("numerator") / F.col("denominator")).cast("decimal(20,10)").alias("_ratio")
    )
    later = rows.join(s, (F.col(key) == F.col("_k")) & (F.col("effective_date") > F.col(as_of)))
    product = later.groupBy(F.col(row_id).alias("_id")).agg(
        F.aggregate(F.collect_list("_ratio"), F.lit(1).cast("decimal(30,10)"), lambda a, x: (a * x).cast("decimal(30,10)")).alias("factor")
    )
    return rows.join(product, F.col(row_id) == F.col("_id"), "left").drop("_id").withColumn("factor", F.coalesce("factor", F.lit(1).cast("decimal(30,10)")))


def grow(rows: DataFrame, weight: str, ratio: str, by: list[str]) -> DataFrame:
    """Value-weighted growth of each group: sum(weight * ratio) / sum(weight)."""
    g = rows.filter((F.col(weight) > 0) & F.col(ratio).isNotNull()).groupBy(*by).agg(
        (F.sum(F.col(weight).cast("double") * F.col(ratio)) / F.sum(F.col(weight).cast("double"))).alias("growth"), F.count("*").alias("positions")
    )
    return g


def listing_splits(splits: DataFrame, rows: DataFrame, stock: str, series: str, ticker: str, name: str) -> DataFrame:
    """Splits of each listing of ``rows``, keyed by ``name`` ("stock:ticker"): those that name it or, being null, none."""
    listings = rows.select(stock, ticker).distinct()
    j = splits.join(listings, stock).filter(F.col(series).isNull() | (F.col(series) == F.col(ticker)))
    return j.withColumn(name, F.concat_ws(":", stock, ticker))


def clone_daily(rows: DataFrame, prices: DataFrame, wait: int = 45, last: int = 150) -> DataFrame:
    """(institutional_holder_id, day, mark): each holder's clone marked to market by session, from 100.

    Bought by value ``wait`` days after a report at the last close, held to ``wait`` days after the next, or
    ``last`` days. Closes are carried forward over sessions once a stock (bounded by stocks x sessions), so
    positions meet them by equality on (stock, session), not by range.
    """
    who, stock = "institutional_holder_id", "common_stock_id"
    px = prices.groupBy(stock, "bar_date").agg(F.max("close").alias("close"))
    cal = px.select(F.col("bar_date").alias("_s")).distinct().withColumn("_o", F.row_number().over(Window.orderBy("_s")))  # one row a session
    upto = cal.withColumn("_to", F.coalesce(F.lead("_s").over(Window.orderBy("_s")), F.date_add("_s", wait + last + 400)))
    by_day = upto.select(F.explode(F.sequence("_s", F.date_sub("_to", 1))).alias("_d"), "_o")
    at = lambda df, c, name: df.join(F.broadcast(by_day.select(F.col("_d").alias(c), F.col("_o").alias(name))), c, "left")
    w = Window.partitionBy(stock).orderBy("_o")
    held = px.join(F.broadcast(cal), px["bar_date"] == cal["_s"]).select(stock, "close", "_o")
    end = F.coalesce(F.lead("_o").over(w) - 1, F.lit(cal.count()))
    dense = held.withColumn("_end", end).select(stock, "close", F.explode(F.sequence("_o", "_end")).alias("_o"))

    sums = rows.select("holding_id", who, stock, "report_date", "value").distinct().filter(F.col(who).isNotNull() & F.col(stock).isNotNull() & F.col("report_date").isNotNull())
    b = sums.groupBy(who, "report_date", stock).agg(F.sum("value").cast("double").alias("v"))
    dates = b.select(who, "report_date").distinct()
    then = F.lead("report_date").over(Window.partitionBy(who).orderBy("report_date"))
    dates = dates.withColumns({"_buy": F.date_add("report_date", wait), "_sell": F.coalesce(F.date_add(then, wait), F.date_add("report_date", wait + last))})
    dates = at(at(dates, "_buy", "_b"), "_sell", "_e").filter(F.col("_b") < F.col("_e")).select(who, "report_date", "_b", "_e")
    bought = b.join(dates, [who, "report_date"]).join(dense.select(stock, F.col("close").alias("_c0"), F.col("_o").alias("_b")), [stock, "_b"])
    marks = bought.select(who, "report_date", stock, "v", "_c0", F.explode(F.sequence(F.col("_b") + 1, F.col("_e"))).alias("_o")).join(dense, [stock, "_o"])
    g = marks.groupBy(who, "report_date", "_o").agg((F.sum(F.col("v") * F.col("close") / F.col("_c0")) / F.sum("v")).alias("g"))
    path = Window.partitionBy(who).orderBy("report_date").rowsBetween(Window.unboundedPreceding, -1)
    ends = g.groupBy(who, "report_date").agg(F.max_by("g", "_o").alias("_last")).withColumn("_before", F.coalesce(F.product("_last").over(path), F.lit(1.0))).drop("_last")
    return g.join(ends, [who, "report_date"]).join(F.broadcast(cal), "_o").select(who, F.col("_s").alias("day"), (100 * F.col("_before") * F.col("g")).alias("mark"))


def restate_history(bars: DataFrame, splits: DataFrame, key: str, date: str, price: str) -> DataFrame:
    """Adds ``restated``: the price over all later splits, newest first, rounded half to even at each step.

    Rounding at each step is part of the result, so the ratios aren't multiplied up first.
    """
    s = splits.filter((F.col("numerator") > 0) & (F.col("denominator") > 0)).groupBy(F.col(key).alias("_k")).agg(
        F.reverse(F.array_sort(F.collect_list(F.struct("effective_date", F.col("numerator").cast("bigint").alias("n"), F.col("denominator").cast("bigint").alias("d"))))).alias("_s")
    )
    joined = bars.join(s, F.col(key) == F.col("_k"), "left")
    later = F.filter(F.coalesce("_s", F.array().cast("array<struct<effective_date:date,n:bigint,d:bigint>>")), lambda x: x["effective_date"] > F.col(date))
    return joined.withColumn("restated", F.aggregate(later, F.col(price), lambda p, x: half_even(p * x["d"], x["n"]))).drop("_k", "_s")


def window_after_warm_up(df: DataFrame, indicator: Column, name: str, date: str, first: str) -> DataFrame:
    """An indicator over whole series, shown from ``first`` on: the bars before warm it up."""
    return df.withColumn(name, indicator).filter(F.col(date) >= F.lit(first).cast("date"))


def usable_start(positions: DataFrame, prices: DataFrame, group: list[str], key: str, since: str, date: str) -> DataFrame:
    """(group, usable_from): the first date from which every position has had a price.

    A position without any price makes its group's date null.
    """
    first = prices.groupBy(key).agg(F.min(date).alias("_first"))
    j = positions.select(*group, key, since).distinct().join(first, key, "left")
    ready = F.greatest(F.col("_first"), F.col(since))
    return j.groupBy(*group).agg(F.when(F.count_if(F.col("_first").isNull()) == 0, F.max(ready)).alias("usable_from"))
