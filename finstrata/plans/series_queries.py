"""Queries over ordered series: indicators, returns, as-of and range joins, scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from finstrata.core.tables import table
from finstrata.operators import relational as R
from finstrata.operators import series as S
from finstrata.plans.views import BARS, bars, day, half_even_sql

QUERIES, ORACLES = {}, {}
K, D = ["common_stock_id"], "bar_date"
B = BARS
W = "(PARTITION BY common_stock_id ORDER BY bar_date)"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _frame(n: int) -> str:
    return f"(PARTITION BY common_stock_id ORDER BY bar_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


_D = "common_stock_id, strftime(bar_date, '%Y-%m-%d') AS bar_date"


@query("""SELECT series_id, strftime(obs_date, '%Y-%m-%d') AS obs_date, CAST(value AS DOUBLE) AS value FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY obs_date DESC) AS rn FROM fred_observation WHERE value IS NOT NULL) WHERE rn = 1""")
def win_latest_per_key(spark, d):
    rows = table(spark, d, "fred_observation").filter(F.col("value").isNotNull())
    return R.nth_latest(rows, ["series_id"], [F.desc("obs_date")]).select("series_id", day("obs_date").alias("obs_date"), F.col("value").cast("double").alias("value"))


@query("""SELECT series_id, strftime(obs_date, '%Y-%m-%d') AS obs_date, CAST(value AS DOUBLE) AS value FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY obs_date DESC) AS rn FROM fred_observation WHERE value IS NOT NULL) WHERE rn = 2""")
def win_second_latest(spark, d):
    rows = table(spark, d, "fred_observation").filter(F.col("value").isNotNull())
    return R.nth_latest(rows, ["series_id"], [F.desc("obs_date")], 2).select("series_id", day("obs_date").alias("obs_date"), F.col("value").cast("double").alias("value"))


@query(f"SELECT {_D}, CAST(CASE WHEN row_number() OVER {W} >= 20 THEN {half_even_sql('s', '20')} END AS BIGINT) AS sma20 FROM (SELECT *, CAST(sum(close) OVER {_frame(20)} AS BIGINT) AS s FROM {B})")
def win_sma(spark, d):
    """Simple moving average in ten-thousandths, rounded half to even."""
    return bars(spark, d).select(*K, day(D).alias(D), S.sma(F.col("close"), K, D, 20).alias("sma20"))


@query(f"""WITH m AS (SELECT *, row_number() OVER {W} AS rn, avg(close / 10000.0) OVER {_frame(20)} AS m, stddev_pop(close / 10000.0) OVER {_frame(20)} AS s, CAST(sum(close) OVER {_frame(20)} AS BIGINT) AS t FROM {B})
SELECT {_D}, CAST(CASE WHEN rn >= 20 THEN {half_even_sql('t', '20')} END AS BIGINT) AS middle, CASE WHEN rn >= 20 THEN round(m + 2 * s, 3) END AS upper, CASE WHEN rn >= 20 THEN round(m - 2 * s, 3) END AS lower,
CASE WHEN rn >= 20 AND 4 * s > 1e-9 THEN round((close / 10000.0 - (m - 2 * s)) / (4 * s), 3) + 0.0 END AS percent_b, CASE WHEN rn >= 20 AND m <> 0 THEN round(4 * s / m, 4) END AS bandwidth FROM m""")
def win_bollinger(spark, d):
    return S.bollinger(bars(spark, d), "close", K, D).select(*K, day(D).alias(D), "middle", "upper", "lower", "percent_b", "bandwidth")


_ST = f"(SELECT common_stock_id, bar_date, close, row_number() OVER {W} AS rn, max(high) OVER {_frame(14)} AS hi, min(low) OVER {_frame(14)} AS lo FROM {B})"
_STK = f"(SELECT common_stock_id, bar_date, rn, CASE WHEN rn >= 14 THEN CASE WHEN hi = lo THEN 500000 ELSE {half_even_sql('(close - lo) * 1000000', '(CASE WHEN hi = lo THEN 1 ELSE hi - lo END)')} END END AS k FROM {_ST})"


@query(f"SELECT {_D}, CAST(k AS BIGINT) AS percent_k, CAST(CASE WHEN rn >= 16 THEN {half_even_sql('t', '3')} END AS BIGINT) AS percent_d FROM (SELECT *, CAST(sum(k) OVER {_frame(3)} AS BIGINT) AS t FROM {_STK})")
def win_stochastic(spark, d):
    return S.stochastic(bars(spark, d), K, D).select(*K, day(D).alias(D), "percent_k", "percent_d")


@query(f"SELECT {_D}, CAST(sum(v) OVER {W} AS BIGINT) AS obv FROM (SELECT *, CASE WHEN close > lag(close) OVER {W} THEN volume WHEN close < lag(close) OVER {W} THEN -volume ELSE 0 END AS v FROM {B})")
def win_on_balance_volume(spark, d):
    return S.on_balance_volume(bars(spark, d), K, D).select(*K, day(D).alias(D), "obv")


def _percent(base: str) -> str:
    return f"CASE WHEN {base} > 0 THEN {half_even_sql(f'(close - {base}) * 10000', f'CASE WHEN {base} > 0 THEN {base} END')} / 100.0 END"


@query(f"SELECT {_D}, " + ", ".join(f"{_percent(f'b{n}')} AS r{n}" for n in (5, 20, 120)) + f" FROM (SELECT *, lag(close, 5) OVER {W} AS b5, lag(close, 20) OVER {W} AS b20, lag(close, 120) OVER {W} AS b120 FROM {B})")
def win_trailing_returns(spark, d):
    return bars(spark, d).select(*K, day(D).alias(D), *[S.trailing_return("close", K, D, n).alias(f"r{n}") for n in (5, 20, 120)])


def _to_date(part: str) -> str:
    return f"first_value(p) OVER (PARTITION BY common_stock_id, date_trunc('{part}', bar_date) ORDER BY bar_date)"


@query(f"SELECT {_D}, {_percent('m')} AS mtd, {_percent('y')} AS ytd FROM (SELECT *, {_to_date('month')} AS m, {_to_date('year')} AS y FROM (SELECT *, lag(close) OVER {W} AS p FROM {B}))")
def win_calendar_returns(spark, d):
    """Month and year to date, from the last bar before the period."""
    return S.with_calendar_returns(bars(spark, d), "close", K, D).select(*K, day(D).alias(D), "mtd", "ytd")


@query(f"""WITH s AS (SELECT *, coalesce(CAST(sign(close - lag(close) OVER {W}) AS INT), 0) AS sg FROM {B}), n AS (SELECT *, CASE WHEN sg <> coalesce(lag(sg) OVER {W}, 9) THEN 1 ELSE 0 END AS nw FROM s), r AS (SELECT *, sum(nw) OVER {W} AS run FROM n)
SELECT {_D}, CAST(row_number() OVER (PARTITION BY common_stock_id, run ORDER BY bar_date) * sg AS INT) AS streak FROM r""")
def win_streaks(spark, d):
    return S.streaks(bars(spark, d), "close", K, D).select(*K, day(D).alias(D), F.col("streak").cast("int").alias("streak"))


_SM = f"(SELECT common_stock_id, bar_date, CASE WHEN rn >= 5 THEN {half_even_sql('f', '5')} END AS fast, CASE WHEN rn >= 20 THEN {half_even_sql('s', '20')} END AS slow FROM (SELECT *, row_number() OVER {W} AS rn, CAST(sum(close) OVER {_frame(5)} AS BIGINT) AS f, CAST(sum(close) OVER {_frame(20)} AS BIGINT) AS s FROM {B}))"


@query(f"""WITH p AS (SELECT *, lag(fast) OVER {W} AS pf, lag(slow) OVER {W} AS ps, row_number() OVER (PARTITION BY common_stock_id ORDER BY bar_date DESC) AS back FROM {_SM}),
h AS (SELECT common_stock_id, bar_date, CASE WHEN fast > slow THEN 'golden' ELSE 'death' END AS c FROM p WHERE back <= 40 AND ((pf <= ps AND fast > slow) OR (pf >= ps AND fast < slow)))
SELECT common_stock_id, arg_max(c, bar_date) AS "cross", strftime(max(bar_date), '%Y-%m-%d') AS cross_date FROM h GROUP BY 1""")
def win_average_cross(spark, d):
    averages = bars(spark, d).withColumns({"fast": S.sma(F.col("close"), K, D, 5), "slow": S.sma(F.col("close"), K, D, 20)})
    return S.crosses(averages, "fast", "slow", K, D, 40).select(*K, "cross", day("cross_date").alias("cross_date"))


@query(f"SELECT common_stock_id, round(max((peak - close) * 100.0 / peak), 4) AS max_drawdown FROM (SELECT *, max(close) OVER {W} AS peak FROM {B}) GROUP BY 1")
def win_max_drawdown(spark, d):
    return S.drawdowns(bars(spark, d), "close", K, D)


@query(f"""SELECT {_D}, max(high) OVER w AS high_52w, min(low) OVER w AS low_52w, date_diff('day', min(bar_date) OVER (PARTITION BY common_stock_id), bar_date) < 365 AS is_short FROM {B}
WINDOW w AS (PARTITION BY common_stock_id ORDER BY bar_date RANGE BETWEEN INTERVAL 365 DAY PRECEDING AND CURRENT ROW)""")
def win_year_range(spark, d):
    return S.year_range(bars(spark, d), K, D).select(*K, day(D).alias(D), "high_52w", "low_52w", "is_short")


@query(f"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY common_stock_id ORDER BY bar_date DESC) AS back FROM {B}), g AS (SELECT common_stock_id, CAST(sum(CAST(close AS HUGEINT) * volume) AS DOUBLE) / CAST(sum(volume) AS DOUBLE) AS v, arg_max(close, bar_date) AS c, count(*) AS n FROM b WHERE back <= 65 GROUP BY 1)
SELECT common_stock_id, round(c / v - 1, 6) AS above_vwap FROM g WHERE n >= 20""")
def win_vwap_distance(spark, d):
    return S.vwap_distance(bars(spark, d), K, D)


_N = f"(SELECT *, row_number() OVER {W} AS rn FROM {B})"


def _ema_sql(n: int, src: str = "close", rel: str = _N, first: int = 1) -> str:
    seed = f"SELECT common_stock_id, {first + n - 1} AS rn, {half_even_sql('CAST(sum(' + src + ') AS BIGINT)', str(n))} AS e FROM {rel} WHERE rn BETWEEN {first} AND {first + n - 1} GROUP BY 1 HAVING count(*) = {n}"
    step = half_even_sql(f"2 * b.{src} + {n - 1} * a.e", str(n + 1))
    return f"({seed} UNION ALL SELECT b.common_stock_id, b.rn, {step} FROM e{n} a JOIN {rel} b ON b.common_stock_id = a.common_stock_id AND b.rn = a.rn + 1)"


@query(f"""WITH RECURSIVE n AS MATERIALIZED {_N}, e12(common_stock_id, rn, e) AS {_ema_sql(12, rel='n')}, e26(common_stock_id, rn, e) AS {_ema_sql(26, rel='n')}
SELECT n.common_stock_id, strftime(n.bar_date, '%Y-%m-%d') AS bar_date, CAST(a.e AS BIGINT) AS ema12, CAST(b.e AS BIGINT) AS ema26, CAST(a.e - b.e AS BIGINT) AS macd FROM n LEFT JOIN e12 a ON a.common_stock_id = n.common_stock_id AND a.rn = n.rn LEFT JOIN e26 b ON b.common_stock_id = n.common_stock_id AND b.rn = n.rn""")
def win_ema(spark, d):
    """Exponential averages that feed back their rounded value, and their difference."""
    return S.smoothers(bars(spark, d), K, D).select(*K, day(D).alias(D), "ema12", "ema26", "macd")


def _wilder_sql(name: str, x: str, rel: str, first: int) -> str:
    """Wilder's smoothing over 14 values of ``rel``: seeded by their mean, then folded."""
    seed = f"SELECT common_stock_id, CAST({first + 13} AS BIGINT), CAST(sum({x}) AS DOUBLE) / 14 FROM {rel} WHERE rn BETWEEN {first} AND {first + 13} GROUP BY 1 HAVING count(*) = 14"
    return f"{name}(common_stock_id, rn, a) AS ({seed} UNION ALL SELECT b.common_stock_id, b.rn, (w.a * 13 + CAST(b.{x} AS DOUBLE)) / 14 FROM {name} w JOIN {rel} b ON b.common_stock_id = w.common_stock_id AND b.rn = w.rn + 1)"


_MRA = f"""WITH RECURSIVE n AS MATERIALIZED (SELECT *, greatest(close - lag(close) OVER w, 0) AS up, greatest(lag(close) OVER w - close, 0) AS down,
 CASE WHEN lag(close) OVER w IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr FROM {_N} WINDOW w AS (PARTITION BY common_stock_id ORDER BY bar_date)),
e12(common_stock_id, rn, e) AS {_ema_sql(12, rel='n')}, e26(common_stock_id, rn, e) AS {_ema_sql(26, rel='n')},
m AS MATERIALIZED (SELECT a.common_stock_id, a.rn, CAST(a.e - b.e AS BIGINT) AS macd FROM e12 a JOIN e26 b ON a.common_stock_id = b.common_stock_id AND a.rn = b.rn),
e9(common_stock_id, rn, e) AS {_ema_sql(9, 'macd', 'm', 26)}, {_wilder_sql('u', 'up', 'n', 2)}, {_wilder_sql('d', 'down', 'n', 2)}, {_wilder_sql('t', 'tr', 'n', 1)}
SELECT n.common_stock_id, strftime(n.bar_date, '%Y-%m-%d') AS bar_date, m.macd, CAST(e9.e AS BIGINT) AS signal, CAST(m.macd - e9.e AS BIGINT) AS histogram,
 round_even(CASE WHEN d.a = 0 THEN 100 ELSE 100 - 100 / (1 + u.a / d.a) END, 2) AS rsi14, round_even(t.a, 0) AS atr14 FROM n LEFT JOIN m USING (common_stock_id, rn) LEFT JOIN e9 USING (common_stock_id, rn) LEFT JOIN u USING (common_stock_id, rn) LEFT JOIN d USING (common_stock_id, rn) LEFT JOIN t USING (common_stock_id, rn)"""


@query(_MRA)
def win_macd_rsi_atr(spark, d):
    """MACD signal and histogram, RSI(14) and ATR(14); all recursive."""
    return S.smoothers(bars(spark, d), K, D).select(*K, day(D).alias(D), "macd", "signal", "histogram", "rsi14", "atr14")


@query(f"""SELECT t.transaction_id, p.close FROM (SELECT DISTINCT transaction_id, common_stock_id, transaction_date FROM insider_transaction WHERE transaction_date IS NOT NULL) t
ASOF LEFT JOIN {B} p ON t.common_stock_id = p.common_stock_id AND t.transaction_date >= p.bar_date""")
def join_as_of(spark, d):
    """The last close on or before each insider transaction."""
    events = table(spark, d, "insider_transaction").select("transaction_id", "common_stock_id", "transaction_date").distinct().filter(F.col("transaction_date").isNotNull())
    return S.as_of_join(events, bars(spark, d).select("common_stock_id", "bar_date", "close"), K, "transaction_date", D, "close").select("transaction_id", "close")


# No split table is delivered: one split a stock whose number is divisible by three, and a later one for every ninth.
_SPLITS = "(SELECT common_stock_id, DATE '2023-06-15' AS effective_date, 2 AS numerator, 1 AS denominator FROM common_stock WHERE common_stock_id % 3 = 0 UNION ALL SELECT common_stock_id, DATE '2024-02-01', 3, 2 FROM common_stock WHERE common_stock_id % 9 = 0)"


def _splits(spark, d):
    s = table(spark, d, "common_stock").select("common_stock_id")
    one = lambda k, day_, a, b: s.filter(F.col("common_stock_id") % k == 0).select("common_stock_id", F.lit(day_).cast("date").alias("effective_date"), F.lit(a).alias("numerator"), F.lit(b).alias("denominator"))
    return one(3, "2023-06-15", 2, 1).unionByName(one(9, "2024-02-01", 3, 2))


@query(f"SELECT f.fact_id, CAST(coalesce(product(CAST(s.numerator AS DOUBLE) / s.denominator), 1) AS DOUBLE) AS factor, CAST(round(f.shares * coalesce(product(CAST(s.numerator AS DOUBLE) / s.denominator), 1)) AS BIGINT) AS restated FROM shares_fact f LEFT JOIN {_SPLITS} s ON s.common_stock_id = f.common_stock_id AND s.effective_date > f.as_of GROUP BY f.fact_id, f.shares")
def join_split_factor(spark, d):
    """Share counts restated by the product of later splits (strictly later)."""
    rows = table(spark, d, "shares_fact").select("fact_id", "common_stock_id", "shares", "as_of")
    out = S.split_factor(rows, _splits(spark, d), "common_stock_id", "as_of", "fact_id")
    return out.select("fact_id", F.col("factor").cast("double").alias("factor"), F.round(F.col("shares") * F.col("factor"), 0).cast("bigint").alias("restated"))


@query(f"""WITH s AS (SELECT common_stock_id, stddev_samp(r) AS vol, count(*) AS n FROM (SELECT common_stock_id, CAST(close AS DOUBLE) / lag(close) OVER {W} - 1 AS r FROM {B}) WHERE r IS NOT NULL GROUP BY 1),
p AS (SELECT common_stock_id, round(vol, 8) AS vol FROM s)
SELECT common_stock_id, vol, round(CASE WHEN count(*) OVER () = 1 THEN 50 ELSE (rank() OVER (ORDER BY vol) - 1 + (count(*) OVER (PARTITION BY vol) - 1) / 2.0) / (count(*) OVER () - 1) * 100 END, 6) AS percentile FROM p""")
def win_percentile(spark, d):
    """Volatility with its percentile, ties at their mean rank."""
    w = Window.partitionBy(*K).orderBy(D)
    r = bars(spark, d).withColumn("r", F.col("close").cast("double") / F.lag("close").over(w) - 1).filter(F.col("r").isNotNull())
    p = r.groupBy(*K).agg(F.round(F.stddev_samp("r"), 8).alias("vol"))
    return R.with_percentile(p, "vol", "percentile").withColumn("percentile", F.round("percentile", 6))


@query(f"""WITH f AS (SELECT s.common_stock_id, CAST(v.v AS DOUBLE) AS v, CAST(t.n AS DOUBLE) AS n FROM common_stock s LEFT JOIN (SELECT common_stock_id, sum(volume) AS v FROM {B} GROUP BY 1) v USING (common_stock_id)
LEFT JOIN (SELECT common_stock_id, count(DISTINCT transaction_id) AS n FROM insider_transaction WHERE transaction_code = 'Purchase' GROUP BY 1) t USING (common_stock_id)),
p AS (SELECT common_stock_id, CASE WHEN v IS NOT NULL THEN (rank() OVER (PARTITION BY v IS NULL ORDER BY v) - 1 + (count(*) OVER (PARTITION BY v) - 1) / 2.0) / (count(*) OVER (PARTITION BY v IS NULL) - 1) * 100 END AS pv,
CASE WHEN n IS NOT NULL THEN (rank() OVER (PARTITION BY n IS NULL ORDER BY n) - 1 + (count(*) OVER (PARTITION BY n) - 1) / 2.0) / (count(*) OVER (PARTITION BY n IS NULL) - 1) * 100 END AS pn FROM f)
SELECT common_stock_id, round((coalesce(pv * 0.7, 0) + coalesce(pn * 0.3, 0)) / (CASE WHEN pv IS NULL THEN 0 ELSE 0.7 END + CASE WHEN pn IS NULL THEN 0 ELSE 0.3 END), 4) AS score FROM p WHERE pv IS NOT NULL OR pn IS NOT NULL""")
def win_composite_score(spark, d):
    """Weighted percentiles; the weight of a missing factor goes to the others."""
    vol = bars(spark, d).groupBy(*K).agg(F.sum("volume").cast("double").alias("v"))
    buys = table(spark, d, "insider_transaction").filter(F.col("transaction_code") == "Purchase").groupBy(*K).agg(F.count_distinct("transaction_id").cast("double").alias("n"))
    f = table(spark, d, "common_stock").select(*K).join(vol, K, "left").join(buys, K, "left")
    p = R.with_percentile(R.with_percentile(f, "v", "pv"), "n", "pn")
    return p.withColumn("score", F.round(R.weighted_composite({"pv": 0.7, "pn": 0.3}), 4)).filter(F.col("score").isNotNull()).select(*K, "score")


@query("""WITH m AS (SELECT DISTINCT revenue_row_id, common_stock_id, member, fiscal_year, CAST(value AS DOUBLE) AS value, filed_date FROM dimensional_revenue_row WHERE axis = 'srt:StatementGeographicalAxis' AND unit = 'USD' AND caption IS NULL AND fiscal_year IS NOT NULL),
p AS (SELECT *, dense_rank() OVER (PARTITION BY common_stock_id ORDER BY fiscal_year DESC) AS k FROM m QUALIFY row_number() OVER (PARTITION BY common_stock_id, member, fiscal_year ORDER BY filed_date DESC NULLS LAST, revenue_row_id) = 1),
y AS (SELECT common_stock_id, max(CASE WHEN k = 1 THEN fiscal_year END) AS year1, max(CASE WHEN k = 2 THEN fiscal_year END) AS year2, max(CASE WHEN k = 3 THEN fiscal_year END) AS year3 FROM p GROUP BY 1),
v AS (SELECT common_stock_id, member, max(CASE WHEN k = 1 THEN value END) AS value1, max(CASE WHEN k = 2 THEN value END) AS value2, max(CASE WHEN k = 3 THEN value END) AS value3 FROM p WHERE k <= 3 GROUP BY 1, 2)
SELECT common_stock_id, member, year1, year2, year3, value1, value2, value3 FROM v JOIN y USING (common_stock_id)""")
def win_pivot_newest(spark, d):
    """Each stock's members by its three newest fiscal years, the latest filed in each cell, in one pinned unit."""
    rows = table(spark, d, "dimensional_revenue_row").filter((F.col("axis") == "srt:StatementGeographicalAxis") & (F.col("unit") == "USD") & F.col("caption").isNull() & F.col("fiscal_year").isNotNull())
    one = rows.select("revenue_row_id", *K, "member", "fiscal_year", F.col("value").cast("double").alias("value"), "filed_date").distinct()
    best = R.nth_latest(one, [*K, "member", "fiscal_year"], [F.desc_nulls_last("filed_date"), F.col("revenue_row_id")])
    years = best.select(*K, "fiscal_year").distinct().withColumn("k", F.row_number().over(Window.partitionBy(*K).orderBy(F.desc("fiscal_year")))).filter(F.col("k") <= 3)
    pick = lambda c: [F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{'year' if c == 'fiscal_year' else c}{k}") for k in (1, 2, 3)]
    wide = best.join(years, [*K, "fiscal_year"]).groupBy(*K, "member").agg(*pick("value"))
    return wide.join(years.groupBy(*K).agg(*pick("fiscal_year")), K).select(*K, "member", "year1", "year2", "year3", "value1", "value2", "value3")


@query(f"""WITH d AS (SELECT DISTINCT bar_date FROM {B}), s AS (SELECT common_stock_id, min(bar_date) AS a, max(bar_date) AS z FROM {B} GROUP BY 1)
SELECT s.common_stock_id, strftime(min(d.bar_date), '%Y-%m-%d') AS first_gap, count(*) AS gaps FROM s JOIN d ON d.bar_date BETWEEN s.a AND s.z LEFT JOIN {B} b ON b.common_stock_id = s.common_stock_id AND b.bar_date = d.bar_date WHERE b.bar_date IS NULL GROUP BY 1""")
def win_first_gap(spark, d):
    """Each series' first missing session: neighbouring bars are compared on the ordinal of the session, no cross product."""
    b = bars(spark, d).select(*K, D).distinct()
    sessions = b.select(D).distinct().withColumn("ordinal", F.row_number().over(Window.orderBy(D)))
    w = Window.partitionBy(*K).orderBy("ordinal")
    gaps = b.join(F.broadcast(sessions), D).withColumn("prev", F.lag("ordinal").over(w)).filter(F.col("ordinal") > F.col("prev") + 1)
    first = gaps.groupBy(*K).agg(F.min("prev").alias("p"), F.sum(F.col("ordinal") - F.col("prev") - 1).alias("gaps"))
    return first.join(F.broadcast(sessions), F.col("p") + 1 == F.col("ordinal")).select(*K, day(D).alias("first_gap"), "gaps")


def _clones(spark, d, q):
    """(holder, report date, growth, positions) of the clones of these holdings."""
    b = q.select("holding_id", "institutional_holder_id", "common_stock_id", "report_date", "value").distinct().groupBy("institutional_holder_id", "report_date", "common_stock_id").agg(F.sum("value").alias("value"))
    dates = b.select("institutional_holder_id", "report_date").distinct().withColumn("next", F.lead("report_date").over(Window.partitionBy("institutional_holder_id").orderBy("report_date")))
    x = b.join(dates.filter(F.col("next").isNotNull()), ["institutional_holder_id", "report_date"]).withColumns({"buy": F.date_add("report_date", 45), "sell": F.date_add("next", 45)})
    px = bars(spark, d).select("common_stock_id", "bar_date", "close")
    one = S.as_of_join(x, px.withColumnRenamed("close", "c0"), K, "buy", D, "c0")
    two = S.as_of_join(one, px.withColumnRenamed("close", "c1"), K, "sell", D, "c1")
    ratio = two.withColumn("ratio", F.col("c1").cast("double") / F.col("c0"))
    return S.grow(ratio, "value", "ratio", ["institutional_holder_id", "report_date"])


@query("""WITH q AS (SELECT DISTINCT holding_id, institutional_holder_id AS h, common_stock_id AS s, report_date AS r, value AS v FROM institutional_holding WHERE filing_type = 'Form13F' AND value > 0),
b AS (SELECT h, r, s, sum(v) AS v FROM q GROUP BY 1, 2, 3), d AS (SELECT h, r, lead(r) OVER (PARTITION BY h ORDER BY r) AS nx FROM (SELECT DISTINCT h, r FROM b)),
px AS """ + B + """,
x AS (SELECT b.h, b.r, d.nx, b.s, b.v FROM b JOIN d ON d.h = b.h AND d.r = b.r WHERE d.nx IS NOT NULL),
p0 AS (SELECT x.*, px.close AS c0, px.bar_date AS d0 FROM x ASOF LEFT JOIN px ON px.common_stock_id = x.s AND x.r + 45 >= px.bar_date),
p1 AS (SELECT p0.*, px.close AS c1 FROM p0 ASOF LEFT JOIN px ON px.common_stock_id = p0.s AND p0.nx + 45 >= px.bar_date)
SELECT h AS institutional_holder_id, strftime(r, '%Y-%m-%d') AS report_date, round(growth, 6) AS growth, positions, round(product(growth) OVER (PARTITION BY h ORDER BY r), 6) AS chained FROM (
SELECT h, r, CAST(sum(CAST(v AS DOUBLE) * c1 / c0) AS DOUBLE) / CAST(sum(CAST(v AS DOUBLE)) AS DOUBLE) AS growth, count(*) AS positions FROM p1 WHERE c0 IS NOT NULL AND c1 IS NOT NULL GROUP BY 1, 2)""")
def win_clone_chain(spark, d):
    """Clone of every fund: each period's growth, and the product of the periods so far.

    A period in which no position has both prices has no row and leaves the product as it is.
    """
    q = table(spark, d, "institutional_holding").filter((F.col("filing_type") == "Form13F") & (F.col("value") > 0))
    w = Window.partitionBy("institutional_holder_id").orderBy("report_date").rowsBetween(Window.unboundedPreceding, 0)
    g = _clones(spark, d, q).withColumn("chained", F.round(F.product("growth").over(w), 6))
    return g.select("institutional_holder_id", day("report_date").alias("report_date"), F.round("growth", 6).alias("growth"), "positions", "chained")


@query("""SELECT event_type, strftime(time_bucket(INTERVAL 14 DAY, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d') AS bucket, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""")
def inc_rolling_buckets(spark, d):
    """Events by type in fourteen-day buckets."""
    rows = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    g = rows.groupBy("event_type", F.window("t", "14 days")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return g.select("event_type", day("window.start").alias("bucket"), "n", "total")
