"""Queries over reported facts, and further series and ranking queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finstrata.core.tables import table
from finstrata.functions import calendar as C
from finstrata.functions import documents as D
from finstrata.operators import facts as X
from finstrata.operators import relational as R
from finstrata.operators import series as S
from finstrata.plans.pipeline_queries import USD_REVENUE, usd_revenue
from finstrata.plans.series_queries import _SPLITS, _splits
from finstrata.plans.text_queries import _SESS, _SESS_WIDE
from finstrata.plans.views import BARS, CURRENT, HOLDINGS, PREVIOUS, bars, day, half_even_sql, holdings

QUERIES, ORACLES = {}, {}
W = "(PARTITION BY common_stock_id ORDER BY bar_date)"
H, CUR, PRE = HOLDINGS, f"DATE '{CURRENT}'", f"DATE '{PREVIOUS}'"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


_REV = USD_REVENUE


def _revenue(spark, d):
    """All revenue rows of money in whole US dollars, each once."""
    cols = ["revenue_row_id", "common_stock_id", "axis", "member", "period_start", "period_end", "filed_date", "fiscal_year"]
    return usd_revenue(spark, d, *cols).select(*cols, F.col("amount_usd").alias("v")).distinct()


@query(f"""SELECT common_stock_id, member, revenue_row_id, v FROM (SELECT *, row_number() OVER (PARTITION BY common_stock_id, member ORDER BY period_end DESC, CASE axis WHEN 'srt:StatementGeographicalAxis' THEN 1 WHEN 'srt:ProductOrServiceAxis' THEN 2 ELSE 3 END, filed_date DESC NULLS LAST, revenue_row_id DESC) AS rn
FROM {_REV} WHERE period_start IS NULL OR date_diff('day', period_start, period_end) BETWEEN 0 AND 380) WHERE rn = 1""")
def fn_pick_best_fact(spark: SparkSession, d: str) -> DataFrame:
    """The best revenue fact of each member: latest period, then the axis preferred, then filed last."""
    axes = ["srt:StatementGeographicalAxis", "srt:ProductOrServiceAxis", "us-gaap:StatementBusinessSegmentsAxis"]
    f = _revenue(spark, d).select("*", F.lit("10-K").alias("form"), F.col("axis").alias("concept"), F.col("filed_date").alias("filed"), F.col("revenue_row_id").alias("accession"))
    return X.pick_best(f, ["common_stock_id", "member"], axes, ["10-K"]).select("common_stock_id", "member", "revenue_row_id", "v")


@query(f"SELECT common_stock_id, axis, member, strftime(period_end, '%Y-%m-%d') AS period_end, revenue_row_id FROM (SELECT *, row_number() OVER (PARTITION BY common_stock_id, axis, member, period_start, period_end ORDER BY filed_date DESC NULLS LAST, revenue_row_id DESC) AS rn FROM {_REV}) WHERE rn = 1")
def fn_one_per_span(spark, d):
    f = _revenue(spark, d).select("*", F.col("filed_date").alias("filed"), F.col("revenue_row_id").alias("accession"))
    return X.one_per_span(f, ["common_stock_id", "axis", "member"]).select("common_stock_id", "axis", "member", day("period_end").alias("period_end"), "revenue_row_id")


_MEM = f"(SELECT common_stock_id, fiscal_year, member, filed_date, sum(v) AS v FROM {_REV} WHERE axis = 'srt:StatementGeographicalAxis' AND filed_date IS NOT NULL GROUP BY 1, 2, 3, 4)"
_TOT = f"(SELECT common_stock_id, fiscal_year, sum(v) AS t FROM (SELECT *, row_number() OVER (PARTITION BY common_stock_id, fiscal_year, member ORDER BY filed_date DESC, v DESC) AS rn FROM {_MEM}) WHERE rn = 1 GROUP BY 1, 2)"


@query(f"""WITH m AS {_MEM}, t AS {_TOT}, s AS (SELECT common_stock_id, fiscal_year, filed_date, sum(v) AS s FROM m GROUP BY 1, 2, 3),
c AS (SELECT common_stock_id, fiscal_year, max(filed_date) AS f FROM s JOIN t USING (common_stock_id, fiscal_year) WHERE t <> 0 AND abs(CAST(s AS DOUBLE) / CAST(t AS DOUBLE) - 1) <= 0.005 GROUP BY 1, 2),
j AS (SELECT m.*, c.f FROM m LEFT JOIN c USING (common_stock_id, fiscal_year)), r AS (SELECT *, row_number() OVER (PARTITION BY common_stock_id, fiscal_year, member ORDER BY filed_date DESC, v DESC) AS rn FROM j)
SELECT common_stock_id, fiscal_year, member, CAST(v AS BIGINT) AS v, f IS NOT NULL AS reconciled FROM r WHERE (f IS NOT NULL AND f = filed_date) OR (f IS NULL AND rn = 1)""")
def fn_reconcile_to_total(spark, d):
    """Members of the filing that adds up to the total, else the latest of each."""
    m = _revenue(spark, d).filter((F.col("axis") == "srt:StatementGeographicalAxis") & F.col("filed_date").isNotNull()).groupBy("common_stock_id", "fiscal_year", "member", "filed_date").agg(F.sum("v").alias("v"))
    w = Window.partitionBy("common_stock_id", "fiscal_year", "member").orderBy(F.desc("filed_date"), F.desc("v"))
    t = m.withColumn("rn", F.row_number().over(w)).filter("rn = 1").groupBy("common_stock_id", "fiscal_year").agg(F.sum("v").alias("t"))
    return X.reconcile(m, t, ["common_stock_id", "fiscal_year"], "v", "t", "filed_date").select("common_stock_id", "fiscal_year", "member", "v", "reconciled")


# Subsets of the other members by recursion over their order; a member that is such a sum in two years goes.
@query(f"""WITH RECURSIVE g AS (SELECT common_stock_id AS s, fiscal_year AS y, member AS m, max(v) AS v FROM {_REV} WHERE axis = 'srt:StatementGeographicalAxis' GROUP BY 1, 2, 3),
o AS (SELECT *, row_number() OVER (PARTITION BY s, y ORDER BY m) AS k, count(*) OVER (PARTITION BY s, y) AS n FROM g WHERE y IS NOT NULL AND m IS NOT NULL AND v <> 0),
r(s, y, t, tv, k, total, taken) AS (SELECT s, y, m, v, CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0 FROM o UNION ALL SELECT r.s, r.y, r.t, r.tv, o.k, r.total + o.v * z.x, r.taken + z.x FROM r JOIN o ON o.s = r.s AND o.y = r.y AND o.k = r.k + 1 JOIN (VALUES (0), (1)) AS z(x) ON z.x = 0 OR o.m <> r.t),
e AS (SELECT s, t FROM (SELECT DISTINCT r.s, r.t, r.y FROM r JOIN o ON o.s = r.s AND o.y = r.y AND o.k = r.k AND o.n = r.k WHERE taken >= 2 AND total = tv) GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT s AS common_stock_id, y AS fiscal_year, m AS member, v, TRUE AS searched FROM g WHERE s IS NOT NULL AND NOT EXISTS (SELECT 1 FROM e WHERE e.s = g.s AND e.t = g.m)""")
def fn_without_rollups(spark, d):
    """Members without those that are sums of others; groups too large to search would be told."""
    m = _revenue(spark, d).filter(F.col("axis") == "srt:StatementGeographicalAxis").groupBy("common_stock_id", "fiscal_year", "member").agg(F.max("v").alias("v"))
    return X.without_rollups(m, ["common_stock_id"], "fiscal_year", "member", "v").select("common_stock_id", "fiscal_year", "member", "v", "searched")


@query(f"""WITH y AS (SELECT common_stock_id, member, fiscal_year, max(v) AS v FROM {_REV} WHERE axis = 'srt:StatementGeographicalAxis' GROUP BY 1, 2, 3),
n AS (SELECT *, abs(CAST(lag(v) OVER w AS DOUBLE)) AS a, abs(CAST(lead(v) OVER w AS DOUBLE)) AS b, abs(CAST(v AS DOUBLE)) AS x FROM y WINDOW w AS (PARTITION BY common_stock_id, member ORDER BY fiscal_year)),
o AS (SELECT *, a > 0 AND b > 0 AND x > 0 AS ok FROM n), p AS (SELECT *, CASE WHEN ok THEN abs(log10(a / b)) < 0.7 END AS near, CASE WHEN ok THEN abs(log10(x / sqrt(a * b))) END AS off FROM o)
SELECT common_stock_id, member, fiscal_year, CASE WHEN near AND abs(off - 3) < 0.35 THEN 1000 WHEN near AND abs(off - 6) < 0.35 THEN 1000000 END AS scale_error FROM p""")
def fn_scale_errors(spark, d):
    y = _revenue(spark, d).filter(F.col("axis") == "srt:StatementGeographicalAxis").groupBy("common_stock_id", "member", "fiscal_year").agg(F.max("v").alias("v"))
    return X.scale_errors(y, ["common_stock_id", "member"], "fiscal_year", "v").select("common_stock_id", "member", "fiscal_year", "scale_error")


@query(f"""WITH s AS {_SESS_WIDE}, b AS (SELECT b.*, s.ordinal AS o FROM {BARS} b JOIN s ON s.session = b.bar_date), p AS (SELECT *, lag(close) OVER {W} AS pc, lag(o) OVER {W} AS po, lag(bar_date) OVER {W} AS pd FROM b)
SELECT common_stock_id, strftime(bar_date, '%Y-%m-%d') AS bar_date, CASE WHEN po = o - 1 AND NOT EXISTS (SELECT 1 FROM {_SPLITS} x WHERE x.common_stock_id = p.common_stock_id AND x.effective_date > p.pd AND x.effective_date <= p.bar_date) THEN round((close - pc) * 100.0 / pc, 4) + 0.0 END AS day_change FROM p""")
def win_day_change(spark, d):
    """Change against the session before, if the bar before is of that session and no split lies between."""
    w = Window.partitionBy("common_stock_id").orderBy("bar_date")
    cal = C.sessions_of(table(spark, d, "daily_stock_price"), "bar_date")
    b = bars(spark, d).join(F.broadcast(cal), F.col("bar_date") == F.col("session")).select("common_stock_id", "bar_date", "close", "ordinal")
    p = b.withColumns({"pc": F.lag("close").over(w), "po": F.lag("ordinal").over(w), "pd": F.lag("bar_date").over(w)})
    s = _splits(spark, d).select(F.col("common_stock_id").alias("k"), "effective_date")
    hit = p.join(s, (F.col("common_stock_id") == F.col("k")) & (F.col("effective_date") > F.col("pd")) & (F.col("effective_date") <= F.col("bar_date")), "left_semi").select("common_stock_id", "bar_date", F.lit(True).alias("split"))
    ok = (F.col("po") == F.col("ordinal") - 1) & F.col("split").isNull()
    return p.join(hit, ["common_stock_id", "bar_date"], "left").select("common_stock_id", day("bar_date").alias("bar_date"), F.when(ok, F.round((F.col("close") - F.col("pc")) * 100.0 / F.col("pc"), 4) + 0.0).alias("day_change"))


@query(f"""WITH r AS (SELECT *, CAST(close AS DOUBLE) / lag(close) OVER {W} - 1 AS r, lag(close, 5) OVER {W} AS c5 FROM {BARS}),
s AS (SELECT *, stddev_samp(r) OVER f AS sd, count(r) OVER f AS n, avg(CAST(close AS DOUBLE) * volume) OVER (PARTITION BY common_stock_id ORDER BY bar_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS t5, avg(CAST(close AS DOUBLE) * volume) OVER f AS t60 FROM r WINDOW f AS (PARTITION BY common_stock_id ORDER BY bar_date ROWS BETWEEN 64 PRECEDING AND 5 PRECEDING))
SELECT common_stock_id, strftime(bar_date, '%Y-%m-%d') AS bar_date, n >= 30 AND CAST(close AS DOUBLE) / c5 - 1 >= 2 * sd * sqrt(5) AS price_spike, n >= 30 AND close > c5 AND t5 >= 2 * t60 AS volume_surge FROM s WHERE c5 IS NOT NULL AND n > 1""")
def win_spike_and_surge(spark, d):
    """Five-bar moves over twice the baseline's deviation, and turnover twice the baseline's on a rise."""
    w = Window.partitionBy("common_stock_id").orderBy("bar_date")
    base, five = w.rowsBetween(-64, -5), w.rowsBetween(-4, 0)
    c = F.col("close").cast("double")
    r = bars(spark, d).withColumns({"r": c / F.lag("close").over(w) - 1, "c5": F.lag("close", 5).over(w)})
    turn = c * F.col("volume")
    s = r.withColumns({"sd": F.stddev_samp("r").over(base), "n": F.count("r").over(base), "t5": F.avg(turn).over(five), "t60": F.avg(turn).over(base)}).filter(F.col("c5").isNotNull() & (F.col("n") > 1))
    return s.select(
        "common_stock_id", day("bar_date").alias("bar_date"), ((F.col("n") >= 30) & (c / F.col("c5") - 1 >= 2 * F.col("sd") * F.sqrt(F.lit(5.0)))).alias("price_spike"),
        ((F.col("n") >= 30) & (F.col("close") > F.col("c5")) & (F.col("t5") >= 2 * F.col("t60"))).alias("volume_surge"),
    )


@query(f"""SELECT common_stock_id, CASE WHEN z - a >= 90 AND c0 > 0 THEN round((pow(CAST(c1 AS DOUBLE) / c0, 365.25 / (z - a)) - 1) * 100, 4) END AS cagr FROM (SELECT common_stock_id, min(bar_date) AS a, max(bar_date) AS z, arg_min(close, bar_date) AS c0, arg_max(close, bar_date) AS c1 FROM {BARS} GROUP BY 1)""")
def win_cagr(spark, d):
    g = bars(spark, d).groupBy("common_stock_id").agg(F.min("bar_date").alias("a"), F.max("bar_date").alias("z"), F.min_by("close", "bar_date").alias("c0"), F.max_by("close", "bar_date").alias("c1"))
    days = F.date_diff("z", "a")
    return g.select("common_stock_id", F.when((days >= 90) & (F.col("c0") > 0), F.round((F.pow(F.col("c1").cast("double") / F.col("c0"), 365.25 / days) - 1) * 100, 4)).alias("cagr"))


@query(f"""WITH f AS (SELECT fact_id, common_stock_id, as_of, shares FROM (SELECT *, row_number() OVER (PARTITION BY common_stock_id, as_of ORDER BY filed DESC NULLS LAST, fact_id) AS rn FROM shares_fact WHERE as_of IS NOT NULL) WHERE rn = 1),
x AS (SELECT f.*, coalesce((SELECT product(CAST(numerator AS DOUBLE) / denominator) FROM {_SPLITS} s WHERE s.common_stock_id = f.common_stock_id AND s.effective_date > f.as_of), 1) AS k FROM f)
SELECT fact_id, CAST(round(shares * k) - lag(CAST(round(shares * k) AS BIGINT)) OVER (PARTITION BY common_stock_id ORDER BY as_of) AS BIGINT) AS change FROM x""")
def win_restated_change(spark, d):
    """Change against the count before, both in today's shares."""
    f = table(spark, d, "shares_fact").filter(F.col("as_of").isNotNull())
    one = R.nth_latest(f, ["common_stock_id", "as_of"], [F.desc_nulls_last("filed"), F.col("fact_id")]).select("fact_id", "common_stock_id", "as_of", "shares")
    x = S.split_factor(one, _splits(spark, d), "common_stock_id", "as_of", "fact_id").withColumn("n", F.round(F.col("shares") * F.col("factor"), 0).cast("bigint"))
    return x.select("fact_id", (F.col("n") - F.lag("n").over(Window.partitionBy("common_stock_id").orderBy("as_of"))).alias("change"))


@query(f"""WITH e AS (SELECT common_stock_id, bar_date, close, CASE WHEN close > lag(close) OVER {W} THEN volume ELSE 0 END AS up, volume FROM {BARS}), m AS (SELECT max(bar_date) AS z FROM e),
g AS (SELECT common_stock_id, sum(CASE WHEN bar_date > z - 14 THEN up END) AS u1, sum(CASE WHEN bar_date > z - 14 THEN volume END) AS v1, sum(CASE WHEN bar_date > z - 28 AND bar_date <= z - 14 THEN up END) AS u2, sum(CASE WHEN bar_date > z - 28 AND bar_date <= z - 14 THEN volume END) AS v2 FROM e, m GROUP BY 1)
SELECT common_stock_id, round(CAST(u1 AS DOUBLE) / CAST(v1 AS DOUBLE) * 100, 4) AS recent, round(CAST(u2 AS DOUBLE) / CAST(v2 AS DOUBLE) * 100, 4) AS prior, round((CAST(u1 AS DOUBLE) / CAST(v1 AS DOUBLE) - CAST(u2 AS DOUBLE) / CAST(v2 AS DOUBLE)) * 100, 4) + 0.0 AS change FROM g WHERE v1 > 0 AND v2 > 0""")
def agg_adjacent_buckets(spark, d):
    """Share of volume on rising days in the last fortnight and the one before, and the difference."""
    w = Window.partitionBy("common_stock_id").orderBy("bar_date")
    e = bars(spark, d).withColumn("up", F.when(F.col("close") > F.lag("close").over(w), F.col("volume")).otherwise(0))
    z = e.agg(F.max("bar_date").alias("z"))
    back = F.date_diff("z", "bar_date")
    both = e.crossJoin(F.broadcast(z)).filter(back < 28)
    part = lambda c, now: F.sum(F.when((back < 14) if now else (back >= 14), F.col(c))).cast("double")
    g = both.groupBy("common_stock_id").agg(part("up", True).alias("u1"), part("volume", True).alias("v1"), part("up", False).alias("u2"), part("volume", False).alias("v2")).filter("v1 > 0 AND v2 > 0")
    a, b = F.col("u1") / F.col("v1"), F.col("u2") / F.col("v2")
    return g.select("common_stock_id", F.round(a * 100, 4).alias("recent"), F.round(b * 100, 4).alias("prior"), (F.round((a - b) * 100, 4) + 0.0).alias("change"))


@query(f"SELECT s.common_stock_id, coalesce(max(CAST(round(f.shares * coalesce((SELECT product(CAST(numerator AS DOUBLE) / denominator) FROM {_SPLITS} x WHERE x.common_stock_id = f.common_stock_id AND x.effective_date > f.as_of), 1)) AS BIGINT)), 0) AS most FROM common_stock s LEFT JOIN (SELECT * FROM shares_fact WHERE form LIKE '10-K%') f USING (common_stock_id) GROUP BY 1")
def agg_worst_restated(spark, d):
    """The greatest restated count of each stock; 0 where the feed has none."""
    f = table(spark, d, "shares_fact").filter(F.col("form").startswith("10-K")).select("fact_id", "common_stock_id", "as_of", "shares")
    x = S.split_factor(f, _splits(spark, d), "common_stock_id", "as_of", "fact_id").groupBy("common_stock_id").agg(F.max(F.round(F.col("shares") * F.col("factor"), 0).cast("bigint")).alias("m"))
    return table(spark, d, "common_stock").select("common_stock_id").join(x, "common_stock_id", "left").select("common_stock_id", F.coalesce("m", F.lit(0)).alias("most"))


@query(f"SELECT accession_number, count(*) AS rows_n, CAST(sum(value) AS BIGINT) AS value, bool_or(value_pending) AS pending FROM {H} GROUP BY 1")
def agg_filing_totals(spark, d):
    return holdings(spark, d, "accession_number", "value", "value_pending").groupBy("accession_number").agg(F.count("*").alias("rows_n"), F.sum("value").alias("value"), F.bool_or("value_pending").alias("pending"))


@query(f"""WITH k AS (SELECT DISTINCT common_stock_id AS s, institutional_holder_id AS h, report_date AS r FROM {H} WHERE report_date IN ({CUR}, {PRE})), g AS (SELECT s, h, max(r) AS hi, min(r) AS lo FROM k GROUP BY 1, 2),
c AS (SELECT s, count(*) FILTER (WHERE lo = {CUR}) AS n, count(*) FILTER (WHERE hi = {PRE}) AS o FROM g GROUP BY 1)
SELECT * FROM (SELECT s AS common_stock_id, n AS filers, 'new' AS bucket FROM c WHERE n > 0 ORDER BY n DESC, s LIMIT 15) UNION ALL SELECT * FROM (SELECT s, o, 'sold out' FROM c WHERE o > 0 ORDER BY o DESC, s LIMIT 15)""")
def top_new_and_sold_out(spark, d):
    c = R.churn(holdings(spark, d, "common_stock_id", "institutional_holder_id", "report_date"), "common_stock_id", "institutional_holder_id", "report_date", CURRENT, PREVIOUS)
    top = lambda col, name: c.filter(F.col(col) > 0).orderBy(F.desc(col), "common_stock_id").limit(15).select("common_stock_id", F.col(col).alias("filers"), F.lit(name).alias("bucket"))
    return top("new_filers", "new").unionByName(top("sold_out_filers", "sold out"))


@query("""SELECT common_stock_id, market_capitalization, row_number() OVER (ORDER BY CASE WHEN market_capitalization IS NULL OR market_capitalization >= 1e11 THEN 1 ELSE 0 END, market_capitalization DESC NULLS LAST, common_stock_id) AS place FROM common_stock ORDER BY place LIMIT 50""")
def top_with_sentinels_last(spark, d):
    """Values at or above a ceiling are no values and come last."""
    odd = F.when(F.col("market_capitalization").isNull() | (F.col("market_capitalization") >= 1e11), 1).otherwise(0)
    order = [odd, F.desc_nulls_last("market_capitalization"), F.col("common_stock_id")]
    top = table(spark, d, "common_stock").orderBy(*order).limit(50)
    return top.select("common_stock_id", "market_capitalization", F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("place"))


@query(f"SELECT common_stock_id, round(CAST(a AS DOUBLE) / b, 6) AS ratio FROM (SELECT common_stock_id, sum(CASE WHEN option_type = 'Put' THEN value ELSE 0 END) AS a, sum(value) AS b FROM {H} WHERE report_date = {CUR} GROUP BY 1) WHERE b > 0 ORDER BY CAST(a AS DOUBLE) / b DESC, common_stock_id LIMIT 25")
def top_by_ratio(spark, d):
    h = holdings(spark, d, "common_stock_id", "report_date", "option_type", "value").filter(F.col("report_date") == F.lit(CURRENT).cast("date"))
    g = h.groupBy("common_stock_id").agg(F.sum(F.when(F.col("option_type") == "Put", F.col("value")).otherwise(0)).alias("a"), F.sum("value").alias("b")).filter("b > 0")
    return g.orderBy(F.desc(F.col("a").cast("double") / F.col("b")), "common_stock_id").limit(25).select("common_stock_id", F.round(F.col("a").cast("double") / F.col("b"), 6).alias("ratio"))


@query("""SELECT insider_owner_id, common_stock_id, best FROM (SELECT insider_owner_id, common_stock_id, max(CAST(shares * price_per_share AS DOUBLE)) AS best FROM insider_transaction WHERE transaction_code IN ('Sale', 'Purchase') GROUP BY 1, 2) WHERE best IS NOT NULL ORDER BY best DESC, insider_owner_id, common_stock_id LIMIT 40""")
def top_distinct_then_cap(spark, d):
    """Repeats go before the cap, so the cap is exact and nothing is fetched in excess."""
    t = table(spark, d, "insider_transaction").filter(F.col("transaction_code").isin("Sale", "Purchase"))
    g = t.groupBy("insider_owner_id", "common_stock_id").agg(F.max((F.col("shares") * F.col("price_per_share")).cast("double")).alias("best")).filter(F.col("best").isNotNull())
    return g.orderBy(F.desc("best"), "insider_owner_id", "common_stock_id").limit(40)


@query(f"""WITH s AS (SELECT common_stock_id, effective_date, CAST(numerator AS DOUBLE) / denominator AS k FROM {_SPLITS}), b AS {BARS}
SELECT s.common_stock_id, strftime(s.effective_date, '%Y-%m-%d') AS effective_date, abs(CAST(x.close AS DOUBLE) / y.close / k - 1) <= 0.15 AS is_discontinuous FROM s
JOIN LATERAL (SELECT arg_max(close, bar_date) AS close FROM b WHERE b.common_stock_id = s.common_stock_id AND b.bar_date < s.effective_date) x ON true
JOIN LATERAL (SELECT arg_min(close, bar_date) AS close FROM b WHERE b.common_stock_id = s.common_stock_id AND b.bar_date >= s.effective_date) y ON true WHERE x.close IS NOT NULL AND y.close IS NOT NULL""")
def ing_split_discontinuity(spark, d):
    """Whether the closes around a split differ by its ratio, so that prices were not restated."""
    s = _splits(spark, d).select("common_stock_id", "effective_date", (F.col("numerator").cast("double") / F.col("denominator")).alias("k"))
    j = s.join(bars(spark, d).select("common_stock_id", "bar_date", "close"), "common_stock_id")
    before, after = F.col("bar_date") < F.col("effective_date"), F.col("bar_date") >= F.col("effective_date")
    g = j.groupBy("common_stock_id", "effective_date", "k").agg(
        F.max_by(F.when(before, F.col("close")), F.when(before, F.col("bar_date"))).alias("x"), F.min_by(F.when(after, F.col("close")), F.when(after, F.col("bar_date"))).alias("y")
    ).filter("x IS NOT NULL AND y IS NOT NULL")
    return g.select("common_stock_id", day("effective_date").alias("effective_date"), (F.abs(F.col("x").cast("double") / F.col("y") / F.col("k") - 1) <= 0.15).alias("is_discontinuous"))


@query("""SELECT insider_owner_id, common_stock_id, strftime(transaction_date, '%Y-%m-%d') AS transaction_date, transaction_code, coalesce(security_title, '') AS security_title, count(*) AS n, CAST(sum(shares) AS BIGINT) AS shares
FROM (SELECT DISTINCT t.* EXCLUDE (creation_time) FROM insider_transaction t JOIN common_stock USING (common_stock_id) WHERE transaction_date IS NOT NULL AND transaction_date <= filing_date) GROUP BY ALL""")
def ing_build_trades(spark, d):
    """Trades of known stocks that aren't dated after their filing, by key with nulls as blanks."""
    t = table(spark, d, "insider_transaction").drop("creation_time").distinct().filter(F.col("transaction_date").isNotNull() & (F.col("transaction_date") <= F.col("filing_date")))
    known = t.join(table(spark, d, "common_stock").select("common_stock_id"), "common_stock_id", "left_semi")
    return known.groupBy("insider_owner_id", "common_stock_id", day("transaction_date").alias("transaction_date"), "transaction_code", F.coalesce("security_title", F.lit("")).alias("security_title")).agg(F.count("*").alias("n"), F.sum("shares").alias("shares"))


@query(f"""WITH f AS (SELECT common_stock_id AS k, max(as_of) AS latest, count(*) AS n FROM shares_fact GROUP BY 1) SELECT s.common_stock_id, s.ticker, strftime(latest, '%Y-%m-%d') AS latest, coalesce(n, 0) AS n FROM common_stock s LEFT JOIN f ON f.k = s.common_stock_id WHERE n >= 2""")
def ing_directory(spark, d):
    """A directory rebuilt whole: latest period and rows of each series; stale ones drop out."""
    f = table(spark, d, "shares_fact").groupBy("common_stock_id").agg(F.max("as_of").alias("latest"), F.count("*").alias("n")).filter("n >= 2")
    return table(spark, d, "common_stock").select("common_stock_id", "ticker").join(f, "common_stock_id").select("common_stock_id", "ticker", day("latest").alias("latest"), "n")


@query(f"""SELECT b.common_stock_id, strftime(b.bar_date, '%Y-%m-%d') AS bar_date, CAST(CASE WHEN n = 0 THEN close WHEN n = 1 AND bar_date < DATE '2023-06-15' AND common_stock_id % 9 <> 0 THEN {half_even_sql('close', '2')}
 WHEN n = 1 THEN {half_even_sql('close * 2', '3')} ELSE {half_even_sql(half_even_sql('close * 2', '3'), '2')} END AS BIGINT) AS restated FROM (SELECT *, (CASE WHEN common_stock_id % 3 = 0 AND bar_date < DATE '2023-06-15' THEN 1 ELSE 0 END) + (CASE WHEN common_stock_id % 9 = 0 AND bar_date < DATE '2024-02-01' THEN 1 ELSE 0 END) AS n FROM {BARS}) b""")
def ing_restate_history(spark, d):
    """Closes in today's shares, rounded at each split from the newest back."""
    b = bars(spark, d).select("common_stock_id", "bar_date", "close")
    return S.restate_history(b, _splits(spark, d), "common_stock_id", "bar_date", "close").select("common_stock_id", day("bar_date").alias("bar_date"), "restated")


@query(f"""WITH q AS (SELECT DISTINCT institutional_holder_id AS h, common_stock_id AS s, report_date AS r FROM {H}), f AS (SELECT common_stock_id AS s, min(bar_date) AS a FROM {BARS} GROUP BY 1)
SELECT h AS institutional_holder_id, strftime(r, '%Y-%m-%d') AS report_date, CASE WHEN count(*) FILTER (WHERE a IS NULL) = 0 THEN strftime(max(greatest(a, r)), '%Y-%m-%d') END AS usable_from FROM q LEFT JOIN f USING (s) GROUP BY 1, 2""")
def fn_usable_start(spark, d):
    """The first date at which all of a report's positions can be priced."""
    q = holdings(spark, d, "institutional_holder_id", "common_stock_id", "report_date").withColumn("since", F.col("report_date"))
    u = S.usable_start(q, bars(spark, d), ["institutional_holder_id", "report_date"], "common_stock_id", "since", "bar_date")
    return u.select("institutional_holder_id", day("report_date").alias("report_date"), day("usable_from").alias("usable_from"))


@query(f"""WITH s AS {_SESS}, e AS (SELECT max(ordinal) AS o, max(session) AS settlement FROM s GROUP BY date_trunc('month', session), CASE WHEN day(session) <= 15 THEN 1 ELSE 2 END)
SELECT strftime(settlement, '%Y-%m-%d') AS settlement, strftime(a.session, '%Y-%m-%d') AS due, strftime(b.session, '%Y-%m-%d') AS published FROM e LEFT JOIN s a ON a.ordinal = e.o + 2 LEFT JOIN s b ON b.ordinal = e.o + 9""")
def fn_settlement_cycle(spark, d):
    c = C.settlement_cycle(C.sessions(spark, 2018, 2025))
    return c.select(day("settlement").alias("settlement"), day("due").alias("due"), day("published").alias("published"))


# What Python takes for a blank, as a class of characters.
_WS = r"\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_LAST = "CASE WHEN {0} + 1024 >= n THEN n ELSE coalesce(list_max(list_filter(ends, lambda x: x >= greatest({0} + 896, {0} + 1) AND x < {0} + 1024)) + 1, {0} + 1024) END"


@query(rf"""WITH RECURSIVE t AS (SELECT doc_id, text, regexp_extract_all(text, '[^{_WS}]+') AS w, regexp_extract_all(text, '[{_WS}]+') AS s, regexp_matches(text, '^[{_WS}]') AS lead FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i, s, lead FROM t WHERE len(w) > 0),
p AS (SELECT doc_id, n, i, word, coalesce(sum(length(word)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + coalesce(sum(length(gap)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING), 0) AS a
 FROM (SELECT *, CASE WHEN lead THEN s[i + 1] WHEN i > 0 THEN s[i] END AS gap FROM u)),
e AS (SELECT doc_id, any_value(n) AS n, list(i) FILTER (WHERE regexp_matches(word, '[.!?]["'')\]]*$')) AS ends FROM p GROUP BY 1),
r AS (SELECT doc_id, 0 AS chunk, CAST(0 AS BIGINT) AS first, {_LAST.format('0')} AS last, n, ends FROM e UNION ALL SELECT doc_id, chunk + 1, f, {_LAST.format('f')}, n, ends FROM (SELECT *, greatest(last - 128, first + 1) AS f FROM r WHERE last < n))
SELECT r.doc_id, CAST(chunk AS INT) AS chunk, CAST(x.a AS INT) AS start_char, CAST(y.a + length(y.word) AS INT) AS end_char, CAST(1 + length(left(t.text, CAST(x.a AS BIGINT))) - length(replace(left(t.text, CAST(x.a AS BIGINT)), chr(10), '')) AS INT) AS start_line,
 CAST(last - first AS INT) AS n_tokens, CAST(y.a + length(y.word) - x.a AS INT) AS n_chars FROM r JOIN t USING (doc_id) JOIN p x ON x.doc_id = r.doc_id AND x.i = r.first JOIN p y ON y.doc_id = r.doc_id AND y.i = r.last - 1""")
def fn_token_windows(spark, d):
    """Windows of at most 1,024 words that end with a sentence where they can, over whole texts."""
    w = D.token_windows(table(spark, d, "documents"), "doc_id", "text")
    return w.select("doc_id", "chunk", "start_char", "end_char", "start_line", "n_tokens", F.length("content").alias("n_chars"))


@query("""SELECT transaction_id, CASE WHEN regexp_matches(transaction_code, 'sale|tax', 'i') THEN 'out' WHEN regexp_matches(transaction_code, 'purchase|award|exercise', 'i') THEN 'in' ELSE 'other' END AS kind FROM insider_transaction GROUP BY ALL""")
def fn_classify(spark, d):
    kinds = [("out", "sale|tax"), ("in", "purchase|award|exercise")]
    return table(spark, d, "insider_transaction").select("transaction_id", D.classify(F.col("transaction_code"), kinds, "other").alias("kind")).distinct()
