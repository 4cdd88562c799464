"""Queries over reported facts, filings and funds that go beyond one table or one period."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finstrata.core.tables import table
from finstrata.functions import calendar as C
from finstrata.operators import facts as X
from finstrata.operators import relational as R
from finstrata.operators import series as S
from finstrata.plans.facts_queries import _REV, _revenue
from finstrata.plans.incremental_queries import _folder
from finstrata.plans.series_queries import _N, _SPLITS, _splits, win_composite_score
from finstrata.plans.series_queries import ORACLES as SERIES_SQL
from finstrata.plans.views import BARS, CURRENT, HOLDINGS, PREVIOUS, bars, day, half_even_sql, holdings
from finstrata.streaming import incremental as I

QUERIES, ORACLES = {}, {}
H, CUR, PRE = HOLDINGS, f"DATE '{CURRENT}'", f"DATE '{PREVIOUS}'"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


# reported facts

_GEO, _SEG = "srt:StatementGeographicalAxis", "us-gaap:StatementBusinessSegmentsAxis"
# Years as filed, a quarter filed under each year, and a fourth quarter of its own where there are segments.
_SPANS = f"""(SELECT common_stock_id, axis, member, period_start, period_end, 'FY' AS fiscal_period FROM {_REV} WHERE period_start IS NOT NULL AND axis IS NOT NULL AND member IS NOT NULL
 UNION SELECT common_stock_id, axis, member, period_end - 90, period_end, 'FY' FROM {_REV} WHERE axis IS NOT NULL AND member IS NOT NULL AND period_end IS NOT NULL
 UNION SELECT common_stock_id, axis, member, period_end - 90, period_end, 'Q4' FROM {_REV} WHERE axis = '{_SEG}' AND member IS NOT NULL AND period_end IS NOT NULL)"""


@query(f"""WITH f AS {_SPANS}, n AS (SELECT *, date_diff('day', period_start, period_end) AS n FROM f),
p AS (SELECT common_stock_id, axis, member, period_start, period_end, 'Q4' AS fiscal_period FROM n a WHERE n BETWEEN 80 AND 100 AND fiscal_period = 'FY'
 AND EXISTS (SELECT 1 FROM n b WHERE b.common_stock_id = a.common_stock_id AND b.axis = a.axis AND b.member = a.member AND b.period_end = a.period_end AND b.n BETWEEN 350 AND 380)
 AND NOT EXISTS (SELECT 1 FROM n b WHERE b.common_stock_id = a.common_stock_id AND b.axis = a.axis AND b.member = a.member AND b.period_end = a.period_end AND b.fiscal_period = 'Q4'))
SELECT common_stock_id, axis, member, strftime(period_start, '%Y-%m-%d') AS period_start, strftime(period_end, '%Y-%m-%d') AS period_end, fiscal_period FROM (SELECT common_stock_id, axis, member, period_start, period_end, fiscal_period FROM n UNION ALL SELECT * FROM p)""")
def fct_fourth_quarters(spark: SparkSession, d: str) -> DataFrame:
    """Spans with the quarters that were filed under the full year told as fourth ones."""
    r = _revenue(spark, d).filter("axis IS NOT NULL AND member IS NOT NULL")
    keys = ["common_stock_id", "axis", "member"]
    year = r.filter("period_start IS NOT NULL").select(*keys, "period_start", "period_end", F.lit("FY").alias("fiscal_period"))
    quarter = r.filter("period_end IS NOT NULL").select(*keys, F.date_sub("period_end", 90).alias("period_start"), "period_end", F.lit("FY").alias("fiscal_period"))
    fourth = quarter.filter(F.col("axis") == _SEG).withColumn("fiscal_period", F.lit("Q4"))
    out = X.with_fourth_quarters(year.unionByName(quarter).unionByName(fourth).distinct(), keys)
    return out.select(*keys, day("period_start").alias("period_start"), day("period_end").alias("period_end"), "fiscal_period")


_LINES = [("home", ["Domestic", "AmericasRegion"]), ("abroad", ["EuropeRegion", "AsiaPacific", "RestOfWorld"])]
_ONE = f"(SELECT common_stock_id, member, period_end, max(v) AS v FROM {_REV} WHERE axis = '{_GEO}' AND common_stock_id IS NOT NULL AND period_end IS NOT NULL GROUP BY 1, 2, 3)"


@query(f"""WITH f AS {_ONE}, t(line_no, line, member, k) AS (VALUES (0, 'home', 'Domestic', 0), (0, 'home', 'AmericasRegion', 1), (1, 'abroad', 'EuropeRegion', 0), (1, 'abroad', 'AsiaPacific', 1), (1, 'abroad', 'RestOfWorld', 2)),
l AS (SELECT * FROM (SELECT *, max(period_end) OVER (PARTITION BY common_stock_id) AS z FROM f) WHERE period_end = z)
SELECT common_stock_id, line_no, line, member AS concept, v AS value FROM (SELECT l.*, t.line_no, t.line, row_number() OVER (PARTITION BY common_stock_id, line_no ORDER BY k) AS rn FROM l JOIN t USING (member)) WHERE rn = 1""")
def fct_statement(spark, d):
    """Each stock's latest period by lines, each from the first of its members that is reported."""
    f = _revenue(spark, d).filter((F.col("axis") == _GEO) & F.col("common_stock_id").isNotNull() & F.col("period_end").isNotNull())
    one = f.groupBy("common_stock_id", F.col("member").alias("concept"), "period_end").agg(F.max("v").alias("value"))
    return X.statement(one, _LINES, ["common_stock_id"])


def _axis_sql(axis: str) -> str:
    return f"(SELECT common_stock_id, period_end, CAST(sum(v) AS DOUBLE) AS v FROM (SELECT common_stock_id, member, period_end, max(v) AS v FROM {_REV} WHERE axis = '{axis}' GROUP BY 1, 2, 3) GROUP BY 1, 2)"


@query(f"SELECT r.common_stock_id, strftime(r.period_end, '%Y-%m-%d') AS period_end, r.v AS revenue, i.v AS income, round(i.v / r.v * 100, 4) AS margin FROM {_axis_sql(_GEO)} r JOIN {_axis_sql(_SEG)} i USING (common_stock_id, period_end) WHERE r.v > 0")
def fct_margins(spark, d):
    """Segments' sum against the regions' sum, where both are there and the latter is positive."""
    def side(axis):
        one = _revenue(spark, d).filter(F.col("axis") == axis).groupBy("common_stock_id", "member", "period_end").agg(F.max("v").alias("v"))
        return one.groupBy("common_stock_id", "period_end").agg(F.sum("v").cast("double").alias("value"))

    m = X.margins(side(_GEO), side(_SEG), ["common_stock_id", "period_end"])
    return m.select("common_stock_id", day("period_end").alias("period_end"), "revenue", "income", "margin")


_MEMBERS = f"(SELECT common_stock_id, fiscal_year, member, max(v) AS v FROM {_REV} WHERE axis = '{_GEO}' AND v > 0 AND member IS NOT NULL AND common_stock_id IS NOT NULL AND fiscal_year IS NOT NULL GROUP BY 1, 2, 3)"


@query(f"""WITH m AS {_MEMBERS}, t AS (SELECT common_stock_id, fiscal_year, CAST(sum(v) AS BIGINT) AS t, count(*) AS n, list_sort(list(member)) AS names FROM m GROUP BY 1, 2),
a AS (SELECT m.*, n, names FROM m JOIN t USING (common_stock_id, fiscal_year)), keep AS (SELECT *, n > 2 OR (n = 2 AND names < ['part one', 'part two']) AS own FROM t)
SELECT a.common_stock_id, a.fiscal_year, a.member, a.v, true AS collapsed, true AS searched FROM a JOIN keep k USING (common_stock_id, fiscal_year) WHERE k.own
UNION ALL SELECT common_stock_id, fiscal_year, p, CASE p WHEN 'part one' THEN t // 2 + 1 ELSE t - t // 2 - 1 END, true, true FROM keep, (VALUES ('part one'), ('part two')) AS z(p) WHERE NOT own""")
def fct_schemes(spark, d):
    """Members reported by two schemes of one total (regions, and two parts made of their sum): one scheme stays."""
    m = _revenue(spark, d).filter((F.col("axis") == _GEO) & (F.col("v") > 0) & F.col("member").isNotNull() & F.col("common_stock_id").isNotNull() & F.col("fiscal_year").isNotNull())
    keys = ["common_stock_id", "fiscal_year"]
    one = m.groupBy(*keys, "member").agg(F.max("v").alias("v"))
    total = one.groupBy(*keys).agg(F.sum("v").alias("t"))
    half = F.floor(F.col("t") / 2) + 1
    parts = [total.select(*keys, F.lit(name).alias("member"), v.cast("bigint").alias("v"), "t") for name, v in (("part one", half), ("part two", F.col("t") - half))]
    rows = one.join(total, keys).select(*keys, "member", "v", "t").unionByName(parts[0]).unionByName(parts[1])
    return X.collapse_schemes(rows, keys, "member", "v", "t").select(*keys, "member", "v", "collapsed", "searched")


_LEGS = f"(SELECT DISTINCT a.common_stock_id, a.fiscal_year, a.axis, a.member, b.axis AS other_axis, b.member AS other_member FROM {_REV} a JOIN {_REV} b ON b.common_stock_id = a.common_stock_id AND b.fiscal_year = a.fiscal_year WHERE a.axis = '{_SEG}' AND b.axis IN ('{_GEO}', 'srt:ProductOrServiceAxis'))"


@query(f"SELECT common_stock_id, fiscal_year, other_axis AS axis, other_member AS member, axis AS other_axis, member AS other_member FROM {_LEGS} WHERE other_axis = '{_GEO}'")
def fct_axes(spark, d):
    """Facts with two axes (segment by region or product) seen from the regions."""
    r = _revenue(spark, d).select("common_stock_id", "fiscal_year", "axis", "member").distinct()
    b = r.filter(F.col("axis").isin(_GEO, "srt:ProductOrServiceAxis")).select("common_stock_id", "fiscal_year", F.col("axis").alias("other_axis"), F.col("member").alias("other_member"))
    legs = r.filter(F.col("axis") == _SEG).join(b, ["common_stock_id", "fiscal_year"])
    return X.orient_axes(legs, "axis", "member", "other_axis", "other_member", [_GEO]).select("common_stock_id", "fiscal_year", "axis", "member", "other_axis", "other_member")


@query("""WITH t AS (SELECT DISTINCT transaction_id, common_stock_id, transaction_date, coalesce(transaction_code, '') AS source, shares FROM insider_transaction WHERE transaction_date IS NOT NULL AND shares IS NOT NULL),
g AS (SELECT common_stock_id, transaction_date, source, CAST(sum(shares) AS BIGINT) AS shares, count(*) AS parts FROM t GROUP BY 1, 2, 3)
SELECT common_stock_id, strftime(transaction_date, '%Y-%m-%d') AS paid, source, shares, parts FROM (SELECT *, row_number() OVER (PARTITION BY common_stock_id, transaction_date ORDER BY CASE source WHEN 'Purchase' THEN 1 WHEN 'Sale' THEN 2 ELSE 3 END, source) AS rn FROM g) WHERE rn = 1""")
def fct_payments(spark, d):
    """Amounts of one day added up within the preferred kind of source only."""
    t = table(spark, d, "insider_transaction").filter("transaction_date IS NOT NULL AND shares IS NOT NULL").select("transaction_id", "common_stock_id", "transaction_date", F.coalesce("transaction_code", F.lit("")).alias("source"), "shares").distinct()
    return X.combine_payments(t, ["common_stock_id", "transaction_date"], "shares", "source", ["Purchase", "Sale"]).select("common_stock_id", day("transaction_date").alias("paid"), "source", "shares", "parts")


@query("SELECT i, CAST(r AS DOUBLE) AS ratio FROM (VALUES (1, 2), (2, 1000), (3, 0.5), (4, NULL), (5, NULL), (6, 10)) AS t(i, r)")
def fn_depositary_ratio(spark, d):
    texts = ["Each ADS represents two ordinary shares", "each American Depositary Share representing 1,000 Class A ordinary shares", "one ADR represents one-half of an ordinary share", "no ratio", None, "1 ADS represents the right to receive ten (10) common shares"]
    return spark.createDataFrame(list(enumerate(texts, 1)), "i int, t string").select("i", X.depositary_ratio(F.col("t")).cast("double").alias("ratio"))


@query(f"SELECT DISTINCT holding_id, filing_date <= report_date + 45 AS in_time FROM {H}")
def fn_filing_window(spark, d):
    """Whether each holding was filed while its report's window was open."""
    return holdings(spark, d, "filing_date", "report_date").select("holding_id", C.filing_window_open(F.col("report_date"), F.col("filing_date")).alias("in_time")).distinct()


# filings and quarters


@query(f"""WITH f AS (SELECT DISTINCT institutional_holder_id AS h, accession_number AS a, report_date AS r, filing_date AS fd FROM {H}),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY r DESC NULLS LAST, fd DESC NULLS LAST, a DESC NULLS LAST) AS rn FROM f) WHERE rn = 1)
SELECT q.common_stock_id, q.institutional_holder_id, CAST(sum(q.value) AS BIGINT) AS value, count(*) AS positions FROM {H} q JOIN l ON l.h = q.institutional_holder_id AND l.a = q.accession_number AND l.r = q.report_date GROUP BY 1, 2""")
def join_latest_filing(spark, d):
    """Positions of each series' latest filing by period, filing date and number: one window, then an equi-join."""
    rows = holdings(spark, d, "institutional_holder_id", "common_stock_id", "accession_number", "report_date", "filing_date", "value")
    filings = rows.select("institutional_holder_id", "accession_number", "report_date", "filing_date").distinct()
    latest = R.nth_latest(filings, ["institutional_holder_id"], [F.desc_nulls_last(c) for c in ("report_date", "filing_date", "accession_number")]).drop("filing_date")
    return rows.join(latest, ["institutional_holder_id", "accession_number", "report_date"], "left_semi").groupBy("common_stock_id", "institutional_holder_id").agg(F.sum("value").alias("value"), F.count("*").alias("positions"))


# Who files is told by the file number, else the CRD number, else the name with city, else the name, else the id.
_WHO = """CASE WHEN form13f_file_number IS NOT NULL THEN '1:' || form13f_file_number WHEN crd_number IS NOT NULL THEN '2:' || crd_number WHEN name IS NOT NULL AND city IS NOT NULL THEN '3:' || name || '|' || city
 WHEN name IS NOT NULL THEN '4:' || name ELSE '5:' || institutional_holder_id END"""


@query(f"""WITH w AS (SELECT institutional_holder_id AS h, {_WHO} AS who FROM institutional_holder), f AS (SELECT DISTINCT w.who, q.accession_number AS a, q.report_date AS r, q.filing_date AS fd FROM {H} q JOIN w ON w.h = q.institutional_holder_id)
SELECT who, a AS accession_number, strftime(r, '%Y-%m-%d') AS report_date FROM (SELECT *, row_number() OVER (PARTITION BY who ORDER BY r DESC NULLS LAST, fd DESC NULLS LAST, a DESC NULLS LAST) AS rn FROM f) WHERE rn = 1""")
def set_latest_per_series(spark, d):
    """The latest filing of every series, five disjoint ways of telling a series as one computed key."""
    s = table(spark, d, "institutional_holder").select("institutional_holder_id", F.expr(_WHO).alias("who"))
    f = holdings(spark, d, "institutional_holder_id", "accession_number", "report_date", "filing_date").join(s, "institutional_holder_id").select("who", "accession_number", "report_date", "filing_date").distinct()
    best = R.nth_latest(f, ["who"], [F.desc_nulls_last(c) for c in ("report_date", "filing_date", "accession_number")])
    return best.select("who", "accession_number", day("report_date").alias("report_date"))


@query(f"""SELECT common_stock_id, CAST(sum(CASE WHEN report_date = {CUR} THEN shares WHEN NOT EXISTS (SELECT 1 FROM {H} c WHERE c.report_date = {CUR} AND c.institutional_holder_id = p.institutional_holder_id) THEN shares ELSE 0 END) AS BIGINT) AS combined_shares,
CAST(sum(CASE WHEN report_date = {PRE} THEN shares ELSE 0 END) AS BIGINT) AS previous_shares, count(DISTINCT CASE WHEN report_date = {CUR} THEN institutional_holder_id END) AS filed, count(DISTINCT institutional_holder_id) AS holders FROM {H} p WHERE report_date IN ({CUR}, {PRE}) GROUP BY 1""")
def agg_combined_quarter(spark, d):
    """The current quarter with the previous rows of those who haven't filed yet, beside the previous quarter."""
    both = holdings(spark, d, "common_stock_id", "institutional_holder_id", "report_date", "shares").filter(F.col("report_date").isin(date.fromisoformat(CURRENT), date.fromisoformat(PREVIOUS)))
    now = F.col("report_date") == F.lit(CURRENT).cast("date")
    filed = both.filter(now).select("institutional_holder_id", F.lit(True).alias("has_filed")).distinct()
    rows = both.join(filed, "institutional_holder_id", "left")
    by = rows.groupBy("common_stock_id", "institutional_holder_id").agg(
        F.sum(F.when(now | F.col("has_filed").isNull(), F.col("shares")).otherwise(0)).alias("c"), F.sum(F.when(~now, F.col("shares")).otherwise(0)).alias("p"), F.max(now).alias("filed"),
    )
    held = F.col("institutional_holder_id").isNotNull()
    return by.groupBy("common_stock_id").agg(F.sum("c").alias("combined_shares"), F.sum("p").alias("previous_shares"), F.count_if(F.col("filed") & held).alias("filed"), F.count_if(held).alias("holders"))


@query("""SELECT strftime(min(filing_date), '%Y-%m-%d') AS first_dense FROM (SELECT filing_date FROM (SELECT DISTINCT transaction_id, filing_date FROM insider_transaction) GROUP BY 1 HAVING count(*) >= 5)""")
def agg_first_dense_date(spark, d):
    """The first filing date with at least five transactions."""
    t = table(spark, d, "insider_transaction").select("transaction_id", "filing_date").distinct()
    return t.groupBy("filing_date").count().filter("count >= 5").agg(day(F.min("filing_date")).alias("first_dense"))


@query("""WITH q AS (SELECT DISTINCT holding_id, institutional_holder_id, common_stock_id, report_date, share_type, coalesce(option_type, '') AS option_type, accession_number, shares, value, voting_auth_sole, voting_auth_shared, voting_auth_none, value_pending FROM institutional_holding WHERE filing_type = 'Form13F')
SELECT institutional_holder_id, common_stock_id, strftime(report_date, '%Y-%m-%d') AS report_date, share_type, option_type, CAST(sum(shares) AS BIGINT) AS shares, CAST(sum(value) AS BIGINT) AS value, CAST(sum(voting_auth_sole) AS BIGINT) AS sole, CAST(sum(voting_auth_shared) AS BIGINT) AS shared, CAST(sum(voting_auth_none) AS BIGINT) AS no_vote,
bool_or(value_pending) AS pending, string_agg(accession_number || ':' || shares, ',' ORDER BY accession_number || ':' || shares, holding_id) AS entries FROM q GROUP BY 1, 2, 3, 4, 5""")
def agg_merge_entries(spark, d):
    """Legs of one natural key added up, voting too, with the entries they came from."""
    rows = holdings(spark, d, "institutional_holder_id", "common_stock_id", "report_date", "share_type", "option_type", "accession_number", "shares", "value", "voting_auth_sole", "voting_auth_shared", "voting_auth_none", "value_pending")
    entry = F.concat_ws(":", "accession_number", F.col("shares").cast("string"))
    told = F.when(F.col("accession_number").isNotNull() & F.col("shares").isNotNull(), entry)
    total = lambda c, name: F.sum(c).alias(name)
    return rows.groupBy("institutional_holder_id", "common_stock_id", day("report_date").alias("report_date"), "share_type", F.coalesce("option_type", F.lit("")).alias("option_type")).agg(
        total("shares", "shares"), total("value", "value"), total("voting_auth_sole", "sole"), total("voting_auth_shared", "shared"), total("voting_auth_none", "no_vote"), F.bool_or("value_pending").alias("pending"),
        F.nullif(F.array_join(F.array_sort(F.collect_list(told)), ","), F.lit("")).alias("entries"),
    )


@query(f"""WITH i AS (SELECT DISTINCT industry, nullif(regexp_extract(industry, '^(\\w+)', 1), '') AS sector FROM common_stock WHERE industry IS NOT NULL)
SELECT sector, strftime(report_date, '%Y-%m-%d') AS report_date, CAST(sum(value) AS BIGINT) AS value, count(DISTINCT h.common_stock_id) AS stocks, count(DISTINCT industry) AS industries FROM {H} h JOIN common_stock s USING (common_stock_id) JOIN i USING (industry) WHERE sector IS NOT NULL GROUP BY 1, 2""")
def join_sector_snapshots(spark, d):
    """Holdings by stock, industry and sector (an industry's first word): three hops, aggregated before the dimensions."""
    by = holdings(spark, d, "common_stock_id", "report_date", "value").groupBy("common_stock_id", "report_date").agg(F.sum("value").alias("value"))
    stocks = table(spark, d, "common_stock").select("common_stock_id", "industry")
    sectors = stocks.select("industry").distinct().withColumn("sector", F.nullif(F.regexp_extract("industry", r"^(\w+)", 1), F.lit("")))
    j = by.join(stocks, "common_stock_id").join(sectors, "industry").filter(F.col("sector").isNotNull())
    return j.groupBy("sector", day("report_date").alias("report_date")).agg(F.sum("value").alias("value"), F.count_distinct("common_stock_id").alias("stocks"), F.count_distinct("industry").alias("industries"))


_HELD = f"(SELECT common_stock_id, count(DISTINCT CASE WHEN report_date = {CUR} THEN institutional_holder_id END) AS filers, count(DISTINCT CASE WHEN report_date = {PRE} THEN institutional_holder_id END) AS before, CAST(sum(CASE WHEN report_date = {CUR} THEN value ELSE 0 END) AS BIGINT) AS value, CAST(sum(CASE WHEN report_date = {CUR} THEN shares ELSE 0 END) AS BIGINT) AS shares FROM {H} WHERE report_date IN ({CUR}, {PRE}) GROUP BY 1)"
_SORTS = {"filers": "filers", "value": "value", "shares": "shares", "change": "filers - before"}


@query(" UNION ALL ".join(f"SELECT * FROM (SELECT '{name}' AS sort, common_stock_id, row_number() OVER (ORDER BY {by} DESC, common_stock_id) AS place FROM {_HELD} ORDER BY {by} DESC, common_stock_id LIMIT 25)" for name, by in _SORTS.items()))
def top_most_held_sorts(spark, d):
    """The most held stocks by filers, value, shares and gain of filers."""
    rows = holdings(spark, d, "common_stock_id", "institutional_holder_id", "report_date", "shares", "value")
    a = R.period_activity(rows, ["common_stock_id"], "institutional_holder_id", "report_date", CURRENT, PREVIOUS, ["shares", "value"]).select(
        "common_stock_id", F.col("current_filers").alias("filers"), F.col("previous_filers").alias("before"), F.col("current_value").alias("value"), F.col("current_shares").alias("shares")
    )
    out = None
    for name, by in _SORTS.items():
        order = [F.desc(F.expr(by)), F.col("common_stock_id")]
        top = a.orderBy(*order).limit(25).select(F.lit(name).alias("sort"), "common_stock_id", F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("place"))
        out = top if out is None else out.unionByName(top)
    return out


@query(f"""WITH b AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents WHERE n_chars IS NOT NULL UNION ALL SELECT doc_id, row_number() OVER (ORDER BY reporting_date DESC NULLS LAST, doc_id) FROM documents)
SELECT doc_id, min(r) AS best_rank FROM b GROUP BY 1""")
def set_best_rank(spark, d):
    """Documents of two rankings, each once with its best rank; ranks by range-partitioned prefix sums."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "reporting_date")

    def ranked(rows, first):
        key = first.cast("bigint") * (1 << 33) + F.col("doc_id")  # one number for both: ids stay below 2 ** 33
        return R.with_place(rows.select("doc_id", key.alias("k")), "k", "rank").select("doc_id", "rank")

    long = ranked(docs.filter("n_chars IS NOT NULL"), -F.col("n_chars"))
    new = ranked(docs, F.coalesce(-F.unix_date("reporting_date"), F.lit(1 << 20)))
    return R.nth_latest(long.unionByName(new), ["doc_id"], [F.col("rank")]).select("doc_id", F.col("rank").alias("best_rank"))


# series


@query(f"SELECT common_stock_id, strftime(bar_date, '%Y-%m-%d') AS bar_date, CAST(CASE WHEN rn >= 20 THEN {half_even_sql('s', '20')} END AS BIGINT) AS sma20 FROM (SELECT *, CAST(sum(close) OVER (PARTITION BY common_stock_id ORDER BY bar_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM {_N}) WHERE bar_date >= DATE '2024-01-01'")
def win_warm_up(spark, d):
    """A moving average over whole series, shown from 2024 on: it is warm on the first day shown."""
    b = bars(spark, d).select("common_stock_id", "bar_date", "close")
    w = S.window_after_warm_up(b, S.sma(F.col("close"), ["common_stock_id"], "bar_date", 20), "sma20", "bar_date", "2024-01-01")
    return w.select("common_stock_id", day("bar_date").alias("bar_date"), "sma20")


@query(f"""WITH s AS ({SERIES_SQL['win_composite_score']}), k AS (SELECT common_stock_id, count(DISTINCT transaction_code) AS n FROM insider_transaction GROUP BY 1)
SELECT common_stock_id, round(least(100, score + least(20, 6 * coalesce(n, 0))), 2) AS score, least(20, 6 * coalesce(n, 0)) AS boost FROM s LEFT JOIN k USING (common_stock_id)""")
def win_boosted_score(spark, d):
    """The composite with boosts for kinds of insider trades: at most 20, and at most 100 in all."""
    k = table(spark, d, "insider_transaction").groupBy("common_stock_id").agg(F.count_distinct("transaction_code").alias("n"))
    boost = F.least(F.lit(20).cast("bigint"), 6 * F.coalesce("n", F.lit(0)))
    s = win_composite_score(spark, d).join(k, "common_stock_id", "left")
    return s.select("common_stock_id", F.round(F.least(F.lit(100.0), F.col("score") + boost), 2).alias("score"), boost.alias("boost"))


# Splits of a stock hold for all its listings, or for the one they name.
_SCOPED = f"(SELECT s.*, CASE WHEN effective_date > DATE '2024-01-01' THEN t.first END AS series FROM {_SPLITS} s LEFT JOIN (SELECT common_stock_id, min(listed_ticker) AS first FROM daily_stock_price GROUP BY 1) t USING (common_stock_id) WHERE effective_date < DATE '2024-01-01' OR t.first IS NOT NULL)"


@query(f"""WITH b AS (SELECT DISTINCT price_id, common_stock_id, listed_ticker, bar_date, CAST(close AS DOUBLE) AS close FROM daily_stock_price WHERE close > 0 AND listed_ticker IS NOT NULL)
SELECT price_id, round(close / coalesce((SELECT product(CAST(numerator AS DOUBLE) / denominator) FROM {_SCOPED} s WHERE s.common_stock_id = b.common_stock_id AND (s.series IS NULL OR s.series = b.listed_ticker) AND s.effective_date > b.bar_date), 1), 4) AS restated FROM b""")
def join_listing_splits(spark, d):
    """Closes restated by the later splits of their own listing; a split that names none holds for all."""
    p = table(spark, d, "daily_stock_price")
    b = p.filter("close > 0 AND listed_ticker IS NOT NULL").select("price_id", "common_stock_id", "listed_ticker", "bar_date", F.col("close").cast("double").alias("close")).distinct()
    first = p.groupBy("common_stock_id").agg(F.min("listed_ticker").alias("first"))
    late = F.col("effective_date") > F.lit("2024-01-01").cast("date")
    s = _splits(spark, d).join(first, "common_stock_id", "left").withColumn("series", F.when(late, F.col("first"))).filter(~late | F.col("first").isNotNull())
    own = S.listing_splits(s, b, "common_stock_id", "series", "listed_ticker", "listing")
    x = S.split_factor(b.withColumn("listing", F.concat_ws(":", "common_stock_id", "listed_ticker")), own, "listing", "bar_date", "price_id")
    return x.select("price_id", F.round(F.col("close") / F.col("factor").cast("double"), 4).alias("restated"))


@query(f"""SELECT common_stock_id, strftime(report_date, '%Y-%m-%d') AS report_date, CAST(round(shares * k) AS BIGINT) AS shares FROM (SELECT a.*, coalesce((SELECT product(CAST(numerator AS DOUBLE) / denominator) FROM {_SPLITS} s WHERE s.common_stock_id = a.common_stock_id AND s.effective_date > a.report_date), 1) AS k
FROM (SELECT common_stock_id, report_date, CAST(sum(shares) AS BIGINT) AS shares FROM {H} WHERE common_stock_id IS NOT NULL AND report_date IS NOT NULL GROUP BY 1, 2) a)""")
def agg_restated_market(spark, d):
    """Every stock's shares by quarter in today's shares: totals are restated, not rows."""
    t = holdings(spark, d, "common_stock_id", "report_date", "shares").filter("common_stock_id IS NOT NULL AND report_date IS NOT NULL").groupBy("common_stock_id", "report_date").agg(F.sum("shares").alias("shares")).withColumn("id", F.concat_ws(":", "common_stock_id", "report_date"))
    x = S.split_factor(t, _splits(spark, d), "common_stock_id", "report_date", "id")
    return x.select("common_stock_id", day("report_date").alias("report_date"), F.round(F.col("shares") * F.col("factor"), 0).cast("bigint").alias("shares"))


# increments


@query("""SELECT 'insider_transaction' AS dataset, strftime(max(filing_date), '%Y-%m-%d') AS start FROM insider_transaction UNION ALL SELECT 'fred_observation', strftime(max(obs_date), '%Y-%m-%d') FROM fred_observation UNION ALL SELECT 'nothing', '2021-05-01' UNION ALL SELECT 'nothing, no floor', '2020-01-01'""")
def inc_start_from(spark, d):
    """Where each dataset's fetching goes on."""
    t, f = table(spark, d, "insider_transaction"), table(spark, d, "fred_observation")
    rows = [("insider_transaction", I.start_from(spark, t, "filing_date")), ("fred_observation", I.start_from(spark, f, "obs_date")), ("nothing", I.start_from(spark, t.limit(0), "filing_date", "2021-05-01")), ("nothing, no floor", I.start_from(spark, t.limit(0), "filing_date"))]
    return spark.createDataFrame(rows, "dataset string, start string")


@query(f"SELECT * FROM (SELECT 'same time' AS told, 'snapshot' AS source, count(*) AS n FROM {H} UNION ALL SELECT 'other times', 'live', count(*) FROM {H} UNION ALL SELECT 'missing', 'live', count(*) FROM {H})")
def inc_versioned_or_live(spark, d):
    """Snapshots are read only if all were computed together."""
    rows = holdings(spark, d, "value")
    paths = {k: _folder(spark, f"snapshot-{k}") for k in "abc"}
    for k, at in (("a", 1), ("b", 1), ("c", 2)):
        rows.withColumn("computed_at", F.lit(at)).write.parquet(paths[k])
    out = []
    for told, want in (("same time", "ab"), ("other times", "ac")):
        frames, live = I.versioned_or_live(spark, [paths[k] for k in want], lambda: rows)
        out.append((told, "live" if frames is None else "snapshot", (live if frames is None else frames[0]).count()))
    frames, live = I.versioned_or_live(spark, [paths["a"], f"{paths['b']}-{uuid.uuid4().hex}"], lambda: rows)
    out.append(("missing", "live" if frames is None else "snapshot", (live if frames is None else frames[0]).count()))
    return spark.createDataFrame(out, "told string, source string, n bigint")


@query("""WITH t AS (SELECT transaction_id AS k, bool_and(price_per_share IS NOT NULL) AS ok FROM insider_transaction GROUP BY 1), o AS (SELECT DISTINCT transaction_id AS k FROM insider_transaction WHERE transaction_code = 'Gift')
SELECT k AS transaction_id, CASE WHEN o.k IS NULL THEN 1 ELSE 5 END AS attempts, CASE WHEN o.k IS NULL THEN 1 END AS wait_hours FROM t LEFT JOIN o USING (k) WHERE NOT ok""".replace("SELECT k AS", "SELECT t.k AS").replace("USING (k)", "ON o.k = t.k"))
def inc_failures(spark, d):
    """Rows that can't be used with the hours to wait; those tried often enough wait no more."""
    t = table(spark, d, "insider_transaction")
    before = t.filter("transaction_code = 'Gift'").select("transaction_id", F.lit(4).alias("attempts")).distinct()
    return I.split_failures(t, F.col("price_per_share").isNotNull(), "transaction_id", before)[1]


@query("SELECT common_stock_id, fact_id FROM shares_fact WHERE coalesce(year(filed), 0) < 2023")
def inc_stale(spark, d):
    """Facts made by an older version (here the year of filing) than the current one."""
    return I.stale(table(spark, d, "shares_fact").withColumn("version", F.year("filed")), "version", 2023).select("common_stock_id", "fact_id")


@query("""SELECT event_type, strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT *, unnest([time_bucket(INTERVAL 3 DAY, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 3 DAY, ts, TIMESTAMP '1970-01-01') - INTERVAL 3 DAY]) AS w FROM events) WHERE ts >= w AND ts < w + INTERVAL 6 DAY GROUP BY 1, 2""")
def inc_sliding_windows(spark, d):
    """Six-day windows every three days."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return I.windowed(e, "ts", "6 days", ["event_type"], "value", "3 days").select("event_type", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n", F.round("total", 2).alias("total"))


@query(f"""WITH k AS (SELECT DISTINCT institutional_holder_id AS h, report_date AS r FROM {H} WHERE is_amendment)
SELECT institutional_holder_id, strftime(report_date, '%Y-%m-%d') AS report_date, count(*) AS rows_n, CAST(sum(value) AS BIGINT) AS value FROM {H} q LEFT JOIN k ON k.h = q.institutional_holder_id AND k.r = q.report_date WHERE k.h IS NULL OR q.is_amendment GROUP BY 1, 2""")
def inc_restate_periods(spark, d):
    """Original holdings stored by period; a period that is restated is deleted and inserted again as amended."""
    path = _folder(spark, "periods")
    rows = holdings(spark, d, "institutional_holder_id", "report_date", "value", "is_amendment").filter("institutional_holder_id IS NOT NULL AND report_date IS NOT NULL")
    I.restate_periods(rows.filter("NOT is_amendment"), rows.filter("is_amendment"), ["institutional_holder_id", "report_date"], "report_date", path)
    got = spark.read.parquet(path)
    return got.groupBy("institutional_holder_id", day(F.col("report_date").cast("date")).alias("report_date")).agg(F.count("*").alias("rows_n"), F.sum("value").alias("value"))


@query("""WITH f AS (SELECT common_stock_id, max(as_of) AS latest, count(*) AS n FROM shares_fact GROUP BY 1), old AS (SELECT common_stock_id, DATE '2000-01-01' AS latest, 0 AS n FROM common_stock)
SELECT o.common_stock_id, strftime(f.latest, '%Y-%m-%d') AS latest, f.n, f.latest > o.latest AS is_newer FROM old o JOIN f USING (common_stock_id)""")
def ing_directory_upsert(spark, d):
    """A stored directory brought up to date: known series updated, new ones put in, those without rows pruned."""
    from finstrata.sources import sinks

    f = table(spark, d, "shares_fact").filter("common_stock_id IS NOT NULL").groupBy("common_stock_id").agg(F.max("as_of").alias("latest"), F.count("*").alias("n"))
    old = table(spark, d, "common_stock").select("common_stock_id", F.lit("2000-01-01").cast("date").alias("latest"), F.lit(0).cast("bigint").alias("n"))
    merged = sinks.upsert(old, f.join(old.select("common_stock_id"), "common_stock_id", "left_semi"), ["common_stock_id"])
    pruned = sinks.delete_where(merged, F.col("n") == 0)
    return pruned.select("common_stock_id", day("latest").alias("latest"), "n", (F.col("latest") > F.lit("2000-01-01").cast("date")).alias("is_newer"))


# the clone of a fund, day by day

_PRICED = f"""px AS {BARS}, q AS (SELECT DISTINCT holding_id, institutional_holder_id AS h, common_stock_id AS s, report_date AS r, value AS v FROM institutional_holding WHERE filing_type = 'Form13F' AND value > 0 AND common_stock_id IS NOT NULL AND report_date IS NOT NULL AND institutional_holder_id IS NOT NULL),
b AS (SELECT h, r, s, CAST(sum(v) AS DOUBLE) AS v FROM q GROUP BY 1, 2, 3), e AS (SELECT h, r, r + 45 AS buy, coalesce(lead(r) OVER (PARTITION BY h ORDER BY r) + 45, r + 195) AS sell FROM (SELECT DISTINCT h, r FROM b)),
days AS (SELECT DISTINCT bar_date AS t FROM px), c AS (SELECT b.*, e.buy, e.sell, px.close AS c0 FROM b JOIN e ON e.h = b.h AND e.r = b.r ASOF JOIN px ON px.common_stock_id = b.s AND e.buy >= px.bar_date)"""


@query(f"""WITH {_PRICED}, x AS (SELECT c.h, c.r, c.v, c.c0, days.t, px.close AS c1 FROM c JOIN days ON days.t > c.buy AND days.t <= c.sell ASOF JOIN px ON px.common_stock_id = c.s AND days.t >= px.bar_date),
g AS (SELECT h, r, t, sum(v * c1 / c0) / sum(v) AS g FROM x GROUP BY 1, 2, 3), l AS (SELECT h, r, arg_max(g, t) AS last FROM g GROUP BY 1, 2), p AS (SELECT h, r, coalesce(product(last) OVER (PARTITION BY h ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS before FROM l)
SELECT g.h AS institutional_holder_id, strftime(g.t, '%Y-%m-%d') AS day, round(100 * p.before * g.g, 4) AS mark FROM g JOIN p ON p.h = g.h AND p.r = g.r""")
def win_clone_daily(spark, d):
    """Every fund's clone marked to market each session, from 100: bought 45 days after a report, held to 45 days
    after the next (150 days after the last). Positions without a price when bought are left out."""
    rows = table(spark, d, "institutional_holding").filter("filing_type = 'Form13F' AND value > 0")
    return S.clone_daily(rows, bars(spark, d).select("common_stock_id", "bar_date", "close")).select("institutional_holder_id", day("day").alias("day"), F.round("mark", 4).alias("mark"))
