"""Ownership queries: filters, joins, aggregations, top-k and set operations over filings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finstrata.core.tables import table
from finstrata.operators import relational as R
from finstrata.plans.views import CURRENT, HOLDINGS, PREVIOUS, day, holdings

QUERIES, ORACLES = {}, {}
H, CUR, PRE = HOLDINGS, f"DATE '{CURRENT}'", f"DATE '{PREVIOUS}'"
BOTH = f"report_date IN ({CUR}, {PRE})"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


# scans and predicates


@query("""SELECT 'common_stock' AS table_name, count(*) AS n FROM common_stock UNION ALL SELECT 'institutional_holder', count(*) FROM institutional_holder
UNION ALL SELECT 'institutional_holding', count(*) FROM institutional_holding UNION ALL SELECT 'daily_stock_price', count(*) FROM daily_stock_price
UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'events', count(*) FROM events""")
def scan_table_counts(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name in ("common_stock", "institutional_holder", "institutional_holding", "daily_stock_price", "documents", "events"):
        one = table(spark, d, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT common_stock_id, ticker, name, cik, cusip FROM common_stock WHERE common_stock_id = 7")
def scan_point_lookup(spark, d):
    return R.where_all(table(spark, d, "common_stock"), common_stock_id=7).select("common_stock_id", "ticker", "name", "cik", "cusip")


@query("""SELECT DISTINCT price_id, strftime(bar_date, '%Y-%m-%d') AS bar_date, CAST(close AS DOUBLE) AS close FROM daily_stock_price
WHERE common_stock_id = 3 AND bar_date BETWEEN DATE '2024-03-01' AND DATE '2024-06-30'""")
def pred_date_window(spark, d):
    rows = R.where_all(table(spark, d, "daily_stock_price"), common_stock_id=3, bar_date=("2024-03-01", "2024-06-30"))
    return rows.select("price_id", day("bar_date").alias("bar_date"), F.col("close").cast("double").alias("close")).distinct()


@query(f"SELECT holding_id, shares, value FROM {H} WHERE report_date >= DATE '2024-01-01' AND share_type IN ('Shares', 'Principal') AND option_type = 'Put'")
def pred_optional_criteria(spark, d):
    rows = holdings(spark, d, "report_date", "share_type", "option_type", "institutional_holder_id", "shares", "value")
    return R.where_all(
        rows, report_date=("2024-01-01", None), share_type=["Shares", "Principal"], option_type="Put", institutional_holder_id=None
    ).select("holding_id", "shares", "value")


@query("""SELECT common_stock_id, count(*) AS n FROM (SELECT DISTINCT transaction_id, common_stock_id FROM insider_transaction)
WHERE common_stock_id IN (SELECT common_stock_id FROM common_stock WHERE industry = 'Water utilities') GROUP BY 1""")
def pred_in_set(spark, d):
    wanted = R.where_all(table(spark, d, "common_stock"), industry="Water utilities").select("common_stock_id")
    rows = table(spark, d, "insider_transaction").select("transaction_id", "common_stock_id").distinct()
    return rows.join(wanted, "common_stock_id", "left_semi").groupBy("common_stock_id").agg(F.count("*").alias("n"))


_CIKS = "SELECT common_stock_id, list_sort(list(DISTINCT lpad(ltrim(regexp_replace(cik, '[^0-9]', '', 'g'), '0'), 10, '0'))) AS ciks FROM stock_secondary_cik_attached GROUP BY 1"


def _ciks(spark, d):
    from finstrata.operators.ledger import clean_cik

    rows = table(spark, d, "stock_secondary_cik_attached").select("common_stock_id", clean_cik(F.col("cik")).alias("cik"))
    return rows.groupBy("common_stock_id").agg(F.array_sort(F.collect_set("cik")).alias("ciks"))


@query(f"WITH c AS ({_CIKS}) SELECT q.common_stock_id AS searched_id, a.common_stock_id, array_to_string(a.ciks, ',') AS ciks FROM c q JOIN c a ON list_has_any(a.ciks, q.ciks)")
def pred_array_overlap_all(spark, d):
    """For every stock the stocks whose CIKs overlap with its own (itself too): single CIKs are joined by equality."""
    rows = _ciks(spark, d)
    one = rows.select("common_stock_id", F.explode("ciks").alias("cik"))
    pairs = one.withColumnRenamed("common_stock_id", "searched_id").join(one, "cik").select("searched_id", "common_stock_id").distinct()
    return pairs.join(rows, "common_stock_id").select("searched_id", "common_stock_id", F.array_join("ciks", ",").alias("ciks"))


@query(f"SELECT common_stock_id, unnest(ciks) AS cik FROM ({_CIKS})")
def pred_array_flatten(spark, d):
    return _ciks(spark, d).select("common_stock_id", F.explode("ciks").alias("cik"))


@query(r"SELECT institutional_holder_id, name FROM institutional_holder WHERE name ILIKE '%fund s%' ESCAPE '\' OR name ILIKE '%\_%' ESCAPE '\'")
def pred_text_contains(spark, d):
    rows = table(spark, d, "institutional_holder")
    return rows.filter(R.contains_text(F.col("name"), "fund s") | R.contains_text(F.col("name"), "_")).select("institutional_holder_id", "name")


@query("SELECT institutional_holder_id, name FROM institutional_holder WHERE regexp_matches(name, '(^|[^A-Za-z0-9])bank($|[^A-Za-z0-9])', 'i')")
def pred_whole_word(spark, d):
    rows = table(spark, d, "institutional_holder")
    return rows.filter(R.whole_word(F.col("name"), "bank")).select("institutional_holder_id", "name")


@query("""SELECT common_stock_id, ticker, name, CASE WHEN lower(ticker) = 'inc zq' THEN 0 WHEN ticker ILIKE 'inc zq%' THEN 1 ELSE 2 END AS match_rank FROM common_stock
WHERE (coalesce(ticker ILIKE '%inc%', false) OR coalesce(name ILIKE '%inc%', false) OR coalesce(cik ILIKE '%inc%', false) OR coalesce(cusip ILIKE '%inc%', false))
AND (coalesce(ticker ILIKE '%zq%', false) OR coalesce(name ILIKE '%zq%', false) OR coalesce(cik ILIKE '%zq%', false) OR coalesce(cusip ILIKE '%zq%', false))""")
def pred_ranked_search(spark, d):
    found = R.ranked_search(table(spark, d, "common_stock"), "inc zq", ["ticker", "name", "cik", "cusip"], "ticker", "ticker")
    return found.select("common_stock_id", "ticker", "name", "match_rank")


@query("""SELECT revenue_row_id FROM dimensional_revenue_row WHERE date_diff('day', period_start, period_end) BETWEEN 0 AND 380 GROUP BY 1""")
def pred_plausible_span(spark, d):
    rows = table(spark, d, "dimensional_revenue_row")
    return rows.filter(F.date_diff("period_end", "period_start").between(0, 380)).select("revenue_row_id").distinct()


@query("SELECT common_stock_id, ticker FROM common_stock WHERE false")
def pred_never(spark, d):
    return R.never(table(spark, d, "common_stock").select("common_stock_id", "ticker"))


@query("SELECT coalesce(industry, '') AS industry, string_agg(ticker, ',' ORDER BY ticker) AS tickers, count(*) AS n FROM common_stock GROUP BY 1")
def pred_nested_children(spark, d):
    rows = table(spark, d, "common_stock").groupBy(F.coalesce("industry", F.lit("")).alias("industry"))
    return rows.agg(F.array_join(F.array_sort(F.collect_list("ticker")), ",").alias("tickers"), F.count("*").alias("n"))


@query(f"""SELECT h.common_stock_id, round(CASE WHEN max(s.shares_out_standing) > 0 THEN CAST(sum(h.shares) AS DOUBLE) / max(s.shares_out_standing) * 100 ELSE 0 END, 6) AS held_percent
FROM {H} h JOIN common_stock s USING (common_stock_id) WHERE report_date = {CUR} GROUP BY 1""")
def pred_safe_share(spark, d):
    held = R.where_all(holdings(spark, d, "common_stock_id", "report_date", "shares"), report_date=F.col("report_date") == F.lit(CURRENT).cast("date"))
    by = held.groupBy("common_stock_id").agg(F.sum("shares").alias("held"))
    joined = by.join(table(spark, d, "common_stock").select("common_stock_id", "shares_out_standing"), "common_stock_id")
    return joined.select("common_stock_id", F.round(R.share_of(F.col("held"), F.col("shares_out_standing")), 6).alias("held_percent"))


@query(f"SELECT holding_id, value FROM {H} WHERE report_date = {CUR} ORDER BY value DESC NULLS LAST, holding_id LIMIT 500 OFFSET 100")
def top_page(spark, d):
    rows = holdings(spark, d, "report_date", "value").filter(F.col("report_date") == F.lit(CURRENT).cast("date"))
    return R.page(rows, [F.desc_nulls_last("value"), "holding_id"], 9_999, 100).select("holding_id", "value")


# aggregations over two quarters

_ACT = f"""SELECT common_stock_id, CAST(sum(CASE WHEN report_date = {CUR} THEN shares ELSE 0 END) AS BIGINT) AS current_shares, CAST(sum(CASE WHEN report_date = {PRE} THEN shares ELSE 0 END) AS BIGINT) AS previous_shares,
CAST(sum(CASE WHEN report_date = {CUR} THEN value ELSE 0 END) AS BIGINT) AS current_value, CAST(sum(CASE WHEN report_date = {PRE} THEN value ELSE 0 END) AS BIGINT) AS previous_value,
count(DISTINCT CASE WHEN report_date = {CUR} THEN institutional_holder_id END) AS current_filers, count(DISTINCT CASE WHEN report_date = {PRE} THEN institutional_holder_id END) AS previous_filers
FROM {H} WHERE {BOTH} GROUP BY 1"""


def _activity(spark, d):
    rows = holdings(spark, d, "common_stock_id", "institutional_holder_id", "report_date", "shares", "value")
    return R.period_activity(rows, ["common_stock_id"], "institutional_holder_id", "report_date", CURRENT, PREVIOUS, ["shares", "value"])


@query(_ACT)
def agg_quarterly_activity(spark, d):
    return _activity(spark, d)


@query(_ACT.replace("SELECT common_stock_id,", "SELECT institutional_holder_id, coalesce(listed_ticker, '') AS listing,").replace("GROUP BY 1", "GROUP BY 1, 2"))
def agg_holder_listing_activity(spark, d):
    rows = holdings(spark, d, "listed_ticker", "institutional_holder_id", "report_date", "shares", "value").withColumn("listing", F.coalesce("listed_ticker", F.lit("")))
    return R.period_activity(rows, ["institutional_holder_id", "listing"], "institutional_holder_id", "report_date", CURRENT, PREVIOUS, ["shares", "value"])


@query(f"SELECT * FROM (SELECT common_stock_id, current_value - previous_value AS value_change, 'buyers' AS side FROM ({_ACT}) WHERE current_value > previous_value ORDER BY value_change DESC, common_stock_id LIMIT 20) UNION ALL SELECT * FROM (SELECT common_stock_id, current_value - previous_value AS value_change, 'sellers' AS side FROM ({_ACT}) WHERE current_value < previous_value ORDER BY value_change, common_stock_id LIMIT 20)")
def top_buyers_sellers(spark, d):
    change = _activity(spark, d).select("common_stock_id", (F.col("current_value") - F.col("previous_value")).alias("value_change"))
    up = change.filter("value_change > 0").orderBy(F.desc("value_change"), "common_stock_id").limit(20).withColumn("side", F.lit("buyers"))
    down = change.filter("value_change < 0").orderBy("value_change", "common_stock_id").limit(20).withColumn("side", F.lit("sellers"))
    return up.unionByName(down)


_CARRY = f"(SELECT * FROM {H} WHERE report_date = {CUR} UNION ALL SELECT * FROM {H} p WHERE report_date = {PRE} AND NOT EXISTS (SELECT 1 FROM {H} c WHERE c.report_date = {CUR} AND c.institutional_holder_id = p.institutional_holder_id))"


@query(f"SELECT common_stock_id, strftime(report_date, '%Y-%m-%d') AS source_date, CAST(sum(shares) AS BIGINT) AS shares, CAST(sum(value) AS BIGINT) AS value, count(*) AS rows_n FROM {_CARRY} GROUP BY 1, 2")
def join_carry_forward(spark, d):
    rows = holdings(spark, d, "common_stock_id", "institutional_holder_id", "report_date", "shares", "value")
    both = R.carry_forward(rows, "institutional_holder_id", "report_date", CURRENT, PREVIOUS)
    return both.groupBy("common_stock_id", day("report_date").alias("source_date")).agg(
        F.sum("shares").alias("shares"), F.sum("value").alias("value"), F.count("*").alias("rows_n")
    )


@query(f"""WITH k AS (SELECT DISTINCT common_stock_id AS s, institutional_holder_id AS h, report_date AS r FROM {H} WHERE {BOTH}),
c AS (SELECT s, h FROM k WHERE r = {CUR}), p AS (SELECT s, h FROM k WHERE r = {PRE})
SELECT s AS common_stock_id, count(*) FILTER (WHERE ph IS NULL) AS new_filers, count(*) FILTER (WHERE ch IS NULL) AS sold_out_filers, count(*) FILTER (WHERE ph IS NOT NULL AND ch IS NOT NULL) AS kept_filers
FROM (SELECT coalesce(c.s, p.s) AS s, c.h AS ch, p.h AS ph FROM c FULL JOIN p ON c.s = p.s AND c.h = p.h) GROUP BY 1""")
def agg_churn(spark, d):
    rows = holdings(spark, d, "common_stock_id", "institutional_holder_id", "report_date")
    return R.churn(rows, "common_stock_id", "institutional_holder_id", "report_date", CURRENT, PREVIOUS)


@query(f"""SELECT DISTINCT p.institutional_holder_id, p.common_stock_id FROM {H} p WHERE p.report_date = {PRE}
AND EXISTS (SELECT 1 FROM {H} c WHERE c.report_date = {CUR} AND c.institutional_holder_id = p.institutional_holder_id)
AND NOT EXISTS (SELECT 1 FROM {H} c WHERE c.report_date = {CUR} AND c.institutional_holder_id = p.institutional_holder_id AND c.common_stock_id = p.common_stock_id)""")
def join_sold_out_among_filers(spark, d):
    rows = holdings(spark, d, "common_stock_id", "institutional_holder_id", "report_date")
    return R.gone_among_filers(rows, "common_stock_id", "institutional_holder_id", "report_date", CURRENT, PREVIOUS)


@query(f"""SELECT institutional_holder_id, strftime(report_date, '%Y-%m-%d') AS report_date, strftime(max(filing_date), '%Y-%m-%d') AS last_filed, CAST(sum(value) AS BIGINT) AS value, count(*) AS positions, count(DISTINCT common_stock_id) AS stocks FROM {H} GROUP BY 1, 2""")
def agg_holder_snapshots(spark, d):
    rows = holdings(spark, d, "institutional_holder_id", "report_date", "filing_date", "value", "common_stock_id")
    return rows.groupBy("institutional_holder_id", day("report_date").alias("report_date")).agg(
        day(F.max("filing_date")).alias("last_filed"), F.sum("value").alias("value"), F.count("*").alias("positions"), F.count_distinct("common_stock_id").alias("stocks")
    )


@query(f"""SELECT strftime(report_date, '%Y-%m-%d') AS report_date, CAST(sum(value) AS BIGINT) AS value, count(DISTINCT institutional_holder_id) AS filers, count(DISTINCT common_stock_id) AS stocks,
count(DISTINCT accession_number) AS filings, count(DISTINCT cusip) AS cusips FROM {H} GROUP BY 1""")
def agg_quarter_totals(spark, d):
    """Four distinct counts a quarter without multiplying rows: filings with their filer and stocks with their
    CUSIPs are reduced first, by two aggregations over one shuffle, and the few that are left are counted."""
    rows = holdings(spark, d, "report_date", "value", "institutional_holder_id", "common_stock_id", "accession_number", "cusip")
    filed = rows.groupBy("report_date", "institutional_holder_id", "accession_number").agg(F.sum("value").alias("value"))
    held = rows.groupBy("report_date", "common_stock_id", "cusip").agg(F.lit(1).alias("one"))
    a = filed.groupBy("report_date").agg(F.sum("value").alias("value"), F.count_distinct("institutional_holder_id").alias("filers"), F.count_distinct("accession_number").alias("filings"))
    b = held.groupBy("report_date").agg(F.count_distinct("common_stock_id").alias("stocks"), F.count_distinct("cusip").alias("cusips"))
    both = a.join(b, a["report_date"].eqNullSafe(b["report_date"])).select(day(a["report_date"]).alias("report_date"), "value", "filers", "stocks", "filings", "cusips")
    return both


@query(f"SELECT institutional_holder_id, common_stock_id, strftime(min(report_date), '%Y-%m-%d') AS first_owned FROM {H} GROUP BY 1, 2")
def agg_first_owned(spark, d):
    rows = holdings(spark, d, "institutional_holder_id", "common_stock_id", "report_date")
    return rows.groupBy("institutional_holder_id", "common_stock_id").agg(day(F.min("report_date")).alias("first_owned"))


@query(f"""SELECT s.industry, strftime(h.report_date, '%Y-%m-%d') AS report_date, CAST(sum(h.value) AS BIGINT) AS value, count(DISTINCT h.common_stock_id) AS stocks
FROM {H} h JOIN common_stock s USING (common_stock_id) WHERE s.industry IS NOT NULL GROUP BY 1, 2""")
def join_industry_snapshots(spark, d):
    """Aggregated by stock before the dimension is joined, so the join is over few rows."""
    rows = holdings(spark, d, "common_stock_id", "report_date", "value")
    by = rows.groupBy("common_stock_id", day("report_date").alias("report_date")).agg(F.sum("value").alias("value"))
    stocks = table(spark, d, "common_stock").select("common_stock_id", "industry").filter(F.col("industry").isNotNull())
    return by.join(stocks, "common_stock_id").groupBy("industry", "report_date").agg(F.sum("value").alias("value"), F.count("*").alias("stocks"))


@query(f"""WITH a AS (SELECT institutional_holder_id, common_stock_id, CAST(sum(CASE WHEN report_date = {CUR} THEN value ELSE 0 END) AS BIGINT) AS cur, CAST(sum(CASE WHEN report_date = {PRE} THEN value ELSE 0 END) AS BIGINT) AS pre FROM {H} WHERE {BOTH} GROUP BY 1, 2)
SELECT a.institutional_holder_id, i.name AS holder, a.common_stock_id, s.ticker, cur AS current_value, pre AS previous_value FROM a JOIN common_stock s USING (common_stock_id) JOIN institutional_holder i USING (institutional_holder_id) WHERE pre > 0 AND cur >= 2 * pre""")
def join_doubled_down(spark, d):
    """Positions at least doubled, with both dimensions."""
    rows = holdings(spark, d, "common_stock_id", "institutional_holder_id", "report_date", "value")
    a = R.period_activity(rows, ["institutional_holder_id", "common_stock_id"], "institutional_holder_id", "report_date", CURRENT, PREVIOUS, ["value"])
    big = a.filter((F.col("previous_value") > 0) & (F.col("current_value") >= 2 * F.col("previous_value")))
    stocks = table(spark, d, "common_stock").select("common_stock_id", "ticker")
    owners = table(spark, d, "institutional_holder").select("institutional_holder_id", F.col("name").alias("holder"))
    return big.join(stocks, "common_stock_id").join(owners, "institutional_holder_id").select(
        "institutional_holder_id", "holder", "common_stock_id", "ticker", "current_value", "previous_value"
    )


@query(f"SELECT h.holding_id, common_stock_id, institutional_holder_id, strftime(report_date, '%Y-%m-%d') AS report_date FROM {H} h JOIN (SELECT common_stock_id, institutional_holder_id, max(report_date) AS report_date FROM {H} GROUP BY 1, 2) m USING (common_stock_id, institutional_holder_id, report_date)")
def join_latest_per_position(spark, d):
    """Every stock's rows of each holder's latest report, ties kept."""
    rows = holdings(spark, d, "common_stock_id", "institutional_holder_id", "report_date")
    return R.latest_with_ties(rows, ["common_stock_id", "institutional_holder_id"], "report_date").select("holding_id", "common_stock_id", "institutional_holder_id", day("report_date").alias("report_date"))


@query(f"""WITH last AS (SELECT h.institutional_holder_id, h.report_date, CAST(sum(value) AS BIGINT) AS value, count(DISTINCT common_stock_id) AS stocks FROM {H} h
 JOIN (SELECT institutional_holder_id, max(report_date) AS report_date FROM {H} GROUP BY 1) m USING (institutional_holder_id, report_date) GROUP BY 1, 2)
SELECT i.institutional_holder_id, i.name, value, stocks, date_diff('day', report_date, max(report_date) OVER ()) <= 135 AS is_live FROM last JOIN institutional_holder i USING (institutional_holder_id) WHERE i.name ILIKE '%bank%'""")
def join_rank_with_stats(spark, d):
    """Institutions found by name with their latest totals; live ones are those near the newest."""
    rows = holdings(spark, d, "institutional_holder_id", "report_date", "value", "common_stock_id")
    newest = Window.partitionBy("institutional_holder_id")
    last = rows.withColumn("_m", F.max("report_date").over(newest)).filter(F.col("_m") == F.col("report_date"))
    stats = last.groupBy("institutional_holder_id", "report_date").agg(F.sum("value").alias("value"), F.count_distinct("common_stock_id").alias("stocks"))
    named = table(spark, d, "institutional_holder").filter(R.contains_text(F.col("name"), "bank")).select("institutional_holder_id", "name")
    found = named.join(stats, "institutional_holder_id")
    top = found.agg(F.max("report_date").alias("_top"))
    live = F.date_diff("_top", "report_date") <= 135
    return found.crossJoin(F.broadcast(top)).select("institutional_holder_id", "name", "value", "stocks", live.alias("is_live")).orderBy(F.desc("is_live"), F.desc("value"), "institutional_holder_id")


@query(f"""SELECT i.institutional_holder_id, i.name, coalesce(n, 0) AS positions FROM institutional_holder i LEFT JOIN (SELECT institutional_holder_id, count(*) AS n FROM {H} WHERE report_date = {CUR} GROUP BY 1) USING (institutional_holder_id)""")
def join_left_first(spark, d):
    counts = holdings(spark, d, "institutional_holder_id", "report_date").filter(F.col("report_date") == F.lit(CURRENT).cast("date")).groupBy("institutional_holder_id").agg(F.count("*").alias("n"))
    owners = table(spark, d, "institutional_holder").select("institutional_holder_id", "name")
    return owners.join(counts, "institutional_holder_id", "left").select("institutional_holder_id", "name", F.coalesce("n", F.lit(0)).alias("positions"))


@query("""SELECT insider_owner_id, common_stock_id, transaction_id, shares_owned_after FROM (SELECT *, row_number() OVER (PARTITION BY insider_owner_id, common_stock_id ORDER BY transaction_date DESC NULLS LAST, filing_date DESC NULLS LAST, transaction_id DESC) AS rn
FROM (SELECT DISTINCT transaction_id, insider_owner_id, common_stock_id, transaction_date, filing_date, shares_owned_after FROM insider_transaction)) WHERE rn = 1""")
def join_current_row(spark, d):
    rows = table(spark, d, "insider_transaction").select("transaction_id", "insider_owner_id", "common_stock_id", "transaction_date", "filing_date", "shares_owned_after").distinct()
    order = [F.desc_nulls_last("transaction_date"), F.desc_nulls_last("filing_date"), F.desc("transaction_id")]
    return R.nth_latest(rows, ["insider_owner_id", "common_stock_id"], order).select("insider_owner_id", "common_stock_id", "transaction_id", "shares_owned_after")


@query("""SELECT common_stock_id, fact_id, shares FROM (SELECT *, row_number() OVER (PARTITION BY common_stock_id ORDER BY as_of DESC NULLS LAST, filed DESC NULLS LAST, accession_number DESC NULLS LAST, fact_id) AS rn FROM shares_fact) WHERE rn = 1""")
def join_no_later_row(spark, d):
    """The row no other exceeds in (period, filing date, accession): a window, not a theta anti-join."""
    order = [F.desc_nulls_last("as_of"), F.desc_nulls_last("filed"), F.desc_nulls_last("accession_number"), F.col("fact_id")]
    return R.nth_latest(table(spark, d, "shares_fact"), ["common_stock_id"], order).select("common_stock_id", "fact_id", "shares")


@query(f"""SELECT institutional_holder_id, common_stock_id, coalesce(c.v, 0) AS current_value, coalesce(p.v, 0) AS previous_value FROM
(SELECT institutional_holder_id, common_stock_id, CAST(sum(value) AS BIGINT) AS v FROM {H} WHERE report_date = {CUR} GROUP BY 1, 2) c FULL JOIN
(SELECT institutional_holder_id, common_stock_id, CAST(sum(value) AS BIGINT) AS v FROM {H} WHERE report_date = {PRE} GROUP BY 1, 2) p USING (institutional_holder_id, common_stock_id)""")
def join_full_outer_positions(spark, d):
    """Every holder's positions of two periods side by side."""
    rows = holdings(spark, d, "common_stock_id", "institutional_holder_id", "report_date", "value")
    keys = ["institutional_holder_id", "common_stock_id"]
    side = lambda q, name: rows.filter(F.col("report_date") == F.lit(q).cast("date")).groupBy(*keys).agg(F.sum("value").alias(name))
    both = side(CURRENT, "current_value").join(side(PREVIOUS, "previous_value"), keys, "full")
    return both.select(*keys, F.coalesce("current_value", F.lit(0)).alias("current_value"), F.coalesce("previous_value", F.lit(0)).alias("previous_value"))


_CC = "regexp_replace(upper({}), '[^A-Z0-9]', '', 'g')"


@query(f"""WITH k AS (SELECT common_stock_id, {_CC.format('cusip')} AS c FROM common_stock UNION SELECT common_stock_id, {_CC.format('cusip')} FROM stock_cusip_changed UNION SELECT common_stock_id, {_CC.format('previous_cusip')} FROM stock_cusip_changed)
SELECT disagreement_id FROM value_basis_disagreement WHERE {_CC.format('cusip')} IN (SELECT c FROM k WHERE length(c) = 9)""")
def join_cusip_set(spark, d):
    """Rows whose CUSIP any stock bears or bore: a semi-join with the union of both sets."""
    from finstrata.operators.ledger import clean_cusip

    now = table(spark, d, "common_stock").select(clean_cusip(F.col("cusip")).alias("c"))
    moved = table(spark, d, "stock_cusip_changed")
    old = moved.select(clean_cusip(F.col("cusip")).alias("c")).union(moved.select(clean_cusip(F.col("previous_cusip"))))
    rows = table(spark, d, "value_basis_disagreement").select("disagreement_id", clean_cusip(F.col("cusip")).alias("c"))
    return rows.join(now.union(old).distinct(), "c", "left_semi").select("disagreement_id")


@query(f"""WITH p AS (SELECT {_CC.format('cusip')} AS c, min(common_stock_id) AS s FROM common_stock GROUP BY 1),
a AS (SELECT {_CC.format('cusip')} AS c, min(common_stock_id) AS s FROM stock_cusip_changed GROUP BY 1 HAVING count(DISTINCT common_stock_id) = 1)
SELECT v.disagreement_id, coalesce(p.s, a.s) AS common_stock_id, CASE WHEN p.s IS NOT NULL THEN 'current' WHEN a.s IS NOT NULL THEN 'former' ELSE 'none' END AS basis
FROM (SELECT disagreement_id, {_CC.format('cusip')} AS c FROM value_basis_disagreement) v LEFT JOIN p USING (c) LEFT JOIN a USING (c)""")
def join_cusip_cascade(spark, d):
    """CUSIP to stock by precedence: a current one, then a former one that only one stock bore."""
    from finstrata.operators.ledger import clean_cusip

    key = clean_cusip(F.col("cusip")).alias("c")
    primary = table(spark, d, "common_stock").select(key, "common_stock_id").groupBy("c").agg(F.min("common_stock_id").alias("p"))
    former = table(spark, d, "stock_cusip_changed").select(key, "common_stock_id").groupBy("c").agg(F.min("common_stock_id").alias("a"), F.count_distinct("common_stock_id").alias("n")).filter("n = 1").drop("n")
    rows = table(spark, d, "value_basis_disagreement").select("disagreement_id", key)
    joined = rows.join(primary, "c", "left").join(former, "c", "left")
    basis = F.when(F.col("p").isNotNull(), "current").when(F.col("a").isNotNull(), "former").otherwise("none")
    return joined.select("disagreement_id", F.coalesce("p", "a").alias("common_stock_id"), basis.alias("basis"))


# portfolios

_POS = f"(SELECT institutional_holder_id, common_stock_id, CAST(sum(value) AS BIGINT) AS value FROM {H} WHERE report_date = {CUR} AND value > 0 GROUP BY 1, 2)"


def _positions(spark, d):
    rows = holdings(spark, d, "institutional_holder_id", "common_stock_id", "report_date", "value")
    return rows.filter((F.col("report_date") == F.lit(CURRENT).cast("date")) & (F.col("value") > 0)).groupBy("institutional_holder_id", "common_stock_id").agg(F.sum("value").alias("value"))


@query(f"""SELECT institutional_holder_id, coalesce(industry, 'Unclassified') AS industry, CAST(sum(value) AS BIGINT) AS value, count(DISTINCT common_stock_id) AS stocks,
round(CAST(sum(value) AS DOUBLE) / sum(sum(value)) OVER (PARTITION BY institutional_holder_id) * 100, 6) AS percent FROM {_POS} JOIN common_stock USING (common_stock_id) GROUP BY 1, 2""")
def agg_allocation(spark, d):
    stocks = table(spark, d, "common_stock").select("common_stock_id", F.coalesce("industry", F.lit("Unclassified")).alias("industry"))
    by = _positions(spark, d).join(stocks, "common_stock_id").groupBy("institutional_holder_id", "industry").agg(F.sum("value").alias("value"), F.count_distinct("common_stock_id").alias("stocks"))
    total = F.sum("value").over(Window.partitionBy("institutional_holder_id"))
    return by.withColumn("percent", F.round(R.share_of(F.col("value"), total), 6))


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY institutional_holder_id ORDER BY value DESC, common_stock_id) AS rn FROM {_POS})
SELECT institutional_holder_id, CAST(sum(value) AS BIGINT) AS aum, count(*) AS positions, round(CAST(sum(CASE WHEN rn <= 10 THEN value ELSE 0 END) AS DOUBLE) / sum(value) * 100, 6) AS top10_percent,
round(CAST(sum(CASE WHEN rn <= 25 THEN value ELSE 0 END) AS DOUBLE) / sum(value) * 100, 6) AS top25_percent FROM r GROUP BY 1""")
def agg_portfolio_summary(spark, d):
    rank = F.row_number().over(Window.partitionBy("institutional_holder_id").orderBy(F.desc("value"), "common_stock_id"))
    top = lambda k: F.sum(F.when(F.col("rn") <= k, F.col("value")).otherwise(0))
    return _positions(spark, d).withColumn("rn", rank).groupBy("institutional_holder_id").agg(
        F.sum("value").alias("aum"), F.count("*").alias("positions"),
        F.round(R.share_of(top(10), F.sum("value")), 6).alias("top10_percent"), F.round(R.share_of(top(25), F.sum("value")), 6).alias("top25_percent"),
    )


@query(f"""WITH a AS (SELECT institutional_holder_id, common_stock_id, CAST(sum(CASE WHEN report_date = {CUR} THEN shares ELSE 0 END) AS BIGINT) AS cs, CAST(sum(CASE WHEN report_date = {PRE} THEN shares ELSE 0 END) AS BIGINT) AS ps,
CAST(sum(CASE WHEN report_date = {CUR} THEN value ELSE 0 END) AS BIGINT) AS cv, CAST(sum(CASE WHEN report_date = {PRE} THEN value ELSE 0 END) AS BIGINT) AS pv FROM {H} WHERE {BOTH} GROUP BY 1, 2)
SELECT institutional_holder_id, round(CASE WHEN sum(cv) > 0 THEN sum(CASE WHEN cs > 0 THEN abs(cs - ps) * (CAST(cv AS DOUBLE) / cs) WHEN ps > 0 THEN ps * (CAST(pv AS DOUBLE) / ps) ELSE 0 END) / (2 * CAST(sum(cv) AS DOUBLE)) * 100 ELSE 0 END, 4) AS turnover_percent FROM a GROUP BY 1""")
def agg_turnover(spark, d):
    """Quarter-over-quarter turnover: traded shares at the value a share, against twice the assets."""
    rows = holdings(spark, d, "institutional_holder_id", "common_stock_id", "report_date", "shares", "value")
    a = R.period_activity(rows, ["institutional_holder_id", "common_stock_id"], "institutional_holder_id", "report_date", CURRENT, PREVIOUS, ["shares", "value"])
    cs, ps, cv, pv = (F.col(c) for c in ("current_shares", "previous_shares", "current_value", "previous_value"))
    traded = F.when(cs > 0, F.abs(cs - ps) * (cv.cast("double") / cs)).when(ps > 0, ps * (pv.cast("double") / ps)).otherwise(0.0)
    total = F.sum(cv)
    rate = F.when(total > 0, F.sum(traded) / (2 * total.cast("double")) * 100).otherwise(0.0)
    return a.groupBy("institutional_holder_id").agg(F.round(rate, 4).alias("turnover_percent"))


@query(f"""WITH s AS (SELECT institutional_holder_id AS w, common_stock_id AS i FROM {_POS}), n AS (SELECT w, count(*) AS n FROM s GROUP BY 1)
SELECT a.w AS a, b.w AS b, count(*) AS shared, max(na.n) + max(nb.n) - count(*) AS union_size, round(CAST(count(*) AS DOUBLE) / (max(na.n) + max(nb.n) - count(*)) * 100, 4) AS jaccard
FROM s a JOIN s b ON a.i = b.i AND a.w < b.w JOIN n na ON na.w = a.w JOIN n nb ON nb.w = b.w WHERE a.w IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89) AND b.w IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89) GROUP BY 1, 2""")
def agg_overlap_matrix(spark, d):
    """Shared positions of ten chosen funds, pair by pair."""
    chosen = R.where_all(_positions(spark, d), institutional_holder_id=[1, 2, 3, 5, 8, 13, 21, 34, 55, 89])
    return R.overlap_pairs(chosen, "institutional_holder_id", "common_stock_id")


@query(f"""WITH s AS (SELECT * FROM {_POS} WHERE institutional_holder_id IN (1, 2, 3)), g AS (SELECT common_stock_id, count(*) AS funds, min(value) AS lo, max(value) AS hi FROM s GROUP BY 1)
SELECT count(*) FILTER (WHERE funds = 3) AS shared, count(*) AS union_size, round(CAST(count(*) FILTER (WHERE funds = 3) AS DOUBLE) / count(*) * 100, 6) AS jaccard,
round(CAST(sum(CASE WHEN funds = 3 THEN lo ELSE 0 END) AS DOUBLE) / CAST(sum(hi) AS DOUBLE) * 100, 6) AS weighted FROM g""")
def agg_fund_overlap(spark, d):
    """Overlap of three funds by count and by dollars (least over greatest position)."""
    g = R.where_all(_positions(spark, d), institutional_holder_id=[1, 2, 3]).groupBy("common_stock_id").agg(F.count("*").alias("funds"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    every = F.col("funds") == 3
    return g.agg(
        F.count_if(every).alias("shared"), F.count("*").alias("union_size"), F.round(R.share_of(F.count_if(every), F.count("*")), 6).alias("jaccard"),
        F.round(R.share_of(F.sum(F.when(every, F.col("lo")).otherwise(0)), F.sum("hi")), 6).alias("weighted"),
    )


@query(f"SELECT common_stock_id, count(DISTINCT institutional_holder_id) AS funds, CAST(sum(value) AS BIGINT) AS value FROM {_POS} GROUP BY 1 HAVING count(DISTINCT institutional_holder_id) >= 5")
def agg_consensus(spark, d):
    return _positions(spark, d).groupBy("common_stock_id").agg(F.count_distinct("institutional_holder_id").alias("funds"), F.sum("value").alias("value")).filter(F.col("funds") >= 5)


@query(f"""WITH w AS (SELECT *, CAST(value AS DOUBLE) / sum(value) OVER (PARTITION BY institutional_holder_id) AS weight FROM {_POS}), g AS (SELECT common_stock_id, count(*) AS funds, round(sum(weight), 6) AS weight, CAST(sum(value) AS BIGINT) AS value FROM w GROUP BY 1 HAVING count(*) >= 2)
SELECT common_stock_id, funds, weight, value, row_number() OVER (ORDER BY funds DESC, weight DESC, value DESC, common_stock_id) AS index_rank, round(1.0 / least(50, count(*) OVER ()), 6) AS index_weight FROM g QUALIFY index_rank <= 50""")
def agg_consensus_index(spark, d):
    """An equal-weight index of the stocks that most funds hold, by weight within the fund."""
    share = F.col("value").cast("double") / F.sum("value").over(Window.partitionBy("institutional_holder_id"))
    g = _positions(spark, d).withColumn("w", share).groupBy("common_stock_id").agg(F.count("*").alias("funds"), F.round(F.sum("w"), 6).alias("weight"), F.sum("value").alias("value")).filter("funds >= 2")
    top = g.orderBy(F.desc("funds"), F.desc("weight"), F.desc("value"), "common_stock_id").limit(50)
    w = Window.orderBy(F.desc("funds"), F.desc("weight"), F.desc("value"), "common_stock_id")
    return top.withColumn("index_rank", F.row_number().over(w).cast("bigint")).withColumn("index_weight", F.round(F.lit(1.0) / F.count("*").over(Window.partitionBy()), 6))


@query(f"""WITH n AS (SELECT accession_number, institutional_holder_id, filing_date, count(*) AS n FROM {H} GROUP BY 1, 2, 3)
SELECT accession_number, institutional_holder_id, strftime(filing_date, '%Y-%m-%d') AS filing_date, n AS rows_n FROM (SELECT *, row_number() OVER (PARTITION BY accession_number ORDER BY n DESC, filing_date DESC, institutional_holder_id) AS rn FROM n) WHERE rn = 1""")
def agg_dominant_variant(spark, d):
    """Of the variants of a filing's metadata, the one most rows bear."""
    n = holdings(spark, d, "accession_number", "institutional_holder_id", "filing_date").groupBy("accession_number", "institutional_holder_id", "filing_date").agg(F.count("*").alias("rows_n"))
    best = R.nth_latest(n, ["accession_number"], [F.desc("rows_n"), F.desc("filing_date"), F.col("institutional_holder_id")])
    return best.select("accession_number", "institutional_holder_id", day("filing_date").alias("filing_date"), "rows_n")


@query(f"""SELECT institutional_holder_id, common_stock_id, strftime(report_date, '%Y-%m-%d') AS report_date, share_type, coalesce(option_type, '') AS option_type, CAST(sum(shares) AS BIGINT) AS shares, CAST(sum(value) AS BIGINT) AS value, bool_or(value_pending) AS pending, count(*) AS legs
FROM {H} GROUP BY 1, 2, 3, 4, 5""")
def agg_merge_legs(spark, d):
    """Rows of equal natural key added up; flags or'ed."""
    rows = holdings(spark, d, "institutional_holder_id", "common_stock_id", "report_date", "share_type", "option_type", "shares", "value", "value_pending")
    return rows.groupBy("institutional_holder_id", "common_stock_id", day("report_date").alias("report_date"), "share_type", F.coalesce("option_type", F.lit("")).alias("option_type")).agg(
        F.sum("shares").alias("shares"), F.sum("value").alias("value"), F.bool_or("value_pending").alias("pending"), F.count("*").alias("legs")
    )


@query(f"SELECT DISTINCT strftime(report_date, '%Y-%m-%d') AS report_date FROM {H}")
def agg_distinct_dates(spark, d):
    return table(spark, d, "institutional_holding").filter(F.col("filing_type") == "Form13F").select(day("report_date").alias("report_date")).distinct().orderBy(F.desc("report_date"))


@query(f"SELECT common_stock_id, count(DISTINCT report_date) AS quarters FROM {H} GROUP BY 1 HAVING count(DISTINCT report_date) >= 10")
def agg_dense_coverage(spark, d):
    return holdings(spark, d, "common_stock_id", "report_date").groupBy("common_stock_id").agg(F.count_distinct("report_date").alias("quarters")).filter("quarters >= 10")


_HEAT = f"""WITH k AS (SELECT DISTINCT common_stock_id AS s, institutional_holder_id AS h, report_date AS r FROM {H} WHERE {BOTH}),
g AS (SELECT s, h, max(CASE WHEN r = {CUR} THEN 1 ELSE 0 END) AS c, max(CASE WHEN r = {PRE} THEN 1 ELSE 0 END) AS p FROM k GROUP BY 1, 2),
t AS (SELECT s, sum(c) AS cur, sum(p) AS pre, sum(CASE WHEN c = 1 AND p = 0 THEN 1 ELSE 0 END) AS nw, sum(CASE WHEN c = 0 AND p = 1 THEN 1 ELSE 0 END) AS sold FROM g GROUP BY 1),
u AS (SELECT count(DISTINCT h) AS n FROM k WHERE r = {CUR})"""


@query(f"""{_HEAT} SELECT s AS common_stock_id, CAST(cur AS BIGINT) AS current_filers, round(CAST(nw - sold AS DOUBLE) / cur * 100 + CASE WHEN pre > 0 THEN (1 - CAST(sold AS DOUBLE) / pre) * 100 ELSE 0 END + CAST(cur AS DOUBLE) / n * 100, 1) AS score FROM t, u WHERE cur >= 3""")
def agg_conviction(spark, d):
    """Score of stocks with three or more filers: net new, kept, and breadth of ownership."""
    rows = holdings(spark, d, "common_stock_id", "institutional_holder_id", "report_date")
    c = R.churn(rows, "common_stock_id", "institutional_holder_id", "report_date", CURRENT, PREVIOUS)
    universe = rows.filter(F.col("report_date") == F.lit(CURRENT).cast("date")).agg(F.count_distinct("institutional_holder_id").alias("n"))
    cur, pre = F.col("new_filers") + F.col("kept_filers"), F.col("sold_out_filers") + F.col("kept_filers")
    score = (F.col("new_filers") - F.col("sold_out_filers")).cast("double") / cur * 100 + F.when(pre > 0, (1 - F.col("sold_out_filers").cast("double") / pre) * 100).otherwise(0.0) + cur.cast("double") / F.col("n") * 100
    return c.crossJoin(F.broadcast(universe)).filter(cur >= 3).select("common_stock_id", cur.alias("current_filers"), F.round(score, 1).alias("score"))


@query(f"""SELECT institutional_holder_id, common_stock_id, cs AS current_shares, ps AS previous_shares, CASE WHEN ps = 0 THEN 'Initiated' WHEN cs = 0 THEN 'Exited' WHEN cs > ps THEN 'Increased' WHEN cs < ps THEN 'Reduced' ELSE 'Unchanged' END AS change FROM
(SELECT institutional_holder_id, common_stock_id, CAST(sum(CASE WHEN report_date = {CUR} THEN shares ELSE 0 END) AS BIGINT) AS cs, CAST(sum(CASE WHEN report_date = {PRE} THEN shares ELSE 0 END) AS BIGINT) AS ps FROM {H} WHERE {BOTH} GROUP BY 1, 2)""")
def win_position_change(spark, d):
    rows = holdings(spark, d, "institutional_holder_id", "common_stock_id", "report_date", "shares")
    a = R.period_activity(rows, ["institutional_holder_id", "common_stock_id"], "institutional_holder_id", "report_date", CURRENT, PREVIOUS, ["shares"])
    cs, ps = F.col("current_shares"), F.col("previous_shares")
    kind = F.when(ps == 0, "Initiated").when(cs == 0, "Exited").when(cs > ps, "Increased").when(cs < ps, "Reduced").otherwise("Unchanged")
    return a.select("institutional_holder_id", "common_stock_id", "current_shares", "previous_shares", kind.alias("change"))


# order and sets


@query(f"SELECT s.common_stock_id, s.ticker, g.filers, g.value FROM (SELECT common_stock_id, count(DISTINCT institutional_holder_id) AS filers, CAST(sum(value) AS BIGINT) AS value FROM {H} WHERE report_date = {CUR} GROUP BY 1 ORDER BY filers DESC, value DESC, common_stock_id LIMIT 25) g JOIN common_stock s USING (common_stock_id)")
def top_most_held(spark, d):
    """Ranked before the dimension is joined, so only the top rows are looked up."""
    rows = holdings(spark, d, "common_stock_id", "institutional_holder_id", "report_date", "value").filter(F.col("report_date") == F.lit(CURRENT).cast("date"))
    top = rows.groupBy("common_stock_id").agg(F.count_distinct("institutional_holder_id").alias("filers"), F.sum("value").alias("value")).orderBy(F.desc("filers"), F.desc("value"), "common_stock_id").limit(25)
    return table(spark, d, "common_stock").select("common_stock_id", "ticker").join(F.broadcast(top), "common_stock_id")


@query("""SELECT transaction_id, strftime(filing_date, '%Y-%m-%d') AS filing_date FROM (SELECT DISTINCT transaction_id, filing_date FROM insider_transaction ORDER BY filing_date DESC NULLS LAST, transaction_id DESC LIMIT 100)""")
def top_newest_ascending(spark, d):
    """The newest hundred, oldest of them first."""
    rows = table(spark, d, "insider_transaction").select("transaction_id", "filing_date").distinct()
    newest = rows.orderBy(F.desc_nulls_last("filing_date"), F.desc("transaction_id")).limit(100)
    return newest.orderBy("filing_date", "transaction_id").select("transaction_id", day("filing_date").alias("filing_date"))


@query("""SELECT common_stock_id, transaction_id, value FROM (SELECT *, row_number() OVER (PARTITION BY common_stock_id ORDER BY value DESC NULLS LAST, transaction_id) AS rn FROM
(SELECT DISTINCT transaction_id, common_stock_id, CAST(shares * price_per_share AS DOUBLE) AS value FROM insider_transaction WHERE transaction_code = 'Sale')) WHERE rn <= 3""")
def top_capped_per_company(spark, d):
    rows = table(spark, d, "insider_transaction").filter(F.col("transaction_code") == "Sale").select(
        "transaction_id", "common_stock_id", (F.col("shares") * F.col("price_per_share")).cast("double").alias("value")
    ).distinct()
    w = Window.partitionBy("common_stock_id").orderBy(F.desc_nulls_last("value"), "transaction_id")
    return rows.withColumn("rn", F.row_number().over(w)).filter("rn <= 3").drop("rn")


@query("""SELECT common_stock_id, ticker, name FROM common_stock WHERE upper(ticker) = 'ZQ' UNION SELECT common_stock_id, ticker, name FROM common_stock WHERE NOT EXISTS (SELECT 1 FROM common_stock WHERE upper(ticker) = 'ZQ')
AND lower(name) LIKE '%holdings%' AND lower(name) LIKE '%inc%'""")
def set_exclusive_tiers(spark, d):
    """Exact ticker, else all words, else any word of the name."""
    rows = table(spark, d, "common_stock").select("common_stock_id", "ticker", "name")
    name = F.lower("name")
    tiers = [rows.filter(F.upper("ticker") == "ZQ"), rows.filter(name.contains("holdings") & name.contains("inc")), rows.filter(name.contains("holdings") | name.contains("inc"))]
    return R.resolve_tiers(tiers, "common_stock_id").drop("tier")


@query(f"""SELECT strftime(report_date, '%Y-%m-%d') AS report_date FROM {H} WHERE institutional_holder_id IN (1, 2, 3) GROUP BY report_date HAVING count(DISTINCT institutional_holder_id) = 3""")
def set_common_dates(spark, d):
    """Report dates that all chosen funds share: an intersection as one grouped count."""
    rows = R.where_all(holdings(spark, d, "institutional_holder_id", "report_date"), institutional_holder_id=[1, 2, 3])
    return rows.groupBy("report_date").agg(F.count_distinct("institutional_holder_id").alias("n")).filter("n = 3").select(day("report_date").alias("report_date"))


@query("SELECT common_stock_id FROM common_stock EXCEPT SELECT common_stock_id FROM insider_transaction WHERE transaction_code = 'Purchase'")
def set_except(spark, d):
    bought = table(spark, d, "insider_transaction").filter(F.col("transaction_code") == "Purchase").select("common_stock_id")
    return table(spark, d, "common_stock").select("common_stock_id").distinct().join(bought, "common_stock_id", "left_anti")


@query(f"SELECT 'stock' AS kind, common_stock_id AS id, name FROM common_stock WHERE name ILIKE '%sel%' UNION ALL SELECT 'institution', institutional_holder_id, name FROM institutional_holder WHERE name ILIKE '%sel%'")
def set_search_everything(spark, d):
    """One search over all kinds of entity."""
    stocks = table(spark, d, "common_stock").select(F.lit("stock").alias("kind"), F.col("common_stock_id").alias("id"), "name")
    owners = table(spark, d, "institutional_holder").select(F.lit("institution").alias("kind"), F.col("institutional_holder_id").alias("id"), "name")
    return stocks.unionByName(owners).filter(R.contains_text(F.col("name"), "sel"))
