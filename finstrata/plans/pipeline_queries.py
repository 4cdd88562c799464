"""Queries p1 to p4, p6 and p7 over the tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finstrata.core.tables import table
from finstrata.operators import drift, known_at, ledger, shards, spikes, units

GEOGRAPHY = "srt:StatementGeographicalAxis"
SCALE_TOLERANCE, SCALE_MARGIN = 1.5, 0.2


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Share counts and geographic revenue rows as filed by each insider transaction's date."""
    facts = table(spark, d, "shares_fact")
    counts = known_at.known_intervals(
        facts, ["common_stock_id"], "filed", [F.col("as_of"), F.col("filed")], "fact_id"
    ).select("common_stock_id", F.lit("shares").alias("fact_kind"), "fact_id", "from_day", "to_day")
    rows = table(spark, d, "dimensional_revenue_row").filter(F.col("axis") == GEOGRAPHY)
    revenue = known_at.known_intervals(
        rows, ["common_stock_id", "member"], "filed_date", [F.col("period_end"), F.col("filed_date")], "revenue_row_id"
    ).select("common_stock_id", F.lit("revenue").alias("fact_kind"), F.col("revenue_row_id").alias("fact_id"), "from_day", "to_day")
    events = table(spark, d, "insider_transaction").select("transaction_id", "common_stock_id", "transaction_date")  # redelivered ones go at the end
    joined = known_at.join_as_known(
        events, "transaction_date", ["common_stock_id"], counts.unionByName(revenue), ["fact_kind", "fact_id"],
        known_at.day_span((facts, "filed"), (rows, "filed_date")),
    )
    return joined.select("transaction_id", "fact_kind", "fact_id").distinct()


P1_SQL = """
WITH t AS (SELECT DISTINCT transaction_id, common_stock_id, transaction_date FROM insider_transaction WHERE transaction_date IS NOT NULL),
s AS (SELECT t.transaction_id, f.fact_id, row_number() OVER (PARTITION BY t.transaction_id ORDER BY f.as_of DESC NULLS LAST, f.filed DESC, f.fact_id) AS rn
      FROM t JOIN shares_fact f ON f.common_stock_id = t.common_stock_id AND f.filed <= t.transaction_date),
r AS (SELECT t.transaction_id, v.revenue_row_id, row_number() OVER (PARTITION BY t.transaction_id, v.member ORDER BY v.period_end DESC NULLS LAST, v.filed_date DESC, v.revenue_row_id) AS rn
      FROM t JOIN dimensional_revenue_row v ON v.common_stock_id = t.common_stock_id AND v.filed_date <= t.transaction_date
      WHERE v.axis = 'srt:StatementGeographicalAxis' AND v.member IS NOT NULL)
SELECT transaction_id, 'shares' AS fact_kind, fact_id FROM s WHERE rn = 1
UNION SELECT transaction_id, 'revenue' AS fact_kind, revenue_row_id AS fact_id FROM r WHERE rn = 1
"""


def p2_flags(spark: SparkSession, d: str) -> DataFrame:
    """Each suspect bar with its kinds of fault (see ``spikes.flag_bars``)."""
    return spikes.flag_bars(table(spark, d, "daily_stock_price"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_flags(spark, d).select("price_id").distinct()


P2_SQL = """
WITH b AS (SELECT DISTINCT price_id, common_stock_id AS s, listed_ticker AS t, bar_date AS d, CAST(open AS DOUBLE) AS o, CAST(high AS DOUBLE) AS h, CAST(low AS DOUBLE) AS l, CAST(close AS DOUBLE) AS c, volume FROM daily_stock_price),
x AS (SELECT *, (o <= 0 OR h <= 0 OR l <= 0 OR c <= 0 OR h < l OR o > h OR o < l OR c > h OR c < l) AS bad FROM b WHERE volume > 0),
r AS (SELECT *, CASE WHEN c IS DISTINCT FROM lag(c) OVER w THEN 1 ELSE 0 END AS nw FROM x WINDOW w AS (PARTITION BY s, t ORDER BY d, price_id)),
g AS (SELECT *, sum(nw) OVER (PARTITION BY s, t ORDER BY d, price_id) AS run FROM r),
k AS (SELECT price_id, count(*) OVER (PARTITION BY s, t, run) AS n, row_number() OVER (PARTITION BY s, t, run ORDER BY d, price_id) AS i FROM g),
y AS (SELECT *, ln(c) AS y FROM x WHERE NOT bad),
m AS (SELECT *, median(abs(y - p)) OVER (PARTITION BY s, t) AS mv FROM (SELECT *, lag(y) OVER w AS p FROM y WINDOW w AS (PARTITION BY s, t ORDER BY d, price_id))),
a AS (SELECT *, lag(y, 1) OVER w AS b1, lag(y, 2) OVER w AS b2, lag(y, 3) OVER w AS b3, lead(y, 1) OVER w AS f1, lead(y, 2) OVER w AS f2, lead(y, 3) OVER w AS f3 FROM m WINDOW w AS (PARTITION BY s, t ORDER BY d, price_id)),
v AS (SELECT price_id,
 least(abs(y - (b1 + f1) / 2)) > 10 * mv AND abs(f1 - b1) < 0.6 * abs(y - (b1 + f1) / 2) AS m1,
 least(abs(y - (b1 + f2) / 2), abs(f1 - (b1 + f2) / 2)) > 10 * mv AND abs(f2 - b1) < 0.6 * least(abs(y - (b1 + f2) / 2), abs(f1 - (b1 + f2) / 2)) AS m2,
 least(abs(b1 - (b2 + f1) / 2), abs(y - (b2 + f1) / 2)) > 10 * mv AND abs(f1 - b2) < 0.6 * least(abs(b1 - (b2 + f1) / 2), abs(y - (b2 + f1) / 2)) AS n2,
 least(abs(y - (b1 + f3) / 2), abs(f1 - (b1 + f3) / 2), abs(f2 - (b1 + f3) / 2)) > 10 * mv AND abs(f3 - b1) < 0.6 * least(abs(y - (b1 + f3) / 2), abs(f1 - (b1 + f3) / 2), abs(f2 - (b1 + f3) / 2)) AS m3,
 least(abs(b1 - (b2 + f2) / 2), abs(y - (b2 + f2) / 2), abs(f1 - (b2 + f2) / 2)) > 10 * mv AND abs(f2 - b2) < 0.6 * least(abs(b1 - (b2 + f2) / 2), abs(y - (b2 + f2) / 2), abs(f1 - (b2 + f2) / 2)) AS n3,
 least(abs(b2 - (b3 + f1) / 2), abs(b1 - (b3 + f1) / 2), abs(y - (b3 + f1) / 2)) > 10 * mv AND abs(f1 - b3) < 0.6 * least(abs(b2 - (b3 + f1) / 2), abs(b1 - (b3 + f1) / 2), abs(y - (b3 + f1) / 2)) AS o3,
 b1, b2, b3, f1, f2, f3, ln(h) - ln(greatest(o, c)) > 10 * mv AS hi FROM a)
SELECT price_id FROM x WHERE bad UNION SELECT price_id FROM k WHERE n >= 6 AND i > 1
UNION SELECT price_id FROM v WHERE (m1 AND b1 IS NOT NULL AND f1 IS NOT NULL) OR (m2 AND b1 IS NOT NULL AND f2 IS NOT NULL) OR (n2 AND b2 IS NOT NULL AND f1 IS NOT NULL)
 OR (m3 AND b1 IS NOT NULL AND f3 IS NOT NULL) OR (n3 AND b2 IS NOT NULL AND f2 IS NOT NULL) OR (o3 AND b3 IS NOT NULL AND f1 IS NOT NULL) OR hi
"""
_P2_HIT = P2_SQL[P2_SQL.index("FROM v WHERE") + 12 : P2_SQL.rindex("OR hi")]
P2B_SQL = P2_SQL[: P2_SQL.index("SELECT price_id FROM x WHERE bad")] + f"""
SELECT price_id, CAST(sum(f) AS INT) AS flags FROM (SELECT DISTINCT price_id, 1 AS f FROM x WHERE bad UNION SELECT price_id, 2 FROM k WHERE n >= 6 AND i > 1 UNION SELECT price_id, 4 FROM v WHERE {_P2_HIT} UNION SELECT price_id, 8 FROM v WHERE hi) GROUP BY 1
"""


def p3_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Every version of every identifier ever believed, with valid and recorded periods; unknown times are empty."""
    text = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias(c)
    cusips = table(spark, d, "stock_cusip_changed").select(
        "common_stock_id", ledger.clean_cusip(F.col("cusip")).alias("value"),
        ledger.clean_cusip(F.col("previous_cusip")).alias("previous"), "raised_at", "received_at",
    )
    a = ledger.bitemporal_ledger(cusips, "common_stock_id", "value", "previous", "raised_at", "received_at")
    ciks = table(spark, d, "stock_secondary_cik_attached").select(
        "common_stock_id", ledger.clean_cik(F.col("cik")).alias("value"), "raised_at", "received_at"
    ).filter(F.col("common_stock_id").isNotNull()).withColumn("entity", F.concat_ws(":", "common_stock_id", "value"))
    b = ledger.bitemporal_ledger(ciks, "entity", "value", None, "raised_at", "received_at")
    b = b.withColumn("common_stock_id", F.split_part("entity", F.lit(":"), F.lit(1)).cast("bigint")).drop("entity")
    out = a.withColumn("attribute", F.lit("cusip")).unionByName(b.withColumn("attribute", F.lit("cik")))
    return out.select(
        "common_stock_id", "attribute", F.col("value").alias("attribute_value"), text("valid_from"), text("valid_to"), "is_open",
        text("recorded_from"), text("recorded_to"),
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """What is believed now: the ledger's versions whose recorded period is open."""
    return (
        p3_ledger(spark, d).filter(F.col("recorded_to") == "")
        .select("common_stock_id", "attribute", "attribute_value", "valid_from", F.when(F.col("is_open"), F.lit("open")).otherwise(F.col("valid_to")).alias("valid_to"))
        .distinct()
    )


# Every recorded time's view of the messages known by then, folded anew, and runs of views that agree.
P3B_SQL = r"""
WITH raw AS (SELECT 'cusip' AS attribute, common_stock_id AS s, '' AS k, regexp_replace(upper(cusip), '[^A-Z0-9]', '', 'g') AS v, regexp_replace(upper(previous_cusip), '[^A-Z0-9]', '', 'g') AS p, raised_at AS t, received_at AS r FROM stock_cusip_changed
 UNION ALL SELECT 'cik', common_stock_id, c, c, NULL, raised_at, received_at FROM (SELECT *, lpad(ltrim(regexp_replace(cik, '[^0-9]', '', 'g'), '0'), 10, '0') AS c FROM stock_secondary_cik_attached)),
m AS (SELECT attribute, s, k, t, v, max(p) AS p, min(coalesce(r, t)) AS r FROM raw WHERE s IS NOT NULL AND v IS NOT NULL AND t IS NOT NULL GROUP BY 1, 2, 3, 4, 5),
seen AS (SELECT *, lead(told) OVER (PARTITION BY attribute, s, k ORDER BY told) AS next_told, row_number() OVER (PARTITION BY attribute, s, k ORDER BY told) AS n FROM (SELECT DISTINCT attribute, s, k, r AS told FROM m)),
x AS (SELECT m.*, a.told, a.n, a.next_told, lag(v) OVER (PARTITION BY m.attribute, m.s, m.k, a.told ORDER BY t) AS f FROM m JOIN seen a ON a.attribute = m.attribute AND a.s = m.s AND a.k = m.k AND m.r <= a.told),
y AS (SELECT *, lead(t) OVER w AS nt, lead(p) OVER w AS np FROM x WHERE f IS NULL OR f <> v OR p <> f WINDOW w AS (PARTITION BY attribute, s, k, told ORDER BY t)),
o AS (SELECT attribute, s, k, told, n, next_told, v, t AS vf, CASE WHEN np IS NULL OR np = v THEN nt END AS vt, nt IS NULL AS is_open FROM y
 UNION SELECT attribute, s, k, told, n, next_told, p, NULL, t, FALSE FROM y WHERE p IS NOT NULL AND p IS DISTINCT FROM f),
g AS (SELECT *, n - row_number() OVER (PARTITION BY attribute, s, k, v, vf, vt, is_open ORDER BY n) AS island FROM o)
SELECT s AS common_stock_id, attribute, v AS attribute_value, coalesce(strftime(vf, '%Y-%m-%d %H:%M:%S'), '') AS valid_from, coalesce(strftime(vt, '%Y-%m-%d %H:%M:%S'), '') AS valid_to, is_open,
 strftime(min(told), '%Y-%m-%d %H:%M:%S') AS recorded_from, arg_max(coalesce(strftime(next_told, '%Y-%m-%d %H:%M:%S'), ''), n) AS recorded_to
FROM g GROUP BY attribute, s, k, v, vf, vt, is_open, island
"""
P3_SQL = r"""
WITH m AS (SELECT common_stock_id, raised_at, max(regexp_replace(upper(cusip), '[^A-Z0-9]', '', 'g')) AS v,
                  max(regexp_replace(upper(previous_cusip), '[^A-Z0-9]', '', 'g')) AS p
           FROM stock_cusip_changed WHERE cusip IS NOT NULL AND raised_at IS NOT NULL AND common_stock_id IS NOT NULL GROUP BY 1, 2),
c AS (SELECT * FROM (SELECT *, lag(v) OVER (PARTITION BY common_stock_id ORDER BY raised_at) AS f FROM m) WHERE f IS NULL OR f <> v OR p <> f),
n AS (SELECT *, lead(raised_at) OVER w AS nxt, lead(p) OVER w AS np FROM c WINDOW w AS (PARTITION BY common_stock_id ORDER BY raised_at))
SELECT common_stock_id, 'cusip' AS attribute, v AS attribute_value, strftime(raised_at, '%Y-%m-%d %H:%M:%S') AS valid_from,
       CASE WHEN nxt IS NULL THEN 'open' WHEN np IS NULL OR np = v THEN strftime(nxt, '%Y-%m-%d %H:%M:%S') ELSE '' END AS valid_to FROM n
UNION SELECT common_stock_id, 'cusip', p, '', strftime(raised_at, '%Y-%m-%d %H:%M:%S') FROM n WHERE p IS NOT NULL AND p IS DISTINCT FROM f
UNION SELECT common_stock_id, 'cik', lpad(ltrim(regexp_replace(cik, '[^0-9]', '', 'g'), '0'), 10, '0') AS k,
       strftime(min(raised_at), '%Y-%m-%d %H:%M:%S'), 'open' FROM stock_secondary_cik_attached
WHERE cik IS NOT NULL AND common_stock_id IS NOT NULL AND raised_at IS NOT NULL GROUP BY common_stock_id, k
"""


def p4_solutions(spark: SparkSession, d: str) -> DataFrame:
    """Filed values with the scale that the identity filed_value * scale = derived_value gives.

    A filed value may besides be off by a split ratio or a stale mark, so the residual may be up to half
    the step between scales; where a second scale is nearly as good, neither is taken.
    """
    rows = table(spark, d, "value_basis_disagreement").select("disagreement_id", "filed_value", "derived_value")
    solved = units.solve_units(rows, "filed_value", F.col("derived_value"), [1, 1_000, 1_000_000, 1_000_000_000], SCALE_TOLERANCE, SCALE_MARGIN)
    return solved.select("disagreement_id", F.col("filed_value").cast("double").alias("filed_value"), F.round("residual", 6).alias("residual"), "solutions", "factor")


P4B_SQL = """
WITH r AS (SELECT disagreement_id, filed_value, f, CASE WHEN filed_value > 0 AND derived_value > 0 THEN abs(log10(CAST(filed_value AS DOUBLE) * f / CAST(derived_value AS DOUBLE))) END AS res FROM value_basis_disagreement, (VALUES (1), (1000), (1000000), (1000000000)) AS z(f)),
b AS (SELECT disagreement_id, filed_value, min(res) AS best, arg_min(f, res) AS f FROM r GROUP BY 1, 2),
n AS (SELECT r.disagreement_id, count(*) FILTER (WHERE res < best + 0.2) AS n FROM r JOIN b USING (disagreement_id) GROUP BY 1)
SELECT disagreement_id, CAST(b.filed_value AS DOUBLE) AS filed_value, round(best, 6) AS residual, CAST(CASE WHEN best < 1.5 THEN n ELSE 0 END AS INT) AS solutions, CAST(CASE WHEN best < 1.5 AND n = 1 THEN f END AS BIGINT) AS factor FROM b JOIN n USING (disagreement_id)
"""


def p4_scale_by_series(spark: SparkSession, d: str) -> DataFrame:
    """Revenue rows against their member's other years: the scale the text names, and the one that ties them.

    amount = value * rate * scale should be the member's usual amount, the median of all its rows as
    the text reads them. Rows whose own text disagrees, and those that more than one scale fits, are told.
    """
    rates = units.rate_periods(table(spark, d, "fred_observation"), "currency", "obs_date", "value")
    rows = table(spark, d, "dimensional_revenue_row").select(
        "revenue_row_id", "common_stock_id", "axis", "member", "period_end", "value", "unit", "caption"
    ).dropDuplicates(["revenue_row_id"])
    named = units.named_units(rows, F.col("unit"), F.col("caption")).filter(F.col("currency").isNotNull() & (F.col("value") != 0))
    until = rows.agg(F.max("period_end")).first()[0]
    money = units.at_rates(named.withColumnRenamed("scale", "said"), "period_end", rates, until).withColumn("unscaled", F.abs("value").cast("double") * F.col("fx_rate").cast("double"))
    keys = ["common_stock_id", "axis", "member"]
    usual = money.groupBy(*keys).agg(F.median(F.log10(F.col("unscaled") * F.col("said"))).alias("usual"), F.count("*").alias("rows"))
    tied = money.join(usual, keys).filter(F.col("rows") >= 3).withColumn("level", F.pow(F.lit(10.0), F.col("usual")))
    solved = units.solve_units(tied, "unscaled", F.col("level"), [1, 1_000, 1_000_000, 1_000_000_000], SCALE_TOLERANCE, SCALE_MARGIN)
    return solved.select("revenue_row_id", "said", F.round("residual", 4).alias("residual"), "solutions", "factor", (F.col("factor") == F.col("said")).alias("agrees"))


def usd_revenue(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """All revenue rows of money with ``currency``, ``scale`` and ``amount_usd``, beside the columns asked for."""
    rates = units.rate_periods(table(spark, d, "fred_observation"), "currency", "obs_date", "value")
    rows = table(spark, d, "dimensional_revenue_row").select(*dict.fromkeys(["revenue_row_id", "period_end", "value", "unit", "caption", *columns]))
    named = units.named_units(rows, F.col("unit"), F.col("caption")).filter(F.col("currency").isNotNull() & F.col("value").isNotNull())
    until = rows.agg(F.max("period_end")).first()[0]
    return units.to_whole_usd(named, "value", "period_end", rates, until)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    other = usd_revenue(spark, d).filter(~((F.col("currency") == "USD") & (F.col("scale") == 1)))
    revenue = other.select(F.lit("revenue").alias("record_kind"), F.col("revenue_row_id").alias("record_id"), "amount_usd")
    solved = p4_solutions(spark, d).filter(F.col("factor").isin(1_000, 1_000_000))
    holding = solved.select(
        F.lit("holding").alias("record_kind"), F.col("disagreement_id").alias("record_id"),
        F.round(F.col("filed_value") * F.col("factor").cast("decimal(10,0)"), 0).cast("bigint").alias("amount_usd"),
    )
    return revenue.filter(F.col("amount_usd").isNotNull()).unionByName(holding).distinct()


# Currency and scale as P4_SQL reads them; each row's scale is then judged by its member's median amount.
P4C_SQL = """
amounts AS (SELECT DISTINCT revenue_row_id, f, CAST(abs(value) AS DOUBLE) * CAST(rate AS DOUBLE) AS u FROM (SELECT j.*, CASE WHEN code = 'USD' THEN 1 ELSE o.value END AS rate
  FROM j ASOF LEFT JOIN (SELECT currency, obs_date, value FROM fred_observation WHERE value IS NOT NULL) o ON o.currency = j.code AND j.period_end >= o.obs_date) WHERE code IS NOT NULL AND value <> 0 AND rate IS NOT NULL),
t AS (SELECT a.*, median(log10(u * f)) OVER w AS usual, count(*) OVER w AS n FROM amounts a JOIN (SELECT DISTINCT revenue_row_id, common_stock_id, axis, member FROM dimensional_revenue_row) d USING (revenue_row_id)
  WHERE common_stock_id IS NOT NULL AND axis IS NOT NULL AND member IS NOT NULL WINDOW w AS (PARTITION BY common_stock_id, axis, member)),
e AS (SELECT revenue_row_id, f AS said, z.g, abs(log10(u * z.g) - usual) AS res FROM t, (VALUES (1), (1000), (1000000), (1000000000)) AS z(g) WHERE n >= 3),
b AS (SELECT revenue_row_id, said, min(res) AS best, arg_min(g, res) AS g FROM e GROUP BY 1, 2),
q AS (SELECT b.*, (SELECT count(*) FROM e WHERE e.revenue_row_id = b.revenue_row_id AND e.res < b.best + 0.2) AS n FROM b)
SELECT revenue_row_id, CAST(said AS BIGINT) AS said, round(best, 4) AS residual, CAST(CASE WHEN best < 1.5 THEN n ELSE 0 END AS INT) AS solutions, CAST(CASE WHEN best < 1.5 AND n = 1 THEN g END AS BIGINT) AS factor,
 CASE WHEN best < 1.5 AND n = 1 THEN g = said END AS agrees FROM q
"""
_CUR = """(VALUES ('usd','USD'),('us$','USD'),('$','USD'),('us dollars','USD'),('eur','EUR'),('€','EUR'),('euros','EUR'),('gbp','GBP'),('£','GBP'),('pounds sterling','GBP'),('jpy','JPY'),('¥','JPY'),('japanese yen','JPY'),
('cad','CAD'),('c$','CAD'),('canadian dollars','CAD'),('chf','CHF'),('sfr.','CHF'),('swiss francs','CHF'),('sek','SEK'),('swedish kronor','SEK'),('brl','BRL'),('r$','BRL'),('brazilian reais','BRL')) AS cur(t, code)"""
_SIZE = """(VALUES ('thousands',1000),('thds.',1000),('000s',1000),(chr(39) || '000',1000),(chr(39) || '000s',1000),('k',1000),('million',1000000),('millions',1000000),('mn',1000000),('mil.',1000000),('mio.',1000000),('m',1000000),
('billion',1000000000),('billions',1000000000),('bn',1000000000)) AS size(w, f)"""
P4_SQL = f"""
WITH cur AS (SELECT * FROM {_CUR}), size AS (SELECT * FROM {_SIZE}),
spelt AS (SELECT t AS u, code, CAST(NULL AS BIGINT) AS f FROM cur UNION SELECT t || sep || w, code, f FROM cur, size, (VALUES (''), (' ')) AS s(sep)
 UNION SELECT p || t, code, f FROM cur, (VALUES ('k', 1000), ('t', 1000), ('m', 1000000)) AS z(p, f) UNION SELECT w || ' of ' || t, code, f FROM cur, size),
tails AS (SELECT ', in ' || t AS tail, code, CAST(NULL AS BIGINT) AS f FROM cur UNION SELECT ', ' || w || ' of ' || t, code, f FROM cur, size UNION SELECT ' in ' || t || ' ' || w, code, f FROM cur, size UNION SELECT '(' || t || ' ' || w || ')', code, f FROM cur, size
 UNION SELECT p || w || q, NULL, f FROM size, (VALUES ('(in ', ')'), ('(', ')'), (' in ', ''), ('- amounts in ', ''), ('- figures stated in ', ''), ('- expressed in ', ''), ('(', ', unaudited)'), ('(', ', except per share data)')) AS z(p, q)),
r AS (SELECT DISTINCT revenue_row_id, period_end, value, regexp_replace(lower(trim(coalesce(unit, ''))), '^iso4217:', '') AS u, lower(trim(coalesce(caption, ''))) AS c FROM dimensional_revenue_row),
c AS (SELECT c, arg_max(code, length(tail)) AS code, arg_max(coalesce(f, 0), length(tail)) AS f FROM (SELECT DISTINCT c FROM r) JOIN tails ON ends_with(c, tail) GROUP BY c),
j AS (SELECT r.*, CASE WHEN r.u = '' OR s.u IS NOT NULL THEN coalesce(s.code, c.code) END AS code, coalesce(s.f, nullif(c.f, 0), 1) AS f FROM r LEFT JOIN spelt s ON s.u = r.u LEFT JOIN c ON c.c = r.c),
k AS (SELECT * FROM j WHERE code IS NOT NULL AND value IS NOT NULL AND NOT (code = 'USD' AND f = 1)),
x AS (SELECT k.*, CASE WHEN code = 'USD' THEN 1 ELSE o.value END AS rate FROM k ASOF LEFT JOIN (SELECT currency, obs_date, value FROM fred_observation WHERE value IS NOT NULL) o ON o.currency = k.code AND k.period_end >= o.obs_date)
SELECT 'revenue' AS record_kind, revenue_row_id AS record_id, CAST(round(CAST(value * f AS DECIMAL(26,4)) * CAST(rate AS DECIMAL(12,6)), 0) AS BIGINT) AS amount_usd FROM x WHERE rate IS NOT NULL
UNION SELECT 'holding', disagreement_id, CAST(round(filed_value * CASE WHEN lr < 4.5 THEN 1000 ELSE 1000000 END, 0) AS BIGINT) FROM (SELECT disagreement_id, filed_value, log10(CAST(derived_value AS DOUBLE) / CAST(filed_value AS DOUBLE)) AS lr FROM value_basis_disagreement WHERE filed_value > 0 AND derived_value > 0)
WHERE abs(lr - 3) < 1.4 OR abs(lr - 6) < 1.4
"""

P4C_SQL = P4_SQL[: P4_SQL.index("k AS (SELECT")] + P4C_SQL.lstrip()
#: All revenue rows of money in whole US dollars, as a relation.
USD_REVENUE = "(" + P4_SQL[: P4_SQL.index("SELECT 'revenue' AS record_kind")].strip().replace(" AND NOT (code = 'USD' AND f = 1)", "") + """
SELECT DISTINCT d.revenue_row_id, d.common_stock_id, d.axis, d.member, d.period_start, d.period_end, CAST(round(CAST(x.value * x.f AS DECIMAL(26,4)) * CAST(x.rate AS DECIMAL(12,6)), 0) AS BIGINT) AS v, d.filed_date, d.fiscal_year
FROM x JOIN dimensional_revenue_row d USING (revenue_row_id) WHERE x.rate IS NOT NULL)"""


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The three largest holdings of each stock and report date."""
    rows = table(spark, d, "institutional_holding")
    best = shards.top_rows(rows, ["common_stock_id", "report_date"], "shares", "holding_id", 3, ["common_stock_id"])
    return best.select("common_stock_id", F.date_format("report_date", "yyyy-MM-dd").alias("report_date"), "holding_id")


P6_SQL = """
SELECT common_stock_id, report_date, holding_id FROM (
  SELECT common_stock_id, strftime(report_date, '%Y-%m-%d') AS report_date, holding_id,
         row_number() OVER (PARTITION BY common_stock_id, report_date ORDER BY shares DESC NULLS LAST, holding_id) AS rn
  FROM (SELECT DISTINCT common_stock_id, report_date, holding_id, shares FROM institutional_holding
        WHERE common_stock_id IS NOT NULL AND report_date IS NOT NULL AND holding_id IS NOT NULL))
WHERE rn <= 3
"""


def p6_share_of_class(spark: SparkSession, d: str) -> DataFrame:
    """Shares held per stock and report date against shares outstanding, by a sharded join."""
    rows = table(spark, d, "institutional_holding").select("common_stock_id", "report_date", "holding_id", "shares").filter(
        F.col("common_stock_id").isNotNull() & F.col("report_date").isNotNull()
    )
    stocks = table(spark, d, "common_stock").select("common_stock_id", "ticker", "shares_out_standing")
    plan = shards.plan_shards(rows, ["common_stock_id"])
    joined = shards.join_sharded(rows.distinct(), stocks, plan, F.col("holding_id"))
    return joined.groupBy("common_stock_id", F.date_format("report_date", "yyyy-MM-dd").alias("report_date")).agg(
        F.first("ticker").alias("ticker"), F.count("*").alias("holdings"), F.sum("shares").alias("shares_held"),
        F.first("shares_out_standing").alias("shares_outstanding"),
    )


P6B_SQL = """
SELECT h.common_stock_id, strftime(h.report_date, '%Y-%m-%d') AS report_date, any_value(s.ticker) AS ticker, count(*) AS holdings,
       CAST(sum(h.shares) AS BIGINT) AS shares_held, any_value(s.shares_out_standing) AS shares_outstanding
FROM (SELECT DISTINCT common_stock_id, report_date, holding_id, shares FROM institutional_holding WHERE report_date IS NOT NULL) h
JOIN common_stock s ON s.common_stock_id = h.common_stock_id GROUP BY 1, 2
"""


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    changes = drift.layout_changes(table(spark, d, "othermanager_archive_file"), table(spark, d, "othermanager_archive_line"))
    return changes.select("file_id", "field_name", "change_kind").distinct()


# The headings of each field, written out here again so that the SQL is a witness of its own.
_FIELD = """CASE WHEN h IN ('accessionnumber', 'accn', 'filingaccession', 'submissionref') THEN 'accession_number' WHEN h IN ('sequencenumber', 'seqno', 'mgrordinal', 'othermanagersk') THEN 'sequence_number'
 WHEN h IN ('name', 'firm', 'managername', 'othermanager') THEN 'name' WHEN h IN ('cik', 'filercik', 'centralindexkey', 'registrantkey') THEN 'cik'
 WHEN h IN ('form13ffilenumber', 'form13ffileno', 'fileno028', 'thirteenfnr') THEN 'form13f_file_number' WHEN h IN ('crdnumber', 'crd', 'iardcrd', 'advisercrdno') THEN 'crd_number'
 WHEN h IN ('secfilenumber', 'secno801', 'advfileno', 'adviserfile') THEN 'sec_file_number' WHEN h IN ('stateorcountry', 'statectry', 'domicile') THEN 'state_or_country'
 WHEN h IN ('filingdate', 'datefiled', 'filedon') THEN 'filing_date' END"""
P7_SQL = f"""
WITH h AS (SELECT file_id, unnest(string_split(header_line, chr(9))) AS raw, generate_subscripts(string_split(header_line, chr(9)), 1) AS pos FROM othermanager_archive_file),
n AS (SELECT file_id, pos, regexp_replace(lower(raw), '[^a-z0-9]', '', 'g') AS h FROM h), f AS (SELECT file_id, pos, h, {_FIELD} AS field FROM n),
c AS (SELECT file_id, trim(unnest(string_split(raw_line, chr(9)))) AS cell, generate_subscripts(string_split(raw_line, chr(9)), 1) AS pos FROM othermanager_archive_line),
t AS (SELECT file_id, pos, CASE WHEN bool_and(regexp_full_match(cell, '0|[1-9][0-9]*')) THEN 'integer' WHEN bool_and(regexp_full_match(cell, '[0-9]+[.][0-9]+')) THEN 'decimal' ELSE 'text' END AS type FROM c WHERE cell <> '' GROUP BY 1, 2),
l AS (SELECT f.file_id, f.field, f.h, t.type FROM f LEFT JOIN t USING (file_id, pos) WHERE field IS NOT NULL),
p AS (SELECT file_id, lag(file_id) OVER (PARTITION BY feed_id ORDER BY published_on, file_id) AS prev FROM othermanager_archive_file),
d AS (SELECT p.file_id, b.field, a.h AS ah, a.type AS aty, b.h AS bh, b.type AS bty FROM p JOIN l b ON b.file_id = p.file_id LEFT JOIN l a ON a.file_id = p.prev AND a.field = b.field WHERE prev IS NOT NULL
 UNION SELECT p.file_id, a.field, a.h, a.type, b.h, b.type FROM p JOIN l a ON a.file_id = p.prev LEFT JOIN l b ON b.file_id = p.file_id AND a.field = b.field WHERE prev IS NOT NULL)
SELECT file_id, field AS field_name, 'added' AS change_kind FROM d WHERE ah IS NULL UNION SELECT file_id, field, 'removed' FROM d WHERE bh IS NULL
UNION SELECT file_id, field, 'renamed' FROM d WHERE ah <> bh UNION SELECT file_id, field, 'retyped' FROM d WHERE aty <> bty
"""


def p7_table(spark: SparkSession, d: str) -> DataFrame:
    """All archived lines in the union schema."""
    return drift.unified_table(table(spark, d, "othermanager_archive_file"), table(spark, d, "othermanager_archive_line"))


def p7_table_text(spark: SparkSession, d: str) -> DataFrame:
    """All archived lines with their cells as written."""
    files, lines = table(spark, d, "othermanager_archive_file"), table(spark, d, "othermanager_archive_line")
    return drift.unified_table(files, lines, {f: "text" for f in drift.NAMES})


def p7_union_types(spark: SparkSession, d: str) -> DataFrame:
    """Each field's type in the union schema."""
    placed = drift.placed_columns(table(spark, d, "othermanager_archive_file"), table(spark, d, "othermanager_archive_line"))
    return spark.createDataFrame(list(drift.union_types(placed).items()), "field_name string, type string")


P7B_SQL = P7_SQL[: P7_SQL.index("t AS (SELECT")].replace("c AS (SELECT file_id, trim", "c AS (SELECT file_id, line_no, trim") + "SELECT file_id, line_no, " + ", ".join(
    f"max(CASE WHEN field = '{f}' THEN cell END) AS {f}" for f in drift.NAMES
) + " FROM c JOIN f USING (file_id, pos) WHERE cell <> '' AND field IS NOT NULL GROUP BY 1, 2"
P7C_SQL = P7_SQL[: P7_SQL.index("p AS (SELECT")].rstrip().rstrip(",") + """
SELECT field AS field_name, CASE WHEN bool_or(type = 'text') THEN 'text' WHEN bool_or(type = 'decimal') THEN 'decimal' WHEN bool_or(type = 'integer') THEN 'integer' ELSE 'text' END AS type FROM l GROUP BY 1"""


QUERIES = {
    "p1_found": p1_found, "p2_found": p2_found, "p2_flags": p2_flags, "p3_found": p3_found, "p3_ledger": p3_ledger,
    "p4_found": p4_found, "p4_solutions": p4_solutions, "p4_scale_by_series": p4_scale_by_series, "p6_found": p6_found, "p6_share_of_class": p6_share_of_class,
    "p7_found": p7_found, "p7_table": p7_table, "p7_table_text": p7_table_text, "p7_union_types": p7_union_types,
}
ORACLES = {"p1_found": P1_SQL, "p2_found": P2_SQL, "p2_flags": P2B_SQL, "p4_found": P4_SQL, "p7_found": P7_SQL, "p7_table_text": P7B_SQL, "p7_union_types": P7C_SQL, "p4_solutions": P4B_SQL, "p4_scale_by_series": P4C_SQL, "p3_found": P3_SQL, "p3_ledger": P3B_SQL, "p6_found": P6_SQL, "p6_share_of_class": P6B_SQL}
