"""Queries over deliveries, corrections, snapshots and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from finstrata.core.tables import checkpoint_dir, table
from finstrata.plans.views import HOLDINGS, day, holdings
from finstrata.sources import sinks
from finstrata.streaming import incremental as I

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _folder(spark: SparkSession, what: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


@query("SELECT holding_id, strftime(min(creation_time), '%Y-%m-%d %H:%M:%S') AS first_seen, count(*) AS deliveries FROM institutional_holding GROUP BY 1")
def inc_delivery_ledger(spark, d):
    """Each row once with its first delivery: a keyed minimum, combined map-side."""
    rows = table(spark, d, "institutional_holding")
    return rows.groupBy("holding_id").agg(F.date_format(F.min("creation_time"), "yyyy-MM-dd HH:mm:ss").alias("first_seen"), F.count("*").alias("deliveries"))


_F = f"(SELECT institutional_holder_id, report_date, accession_number, filing_date, bool_or(is_amendment) AS amended, count(*) AS n FROM {HOLDINGS} GROUP BY 1, 2, 3, 4)"


@query(f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY institutional_holder_id, report_date ORDER BY filing_date, accession_number) AS k FROM {_F}),
l AS (SELECT *, coalesce(max(CASE WHEN NOT amended THEN k END) OVER (PARTITION BY institutional_holder_id, report_date), 0) AS last FROM f)
SELECT institutional_holder_id, strftime(report_date, '%Y-%m-%d') AS report_date, accession_number, n AS rows_n FROM l WHERE k >= last""")
def inc_settled_submissions(spark, d):
    """The filings that stand for each filer and period; amendments add to the last original."""
    f = holdings(spark, d, "institutional_holder_id", "report_date", "accession_number", "filing_date", "is_amendment").groupBy(
        "institutional_holder_id", "report_date", "accession_number", "filing_date"
    ).agg(F.bool_or("is_amendment").alias("amended"), F.count("*").alias("rows_n"))
    kept = I.settle_submissions(f, ["institutional_holder_id", "report_date"], ["filing_date", "accession_number"], ~F.col("amended"))
    return kept.select("institutional_holder_id", day("report_date").alias("report_date"), "accession_number", "rows_n")


@query(f"SELECT institutional_holder_id, strftime(report_date, '%Y-%m-%d') AS report_date, CAST(sum(value) AS BIGINT) AS value, count(*) AS positions FROM {HOLDINGS} WHERE report_date >= DATE '2024-06-30' GROUP BY 1, 2")
def inc_snapshot_refresh(spark, d):
    """A snapshot by report date whose partitions from one date on are dirty: only those are rebuilt."""
    base = holdings(spark, d, "institutional_holder_id", "report_date", "value")
    path = _folder(spark, "snapshot")

    def build(rows):
        return rows.groupBy("institutional_holder_id", "report_date").agg(F.sum("value").alias("value"), F.count("*").alias("positions"))

    dirty = I.dirty_partitions(base.filter(F.col("report_date") >= F.lit("2024-06-30").cast("date")), "report_date")
    I.refresh(base, dirty, "report_date", build, path)
    return spark.read.parquet(path).select("institutional_holder_id", day(F.col("report_date").cast("date")).alias("report_date"), "value", "positions")


@query("""WITH o AS (SELECT common_stock_id, arg_max(shares, (as_of, -fact_id)) AS shares FROM shares_fact WHERE as_of < DATE '2024-01-01' GROUP BY 1), n AS (SELECT common_stock_id, arg_max(shares, (as_of, -fact_id)) AS shares FROM shares_fact WHERE as_of >= DATE '2024-01-01' GROUP BY 1)
SELECT coalesce(o.common_stock_id, n.common_stock_id) AS common_stock_id, coalesce(n.shares, o.shares) AS shares FROM o FULL JOIN n ON o.common_stock_id = n.common_stock_id""")
def inc_upsert(spark, d):
    """Share counts up to 2023 upserted with those of 2024."""
    f = table(spark, d, "shares_fact").filter(F.col("as_of").isNotNull())
    side = lambda when: f.filter(when).groupBy("common_stock_id").agg(F.max_by("shares", F.struct("as_of", -F.col("fact_id"))).alias("shares"))
    cut = F.col("as_of") < F.lit("2024-01-01").cast("date")
    return sinks.upsert(side(cut), side(~cut), ["common_stock_id"])


@query("""SELECT common_stock_id, count(*) AS n FROM (SELECT DISTINCT transaction_id, common_stock_id FROM insider_transaction WHERE NOT coalesce(transaction_code = 'Gift', false)) GROUP BY 1""")
def inc_delete_where(spark, d):
    rows = sinks.delete_where(table(spark, d, "insider_transaction"), F.col("transaction_code") == "Gift")
    return rows.groupBy("common_stock_id").agg(F.count_distinct("transaction_id").alias("n"))


@query("""SELECT event_type, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""")
def inc_stream_windows(spark, d):
    """Events through a structured stream that lets each in once, then daily windows of what came in."""
    source, sink, state = (_folder(spark, x) for x in ("events", "windows", "state"))
    table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(source)
    stream = I.once(I.stream_table(spark, source), ["event_id"], "ts", "40 days")
    I.run_to_end(stream, sink, state)
    got = spark.read.parquet(sink)
    g = got.groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return g.select("event_type", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n", "total")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM n GROUP BY user_id, k""")
def inc_sessions(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return I.sessions(e, ["user_id"], "ts", "6 hours").select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")


@query(f"""WITH p AS (SELECT DISTINCT holding_id, common_stock_id, report_date, shares, filed_value FROM {HOLDINGS} WHERE value_pending),
c AS (SELECT common_stock_id, bar_date, max(CAST(close AS DECIMAL(18,4))) AS p FROM daily_stock_price WHERE close > 0 GROUP BY 1, 2)
SELECT holding_id, CAST(coalesce(round(shares * c.p), filed_value) AS BIGINT) AS value, CASE WHEN c.p IS NOT NULL THEN 'derived' WHEN filed_value IS NOT NULL THEN 'filed' ELSE 'unavailable' END AS state FROM p LEFT JOIN c ON c.common_stock_id = p.common_stock_id AND c.bar_date = p.report_date""")
def inc_reprice_pending(spark, d):
    """Pending values priced from the close of their date, else filed value, else unavailable."""
    p = holdings(spark, d, "common_stock_id", "report_date", "shares", "filed_value", "value_pending").filter("value_pending").withColumn("tries", F.lit(2))
    px = table(spark, d, "daily_stock_price").filter(F.col("close") > 0).select("common_stock_id", F.col("bar_date").alias("report_date"), "close")
    return I.reprice(p, px, ["common_stock_id", "report_date"], "close", "shares", "filed_value", "tries", 3).select("holding_id", "value", "state")


@query("""SELECT common_stock_id, CAST(sum(v) AS BIGINT) AS volume, string_agg(DISTINCT t, ',' ORDER BY t) AS tickers FROM (SELECT DISTINCT price_id, common_stock_id, volume AS v, listed_ticker AS t FROM daily_stock_price) GROUP BY 1""")
def ing_merge_volumes(spark, d):
    """Volumes added up and the markets' codes merged in order."""
    rows = table(spark, d, "daily_stock_price").select("price_id", "common_stock_id", "volume", "listed_ticker").distinct()
    return rows.groupBy("common_stock_id").agg(F.sum("volume").alias("volume"), F.array_join(F.array_sort(F.collect_set("listed_ticker")), ",").alias("tickers"))


@query("""SELECT name_key, min(institutional_holder_id) AS institutional_holder_id FROM (SELECT DISTINCT lower(split_part(trim(name), ' ', 1)) AS name_key, institutional_holder_id FROM institutional_holder) GROUP BY 1 HAVING count(*) = 1""")
def ing_unambiguous_parent(spark, d):
    """Keys that one candidate alone bears."""
    rows = table(spark, d, "institutional_holder").select(F.lower(F.split_part(F.trim("name"), F.lit(" "), F.lit(1))).alias("name_key"), "institutional_holder_id").distinct()
    return rows.groupBy("name_key").agg(F.min("institutional_holder_id").alias("institutional_holder_id"), F.count("*").alias("n")).filter("n = 1").drop("n")


@query("""SELECT price_id FROM (SELECT DISTINCT price_id, open, high, low, close FROM daily_stock_price) WHERE open <= 0 OR high <= 0 OR low <= 0 OR close <= 0 OR high < low OR open > high OR open < low OR close > high OR close < low""")
def ing_invalid_bars(spark, d):
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    bad = (F.least(o, h, lo, c) <= 0) | (h < lo) | (o > h) | (o < lo) | (c > h) | (c < lo)
    return table(spark, d, "daily_stock_price").filter(bad).select("price_id").distinct()


@query(f"""SELECT institutional_holder_id, accession_number, strftime(filing_date, '%Y-%m-%d') AS filing_date FROM (SELECT *, row_number() OVER (PARTITION BY institutional_holder_id ORDER BY filing_date DESC, accession_number DESC) AS rn FROM (SELECT DISTINCT institutional_holder_id, accession_number, filing_date FROM {HOLDINGS})) WHERE rn = 1""")
def ing_latest_submission(spark, d):
    rows = holdings(spark, d, "institutional_holder_id", "accession_number", "filing_date")
    best = rows.groupBy("institutional_holder_id").agg(F.max(F.struct("filing_date", "accession_number")).alias("m"))
    return best.select("institutional_holder_id", F.col("m.accession_number").alias("accession_number"), day("m.filing_date").alias("filing_date"))


@query(f"""WITH k AS (SELECT DISTINCT common_stock_id, report_date FROM {HOLDINGS} WHERE value_pending) SELECT k.common_stock_id, strftime(k.report_date, '%Y-%m-%d') AS report_date, CAST(max(p.close) AS DOUBLE) AS close FROM k LEFT JOIN daily_stock_price p ON p.common_stock_id = k.common_stock_id AND p.bar_date = k.report_date GROUP BY 1, 2""")
def ing_price_requests(spark, d):
    """Distinct keys that want a price, looked up by an equi-join instead of a cross product."""
    k = holdings(spark, d, "common_stock_id", "report_date", "value_pending").filter("value_pending").select("common_stock_id", "report_date").distinct()
    px = table(spark, d, "daily_stock_price").groupBy("common_stock_id", F.col("bar_date").alias("report_date")).agg(F.max("close").alias("close"))
    return k.join(px, ["common_stock_id", "report_date"], "left").select("common_stock_id", day("report_date").alias("report_date"), F.col("close").cast("double").alias("close"))
