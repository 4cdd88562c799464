"""Domain relations over the test tables, and the same as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finstrata.core.tables import table
from finstrata.operators import series

CURRENT, PREVIOUS = "2024-12-31", "2024-09-30"


def holdings(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """13F holdings, each once although some are delivered again; only the columns asked for."""
    rows = table(spark, d, "institutional_holding").filter(F.col("filing_type") == "Form13F")
    return rows.select("holding_id", *columns).distinct()


HOLDINGS = """(SELECT DISTINCT holding_id, institutional_holder_id, common_stock_id, filing_date, report_date, value, filed_value, shares,
 share_type, option_type, filing_type, cusip, listed_ticker, accession_number, is_amendment, value_pending
 FROM institutional_holding WHERE filing_type = 'Form13F')"""


def bars(spark: SparkSession, d: str) -> DataFrame:
    """Traded bars by stock and date in ten-thousandths; rows with impossible prices left out."""
    p = table(spark, d, "daily_stock_price").select(
        "price_id", "common_stock_id", "bar_date", *[series.units(c).alias(c) for c in ("open", "high", "low", "close")], "volume"
    )
    sane = (F.least("open", "high", "low", "close") > 0) & (F.col("high") >= F.greatest("open", "close", "low")) & (F.col("low") <= F.least("open", "close"))
    return p.filter(sane & (F.col("volume") > 0)).distinct().drop("price_id")


BARS = """(SELECT common_stock_id, bar_date, open, high, low, close, volume FROM (
 SELECT DISTINCT price_id, common_stock_id, bar_date, CAST(open * 10000 AS BIGINT) AS open, CAST(high * 10000 AS BIGINT) AS high,
  CAST(low * 10000 AS BIGINT) AS low, CAST(close * 10000 AS BIGINT) AS close, volume FROM daily_stock_price)
 WHERE least(open, high, low, close) > 0 AND high >= greatest(open, close, low) AND low <= least(open, close) AND volume > 0)"""


def half_even_sql(total: str, n: str) -> str:
    """total / n rounded half to even over whole numbers, as ``series.half_even``."""
    r = f"(((({total}) % ({n})) + ({n})) % ({n}))"
    q = f"((({total}) - {r}) // ({n}))"
    return f"({q} + CASE WHEN 2 * {r} > ({n}) OR (2 * {r} = ({n}) AND abs({q}) % 2 = 1) THEN 1 ELSE 0 END)"


def day(c):
    return F.date_format(c, "yyyy-MM-dd")
