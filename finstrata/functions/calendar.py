"""Trading sessions and fiscal periods."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def easter(year: int) -> date:
    """Easter Sunday of the Gregorian calendar (anonymous algorithm)."""
    a, b, c = year % 19, year // 100, year % 100
    d, e = b // 4, b % 4
    g = (8 * b + 13) // 25
    h = (19 * a + b - d - g + 15) % 30
    i, k = c // 4, c % 4
    r = (32 + 2 * e + 2 * i - h - k) % 7
    m = (a + 11 * h + 22 * r) // 451
    month, day = divmod(h + r - 7 * m + 114, 31)
    return date(year, month, day + 1)


def _nth(year: int, month: int, weekday: int, n: int) -> date:
    """The n-th such weekday of a month, from its end if n is negative."""
    if n > 0:
        first = date(year, month, 1)
        return first + timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = date(year + month // 12, month % 12 + 1, 1) - timedelta(1)
    return last - timedelta((last.weekday() - weekday) % 7)


def _observed(d: date, saturday: bool = True) -> date | None:
    if d.weekday() == 5:
        return d - timedelta(1) if saturday else None
    return d + timedelta(1) if d.weekday() == 6 else d


def holidays(year: int) -> set[date]:
    """Full-day holidays of the New York exchange by its rules."""
    out = {
        _observed(date(year, 1, 1), saturday=False), _nth(year, 1, 0, 3), _nth(year, 2, 0, 3), easter(year) - timedelta(2),
        _nth(year, 5, 0, -1), _observed(date(year, 7, 4)), _nth(year, 9, 0, 1), _nth(year, 11, 3, 4), _observed(date(year, 12, 25)),
    }
    if year >= 2022:
        out.add(_observed(date(year, 6, 19)))
    return {d for d in out if d}


def sessions(spark: SparkSession, first: int, last: int) -> DataFrame:
    """(session, ordinal) of the trading days of the years first to last; about 252 a year."""
    closed = sorted(d for y in range(first, last + 1) for d in holidays(y))
    days = spark.range(1).select(F.explode(F.sequence(F.lit(date(first, 1, 1)), F.lit(date(last, 12, 31)))).alias("session"))
    open_days = days.filter(F.dayofweek("session").between(2, 6) & ~F.col("session").isin(closed))
    return open_days.withColumn("ordinal", F.row_number().over(Window.orderBy("session")))


def sessions_of(rows: DataFrame, day: str) -> DataFrame:
    """``sessions`` of all years in which ``day`` falls and one more on either side; one pass for the two ends."""
    ends = rows.agg(F.year(F.min(day)), F.year(F.max(day))).first()
    first, last = (ends[0], ends[1]) if ends[0] is not None else (2000, 2000)
    return sessions(rows.sparkSession, first - 1, last + 1)


def shift_sessions(rows: DataFrame, day: str, calendar: DataFrame, n: int, name: str) -> DataFrame:
    """Adds the session n after the last one on or before ``day`` (n may be negative)."""
    w = Window.orderBy("session")
    spans = calendar.select(F.col("session").alias("_from"), F.lead("session").over(w).alias("_to"), F.col("ordinal").alias("_o"))
    by_day = spans.filter("_to is not null").select(F.explode(F.sequence("_from", F.date_sub("_to", 1))).alias(day), "_o")
    target = calendar.select(F.col("session").alias(name), (F.col("ordinal") - n).alias("_o"))
    return rows.join(F.broadcast(by_day), day, "left").join(F.broadcast(target), "_o", "left").drop("_o")


def fiscal_period(day: Column, year_end_month: Column) -> Column:
    """(fiscal_year, fiscal_quarter) of a date for a company whose year ends with that month."""
    months = F.pmod(F.month(day) - year_end_month - 1, F.lit(12))
    year = F.year(day) + F.when(F.month(day) > year_end_month, 1).otherwise(0)
    return F.struct(year.alias("fiscal_year"), (F.floor(months / 3) + 1).cast("int").alias("fiscal_quarter"))


def quarter_end(fiscal_year: Column, quarter: Column, year_end_month: Column) -> Column:
    """Last day of a fiscal quarter."""
    end = F.make_date(fiscal_year, year_end_month, F.lit(1))
    return F.last_day(F.add_months(end, (quarter - 4) * 3))


def span_kind(start: Column, end: Column) -> Column:
    """What a reporting span covers by its days: a year, a quarter, a half, nine months."""
    n = F.date_diff(end, start)
    return (
        F.when(n.between(350, 380), "FY").when(n.between(80, 100), "Q").when(n.between(170, 190), "H1").when(n.between(260, 280), "9M")
    )


def filing_window_open(report: Column, as_of: Column, days: int = 45) -> Column:
    """Whether the deadline of a report's filing is still to come on ``as_of``."""
    return as_of <= F.date_add(report, days)


def settlement_cycle(calendar: DataFrame, disseminated_after: int = 7) -> DataFrame:
    """(settlement, due, published): short-interest settlements of each month and what follows them.

    Settlement is on the last session on or before the 15th and the month's last; reports are due two
    sessions later and published ``disseminated_after`` sessions after they are due.
    """
    half = F.when(F.dayofmonth("session") <= 15, 1).otherwise(2)
    ends = calendar.groupBy(F.trunc("session", "month").alias("_m"), half.alias("_h")).agg(F.max("ordinal").alias("_o"), F.max("session").alias("settlement"))
    at = lambda n, name: calendar.select((F.col("ordinal") - n).alias("_o"), F.col("session").alias(name))
    return ends.join(F.broadcast(at(2, "due")), "_o", "left").join(F.broadcast(at(2 + disseminated_after, "published")), "_o", "left").select("settlement", "due", "published")
