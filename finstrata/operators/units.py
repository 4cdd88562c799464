"""Quantities recorded in different units, brought to whole US dollars.

Two sources of evidence. Text: a unit column or, failing that, a caption names currency and
scale. Identity: where columns are tied by a known relation (value = shares * price, mass =
density * volume), the unit combination whose log residual is least is the one recorded; a
combination must leave a residual below ``tolerance``, and a second one as good makes the
solution non-unique, which is flagged and never converted.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How currencies are written, in lower case. A bare dollar sign is of US dollars.
CURRENCIES = {
    "USD": ["usd", "us$", "$", "us dollar", "us dollars", "u.s. dollars"],
    "EUR": ["eur", "€", "euro", "euros"],
    "GBP": ["gbp", "£", "pound sterling", "pounds sterling"],
    "JPY": ["jpy", "¥", "yen", "japanese yen"],
    "CAD": ["cad", "c$", "canadian dollar", "canadian dollars"],
    "CHF": ["chf", "sfr.", "sfr", "swiss franc", "swiss francs"],
    "SEK": ["sek", "swedish krona", "swedish kronor"],
    "BRL": ["brl", "r$", "brazilian real", "brazilian reais"],
}
# Words of scale, and letters that are such only beside a currency.
SCALES = {
    1_000: ["thousand", "thousands", "thd.", "thds.", "thds", "000s", "'000", "'000s"],
    1_000_000: ["million", "millions", "mn", "mil.", "mio.", "mil", "mio"],
    1_000_000_000: ["billion", "billions", "bn"],
}
LETTERS = {1_000: ["k", "t"], 1_000_000: ["m"]}
#: Parts into which the rows of one pair of texts are cut for the join with what the texts say.
SALTS = 16


def _any(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))


_MONEY = _any([w for names in CURRENCIES.values() for w in names])
_WORDS = _any([w for names in SCALES.values() for w in names])
_SHORT = _any([w for names in [*SCALES.values(), *LETTERS.values()] for w in names])
_UNIT = rf"^(?:({_SHORT})(?: of)? ?)?({_MONEY})(?: ?({_SHORT}))?$"
#: Closing phrases that name the unit of a heading's amounts.
_PHRASE = (
    rf"(?:\((?:in )?(?:(?:{_MONEY}) )?(?:{_WORDS})(?: of (?:{_MONEY}))?(?:,[^()]*)?\)"
    rf"|\((?:in )?(?:{_MONEY})(?:,[^()]*)?\)"
    rf"|(?:^|[ ,-])(?:in|stated in|expressed in) (?:(?:{_MONEY}) )?(?:{_WORDS})(?: of (?:{_MONEY}))?"
    rf"|, (?:{_WORDS}) of (?:{_MONEY})"
    rf"|(?:^|[ ,-])in (?:{_MONEY}))$"
)


def _lookup(token: Column, table: dict, kind: str) -> Column:
    pairs = [x for value, names in table.items() for n in names for x in (F.lit(n), F.lit(value).cast(kind))]
    return F.try_element_at(F.create_map(*pairs), token)


def _scale(token: Column) -> Column:
    return _lookup(token, {k: SCALES[k] + LETTERS.get(k, []) for k in SCALES}, "bigint")


def named_units(rows: DataFrame, unit: Column, caption: Column) -> DataFrame:
    """Adds ``currency`` and ``scale``: the unit's, else the caption's, else a scale of one.

    A unit is a currency, alone or with one word of scale before or after it; anything else that
    isn't blank (shares, acres, dollars per share) is of another kind. Of a caption only closing
    phrases count: "(in thousands)", "in USD thousands", ", thousands of euros", ", in euros";
    "sales to thousands of small accounts" says nothing about the amounts. ``currency`` is null
    where neither names one or the unit is of another kind.
    """
    rows = rows.drop("currency", "scale").withColumns({"_u": F.coalesce(unit, F.lit("")), "_c": F.coalesce(caption, F.lit(""))})
    # texts repeat from row to row: each pair is read once, the rows look it up; salted, as most bear the same few
    given = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    texts = rows.select("_u", "_c").distinct().select("*", *_read_texts(F.col("_u"), F.col("_c")))
    spread = texts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return given.join(spread, ["_u", "_c", "_salt"]).drop("_u", "_c", "_salt")


def _read_texts(unit: Column, caption: Column) -> list[Column]:
    u = F.regexp_replace(F.trim(F.lower(unit)), "^iso4217:", "")
    phrase = F.regexp_extract(F.trim(F.lower(caption)), _PHRASE, 0)
    money, size = F.regexp_extract(u, _UNIT, 2), F.concat(F.regexp_extract(u, _UNIT, 1), F.regexp_extract(u, _UNIT, 3))
    said_money = F.regexp_extract(phrase, rf"(?<![a-z])({_MONEY})(?![a-z])", 1)
    said_size = F.regexp_extract(phrase, rf"(?<![a-z0-9])({_WORDS})(?![a-z0-9])", 1)
    other = (u != "") & (money == "")
    currency = F.when(~other, F.coalesce(_lookup(money, CURRENCIES, "string"), _lookup(said_money, CURRENCIES, "string")))
    return [currency.alias("currency"), F.coalesce(_scale(size), _scale(said_size), F.lit(1).cast("bigint")).alias("scale")]


def rate_periods(rates: DataFrame, currency: str, date: str, value: str, home: str = "USD") -> DataFrame:
    """(currency, from_date, to_date, rate): each rate holds until the next that isn't null."""
    known = rates.filter(F.col(value).isNotNull() & F.col(currency).isNotNull() & F.col(date).isNotNull())
    one = known.groupBy(F.col(currency).alias("currency"), F.col(date).alias("from_date")).agg(F.max(value).alias("rate"))
    w = Window.partitionBy("currency").orderBy("from_date")
    return one.filter(F.col("currency") != home).select(
        "currency", "from_date", F.lead("from_date").over(w).alias("to_date"), "rate"
    )


def at_rates(rows: DataFrame, date: str, rates: DataFrame, until=None) -> DataFrame:
    """Rows with ``currency`` that have a rate, with it as ``fx_rate``: the last on or before ``date``.

    Foreign rows before the first rate or without date, and rows without currency, are left out.
    ``until`` is the last date of the rows, if the caller knows it. Rates are joined on (currency,
    month): each holds for the months it spans, so the join is an equi-join that keeps few candidates.
    """
    last = F.coalesce(F.date_sub("to_date", 1), F.col("until"))
    until = until or rows.agg(F.max(date)).first()[0]
    spans = (
        rates.withColumn("until", F.greatest(F.lit(until).cast("date"), F.col("from_date")))
        .withColumn("_fx_month", F.explode(F.sequence(F.trunc("from_date", "month"), F.trunc(last, "month"), F.expr("interval 1 month"))))
        .select(F.col("currency").alias("_fx_cur"), F.col("_fx_month"), F.col("from_date").alias("_fx_from"), F.col("to_date").alias("_fx_to"), F.col("rate").cast("decimal(12,6)").alias("_fx_rate"))
    )
    joined = rows.drop("fx_rate").filter(F.col("currency").isNotNull()).join(
        spans,
        (F.col("currency") == F.col("_fx_cur")) & (F.trunc(date, "month") == F.col("_fx_month"))
        & (F.col(date) >= F.col("_fx_from")) & (F.col("_fx_to").isNull() | (F.col(date) < F.col("_fx_to"))),
        "left",
    )
    converted = joined.filter((F.col("currency") == "USD") | F.col("_fx_rate").isNotNull())
    rate = F.when(F.col("currency") == "USD", F.lit(1).cast("decimal(12,6)")).otherwise(F.col("_fx_rate"))
    return converted.withColumn("fx_rate", rate).drop("_fx_cur", "_fx_month", "_fx_from", "_fx_to", "_fx_rate")


def to_whole_usd(rows: DataFrame, value: str, date: str, rates: DataFrame, until=None) -> DataFrame:
    """Rows of ``at_rates`` that also have a ``scale``, with ``amount_usd`` added; a null value gives a null amount."""
    scaled = (F.col(value).cast("decimal(24,4)") * F.col("scale").cast("decimal(10,0)")).cast("decimal(26,4)")
    return at_rates(rows, date, rates, until).withColumn("amount_usd", F.round(scaled * F.col("fx_rate"), 0).cast("bigint")).drop("fx_rate")


def solve_units(
    rows: DataFrame, recorded: str, identity: Column, factors: list[int], tolerance: float = 0.12, margin: float = 0.12
) -> DataFrame:
    """Adds ``factor``, ``residual`` and ``solutions`` from an identity between columns.

    For each candidate factor f the residual is |log10(recorded * f / identity)|. ``factor`` is
    the one of least residual if that is below ``tolerance``, else null; ``solutions`` counts the
    factors whose residual is below the tolerance or within ``margin`` of the least. A factor is
    kept only if it is the one solution. Null, zero or negative quantities have none.
    """
    x, y = F.col(recorded).cast("double"), identity.cast("double")
    usable = (x > 0) & (y > 0)
    residual = lambda f: F.abs(F.log10(F.when(usable, x * f / y)))
    each = F.array_sort(F.array(*[F.struct(residual(f).alias("residual"), F.lit(f).cast("bigint").alias("factor")) for f in factors]))
    best = F.element_at("_each", 1)
    return (
        rows.withColumn("_each", each)
        .withColumn("residual", best["residual"])
        .withColumn("solutions", F.when(best["residual"] < tolerance, F.size(F.filter("_each", lambda e: e["residual"] < best["residual"] + margin))).otherwise(F.lit(0)))
        .withColumn("factor", F.when(F.col("solutions") == 1, best["factor"]))
        .drop("_each")
    )
