"""Relational operators: filters, latest rows, set membership over quarters, resolution tiers.

All are ``DataFrame -> DataFrame`` with explicit parameters and no action inside, except where
the docstring says so.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finstrata.core.scans import chunked_scan

MOST_ROWS, MOST_OFFSET = 500, 100_000


def where_all(df: DataFrame, **criteria) -> DataFrame:
    """Filters by each criterion that isn't None.

    A list or set means membership, a pair (low, high) an inclusive range open at None, a
    Column is a predicate, anything else equality.
    """
    for name, want in criteria.items():
        if want is None:
            continue
        c = F.col(name) if name in df.columns else None
        if isinstance(want, Column):
            df = df.filter(want)
        elif isinstance(want, (list, set, frozenset)):
            df = df.filter(c.isin(list(want)))
        elif isinstance(want, tuple):
            low, high = want
            if low is not None:
                df = df.filter(c >= F.lit(low))
            if high is not None:
                df = df.filter(c <= F.lit(high))
        else:
            df = df.filter(c == F.lit(want))
    return df


def never(df: DataFrame) -> DataFrame:
    """The empty relation of the same columns."""
    return df.filter(F.lit(False))


def like_pattern(text: str) -> str:
    """The text as a LIKE pattern that stands for itself, with backslash as escape."""
    return re.sub(r"([\\%_])", r"\\\1", text)


def contains_text(c: Column, text: str) -> Column:
    return c.ilike("%" + like_pattern(text) + "%")


def whole_word(c: Column, word: str) -> Column:
    """Whether ``word`` stands in the text between non-alphanumerics, in any case."""
    return c.rlike(rf"(?i)(^|[^\p{{L}}\p{{N}}]){re.escape(word)}($|[^\p{{L}}\p{{N}}])")


def ranked_search(df: DataFrame, query: str, columns: list[str], exact: str, order: str) -> DataFrame:
    """Rows in which every word of the query occurs in some column; exact hits, then prefixes first."""
    words = [w for w in re.split(r"\s+", query.strip()) if w]
    for w in words:
        df = df.filter(reduce(lambda a, b: a | b, [F.coalesce(contains_text(F.col(c), w), F.lit(False)) for c in columns]))
    whole = F.lower(F.col(exact)) == query.strip().lower()
    prefix = F.col(exact).ilike(like_pattern(query.strip()) + "%")
    return df.withColumn("match_rank", F.when(whole, 0).when(prefix, 1).otherwise(2)).orderBy("match_rank", order)


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """A page of a total order; limit and offset are clamped."""
    return df.orderBy(*order).offset(max(0, min(offset, MOST_OFFSET))).limit(max(1, min(limit, MOST_ROWS)))


def nth_latest(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The n-th row of each key in a total order; keys with fewer rows have none."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == n).drop("_rn")


def latest_with_ties(df: DataFrame, keys: list[str], date: str) -> DataFrame:
    """All rows of each key's latest date."""
    newest = df.groupBy(*keys).agg(F.max(date).alias("_d"))
    return df.join(newest.withColumnRenamed("_d", date), [*keys, date])


def share_of(part: Column, whole: Column) -> Column:
    """part / whole in percent, 0 where there is no positive whole."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double") * 100).otherwise(F.lit(0.0))


def period_activity(rows: DataFrame, by: list[str], who: str, date: str, current: str, previous: str, measures: list[str]) -> DataFrame:
    """Each measure's sum and the distinct filers in two periods side by side, in one pass.

    First by filer, with presence flags, then over filers: distinct counts become sums of flags, so
    rows aren't multiplied for them. A null filer adds to the sums and isn't counted.
    """
    cur, prev = F.col(date) == F.lit(current).cast("date"), F.col(date) == F.lit(previous).cast("date")
    sides = (("current", cur), ("previous", prev))
    sums = [F.sum(F.when(when, F.col(m)).otherwise(0)).alias(f"{side}_{m}") for m in measures for side, when in sides]
    flags = [F.max(when.cast("int")).alias(f"_{side}") for side, when in sides]
    one = rows.filter(cur | prev).groupBy(*dict.fromkeys([*by, who])).agg(*sums, *flags)
    return one.groupBy(*by).agg(
        *[F.sum(f"{side}_{m}").alias(f"{side}_{m}") for m in measures for side, _ in sides],
        *[F.count_if((F.col(f"_{side}") == 1) & F.col(who).isNotNull()).alias(f"{side}_filers") for side, _ in sides],
    )


def churn(rows: DataFrame, item: str, who: str, date: str, current: str, previous: str) -> DataFrame:
    """Filers that began and ceased to hold each item, by presence flags and two aggregations.

    No anti-join: (item, who) is reduced to its two flags first, then counted by item.
    """
    cur, prev = F.col(date) == F.lit(current).cast("date"), F.col(date) == F.lit(previous).cast("date")
    flags = rows.filter(cur | prev).groupBy(item, who).agg(F.max(cur.cast("int")).alias("c"), F.max(prev.cast("int")).alias("p"))
    return flags.groupBy(item).agg(
        F.count_if((F.col("c") == 1) & (F.col("p") == 0)).alias("new_filers"),
        F.count_if((F.col("c") == 0) & (F.col("p") == 1)).alias("sold_out_filers"),
        F.count_if((F.col("c") == 1) & (F.col("p") == 1)).alias("kept_filers"),
    )


def carry_forward(rows: DataFrame, who: str, date: str, current: str, previous: str) -> DataFrame:
    """The current period, with the previous one's rows of those who haven't filed yet."""
    now = rows.filter(F.col(date) == F.lit(current).cast("date"))
    before = rows.filter(F.col(date) == F.lit(previous).cast("date"))
    return now.unionByName(before.join(now.select(who).distinct(), who, "left_anti"))


def gone_among_filers(rows: DataFrame, item: str, who: str, date: str, current: str, previous: str) -> DataFrame:
    """(who, item) held before and not now, of those who filed now: a semi- and an anti-join."""
    now = rows.filter(F.col(date) == F.lit(current).cast("date")).select(who, item).distinct()
    before = rows.filter(F.col(date) == F.lit(previous).cast("date")).select(who, item).distinct()
    return before.join(now.select(who).distinct(), who, "left_semi").join(now, [who, item], "left_anti")


def resolve_tiers(tiers: list[DataFrame], key: str) -> DataFrame:
    """Rows of the first tier that has any, without repeats: exact before alias before tokens."""
    tagged = reduce(lambda a, b: a.unionByName(b), [t.withColumn("tier", F.lit(i)) for i, t in enumerate(tiers)])
    first = tagged.agg(F.min("tier").alias("tier"))
    return tagged.join(F.broadcast(first), "tier").dropDuplicates([key])


def overlap_pairs(rows: DataFrame, who: str, item: str) -> DataFrame:
    """(a, b, shared, union_size, jaccard) of every two that share an item.

    Meant for a chosen set of holders; the join is on the item, so pairs without one don't arise.
    """
    held = rows.select(who, item).distinct()
    size = held.groupBy(who).agg(F.count("*").alias("n"))
    a, b = held.select(F.col(who).alias("a"), item), held.select(F.col(who).alias("b"), item)
    shared = a.join(b, item).filter(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.count("*").alias("shared"))
    sizes = lambda c, n: size.select(F.col(who).alias(c), F.col("n").alias(n))
    union = F.col("na") + F.col("nb") - F.col("shared")
    return shared.join(sizes("a", "na"), "a").join(sizes("b", "nb"), "b").select(
        "a", "b", "shared", union.alias("union_size"), F.round(F.col("shared") / union * 100, 4).alias("jaccard")
    )


def _counts_along(df: DataFrame, value: str, chunks: int) -> DataFrame:
    """(_v, _c, _upto, _n): each value's rows, the rows up to it, all rows; no task sees all rows or all values.

    Rows are counted by value; the counts, cut into chunks at quantiles of the values, are summed along.
    """
    v = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    edges = v.agg(F.percentile_approx("_v", [i / chunks for i in range(1, chunks)], 10 * chunks).alias("_e"), F.sum("_c").alias("_n"))
    placed = v.crossJoin(F.broadcast(edges)).withColumns({"_all": F.lit(0), "_chunk_no": F.size(F.filter("_e", lambda e: e < F.col("_v")))}).drop("_e")
    return chunked_scan(placed, ["_all"], F.col("_chunk_no"), ["_v"], {"_upto": ("sum_upto", "_c")})


def with_percentile(df: DataFrame, value: str, name: str, chunks: int = 256) -> DataFrame:
    """Adds the mean rank of equal values over n - 1, in percent; 50 for a single row; null stays null."""
    pct = F.when(F.col("_n") == 1, F.lit(50.0)).otherwise((F.col("_upto") - F.col("_c") + (F.col("_c") - 1) / 2) / (F.col("_n") - 1) * 100)
    return df.drop(name).join(_counts_along(df, value, chunks).select("_v", pct.alias(name)), F.col(value) == F.col("_v"), "left").drop("_v")


def with_place(df: DataFrame, value: str, name: str, chunks: int = 256) -> DataFrame:
    """Adds the place of each row by a number, from 1 for the least; equal ones share the first place; null stays null."""
    place = (F.col("_upto") - F.col("_c") + 1).cast("bigint")
    return df.drop(name).join(_counts_along(df, value, chunks).select("_v", place.alias(name)), F.col(value) == F.col("_v"), "left").drop("_v")


def weighted_composite(factors: dict[str, float]) -> Column:
    """Weighted mean of percentile columns; a null factor's weight goes to the others."""
    total = reduce(lambda a, b: a + b, [F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for c, w in factors.items()])
    score = reduce(lambda a, b: a + b, [F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in factors.items()])
    return F.when(total > 0, score / total)
