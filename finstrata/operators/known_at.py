"""Attributes as they were known at an event's time.

Facts arrive over time (``known_at``) and of those known, one is the best by a fixed
precedence. Each entity's history thus falls into half-open intervals, in each of which
one fact was the best. An interval is decomposed into dyadic time nodes: node (k, i)
covers the days [i * 2^k, (i + 1) * 2^k). An event lies in exactly one node of each
level, so a plain equi-join on (key, level, node) finds every interval that encloses it:
no range join, no scan of an entity's whole history, and a hot entity's rows spread over
its nodes.

Scale: facts are reduced to one row per entity and day before the only window; events are
reduced to distinct (key, day) before the join; both sides then shuffle on the node key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def day_number(c: Column) -> Column:
    return F.unix_date(c.cast("date"))


def day_span(*columns: tuple[DataFrame, str]) -> tuple[int | None, int | None]:
    """First and last day number over date columns: one cheap scan of each."""
    ends = [df.agg(F.min(day_number(F.col(c))), F.max(day_number(F.col(c)))).first() for df, c in columns]
    known = [e for e in ends if e[0] is not None]
    return (min(e[0] for e in known), max(e[1] for e in known)) if known else (None, None)


def known_intervals(
    facts: DataFrame, entity: list[str], known_at: str, precedence: list[Column], fact_id: str
) -> DataFrame:
    """Half-open intervals (entity, from_day, to_day, fact_id) of the best fact known.

    ``precedence``: columns of which the greater wins, in order; a null is the least. Ties
    go to the smallest ``fact_id``. Facts with a null ``known_at`` or a null entity column
    are never known. ``to_day`` is null for an interval that is still open.
    """
    rank = F.struct(*[p.alias(f"p{i}") for i, p in enumerate(precedence)], (-F.col(fact_id)).alias("neg_id"))
    known = facts.select(*entity, day_number(F.col(known_at)).alias("from_day"), rank.alias("best"))
    for c in [*entity, "from_day"]:
        known = known.filter(F.col(c).isNotNull())
    per_day = known.filter(F.col("best.neg_id").isNotNull()).groupBy(*entity, "from_day").agg(F.max("best").alias("best"))
    w = Window.partitionBy(*entity).orderBy("from_day")
    best = per_day.withColumn("best", F.max("best").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    changed = best.withColumn("before", F.lag("best").over(w)).filter(
        F.col("before").isNull() | (F.col("before") != F.col("best"))
    )
    return changed.select(
        *entity,
        "from_day",
        F.lead("from_day").over(w).alias("to_day"),
        (-F.col("best.neg_id")).alias(fact_id),
    )


def dyadic_nodes(first: Column, end: Column, levels: int) -> Column:
    """The canonical dyadic nodes (level, node) that make up [first, end), at most 2 a level."""

    def at(k: Column) -> Column:
        width = F.call_function("shiftleft", F.lit(1), k)
        lo, hi = F.ceil(first / width).cast("int"), F.floor(end / width).cast("int")
        node = lambda i: F.struct(k.alias("level"), i.cast("int").alias("node"))
        left = F.when((lo < hi) & (lo % 2 == 1), F.array(node(lo))).otherwise(F.array().cast("array<struct<level:int,node:int>>"))
        right = F.when((lo < hi) & (hi % 2 == 1), F.array(node(hi - 1))).otherwise(F.array().cast("array<struct<level:int,node:int>>"))
        return F.concat(left, right)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at))


def join_as_known(
    events: DataFrame, time: str, key: list[str], intervals: DataFrame, carry: list[str],
    span: tuple[int | None, int | None] | None = None,
) -> DataFrame:
    """Every event with the facts in force at its time: inner join of ``events`` with ``carry``.

    ``intervals`` has ``key``, from_day, to_day and ``carry``; several entities (members, say)
    may share a key, each then gives its own row. Events without a time or key give none.
    Columns of ``intervals`` other than those are dropped; a column of ``events`` that is named
    like one of ``carry`` gives way to it. Repeated events give repeated rows. ``span``: the first
    and last day on which an interval begins; without it the intervals are asked.
    """
    events = events.drop(*carry)
    lo, hi = span or intervals.agg(F.min("from_day"), F.max("from_day")).first()
    if lo is None:
        lo = hi = 0
    span = hi - lo + 2  # days from lo on, the last of which stands for all later ones
    levels = max(1, (span - 1).bit_length())
    nodes = (
        intervals.select(
            *key, *carry,
            (F.col("from_day") - lo).alias("_first"),
            F.coalesce(F.col("to_day") - lo, F.lit(1 << levels)).alias("_end"),
        )
        .withColumn("_n", F.explode(dyadic_nodes(F.col("_first"), F.col("_end"), levels)))
        .select(*key, *carry, "_first", "_end", F.col("_n.level").alias("_level"), F.col("_n.node").alias("_node"))
    )
    day = F.least(day_number(F.col(time)) - lo, F.lit(span - 1))
    probes = (
        events.select(*key, F.col(time)).distinct()
        .withColumn("_day", day)
        .filter(F.col("_day") >= 0)
        .withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
        .withColumn("_node", F.expr("shiftright(_day, _level)"))
    )
    hits = (
        probes.join(nodes, [*key, "_level", "_node"])
        .filter((F.col("_first") <= F.col("_day")) & (F.col("_day") < F.col("_end")))
        .select(*key, time, *carry)
    )
    return events.filter(F.col(time).isNotNull()).join(hits, [*key, time])
