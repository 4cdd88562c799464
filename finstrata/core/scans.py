"""Running maxima, minima, counts and neighbours along long groups, without one task a group.

A window over a group runs in one task. Where a group may hold a large part of all rows, its
rows are cut into chunks that follow the order (a time bucket, say). Each chunk is reduced to
one row, the few rows of chunks are scanned by a window, and what came before or comes after a
chunk is joined back to windows that run within it. Both run on the same hash of (keys, chunk),
so the rows themselves are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _backwards(keys: list[str], order: list[str]):
    """From the row to the last one, read from the end so that the frame grows."""
    return Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)


def chunked_scan(df: DataFrame, keys: list[str], chunk: Column | None, order: list[str], outputs: dict[str, tuple[str, Column | str]]) -> DataFrame:
    """Adds columns that look along each group of ``keys`` in ``order``.

    ``chunk`` must not fall along the order and must not be null; None means that groups are
    known to be short, and plain windows serve. ``outputs`` maps a new column
    to its kind and argument: "max_before" and "max_upto" (greatest value in earlier rows, without
    and with the row itself), "sum_upto" (their sum with the row itself), "min_from" (least value
    from the row on), "count_before" (earlier rows), "previous" (the value in the row before).
    Nulls are no values, except for "previous". All frames grow as rows come, so each is linear.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    keep = [c for c in df.columns if c not in outputs]
    if chunk is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        past, upto, on = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0), _backwards(keys, order)
        plain = {
            "max_before": lambda c: F.max(c).over(past), "max_upto": lambda c: F.max(c).over(upto), "min_from": lambda c: F.min(c).over(on),
            "sum_upto": lambda c: F.coalesce(F.sum(c).over(upto), F.lit(0)),
            "count_before": lambda c: (F.row_number().over(w) - 1).cast("bigint"), "previous": lambda c: F.lag(c).over(w),
        }
        return df.select(*keep, *[plain[kind](col(arg)).alias(name) for name, (kind, arg) in outputs.items()])
    rows = df.withColumn("_chunk", chunk)
    for name, (_, arg) in outputs.items():
        rows = rows.withColumn(f"_arg_{name}", col(arg))
    last = F.struct(*order) if len(order) > 1 else F.col(order[0])
    reduced = {"max_before": F.max, "max_upto": F.max, "sum_upto": F.sum, "min_from": F.min, "count_before": lambda c: F.count(F.lit(1)), "previous": lambda c: F.max_by(F.struct(c.alias("v")), last)}
    parts = rows.groupBy(*keys, "_chunk").agg(*[reduced[kind](F.col(f"_arg_{name}")).alias(f"_c_{name}") for name, (kind, _) in outputs.items()])
    w = Window.partitionBy(*keys).orderBy("_chunk")
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys).orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    outside = {
        "max_before": lambda c: F.max(c).over(before), "max_upto": lambda c: F.max(c).over(before), "min_from": lambda c: F.min(c).over(after),
        "sum_upto": lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)), "count_before": lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)), "previous": lambda c: F.lag(c).over(w),
    }
    carried = parts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_chunk").alias("_k_chunk"), *[outside[kind](F.col(f"_c_{name}")).alias(f"_o_{name}") for name, (kind, _) in outputs.items()])
    same = [F.col(k) == F.col(f"_k_{k}") for k in keys] + [F.col("_chunk") == F.col("_k_chunk")]
    joined = rows.join(carried, same)
    inner = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    past, upto, on = inner.rowsBetween(Window.unboundedPreceding, -1), inner.rowsBetween(Window.unboundedPreceding, 0), _backwards([*keys, "_chunk"], order)

    def whole(name: str, kind: str) -> Column:
        a, o = F.col(f"_arg_{name}"), F.col(f"_o_{name}")
        if kind == "max_before":
            return F.greatest(F.max(a).over(past), o)
        if kind == "max_upto":
            return F.greatest(F.max(a).over(upto), o)
        if kind == "sum_upto":
            return F.coalesce(F.sum(a).over(upto), F.lit(0)) + o
        if kind == "min_from":
            return F.least(F.min(a).over(on), o)
        if kind == "count_before":
            return F.row_number().over(inner) - 1 + o
        return F.coalesce(F.lag(F.struct(a.alias("v"))).over(inner), o).getField("v")

    return joined.select(*keep, *[whole(name, kind).alias(name) for name, (kind, _) in outputs.items()])
