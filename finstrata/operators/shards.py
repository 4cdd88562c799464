"""Per-key results when a few keys hold most rows.

Loads are counted for all keys. A key whose load exceeds a task's fair share is cut into
shards in proportion to its load; the other keys are gathered in hashed micro-bins. Shards
and micro-bins are then packed to tasks, largest first, each to the least loaded task. Rows
go straight to their task (no second hash), and a matching side is replicated only to the
shards of the keys it matches.

What reaches the driver is bounded by the number of tasks, whatever the data: at most
2 * tasks heavy keys (each has over half a fair share) and ``BINS`` * tasks micro-bin loads.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finstrata.core.streams import complete_groups, group_starts
from finstrata.core.tables import shuffle_partitions

BINS = 16


@dataclass
class ShardPlan:
    keys: list[str]
    tasks: int
    heavy: DataFrame  # keys, _tasks array<int>: one task for each shard
    light: DataFrame  # _bin, _task
    loads: list[float]  # of each task, in rows
    split: int  # keys with more than one shard


def _bin(keys: list[str], tasks: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(tasks * BINS)).cast("int")


def plan_shards(df: DataFrame, keys: list[str], tasks: int | None = None) -> ShardPlan:
    spark = df.sparkSession
    tasks = tasks or shuffle_partitions(spark)
    loads = df.groupBy(*keys).agg(F.count("*").alias("_n")).persist()
    try:
        total = loads.agg(F.sum("_n")).first()[0] or 0
        fair = max(total / tasks, 1)
        heavy = [tuple(r) for r in loads.filter(F.col("_n") > fair / 2).collect()]  # fewer than 2 * tasks
        bins = (
            loads.filter(F.col("_n") <= fair / 2).groupBy(_bin(keys, tasks).alias("_bin")).agg(F.sum("_n").alias("_n")).collect()
        )
    finally:
        loads.unpersist()
    units: list[tuple[float, int, int, int]] = []  # load, heavy key or -1, shard, bin
    for k, row in enumerate(heavy):
        shards = max(1, math.ceil(row[-1] / fair))
        units += [(row[-1] / shards, k, s, -1) for s in range(shards)]
    units += [(float(r["_n"]), -1, -1, r["_bin"]) for r in bins]
    heap = [(0.0, t) for t in range(tasks)]
    at: dict[int, dict[int, int]] = {}
    light: list[tuple[int, int]] = []
    for load, k, s, b in sorted(units, reverse=True):
        had, t = heapq.heappop(heap)
        heapq.heappush(heap, (had + load, t))
        if k < 0:
            light.append((b, t))
        else:
            at.setdefault(k, {})[s] = t
    fields = df.select(*keys).schema.fields
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in fields], T.StructField("_tasks", T.ArrayType(T.IntegerType()))])
    rows = [(*heavy[k][:-1], [at[k][s] for s in range(len(at[k]))]) for k in sorted(at)]
    return ShardPlan(
        keys, tasks, spark.createDataFrame(rows, schema), spark.createDataFrame(light, "_bin int, _task int"),
        [x for x, _ in sorted(heap, key=lambda x: x[1])], sum(len(x) > 1 for x in at.values()),
    )


def _with_plan(df: DataFrame, plan: ShardPlan) -> DataFrame:
    same = [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in plan.keys]
    heavy = plan.heavy.select(*[F.col(k).alias(f"_h_{k}") for k in plan.keys], "_tasks")
    return (
        df.join(F.broadcast(heavy), same, "left").drop(*[f"_h_{k}" for k in plan.keys])
        .withColumn("_bin", F.when(F.col("_tasks").isNull(), _bin(plan.keys, plan.tasks)))
        .join(F.broadcast(plan.light), "_bin", "left")
    )


def assign_rows(df: DataFrame, plan: ShardPlan, row_id: Column) -> DataFrame:
    """Adds _shard and _task; rows of equal ``row_id`` and key go to the same shard.

    Columns of the plan's own names (_tasks, _bin, _task, _shard) are replaced.
    """
    df = df.drop("_tasks", "_bin", "_task", "_shard")
    shard = F.when(F.col("_tasks").isNull(), 0).otherwise(F.pmod(F.xxhash64(row_id), F.size("_tasks"))).cast("int")
    return (
        _with_plan(df, plan).withColumn("_shard", shard)
        .withColumn("_task", F.coalesce(F.col("_task"), F.get("_tasks", F.col("_shard")), F.lit(0)))
        .drop("_tasks", "_bin")
    )


def replicate_rows(df: DataFrame, plan: ShardPlan) -> DataFrame:
    """The matching side: each row once for every task that has a shard of its key, with _task."""
    df = df.drop("_tasks", "_bin", "_task", "_shard", "_p")
    return (
        _with_plan(df, plan)
        .withColumn("_p", F.explode(F.when(F.col("_tasks").isNull(), F.array(F.coalesce("_task", F.lit(0)))).otherwise(F.array_distinct("_tasks"))))
        .drop("_task", "_bin", "_tasks").withColumnRenamed("_p", "_task")
    )


def join_sharded(left: DataFrame, right: DataFrame, plan: ShardPlan, row_id: Column, how: str = "inner") -> DataFrame:
    """Join on the plan's keys with the hot keys' rows spread and the right side replicated to them.

    As in any join, null keys match nothing. A column of the right side that the left has too,
    other than a key, is left out.
    """
    right = right.drop(*[c for c in right.columns if c in left.columns and c not in plan.keys])
    a = assign_rows(left, plan, row_id).repartitionById(plan.tasks, F.col("_task"))
    b = replicate_rows(right, plan).repartitionById(plan.tasks, F.col("_task"))
    return a.join(b, [*plan.keys, "_task"], how).drop("_task", "_shard")


def top_rows(
    df: DataFrame, keys: list[str], by: str, row_id: str, k: int, shard_keys: list[str] | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """For each key the ``k`` rows greatest in ``by``; ties to the smaller ``row_id``.

    Rows of equal ``row_id`` and ``by`` count once. Rows with a null key or row_id are left out; a null
    ``by`` is less than any value. ``by`` and ``row_id`` must be bigint. Extra columns are
    ignored; the result has keys, ``row_id`` and ``by``.
    """
    rows = df.select(*keys, row_id, by)
    for c in [*keys, row_id]:
        rows = rows.filter(F.col(c).isNotNull())
    plan = plan_shards(rows, shard_keys or keys, tasks)
    placed = assign_rows(rows, plan, F.col(row_id)).repartitionById(plan.tasks, F.col("_task"))
    local = placed.select(*keys, row_id, by).sortWithinPartitions(*keys, F.col(by).desc_nulls_last(), row_id)

    def first_k(batches):
        for tbl in complete_groups(batches, keys):
            starts = group_starts(tbl, keys)
            ids = tbl.column(row_id).to_numpy()
            new = np.ones(len(ids), dtype=bool)
            new[1:] = ids[1:] != ids[:-1]
            new[starts] = True
            group = np.zeros(len(ids), dtype=np.int64)
            group[starts] = 1
            group = np.cumsum(group) - 1
            rank = np.cumsum(new)
            rank -= (rank[starts] - 1)[group]
            keep = new & (rank <= k)
            yield from tbl.filter(pa.array(keep)).combine_chunks().to_batches()

    best = local.mapInArrow(first_k, local.schema)
    w = Window.partitionBy(*keys).orderBy(F.col(by).desc_nulls_last(), row_id)
    return best.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k).drop("_rank")
