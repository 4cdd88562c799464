import random
from collections import defaultdict

from pyspark.sql import functions as F

from finstrata.operators.shards import assign_rows, join_sharded, plan_shards, top_rows


def _rows(n=4000, seed=2):
    r = random.Random(seed)
    rows = [(1 if r.random() < 0.4 else r.randrange(2, 300), r.choice(["x", "y", None]), i, r.choice([None, r.randrange(50)])) for i in range(n)]
    rows += rows[:300]
    return rows + [(None, "x", 5, 5), (3, "x", None, 5)]


SCHEMA = "k long, d string, id long, v long"


def test_top_rows_as_brute_force(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("_task", F.lit("clash")).withColumn("_n", F.lit("clash"))
    groups = defaultdict(set)
    for k, d, i, v in rows:
        if None not in (k, d, i):
            groups[k, d].add((v is None, -(v or 0), i))
    want = {(k, d, i) for (k, d), g in groups.items() for _, _, i in sorted(g)[:3]}
    got = [tuple(r) for r in top_rows(df, ["k", "d"], "v", "id", 3, ["k"]).select("k", "d", "id").collect()]
    assert set(got) == want and len(got) == len(want)


def test_hot_key_is_spread_by_its_load(spark):
    df = spark.createDataFrame(_rows(), SCHEMA).filter("k is not null")
    plan = plan_shards(df, ["k"], 8)
    assert plan.split == 1
    assert max(plan.loads) < 1.3 * sum(plan.loads) / 8
    by_task = {r._task: r["count"] for r in assign_rows(df, plan, F.col("id")).groupBy("_task").count().collect()}
    assert max(by_task.values()) < 1.5 * sum(by_task.values()) / 8


def test_sharded_join_is_a_join(spark):
    left = spark.createDataFrame(_rows(), SCHEMA)
    right = spark.createDataFrame([(k, f"n{k}") for k in range(1, 200)] + [(None, "none"), (1, "again")], "k long, name string").withColumn("d", F.lit("clash"))
    plan = plan_shards(left.filter("k is not null"), ["k"], 8)
    got = join_sharded(left, right, plan, F.col("id")).select("k", "id", "name")
    want = left.join(right.drop("d"), "k").select("k", "id", "name")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_two_shards_of_a_key_in_one_task_replicate_once(spark):
    left = spark.createDataFrame([(1, i) for i in range(100)] + [(2, i) for i in range(100, 110)], "k long, id long")
    right = spark.createDataFrame([(1, "a"), (2, "b")], "k long, name string")
    plan = plan_shards(left, ["k"], 3)
    plan.heavy = spark.createDataFrame([(1, [0, 1, 1])], "k long, _tasks array<int>")
    assert join_sharded(left, right, plan, F.col("id")).count() == 110


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert top_rows(df, ["k", "d"], "v", "id", 3).count() == 0
