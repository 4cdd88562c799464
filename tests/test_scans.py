import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from finstrata.core.scans import chunked_scan
from finstrata.core.streams import complete_groups, group_starts

OUT = {"a": ("max_before", "v"), "b": ("max_upto", "v"), "c": ("min_from", "v"), "d": ("count_before", "v"), "e": ("previous", "v"), "f": ("sum_upto", "v")}


@pytest.mark.parametrize("width", [1, 7, 1000, None])
def test_as_a_plain_window(spark, width):
    r = random.Random(width or 0)
    rows = [(r.choice([1, 1, 1, 2]), t, r.choice([None, r.randrange(99)])) for t in range(300)]
    df = spark.createDataFrame(rows, "k long, t long, v long").withColumn("a", F.lit("clash"))
    got = chunked_scan(df, ["k"], F.floor(F.col("t") / width) if width else None, ["t"], OUT)
    w = Window.partitionBy("k").orderBy("t")
    want = df.select(
        "k", "t", "v", F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("a"), F.max("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("b"),
        F.min("v").over(w.rowsBetween(0, Window.unboundedFollowing)).alias("c"), (F.row_number().over(w) - 1).cast("bigint").alias("d"), F.lag("v").over(w).alias("e"),
        F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).alias("f"),
    )
    key = lambda x: (x.k, x.t)
    assert [tuple(x) for x in sorted(got.collect(), key=key)] == [tuple(x) for x in sorted(want.collect(), key=key)]


def test_empty(spark):
    df = spark.createDataFrame([], "k long, t long, v long")
    assert chunked_scan(df, ["k"], F.floor(F.col("t") / 5), ["t"], OUT).count() == 0


def test_groups_are_never_cut():
    import pyarrow as pa

    r = random.Random(3)
    keys = sorted((r.randrange(9), r.choice([None, "a", "b"]) or "") for _ in range(500))
    batches = [pa.record_batch({"k": pa.array([k for k, _ in keys[i : i + 13]]), "s": pa.array([s for _, s in keys[i : i + 13]])}) for i in range(0, 500, 13)]
    seen = []
    for t in complete_groups(iter(batches), ["k", "s"], 40):
        starts = group_starts(t, ["k", "s"])
        groups = {(a, b) for a, b in zip(t.column("k").to_pylist(), t.column("s").to_pylist())}
        assert len(starts) == len(groups) and not groups & set(seen)
        seen += groups
    assert len(seen) == len(set(keys))
