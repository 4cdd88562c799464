from datetime import datetime, timedelta

from pyspark.sql import functions as F

from finstrata.streaming import incremental as I

T0 = datetime(2024, 1, 1)


def test_once_and_windows(spark, tmp_path):
    rows = [(i % 40, T0 + timedelta(minutes=i % 40), "ab"[i % 2], 1.0) for i in range(60)]
    src, out, ck = str(tmp_path / "s"), str(tmp_path / "o"), str(tmp_path / "c")
    spark.createDataFrame(rows, "id long, ts timestamp, kind string, v double").write.parquet(src)
    stream = I.once(I.stream_table(spark, src), ["id"], "ts", "1 hour")
    I.run_to_end(stream, out, ck)
    assert spark.read.parquet(out).count() == 40
    spark.createDataFrame(rows[:5] + [(99, T0 + timedelta(minutes=39), "a", 1.0)], "id long, ts timestamp, kind string, v double").write.mode("append").parquet(src)
    I.run_to_end(stream, out, ck)  # goes on where it stopped; what came again stays out
    assert spark.read.parquet(out).count() == 41
    w = I.windowed(spark.read.parquet(out), "ts", "10 minutes", ["kind"], "v")
    assert w.agg(F.sum("n")).first()[0] == 41 and w.count() == 8
    late = I.windowed(I.stream_table(spark, src).withWatermark("ts", "5 minutes"), "ts", "10 minutes", [], "v", "5 minutes")
    I.run_to_end(late, str(tmp_path / "w"), str(tmp_path / "wc"))
    assert spark.read.parquet(str(tmp_path / "w")).count() > 0


def test_submissions_that_stand(spark):
    rows = [(1, "a", 1, "original"), (1, "b", 2, "restatement"), (1, "c", 3, "new"), (2, "d", 1, "new"), (2, "e", 2, "new")]
    df = spark.createDataFrame(rows, "h int, acc string, at int, kind string")
    kept = I.settle_submissions(df, ["h"], ["at"], F.col("kind") != "new")
    assert sorted(r.acc for r in kept.collect()) == ["b", "c", "d", "e"]


def test_refresh_touches_dirty_partitions_only(spark, tmp_path):
    base = spark.createDataFrame([("q1", 1), ("q1", 2), ("q2", 5)], "q string, v int")
    path = str(tmp_path / "snap")
    build = lambda df: df.groupBy("q").agg(F.sum("v").alias("v"))
    I.refresh(base, I.dirty_partitions(base, "q"), "q", build, path)
    changed = base.union(spark.createDataFrame([("q2", 7), ("q1", 100)], base.schema))
    I.refresh(changed, spark.createDataFrame([("q2",)], "q string"), "q", build, path)
    assert {r.q: r.v for r in spark.read.parquet(path).collect()} == {"q1": 3, "q2": 12}
    follow = I.dirty_partitions(spark.createDataFrame([(1,)], "q int"), "q", "q + 1")
    assert sorted(r.q for r in follow.collect()) == [1, 2]


def test_reprice_and_versions(spark, tmp_path):
    p = spark.createDataFrame([(1, "a", 10, None, 0), (2, "b", 10, 77, 2), (3, "b", 10, None, 2), (4, "b", 10, 77, 0)], "i int, k string, shares long, filed long, tries int")
    px = spark.createDataFrame([("a", 2.5)], "k string, price double")
    got = {r.i: (r.value, r.state, r.tries) for r in I.reprice(p, px, ["k"], "price", "shares", "filed", "tries", 3).collect()}
    assert got == {1: (25, "derived", 0), 2: (77, "filed", 3), 3: (None, "unavailable", 3), 4: (None, "pending", 1)}
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    spark.range(1).withColumn("computed_at", F.lit(1)).write.parquet(a)
    assert I.versioned_or_live(spark, [a, b], lambda: "live") == (None, "live")
    spark.range(1).withColumn("computed_at", F.lit(1)).write.parquet(b)
    assert I.versioned_or_live(spark, [a, b], lambda: "live")[1] is None
    spark.range(1).withColumn("computed_at", F.lit(2)).write.mode("append").parquet(b)
    assert I.versioned_or_live(spark, [a, b], lambda: "live") == (None, "live")
