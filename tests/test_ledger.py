import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from finstrata.operators.ledger import bitemporal_ledger, clean_cik, clean_cusip

T0 = datetime(2020, 1, 1)


def _believed(messages):
    """Versions that plain reading of the messages gives, by entity."""
    once = {}
    for e, v, p, raised, _ in messages:
        if e is None or v is None or raised is None:
            continue
        old = once.get((e, raised))
        once[e, raised] = (v, p) if old is None or v > old[0] else (v, max(filter(None, [p, old[1]]), default=None)) if v == old[0] else old
    out = set()
    for e in {k[0] for k in once}:
        force = since = None
        for (_, raised), (v, p) in sorted(((k, x) for k, x in once.items() if k[0] == e), key=lambda x: x[0][1]):
            lost = p is not None and p != force
            if v == force and not lost:
                continue
            if force is not None:
                out.add((e, force, since, None if lost else raised, False))
            if lost:
                out.add((e, p, None, raised, False))
            force, since = v, raised
        if force is not None:
            out.add((e, force, since, None, True))
    return out


@pytest.mark.parametrize("block,long", [(1, 1000), (2, 1000), (3, 1000), (5, 1000), (1000, 1000), (3, 2), (1, 3)])
def test_every_recorded_time_tells_what_was_known(spark, block, long):
    r = random.Random(block)
    rows = []
    for e in (1, 2, 3):
        for _ in range(25 if e < 3 else 3):
            raised = T0 + timedelta(days=r.randrange(60))
            late = r.choice([0, 0, 0, 1, 30])
            if r.random() < 0.15:  # valid long after it was recorded
                late = -r.randrange(5, 60)
            rows.append((e, r.choice("ABC"), r.choice(["A", "B", None, None]), raised, raised + timedelta(days=late, seconds=r.randrange(999))))
    # one value and one previous a raised time, as messages sent twice have
    seen = {}
    rows = [seen.setdefault((x[0], x[3]), x)[:3] + (x[3], x[4]) for x in rows]
    rows += [(None, "A", None, T0, T0), (4, None, None, T0, T0), (4, "A", None, None, T0)]
    df = spark.createDataFrame(rows, "entity long, value string, previous string, raised timestamp, recorded timestamp").withColumn("block", F.lit("clash"))
    got = bitemporal_ledger(df, "entity", "value", "previous", "raised", "recorded", block, long).collect()
    for at in sorted({x[4] for x in rows}):
        then = {(g.entity, g.value, g.valid_from, g.valid_to, g.is_open) for g in got if g.recorded_from <= at and (g.recorded_to is None or g.recorded_to > at)}
        assert then == _believed([x for x in rows if x[4] <= at]), at
    now = {(g.entity, g.value, g.valid_from, g.valid_to, g.is_open) for g in got if g.recorded_to is None}
    assert now == _believed(rows)


def test_nothing_is_overwritten(spark):
    rows = [(1, "A", None, T0, T0), (1, "B", "A", T0 + timedelta(10), T0 + timedelta(10)), (1, "C", "A", T0 + timedelta(5), T0 + timedelta(20))]
    df = spark.createDataFrame(rows, "entity long, value string, previous string, raised timestamp, recorded timestamp")
    got = bitemporal_ledger(df, "entity", "value", "previous", "raised", "recorded").orderBy("recorded_from", "valid_from").collect()
    t = lambda n: T0 + timedelta(n)
    assert [(g.value, g.valid_from, g.valid_to, g.recorded_from, g.recorded_to) for g in got] == [
        ("A", t(0), None, t(0), t(10)), ("A", t(0), t(10), t(10), t(20)), ("B", t(10), None, t(10), None),
        ("A", None, t(10), t(20), None), ("A", t(0), t(5), t(20), None), ("C", t(5), None, t(20), None),
    ]


def test_empty(spark):
    df = spark.createDataFrame([], "entity string, value string, previous string, raised timestamp, recorded timestamp")
    assert bitemporal_ledger(df, "entity", "value", "previous", "raised", "recorded").count() == 0


def test_identifiers(spark):
    df = spark.createDataFrame([(" z9v3-m6 AA 4", "CIK0099638426"), ("Z9", " 42 "), (None, None), ("", "none")], "a string, b string")
    got = df.select(clean_cusip(F.col("a")).alias("a"), clean_cik(F.col("b")).alias("b")).collect()
    assert [tuple(x) for x in got] == [("Z9V3M6AA4", "0099638426"), (None, "0000000042"), (None, None), (None, None)]


def test_a_straggler_leaves_the_segments_short(spark):
    import time

    n = 20_000
    rows = spark.range(n).select(
        F.lit("hot").alias("entity"), F.concat(F.lit("v"), F.col("id") % 7).alias("value"), F.concat(F.lit("v"), (F.col("id") + 6) % 7).alias("previous"),
        F.timestamp_seconds(F.col("id") * 60 + 600).alias("raised"), F.timestamp_seconds(F.col("id") * 60 + 601).alias("recorded"),
    ).unionByName(spark.createDataFrame([("hot", "w", None)], "entity string, value string, previous string").select(
        "*", F.timestamp_seconds(F.lit(1)).alias("raised"), F.timestamp_seconds(F.lit(n * 60 + 900)).alias("recorded")))
    start = time.time()
    got = bitemporal_ledger(rows, "entity", "value", "previous", "raised", "recorded", block=2000)
    now = got.filter(F.col("recorded_to").isNull())
    # v0 was told without a previous value known, so v6 came before it and the straggler ends at an unknown time
    assert now.count() == n + 2 and time.time() - start < 60
    assert {(r.value, r.valid_to) for r in now.orderBy(F.coalesce("valid_from", "valid_to")).limit(1).collect()} == {("w", None)}


def test_a_message_far_ahead_leaves_the_segments_short(spark):
    from finstrata.operators import ledger

    n = 3000
    rows = spark.range(n).select(
        F.lit("hot").alias("entity"), F.concat(F.lit("v"), F.col("id") % 7).alias("value"), F.concat(F.lit("v"), (F.col("id") + 6) % 7).alias("previous"),
        F.timestamp_seconds(F.col("id") * 60 + 600).alias("raised"), F.timestamp_seconds(F.col("id") * 60 + 601).alias("recorded"),
    ).unionByName(spark.createDataFrame([("hot", "w", "v1")], "entity string, value string, previous string").select(
        "*", F.timestamp_seconds(F.lit(n * 100)).alias("raised"), F.timestamp_seconds(F.lit(1)).alias("recorded")))
    sizes, run = [], ledger.stream_groups

    def spy(df, keys, *rest):
        sizes.extend(r["count"] for r in df.groupBy(*keys).count().collect())
        return run(df, keys, *rest)

    ledger.stream_groups = spy
    try:
        whole = bitemporal_ledger(rows, "entity", "value", "previous", "raised", "recorded", block=1 << 20)
        cut = bitemporal_ledger(rows, "entity", "value", "previous", "raised", "recorded", block=200)
        assert sorted(map(str, whole.collect())) == sorted(map(str, cut.collect()))
    finally:
        ledger.stream_groups = run
    assert sizes[0] == n + 1 and len(sizes) > 10 and max(sizes[1:]) < 3 * 200
