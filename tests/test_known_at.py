import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from finstrata.operators.known_at import dyadic_nodes, join_as_known, known_intervals

D0 = date(2020, 1, 1)


def _brute(events, facts):
    out = set()
    for e, k, t in events:
        if t is None or k is None:
            continue
        best = {}
        for f, fk, member, as_of, filed in facts:
            if fk == k and member is not None and filed is not None and filed <= t:
                rank = (as_of or date.min, filed, -f)
                if member not in best or rank > best[member][0]:
                    best[member] = (rank, f)
        out |= {(e, f) for _, f in best.values()}
    return out


def test_matches_brute_force(spark):
    r = random.Random(1)
    day = lambda n: D0 + timedelta(r.randrange(n))
    facts = [(i, r.choice([1, 1, 1, 2, None]), r.choice(["a", "b", None]), r.choice([day(400), None]), r.choice([day(400), day(400), None])) for i in range(200)]
    facts += facts[:20]
    events = [(i, r.choice([1, 1, 2, 3, None]), r.choice([day(600), day(600), None, date(1990, 1, 1), date(2090, 1, 1)])) for i in range(150)]
    f = spark.createDataFrame(facts, "fact_id long, k long, member string, as_of date, filed date").withColumn("from_day", F.lit("x")).withColumn("best", F.lit(1))
    e = spark.createDataFrame(events, "e long, k long, t date").withColumn("fact_id", F.lit(-1)).withColumn("_day", F.lit("clash"))
    iv = known_intervals(f, ["k", "member"], "filed", [F.col("as_of"), F.col("filed")], "fact_id")
    got = {(x.e, x.fact_id) for x in join_as_known(e, "t", ["k"], iv, ["fact_id"]).select("e", "fact_id").collect()}
    assert got == _brute(events, facts)


def test_empty_sides(spark):
    f = spark.createDataFrame([], "fact_id long, k long, as_of date, filed date")
    e = spark.createDataFrame([(1, 1, D0)], "e long, k long, t date")
    iv = known_intervals(f, ["k"], "filed", [F.col("as_of")], "fact_id")
    assert join_as_known(e, "t", ["k"], iv, ["fact_id"]).count() == 0
    one = spark.createDataFrame([(7, 1, D0, D0)], f.schema)
    iv = known_intervals(one, ["k"], "filed", [F.col("as_of")], "fact_id")
    assert join_as_known(e.limit(0), "t", ["k"], iv, ["fact_id"]).count() == 0
    assert [x.fact_id for x in join_as_known(e, "t", ["k"], iv, ["fact_id"]).collect()] == [7]


def test_nodes_cover_exactly(spark):
    rows = [(a, b) for a in range(0, 17) for b in range(a + 1, 17)]
    df = spark.createDataFrame(rows, "a int, b int").select("a", "b", dyadic_nodes(F.col("a"), F.col("b"), 4).alias("n"))
    for x in df.collect():
        days = sorted(d for n in x.n for d in range(n.node << n.level, (n.node + 1) << n.level))
        assert days == list(range(x.a, x.b))
        assert len(x.n) <= 2 * 5
