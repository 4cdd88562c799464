"""Queries that cover every key, not a chosen few."""

import math

from finstrata.plans import registry


def _run(spark, d, name):
    return registry.queries()[name](spark, d).collect()


def test_clone_chain_of_every_holder(spark, small):
    from finstrata.core.tables import table

    rows = _run(spark, small, "win_clone_chain")
    holders = table(spark, small, "institutional_holding").filter("filing_type = 'Form13F' AND value > 0").groupBy("institutional_holder_id").agg({"report_date": "max"})
    assert len({r.institutional_holder_id for r in rows}) > 0.5 * holders.count()
    for h in {r.institutional_holder_id for r in rows}:
        mine = sorted((r for r in rows if r.institutional_holder_id == h), key=lambda r: r.report_date)
        for i, r in enumerate(mine):
            assert math.isclose(r.chained, math.prod(x.growth for x in mine[: i + 1]), rel_tol=1e-4)


def test_pivot_of_every_stock_by_its_own_newest_years(spark, small):
    rows = _run(spark, small, "win_pivot_newest")
    assert len({r.common_stock_id for r in rows}) > 1
    assert all(r.year1 > (r.year2 or 0) >= (r.year3 or 0) for r in rows)


def test_joins_of_every_stock_and_holder(spark, small):
    latest = _run(spark, small, "join_latest_per_position")
    assert len({r.common_stock_id for r in latest}) > 1
    both = _run(spark, small, "join_full_outer_positions")
    assert len({r.institutional_holder_id for r in both}) > 1
    assert len({(r.institutional_holder_id, r.common_stock_id) for r in both}) == len(both)


def test_daily_clones_end_where_the_chain_does(spark, small):
    marks = _run(spark, small, "win_clone_daily")
    chain = _run(spark, small, "win_clone_chain")
    assert len({r.institutional_holder_id for r in marks}) >= len({r.institutional_holder_id for r in chain})
    assert len({(r.institutional_holder_id, r.day) for r in marks}) == len(marks) and all(r.mark > 0 for r in marks)


def test_overlaps_of_every_stock(spark, tmp_path):
    rows = [(1, "0000000011"), (1, "0000000012"), (50, "12"), (60, "0000000099"), (70, "99"), (80, "0000000077")]
    spark.createDataFrame(rows, "common_stock_id long, cik string").write.parquet(f"{tmp_path}/stock_secondary_cik_attached.parquet")
    got = {(r.searched_id, r.common_stock_id) for r in _run(spark, str(tmp_path), "pred_array_overlap_all")}
    assert got == {(1, 1), (1, 50), (50, 1), (50, 50), (60, 60), (60, 70), (70, 60), (70, 70), (80, 80)}
