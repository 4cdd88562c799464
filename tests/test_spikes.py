from datetime import date, timedelta

import numpy as np
import pytest

from finstrata.operators.spikes import HIGH, LIMIT, SPIKE, STUCK, flag_bars

SCHEMA = "price_id long, common_stock_id long, listed_ticker string, bar_date date, open double, high double, low double, close double, volume long, extra string"


def _series(n, seed, stock=1, ticker="T", first=0, move=0.01):
    r = np.random.default_rng(seed)
    c = 100 * np.exp(np.cumsum(r.normal(0, move, n)))
    return [[first + i, stock, ticker, date(2015, 1, 1) + timedelta(i), x, x * 1.004, x * 0.996, x, 1000, "e"] for i, x in enumerate(c.round(4).tolist())]


def _set_close(row, x):
    row[4:8] = [x, x * 1.001, x * 0.999, x]


def _flags(spark, rows, **kw):
    return {r.price_id: r.flags for r in flag_bars(spark.createDataFrame([tuple(x) for x in rows], SCHEMA), **kw).collect()}


@pytest.fixture(scope="module")
def planted():
    rows, want = _series(400, 3), {}
    for at, n in ((50, 1), (90, 2), (130, 3)):
        for i in range(at, at + n):
            _set_close(rows[i], rows[i][7] * 1.6)
            want[i] = SPIKE
    for i in range(200, 204):  # four bars away are too many
        _set_close(rows[i], rows[i][7] * 1.6)
    for i in range(260, 400):  # a move that lasts
        _set_close(rows[i], rows[i][7] * 1.5)
    rows[300][5] = rows[300][7] * 1.5
    want[300] = HIGH
    rows[310][6] = rows[310][5] + 1
    rows[311][7] = 0.0
    want[310] = want[311] = LIMIT
    for i in range(330, 337):
        _set_close(rows[i], 77.0 * rows[329][7] / 77.0)
    for i in range(330, 337):
        want[i] = STUCK
    _set_close(rows[329], rows[330][7])
    rows[345][8] = 0
    rows[345][7] = 9999.0
    return rows, want


def test_planted_faults(spark, planted):
    rows, want = planted
    assert _flags(spark, rows) == want


def test_long_series_is_cut_without_a_trace(spark, planted):
    rows, want = planted
    assert _flags(spark, rows, long=150, halo=32) == want


def test_repeats_nulls_and_order_change_nothing(spark, planted):
    rows, want = planted
    more = rows + rows[40:140] + [[None, 1, "T", date(2015, 2, 2), 1.0, 1.0, 1.0, 1.0, 1, None], [9001, 1, "T", None, 1.0, 1.0, 1.0, 1.0, 1, None]]
    other = [[5000 + i, 2, None, date(2015, 1, 1) + timedelta(i), None, None, None, None, None, None] for i in range(10)]
    assert _flags(spark, more[::-1] + other) == want


def test_empty_and_tiny(spark):
    assert _flags(spark, []) == {}
    assert _flags(spark, _series(1, 1)) == {}
    assert _flags(spark, _series(2, 1)) == {}
    flat = _series(5, 1)
    for r in flat:
        _set_close(r, 5.0)
    assert _flags(spark, flat) == {}


def test_long_series_is_judged_by_its_own_usual_move(spark):
    rows = _series(600, 5)
    for i, x in enumerate(np.exp(np.cumsum(np.random.default_rng(6).normal(0, np.where(np.arange(600) < 150, 0.0005, 0.02)))) * 100):
        _set_close(rows[i], round(float(x), 4))
    for at, by in ((60, 1.05), (120, 1.5), (400, 1.05), (500, 1.5)):
        _set_close(rows[at], rows[at][7] * by)
    rows[90][5] *= 1.05
    rows[450][5] *= 1.5
    other = _series(100, 7, stock=2, first=5000)
    _set_close(other[50], other[50][7] * 1.5)
    whole = _flags(spark, rows + other)
    assert whole[120] == whole[500] == whole[5050] == SPIKE and whole[450] == HIGH and 60 not in whole
    assert _flags(spark, rows + other, long=150, halo=32) == whole
