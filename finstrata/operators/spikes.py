"""Implausible readings in measured series.

Each series is judged by its own standard: a robust autoregression of order one on log
closes gives the innovations and their median size, the series' usual move. Candidates are
innovations far outside it; each is tested as an additive outlier (the level returns within
``max_bars``) against a level shift (it does not). Found outliers are replaced by the level
around them and the fit is repeated until nothing new is found. Stuck runs and physical
limits are separate flags.

Groups: spiked closes and the usual move are always found on the whole series. For one of more
than ``LONG`` traded bars that pass holds nothing but dates, numbers and closes; the other tests
run on chunks in time that carry ``HALO`` bars of their neighbours and get the series' usual
move. The cut of a long series follows exact bar counts per ``BUCKET_DAYS`` days.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finstrata.core.streams import stream_groups

LONG = 4096
HALO = 64
BUCKET_DAYS = 64

LIMIT, STUCK, SPIKE, HIGH = 1, 2, 4, 8


def _group_median(x: np.ndarray, gid: np.ndarray, groups: int) -> np.ndarray:
    """Median by group (lower and upper middle averaged); NaN for a group without values."""
    ok = ~np.isnan(x)
    x, gid = x[ok], gid[ok]
    order = np.lexsort((x, gid))
    x, gid = x[order], gid[order]
    n = np.bincount(gid, minlength=groups)
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    out = np.full(groups, np.nan)
    has = n > 0
    lo, hi = first[has] + (n[has] - 1) // 2, first[has] + n[has] // 2
    out[has] = (x[lo] + x[hi]) / 2
    return out


def _robust_ar(y: np.ndarray, gid: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Innovations of a Huber-weighted AR(1) by group, and their median size by group."""
    level = _group_median(y, gid, groups)
    prev = np.full(len(y), np.nan)
    same = gid[1:] == gid[:-1]
    prev[1:][same] = y[:-1][same]
    a, b = prev - level[gid], y - level[gid]
    ok = ~np.isnan(a)
    phi, e = np.ones(groups), np.where(ok, b - a, np.nan)
    for _ in range(3):
        s = _group_median(np.abs(e), gid, groups)
        w = np.where(ok, np.minimum(1.0, 3 * s[gid] / np.maximum(np.abs(e), 1e-300)), 0.0)
        w[np.isnan(w)] = 0.0
        az, bz = np.where(ok, a, 0.0), np.where(ok, b, 0.0)
        # pairs with an outlying regressor have no weight either: its innovation came the bar before
        w[1:] = np.where(same, np.minimum(w[1:], np.where(ok[:-1], w[:-1], 1.0)), w[1:])
        num, den = np.bincount(gid, w * az * bz, groups), np.bincount(gid, w * az * az, groups)
        with np.errstate(invalid="ignore", divide="ignore"):
            phi = np.clip(np.where(den > 0, num / den, 1.0), 0.9, 1.0)
        e = np.where(ok, b - phi[gid] * a, np.nan)
    return e, _group_median(np.abs(e), gid, groups)


def find_spikes(
    y: np.ndarray, gid: np.ndarray, groups: int, times: float = 10.0, max_bars: int = 3
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Additive outliers among log closes; returns flags, usual move by group, cleaned values.

    Flags only grow from fit to fit, so the loop ends, when a fit finds nothing new.
    """
    y, n = y.copy(), len(y)
    flags = np.zeros(n, dtype=bool)
    scale = np.full(groups, np.nan)
    while True:
        e, scale = _robust_ar(y, gid, groups)
        s = scale[gid]
        with np.errstate(invalid="ignore"):
            start = np.flatnonzero(np.abs(e) > 0.6 * times * s)
        found = np.zeros(n, dtype=bool)
        clean = y.copy()
        for m in range(1, max_bars + 1):
            t = start[(start >= 1) & (start + m < n)]
            t = t[gid[t - 1] == gid[t + m]]
            if not len(t):
                continue
            before, after = y[t - 1], y[t + m]
            level = (before + after) / 2
            away = np.min(np.abs(np.stack([y[t + j] - level for j in range(m)])), axis=0)
            # additive outlier: the level after is the level before; level shift: it is not
            ao = (away > times * s[t]) & (np.abs(after - before) < 0.6 * away)
            for j in range(m):
                at = t[ao] + j
                found[at] = True
                clean[at] = level[ao]
        new = found & ~flags
        if not new.any():
            break
        flags |= found
        y[found] = clean[found]
    return flags, scale, y


def _once(tbl: pa.Table, starts: np.ndarray) -> tuple[pa.Table, np.ndarray]:
    """Bars without redelivered ones, and their group; bars come sorted by date and price_id."""
    n = tbl.num_rows
    gid = np.zeros(n, dtype=np.int64)
    gid[starts] = 1
    gid = np.cumsum(gid) - 1
    ids = tbl.column("price_id").to_numpy()
    first = np.ones(n, dtype=bool)  # a redelivered bar follows the bar it repeats
    first[1:] = (ids[1:] != ids[:-1]) | (gid[1:] != gid[:-1])
    if not first.all():
        tbl, gid = tbl.filter(pa.array(first)), gid[first]
    return tbl, gid


def judge_closes(tbl: pa.Table, starts: np.ndarray, keys: list[str], times: float, max_bars: int) -> pa.Table | None:
    """Kernel for whole series of sound bars: a row without price_id with each one's usual move, and its spiked closes."""
    tbl, gid = _once(tbl, starts)
    if not tbl.num_rows:
        return None
    spike, scale, _ = find_spikes(np.log(tbl.column("close").to_numpy()), gid, int(gid[-1]) + 1, times, max_bars)
    first = np.flatnonzero(np.concatenate(([True], gid[1:] != gid[:-1])))
    at = np.flatnonzero(spike & (scale[gid] > 0))
    rows = np.concatenate([first, at])
    head = np.arange(len(rows)) < len(first)
    return pa.table({
        **{k: tbl.column(k).take(pa.array(rows)) for k in keys},
        "price_id": pa.array(tbl.column("price_id").to_numpy()[rows], pa.int64(), mask=head), "move": pa.array(scale[gid[rows]], pa.float64()),
    })


def judge_bars(tbl: pa.Table, starts: np.ndarray, times: float, max_bars: int, min_run: int) -> pa.Table | None:
    """Kernel: flags of the home bars of each chunk; where bars bring their series' usual move, all but spiked closes."""
    tbl, gid = _once(tbl, starts)
    n, ids = tbl.num_rows, tbl.column("price_id").to_numpy()
    groups = int(gid[-1]) + 1 if n else 0
    num = lambda c: tbl.column(c).to_numpy(zero_copy_only=False).astype(float)
    o, h, lo, c, v = (num(k) for k in ("open", "high", "low", "close", "volume"))
    out = np.zeros(n, dtype=np.int32)
    with np.errstate(invalid="ignore", divide="ignore"):
        limit = (np.fmin(np.fmin(o, h), np.fmin(lo, c)) <= 0) | (h < lo) | (o < lo) | (o > h) | (c < lo) | (c > h)
        out[limit & ~(v == 0)] |= LIMIT
        traded = (v > 0) & ~np.isnan(c)

        at = np.flatnonzero(traded)
        if len(at):
            g, x = gid[at], c[at]
            new = np.ones(len(at), dtype=bool)
            new[1:] = (g[1:] != g[:-1]) | (x[1:] != x[:-1])
            run = np.cumsum(new) - 1
            long = np.bincount(run)[run] >= min_run
            out[at[long & ~new]] |= STUCK

        at = np.flatnonzero(traded & ~limit & (c > 0))
        if len(at):
            g, y = gid[at], np.log(c[at])
            if "move" in tbl.column_names:
                spike, s = np.zeros(len(at), dtype=bool), num("move")[at]
            else:
                spike, scale, _ = find_spikes(y, g, groups, times, max_bars)
                s = scale[g]
            out[at[spike]] |= SPIKE
            top = np.fmax(np.log(o[at]), y)
            out[at[(np.log(h[at]) - top > times * s) & (s > 0)]] |= HIGH
            out[at[spike & ~(s > 0)]] &= ~SPIKE
    keep = (out > 0) & tbl.column("home").to_numpy(zero_copy_only=False)
    if not keep.any():
        return None
    return pa.table({"price_id": ids[keep], "flags": out[keep]})


def flag_bars(
    bars: DataFrame,
    series: list[str] = ("common_stock_id", "listed_ticker"),
    times: float = 10.0,
    max_bars: int = 3,
    min_run: int = 6,
    long: int = LONG,
    halo: int = HALO,
) -> DataFrame:
    """(price_id, flags): 1 impossible prices, 2 stuck run, 4 spiked close, 8 spiked high.

    Rows without price_id or bar_date are no bars; a null in a series column is a value of
    its own; a null price or volume makes the tests that need it false. A repeated price_id
    counts once. Extra columns are ignored. Bars of volume 0 are never flagged.
    """
    series = list(series)
    rows = bars.select(
        *[F.coalesce(F.col(s).cast("string"), F.lit("\u0000")).alias(f"s{i}") for i, s in enumerate(series)],
        "price_id", F.col("bar_date"), *[F.col(k).cast("double").alias(k) for k in ("open", "high", "low", "close")],
        F.col("volume").cast("double").alias("volume"),
    ).filter(F.col("price_id").isNotNull() & F.col("bar_date").isNotNull())
    keys = [f"s{i}" for i in range(len(series))]
    rows = rows.withColumn("bucket", F.floor(F.date_diff("bar_date", F.lit("1970-01-01")) / BUCKET_DAYS).cast("int"))
    traded = F.col("volume") > 0
    heavy = rows.groupBy(*keys).agg(F.count_if(traded).alias("n")).filter(F.col("n") > long).select(*keys)
    kernel = lambda tbl, starts: judge_bars(tbl, starts, times, max_bars, min_run)
    judge = lambda df, by: stream_groups(df.drop("bucket"), by, ["bar_date", "price_id"], kernel, "price_id bigint, flags int")
    if heavy.isEmpty():
        return judge(rows.withColumn("home", F.lit(True)), keys)
    counts = rows.groupBy(*keys, "bucket").agg(F.count_if(traded).alias("n"))
    w = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    chunk = lambda c: F.floor(F.greatest(c, F.lit(0)) / long).cast("int")
    before = F.coalesce(F.sum("n").over(w), F.lit(0))
    plan = (
        counts.join(heavy, keys, "left_semi")
        .withColumn("before", before)
        .withColumn("mine", chunk(F.col("before")))
        .withColumn("pad", halo + F.max("n").over(Window.partitionBy(*keys)))
        .withColumn("chunk", F.explode(F.sequence(chunk(F.col("before") - F.col("pad")), chunk(F.col("before") + F.col("n") + F.col("pad")))))
        .select(*keys, "bucket", "chunk", (F.col("chunk") == F.col("mine")).alias("home"))
    )
    largest, o, h, lo, c = rows.join(heavy, keys, "left_semi"), *[F.nanvl(F.col(k), F.lit(None).cast("double")) for k in ("open", "high", "low", "close")]
    limit = (F.least(o, h, lo, c) <= 0, h < lo, o < lo, o > h, c < lo, c > h)
    sound = largest.filter(traded & (c > 0))
    for wrong in limit:
        sound = sound.filter(~F.coalesce(wrong, F.lit(False)))
    whole = lambda tbl, starts: judge_closes(tbl, starts, keys, times, max_bars)
    schema = ", ".join([*[f"{k} string" for k in keys], "price_id bigint", "move double"])
    closes = stream_groups(sound.select(*keys, "bar_date", "price_id", "close"), keys, ["bar_date", "price_id"], whole, schema).persist()
    moves = closes.filter(F.col("price_id").isNull()).select(*keys, "move")
    parts = largest.join(plan, [*keys, "bucket"]).join(moves, keys, "left")
    spiked = closes.filter(F.col("price_id").isNotNull()).select("price_id", F.lit(SPIKE).alias("flags"))
    long_ones = judge(parts, [*keys, "chunk"]).unionByName(spiked).groupBy("price_id").agg(F.bit_or("flags").alias("flags"))
    return judge(rows.join(heavy, keys, "left_anti").withColumn("home", F.lit(True)), keys).unionByName(long_ones)
