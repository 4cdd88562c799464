"""Bitemporal history of changing attributes.

Messages say what an attribute became and when (valid time); they arrive later and out of
order (recorded time). The ledger holds every version ever believed, with both periods: a
late message splits or supersedes versions by closing their recorded period and opening
others; nothing is overwritten. The versions believed now are those whose recorded period
is open.

A sweep goes over an entity's messages in the order they were recorded and keeps the
timeline sorted by valid time, so a message touches only its neighbours. To keep tasks small,
an entity's time is cut into segments that are swept apart. Cuts are messages that were the
newest when they were recorded: nothing on a cut's far side was known before it, so a segment
needs, besides its own messages, only those between the cut that begins it and the newest
message known then, and those from the cut that ends it up to the next newest message that
changes the value. Messages that come late fall in the segment of their valid time and leave
the cuts where they are. Messages far ahead of those recorded after them are no cuts; they are
carried through the segments that they are ahead of, each of which tells of them for its time. Repeats that can never matter (the message right before them in valid
time says the same and was known before) are dropped first. A segment holds about ``BLOCK``
messages and the late ones that fall in its time.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finstrata.core.scans import chunked_scan
from finstrata.core.streams import stream_groups
from finstrata.core.tables import checkpoint_dir

BLOCK = 2048
LONG = 100_000  # messages of an entity up to which plain windows serve
CHUNK = 28 * 86_400 * 1_000_000  # microseconds of time that a scan handles in one task
EVER = 1 << 61  # later than any time
NONE = -(1 << 62)  # an unknown time
OPEN = NONE + 1  # not ended yet

_EVENTS = "value string, valid_from bigint, valid_to bigint, at bigint, seq bigint, opens boolean"


class _Timeline:
    """Messages of one entity in order of valid time, and the versions they imply."""

    def __init__(self, times: list[int], values: list[str], previous: list[str | None]):
        self.times, self.values, self.previous = times, values, previous

    def _starts(self, i: int) -> bool:
        """Whether a message changes anything: a repeat does if its previous value tells of a lost one."""
        return i == 0 or self.values[i] != self.values[i - 1] or self.previous[i] not in (None, self.values[i - 1])

    def versions(self, lo: int, hi: int, home: dict[int, tuple[int, int]], at: int) -> set[tuple[str, int, int]]:
        """Rows (value, from, to) of the versions that start with one of the messages lo to hi that are told of at this time."""
        out, n = set(), len(self.times)
        for k in range(lo, min(hi + 1, n)):
            since, until = home.get(self.times[k], (1, 0))
            if not since <= at < until or not self._starts(k):
                continue
            lost = self.previous[k]
            if lost is not None and lost != (self.values[k - 1] if k else None):
                out.add((lost, NONE, self.times[k]))
            e = k + 1
            while e < n and not self._starts(e):
                e += 1
            to = OPEN
            if e < n:
                to = self.times[e] if self.previous[e] in (None, self.values[k]) else NONE
            out.add((self.values[k], self.times[k], to))
        return out

    def add(self, time: int, value: str, previous: str | None, home: dict, recorded: int) -> tuple[set, set]:
        """Versions that end and begin to be believed."""
        at = bisect_left(self.times, time)
        a = max(at - 1, 0)
        while a > 0 and not self._starts(a):
            a -= 1
        old = self.versions(a, at, home, recorded)
        self.times.insert(at, time)
        self.values.insert(at, value)
        self.previous.insert(at, previous)
        new = self.versions(a, at + 1, home, recorded)
        return old - new, new - old


def _sweep(tbl: pa.Table, starts: np.ndarray) -> pa.Table | None:
    """Kernel: belief events of segments; rows come in the order they were recorded."""
    raised, recorded = tbl.column("raised").to_numpy(), tbl.column("recorded").to_numpy()
    value, previous = tbl.column("value").to_pylist(), tbl.column("previous").to_pylist()
    lo, hi, entity = tbl.column("lo").to_numpy(), tbl.column("hi").to_numpy(), tbl.column("entity")
    ends = np.append(starts[1:], tbl.num_rows)
    rows: list[tuple] = []
    index: list[int] = []
    for a, b in zip(starts.tolist(), ends.tolist()):
        line, home = _Timeline([], [], []), dict(zip(raised[a:b].tolist(), zip(lo[a:b].tolist(), hi[a:b].tolist())))
        for i in range(a, b):
            gone, come = line.add(int(raised[i]), value[i], previous[i], home, int(recorded[i]))
            for opens, which in ((False, gone), (True, come)):
                for v, f, t in sorted(which):
                    rows.append((v, f, t, int(recorded[i]), len(rows), opens))
                    index.append(a)
    if not rows:
        return None
    cols = list(zip(*rows))
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    names = ["value", "valid_from", "valid_to", "at", "seq", "opens"]
    out = {"entity": entity.take(pa.array(index)).combine_chunks()}
    return pa.table(out | {k: pa.array(list(c), t) for k, c, t in zip(names, cols, types)})


def bitemporal_ledger(
    messages: DataFrame, entity: str, value: str, previous: str | None, raised: str, recorded: str, block: int = BLOCK, long: int = LONG
) -> DataFrame:
    """(entity, value, valid_from, valid_to, from_known, is_open, recorded_from, recorded_to).

    valid_from and valid_to are null where the time is unknown; ``is_open`` marks versions
    still valid; recorded_to is null for what is believed now. ``entity`` must be bigint or
    string. Messages that are null in entity, value or raised say nothing and are left out;
    a null recorded time counts as the raised time. Messages of one entity and raised time
    count once: the first recorded, with the greatest value if several were told.
    """
    micros = lambda *c: F.unix_micros(F.coalesce(*c).cast("timestamp"))
    said = messages.select(
        F.col(entity).alias("entity"), F.col(value).alias("value"),
        (F.col(previous) if previous else F.lit(None).cast("string")).alias("previous"),
        micros(raised).alias("raised"), micros(recorded, raised).alias("recorded"),
    ).filter(F.col("entity").isNotNull() & F.col("value").isNotNull() & F.col("raised").isNotNull())
    once = (
        said.groupBy("entity", "raised", "value").agg(F.max("previous").alias("previous"), F.min("recorded").alias("recorded"))
        .groupBy("entity", "raised").agg(F.max(F.struct("value", "previous", "recorded")).alias("m"))
        .select("entity", "raised", "m.*")
    )
    most = once.groupBy("entity").count().agg(F.max("count")).first()[0] or 0
    hot = most > long  # an entity too long for one task: cut its windows into chunks of time
    bucket = lambda c: F.floor(F.col(c) / CHUNK) if hot else None
    by_valid = (["entity"], bucket("raised"), ["raised"])
    by_record = (["entity"], bucket("recorded"), ["recorded", "raised"])
    told = lambda c: F.col("previous").isNotNull() & (F.col("previous") != c)
    saved = lambda df: df.checkpoint() if hot else df  # noqa: E731  # a scan in chunks reads its input twice
    if hot:
        checkpoint_dir(messages.sparkSession)
    p = F.col("p")
    needless = F.coalesce((p["value"] == F.col("value")) & ~told(p["value"]) & (p["recorded"] <= F.col("recorded")), F.lit(False))
    kept = saved(chunked_scan(once, *by_valid, {"p": ("previous", F.struct("value", "recorded"))})).filter(~needless).drop("p")
    # ahead: valid after half of the messages that were recorded a block later; any choice is right, this one keeps cuts
    many = most > 2 * block
    if many:
        numbered = saved(chunked_scan(kept, *by_record, {"n": ("count_before", "raised")}).withColumn("n", F.floor(F.col("n") / block)))
        middle = numbered.groupBy("entity", "n").agg(F.percentile_approx("raised", 0.5).alias("middle")).withColumn("n", F.col("n") - 2)
        kept = numbered.join(middle, ["entity", "n"], "left").withColumn("ahead", F.coalesce(F.col("raised") > F.col("middle"), F.lit(False))).drop("n", "middle")
    else:
        kept = kept.withColumn("ahead", F.lit(False))
    newest = ~F.col("ahead") & (F.col("newest").isNull() | (F.col("newest") < F.col("raised")))
    seen = chunked_scan(saved(kept), *by_record, {"newest": ("max_before", F.when(~F.col("ahead"), F.col("raised")))}).withColumn("cut", newest).drop("newest")
    ranked = chunked_scan(saved(seen), *by_valid, {
        "rank": ("sum_upto", F.col("cut").cast("bigint")), "line": ("max_before", F.when(F.col("cut"), F.struct("raised", "value"))),
    })
    line = F.col("line")["value"]
    change = F.col("cut") & (line.isNull() | (line != F.col("value")) | told(F.col("value")))
    ranked = ranked.withColumns({"rank": F.greatest(F.col("rank") - 1, F.lit(0)), "change": change}).drop("line")
    placed = chunked_scan(saved(ranked), *by_valid, {"changed": ("max_before", F.when(F.col("change"), F.col("rank")))})
    # a message's own segment, the next one if it lies right before its cut, and those that end at a cut with no change since
    own = F.floor(F.col("rank") / block)
    since = F.greatest(F.ceil(F.coalesce(F.col("changed"), F.lit(0)) / block), F.lit(1)) - 1
    earlier = F.when(since < own, F.sequence(since, own - 1)).otherwise(F.array().cast("array<bigint>"))
    later = F.when(F.col("rank") % block == block - 1, F.array(own + 1)).otherwise(F.array().cast("array<bigint>"))
    parts = F.concat(F.array(own), earlier, later)
    lo, hi = F.lit(EVER), F.lit(-EVER)
    if many:
        # a message ahead goes to all segments before its own from the one of its time on
        placed = saved(chunked_scan(saved(placed), *by_record, {"told": ("max_before", F.when(F.col("change"), F.col("rank")))}))
        then = F.greatest(F.ceil(F.coalesce(F.col("told"), F.lit(0)) / block), F.lit(1)) - 1
        parts = F.array_distinct(F.concat(parts, F.when(F.col("ahead") & (then < own), F.sequence(then, own - 1)).otherwise(F.array().cast("array<bigint>"))))
    blocks = placed.withColumn("own", own).withColumn("block", F.explode(parts))
    mine = F.col("block") == F.col("own")
    if many:
        cuts = placed.filter(F.col("cut") & (F.col("rank") > 0) & (F.col("rank") % block == 0)).select("entity", F.floor(F.col("rank") / block).alias("block"), F.col("recorded").alias("begins"))
        ends = cuts.select("entity", (F.col("block") - 1).alias("block"), F.col("begins").alias("ends"))
        blocks = blocks.join(cuts, ["entity", "block"], "left").join(ends, ["entity", "block"], "left")
        begins = F.coalesce("begins", F.lit(-EVER))
        carried = F.col("ahead") & (F.col("block") < F.col("own")) & (F.col("recorded") < F.col("ends"))
        lo, hi = F.when((mine & F.col("ahead")) | carried, begins).otherwise(lo), F.when(carried, F.col("ends")).otherwise(hi)
    lo, hi = F.when(mine & ~F.col("ahead"), -EVER).otherwise(lo), F.when(mine, EVER).otherwise(hi)
    kind = dict(blocks.dtypes)["entity"]
    events = stream_groups(
        blocks.select("entity", "block", "value", "previous", "raised", "recorded", lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi")),
        ["entity", "block"], ["recorded", "raised"], _sweep, f"entity {kind}, {_EVENTS}",
    )
    pair = Window.partitionBy("entity", "value", "valid_from", "valid_to").orderBy("at", "seq")
    stamp = lambda c: F.timestamp_micros(c)
    known = lambda c: F.when(F.col(c) > OPEN, stamp(F.col(c)))
    return (
        events.withColumn("until", F.lead("at").over(pair))
        .filter(F.col("opens") & (F.col("until").isNull() | (F.col("until") > F.col("at"))))
        .select(
            F.col("entity").alias(entity), "value", known("valid_from").alias("valid_from"),
            known("valid_to").alias("valid_to"), (F.col("valid_to") == OPEN).alias("is_open"),
            stamp(F.col("at")).alias("recorded_from"), stamp(F.col("until")).alias("recorded_to"),
        )
    )


def clean_cusip(c):
    """Nine capital letters and digits, or null."""
    plain = F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")
    return F.when(F.length(plain) == 9, plain)


def clean_cik(c):
    """Ten digits, or null when there are none or more than ten that count."""
    digits = F.regexp_replace(F.regexp_replace(c, "[^0-9]", ""), "^0+", "")
    return F.when((F.length(digits) > 0) & (F.length(digits) <= 10), F.lpad(digits, 10, "0"))
