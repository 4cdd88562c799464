"""Filling containers of fixed capacity with texts.

Bounded-space online packing: each partition keeps a fixed number of open containers, puts each
item into the one it leaves least room in (best fit), and emits the fullest when it fits none.
The open ones left at the end of each partition are merged in a second step, many partitions'
leftovers to a task. Items are never split unless longer than a container; such texts are cut
into full pieces and a remainder that is packed like any item.

One pass over the texts: after it only ids and sizes move.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
OPEN = 64
#: Partitions whose leftovers one task merges.
MERGED = 32

_ITEMS = "array<struct<doc_id:bigint,part:int,n_tokens:int,first_token:int>>"
_ITEM = pa.struct([("doc_id", pa.int64()), ("part", pa.int32()), ("n_tokens", pa.int32()), ("first_token", pa.int32())])

_encoders: dict[tuple, object] = {}


def encoder(path: str, pattern: str | None = None):
    """A byte-level BPE from a rank file, with the pattern that cuts text before it; loaded once in each Python worker.

    Without a pattern it is the one that comes with the public tokenizers' files.
    """
    if (path, pattern) not in _encoders:
        import tiktoken

        if pattern is None:
            from public_tokenizers import PATTERN as cut
        else:
            cut = pattern
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path, pattern] = tiktoken.Encoding("own", pat_str=cut, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path, pattern]


class Packer:
    """Best fit over at most ``space`` open containers."""

    def __init__(self, capacity: int, space: int):
        self.capacity, self.space = capacity, space
        self.rooms: list[tuple[int, int]] = []  # (room left, number), sorted
        self.open: dict[int, list] = {}
        self.next = 0

    def put(self, size: int, items: list) -> tuple[int, list] | None:
        """Places items of a joint size; returns (room, items) of a container this closed."""
        closed = None
        at = bisect.bisect_left(self.rooms, (size, -1))
        if at < len(self.rooms):
            room, k = self.rooms.pop(at)
        else:
            if len(self.rooms) >= self.space:
                room, k = self.rooms.pop(0)
                closed = (room, self.open.pop(k))
            k, room = self.next, self.capacity
            self.next += 1
            self.open[k] = []
        self.open[k] += items
        if room == size and closed is None:
            return 0, self.open.pop(k)
        bisect.insort(self.rooms, (room - size, k))
        return closed

    def rest(self) -> Iterator[tuple[int, list]]:
        for room, k in self.rooms:
            yield room, self.open[k]


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, open_containers: int = OPEN,
    doc_id: str = "doc_id", text: str = "text", pattern: str | None = None,
) -> DataFrame:
    """(container_id, doc_id, part, n_tokens, first_token): each text's place.

    Texts are packed whole, ``part`` 0, unless longer than ``capacity``. An empty text has no
    tokens and a place in some container; a null text or id has none. Repeated rows are packed as
    often as they come. ``container_id`` is unique but not dense.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(tokenizer, pattern)
        packer, me = Packer(capacity, open_containers), TaskContext.get().partitionId()
        group, n, out = me // MERGED, 0, []

        def flush() -> pa.RecordBatch:
            rows = [(me * (1 << 32) + n + i, room, done, group, items) for i, (room, done, items) in enumerate(out)]
            cols = list(zip(*rows))
            return pa.record_batch({
                "cid": pa.array(cols[0], pa.int64()), "room": pa.array(cols[1], pa.int32()), "done": pa.array(cols[2], pa.bool_()),
                "grp": pa.array(cols[3], pa.int32()), "items": pa.array(cols[4], pa.list_(_ITEM)),
            })

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, t in zip(ids, texts):
                size, at, part = len(enc.encode_ordinary(t)), 0, 0
                while size > capacity:
                    out.append((0, True, [{"doc_id": i, "part": part, "n_tokens": capacity, "first_token": at}]))
                    size, at, part = size - capacity, at + capacity, part + 1
                full = packer.put(size, [{"doc_id": i, "part": part, "n_tokens": size, "first_token": at}])
                if full is not None:
                    out.append((full[0], True, full[1]))
            if len(out) >= 1000:
                yield flush()
                n, out = n + len(out), []
        out += [(room, False, items) for room, items in packer.rest()]
        if out:
            yield flush()

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packers: dict[int, Packer] = {}
        ids: dict[int, int] = {}

        def rows(pairs) -> pa.RecordBatch:
            flat = [(c, x) for c, items in pairs for x in items]
            return pa.record_batch({
                "container_id": pa.array([c for c, _ in flat], pa.int64()), "doc_id": pa.array([x["doc_id"] for _, x in flat], pa.int64()),
                "part": pa.array([x["part"] for _, x in flat], pa.int32()), "n_tokens": pa.array([x["n_tokens"] for _, x in flat], pa.int32()),
                "first_token": pa.array([x["first_token"] for _, x in flat], pa.int32()),
            })

        for batch in batches:
            pairs = []
            for r in batch.to_pylist():
                if r["done"]:
                    pairs.append((r["cid"], r["items"]))
                    continue
                items = [x | {"cid": r["cid"]} for x in r["items"]]
                packer = packers.setdefault(r["grp"], Packer(capacity, 1 << 30))
                full = packer.put(capacity - r["room"], items)
                if full is not None:
                    pairs.append((full[1][0]["cid"], full[1]))
            if pairs:
                yield rows(pairs)
        pairs = [(items[0]["cid"], items) for p in packers.values() for _, items in p.rest() if items]
        if pairs:
            yield rows(pairs)

    rows = docs.select(F.col(doc_id).cast("bigint").alias("d"), F.col(text).alias("t")).filter(F.col("d").isNotNull() & F.col("t").isNotNull())
    filled = rows.mapInArrow(first, f"cid bigint, room int, done boolean, grp int, items {_ITEMS}")
    spread = F.when(F.col("done"), F.xxhash64("cid")).otherwise(F.xxhash64("grp"))
    # the leftovers with least room first: the large ones are placed while there is most choice
    merged = filled.repartition(spread).sortWithinPartitions("room")
    return merged.mapInArrow(second, "container_id bigint, doc_id bigint, part int, n_tokens int, first_token int")


def packing_report(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: documents, containers, tokens, the fullest container, texts split without need, and share filled."""
    boxes = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("fill"))
    docs = placed.groupBy("doc_id").agg(F.sum("n_tokens").alias("size"), F.max("part").alias("last"), F.count("*").alias("parts"))
    split = (F.col("parts") > 1) & (F.col("size") <= capacity)
    whole = docs.agg(F.count("*").alias("documents"), F.sum("size").alias("tokens"), F.count_if(split).alias("split_without_need"))
    full = boxes.agg(F.count("*").alias("containers"), F.max("fill").alias("fullest"))
    return whole.crossJoin(full).withColumn("filled", F.col("tokens") / (F.col("containers") * capacity))
