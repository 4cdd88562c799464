"""Running vectorised kernels over whole groups without one Python call per group.

``stream_groups`` shuffles by the grouping keys, sorts inside each partition and hands
the kernel Arrow tables that hold complete groups, many at a time. Memory is bounded by
one Arrow batch plus the largest single group, so callers split hot groups first (by time
chunk, shard or block) and pass the split as one of the keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame

#: Rows that are gathered before the kernel runs, so that small groups share one call.
ROWS_PER_CALL = 50_000


def _plain(col: pa.ChunkedArray) -> np.ndarray:
    if pa.types.is_dictionary(col.type):
        col = col.cast(col.type.value_type)
    return col.to_numpy(zero_copy_only=False)


def group_starts(tbl: pa.Table, keys: list[str]) -> np.ndarray:
    """Positions at which a new group begins in a table that is sorted by ``keys``."""
    n = tbl.num_rows
    new = np.zeros(n, dtype=bool)
    if n:
        new[0] = True
    for k in keys:
        col = tbl.column(k).combine_chunks() if n else tbl.column(k)
        if n > 1:
            a, b = col.slice(0, n - 1), col.slice(1)
            differs = pc.or_kleene(
                pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b))
            )
            new[1:] |= np.asarray(differs.to_numpy(zero_copy_only=False), dtype=bool)
    return np.flatnonzero(new)


def _last_group_start(tbl: pa.Table, keys: list[str]) -> int:
    starts = group_starts(tbl, keys)
    return int(starts[-1]) if len(starts) else 0


def complete_groups(
    batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = ROWS_PER_CALL
) -> Iterator[pa.Table]:
    """Tables of whole groups from a stream of batches sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        tbl = pa.Table.from_batches(held)
        cut = _last_group_start(tbl, keys)
        if cut:
            yield tbl.slice(0, cut).combine_chunks()
            held = tbl.slice(cut).combine_chunks().to_batches()
            n = tbl.num_rows - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def stream_groups(
    df: DataFrame,
    keys: list[str],
    order: list[str | Column],
    kernel: Callable[[pa.Table, np.ndarray], pa.Table | None],
    schema: str,
    rows: int = ROWS_PER_CALL,
) -> DataFrame:
    """``kernel(table, group starts) -> table`` over all groups of ``df``.

    A kernel may return None for no rows. Its columns must come in the order of ``schema``.
    """
    shuffled = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tbl in complete_groups(batches, keys, rows):
            out = kernel(tbl, group_starts(tbl, keys))
            if out is not None and out.num_rows:
                yield from out.combine_chunks().to_batches()

    return shuffled.mapInArrow(run, schema)
