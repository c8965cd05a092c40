"""Vectorised work over whole sorted groups, many groups per call."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _differs(column: pa.ChunkedArray) -> np.ndarray:
    """For rows 1..n-1: does the key differ from the row before? Two nulls are the same key."""
    here, before = column.slice(1), column.slice(0, len(column) - 1)
    unequal = pc.fill_null(pc.not_equal(here, before), True)
    both = pc.and_(pc.is_null(here), pc.is_null(before))
    return pc.and_(unequal, pc.invert(both)).to_numpy(zero_copy_only=False)


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which a new group begins, in a table sorted by its keys."""
    if table.num_rows == 0:
        return np.zeros(0, np.int64)
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    if table.num_rows > 1:
        for key in keys:
            new[1:] |= _differs(table[key])
    return np.flatnonzero(new)


def floats(table: pa.Table, name: str) -> np.ndarray:
    """A numeric column as float64 with NaN for null."""
    return pc.fill_null(table[name].cast(pa.float64()), np.nan).to_numpy()


def longs(table: pa.Table, name: str, null: int = -1) -> np.ndarray:
    return pc.fill_null(table[name].cast(pa.int64()), null).to_numpy()


def map_sorted_groups(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    fn: Callable[[pa.Table, np.ndarray], pa.Table],
    schema: str,
    rows_per_call: int = 40_000,
) -> DataFrame:
    """Shuffle by `keys`, sort by keys and `order`, and call fn(table, starts) on tables of whole groups.

    One call holds many small groups, so numpy works across groups rather than once per group. A group must fit
    in memory: callers split long ones with `time_blocks` or pre-aggregate first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < rows_per_call:
                continue
            table = pa.Table.from_batches(held)
            starts = group_starts(table, keys)
            cut = int(starts[-1])
            if cut:
                yield from fn(table.slice(0, cut), starts[:-1]).to_batches()
                table = table.slice(cut)
            held, rows = table.combine_chunks().to_batches(), table.num_rows
        if rows:
            table = pa.Table.from_batches(held)
            yield from fn(table, group_starts(table, keys)).to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def time_blocks(df: DataFrame, time: Column, seconds: float, halo: float, block: str, own: str) -> DataFrame:
    """Give each row the number of its time block, and copies to the blocks whose edge is nearer than `halo`.

    A group that lasts long is so cut into pieces of bounded time, each with the context it needs. `own` is true
    in the row's own block and false in the copies.
    """
    at = F.floor(time / F.lit(float(seconds)))
    near = F.array_distinct(F.array(F.floor((time - halo) / seconds), at, F.floor((time + halo) / seconds)))
    inside = F.floor((time - halo) / seconds) == F.floor((time + halo) / seconds)
    return df.withColumn(block, F.explode(F.when(inside, F.array(at)).otherwise(near))).withColumn(own, F.col(block) == at)
