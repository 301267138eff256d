"""Grouped Arrow processing without one Python call per group.

``by_group`` hash-partitions rows by their block key, sorts inside the partitions and hands a function *runs of
whole groups* as one Arrow table, so thousands of small groups share a call and NumPy works over all of them at
once.  A block key must bound its group (a volume is cut into blocks of lines or positions, see ``halo_blocks``);
nothing here ever holds more than ``min_rows`` rows plus one group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which a new key begins in a table sorted by ``keys`` (integer keys without nulls)."""
    n = table.num_rows
    if n == 0:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], min_rows: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if b.num_rows == 0:
            continue
        held.append(b)
        rows += b.num_rows
        if rows >= min_rows:
            t = pa.Table.from_batches(held).combine_chunks()
            cut = int(key_starts(t, keys)[-1])
            if cut:
                yield t.slice(0, cut)
            rest = t.slice(cut)
            held, rows = rest.to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def by_group(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[pa.Table], pa.Table], schema: str, min_rows: int = 150_000) -> DataFrame:
    """Apply ``fn`` to tables that hold whole groups of ``keys``, sorted by ``keys`` and ``order``.

    Keys must be integers without nulls.  ``fn`` sees many groups at a time and must honour their borders.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches, keys, min_rows):
            yield from fn(t).to_batches(max_chunksize=20_000)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def map_arrow(df: DataFrame, fn: Callable[[pa.Table], pa.Table], schema: str, min_rows: int = 1) -> DataFrame:
    """Apply ``fn`` to tables of at least ``min_rows`` rows (fewer at the end), without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= min_rows:
                yield from fn(pa.Table.from_batches(held).combine_chunks()).to_batches(max_chunksize=20_000)
                held, rows = [], 0
        if held:
            yield from fn(pa.Table.from_batches(held).combine_chunks()).to_batches(max_chunksize=20_000)

    return df.mapInArrow(run, schema)


def by_bytes(table: pa.Table, column: str, limit: int) -> Iterator[pa.Table]:
    """Parts of a table whose texts have about ``limit`` bytes (at least one row each), so that arrays made from them
    stay small whatever the batch holds."""
    n = pc.fill_null(pc.binary_length(table.column(column)), 0).to_numpy()
    part = np.cumsum(n) // limit
    cut = np.flatnonzero(part[1:] != part[:-1]) + 1
    for a, b in zip(np.concatenate([[0], cut]), np.append(cut, table.num_rows)):
        if b > a:
            yield table.slice(int(a), int(b - a))


def halo_blocks(pos: Column, size: int, halo: int) -> Column:
    """Array of the blocks that need position ``pos`` (from 0): its own, and a neighbour within ``halo`` of it."""
    own = F.floor(pos / size).cast("int")
    left = F.greatest(F.lit(0), F.floor((pos - halo) / size).cast("int"))
    right = F.floor((pos + halo) / size).cast("int")
    return F.when(left != own, F.array(left, own)).when(right != own, F.array(own, right)).otherwise(F.array(own))
