"""Parallel prefix scan over the blocks of records.

A block of a record is a function of the state in which it is entered; functions are put together without knowing the
state, so blocks are read apart from each other.  Blocks are grouped ``radix`` at a time: groups are composed into one
function each, level by level, until a record has one group; going down again, every block gets the composition of
all blocks before it.  No task ever holds more than ``radix`` functions of a record.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fumikura.plans.blocks import by_group, key_starts
from fumikura.sources.stage import stage

RADIX = 256
Compose = Callable[[bytes, bytes], bytes]


def exclusive(blocks: DataFrame, keys: list[str], compose: Compose, unit: bytes, radix: int = RADIX, backward: bool = False) -> DataFrame:
    """``blocks``: the integer keys of a record, blk int, f binary; read several times, so it should be a stage.

    Returns keys, blk, before: ``compose`` over the f of all blocks with a smaller number (``backward``: a larger
    one), in the order of the numbers, and ``unit`` where there is none.
    """
    fn = (lambda acc, f: compose(f, acc)) if backward else compose
    sign = -1 if backward else 1
    lo, hi = blocks.agg(F.min(F.col("blk") * sign), F.max(F.col("blk") * sign)).first()
    lo, hi = lo or 0, hi or 0
    b = blocks.select(*keys, (F.col("blk") * sign - lo).cast("int").alias("blk"), "f")
    out = _level(b, keys, fn, unit, radix, hi - lo)
    return out.select(*keys, ((F.col("blk") + lo) * sign).cast("int").alias("blk"), "before")


def _level(b: DataFrame, keys: list[str], fn: Compose, unit: bytes, radix: int, top: int) -> DataFrame:
    names = ", ".join(f"{k} long" for k in keys)

    def prefixes(t: pa.Table) -> pa.Table:
        out, keep = [], []
        f, blk = t.column("f").to_pylist(), t.column("blk").to_numpy()
        starts = key_starts(t, [*keys, "g"])
        for a, z in zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows]):
            acc = unit
            for r in range(a, z):
                if blk[r] >= 0:
                    keep.append(r)
                    out.append(acc)
                acc = fn(acc, f[r])
        return t.select([*keys, "blk"]).take(pa.array(keep, pa.int64())).append_column("before", pa.array(out, pa.binary()))

    b = b.withColumn("g", F.floor(F.col("blk") / radix).cast("int"))
    if top >= radix:

        def total(t: pa.Table) -> pa.Table:
            f = t.column("f").to_pylist()
            starts = key_starts(t, [*keys, "g"])
            out = []
            for a, z in zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows]):
                acc = f[a]
                for r in range(a + 1, z):
                    acc = fn(acc, f[r])
                out.append(acc)
            head = t.select([*keys, "g"]).take(pa.array(starts, pa.int64())).rename_columns([*keys, "blk"])
            return head.append_column("f", pa.array(out, pa.binary()))

        up = stage(by_group(b, [*keys, "g"], ["blk"], total, f"{names}, blk int, f binary", min_rows=10_000), "scan")
        over = _level(up, keys, fn, unit, radix, top // radix)
        b = b.unionByName(over.select(*keys, F.lit(-1).alias("blk"), F.col("before").alias("f"), F.col("blk").alias("g")))
    return by_group(b, [*keys, "g"], ["blk"], prefixes, f"{names}, blk int, before binary", min_rows=10_000)


def compose_maps(first: bytes, then: bytes) -> bytes:
    """Functions on small numbers as int16 tables; -1 is final, an empty table changes nothing."""
    if not first or not then:
        return first or then
    f, g = np.frombuffer(first, "<i2"), np.frombuffer(then, "<i2")
    return np.where(f < 0, -1, g[np.maximum(f, 0)]).astype("<i2").tobytes()
