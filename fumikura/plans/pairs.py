"""Vectors against vectors in blocks: a matrix product for each pair of blocks, never a nested-loop join.

Rows are dealt to blocks by hash and packed; blocks meet by an equi-join on the block number, to which the left side
is copied as often as there are right blocks.  A task holds two blocks and their product.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 1024
#: names and matrices of two blocks, and whether they are the same one, to a table of results
Product = Callable[[pa.Array, np.ndarray, pa.Array, np.ndarray, bool], pa.Table]


def packed(v: DataFrame, key: str, vec: str, blocks: int) -> DataFrame:
    """blk, rows (array of key and vector)."""
    d = v.select(F.col(key).alias("key"), F.col(vec).cast("array<double>").alias("vec"))
    return d.groupBy(F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("blk")).agg(F.collect_list(F.struct("key", "vec")).alias("rows"))


def unpack(rows: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Keys and matrix of one packed block."""
    s = rows.flatten()
    v = s.field("vec")
    flat = v.flatten().to_numpy(zero_copy_only=False)
    return s.field("key"), flat.reshape(len(s), -1) if len(s) else np.zeros((0, 0))


def block_product(left: DataFrame, right: DataFrame, key: str, vec: str, fn: Product, schema: str, size: int = SIZE, once: bool = False) -> DataFrame:
    """``fn`` over every pair of a left and a right block; ``once``: both sides are the same rows, each unordered pair
    of blocks comes once.  Vectors must not be null and be of one length."""
    nb = max(1, -(-right.count() // size))
    nl = nb if once else max(1, -(-left.count() // size))
    r = packed(right, key, vec, nb)
    ln = packed(left, key, vec, nl).select(F.col("blk").alias("lb"), F.col("rows").alias("lrows"))
    low = F.col("lb") if once else F.lit(0)
    j = ln.select("lb", "lrows", F.explode(F.sequence(low, F.lit(nb - 1))).alias("blk")).join(r, "blk").select("lb", "blk", "lrows", "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x, y = unpack(b.column("lrows").slice(i, 1)), unpack(b.column("rows").slice(i, 1))
                out = fn(*x, *y, once and b.column("lb")[i].as_py() == b.column("blk")[i].as_py())
                yield from out.to_batches(max_chunksize=50_000)

    return j.mapInArrow(run, schema)


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """1 - cosine of all rows of x with all of y; null (nan) where a row is zero."""
    n = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :]
    return 1 - np.divide(x @ y.T, n, out=np.full(n.shape, np.nan), where=n > 0)


def delta(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Mean absolute difference."""
    out = np.zeros((len(x), len(y)))
    for k in range(x.shape[1]):  # a column at a time: nothing larger than the result
        out += np.abs(x[:, k, None] - y[None, :, k])
    return out / max(x.shape[1], 1)


def euclidean(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Root of squared differences; a value that is missing on either side adds nothing."""
    out = np.zeros((len(x), len(y)))
    for k in range(x.shape[1]):
        out += np.nan_to_num((x[:, k, None] - y[None, :, k]) ** 2)
    return np.sqrt(out)


METRICS = {"cosine": cosine, "delta": delta, "euclidean": euclidean}


def all_pairs(v: DataFrame, key: str, vec: str, metric: str, name: str, digits: int = 9, size: int = SIZE) -> DataFrame:
    """(a, b, name) of all pairs a < b: the distance matrix is the result."""
    fn, kt = METRICS[metric], v.schema[key].dataType.simpleString()

    def product(ka: pa.Array, x: np.ndarray, kb: pa.Array, y: np.ndarray, same: bool) -> pa.Table:
        a, b = np.array(ka.to_pylist(), object), np.array(kb.to_pylist(), object)
        i, j = (np.triu_indices(len(a), 1) if same else tuple(g.ravel() for g in np.indices((len(a), len(b)))))
        d = np.round(fn(x, y)[i, j], digits)
        swap = a[i] > b[j]
        first, second = np.where(swap, b[j], a[i]), np.where(swap, a[i], b[j])
        return pa.table({"a": pa.array(first, ka.type), "b": pa.array(second, ka.type), name: pa.array(d, mask=np.isnan(d))})

    return block_product(v, v, key, vec, product, f"a {kt}, b {kt}, {name} double", size, once=True)


def nearest(queries: DataFrame, base: DataFrame, key: str, vec: str, metric: str, k: int, name: str, digits: int = 9, size: int = SIZE) -> DataFrame:
    """(q, key, name): of every query its k nearest other rows in each block; the caller keeps the k best of all."""
    fn, kt = METRICS[metric], base.schema[key].dataType.simpleString()

    def product(ka: pa.Array, x: np.ndarray, kb: pa.Array, y: np.ndarray, same: bool) -> pa.Table:
        a, b = np.array(ka.to_pylist(), object), np.array(kb.to_pylist(), object)
        b_order = np.argsort(b, kind="stable")  # ties by name
        d = np.round(fn(x, y), digits)[:, b_order]
        b = b[b_order]
        d[(a[:, None] == b[None, :]) | np.isnan(d)] = np.inf
        top = np.argsort(d, axis=1, kind="stable")[:, :k]
        i = np.repeat(np.arange(len(a)), top.shape[1])
        v = d[i, top.ravel()]
        keep = np.isfinite(v)
        return pa.table({"q": pa.array(a[i][keep], ka.type), "key": pa.array(b[top.ravel()][keep], ka.type), name: pa.array(v[keep])})

    return block_product(queries, base, key, vec, product, f"q {kt}, key {kt}, {name} double", size)
