"""Problem 7: evaluation texts leaking into training text.

``find`` (rows of p7_found) does not use the method named.  A size-partitioned MinHash sketch keeps the smallest
hashes of an item's shingles and estimates how much of the *item* a document holds; a case here is any passage of 50
letters, of an item of any length, of which up to five may be changed, so a document may hold only three shingles of
an item and none of a sketch (README has the recall).  ``find`` keeps every shingle instead: of 50 letters with at
most five changed, eight in a row are always unchanged (45 letters in at most six runs), so a document that leaks an
item holds one of its shingles.  Along the diagonal of a shared shingle, a window of 50 letters with at least 45 equal
is a leak.

``contained`` is the method named, for items that stand in a document as a whole: bottom-k sketches of the items by
size partitions, the estimate of the containment from the sketch, and the exact shingle containment of the candidates.

Items are the query set: they come to the driver in blocks of bounded size, and each block's table (bounded with it)
is matched against all documents in one scan without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fumikura.llm.letters import letters, rolling
from fumikura.plans.blocks import by_bytes, map_arrow

SHINGLE, PASSAGE, CHANGED = 8, 50, 5
#: Letters of a block of items; an item longer than that is a block of its own.
BLOCK_LETTERS = 8_000_000
#: Bytes of documents whose letters are in arrays at a time.
PART_BYTES = 4_000_000
#: Bits of the table that tells early whether a shingle can be one of an item's.
BITS = 22
#: Pairs of a shingle of a text and one of an item that are in arrays at a time (one shingle's are never parted).
EXPANSION = 2_000_000
#: Values of an item's sketch; items whose shingles are fewer are known whole.
SKETCH = 64


@dataclass
class Index:
    """Items of one block: letters, and all their shingles sorted by value."""

    ids: np.ndarray
    text: np.ndarray
    begin: np.ndarray
    value: np.ndarray
    item: np.ndarray
    at: np.ndarray
    seen: np.ndarray


def index(ids: list[int], texts: list[str], passage: int = PASSAGE) -> Index:
    x, n = letters(texts)
    begin = np.concatenate([[0], np.cumsum(n)])
    value, item, at = [], [], []
    for j in range(len(ids)):
        if n[j] < passage:
            continue  # no passage of an item that short exists
        h = rolling(x[begin[j] : begin[j + 1]], SHINGLE)
        value.append(h)
        item.append(np.full(len(h), j))
        at.append(np.arange(len(h)))
    cat = lambda a, t: np.concatenate(a).astype(t) if a else np.zeros(0, t)
    value, item, at = cat(value, np.uint64), cat(item, np.int32), cat(at, np.int32)
    o = np.argsort(value, kind="stable")
    value, item, at = value[o], item[o], at[o]
    seen = np.zeros(1 << BITS, bool)
    seen[(value >> np.uint64(64 - BITS)).astype(np.int64)] = True
    return Index(np.array(ids, np.int64), x, begin, value, item, at, seen)


def leaks(texts: list[str | None], s: Index, passage: int = PASSAGE, changed: int = CHANGED) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (number of the text, number of the item), each once."""
    x, n = letters(texts)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(s.value):
        return none
    h = rolling(x, SHINGLE)
    p = np.flatnonzero(s.seen[(h >> np.uint64(64 - BITS)).astype(np.int64)])
    if not len(p):
        return none
    lo = np.searchsorted(s.value, h[p], "left")
    hi = np.searchsorted(s.value, h[p], "right")
    ok = hi > lo
    p, lo, hi = p[ok], lo[ok], hi[ok]
    ends = np.cumsum(n)
    doc = np.searchsorted(ends, p, "right")
    inside = p + SHINGLE <= ends[doc]  # not across two texts
    p, lo, hi, doc = p[inside], lo[inside], hi[inside], doc[inside]
    # shingles that many items have are expanded in parts of a bounded size
    k = np.cumsum(hi - lo)
    part = k // EXPANSION
    cut = np.flatnonzero(part[1:] != part[:-1]) + 1
    got = [_verified(p[a:b], lo[a:b], hi[a:b], doc[a:b], x, ends - n, ends, s, passage, changed) for a, b in zip(np.concatenate([[0], cut]), np.append(cut, len(p))) if b > a]
    if not got:
        return none
    pairs = np.unique(np.concatenate(got, axis=1), axis=1)
    return pairs[0], pairs[1]


def _verified(p: np.ndarray, lo: np.ndarray, hi: np.ndarray, doc: np.ndarray, x: np.ndarray, doc_first: np.ndarray, doc_end: np.ndarray, s: Index, passage: int, changed: int) -> np.ndarray:
    """Pairs (text, item) with a passage, from shingles at p of the texts that entries lo to hi of the index hold."""
    k = hi - lo
    rep = np.repeat(np.arange(len(p)), k)
    entry = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k) + np.repeat(lo, k)
    p, doc, item, q = p[rep].astype(np.int64), doc[rep].astype(np.int64), s.item[entry].astype(np.int64), s.at[entry].astype(np.int64)
    # one look per diagonal and stretch of the item
    step = passage - SHINGLE + 1
    diag, stretch = p - q, q // step
    o = np.lexsort((stretch, item, diag, doc))
    first = np.ones(len(o), bool)
    first[1:] = (diag[o][1:] != diag[o][:-1]) | (item[o][1:] != item[o][:-1]) | (stretch[o][1:] != stretch[o][:-1]) | (doc[o][1:] != doc[o][:-1])
    o = o[first]
    doc, item, diag, stretch = doc[o], item[o], diag[o], stretch[o]
    out = []
    width = 2 * step - 2 + passage  # windows that begin up to step - 1 before the stretch or inside it
    doc_a, doc_b = doc_first[doc], doc_end[doc]
    it_a, it_len = s.begin[item], s.begin[item + 1] - s.begin[item]
    off = np.arange(width)
    for a in range(0, len(o), 20_000):
        z = slice(a, a + 20_000)
        qq = (stretch[z] * step - (step - 1))[:, None] + off
        pp = qq + diag[z][:, None]
        valid = (qq >= 0) & (qq < it_len[z][:, None]) & (pp >= doc_a[z][:, None]) & (pp < doc_b[z][:, None])
        same = valid & (s.text[np.minimum(it_a[z][:, None] + np.maximum(qq, 0), len(s.text) - 1)] == x[np.clip(pp, 0, len(x) - 1)])
        cs, cv = (np.zeros((len(qq), width + 1), np.int16) for _ in range(2))
        np.cumsum(same, axis=1, out=cs[:, 1:])
        np.cumsum(valid, axis=1, out=cv[:, 1:])
        hit = ((cs[:, passage:] - cs[:, :-passage] >= passage - changed) & (cv[:, passage:] - cv[:, :-passage] == passage)).any(axis=1)
        out.append(np.stack([doc[z][hit], item[z][hit]]))
    return np.unique(np.concatenate(out, axis=1), axis=1) if out else np.zeros((2, 0), np.int64)


def _over_items(docs: DataFrame, items: DataFrame, make, match, extra: tuple[tuple[str, pa.DataType], ...], block_letters: int) -> DataFrame:
    """All documents against all items, in blocks of items: ``make`` builds a block's table, ``match`` gives numbers
    of texts, numbers of items and the extra columns.  A block is sent to all executors; its size is ``block_letters``
    letters and one item at most."""
    spark = docs.sparkSession
    d = docs.where("doc_id is not null and text <> ''").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    schema = "doc_id long, item_id long" + "".join(f", {n} {'long' if t == pa.int64() else 'double'}" for n, t in extra)

    def scan(block: list[tuple[int, str]]) -> DataFrame:
        held = spark.sparkContext.broadcast(make([a for a, _ in block], [b for _, b in block]))

        def fn(t: pa.Table) -> pa.Table:
            out = []
            for part in by_bytes(t, "text", PART_BYTES):
                ids = part.column("doc_id").to_numpy()
                d, i, *more = match(part.column("text").to_pylist(), held.value)
                cols = {"doc_id": pa.array(ids[d], pa.int64()), "item_id": pa.array(held.value.ids[i], pa.int64())}
                out.append(pa.table(cols | {n: pa.array(v, t) for (n, t), v in zip(extra, more)}))
            return pa.concat_tables(out)

        return map_arrow(d, fn, schema)

    out, block, size = None, [], 0
    q = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint"), "text").distinct()
    for r in q.toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1])
        if size >= block_letters:
            part = scan(block)
            out = part if out is None else out.union(part)
            block, size = [], 0
    if block or out is None:
        part = scan(block)
        out = part if out is None else out.union(part)
    return out


def find(docs: DataFrame, items: DataFrame, passage: int = PASSAGE, changed: int = CHANGED, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """doc_id, item_id of every document that holds ``passage`` consecutive letters of an item, of which at most
    ``changed`` differ.

    Null or empty texts hold nothing, rows with a null id are left out, repeated ids or rows give one pair, equal
    items are each reported, an empty table on either side gives no row.
    """
    if changed * (SHINGLE - 1) + SHINGLE - 1 >= passage - changed:
        raise ValueError("so many changes may leave no shingle unchanged")
    return _over_items(docs, items, lambda a, b: index(a, b, passage), lambda t, s: leaks(t, s, passage, changed), (), block_letters).distinct()


@dataclass
class Sketches:
    """Items of one block: all their shingles in order, and the values of their sketches sorted by value."""

    ids: np.ndarray
    whole: list[np.ndarray]
    value: np.ndarray
    item: np.ndarray
    kept: np.ndarray
    seen: np.ndarray


def size_partition(n: int) -> int:
    """Number of the partition of an item with n distinct shingles: sizes from a power of two to the next."""
    return int(n).bit_length() - 1


def bottom_sketches(ids: list[int], texts: list[str], k: int = SKETCH) -> Sketches:
    """The k smallest shingle hashes of each item.  Items are in the order of their size partitions: sketches of one
    partition sample their items at about the same rate k / n, so their values lie in one range of hashes."""
    x, n = letters(texts)
    begin = np.concatenate([[0], np.cumsum(n)])
    sets = [np.unique(rolling(x[begin[j] : begin[j + 1]], SHINGLE)) for j in range(len(ids))]
    order = sorted((j for j in range(len(ids)) if len(sets[j])), key=lambda j: (size_partition(len(sets[j])), j))
    whole = [sets[j] for j in order]
    low = [s[:k] for s in whole]
    value = np.concatenate(low) if low else np.zeros(0, np.uint64)
    item = np.repeat(np.arange(len(low)), [len(s) for s in low])
    o = np.argsort(value, kind="stable")
    seen = np.zeros(1 << BITS, bool)
    seen[(value >> np.uint64(64 - BITS)).astype(np.int64)] = True
    return Sketches(np.array([ids[j] for j in order], np.int64), whole, value[o], item[o], np.array([len(s) for s in low], np.int64), seen)


def containments(texts: list[str | None], s: Sketches, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts, items and the exact share of the item's shingles in the text, where the share is ``least`` or more.

    A text is a candidate if its sketch estimate isn't below ``least`` by more than three deviations."""
    x, n = letters(texts)
    got: list[tuple[int, int, float]] = []
    ends = np.cumsum(n)
    if len(s.value):
        for d in range(len(texts)):
            h = np.unique(rolling(x[ends[d] - n[d] : ends[d]], SHINGLE))
            p = h[s.seen[(h >> np.uint64(64 - BITS)).astype(np.int64)]]
            lo, hi = np.searchsorted(s.value, p, "left"), np.searchsorted(s.value, p, "right")
            if not (hi > lo).any():
                continue
            hit = np.zeros(len(s.value) + 1, np.int64)  # entries of the sketches that the text holds
            np.add.at(hit, lo, 1)
            np.add.at(hit, hi, -1)
            share = np.bincount(s.item, weights=np.cumsum(hit[:-1]), minlength=len(s.kept)) / s.kept
            slack = 3 * np.sqrt(least * (1 - least) / s.kept)
            for j in np.flatnonzero((share > 0) & (share >= least - slack)).tolist():
                exact = np.isin(s.whole[j], h, assume_unique=True).mean()
                if exact >= least:
                    got.append((d, j, round(float(exact), 6)))
    d, j, c = (list(z) for z in zip(*got)) if got else ([], [], [])
    return np.array(d, np.int64), np.array(j, np.int64), np.array(c, float)


def contained(docs: DataFrame, items: DataFrame, least: float = 0.8, k: int = SKETCH, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """doc_id, item_id, containment of every document that holds at least ``least`` of an item's distinct shingles of
    eight letters, by size-partitioned MinHash containment search; candidates are verified exactly.

    Items of fewer than eight letters have no shingle and no row; nulls, repeats and empty tables as in ``find``.
    """
    return _over_items(docs, items, lambda a, b: bottom_sketches(a, b, k), lambda t, s: containments(t, s, least), (("containment", pa.float64()),), block_letters).distinct()
