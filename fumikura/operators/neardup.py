"""Texts with similar sets of shingles, exactly, by a prefix filter.

A shingler turns a batch of rows into shingle hashes in NumPy.  Two passes read the texts: the first gives each set a
digest (equal sets are one class) and counts shingles in a table of 2^18 buckets; the second orders every class's set
by (bucket count, hash), so from the rarest, and keeps its prefix: sets that share enough share a shingle of their
prefixes.  Prefixes are joined; the sizes of the sets, the number of shared prefix shingles and the counts of shingles by
cells of the hash (an upper bound of what two sets share) rule most pairs out.  What
is left is counted on the whole sets, which are made again for these texts only: sets are never written.

Containment has no short prefixes (a tenth of the smaller set may be enough), so nothing is joined there: every set is
written once, in units of a million shingles sorted by hash, and tasks compare a block of units with the units behind it
in NumPy.  Neither postings nor candidates are shuffled or written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fumikura.plans.blocks import by_bytes
from fumikura.sources.stage import stage

BUCKET_BITS = 18
PART_BYTES = 4_000_000
#: Cells of a text's shingles by the first bits of the hash: texts share no more than the smaller count of each cell.
CELL_BITS = 9
CELLS = 1 << CELL_BITS
#: Containment: shingles of a written unit, of the block that a task holds, and pairs counted at once.
UNIT = 1_000_000
BLOCK = 4_000_000
AT_ONCE = 1_000_000
#: Containment: shingles that two sets must share among their rarer ones.
SOME = 3
#: First bits of a hash by which a task sees that its block hasn't the shingle.
SEEN_BITS = 25
#: Rows, counted before, that are broadcast at most.
FEW = 2_000_000
_state: dict = {}


@dataclass(frozen=True)
class Shingler:
    """What to read of each row, and the function from a table with it to all shingle hashes and how many a row has."""

    column: Column
    extract: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def spans_hash(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of x[a:b] for many ranges: differences of prefix sums of a polynomial, moved to the same power."""
    base = np.uint64(0x5851F42D4C957F2D)
    inv = np.uint64(pow(int(base), -1, 1 << 64))
    power = lambda q, n: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(n - 1, 0), q, np.uint64)]))
    p = np.zeros(len(x) + 1, np.uint64)
    p[1:] = np.add.accumulate(mix(x.astype(np.uint64), 1) * power(base, len(x))[: len(x)])
    return mix((p[b] - p[a]) * power(inv, len(x) + 1)[a] + (b - a).astype(np.uint64))


def _code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    t = [x or "" for x in texts]
    return np.frombuffer("".join(t).encode("utf-32-le", "surrogatepass"), "<u4"), np.fromiter(map(len, t), np.int64, len(t))


def _classes() -> np.ndarray:
    """By code point: 2 a letter of Han or kana, 1 another letter or digit, 0 neither."""
    if "classes" not in _state:
        import regex

        out = np.zeros(0x110000, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for pattern, k in ((r"[\p{L}\p{N}]+", 1), (r"[\p{Han}\p{Hiragana}\p{Katakana}ー]+", 2)):
            for m in regex.finditer(pattern, every):
                out[ord(m[0][0]) : ord(m[0][-1]) + 1] = k
        out[0xD800:0xE000] = 0
        _state["classes"] = out
    return _state["classes"]


def words(text: Column, k: int = 5) -> Shingler:
    """Runs of ``k`` words; a letter of Han or kana is a word, and so is a run of other letters and digits.  A text of
    fewer words has one shingle of all its words, or of the text itself if it has no word."""

    def extract(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = column.to_pylist()
        cp, n = _code_points([t.lower() if t else t for t in texts])
        doc = np.repeat(np.arange(len(n)), n)
        cls = _classes()[cp]
        new = np.ones(len(cp), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (cls[1:] != cls[:-1])
        starts = np.flatnonzero((cls == 2) | (cls == 1) & new)
        run_end = np.flatnonzero(np.append(new[1:], True)) + 1 if len(cp) else np.zeros(0, np.int64)
        ends = np.where(cls[starts] == 2, starts + 1, run_end[np.searchsorted(run_end, starts, "right")] if len(starts) else starts)
        w = spans_hash(cp, starts, ends)
        per = np.bincount(doc[starts], minlength=len(n))
        last = np.cumsum(per)
        at = np.arange(len(w))
        full = at + k <= np.repeat(last, per)
        few = per < k
        a = np.concatenate([at[full], (last - per)[few]])
        b = np.concatenate([at[full] + k, last[few]])
        h = spans_hash(w, a, b)
        who = np.concatenate([np.repeat(np.arange(len(n)), per)[full], np.flatnonzero(few)])
        none = np.flatnonzero(per == 0)
        if len(none):  # the whole text
            top = np.cumsum(n)
            h[len(h) - int(few.sum()) :][np.searchsorted(np.flatnonzero(few), none)] = mix(spans_hash(cp, (top - n)[none], top[none]), 7)
        o = np.argsort(who, kind="stable")
        return h[o], np.bincount(who, minlength=len(n))

    return Shingler(text, extract)


def characters(text: Column, k: int = 12, step: int = 6) -> Shingler:
    """Every ``step``-th run of ``k`` characters, white space left out; a shorter text has none."""

    def extract(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        cp, n = _code_points(column.to_pylist())
        doc = np.repeat(np.arange(len(n)), n)
        keep = ~np.isin(cp, _WHITE)
        cp, n = cp[keep], np.bincount(doc[keep], minlength=len(n))
        top = np.cumsum(n)
        count = np.maximum((n - k) // step + 1, 0)
        a = np.repeat(top - n, count) + (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)) * step
        return spans_hash(cp, a, a + k), count

    return Shingler(text, extract)


#: White space as the patterns of the queries have it.
_WHITE = np.array([9, 10, 11, 12, 13, 32, 0x3000])


def of_column(shingles: Column) -> Shingler:
    """Shingles that a column expression makes: an array of texts or numbers."""

    def extract(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        return flat, np.diff(column.offsets.to_numpy()) if column.null_count == 0 else np.array([len(x or ()) for x in column.to_pylist()])

    hashed = F.transform(shingles, lambda x: F.xxhash64(x.cast("string")))
    return Shingler(F.coalesce(hashed, F.array().cast("array<bigint>")), extract)


def _order(h: np.ndarray, row: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Order by row, weight and hash.  Rows and weights of 16 bits are sorted by radix."""
    if len(row) and row[-1] > 65_535:
        return np.lexsort((h, row) if weight is None else (h, weight, row))
    o = np.argsort(h)
    if weight is not None:
        o = o[np.argsort(weight[o], kind="stable")]
    return o[np.argsort(row.astype(np.uint16)[o], kind="stable")]


def _sets(column: pa.Array, extract: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, row by row, sorted; and how many each row has."""
    h, n = extract(column)
    row = np.repeat(np.arange(len(n)), n)
    o = _order(h, row)
    h, row = h[o], row[o]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[first], np.bincount(row[first], minlength=len(n))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    for b in batches:
        t = pa.Table.from_batches([b]).combine_chunks()
        if not t.num_rows:
            continue
        if pa.types.is_string(t.schema.field("v").type):
            yield from by_bytes(t, "v", PART_BYTES)
        else:
            yield t


def _column(t: pa.Table) -> pa.Array:
    c = t.column("v").combine_chunks()
    return c.chunk(0) if isinstance(c, pa.ChunkedArray) else c


def classes(rows: DataFrame, s: Shingler, buckets: bool = True) -> tuple[DataFrame, np.ndarray]:
    """(k, n, class, copies) of rows (k, v) that have shingles: equal sets are a class, named by its smallest key; and
    the bucket counts, zero without ``buckets``.  Both come from one pass; the buckets, 2^18 at most, are summed on the
    driver."""

    extract = s.extract

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        for t in _parts(batches):
            h, n = _sets(_column(t), extract)
            if buckets:
                counts += np.bincount((h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(counts))
            edge = np.concatenate([[0], np.cumsum(n)])
            sums = [np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(mix(h, salt))]) for salt in (3, 11)]
            d1, d2 = ((c[edge[1:]] - c[edge[:-1]]).view(np.int64) for c in sums)
            keep = np.flatnonzero(n > 0)
            yield pa.RecordBatch.from_arrays([t.column("k").combine_chunks().take(pa.array(keep)) if t.column("k").num_chunks == 1 else pa.concat_arrays(t.column("k").chunks).take(pa.array(keep)), pa.array(n[keep]), pa.array(d1[keep]), pa.array(d2[keep])], names=["k", "n", "h1", "h2"])
        at = np.flatnonzero(counts)
        for a in range(0, len(at), 50_000):
            p = at[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(p), pa.int64()), pa.array(np.full(len(p), -1)), pa.array(p), pa.array(counts[p])], names=["k", "n", "h1", "h2"])

    both = stage(rows.mapInArrow(run, "k long, n long, h1 long, h2 long"), "digests")
    c = both.where("n > 0")
    first = c.groupBy("n", "h1", "h2").agg(F.min("k").alias("class"), F.count("*").alias("copies"))
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    if buckets:
        t = both.where("n < 0").groupBy("h1").agg(F.sum("h2").alias("c")).toArrow()
        counts[t.column("h1").to_numpy()] = t.column("c").to_numpy()
    return c.join(first, ["n", "h1", "h2"]).select("k", "n", "class", "copies"), counts


@dataclass(frozen=True)
class _Docs:
    """Sets in the order of size and key; their postings as x (distinct hashes, sorted), start (of each hash's list) and
    key (number of the hash, 2^32 times, and number of the set), sorted."""

    k: np.ndarray
    n: np.ndarray
    copies: np.ndarray
    x: np.ndarray
    start: np.ndarray
    key: np.ndarray


_LOW = 0xFFFFFFFF


def _pack(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """A unit as one row: its sets, and its postings (hash and number of the set) sorted by hash."""
    k, n, copies, h = (np.concatenate(x) for x in zip(*held))
    o = np.argsort(h)
    row = np.repeat(np.arange(len(k), dtype=np.uint16 if len(k) <= 65_536 else np.uint32), n)
    parts = (k, n, copies, h[o], row[o])
    return pa.RecordBatch.from_arrays([pa.array([len(h)]), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], names=["size", "k", "n", "copies", "x", "d"])


def _unit(uri: str) -> tuple[np.ndarray, ...]:
    files, path = fs.FileSystem.from_uri(uri)
    t = pq.ParquetFile(path, filesystem=files).read()
    k, n, copies, x, d = (np.frombuffer(t.column(c)[0].as_buffer(), "<u8" if c == "x" else "<i8") if c != "d" else t.column(c)[0].as_buffer() for c in ("k", "n", "copies", "x", "d"))
    return k, n, copies, x, np.frombuffer(d, "<u2" if len(k) <= 65_536 else "<u4")


def _docs(units: list[tuple[np.ndarray, ...]]) -> _Docs:
    k, n, copies, x = (np.concatenate([u[i] for u in units]) for i in range(4))
    o = np.lexsort((k, n))
    rank = np.empty(len(o), np.int64)
    rank[o] = np.arange(len(o))
    first = accumulate((len(u[0]) for u in units), initial=0)
    d = np.concatenate([rank[a : a + len(u[0])][u[4]] for a, u in zip(first, units)])
    if len(units) > 1:
        by = np.argsort(x, kind="stable")  # runs that are sorted already
        x, d = x[by], d[by]
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    start = np.append(np.flatnonzero(new), len(x))
    key = (np.cumsum(new) - 1 << 32) | d
    key.sort()
    return _Docs(k[o], n[o], copies[o], x[new], start, key)


def _ranges(a: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Numbers of the ranges a, a + 1, ... of n each, one after the other."""
    return np.repeat(a - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def _after(p: _Docs, q: _Docs) -> tuple[np.ndarray, np.ndarray]:
    """By set of p the first set of q that is larger, or equally large with a greater key; and by set of q that of p."""
    of_q = np.lexsort((np.concatenate([p.k, q.k]), np.concatenate([p.n, q.n]))) >= len(p.k)  # both are in this order
    before = np.cumsum(of_q)
    return before[~of_q], (np.arange(len(of_q)) - before + 1)[of_q]


def _place(key: np.ndarray, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The first place in each of the lists lo to hi, none empty, where key is x or more, else hi."""
    out = lo + (key[lo] < x)
    out += (hi - lo > 1) & (key[hi - 1] < x)
    z = np.flatnonzero(hi - lo > 2)
    out[z] = np.searchsorted(key, x[z])
    return out


def _cuts(total: np.ndarray, most: int) -> list[int]:
    """Borders of runs of about ``most`` in all, at least one each."""
    part = (np.cumsum(total) - total) // most
    return [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(total)]


def _common(need: np.ndarray, p: np.ndarray, u: np.ndarray, lo: np.ndarray, hi: np.ndarray, key: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(p, q, common) of sets p and larger sets q, that have ``need`` of p's shingles in common, and of some that have
    fewer.  Set p has a shingle of number u, and key[lo:hi] are the postings of the larger sets, of ``size``, with it.

    Who shares ``need`` of the shingles that p and any of the sets have shares ``SOME`` of them all without the need - SOME
    that most sets have: these give the candidates, which are then looked up among the others."""
    m, some = hi - lo, np.minimum(need, SOME)
    z = np.flatnonzero(m > 0)
    has = np.bincount(p[z], minlength=len(need))
    z = z[(has >= need)[p[z]]]
    if not len(z):
        return
    z = z[np.argsort((p[z] << 32) | m[z])]
    p, u, lo, m = p[z], u[z], lo[z], m[z]
    who, first = np.unique(p, return_index=True)
    head = np.arange(len(p)) - np.repeat(first, has[who]) < (has - need + some)[p]
    hp, hl, hm, tp, tu, tl, tm = p[head], lo[head], m[head], p[~head], u[~head], lo[~head], m[~head]
    heads, tails = np.searchsorted(hp, np.append(who, len(need))), np.searchsorted(tp, np.append(who, len(need)))
    work = np.add.reduceat(hm, heads[:-1])
    cuts = _cuts(work, AT_ONCE)
    for a, b in zip(cuts, cuts[1:]):
        pair, c = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = slice(heads[a], heads[b])
        inner = _cuts(hm[at], AT_ONCE)
        for i, j in zip(inner, inner[1:]):
            x = slice(at.start + i, at.start + j)
            new = np.repeat(hp[x] * size, hm[x]) + (key[_ranges(hl[x], hm[x])] & _LOW)
            new.sort()
            one = np.flatnonzero(np.append(True, new[1:] != new[:-1]))
            new, n = new[one], np.diff(np.append(one, len(new)))
            if len(pair):  # a set with more postings than are counted at once
                pair, back = np.unique(np.concatenate([pair, new]), return_inverse=True)
                c = np.bincount(back, np.concatenate([c, n])).astype(np.int64)
            else:
                pair, c = new, n
        of = pair // size
        z = c >= some[of]
        pair, of, c = pair[z], of[z], c[z]
        if not len(pair):
            continue
        more = (need - some)[of]
        at = slice(tails[a], tails[b])
        if tm[at].sum() < 8 * more.sum():  # the other postings are fewer than what would be looked up
            inner = _cuts(tm[at], AT_ONCE)
            for i, j in zip(inner, inner[1:]):
                x = slice(at.start + i, at.start + j)
                new = np.repeat(tp[x] * size, tm[x]) + (key[_ranges(tl[x], tm[x])] & _LOW)
                here = np.minimum(np.searchsorted(pair, new), len(pair) - 1)
                c += np.bincount(here[pair[here] == new], minlength=len(pair))
        else:
            inner = _cuts(more, AT_ONCE)
            begin = tails[np.searchsorted(who, of)]
            for i, j in zip(inner, inner[1:]):
                which = np.repeat(np.arange(i, j), more[i:j])
                at = _ranges(begin[i:j], more[i:j])
                new = (tu[at] << 32) | (pair % size)[which]
                here = np.minimum(np.searchsorted(key, new), len(key) - 1)
                c += np.bincount(which[key[here] == new], minlength=len(pair))
        yield of, pair % size, c


def _enough(p: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Places of the sets that occur often enough."""
    return np.flatnonzero((np.bincount(p, minlength=len(need)) >= need)[p])


def _within(b: _Docs, need: Callable) -> Iterator[tuple[_Docs, _Docs, tuple]]:
    count, need = np.diff(b.start), need(b.n)
    every = np.flatnonzero(np.repeat(count > 1, count))
    cuts = _cuts(b.n, AT_ONCE)  # the smaller sets, some at a time
    for i, j in zip(cuts, cuts[1:]):
        p = b.key[every] & _LOW
        z = every[(p >= i) & (p < j)]
        z = z[_enough(b.key[z] & _LOW, need)]
        u, p = b.key[z] >> 32, b.key[z] & _LOW
        for found in _common(need, p, u, z + 1, b.start[u + 1], b.key, len(b.k)):
            yield b, b, found


def _across(b: _Docs, seen: np.ndarray, unit: tuple[np.ndarray, ...], need: Callable) -> Iterator[tuple[_Docs, _Docs, tuple]]:
    """Pairs of a set of the block and one of the unit, either of them the smaller."""
    k, n, copies, x, d = unit
    z = np.flatnonzero(seen[(x >> np.uint64(64 - SEEN_BITS)).astype(np.int64)])
    u = np.minimum(np.searchsorted(b.x, x[z]), len(b.x) - 1)
    same = b.x[u] == x[z]
    u, z = u[same], z[same]
    if not len(z):
        return
    o = np.lexsort((k, n))
    rank = np.empty(len(o), np.int64)
    rank[o] = np.arange(len(o))
    key = (u << 32) | rank[d[z]]
    key.sort()
    q = _Docs(k[o], n[o], copies[o], x, u, key)  # of the postings, only key is of use
    least = need(q.n)
    z = _enough(key & _LOW, least)
    u, p = key[z] >> 32, key[z] & _LOW
    in_b, in_q = _after(q, b)
    ends = b.start[u + 1]
    lo = _place(b.key, b.start[u], ends, (u << 32) | in_b[p])
    for found in _common(least, p, u, lo, ends, b.key, len(b.k)):
        yield q, b, found
    least, u = need(b.n), key >> 32
    one = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
    begin, ends, u = one, np.append(one[1:], len(u)), u[one]
    count = b.start[u + 1] - b.start[u]
    p = b.key[_ranges(b.start[u], count)] & _LOW
    z = _enough(p, least)
    of, p = np.repeat(np.arange(len(u)), count)[z], p[z]
    u, ends = u[of], ends[of]
    lo = _place(key, begin[of], ends, (u << 32) | in_q[p])
    for found in _common(least, p, u, lo, ends, key, len(q.k)):
        yield b, q, found


def contained(rows: DataFrame, s: Shingler, least: float, unit: int = UNIT, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``similar`` for containment.  Every set is written once; a task holds the postings of a block of units and
    compares them with themselves and with the units behind, one after the other."""
    spark, extract = rows.sparkSession, s.extract
    cls = stage(classes(rows, s, buckets=False)[0], "classes")
    odd = cls.where("copies > 1")
    if n := odd.count():
        side = F.broadcast if n <= FEW else lambda x: x
        rows = rows.join(side(odd.where("k <> class").select("k")), "k", "left_anti").join(side(odd.where("k = class").select("k", "copies")), "k", "left")
    else:
        rows = rows.withColumn("copies", F.lit(1).cast("bigint"))

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for t in _parts(batches):
            h, n = _sets(_column(t), extract)
            z = n > 0
            held.append((t.column("k").to_numpy()[z], n[z].astype(np.int64), t.column("copies").fill_null(1).to_numpy()[z], h))
            size += len(h)
            if size >= unit:
                yield _pack(held)
                held, size = [], 0
        if size:
            yield _pack(held)

    e = stage(rows.mapInArrow(units, "size long, k binary, n binary, copies binary, x binary, d binary"), "units", maxRecordsPerFile=1)
    files = sorted(e.select(F.col("_metadata.file_path"), "size").collect())
    paths, cuts = [f for f, _ in files], _cuts(np.array([z for _, z in files], np.int64), block)
    run = max(4, len(paths) // 10)  # units that a task goes through
    tasks = [(a, b, c, min(c + run, len(paths))) for a, b in zip(cuts, cuts[1:]) if b > a for c in range(b, max(len(paths), b + 1), run)]
    work = spark.sparkContext.broadcast((paths, tasks))

    def need(n: np.ndarray) -> np.ndarray:
        return np.maximum(1, np.ceil(np.round(n * least, 9)).astype(np.int64))

    def found(a: int, b: int, c: int, d: int) -> Iterator[tuple[_Docs, _Docs, tuple]]:
        paths = work.value[0]
        held = _docs([_unit(x) for x in paths[a:b]])
        if c == b:
            yield from _within(held, need)
        seen = np.zeros(1 << SEEN_BITS, bool)
        seen[(held.x >> np.uint64(64 - SEEN_BITS)).astype(np.int64)] = True
        for x in paths[c:d]:
            yield from _across(held, seen, _unit(x), need)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column("id").to_pylist():
                for p, q, (x, y, c) in found(*work.value[1][i]):
                    share = c / p.n[x]
                    z = share >= least
                    x, y, c, share = x[z], y[z], c[z], share[z]
                    turn = p.k[x] > q.k[y]
                    of = lambda f, g: pa.array(np.where(turn, g[y], f[x]))  # noqa: B023, E731
                    t = pa.table([of(p.k, q.k), pa.array(np.where(turn, p.k[x], q.k[y])), pa.array(c), pa.array(share), of(p.copies, q.copies), pa.array(np.where(turn, p.copies[x], q.copies[y]))], names=["a", "b", "common", "share", "a_class", "b_class"])
                    yield from t.to_batches(max_chunksize=50_000)

    every = spark.range(0, len(tasks), 1, max(1, len(tasks)))
    return cls, every.mapInArrow(pairs, "a long, b long, common long, share double, a_class long, b_class long")


def similar(rows: DataFrame, s: Shingler, least: float, measure: str = "jaccard") -> tuple[DataFrame, DataFrame]:
    """Classes as above, and pairs a < b of classes with ``common`` shingles, ``share`` of the union (jaccard) or of
    the smaller set (containment) of at least ``least``, and the copies of both."""
    if measure == "containment":
        return contained(rows, s, least)
    spark = rows.sparkSession
    cls, counts = classes(rows, s)
    cls = stage(cls, "classes")
    heads = cls.where("k = class").select("k", "copies")
    # frequencies to a thousandth of a doubling, in 16 bits: 512 kB
    scale = np.round(np.log2(counts + 1) * 1000).astype(np.int64)
    held = spark.sparkContext.broadcast(np.minimum(scale, 65_535).astype(np.uint16))
    extract = s.extract

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _parts(batches):
            h, n = _sets(_column(t), extract)
            row = np.repeat(np.arange(len(n)), n)
            weight = held.value[(h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
            o = _order(h, row, weight)
            h, weight = h[o], weight[o].astype(np.int32)
            pos = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            size = n[row]
            end = size - np.ceil(np.round(size * least, 9)).astype(np.int64)  # where the prefix ends
            k, every = t.column("k").to_numpy(), np.flatnonzero(pos <= end)
            for a in range(0, len(every), 100_000):
                z = every[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(h[z].view(np.int64)), pa.array(k[row[z]]), pa.array(size[z].astype(np.int32)), pa.array(weight[z], mask=(pos != end)[z])], names=["x", "k", "n", "last"])

    mine = rows.join(heads.select("k"), "k", "left_semi")
    e = stage(mine.mapInArrow(prefixes, "x long, k long, n int, last int"), "prefixes")
    a = e.select("x", F.col("k").alias("p"), F.col("n").alias("np"))
    b = e.select("x", F.col("k").alias("q"), F.col("n").alias("nq"))
    smaller = (F.col("np") < F.col("nq")) | ((F.col("np") == F.col("nq")) & (F.col("p") < F.col("q")))
    c = a.join(b, "x").where(smaller & (F.col("np") >= F.col("nq") * least - 1e-9))
    c = c.groupBy("p", "q", "np", "nq").agg(F.count("*").alias("c"))
    # shingles shared behind the prefix that ends first are fewer than ceil(least n) of its set, so the prefixes share
    # the rest; hashes compare as unsigned numbers
    need = F.ceil(F.round((F.col("np") + F.col("nq")) * (least / (1 + least)), 6))
    behind = lambda n: F.ceil(F.round(F.col(n) * least, 9)) - 1
    c = c.where(F.col("c") >= need - behind("nq"))
    ends = e.where("last is not null").select("k", F.struct("last", F.col("x").bitwiseXOR(F.lit(-(2**63))).alias("x")).alias("end"))
    end = lambda n: ends.select(F.col("k").alias(n), F.col("end").alias(f"end_{n}"))
    c = c.join(end("p"), "p").join(end("q"), "q").where(F.col("c") >= need - F.when(F.col("end_p") <= F.col("end_q"), behind("np")).otherwise(behind("nq"))).drop("end_p", "end_q")
    c = stage(c.drop("c"), "candidates")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _parts(batches):
            h, n = _sets(_column(t), extract)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(h.view(np.int64)))
            yield from pa.table({"k": t.column("k"), "s": lists}).to_batches(max_chunksize=2_000)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _parts(batches):
            h, n = _sets(_column(t), extract)
            at = np.repeat(np.arange(len(n)), n) * CELLS + (h >> np.uint64(64 - CELL_BITS)).astype(np.int64)
            cells = np.bincount(at, minlength=len(n) * CELLS).reshape(-1, CELLS)
            fits = cells.max(axis=1, initial=0) < 65_536
            packed = [x.astype("<u2").tobytes() if ok else None for x, ok in zip(cells, fits)]
            yield from pa.table({"k": t.column("k"), "cells": pa.array(packed, pa.binary())}).to_batches(max_chunksize=2_000)

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blank = b"\xff" * (2 * CELLS)  # a text too large for 16 bits is no bound
        for b in batches:
            for a in range(0, b.num_rows, 5_000):
                z = b.slice(a, 5_000)
                p, q = (np.frombuffer(b"".join(x or blank for x in z.column(f"cells_{n}").to_pylist()), "<u2").reshape(-1, CELLS) for n in "pq")
                most = np.minimum(p, q).sum(axis=1, dtype=np.int64)
                sp, sq = z.column("np").to_numpy().astype(np.int64), z.column("nq").to_numpy().astype(np.int64)
                need = np.ceil(np.round((sp + sq) * (least / (1 + least)), 6))
                yield z.filter(pa.array(most >= need)).select(["p", "q", "np", "nq"])

    chosen = lambda c: rows.join(c.select(F.col("p").alias("k")).union(c.select("q")).distinct(), "k", "left_semi")
    hist = stage(chosen(c).mapInArrow(counted, "k long, cells binary"), "cells")
    cells = lambda n: hist.select(F.col("k").alias(n), F.col("cells").alias(f"cells_{n}"))
    c = stage(c.join(cells("p"), "p").join(cells("q"), "q").select("p", "q", "np", "nq", "cells_p", "cells_q").mapInArrow(bounded, "p long, q long, np int, nq int"), "bounded")
    d = stage(chosen(c).mapInArrow(whole, "k long, s array<bigint>"), "sets")
    side = lambda n: d.select(F.col("k").alias(n), F.col("s").alias(f"s_{n}"))
    j = c.join(side("p"), "p").join(side("q"), "q").select("p", "q", "np", "nq", F.size(F.array_intersect("s_p", "s_q")).cast("bigint").alias("common"))
    j = j.withColumn("share", F.col("common") / (F.col("np") + F.col("nq") - F.col("common"))).where(F.col("share") >= least)
    copies = lambda n, m: heads.select(F.col("k").alias(n), F.col("copies").alias(m))
    j = j.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "common", "share").join(copies("a", "a_class"), "a").join(copies("b", "b_class"), "b")
    return cls, j.select("a", "b", "common", "share", "a_class", "b_class")
