"""Problem 1: long exact spans shared between records.

Method: content-defined chunking.  A gear rolling hash runs over the units of a record (token surfaces, or the
characters of a title); a unit is a cut where its hash is the minimum of the hashes around it.  Cuts depend only on
the text within reach, so an insertion shifts nothing beyond it.  The variable chunk between two cuts is known by
its digest; a digest that occurs in two records marks a possible shared span.

Why no span is missed: with a gear window of ``k`` units and minima over ``w`` hashes, two equal stretches of
``span >= 2w + k - 1`` units contain the same two neighbouring cuts, hence an equal chunk (``chunk_parameters``
chooses k and w so).  The exact check follows: every window of ``span`` units around a shared chunk is hashed in
full and counted by record, and only windows found in two records count as shared.  No pairs of records are ever
formed: a digest's rows are reduced to the smallest and the largest record key, on the map side first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fumikura.plans.blocks import by_group, halo_blocks, key_starts, map_arrow
from fumikura.sources.corpus import token_rows, volume_keys
from fumikura.sources.stage import stage

#: Units of a block that one Python call treats as a whole.
BLOCK = 8192
#: Names of the two keys of a record's part: 128 bits, so that two parts never share both.
RKEYS = ["rkey", "rkey2"]
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE2 = np.uint64(0xC2B2AE3D27D4EB4F | 1)


def chunk_parameters(span: int) -> tuple[int, int]:
    """(k, w) of a span: k a power of two about a quarter of it, w the largest with 2w + k - 1 <= span."""
    k = 1
    while k * 2 <= span / 3.5 and k < 8:
        k *= 2
    return k, max(1, (span - k + 1) // 2)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def gear(units: np.ndarray, k: int) -> np.ndarray:
    """Gear hash at each unit: h = (h << 64/k) + gear(unit), so that exactly the last k units count.  The first k-1
    values are of shorter windows."""
    g, h, s = _mix(units), np.zeros(len(units), np.uint64), 64 // k
    for j in range(k):
        h[j:] += g[: len(g) - j] << np.uint64(s * j)
    return h


def cuts(h: np.ndarray, w: int) -> np.ndarray:
    """Positions whose hash is the rightmost minimum of some w neighbouring hashes."""
    n = len(h)
    if n < w:
        return np.zeros(0, np.int64)
    win = np.lib.stride_tricks.sliding_window_view(h, w)
    at = np.arange(len(win)) + (w - 1 - np.argmin(win[:, ::-1], axis=1))
    keep = np.zeros(n, bool)
    keep[at] = True
    return np.flatnonzero(keep)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def range_hash(units: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: np.uint64) -> np.ndarray:
    """Hash of units[lo:hi] for many ranges, from prefix sums of a polynomial."""
    p = np.zeros(len(units) + 1, np.uint64)
    p[1:] = np.add.accumulate(_mix(units + base) * _powers(len(units), base))
    return _mix((p[hi] - p[lo]) * _powers(len(units) + 1, _inverse(base))[lo] + (hi - lo).astype(np.uint64))


def _blocks(rows: DataFrame, span: int, block: int) -> DataFrame:
    """One row per block of a record: its keys, the first position, and the unit hashes with the halo, packed."""
    halo = 2 * span + 8
    rows = rows.select(*RKEYS, "rec", "vol_no", "pos", "unit", F.explode(halo_blocks(F.col("pos") - 1, block, halo)).alias("blk"))

    def pack(t: pa.Table) -> pa.Table:
        pos, unit = t.column("pos").to_numpy(), t.column("unit").to_numpy()
        starts = key_starts(t, [*RKEYS, "blk"])
        ends = np.append(starts[1:], len(pos))
        first = np.ones(len(pos), bool)  # repeated rows count once
        first[1:] = pos[1:] != pos[:-1]
        first[starts] = True
        data = [unit[a:b][first[a:b]].astype("<i8").tobytes() for a, b in zip(starts, ends)]
        head = t.select([*RKEYS, "rec", "vol_no", "blk"]).take(pa.array(starts))
        return head.append_column("lo", pa.array(pos[starts], pa.int32())).append_column("units", pa.array(data, pa.binary()))

    return by_group(rows, [*RKEYS, "blk"], ["pos"], pack, "rkey long, rkey2 long, rec string, vol_no int, blk int, lo int, units binary")


def _each(t: pa.Table):
    """(row number, first position, block, unit hashes) of packed blocks."""
    los, blks, units = t.column("lo").to_pylist(), t.column("blk").to_pylist(), t.column("units")
    for r in range(t.num_rows):
        yield r, los[r], blks[r], np.frombuffer(units[r].as_py(), "<u8")


def _long(a: list[np.ndarray], kind: str = "int64") -> np.ndarray:
    return np.concatenate(a).astype(kind) if a else np.zeros(0, kind)


def shared_positions(rows: DataFrame, span: int, block: int = BLOCK) -> DataFrame:
    """Maximal runs of shared positions.

    ``rows``: rec string, vol_no int, pos int (consecutive from 1 in a record), unit long (hash of the unit), rkey,
    rkey2 long (keys of the record part), owner, if there is one: then parts with the same rec do not share with each
    other.  Returns
    rec, vol_no, first_pos, last_pos.  Rows with nulls must be removed before; an empty input gives no row; records
    shorter than the span have none.
    """
    k, w = chunk_parameters(span)
    size = max(block, 4 * span + 16)
    owners = "owner" in rows.columns
    who = ["owner", "owner2"] if owners else []
    packed = stage(_blocks(rows, span, size), "spans")

    def chunks(t: pa.Table) -> pa.Table:
        at, lo_pos, dig = [], [], []
        for r, lo, blk, u in _each(t):
            if len(u) < span:
                continue
            c = cuts(gear(u, k)[k - 1 :], w) + (k - 1)
            a, b = c[:-1], c[1:]
            own = (a + lo - 1) // size == blk
            a, b = a[own], b[own]
            if len(a):
                at.append(np.full(len(a), r))
                lo_pos.append(a - (k - 1) + lo)
                dig.append(np.stack([range_hash(u, a - (k - 1), b + 1, _BASE).view(np.int64), b + lo]))
        head = t.select([*RKEYS, "blk", *who]).take(pa.array(_long(at)))
        d = np.concatenate(dig, axis=1) if dig else np.zeros((2, 0), np.int64)
        return head.append_column("a", pa.array(_long(lo_pos), pa.int32())).append_column("b", pa.array(d[1], pa.int32())).append_column("digest", pa.array(d[0], pa.int64()))

    if owners:
        packed = packed.withColumn("owner", F.xxhash64("rec")).withColumn("owner2", F.xxhash64(F.reverse("rec")))
    c = map_arrow(packed.select(*RKEYS, "blk", "lo", "units", *who), chunks, f"rkey long, rkey2 long, blk int{''.join(f', {x} long' for x in who)}, a int, b int, digest long")

    def twice(df: DataFrame, *by: str) -> DataFrame:
        """Keys that two records hold: their smallest and largest record differ in one of the two hashes."""
        ends = [f(x).alias(f"{n}{k}") for k, x in enumerate(who or RKEYS) for n, f in (("x", F.min), ("y", F.max))]
        return df.groupBy(*by).agg(*ends).where("x0 < y0 or x1 < y1").select(*by)

    marked = c.join(twice(c, "digest"), "digest", "left_semi").groupBy(*RKEYS, "blk").agg(F.collect_list(F.struct("a", "b")).alias("at"))

    def windows(t: pa.Table) -> pa.Table:
        at, pos, h1, h2 = [], [], [], []
        marks = t.column("at").to_pylist()
        for r, lo, _blk, u in _each(t):
            cover = np.zeros(len(u) + 1, np.int64)
            for m in marks[r]:  # window starts that hold the whole chunk
                a, b = m["b"] - lo - span + 1, m["a"] - lo
                cover[max(a, 0)] += 1
                cover[max(b, -1) + 1] -= 1
            s = np.flatnonzero(np.cumsum(cover)[: max(0, len(u) - span + 1)] > 0)
            if len(s):
                at.append(np.full(len(s), r))
                pos.append(s + lo)
                h1.append(range_hash(u, s, s + span, _BASE).view(np.int64))
                h2.append(range_hash(u, s, s + span, _BASE2).view(np.int64))
        head = t.select([*RKEYS, "rec", "vol_no"]).take(pa.array(_long(at)))
        return head.append_column("pos", pa.array(_long(pos), pa.int32())).append_column("h1", pa.array(_long(h1), pa.int64())).append_column("h2", pa.array(_long(h2), pa.int64()))

    win = map_arrow(packed.select(*RKEYS, "rec", "vol_no", "blk", "lo", "units").join(marked, [*RKEYS, "blk"]), windows, "rkey long, rkey2 long, rec string, vol_no int, pos int, h1 long, h2 long")
    win = stage(win.withColumn("owner", F.xxhash64("rec")).withColumn("owner2", F.xxhash64(F.reverse("rec"))) if owners else win, "windows")
    both = win.join(twice(win, "h1", "h2"), ["h1", "h2"], "left_semi")
    # islands inside position ranges first, then over the few islands of a record
    both = both.select(*RKEYS, "rec", "vol_no", "pos", F.floor((F.col("pos") - 1) / size).alias("blk"))
    return _islands(_islands(both.select("*", F.col("pos").alias("first_pos"), (F.col("pos") + span - 1).alias("last_pos")), "blk")).select("rec", "vol_no", "first_pos", "last_pos")


def _islands(df: DataFrame, *by: str) -> DataFrame:
    """Merge intervals that touch or overlap, by record."""
    keys = [*RKEYS, "rec", "vol_no", *by]
    w = Window.partitionBy(*keys).orderBy("first_pos")
    reach = F.max("last_pos").over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("new", F.when(reach >= F.col("first_pos") - 1, 0).otherwise(1))
    df = df.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(*keys, "island").agg(F.min("first_pos").alias("first_pos"), F.max("last_pos").alias("last_pos")).drop("island")


def surface_units(tsv: DataFrame) -> DataFrame:
    """Tokens of volumes as units; a null surface is a unit of its own kind (equal to other nulls)."""
    t = tsv.where("work_stem is not null and vol_no is not null and i is not null")
    return t.select(F.col("work_stem").alias("rec"), "vol_no", F.col("i").alias("pos"), F.xxhash64(F.coalesce("surface", F.lit("\0"))).alias("unit"), *(k.alias(n) for k, n in zip(volume_keys(), RKEYS)))


def title_units(metadata: DataFrame) -> DataFrame:
    """Characters of the titles as stored; each distinct title of an id once, titles of one id never share."""
    t = metadata.where("id is not null and title_aozora <> ''").select(F.col("id").alias("rec"), F.col("title_aozora").alias("title")).distinct()
    t = t.select("rec", F.lit(0).alias("vol_no"), F.xxhash64("rec").alias("owner"), F.xxhash64("rec", "title").alias("rkey"), F.xxhash64("title", "rec").alias("rkey2"), F.posexplode(F.split("title", "")).alias("p", "ch"))
    return t.where("ch <> ''").select("rec", "vol_no", (F.col("p") + 1).alias("pos"), F.xxhash64("ch").alias("unit"), *RKEYS, "owner")


def shared_spans(tsv: DataFrame, metadata: DataFrame, token_span: int = 30, title_span: int = 16) -> DataFrame:
    """field, rec, vol_no, first_pos, last_pos of every longest run of shared positions.

    Nulls in keys drop the row (it belongs to no record), empty titles have no position, repeated rows count once,
    extra columns are ignored.
    """
    s = shared_positions(surface_units(tsv), token_span).withColumn("field", F.lit("surface"))
    m = shared_positions(title_units(metadata), title_span).withColumn("field", F.lit("title_aozora")).distinct()
    out = s.unionByName(m)
    return out.select("field", "rec", F.col("vol_no").cast("bigint").alias("vol_no"), F.col("first_pos").cast("bigint").alias("first_pos"), F.col("last_pos").cast("bigint").alias("last_pos"))


def record_lengths(tsv: DataFrame, metadata: DataFrame) -> DataFrame:
    """field, rec, vol_no, n: tokens of every volume, characters of every id's titles (the longest, if it has several).
    Titles are null or empty where there is none: such an id has no row."""
    v = token_rows(tsv).groupBy("work_stem", "vol_no").agg(F.count("*").alias("n")).select(F.lit("surface").alias("field"), F.col("work_stem").alias("rec"), F.col("vol_no").cast("bigint").alias("vol_no"), "n")
    t = metadata.where("id is not null and title_aozora <> ''").groupBy("id").agg(F.max(F.length("title_aozora")).cast("bigint").alias("n"))
    return v.unionByName(t.select(F.lit("title_aozora").alias("field"), F.col("id").alias("rec"), F.lit(0).cast("bigint").alias("vol_no"), "n"))


def shared_shares(spans: DataFrame, lengths: DataFrame) -> DataFrame:
    """For each record of ``lengths`` (field, rec, vol_no, n): n, how many positions are shared, and their share.
    Positions that runs of several titles of one id cover count once."""
    w = Window.partitionBy("field", "rec", "vol_no").orderBy("first_pos", "last_pos").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("last_pos") - F.greatest(F.col("first_pos") - 1, F.coalesce(F.max("last_pos").over(w), F.lit(0))))
    per = spans.withColumn("new", new).groupBy("field", "rec", "vol_no").agg(F.sum("new").alias("shared"))
    j = lengths.join(per, ["field", "rec", "vol_no"], "left")
    return j.select("field", "rec", "vol_no", "n", F.coalesce("shared", F.lit(0)).alias("shared"), F.round(F.coalesce("shared", F.lit(0)) / F.when(F.col("n") > 0, F.col("n")), 6).alias("share"))
