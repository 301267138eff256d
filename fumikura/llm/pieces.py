"""Problem 4: splitting oversized items at natural boundaries.

Method: structure-tree packing.  A volume is a tree of lines (closed by EOS rows), sentences, clauses and tokens,
written in post-order as one byte a token: the highest node that the token closes.  From a piece's first token on,
sibling subtrees are merged up to the limit, lines first; only where the next sibling is an oversized node (it has no
sibling's end in the second half of the limit) does the packing descend into that node, to its sentences, then
clauses, then tokens.  The next piece starts ``overlap - 1`` tokens before that end.

The chain of pieces of a volume is sequential, but it is entered in a block of positions at one of few offsets (less
than a piece's step), so a block is a function from the offset at which a piece begins in it to the offset in the next
one, worked out for all offsets at once.  The functions are composed by a prefix scan (``scan``); then every block
writes its pieces on its own.  No task holds more than a block, whatever the size of the volume.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fumikura.llm.scan import compose_maps, exclusive
from fumikura.plans.blocks import by_group, key_starts, map_arrow
from fumikura.sources.corpus import VKEYS, volume_keys
from fumikura.sources.stage import stage

LIMIT, OVERLAP, BLOCK = 400, 40, 16_384
#: Marks that end a sentence, marks that end a clause.
SENTENCE, CLAUSE = ("。", "．", "！", "？"), ("、", "，")
#: What a token closes: a line, a sentence, a clause, itself.
LINES, SENTENCES, CLAUSES = 3, 2, 1


def piece_ends(tree: np.ndarray, starts: int, left: int, limit: int) -> np.ndarray:
    """The last token of the piece that begins at each of the first ``starts`` tokens; ``left`` tokens of the volume
    follow from the first one on, of which ``tree`` holds as many as the pieces need."""
    s = np.arange(starts)
    rest = left - s <= limit
    top = np.minimum(s + limit - 1, len(tree) - 1)  # the last token that fits
    end, open_ = top.copy(), ~rest
    at = np.arange(len(tree))
    for node in (LINES, SENTENCES, CLAUSES):
        # siblings merged: the last end of a subtree of this kind that fits
        merged = np.maximum.accumulate(np.where(tree >= node, at, -1))[top] if len(tree) else top
        fits = open_ & (merged >= s + limit // 2)
        end[fits] = merged[fits]
        open_ &= ~fits  # the others descend into an oversized node
    end[rest] = left - 1
    return end


def block_map(end: np.ndarray, left: int, limit: int, overlap: int, size: int) -> np.ndarray:
    """For each offset at which a piece may begin in the block: the offset in the next block at which one begins
    there, or -1 if the last piece is reached."""
    to = np.where(left - np.arange(len(end)) <= limit, -1, end - overlap + 1)
    while True:
        inside = (to >= 0) & (to < size)
        if not inside.any():
            break
        to[inside] = to[to[inside]]
    out = np.full(limit - overlap, -1, np.int64)
    k = min(len(out), len(to))
    out[:k] = np.where(to[:k] >= 0, to[:k] - size, -1)
    return out


def packed_levels(tsv: DataFrame, block: int = BLOCK) -> DataFrame:
    """vkey, vkey2, work_stem, vol_no, blk, n, head (the block begins with an EOS row), levels (a byte a token).

    Broken rows (neither ``i`` nor ``pos1``) hold no token and are left out, rows without keys too; repeated rows
    count once.
    """
    t = tsv.where("work_stem is not null and vol_no is not null and line_no is not null and (i is not null or pos1 = 'EOS')")
    level = F.when(F.col("i").isNull(), 9).when(F.col("surface").isin(*SENTENCE), SENTENCES).when(F.col("surface").isin(*CLAUSE), CLAUSES).otherwise(0)
    t = t.select(*volume_keys(), "work_stem", "vol_no", F.floor(F.col("line_no") / block).cast("int").alias("blk"), "line_no", level.cast("tinyint").alias("lv"))

    def pack(x: pa.Table) -> pa.Table:
        line, lv = x.column("line_no").to_numpy(), x.column("lv").to_numpy()
        starts = key_starts(x, [*VKEYS, "blk"])
        new = np.ones(len(line), bool)
        new[1:] = line[1:] != line[:-1]
        new[starts] = True
        heads, data, n = [], [], []
        for a, b in zip(starts, np.append(starts[1:], len(line))):
            c = lv[a:b][new[a:b]]
            eos = c == 9
            heads.append(bool(eos[0]))
            before = np.zeros(len(c), bool)
            before[:-1] = eos[1:]
            c = np.where(before & ~eos, LINES, c)[~eos]
            data.append(c.astype(np.int8).tobytes())
            n.append(len(c))
        head = x.select([*VKEYS, "work_stem", "vol_no", "blk"]).take(pa.array(starts))
        return head.append_column("n", pa.array(n, pa.int64())).append_column("head", pa.array(heads, pa.bool_())).append_column("levels", pa.array(data, pa.binary()))

    return by_group(t, [*VKEYS, "blk"], ["line_no"], pack, "vkey long, vkey2 long, work_stem string, vol_no int, blk int, n long, head boolean, levels binary")


def position_blocks(packed: DataFrame, limit: int, overlap: int, size: int) -> DataFrame:
    """Blocks of ``size`` positions of the volumes above the limit, with the tokens after it that its pieces may need:
    keys, work_stem, vol_no, blk, left (tokens of the volume from its first one on), levels, f (``block_map``)."""
    per = packed.select(*VKEYS, "blk", "n")
    w = Window.partitionBy(*VKEYS)  # a row per block of lines
    per = per.withColumn("total", F.sum("n").over(w)).withColumn("at", F.sum("n").over(w.orderBy("blk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    rows = packed.drop("n").join(per.where(F.col("total") > limit), [*VKEYS, "blk"])

    def cut(t: pa.Table) -> pa.Table:
        src, blk, lo, kind, data = [], [], [], [], []
        for r, (at, n, head, lv) in enumerate(zip(*(t.column(c).to_pylist() for c in ("at", "n", "head", "levels")))):
            parts = [(at, lv, 0)] if n else []
            if head and at:
                parts.append((at - 1, bytes([LINES]), 1))  # the token before this block ends a line
            for a, x, k in parts:
                for p in range(max(0, (a - size - limit) // size + 1), (a + len(x) - 1) // size + 1):
                    u, v = max(a, p * size), min(a + len(x), p * size + size + limit)
                    if u < v:
                        src.append(r)
                        blk.append(p)
                        lo.append(u)
                        kind.append(k)
                        data.append(x[u - a : v - a])
        out = t.select([*VKEYS, "work_stem", "vol_no", "total"]).take(pa.array(src, pa.int64()))
        for name, v, kt in (("blk", blk, pa.int32()), ("lo", lo, pa.int64()), ("kind", kind, pa.int8()), ("data", data, pa.binary())):
            out = out.append_column(name, pa.array(v, kt))
        return out

    def build(t: pa.Table) -> pa.Table:
        starts = key_starts(t, [*VKEYS, "blk"])
        blk, lo, kind, total = (t.column(c).to_numpy() for c in ("blk", "lo", "kind", "total"))
        data = t.column("data")
        left, levels, f = [], [], []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows]):
            base = int(blk[a]) * size
            rest = int(total[a]) - base
            x = np.zeros(min(size + limit, rest), np.int8)
            for r in range(a, b):  # the ends found by the next block come last
                d = np.frombuffer(data[r].as_py(), np.int8)
                x[lo[r] - base : lo[r] - base + len(d)] = d
            left.append(rest)
            levels.append(x.tobytes())
            f.append(block_map(piece_ends(x, min(size, rest), rest, limit), rest, limit, overlap, size).astype("<i2").tobytes())
        out = t.select([*VKEYS, "work_stem", "vol_no", "blk"]).take(pa.array(starts))
        for name, v, kt in (("left", left, pa.int64()), ("levels", levels, pa.binary()), ("f", f, pa.binary())):
            out = out.append_column(name, pa.array(v, kt))
        return out

    cols = "vkey long, vkey2 long, work_stem string, vol_no int"
    parts = map_arrow(rows.select(*VKEYS, "work_stem", "vol_no", "at", F.octet_length("levels").alias("n"), "head", "levels", "total"), cut, f"{cols}, total long, blk int, lo long, kind tinyint, data binary")
    return by_group(parts, [*VKEYS, "blk"], ["kind", "lo"], build, f"{cols}, blk int, left long, levels binary, f binary", min_rows=500)


def surface_pieces(tsv: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, block: int = BLOCK) -> DataFrame:
    """work_stem, vol_no, first_pos, last_pos (from 1) of the pieces of volumes of more than ``limit`` tokens."""
    if not 0 < overlap <= limit // 2:
        raise ValueError("the overlap must be positive and at most half the limit")
    if limit > 32_000:
        raise ValueError("offsets are held in 16 bits")
    size = max(block, limit)
    blocks = stage(position_blocks(stage(packed_levels(tsv, block), "lines"), limit, overlap, size), "blocks")
    later = blocks.where("blk > 0").select(*VKEYS).distinct()  # volumes of several blocks
    f = blocks.join(later, VKEYS, "left_semi").select(*VKEYS, "blk", "f")
    entered = exclusive(stage(f, "maps"), VKEYS, compose_maps, b"")

    def write(t: pa.Table) -> pa.Table:
        src, first, last = [], [], []
        for r, (blk, left, lv, before) in enumerate(zip(*(t.column(c).to_pylist() for c in ("blk", "left", "levels", "before")))):
            s = int(np.frombuffer(before, "<i2")[0]) if before else 0  # a volume's first piece begins at 0
            end = piece_ends(np.frombuffer(lv, np.int8), min(size, left), left, limit)
            while 0 <= s < len(end):
                src.append(r)
                first.append(blk * size + s + 1)
                last.append(blk * size + int(end[s]) + 1)
                s = int(end[s]) - overlap + 1 if left - s > limit else -1
        out = t.select(["work_stem", "vol_no"]).take(pa.array(src, pa.int64()))
        return out.append_column("first_pos", pa.array(first, pa.int64())).append_column("last_pos", pa.array(last, pa.int64()))

    b = blocks.drop("f").join(entered, [*VKEYS, "blk"], "left")
    return map_arrow(b.select("work_stem", "vol_no", "blk", "left", "levels", "before"), write, "work_stem string, vol_no int, first_pos long, last_pos long")


def stated_pieces(metadata: DataFrame, tsv: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """id, first_pos, last_pos for works without rows in tsv, from their stated number of tokens; numbers that can't
    be read give none.  An id whose rows state different numbers counts with the first known one."""
    from fumikura.sources.corpus import works

    w = works(metadata.select(*metadata.columns)).where(F.col("tokens") > limit)
    held = tsv.where("work_stem is not null").select("work_stem").distinct()
    w = w.join(held, "work_stem", "left_anti")
    step = limit - overlap
    k = F.floor((F.col("tokens") - overlap - 1) / step)  # pieces after the first
    w = w.select("id", "tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), k)).alias("j"))
    first = F.col("j") * step + 1
    return w.select("id", first.alias("first_pos"), F.least(first + limit - 1, F.col("tokens")).alias("last_pos"))


def found(tsv: DataFrame, metadata: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    s = surface_pieces(tsv, limit, overlap).select(F.lit("surface").alias("field"), F.col("work_stem").alias("rec"), F.col("vol_no").cast("bigint").alias("vol_no"), "first_pos", "last_pos")
    m = stated_pieces(metadata, tsv, limit, overlap).select(F.lit("tokens").alias("field"), F.col("id").alias("rec"), F.lit(0).cast("bigint").alias("vol_no"), "first_pos", "last_pos")
    return s.unionByName(m)

