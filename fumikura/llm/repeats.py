"""Problem 8: repetition inside a single document.

The method named (cross-document line frequency: hash normalised lines, count distinct documents per host, remove
lines above limits, reject depleted documents) measures what documents share with each other; it cannot give the
share of letters that a document repeats of itself.  So ``repeated`` uses another: every run of 30 letters of a
document is hashed by a rolling hash, and runs whose hash occurs earlier in the same document cover their letters.
It is one scan without a shuffle; the arrays of many documents are sorted together.

``line_frequency`` and ``clean`` are the named method, for boilerplate that documents of a host share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fumikura.llm.letters import letters, rolling
from fumikura.plans.blocks import by_bytes, map_arrow

RUN, SHARE_PCT = 30, 45
#: Bytes of documents whose letters are in arrays at a time.
PART_BYTES = 4_000_000


def repeated_letters(texts: list[str | None], run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """For each text: its letters (Arabic digits left out), and how many of them lie in ``run`` consecutive letters
    that also begin earlier in the text."""
    x, n = letters(texts, digits=False)
    if len(x) < run:
        return n, np.zeros(len(n), np.int64)
    h = rolling(x, run)
    ends = np.cumsum(n)
    doc = np.repeat(np.arange(len(n)), n)[: len(h)]
    inside = np.arange(len(h)) + run <= ends[doc]
    p = np.flatnonzero(inside)
    key = h[p] ^ (doc[p].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    o = np.argsort(key, kind="stable")  # equal runs of a text by position
    again = np.zeros(len(p), bool)
    again[o[1:]] = key[o][1:] == key[o][:-1]
    cover = np.zeros(len(x) + 1, np.int32)
    s = p[again]
    np.add.at(cover, s, 1)
    np.add.at(cover, s + run, -1)
    hit = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    return n, hit[ends] - hit[ends - n]


def repeated(docs: DataFrame, run: int = RUN) -> DataFrame:
    """doc_id, letters, repeated, share (null for texts without letters) of every row; a null text has no letters,
    rows with a null id are left out, repeated rows stay."""

    def fn(t: pa.Table) -> pa.Table:
        out = []
        for part in by_bytes(t, "text", PART_BYTES):
            n, r = repeated_letters(part.column("text").to_pylist(), run)
            share = np.round(r / np.maximum(n, 1), 6)
            out.append(pa.table({"doc_id": part.column("doc_id"), "letters": pa.array(n, pa.int64()), "repeated": pa.array(r, pa.int64()), "share": pa.array(share, pa.float64(), mask=n == 0)}))
        return pa.concat_tables(out)

    return map_arrow(docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), fn, "doc_id long, letters long, repeated long, share double")


def found(docs: DataFrame) -> DataFrame:
    """Documents with at least 45 percent of their letters repeated."""
    return repeated(docs).where(F.col("letters") > 0).where(F.col("repeated") * 100 >= F.col("letters") * SHARE_PCT).select("doc_id").distinct()


def _lines(docs: DataFrame, host: str) -> DataFrame:
    norm: Column = F.lower(F.regexp_replace("line", r"[^\p{L}\p{N}]", ""))
    d = docs.where("doc_id is not null").select("doc_id", F.col(host).alias("host"), F.posexplode(F.split("text", "\r\n|[\n\r]")).alias("pos", "line"))
    return d.withColumn("norm", norm).where("norm <> ''").withColumn("hash", F.xxhash64("norm"))


def line_frequency(docs: DataFrame, host: str = "source", min_docs: int = 2) -> DataFrame:
    """host, hash, docs, lines of every normalised line that ``min_docs`` documents of a host hold.

    Two steps, so a hot line is first reduced by document on the map side: distinct (host, hash, document), count.
    A null host is a host of its own; null and empty texts have no lines.
    """
    per = _lines(docs, host).groupBy("host", "hash", "doc_id").agg(F.count("*").alias("k"))
    return per.groupBy("host", "hash").agg(F.count("*").alias("docs"), F.sum("k").alias("lines")).where(F.col("docs") >= min_docs)


def clean(docs: DataFrame, host: str = "source", max_docs: int = 5, min_left: float = 0.5) -> DataFrame:
    """doc_id, lines, kept, rejected: lines that more than ``max_docs`` documents of the host hold are removed, and
    a document that keeps less than ``min_left`` of its characters is rejected."""
    hot = line_frequency(docs, host, max_docs + 1).select("host", "hash", F.lit(True).alias("hot"))
    ls = _lines(docs, host)
    j = ls.join(hot, ls["host"].eqNullSafe(hot["host"]) & (ls["hash"] == hot["hash"]), "left").select("doc_id", F.length("norm").alias("c"), F.coalesce("hot", F.lit(False)).alias("hot"))
    g = j.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(~F.col("hot")).alias("kept"), F.sum("c").alias("c"), F.sum(F.when(F.col("hot"), 0).otherwise(F.col("c"))).alias("left"))
    return g.select("doc_id", "lines", "kept", (F.col("left") < min_left * F.col("c")).alias("rejected"))
