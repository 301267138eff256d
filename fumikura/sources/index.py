"""The token index: built once from the raw rows, opened by every query.

``tokens``: each token once, with the number of its sentence, in the order of volume and position, and beside it the
forms that follow (and precede) it in its sentence.  So a phrase is a filter on one row: its terms are pushed into the
scan, nothing is shuffled or joined.  Columns are dictionary-encoded; bloom filters on the two forms let a rare word
skip row groups.  ``forms``: frequencies by form and part of speech.  ``sizes``: tokens of each work.  ``works``: one
row of attributes a work.  A JSON record says what it was made of.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fumikura.operators import tokens as tk
from fumikura.plans.blocks import halo_blocks
from fumikura.sources.formats import read_provenance, write_provenance
from fumikura.sources.stage import keep, shared_dir

#: How many following tokens are beside each token, and how many preceding ones.
AHEAD, BEHIND, BLOCK = 3, 2, 8192
COLUMNS = ("surface", "lemma_key", "lemma", "orthbase", "lform", "pos1", "pos2", "pos3", "goshu")
NO_WORKS = "work_stem string, period string, genre_main string, author_sex string, register_level string, tokens long, author string, title string, year int"
BESIDE = ("surface", "lemma_key", "pos1")


@dataclass
class Index:
    spark: SparkSession
    path: str

    @cached_property
    def tokens(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/tokens")

    @cached_property
    def forms(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/forms")

    @cached_property
    def sizes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/sizes")

    @cached_property
    def works(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/works")

    @cached_property
    def provenance(self) -> dict:
        return read_provenance(self.spark, self.path)


def with_neighbours(tok: DataFrame, block: int = BLOCK) -> DataFrame:
    """Tokens with the columns of ``BESIDE`` of the next tokens of their sentence (``surface_1`` ...) and the surfaces
    before (``surface_m1`` ...); null outside the sentence.  Blocks of positions overlap by as much as is looked at,
    so no task holds more than a block of a volume."""
    cols = tok.columns
    e = tok.select("*", F.explode(halo_blocks(F.col("i") - 1, block, max(AHEAD, BEHIND))).alias("_blk"))
    w = Window.partitionBy("work_stem", "vol_no", "_blk").orderBy("i")

    def at(c: str, k: int):
        move = lambda x: F.lead(x, k).over(w) if k > 0 else F.lag(x, -k).over(w)
        return F.when((move("i") == F.col("i") + k) & (move("sent") == F.col("sent")), move(c))

    near = {f"{c}_{k}": at(c, k) for k in range(1, AHEAD + 1) for c in BESIDE if c in cols}
    near |= {f"surface_m{k}": at("surface", -k) for k in range(1, BEHIND + 1)}
    e = e.select("*", *(x.alias(n) for n, x in near.items()))
    return e.where(F.col("_blk") == F.floor((F.col("i") - 1) / block)).drop("_blk")


def build(tsv: DataFrame, works: DataFrame, path: str, source: dict | None = None) -> Index:
    """Write the index; ``works`` has one row a work_stem.  An empty table gives an empty index."""
    spark = tsv.sparkSession
    t = with_neighbours(tk.tokens(tsv, *(c for c in COLUMNS if c in tsv.columns), sentences=True))
    w = t.write.mode("overwrite")
    for c in ("lemma_key", "surface"):
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true")
    w.parquet(f"{path}/tokens")
    index = Index(spark, path)
    t = index.tokens
    forms = t.groupBy(*(c for c in ("lemma_key", "surface", "pos1", "pos2") if c in t.columns)).agg(F.count("*").alias("n"))
    forms.write.mode("overwrite").parquet(f"{path}/forms")
    t.groupBy("work_stem").agg(F.count("*").alias("tokens")).write.mode("overwrite").parquet(f"{path}/sizes")
    works.write.mode("overwrite").parquet(f"{path}/works")
    total, words = index.forms.agg(F.sum("n"), F.sum(F.when(~tk.is_punct(), F.col("n")))).first()
    write_provenance(spark, path, {**(source or {}), "tokens": int(total or 0), "words": int(words or 0)}, index.tokens)
    return index


def open_index(spark: SparkSession, path: str) -> Index:
    """An index that was built before; ``FileNotFoundError`` if there is none or it isn't complete."""
    if not _exists(spark, f"{path.rstrip('/')}.provenance.json"):
        raise FileNotFoundError(path)
    return Index(spark, path)


_OPEN: dict[tuple[str, str], Index] = {}


def of_tables(spark: SparkSession, sf_dir: str) -> Index:
    """The session's index of a folder of tables: built by the first query that asks for it (and again if its files or
    the tables' have changed since), in a place of its own in the shared folder, and removed when the session ends."""
    from fumikura.sources.corpus import attributes, table

    sig = _signature(spark, f"{sf_dir}/tsv.parquet", f"{sf_dir}/corpus_metadata_v2.parquet")
    key = (spark.sparkContext.applicationId, sig)
    if key not in _OPEN or not _exists(spark, f"{_OPEN[key].path}.provenance.json"):
        path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
        keep(spark, path, f"{path}.provenance.json")
        known = _exists(spark, f"{sf_dir}/corpus_metadata_v2.parquet")
        works = attributes(table(spark, sf_dir, "corpus_metadata_v2")) if known else spark.createDataFrame([], NO_WORKS)
        _OPEN[key] = build(table(spark, sf_dir, "tsv"), works, path, {"source": sf_dir, "signature": sig})
    return _OPEN[key]


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def _signature(spark: SparkSession, *paths: str) -> str:
    out = []
    for x in filter(lambda x: _exists(spark, x), paths):
        p, fs = _path(spark, x)
        for f in [fs.getFileStatus(p), *fs.listStatus(p)]:
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.md5(json.dumps(out).encode()).hexdigest()
