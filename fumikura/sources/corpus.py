"""The corpus tables as the operators want them: tokens once each, metadata one row per work in one writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fumikura.functions import keys


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Names of the two keys of a volume.
VKEYS = ["vkey", "vkey2"]


def volume_keys() -> list[Column]:
    """Two 64-bit hashes of work and volume, by which blocks are grouped without comparing strings in the sort; 128
    bits together, so that two volumes never share both."""
    return [F.xxhash64("work_stem", "vol_no").alias("vkey"), F.xxhash64("vol_no", "work_stem").alias("vkey2")]


def token_rows(tsv: DataFrame, *columns: str, block: int = 4096) -> DataFrame:
    """Rows of tokens, each once: repeated rows (equal but for ``loaded_at``) share work, volume and ``i``.

    Partitioned by (work, volume, block of ``block`` positions), so a hot volume is split, and an aggregation by
    work or volume that follows combines on the map side over whole blocks.
    """
    t = tsv.where("work_stem is not null and vol_no is not null and i is not null").withColumn("blk", F.floor((F.col("i") - 1) / block).cast("int"))
    t = t.select("work_stem", "vol_no", "blk", "i", *columns).repartition("work_stem", "vol_no", "blk")
    return t.groupBy("work_stem", "vol_no", "blk", "i").agg(*(F.first(c).alias(c) for c in columns)) if columns else t.distinct()


def works(metadata: DataFrame) -> DataFrame:
    """One row per work: id, work_stem and the categories in one writing (repeated rows mean the same; the first
    known value of each column counts, in the order of ``loaded_at``)."""
    m = metadata.where("id is not null").select(
        keys.strip(F.col("id")).alias("id"),
        keys.work_stem(F.col("aozora_person_id"), F.col("aozora_work_id")).alias("work_stem"),
        keys.period_number(F.col("period")).alias("period"),
        keys.category(F.col("genre_main")).alias("genre_main"),
        keys.sex(F.col("author_sex")).alias("author_sex"),
        keys.category(F.col("register_level")).alias("register_level"),
        keys.stated_number(F.col("tokens")).alias("tokens"),
        F.col("loaded_at"),
    )
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(F.coalesce("loaded_at", F.lit("9999-12-31").cast("timestamp")), F.col(c)))).alias(c) for c in ("work_stem", "period", "genre_main", "author_sex", "register_level", "tokens")]
    return m.groupBy("id").agg(*first)


def attributes(metadata: DataFrame) -> DataFrame:
    """work_stem, period, genre_main, author_sex, register_level, tokens, author, title, year of every work, one row each."""
    w = works(metadata).where("work_stem is not null").groupBy("work_stem").agg(*(F.min(c).alias(c) for c in ("period", "genre_main", "author_sex", "register_level", "tokens")))
    text = lambda c: keys.strip(keys.narrow(F.col(c))).alias(c)
    a = metadata.select(keys.work_stem(F.col("aozora_person_id"), F.col("aozora_work_id")).alias("work_stem"), text("author_ja"), text("title_aozora"), F.expr("try_cast(year_first as int)").alias("year"))
    a = a.where("work_stem is not null").groupBy("work_stem").agg(F.min("author_ja").alias("author"), F.min("title_aozora").alias("title"), F.min("year").alias("year"))
    return w.join(a, "work_stem")
