"""Readers and writers of the text formats around the corpus."""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

REPORT_ROWS = 100_000
MORPHEMES = ("i", "surface", "lemma_key", "lemma", "orthbase", "lform", "pos1", "pos2", "pos3", "pos4", "ctype", "cform", "goshu")


def read_csv(spark: SparkSession, path: str, sep: str = ",", comment: str | None = None) -> DataFrame:
    """A table with a header; every cell is text; a byte-order mark before the first name is dropped."""
    r = spark.read.option("header", True).option("sep", sep).option("multiLine", sep == ",").option("escape", '"')
    df = (r.option("comment", comment) if comment else r).csv(path)
    return df.withColumnsRenamed({c: c.lstrip("﻿").strip() for c in df.columns})


def column(df: DataFrame, *names: str) -> Column:
    """The first column of that name, else the first whose name contains it; resolved before planning."""
    for n in names:
        if n in df.columns:
            return F.col(f"`{n}`")
    for n in names:
        for c in df.columns:
            if n in c:
                return F.col(f"`{c}`")
    raise KeyError(f"none of {names} among {df.columns}")


def read_morphemes(spark: SparkSession, path: str) -> DataFrame:
    """Morpheme tables: one file a volume, a comment line with provenance, a header, 13 columns; an EOS row ends a
    line.  Gives work_stem and vol_no from the file name (``person_work[_volume].tsv``), line_no, the columns; short
    rows are left out.  Empty features (an asterisk) become empty text.

    Lines are numbered by ``monotonically_increasing_id`` inside a file: whole files are read in order, so numbers
    rise along the file; they need not be consecutive.
    """
    t = spark.read.option("wholetext", False).text(path).select("value", F.col("_metadata.file_name").alias("f"), F.monotonically_increasing_id().alias("n"))
    c = F.split("value", "\t")
    t = t.where(~F.col("value").startswith("#")).withColumn("c", c).where((F.size("c") >= len(MORPHEMES)) & (F.get("c", F.lit(0)) != "i"))
    stem = F.regexp_extract("f", "^([0-9]+_[0-9]+)", 1)
    vol = F.coalesce(F.regexp_extract("f", "^[0-9]+_[0-9]+_([0-9]+)", 1).try_cast("int"), F.lit(1))
    clean = lambda k: F.when(F.get("c", F.lit(k)) == "*", "").otherwise(F.get("c", F.lit(k)))
    cols = [F.get("c", F.lit(0)).try_cast("int").alias("i"), *(clean(k).alias(m) for k, m in enumerate(MORPHEMES) if k)]
    t = t.select(stem.alias("work_stem"), vol.alias("vol_no"), "n", *cols)
    w = Window.partitionBy("work_stem", "vol_no").orderBy("n")  # a file, which one task read
    return t.withColumn("line_no", F.row_number().over(w)).drop("n")


def write_table(df: DataFrame, path: str, provenance: dict, partition_by: tuple[str, ...] = ()) -> None:
    """Parquet, and a JSON record beside it of what made it."""
    (df.write.partitionBy(*partition_by) if partition_by else df.write).mode("overwrite").parquet(path)
    write_provenance(df.sparkSession, path, provenance, df)


def write_provenance(spark: SparkSession, path: str, provenance: dict, df: DataFrame) -> None:
    record = {**provenance, "columns": [f"{n} {t}" for n, t in df.dtypes], "written": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}
    _write_text(spark, f"{path.rstrip('/')}.provenance.json", json.dumps(record, ensure_ascii=False, indent=1))


def read_provenance(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.text(f"{path.rstrip('/')}.provenance.json").collect()))


def export_csv(df: DataFrame, path: str, provenance: dict) -> None:
    """One CSV folder of a report (a page or a top-k) with the provenance in its own columns of the first row.  More than
    ``REPORT_ROWS`` rows are no report but an error; tables are written by ``write_table``."""
    if df.limit(REPORT_ROWS + 1).count() > REPORT_ROWS:
        raise ValueError(f"more than {REPORT_ROWS} rows for a report")
    note = json.dumps(provenance, ensure_ascii=False)
    w = Window.orderBy(F.monotonically_increasing_id())
    out = df.coalesce(1).withColumn("_n", F.row_number().over(w)).withColumn("provenance", F.when(F.col("_n") == 1, note)).drop("_n")
    out.write.mode("overwrite").option("header", True).csv(path)


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def menkuten_table(spark: SparkSession) -> DataFrame:
    """(plane, row, cell, ch) of the two planes of JIS X 0213, from Python's codec: 2 x 94 x 94 code points at most."""
    rows = []
    for plane in (1, 2):
        for r in range(1, 95):
            for c in range(1, 95):
                raw = bytes([0x8F] * (plane - 1) + [r + 0xA0, c + 0xA0])
                try:
                    rows.append((plane, r, c, raw.decode("euc_jis_2004")))
                except UnicodeDecodeError:
                    continue
    return spark.createDataFrame(rows, "plane int, row int, cell int, ch string")


def resolve_glyphs(notes: DataFrame, supplement: DataFrame, note: str = "note") -> DataFrame:
    """Adds ch and kind to notes on missing glyphs: the longest supplement key (key, ch) the note contains, then
    plane-row-cell, then U+hex; unresolved ones get the geta mark.  Distinct notes are resolved once."""
    spark = notes.sparkSession
    d = notes.select(note).where(F.col(note).isNotNull()).distinct()
    # candidates by the pairs of letters that note and key share, so the list may be of any size
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda p: F.substring(c, p, F.lit(2)))
    keys = supplement.where("key <> ''").select("key", "ch", F.substring("key", 1, 2).alias("gram"))
    parts = d.select(note, F.explode(F.array_distinct(F.concat(grams(F.col(note)), F.split(note, "")))).alias("gram"))
    s = parts.join(keys, "gram").where(F.col(note).contains(F.col("key"))).groupBy(note).agg(F.max_by("ch", F.struct(F.length("key"), "key")).alias("s"))
    at = [F.regexp_extract(note, "([12])-([0-9]{1,2})-([0-9]{1,2})", k).try_cast("int").alias(n) for k, n in ((1, "plane"), (2, "row"), (3, "cell"))]
    m = d.select(note, *at).join(F.broadcast(menkuten_table(spark).withColumnRenamed("ch", "m")), ["plane", "row", "cell"], "left").select(note, "m")
    u = F.regexp_extract(note, "U\\+([0-9A-Fa-f]{4,5})", 1)
    cp = F.when(u != "", F.decode(F.unhex(F.lpad(u, 8, "0")), "UTF-32"))
    j = d.join(s, note, "left").join(m, note, "left").select(note, F.coalesce("s", "m", cp, F.lit("〓")).alias("ch"), F.when(F.col("s").isNotNull(), "supplement").when(F.col("m").isNotNull(), "menkuten").when(cp.isNotNull(), "unicode").otherwise("unresolved").alias("kind"))
    return notes.join(j, note, "left")
