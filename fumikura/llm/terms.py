"""Problem 2: how distinctive a term is per record.

Method: smoothed language-model divergence.  With p(t|d) = (tf + mu p(t|C)) / (n_d + mu), a term's score is its part
p(t|d) log2(p(t|d) / p(t|C)) of the relative entropy between the Dirichlet-smoothed record distribution and the
collection distribution; terms found in fewer than ``min_df`` records get no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fumikura.sources.corpus import token_rows, works
from fumikura.sources.stage import stage

MU = 1000.0


def work_terms(tsv: DataFrame) -> DataFrame:
    """(work_stem, term, tf): a term is a non-empty lemma up to its first hyphen (a lemma that begins with one has
    none).  Repeated rows count once; null and empty lemmas are no term."""
    t = token_rows(tsv, "lemma")
    t = t.withColumn("term", F.substring_index("lemma", "-", 1)).where("term <> ''")
    return t.groupBy("work_stem", "term").agg(F.count("*").alias("tf"))


def distinctive(counts: DataFrame, rec: str, min_df: int = 1, mu: float = MU) -> DataFrame:
    """``counts``: (rec, term, tf[, works]).  Adds df (records with the term), cf (in the collection) and score.

    Marginals by term and by record are two aggregates joined back; a hot term has one row per record, the join's
    other side one row, so AQE can split it.  Null records or terms are dropped, an empty table gives none.
    """
    c = counts.where(F.col(rec).isNotNull() & F.col("term").isNotNull())
    by_term = c.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).where(F.col("df") >= min_df)
    by_rec = c.groupBy(rec).agg(F.sum("tf").alias("n"))
    total = c.agg(F.sum("tf").alias("all_n"))
    p_c = F.col("cf") / F.col("all_n")
    p_d = (F.col("tf") + mu * p_c) / (F.col("n") + mu)
    j = c.join(by_term, "term").join(by_rec, rec).crossJoin(F.broadcast(total))  # one row
    return j.withColumn("score", F.round(p_d * F.log2(p_d / p_c), 12)).drop("all_n", "n")


def work_periods(metadata: DataFrame) -> DataFrame:
    """(work_stem, period): the smallest known period of the ids that name the work."""
    return works(metadata).where("work_stem is not null and period is not null").groupBy("work_stem").agg(F.min("period").alias("period"))


def period_terms(counts: DataFrame, metadata: DataFrame) -> DataFrame:
    """(period, term, tf, works) over the works that have a period."""
    return counts.join(work_periods(metadata), "work_stem").groupBy("period", "term").agg(F.sum("tf").alias("tf"), F.count("*").alias("works"))


def found(tsv: DataFrame, metadata: DataFrame) -> DataFrame:
    """Rows of the scored tables: terms held by at most two works and occurring six times in the work; terms of one
    period only, twelve times in at least four works (a document-frequency cutoff over works).  Counts alone decide
    which rows these are; such a term's score may be zero or negative.  The rows of each record are in the order of
    the score, highest first (ties by term)."""
    counts = stage(work_terms(tsv), "terms")  # read by six aggregates and joins
    w = distinctive(counts, "work_stem").where("tf >= 6 and df <= 2").select(F.lit("work").alias("unit"), F.col("work_stem").alias("rec"), "term", "score")
    p = distinctive(period_terms(counts, metadata), "period").where("tf >= 12 and works >= 4 and df = 1").select(F.lit("period").alias("unit"), F.col("period").alias("rec"), "term", "score")
    return w.unionByName(p).orderBy("unit", "rec", F.desc("score"), "term").select("unit", "rec", "term")


def top_terms(tsv: DataFrame, metadata: DataFrame, k: int = 20) -> DataFrame:
    """The k most characteristic terms of every work and period (ties by term)."""
    from pyspark.sql.window import Window

    counts = stage(work_terms(tsv), "terms")
    cols = ["unit", "rec", "term", "tf", "df", "cf", "score"]
    w = distinctive(counts, "work_stem", min_df=2).withColumn("unit", F.lit("work")).withColumnRenamed("work_stem", "rec").select(*cols)
    p = distinctive(period_terms(counts, metadata), "period").withColumn("unit", F.lit("period")).withColumnRenamed("period", "rec").select(*cols)
    by = Window.partitionBy("unit", "rec").orderBy(F.desc("score"), "term")
    return w.unionByName(p).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
