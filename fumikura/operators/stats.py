"""Corpus statistics: keyness, dispersion, lexicon, overlap and rank measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def g2(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Signed two-term log likelihood of a in c tokens against b in d tokens."""
    e1, e2 = c * (a + b) / (c + d), d * (a + b) / (c + d)
    part = lambda x, e: F.when(x > 0, x * F.ln(x / e)).otherwise(0.0)
    return F.when(a / c >= b / d, 1.0).otherwise(-1.0) * 2.0 * (part(a, e1) + part(b, e2))


def keyness(counts: DataFrame, group: str, least: int = 10, threshold: float = 15.13) -> DataFrame:
    """Per group: terms with at least ``least`` occurrences whose absolute G2 reaches the threshold.

    ``counts``: (group, term, n); rows without a group belong to neither side.  The reference is all other groups.
    """
    c = counts.where(F.col(group).isNotNull())
    size = c.groupBy(group).agg(F.sum("n").alias("n_in"))
    total = size.agg(F.sum("n_in").alias("n_all"))
    term = c.groupBy("term").agg(F.sum("n").alias("n_term"))
    a, b = F.col("n").cast("double"), (F.col("n_term") - F.col("n")).cast("double")
    nc, nd = F.col("n_in").cast("double"), (F.col("n_all") - F.col("n_in")).cast("double")
    j = c.where(F.col("n") >= least).join(term, "term").join(F.broadcast(size), group).crossJoin(F.broadcast(total))  # groups are few: periods or styles
    j = j.where(nd > 0).select(group, "term", F.col("n").alias("freq_in"), (F.col("n_term") - F.col("n")).alias("freq_out"), (a / nc * 1e6).alias("i"), (b / nd * 1e6).alias("o"), g2(a, b, nc, nd).alias("g"))
    return j.where(F.abs("g") >= threshold).select(group, "term", "freq_in", "freq_out", F.round("i", 2).alias("pm_in"), F.round("o", 2).alias("pm_out"), F.round(F.log2((F.col("i") + 0.01) / (F.col("o") + 0.01)), 3).alias("log_ratio"), F.round("g", 2).alias("g2"))


def document_frequency(counts: DataFrame, unit: str, group: str | None = None) -> DataFrame:
    """(term[, group]): units that hold the term and their proportion among the units (of the group)."""
    by = [group] if group else []
    total = counts.select(unit, *by).distinct().groupBy(*by).agg(F.count("*").alias("units"))
    d = counts.groupBy(*by, "term").agg(F.count_distinct(unit).alias("df"))
    d = d.join(F.broadcast(total), by) if by else d.crossJoin(F.broadcast(total))
    return d.select(*by, "term", "df", F.round(F.col("df") / F.col("units"), 6).alias("df_prop"))


def dispersion(counts: DataFrame, unit: str, group: str | None = None, least: int = 1) -> DataFrame:
    """Gries' DP per term (inside its group), the largest unit's share and that unit.

    Units without the term add their share of the corpus, which is one minus the shares of those that have it, so no
    grid of units and terms is formed.
    """
    by = [group] if group else []
    size = counts.groupBy(*by, unit).agg(F.sum("n").alias("len"))
    total = size.groupBy(*by).agg(F.sum("len").alias("corpus"))
    c = counts.join(size, [*by, unit])
    c = c.join(F.broadcast(total), by) if by else c.crossJoin(F.broadcast(total))
    t = counts.groupBy(*by, "term").agg(F.sum("n").alias("freq"), F.max("n").alias("most")).where(F.col("freq") >= least)
    c = c.join(t, [*by, "term"])
    f, s = F.col("n") / F.col("freq"), F.col("len") / F.col("corpus")
    first = F.min(F.when(F.col("n") == F.col("most"), F.col(unit)))
    return c.groupBy(*by, "term").agg(F.first("freq").alias("freq"), F.count("*").alias("units"), F.round(0.5 * (F.sum(F.abs(f - s)) + 1 - F.sum(s)), 4).alias("dp"), F.round(F.max(f), 4).alias("top_share"), first.alias("top_unit"))


def with_rank(df: DataFrame, x: str, *by: str, parts: int = 64) -> DataFrame:
    """Adds below (rows with a smaller x, in the group), equal (rows with the same x) and all (rows of the group).

    Ranks over all rows without one task that sees them all: values are dealt to ranges by approximate quantiles,
    counted by range and value, and summed up over ranges first; nulls in x must be gone before."""
    cuts = sorted(set(df.approxQuantile(x, [j / parts for j in range(1, parts)], 0.001)))
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(x))) if cuts else F.lit(0)
    per = df.groupBy(*by, x).agg(F.count("*").alias("equal")).withColumn("_part", part)
    whole = per.groupBy(*by, "_part").agg(F.sum("equal").alias("k"))
    w = Window.partitionBy(*by).orderBy("_part")  # at most ``parts`` rows a group
    whole = whole.select(*by, "_part", F.coalesce(F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("k").over(Window.partitionBy(*by)).alias("all"))
    inside = Window.partitionBy(*by, "_part").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    per = per.join(F.broadcast(whole) if not by else whole, [*by, "_part"]).withColumn("below", F.col("_before") + F.coalesce(F.sum("equal").over(inside), F.lit(0)))
    return df.join(per.select(*by, x, "below", "equal", "all"), [*by, x])


def spearman(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Spearman's correlation: Pearson's of average ranks; null where all values are equal."""
    r = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y))
    rank = lambda d, c, n: with_rank(d, c, *by).withColumn(n, F.col("below") + (F.col("equal") + 1) / 2).drop("below", "equal", "all")
    r = rank(rank(r, x, "rx"), y, "ry")
    return r.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.covar_pop("rx", "ry") / F.nullif(F.stddev_pop("rx") * F.stddev_pop("ry"), F.lit(0.0)), 6).alias("rho"))


def overlap_at(a: DataFrame, b: DataFrame, group: str, order: list[Column], k: int = 50) -> DataFrame:
    """Per group: the share of a's first k terms that are among b's, with denominator min(k, terms)."""
    w = Window.partitionBy(group).orderBy(*order)
    top = lambda d: d.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select(group, "term")
    ta, tb = top(a), top(b)
    n = ta.groupBy(group).agg(F.count("*").alias("na")).join(tb.groupBy(group).agg(F.count("*").alias("nb")), group)
    both = ta.join(tb, [group, "term"]).groupBy(group).agg(F.count("*").alias("common"))
    j = n.join(both, group, "left")
    return j.select(group, F.coalesce("common", F.lit(0)).alias("common"), F.round(F.coalesce("common", F.lit(0)) / F.least(F.lit(k), F.greatest("na", "nb")), 4).alias("overlap"))


def stop_list(chunks: DataFrame, min_df: int, max_ratio: float) -> DataFrame:
    """Terms in fewer than ``min_df`` chunks or in more than ``max_ratio`` of them."""
    d = chunks.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = chunks.agg(F.count("*").alias("n"))
    r = F.col("df") / F.col("n")
    return d.crossJoin(F.broadcast(n)).where((F.col("df") < min_df) | (r > max_ratio)).select("term", "df", F.round(r, 6).alias("ratio"))


def lexicon(tok: DataFrame, attributes: DataFrame) -> DataFrame:
    """Per lemma: count, works, dominant part of speech and share, top work and share, DP, the period in which it is
    relatively most frequent, top author share.

    ``tok`` (work_stem, lemma_key, pos1, pos2, pos3); ``attributes`` (work_stem, period, author).  Works without
    attributes form a period and an author of their own.
    """
    from fumikura.operators.tokens import pos_label

    t = tok.where(F.col("lemma_key") != "").select("work_stem", F.col("lemma_key").alias("term"), pos_label().alias("pos"))
    fine = t.groupBy("work_stem", "term", "pos").agg(F.count("*").alias("n"))  # the one pass over tokens
    c = fine.groupBy("work_stem", "term").agg(F.sum("n").alias("n"))
    pos = fine.groupBy("term", "pos").agg(F.sum("n").alias("n")).groupBy("term").agg(F.sum("n").alias("count"), F.max(F.struct("n", "pos")).alias("m"))
    pos = pos.select("term", "count", F.col("m.pos").alias("pos"), F.round(F.col("m.n") / F.col("count"), 4).alias("pos_share"))
    d = dispersion(c, "work_stem").select("term", F.col("units").alias("docs"), F.col("top_unit").alias("top_work"), F.col("top_share").alias("top_work_share"), "dp")
    a = c.join(attributes, "work_stem", "left").na.fill({"period": "不明", "author": "不明"})
    p = a.groupBy("period", "term").agg(F.sum("n").alias("n"))
    size = p.groupBy("period").agg(F.sum("n").alias("size"))
    peak = p.join(F.broadcast(size), "period").groupBy("term").agg(F.max_by("period", F.struct(F.col("n") / F.col("size"), "period")).alias("peak_period"))
    auth = a.groupBy("term", "author").agg(F.sum("n").alias("n")).groupBy("term").agg(F.round(F.max("n") / F.sum("n"), 4).alias("top_author_share"))
    return pos.join(d, "term").join(peak, "term").join(auth, "term")


def select_vocabulary(lex: DataFrame, include: list[str], exclude: list[str] = (), min_count: int = 1, max_docs: int | None = None, max_work_share: float = 1.0, max_author_share: float = 1.0, max_dp: float = 1.0) -> DataFrame:
    """Lexicon rows of the wanted parts of speech that pass every limit (a limit is broken only when exceeded)."""
    anyof = lambda ps: F.exists(F.array(*map(F.lit, ps)), lambda p: (F.col("pos") == p) | F.startswith(F.col("pos"), F.concat(p, F.lit("-"))))
    keep = anyof(include) if include else F.lit(True)
    drop = (F.col("count") < min_count) | (F.col("top_work_share") > max_work_share) | (F.col("top_author_share") > max_author_share) | (F.col("dp") > max_dp)
    if exclude:
        drop = drop | anyof(list(exclude))
    if max_docs is not None:
        drop = drop | (F.col("docs") > max_docs)
    return lex.where(keep & ~drop)


def monotone(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Per group: does the value only rise (or only fall) along the order?"""
    w = Window.partitionBy(group).orderBy(order)
    d = df.withColumn("step", F.col(value) - F.lag(value).over(w))
    return d.groupBy(group).agg(F.count("*").alias("n"), F.coalesce(F.bool_and(F.col("step") >= 0), F.lit(True)).alias("rises"), F.coalesce(F.bool_and(F.col("step") <= 0), F.lit(True)).alias("falls"))


def weighted_means(df: DataFrame, by: list[str], weight: str, values: list[str]) -> DataFrame:
    """Means weighted by a column, by stratum; rows without a value count for neither part."""
    return df.groupBy(*by).agg(F.count("*").alias("units"), *(F.round(F.sum(F.col(v) * F.col(weight)) / F.nullif(F.sum(F.when(F.col(v).isNotNull(), F.col(weight))), F.lit(0)), 6).alias(v) for v in values))
