"""Co-occurrence, embeddings, document vectors and their confounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fumikura.functions.keys import draw_order
from fumikura.operators.stylometry import dot
from fumikura.plans import pairs as blocked


def cooccurrence(tok: DataFrame, window: int = 5, top: int = 3000, term: str = "lemma_key") -> DataFrame:
    """(a, b, n): how often b stands within ``window`` tokens after or before a in the same volume, over the ``top``
    most frequent terms; a term with itself is left out, both orders are given."""
    t = tok.where(F.col(term) != "").select("work_stem", "vol_no", "i", F.col(term).alias("term"))
    vocab = t.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(top).select("term")
    t = t.join(F.broadcast(vocab), "term")  # at most ``top`` terms
    ahead = t.select("work_stem", "vol_no", F.col("term").alias("a"), F.explode(F.sequence(F.col("i") + 1, F.col("i") + window)).alias("i"))
    half = ahead.join(t.withColumnRenamed("term", "b"), ["work_stem", "vol_no", "i"]).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))
    return half.union(half.select("b", "a", "n")).groupBy("a", "b").agg(F.sum("n").alias("n"))


def ppmi(co: DataFrame) -> DataFrame:
    """Positive pointwise mutual information in nats of co-occurrence counts; zeros are left out."""
    m = co.groupBy("a").agg(F.sum("n").alias("na"))
    total = m.agg(F.sum("na").alias("total"))
    j = co.join(F.broadcast(m), "a").join(F.broadcast(m.select(F.col("a").alias("b"), F.col("na").alias("nb"))), "b").crossJoin(F.broadcast(total))
    v = F.ln(F.col("n") * F.col("total") / (F.col("na").cast("double") * F.col("nb")))
    return j.select("a", "b", F.round(v, 6).alias("ppmi")).where("ppmi > 0")


def svd_vectors(matrix: DataFrame, value: str, dims: int = 100, limit: int = 3000) -> DataFrame:
    """(term, vec): U S of a square term matrix of at most ``limit`` terms, decomposed on the driver."""
    names = [r[0] for r in matrix.select("a").union(matrix.select("b")).distinct().orderBy("a").limit(limit + 1).collect()]
    if len(names) > limit:
        raise ValueError(f"more than {limit} terms")
    at = {x: j for j, x in enumerate(names)}
    x = np.zeros((len(names), len(names)))
    for a, b, v in matrix.select("a", "b", value).toLocalIterator():
        x[at[a], at[b]] = v
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    us = u[:, :dims] * s[:dims]
    us *= np.where(np.abs(us.max(axis=0)) >= np.abs(us.min(axis=0)), 1, -1)
    return matrix.sparkSession.createDataFrame([(t, [float(y) for y in us[j]]) for t, j in at.items()], "term string, vec array<double>")


def centroids(v: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """Mean vector of each key, by element."""
    e = v.select(key, F.posexplode(vec).alias("d", "x")).groupBy(key, "d").agg(F.avg("x").alias("x"))
    return e.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda y: y["x"]).alias("vec"))


def unit(vec: Column) -> Column:
    n = F.sqrt(dot(vec, vec))
    return F.transform(vec, lambda x: x / F.when(n > 0, n))


def neighbours(v: DataFrame, key: str, queries: Column, k: int = 10, vec: str = "vec", block: int = 4096) -> DataFrame:
    """Exact k nearest rows by cosine (ties by key) for the rows that ``queries`` selects, against all rows, in blocks
    of both: a pair of blocks keeps its k best of every query, and those are merged."""
    base = v.where(F.col(vec).isNotNull()).select(F.col(key).alias("key"), F.col(vec).alias("vec"))
    q = v.where(queries & F.col(vec).isNotNull()).select(F.col(key).alias("key"), F.col(vec).alias("vec"))
    every = blocked.nearest(q, base, "key", "vec", "cosine", k, "dist", size=block).select("q", "key", F.round(1 - F.col("dist"), 9).alias("sim"))
    w = Window.partitionBy("q").orderBy(F.desc("sim"), "key")
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def gaps(v: DataFrame, labels: list[str], vec: str = "vec") -> DataFrame:
    """Per attribute: exact mean cosine within and between its values and the gap, from sums of unit vectors: the sum
    over pairs is (|sum x|^2 - n) / 2, so no pair is formed.  Rows without a label are left out of it."""
    u = v.select(*labels, F.posexplode(unit(F.col(vec))).alias("d", "x"))
    out = None
    for lb in labels:
        e = u.where(F.col(lb).isNotNull())
        g = e.groupBy(lb, "d").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
        per = g.groupBy(lb).agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.max("n").alias("n"))
        allv = g.groupBy("d").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).agg(F.sum(F.col("s") * F.col("s")).alias("ss_all"), F.max("n").alias("n_all"))
        p = per.agg(F.sum((F.col("ss") - F.col("n")) / 2).alias("win"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pin")).crossJoin(allv)
        pout = F.col("n_all") * (F.col("n_all") - 1) / 2 - F.col("pin")
        wi, be = F.col("win") / F.nullif(F.col("pin"), F.lit(0.0)), ((F.col("ss_all") - F.col("n_all")) / 2 - F.col("win")) / F.nullif(pout, F.lit(0.0))
        r = p.select(F.lit(lb).alias("attribute"), F.round(wi, 6).alias("within"), F.round(be, 6).alias("between"), F.round(wi - be, 6).alias("gap"))
        out = r if out is None else out.union(r)
    return out


def centred(v: DataFrame, group: str, vec: str = "vec") -> DataFrame:
    """Vectors less the centroid of their group; rows without a group stay as they are."""
    c = centroids(v.where(F.col(group).isNotNull()), group, vec).withColumnRenamed("vec", "c")
    return v.join(c, group, "left").withColumn(vec, F.when(F.col("c").isNotNull(), F.zip_with(vec, "c", lambda x, y: x - y)).otherwise(F.col(vec))).drop("c")


def procrustes(base: DataFrame, other: DataFrame) -> np.ndarray:
    """Rotation that turns ``other``'s vectors onto ``base``'s over their common terms: U V' of other' base.  Only the
    cross product (dimensions squared) comes to the driver."""
    j = base.select("term", F.col("vec").alias("x")).join(other.select("term", F.col("vec").alias("y")), "term")
    e = j.select(F.posexplode("y").alias("r", "p"), "x").select("r", "p", F.posexplode("x").alias("c", "q"))
    rows = e.groupBy("r", "c").agg(F.sum(F.col("p") * F.col("q")).alias("m")).collect()
    n = 1 + max((max(r["r"], r["c"]) for r in rows), default=-1)
    m = np.zeros((n, n))
    for r in rows:
        m[r["r"], r["c"]] = r["m"]
    u, _, vt = np.linalg.svd(m)
    return u @ vt


def rotate(v: DataFrame, rotation: np.ndarray) -> DataFrame:
    cols = [F.array(*map(F.lit, map(float, c))) for c in rotation.T]
    return v.withColumn("vec", F.array(*(dot(F.col("vec"), c) for c in cols)))


def drift(slices: dict[str, DataFrame]) -> DataFrame:
    """Per term found in all slices (aligned, in order): cosine distance first to last, mean and largest step and
    where it is."""
    names = list(slices)
    j = None
    for k, n in enumerate(names):
        s = slices[n].select("term", unit(F.col("vec")).alias(f"v{k}"))
        j = s if j is None else j.join(s, "term")
    steps = F.array(*(F.struct((1 - dot(F.col(f"v{k}"), F.col(f"v{k + 1}"))).alias("d"), F.lit(f"{names[k]}>{names[k + 1]}").alias("at")) for k in range(len(names) - 1)))
    j = j.withColumn("steps", steps)
    return j.select("term", F.round(1 - dot(F.col("v0"), F.col(f"v{len(names) - 1}")), 6).alias("drift_first_last"), F.round(F.aggregate("steps", F.lit(0.0), lambda a, x: a + x["d"]) / F.size("steps"), 6).alias("drift_mean_step"), F.round(F.array_max("steps")["d"], 6).alias("drift_max_step"), F.array_max("steps")["at"].alias("max_step_at"))


def word_vectors(sentences: DataFrame, dims: int = 50, window: int = 3, min_count: int = 20, seed: int = 1, epochs: int = 1, partitions: int = 1) -> DataFrame:
    """(term, vec) by MLlib's skip-gram; the reference estimator is another (negative sampling), so results are
    compared by properties.  ``partitions`` models are trained side by side and averaged each epoch: more than one is
    needed beyond what one task can pass over, and asks for about as many more epochs."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    m = Word2Vec(vectorSize=dims, windowSize=window, minCount=min_count, seed=seed, maxIter=epochs, numPartitions=partitions, inputCol="words", outputCol="v").fit(sentences)
    return m.getVectors().select(F.col("word").alias("term"), vector_to_array("vector").alias("vec"))


def balanced(units: DataFrame, by: str, key: str, seed: int = 42, per_author: int | None = None, author: str = "author") -> DataFrame:
    """Rows of as many units in every slice as the smallest has, by hash; first at most ``per_author`` of an author in
    a slice (rows without an author count as one).  Ranks inside a slice come from counts of hash ranges."""
    u = units.withColumn("_h", draw_order(seed, key))
    if per_author is not None:
        u = u.withColumn("_r", F.row_number().over(Window.partitionBy(by, author).orderBy("_h", key))).where(F.col("_r") <= per_author).drop("_r")
    least = u.groupBy(by).agg(F.count("*").alias("n")).agg(F.min("n").alias("least"))
    u = u.withColumn("_part", F.substring("_h", 1, 2))
    per = u.groupBy(by, "_part").agg(F.count("*").alias("c"))
    before = per.select(by, "_part", (F.sum("c").over(Window.partitionBy(by).orderBy("_part")) - F.col("c")).alias("_b"))  # 256 rows a slice
    r = u.join(before, [by, "_part"]).withColumn("_r", F.col("_b") + F.row_number().over(Window.partitionBy(by, "_part").orderBy("_h", key)))
    return r.crossJoin(F.broadcast(least)).where(F.col("_r") <= F.col("least")).drop("_h", "_part", "_b", "_r", "least")  # one row


def drift_over_runs(runs: list[DataFrame]) -> DataFrame:
    """Per term that every run has: mean, sample deviation, coefficient of variation, least and largest drift from the
    first to the last slice, and the step that is most often the largest (ties by name)."""
    every = None
    for k, r in enumerate(runs):
        x = r.select("term", "drift_first_last", "max_step_at", F.lit(k).alias("run"))
        every = x if every is None else every.union(x)
    d = F.col("drift_first_last")
    g = every.groupBy("term").agg(F.count("*").alias("runs"), F.avg(d).alias("m"), F.stddev_samp(d).alias("sd"), F.min(d).alias("drift_min"), F.max(d).alias("drift_max"), F.mode("max_step_at", True).alias("max_step_at")).where(F.col("runs") == len(runs))
    return g.select("term", "runs", F.round("m", 6).alias("drift_mean"), F.round("sd", 6).alias("drift_sd"), F.round(F.col("sd") / F.nullif(F.col("m"), F.lit(0.0)), 6).alias("drift_cv"), "drift_min", "drift_max", "max_step_at")


def neighbour_stability(runs: list[DataFrame]) -> DataFrame:
    """Per query: the mean Jaccard similarity of its neighbours (q, key) over all pairs of runs; runs are few."""
    sets = [r.groupBy("q").agg(F.collect_set("key").alias(f"s{k}")) for k, r in enumerate(runs)]
    j = sets[0]
    for x in sets[1:]:
        j = j.join(x, "q")
    both = [F.size(F.array_intersect(f"s{a}", f"s{b}")) / F.size(F.array_union(f"s{a}", f"s{b}")) for a in range(len(runs)) for b in range(a + 1, len(runs))]
    return j.select("q", F.round(sum(both[1:], both[0]) / len(both), 6).alias("jaccard"))


def quartiles(drifts: DataFrame, value: str, label: str) -> DataFrame:
    """Rows, quartiles and the largest value of a drift table, under a label."""
    p = lambda q: F.round(F.percentile(value, q), 6)
    return drifts.agg(F.count("*").alias("terms"), p(0.25).alias("q1"), p(0.5).alias("median"), p(0.75).alias("q3"), F.round(F.max(value), 6).alias("most")).select(F.lit(label).alias("labels"), "*")


def chunk_vectors(chunks: DataFrame, words: DataFrame) -> DataFrame:
    """(chunk, vec): the mean of the vectors of a chunk's known words, which stands for a paragraph-vector model here;
    chunks without a known word have none."""
    e = chunks.select("chunk", F.explode("terms").alias("term")).join(words, "term").select("chunk", F.posexplode("vec").alias("d", "x"))
    g = e.groupBy("chunk", "d").agg(F.avg("x").alias("x"))
    return g.groupBy("chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda y: y["x"]).alias("vec"))


def cover(terms: DataFrame, known: DataFrame, least: float = 0.6) -> DataFrame:
    """How many of the terms have a row in ``known`` (term), their share, and whether it is enough to go by."""
    g = terms.select("term").distinct().join(known.select("term").distinct().withColumn("k", F.lit(1)), "term", "left").agg(F.count("*").alias("terms"), F.count("k").alias("known"))
    share = F.col("known") / F.nullif(F.col("terms"), F.lit(0))
    return g.select("terms", "known", F.round(share, 6).alias("share"), (share >= least).alias("enough"))


def fold_stratified(v: DataFrame, key: str, label: str, k: int = 5, seed: int = 0) -> DataFrame:
    """A fold of each labelled row such that every label is spread over all folds: rows of a label in the order of a
    hash, ranks from counts of hash ranges, dealt in turn."""
    d = v.where(F.col(label).isNotNull()).withColumn("_h", draw_order(seed, key)).withColumn("_part", F.substring("_h", 1, 2))
    per = d.groupBy(label, "_part").agg(F.count("*").alias("c"))
    before = per.select(label, "_part", (F.sum("c").over(Window.partitionBy(label).orderBy("_part")) - F.col("c")).alias("_b"))  # 256 rows a label
    r = d.join(before, [label, "_part"]).withColumn("fold", ((F.col("_b") + F.row_number().over(Window.partitionBy(label, "_part").orderBy("_h", key)) - 1) % k).cast("int"))
    return r.drop("_h", "_part", "_b")


def preservation(a: DataFrame, b: DataFrame, key: str, queries: Column, k: int = 5) -> DataFrame:
    """Of two spaces of the same rows: the mean share of the queries' k nearest rows in ``a`` that are so in ``b``."""
    x, y = (neighbours(v, key, queries, k).select("q", "key") for v in (a, b))
    j = x.join(y.withColumn("kept", F.lit(1)), ["q", "key"], "left").groupBy("q").agg((F.count("kept") / F.count("*")).alias("p"))
    return j.agg(F.count("*").alias("units"), F.round(F.avg("p"), 6).alias("preserved"))


def fold_by_group(v: DataFrame, group: str, k: int = 5) -> DataFrame:
    """A fold of each row such that a group is in one fold: groups in the order of their size, dealt to the folds
    there and back.  The order comes from counts of sizes first, then of hash ranges, so no task sees all groups."""
    sizes = v.groupBy(group).agg(F.count("*").alias("n")).withColumn("h", draw_order(0, group)).withColumn("part", F.substring("h", 1, 2))
    per = sizes.groupBy("n", "part").agg(F.count("*").alias("c"))
    of_n = per.groupBy("n").agg(F.sum("c").alias("c"))
    before_n = of_n.select("n", (F.sum("c").over(Window.orderBy(F.desc("n"))) - F.col("c")).alias("b1"))  # a row for each size that occurs
    before = per.select("n", "part", (F.sum("c").over(Window.partitionBy("n").orderBy("part")) - F.col("c")).alias("b2"))
    r = sizes.join(before, ["n", "part"]).join(before_n, "n")
    r = r.withColumn("r", (F.col("b1") + F.col("b2") + F.row_number().over(Window.partitionBy("n", "part").orderBy("h", group)) - 1) % (2 * k))
    return v.join(r.select(group, F.when(F.col("r") < k, F.col("r")).otherwise(2 * k - 1 - F.col("r")).cast("int").alias("fold")), group)


def grouped_accuracy(v: DataFrame, label: str, group: str, k: int = 5, vec: str = "vec", stratified: str | None = None) -> DataFrame:
    """Accuracy of a multinomial logistic classifier over folds by group, or over folds stratified by label if
    ``stratified`` names the rows' key, and of the majority label."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, StringIndexer
    from pyspark.ml.functions import array_to_vector

    from fumikura.sources.stage import stage

    rows = v.where(F.col(label).isNotNull() & F.col(group).isNotNull())
    d = (fold_stratified(rows, stratified, label, k) if stratified else fold_by_group(rows, group, k)).withColumn("x", array_to_vector(F.col(vec).cast("array<double>")))
    d = StringIndexer(inputCol=label, outputCol="y", stringOrderType="alphabetAsc").fit(d).transform(d)
    d = stage(d.select("y", "x", "fold"), "folds")  # read by every fold
    pipe = Pipeline(stages=[StandardScaler(withMean=True, inputCol="x", outputCol="z"), LogisticRegression(featuresCol="z", labelCol="y", maxIter=50, regParam=0.01)])
    out = None
    for f in range(k):
        p = pipe.fit(d.where(F.col("fold") != f)).transform(d.where(F.col("fold") == f)).select((F.col("prediction") == F.col("y")).alias("ok"))
        out = p if out is None else out.union(p)
    major = d.groupBy("y").agg(F.count("*").alias("n")).agg(F.max("n").alias("m"), F.sum("n").alias("t"))
    return out.agg(F.count("*").alias("units"), F.round(F.count_if("ok") / F.count("*"), 4).alias("accuracy")).crossJoin(major.select(F.round(F.col("m") / F.col("t"), 4).alias("majority")))


def permute(labels: DataFrame, key: str, label: str, seed: int = 42) -> DataFrame:
    """Labels of labelled rows in another order by hash: the control experiment.  Ranks come from row counts of hash
    ranges first, so rows are never in one task."""
    d = labels.where(F.col(label).isNotNull()).select(key, label)
    a = _ranked(d.select(key, draw_order(0, key).alias("h")), key)
    b = _ranked(d.select(key, label, draw_order(seed, key).alias("h")), key).select("rank", label)
    return a.select(key, "rank").join(b, "rank").drop("rank")


def _ranked(d: DataFrame, key: str) -> DataFrame:
    d = d.withColumn("part", F.substring("h", 1, 3))
    n = d.groupBy("part").agg(F.count("*").alias("k"))
    before = n.select("part", F.coalesce(F.sum("k").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # 4,096 rows
    return d.join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("h", key))).drop("part", "before", "h")
