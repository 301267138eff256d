"""Co-occurrence, embedding and confound queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fumikura.operators import tokens as tk
from fumikura.operators import vectors as ve
from fumikura.queries.base import ATT, CONTENT, TOK, attributes, tok, with_
from fumikura.sources.corpus import table
from fumikura.sources.stage import stage


def _vecs(s, d):
    e = table(s, d, "embeddings").where("vec_id is not null and embedding is not null")
    return e.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vec"), F.col("label").cast("int").alias("label"), (F.col("vec_id") % 4).cast("int").alias("author"))


def cooc(s, d):
    return ve.cooccurrence(tok(s, d, "lemma_key"))


def ppmi(s, d):
    return ve.ppmi(stage(cooc(s, d), "cooc"))


def ppmi_svd_norms(s, d):
    v = ve.svd_vectors(stage(ppmi(s, d), "ppmi"), "ppmi")
    return v.select("term", F.round(F.sqrt(ve.dot(F.col("vec"), F.col("vec"))), 4).alias("norm"))


def embed_nn(s, d):
    return ve.neighbours(_vecs(s, d), "vec_id", F.col("vec_id") % 20 == 0, 5).select("q", "key", F.round("sim", 6).alias("sim"), "rank")


def embed_within_between(s, d):
    return ve.gaps(_vecs(s, d), ["label", "author"])


def embed_nn_accuracy(s, d):
    v = _vecs(s, d)
    nn = ve.neighbours(v, "vec_id", F.col("vec_id") % 20 == 0, 1)
    lb = v.select("vec_id", "label")
    j = nn.join(lb.withColumnsRenamed({"vec_id": "q", "label": "lq"}), "q").join(lb.withColumnsRenamed({"vec_id": "key", "label": "lk"}), "key")
    return j.agg(F.count("*").alias("units"), F.round(F.count_if(F.col("lq").eqNullSafe(F.col("lk"))) / F.count("*"), 6).alias("rate"))


def embed_centroids(s, d):
    c = ve.centroids(_vecs(s, d), "label")
    return c.select("label", F.posexplode("vec").alias("d", "x")).select("label", "d", F.round("x", 6).alias("x"))


def embed_centering(s, d):
    v = _vecs(s, d)
    g0, g1 = ve.gaps(v, ["label"]), ve.gaps(ve.centred(v, "author"), ["label"])
    j = g0.select("attribute", F.col("gap").alias("gap_before")).join(g1.select("attribute", F.col("gap").alias("gap_after")), "attribute")
    return j.select("*", F.round(F.col("gap_after") / F.nullif(F.col("gap_before"), F.lit(0.0)), 4).alias("retention"))


def work_vectors(s, d):
    """Mean of term vectors per work (PPMI-SVD), as squared norms."""
    v = ve.svd_vectors(stage(ppmi(s, d), "ppmi"), "ppmi")
    c = tk.counts(tok(s, d, "lemma_key"), "work_stem").join(F.broadcast(v), "term")  # at most 3,000 terms
    e = c.select("work_stem", "n", F.posexplode("vec").alias("d", "x")).groupBy("work_stem", "d").agg((F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("x"))
    return e.groupBy("work_stem").agg(F.round(F.sqrt(F.sum(F.col("x") * F.col("x"))), 4).alias("norm"), F.count("*").alias("dims"))


def _slices(s, d):
    """Sentences of early and late works, as many works of both; a sentence is cut at every 1,000 positions."""
    p = attributes(s, d).select("work_stem", "author", F.when(F.col("period") <= "4", "early").otherwise("late").alias("slice")).where("period is not null")
    p = ve.balanced(p, "slice", "work_stem", per_author=20)
    t = tok(s, d, "lemma_key", sentences=True).where("lemma_key <> ''").join(p, "work_stem").withColumn("cut", F.floor(F.col("i") / 1000))
    g = t.groupBy("slice", "work_stem", "vol_no", "sent", "cut").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "lemma_key"))), lambda x: x["lemma_key"]).alias("words"))
    return stage(g, "sentences")


def _slice_vectors(s, d, seed=1, slices=None):
    g = _slices(s, d) if slices is None else slices
    return {n: stage(ve.word_vectors(g.where(F.col("slice") == n).select("words"), 16, 3, 5, seed), "vectors") for n in ("early", "late")}


def _drift(v):
    return ve.drift({"early": ve.rotate(v["early"], ve.procrustes(v["late"], v["early"])), "late": v["late"]})


def drift_table(s, d):
    return _drift(_slice_vectors(s, d))


def drift_runs(s, d):
    """Drift over three seeds."""
    g = _slices(s, d)
    return ve.drift_over_runs([_drift(_slice_vectors(s, d, k, g)) for k in (1, 2, 3)])


def drift_control(s, d):
    """Drift between slices against drift between works dealt to two slices by chance."""
    g = _slices(s, d)
    w = g.select("work_stem", "slice").distinct()
    perm = g.drop("slice").join(ve.permute(w, "work_stem", "slice"), "work_stem")
    return ve.quartiles(_drift(_slice_vectors(s, d, 1, g)), "drift_first_last", "real").union(ve.quartiles(_drift(_slice_vectors(s, d, 1, stage(perm, "permuted"))), "drift_first_last", "permuted"))


def slice_sizes(s, d):
    """Works in each slice after the balance."""
    p = attributes(s, d).where("period is not null").select("work_stem", "author", F.when(F.col("period") <= "4", "early").otherwise("late").alias("slice"))
    return ve.balanced(p, "slice", "work_stem", per_author=20).select("slice", "work_stem")


PROBES = ("男", "見る", "雨", "の")


def w2v_neighbours(s, d):
    return ve.neighbours(_slice_vectors(s, d)["late"], "term", F.col("term").isin(*PROBES), 5)


def neighbour_stability(s, d):
    g = _slices(s, d)
    return ve.neighbour_stability([ve.neighbours(_slice_vectors(s, d, k, g)["late"], "term", F.col("term").isin(*PROBES), 10).select("q", "key") for k in (1, 2, 3)])


def w2v_cover(s, d):
    """How many terms of the model the tokens give a part of speech for."""
    v = _slice_vectors(s, d)["late"]
    return ve.cover(v, tok(s, d, "lemma_key", "pos1").where("pos1 <> ''").select(F.col("lemma_key").alias("term")))


def chunk_means(s, d):
    """Chunk vectors of given term vectors (two numbers made of the term), so that SQL can make them too."""
    c = tk.chunks(tok(s, d, "lemma_key", "pos1", "pos2"), 200).select(F.concat_ws("#", "work_stem", "chunk_no").alias("chunk"), "terms")
    h = lambda k: F.conv(F.substring(F.md5("term"), k, 2), 16, 10).cast("double")
    w = c.select(F.explode("terms").alias("term")).distinct().select("term", F.array(h(1), h(3)).alias("vec"))
    v = ve.chunk_vectors(c, w)
    return v.select("chunk", F.round(F.col("vec")[0], 6).alias("x"), F.round(F.col("vec")[1], 6).alias("y"))


def projection_quality(s, d):
    """How many of the nearest rows stay so when only the first half of the dimensions is kept."""
    v = _vecs(s, d)
    return ve.preservation(v, v.withColumn("vec", F.expr("slice(vec, 1, cast(size(vec) / 2 as int))")), "vec_id", F.col("vec_id") % 20 == 0, 5)


def stratified_cv(s, d):
    return ve.grouped_accuracy(_vecs(s, d), "label", "author", stratified="vec_id")


def group_cv(s, d):
    return ve.grouped_accuracy(_vecs(s, d), "label", "author")


def perm_control(s, d):
    v = _vecs(s, d)
    p = ve.permute(v, "vec_id", "label")
    real, ctrl = ve.gaps(v, ["label"]), ve.gaps(v.drop("label").join(p, "vec_id"), ["label"])
    return real.withColumn("labels", F.lit("real")).union(ctrl.withColumn("labels", F.lit("permuted")))


QUERIES = {f.__name__: f for f in (cooc, ppmi, ppmi_svd_norms, embed_nn, embed_within_between, embed_nn_accuracy, embed_centroids, embed_centering, work_vectors, drift_table, drift_runs, drift_control, slice_sizes, w2v_neighbours, neighbour_stability, w2v_cover, chunk_means, projection_quality, stratified_cv, group_cv, perm_control)}

_CO = "vc AS (SELECT lemma_key FROM tok WHERE lemma_key <> '' GROUP BY lemma_key ORDER BY count(*) DESC, lemma_key LIMIT 3000), tv AS (SELECT work_stem, vol_no, i, lemma_key AS term FROM tok WHERE lemma_key IN (SELECT lemma_key FROM vc)), co AS (SELECT x.term AS a, y.term AS b, count(*) AS n FROM tv x JOIN tv y ON x.work_stem = y.work_stem AND x.vol_no = y.vol_no AND y.i BETWEEN x.i - 5 AND x.i + 5 AND x.i <> y.i WHERE x.term <> y.term GROUP BY ALL)"
_V = "v0 AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec, CAST(label AS INTEGER) AS label, CAST(vec_id % 4 AS INTEGER) AS author FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL), v1 AS (SELECT vec_id, label, author, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS u FROM v0)"
_GAP = lambda lb, src="v1": f"SELECT '{lb}' AS attribute, round(avg(c) FILTER (WHERE same), 6) AS within, round(avg(c) FILTER (WHERE NOT same), 6) AS between, round(avg(c) FILTER (WHERE same) - avg(c) FILTER (WHERE NOT same), 6) AS gap FROM (SELECT list_dot_product(x.u, y.u) AS c, x.{lb} = y.{lb} AS same FROM {src} x JOIN {src} y ON x.vec_id < y.vec_id WHERE x.{lb} IS NOT NULL AND y.{lb} IS NOT NULL)"
_NNQ = "nq AS (SELECT x.vec_id AS q, y.vec_id AS key, round(list_dot_product(x.u, y.u), 9) AS sim, row_number() OVER (PARTITION BY x.vec_id ORDER BY round(list_dot_product(x.u, y.u), 9) DESC, y.vec_id) AS rank FROM v1 x JOIN v1 y ON x.vec_id <> y.vec_id WHERE x.vec_id % 20 = 0)"
_CEN = "ex AS (SELECT vec_id, author, label, unnest(vec) AS x, generate_subscripts(vec, 1) AS d FROM v0), ce AS (SELECT vec_id, author, label, d, x - avg(x) OVER (PARTITION BY author, d) AS x FROM ex), cl AS (SELECT vec_id, author, label, list(x ORDER BY d) AS vec FROM ce GROUP BY ALL), v2 AS (SELECT vec_id, label, author, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS u FROM cl)"
SQL = {
    "cooc": with_(TOK, _CO) + "SELECT * FROM co",
    "ppmi": with_(TOK, _CO) + ", m AS (SELECT a, sum(n) AS n FROM co GROUP BY a), t AS (SELECT sum(n) AS t FROM co) SELECT * FROM (SELECT co.a, co.b, round(ln(co.n * t / (CAST(x.n AS DOUBLE) * y.n)), 6) AS ppmi FROM co JOIN m x ON x.a = co.a JOIN m y ON y.a = co.b, t) WHERE ppmi > 0",
    "embed_nn": with_(_V, _NNQ) + "SELECT q, key, round(sim, 6) AS sim, rank FROM nq WHERE rank <= 5",
    "embed_within_between": with_(_V) + _GAP("label") + " UNION ALL " + _GAP("author"),
    "embed_nn_accuracy": with_(_V, _NNQ) + "SELECT count(*) AS units, round(count(*) FILTER (WHERE a.label IS NOT DISTINCT FROM b.label) / count(*), 6) AS rate FROM nq JOIN v0 a ON a.vec_id = q JOIN v0 b ON b.vec_id = key WHERE rank = 1",
    "perm_control": with_(_V, "rk AS (SELECT vec_id, u, label, row_number() OVER (ORDER BY md5('0|' || vec_id), vec_id) AS ra, row_number() OVER (ORDER BY md5('42|' || vec_id), vec_id) AS rb FROM v1 WHERE label IS NOT NULL), pm AS (SELECT a.vec_id, a.u, b.label FROM rk a JOIN rk b ON a.ra = b.rb)") + "SELECT *, 'real' AS labels FROM (" + _GAP("label") + ") UNION ALL SELECT *, 'permuted' FROM (" + _GAP("label", "pm") + ")",
    "slice_sizes": with_(ATT) + ", p AS (SELECT work_stem, CASE WHEN period <= '4' THEN 'early' ELSE 'late' END AS slice, author, md5('42|' || work_stem) AS h FROM att WHERE period IS NOT NULL), q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slice, author ORDER BY h, work_stem) AS ra FROM p) WHERE ra <= 20), n AS (SELECT min(k) AS least FROM (SELECT count(*) AS k FROM q GROUP BY slice)) SELECT slice, work_stem FROM (SELECT *, row_number() OVER (PARTITION BY slice ORDER BY h, work_stem) AS r FROM q), n WHERE r <= least",
    "chunk_means": with_(TOK, f"ct AS (SELECT work_stem, lemma_key AS term, row_number() OVER (PARTITION BY work_stem ORDER BY vol_no, i) - 1 AS rk FROM tok WHERE {CONTENT} AND lemma_key <> ''), c0 AS (SELECT work_stem || '#' || CAST(rk // 200 AS VARCHAR) AS chunk, term, count(*) OVER (PARTITION BY work_stem, rk // 200) AS k FROM ct)") + "SELECT chunk, round(avg(('0x' || substr(md5(term), 1, 2))::INTEGER), 6) AS x, round(avg(('0x' || substr(md5(term), 3, 2))::INTEGER), 6) AS y FROM c0 WHERE k >= 100 GROUP BY chunk",
    "projection_quality": with_(_V, _NNQ) + ", v2 AS (SELECT vec_id, list_transform(vec[1:len(vec) // 2], lambda x: x / sqrt(list_dot_product(vec[1:len(vec) // 2], vec[1:len(vec) // 2]))) AS u FROM v0), n2 AS (SELECT x.vec_id AS q, y.vec_id AS key, row_number() OVER (PARTITION BY x.vec_id ORDER BY round(list_dot_product(x.u, y.u), 9) DESC, y.vec_id) AS rank FROM v2 x JOIN v2 y ON x.vec_id <> y.vec_id WHERE x.vec_id % 20 = 0), j AS (SELECT nq.q, count(n2.key) / count(*) AS p FROM nq LEFT JOIN n2 ON n2.q = nq.q AND n2.key = nq.key AND n2.rank <= 5 WHERE nq.rank <= 5 GROUP BY nq.q) SELECT count(*) AS units, round(avg(p), 6) AS preserved FROM j",
    "embed_centroids": with_(_V) + ", e AS (SELECT label, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS d FROM v0) SELECT label, CAST(d AS INTEGER) AS d, round(avg(x), 6) AS x FROM e GROUP BY ALL",
    "embed_centering": with_(_V, _CEN) + ", a AS (" + _GAP("label") + "), b AS (" + _GAP("label", "v2") + ") SELECT a.attribute, a.gap AS gap_before, b.gap AS gap_after, round(b.gap / nullif(a.gap, 0), 4) AS retention FROM a JOIN b USING (attribute)",
}
