"""Delta, attribution, containment and agreement queries.  Works with fewer than 300 tokens carry no profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from fumikura.operators import neardup, quality
from fumikura.operators import stylometry as st
from fumikura.operators import tokens as tk
from fumikura.queries.base import ATT, TOK, attributes, tok, with_
from fumikura.sources.corpus import table

N = 50
#: Share of the shorter text's runs of twelve characters that another text has.
CONTAINED = 0.05
QUESTIONED = "099001_040404"


def _sources(s, d):
    """Documents by source as long texts: words of letters per source."""
    docs = table(s, d, "documents").where("source is not null and text <> ''")
    w = docs.select(F.col("source").alias("work_stem"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[\\p{L}\\p{N}]+"), 0)).alias("lemma_key"))
    return w


def _rel(s, d, n=N):
    return tk.relative_frequencies(_sources(s, d), n)


def z_table(s, d):
    return st.z_scores(_rel(s, d)).withColumn("z", F.round("z", 6))


def delta_pairs(s, d):
    return st.delta(_rel(s, d)).withColumn("delta", F.round("delta", 5))


def cosine_delta(s, d):
    return st.cosine_delta(_rel(s, d)).withColumn("delta", F.round("delta", 5))


def closest_pairs(s, d):
    return delta_pairs(s, d).orderBy("delta", "a", "b").limit(10)


def delta_nn(s, d):
    return st.nearest_unit(st.z_scores(_rel(s, d)))


def delta_nn_accuracy(s, d):
    labels = _rel(s, d).select("work_stem").distinct().withColumn("kind", F.substring_index("work_stem", "_", 1))
    return st.same_label_rate(delta_nn(s, d), labels, "work_stem", "kind")


def delta_attribution(s, d):
    c = tk.counts(tok(s, d, "lemma_key"), "work_stem")
    return st.attribution(c, attributes(s, d).select("work_stem", "author"), QUESTIONED, 50)


def pca_scores(s, d):
    return st.pca_scores(st.z_scores(_rel(s, d), zero="drop"))


def ward_dendrogram(s, d):
    return st.ward_clusters(delta_pairs(s, d), "delta")


def _texts(s, d):
    return table(s, d, "documents").where("doc_id is not null and text <> ''")


#: A letter of Han or kana is a word, and so is a run of other letters and digits.
_CJK = "\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}ー"
_WORD = f"[{_CJK}]|[\\p{{L}}\\p{{N}}&&[^{_CJK}]]+"


def _words():
    return neardup.words(F.col("text"))


def shingle_containment(s, d):
    return st.similar_sets(_texts(s, d), "doc_id", neardup.characters(F.col("text")), CONTAINED)


def _whole_texts(s, d):
    return table(s, d, "documents").where("doc_id is not null and text is not null")


def near_dups(s, d):
    return st.similar_sets(_whole_texts(s, d), "doc_id", _words(), 0.8, "jaccard")


def near_dup_links(s, d):
    """A row for every document; one without a text is a class of its own."""
    links = st.duplicate_links(_whole_texts(s, d), "doc_id", _words())
    every = table(s, d, "documents").where("doc_id is not null").select("doc_id").join(links, "doc_id", "left")
    return every.select("doc_id", F.coalesce("class", "doc_id").alias("class"), F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("links", F.lit(0)).alias("links"))


def _edited(s, d):
    """Every text, and a copy of it without its first and last five characters."""
    t = _whole_texts(s, d).select("doc_id", "text")
    return t.union(t.select(F.col("doc_id") + 1_000_000_000, F.expr("substring(text, 6, greatest(length(text) - 10, 0))")))


def near_dups_edited(s, d):
    return st.similar_sets(_edited(s, d), "doc_id", _words(), 0.8, "jaccard")


def duplication_findings(s, d):
    """Texts, and their first halves under other ids, by how much of the shorter one the other has."""
    t = _texts(s, d).select("doc_id", "text")
    t = t.union(t.select(F.col("doc_id") + 1_000_000_000, F.expr("substring(text, 1, cast(floor(length(text) / 2) as int))")))
    p = st.similar_sets(t, "doc_id", neardup.characters(F.col("text")), 0.15)
    return quality.duplication(p)


def twin_profiles(s, d):
    p = table(s, d, "documents").where("doc_id is not null and text <> ''").select("source", F.length("text").alias("c"), F.length(F.regexp_replace("text", "[^\\u4e00-\\u9fff]", "")).alias("k"))
    p = p.groupBy("source").agg(F.sum("c").cast("double").alias("chars"), F.count("*").cast("double").alias("docs"), (F.sum("k") / F.sum("c")).alias("kanji_ratio"))
    return st.closest_profiles(p, "source", ["chars", "docs", "kanji_ratio"])


def js_divergence(s, d):
    c = tk.counts(_sources(s, d), "work_stem").withColumn("p", F.col("n") / F.sum("n").over(_by()))
    return st.js_divergence(c, "work_stem", "term", "p")


def _by():
    from pyspark.sql.window import Window

    return Window.partitionBy("work_stem")


def spearman_spaces(s, d):
    return st.rank_agreement(delta_pairs(s, d), js_divergence(s, d), "delta", "jsd")


QUERIES = {f.__name__: f for f in (z_table, delta_pairs, cosine_delta, closest_pairs, delta_nn, delta_nn_accuracy, delta_attribution, pca_scores, ward_dendrogram, shingle_containment, near_dups, near_dups_edited, duplication_findings, near_dup_links, twin_profiles, js_divergence, spearman_spaces)}

_W = "wd AS (SELECT source AS work_stem, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents WHERE source IS NOT NULL AND text <> ''), cw AS (SELECT work_stem, term, count(*) AS n FROM wd GROUP BY ALL)"
_REL = f"tp AS (SELECT term FROM cw GROUP BY term ORDER BY sum(n) DESC, term LIMIT {N}), sz AS (SELECT work_stem, sum(n) AS total FROM cw GROUP BY ALL), rl AS (SELECT work_stem, term, coalesce(n, 0) / total AS rel FROM sz CROSS JOIN tp LEFT JOIN cw USING (work_stem, term))"
_Z = "zz AS (SELECT work_stem, term, (rel - avg(rel) OVER (PARTITION BY term)) / (CASE WHEN stddev_pop(rel) OVER (PARTITION BY term) > 0 THEN stddev_pop(rel) OVER (PARTITION BY term) ELSE 1e-12 END) AS z FROM rl)"
_D = "dl AS (SELECT x.work_stem AS a, y.work_stem AS b, round(avg(abs(x.z - y.z)), 5) AS delta FROM zz x JOIN zz y USING (term) WHERE x.work_stem < y.work_stem GROUP BY ALL)"
_NN = "nn AS (SELECT a, min_by(b, (delta, b)) AS b, min(delta) AS delta FROM (SELECT a, b, delta FROM dl UNION ALL SELECT b, a, delta FROM dl) GROUP BY a)"
_JS = """pp AS (SELECT work_stem, term, n / sum(n) OVER (PARTITION BY work_stem) AS p FROM cw), gr AS (SELECT x.work_stem AS a, y.work_stem AS b FROM (SELECT DISTINCT work_stem FROM cw) x, (SELECT DISTINCT work_stem FROM cw) y WHERE x.work_stem < y.work_stem),
cm AS (SELECT x.work_stem AS a, y.work_stem AS b, sum((-x.p * log2(x.p) - y.p * log2(y.p) + (x.p + y.p) * log2(x.p + y.p)) / 2) AS less FROM pp x JOIN pp y USING (term) WHERE x.work_stem < y.work_stem GROUP BY ALL),
js AS (SELECT a, b, round(greatest(0.0e0, least(1.0e0, 1.0e0 - coalesce(less, 0.0e0))), 6) AS jsd FROM gr LEFT JOIN cm USING (a, b))"""


def _contain(sets: str, least: str, measure: str = "containment") -> str:
    of = "least(na, nb)" if measure == "containment" else "(na + nb - common)"
    return f"""WITH {sets}, cl AS (SELECT min(doc_id) AS k, count(*) AS copies, s FROM dd WHERE len(s) > 0 GROUP BY s),
ee AS (SELECT k, copies, len(s) AS n, unnest(s) AS x FROM cl), jj AS (SELECT p.k AS a, q.k AS b, count(*) AS common, any_value(p.n) AS na, any_value(q.n) AS nb, any_value(p.copies) AS a_class, any_value(q.copies) AS b_class FROM ee p JOIN ee q USING (x) WHERE p.k < q.k GROUP BY p.k, q.k),
pr AS (SELECT a, b, common, round(common / {of}, 6) AS {measure}, a_class, b_class FROM jj WHERE common / {of} >= {least})
"""


_BODY = "regexp_replace(text, '[\\s\\x{3000}]', '', 'g')"
# words: blanks around every letter of Han or kana, then runs of letters and digits; a text of fewer than five words has
# one shingle of all of them, or of itself; hashed, so that five strings aren't kept for every place
_WORDS = "w0 AS (SELECT doc_id, text, regexp_extract_all(regexp_replace(lower(text), '([\\p{Han}\\p{Hiragana}\\p{Katakana}ー])', ' \\1 ', 'g'), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL), dd AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda p: hash(array_to_string(w[p:p + 4], ' '))) WHEN len(w) > 0 THEN [hash('few ' || array_to_string(w, ' '))] ELSE [hash('none ' || text)] END)) AS s FROM w0)"
SQL = {
    "z_table": with_(_W, _REL, _Z) + "SELECT work_stem, term, round(z, 6) AS z FROM zz",
    "delta_pairs": with_(_W, _REL, _Z, _D) + "SELECT * FROM dl",
    "cosine_delta": with_(_W, _REL, _Z) + "SELECT x.work_stem AS a, y.work_stem AS b, round(1 - sum(x.z * y.z) / (sqrt(sum(x.z * x.z)) * sqrt(sum(y.z * y.z))), 5) AS delta FROM zz x JOIN zz y USING (term) WHERE x.work_stem < y.work_stem GROUP BY ALL",
    "closest_pairs": with_(_W, _REL, _Z, _D) + "SELECT * FROM dl ORDER BY delta, a, b LIMIT 10",
    "delta_nn": with_(_W, _REL, _Z, _D, _NN) + "SELECT * FROM nn",
    "delta_nn_accuracy": with_(_W, _REL, _Z, _D, _NN) + "SELECT count(*) AS units, round(count(*) FILTER (WHERE split_part(a, '_', 1) = split_part(b, '_', 1)) / count(*), 6) AS rate FROM nn",
    "delta_attribution": with_(TOK, ATT, "cw AS (SELECT work_stem, lemma_key AS term, count(*) AS n FROM tok WHERE lemma_key <> '' GROUP BY ALL)", f"tp AS (SELECT term FROM cw WHERE work_stem <> '{QUESTIONED}' GROUP BY term ORDER BY sum(n) DESC, term LIMIT 50), sz AS (SELECT work_stem, sum(n) AS size FROM cw GROUP BY ALL), rl AS (SELECT work_stem, term, coalesce(n, 0) * 1e4 / size AS rel FROM sz CROSS JOIN tp LEFT JOIN cw USING (work_stem, term)), ms AS (SELECT term, avg(rel) AS mu, stddev_pop(rel) AS sd FROM rl WHERE work_stem <> '{QUESTIONED}' GROUP BY term HAVING stddev_pop(rel) > 0), zz AS (SELECT work_stem, term, (rel - mu) / sd AS z FROM rl JOIN ms USING (term)), pf AS (SELECT author, term, avg(z) AS pz FROM zz JOIN att USING (work_stem) WHERE work_stem <> '{QUESTIONED}' AND author IS NOT NULL GROUP BY ALL), dd AS (SELECT author, term, abs(pz - z) AS df FROM pf JOIN (SELECT term, z FROM zz WHERE work_stem = '{QUESTIONED}') USING (term))") + "SELECT author, round(avg(df), 5) AS delta, max_by(term, (round(df, 9), term)) AS strongest FROM dd GROUP BY author",
    "shingle_containment": _contain(f"dd AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN length({_BODY}) >= 12 THEN list_transform(range(1, length({_BODY}) - 10, 6), lambda p: substring({_BODY}, CAST(p AS INTEGER), 12)) ELSE [] END)) AS s FROM documents WHERE doc_id IS NOT NULL AND text <> '')", f"{CONTAINED}e0") + "SELECT * FROM pr",
    "near_dups": _contain(_WORDS, "0.8e0", "jaccard") + "SELECT * FROM pr",
    "near_dups_edited": _contain(_WORDS.replace("FROM documents WHERE", "FROM (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id + 1000000000, substring(text, 6, greatest(length(text) - 10, 0)) FROM documents) WHERE"), "0.8e0", "jaccard") + "SELECT * FROM pr",
    "duplication_findings": _contain(f"dd AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN length({_BODY}) >= 12 THEN list_transform(range(1, length({_BODY}) - 10, 6), lambda p: substring({_BODY}, CAST(p AS INTEGER), 12)) ELSE [] END)) AS s FROM (SELECT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text <> '' UNION ALL SELECT doc_id + 1000000000, substring(text, 1, length(text) // 2) FROM documents WHERE doc_id IS NOT NULL AND text <> ''))", "0.15e0") + "SELECT CASE WHEN containment >= 0.4e0 THEN 'FATAL' ELSE 'WARN' END AS level, 'duplication' AS \"check\", CAST(a AS VARCHAR) || ' / ' || CAST(b AS VARCHAR) AS target, CAST(containment AS VARCHAR) AS detail FROM pr",
    "near_dup_links": _contain(_WORDS, "0.8e0", "jaccard") + ", lk AS (SELECT k, count(*) AS links FROM (SELECT a AS k FROM pr UNION ALL SELECT b FROM pr) GROUP BY k) SELECT d.doc_id, coalesce(cl.k, d.doc_id) AS class, coalesce(copies, 1) AS copies, coalesce(links, 0) AS links FROM documents d LEFT JOIN dd USING (doc_id) LEFT JOIN cl USING (s) LEFT JOIN lk USING (k) WHERE d.doc_id IS NOT NULL",
    "twin_profiles": "WITH p AS (SELECT source, CAST(sum(length(text)) AS DOUBLE) AS c, CAST(count(*) AS DOUBLE) AS d, sum(length(regexp_replace(text, '[^\\x{4e00}-\\x{9fff}]', '', 'g'))) / sum(length(text)) AS k FROM documents WHERE doc_id IS NOT NULL AND text <> '' GROUP BY source), z AS (SELECT source, (c - avg(c) OVER ()) / nullif(stddev_pop(c) OVER (), 0) AS c, (d - avg(d) OVER ()) / nullif(stddev_pop(d) OVER (), 0) AS d, (k - avg(k) OVER ()) / nullif(stddev_pop(k) OVER (), 0) AS k FROM p) SELECT x.source AS a, y.source AS b, round(sqrt(coalesce((x.c - y.c) ** 2, 0) + coalesce((x.d - y.d) ** 2, 0) + coalesce((x.k - y.k) ** 2, 0)), 6) AS dist FROM z x JOIN z y ON x.source < y.source ORDER BY dist, a, b LIMIT 1",
    "js_divergence": with_(_W, _JS) + "SELECT * FROM js",
    "spearman_spaces": with_(_W, _REL, _Z, _D, _JS) + ", j AS (SELECT delta AS x, jsd AS y FROM dl JOIN js USING (a, b)), r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM j) SELECT count(*) AS n, round(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 6) AS rho FROM r",
}
