"""Topic queries.  Theta and phi are made from the tokens, so that SQL can make them too: a term belongs to the topic
that its MD5 gives; a chunk is 200 content tokens of a work."""

from __future__ import annotations

from pyspark.sql import functions as F

from fumikura.operators import stats
from fumikura.operators import tokens as tk
from fumikura.operators import topics as tp
from fumikura.queries.base import ATT, CONTENT, TOK, attributes, tok, with_
from fumikura.sources.stage import stage

K = 8


def _chunks(s, d):
    c = tk.chunks(tok(s, d, "lemma_key", "pos1", "pos2"), 200)
    return c.select("work_stem", F.concat_ws("#", "work_stem", "chunk_no").alias("chunk"), "terms")


def _topic(term):
    return (F.conv(F.substring(F.md5(term), 1, 2), 16, 10).cast("int") % K).cast("int")


def _tables(s, d):
    ch = stage(_chunks(s, d), "chunks")
    t = ch.select("chunk", F.explode("terms").alias("term")).withColumn("topic", _topic(F.col("term")))
    phi = t.groupBy("topic", "term").agg(F.count("*").alias("n"))
    n = t.groupBy("chunk").agg(F.count("*").alias("all_n"))
    c = t.groupBy("chunk", "topic").agg(F.count("*").alias("n"))
    topics = s.range(K).select(F.col("id").cast("int").alias("topic"))
    theta = n.crossJoin(F.broadcast(topics)).join(c, ["chunk", "topic"], "left").select("chunk", "topic", (F.coalesce("n", F.lit(0)) / F.col("all_n")).alias("p"))
    return ch, stage(theta, "theta"), stage(phi, "phi")


def _att(s, d):
    return _chunks(s, d).select("chunk", "work_stem").join(attributes(s, d).select("work_stem", "period", "genre_main", "author"), "work_stem", "left")


def topic_means(s, d):
    return tp.mean_theta(_tables(s, d)[1])


def topic_by_period(s, d):
    return tp.mean_theta(_tables(s, d)[1], _att(s, d), "period")


def topic_by_genre(s, d):
    return tp.mean_theta(_tables(s, d)[1], _att(s, d), "genre_main")


def topic_lift(s, d):
    return tp.lift(_tables(s, d)[1], _att(s, d), "period")


def topic_entropy(s, d):
    e = tp.entropy(_tables(s, d)[1]).join(_att(s, d).select("chunk", "period"), "chunk")
    return e.groupBy("period").agg(F.count("*").alias("chunks"), F.round(F.avg("entropy"), 5).alias("mean"), F.round(F.stddev_pop("entropy"), 5).alias("sd"))


def relevance(s, d):
    return tp.relevance(_tables(s, d)[2])


def topic_relatedness(s, d):
    _, theta, phi = _tables(s, d)
    return tp.relatedness(theta, phi, 500)


def topic_work_shares(s, d):
    return tp.shares_of_works(_tables(s, d)[1], F.substring_index("chunk", "#", 1))


def topic_graph(s, d):
    r = stage(topic_relatedness(s, d).select("a", "b", "clr_corr"), "relatedness")
    return tp.similarity_graph(r, "clr_corr", 2)


def topic_bipartite(s, d):
    return tp.bipartite(topic_work_shares(s, d))


def topic_communities(s, d):
    return tp.communities(topic_graph(s, d))


def topic_modularity(s, d):
    """Of topics put together by their number modulo three, and of the communities found: the second is no smaller."""
    e = stage(topic_graph(s, d), "graph")
    third = e.select(F.col("a").alias("node")).union(e.select("b")).distinct().withColumn("community", F.col("node") % 3)
    return tp.modularity(e, third)


def topic_profiles(s, d):
    _, theta, phi = _tables(s, d)
    return tp.profiles(theta, _att(s, d), "period", phi)


def topic_representatives(s, d):
    return tp.representative(_tables(s, d)[1])


def topic_coherence(s, d):
    ch, _, phi = _tables(s, d)
    return tp.coherence(phi, ch)


def topic_fingerprint(s, d):
    return tp.fingerprint(_tables(s, d)[2])


def doc_topics_read(s, d):
    theta = _tables(s, d)[1]
    g = theta.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("topic", "p"))).alias("z"))
    dense = F.concat_ws("\t", F.lit("0"), "chunk", F.array_join(F.transform("z", lambda x: x["p"].cast("string")), "\t"))
    pairs = F.concat_ws("\t", F.lit("0"), F.concat("chunk", F.lit("+")), F.array_join(F.transform("z", lambda x: F.concat_ws("\t", x["topic"].cast("string"), x["p"].cast("string"))), "\t"))
    r = tp.read_doc_topics(g.select(F.explode(F.array(dense, pairs)).alias("value")))
    return r.groupBy("topic").agg(F.count("*").alias("rows"), F.round(F.avg("p"), 6).alias("mean"))


def lda_fit(s, d):
    theta, phi = tp.fit_lda(stage(_chunks(s, d).select("chunk", "terms"), "chunks"), 5)
    return theta.groupBy("topic").agg(F.round(F.avg("p"), 4).alias("mean"), F.count("*").alias("chunks"))


def topic_terms(s, d):
    return tp.term_profile(_tables(s, d)[2])


def topic_authors(s, d):
    return tp.author_mass(_tables(s, d)[1], _att(s, d).select("chunk", "author"))


def topic_filtered(s, d):
    """Relevant terms of the topics among nouns and verbs that no work holds for itself."""
    lex = stats.lexicon(tok(s, d, "lemma_key", "pos1", "pos2", "pos3"), attributes(s, d).select("work_stem", "period", "author"))
    return tp.relevance(tp.chosen_terms(_tables(s, d)[2], lex, 5, ["名詞", "動詞"], 0.9, 0.8, 0.95), 0.6, 5)


def stopped_chunks(s, d):
    """Chunks without the most frequent fifty terms."""
    c = _chunks(s, d).select("chunk", "terms")
    stop = tk.mfw(tok(s, d, "lemma_key"), 50).select("term")
    return tp.without_stopwords(c, stop).select("chunk", F.size("terms").alias("left"))


def topic_keys_read(s, d):
    """Lines of topic, weight and words made of the relevant terms, read again."""
    r = tp.relevance(_tables(s, d)[2], 1.0, 5).groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), " ").alias("w"))
    k = tp.read_topic_keys(r.select(F.concat_ws("\t", "topic", F.lit("0.5"), "w").alias("value")))
    return k.select("topic", "alpha", F.size("words").alias("words"))


def lda_sweep(s, d):
    """Models of the stopped chunks for three numbers of topics; compared by properties in the tests."""
    c = stage(tp.without_stopwords(_chunks(s, d).select("chunk", "terms"), tk.mfw(tok(s, d, "lemma_key"), 50).select("term")), "stopped")
    return tp.sweep(c, [3, 5, 8], max_iter=5)


def lda_chain(s, d):
    """From a fitted model to what is made of it: topics with their terms, their peak period and their largest author."""
    c = stage(_chunks(s, d).select("chunk", "terms"), "chunks")
    theta, phi = tp.fit_lda(c, 5)
    theta, phi = stage(theta, "theta"), stage(phi.withColumnRenamed("weight", "n"), "phi")
    p = tp.profiles(theta, _att(s, d), "period", phi).select("topic", "peak", "peak_ratio", "words")
    a = tp.author_mass(theta, _att(s, d).select("chunk", "author")).groupBy("topic").agg(F.max("share").alias("top_author_share"))
    return p.join(a, "topic").join(tp.term_profile(phi), "topic")


QUERIES = {f.__name__: f for f in (topic_terms, topic_authors, topic_filtered, stopped_chunks, topic_keys_read, lda_sweep, lda_chain, topic_means, topic_by_period, topic_by_genre, topic_lift, topic_entropy, relevance, topic_relatedness, topic_work_shares, topic_graph, topic_bipartite, topic_communities, topic_modularity, topic_profiles, topic_representatives, topic_coherence, topic_fingerprint, doc_topics_read, lda_fit)}

_T = f"""ct AS (SELECT work_stem, lemma_key AS term, row_number() OVER (PARTITION BY work_stem ORDER BY vol_no, i) - 1 AS rk FROM tok WHERE {CONTENT} AND lemma_key <> ''),
c0 AS (SELECT work_stem, work_stem || '#' || CAST(rk // 200 AS VARCHAR) AS chunk, term, count(*) OVER (PARTITION BY work_stem, rk // 200) AS k FROM ct),
c1 AS (SELECT work_stem, chunk, term, CAST(('0x' || substr(md5(term), 1, 2)) AS INTEGER) % {K} AS topic FROM c0 WHERE k >= 100),
phi AS (SELECT topic, term, count(*) AS n FROM c1 GROUP BY ALL), cn AS (SELECT chunk, any_value(work_stem) AS work_stem, count(*) AS all_n FROM c1 GROUP BY chunk), cc AS (SELECT chunk, topic, count(*) AS n FROM c1 GROUP BY ALL),
th AS (SELECT cn.chunk, work_stem, CAST(t.topic AS INTEGER) AS topic, coalesce(n, 0) / all_n AS p FROM cn CROSS JOIN (SELECT unnest(range({K})) AS topic) t LEFT JOIN cc ON cc.chunk = cn.chunk AND cc.topic = t.topic),
ta AS (SELECT th.*, period, genre_main FROM th LEFT JOIN att USING (work_stem))"""
_B = with_(TOK, ATT, _T)
_RV = "rv AS (SELECT topic, term, n, n / nt AS p, round(0.6e0 * ln(n / nt) + 0.4e0 * ln((n / nt) / (nw / total)), 6) AS relevance FROM phi JOIN (SELECT topic, sum(n) AS nt FROM phi GROUP BY ALL) USING (topic) JOIN (SELECT term, sum(n) AS nw FROM phi GROUP BY ALL) USING (term), (SELECT sum(n) AS total FROM phi) WHERE n >= 3), rk AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY relevance DESC, term) AS rank FROM rv)"
_REL = """bt AS (SELECT term FROM phi GROUP BY term ORDER BY sum(n) DESC, term LIMIT 500), nt AS (SELECT topic, sum(n) AS nt FROM phi GROUP BY ALL), fl AS (SELECT nt.topic, bt.term, coalesce(n / nt, 0) AS rel FROM nt CROSS JOIN bt LEFT JOIN phi ON phi.topic = nt.topic AND phi.term = bt.term),
zz AS (SELECT topic, term, rel, (rel - avg(rel) OVER (PARTITION BY term)) / (CASE WHEN stddev_samp(rel) OVER (PARTITION BY term) > 0 THEN stddev_samp(rel) OVER (PARTITION BY term) ELSE 1 END) AS z FROM fl),
r1 AS (SELECT x.topic AS a, y.topic AS b, round(1 - sum(x.rel * y.rel) / (sqrt(sum(x.rel * x.rel)) * sqrt(sum(y.rel * y.rel))), 5) AS cosine, round(avg(abs(x.z - y.z)), 5) AS delta FROM zz x JOIN zz y USING (term) WHERE x.topic < y.topic GROUP BY ALL),
cl AS (SELECT chunk, topic, ln(p + 1e-12) - avg(ln(p + 1e-12)) OVER (PARTITION BY chunk) AS c FROM th), r2 AS (SELECT x.topic AS a, y.topic AS b, round(covar_pop(x.c, y.c) / nullif(stddev_pop(x.c) * stddev_pop(y.c), 0), 5) AS clr_corr FROM cl x JOIN cl y USING (chunk) WHERE x.topic < y.topic GROUP BY ALL), rel AS (SELECT * FROM r1 JOIN r2 USING (a, b))"""
_WS = "ws AS (SELECT work_stem AS work, topic, sum(p) AS s FROM th GROUP BY ALL), sw AS (SELECT work, topic, round(s / nullif(sum(s) OVER (PARTITION BY work), 0), 6) AS topic_in_work, round(s / nullif(sum(s) OVER (PARTITION BY topic), 0), 6) AS work_in_topic, s / nullif(sum(s) OVER (PARTITION BY topic), 0) > 0.5e0 AS concentrated FROM ws)"
_GCTE = ", b AS (SELECT a, b, clr_corr AS v FROM rel UNION ALL SELECT b, a, clr_corr FROM rel), t AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY v DESC, b) AS r FROM b), e AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM t WHERE r <= 2), q AS (SELECT a, b, round(cume_dist() OVER (ORDER BY clr_corr), 6) AS weight FROM rel)"
_GRAPH = " SELECT * FROM q JOIN e USING (a, b)"
SQL = {
    "topic_means": _B + "SELECT topic, round(avg(p), 6) AS mean, count(*) AS chunks FROM th GROUP BY topic",
    "topic_by_period": _B + "SELECT period, topic, round(avg(p), 6) AS mean, count(*) AS chunks FROM ta WHERE period <> '' GROUP BY ALL",
    "topic_by_genre": _B + "SELECT genre_main, topic, round(avg(p), 6) AS mean, count(*) AS chunks FROM ta WHERE genre_main <> '' GROUP BY ALL",
    "topic_lift": _B + ", g AS (SELECT period, topic, avg(p) AS m FROM ta WHERE period IS NOT NULL GROUP BY ALL), o AS (SELECT topic, avg(p) AS o FROM th GROUP BY ALL), l AS (SELECT period, topic, round(m / nullif(o, 0), 6) AS lift FROM g JOIN o USING (topic)), r AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY lift DESC NULLS LAST, topic) AS rank FROM l) SELECT * FROM r WHERE rank <= 3",
    "topic_entropy": _B + ", e AS (SELECT chunk, any_value(period) AS period, round(-sum(p * ln(p + 1e-12)), 6) AS entropy FROM ta GROUP BY chunk) SELECT period, count(*) AS chunks, round(avg(entropy), 5) AS mean, round(stddev_pop(entropy), 5) AS sd FROM e GROUP BY period",
    "relevance": with_(TOK, ATT, _T, _RV) + "SELECT topic, term, n, relevance, rank, round(sum(p) OVER (PARTITION BY topic), 6) AS kept_mass FROM rk WHERE rank <= 10",
    "topic_relatedness": with_(TOK, ATT, _T, _REL) + ", pj AS (SELECT topic, term, n / nt AS p FROM phi JOIN nt USING (topic)), cm AS (SELECT x.topic AS a, y.topic AS b, sum((-x.p * log2(x.p) - y.p * log2(y.p) + (x.p + y.p) * log2(x.p + y.p)) / 2) AS less FROM pj x JOIN pj y USING (term) WHERE x.topic < y.topic GROUP BY ALL), cd AS (SELECT x.topic AS a, y.topic AS b, round(1 - sum(x.z * y.z) / (sqrt(sum(x.z * x.z)) * sqrt(sum(y.z * y.z))), 5) AS cosine_delta FROM zz x JOIN zz y USING (term) WHERE x.topic < y.topic GROUP BY ALL) SELECT rel.a, rel.b, cosine, delta, cosine_delta, round(greatest(0.0e0, least(1.0e0, 1.0e0 - coalesce(less, 0.0e0))), 6) AS jsd, clr_corr FROM rel JOIN cd USING (a, b) LEFT JOIN cm USING (a, b)",
    "topic_terms": _B + ", nt AS (SELECT topic, sum(n) AS nt FROM phi GROUP BY ALL), pj AS (SELECT topic, term, n, n / nt AS p FROM phi JOIN nt USING (topic)), w AS (SELECT *, sum(p) OVER (PARTITION BY term) AS ap, sum(n) OVER (PARTITION BY term) / sum(n) OVER () AS q, row_number() OVER (PARTITION BY topic ORDER BY n DESC, term) AS r FROM pj) SELECT topic, round(avg(p / ap) FILTER (WHERE r <= 10), 6) AS exclusivity, round(1 / sum(p * p), 4) AS effective_words, round(sum(p * ln(p / q)), 6) AS corpus_dist FROM w GROUP BY topic",
    "topic_authors": _B + ", g AS (SELECT topic, author, sum(p) AS s FROM th JOIN att USING (work_stem) WHERE author IS NOT NULL GROUP BY ALL) SELECT topic, author, round(s / sum(s) OVER (PARTITION BY topic), 6) AS share, s / sum(s) OVER (PARTITION BY topic) > 0.5e0 AS concentrated FROM g",
    "stopped_chunks": _B + ", sw AS (SELECT lemma_key FROM tok WHERE lemma_key <> '' GROUP BY lemma_key ORDER BY count(*) DESC, lemma_key LIMIT 50) SELECT chunk, CAST(count(*) FILTER (WHERE term NOT IN (SELECT lemma_key FROM sw)) AS INTEGER) AS \"left\" FROM c1 GROUP BY chunk",
    "topic_keys_read": "SELECT CAST(unnest(range(8)) AS INTEGER) AS topic, 0.5e0 AS alpha, 5 AS words",
    "topic_work_shares": with_(TOK, ATT, _T, _WS) + "SELECT * FROM sw",
    "topic_graph": with_(TOK, ATT, _T, _REL) + _GCTE + _GRAPH,
    "topic_modularity": with_(TOK, ATT, _T, _REL) + _GCTE + ", gg AS (SELECT * FROM (" + _GRAPH + ")), ed AS (SELECT a % 3 AS c, weight FROM gg UNION ALL SELECT b % 3, weight FROM gg), kk AS (SELECT c, sum(weight) AS k FROM ed GROUP BY c), mm AS (SELECT sum(weight) AS m, sum(CASE WHEN a % 3 = b % 3 THEN weight ELSE 0 END) AS i FROM gg) SELECT (SELECT count(*) FROM kk) AS communities, round(i / m - (SELECT sum(k * k) FROM kk) / (4 * m * m), 6) AS modularity FROM mm",
    "topic_bipartite": with_(TOK, ATT, _T, _WS) + ", r AS (SELECT *, row_number() OVER (PARTITION BY work ORDER BY topic_in_work DESC, topic) AS r FROM sw) SELECT work, topic, topic_in_work AS share FROM r WHERE r <= 3 AND topic_in_work >= 0.05e0",
    "topic_profiles": with_(TOK, ATT, _T, _RV) + ", g AS (SELECT topic, period, avg(p) AS m FROM ta WHERE period IS NOT NULL GROUP BY ALL), q AS (SELECT topic, max_by(period, (round(m, 9), period)) AS peak, round(max(m) / avg(m), 4) AS peak_ratio, round(stddev_pop(m), 6) AS variation FROM g GROUP BY topic), w AS (SELECT topic, string_agg(term, '・' ORDER BY rank) AS words FROM rk WHERE rank <= 2 GROUP BY topic) SELECT *, coalesce(words, '') || CASE WHEN peak_ratio >= 1.3e0 THEN ' [' || peak || ']' ELSE '' END AS label FROM q LEFT JOIN w USING (topic)",
    "topic_representatives": _B + ", r AS (SELECT topic, chunk, p, row_number() OVER (PARTITION BY topic ORDER BY round(p, 9) DESC, chunk) AS rank FROM th) SELECT topic, rank, chunk, round(p, 6) AS p FROM r WHERE rank <= 5",
    "topic_coherence": _B + ", t AS (SELECT topic, term, row_number() OVER (PARTITION BY topic ORDER BY n DESC, term) AS r FROM phi), t5 AS (SELECT * FROM t WHERE r <= 5), d AS (SELECT DISTINCT chunk, term FROM c1 WHERE term IN (SELECT term FROM t5)), df AS (SELECT term, count(*) AS df FROM d GROUP BY ALL), co AS (SELECT x.term AS t1, y.term AS t2, count(*) AS co FROM d x JOIN d y USING (chunk) WHERE x.term <> y.term GROUP BY ALL) SELECT p.topic, round(sum(ln((coalesce(co, 0) + 1) / df)), 4) AS coherence FROM t5 p JOIN t5 q ON p.topic = q.topic AND p.r > q.r LEFT JOIN co ON co.t1 = p.term AND co.t2 = q.term JOIN df ON df.term = q.term GROUP BY p.topic",
    "topic_fingerprint": _B + "SELECT concat_ws('-', " + ", ".join(f"CAST(sum(CAST(('0x' || substr(md5(topic || '|' || term || '|' || n), {8 * k + 1}, 8)) AS BIGINT)) AS VARCHAR)" for k in range(4)) + ") AS fingerprint, count(*) AS rows FROM phi",
    "doc_topics_read": _B + "SELECT topic, 2 * count(*) AS rows, round(avg(p), 6) AS mean FROM th GROUP BY topic",
}
