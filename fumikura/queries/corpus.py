"""Profiles, frequencies, keyness, dispersion, lexicon, chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from fumikura.functions import text
from fumikura.operators import stats
from fumikura.operators import tokens as tk
from fumikura.queries.base import ATT, CONTENT, PUNCT, ST, TOK, UNKNOWN, attributes, tok, with_
from fumikura.sources.corpus import table

#: Markers of literary and of colloquial style, pronouns of the first and the third person.
MARKERS = {
    "bungo": ("なり", "けり", "ごとし", "べし", "ざる", "ざり", "たり", "候", "けむ", "らむ", "しむ", "ども", "なれ", "べから", "ごとき", "ざれ", "たる", "ぬる"),
    "kogo": ("です", "ます", "である", "だっ", "ました", "でしょ", "ません", "ている", "ていた", "じゃ", "だ", "ない", "なかっ", "だろ"),
    "first": ("私", "僕", "俺", "おれ", "わたし", "わたくし", "あたし", "自分", "わし"),
    "third": ("彼", "彼女", "かれ"),
}


def token_profile(s, d):
    return tk.report(tok(s, d))


def unknown_words(s, d):
    return tk.unknown_words(tok(s, d, "surface", "lemma"))


def lexical_profile(s, d):
    return tk.profile(tok(s, d, "lemma_key"), "work_stem")


def mfw_list(s, d):
    return tk.mfw(tok(s, d, "lemma_key"), 300)


def mfw_relfreq(s, d):
    return tk.relative_frequencies(tok(s, d, "lemma_key"), 100).withColumn("rel", F.round("rel", 8))


def lemma_policies(s, d):
    t = tok(s, d, "surface", "orthbase", "lemma", "pos2")
    e = t.select(F.explode(F.array(*(F.struct(F.lit(p).alias("policy"), tk.lemma_key(p).alias("key")) for p in ("surface", "orthBase", "lemma", "mixed")))).alias("x"))
    return e.groupBy("x.policy").agg(F.count_distinct("x.key").alias("forms"), F.count("*").alias("tokens"))


def _period_counts(s, d):
    c = tk.counts(tok(s, d, "lemma_key"), "work_stem")
    return c.join(attributes(s, d).select("work_stem", "period"), "work_stem", "left")


def keyness_by_period(s, d):
    return stats.keyness(_period_counts(s, d).groupBy("period", "term").agg(F.sum("n").alias("n")), "period")


def doc_freq(s, d):
    return stats.document_frequency(tk.counts(tok(s, d, "lemma_key"), "work_stem"), "work_stem")


def doc_freq_in_period(s, d):
    return stats.document_frequency(_period_counts(s, d).where("period is not null"), "work_stem", "period")


def dispersion_dp(s, d):
    return stats.dispersion(tk.counts(tok(s, d, "lemma_key"), "work_stem"), "work_stem", least=20)


def dispersion_dp_in(s, d):
    return stats.dispersion(_period_counts(s, d).where("period is not null"), "work_stem", "period", least=10)


def culling_report(s, d):
    from pyspark.sql.window import Window

    k = keyness_by_period(s, d).withColumn("r", F.row_number().over(Window.partitionBy("period").orderBy(F.desc("g2"), "term"))).where("r <= 15")
    df = stats.document_frequency(tk.counts(tok(s, d, "lemma_key"), "work_stem"), "work_stem")
    return k.join(df, "term").groupBy("period").agg(F.count("*").alias("top"), F.count_if(F.col("df_prop") < 0.1).alias("rare"), F.round(F.count_if(F.col("df_prop") < 0.1) / F.count("*"), 4).alias("rare_share"))


def keyness_overlap(s, d):
    c = _period_counts(s, d)
    k = stats.keyness(c.groupBy("period", "term").agg(F.sum("n").alias("n")), "period", threshold=6.63)
    dp = stats.dispersion(c.where("period is not null"), "work_stem", "period").select("period", "term", "dp")
    kept = k.join(dp, ["period", "term"]).where("dp <= 0.5")
    return stats.overlap_at(k, kept, "period", [F.desc("g2"), F.asc("term")], 50)


def threshold_misses(s, d):
    from pyspark.sql.window import Window

    c = _period_counts(s, d)
    k = stats.keyness(c.groupBy("period", "term").agg(F.sum("n").alias("n")), "period", threshold=0.0)
    dp = stats.dispersion(c.where("period is not null"), "work_stem", "period").select("period", "term", "dp")
    j = k.join(dp, ["period", "term"]).withColumn("kept", F.abs("g2") >= 15.13)
    miss = j.where((F.col("kept") & (F.col("dp") > 0.5)) | (~F.col("kept") & (F.col("dp") < 0.3)))
    w = Window.partitionBy("kept").orderBy(F.when(F.col("kept"), -F.col("dp")).otherwise(F.col("dp")), F.desc(F.abs("g2")), "period", "term")
    return miss.withColumn("rank", F.row_number().over(w)).where("rank <= 6").select("kept", "rank", "period", "term", "g2", "dp")


def _spearman_keyness(s, d):
    c = _period_counts(s, d)
    k = stats.keyness(c.groupBy("period", "term").agg(F.sum("n").alias("n")), "period")
    dp = stats.dispersion(c.where("period is not null"), "work_stem", "period").select("period", "term", "dp")
    return k.join(dp, ["period", "term"])


def keyness_dispersion_rho(s, d):
    return stats.spearman(_spearman_keyness(s, d), "g2", "dp", "period")


def _chunks(s, d, size=200):
    return tk.chunks(tok(s, d, "lemma_key", "pos1", "pos2"), size)


def chunk_index(s, d):
    return _chunks(s, d).select("work_stem", "chunk_no", "chunk_tokens", F.element_at("terms", 1).alias("first_term"), F.element_at("terms", -1).alias("last_term"))


def chunk_spread(s, d):
    return tk.cap_chunks(_chunks(s, d).select("work_stem", "chunk_no"), 3, "spread")


def chunk_head(s, d):
    return tk.cap_chunks(_chunks(s, d).select("work_stem", "chunk_no"), 3, "head")


def chunk_hash_sample(s, d):
    return tk.cap_chunks(_chunks(s, d).select("work_stem", "chunk_no"), 3, "random")


def chunk_stratified_sample(s, d):
    return tk.cap_chunks(_chunks(s, d).select("work_stem", "chunk_no"), 3, "stratified")


def auto_stoplist(s, d):
    return stats.stop_list(_chunks(s, d), 3, 0.5)


def _lexicon(s, d):
    return stats.lexicon(tok(s, d, "lemma_key", "pos1", "pos2", "pos3"), attributes(s, d).select("work_stem", "period", "author"))


def lexicon(s, d):
    return _lexicon(s, d).where(F.col("count") >= 5)


def vocabulary_nva(s, d):
    return stats.select_vocabulary(_lexicon(s, d), ["名詞-普通名詞", "動詞", "形容詞"], ["名詞-数詞"], min_count=10, max_work_share=0.6, max_author_share=0.8, max_dp=0.9).select("term", "pos", "count", "docs")


def marker_density(s, d):
    """Densities of literary and colloquial markers and of pronouns, and the style they give."""
    c = tk.marker_counts(tok(s, d, "surface"), MARKERS)
    per = lambda n: F.round(F.col(n) / F.col("tokens") * 1e4, 1)
    c = c.select("work_stem", "tokens", *(per(n).alias(n) for n in MARKERS))
    return c.withColumn("style", text.style_class(F.col("bungo"), F.col("kogo")))


def period_sizes(s, d):
    c = tok(s, d, "surface").groupBy("work_stem").agg(F.count("*").alias("n")).join(attributes(s, d).select("work_stem", "period"), "work_stem", "left")
    g = c.groupBy("period").agg(F.count("*").alias("works"), F.sum("n").alias("tokens"))
    total = g.agg(F.sum("works").alias("w"), F.sum("tokens").alias("t"))
    return g.crossJoin(F.broadcast(total)).select("period", "works", "tokens", F.round(F.col("works") / F.col("w"), 6).alias("works_prop"), F.round(F.col("tokens") / F.col("t"), 6).alias("tokens_prop"))


def unknown_by_stratum(s, d):
    r = tk.report(tok(s, d)).groupBy("work_stem").agg(F.sum("tokens").alias("tokens"), F.avg("unknown_rate").alias("unknown_rate"), F.avg(F.col("types") / F.col("tokens")).alias("type_rate"))
    r = r.join(attributes(s, d).select("work_stem", "genre_main", "author_sex"), "work_stem", "left")
    return stats.weighted_means(r, ["genre_main", "author_sex"], "tokens", ["unknown_rate", "type_rate"])


def median_ttr_trend(s, d):
    p = tk.profile(tok(s, d, "lemma_key"), "work_stem").join(attributes(s, d).select("work_stem", "period", "genre_main"), "work_stem").where("period is not null and genre_main is not null")
    m = p.groupBy("genre_main", "period").agg(F.round(F.percentile("ttr", 0.5), 6).alias("ttr"))
    return stats.monotone(m, "genre_main", "period", "ttr")


def stated_rates(s, d):
    r = table(s, d, "tokenise_report").dropDuplicates(["file", "tokens", "unknown_tokens"])
    return r.agg(F.count("*").alias("rows"), F.sum("tokens").alias("tokens"), F.round(F.sum("unknown_tokens") / F.sum("tokens"), 6).alias("rate"), F.count_if(F.col("unknown_rate").isNull()).alias("null_rates"))


QUERIES = {f.__name__: f for f in (token_profile, unknown_words, lexical_profile, mfw_list, mfw_relfreq, lemma_policies, keyness_by_period, doc_freq, doc_freq_in_period, dispersion_dp, dispersion_dp_in, culling_report, keyness_overlap, threshold_misses, keyness_dispersion_rho, chunk_index, chunk_spread, chunk_head, chunk_hash_sample, chunk_stratified_sample, auto_stoplist, lexicon, vocabulary_nva, marker_density, period_sizes, unknown_by_stratum, median_ttr_trend, stated_rates)}

_C = "cw AS (SELECT work_stem, lemma_key AS term, count(*) AS n FROM tok WHERE lemma_key <> '' GROUP BY ALL)"
_CP = "cp AS (SELECT cw.*, att.period FROM cw LEFT JOIN att USING (work_stem))"
_PART = lambda a, e: f"(CASE WHEN {a} > 0 THEN {a} * ln({a} / {e}) ELSE 0.0e0 END)"
_KEY = f"""pt AS (SELECT period, term, CAST(sum(n) AS DOUBLE) AS a FROM cp WHERE period IS NOT NULL GROUP BY ALL),
sz AS (SELECT period, sum(a) AS c FROM pt GROUP BY ALL), tt AS (SELECT term, sum(a) AS t FROM pt GROUP BY ALL), al AS (SELECT sum(c) AS al FROM sz),
k0 AS (SELECT period, term, a, t - a AS b, c, al - c AS dd FROM pt JOIN tt USING (term) JOIN sz USING (period), al WHERE a >= 10 AND al - c > 0),
k1 AS (SELECT period, term, CAST(a AS BIGINT) AS freq_in, CAST(b AS BIGINT) AS freq_out, a / c * 1e6 AS pi, b / dd * 1e6 AS po, (CASE WHEN a / c >= b / dd THEN 1.0e0 ELSE -1.0e0 END) * 2.0e0 * ({_PART('a', '(c * (a + b) / (c + dd))')} + {_PART('b', '(dd * (a + b) / (c + dd))')}) AS g FROM k0),
key AS (SELECT period, term, freq_in, freq_out, round(pi, 2) AS pm_in, round(po, 2) AS pm_out, round(log2((pi + 0.01e0) / (po + 0.01e0)), 3) AS log_ratio, round(g, 2) AS g2, g FROM k1)"""
_DP = lambda src, by, least: f"""ln_ AS (SELECT {by} work_stem, CAST(sum(n) AS DOUBLE) AS len FROM {src} GROUP BY ALL), to_ AS (SELECT {by} sum(len) AS corpus FROM ln_ GROUP BY ALL),
te_ AS (SELECT {by} term, CAST(sum(n) AS BIGINT) AS freq, max(n) AS most FROM {src} GROUP BY ALL HAVING sum(n) >= {least}),
dp_ AS (SELECT {by} term, any_value(freq) AS freq, count(*) AS units, round(0.5e0 * (sum(abs(n / freq - len / corpus)) + 1 - sum(len / corpus)), 4) AS dp, round(max(n / freq), 4) AS top_share, min(CASE WHEN n = most THEN work_stem END) AS top_unit FROM {src} JOIN te_ USING ({by} term) JOIN ln_ USING ({by} work_stem) {'JOIN to_ USING (period)' if by else ', to_'} GROUP BY ALL)"""  # noqa: E731
_CH = f"""ct AS (SELECT work_stem, lemma_key, row_number() OVER (PARTITION BY work_stem ORDER BY vol_no, i) - 1 AS rk FROM tok WHERE {CONTENT} AND lemma_key <> ''),
ch AS (SELECT work_stem, CAST(rk // 200 AS BIGINT) AS chunk_no, count(*) AS chunk_tokens, min_by(lemma_key, rk) AS first_term, max_by(lemma_key, rk) AS last_term, list(DISTINCT lemma_key) AS terms FROM ct GROUP BY ALL HAVING count(*) >= 100),
nc AS (SELECT work_stem, count(*) AS nn FROM ch GROUP BY ALL)"""
_REP = f"rep AS (SELECT work_stem, vol_no, count(*) AS tokens, count(DISTINCT lemma_key) AS types, count(*) FILTER (WHERE {CONTENT}) AS content_tokens, count(DISTINCT lemma_key) FILTER (WHERE {CONTENT}) AS content_types, count(*) FILTER (WHERE {UNKNOWN}) AS unknown_tokens, round(count(*) FILTER (WHERE {UNKNOWN}) / nullif(count(*) FILTER (WHERE NOT {PUNCT}), 0), 6) AS unknown_rate FROM tok GROUP BY ALL)"
_PRO = "pro AS (SELECT work_stem, CAST(any_value(nn) AS BIGINT) AS tokens, count(*) AS types, round(count(*) / any_value(nn), 6) AS ttr, round(count(*) / sqrt(any_value(nn)), 6) AS guiraud_r, round(1e4 * (sum(n * n) - any_value(nn)) / (CAST(any_value(nn) AS DOUBLE) * any_value(nn)), 6) AS yule_k, round(-sum(n / nn * log2(n / nn)), 6) AS entropy_bits, round(count(*) FILTER (WHERE n = 1) / count(*), 6) AS hapax_ratio FROM cw JOIN (SELECT work_stem, sum(n) AS nn FROM cw GROUP BY ALL) USING (work_stem) GROUP BY work_stem)"
_LEX = f"""ft AS (SELECT work_stem, lemma_key AS term, concat_ws('-', nullif(nullif(pos1, ''), '*'), nullif(nullif(pos2, ''), '*'), nullif(nullif(pos3, ''), '*')) AS pos, count(*) AS n FROM tok WHERE lemma_key <> '' GROUP BY ALL),
tp AS (SELECT term, pos, sum(n) AS n FROM ft GROUP BY ALL), tq AS (SELECT term, CAST(sum(n) AS BIGINT) AS count, max_by(pos, (n, pos)) AS pos, round(max(n) / sum(n), 4) AS pos_share FROM tp GROUP BY term),
la AS (SELECT cw.term, cw.n, coalesce(period, '不明') AS period, coalesce(author, '不明') AS author FROM cw LEFT JOIN att USING (work_stem)), lp AS (SELECT period, term, sum(n) AS n FROM la GROUP BY ALL), ls AS (SELECT period, sum(n) AS size FROM lp GROUP BY ALL),
pk AS (SELECT term, max_by(period, (n / size, period)) AS peak_period FROM lp JOIN ls USING (period) GROUP BY term), au AS (SELECT term, round(max(n) / sum(n), 4) AS top_author_share FROM (SELECT term, author, sum(n) AS n FROM la GROUP BY ALL) GROUP BY term),
lex AS (SELECT tq.*, units AS docs, top_unit AS top_work, top_share AS top_work_share, dp, peak_period, top_author_share FROM tq JOIN dp_ USING (term) JOIN pk USING (term) JOIN au USING (term))"""
_B = with_(TOK, _C)
_BP = with_(TOK, ATT, _C, _CP)
_PP = "(SELECT * FROM cp WHERE period IS NOT NULL)"
_DPIN = _DP(_PP, "period,", 1)

# written out once more, so that a wrong list above differs from the SQL
_MARKERS = {
    "bungo": "なり けり ごとし べし ざる ざり たり 候 けむ らむ しむ ども なれ べから ごとき ざれ たる ぬる".split(),
    "kogo": "です ます である だっ ました でしょ ません ている ていた じゃ だ ない なかっ だろ".split(),
    "first": "私 僕 俺 おれ わたし わたくし あたし 自分 わし".split(),
    "third": "彼 彼女 かれ".split(),
}
SQL = {
    "token_profile": with_(TOK, _REP) + "SELECT * FROM rep",
    "unknown_words": with_(TOK) + f", u AS (SELECT surface, count(*) AS freq FROM tok WHERE {UNKNOWN} GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY freq DESC, surface) AS rank, round(sum(freq) OVER (ORDER BY freq DESC, surface) / sum(freq) OVER (), 6) AS cum_share FROM u) SELECT surface, freq, rank, cum_share FROM r WHERE rank <= 3000",
    "lexical_profile": with_(TOK, _C, _PRO) + "SELECT * FROM pro",
    "mfw_list": _B + "SELECT term, CAST(sum(n) AS BIGINT) AS n FROM cw GROUP BY term ORDER BY n DESC, term LIMIT 300",
    "mfw_relfreq": _B + ", t AS (SELECT term FROM cw GROUP BY term ORDER BY sum(n) DESC, term LIMIT 100), z AS (SELECT work_stem, sum(n) AS total FROM cw GROUP BY ALL) SELECT work_stem, term, round(coalesce(n, 0) / total, 8) AS rel FROM z CROSS JOIN t LEFT JOIN cw USING (work_stem, term)",
    "keyness_by_period": with_(TOK, ATT, _C, _CP, _KEY) + "SELECT period, term, freq_in, freq_out, pm_in, pm_out, log_ratio, g2 FROM key WHERE abs(g) >= 15.13e0",
    "doc_freq": _B + "SELECT term, count(DISTINCT work_stem) AS df, round(count(DISTINCT work_stem) / (SELECT count(DISTINCT work_stem) FROM cw), 6) AS df_prop FROM cw GROUP BY term",
    "doc_freq_in_period": _BP + ", u AS (SELECT period, count(DISTINCT work_stem) AS units FROM cp GROUP BY ALL) SELECT period, term, count(DISTINCT work_stem) AS df, round(count(DISTINCT work_stem) / any_value(units), 6) AS df_prop FROM cp JOIN u USING (period) GROUP BY period, term",
    "dispersion_dp": with_(TOK, _C, _DP("cw", "", 20)) + "SELECT * FROM dp_",
    "dispersion_dp_in": with_(TOK, ATT, _C, _CP, _DP(_PP, "period,", 10)) + "SELECT * FROM dp_",
    "culling_report": with_(TOK, ATT, _C, _CP, _KEY) + ", r AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY g2 DESC, term) AS r FROM key WHERE abs(g) >= 15.13e0), f AS (SELECT term, count(DISTINCT work_stem) / (SELECT count(DISTINCT work_stem) FROM cw) AS p FROM cw GROUP BY term) SELECT period, count(*) AS top, count(*) FILTER (WHERE round(p, 6) < 0.1e0) AS rare, round(count(*) FILTER (WHERE round(p, 6) < 0.1e0) / count(*), 4) AS rare_share FROM r JOIN f USING (term) WHERE r <= 15 GROUP BY period",
    "keyness_overlap": with_(TOK, ATT, _C, _CP, _KEY, _DPIN) + ", a AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY g2 DESC, term) AS r FROM key WHERE abs(g) >= 6.63e0), b AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY g2 DESC, term) AS r FROM (SELECT key.* FROM key JOIN dp_ USING (period, term) WHERE abs(g) >= 6.63e0 AND dp <= 0.5e0)), na AS (SELECT period, count(*) AS na FROM a WHERE r <= 50 GROUP BY ALL), nb AS (SELECT period, count(*) AS nb FROM b WHERE r <= 50 GROUP BY ALL), co AS (SELECT a.period, count(*) AS common FROM a JOIN b USING (period, term) WHERE a.r <= 50 AND b.r <= 50 GROUP BY ALL) SELECT period, coalesce(common, 0) AS common, round(coalesce(common, 0) / least(50, greatest(na, nb)), 4) AS overlap FROM na JOIN nb USING (period) LEFT JOIN co USING (period)",
    "threshold_misses": with_(TOK, ATT, _C, _CP, _KEY, _DPIN) + ", j AS (SELECT period, term, g2, dp, abs(g2) >= 15.13e0 AS kept FROM key JOIN dp_ USING (period, term)), m AS (SELECT *, row_number() OVER (PARTITION BY kept ORDER BY CASE WHEN kept THEN -dp ELSE dp END, abs(g2) DESC, period, term) AS rank FROM j WHERE (kept AND dp > 0.5e0) OR (NOT kept AND dp < 0.3e0)) SELECT kept, rank, period, term, g2, dp FROM m WHERE rank <= 6",
    "keyness_dispersion_rho": with_(TOK, ATT, _C, _CP, _KEY, _DPIN) + ", j AS (SELECT period, g2, dp FROM key JOIN dp_ USING (period, term) WHERE abs(g) >= 15.13e0), r AS (SELECT period, rank() OVER (PARTITION BY period ORDER BY g2) + (count(*) OVER (PARTITION BY period, g2) - 1) / 2 AS rx, rank() OVER (PARTITION BY period ORDER BY dp) + (count(*) OVER (PARTITION BY period, dp) - 1) / 2 AS ry FROM j) SELECT period, count(*) AS n, round(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 6) AS rho FROM r GROUP BY period",
    "chunk_index": with_(TOK, _CH) + "SELECT work_stem, chunk_no, chunk_tokens, first_term, last_term FROM ch",
    "chunk_spread": with_(TOK, _CH) + "SELECT work_stem, chunk_no FROM ch JOIN nc USING (work_stem) WHERE nn <= 3 OR chunk_no IN (0, nn // 3, 2 * nn // 3)",
    "chunk_head": with_(TOK, _CH) + "SELECT work_stem, chunk_no FROM ch WHERE chunk_no < 3",
    "chunk_hash_sample": with_(TOK, _CH) + "SELECT work_stem, chunk_no FROM (SELECT *, row_number() OVER (PARTITION BY work_stem ORDER BY md5('42|' || work_stem || '|' || chunk_no), chunk_no) AS r FROM ch) WHERE r <= 3",
    "chunk_stratified_sample": with_(TOK, _CH) + ", sr AS (SELECT ch.work_stem, chunk_no, nn, CASE WHEN nn <= 3 THEN chunk_no WHEN chunk_no < nn // 3 THEN 0 WHEN chunk_no < 2 * nn // 3 THEN 1 ELSE 2 END AS stratum FROM ch JOIN nc USING (work_stem)) SELECT work_stem, chunk_no FROM (SELECT *, row_number() OVER (PARTITION BY work_stem, stratum ORDER BY md5('42|' || work_stem || '|' || chunk_no), chunk_no) AS r FROM sr) WHERE r = 1",
    "auto_stoplist": with_(TOK, _CH) + ", e AS (SELECT unnest(terms) AS term FROM ch), g AS (SELECT term, count(*) AS df FROM e GROUP BY ALL) SELECT term, df, round(df / (SELECT count(*) FROM ch), 6) AS ratio FROM g WHERE df < 3 OR df / (SELECT count(*) FROM ch) > 0.5e0",
    "lexicon": with_(TOK, ATT, _C, _DP("cw", "", 1), _LEX) + "SELECT * FROM lex WHERE count >= 5",
    "vocabulary_nva": with_(TOK, ATT, _C, _DP("cw", "", 1), _LEX) + "SELECT term, pos, count, docs FROM lex WHERE count >= 10 AND top_work_share <= 0.6e0 AND top_author_share <= 0.8e0 AND dp <= 0.9e0 AND NOT regexp_matches(pos, '^名詞-数詞(-|$)') AND regexp_matches(pos, '^(名詞-普通名詞|動詞|形容詞)(-|$)')",
    "period_sizes": with_(TOK, ATT) + ", c AS (SELECT work_stem, count(*) AS n FROM tok GROUP BY ALL), g AS (SELECT period, count(*) AS works, CAST(sum(n) AS BIGINT) AS tokens FROM c LEFT JOIN att USING (work_stem) GROUP BY period) SELECT *, round(works / sum(works) OVER (), 6) AS works_prop, round(tokens / sum(tokens) OVER (), 6) AS tokens_prop FROM g",
    "unknown_by_stratum": with_(TOK, ATT, _REP) + ", w AS (SELECT work_stem, sum(tokens) AS tokens, avg(unknown_rate) AS unknown_rate, avg(types / tokens) AS type_rate FROM rep GROUP BY work_stem) SELECT genre_main, author_sex, count(*) AS units, round(sum(unknown_rate * w.tokens) / sum(CASE WHEN unknown_rate IS NOT NULL THEN w.tokens END), 6) AS unknown_rate, round(sum(type_rate * w.tokens) / sum(CASE WHEN type_rate IS NOT NULL THEN w.tokens END), 6) AS type_rate FROM w LEFT JOIN att USING (work_stem) GROUP BY genre_main, author_sex",
    "median_ttr_trend": with_(TOK, ATT, _C, _PRO) + ", m AS (SELECT genre_main, period, round(median(ttr), 6) AS ttr FROM pro JOIN att USING (work_stem) WHERE period IS NOT NULL AND genre_main IS NOT NULL GROUP BY ALL), s AS (SELECT *, ttr - lag(ttr) OVER (PARTITION BY genre_main ORDER BY period) AS step FROM m) SELECT genre_main, count(*) AS n, coalesce(bool_and(step >= 0), true) AS rises, coalesce(bool_and(step <= 0), true) AS falls FROM s GROUP BY genre_main",
    "stated_rates": "WITH r AS (SELECT file, tokens, unknown_tokens, min(unknown_rate) AS unknown_rate FROM tokenise_report GROUP BY ALL) SELECT count(*) AS rows, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(unknown_tokens) / sum(tokens), 6) AS rate, count(*) FILTER (WHERE unknown_rate IS NULL) AS null_rates FROM r",
    "lemma_policies": with_(TOK) + ", b AS (SELECT surface, coalesce(nullif(nullif(orthbase, ''), '*'), surface) AS o, coalesce(regexp_replace(nullif(nullif(lemma, ''), '*'), '-[\\p{Han}\\p{Hiragana}\\p{Katakana}ー]+$', ''), nullif(nullif(orthbase, ''), '*'), surface) AS l, pos2 FROM tok), e AS (SELECT unnest([('surface', surface), ('orthBase', o), ('lemma', l), ('mixed', CASE WHEN pos2 = '固有名詞' THEN o ELSE l END)]) AS x FROM b) SELECT x[1] AS policy, count(DISTINCT x[2]) AS forms, count(*) AS tokens FROM e GROUP BY 1",
    "marker_density": with_(TOK) + ", m AS (SELECT work_stem, [coalesce(surface, ''), coalesce(surface, '') || lead(coalesce(surface, '')) OVER w, coalesce(surface, '') || lead(coalesce(surface, '')) OVER w || lead(coalesce(surface, ''), 2) OVER w, coalesce(surface, '') || lead(coalesce(surface, '')) OVER w || lead(coalesce(surface, ''), 2) OVER w || lead(coalesce(surface, ''), 3) OVER w] AS c FROM tok WINDOW w AS (PARTITION BY work_stem, vol_no ORDER BY i)), g AS (SELECT work_stem, count(*) AS tokens, " + ", ".join(f"round(count(*) FILTER (WHERE list_has_any(c, {list(words)})) / count(*) * 1e4, 1) AS {n}" for n, words in _MARKERS.items()) + " FROM m GROUP BY work_stem) SELECT *, CASE WHEN bungo >= 80 AND round(coalesce(bungo / nullif(bungo + kogo, 0), 0), 3) >= 0.2e0 THEN 'A' WHEN round(coalesce(bungo / nullif(bungo + kogo, 0), 0), 3) <= 0.1e0 THEN 'C' ELSE 'B' END AS style FROM g",
}
