"""Data-quality and balance queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fumikura.functions import keys
from fumikura.functions import text as tx
from fumikura.operators import quality as q
from fumikura.operators import tokens as tk
from fumikura.queries.base import ATT, PUNCT, ST, TOK, UNKNOWN, attributes, sql_category, tok, with_
from fumikura.sources.corpus import table

SKEW = ["period", "genre_main", "author_sex", "register_level"]


def _docs(s, d):
    return table(s, d, "documents")


def quality_findings(s, d):
    return q.text_findings(_docs(s, d))


def quality_gate(s, d):
    return q.gate(q.text_findings(_docs(s, d)))


def meta_required(s, d):
    return q.metadata_findings(table(s, d, "corpus_metadata_v2"))


def unknown_outliers(s, d):
    r = tk.report(tok(s, d)).select(F.concat_ws("#", "work_stem", "vol_no").alias("target"), "work_stem", "unknown_rate")
    return q.rate_outliers(r.join(attributes(s, d).select("work_stem", "genre_main"), "work_stem", "left"), "genre_main", "unknown_rate", "target", 1.5, 0.002)


def extraction_loss(s, d):
    t = _docs(s, d).where("text <> ''").select("doc_id", (F.length(tx.strip_gloss(F.col("text"))) / F.length("text")).alias("ratio"))
    return q.low_ratio(t, "doc_id", "ratio", 0.97)


def length_skew(s, d):
    return q.length_skew(tok(s, d, "surface").groupBy("work_stem").agg(F.count("*").alias("n")), "work_stem", "n")


def _sizes(s, d):
    n = tok(s, d, "surface").groupBy("work_stem").agg(F.count("*").alias("tokens"))
    return n.join(attributes(s, d).drop("tokens"), "work_stem", "left").select(F.col("work_stem").alias("work"), "author", F.col("period").alias("band"), F.col("author_sex").alias("sex"), "tokens")


def balance_audit(s, d):
    return q.balance_audit(_sizes(s, d))


def share_skew(s, d):
    return q.skew(attributes(s, d), SKEW)


def skew_before_after(s, d):
    a = attributes(s, d)
    return q.skew_change(a, a.where("year >= 1912"), SKEW)


def tbd_cells(s, d):
    m = table(s, d, "corpus_metadata_v2").where("id is not null")
    cols = ["period", "genre_main", "author_sex", "register_level", "tokens", "audience"]
    e = m.select("id", F.explode(F.array(*(F.struct(F.lit(c).alias("c"), keys.category(F.col(c)).alias("v")) for c in cols))).alias("x"))
    return e.groupBy(F.col("x.c").alias("column")).agg(F.count_if(F.col("x.v").isNull()).alias("open"), F.count("*").alias("rows"))


def empty_period_chunks(s, d):
    c = table(s, d, "chunks_index").where("chunk_id is not null").agg(F.count("*").alias("chunks"), F.count_if(F.col("period").isNull() | (F.trim("period") == "")).alias("empty"))
    share = F.col("empty") / F.nullif(F.col("chunks"), F.lit(0))
    return c.select("chunks", "empty", F.round(share, 6).alias("share"), F.when(share > 0.5, "FATAL").when(share > 0, "WARN").otherwise("OK").alias("level"))


def report_agreement(s, d):
    """Stated against counted tokens of volumes."""
    r = table(s, d, "tokenise_report").where("file is not null").groupBy("file").agg(F.max("tokens").alias("stated"))
    n = tok(s, d, "surface").groupBy(F.concat(F.col("work_stem"), F.lit("_"), F.col("vol_no")).alias("v")).agg(F.count("*").alias("counted"))
    bare = F.regexp_replace("file", "\\.[a-z]+$", "")
    j = r.withColumn("v", bare).join(n, "v", "full")
    return j.agg(F.count("*").alias("volumes"), F.count_if(F.col("stated").isNull()).alias("not_stated"), F.count_if(F.col("counted").isNull()).alias("not_counted"), F.count_if(F.col("stated") == F.col("counted")).alias("equal"))


def _segmentations(s, d):
    """Tokens by sentence, and a segmentation that joins every particle to the word before."""
    a = tok(s, d, "surface", "pos1", sentences=True).select(F.concat_ws("#", "work_stem", "vol_no", "sent").alias("unit"), F.col("i").alias("ord"), "surface", "pos1")
    w = Window.partitionBy("unit").orderBy("ord")
    b = a.withColumn("g", F.sum(F.when(F.col("pos1") == "助詞", 0).otherwise(1)).over(w)).groupBy("unit", "g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "surface"))), lambda x: x["surface"]), "").alias("surface"), F.min("ord").alias("ord"))
    return a, b


def segmentation_agreement(s, d):
    j = q.boundary_agreement(*_segmentations(s, d), "unit")
    return j.agg(F.count("*").alias("units"), F.sum("common").alias("common"), F.sum("either").alias("either"), F.round(F.percentile("jaccard", 0.5), 6).alias("median"))


def segmentation_samples(s, d):
    return q.disagreements(*_segmentations(s, d), "unit")


def segmentation_stats(s, d):
    return tk.segmentation_stats(tok(s, d, "surface", "lemma", "pos1"))


def category_crosstab(s, d):
    a = attributes(s, d).where("genre_main is not null and author_sex is not null")
    g = a.groupBy("genre_main", "author_sex").agg(F.count("*").alias("works"), F.sum("tokens").alias("tokens"))
    t = g.agg(F.sum("works").alias("w"))
    return g.crossJoin(F.broadcast(t)).select("genre_main", "author_sex", "works", "tokens", F.round(F.col("works") / F.col("w"), 6).alias("share"))


QUERIES = {f.__name__: f for f in (quality_findings, quality_gate, meta_required, unknown_outliers, extraction_loss, length_skew, balance_audit, share_skew, skew_before_after, tbd_cells, empty_period_chunks, report_agreement, segmentation_agreement, segmentation_samples, segmentation_stats, category_crosstab)}

_N = lambda x: f"(length(text) - length(replace(text, '{x}', '')))"
_MANY = "length(regexp_replace(text, '[^ゝゞヽヾ〳〴〵]', '', 'g'))"
_COLO = "(" + " + ".join(f"(CASE WHEN contains(regexp_replace(text, '[ \\n]', '', 'g'), '{m}') THEN 1 ELSE 0 END)" for m in tx.COLOPHON) + ")"
_LEAK = "concat_ws(' ', CASE WHEN contains(text, '］') THEN '］' END, CASE WHEN contains(text, '［＃') THEN '［＃' END, CASE WHEN contains(text, '《') THEN '《' END, CASE WHEN contains(text, '》') THEN '》' END)"
_F = lambda cond, level, check, detail: f"SELECT {level} AS level, '{check}' AS check, CAST(doc_id AS VARCHAR) AS target, CAST({detail} AS VARCHAR) AS detail FROM documents WHERE doc_id IS NOT NULL AND ({cond})"
_FIND = " UNION ALL ".join([
    _F(f"{_N('〓')} > 0", f"CASE WHEN {_N('〓')} > 20 THEN 'FATAL' ELSE 'WARN' END", "glyph_unresolved", _N("〓")), _F(f"{_N('※')} > 0", "'WARN'", "glyph_marker", _N("※")), _F(f"{_COLO} >= 2", "'FATAL'", "colophon", _COLO),
    _F(f"{_LEAK} <> ''", "'WARN'", "annotation_leak", _LEAK), _F(f"{_MANY} > 0", "'WARN'", "iteration_marks", _MANY), _F("text IS NULL OR trim(text, ' ') = ''", "'FATAL'", "empty_text", "''"),
    _F("trim(text, ' ') <> '' AND length(text) < 20", "'WARN'", "too_short", "length(text)"), _F("n_chars <> length(text)", "'WARN'", "wrong_length", "n_chars - length(text)"),
])
_REQ = "rq AS (SELECT id, unnest([('author_ja', author_ja), ('title_aozora', title_aozora), ('period', period), ('genre_main', genre_main), ('year_first', year_first)]) AS x FROM corpus_metadata_v2 WHERE id IS NOT NULL)"
_SIZES = "sz AS (SELECT work_stem AS work, author, period AS band, author_sex AS sex, n AS tokens FROM (SELECT work_stem, count(*) AS n FROM tok GROUP BY ALL) LEFT JOIN att USING (work_stem))"
_SKEW = lambda name, where: f"{name}v AS (SELECT x[1] AS attribute, x[2] AS value, count(*) AS n FROM (SELECT unnest([('period', period), ('genre_main', genre_main), ('author_sex', author_sex), ('register_level', register_level)]) AS x FROM att {where}) GROUP BY ALL), {name} AS (SELECT attribute, count(*) FILTER (WHERE value IS NOT NULL) AS categories, max_by(value, (n, value)) FILTER (WHERE value IS NOT NULL) AS top, round(max(n) FILTER (WHERE value IS NOT NULL) / sum(n) FILTER (WHERE value IS NOT NULL), 6) AS top_share, CAST(coalesce(sum(n) FILTER (WHERE value IS NULL), 0) AS BIGINT) AS missing FROM {name}v GROUP BY attribute)"
_SEG = "a0 AS (SELECT concat_ws('#', work_stem, vol_no, sent) AS unit, i AS ord, surface, pos1 FROM st), ea AS (SELECT unit, surface, sum(length(surface)) OVER (PARTITION BY unit ORDER BY ord) AS \"at\" FROM a0), b0 AS (SELECT *, sum(CASE WHEN pos1 = '助詞' THEN 0 ELSE 1 END) OVER (PARTITION BY unit ORDER BY ord) AS g FROM a0), b1 AS (SELECT unit, g, string_agg(surface, '' ORDER BY ord) AS surface FROM b0 GROUP BY ALL), eb AS (SELECT unit, surface, sum(length(surface)) OVER (PARTITION BY unit ORDER BY g) AS \"at\" FROM b1), fj AS (SELECT unit, \"at\", ea.surface AS seg_a, eb.surface AS seg_b FROM ea FULL JOIN eb USING (unit, \"at\"))"
_MED = lambda src, part: f"md AS (SELECT *, row_number() OVER ({part} ORDER BY v) AS rn, count(*) OVER ({part}) AS cn FROM {src} WHERE v IS NOT NULL)"
SQL = {
    "unknown_outliers": with_(TOK, ATT) + f", r AS (SELECT work_stem || '#' || vol_no AS target, work_stem, round(count(*) FILTER (WHERE {UNKNOWN}) / nullif(count(*) FILTER (WHERE NOT {PUNCT}), 0), 6) AS v FROM tok GROUP BY work_stem, vol_no), g AS (SELECT target, v, coalesce(genre_main, '-') AS grp FROM r LEFT JOIN att USING (work_stem)), " + _MED("g", "PARTITION BY grp") + ", m AS (SELECT grp, v AS med FROM md WHERE rn = cn // 2 + 1) SELECT 'WARN' AS level, 'unknown_rate_outlier' AS \"check\", target, CAST(round(v, 6) AS VARCHAR) AS detail FROM g JOIN m USING (grp) WHERE v > greatest(med * 1.5e0, med + 0.002e0)",
    "extraction_loss": "WITH g AS (SELECT doc_id, length(regexp_replace(regexp_replace(text, '《[^》]*》', '', 'g'), '［＃[^］]*］', '', 'g')) / length(text) AS v FROM documents WHERE text <> ''), " + _MED("g", "") + " SELECT 'FATAL' AS level, 'extraction_loss' AS \"check\", CAST(doc_id AS VARCHAR) AS target, CAST(round(v, 6) AS VARCHAR) AS detail FROM g WHERE v < 0.97e0 * (SELECT v FROM md WHERE rn = cn // 2 + 1)",
    "segmentation_agreement": with_(ST, _SEG) + ", u AS (SELECT unit, count(*) FILTER (WHERE seg_a IS NOT NULL AND seg_b IS NOT NULL) AS common, count(*) AS either FROM fj GROUP BY unit) SELECT count(*) AS units, CAST(sum(common) AS BIGINT) AS common, CAST(sum(either) AS BIGINT) AS either, round(median(round(common / either, 6)), 6) AS median FROM u",
    "segmentation_samples": with_(ST, _SEG) + "SELECT unit, CAST(\"at\" AS BIGINT) AS \"at\", seg_a, seg_b FROM fj WHERE seg_a IS NULL OR seg_b IS NULL ORDER BY md5('42|' || unit || '|' || CAST(\"at\" AS BIGINT)), unit, \"at\" LIMIT 20",
    "segmentation_stats": with_(TOK) + ", t AS (SELECT * FROM tok WHERE NOT " + PUNCT + "), u AS (SELECT *, lemma IS NULL OR lemma IN ('', '*') AS unk FROM t) SELECT work_stem, count(*) AS tokens, count(*) FILTER (WHERE unk) AS unknown, round(count(*) FILTER (WHERE unk) / count(*), 5) AS unknown_rate, round(avg(length(surface)), 5) AS mean_len, round(count(*) FILTER (WHERE length(surface) = 1) / count(*), 5) AS len1_rate, round(count(*) FILTER (WHERE pos1 = '名詞') / count(*), 5) AS noun_rate, round(count(*) FILTER (WHERE pos1 = '動詞') / count(*), 5) AS verb_rate, round(count(*) FILTER (WHERE pos1 = '助動詞') / count(*), 5) AS aux_rate FROM u GROUP BY work_stem",
    "quality_findings": _FIND,
    "quality_gate": f"SELECT level, \"check\", count(*) AS n FROM ({_FIND}) GROUP BY ALL",
    "meta_required": f"WITH {_REQ} SELECT 'FATAL' AS level, 'required_empty' AS check, id AS target, x[1] AS detail FROM rq WHERE x[2] IS NULL OR trim(x[2], ' ') = '' UNION SELECT 'WARN', 'to_be_decided', id, x[1] FROM rq WHERE upper(trim(x[2], ' ')) = 'TBD' OR trim(x[2], ' ') = '不明' UNION SELECT CASE WHEN try_cast(year_first AS INTEGER) IS NULL THEN 'FATAL' ELSE 'WARN' END, 'year_range', id, year_first FROM corpus_metadata_v2 WHERE id IS NOT NULL AND trim(year_first, ' ') <> '' AND (try_cast(year_first AS INTEGER) IS NULL OR try_cast(year_first AS INTEGER) < 1850 OR try_cast(year_first AS INTEGER) > 1970) UNION SELECT 'WARN', 'repeated_id', id, CAST(count(*) AS VARCHAR) FROM corpus_metadata_v2 WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1",
    "length_skew": with_(TOK) + ", z AS (SELECT work_stem, count(*) AS n FROM tok GROUP BY ALL), m AS (SELECT max((n, work_stem)) AS hi, min((n, work_stem)) AS lo FROM z) SELECT 'WARN' AS level, 'length_skew' AS check, hi[2] || ' / ' || lo[2] AS target, CAST(round(hi[1] / lo[1], 2) AS VARCHAR) AS detail FROM m WHERE hi[1] / lo[1] > 10",
    "balance_audit": with_(TOK, ATT, _SIZES) + ", t AS (SELECT CAST(sum(tokens) AS DOUBLE) AS al FROM sz), g AS (SELECT 'author_share' AS check, author AS target, sum(tokens) / any_value(al) AS v, sum(tokens) / any_value(al) <= 0.12e0 AS ok FROM sz, t WHERE author IS NOT NULL GROUP BY author UNION ALL SELECT 'work_share', work, sum(tokens) / any_value(al), sum(tokens) / any_value(al) <= 0.08e0 FROM sz, t GROUP BY work), b AS (SELECT band, sum(tokens) AS n FROM sz WHERE band IS NOT NULL GROUP BY band), ba AS (SELECT band, max(n) / sum(n) AS v FROM (SELECT band, author, sum(tokens) AS n FROM sz WHERE band IS NOT NULL AND author IS NOT NULL GROUP BY ALL) GROUP BY band) SELECT \"check\", target, round(v, 6) AS value, ok FROM g WHERE NOT ok UNION ALL SELECT 'band_ratio', max_by(band, (n, band)) || '/' || min_by(band, (n, band)), round(max(n) / min(n), 6), max(n) / min(n) <= 3 FROM b UNION ALL SELECT 'band_top_author', band, round(v, 6), v <= 0.4e0 FROM ba UNION ALL SELECT 'female_share', 'all', round(sum(CASE WHEN sex = 'f' THEN tokens ELSE 0 END) / sum(tokens), 6), round(sum(CASE WHEN sex = 'f' THEN tokens ELSE 0 END) / sum(tokens), 6) >= 0.2e0 FROM sz WHERE sex IS NOT NULL",
    "share_skew": with_(ATT, _SKEW("sk", "")) + "SELECT * FROM sk",
    "skew_before_after": with_(ATT, _SKEW("ska", ""), _SKEW("skb", "WHERE year >= 1912")) + "SELECT attribute, ska.top AS top_before, ska.top_share AS share_before, skb.top AS top_after, skb.top_share AS share_after, round(skb.top_share - ska.top_share, 6) AS change FROM ska JOIN skb USING (attribute)",
    "tbd_cells": "WITH e AS (SELECT unnest([('period', " + sql_category("period") + "), ('genre_main', " + sql_category("genre_main") + "), ('author_sex', " + sql_category("author_sex") + "), ('register_level', " + sql_category("register_level") + "), ('tokens', " + sql_category("tokens") + "), ('audience', " + sql_category("audience") + ")]) AS x FROM corpus_metadata_v2 WHERE id IS NOT NULL) SELECT x[1] AS \"column\", count(*) FILTER (WHERE x[2] IS NULL) AS open, count(*) AS rows FROM e GROUP BY 1",
    "empty_period_chunks": "WITH c AS (SELECT count(*) AS chunks, count(*) FILTER (WHERE period IS NULL OR trim(period, ' ') = '') AS empty FROM chunks_index WHERE chunk_id IS NOT NULL) SELECT chunks, empty, round(empty / nullif(chunks, 0), 6) AS share, CASE WHEN empty / chunks > 0.5e0 THEN 'FATAL' WHEN empty > 0 THEN 'WARN' ELSE 'OK' END AS level FROM c",
    "report_agreement": with_(TOK) + ", r AS (SELECT regexp_replace(file, '\\.[a-z]+$', '') AS v, max(tokens) AS stated FROM tokenise_report WHERE file IS NOT NULL GROUP BY file), n AS (SELECT work_stem || '_' || vol_no AS v, count(*) AS counted FROM tok GROUP BY ALL) SELECT count(*) AS volumes, count(*) FILTER (WHERE stated IS NULL) AS not_stated, count(*) FILTER (WHERE counted IS NULL) AS not_counted, count(*) FILTER (WHERE stated = counted) AS equal FROM r FULL JOIN n USING (v)",
    "category_crosstab": with_(ATT) + "SELECT genre_main, author_sex, count(*) AS works, CAST(sum(tokens) AS BIGINT) AS tokens, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM att WHERE genre_main IS NOT NULL AND author_sex IS NOT NULL GROUP BY ALL",
}
