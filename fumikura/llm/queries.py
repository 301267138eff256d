"""Queries of the operators for training data, named by problem, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fumikura.llm import encoding, leaks, pieces, repeats, sampling, sentences, spans, terms
from fumikura.sources.corpus import table

Q = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(table(spark, d, "tsv"), table(spark, d, "corpus_metadata_v2"))


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    tsv, m = table(spark, d, "tsv"), table(spark, d, "corpus_metadata_v2")
    return spans.shared_shares(spans.shared_spans(tsv, m), spans.record_lengths(tsv, m))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.found(table(spark, d, "tsv"), table(spark, d, "corpus_metadata_v2"))


def p2_scores(spark: SparkSession, d: str) -> DataFrame:
    return terms.top_terms(table(spark, d, "tsv"), table(spark, d, "corpus_metadata_v2")).withColumn("score", F.round("score", 9))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return sampling.found(table(spark, d, "corpus_metadata_v2"), table(spark, d, "sample_targets"))


def p3_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.draw(table(spark, d, "corpus_metadata_v2"), table(spark, d, "sample_targets"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return sampling.report(table(spark, d, "corpus_metadata_v2"), table(spark, d, "sample_targets"))


def p3_limits(spark: SparkSession, d: str) -> DataFrame:
    """The part of the report that no draw decides."""
    return p3_report(spark, d).select("target_id", "needed", "available", "can_be_met")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.found(table(spark, d, "tsv"), table(spark, d, "corpus_metadata_v2"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.found(table(spark, d, "tsv"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode(table(spark, d, "documents"))


def p6_decode(spark: SparkSession, d: str) -> DataFrame:
    """Every document encoded and decoded again; a null text comes back empty."""
    return encoding.decode(encoding.encode(table(spark, d, "documents")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p7_contained(spark: SparkSession, d: str) -> DataFrame:
    return leaks.contained(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return repeats.found(table(spark, d, "documents"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return repeats.repeated(table(spark, d, "documents"))


def p8_lines(spark: SparkSession, d: str) -> DataFrame:
    return repeats.clean(table(spark, d, "documents"))


def queries() -> dict[str, Q]:
    return {f.__name__: f for f in (p1_found, p1_shares, p2_found, p2_scores, p3_found, p3_sample, p3_report, p3_limits, p4_found, p5_found, p6_ids, p6_decode, p7_found, p7_contained, p8_found, p8_shares, p8_lines)}


_FULL, _HALF = "０１２３４５６７８９，．　＿－ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ", "0123456789,. _-ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_OUT = "[\\s\\x{00a0}\\x{3000}\\x{200b}\\x{feff}]"


def _clean(c: str) -> str:
    return f"regexp_replace(translate({c}, '{_FULL}', '{_HALF}'), '^{_OUT}+|{_OUT}+$', '', 'g')"


def _category(c: str) -> str:
    return f"(CASE WHEN lower({_clean(c)}) NOT IN ('', '不明', '未詳', 'tbd', 'na', 'n/a', 'none', 'null', 'nan', 'unknown', '-', '?') THEN lower({_clean(c)}) END)"


def _sex(c: str) -> str:
    x = _category(c)
    return f"(CASE WHEN {x} IN ('f', 'female', 'woman', '女', '女性') THEN 'f' WHEN {x} IN ('m', 'male', 'man', '男', '男性') THEN 'm' ELSE {x} END)"


def _period(c: str) -> str:
    return f"nullif(regexp_extract({_clean(c)}, '^(\\d+)', 1), '')"


_STEM = f"lpad({_clean('aozora_person_id')}, 6, '0') || '_' || lpad({_clean('aozora_work_id')}, 6, '0')"
_WORKS = f"wk AS (SELECT id, min({_STEM}) AS work_stem, min({_period('period')}) AS period, min({_category('genre_main')}) AS genre_main, min({_sex('author_sex')}) AS author_sex, min({_category('register_level')}) AS register_level, min(try_cast(nullif(regexp_extract(regexp_replace(translate(tokens, '{_FULL}', '{_HALF}'), '[\\s\\x{{00a0}}\\x{{3000}},_、]', '', 'g'), '^\\+?(\\d+)(?:\\.0*)?(?:[\\p{{L}}%]*)$', 1), '') AS BIGINT)) AS tokens FROM corpus_metadata_v2 WHERE id IS NOT NULL GROUP BY id)"
_RUNS = "SELECT field, rec, vol_no, min(a) AS first_pos, max(z) AS last_pos FROM (SELECT *, sum(new) OVER (PARTITION BY rec, vol_no ORDER BY a ROWS UNBOUNDED PRECEDING) AS isl FROM (SELECT *, CASE WHEN a <= lag(z) OVER (PARTITION BY rec, vol_no ORDER BY a) + 1 THEN 0 ELSE 1 END AS new FROM {src})) GROUP BY field, rec, vol_no, isl"


def _shared(rows: str, field: str, n: int, owner: str) -> str:
    """Windows of n units by their text, shared if two owners have them, as runs."""
    return f"""u AS ({rows}), w AS (SELECT *, string_agg(x, chr(1)) OVER f AS g, count(*) OVER f AS c FROM u WINDOW f AS (PARTITION BY rec, vol_no ORDER BY p ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)),
s AS (SELECT g FROM w WHERE c = {n} GROUP BY g HAVING count(DISTINCT {owner}) > 1), h AS (SELECT '{field}' AS field, rec, vol_no, p AS a, p + {n - 1} AS z FROM w WHERE c = {n} AND g IN (SELECT g FROM s))"""


_TOKENS = "SELECT work_stem AS rec, CAST(vol_no AS BIGINT) AS vol_no, CAST(i AS BIGINT) AS p, any_value(surface) AS x FROM tsv WHERE i IS NOT NULL AND work_stem IS NOT NULL AND vol_no IS NOT NULL GROUP BY ALL"
_TITLES = "SELECT id AS rec, CAST(0 AS BIGINT) AS vol_no, CAST(p AS BIGINT) AS p, substring(title_aozora, CAST(p AS INTEGER), 1) AS x FROM (SELECT DISTINCT id, title_aozora, unnest(range(1, length(title_aozora) + 1)) AS p FROM corpus_metadata_v2 WHERE id IS NOT NULL)"
_TERMS = "tk AS (SELECT DISTINCT work_stem, vol_no, i, split_part(lemma, '-', 1) AS term FROM tsv WHERE i IS NOT NULL AND work_stem IS NOT NULL AND vol_no IS NOT NULL), c AS (SELECT work_stem, term, count(*) AS tf FROM tk WHERE term <> '' GROUP BY ALL)"
_PERIODS = "pw AS (SELECT work_stem, min(period) AS period FROM wk WHERE work_stem IS NOT NULL AND period IS NOT NULL GROUP BY work_stem), pc AS (SELECT period, term, sum(tf) AS tf, count(*) AS works FROM c JOIN pw USING (work_stem) GROUP BY ALL)"
_SCORES = lambda name, src, rec, extra: f"{name} AS (SELECT {rec} AS rec, term, CAST(tf AS BIGINT) AS tf, {extra} count(*) OVER t AS df, CAST(sum(tf) OVER t AS BIGINT) AS cf, (tf + 1000 * (sum(tf) OVER t / sum(tf) OVER ())) / (sum(tf) OVER (PARTITION BY {rec}) + 1000) AS pd, sum(tf) OVER t / sum(tf) OVER () AS pc FROM {src} WINDOW t AS (PARTITION BY term))"


def oracle_sql() -> dict[str, str]:
    match = " AND ".join(f"(t.{c} IS NULL OR t.{c} = wk.{c})" for c in ("period", "genre_main", "author_sex", "register_level"))
    p1 = "WITH a AS (WITH " + _shared(_TOKENS, "surface", 30, "(rec, vol_no)") + _RUNS.format(src="h").replace("SELECT field", " SELECT field", 1) + "), b AS (WITH " + _shared(_TITLES, "title_aozora", 16, "rec") + _RUNS.format(src="h").replace("SELECT field", " SELECT field", 1) + ") SELECT * FROM a UNION ALL SELECT * FROM b"
    return {
        "p1_found": p1,
        "p1_shares": f"WITH f AS ({p1}), ln AS (SELECT 'surface' AS field, rec, vol_no, count(*) AS n FROM ({_TOKENS}) GROUP BY ALL UNION ALL SELECT 'title_aozora', id, 0, max(length(title_aozora)) FROM corpus_metadata_v2 WHERE id IS NOT NULL AND title_aozora <> '' GROUP BY id), sh AS (SELECT field, rec, vol_no, CAST(sum(last_pos - first_pos + 1) AS BIGINT) AS shared FROM f GROUP BY ALL) SELECT field, rec, vol_no, CAST(n AS BIGINT) AS n, coalesce(shared, 0) AS shared, round(coalesce(shared, 0) / n, 6) AS share FROM ln LEFT JOIN sh USING (field, rec, vol_no)",
        "p2_found": f"WITH {_TERMS}, {_WORKS}, {_PERIODS}, d AS (SELECT term, count(*) AS df FROM c GROUP BY term), q AS (SELECT term, count(*) AS df FROM pc GROUP BY term) SELECT 'work' AS unit, work_stem AS rec, term FROM c JOIN d USING (term) WHERE tf >= 6 AND df <= 2 UNION ALL SELECT 'period', period, term FROM pc JOIN q USING (term) WHERE tf >= 12 AND works >= 4 AND df = 1",
        "p3_found": f"WITH {_WORKS}, n AS (SELECT count(*) // 5 AS n FROM wk), t AS (SELECT target_id, {_period('period')} AS period, {_category('genre_main')} AS genre_main, {_sex('author_sex')} AS author_sex, {_category('register_level')} AS register_level, share_pct, min_items FROM sample_targets) SELECT target_id FROM t, n WHERE (SELECT count(*) FROM wk WHERE {match}) < greatest(CAST(ceil(share_pct * n / 100) AS BIGINT), min_items)",
        "p3_limits": f"WITH {_WORKS}, n AS (SELECT count(*) // 5 AS n FROM wk), t AS (SELECT target_id, {_period('period')} AS period, {_category('genre_main')} AS genre_main, {_sex('author_sex')} AS author_sex, {_category('register_level')} AS register_level, share_pct, min_items FROM sample_targets), x AS (SELECT target_id, CAST(greatest(CAST(ceil(share_pct * n / 100) AS BIGINT), min_items) AS BIGINT) AS needed, (SELECT count(*) FROM wk WHERE {match}) AS available FROM t, n) SELECT target_id, needed, available, available >= needed AS can_be_met FROM x",
        "p6_decode": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p8_lines": """WITH e AS (SELECT doc_id, source AS host, unnest(regexp_split_to_array(text, '\\r\\n|[\\n\\r]')) AS line FROM documents WHERE doc_id IS NOT NULL), l AS (SELECT doc_id, host, lower(regexp_replace(line, '[^\\p{L}\\p{N}]', '', 'g')) AS norm FROM e), k AS (SELECT * FROM l WHERE norm <> ''), h AS (SELECT coalesce(host, chr(1)) AS host, norm, count(DISTINCT doc_id) > 5 AS hot FROM k GROUP BY ALL)
SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE NOT hot) AS kept, coalesce(sum(CASE WHEN hot THEN 0 ELSE length(k.norm) END), 0) < 0.5e0 * sum(length(k.norm)) AS rejected FROM k JOIN h ON h.host = coalesce(k.host, chr(1)) AND h.norm = k.norm GROUP BY doc_id""",
        "p4_found": f"""WITH RECURSIVE {_WORKS}, l AS (SELECT DISTINCT work_stem, vol_no, line_no, i, surface FROM tsv WHERE work_stem IS NOT NULL AND vol_no IS NOT NULL AND line_no IS NOT NULL AND (i IS NOT NULL OR pos1 = 'EOS')),
m AS (SELECT *, lead(i IS NULL) OVER (PARTITION BY work_stem, vol_no ORDER BY line_no) AS e FROM l), k AS (SELECT work_stem, vol_no, i, e, surface, count(*) OVER (PARTITION BY work_stem, vol_no) AS n FROM m WHERE i IS NOT NULL),
f AS (SELECT work_stem, vol_no, CAST(i AS BIGINT) AS s, n, CAST(CASE WHEN n - i + 1 <= 400 THEN n ELSE coalesce(max(CASE WHEN e THEN i END) OVER w, max(CASE WHEN surface IN ('。', '．', '！', '？') THEN i END) OVER w, max(CASE WHEN surface IN ('、', '，') THEN i END) OVER w, i + 399) END AS BIGINT) AS z FROM k WHERE n > 400 WINDOW w AS (PARTITION BY work_stem, vol_no ORDER BY i ROWS BETWEEN 200 FOLLOWING AND 399 FOLLOWING)),
r AS (SELECT work_stem, vol_no, s, z, n FROM f WHERE s = 1 UNION ALL SELECT f.work_stem, f.vol_no, f.s, f.z, f.n FROM r JOIN f ON f.work_stem = r.work_stem AND f.vol_no = r.vol_no AND f.s = r.z - 39 WHERE r.z < r.n)
SELECT 'surface' AS field, work_stem AS rec, CAST(vol_no AS BIGINT) AS vol_no, s AS first_pos, z AS last_pos FROM r
UNION ALL SELECT 'tokens', id, 0, j * 360 + 1, least(j * 360 + 400, tokens) FROM (SELECT id, tokens, unnest(range((tokens - 41) // 360 + 1)) AS j FROM wk WHERE tokens > 400 AND coalesce(work_stem, '') NOT IN (SELECT work_stem FROM tsv WHERE work_stem IS NOT NULL))""",
        "p2_scores": f"WITH {_TERMS}, {_WORKS}, {_PERIODS}, {_SCORES('sw', 'c', 'work_stem', '')}, {_SCORES('sp', 'pc', 'period', '')}, a AS (SELECT 'work' AS unit, * FROM sw WHERE df >= 2 UNION ALL SELECT 'period', * FROM sp), b AS (SELECT unit, rec, term, tf, df, cf, round(pd * log2(pd / pc), 12) AS score FROM a), r AS (SELECT *, row_number() OVER (PARTITION BY unit, rec ORDER BY score DESC, term) AS rank FROM b) SELECT unit, rec, term, tf, df, cf, round(score, 9) AS score, rank FROM r WHERE rank <= 20",
    }
