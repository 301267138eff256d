"""Shared inputs of the queries, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fumikura.sources.index import of_tables

COLS = ("surface", "lemma_key", "lemma", "orthbase", "pos1", "pos2", "pos3", "goshu")


def tok(spark: SparkSession, d: str, *columns: str, sentences: bool = False) -> DataFrame:
    """Tokens from the index, which the first query of a session builds or opens."""
    return of_tables(spark, d).tokens.select("work_stem", "vol_no", "i", *(["sent"] if sentences else []), *(columns or COLS))


def attributes(spark: SparkSession, d: str) -> DataFrame:
    """work_stem, period, genre_main, author_sex, register_level, tokens, author, title, year of every work."""
    return of_tables(spark, d).works


_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F)).replace("'", "''") + "　"
_HALF = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''") + " "


def sql_narrow(c: str) -> str:
    return f"translate({c}, '{_FULL}', '{_HALF}')"


def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^[\\s\\x{{00a0}}\\x{{3000}}\\x{{200b}}\\x{{feff}}]+|[\\s\\x{{00a0}}\\x{{3000}}\\x{{200b}}\\x{{feff}}]+$', '', 'g')"


def sql_category(c: str) -> str:
    x = f"lower({sql_strip(sql_narrow(c))})"
    return f"(CASE WHEN {x} NOT IN ('', '不明', '未詳', 'tbd', 'na', 'n/a', 'none', 'null', 'nan', 'unknown', '-', '?') THEN {x} END)"


def sql_sex(c: str) -> str:
    x = sql_category(c)
    return f"(CASE WHEN {x} IN ('f','female','woman','女','女性') THEN 'f' WHEN {x} IN ('m','male','man','男','男性') THEN 'm' ELSE {x} END)"


def sql_period(c: str) -> str:
    return f"nullif(regexp_extract({sql_strip(sql_narrow(c))}, '^(\\d+)', 1), '')"


def sql_number(c: str) -> str:
    x = f"regexp_replace({sql_narrow(c)}, '[\\s\\x{{00a0}}\\x{{3000}},_、]', '', 'g')"
    return f"try_cast(nullif(regexp_extract({x}, '^\\+?(\\d+)(?:\\.0*)?(?:[\\p{{L}}%]*)$', 1), '') AS BIGINT)"


#: tok: each token once.
TOK = "tok AS (SELECT DISTINCT work_stem, vol_no, i, surface, lemma_key, lemma, orthbase, pos1, pos2, pos3, goshu FROM tsv WHERE i IS NOT NULL AND work_stem IS NOT NULL AND vol_no IS NOT NULL AND line_no IS NOT NULL)"
#: st: each token once, with the number of line ends before it in the volume.
ST = """lns AS (SELECT DISTINCT work_stem, vol_no, line_no, i, surface, lemma_key, lemma, orthbase, pos1, pos2, pos3 FROM tsv WHERE work_stem IS NOT NULL AND vol_no IS NOT NULL AND line_no IS NOT NULL AND (i IS NOT NULL OR pos1 = 'EOS')),
st AS (SELECT * EXCLUDE (line_no) FROM (SELECT *, CAST(sum(CASE WHEN i IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY work_stem, vol_no ORDER BY line_no) AS BIGINT) AS sent FROM lns) WHERE i IS NOT NULL)"""
#: att: one row per work.
ATT = f"""ids AS (SELECT {sql_strip("id")} AS id, min(lpad({sql_strip(sql_narrow("aozora_person_id"))}, 6, '0') || '_' || lpad({sql_strip(sql_narrow("aozora_work_id"))}, 6, '0')) AS work_stem, min({sql_period("period")}) AS period, min({sql_category("genre_main")}) AS genre_main, min({sql_sex("author_sex")}) AS author_sex, min({sql_category("register_level")}) AS register_level, min({sql_number("tokens")}) AS tokens, min({sql_strip(sql_narrow("author_ja"))}) AS author, min({sql_strip(sql_narrow("title_aozora"))}) AS title, min(try_cast(year_first AS INTEGER)) AS year FROM corpus_metadata_v2 WHERE id IS NOT NULL GROUP BY 1),
att AS (SELECT work_stem, min(period) AS period, min(genre_main) AS genre_main, min(author_sex) AS author_sex, min(register_level) AS register_level, min(tokens) AS tokens, min(author) AS author, min(title) AS title, min(year) AS year FROM ids WHERE work_stem IS NOT NULL GROUP BY work_stem)"""
#: Content tokens, punctuation, unknown words as conditions.
CONTENT = "(pos1 IN ('名詞','動詞','形容詞','副詞','形状詞') AND coalesce(pos2,'') <> '数詞')"
PUNCT = "(coalesce(pos1,'') IN ('補助記号','空白','記号'))"
UNKNOWN = f"((lemma IS NULL OR lemma IN ('','*')) AND NOT {PUNCT})"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
