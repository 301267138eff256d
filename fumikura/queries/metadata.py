"""Queries over the building of the metadata table."""

from __future__ import annotations

from pyspark.sql import functions as F

from fumikura.operators import metadata as md
from fumikura.queries.base import ATT, TOK, attributes, sql_period, tok, with_
from fumikura.sources.corpus import table

COLUMNS = ["register_level", "form", "narration", "completeness"]


def _meta(s, d):
    """A row of the table for each id."""
    m = table(s, d, "corpus_metadata_v2").where("id is not null")
    cols = [c for c in m.columns if c not in ("id", "loaded_at")]
    return m.groupBy("id").agg(*(F.min(c).alias(c) for c in cols))


def _editor(s, d):
    """The stored values of every third work as an editor's table, ids unpadded; every ninth is of no work."""
    m = _meta(s, d).where("aozora_person_id is not null and aozora_work_id is not null").withColumn("k", F.conv(F.substring(F.md5("id"), 1, 4), 16, 10).cast("int"))
    bare = lambda c: F.regexp_replace(F.trim(F.col(c)), "^0+(?=[0-9])", "")
    person = F.when(F.col("k") % 9 == 0, F.concat(F.lit("9"), bare("aozora_person_id"))).otherwise(bare("aozora_person_id"))
    return m.where("k % 3 = 0").select(person.alias("person_id"), bare("aozora_work_id").alias("work_id"), *COLUMNS, F.when(F.col("k") % 2 == 0, F.concat(F.lit("checked "), "id")).alias("editorial_note"))


def editorial_rejects(s, d):
    return md.decisions(_editor(s, d), COLUMNS)[1].groupBy("column").agg(F.count("*").alias("cells"), F.count_distinct("value").alias("values"))


def editorial_stale(s, d):
    return md.stale(md.decisions(_editor(s, d), COLUMNS)[0], _meta(s, d))


def editorial_applied(s, d):
    good, _ = md.decisions(_editor(s, d), COLUMNS)
    m = md.decide(_meta(s, d), good, COLUMNS)
    return m.select("id", "register_level", "form", F.endswith(F.col("source_meta"), F.lit("editorial")).alias("edited"), F.coalesce(F.col("note").contains("checked"), F.lit(False)).alias("noted"))


def usable_works(s, d):
    m = md.usable(_meta(s, d))
    return m.groupBy("completeness").agg(F.count("*").alias("works"))


def extended_works(s, d):
    """Works of the chunk index that half of the table lacks, with the other half as candidates."""
    m = _meta(s, d).withColumn("k", F.conv(F.substring(F.md5("id"), 1, 4), 16, 10).cast("int") % 2)
    c = m.where("k = 0")
    log = c.select(F.col("aozora_person_id").alias("person_id"), F.col("aozora_work_id").alias("work_id"), "author_ja", F.concat("title_aozora", F.when(F.col("id") > "M", F.lit("上巻")).otherwise("")).alias("title_aozora"), F.when(F.length("id") % 2 == 0, F.col("year_first")).alias("year_first"), "ndc", F.lit("").alias("shoshutsu"))
    x = md.extend(m.where("k = 1").drop("k"), log, c.withColumn("year_target", F.col("year_first")))
    return x.select("person", "work", "year", "year_source", "period", "completeness", "sibling")


def periods_anew(s, d):
    return md.periods(_meta(s, d)).groupBy("period").agg(F.count("*").alias("works"), F.count_if("moved").alias("moved"))


def person_facts(s, d):
    t = _meta(s, d).select(F.col("aozora_person_id").alias("person_id"), F.col("author_reading").alias("reading"), F.col("author_birth").alias("birth"), F.col("author_death").alias("death"), "id")
    return md.persons(t, "id")


def metadata_agreement(s, d):
    m = _meta(s, d).select("id", "author_ja", "completeness")
    h = F.conv(F.substring(F.md5("id"), 1, 4), 16, 10).cast("int")
    other = m.where(h % 10 != 0).withColumn("completeness", F.when(h % 50 == 1, "other").otherwise(F.col("completeness")))
    return md.provenance_agreement(m, other, "id", ["author_ja", "completeness"])


def corpus_summary(s, d):
    n = tok(s, d, "surface").groupBy("work_stem").agg(F.count("*").alias("tokens"))
    return md.summary(n.join(attributes(s, d).select("work_stem", "author", "year"), "work_stem", "left"))


def slice_shares(s, d):
    """Chunks, tokens and works of each period of the chunk index, and how many times the smallest the largest is."""
    c = table(s, d, "chunks_index").where("chunk_id is not null and period5 is not null").dropDuplicates(["chunk_id"])
    g = c.groupBy("period5").agg(F.count("*").alias("chunks"), F.sum("chunk_tokens").alias("tokens"), F.count_distinct("work_stem").alias("works"))
    t = g.agg(F.sum("chunks").alias("all_c"), F.max("tokens").alias("hi"), F.min("tokens").alias("lo"))
    return g.crossJoin(F.broadcast(t)).select("period5", "chunks", "tokens", "works", F.round(F.col("chunks") / F.col("all_c"), 6).alias("share"), F.round(F.col("hi") / F.col("lo"), 4).alias("ratio"))  # one row


def five_year_bins(s, d):
    """Mean share of content tokens unknown to no one: chunk tokens by five years of first publication."""
    c = table(s, d, "chunks_index").where("chunk_id is not null").dropDuplicates(["chunk_id"])
    y = F.floor(md.year_of(F.col("year_first")) / 5) * 5
    return c.withColumn("bin", y.cast("int")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("chunks"), F.round(F.avg("chunk_tokens"), 4).alias("mean_tokens"))


QUERIES = {f.__name__: f for f in (editorial_rejects, editorial_stale, editorial_applied, usable_works, extended_works, periods_anew, person_facts, metadata_agreement, corpus_summary, slice_shares, five_year_bins)}

_M = "mm AS (SELECT id, min(author_ja) AS author_ja, min(aozora_person_id) AS pid, min(aozora_work_id) AS wid, min(register_level) AS register_level, min(form) AS form, min(narration) AS narration, min(completeness) AS completeness, min(note) AS note, min(author_reading) AS author_reading, min(author_birth) AS author_birth, min(author_death) AS author_death, min(year_first) AS year_first, min(period) AS period FROM corpus_metadata_v2 WHERE id IS NOT NULL GROUP BY id)"
_SIX = lambda c: f"(CASE WHEN regexp_matches(trim({c}, ' '), '^[0-9]{{1,5}}$') THEN lpad(trim({c}, ' '), 6, '0') ELSE trim({c}, ' ') END)"
_BARE = lambda c: f"regexp_replace(trim({c}, ' '), '^0+([0-9])', '\\1')"
_VOC = {c: "(" + ", ".join(f"'{x}'" for x in v.split()) + ")" for c, v in {"register_level": "canonical middlebrow popular documentary", "form": "novel novella short-story collection cycle treatise essay diary diary-novel biography autobiography play travelogue oral-transcript", "narration": "first third mixed none dialogue", "completeness": "complete incomplete part partial revised DUPLICATE superseded too_short merged"}.items()}
_CELL = lambda c: f"nullif(trim({c}, ' '), '')"
_ED = f"ek AS (SELECT *, ('0x' || substr(md5(id), 1, 4))::INTEGER AS k FROM mm WHERE pid IS NOT NULL AND wid IS NOT NULL), er AS (SELECT CASE WHEN k % 9 = 0 THEN '9' || {_BARE('pid')} ELSE {_BARE('pid')} END AS p0, {_BARE('wid')} AS w0, " + ", ".join(f"{_CELL(c)} AS {c}" for c in COLUMNS) + ", CASE WHEN k % 2 = 0 THEN 'checked ' || id END AS en FROM ek WHERE k % 3 = 0), " + f"ed AS (SELECT {_SIX('p0')} AS person, {_SIX('w0')} AS work, " + ", ".join(f"{c} AS {c}, coalesce({c} IN {_VOC[c]}, true) AS ok_{c}" for c in COLUMNS) + ", en FROM er WHERE p0 <> '' AND w0 <> ''), " + "ea AS (SELECT person, work, max((" + ", ".join(f"CASE WHEN ok_{c} THEN coalesce({c}, '') ELSE '' END" for c in COLUMNS) + ", coalesce(en, ''))) AS x FROM ed GROUP BY person, work)"
SQL = {
    "editorial_rejects": with_(_M, _ED) + ", b AS (" + " UNION ".join(f"SELECT person, work, '{c}' AS col, {c} AS v FROM ed WHERE {c} IS NOT NULL AND NOT ok_{c}" for c in COLUMNS) + ") SELECT col AS \"column\", count(*) AS cells, count(DISTINCT v) AS \"values\" FROM b GROUP BY col",
    "editorial_stale": with_(_M, _ED) + f"SELECT person, work FROM ea WHERE (person, work) NOT IN (SELECT ({_SIX('pid')}, {_SIX('wid')}) FROM mm WHERE pid IS NOT NULL AND wid IS NOT NULL)",
    "editorial_applied": with_(_M, _ED) + f"SELECT id, coalesce(nullif(x[1], ''), register_level) AS register_level, coalesce(nullif(x[2], ''), form) AS form, person IS NOT NULL AS edited, coalesce(contains(note, 'checked') OR x[5] <> '', false) AS noted FROM mm LEFT JOIN ea ON person = {_SIX('pid')} AND work = {_SIX('wid')}",
    "usable_works": with_(_M) + "SELECT completeness, count(*) AS works FROM mm WHERE coalesce(completeness NOT IN ('superseded', 'merged', 'too_short'), true) GROUP BY completeness",
    "periods_anew": with_(_M) + f", y AS (SELECT id, try_cast(substring(trim(year_first, ' '), 1, 4) AS INTEGER) AS y, {sql_period('period')} AS old FROM mm), p AS (SELECT *, CASE WHEN y IS NULL OR y <= 0 THEN NULL WHEN y < 1887 THEN '1' WHEN y < 1900 THEN '2' WHEN y < 1912 THEN '3' WHEN y < 1926 THEN '4' WHEN y < 1945 THEN '5' ELSE '6' END AS p FROM y) SELECT coalesce(p, old) AS period, count(*) AS works, count(*) FILTER (WHERE p IS NOT NULL AND p IS DISTINCT FROM old) AS moved FROM p GROUP BY 1",
    "person_facts": with_(_M) + f", t AS (SELECT {_SIX('pid')} AS person, id, {_CELL('author_reading')} AS author_reading, nullif(regexp_extract(coalesce(author_birth, ''), '([0-9]{{4}})', 1), '') AS author_birth, nullif(regexp_extract(coalesce(author_death, ''), '([0-9]{{4}})', 1), '') AS author_death FROM mm WHERE {_CELL('pid')} IS NOT NULL) SELECT person, author_reading, author_birth, author_death FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY id) AS r FROM t) WHERE r = 1",
    "metadata_agreement": with_(_M) + ", h AS (SELECT *, ('0x' || substr(md5(id), 1, 4))::INTEGER AS k FROM mm), g AS (SELECT count(*) FILTER (WHERE k % 10 <> 0) AS \"both\", count(*) FILTER (WHERE k % 10 = 0) AS only_a, count(*) FILTER (WHERE k % 50 = 1 AND completeness IS DISTINCT FROM 'other') AS cells_differ FROM h) SELECT \"both\", only_a, 0 AS only_b, cells_differ, 1.0e0 AS share, cells_differ = 0 AS agrees FROM g",
    "corpus_summary": with_(TOK, ATT) + ", n AS (SELECT work_stem, count(*) AS tokens FROM tok GROUP BY work_stem) SELECT count(*) AS works, count(DISTINCT author) AS authors, CAST(sum(n.tokens) AS BIGINT) AS tokens, min(year) AS first_year, max(year) AS last_year FROM n LEFT JOIN att USING (work_stem)",
    "slice_shares": "WITH c AS (SELECT chunk_id, any_value(period5) AS period5, any_value(chunk_tokens) AS t, any_value(work_stem) AS w FROM chunks_index WHERE chunk_id IS NOT NULL AND period5 IS NOT NULL GROUP BY chunk_id), g AS (SELECT period5, count(*) AS chunks, CAST(sum(t) AS BIGINT) AS tokens, count(DISTINCT w) AS works FROM c GROUP BY period5) SELECT *, round(chunks / sum(chunks) OVER (), 6) AS share, round(max(tokens) OVER () / min(tokens) OVER (), 4) AS ratio FROM g",
    "five_year_bins": "WITH c AS (SELECT chunk_id, any_value(try_cast(substring(trim(year_first, ' '), 1, 4) AS INTEGER)) AS y, any_value(chunk_tokens) AS t FROM chunks_index WHERE chunk_id IS NOT NULL GROUP BY chunk_id) SELECT CAST(y // 5 * 5 AS INTEGER) AS bin, count(*) AS chunks, round(avg(t), 4) AS mean_tokens FROM c WHERE y > 0 GROUP BY 1",
}
