"""Concordance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fumikura.operators import concordance as kw
from fumikura.operators import requests
from fumikura.queries.base import ATT, PUNCT, ST, attributes, with_
from fumikura.sources.corpus import table
from fumikura.sources.index import of_tables

NODE = "見る"


def _t(s, d):
    return of_tables(s, d).tokens


def _hits(query, **options):
    return lambda s, d: kw.search(_t(s, d), query, **options)


def kwic_index(s, d):
    """What the index holds; the first query of a session builds it."""
    t = of_tables(s, d).tokens
    v = t.groupBy("work_stem", "vol_no").agg(F.count("*").alias("n"), F.count("lemma_key_1").alias("followed"), F.count("surface_m2").alias("preceded"), F.count_distinct("sent").alias("k"))
    return v.agg(F.sum("n").alias("tokens"), F.count("*").alias("volumes"), F.sum("k").alias("sentences"), F.sum("followed").alias("followed"), F.sum("preceded").alias("preceded"))


def kwic_totals(s, d):
    h = kw.search(_t(s, d), NODE)
    return h.agg(F.count("*").alias("hits"), F.count_distinct("work_stem").alias("works"))


def kwic_by_work(s, d):
    return kw.by_group(kw.search(_t(s, d), NODE), of_tables(s, d).sizes, "work_stem")


def _bands(s, d):
    return attributes(s, d).select("work_stem", F.col("period").alias("band"))


def kwic_by_band(s, d):
    b = _bands(s, d)
    sizes = of_tables(s, d).sizes.join(b, "work_stem", "left").groupBy("band").agg(F.sum("tokens").alias("tokens"))
    return kw.by_group(kw.search(_t(s, d), NODE).join(b, "work_stem", "left"), sizes, "band")


def kwic_facets(s, d):
    h = kw.facets(kw.search(_t(s, d), "*/動詞 *", exclude_punct=True), attributes(s, d), genre_main=["fiction"], author_sex=["f"])
    return h.groupBy("work_stem").agg(F.count("*").alias("hits"))


def kwic_facet_period(s, d):
    h = kw.facets(kw.search(_t(s, d), NODE), attributes(s, d), period=["2", "3", "4"], register_level=[], genre_main=["fiction", "essay"])
    return h.select("work_stem", "vol_no", "i")


def kwic_types(s, d):
    return kw.tally(kw.search(_t(s, d), "*/名詞 の"))


def _page(s, d, query, sort, columns, limit=60):
    h = kw.with_source(kw.sort_keys(_t(s, d), query, sort), attributes(s, d))
    return h.orderBy(*kw.order_columns(sort)).limit(limit).select("work_stem", "vol_no", "i", *columns)  # a page


def kwic_sorted_left1(s, d):
    h = kw.sort_keys(_t(s, d), NODE, "left1")
    return h.orderBy(*kw.order_columns("left1")).select("work_stem", "vol_no", "i", "left1")


def kwic_page_left2(s, d):
    return _page(s, d, "男 の", "left2", ["left1", "left2"])


def kwic_page_right2(s, d):
    return _page(s, d, "*/名詞 の", "right2", ["right1", "right2"])


def kwic_page_title(s, d):
    return _page(s, d, NODE, "title", ["title", "has_meta"])


def kwic_page_author(s, d):
    return _page(s, d, NODE, "author", ["author", "year"])


def kwic_page_random(s, d):
    return _page(s, d, NODE, "random", [])


def kwic_page(s, d):
    h = kw.sort_keys(_t(s, d), NODE, "right1")
    return h.orderBy(*kw.order_columns("right1")).offset(10).limit(20).select("work_stem", "vol_no", "i", "right1")  # a page


def kwic_sorted_year(s, d):
    h = kw.search(_t(s, d), NODE).join(attributes(s, d).select("work_stem", "year", "author"), "work_stem", "left")
    return h.select("work_stem", "vol_no", "i", F.coalesce("year", F.lit(9999)).alias("year"), "author").orderBy("year", "author", "work_stem", "vol_no", "i")


def kwic_sample(s, d):
    return kw.sample(kw.search(_t(s, d), "*/動詞"), 50)


def kwic_rows(s, d):
    t = _t(s, d)
    return kw.context(t, kw.search(t, NODE), 1, 5)


def kwic_table(s, d):
    """The rows of a request as a table for readers."""
    a = requests.search(of_tables(s, d), NODE, context=5, limit=50, sort="year")
    return kw.result_table(a.rows.drop("author", "title", "year", "period", "has_meta"), attributes(s, d), "")


def kwic_passage(s, d):
    return kw.passage(_t(s, d), "099001_040404", 1, 100, 30, 30)


def kwic_text(s, d):
    return kw.kwic_text(table(s, d, "documents"), "灯台坂", 28)


def colloc_measures(s, d):
    t = _t(s, d)
    return kw.collocates(t, kw.search(t, NODE), min_co=2, forms=of_tables(s, d).forms)


def colloc_pos(s, d):
    t = _t(s, d)
    return kw.collocates(t, kw.search(t, "*/動詞"), min_co=5, pos=["名詞"], forms=of_tables(s, d).forms)


def colloc_classes(s, d):
    """Major and minor classes mixed."""
    t = _t(s, d)
    return kw.collocates(t, kw.search(t, NODE), min_co=1, pos=["動詞", "名詞-普通名詞"], forms=of_tables(s, d).forms)


def colloc_focus(s, d):
    t = _t(s, d)
    return kw.focus(t, kw.search(t, "*/動詞"), "の")


def variants_by_band(s, d):
    t = _t(s, d)
    return kw.variants(t, kw.search(t, "*/名詞", carry=("orthbase",)), _bands(s, d))


def variant_table(s, d):
    return kw.variant_table(_t(s, d), min_types=2, min_var=1, min_freq=3).drop("pos")


def variant_ranks(s, d):
    return kw.ranked_variants(kw.variant_table(_t(s, d), min_types=2, min_var=2, min_freq=5), "types", 30).drop("spellings")


def pos_tree(s, d):
    return kw.pos_tree(_t(s, d))


def facet_counts(s, d):
    w = of_tables(s, d).sizes.select("work_stem").join(attributes(s, d), "work_stem", "left")
    e = w.select(F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in ("author", "period", "genre_main", "author_sex")))).alias("x"))
    return e.groupBy("x.facet", "x.value").agg(F.count("*").alias("works"))


_HITS = {"kwic_word": NODE, "kwic_phrase": "男 の", "kwic_glob": "帆*|*坂", "kwic_regex": "re:[雪雨].", "kwic_pos": "*/動詞 た/助動詞", "kwic_mixed": "S:の */名詞 L:を|が"}
QUERIES = {n: _hits(q) for n, q in _HITS.items()} | {f.__name__: f for f in (kwic_index, kwic_totals, kwic_by_work, kwic_by_band, kwic_facets, kwic_facet_period, kwic_types, kwic_sorted_left1, kwic_page_left2, kwic_page_right2, kwic_page_title, kwic_page_author, kwic_page_random, kwic_table, colloc_classes, variant_ranks, kwic_page, kwic_sorted_year, kwic_sample, kwic_rows, kwic_passage, kwic_text, colloc_measures, colloc_pos, colloc_focus, variants_by_band, variant_table, pos_tree, facet_counts)}

_S = with_(ST)
_J = "USING (work_stem, vol_no, sent)"
_LD = "ld AS (SELECT *, " + ", ".join(f"lead({c}, {k}) OVER w AS {c}_{k}" for k in (1, 2, 3) for c in ("lemma_key", "surface", "pos1", "i")) + ", " + ", ".join(f"lag({c}, {k}) OVER w AS {c}_m{k}" for k in (1, 2) for c in ("surface", "i")) + " FROM st WINDOW w AS (PARTITION BY work_stem, vol_no, sent ORDER BY i))"
_L = with_(ST, _LD)
_SEQ = lambda conds, forms: _L + "SELECT work_stem, vol_no, sent, i, concat_ws(' ', " + ", ".join(forms) + ") AS form FROM ld WHERE " + " AND ".join([*conds, *(f"i_{k} = i + {k}" for k in range(1, len(forms)))])
_NODE = f"nd AS (SELECT * FROM st WHERE lemma_key = '{NODE}')"
_TN = f"tn AS (SELECT work_stem, vol_no, sent, i, lemma_key AS form, pos1, pos2 FROM st WHERE NOT {PUNCT})"
_OFF = "of AS (SELECT unnest([-4, -3, -2, -1, 1, 2, 3, 4]) AS o)"
_CELL = lambda o, x: f"(CASE WHEN {o} > 0 AND {x} > 0 THEN ({o}) * ln(({o}) / ({x})) ELSE 0.0e0 END)"


def _colloc(node: str, least: int, pos: str) -> str:
    return with_(ST, _TN, _OFF, f"hh AS (SELECT work_stem, vol_no, sent, i FROM st WHERE {node})") + f""", wn AS (SELECT tn.form, tn.pos1, tn.pos2 FROM hh CROSS JOIN of JOIN tn ON tn.work_stem = hh.work_stem AND tn.vol_no = hh.vol_no AND tn.sent = hh.sent AND tn.i = hh.i + o),
ww AS (SELECT count(*) AS co_all FROM wn), nn AS (SELECT count(*) AS total FROM tn), nh AS (SELECT count(*) AS node FROM hh),
co AS (SELECT form, count(*) AS co FROM wn {pos} GROUP BY form HAVING count(*) >= {least}), fr AS (SELECT form, count(*) AS freq FROM tn {pos} GROUP BY form HAVING count(*) >= 3),
x AS (SELECT form, co, freq, CAST(co AS DOUBLE) AS a, CAST(freq AS DOUBLE) AS f, CAST(co_all AS DOUBLE) AS w, CAST(total AS DOUBLE) AS n, CAST(node AS DOUBLE) AS nd FROM co JOIN fr USING (form), ww, nn, nh),
y AS (SELECT *, w * f / n AS e, 2.0e0 * ({_CELL('a', 'w * f / n')} + {_CELL('w - a', 'w * (n - f) / n')} + {_CELL('f - a', '(n - w) * f / n')} + {_CELL('n - w - f + a', '(n - w) * (n - f) / n')}) AS ll FROM x)
SELECT form, co, freq, round(14 + log2(2 * a / (nd + f)), 2) AS logdice, round(log2(a / e), 2) AS mi, round(log2(a * a * a / e), 2) AS mi3, round((a - e) / sqrt(a), 2) AS t, round(CASE WHEN a >= e THEN ll ELSE -ll END, 2) AS g2, round(a / w - (f - a) / (n - w), 4) AS delta_p_fwd, round(a / f - (w - a) / (n - f), 4) AS delta_p_bwd FROM y"""


SQL = {
    "kwic_word": _SEQ([f"lemma_key = '{NODE}'"], ["lemma_key"]),
    "kwic_phrase": _SEQ(["lemma_key = '男'", "lemma_key_1 = 'の'"], ["lemma_key", "lemma_key_1"]),
    "kwic_glob": _SEQ(["(lemma_key LIKE '帆%' OR lemma_key LIKE '%坂')"], ["lemma_key"]),
    "kwic_regex": _SEQ(["regexp_matches(lemma_key, '[雪雨].')"], ["lemma_key"]),
    "kwic_pos": _SEQ(["pos1 LIKE '動詞%'", "lemma_key_1 = 'た'", "pos1_1 LIKE '助動詞%'"], ["lemma_key", "lemma_key_1"]),
    "kwic_mixed": _SEQ(["surface = 'の'", "pos1_1 LIKE '名詞%'", "lemma_key_2 IN ('を', 'が')"], ["surface", "lemma_key_1", "lemma_key_2"]),
    "kwic_index": _L + "SELECT count(*) AS tokens, count(DISTINCT (work_stem, vol_no)) AS volumes, count(DISTINCT (work_stem, vol_no, sent)) AS sentences, count(*) FILTER (WHERE i_1 = i + 1 AND lemma_key_1 IS NOT NULL) AS followed, count(*) FILTER (WHERE i_m2 = i - 2 AND surface_m2 IS NOT NULL) AS preceded FROM ld",
    "kwic_facet_period": with_(ST, ATT) + f"SELECT work_stem, vol_no, i FROM st WHERE lemma_key = '{NODE}' AND work_stem IN (SELECT work_stem FROM att WHERE period IN ('2', '3', '4') AND genre_main IN ('fiction', 'essay'))",
    "kwic_page_left2": _L + "SELECT work_stem, vol_no, i, CASE WHEN i_m1 = i - 1 THEN surface_m1 END AS left1, CASE WHEN i_m2 = i - 2 THEN surface_m2 END AS left2 FROM ld WHERE lemma_key = '男' AND lemma_key_1 = 'の' AND i_1 = i + 1 ORDER BY left1 NULLS FIRST, left2 NULLS FIRST, work_stem, vol_no, i LIMIT 60",
    "kwic_page_right2": _L + "SELECT work_stem, vol_no, i, CASE WHEN i_2 = i + 2 THEN surface_2 END AS right1, CASE WHEN i_3 = i + 3 THEN surface_3 END AS right2 FROM ld WHERE pos1 LIKE '名詞%' AND lemma_key_1 = 'の' AND i_1 = i + 1 ORDER BY right1 NULLS FIRST, right2 NULLS FIRST, work_stem, vol_no, i LIMIT 60",
    "kwic_page_title": with_(ST, ATT) + f"SELECT work_stem, vol_no, i, coalesce(title, work_stem) AS title, att.work_stem IS NOT NULL AS has_meta FROM st LEFT JOIN att USING (work_stem) WHERE lemma_key = '{NODE}' ORDER BY coalesce(title, st.work_stem), st.work_stem, vol_no, i LIMIT 60",
    "kwic_page_author": with_(ST, ATT) + f"SELECT work_stem, vol_no, i, coalesce(author, '{kw.NO_METADATA}') AS author, year FROM st LEFT JOIN att USING (work_stem) WHERE lemma_key = '{NODE}' ORDER BY coalesce(author, '{kw.NO_METADATA}'), st.work_stem, vol_no, i LIMIT 60",
    "kwic_page_random": _S + f"SELECT work_stem, vol_no, i FROM st WHERE lemma_key = '{NODE}' ORDER BY md5('42|' || work_stem || '|' || vol_no || '|' || i), work_stem, vol_no, i LIMIT 60",
    "kwic_sample": _S + "SELECT work_stem, vol_no, sent, i, lemma_key AS form FROM st WHERE pos1 LIKE '動詞%' ORDER BY md5('42|' || work_stem || '|' || vol_no || '|' || i), work_stem, vol_no, i LIMIT 50",
    "kwic_table": with_(ST, _NODE, ATT) + f", pg AS (SELECT nd.work_stem, nd.vol_no, nd.i, att.period, coalesce(author, '{kw.NO_METADATA}') AS author, coalesce(title, nd.work_stem) AS title FROM nd LEFT JOIN att ON att.work_stem = nd.work_stem ORDER BY coalesce(year, 9999), coalesce(author, '{kw.NO_METADATA}'), nd.work_stem, nd.vol_no, nd.i LIMIT 50) SELECT coalesce(any_value(period), '?') AS period, any_value(author) AS author, any_value(title) AS title, replace(coalesce(string_agg(CASE WHEN x.i < pg.i THEN x.surface END, ' ' ORDER BY x.i), ''), ' ', '') AS left, replace(string_agg(CASE WHEN x.i = pg.i THEN x.surface END, ' ' ORDER BY x.i), ' ', '') AS key, replace(coalesce(string_agg(CASE WHEN x.i > pg.i THEN x.surface END, ' ' ORDER BY x.i), ''), ' ', '') AS right, pg.work_stem, pg.vol_no, pg.i FROM pg JOIN st x ON x.work_stem = pg.work_stem AND x.vol_no = pg.vol_no AND x.i BETWEEN pg.i - 5 AND pg.i + 5 GROUP BY pg.work_stem, pg.vol_no, pg.i",
    "colloc_classes": _colloc(f"lemma_key = '{NODE}'", 1, "WHERE pos1 IN ('動詞') OR pos1 || '-' || pos2 = '名詞-普通名詞'"),
    "variant_ranks": _S + ", c AS (SELECT lemma_key AS lemma, orthbase, count(*) AS n FROM st WHERE lemma_key <> '' AND orthbase <> '' GROUP BY ALL), p AS (SELECT lemma, max_by(pos1, (n, pos1)) AS pos FROM (SELECT lemma_key AS lemma, pos1, count(*) AS n FROM st WHERE lemma_key <> '' AND orthbase <> '' GROUP BY ALL) GROUP BY lemma) SELECT lemma, count(*) FILTER (WHERE n >= 2) AS types, CAST(sum(n) AS BIGINT) AS total, first(orthbase ORDER BY n DESC, orthbase) AS main, round(1 - max(n) / sum(n), 6) AS minor_share, any_value(pos) AS pos FROM c JOIN p USING (lemma) GROUP BY lemma HAVING count(*) FILTER (WHERE n >= 2) >= 2 AND sum(n) >= 5 ORDER BY types DESC, minor_share DESC, total DESC, lemma LIMIT 30",
    "kwic_totals": _S + f"SELECT count(*) AS hits, count(DISTINCT work_stem) AS works FROM st WHERE lemma_key = '{NODE}'",
    "kwic_by_work": with_(ST, _NODE) + "SELECT z.work_stem, coalesce(h, 0) AS hits, z.tokens, round(coalesce(h, 0) / z.tokens * 1e4, 4) AS per_10k FROM (SELECT work_stem, count(*) AS tokens FROM st GROUP BY ALL) z LEFT JOIN (SELECT work_stem, count(*) AS h FROM nd GROUP BY ALL) USING (work_stem)",
    "kwic_by_band": with_(ST, _NODE, ATT) + ", z AS (SELECT period AS band, count(*) AS tokens FROM st LEFT JOIN att USING (work_stem) GROUP BY period), h AS (SELECT period AS band, count(*) AS h FROM nd LEFT JOIN att USING (work_stem) GROUP BY period) SELECT z.band, coalesce(h, 0) AS hits, z.tokens, round(coalesce(h, 0) / z.tokens * 1e4, 4) AS per_10k FROM z LEFT JOIN h ON z.band IS NOT DISTINCT FROM h.band",
    "kwic_facets": with_(ST, ATT) + f"SELECT a.work_stem, count(*) AS hits FROM st a JOIN st b ON b.work_stem = a.work_stem AND b.vol_no = a.vol_no AND b.sent = a.sent AND b.i = a.i + 1 WHERE a.pos1 LIKE '動詞%' AND a.work_stem IN (SELECT work_stem FROM att WHERE genre_main = 'fiction' AND author_sex = 'f') GROUP BY ALL",
    "kwic_types": _S + f"SELECT a.lemma_key || ' ' || b.lemma_key AS form, count(*) AS n FROM st a JOIN st b ON b.work_stem = a.work_stem AND b.vol_no = a.vol_no AND b.sent = a.sent AND b.i = a.i + 1 WHERE a.pos1 LIKE '名詞%' AND b.lemma_key = 'の' GROUP BY 1 ORDER BY n DESC, form LIMIT 50",
    "kwic_sorted_left1": _L + f"SELECT work_stem, vol_no, i, CASE WHEN i_m1 = i - 1 THEN surface_m1 END AS left1 FROM ld WHERE lemma_key = '{NODE}'",
    "kwic_page": _L + f"SELECT work_stem, vol_no, i, CASE WHEN i_1 = i + 1 THEN surface_1 END AS right1 FROM ld WHERE lemma_key = '{NODE}' ORDER BY right1 NULLS FIRST, work_stem, vol_no, i LIMIT 20 OFFSET 10",
    "kwic_sorted_year": with_(ST, _NODE, ATT) + "SELECT work_stem, vol_no, i, coalesce(year, 9999) AS year, author FROM nd LEFT JOIN att USING (work_stem)",
    "kwic_rows": with_(ST, _NODE) + "SELECT nd.work_stem, nd.vol_no, nd.i, coalesce(string_agg(CASE WHEN x.i < nd.i THEN x.surface END, ' ' ORDER BY x.i), '') AS left, string_agg(CASE WHEN x.i = nd.i THEN x.surface END, ' ' ORDER BY x.i) AS key, coalesce(string_agg(CASE WHEN x.i > nd.i THEN x.surface END, ' ' ORDER BY x.i), '') AS right, count(*) FILTER (WHERE x.sent = nd.sent) AS same_sent FROM nd JOIN st x ON x.work_stem = nd.work_stem AND x.vol_no = nd.vol_no AND x.i BETWEEN nd.i - 5 AND nd.i + 5 GROUP BY nd.work_stem, nd.vol_no, nd.i",
    "kwic_passage": _S + ", v AS (SELECT * FROM st WHERE work_stem = '099001_040404' AND vol_no = 1), e AS (SELECT min(sent) AS a, max(sent) AS b FROM v WHERE i BETWEEN 70 AND 130) SELECT work_stem, vol_no, sent, string_agg(surface, '' ORDER BY i) AS text FROM v, e WHERE sent BETWEEN a AND b GROUP BY ALL",
    "kwic_text": '''WITH p AS (SELECT doc_id, text AS t, string_split(text, '灯台坂') AS ps FROM documents WHERE contains(text, '灯台坂')), e AS (SELECT doc_id, t, unnest(range(1, len(ps))) AS k, ps FROM p), q AS (SELECT doc_id, t, CAST(list_sum(list_transform(ps[1:k], lambda x: length(x))) AS BIGINT) + (k - 1) * 3 + 1 AS pos FROM e) SELECT doc_id, CAST(pos AS BIGINT) AS "at", substring(t, greatest(1, pos - 28), pos - greatest(1, pos - 28)) AS "left", substring(t, pos + 3, 28) AS "right" FROM q''',
    "colloc_measures": _colloc(f"lemma_key = '{NODE}'", 2, ""),
    "colloc_pos": _colloc("pos1 LIKE '動詞%'", 5, "WHERE pos1 IN ('名詞')"),
    "colloc_focus": with_(ST, _TN, _OFF) + "SELECT h.work_stem, h.vol_no, h.sent, h.i, any_value(h.lemma_key) AS form, count(*) AS marks FROM st h CROSS JOIN of JOIN tn ON tn.work_stem = h.work_stem AND tn.vol_no = h.vol_no AND tn.sent = h.sent AND tn.i = h.i + o WHERE h.pos1 LIKE '動詞%' AND tn.form = 'の' GROUP BY h.work_stem, h.vol_no, h.sent, h.i",
    "variants_by_band": with_(ST, ATT) + ", h AS (SELECT work_stem, coalesce(orthbase, '') AS sp FROM st WHERE pos1 LIKE '名詞%'), b AS (SELECT sp FROM h GROUP BY sp ORDER BY count(*) DESC, sp LIMIT 12) SELECT period AS band, CASE WHEN sp IN (SELECT sp FROM b) THEN sp ELSE '(other)' END AS spelling, count(*) AS n FROM h LEFT JOIN att USING (work_stem) GROUP BY 1, 2",
    "variant_table": _S + ", c AS (SELECT lemma_key AS lemma, orthbase, count(*) AS n FROM st WHERE lemma_key <> '' AND orthbase <> '' GROUP BY ALL) SELECT lemma, count(*) AS types, CAST(sum(n) AS BIGINT) AS total, first(orthbase ORDER BY n DESC, orthbase) AS main, round(1 - max(n) / sum(n), 6) AS minor_share, string_agg(orthbase, '|' ORDER BY n DESC, orthbase) AS spellings FROM c GROUP BY lemma HAVING count(*) >= 2 AND sum(n) >= 3",
    "pos_tree": _S + f"SELECT pos1, pos2, count(*) AS n FROM (SELECT pos1, coalesce(pos2, '') AS pos2 FROM st WHERE NOT {PUNCT}) GROUP BY ROLLUP (pos1, pos2) HAVING grouping(pos1) = 0",
    "facet_counts": with_(ST, ATT) + ", w AS (SELECT * FROM (SELECT DISTINCT work_stem FROM st) LEFT JOIN att USING (work_stem)) SELECT 'author' AS facet, author AS value, count(*) AS works FROM w GROUP BY author UNION ALL SELECT 'period', period, count(*) FROM w GROUP BY period UNION ALL SELECT 'genre_main', genre_main, count(*) FROM w GROUP BY genre_main UNION ALL SELECT 'author_sex', author_sex, count(*) FROM w GROUP BY author_sex",
}
