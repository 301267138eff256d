"""Queries over titles, classifications, spellings, notes and the structure of texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fumikura.functions import keys, marks, structure, text, udfs
from fumikura.operators import resolve
from fumikura.operators import tokens as tk
from fumikura.queries.base import PUNCT, ST, TOK, UNKNOWN, sql_category, sql_narrow, sql_strip, tok, with_
from fumikura.sources.corpus import table


def _meta(s, d, *cols):
    return table(s, d, "corpus_metadata_v2").where("id is not null").select("id", *cols).distinct()


def _docs(s, d):
    return table(s, d, "documents").where("doc_id is not null and text is not null")


def title_keys(s, d):
    return _meta(s, d, "author_ja", "title_aozora").select("id", text.author_key(F.col("author_ja")).alias("author_key"), text.title_key(F.col("title_aozora")).alias("title_key"), text.base_title(F.col("title_aozora")).alias("base_title")).distinct()


def year_ranges(s, d):
    lo, hi = text.years(keys.narrow(F.col("period")))
    return _meta(s, d, "period").select("id", lo.alias("first"), hi.alias("last")).distinct()


def ndc_genres(s, d):
    return _meta(s, d, "ndc").select("id", text.ndc_primary(F.col("ndc")).alias("ndc"), text.genre_of_ndc(F.col("ndc")).alias("genre")).distinct()


def year_bands(s, d):
    y = F.expr("try_cast(year_first as int)")
    return _meta(s, d, "year_first").select("id", y.alias("year"), text.period_of_year(y).alias("period6"), text.period5(text.period_of_year(y)).alias("period5"), text.year_band(y).alias("band")).distinct()


def style_classes(s, d):
    b, k = F.expr("try_cast(bungo_per10k as double)"), F.expr("try_cast(kogo_per10k as double)")
    return _meta(s, d, "bungo_per10k", "kogo_per10k").select("id", b.alias("bungo"), k.alias("kogo"), text.style_class(b, k).alias("style")).distinct()


def style_confusion(s, d):
    m = style_classes(s, d).join(_meta(s, d, "style_class").select("id", F.substring(keys.strip(keys.narrow(F.col("style_class"))), 1, 1).alias("stated")).distinct(), "id")
    return m.groupBy("stated", "style").agg(F.count("*").alias("works"))


def work_labels(s, d):
    m = _meta(s, d, "author_ja", "title_aozora", "year_first")
    label = lambda *y: text.work_label(F.col("author_ja"), F.col("title_aozora"), *y)
    return m.select("id", label().alias("label"), label(F.col("year_first")).alias("dated")).distinct()


def first_media(s, d):
    """The statement on the first publication, as stored and as a source line made of what is known."""
    m = _meta(s, d, "first_medium", "title_aozora", "year_first").withColumn("n", F.conv(F.substring(F.md5("id"), 1, 2), 16, 10).cast("int") % 6)
    line = F.element_at(F.array(*(F.concat(*parts) for parts in (
        (F.lit("「"), "title_aozora", F.lit("」 "), "year_first"), ("title_aozora", F.lit("書院、"), "year_first"), (F.lit("東京日日、"), "year_first"), (F.lit("第三巻第二号 "), "year_first"), (F.col("title_aozora"), F.lit(" 1910年6月14日")), (F.lit("不詳"),),
    ))), (F.col("n") + 1).cast("int"))
    return m.select("id", F.col("first_medium").alias("stated"), text.first_medium(F.col("first_medium")).alias("of_stated"), text.first_medium(line).alias("of_line")).distinct()


def display_forms(s, d):
    f = tok(s, d, "lemma").where("lemma <> ''").select("lemma").distinct()
    return f.select("lemma", text.display_form(F.col("lemma")).alias("shown"))


def token_guard(s, d):
    """Texts that blanks cut into tokens of more than eight characters on average: they aren't tokenised."""
    n = text.token_length(F.col("text"))
    return _docs(s, d).select("doc_id", F.round(n, 4).alias("mean_length"), F.coalesce(n > text.LONGEST_MEAN, F.lit(False)).alias("refused"))


def note_classes(s, d):
    n = _docs(s, d).select(F.explode(F.regexp_extract_all("text", F.lit("［＃([^］]*)］"), 1)).alias("note"))
    return n.groupBy(text.note_kind(F.col("note")).alias("kind")).agg(F.count("*").alias("notes"), F.count_distinct("note").alias("forms"))


def glosses(s, d):
    g = _docs(s, d).select("doc_id", F.regexp_extract_all("text", F.lit("《([^》]*)》"), 1).alias("g"), F.length(text.strip_gloss(F.col("text"))).alias("chars_left")).where(F.size("g") > 0)
    return g.select("doc_id", F.size("g").alias("glosses"), "chars_left")


def char_profile(s, d):
    r = tk.char_ratios(F.col("text"))
    return _docs(s, d).select("doc_id", *(c.alias(n) for n, c in r.items()))


def sentence_profile(s, d):
    p = F.filter(F.split("text", "[。！？]"), lambda x: F.trim(x) != "")
    words = {"i_per_10k": "私", "self_per_10k": "自分"}
    return _docs(s, d).select("doc_id", F.size(p).alias("sentences"), F.round(F.aggregate(p, F.lit(0), lambda a, x: a + F.length(x)) / F.nullif(F.size(p), F.lit(0)), 4).alias("mean_chars"), *(F.round(text.per_10k(F.col("text"), w), 4).alias(n) for n, w in words.items()))


def tidy_lengths(s, d):
    return _docs(s, d).select("doc_id", F.length(text.fold_width(F.col("text"))).alias("folded"), F.length(text.tidy(F.col("text"))).alias("tidied"))


def paragraph_rows(s, d):
    p = _docs(s, d).select("doc_id", F.posexplode(F.split(F.regexp_replace("text", "\\r", ""), "\\n+")).alias("par", "t"))
    return p.where("t <> ''").select("doc_id", "par", F.length("t").alias("chars"), F.startswith(F.col("t"), F.lit("「")).alias("speech"))


def speech_marks(s, d):
    c = lambda x: F.length("text") - F.length(F.replace("text", F.lit(x), F.lit("")))
    t = _docs(s, d).select("doc_id", c("「").alias("o"), c("」").alias("z"), c("『").alias("oo"), c("』").alias("zz"), F.length("text").alias("chars"))
    said, unclosed = F.least("o", "z"), F.greatest(F.col("o") - F.col("z"), F.lit(0))
    first = F.when((F.least("oo", "zz") >= 20) & (F.least("oo", "zz") > said * 1.5), "『』").otherwise("「」")
    return t.select("doc_id", said.alias("said"), unclosed.alias("unclosed"), first.alias("first_level"), text.speech_grade(said, unclosed, F.col("chars")).alias("grade"))


def speech_share(s, d):
    t = _docs(s, d).select("source", F.length("text").alias("n"), F.aggregate(F.regexp_extract_all("text", F.lit("「[^「」]*」"), 0), F.lit(0), lambda a, x: a + F.length(x)).alias("q"))
    return t.groupBy("source").agg(F.sum("n").alias("chars"), F.sum("q").alias("speech_chars"), F.round(F.sum("q") / F.nullif(F.sum("n"), F.lit(0)), 6).alias("speech_ratio"))


def stream_sizes(s, d):
    return table(s, d, "documents").groupBy("stream").agg(F.count("*").alias("docs"), F.count("text").alias("texts"), F.sum(F.length("text")).alias("chars"))


def colophons(s, d):
    h = text.colophon_hits(F.col("text"))
    return _docs(s, d).select("doc_id", h.alias("hits"), F.size(text.body_lines(F.col("text"))).alias("body_lines"), F.size(F.split("text", "\n")).alias("lines"))


def _unknown(s, d):
    return tok(s, d, "surface", "lemma", "pos1", "pos2").where(tk.is_unknown())


def unknown_classes(s, d):
    w = _unknown(s, d).groupBy("surface").agg(F.count("*").alias("n"))
    g = w.groupBy(text.unknown_class(F.col("surface")).alias("class")).agg(F.count("*").alias("types"), F.sum("n").alias("tokens"), F.array_join(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "surface"))).getField("surface"), 1, 3), "|").alias("examples"))
    total = F.sum("tokens").over(Window.partitionBy())  # one row a class
    return g.select("*", F.round(F.col("tokens") / total * 100, 2).alias("pct"))


def unknown_pos(s, d):
    w = _unknown(s, d).groupBy("surface", F.concat_ws("-", tk.nonempty("pos1"), tk.nonempty("pos2")).alias("pos")).agg(F.count("*").alias("n"))
    return w.groupBy("surface").agg(F.sum("n").alias("tokens"), F.max(F.struct("n", "pos")).alias("m")).select("surface", "tokens", F.col("m.pos").alias("pos"))


def _kata(s, d):
    """Katakana words of tokens and of texts, where old spellings stand beside new ones."""
    t = tok(s, d, "surface").select("surface")
    x = _docs(s, d).select(F.explode(F.regexp_extract_all("text", F.lit("([ァ-ヺー]{2,})"), 1)).alias("surface"))
    return t.where(F.col("surface").rlike("^[ァ-ヺー]{2,}$")).union(x).groupBy("surface").agg(F.count("*").alias("n"))


def _groups(w, loose):
    g = w.groupBy(text.katakana_key(F.col("surface"), loose).alias("key")).agg(F.count("*").alias("forms"), F.sum("n").alias("total"), F.array_join(F.array_sort(F.collect_list("surface")), "|").alias("spellings"))
    return g.where("forms > 1").withColumn("loose", F.lit(loose))


def katakana_groups(s, d):
    """Words of the corpus, and each once more as it would be written with full-size letters only."""
    w = _kata(s, d)
    w = w.union(w.select(F.translate("surface", "ャュョッ", "ヤユヨツ"), "n")).groupBy("surface").agg(F.sum("n").alias("n"))
    return _groups(w, False).union(_groups(w, True))


def katakana_keys(s, d):
    """Keys of made spellings, one for each rule, beside those of the corpus."""
    made = s.createDataFrame([(x,) for x in "ストツキング ストッキング ヰスキー ウイスキー ラムプ ランプ サアベル サーベル ヴァイオリン バイオリン ヲルガン シムポジウム ムード アムール ヱプロン クヮルテット".split()], "surface string")
    w = _kata(s, d).select("surface").union(made).distinct()
    return w.select("surface", text.katakana_key(F.col("surface")).alias("key"), text.katakana_key(F.col("surface"), True).alias("loose"))


def _cut(s, d):
    """Tokens as a dictionary would cut them that knows only the first two letters of long katakana words."""
    t = tok(s, d, "surface", "lemma", "pos1", sentences=True)
    long = F.col("surface").rlike("^[\\u30a1-\\u30faー]{4,}$") & (F.coalesce("lemma", F.lit("")) != "")
    parts = F.when(long, F.array(F.substring("surface", 1, 2), F.regexp_replace("surface", "^..", ""))).otherwise(F.array("surface"))
    e = t.select("work_stem", "vol_no", "sent", "lemma", "pos1", "i", F.posexplode(parts).alias("p", "surface"))
    return e.withColumn("i", F.col("i") * 2 - 1 + F.col("p")).drop("p")


def forced_splits(s, d):
    return tk.katakana_runs(_cut(s, d)).groupBy("run").agg(F.count("*").alias("times"), F.first("parts").alias("parts"))


def key_variant_join(s, d):
    f = tok(s, d, "surface").groupBy("work_stem").agg(F.count("*").alias("tokens"))
    return resolve.join_metadata(f, table(s, d, "corpus_metadata_v2")).select("work_stem", "tokens", "meta_id")


def unmatched_report(s, d):
    return resolve.unmatched(key_variant_join(s, d))


def resolve_rank(s, d):
    m = _meta(s, d, "author_ja", "title_aozora").select("id", F.col("author_ja").alias("author"), F.col("title_aozora").alias("title"))
    c = table(s, d, "chunks_index").where("title is not null").select("work_stem", "author_ja", "title").distinct()
    c = c.groupBy("work_stem").agg(F.min("author_ja").alias("author"), F.min("title").alias("title")).withColumnRenamed("work_stem", "wid")
    return resolve.match_titles(c, m.groupBy("id").agg(F.min("author").alias("author"), F.min("title").alias("title")))


def match_misses(s, d):
    """Every title with a word added: none is found, each gets its diagnosis."""
    m = table(s, d, "corpus_metadata_v2").where("id is not null").groupBy("id").agg(F.min("author_ja").alias("author"), F.min("title_aozora").alias("title"))
    c = m.select(F.col("id").alias("wid"), "author", F.concat(F.col("title"), F.lit("補遺")).alias("title"))
    return resolve.diagnose_misses(c, m)


def merged_volumes(s, d):
    parts = _docs(s, d).where("work_stem is not null").select(F.col("doc_id").alias("member"), F.col("text"))
    m = _docs(s, d).where("work_stem is not null").select(F.col("work_stem").alias("canonical"), F.col("doc_id").alias("ord"), F.col("doc_id").alias("member"))
    return resolve.merge_volumes(parts, m).select("canonical", F.length("text").alias("chars"), F.size("members").alias("members"))


def filled_blanks(s, d):
    a = table(s, d, "chunks_index").groupBy("work_stem").agg(F.min("period5").alias("period5"), F.min("genre_main").alias("genre_main"))
    b = table(s, d, "corpus_metadata_v2").select(keys.work_stem(F.col("aozora_person_id"), F.col("aozora_work_id")).alias("work_stem"), keys.category(F.col("genre_main")).alias("genre_main"), "kana_orthography").groupBy("work_stem").agg(F.min("genre_main").alias("genre_main"), F.min("kana_orthography").alias("kana_orthography"))
    return resolve.fill_blanks(a, b, "work_stem", ["genre_main", "kana_orthography"])


def iteration_marks(s, d):
    """Only texts that have a mark go through Python."""
    t, has = _docs(s, d).select("doc_id", "text"), F.col("text").rlike("[ゝゞヽヾ〳〴]|／[＼″]")
    out = t.where(has).withColumn("t", marks.iteration_marks("text")).union(t.where(~has).withColumn("t", F.col("text")))
    return out.select("doc_id", (F.col("t") != F.col("text")).alias("changed"), F.length("t").alias("chars"))


def quote_scan(s, d):
    t = _docs(s, d).select("doc_id", F.explode(marks.spans_of(F.col("text"))).alias("x"))
    return t.groupBy("x.kind").agg(F.count("*").alias("spans"), F.count_distinct("doc_id").alias("docs"))


def html_text(s, d):
    """Every document as a page, with whatever markup and entities are left in it."""
    return _docs(s, d).select("doc_id", F.length(marks.html_text("text")).alias("chars"))


def _pages(s, d):
    """Every document as a page: lines with breaks, notes as spans, glosses as ruby, a division too many closed."""
    t = F.translate(F.col("text"), "<>&", "")
    t = F.regexp_replace(F.regexp_replace(t, "([一-鿿々]+)《([^《》\\n]*)》", "<ruby>$1<rt>$2</rt></ruby>"), "(［＃[^］\\n]*］)", '<span class="notes">$1</span>')
    page = F.concat(F.lit('<html><body><div class="header">x</div><div class="main_text">'), F.regexp_replace(t, "\\n", "<br />\n"), F.lit('<div>y</div></div>z</div><div class="bibliographical_information">底本：w</div></body></html>'))
    return _docs(s, d).select("doc_id", "text", page.alias("page"))


def page_fragments(s, d):
    f = _pages(s, d).select("doc_id", structure.surplus_of("page").alias("surplus"), structure.fragments_of("page").alias("f"))
    n = lambda k: F.size(F.filter("f", lambda x: x["kind"] == k)).alias(k)
    return f.select("doc_id", "surplus", n("ruby"), n("note"))


def text_streams(s, d):
    """Characters of each stream; narration and speech are the whole text less its notes, but for the marks' lines."""
    t = structure.streams(_docs(s, d))
    p = t.withColumn("text", F.regexp_replace("text", "\\n", "")).groupBy("doc_id").pivot("stream", list(structure.STREAMS)).agg(F.sum(F.length("text")))
    return p.select("doc_id", "full", (F.col("narration") + F.col("speech")).alias("told_and_said"), (F.col("speech") <= F.col("full")).alias("speech_within"), (F.col("embedded") <= F.col("full")).alias("embedded_within"))


def framed_texts(s, d):
    """Documents with a letter of ten paragraphs put in: what is inserted is set against the frame."""
    letter = "\n".join(f"「私は{k}度、書いた。自分でも読んだ。" for k in range(10)) + "」"
    t = _docs(s, d).where("text not like '%「%' and text not like '%」%' and text not like '%見出し%'").select("doc_id", F.concat("text", F.lit("\n" + letter)).alias("text"))
    return structure.framing(structure.streams(t, narration_without_inserted=True), least=100)


def quote_parts(s, d):
    r = _docs(s, d).select("doc_id", F.explode(structure.rendered_of("text")).alias("x"))
    return r.groupBy("x.kind", "x.part").agg(F.count("*").alias("parts"), F.count_distinct("doc_id").alias("docs"))


def quote_events(s, d):
    e = _docs(s, d).select("doc_id", F.explode(structure.scan_events(F.split("text", "\n"))).alias("x"))
    return e.groupBy("x.kind").agg(F.count("*").alias("events"), F.count_distinct("doc_id").alias("docs"))


def quote_patterns(s, d):
    e = _docs(s, d).select(F.explode(F.split("text", "\n")).alias("line"))
    return e.agg(*(F.count_if(c).alias(k) for k, c in structure.approximate(F.col("line")).items()))


def glyph_definitions(s, d):
    rows = [("a", "standard", "㋤"), ("a", "PUA", "U+E001"), ("b", "pua", "U+E002"), ("c", "standard", " "), ("d", "PUA", "x"), ("", "standard", "y"), ("e", "Standard", "〼")]
    return structure.glyph_map(s.createDataFrame(rows, "glyph_id string, type string, value string"))


@F.pandas_udf(T.BinaryType())
def _encoded(text: pd.Series, way: pd.Series) -> pd.Series:
    def one(t, k):
        name, codec = (("utf-8", "utf-8"), ("Shift_JIS", "cp932"), ("euc-jp", "euc_jp"))[k]
        try:
            return f"<!--{'x' * 3000}--><meta charset='{name}'>{t}".encode(codec)
        except UnicodeEncodeError:
            return f"<meta charset=utf-8>{t}".encode()

    return pd.Series([one(t, k) for t, k in zip(text, way)])


def decoded_pages(s, d):
    """Every document in one of three encodings, declared as late as it may be, comes back as it was."""
    t = _docs(s, d).where("text not like '%\\\\%' and text not like '%~%'")
    t = t.select("doc_id", "text", marks.decode_page(_encoded("text", F.pmod("doc_id", F.lit(3)).cast("int"))).alias("x"))
    return t.select("doc_id", F.endswith(F.col("x"), F.col("text")).alias("same"))


def ngram_counts(s, d):
    """The two functions called from SQL: pairs of words of all documents, the fifty most frequent."""
    udfs.register(s)
    _docs(s, d).select("doc_id", "text").createOrReplaceTempView("_texts")
    return s.sql("SELECT g.ngram, count(*) AS n FROM (SELECT tokenize(text) AS w FROM _texts) t, LATERAL ngrams(t.w, 2) g GROUP BY g.ngram ORDER BY n DESC, g.ngram LIMIT 50")


QUERIES = {f.__name__: f for f in (ngram_counts, page_fragments, text_streams, framed_texts, quote_parts, quote_events, quote_patterns, glyph_definitions, first_media, display_forms, token_guard, katakana_keys, title_keys, year_ranges, ndc_genres, year_bands, style_classes, style_confusion, work_labels, note_classes, glosses, char_profile, sentence_profile, tidy_lengths, paragraph_rows, speech_marks, speech_share, stream_sizes, colophons, unknown_classes, unknown_pos, katakana_groups, forced_splits, key_variant_join, unmatched_report, resolve_rank, match_misses, merged_volumes, filled_blanks, iteration_marks, quote_scan, html_text, decoded_pages)}

_DOC = "dc AS (SELECT * FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)"
_AK = lambda c: f"regexp_replace({c}, '[\\s\\x{{3000}}・･]', '', 'g')"
_TK = lambda c: f"regexp_replace(regexp_replace({c}, '[\\s\\x{{3000}}「」『』（）()［］\\[\\]〔〕【】、。，．・！？!?,.:：;；―—－ー〜~-]', '', 'g'), '^[0-9０-９]+', '')"
_BT = lambda c: _TK(f"regexp_replace(trim(regexp_replace({c}, '[（(].*$', ''), ' '), '[上中下前後]?巻?$', '')")
_CNT = lambda x: f"(length(text) - length(replace(text, '{x}', '')))"
_WH = "[\\s\\x1c-\\x1f\\x{0085}\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_BODY = f"regexp_replace(text, '{_WH}', '', 'g')"
_CC = lambda p, x=_BODY: f"CAST(length(regexp_replace({x}, '{p}', '', 'g')) AS INTEGER)"
_UW = f"uw AS (SELECT surface, pos1, pos2, count(*) AS n FROM tok WHERE {UNKNOWN} GROUP BY ALL)"
_VERB = "(たり|けり|なり|べし|ざる|らむ|けむ|つれ|ける|ぬる|たる|し)$"
_COLOPHON = "底本： 底本: 入力： 入力: 校正： 校正: 青空文庫作成ファイル このファイルは、インターネットの図書館、青空文庫".split()
_COLO = " + ".join(f"(CASE WHEN contains(flat, '{m}') THEN 1 ELSE 0 END)" for m in _COLOPHON)
_KK = "replace(regexp_replace(regexp_replace(regexp_replace(" + "translate(replace(replace(replace(replace(replace(replace(replace(replace(surface, 'ヰ', 'ウイ'), 'ヱ', 'ウエ'), 'ヲ', 'ウオ'), 'ヴ', 'ブ'), 'ヷ', 'バ'), 'ヸ', 'ビ'), 'ヹ', 'ベ'), 'ヺ', 'ボ'), 'ァィゥェォッャュョヮ', 'アイウエオツヤユヨワ')" + ", 'ム([パピプペポ])', 'ン\\1', 'g'), 'ム([バビブベボ])', 'ン\\1', 'g'), 'ム([パピプペポバビブベボ])', 'ン\\1', 'g'), 'ー', '')"
_LOOSE = "key[1:1] || regexp_replace(key[2:], '[アイウエオ]', '', 'g')"
_KW = "w AS (SELECT surface, count(*) AS n FROM (SELECT surface FROM tok WHERE regexp_matches(surface, '^[ァ-ヺー]{2,}$') UNION ALL SELECT unnest(regexp_extract_all(text, '[ァ-ヺー]{2,}')) FROM documents WHERE doc_id IS NOT NULL) GROUP BY surface)"
_STEM = f"lpad({sql_strip(sql_narrow('aozora_person_id'))}, 6, '0') || '_' || lpad({sql_strip(sql_narrow('aozora_work_id'))}, 6, '0')"
_MK = f"mk AS (SELECT id, {sql_strip(sql_narrow('aozora_person_id'))} AS p, {sql_strip(sql_narrow('aozora_work_id'))} AS w, loaded_at FROM corpus_metadata_v2 WHERE aozora_person_id IS NOT NULL AND aozora_work_id IS NOT NULL), kv AS (SELECT DISTINCT unnest([lpad(p, 6, '0') || '_' || lpad(w, 6, '0'), p || '_' || w, regexp_replace(p, '^0+([0-9])', '\\1') || '_' || regexp_replace(w, '^0+([0-9])', '\\1')]) AS k, id, loaded_at FROM mk), kf AS (SELECT k, min_by(id, (loaded_at, id)) AS meta_id FROM kv GROUP BY k), ft AS (SELECT work_stem, count(*) AS tokens FROM tok GROUP BY ALL), jm AS (SELECT work_stem, tokens, meta_id FROM ft LEFT JOIN kf ON k = work_stem)"

SQL = {
    "title_keys": f"SELECT DISTINCT id, {_AK('author_ja')} AS author_key, {_TK('title_aozora')} AS title_key, {_BT('title_aozora')} AS base_title FROM corpus_metadata_v2 WHERE id IS NOT NULL",
    "year_ranges": f"SELECT DISTINCT id, list_min(y) AS first, list_max(y) AS last FROM (SELECT id, list_transform(regexp_extract_all({sql_narrow('period')}, '((?:1[6-9]|20)[0-9]{{2}})'), lambda x: CAST(x AS INTEGER)) AS y FROM corpus_metadata_v2 WHERE id IS NOT NULL)",
    "ndc_genres": "WITH n AS (SELECT id, list_filter(regexp_split_to_array(regexp_replace(trim(ndc), '(?i)^\\s*NDC\\s*', ''), '[\\s,、/]+'), lambda x: x <> '')[1] AS ndc FROM corpus_metadata_v2 WHERE id IS NOT NULL) SELECT DISTINCT id, ndc, CASE WHEN ndc IS NULL OR regexp_replace(ndc, '^K+', '') = '' THEN NULL WHEN regexp_matches(regexp_replace(ndc, '^K+', ''), '^(9[0-9]3|912)') THEN 'Fiction' ELSE 'Nonfiction' END AS genre FROM n",
    "year_bands": "WITH y AS (SELECT DISTINCT id, try_cast(year_first AS INTEGER) AS year FROM corpus_metadata_v2 WHERE id IS NOT NULL), p AS (SELECT *, CASE WHEN year IS NULL THEN NULL WHEN year < 1887 THEN 1 WHEN year < 1900 THEN 2 WHEN year < 1912 THEN 3 WHEN year < 1926 THEN 4 WHEN year < 1945 THEN 5 ELSE 6 END AS period6 FROM y) SELECT id, year, period6, CASE WHEN period6 IS NULL THEN NULL WHEN period6 <= 2 THEN 1 ELSE period6 - 1 END AS period5, CASE WHEN year IS NULL THEN -1 WHEN year < 1900 THEN 0 WHEN year < 1912 THEN 1 WHEN year < 1926 THEN 2 WHEN year < 1945 THEN 3 ELSE 4 END AS band FROM p",
    "note_classes": with_(_DOC) + ", n AS (SELECT unnest(regexp_extract_all(text, '［＃([^］]*)］', 1)) AS note FROM dc) SELECT CASE " + " ".join(f"WHEN contains(note, '{w}') THEN '{k}'" for k, ws in (("textual", "ママ 底本 誤植"), ("layout", "見出し 改ページ 改丁 字下げ 傍点 太字 横組 罫囲み ページ"), ("figure", "図 挿絵 写真")) for w in ws.split()) + " WHEN contains(note, '水準') OR contains(note, 'U+') OR contains(lower(note), 'unicode') THEN 'gaiji' ELSE 'editorial' END AS kind, count(*) AS notes, count(DISTINCT note) AS forms FROM n GROUP BY 1",
    "glosses": with_(_DOC) + "SELECT doc_id, CAST(len(regexp_extract_all(text, '《[^》]*》')) AS INTEGER) AS glosses, CAST(length(regexp_replace(regexp_replace(text, '《[^》]*》', '', 'g'), '［＃[^］]*］', '', 'g')) AS INTEGER) AS chars_left FROM dc WHERE len(regexp_extract_all(text, '《[^》]*》')) > 0",
    "char_profile": with_(_DOC) + f"SELECT doc_id, CAST(length({_BODY}) AS INTEGER) AS chars, round({_CC('[^一-鿿㐀-䶿]')} / greatest(length({_BODY}), 1), 4) AS kanji_ratio, round({_CC('[^゠-ヿ]')} / greatest(length({_BODY}), 1), 4) AS katakana_ratio, {_CC('[^A-Za-zＡ-Ｚａ-ｚ]', 'text')} AS latin_chars, {_CC('[^0-9０-９]', 'text')} AS digits, {_CC('[^ゝゞヽヾ]', 'text')} AS kana_repeat, {_CC('[^々]', 'text')} AS kanji_repeat, {_CC('[^※]', 'text')} AS gaiji_lost, {_CC('[^〃]', 'text')} AS ditto_mark FROM dc",
    "sentence_profile": with_(_DOC) + ", s AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[。！？]'), lambda x: trim(x, ' ') <> '') AS p FROM dc) SELECT doc_id, CAST(len(p) AS INTEGER) AS sentences, round(list_sum(list_transform(p, lambda x: length(x))) / nullif(len(p), 0), 4) AS mean_chars, round((length(text) - length(replace(text, '私', ''))) / greatest(length(text), 1) * 10000, 4) AS i_per_10k, round((length(text) - length(replace(text, '自分', ''))) / 2 / greatest(length(text), 1) * 10000, 4) AS self_per_10k FROM s",
    "speech_marks": with_(_DOC) + f", m AS (SELECT doc_id, {_CNT('「')} AS o, {_CNT('」')} AS z, least({_CNT('『')}, {_CNT('』')}) AS f2, length(text) AS n FROM dc), g AS (SELECT doc_id, least(o, z) AS said, greatest(o - z, 0) AS unclosed, f2, n FROM m) SELECT doc_id, CAST(said AS INTEGER) AS said, CAST(unclosed AS INTEGER) AS unclosed, CASE WHEN f2 >= 20 AND f2 > said * 1.5e0 THEN '『』' ELSE '「」' END AS first_level, CASE WHEN said = 0 THEN 'none' WHEN coalesce(unclosed / nullif(said + unclosed, 0), 0) >= 0.2e0 OR coalesce(said / nullif(n, 0) * 10000, 0) < 1.5e0 THEN 'partial' ELSE 'full' END AS grade FROM g",
    "speech_share": with_(_DOC) + ", q AS (SELECT source, length(text) AS n, coalesce(list_sum(list_transform(regexp_extract_all(text, '「[^「」]*」'), lambda x: length(x))), 0) AS q FROM dc) SELECT source, CAST(sum(n) AS BIGINT) AS chars, CAST(sum(q) AS BIGINT) AS speech_chars, round(sum(q) / nullif(sum(n), 0), 6) AS speech_ratio FROM q GROUP BY source",
    "stream_sizes": "SELECT stream, count(*) AS docs, count(text) AS texts, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY stream",
    "paragraph_rows": with_(_DOC) + ", p AS (SELECT doc_id, regexp_split_to_array(replace(text, chr(13), ''), '\\n+') AS ps FROM dc), e AS (SELECT doc_id, unnest(ps) AS t, generate_subscripts(ps, 1) - 1 AS par FROM p) SELECT doc_id, CAST(par AS INTEGER) AS par, CAST(length(t) AS INTEGER) AS chars, starts_with(t, '「') AS speech FROM e WHERE t <> ''",
    "work_labels": "WITH l AS (SELECT DISTINCT id, coalesce(author_ja, '?') || '『' || substring(coalesce(title_aozora, ''), 1, 12) || '』' AS label, year_first FROM corpus_metadata_v2 WHERE id IS NOT NULL) SELECT DISTINCT id, label, label || CASE WHEN trim(coalesce(year_first, ''), ' ') <> '' THEN '(' || year_first || ')' ELSE '' END AS dated FROM l",
    "style_classes": "WITH m AS (SELECT DISTINCT id, try_cast(bungo_per10k AS DOUBLE) AS bungo, try_cast(kogo_per10k AS DOUBLE) AS kogo FROM corpus_metadata_v2 WHERE id IS NOT NULL) SELECT id, bungo, kogo, CASE WHEN bungo IS NULL OR kogo IS NULL THEN NULL WHEN bungo >= 80 AND round(coalesce(bungo / nullif(bungo + kogo, 0), 0), 3) >= 0.2e0 THEN 'A' WHEN round(coalesce(bungo / nullif(bungo + kogo, 0), 0), 3) <= 0.1e0 THEN 'C' ELSE 'B' END AS style FROM m",
    "unknown_classes": with_(TOK, _UW) + """, w AS (SELECT surface, sum(n) AS n FROM uw GROUP BY ALL), k AS (SELECT *, CASE WHEN regexp_matches(surface, '[ゝゞヽヾ〳〵〴〵々]') THEN 'iteration mark' WHEN regexp_matches(surface, '[※〓]') THEN 'glyph mark' WHEN regexp_matches(surface, '^[ァ-ヶーヽヾ]+$') THEN 'katakana loan' WHEN regexp_matches(surface, '^[A-Za-zＡ-Ｚａ-ｚ]+$') OR regexp_matches(surface, '^[0-9０-９一二三四五六七八九十百千万億]+$') THEN 'latin or digits' WHEN regexp_matches(surface, '^[㐀-䶿一-鿿豈-\\x{faff}]+$') THEN 'kanji name' WHEN regexp_matches(surface, '^[ぁ-ゖ]+$') THEN CASE WHEN regexp_matches(surface, '(けれ|けり|ざり|ざる|べかり|べけれ|たり|なり|めり|らむ|けむ|つれ|ぬれ|しか|しき|かる|げれ)$') THEN 'literary form' ELSE 'hiragana' END WHEN regexp_matches(surface, '[ァ-ヶーヽヾ]') THEN 'katakana loan' WHEN regexp_matches(surface, '(けれ|けり|ざり|ざる|べかり|べけれ|たり|なり|めり|らむ|けむ|つれ|ぬれ|しか|しき|かる|げれ)$') THEN 'literary form' ELSE 'other' END AS class FROM w) SELECT class, count(*) AS types, CAST(sum(n) AS BIGINT) AS tokens, array_to_string(list(surface ORDER BY n DESC, surface)[1:3], '|') AS examples, round(sum(n) / sum(sum(n)) OVER () * 100, 2) AS pct FROM k GROUP BY class""",
    "unknown_pos": with_(TOK, _UW) + ", p AS (SELECT surface, concat_ws('-', nullif(nullif(pos1, ''), '*'), nullif(nullif(pos2, ''), '*')) AS pos, sum(n) AS n FROM uw GROUP BY ALL) SELECT surface, CAST(sum(n) AS BIGINT) AS tokens, max_by(pos, (n, pos)) AS pos FROM p GROUP BY surface",
    "katakana_groups": with_(TOK, _KW) + f", o AS (SELECT surface, sum(n) AS n FROM (SELECT * FROM w UNION ALL SELECT translate(surface, 'ャュョッ', 'ヤユヨツ'), n FROM w) GROUP BY surface), g AS (SELECT *, {_KK} AS key FROM o), h AS (SELECT surface, n, key, false AS loose FROM g UNION ALL SELECT surface, n, {_LOOSE}, true FROM g) SELECT key, count(*) AS forms, CAST(sum(n) AS BIGINT) AS total, string_agg(surface, '|' ORDER BY surface) AS spellings, loose FROM h GROUP BY key, loose HAVING count(*) > 1",
    "katakana_keys": with_(TOK, _KW) + f", u AS (SELECT surface FROM w UNION SELECT unnest(['ストツキング', 'ストッキング', 'ヰスキー', 'ウイスキー', 'ラムプ', 'ランプ', 'サアベル', 'サーベル', 'ヴァイオリン', 'バイオリン', 'ヲルガン', 'シムポジウム', 'ムード', 'アムール', 'ヱプロン', 'クヮルテット'])), g AS (SELECT surface, {_KK} AS key FROM u) SELECT surface, key, {_LOOSE} AS loose FROM g",
    "forced_splits": with_(ST) + f", t AS (SELECT work_stem, vol_no, sent, i, surface, regexp_matches(surface, '^[\\x{{30a1}}-\\x{{30fa}}ー]+$') AND NOT {UNKNOWN} AND NOT {PUNCT} AS k, regexp_matches(surface, '^[\\x{{30a1}}-\\x{{30fa}}ー]{{4,}}$') AND coalesce(lemma, '') <> '' AS l FROM st), e AS (SELECT work_stem, vol_no, sent, i, k, unnest(CASE WHEN l THEN [surface[1:2], surface[3:]] ELSE [surface] END) AS surface, unnest(CASE WHEN l THEN [0, 1] ELSE [0] END) AS p FROM t WHERE k), r AS (SELECT *, i * 2 - 1 + p - row_number() OVER (PARTITION BY work_stem, vol_no, sent ORDER BY i, p) AS isl FROM e), g AS (SELECT count(*) AS parts, string_agg(surface, '|' ORDER BY i, p) AS run FROM r GROUP BY work_stem, vol_no, sent, isl HAVING count(*) > 1) SELECT run, count(*) AS times, any_value(parts) AS parts FROM g GROUP BY run",
    "first_media": r"""WITH m AS (SELECT DISTINCT id, first_medium, title_aozora AS t, year_first AS y, ('0x' || substring(md5(id), 1, 2))::INTEGER % 6 AS n FROM corpus_metadata_v2 WHERE id IS NOT NULL), l AS (SELECT id, first_medium AS stated, CASE n WHEN 0 THEN '「' || t || '」 ' || y WHEN 1 THEN t || '書院、' || y WHEN 2 THEN '東京日日、' || y WHEN 3 THEN '第三巻第二号 ' || y WHEN 4 THEN t || ' 1910年6月14日' ELSE '不詳' END AS line FROM m),
k AS (SELECT id, stated, line, unnest([stated, line]) AS x, unnest([1, 2]) AS which FROM l), c AS (SELECT *, trim(coalesce(x, ''), ' ') AS z FROM k), r AS (SELECT id, stated, line, which, CASE WHEN regexp_matches(z, '新聞|日日|日々|朝日|読売|報知|時事|萬朝報|万朝報') THEN 'newspaper' WHEN regexp_matches(z, '[号號]|附録') THEN 'magazine' WHEN regexp_matches(z, '(書店|書院|書房|社|館|堂|刊)[、,]?\s*\d{4}') THEN 'book' WHEN regexp_matches(z, '^「[^」]+」\s*\d{4}') THEN 'magazine' WHEN regexp_matches(z, '\d{4}[^\d]*\d{1,2}月\d{1,2}日') THEN 'book' ELSE '' END AS m FROM c)
SELECT DISTINCT a.id, a.stated, a.m AS of_stated, b.m AS of_line FROM r a JOIN r b ON a.id = b.id AND a.stated IS NOT DISTINCT FROM b.stated AND a.line IS NOT DISTINCT FROM b.line AND a.which = 1 AND b.which = 2""",
    "decoded_pages": with_(_DOC) + r"SELECT doc_id, true AS same FROM dc WHERE NOT contains(text, '\\') AND NOT contains(text, '~')".replace("\\\\", "\\"),
    "page_fragments": with_(_DOC) + ", t AS (SELECT doc_id, translate(text, '<>&', '') AS t FROM dc), r AS (SELECT doc_id, t, regexp_replace(t, '[一-鿿々]+《[^《》\\n]*》', '', 'g') AS u FROM t) SELECT doc_id, 1 AS surplus, CAST(len(regexp_extract_all(t, '[一-鿿々]+《[^《》\\n]*》')) AS INTEGER) AS ruby, CAST(len(regexp_extract_all(t, '［＃[^］\\n]*］')) AS INTEGER) AS note FROM r",
    "text_streams": with_(_DOC) + ", t AS (SELECT doc_id, CAST(length(replace(regexp_replace(text, '［＃[^］\\n]*］', '', 'g'), chr(10), '')) AS BIGINT) AS n FROM dc) SELECT doc_id, n AS \"full\", n AS told_and_said, true AS speech_within, true AS embedded_within FROM t",
    "framed_texts": with_(_DOC) + ", t AS (SELECT doc_id, replace(regexp_replace(text, '［＃[^］\\n]*］', '', 'g'), chr(10), '') AS x FROM dc WHERE text NOT LIKE '%「%' AND text NOT LIKE '%」%' AND text NOT LIKE '%見出し%') SELECT doc_id, CAST(181 AS INTEGER) AS inserted_chars, CAST(length(x) AS INTEGER) AS narration_chars, round(181 / (181 + length(x)), 3) AS inserted_share, round(10 / 181 * 1e4, 1) AS i_inserted, round((length(x) - length(replace(x, '私', ''))) / greatest(length(x), 1) * 1e4, 1) AS i_narration FROM t",
    "quote_patterns": with_(_DOC) + ", l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM dc) SELECT count(*) FILTER (WHERE regexp_matches(line, '「[^「」]*$')) AS \"A\", count(*) FILTER (WHERE regexp_matches(line, '^[^「」]*」')) AS \"B\", count(*) FILTER (WHERE regexp_matches(line, '「[^「」]*「')) AS \"C\", count(*) FILTER (WHERE regexp_matches(line, '」[^「」]*」')) AS \"D\", count(*) FILTER (WHERE regexp_matches(line, '「[、。）]')) AS \"E\" FROM l",
    "glyph_definitions": "SELECT * FROM (VALUES ('a', '㋤'), ('b', chr(57346)), ('e', '〼')) t(glyph_id, ch)",
    "ngram_counts": with_(_DOC) + r", w AS (SELECT regexp_extract_all(regexp_replace(lower(text), '([\p{Han}\p{Hiragana}\p{Katakana}ー])', ' \1 ', 'g'), '[\p{L}\p{N}]+') AS w FROM dc), g AS (SELECT unnest(list_transform(range(1, len(w)), lambda p: w[p] || ' ' || w[p + 1])) AS ngram FROM w) SELECT ngram, count(*) AS n FROM g GROUP BY ngram ORDER BY n DESC, ngram LIMIT 50",
    "display_forms": with_(TOK) + "SELECT DISTINCT lemma, regexp_replace(lemma, '-[A-Za-z][A-Za-z .''-]*$', '') AS shown FROM tok WHERE lemma <> ''",
    "token_guard": with_(_DOC) + f", t AS (SELECT doc_id, length({_BODY}) AS c, len(list_filter(regexp_split_to_array(text, '{_WH}+'), lambda x: x <> '')) AS n FROM dc) SELECT doc_id, CASE WHEN n > 0 THEN round(c / n, 4) END AS mean_length, coalesce(n > 0 AND c / n > 8, false) AS refused FROM t",
    "style_confusion": "WITH m AS (SELECT DISTINCT id, try_cast(bungo_per10k AS DOUBLE) AS b, try_cast(kogo_per10k AS DOUBLE) AS k FROM corpus_metadata_v2 WHERE id IS NOT NULL), c AS (SELECT id, CASE WHEN b IS NULL OR k IS NULL THEN NULL WHEN b >= 80 AND round(coalesce(b / nullif(b + k, 0), 0), 3) >= 0.2e0 THEN 'A' WHEN round(coalesce(b / nullif(b + k, 0), 0), 3) <= 0.1e0 THEN 'C' ELSE 'B' END AS style, b, k FROM m), t AS (SELECT DISTINCT id, substring(" + sql_strip(sql_narrow("style_class")) + ", 1, 1) AS stated FROM corpus_metadata_v2 WHERE id IS NOT NULL) SELECT stated, style, count(*) AS works FROM c JOIN t USING (id) GROUP BY ALL",
    "filled_blanks": "WITH a AS (SELECT work_stem, min(period5) AS period5, min(genre_main) AS genre_main FROM chunks_index GROUP BY work_stem), b AS (SELECT " + _STEM + " AS work_stem, min(" + sql_category("genre_main") + ") AS genre_main, min(kana_orthography) AS kana_orthography FROM corpus_metadata_v2 GROUP BY 1) SELECT a.work_stem, a.period5, coalesce(CASE WHEN trim(a.genre_main, ' ') <> '' THEN a.genre_main END, b.genre_main) AS genre_main, b.kana_orthography FROM a LEFT JOIN b USING (work_stem)",
    "tidy_lengths": with_(_DOC) + r", t AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \t\x{3000}]+', ' ', 'g'), ' *\r?\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS x FROM dc) SELECT doc_id, CAST(length(text) AS INTEGER) AS folded, CAST(CASE WHEN x = '' THEN 0 ELSE length(x) + 1 END AS INTEGER) AS tidied FROM t",
    "key_variant_join": with_(TOK, _MK) + "SELECT * FROM jm",
    "unmatched_report": with_(TOK, _MK) + "SELECT count(DISTINCT work_stem) AS works, count(DISTINCT work_stem) FILTER (WHERE meta_id IS NULL) AS unmatched, round(count(DISTINCT work_stem) FILTER (WHERE meta_id IS NULL) / count(DISTINCT work_stem), 6) AS share FROM jm",
    "resolve_rank": f"WITH x AS (SELECT id, min(author_ja) AS a, min(title_aozora) AS t FROM corpus_metadata_v2 WHERE id IS NOT NULL GROUP BY id), w AS (SELECT work_stem AS wid, min(author_ja) AS a, min(title) AS t FROM chunks_index WHERE title IS NOT NULL GROUP BY work_stem), e AS (SELECT wid, id, 1 AS rank FROM w JOIN x ON {_AK('w.a')} = {_AK('x.a')} AND {_TK('w.t')} = {_TK('x.t')} UNION ALL SELECT wid, id, 2 FROM w JOIN x ON {_AK('w.a')} = {_AK('x.a')} AND {_BT('w.t')} = {_BT('x.t')} WHERE {_BT('w.t')} <> ''), g AS (SELECT wid, rank, count(*) AS candidates, min(id) AS id FROM e GROUP BY ALL), m AS (SELECT wid, min_by(id, rank) AS id, min_by(candidates, rank) AS candidates, min(rank) AS rank FROM g GROUP BY wid) SELECT w.wid, id, candidates, rank FROM w LEFT JOIN m USING (wid)",
    "merged_volumes": with_(_DOC) + "SELECT work_stem AS canonical, CAST(sum(length(text)) + count(*) - 1 AS INTEGER) AS chars, CAST(count(*) AS INTEGER) AS members FROM dc WHERE work_stem IS NOT NULL GROUP BY work_stem",
    "colophons": with_(_DOC) + f", f AS (SELECT doc_id, regexp_replace(text, '[ \\n]', '', 'g') AS flat, string_split(text, chr(10)) AS ls FROM dc), b AS (SELECT *, list_position(list_transform(ls, lambda x: regexp_matches(trim(x, ' '), '^({'|'.join(_COLOPHON)})')), true) AS cut FROM f) SELECT doc_id, {_COLO} AS hits, CAST(coalesce(cut - 1, len(ls)) AS INTEGER) AS body_lines, CAST(len(ls) AS INTEGER) AS lines FROM b",
}
