"""Facts on small invented corpora: searches, measures, dispersion, distances, marks, keys."""

import math
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fumikura.functions import keys, marks, text
from fumikura.operators import concordance as kw
from fumikura.operators import neardup, quality, resolve, stats, stylometry, tokens, topics, vectors
from fumikura.queries import stylometry as queries_stylometry
from fumikura.queries import texts as queries_texts
from fumikura.queries import vectors as queries_vectors
from fumikura.sources import stage


def corpus(spark, volumes):
    """Volumes as {(work, vol): lines of (surface, lemma, pos1)} to a tsv table; the first row comes twice, one row is
    broken."""
    rows = []
    for (w, v), lines in volumes.items():
        ln, i = 0, 0
        for line in lines:
            for s, m, p in line:
                ln, i = ln + 1, i + 1
                rows.append((w, v, ln, i, s, m, m, s, "", p, "", "", "", "", "", "", None))
            ln += 1
            rows.append((w, v, ln, None, "", "", None, "", "", "EOS", "", "", "", "", "", "", None))
        rows.append((w, v, ln + 1, None, "x", None, None, None, None, None, None, None, None, None, None, None, None))
    schema = "work_stem string, vol_no int, line_no int, i int, surface string, lemma_key string, lemma string, orthbase string, lform string, pos1 string, pos2 string, pos3 string, pos4 string, ctype string, cform string, goshu string, loaded_at timestamp"
    return spark.createDataFrame(rows + rows[:1], schema)


N, V, P, X = "名詞", "動詞", "助詞", "補助記号"


@pytest.fixture(scope="module")
def tok(spark):
    t = corpus(spark, {
        ("a", 1): [[("山", "山", N), ("を", "を", P), ("見", "見る", V), ("。", "。", X)], [("川", "川", N), ("を", "を", P), ("見る", "見る", V)]],
        ("b", 1): [[("山", "山", N), ("見る", "見る", V), ("山", "山", N)], [("を", "を", P)]],
    })
    return tokens.tokens(t, "surface", "lemma_key", "lemma", "orthbase", "pos1", "pos2", "pos3", sentences=True, block=3).persist()


def places(df):
    return sorted((r["work_stem"], r["vol_no"], r["i"]) for r in df.collect())


def test_sentences_across_blocks(tok):
    got = {(r["work_stem"], r["i"]): r["sent"] for r in tok.collect()}
    assert got == {**{("a", i): int(i > 4) for i in range(1, 8)}, ("b", 1): 0, ("b", 2): 0, ("b", 3): 0, ("b", 4): 1}


def test_lemma_and_surface_differ(tok):
    assert len(places(kw.search(tok, "見る"))) == 3
    assert len(places(kw.search(tok, "S:見る"))) == 2
    with pytest.raises(kw.QueryError):
        kw.search(tok, "見", check_vocabulary=True)


def test_phrases_stay_in_sentences(tok):
    assert places(kw.search(tok, "山 を")) == [("a", 1, 1)]
    assert places(kw.search(tok, "* を 見る")) == [("a", 1, 1), ("a", 1, 5)]
    assert places(kw.search(tok, "*/動詞 */名詞")) == [("b", 1, 2)]


def test_patterns_and_errors(tok):
    assert len(places(kw.search(tok, "見*|川"))) == 4
    assert len(places(kw.search(tok, "re:[山川]"))) == 4
    assert places(kw.search(tok, "山/動詞")) == []
    for bad in ("", "re:["):
        with pytest.raises(kw.QueryError):
            kw.search(tok, bad)
    with pytest.raises(kw.QueryError):
        kw.search(tok, "*/ない", check_vocabulary=True)


def test_collocates_by_hand(tok):
    h = kw.search(tok, "見る")
    got = {r["form"]: r for r in kw.collocates(tok, h, width=2, min_freq=1).collect()}
    assert {f: r["co"] for f, r in got.items()} == {"山": 3, "を": 2, "川": 1}
    w, n, f, o = 6, 10, 3, 3
    assert got["山"]["mi"] == round(math.log2(o * n / (w * f)), 2)
    assert got["山"]["delta_p_fwd"] == round(o / w - (f - o) / (n - w), 4)
    assert sum(r["marks"] for r in kw.focus(tok, h, "山", width=2).collect()) == 3


def test_context_and_sample(tok):
    h = kw.search(tok, "見る")
    c = {(r["work_stem"], r["i"]): (r["left"], r["key"], r["right"]) for r in kw.context(tok, h, 1, 2).collect()}
    assert c[("a", 3)] == ("山 を", "見", "。 川")
    a, b = kw.sample(h, 2, 7).collect(), kw.sample(h.repartition(3), 2, 7).collect()
    assert [tuple(x) for x in a] == [tuple(x) for x in b] and len(a) == 2


def test_variants_sum_up(tok):
    h = kw.search(tok, "見る")
    assert {r["spelling"]: r["n"] for r in kw.variants(tok, h, top=1).collect()} == {"見る": 2, "(other)": 1}


def test_empty_tables(tok):
    e = tok.limit(0)
    assert kw.search(e, "見る").count() == 0
    assert kw.collocates(e, kw.search(e, "見る")).count() == 0
    assert tokens.report(e).count() == 0
    assert stats.dispersion(tokens.counts(e, "work_stem"), "work_stem").count() == 0


def test_dispersion_orders_and_equals_naive(spark):
    even = [("even", f"w{j}", 20) for j in range(8)]
    rows = [*even, ("one", "w0", 160), *(("fill", f"w{j}", 1000) for j in range(8))]
    c = spark.createDataFrame(rows, "term string, work_stem string, n long")
    got = {r["term"]: r["dp"] for r in stats.dispersion(c, "work_stem").collect()}
    size = {w: sum(n for _, x, n in rows if x == w) for w in {x for _, x, _ in rows}}
    for t in ("even", "one"):
        f = {w: n for x, w, n in rows if x == t}
        naive = 0.5 * sum(abs(f.get(w, 0) / sum(f.values()) - s / sum(size.values())) for w, s in size.items())
        assert got[t] == pytest.approx(naive, abs=1e-4)
    assert got["even"] < 0.05 < 0.8 < got["one"]


def test_keyness_leaves_out_unlabelled(spark):
    c = spark.createDataFrame([("1", "x", 50), ("1", "y", 950), ("2", "x", 5), ("2", "y", 995), (None, "x", 9999)], "period string, term string, n long")
    k = {(r["period"], r["term"]): r for r in stats.keyness(c, "period").collect()}
    assert k[("1", "x")]["freq_out"] == 5 and k[("1", "x")]["g2"] > 0
    assert ("2", "x") not in k  # fewer than ten


def test_delta_and_jsd_bounds(spark):
    r = spark.createDataFrame([("a", "x", 0.5), ("a", "y", 0.5), ("b", "x", 0.5), ("b", "y", 0.5), ("c", "z", 1.0)], "work_stem string, term string, rel double")
    j = {(x["a"], x["b"]): x["jsd"] for x in stylometry.js_divergence(r, "work_stem", "term", "rel").collect()}
    assert j == {("a", "b"): 0.0, ("a", "c"): 1.0, ("b", "c"): 1.0}


def test_containment_counts_copies_once(spark):
    d = spark.createDataFrame([(1, "abcdefghijklmnopqrstuvwxyz" * 3), (2, "abcdefghijklmnopqrstuvwxyz" * 3), (3, "abcdefghijklmnopqrstuvwxyz0123456789"), (4, None), (5, "")], "doc_id long, text string")
    sh = stylometry.char_shingles(F.col("text"), 12, 1)
    got = stylometry.similar_sets(d.where("text is not null"), "doc_id", sh, 0.15).collect()
    assert [(r["a"], r["b"], r["a_class"]) for r in got] == [(1, 3, 2)]
    assert {r["doc_id"]: (r["class"], r["copies"], r["links"]) for r in stylometry.duplicate_links(d.where("text is not null"), "doc_id", sh, 0.3).collect()} == {1: (1, 2, 1), 2: (1, 2, 1), 3: (3, 1, 1)}


@pytest.mark.parametrize("measure", ["containment", "jaccard"])
@pytest.mark.parametrize("least", [0.15, 0.5, 0.8, 1.0])
def test_similar_sets_are_exact(spark, measure, least):
    rng = np.random.default_rng(8)
    sets = [sorted(set(rng.integers(0, 25, rng.integers(1, 15)).tolist())) for _ in range(60)]
    d = spark.createDataFrame(list(enumerate(sets)), "id long, s array<long>")
    got = {(r["a"], r["b"]) for r in stylometry.similar_sets(d, "id", F.col("s"), least, measure).collect()}
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(tuple(s), i)
    reps = sorted(first.values())
    of = lambda x, y: min(len(x), len(y)) if measure == "containment" else len(x | y)
    assert got == {(a, b) for a in reps for b in reps if a < b and len(set(sets[a]) & set(sets[b])) / of(set(sets[a]), set(sets[b])) >= least}


def test_neighbours_equal_brute_force(spark):
    x = np.random.default_rng(3).normal(size=(60, 8))
    v = spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)], "id long, vec array<double>")
    got = {(r["q"], r["rank"]): r["key"] for r in vectors.neighbours(v, "id", F.col("id") % 20 == 0, 3, block=2).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in (0, 20, 40):
        s = u @ u[q]
        s[q] = -9
        assert [got[(q, k)] for k in (1, 2, 3)] == np.argsort(-s)[:3].tolist()


def test_procrustes_finds_rotation(spark):
    rng = np.random.default_rng(5)
    x, (q, _) = rng.normal(size=(30, 4)), np.linalg.qr(rng.normal(size=(4, 4)))
    mk = lambda m: spark.createDataFrame([(f"t{i}", [float(y) for y in r]) for i, r in enumerate(m)], "term string, vec array<double>")
    r = vectors.procrustes(mk(x), mk(x @ q.T))
    assert np.allclose(r, q, atol=1e-8)
    d = vectors.drift({"a": vectors.rotate(mk(x @ q.T), r), "b": mk(x)}).collect()
    assert max(abs(y["drift_first_last"]) for y in d) < 1e-6


def test_gaps_by_pairs(spark):
    x = np.random.default_rng(1).normal(size=(12, 5))
    v = spark.createDataFrame([(i, i % 3, [float(y) for y in r]) for i, r in enumerate(x)], "id long, label int, vec array<double>")
    g = vectors.gaps(v, ["label"]).first()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = [(u[i] @ u[j], i % 3 == j % 3) for i in range(12) for j in range(i)]
    assert g["within"] == pytest.approx(np.mean([c for c, w in s if w]), abs=1e-6)
    assert g["between"] == pytest.approx(np.mean([c for c, w in s if not w]), abs=1e-6)


def test_communities_of_two_cliques(spark):
    e = [(a, b, 1.0) for g in ((1, 2, 3), (7, 8, 9)) for a in g for b in g if a < b]
    got = {r["node"]: r["community"] for r in topics.communities(spark.createDataFrame(e, "a int, b int, weight double"), 4).collect()}
    assert len({got[n] for n in (1, 2, 3)}) == len({got[n] for n in (7, 8, 9)}) == 1 and got[1] != got[7]


def test_chunks_and_caps(spark):
    t = corpus(spark, {("w", 1): [[(f"語{k}", f"語{k}", N) for k in range(j, j + 5)] for j in range(0, 50, 5)], ("short", 1): [[("語", "語", N)]]})
    tk = tokens.tokens(t, "lemma_key", "pos1", "pos2", sentences=False)
    c = tokens.chunks(tk, 15)
    assert sorted((r["work_stem"], r["chunk_no"], r["chunk_tokens"]) for r in c.collect()) == [("w", 0, 15), ("w", 1, 15), ("w", 2, 15)]
    ix = spark.createDataFrame([("w", n) for n in range(90)], "work_stem string, chunk_no long")
    assert sorted(r["chunk_no"] for r in tokens.cap_chunks(ix, 40, "spread").collect()) == [int(i * 90 / 40) for i in range(40)]
    assert tokens.cap_chunks(ix, 40, "stratified").count() == 40
    assert tokens.cap_chunks(ix, 40, "random").count() == 40


@pytest.mark.parametrize(("a", "b"), [("かゝ", "かか"), ("かゞみ", "かがみ"), ("がゝ", "がか"), ("漢ゝ", "漢ゝ"), ("ホヽヽ", "ホホホ"), ("ほのぼの〳〵", "ほのぼのほのぼの"), ("さま〴〵", "さまざま"), ("人〳〵", "人〳〵"), ("々", "々"), (None, None)])
def test_iteration_marks(a, b):
    assert marks.expand_repeats(a) == b


def test_quotes():
    assert marks.quote_spans("「あ」と「い」") == [{"first": 0, "last": 0, "kind": "speech"}] * 2
    assert marks.quote_spans("\n".join(["「長い"] * 8) + "」")[0]["kind"] == "embedded"
    assert marks.quote_spans("「開いた\nまま")[0]["kind"] == "unclosed"
    assert marks.quote_spans("閉じた」")[0]["kind"] == "stray"
    assert marks.quote_spans(None) == []


def test_html_and_bytes():
    assert marks.main_text('<body><div class="main_text"><ruby>山<rt>やま</rt></ruby><br>川</div></div><div>底本</div></body>') == "山\n川"
    assert marks.decode_bytes("<meta charset=Shift_JIS>山".encode("cp932")).endswith("山")
    assert marks.decode_bytes("山川".encode("euc_jp")) is not None and marks.decode_bytes(None) is None


def test_keys(spark):
    d = spark.createDataFrame([("1", "000002", "３ 大正（1912〜）", "女", "１，２３４語"), (None, "2", "", " ", "不明"), ("000001", "2", "03_x", "Male", "673.0")], "p string, w string, per string, sex string, n string")
    c = F.col
    got = d.select(keys.work_stem(c("p"), c("w")), keys.period_number(c("per")), keys.sex(c("sex")), keys.stated_number(c("n")), keys.category(c("per"))).collect()
    assert [tuple(r) for r in got] == [("000001_000002", "3", "f", 1234, "3_大正(1912-)"), (None, None, None, None, None), ("000001_000002", "3", "m", 673, "03_x")]


def test_join_by_spellings(spark):
    f = spark.createDataFrame([("000001_000002",), ("1_9",), ("x",)], "work_stem string")
    m = spark.createDataFrame([("A", "1", "2", None), ("B", "000001", "000009", None)], "id string, aozora_person_id string, aozora_work_id string, loaded_at timestamp")
    j = resolve.join_metadata(f, m)
    assert {r["work_stem"]: r["meta_id"] for r in j.collect()} == {"000001_000002": "A", "1_9": "B", "x": None}
    assert resolve.unmatched(j).first()["unmatched"] == 1


def test_merge_needs_all_members(spark):
    p = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "member string, text string")
    m = spark.createDataFrame([("X", 2, "a"), ("X", 1, "b"), ("Y", 1, "c"), ("Y", 2, "gone")], "canonical string, ord int, member string")
    assert [(r["canonical"], r["text"]) for r in resolve.merge_volumes(p, m).collect()] == [("X", "2\n1")]


def test_upper_median_is_no_mean(spark):
    d = spark.createDataFrame([("g", 1.0), ("g", 2.0), ("g", 3.0), ("g", 4.0), ("g", None)], "g string, x double")
    assert quality.upper_median(d, "g", "x").first()["median"] == 3.0


def test_markers_shortest_match(spark):
    d = spark.createDataFrame([(["で", "あ", "る", "なり"],), ([],)], "t array<string>")
    assert [r[0] for r in d.select(tokens.marker_hits(F.col("t"), ["であ", "である", "なり"])).collect()] == [2, 0]


def test_text_functions_take_nulls(spark):
    d = spark.createDataFrame([(None,), ("",)], "x string")
    c = F.col("x")
    lo, hi = text.years(c)
    d.select(text.author_key(c), text.title_key(c), text.base_title(c), lo, hi, text.first_medium(c), text.ndc_primary(c), text.genre_of_ndc(c), text.note_kind(c), text.unknown_class(c), text.katakana_key(c, True), text.fold_width(c), text.tidy(c), text.colophon_hits(c)).collect()


def test_katakana_spellings_meet(spark):
    d = spark.createDataFrame([("ヰスキー",), ("ウイスキー",), ("ラムプ",), ("ランプ",), ("ストツキング",), ("ストッキング",)], "x string")
    k = [r[0] for r in d.select(text.katakana_key(F.col("x"))).collect()]
    assert k[0] == k[1] and k[2] == k[3] and k[4] == k[5]


@settings(max_examples=30, deadline=None)
@given(st.text(alphabet="あかが山ゝゞヽヾ〳〵", max_size=20))
def test_repeats_never_shrink(s):
    assert len(marks.expand_repeats(s)) >= len(s) - s.count("〳〵") * 2


def documents(spark, path, texts):
    rows = [(i, t, "ja", "s", None if t is None else len(t), None, "x", None) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, work_stem string, stream string, fetched_at timestamp").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_every_document_has_a_class(spark, tmp_path):
    d = documents(spark, tmp_path, ["one two three", "one two three", "one two", "。。。", "。。。", "！", "", None, "a b c d e f", "a b c d e f"])
    got = {r["doc_id"]: (r["class"], r["copies"], r["links"]) for r in queries_stylometry.near_dup_links(spark, d).collect()}
    assert got == {0: (0, 2, 0), 1: (0, 2, 0), 2: (2, 1, 0), 3: (3, 2, 0), 4: (3, 2, 0), 5: (5, 1, 0), 6: (6, 1, 0), 7: (7, 1, 0), 8: (8, 2, 0), 9: (8, 2, 0)}


def test_edited_japanese_copy_is_found(spark, tmp_path):
    x = "".join(chr(0x4E00 + 7 * j % 2000) + ("、" if j % 13 == 12 else "") for j in range(400))
    d = documents(spark, tmp_path, [x, x[:200] + "ん" + x[201:], x[::-1], "カタカナー文字abc12 x"])
    assert [(r["a"], r["b"], r["jaccard"] > 0.9) for r in queries_stylometry.near_dups(spark, d).collect()] == [(0, 1, True)]
    assert {r["doc_id"]: (r["class"], r["copies"], r["links"]) for r in queries_stylometry.near_dup_links(spark, d).collect()} == {0: (0, 1, 1), 1: (1, 1, 1), 2: (2, 1, 0), 3: (3, 1, 0)}


def test_words_split_han_and_kana(spark):
    w = F.regexp_extract_all(F.lower("t"), F.lit(queries_stylometry._WORD), F.lit(0))
    got = spark.createDataFrame([("カナー、漢字々abc１２ x-あ한글",)], "t string").select(w.alias("w")).first()["w"]
    assert got == ["カ", "ナ", "ー", "漢", "字", "々", "abc１２", "x", "あ", "한글"]


def test_lda_passes_over_all_chunks(spark):
    chunks = spark.createDataFrame([(f"c{j}", [f"t{j}_{x}" for x in range(60)] + ["の"] * 20) for j in range(100)], "chunk string, terms array<string>")
    theta, phi = topics.fit_lda(chunks, 2, max_iter=2)
    assert theta.count() == 200
    w = phi.groupBy("term").agg(F.max("weight").alias("w")).toPandas().set_index("term")["w"]
    assert len(w) == 6001  # no term is cut
    once = w.drop("の").to_numpy()
    assert once.min() > once.max() / 3  # a chunk that was left out would leave its terms at their prior


def test_cooc_takes_more_than_200_terms(spark, tmp_path):
    words = [f"w{x}" for x in np.random.default_rng(4).permutation(np.repeat(np.arange(300), 2))]
    corpus(spark, {("000001_000001", 1): [[(w, w, "名詞") for w in words]]}).write.parquet(f"{tmp_path}/tsv.parquet")
    want = {}
    for p, a in enumerate(words):
        for b in words[max(0, p - 5) : p] + words[p + 1 : p + 6]:
            if a != b:
                want[a, b] = want.get((a, b), 0) + 1
    assert {(r["a"], r["b"]): r["n"] for r in queries_vectors.cooc(spark, str(tmp_path)).collect()} == want
    assert queries_vectors.ppmi_svd_norms(spark, str(tmp_path)).count() == 300
    assert queries_vectors.work_vectors(spark, str(tmp_path)).first()["dims"] == 100


BROKEN = [("山<br />川", "山\n川"), ("a<|endoftext|>b", "a<|endoftext|>b"), ("a&nbsp;b&amp;c", "a\xa0b&c"), ("a & b &copy c &nosuch; &#x5c71;", "a & b © c &nosuch; 山"), ("1 < 2 > 0", "1 < 2 > 0"), ("a</div>b</p>c", "abc"), ("<p>a<b>c", "ac"), ("山<ruby>川<rt>かわ</ruby>海", "山川海"), ("a<!-- x -->b", "ab"), ("plain", "plain"), ("", "")]


def test_html_of_every_document(spark, tmp_path):
    d = documents(spark, tmp_path, [x for x, _ in BROKEN])
    assert [marks.main_text(x) for x, _ in BROKEN] == [y for _, y in BROKEN]
    assert {r["doc_id"]: r["chars"] for r in queries_texts.html_text(spark, d).collect()} == {i: len(y) for i, (_, y) in enumerate(BROKEN)}


def test_every_id_is_diagnosed(spark, tmp_path):
    rows = [(f"A{j}", "夏目漱石", f"作品{j}") for j in range(8, 13)]
    spark.createDataFrame(rows, "id string, author_ja string, title_aozora string").write.parquet(f"{tmp_path}/corpus_metadata_v2.parquet")
    got = queries_texts.match_misses(spark, str(tmp_path)).collect()
    assert {r["wid"] for r in got if r["reason"] == "title_mismatch"} == {"A8", "A9", "A10", "A11", "A12"}
    assert all(r["other"] == "作品" + r["wid"][1:] and r["d"] == 2 for r in got if r["rank"] == 1)


def test_containment_moves_no_postings(spark, tmp_path):
    rng = np.random.default_rng(5)
    d = documents(spark, tmp_path, ["".join(map(chr, rng.integers(0x4E00, 0x9000, 6_000))) for _ in range(60)])
    first = len(stage._WRITTEN)
    found = queries_stylometry.duplication_findings(spark, d)
    assert "Exchange" not in found._jdf.queryExecution().toString()
    written = sum(p.stat().st_size for _, path in stage._WRITTEN[first:] for p in Path(path.removeprefix("file://")).rglob("*.parquet"))
    assert written < 12 * 60 * (1_000 + 500) + 100_000  # a hash and the number of its set
    assert {(r["level"], r["target"]) for r in found.collect()} == {("FATAL", f"{i} / {i + 1_000_000_000}") for i in range(60)}


def test_short_texts_contain_one_shingle_without_joins(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = ["".join(map(chr, rng.integers(0x4E00, 0x9000, 114))) for _ in range(40)]
    d = documents(spark, tmp_path, [t + x[0][:12] for t in x])  # 20 shingles, of which 0 has one twice
    found = queries_stylometry.shingle_containment(spark, d)
    assert "Exchange" not in found._jdf.queryExecution().toString()
    assert {(r["a"], r["b"], r["common"], r["containment"]) for r in found.collect()} == {(a, b, 1, 0.05 if a else 0.052632) for a in range(40) for b in range(a + 1, 40)}


@pytest.mark.parametrize("least", [0.05, 0.3, 0.7])
def test_containment_over_many_units(spark, least):
    """Units of 60 shingles, blocks of three: every pair of units is met once; a few shingles are in most sets."""
    rng = np.random.default_rng(9)
    sets = [sorted({*rng.integers(0, 60, rng.integers(1, 40)).tolist(), *(range(4) if i % 3 else ())}) for i in range(90)]
    sets[70:] = sets[:20]
    d = spark.createDataFrame(list(enumerate(sets)), "id long, s array<long>").repartition(7)
    _, found = neardup.contained(*stylometry._rows(d, "id", F.col("s")), least, unit=60, block=180)
    want = {(a, b, c, 1 + (a < 20), 1 + (b < 20)) for a in range(70) for b in range(a + 1, 70) if (c := len({*sets[a]} & {*sets[b]})) and c / min(len(sets[a]), len(sets[b])) >= least}
    assert sorted((r["a"], r["b"], r["common"], r["a_class"], r["b_class"]) for r in found.collect()) == sorted(want)
