"""Operators that work in blocks or ranges, with blocks made small, against plain versions; and the new chains."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import N, P, V, corpus

from fumikura.functions import udfs
from fumikura.operators import metadata as md
from fumikura.operators import resolve, stats, stylometry, tokens, topics, vectors
from fumikura.plans import pairs
from fumikura.sources import index, stage


def vecs(spark, n=23, dims=3, seed=1):
    r = np.random.default_rng(seed)
    m = np.round(r.normal(size=(n, dims)), 3)
    m[4] = m[9]  # ties
    return m, spark.createDataFrame([(f"u{j:02}", [float(x) for x in v]) for j, v in enumerate(m)], "u string, v array<double>")


@pytest.mark.parametrize("metric", ["cosine", "delta", "euclidean"])
def test_pairs_in_blocks(spark, metric):
    m, d = vecs(spark)
    plain = {"cosine": lambda a, b: 1 - a @ b / (np.linalg.norm(a) * np.linalg.norm(b)), "delta": lambda a, b: np.abs(a - b).mean(), "euclidean": lambda a, b: np.sqrt(((a - b) ** 2).sum())}[metric]
    got = {(r["a"], r["b"]): r["x"] for r in pairs.all_pairs(d, "u", "v", metric, "x", 6, size=5).collect()}
    assert got == {(f"u{i:02}", f"u{j:02}"): pytest.approx(plain(m[i], m[j]), abs=1e-5) for i in range(23) for j in range(i + 1, 23)}
    near = {}
    for r in pairs.nearest(d, d, "u", "v", metric, 2, "x", 6, size=6).collect():
        near.setdefault(r["q"], []).append((r["x"], r["key"]))
    for i in range(23):
        want = sorted((round(float(plain(m[i], m[j])), 6), f"u{j:02}") for j in range(23) if j != i)[:2]
        assert [k for _, k in sorted(near[f"u{i:02}"])[:2]] == [k for _, k in want]
    assert pairs.all_pairs(d.limit(0), "u", "v", metric, "x").count() == 0


def test_divergence_in_blocks(spark):
    r = random.Random(2)
    rows = [(f"u{j}", f"t{k}", r.random()) for j in range(9) for k in range(12) if r.random() < 0.6 or k == 0]
    d = spark.createDataFrame(rows, "u string, t string, p double")
    one = {(x["a"], x["b"]): x["jsd"] for x in stylometry.js_divergence(d, "u", "t", "p", size=2, parts=3).collect()}
    two = {(x["a"], x["b"]): x["jsd"] for x in stylometry.js_divergence(d, "u", "t", "p").collect()}
    assert one == two and len(one) == 36


def test_ranks(spark):
    r = random.Random(5)
    rows = [(r.choice("ab"), float(r.choice([1, 2, 2.5, 3, 9, r.random()]))) for _ in range(300)]
    d = spark.createDataFrame(rows, "g string, x double")
    for x in stats.with_rank(d, "x", "g", parts=7).distinct().collect():
        mine = [v for g, v in rows if g == x["g"]]
        assert (x["below"], x["equal"], x["all"]) == (sum(v < x["x"] for v in mine), sum(v == x["x"] for v in mine), len(mine))
    assert stats.with_rank(d.limit(0), "x").count() == 0


def test_folds(spark):
    r = random.Random(3)
    rows = [(j, f"g{min(int(r.expovariate(0.3)), 9)}", r.choice("xyz")) for j in range(200)] + [(500, "g1", None)]
    d = spark.createDataFrame(rows, "id long, g string, y string")
    f = vectors.fold_by_group(d, "g", 3).select("g", "fold").distinct().collect()
    assert len(f) == len({x["g"] for x in f}) and {x["fold"] for x in f} <= {0, 1, 2}
    s = vectors.fold_stratified(d, "id", "y", 4).groupBy("y", "fold").count().collect()
    for y in "xyz":
        n = [x["count"] for x in s if x["y"] == y]
        assert len(n) == 4 and max(n) - min(n) <= 1


def test_balance(spark):
    d = spark.createDataFrame([(f"w{j}", "a" if j < 30 else "b", "x" if j % 2 else None) for j in range(40)], "w string, s string, author string")
    assert {x["s"]: x["count"] for x in vectors.balanced(d, "s", "w").groupBy("s").count().collect()} == {"a": 10, "b": 10}
    assert {x["s"]: x["count"] for x in vectors.balanced(d, "s", "w", per_author=3).groupBy("s").count().collect()} == {"a": 6, "b": 6}


def test_index_neighbours_over_blocks(spark):
    words = [("山", "山", N), ("を", "を", P), ("見", "見る", V), ("川", "川", N)]
    r = random.Random(1)
    tsv = corpus(spark, {("a", 1): [[r.choice(words) for _ in range(r.randrange(1, 9))] for _ in range(12)]})
    t = tokens.tokens(tsv, "surface", "lemma_key", "pos1", sentences=True, block=7)
    rows = {x["i"]: x for x in index.with_neighbours(t, block=6).collect()}
    assert sorted(rows) == list(range(1, len(rows) + 1))
    for i, x in rows.items():
        for k, n in ((1, "lemma_key_1"), (3, "lemma_key_3")):
            y = rows.get(i + k)
            assert x[n] == (y["lemma_key"] if y is not None and y["sent"] == x["sent"] else None)
        y = rows.get(i - 2)
        assert x["surface_m2"] == (y["surface"] if y is not None and y["sent"] == x["sent"] else None)


@pytest.mark.parametrize("block", [2, 3, 8192])
def test_runs_over_blocks(spark, block):
    kata = lambda *s: [(x, x, N) for x in s]
    tsv = corpus(spark, {("a", 1): [[*kata("ア", "イ", "ウ", "エ"), ("山", "山", N), *kata("オ", "カ")], kata("キ", "ク"), kata("ケ")]})
    t = tokens.tokens(tsv, "surface", "lemma", "pos1", sentences=True)
    assert sorted((x["first"], x["parts"], x["run"]) for x in tokens.katakana_runs(t, block).collect()) == [(1, 4, "ア|イ|ウ|エ"), (6, 2, "オ|カ"), (8, 2, "キ|ク")]


@pytest.mark.parametrize("block", [2, 8192])
def test_markers_over_blocks(spark, block):
    tsv = corpus(spark, {("a", 1): [[("で", "で", P), ("あ", "あ", V)], [("る", "る", V), ("だ", "だ", V), ("だ", "だ", V)]]})
    c = tokens.marker_counts(tokens.tokens(tsv, "surface"), {"k": ("である", "だ", "だだ")}, block=block).first()
    assert (c["tokens"], c["k"]) == (5, 3)


def test_stop_list_and_record(spark):
    c = spark.createDataFrame([("c1", ["a", "b", "a", "c"]), ("c2", ["b"]), ("c3", [])], "chunk string, terms array<string>")
    stop = spark.createDataFrame([("b",), ("z",), ("b",)], "term string")
    assert {r["chunk"]: r["terms"] for r in topics.without_stopwords(c, stop).collect()} == {"c1": ["a", "a", "c"], "c2": [], "c3": []}
    a, b = topics.training_record(stop, k=5), topics.training_record(stop.orderBy(F.desc("term")), k=5)
    assert a == b and a["stop_words"] == 2 and a != topics.training_record(stop.limit(0), k=5)


def test_read_keys_and_diagnostics(spark):
    k = topics.read_topic_keys(spark.createDataFrame([("0\t0.5\tあ い ",), ("x\t1\ty",), ("short",), ("2\tbad\t",)], "value string"))
    assert [tuple(r) for r in k.collect()] == [(0, 0.5, ["あ", "い"]), (2, None, [])]
    x = '<model><topic id="0" tokens="5" coherence="-1.5" exclusivity=\'0.3\' effective_words="12"><word/></topic><topic id="1"></topic></model>'
    assert [tuple(r) for r in topics.read_diagnostics(spark.createDataFrame([(x,)], "value string")).collect()] == [(0, -1.5, 0.3, 12.0), (1, None, None, None)]


def test_communities(spark):
    cliques = [(a, b, 1.0) for base in (0, 10) for a in range(base, base + 4) for b in range(a + 1, base + 4)] + [(3, 10, 0.1)]
    e = spark.createDataFrame(cliques, "a int, b int, weight double")
    with stage.owned():
        c = topics.communities(e)
        got = {r["node"]: r["community"] for r in c.collect()}
        assert len(set(got.values())) == 2 and len({got[x] for x in range(4)}) == 1
        m = topics.modularity(e, spark.createDataFrame(list(got.items()), "node int, community int")).first()
    assert m["communities"] == 2 and m["modularity"] == pytest.approx(12 / 12.1 - 2 * 12.1**2 / (4 * 12.1**2), abs=1e-6)


def test_metadata_extension(spark):
    cols = "id string, aozora_person_id string, aozora_work_id string, author_ja string, title_aozora string, year_first string, genre_sub string, completeness string, note string, period string"
    m = spark.createDataFrame([("A", "1", "2", "甲 乙", "山（上巻）", "1910", "x", "complete", "n", "9"), ("B", "000001", "000003", "甲乙", "川", None, None, None, None, None)], cols)
    log = spark.createDataFrame([("1", "2", "甲乙", "山", "", "", ""), ("1", "9", "甲乙", "山（下巻）", "", "K913", ""), ("1", "9", "甲乙", "山（下巻）", "", "K913", ""), ("2", "1", "丙", "空", "", "", "朝日新聞"), ("2", "2", "丙", "海", "1950-51", "", ""), (None, "3", "丙", "x", "", "", "")], "person_id string, work_id string, author_ja string, title_aozora string, year_first string, ndc string, shoshutsu string")
    cand = spark.createDataFrame([("C", "丙", "空", "1890", "Fiction", "F")], "id string, author_ja string, title_aozora string, year_target string, genre_main string, author_sex string")
    got = {(r["person"], r["work"]): (r["year"], r["year_source"], r["period"], r["genre_main"], r["first_medium"], r["completeness"], r["sibling"]) for r in md.extend(m, log, cand).collect()}
    assert got == {("000001", "000009"): (1910, "sibling:A", "3", "Fiction", "", "part", "A"), ("000002", "000001"): (1890, "candidates", "2", "Fiction", "newspaper", "complete", None), ("000002", "000002"): (1950, "index", "6", "TBD", "", "complete", None)}
    ed = spark.createDataFrame([("1", "2", "complete", "見た"), ("1", "3", "nonsense", ""), ("7", "7", "part", None), ("", "1", "part", None)], "person_id string, work_id string, completeness string, editorial_note string")
    good, bad = md.decisions(ed, ["completeness"])
    assert [tuple(r) for r in bad.collect()] == [("000001", "000003", "completeness", "nonsense")]
    assert [tuple(r) for r in md.stale(good, m).collect()] == [("000007", "000007")]
    x = {r["id"]: (r["completeness"], r["note"], r["source_meta"]) for r in md.decide(m, good, ["completeness"]).collect()}
    assert x == {"A": ("complete", "n ／ 見た", "editorial"), "B": (None, None, "editorial")}
    assert {r["id"]: (r["period"], r["moved"]) for r in md.periods(m).collect()} == {"A": ("3", True), "B": (None, False)}


def test_named_functions(spark):
    udfs.register(spark)
    rows = spark.sql("SELECT g.* FROM (SELECT tokenize('Abc 山川') AS w UNION ALL SELECT tokenize(NULL)) t, LATERAL ngrams(t.w, 2) g").collect()
    assert sorted(tuple(r) for r in rows) == [(1, "abc 山"), (2, "山 川")]


def test_titles_by_subtitle_id_and_orthography(spark):
    x = spark.createDataFrame([("1", "甲", "山", "下", "007", "旧字"), ("2", "甲", "山", "下", "8", "新字"), ("3", "乙", "川", None, "9", None)], "id string, author string, title string, subtitle string, work_id string, orthography string")
    w = spark.createDataFrame([("a", "甲", "山下", "1"), ("b", "甲", "山", None), ("c", "丙", "海", "0009"), ("d", "丁", "川", None), ("e", "乙", "川原", None), ("f", None, None, None)], "wid string, author string, title string, work_id string")
    got = {r["wid"]: (r["id"], r["candidates"], r["rank"]) for r in resolve.match_titles(w, x, "新字").collect()}
    assert got == {"a": ("2", 2, 1), "b": ("2", 2, 1), "c": ("3", 1, 3), "d": (None, None, None), "e": (None, None, None), "f": (None, None, None)}
    why = {r["wid"]: (r["reason"], r["other"]) for r in resolve.diagnose_misses(w.drop("work_id"), x).where("rank = 1").collect()}
    assert why == {"c": ("author_not_found", None), "d": ("author_differs", "乙"), "e": ("title_mismatch", "川"), "f": ("author_not_found", None)}


def test_index_is_built_again_when_it_is_gone(spark, tmp_path):
    import shutil

    corpus(spark, {("000001_000001", 1): [[("山", "山", N), ("を", "を", P)]]}).write.parquet(f"{tmp_path}/tsv.parquet")
    x = index.of_tables(spark, str(tmp_path))
    assert index.of_tables(spark, str(tmp_path)) is x and x.tokens.count() == 2 and x.provenance["tokens"] == 2
    assert index.open_index(spark, x.path).forms.count() == 2
    path = x.path.removeprefix("file://")
    shutil.rmtree(path)
    __import__("os").remove(f"{path}.provenance.json")
    y = index.of_tables(spark, str(tmp_path))
    assert y is not x and y.tokens.count() == 2
    with pytest.raises(FileNotFoundError):
        index.open_index(spark, f"{tmp_path}/none")


def test_empty_index(spark, tmp_path):
    e = corpus(spark, {}).limit(0)
    x = index.build(e, spark.createDataFrame([], index.NO_WORKS), f"{tmp_path}/ix")
    assert x.tokens.count() == x.forms.count() == x.sizes.count() == 0 and x.provenance["tokens"] == 0
