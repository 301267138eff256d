"""The training-data operators against brute force, on small tables with nulls, repeats, ties, empties and clashing
extra columns; blocks are made small so that their borders are crossed."""

import random
import re
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fumikura.llm import encoding, leaks, letters, pieces, queries, repeats, sampling, sentences, spans, terms

TSV = "work_stem string, vol_no int, line_no int, i int, surface string, lemma string, pos1 string, loaded_at timestamp, rkey string, blk string"
META = "id string, aozora_person_id string, aozora_work_id string, title_aozora string, period string, genre_main string, author_sex string, register_level string, tokens string, loaded_at timestamp, k string"


def tsv(spark, volumes, lemmas=None):
    """{(work, vol): [line of surfaces, ...]}; a surface may be (surface, pos1).  First row twice, rows without keys
    and broken rows are added, extra columns clash with names used inside."""
    rows = [(None, 1, 1, 1, "x", "x", "名詞", None, "q", "q"), ("w0", None, 1, 1, "x", "x", "名詞", None, "q", "q")]
    for (w, v), lines in volumes.items():
        ln = i = 0
        for line in lines:
            for s in line:
                s, p = s if isinstance(s, tuple) else (s, "名詞")
                ln, i = ln + 1, i + 1
                rows.append((w, v, ln, i, s, s, p, None, "q", "q"))
            if line is not lines[-1] or len(lines) > 1:
                ln += 1
                rows.append((w, v, ln, None, "", None, "EOS", None, "q", "q"))
        rows.append((w, v, ln + 1, None, "山", None, None, None, "q", "q"))
    rows = rows + rows[2:5]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, TSV)


def meta(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (10 - len(r)), "q") for r in rows], META)


def runs(texts, n, owner=lambda k: k):
    seen = {}
    for k, t in texts.items():
        for p in range(len(t) - n + 1):
            seen.setdefault(tuple(t[p : p + n]), set()).add(owner(k))
    out = []
    for k, t in texts.items():
        cover = [False] * len(t)
        for p in range(len(t) - n + 1):
            if len(seen[tuple(t[p : p + n])]) > 1:
                cover[p : p + n] = [True] * n
        p = 0
        while p < len(t):
            q = p
            while q < len(t) and cover[q]:
                q += 1
            if q > p:
                out.append((k, p + 1, q))
            p = q + 1
    return sorted(out)


# 1


@pytest.mark.parametrize("block", [150, 8192])
def test_shared_spans(spark, block):
    r = random.Random(block)
    word = lambda: r.choice("abcdefgh") + r.choice("xyz")
    common = [word() for _ in range(400)]
    texts = {("w1", 1): [word() for _ in range(300)] + common + [word() for _ in range(50)], ("w2", 1): common[100:131] + ["z"] + common[131:160], ("w2", 2): [word() for _ in range(20)] + common[5:34], ("w3", 1): ["x"] * 90, ("w4", 1): ["x"] * 45 + ["y"], ("w5", 1): common[370:400] + common[370:400], ("w6", 1): ["k"]}
    t = tsv(spark, {k: [v] for k, v in texts.items()})
    got = spans.shared_positions(spans.surface_units(t), 30, block)
    assert sorted(((x["rec"], x["vol_no"]), x["first_pos"], x["last_pos"]) for x in got.collect()) == runs(texts, 30)


def test_shared_titles_and_shares(spark):
    a, b = "いろはにほへとちりぬるをわかよ", "たれそつねならむうゐのおくやま"
    rows = [("A", "1", "1", "序" + a + "た終"), ("A", "1", "1", "序" + a + "た終"), ("B", "1", "2", a + "たれ"), ("C", "1", "3", b), ("C", "1", "3", b + "け"), ("D", None, None, None), (None, "1", "4", a), ("E", "1", "5", "")]
    got = spans.shared_spans(tsv(spark, {}), meta(spark, rows)).collect()
    assert sorted((x["field"], x["rec"], x["vol_no"], x["first_pos"], x["last_pos"]) for x in got) == [("title_aozora", "A", 0, 2, 17), ("title_aozora", "B", 0, 1, 16)]
    lens = spark.createDataFrame([("title_aozora", "A", 0, 18), ("title_aozora", "C", 0, 15)], "field string, rec string, vol_no long, n long")
    s = {x["rec"]: (x["shared"], x["share"]) for x in spans.shared_shares(spark.createDataFrame(got), lens).collect()}
    assert s == {"A": (16, round(16 / 18, 6)), "C": (0, 0.0)}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=40, max_size=120), st.integers(0, 60), st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), max_size=30))
def test_every_shared_span_has_a_common_chunk(x, at, before, after):
    k, w = spans.chunk_parameters(30)
    piece = x[at % (len(x) - 29) :][:30]

    def chunks(u):
        u = spans._mix(np.array(u, np.uint64))
        c = spans.cuts(spans.gear(u, k)[k - 1 :], w) + (k - 1)
        return {bytes(u[a - k + 1 : b + 1]) for a, b in zip(c[:-1], c[1:])}

    assert chunks(x) & chunks(before + piece + after)


# 2


def test_distinctive_terms(spark):
    c = spark.createDataFrame([("a", "x", 6), ("a", "y", 94), ("b", "y", 50), ("b", "z", 50), (None, "x", 3), ("b", None, 3)], "work_stem string, term string, tf long")
    got = {(r["work_stem"], r["term"]): r for r in terms.distinctive(c, "work_stem", mu=100).collect()}
    p_c = 6 / 200
    p_d = (6 + 100 * p_c) / 200
    assert got[("a", "x")]["score"] == pytest.approx(p_d * np.log2(p_d / p_c), abs=1e-10)
    assert got[("a", "x")]["df"] == 1 and len(got) == 4
    assert {r["term"] for r in terms.distinctive(c, "work_stem", min_df=2).collect()} == {"y"}
    assert terms.distinctive(c.limit(0), "work_stem").count() == 0


def test_found_terms(spark):
    vols = {(f"00000{j}_000001", 1): [["稀"] * (6 if j < 2 else 0) + ["時-代"] * 3 + ["-", ""] + ["普"] * 5] for j in range(4)}
    vols[("000009_000001", 1)] = [["普"] * 9]
    m = meta(spark, [*((f"I{j}", str(j), "1", "t", "２ x") for j in range(4)), ("I9", "9", "1", "t", "3_y"), ("I9", "9", "1", "t", "3 y"), ("I8", "8", "1", "t", None)])
    got = sorted(tuple(r) for r in terms.found(tsv(spark, vols), m).collect())
    assert got == [("period", "2", "時"), ("work", "000000_000001", "稀"), ("work", "000001_000001", "稀")]


def test_found_terms_follow_their_scores(spark, monkeypatch):
    a, b, c = (f"00000{j}_000001" for j in range(3))
    t = tsv(spark, {(a, 1): [["乙"] * 6 + ["丙"] * 9 + ["甲"] * 7 + ["共"] * 6 + ["普"] * 100], (b, 1): [["共"] * 60 + ["普"] * 5], (c, 1): [["普"] * 3]})
    m = meta(spark, [("I0", "0", "1", "t", None)])
    rows = lambda: [tuple(r) for r in terms.found(t, m).collect()]
    score = {(r["work_stem"], r["term"]): r["score"] for r in terms.distinctive(terms.work_terms(t), "work_stem").collect()}
    assert score[a, "丙"] > score[a, "甲"] > score[a, "乙"] > 0 > score[a, "共"]  # a negative score is no reason to leave a row out
    assert rows() == [("work", a, x) for x in "丙甲乙共"] + [("work", b, "共")]
    real = terms.distinctive
    monkeypatch.setattr(terms, "distinctive", lambda *x, **k: (d := real(*x, **k)).withColumn("score", -d["score"]))
    assert rows() == [("work", a, x) for x in "共乙甲丙"] + [("work", b, "共")]


# 3


def works_table(spark, n=300):
    r = random.Random(4)
    rows = []
    for i in range(n):
        x = (f"I{i:04d}", "1", str(i), "t", r.choice(["1_a", "２ b", "3_c", None]), r.choice(["Fiction", "ＦＩＣＴＩＯＮ", "Poetry", ""]), r.choice(["男", "F", "female", "m"]), r.choice(["canonical", "Popular "]))
        rows += [x] * (1 + (i % 10 == 0))
    return meta(spark, rows)


def targets_table(spark, rows):
    return spark.createDataFrame(rows, "target_id long, period string, genre_main string, author_sex string, register_level string, share_pct int, min_items int")


def test_sample_meets_targets(spark):
    t = targets_table(spark, [(1, "1 x", None, None, None, 40, 0), (2, None, "poetry", None, None, 50, 1), (3, None, None, "F", "canonical", 30, 1), (4, "9", None, None, None, 1, 1), (5, None, None, None, None, 100, 0), (6, None, "Poetry", "女", "popular", None, 9), (6, None, "Poetry", "女", "popular", None, 9), (None, "1", None, None, None, 99, 9)])
    m = works_table(spark)
    got = {r["target_id"]: r for r in sampling.report(m, t).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6}
    assert got[5]["needed"] == got[5]["sampled"] == 60
    for k in (1, 2, 3, 6):
        assert got[k]["can_be_met"] and got[k]["is_met"], got[k]
    assert not got[4]["can_be_met"] and not got[4]["is_met"]
    assert [r[0] for r in sampling.found(m, t).collect()] == [4]
    a, b = (sorted(r["id"] for r in sampling.draw(x, t).collect()) for x in (m, m.repartition(5)))
    assert a == b and len(set(a)) == 60


def test_empty_sample(spark):
    t = targets_table(spark, [(1, None, None, None, None, 50, 2)])
    m = works_table(spark).limit(0)
    assert sampling.draw(m, t).count() == 0
    assert [r[0] for r in sampling.found(m, t).collect()] == [1]
    assert sampling.found(works_table(spark), t.limit(0)).count() == 0


# 4


def naive_pieces(toks, limit, overlap):
    """toks: (surface, followed by EOS)"""
    out, s = [], 1
    if len(toks) <= limit:
        return out
    while len(toks) - s + 1 > limit:
        e = s + limit - 1
        for test in (lambda x: x[1], lambda x: x[0] in pieces.SENTENCE, lambda x: x[0] in pieces.CLAUSE):
            c = [p for p in range(s + limit // 2, s + limit) if test(toks[p - 1])]
            if c:
                e = c[-1]
                break
        out.append((s, e))
        s = e - overlap + 1
    return [*out, (s, len(toks))]


@pytest.mark.parametrize(("block", "seed"), [(7, 1), (64, 2), (16384, 3)])
def test_pieces(spark, block, seed):
    r = random.Random(seed)
    vols = {}
    for w in range(6):
        n = r.choice([0, 5, 39, 40, 41, 200, 333])
        lines, left = [], n
        while left > 0:
            k = min(left, r.choice([1, 3, 30, 90]))
            lines.append([r.choice("ああああああああああ、。") for _ in range(k)])
            left -= k
        vols[(f"w{w}", 1)] = lines
    want = []
    for (w, v), lines in vols.items():
        toks = [(s, j == len(ln) - 1 and len(lines) > 1) for ln in lines for j, s in enumerate(ln)]
        want += [(w, v, a, b) for a, b in naive_pieces(toks, 40, 4)]
    got = pieces.surface_pieces(tsv(spark, vols), 40, 4, block)
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)


def test_stated_pieces(spark):
    m = meta(spark, [("A", "1", "1", "t", None, None, None, None, "１，０００語"), ("A", "1", "1", "t", None, None, None, None, "1000"), ("B", "1", "2", "t", None, None, None, None, "401"), ("C", "1", "3", "t", None, None, None, None, "400"), ("D", "1", "4", "t", None, None, None, None, "不明"), ("E", "1", "5", "t", None, None, None, None, "9999"), ("F", None, None, None, None, None, None, None, " 760.0 ")])
    t = tsv(spark, {("000001_000005", 1): [["x"]]})
    got = sorted(tuple(x) for x in pieces.stated_pieces(m, t).collect())
    assert got == [("A", 1, 400), ("A", 361, 760), ("A", 721, 1000), ("B", 1, 400), ("B", 361, 401), ("F", 1, 400), ("F", 361, 760)]
    assert pieces.found(t.limit(0), m.limit(0)).count() == 0


# 5

P = "助詞"
CASES = [  # a line, its sentences' last tokens
    ("山 。 川 。", [2, 4]), ("山 ！ ？ 川", [3, 4]), ("「 山 。 川 。 」 空", [6, 7]), ("「 山 。 」 と/P 川 。", [7]), ("山 ？ と/P 川 。", [5]), ("『 山 。 』 、 『 川 。 』 を/P 見 。", [12]),
    ("Mr . Halden saw . It", [5, 6]), ("J . K . Osk came . He", [7, 8]), ("3 . 14 and No . 12 ran . End", [9, 10]), ("am 74 . März kam er . Ja", [7, 8]), ("A . . . b ! C", [6, 7]), ("… 山 … 。 川", [4, 5]),
    ("“ Go . ” said he .", [7]), ("“ Go . ” He went .", [4, 7]), ("「 山 。 川", [3, 4]), ("山 。 」 川", [3, 4]), ("（ 山 。 ） 川", [4, 5]), ("Z . B . Turm . Ja", [6, 7]), ("धर्मः । 海", [2, 3]), ("。", [1]), ("山", [1]),
]


@pytest.mark.parametrize("block", [5, 16384])
def test_sentences(spark, block):
    tok = lambda x: (x[:-2], P) if x.endswith("/P") else x
    vols = {("w", j): [[tok(x) for x in line.split()], ["終"]] for j, (line, _) in enumerate(CASES)}
    vols[("all", 1)] = [[tok(x) for x in line.split()] for line, _ in CASES]
    vols[("one", 1)] = [["山", "。", "川"]]
    got = {}
    for x in sentences.sentence_ends(tsv(spark, vols), block).collect():
        got.setdefault((x["work_stem"], x["vol_no"]), []).append(x["i"])
    for j, (line, ends) in enumerate(CASES):
        assert sorted(got[("w", j)]) == [*ends, len(line.split()) + 1], line
    want, off = [], 0
    for line, ends in CASES:
        want += [off + e for e in ends]
        off += len(line.split())
    assert sorted(got[("all", 1)]) == want
    assert sorted(got[("one", 1)]) == [2, 3]
    assert sentences.found(tsv(spark, {}).limit(0)).count() == 0


# 6

TEXTS = [None, "", " ", "\n", "a", "don't 'll ''s '", "  two  blanks \n\n x　　山 ", "山の上に、雪が降つた。", "Ünïcode 12,345 ½ ①", "🙂🙂 é é ​﻿", "<|endoftext|> x", "が" * 5000, "1'sx 'S 're're", "\t \ty\r\nz  ", "日本語とEnglishの混ざつた文、です。" * 50]


def reference_ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(encoding.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("block", [1, 200, 1_000_000])
def test_encoding(spark, block):
    rows = [(j, t, "q", "q") for j, t in enumerate(TEXTS)] + [(None, "null key", "q", "q"), (4, "a", "q", "q")]
    d = spark.createDataFrame(rows, "doc_id long, text string, block string, k string")
    got = encoding.encode(d, block_chars=block)
    by = sorted(((r["doc_id"] is None, r["doc_id"], tuple(r["ids"])) for r in got.collect()), key=str)
    assert by == sorted(((k is None, k, tuple(reference_ids(t))) for k, t, *_ in rows), key=str)
    back = {r["doc_id"]: r["text"] for r in encoding.decode(got.where("doc_id is not null and doc_id <> 4")).collect()}
    assert back == {j: t or "" for j, t in enumerate(TEXTS) if j != 4}
    assert encoding.encode(d.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(list(" '\n\tsdmtlrve0山のが。、"))), max_size=40))
def test_encoding_any_text(s):
    voc = encoding.vocabulary(encoding.VOCABULARY)
    w, code, n = encoding.words([s], voc)
    assert "".join(w[c] for c in code) == s and n.sum() == len(code)
    assert [i for c in code for i in voc.encode(w[c].encode())] == reference_ids(s)


# 7


def naive_letters(t, digits=True):
    t = re.sub("《[^《》]*》|［＃[^［］]*］", "", t or "")
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).lower()).translate(str.maketrans(letters.OLD, letters.NEW))
    return "".join(c for c in t if unicodedata.category(c)[0] in "LN" and (digits or c not in "0123456789"))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs", "Cn", "Co"]), st.sampled_from(list("《》［＃］かﾞｶ゙會囘１Ａé́"))), max_size=25)), max_size=6), st.booleans())
def test_letters(texts, digits):
    x, n = letters.letters(texts, digits)
    parts = np.split(x, np.cumsum(n)[:-1]) if len(n) else []
    assert ["".join(map(chr, p)) for p in parts] == [naive_letters(t, digits) for t in texts]


def naive_leak(doc, item):
    a, b = naive_letters(doc), naive_letters(item)
    return any(sum(x == y for x, y in zip(a[p : p + 50], b[q : q + 50])) >= 45 for p in range(len(a) - 49) for q in range(len(b) - 49))


def test_leaks(spark):
    r = random.Random(9)
    word = lambda n: "".join(r.choice("山川空雪雨風花鳥月日會國のがをに") for _ in range(n))
    items = [(j, word(r.choice([49, 50, 51, 80, 150]))) for j in range(12)] + [(90, None), (91, ""), (92, "短い"), (None, word(60))]
    items += [(93, items[3][1]), items[4]]

    def spoil(t, k):
        t = list(t)
        for p in sorted(r.sample(range(len(t)), min(k, len(t)))):
            t[p] = "変"
        return "".join(t)

    docs = [(1, None), (2, ""), (3, word(500)), (None, items[1][1]), (4, word(20) + items[2][1].replace("會", "会") + word(30)), (4, word(9))]
    for j, (_, t) in enumerate(items[:12]):
        cut = t[: r.choice([50, 49, 60])]
        docs += [(100 + j, word(30) + "、".join(spoil(cut, k)) + word(30)) for k in (r.choice([0, 4, 5, 6, 7]),)]
        even = list(t[:50])
        for p in range(8, len(even), 9):
            even[p] = "変"
        docs.append((200 + j, "《ルビ》".join(even)))
    want = sorted({(d, i) for d, t in docs if d is not None for i, x in items if i is not None and naive_leak(t, x)})
    dd, ii = spark.createDataFrame([(*x, "q") for x in docs], "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (100, 1_000_000):
        assert sorted(tuple(x) for x in leaks.find(dd, ii, block_letters=size).collect()) == want
    assert len(want) > 10
    assert leaks.find(dd, ii.limit(0)).count() == leaks.find(dd.limit(0), ii).count() == 0


# 8


def naive_repeats(t):
    x = naive_letters(t, False)
    seen, cover = set(), [False] * len(x)
    for p in range(len(x) - 29):
        if x[p : p + 30] in seen:
            cover[p : p + 30] = [True] * 30
        seen.add(x[p : p + 30])
    return len(x), sum(cover)


def test_repeats(spark):
    r = random.Random(2)
    word = lambda n: "".join(r.choice("あいうえお山川空") for _ in range(n))
    a = word(35)
    texts = [None, "", "、。", "短い", a, a + a, a + "。１" + a + "、" + word(40), word(300), "あ" * 31, "あ" * 30, "".join(f"第{k}回、{a}\n" for k in range(9)), word(29) * 2, a * 300, (a + word(8)) * 2 + word(10)]
    d = spark.createDataFrame([(j, t, "q") for j, t in enumerate(texts)] + [(None, a * 3, "q"), (5, a + a, "q")], "doc_id long, text string, letters string")
    got = [(x["doc_id"], x["letters"], x["repeated"]) for x in repeats.repeated(d).collect()]
    assert sorted(got) == sorted([*((j, *naive_repeats(t)) for j, t in enumerate(texts)), (5, *naive_repeats(a + a))])
    want = [j for j, t in enumerate(texts) if naive_repeats(t)[0] and naive_repeats(t)[1] * 100 >= 45 * naive_repeats(t)[0]]
    assert sorted(x["doc_id"] for x in repeats.found(d).collect()) == want
    assert repeats.repeated(d.limit(0)).count() == 0


def test_line_frequency(spark):
    d = spark.createDataFrame([(j, "h", f"告知！\n本文{'上下左右前後内外'[j]}") for j in range(8)] + [(9, None, "告知"), (10, "h", None)], "doc_id long, source string, text string")
    f = {(r["host"], r["docs"]) for r in repeats.line_frequency(d).collect()}
    assert f == {("h", 8)}
    c = {r["doc_id"]: (r["lines"], r["kept"], r["rejected"]) for r in repeats.clean(d, max_docs=5, min_left=0.7).collect()}
    assert c[0] == (2, 1, True) and c[9] == (1, 1, False) and 10 not in c


# all


def test_queries_have_sql_or_none():
    assert set(queries.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p2_scores", "p3_found", "p4_found"])
def test_sql(name, spark, data):
    import os

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(data):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    got, want = queries.queries()[name](spark, data).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    key = lambda df: sorted(tuple(round(v, 6) if isinstance(v, float) else str(v) for v in r) for r in df[cols].itertuples(index=False, name=None))
    assert key(got) == key(want)


@pytest.mark.parametrize("name", ["p3_sample", "p5_found", "p6_ids", "p7_found", "p8_found", "p8_shares", "p8_lines"])
def test_runs(name, spark, data):
    assert queries.queries()[name](spark, data).count() >= 0


