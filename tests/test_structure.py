"""Quotations, segments, streams and pages by hand."""

from pyspark.sql import functions as F

from fumikura.functions import structure as st


def kinds(lines, heads=(), **o):
    return [(k, a, b) for k, a, b in st.quotations(lines, list(heads), **o)]


def test_pairs_and_strays():
    assert kinds(["「あ」と「い」」"]) == [("speech", (0, 0), (0, 2)), ("speech", (0, 4), (0, 6)), ("stray", (0, 7), (0, 7))]
    assert kinds(["「あ「い」う」"]) == [("speech", (0, 0), (0, 6))]  # deeper marks are text
    assert kinds([]) == kinds([""]) == []


def test_repeated_openings_and_inserted_texts():
    lines = ["「一", "　「二", *["「三"] * 5, "「四「内」と言った」"]
    assert kinds(lines) == [("embedded", (0, 0), (7, 9)), ("speech", (7, 2), (7, 4))]
    assert kinds(lines[1:]) == [("speech", (0, 1), (6, 9))]


def test_given_up():
    assert kinds(["「あ", "い", "「う」"], heads=[1]) == [("unclosed", (0, 0), None), ("speech", (2, 0), (2, 2))]
    assert kinds(["「あ", *["い"] * 4, "う」"], most=3) == [("unclosed", (0, 0), None), ("stray", (5, 1), (5, 1))]
    assert kinds(["「あ", *["い"] * 3, "「う」"], most=3) == [("speech", (0, 0), (4, 2))]  # repeated in time
    assert kinds(["「あ「い」う"]) == [("unclosed", (0, 0), None), ("speech", (0, 2), (0, 4))]
    assert kinds(["［＃「あ」は底本では「い」］"]) == []


def test_segments_and_streams(spark):
    text = "始め「言う」終り［＃改ページ］\n［＃大見出し］章\n" + "\n".join(["「手紙"] * 7) + "\n「末「内」外」後"
    d = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {(r["doc_id"], r["stream"]): r["text"] for r in st.streams(d).collect()}
    assert got[1, "speech"] == "「言う」\n「内」"
    assert got[1, "embedded"].startswith("「手紙\n") and got[1, "embedded"].endswith("「末「内」外」")
    assert got[1, "narration"].startswith("始め終り\n章\n「手紙") and got[1, "narration"].endswith("「末外」後")
    assert "改ページ" not in got[1, "full"] and got[2, "full"] == got[3, "full"] == ""
    assert [(x["par"], x["part"]) for x in st.rendered("「あ\nい\nう」")] == [(0, "I"), (1, "M"), (2, "F")]


def test_scan_events(spark):
    def events(text, most=150):
        d = spark.createDataFrame([(text,)], "t string")
        return [(x["kind"], x["par"]) for x in d.select(st.scan_events(F.split("t", "\n"), most=most).alias("e")).first()["e"]]

    assert events("あ」\n「い") == [("stray_close", 1), ("unclosed_at_end", 2)]
    assert events("「あ\n［＃大見出し］章\n「い」") == [("block_boundary", 1)]
    assert events("「あ\nい\nう」", 2) == [("spans_too_many", 1)]
    assert events("「「「あ") == [("line_imbalance", 1), ("unclosed_at_end", 1)]
    assert events("「あ」") == []


def test_surplus_and_frame():
    page = '<div class="main_text">a<div>b</div>c</div>d</div>e<div class="bibliographical_information">f</div>'
    assert st.without_surplus(page) == (page.replace("c</div>d", "cd"), 1)
    assert st.without_surplus("<p>x</p>") == ("<p>x</p>", 0)
    old = "<html><body>" + "x<hr>" + "本文" * 200 + "<hr><p>底本：「あ」</p><hr>後"
    assert "".join(f["text"] for f in st.fragments(old)) == "本文" * 200
    assert st.without_frame("<p>no rule</p>") == "<p>no rule</p>"


def test_fragments():
    page = '<div class="main_text"><h3>題</h3>※<span class="notes">［＃「口＋虚」、第3水準1-84-7］</span><ruby>山<rp>（</rp><rt>やま</rt><rp>）</rp></ruby><br/>※<span class="notes">［＃「※」はママ］</span><img class="gaiji" alt="※(「女」、U+5A86)"><img class="gaiji" alt="※(謎)"></div>'
    got = st.fragments(page)
    assert [(f["kind"], f["text"]) for f in got if f["kind"] != "note"] == [("head", "題"), ("break", "\n"), ("text", st.glyph_at(1, 84, 7)), ("ruby", "山"), ("break", "\n"), ("text", "※"), ("glyph", "媆"), ("glyph", "謎")]
    assert [f["extra"] for f in got if f["kind"] == "ruby"] == ["やま"] and sum(f["kind"] == "note" for f in got) == 2
    assert st.fragments(None) == [] and st.glyph_of("説明だけ") is None


def test_glyph_map_empty(spark):
    assert st.glyph_map(spark.createDataFrame([], "glyph_id string, type string, value string")).count() == 0
