"""Readers, writers, glyphs and requests on small files."""

import pytest
from test_operators import N, P, V, X, corpus

from fumikura.operators import concordance as kw
from fumikura.operators import requests, tokens
from fumikura.sources import formats


def test_csv_with_mark_and_comments(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿作品ID,姓 名\n1,x\n".encode())
    d = formats.read_csv(spark, str(tmp_path / "a.csv"))
    assert d.columns == ["作品ID", "姓 名"] and d.select(formats.column(d, "名前", "姓")).first()[0] == "x"
    with pytest.raises(KeyError):
        formats.column(d, "nothing")


def test_morphemes(spark, tmp_path):
    rows = ["# dictionary=x", "\t".join(formats.MORPHEMES), "1\t山\t山\t山\t山\t*\t名詞" + "\t*" * 6, "short\trow", "\t\t\t\t\t\tEOS" + "\t" * 6, "2\t川\t川\t\t川\t\t名詞" + "\t" * 6]
    (tmp_path / "000001_000002_3.tsv").write_text("\n".join(rows))
    got = [(r["work_stem"], r["vol_no"], r["line_no"], r["i"], r["surface"], r["pos2"]) for r in formats.read_morphemes(spark, str(tmp_path)).orderBy("line_no").collect()]
    assert got == [("000001_000002", 3, 1, 1, "山", ""), ("000001_000002", 3, 2, None, "", ""), ("000001_000002", 3, 3, 2, "川", "")]


def test_provenance(spark, tmp_path):
    d = spark.range(3)
    formats.write_table(d, str(tmp_path / "t"), {"query": "山"})
    assert formats.read_provenance(spark, str(tmp_path / "t"))["query"] == "山" and spark.read.parquet(str(tmp_path / "t")).count() == 3
    formats.export_csv(d, str(tmp_path / "c"), {"query": "山"})
    assert [r["provenance"] is None for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()] == [False, True, True]


def test_glyphs(spark):
    n = spark.createDataFrame([("「木＋吶」、第3水準1-85-54",), ("U+20B9F",), ("特別な字",), ("なし",), (None,), ("なし",)], "note string")
    s = spark.createDataFrame([("特別", "甲"), ("特別な字", "乙")], "key string, ch string")
    got = [(r["note"], r["ch"], r["kind"]) for r in formats.resolve_glyphs(n, s).collect()]
    assert len(got) == 6
    by = {a: (b, c) for a, b, c in got}
    assert by["特別な字"] == ("乙", "supplement") and by["U+20B9F"] == ("𠮟", "unicode") and by["なし"] == ("〓", "unresolved") and by["「木＋吶」、第3水準1-85-54"][1] == "menkuten"


def test_request(spark):
    t = tokens.tokens(corpus(spark, {("a", 1): [[("山", "山", N), ("を", "を", P), ("見", "見る", V), ("。", "。", X)] for _ in range(5)]}), "surface", "lemma_key", "orthbase", "pos1", "pos2", sentences=True)
    a = requests.search(t, "見る", limit=2, offset=1, sample=4, sort="left1", context=99)
    assert a.total.first()["hits"] == 5 and a.rows.count() == 2 and a.sampled
    assert {r["form"] for r in a.collocates.collect()} == {"山", "を"}
    assert requests.search(t, "見る", focus="山").rows.count() == 5
    with pytest.raises(kw.QueryError):
        requests.search(t, "見る", sort="sideways")
    with pytest.raises(kw.QueryError):
        requests.search(t, "ない語")
