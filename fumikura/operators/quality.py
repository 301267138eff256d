"""Data-quality checks.  Each gives findings: level, check, target, detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fumikura.functions import text as tx
from fumikura.functions.keys import draw_order


def finding(level: Column | str, check: str, target: Column, detail: Column) -> list[Column]:
    lv = F.lit(level) if isinstance(level, str) else level
    return [lv.alias("level"), F.lit(check).alias("check"), target.cast("string").alias("target"), detail.cast("string").alias("detail")]


def text_findings(docs: DataFrame, key: str = "doc_id", short: int = 20) -> DataFrame:
    """Unresolved glyphs and markers, colophons and leaked annotation, remaining iteration marks, empty and short
    texts, wrong lengths: one scan, one array of possible findings per row."""
    t = F.col("text")
    count = lambda x: F.length(t) - F.length(F.replace(t, F.lit(x), F.lit("")))
    many = lambda p: F.length(F.regexp_replace(t, f"[^{p}]", ""))
    leak = F.concat_ws(" ", *(F.when(t.contains(m), m) for m in ("］", "［＃", "《", "》")))
    hits = tx.colophon_hits(t)
    item = lambda cond, level, name, detail: F.when(cond, F.struct(F.lit(level).alias("level") if isinstance(level, str) else level.alias("level"), F.lit(name).alias("check"), detail.cast("string").alias("detail")))
    every = F.array_compact(F.array(
        item(count("〓") > 0, F.when(count("〓") > 20, "FATAL").otherwise("WARN"), "glyph_unresolved", count("〓")),
        item(count("※") > 0, "WARN", "glyph_marker", count("※")),
        item(hits >= 2, "FATAL", "colophon", hits),
        item(leak != "", "WARN", "annotation_leak", leak),
        item(many("ゝゞヽヾ〳〴〵") > 0, "WARN", "iteration_marks", many("ゝゞヽヾ〳〴〵")),
        item(t.isNull() | (F.trim(t) == ""), "FATAL", "empty_text", F.lit("")),
        item((F.trim(t) != "") & (F.length(t) < short), "WARN", "too_short", F.length(t)),
        item(F.col("n_chars") != F.length(t), "WARN", "wrong_length", F.col("n_chars") - F.length(t)),
    ))
    e = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("target"), F.explode(every).alias("x"))
    return e.select("x.level", "x.check", "target", "x.detail")


REQUIRED = ("author_ja", "title_aozora", "period", "genre_main", "year_first")


def metadata_findings(meta: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Missing required cells, years that are no number or out of range, cells to be decided, repeated ids."""
    m = meta.where("id is not null")
    y = F.expr("try_cast(year_first as int)")
    cells = F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in required))
    e = m.select("id", F.explode(cells).alias("x"))
    miss = e.where("x.v is null or trim(x.v) = ''").select(*finding("FATAL", "required_empty", F.col("id"), F.col("x.c")))
    tbd = e.where("upper(trim(x.v)) = 'TBD' or trim(x.v) = '不明'").select(*finding("WARN", "to_be_decided", F.col("id"), F.col("x.c")))
    year = m.where("trim(year_first) <> ''").select(*finding(F.when(y.isNull(), "FATAL").otherwise("WARN"), "year_range", F.col("id"), F.col("year_first")), y.alias("y")).where("y is null or y < 1850 or y > 1970").drop("y")
    twice = m.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(*finding("WARN", "repeated_id", F.col("id"), F.col("n")))
    return miss.union(tbd).union(year).union(twice).distinct()


def upper_median(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, median, n): the element at place n // 2 of the sorted values, not interpolated.  Groups are
    orthographies and the like; the rank is exact by a histogram of the values."""
    h = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("k"))
    w = Window.partitionBy(group)
    h = h.withColumn("cum", F.sum("k").over(w.orderBy(value))).withColumn("n", F.sum("k").over(w))
    return h.where(F.col("cum") > F.floor(F.col("n") / 2)).groupBy(group).agg(F.min(value).alias("median"), F.first("n").alias("n"))


def rate_outliers(report: DataFrame, group: str, value: str, target: str, times: float = 2.5, over: float = 0.02) -> DataFrame:
    """Rates above both ``times`` the median of their group and ``over`` more than it."""
    m = upper_median(report, group, value)
    j = report.join(F.broadcast(m), report[group].eqNullSafe(m[group])).where(F.col(value) > F.greatest(F.col("median") * times, F.col("median") + over))
    return j.select(*finding("WARN", f"{value}_outlier", F.col(target), F.round(value, 6)))


def low_ratio(df: DataFrame, target: str, value: str, least: float = 0.75) -> DataFrame:
    """Values below a share of the overall upper median: what extraction lost."""
    d = df.withColumn("one", F.lit(1))
    m = upper_median(d, "one", value).drop("n")
    return d.join(F.broadcast(m), "one").where(F.col(value) < least * F.col("median")).select(*finding("FATAL", "extraction_loss", F.col(target), F.round(value, 6)))


def duplication(pairs: DataFrame, warn: float = 0.15, fatal: float = 0.40) -> DataFrame:
    """Pairs of texts (a, b, containment) of which the shorter one stands in the other to at least ``warn``."""
    p = pairs.where(F.col("containment") >= warn)
    return p.select(*finding(F.when(F.col("containment") >= fatal, "FATAL").otherwise("WARN"), "duplication", F.concat_ws(" / ", "a", "b"), F.col("containment")))


def length_skew(sizes: DataFrame, key: str, n: str, limit: float = 10.0) -> DataFrame:
    a = sizes.agg(F.max(F.struct(n, key)).alias("hi"), F.min(F.struct(n, key)).alias("lo"))
    r = F.col(f"hi.{n}") / F.nullif(F.col(f"lo.{n}"), F.lit(0))
    return a.where(r > limit).select(*finding("WARN", "length_skew", F.concat_ws(" / ", f"hi.{key}", f"lo.{key}"), F.round(r, 2)))


def gate(findings: DataFrame, fail: bool = False) -> DataFrame:
    """Findings by level and check; with ``fail`` the job ends in an error if any is FATAL."""
    g = findings.groupBy("level", "check").agg(F.count("*").alias("n"))
    return g.withColumn("n", F.when(F.lit(fail) & (F.col("level") == "FATAL"), F.raise_error(F.concat(F.lit("fatal finding: "), F.col("check"))).cast("bigint")).otherwise(F.col("n"))) if fail else g


def balance_audit(sizes: DataFrame, max_author: float = 0.12, max_work: float = 0.08, max_ratio: float = 3.0, max_band_author: float = 0.40, min_female: float = 0.20) -> DataFrame:
    """(check, target, value, ok) of a corpus (work, author, band, sex, tokens) against design targets: shares of
    authors and works, largest against smallest band, the top author inside a band, women's share."""
    t = sizes.agg(F.sum("tokens").alias("all"))
    share = lambda g, name, limit: g.crossJoin(F.broadcast(t)).select(F.lit(name).alias("check"), F.col("k").cast("string").alias("target"), F.round(F.col("n") / F.col("all"), 6).alias("value"), (F.col("n") / F.col("all") <= limit).alias("ok"))
    by = lambda c: sizes.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("k")).agg(F.sum("tokens").alias("n"))
    a = share(by("author"), "author_share", max_author).where("not ok")
    w = share(by("work"), "work_share", max_work).where("not ok")
    b = by("band")
    r = b.agg(F.max_by("k", F.struct("n", "k")).alias("hi"), F.min_by("k", F.struct("n", "k")).alias("lo"), (F.max("n") / F.min("n")).alias("v")).select(F.lit("band_ratio").alias("check"), F.concat_ws("/", "hi", "lo").alias("target"), F.round("v", 6).alias("value"), (F.col("v") <= max_ratio).alias("ok"))
    ba = sizes.where("band is not null and author is not null").groupBy("band", "author").agg(F.sum("tokens").alias("n")).groupBy("band").agg(F.max("n").alias("m"), F.sum("n").alias("s"))
    ba = ba.select(F.lit("band_top_author").alias("check"), F.col("band").cast("string").alias("target"), F.round(F.col("m") / F.col("s"), 6).alias("value"), (F.col("m") / F.col("s") <= max_band_author).alias("ok"))
    f = sizes.where("sex is not null").agg(F.round(F.sum(F.when(F.col("sex") == "f", F.col("tokens")).otherwise(0)) / F.sum("tokens"), 6).alias("value")).select(F.lit("female_share").alias("check"), F.lit("all").alias("target"), "value", (F.col("value") >= min_female).alias("ok"))
    return a.union(w).union(r).union(ba).union(f)


def skew(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per attribute: categories, the most frequent one and its share of known values, missing cells: one scan that
    is aggregated by (attribute, value)."""
    e = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")).groupBy("x.attribute", "x.value").agg(F.count("*").alias("n"))
    known = F.col("value").isNotNull()
    return e.groupBy("attribute").agg(
        F.count_if(known).alias("categories"), F.max_by("value", F.when(known, F.struct("n", "value"))).alias("top"),
        F.round(F.max(F.when(known, F.col("n"))) / F.nullif(F.sum(F.when(known, F.col("n"))), F.lit(0)), 6).alias("top_share"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("missing"),
    )


def skew_change(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    a, b = skew(before, columns), skew(after, columns)
    j = a.select("attribute", F.col("top").alias("top_before"), F.col("top_share").alias("share_before")).join(b.select("attribute", F.col("top").alias("top_after"), F.col("top_share").alias("share_after")), "attribute")
    return j.withColumn("change", F.round(F.col("share_after") - F.col("share_before"), 6))


def boundaries(d: DataFrame, unit: str) -> DataFrame:
    """(unit, at, ord, surface): where each token ends, in characters of its unit.  A unit is a sentence or a block,
    bounded by whoever names it."""
    w = Window.partitionBy(unit).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return d.select(unit, F.sum(F.length("surface")).over(w).alias("at"), "ord", "surface")


def disagreements(a: DataFrame, b: DataFrame, unit: str, n: int = 20, seed: int = 42) -> DataFrame:
    """A sample by hash of the places where only one of two segmentations has a boundary."""
    j = boundaries(a, unit).select(unit, "at", F.col("surface").alias("seg_a")).join(boundaries(b, unit).select(unit, "at", F.col("surface").alias("seg_b")), [unit, "at"], "full")
    d = j.where(F.col("seg_a").isNull() | F.col("seg_b").isNull())
    return d.orderBy(draw_order(seed, unit, "at"), unit, "at").limit(n)  # the sample asked for


def boundary_agreement(a: DataFrame, b: DataFrame, unit: str) -> DataFrame:
    """Jaccard agreement of two segmentations given as (unit, ord, surface) rows: token ends as character offsets."""
    j = boundaries(a, unit).select(unit, "at").withColumn("ina", F.lit(1)).join(boundaries(b, unit).select(unit, "at").withColumn("inb", F.lit(1)), [unit, "at"], "full")
    return j.groupBy(unit).agg(F.count_if(F.col("ina").isNotNull() & F.col("inb").isNotNull()).alias("common"), F.count("*").alias("either"), F.round(F.count_if(F.col("ina").isNotNull() & F.col("inb").isNotNull()) / F.count("*"), 6).alias("jaccard"))
