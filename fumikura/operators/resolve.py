"""Entity resolution: keys in several spellings, ranked matches, merges of volumes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fumikura.functions import keys, text


def key_variants(person: Column, work: Column) -> Column:
    """Spellings of a work's key: padded, as stored, and without leading zeros."""
    p, w = keys.strip(keys.narrow(person)), keys.strip(keys.narrow(work))
    bare = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
    return F.array_distinct(F.array_compact(F.array(keys.work_stem(person, work), F.concat_ws("_", p, w), F.concat_ws("_", bare(p), bare(w)))))


def join_metadata(facts: DataFrame, metadata: DataFrame, key: str = "work_stem", keep: str = "first") -> DataFrame:
    """Facts with their metadata row by any spelling of the key (left join; null where unmatched).  The first (or
    last) row by ``loaded_at`` and id counts where several claim a spelling."""
    m = metadata.select(F.explode(key_variants(F.col("aozora_person_id"), F.col("aozora_work_id"))).alias("k"), F.col("id").alias("meta_id"), F.col("loaded_at").alias("at"))
    order = [F.asc("at"), F.asc("meta_id")] if keep == "first" else [F.desc("at"), F.desc("meta_id")]
    m = m.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(*order))).where("r = 1").select("k", "meta_id")
    return facts.join(m, facts[key] == m["k"], "left").drop("k")


def unmatched(joined: DataFrame, key: str = "work_stem") -> DataFrame:
    n = F.count_distinct(key)
    miss = F.count_distinct(F.when(F.col("meta_id").isNull(), F.col(key)))
    return joined.agg(n.alias("works"), miss.alias("unmatched"), F.round(miss / F.nullif(n, F.lit(0)), 6).alias("share"))


def match_titles(wanted: DataFrame, index: DataFrame, prefer: str | None = None) -> DataFrame:
    """Wanted (wid, author, title[, work_id]) to index rows (id, author, title[, subtitle, work_id, orthography]): by
    author and key of the title or of title and subtitle (rank 1), else by author and base title (2), else by the work's
    id without leading zeros (3); of several one in the ``prefer``red orthography, then the smallest id, with the number
    of candidates; unmatched rows stay with a null id."""
    ak, tk, bt = text.author_key(F.col("author")).alias("ak"), text.title_key(F.col("title")).alias("tk"), text.base_title(F.col("title")).alias("bt")
    liked = F.when(F.col("orthography") == prefer, 0).otherwise(1) if prefer and "orthography" in index.columns else F.lit(0)
    no = lambda d: F.regexp_replace(F.trim(F.col("work_id").cast("string")), "^0+(?=.)", "").alias("no") if "work_id" in d.columns else F.lit(None).cast("string").alias("no")
    w, x = wanted.select("wid", ak, tk, bt, no(wanted)), index.select("id", ak, tk, bt, no(index), liked.alias("liked"))
    titles = x.select("id", "ak", "tk", "liked")
    if "subtitle" in index.columns:
        titles = titles.union(index.where("subtitle <> ''").select("id", ak, text.title_key(F.concat("title", "subtitle")), liked)).distinct()
    found = w.join(titles, ["ak", "tk"]).select("wid", "id", "liked", F.lit(1).alias("rank"))
    found = found.union(w.join(x.select("id", "ak", "bt", "liked"), ["ak", "bt"]).where("bt <> ''").select("wid", "id", "liked", F.lit(2)))
    if "work_id" in wanted.columns and "work_id" in index.columns:
        found = found.union(w.join(x.select("id", "no", "liked"), "no").where("no <> ''").select("wid", "id", "liked", F.lit(3)))
    g = found.groupBy("wid", "rank").agg(F.count("*").alias("candidates"), F.min(F.struct("liked", "id")).alias("x"))
    g = g.groupBy("wid").agg(F.min_by(F.struct("x.id", "candidates", "rank"), "rank").alias("m")).select("wid", "m.*")
    return wanted.select("wid").join(g, "wid", "left")


def diagnose_misses(wanted: DataFrame, index: DataFrame, k: int = 5) -> DataFrame:
    """Why a wanted row has no match: the title is in the index under another author, the author has other titles, or
    the author isn't there; with the k nearest titles of the author by edit distance, or the other authors (k at most, by
    name)."""
    miss = match_titles(wanted, index).where("id is null").select("wid").join(wanted, "wid")
    m = miss.select("wid", "title", text.author_key(F.col("author")).alias("ak"), text.title_key(F.col("title")).alias("tk"))
    x = index.select(text.author_key(F.col("author")).alias("ak"), F.col("title").alias("other")).distinct()
    first = lambda d, *o: d.withColumn("rank", F.row_number().over(Window.partitionBy("wid").orderBy(*o))).where(F.col("rank") <= k)
    same = m.where("tk <> ''").join(index.select(text.title_key(F.col("title")).alias("tk"), F.col("author").alias("other")).distinct(), "tk").where("other is not null")
    differs = first(same, "other").select("wid", F.lit("author_differs").alias("reason"), "rank", "other", F.lit(0).alias("d"))
    j = first(m.join(same.select("wid").distinct(), "wid", "left_anti").join(x, "ak", "left").withColumn("d", F.levenshtein(F.col("title"), F.col("other"))), "d", "other")
    return differs.union(j.select("wid", F.when(F.col("other").isNull(), "author_not_found").otherwise("title_mismatch").alias("reason"), "rank", "other", "d"))


def merge_volumes(parts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Texts of member volumes in listed order under the canonical id; a group with a missing member is left out.
    ``parts`` (member, text), ``mapping`` (canonical, ord, member)."""
    expected = mapping.groupBy("canonical").agg(F.count("*").alias("expected"))
    j = mapping.join(parts, "member").groupBy("canonical").agg(F.count("*").alias("found"), F.array_sort(F.collect_list(F.struct("ord", "member", "text"))).alias("m"))
    return j.join(expected, "canonical").where("found = expected").select("canonical", F.array_join(F.transform("m", lambda x: x["text"]), "\n").alias("text"), F.transform("m", lambda x: x["member"]).alias("members"))


def fill_blanks(df: DataFrame, other: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Blank or missing cells of ``df`` from ``other`` (one row per key)."""
    o = other.select(key, *(F.col(c).alias(f"o_{c}") for c in columns))
    have = lambda c: F.when(F.trim(F.col(c)) != "", F.col(c)) if c in df.columns else F.lit(None)
    keep = [c for c in df.columns if c not in columns]
    return df.join(o, key, "left").select(*keep, *(F.coalesce(have(c), F.col(f"o_{c}")).alias(c) for c in columns))
