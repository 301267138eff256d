"""Building the metadata table: new works from a fetch log, facts from candidates, sibling volumes and persons, an
editor's decisions, and the columns that follow from others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fumikura.functions import keys, text

OPEN = "TBD"
#: The controlled vocabulary.
VOCABULARY = {
    "narration": ("first", "third", "mixed", "none", "dialogue"),
    "register_level": ("canonical", "middlebrow", "popular", "documentary"),
    "audience": ("general", "juvenile"),
    "form": ("novel", "novella", "short-story", "collection", "cycle", "treatise", "essay", "diary", "diary-novel", "biography", "autobiography", "play", "travelogue", "oral-transcript"),
    "genre_main": ("Fiction", "Nonfiction"),
    "author_sex": ("M", "F"),
    "completeness": ("complete", "incomplete", "part", "partial", "revised", "DUPLICATE", "superseded", "too_short", "merged"),
}
#: Rows that stay in the table but are in no count.
UNUSED = ("superseded", "merged", "too_short")
#: Columns that a part of a work takes from another part.
INHERITED = ("narration", "register_level", "audience", "form", "genre_sub", "author_sex", "completeness", "first_medium", "year_first_end")


def usable(meta: DataFrame) -> DataFrame:
    """Rows that analyses may count."""
    return meta.where(~F.coalesce(F.col("completeness").isin(*UNUSED), F.lit(False)))


def six(c: Column) -> Column:
    """An id of at most six digits, padded; others as they are."""
    x = F.trim(c)
    return F.when(x.rlike("^[0-9]{1,5}$"), F.lpad(x, 6, "0")).otherwise(x)


def value(c: Column) -> Column:
    """A cell's text without outer blanks; null if there is none."""
    x = F.trim(c)
    return F.when(x != "", x)


def decisions(table: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(person, work, the accepted columns, editorial_note) of an editor's table, the last row of a work counting (in
    the order of all its cells), and the rejected cells (person, work, column, value): values outside the vocabulary."""
    t = table.select(six(F.col("person_id")).alias("person"), six(F.col("work_id")).alias("work"), *(value(F.col(c)).alias(c) for c in [*columns, "editorial_note"])).where("person <> '' and work <> ''")
    fits = lambda c: F.col(c).isin(*VOCABULARY[c]) if c in VOCABULARY else F.lit(True)
    bad = t.select("person", "work", F.explode(F.array(*(F.when(F.col(c).isNotNull() & ~fits(c), F.struct(F.lit(c).alias("column"), F.col(c).alias("value"))) for c in columns))).alias("x")).where("x is not null")
    cells = [*columns, "editorial_note"]
    good = t.select("person", "work", *(F.when(fits(c), F.col(c)).alias(c) for c in columns), "editorial_note")
    last = good.groupBy("person", "work").agg(F.max(F.struct(*(F.coalesce(c, F.lit("")).alias(c) for c in cells))).alias("x"))
    return last.select("person", "work", *(value(F.col(f"x.{c}")).alias(c) for c in cells)), bad.select("person", "work", "x.column", "x.value").distinct()


def decide(meta: DataFrame, decided: DataFrame, columns: list[str]) -> DataFrame:
    """The editor's values in place of the table's; a note is added to the note; ``source_meta`` says so."""
    d = decided.select(F.col("person").alias("_p"), F.col("work").alias("_w"), *(F.col(c).alias(f"_{c}") for c in columns), F.col("editorial_note").alias("_note"))
    j = meta.join(d, (six(meta["aozora_person_id"]) == d["_p"]) & (six(meta["aozora_work_id"]) == d["_w"]), "left")
    source = F.coalesce(F.col("source_meta"), F.lit("")) if "source_meta" in meta.columns else F.lit("")
    hit = F.col("_p").isNotNull()
    out = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in columns}
    out["note"] = F.when(F.col("_note").isNotNull(), F.concat_ws(" ／ ", value(F.col("note")), F.col("_note"))).otherwise(F.col("note"))
    out["source_meta"] = F.when(hit, F.concat_ws("+", value(source), F.lit("editorial"))).otherwise(source)
    return j.withColumns(out).select(*meta.columns, *(["source_meta"] if "source_meta" not in meta.columns else []))


def stale(decided: DataFrame, meta: DataFrame) -> DataFrame:
    """(person, work) of decisions that no row of the table has: they must not be lost without a word."""
    m = meta.select(six(F.col("aozora_person_id")).alias("person"), six(F.col("aozora_work_id")).alias("work"))
    return decided.select("person", "work").join(m, ["person", "work"], "left_anti")


def persons(table: DataFrame, order: str) -> DataFrame:
    """(person, author_reading, author_birth, author_death): the first row of an id, in the order of a column, wins."""
    year = lambda c: F.nullif(F.regexp_extract(F.coalesce(F.col(c), F.lit("")), "([0-9]{4})", 1), F.lit(""))
    t = table.where(value(F.col("person_id")).isNotNull()).select(six(F.col("person_id")).alias("person"), F.col(order).alias("o"), value(F.col("reading")).alias("author_reading"), year("birth").alias("author_birth"), year("death").alias("author_death"))
    return t.groupBy("person").agg(F.min(F.struct("o", "author_reading", "author_birth", "author_death")).alias("x")).select("person", "x.author_reading", "x.author_birth", "x.author_death")


def year_of(c: Column) -> Column:
    """The year that the first four characters state; null for none and for 0."""
    y = F.substring(F.trim(c), 1, 4).try_cast("int")
    return F.when(y > 0, y)


def extend(meta: DataFrame, log: DataFrame, candidates: DataFrame) -> DataFrame:
    """Rows for the works of a fetch log (person_id, work_id, author_ja, title_aozora, year_first, ndc, shoshutsu) that
    the table lacks.

    The year is the log's, else the candidate's, else that of a sibling (a work of the table with the same author and
    title, else the same title without its part); ``year_source`` says which, and what is known of no one is open.  A
    part takes what it doesn't know from its sibling and is marked as a part.  ``needs_review`` lists open columns.
    """
    known = meta.select(six(F.col("aozora_person_id")).alias("person"), six(F.col("aozora_work_id")).alias("work")).distinct()
    new = log.select(six(F.col("person_id")).alias("person"), six(F.col("work_id")).alias("work"), "author_ja", "title_aozora", "year_first", "ndc", "shoshutsu").where("person <> '' and work <> ''")
    new = new.groupBy("person", "work").agg(F.min(F.struct("author_ja", "title_aozora", "year_first", "ndc", "shoshutsu")).alias("x")).select("person", "work", "x.*")
    new = new.join(known, ["person", "work"], "left_anti")
    who = lambda c: text.author_key(F.col(c))
    new = new.withColumns({"_a": who("author_ja"), "_t": text.title_key(F.col("title_aozora")), "_b": text.base_title(F.col("title_aozora"))})

    def first(df: DataFrame, title: Column, columns: list[str], name: str, key: str) -> DataFrame:
        """One row an author and title, the smallest id first."""
        x = df.select(who("author_ja").alias("_a"), title.alias(key), F.struct("id", *columns).alias(name)).where(F.col("_a").isNotNull() & (F.col(key) != ""))
        return x.groupBy("_a", key).agg(F.min(name).alias(name))

    c_cols, s_cols = ["year_target", "genre_main", "author_sex"], ["year_first", *(c for c in INHERITED if c in meta.columns)]
    t, b = text.title_key(F.col("title_aozora")), text.base_title(F.col("title_aozora"))
    j = new.join(first(candidates, t, c_cols, "c1", "_t"), ["_a", "_t"], "left").join(first(candidates, t, c_cols, "c2", "_t").withColumnRenamed("_t", "_b"), ["_a", "_b"], "left")
    j = j.join(first(meta, t, s_cols, "s1", "_t"), ["_a", "_t"], "left").join(first(meta, b, s_cols, "s2", "_b"), ["_a", "_b"], "left")
    c, s = F.coalesce("c1", "c2"), F.coalesce("s1", "s2")
    of_log, of_c, of_s = year_of(F.col("year_first")), year_of(c["year_target"]), year_of(s["year_first"])
    year = F.coalesce(of_log, of_c, of_s)
    source = F.when(of_log.isNotNull(), "index").when(of_c.isNotNull(), "candidates").when(of_s.isNotNull(), F.concat(F.lit("sibling:"), s["id"])).otherwise(OPEN)
    known_cell = lambda x: F.when(~F.coalesce(value(x), F.lit(OPEN)).isin(OPEN), value(x))
    inherited = {k: F.coalesce(known_cell(c[k]) if k in c_cols else F.lit(None), known_cell(s[k]), F.lit(OPEN)) for k in s_cols if k not in ("year_first", "completeness", "first_medium")}
    out = j.select(
        "person", "work", "author_ja", "title_aozora", year.alias("year"), source.alias("year_source"), F.coalesce(text.period_of_year(year).cast("string"), F.lit(OPEN)).alias("period"),
        F.coalesce(known_cell(c["genre_main"]), text.genre_of_ndc(F.col("ndc")), F.lit(OPEN)).alias("genre_main"), F.coalesce(value(text.first_medium(F.col("shoshutsu"))), known_cell(s["first_medium"]) if "first_medium" in s_cols else F.lit(None), F.lit("")).alias("first_medium"),
        F.when(s.isNotNull(), "part").otherwise("complete").alias("completeness"), s["id"].alias("sibling"), *(x.alias(k) for k, x in inherited.items() if k != "genre_main"),
    )
    return out.withColumn("needs_review", F.concat_ws(" ", *(F.when(F.col(k) == OPEN, k) for k in ["year_source", "period", "genre_main", *(k for k in inherited if k != "genre_main")])))


def periods(meta: DataFrame) -> DataFrame:
    """The table with ``period`` worked out anew from the year of every row that has one, and ``moved``, whether it
    stood otherwise: a stored period isn't trusted."""
    p = text.period_of_year(year_of(F.col("year_first"))).cast("string")
    old = keys.period_number(F.col("period"))
    return meta.withColumn("moved", p.isNotNull() & ~p.eqNullSafe(old)).withColumn("period", F.coalesce(p, old))


def provenance_agreement(a: DataFrame, b: DataFrame, key: str, columns: list[str], least: float = 0.8) -> DataFrame:
    """Two versions of a table: rows of both, of one only, the share of the smaller one's keys that both have, cells that
    differ, and whether they agree (at least ``least`` of the keys, no cell differing)."""
    x = a.select(key, F.struct(*columns).alias("x")).dropDuplicates([key])
    y = b.select(key, F.struct(*columns).alias("y")).dropDuplicates([key])
    j = x.join(y, key, "full")
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    differ = sum((F.when(both & ~F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")), 1).otherwise(0) for c in columns), F.lit(0))
    g = j.agg(F.count_if(both).alias("both"), F.count_if(F.col("y").isNull()).alias("only_a"), F.count_if(F.col("x").isNull()).alias("only_b"), F.sum(differ).cast("bigint").alias("cells_differ"))
    share = F.col("both") / F.nullif(F.least(F.col("both") + F.col("only_a"), F.col("both") + F.col("only_b")), F.lit(0))
    return g.select("*", F.round(share, 6).alias("share"), ((share >= least) & (F.col("cells_differ") == 0)).alias("agrees"))


def summary(works: DataFrame) -> DataFrame:
    """Works, authors, tokens, first and last year of a corpus."""
    return works.agg(F.count("*").alias("works"), F.count_distinct("author").alias("authors"), F.sum("tokens").alias("tokens"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
