"""Concordance: query language, sequence search, context, collocates, spelling variants.

A query is a row of terms separated by blanks.  A term is ``[L:|S:]form[/pos]``: the form is looked up among lemma
keys (L) or surfaces (S); ``*`` or nothing is any token; ``re:`` begins a regular expression searched in the form;
``*?[]`` make a pattern for the whole form; ``|`` separates alternatives.  ``/pos`` asks for a part of speech.
Words no vocabulary holds are errors, not empty results (``check=True`` looks them up).

Over the token index (``sources.index``) a query is one filter: the forms of the tokens that follow stand beside each
token, so all terms of a phrase are tested on one row, equality reaches the Parquet scan and nothing is shuffled.
Over any other token table, and for terms further away, hits of single terms are joined on (work, volume, sentence,
position).  A phrase never leaves its sentence.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fumikura.functions.keys import draw_order
from fumikura.operators.tokens import PUNCT

KEYS = ["work_stem", "vol_no", "sent", "i"]
MEASURES = ("co", "logdice", "mi", "mi3", "t", "g2", "delta_p_fwd", "delta_p_bwd")
#: A side of a join is sent to all executors up to this many rows, counted before; beyond it both are shuffled.
SMALL = 2_000_000
NO_METADATA = "（メタデータ無し）"


class QueryError(ValueError):
    """A query that can't be understood, or a word the corpus doesn't hold."""


@dataclass(frozen=True)
class Term:
    column: str
    form: Callable[[Column], Column] | None
    pos: str | None
    text: str

    def predicate(self, at: int = 0) -> Column:
        """The test of the token ``at`` places ahead, in the columns that stand beside the first one."""
        p = F.lit(True) if self.form is None else self.form(F.col(beside(self.column, at)))
        pos1 = F.col(beside("pos1", at))
        if self.pos:
            p = p & F.startswith(pos1, F.lit(self.pos))
        return p if at == 0 or self.form is not None or self.pos else F.col(beside("surface", at)).isNotNull()


def beside(column: str, at: int) -> str:
    """Name of the column of the token ``at`` places ahead (or behind, if negative)."""
    return column if at == 0 else f"{column}_{at}" if at > 0 else f"{column}_m{-at}"


def few(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _glob(pattern: str) -> str:
    """An anchored regular expression for one pattern of * ? [ ]."""
    body = fnmatch.translate(pattern)
    body = re.sub(r"^\(\?s:(.*)\)\\[zZ]$", r"\1", body, flags=re.S)
    return "^" + body.replace("(?>.*?", "(?:.*?") + "$"


def parse(query: str, stream: str = "lemma_key") -> list[Term]:
    if not query or not query.split():
        raise QueryError("the query is empty")
    out = []
    for word in query.split():
        column, text = stream, word
        if word[:2] in ("L:", "S:"):
            column, text = {"L:": "lemma_key", "S:": "surface"}[word[:2]], word[2:]
        form, _, pos = text.partition("/")
        if not form and not pos and text != "*":
            raise QueryError(f"an empty term in {query!r}")
        if form in ("", "*"):
            p = None
        elif form.startswith("re:"):
            try:
                re.compile(form[3:])
            except re.error as e:
                raise QueryError(f"bad regular expression {form[3:]!r}: {e}") from e
            p = lambda c, x=form[3:]: c.rlike(x)
        elif any(x in form for x in "*?["):
            p = lambda c, x="|".join(_glob(x) for x in form.split("|")): c.rlike(x)
        else:
            p = lambda c, x=form.split("|"): c == x[0] if len(x) == 1 else c.isin(*x)
        out.append(Term(column, p, pos or None, word))
    return out


def check(tok: DataFrame, terms: list[Term]) -> None:
    """Raise for a form or part of speech that no token has: one aggregate over the tokens for all terms."""
    tests = [F.coalesce(F.bool_or(t.form(F.col(t.column))), F.lit(False)) if t.form is not None else F.lit(True) for t in terms]
    pos = [F.coalesce(F.bool_or(F.startswith(F.col("pos1"), F.lit(t.pos))), F.lit(False)) if t.pos else F.lit(True) for t in terms]
    row = tok.agg(*(x.alias(f"c{j}") for j, x in enumerate([*tests, *pos]))).first()
    for j, t in enumerate(terms):
        if not row[j]:
            raise QueryError(f"no form of the corpus matches {t.text!r}")
        if not row[len(terms) + j]:
            raise QueryError(f"no part of speech begins with {t.pos!r}")


def search(tok: DataFrame, query: str, stream: str = "lemma_key", exclude_punct: bool = False, check_vocabulary: bool = False, where: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Hits: work_stem, vol_no, sent, i of the first token, ``form``, the matched forms, and the ``carry`` columns of
    the first token.  ``exclude_punct`` tests the first token only."""
    terms = parse(query, stream)
    if check_vocabulary:
        check(tok, terms)

    def first(k: int) -> Column:
        p = terms[k].predicate()
        if k == 0 and exclude_punct:
            p = p & ~F.coalesce("pos1", F.lit("")).isin(*PUNCT)
        return p if where is None else p & where

    form = F.concat_ws(" ", *(f"f{k}" for k in range(len(terms)))).alias("form")
    if all(beside(c, k) in tok.columns for k, t in enumerate(terms) for c in (t.column, "pos1", "surface")):
        p = first(0)
        for k in range(1, len(terms)):
            p = p & terms[k].predicate(k)
        hits = tok.where(p).select(*KEYS, *(F.col(beside(t.column, k)).alias(f"f{k}") for k, t in enumerate(terms)), *carry)
        return hits.select(*KEYS, form, *carry)
    hits = None
    for k, t in enumerate(terms):
        part = tok.where(first(k)).select("work_stem", "vol_no", "sent", (F.col("i") - k).alias("i"), F.col(t.column).alias(f"f{k}"), *(carry if k == 0 else ()))
        hits = part if hits is None else hits.join(part, KEYS)
    return hits.select(*KEYS, form, *carry)


def facets(hits: DataFrame, works: DataFrame, **wanted: list) -> DataFrame:
    """Hits in works with all the wanted attributes (a column of ``works`` = one of the values; all are combined).
    A hit of a work without a row in ``works`` has no attribute."""
    keep = works
    for c, values in wanted.items():
        if c not in works.columns:
            raise QueryError(f"no attribute {c!r}")
        if values:
            keep = keep.where(F.col(c).isin(*values))
    if not any(wanted.values()):
        return hits
    return hits.join(keep.select("work_stem").distinct(), "work_stem", "left_semi")


def sample(hits: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n hits by hash of seed and place: the same for the same seed, whatever the partitioning."""
    return hits.orderBy(draw_order(seed, "work_stem", "vol_no", "i"), "work_stem", "vol_no", "i").limit(n)


def by_group(hits: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """Hits and rate per 10,000 tokens of every group of ``sizes`` (key, tokens), groups without hits included."""
    h = hits.groupBy(key).agg(F.count("*").alias("hits"))
    n = F.coalesce("hits", F.lit(0))
    return sizes.join(h, sizes[key].eqNullSafe(h[key]), "left").select(sizes[key], n.alias("hits"), "tokens", F.round(n / F.col("tokens") * 1e4, 4).alias("per_10k"))


def tally(hits: DataFrame, k: int = 50) -> DataFrame:
    return hits.groupBy("form").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "form").limit(k)


def context(tok: DataFrame, hits: DataFrame, span: int = 1, width: int = 5) -> DataFrame:
    """Left, key and right words of each hit inside its volume, and how many of them share its sentence."""
    h = few(hits.select("work_stem", "vol_no", F.col("sent").alias("hit_sent"), F.col("i").alias("hit"), F.explode(F.sequence(F.col("i") - width, F.col("i") + span - 1 + width)).alias("i")))
    j = h.join(tok.select("work_stem", "vol_no", "i", "sent", "surface"), ["work_stem", "vol_no", "i"])
    side = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("i", "surface")))), lambda x: x["surface"]), " ")
    return j.groupBy("work_stem", "vol_no", F.col("hit").alias("i")).agg(side(F.col("i") < F.col("hit")).alias("left"), side((F.col("i") >= F.col("hit")) & (F.col("i") < F.col("hit") + span)).alias("key"), side(F.col("i") >= F.col("hit") + span).alias("right"), F.count_if(F.col("sent") == F.col("hit_sent")).alias("same_sent"))


def with_source(rows: DataFrame, works: DataFrame) -> DataFrame:
    """Author, title, year, period of each row's work; a work without metadata says so and is titled by its stem."""
    w = works.select("work_stem", "author", "title", "year", "period", F.lit(True).alias("has_meta"))
    j = rows.join(w, "work_stem", "left")
    return j.withColumns({"author": F.coalesce("author", F.lit(NO_METADATA)), "title": F.coalesce("title", "work_stem"), "has_meta": F.coalesce("has_meta", F.lit(False))})


def neighbours(tok: DataFrame, hits: DataFrame, offsets: dict[str, int], column: str = "surface") -> DataFrame:
    """Hits with the form at each offset in the same sentence (null outside it), for sorting by context."""
    out = hits
    for name, k in offsets.items():
        part = tok.select("work_stem", "vol_no", "sent", (F.col("i") - k).alias("i"), F.col(column).alias(name))
        out = few(out).join(part, KEYS) if k == 0 else out.join(part, KEYS, "left")
    return out


ORDERS = ("position", "left1", "left2", "right1", "right2", "year", "author", "title", "random")


def order_columns(sort: str, seed: int = 42) -> list[Column]:
    """Columns to order hits by, with the place last, so ties stand by position.  Context keys ``left1`` ... come from
    ``sort_keys``, year, author and title from ``with_source`` (an unknown year last, then by author)."""
    place = [F.asc("work_stem"), F.asc("vol_no"), F.asc("i")]
    if sort == "position":
        return place
    if sort in ("left1", "left2", "right1", "right2"):
        return [F.asc_nulls_first(f"{sort[:-1]}{k}") for k in range(1, int(sort[-1]) + 1)] + place
    if sort == "year":
        return [F.coalesce("year", F.lit(9999)).asc(), F.asc_nulls_last("author")] + place
    if sort in ("author", "title"):
        return [F.asc_nulls_last(sort)] + place
    if sort == "random":
        return [draw_order(seed, "work_stem", "vol_no", "i").asc()] + place
    raise QueryError(f"no order {sort!r}")


def sort_keys(tok: DataFrame, query: str, sort: str, stream: str = "lemma_key", **options) -> DataFrame:
    """``search`` with the forms that a context order needs: from beside the hit where the index has them, else by a
    join.  An unknown order is a ``QueryError``."""
    order_columns(sort)
    if sort[:-1] not in ("left", "right"):
        return search(tok, query, stream, **options)
    span = len(parse(query, stream))
    offs = {f"{sort[:-1]}{k}": -k if sort[0] == "l" else span - 1 + k for k in range(1, int(sort[-1]) + 1)}
    near = {n: k for n, k in offs.items() if beside("surface", k) in tok.columns}
    hits = search(tok, query, stream, carry=tuple(beside("surface", k) for k in near.values()), **options)
    hits = hits.withColumnsRenamed({beside("surface", k): n for n, k in near.items()})
    return neighbours(tok, hits, {n: k for n, k in offs.items() if n not in near})


def pos_choice(forms: DataFrame, chosen: list[str] | None) -> Column | None:
    """A test on (pos1, pos2) for major classes and ``major-minor`` ones, mixed; None if nothing is chosen.  A choice
    that no form of the vocabulary fits is a ``QueryError``."""
    chosen = [c for c in chosen or [] if c]
    if not chosen:
        return None
    p = F.col("pos1").isin(*chosen) | F.concat_ws("-", "pos1", F.nullif("pos2", F.lit(""))).isin(*chosen)
    if forms.where(p).isEmpty():
        raise QueryError(f"no part of speech {'，'.join(chosen)!r}")
    return p


def vocabulary(tok: DataFrame, column: str = "lemma_key") -> DataFrame:
    """Frequencies by form and part of speech, as the index has them."""
    return tok.groupBy(F.col(column).alias(column), "pos1", "pos2").agg(F.count("*").alias("n"))


def collocates(tok: DataFrame, hits: DataFrame, span: int = 1, width: int = 4, min_co: int = 1, min_freq: int = 3, pos: list[str] | None = None, column: str = "lemma_key", forms: DataFrame | None = None) -> DataFrame:
    """Forms around the hits in the same sentence, punctuation left out, with eight measures of association.

    The window's tokens W are counted before the choice by part of speech, co-occurrences after it; N is all tokens
    but punctuation, a form's frequency is that of the chosen parts of speech.  One pass joins the places around the
    hits with the tokens for W and the co-occurrences; ``forms`` (the index has it) gives frequencies and N.
    """
    forms = vocabulary(tok, column) if forms is None else forms
    choice = pos_choice(forms, pos)
    choice = F.lit(True) if choice is None else choice
    words = forms.where(~F.coalesce("pos1", F.lit("")).isin(*PUNCT))
    node = hits.count()
    offs = [k for k in range(-width, span + width) if not 0 <= k < span]
    h = hits.select("work_stem", "vol_no", "sent", F.explode(F.array(*(F.col("i") + k for k in offs))).alias("i"))
    h = F.broadcast(h) if node * len(offs) <= SMALL else h  # as many rows as counted
    win = h.join(tok.where(~F.coalesce("pos1", F.lit("")).isin(*PUNCT)).select(*KEYS, F.col(column).alias("form"), "pos1", "pos2"), KEYS)
    # the choice is made after this count, so W and the co-occurrences share its exchange
    per = win.groupBy("form", "pos1", "pos2").agg(F.count("*").alias("n"))
    co = per.groupBy("form").agg(F.sum(F.when(choice, F.col("n"))).alias("co")).where(F.col("co") >= max(1, min_co))
    f = words.where(choice).groupBy(F.col(column).alias("form")).agg(F.sum("n").alias("freq")).where(F.col("freq") >= min_freq)
    j = co.join(f, "form").crossJoin(F.broadcast(per.agg(F.sum("n").alias("around")))).crossJoin(F.broadcast(words.agg(F.sum("n").alias("total"))))  # one row each
    W, N, nd = F.col("around").cast("double"), F.col("total").cast("double"), F.lit(float(node))
    o11, fc = (F.col(c).cast("double") for c in ("co", "freq"))
    o12 = W - o11
    e = W * fc / N
    o21, o22 = fc - o11, N - W - fc + o11
    cell = lambda o, x: F.when((o > 0) & (x > 0), o * F.ln(o / x)).otherwise(0.0)
    ll = 2.0 * (cell(o11, e) + cell(o12, W * (N - fc) / N) + cell(o21, (N - W) * fc / N) + cell(o22, (N - W) * (N - fc) / N))
    return j.select(
        "form", "co", "freq", F.round(14 + F.log2(2 * o11 / (nd + fc)), 2).alias("logdice"), F.round(F.log2(o11 / e), 2).alias("mi"), F.round(F.log2(o11 * o11 * o11 / e), 2).alias("mi3"),
        F.round((o11 - e) / F.sqrt(o11), 2).alias("t"), F.round(F.when(o11 >= e, ll).otherwise(-ll), 2).alias("g2"),
        F.round(o11 / W - o21 / F.nullif(N - W, F.lit(0)), 4).alias("delta_p_fwd"), F.round(o11 / fc - o12 / F.nullif(N - fc, F.lit(0)), 4).alias("delta_p_bwd"),
    )


def focus(tok: DataFrame, hits: DataFrame, form: str, span: int = 1, width: int = 4, column: str = "lemma_key") -> DataFrame:
    """Hits with the form in their window, and how many times; the marks sum up to the collocate's co-occurrences."""
    t = tok.where(~F.coalesce("pos1", F.lit("")).isin(*PUNCT) & (F.col(column) == form)).select(*KEYS)
    offs = [k for k in range(-width, span + width) if not 0 <= k < span]
    at = few(t.select("work_stem", "vol_no", "sent", F.explode(F.array(*(F.col("i") - k for k in offs))).alias("i")))
    return hits.join(at.groupBy(*KEYS).agg(F.count("*").alias("marks")), KEYS)


def variants(tok: DataFrame, hits: DataFrame, group: DataFrame | None = None, span: int = 1, top: int = 12) -> DataFrame:
    """Spellings (orthBase sequences) of the hits by group: the ``top`` most frequent, all others as one.  Hits that
    carry ``orthbase`` need no join for their first token."""
    out = hits.select(*KEYS, F.col("orthbase").alias("o0")) if "orthbase" in hits.columns else hits.select(*KEYS)
    for k in range("orthbase" in hits.columns, span):
        out = out.join(tok.select("work_stem", "vol_no", "sent", (F.col("i") - k).alias("i"), F.col("orthbase").alias(f"o{k}")), KEYS)
    out = out.withColumn("spelling", F.concat_ws(" ", *(f"o{k}" for k in range(span)))).groupBy("work_stem", "spelling").agg(F.count("*").alias("n"))
    best = out.groupBy("spelling").agg(F.sum("n").alias("c")).orderBy(F.desc("c"), "spelling").limit(top).select("spelling", F.lit(True).alias("best"))
    out = out.join(F.broadcast(best), "spelling", "left").withColumn("spelling", F.when(F.col("best"), F.col("spelling")).otherwise("(other)"))  # ``top`` rows
    if group is None:
        return out.groupBy("spelling").agg(F.sum("n").alias("n"))
    g = group.columns[-1]
    return out.join(group, "work_stem", "left").groupBy(g, "spelling").agg(F.sum("n").alias("n"))


VARIANT_ORDERS = {"minor": ("minor_share", "total"), "types": ("types", "minor_share", "total"), "freq": ("total", "minor_share")}


def variant_table(tok: DataFrame, min_types: int = 2, min_var: int = 2, min_freq: int = 10) -> DataFrame:
    """Lemmas with several spellings: number of valid ones (at least ``min_var`` times), total over all spellings, main
    spelling, the share of the others, and the most frequent part of speech.  ``tok`` may have counts ``n``."""
    n = F.sum("n") if "n" in tok.columns else F.count("*")
    t = tok.where("lemma_key <> '' and orthbase <> ''").groupBy(F.col("lemma_key").alias("lemma"), "orthbase", "pos1").agg(n.alias("n"))
    p = t.groupBy("lemma", "pos1").agg(F.sum("n").alias("n")).groupBy("lemma").agg(F.max(F.struct("n", "pos1")).getField("pos1").alias("pos"))
    c = t.groupBy("lemma", "orthbase").agg(F.sum("n").alias("n"))
    valid = F.col("n") >= min_var
    spellings = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(valid, F.struct((-F.col("n")).alias("k"), "orthbase")))), lambda x: x["orthbase"]), "|")
    g = c.groupBy("lemma").agg(F.count_if(valid).alias("types"), F.sum("n").alias("total"), F.max("n").alias("main_n"), spellings.alias("spellings"))
    g = g.where((F.col("types") >= min_types) & (F.col("total") >= min_freq))
    return g.join(p, "lemma").select("lemma", "types", "total", F.substring_index("spellings", "|", 1).alias("main"), F.round(1 - F.col("main_n") / F.col("total"), 6).alias("minor_share"), "spellings", "pos")


def ranked_variants(table: DataFrame, sort: str = "minor", limit: int = 100) -> DataFrame:
    """The first rows of the variant table by share of the minor spellings, number of spellings or frequency."""
    if sort not in VARIANT_ORDERS:
        raise QueryError(f"no order {sort!r}")
    return table.orderBy(*(F.desc(c) for c in VARIANT_ORDERS[sort]), "lemma").limit(limit)


def passage(tok: DataFrame, work_stem: str, vol_no: int, i: int, before: int = 50, after: int = 50) -> DataFrame:
    """The text around a token, inside its volume, widened to whole sentences."""
    v = tok.where((F.col("work_stem") == work_stem) & (F.col("vol_no") == vol_no))
    edge = v.where(F.col("i").between(i - before, i + after)).agg(F.min("sent").alias("a"), F.max("sent").alias("b"))
    return v.crossJoin(F.broadcast(edge)).where("sent between a and b").groupBy("work_stem", "vol_no", "sent").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "surface"))), lambda x: x["surface"]), "").alias("text"))


def pos_tree(tok: DataFrame) -> DataFrame:
    """Tokens by major and minor part of speech with subtotals (minor null), punctuation left out."""
    t = tok.where(~F.coalesce("pos1", F.lit("")).isin(*PUNCT)).select("pos1", F.coalesce("pos2", F.lit("")).alias("pos2"))
    return t.rollup("pos1", "pos2").agg(F.count("*").alias("n"), F.grouping_id().alias("level")).where("level < 3").select("pos1", "pos2", "n")


def kwic_text(docs: DataFrame, needle: str, width: int = 28, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every place of a plain string in untokenised texts with ``width`` characters on both sides."""
    parts = F.split(text, re.escape(needle) if re.escape(needle) == needle else "\\Q" + needle + "\\E")
    d = docs.where(F.col(text).contains(needle)).select(key, F.col(text).alias("t"), F.posexplode(F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x: F.length(x))).alias("k", "len"))
    w = Window.partitionBy(key).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("at", F.sum("len").over(w) + F.col("k") * len(needle) + 1)
    left = F.greatest(F.lit(1), F.col("at") - width)
    return d.select(key, F.col("at").cast("bigint").alias("at"), F.substring("t", left, F.col("at") - left).alias("left"), F.substring("t", F.col("at") + len(needle), F.lit(width)).alias("right"))


def result_table(rows: DataFrame, works: DataFrame, join: str = "") -> DataFrame:
    """Context rows as a table for readers: period, author, title, the three parts, and the place in the volume."""
    put = lambda c: F.replace(c, F.lit(" "), F.lit(join)).alias(c)
    return with_source(rows, works).select(F.coalesce("period", F.lit("?")).alias("period"), "author", "title", put("left"), put("key"), put("right"), "work_stem", "vol_no", "i")
