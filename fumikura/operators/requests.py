"""A concordance request as one call: parameters are clamped, every table is a lazy DataFrame over the same hits, and
counts stand before sampling and paging."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fumikura.operators import concordance as kw
from fumikura.sources.index import Index


class _Tokens:
    """What an index gives, made from a table of tokens."""

    def __init__(self, tok: DataFrame):
        self.tokens, columns = tok, [c for c in ("lemma_key", "surface", "pos1", "pos2") if c in tok.columns]
        self.forms = tok.groupBy(*columns).agg(F.count("*").alias("n"))
        self.sizes = tok.groupBy("work_stem").agg(F.count("*").alias("tokens"))
        self.works = tok.sparkSession.createDataFrame([], "work_stem string, author string, title string, year int, period string")


def clamp(value: int | None, default: int, low: int, high: int) -> int:
    return default if value is None else max(low, min(high, int(value)))


@dataclass
class Answer:
    total: DataFrame
    by_work: DataFrame
    by_period: DataFrame
    forms: DataFrame
    collocates: DataFrame
    variants: DataFrame
    rows: DataFrame
    sampled: bool


def search(
    index: Index | DataFrame, query: str, stream: str = "lemma_key", context: int | None = None, limit: int | None = None, offset: int = 0, window: int | None = None, collocates: int | None = None,
    measure: str = "g2", pos: list[str] | None = None, sample: int | None = None, seed: int = 42, sort: str = "position", focus: str | None = None, exclude_punct: bool = False, **facets: list,
) -> Answer:
    """Context 1 to 30 tokens, at most 2,000 rows a page, 200 collocates, a window up to 20.  ``facets`` are columns of
    the works with the values wanted (work_stem, author, period, genre_main, register_level ...), all combined.  An
    unknown order, measure, attribute or part of speech, or a word the corpus doesn't hold, is a ``QueryError``."""
    if measure not in kw.MEASURES:
        raise kw.QueryError(f"no measure {measure!r}")
    index = _Tokens(index) if isinstance(index, DataFrame) else index
    tok, works = index.tokens, index.works
    span = len(kw.parse(query, stream))
    context, window = clamp(context, 8, 1, 30), clamp(window, 4, 1, 20)
    kw.check(index.forms, kw.parse(query, stream))
    hits = kw.facets(kw.sort_keys(tok, query, sort, stream, exclude_punct=exclude_punct), works, **facets)
    listed = hits
    if focus:
        listed = kw.focus(tok, hits, focus, span, window).drop("marks")
        context = max(context, window)
    listed = kw.sample(listed, sample, seed) if sample else listed
    page = kw.with_source(listed, works).orderBy(*kw.order_columns(sort, seed)).offset(max(0, offset)).limit(clamp(limit, 100, 1, 2000))  # a page of results
    periods = works.select("work_stem", "period")
    by_period = kw.by_group(hits.join(periods, "work_stem", "left"), index.sizes.join(periods, "work_stem", "left").groupBy("period").agg(F.sum("tokens").alias("tokens")), "period")
    return Answer(
        total=hits.agg(F.count("*").alias("hits"), F.count_distinct("work_stem").alias("works")), by_work=kw.by_group(hits, index.sizes, "work_stem"), by_period=by_period, forms=kw.tally(hits),
        collocates=kw.collocates(tok, hits, span, window, pos=pos, column=stream, forms=index.forms).orderBy(F.desc(measure), F.desc("co"), "form").limit(clamp(collocates, 30, 1, 200)),
        variants=kw.variants(tok, hits, periods, span), rows=kw.with_source(kw.context(tok, page.select(*kw.KEYS), span, context), works), sampled=sample is not None,
    )
