"""Token tables and lexical profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fumikura.functions.keys import draw_order
from fumikura.functions.text import WHITE
from fumikura.plans.blocks import halo_blocks

BLOCK = 8192
PUNCT = ("補助記号", "空白", "記号")
FEATURES = ("surface", "lemma_key", "lemma", "orthbase", "lform", "pos1", "pos2", "pos3", "pos4", "ctype", "cform", "goshu")


def lines(tsv: DataFrame, *columns: str, block: int = BLOCK) -> DataFrame:
    """Rows that are tokens or line ends, each once (repeated rows share work, volume and line number).  Rows without
    keys and broken rows are left out.  Partitioned by blocks of file lines, so a hot volume is split."""
    cols = [c for c in columns if c not in ("i", "pos1")]
    t = tsv.where("work_stem is not null and vol_no is not null and line_no is not null and (i is not null or pos1 = 'EOS')")
    t = t.select("work_stem", "vol_no", F.floor(F.col("line_no") / block).cast("int").alias("blk"), "line_no", "i", "pos1", *cols)
    t = t.repartition("work_stem", "vol_no", "blk")
    return t.groupBy("work_stem", "vol_no", "blk", "line_no").agg(*(F.first(c).alias(c) for c in ("i", "pos1", *cols)))


def tokens(tsv: DataFrame, *columns: str, sentences: bool = True, block: int = BLOCK) -> DataFrame:
    """work_stem, vol_no, i, [sent,] and the columns of every token.

    ``sent`` counts the line ends before the token in its volume: inside a block by a window, plus the line ends of
    the blocks before it (one row per block), so no task holds more than a block.
    """
    t = lines(tsv, *columns, block=block)
    if not sentences:
        return t.where("i is not null").drop("blk", "line_no")
    eos = F.when(F.col("i").isNull(), 1).otherwise(0)
    vol = ["work_stem", "vol_no"]
    t = t.withColumn("inside", F.sum(eos).over(Window.partitionBy(*vol, "blk").orderBy("line_no")))
    # line ends of the blocks before: a running sum over one row per block
    valid = tsv.where("work_stem is not null and vol_no is not null and line_no is not null").select(*vol, F.floor(F.col("line_no") / block).cast("int").alias("blk"), "line_no", "i", "pos1")
    ends = valid.where("pos1 = 'EOS' and i is null").select(*vol, "blk", "line_no").distinct().groupBy(*vol, "blk").agg(F.count("*").alias("k"))
    every = valid.where("i is not null").select(*vol, "blk").distinct().withColumn("k", F.lit(0).cast("bigint"))
    per = ends.unionByName(every).groupBy(*vol, "blk").agg(F.sum("k").alias("k"))
    before = per.select(*vol, "blk", (F.sum("k").over(Window.partitionBy(*vol).orderBy("blk")) - F.col("k")).alias("offset")).where("offset > 0")
    t = t.join(before, [*vol, "blk"], "left")
    return t.where("i is not null").withColumn("sent", (F.col("inside") + F.coalesce("offset", F.lit(0))).cast("bigint")).drop("blk", "line_no", "inside", "offset")


def nonempty(c: str) -> Column:
    x = F.col(c)
    return F.when((x != "") & (x != "*"), x)


def is_punct() -> Column:
    return F.coalesce(F.col("pos1"), F.lit("")).isin(*PUNCT)


def is_unknown() -> Column:
    """An unknown word has no lemma and is no punctuation."""
    return nonempty("lemma").isNull() & ~is_punct()


def is_content() -> Column:
    """Nouns (not numerals), verbs, adjectives, adverbs, adjectival nouns."""
    return F.col("pos1").isin("名詞", "動詞", "形容詞", "副詞", "形状詞") & (F.coalesce("pos2", F.lit("")) != "数詞")


def lemma_key(policy: str = "mixed") -> Column:
    """The key a token is counted by: surface, orthBase, lemma, or mixed (proper nouns by orthBase, else lemma); each
    falls back on the next known form, and a homograph suffix after a hyphen is dropped."""
    s, o, m = F.col("surface"), nonempty("orthbase"), nonempty("lemma")
    bare = F.regexp_replace(m, "-[\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}ー]+$", "")
    if policy == "surface":
        return s
    if policy == "orthBase":
        return F.coalesce(o, s)
    if policy == "lemma":
        return F.coalesce(bare, o, s)
    if policy == "mixed":
        return F.when(F.col("pos2") == "固有名詞", F.coalesce(o, s)).otherwise(F.coalesce(bare, o, s))
    raise ValueError(f"no lemma policy {policy}")


def pos_label() -> Column:
    return F.concat_ws("-", nonempty("pos1"), nonempty("pos2"), nonempty("pos3"))


def pos_matches(label: Column, prefix: str) -> Column:
    """Prefix match on a hyphen boundary."""
    return (label == prefix) | label.startswith(prefix + "-")


def report(tok: DataFrame) -> DataFrame:
    """Per volume: tokens, types, content tokens and types, unknown tokens and their rate among non-punctuation."""
    key = F.col("lemma_key")
    return tok.groupBy("work_stem", "vol_no").agg(
        F.count("*").alias("tokens"), F.count_distinct(key).alias("types"), F.count_if(is_content()).alias("content_tokens"),
        F.count_distinct(F.when(is_content(), key)).alias("content_types"), F.count_if(is_unknown()).alias("unknown_tokens"),
        F.round(F.count_if(is_unknown()) / F.nullif(F.count_if(~is_punct()), F.lit(0)), 6).alias("unknown_rate"),
    )


def unknown_words(tok: DataFrame, n: int = 3000) -> DataFrame:
    """The most frequent unknown words with their cumulative share (ties by word)."""
    c = tok.where(is_unknown()).groupBy("surface").agg(F.count("*").alias("freq"))
    total = c.agg(F.sum("freq").alias("total"))
    top = c.orderBy(F.desc("freq"), "surface").limit(n)  # the report is a top n
    w = Window.orderBy(F.desc("freq"), "surface")  # over n rows
    return top.crossJoin(F.broadcast(total)).select("surface", "freq", F.row_number().over(w).alias("rank"), F.round(F.sum("freq").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.col("total"), 6).alias("cum_share"))


def counts(tok: DataFrame, *by: str, term: str = "lemma_key") -> DataFrame:
    return tok.where(F.col(term) != "").groupBy(*by, F.col(term).alias("term")).agg(F.count("*").alias("n"))


def profile(tok: DataFrame, *by: str) -> DataFrame:
    """tokens, types, ttr, Guiraud's R, Yule's K, entropy in bits, hapax ratio over types."""
    c = counts(tok, *by)
    c = c.join(c.groupBy(*by).agg(F.sum("n").alias("N_")), list(by))
    n, t = F.col("n"), F.max("N_")
    return c.groupBy(*by).agg(
        t.alias("tokens"), F.count("*").alias("types"), F.round(F.count("*") / t, 6).alias("ttr"), F.round(F.count("*") / F.sqrt(t), 6).alias("guiraud_r"),
        F.round(F.lit(1e4) * (F.sum(n * n) - t) / (t * t), 6).alias("yule_k"), F.round(-F.sum(n / F.col("N_") * F.log2(n / F.col("N_"))), 6).alias("entropy_bits"),
        F.round(F.count_if(n == 1) / F.count("*"), 6).alias("hapax_ratio"),
    )


def mfw(tok: DataFrame, n: int = 300, where: Column | None = None) -> DataFrame:
    """The n most frequent terms, ties by term."""
    c = counts(tok if where is None else tok.where(where))
    return c.orderBy(F.desc("n"), "term").limit(n)


def relative_frequencies(tok: DataFrame, n: int = 300, unit: str = "work_stem") -> DataFrame:
    """Long matrix of units x most frequent terms, zeros included: the grid has units times n rows by definition."""
    from fumikura.sources.stage import stage

    c = stage(counts(tok, unit), "counts")  # read three times
    size = c.groupBy(unit).agg(F.sum("n").alias("total"))
    top = c.groupBy("term").agg(F.sum("n").alias("all_n")).orderBy(F.desc("all_n"), "term").limit(n)
    grid = size.crossJoin(F.broadcast(top.select("term")))  # n terms
    return grid.join(c, [unit, "term"], "left").select(unit, "term", (F.coalesce("n", F.lit(0)) / F.col("total")).alias("rel"))


def chunks(tok: DataFrame, size: int = 500, least: int | None = None) -> DataFrame:
    """Pieces of ``size`` content tokens per work; a trailing piece below ``least`` (half the size) is dropped.

    Positions come from counts: rank inside blocks of 4096 token numbers plus the counts of the blocks before.
    """
    least = size // 2 if least is None else least
    c = tok.where(is_content() & (F.col("lemma_key") != "")).withColumn("b", F.floor((F.col("i") - 1) / 4096))
    per = c.groupBy("work_stem", "vol_no", "b").agg(F.count("*").alias("k"))
    before = per.withColumn("before", F.coalesce(F.sum("k").over(Window.partitionBy("work_stem").orderBy("vol_no", "b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("k")
    rank = F.col("before") + F.row_number().over(Window.partitionBy("work_stem", "vol_no", "b").orderBy("i")) - 1
    c = c.join(before, ["work_stem", "vol_no", "b"]).withColumn("rank", rank)
    return c.groupBy("work_stem", F.floor(F.col("rank") / size).alias("chunk_no")).agg(F.count("*").alias("chunk_tokens"), F.array_sort(F.collect_list(F.struct("rank", "lemma_key"))).alias("toks")).where(F.col("chunk_tokens") >= least).select("work_stem", "chunk_no", "chunk_tokens", F.col("toks.lemma_key").alias("terms"))


def cap_chunks(index: DataFrame, most: int, how: str = "spread", seed: int = 42) -> DataFrame:
    """At most ``most`` chunks of each work: head, spread (evenly spaced), random or stratified (one of each stratum),
    the last two by a hash of seed, work and chunk, so one work's draw never depends on others.

    ``index`` has (work_stem, chunk_no) with chunks numbered from 0."""
    n = index.groupBy("work_stem").agg(F.count("*").alias("n_chunks"))
    j = index.join(n, "work_stem")
    h = draw_order(seed, "work_stem", "chunk_no")
    few = F.col("n_chunks") <= most
    if how == "head":
        return j.where(few | (F.col("chunk_no") < most)).drop("n_chunks")
    if how == "spread":  # chunk_no is one of floor(k * n / most)
        k = F.ceil(F.col("chunk_no") * most / F.col("n_chunks"))
        return j.where(few | ((F.floor(k * F.col("n_chunks") / most) == F.col("chunk_no")) & (k < most))).drop("n_chunks")
    if how == "random":
        w = Window.partitionBy("work_stem").orderBy(h, "chunk_no")
        return j.withColumn("r", F.row_number().over(w)).where(few | (F.col("r") <= most)).drop("n_chunks", "r")
    if how == "stratified":  # stratum s holds floor(s n / most) <= chunk_no < floor((s + 1) n / most)
        s = F.floor(((F.col("chunk_no") + 1) * most - 1) / F.col("n_chunks"))
        w = Window.partitionBy("work_stem", "s").orderBy(h, "chunk_no")
        return j.withColumn("s", s).withColumn("r", F.row_number().over(w)).where(few | (F.col("r") == 1)).drop("n_chunks", "s", "r")
    raise ValueError(f"no way to cap chunks: {how}")


def marker_hits(terms: Column, markers: list[str], longest: int = 4) -> Column:
    """How often a marker begins at a token of an array: the shortest concatenation of up to ``longest`` tokens that is one."""
    m = F.array(*map(F.lit, markers))
    at = lambda i: F.exists(F.sequence(F.lit(1), F.lit(longest)), lambda k: F.array_contains(m, F.array_join(F.slice(terms, i, k), "")))
    return F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size(terms), F.lit(1))), at))


def marker_counts(tok: DataFrame, markers: dict[str, tuple[str, ...]], longest: int = 4, block: int = 8192) -> DataFrame:
    """work_stem, tokens and, for each list of markers, how often one begins at a token: a concatenation of up to
    ``longest`` tokens of the volume is one (a token counts once, whatever its concatenations are).

    Blocks of positions overlap by what is looked ahead, so no task holds more than a block of a volume."""
    e = tok.select("work_stem", "vol_no", "i", F.coalesce("surface", F.lit("")).alias("s"), F.explode(halo_blocks(F.col("i") - 1, block, longest)).alias("blk"))
    w = Window.partitionBy("work_stem", "vol_no", "blk").orderBy("i")
    ahead = [F.col("s"), *(F.lead("s", k).over(w) for k in range(1, longest))]
    e = e.select("work_stem", "i", "blk", *(F.concat(*ahead[: k + 1]).alias(f"c{k}") for k in range(longest))).where(F.col("blk") == F.floor((F.col("i") - 1) / block))
    begins = lambda words: F.greatest(*(F.coalesce(F.col(f"c{k}").isin(*words), F.lit(False)) for k in range(longest)))
    return e.groupBy("work_stem").agg(F.count("*").alias("tokens"), *(F.count_if(begins(words)).alias(n) for n, words in markers.items()))


def char_ratios(text: Column) -> dict[str, Column]:
    """Shares of character classes over the characters that are no white space, and counts of marks."""
    count = lambda x, p: F.length(F.regexp_replace(x, p, ""))
    body = F.regexp_replace(text, WHITE, "")
    n = F.greatest(F.length(body), F.lit(1))
    ratios = {"kanji_ratio": "[^一-鿿㐀-䶿]", "katakana_ratio": "[^゠-ヿ]"}
    counts = {"latin_chars": "[^A-Za-zＡ-Ｚａ-ｚ]", "digits": "[^0-9０-９]", "kana_repeat": "[^ゝゞヽヾ]", "kanji_repeat": "[^々]", "gaiji_lost": "[^※]", "ditto_mark": "[^〃]"}
    return {"chars": F.length(body)} | {k: F.round(count(body, p) / n, 4) for k, p in ratios.items()} | {k: count(text, p) for k, p in counts.items()}


def katakana_runs(tok: DataFrame, block: int = 8192) -> DataFrame:
    """work_stem, vol_no, sent, first, parts, run: two or more known katakana tokens in a row in a sentence: a compound,
    or a word that was cut by force.

    Runs are found inside blocks of positions; only the ones that touch a block's border, two a block at most, are put
    together over the volume."""
    t = tok.where(F.col("surface").rlike("^[\\u30a1-\\u30faー]+$") & ~is_unknown() & ~is_punct())
    t = t.select("work_stem", "vol_no", "sent", "i", "surface", F.floor((F.col("i") - 1) / block).alias("blk"))
    vol = ["work_stem", "vol_no", "sent"]
    t = t.withColumn("island", F.col("i") - F.row_number().over(Window.partitionBy(*vol, "blk").orderBy("i")))
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", c))), lambda x: x[c]), "|").alias("run")
    r = t.withColumn("first", F.col("i")).groupBy(*vol, "blk", "island").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.count("*").alias("parts"), text("surface")).drop("island")
    edge = (F.col("first") == F.col("blk") * block + 1) | (F.col("last") == (F.col("blk") + 1) * block)
    w = Window.partitionBy(*vol).orderBy("first")
    e = r.where(edge).withColumn("new", F.when(F.lag("last").over(w) == F.col("first") - 1, 0).otherwise(1))
    e = e.withColumn("chain", F.sum("new").over(w)).groupBy(*vol, "chain").agg(text("run"), F.min("first").alias("first"), F.sum("parts").alias("parts"))
    cols = [*vol, "first", "parts", "run"]
    return r.where(~edge).select(*cols).unionByName(e.select(*cols)).where("parts > 1")


def segmentation_stats(tok: DataFrame, by: str = "work_stem") -> DataFrame:
    """tokens, unknown ones and their rate, mean length, share of tokens of one letter, of nouns, verbs and
    auxiliaries, punctuation left out."""
    t = tok.where(~is_punct())
    n = F.count("*")
    share = lambda c: F.round(F.count_if(c) / n, 5)
    pos = lambda p: share(F.coalesce(F.col("pos1") == p, F.lit(False)))
    unknown = nonempty("lemma").isNull()
    return t.groupBy(by).agg(
        n.alias("tokens"), F.count_if(unknown).alias("unknown"), share(unknown).alias("unknown_rate"), F.round(F.avg(F.length("surface")), 5).alias("mean_len"), share(F.length("surface") == 1).alias("len1_rate"),
        pos("名詞").alias("noun_rate"), pos("動詞").alias("verb_rate"), pos("助動詞").alias("aux_rate"),
    )
