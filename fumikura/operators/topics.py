"""Topic tables: theta (chunk, topic, p) and phi (topic, term, n), fitted, read or given, and what is made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fumikura.operators.stats import with_rank
from fumikura.operators.stylometry import js_divergence, pairs


def without_stopwords(chunks: DataFrame, stop: DataFrame) -> DataFrame:
    """(chunk, terms) without the terms of a list (term); chunks that keep none stay, with no term.  The list is joined
    to the distinct terms, so it may be of any size."""
    e = chunks.select("chunk", F.posexplode_outer("terms").alias("p", "term"))
    kept = e.join(stop.select("term").distinct(), "term", "left_anti")
    g = kept.groupBy("chunk").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("term").isNotNull(), F.struct("p", "term")))), lambda x: x["term"]).alias("terms"))
    return chunks.select("chunk").join(g, "chunk", "left").select("chunk", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))


def training_record(stop: DataFrame, **parameters) -> dict:
    """What a model was trained with: the parameters, and the stop list's size and digest (whatever its order)."""
    h = F.sha1("term")
    quarter = lambda k: F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("decimal(38,0)")
    row = stop.select("term").distinct().agg(F.count("*").alias("n"), *(F.coalesce(F.sum(quarter(k)), F.lit(0)).cast("string").alias(f"d{k}") for k in range(5))).first()
    return {**parameters, "stop_words": row["n"], "stop_digest": "-".join(row[f"d{k}"] for k in range(5))}


def fit_lda(chunks: DataFrame, k: int = 10, seed: int = 1, max_iter: int = 20) -> tuple[DataFrame, DataFrame]:
    """theta (chunk, topic, p) and phi (topic, term, weight) by MLlib's LDA over (chunk, terms).  Expectation
    maximisation passes over all chunks in each iteration (the online optimizer draws its batches with replacement, so
    even whole ones leave chunks out), and every term is in the vocabulary.  The reference estimator is Gibbs sampling,
    so results are compared by properties."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer
    from pyspark.ml.functions import vector_to_array

    cv = CountVectorizer(inputCol="terms", outputCol="x", vocabSize=2**31 - 1, minDF=1).fit(chunks)
    d = cv.transform(chunks)
    m = LDA(k=k, seed=seed, maxIter=max_iter, optimizer="em", featuresCol="x").fit(d)
    theta = m.transform(d).select("chunk", F.posexplode(vector_to_array("topicDistribution")).alias("topic", "p"))
    words = chunks.sparkSession.createDataFrame(list(enumerate(cv.vocabulary)), "i int, term string")
    phi = m.describeTopics(len(cv.vocabulary)).select("topic", F.explode(F.arrays_zip("termIndices", "termWeights")).alias("z"))
    return theta, phi.select("topic", F.col("z.termIndices").alias("i"), F.col("z.termWeights").alias("weight")).join(words, "i").select("topic", "term", "weight")


def read_doc_topics(lines: DataFrame, value: str = "value") -> DataFrame:
    """(chunk, topic, p) from lines of a number, a path and either one share per topic or pairs of topic and share;
    lines that begin with # are comments.  Pairs are told from shares by a whole number in the first place."""
    p = F.split(F.trim(F.col(value)), "\\s+")
    d = lines.where(~F.col(value).startswith("#") & (F.trim(F.col(value)) != "")).select(F.get(p, F.lit(1)).alias("chunk"), F.slice(p, 3, 1_000_000).alias("v"))
    paired = F.get("v", F.lit(0)).rlike("^[0-9]+$") & (F.size("v") % 2 == 0)
    dense = F.transform("v", lambda x, i: F.struct(i.cast("int").alias("topic"), x.cast("double").alias("p")))
    sparse = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size("v") / 2).cast("int") - 1, F.lit(0))), lambda j: F.struct(F.get("v", j * 2).try_cast("int").alias("topic"), F.get("v", j * 2 + 1).try_cast("double").alias("p")))
    return d.select("chunk", F.explode(F.when(paired, sparse).otherwise(dense)).alias("z")).select("chunk", "z.topic", "z.p")


def read_word_topics(lines: DataFrame, value: str = "value") -> DataFrame:
    """(topic, term, n) from lines of a number, a word and pairs topic:count."""
    p = F.split(F.trim(F.col(value)), "\\s+")
    d = lines.where(F.trim(F.col(value)) != "").select(F.get(p, F.lit(1)).alias("term"), F.explode(F.slice(p, 3, 1_000_000)).alias("tc"))
    return d.select(F.substring_index("tc", ":", 1).cast("int").alias("topic"), "term", F.substring_index("tc", ":", -1).cast("bigint").alias("n"))


def read_topic_keys(lines: DataFrame, value: str = "value") -> DataFrame:
    """(topic, alpha, words) from lines of topic, weight and its words, separated by tabs; other lines are left out."""
    p = F.split(F.col(value), "\t")
    d = lines.where(F.size(p) >= 3).select(F.get(p, F.lit(0)).try_cast("int").alias("topic"), F.get(p, F.lit(1)).try_cast("double").alias("alpha"), F.filter(F.split(F.get(p, F.lit(2)), " "), lambda w: w != "").alias("words"))
    return d.where("topic is not null")


def read_diagnostics(xml: DataFrame, names: tuple[str, ...] = ("coherence", "exclusivity", "effective_words"), value: str = "value") -> DataFrame:
    """(topic, one column a name) from the attributes of the topic elements of diagnostics documents."""
    tag = xml.select(F.explode(F.regexp_extract_all(value, F.lit("<topic\\b([^>]*)>"), F.lit(1))).alias("a"))
    cell = lambda n: F.nullif(F.regexp_extract("a", f"\\b{n}=[\"']([^\"']*)[\"']", 1), F.lit(""))
    return tag.select(cell("id").try_cast("int").alias("topic"), *(cell(n.replace("_", "[_-]")).try_cast("double").alias(n) for n in names)).where("topic is not null")


def mean_theta(theta: DataFrame, attributes: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """Mean share per topic, or per attribute value and topic (blank values left out), with the chunks it rests on."""
    if by is None:
        return theta.groupBy("topic").agg(F.round(F.avg("p"), 6).alias("mean"), F.count("*").alias("chunks"))
    j = theta.join(attributes.select("chunk", by), "chunk").where(F.col(by).isNotNull() & (F.col(by) != ""))
    return j.groupBy(by, "topic").agg(F.round(F.avg("p"), 6).alias("mean"), F.count("*").alias("chunks"))


def lift(theta: DataFrame, attributes: DataFrame, by: str, k: int = 3) -> DataFrame:
    """The k topics of each group whose mean share is most above the overall mean."""
    g = theta.join(attributes.select("chunk", by), "chunk").where(F.col(by).isNotNull()).groupBy(by, "topic").agg(F.avg("p").alias("m"))
    o = theta.groupBy("topic").agg(F.avg("p").alias("o"))
    j = g.join(F.broadcast(o), "topic").withColumn("lift", F.round(F.col("m") / F.nullif(F.col("o"), F.lit(0.0)), 6))
    w = Window.partitionBy(by).orderBy(F.desc("lift"), "topic")
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(by, "topic", "lift", "rank")


def relevance(phi: DataFrame, lam: float = 0.6, k: int = 10, least: int = 3) -> DataFrame:
    """The k most relevant terms of each topic: lam ln p(w|t) + (1 - lam) ln (p(w|t) / p(w)); and the kept mass."""
    t = phi.groupBy("topic").agg(F.sum("n").alias("nt"))
    w = phi.groupBy("term").agg(F.sum("n").alias("nw"))
    total = t.agg(F.sum("nt").alias("total"))
    j = phi.where(F.col("n") >= least).join(F.broadcast(t), "topic").join(w, "term").crossJoin(F.broadcast(total))
    p, q = F.col("n") / F.col("nt"), F.col("nw") / F.col("total")
    j = j.select("topic", "term", "n", F.round(lam * F.ln(p) + (1 - lam) * F.ln(p / q), 6).alias("relevance"), p.alias("p"))
    r = Window.partitionBy("topic").orderBy(F.desc("relevance"), "term")
    j = j.withColumn("rank", F.row_number().over(r)).where(F.col("rank") <= k)
    return j.withColumn("kept_mass", F.round(F.sum("p").over(Window.partitionBy("topic")), 6)).drop("p")


def vectors(table: DataFrame, unit: str, item: str, value: str) -> DataFrame:
    """Dense vectors over all items, zeros included; for topics over a vocabulary of bounded size."""
    items = table.select(item).distinct()
    grid = table.select(unit).distinct().crossJoin(F.broadcast(items)).join(table, [unit, item], "left")
    return grid.groupBy(unit).agg(F.transform(F.array_sort(F.collect_list(F.struct(item, F.coalesce(value, F.lit(0.0)).cast("double").alias("z")))), lambda x: x["z"]).alias("v"))


def relatedness(theta: DataFrame, phi: DataFrame, top: int = 500) -> DataFrame:
    """Pairs of topics: cosine distance of term shares, Delta and Cosine Delta over the ``top`` terms (z over topics,
    sample deviation), Jensen-Shannon divergence over all terms, correlation of centred log shares over chunks."""
    t = phi.groupBy("topic").agg(F.sum("n").alias("nt"))
    best = phi.groupBy("term").agg(F.sum("n").alias("c")).orderBy(F.desc("c"), "term").limit(top).select("term")
    rel = phi.join(F.broadcast(best), "term").join(F.broadcast(t), "topic").select("topic", "term", (F.col("n") / F.col("nt")).alias("rel"))
    full = t.select("topic").crossJoin(F.broadcast(best)).join(rel, ["topic", "term"], "left").na.fill({"rel": 0.0})
    m = full.groupBy("term").agg(F.avg("rel").alias("mu"), F.stddev_samp("rel").alias("sd"))
    z = full.join(F.broadcast(m), "term").select("topic", "term", F.col("rel"), ((F.col("rel") - F.col("mu")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)).alias("z"))
    cos = pairs(vectors(z, "topic", "term", "rel"), "topic", "cosine", "cosine", 5)
    dlt = pairs(vectors(z, "topic", "term", "z"), "topic", "delta", "delta", 5)
    lg = F.ln(F.col("p") + 1e-12)
    c = theta.withColumn("c", lg).join(theta.groupBy("chunk").agg(F.avg(lg).alias("g")), "chunk").select("chunk", "topic", (F.col("c") - F.col("g")).alias("c"))
    cc = c.alias("x").join(c.alias("y"), "chunk").where("x.topic < y.topic").groupBy(F.col("x.topic").alias("a"), F.col("y.topic").alias("b"))
    cc = cc.agg(F.round(F.covar_pop("x.c", "y.c") / F.nullif(F.stddev_pop("x.c") * F.stddev_pop("y.c"), F.lit(0.0)), 5).alias("clr_corr"))
    cdl = pairs(vectors(z, "topic", "term", "z"), "topic", "cosine", "cosine_delta", 5)
    jsd = js_divergence(phi.join(F.broadcast(t), "topic").select("topic", "term", (F.col("n") / F.col("nt")).alias("p")), "topic", "term", "p")
    return cos.join(dlt, ["a", "b"]).join(cdl, ["a", "b"]).join(jsd, ["a", "b"]).join(cc, ["a", "b"])


def shares_of_works(theta: DataFrame, work: Column) -> DataFrame:
    """P(topic|work) and P(work|topic), and whether a work holds more than half of a topic."""
    g = theta.groupBy(work.alias("work"), "topic").agg(F.sum("p").alias("s"))
    a, b = g.groupBy("work").agg(F.sum("s").alias("sw")), g.groupBy("topic").agg(F.sum("s").alias("st"))
    j = g.join(a, "work").join(F.broadcast(b), "topic")
    share = F.col("s") / F.nullif(F.col("st"), F.lit(0.0))
    return j.select("work", "topic", F.round(F.col("s") / F.nullif(F.col("sw"), F.lit(0.0)), 6).alias("topic_in_work"), F.round(share, 6).alias("work_in_topic"), (share > 0.5).alias("concentrated"))


def author_mass(theta: DataFrame, authors: DataFrame) -> DataFrame:
    """Share of each topic that each author's chunks hold, and whether it is more than half; ``authors`` (chunk, author),
    chunks without one are left out."""
    g = theta.join(authors.where("author is not null"), "chunk").groupBy("topic", "author").agg(F.sum("p").alias("s"))
    t = g.groupBy("topic").agg(F.sum("s").alias("st"))
    share = F.col("s") / F.nullif(F.col("st"), F.lit(0.0))
    return g.join(F.broadcast(t), "topic").select("topic", "author", F.round(share, 6).alias("share"), (share > 0.5).alias("concentrated"))  # a row a topic


def entropy(theta: DataFrame) -> DataFrame:
    """Entropy of each chunk's shares in nats."""
    return theta.groupBy("chunk").agg(F.round(-F.sum(F.col("p") * F.ln(F.col("p") + 1e-12)), 6).alias("entropy"))


def similarity_graph(sim: DataFrame, value: str, k: int = 2, keep: float = 1.0) -> DataFrame:
    """Edges a < b from each node's k most similar others, weighted by the rank of the pair among all pairs; only
    the best ``keep`` part of the edges stays.  Nodes are topics or works."""
    both = sim.select("a", "b", value).union(sim.select("b", "a", value))
    w = Window.partitionBy("a").orderBy(F.desc(value), "b")
    top = both.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    edges = top.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    last = with_rank(sim.where(F.col(value).isNotNull()), value)
    ranked = last.withColumn("weight", F.round((F.col("below") + F.col("equal")) / F.col("all"), 6))
    return ranked.join(edges, ["a", "b"]).where(F.col("weight") >= 1 - keep).select("a", "b", "weight")


def bipartite(theta_work: DataFrame, k: int = 3, least: float = 0.05) -> DataFrame:
    """(work, topic, share): each work's k largest topics of at least that share."""
    w = Window.partitionBy("work").orderBy(F.desc("topic_in_work"), "topic")
    return theta_work.withColumn("r", F.row_number().over(w)).where((F.col("r") <= k) & (F.col("topic_in_work") >= least)).select("work", "topic", F.col("topic_in_work").alias("share"))


def communities(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, community, size): weighted label propagation with ties to the smaller label, until no node
    has a label with more weight around it than its own; a random half of the nodes may move in a round, so pairs don't
    swap their labels for ever.  Communities are numbered by size.  Labels that still change after ``rounds`` rounds are an error.  Each round joins
    edges with labels; lineage is cut by a written table, so it scales with the edges."""
    from fumikura.sources.stage import stage

    edges = stage(edges.select("a", "b", "weight"), "edges")
    e = edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").union(edges.select("b", "a", "weight"))
    lab = stage(e.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    for k in range(rounds):
        votes = e.join(lab, e["dst"] == lab["node"]).groupBy("src", "label").agg(F.round(F.sum("weight"), 9).alias("w"))
        own = lab.select(F.col("node").alias("src"), F.col("label").alias("mine"))
        g = votes.join(own, "src").groupBy("src", "mine").agg(F.max_by("label", F.struct("w", -F.col("label"))).alias("best"), F.max("w").alias("top"), F.coalesce(F.max(F.when(F.col("label") == F.col("mine"), F.col("w"))), F.lit(0.0)).alias("held"))
        better = F.col("top") > F.col("held")
        moves = F.pmod(F.xxhash64("src", F.lit(k)), F.lit(2)) == 0
        new = stage(g.select(F.col("src").alias("node"), F.when(better & moves, F.col("best")).otherwise(F.col("mine")).alias("label"), better.alias("better")), "labels")
        lab = new.select("node", "label")
        if new.where("better").isEmpty():
            break
    else:
        raise ValueError(f"labels still change after {rounds} rounds")
    size = lab.groupBy("label").agg(F.count("*").alias("n"))
    no = size.withColumn("community", F.row_number().over(Window.orderBy(F.desc("n"), "label")) - 1)  # one row per community
    return lab.join(F.broadcast(no), "label").select("node", "community", F.col("n").alias("size"))


def profiles(theta: DataFrame, attributes: DataFrame, by: str, phi: DataFrame) -> DataFrame:
    """Per topic: peak group, its ratio to the mean over groups, variation over groups, and a label of the two most
    relevant words with the peak if it stands out."""
    g = theta.join(attributes.select("chunk", by), "chunk").where(F.col(by).isNotNull()).groupBy("topic", by).agg(F.avg("p").alias("m"))
    p = g.groupBy("topic").agg(F.max_by(by, F.struct(F.round("m", 9), F.col(by))).alias("peak"), F.round(F.max("m") / F.avg("m"), 4).alias("peak_ratio"), F.round(F.stddev_pop("m"), 6).alias("variation"))
    w = relevance(phi, 0.6, 2).groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), "・").alias("words"))
    j = p.join(w, "topic", "left")
    return j.select("*", F.concat(F.coalesce("words", F.lit("")), F.when(F.col("peak_ratio") >= 1.3, F.concat(F.lit(" ["), F.col("peak"), F.lit("]"))).otherwise("")).alias("label"))


def representative(theta: DataFrame, k: int = 5) -> DataFrame:
    w = Window.partitionBy("topic").orderBy(F.desc(F.round("p", 9)), "chunk")
    return theta.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("topic", "rank", "chunk", F.round("p", 6).alias("p"))


def term_profile(phi: DataFrame, k: int = 10) -> DataFrame:
    """Per topic: exclusivity (mean over its k most frequent terms of the topic's part of the term's shares in all
    topics), effective words (1 / sum of squared shares) and the divergence from the corpus (sum p ln p / q)."""
    t = phi.groupBy("topic").agg(F.sum("n").alias("nt"))
    p = phi.join(F.broadcast(t), "topic").select("topic", "term", "n", (F.col("n") / F.col("nt")).alias("p"))  # a row a topic
    total = t.agg(F.sum("nt").alias("total"))
    w = p.groupBy("term").agg(F.sum("p").alias("all_p"), F.sum("n").alias("nw"))
    r = Window.partitionBy("topic").orderBy(F.desc("n"), "term")
    j = p.join(w, "term").crossJoin(F.broadcast(total)).withColumn("r", F.row_number().over(r))  # one row
    q = F.col("nw") / F.col("total")
    return j.groupBy("topic").agg(F.round(F.avg(F.when(F.col("r") <= k, F.col("p") / F.col("all_p"))), 6).alias("exclusivity"), F.round(1 / F.sum(F.col("p") * F.col("p")), 4).alias("effective_words"), F.round(F.sum(F.col("p") * F.ln(F.col("p") / q)), 6).alias("corpus_dist"))


def sweep(chunks: DataFrame, ks: list[int], seed: int = 1, max_iter: int = 10, top: int = 10) -> DataFrame:
    """k, coherence, exclusivity: means over the topics of a model for each number of topics.  Weights of the fitted
    models take the place of counts."""
    out = None
    for k in ks:
        _, phi = fit_lda(chunks, k, seed, max_iter)
        phi = phi.withColumnRenamed("weight", "n")
        m = coherence(phi, chunks, top).agg(F.round(F.avg("coherence"), 4).alias("coherence")).crossJoin(term_profile(phi, top).agg(F.round(F.avg("exclusivity"), 4).alias("exclusivity")))  # one row each
        m = m.select(F.lit(k).alias("k"), "coherence", "exclusivity")
        out = m if out is None else out.union(m)
    return out


def chosen_terms(phi: DataFrame, lexicon: DataFrame, least: int = 1, pos: list[str] | None = None, max_docs: float = 1.0, max_work_share: float = 1.0, max_dp: float = 1.0) -> DataFrame:
    """Rows of phi whose term passes the filters: frequency in the corpus, part of speech, share of the works that have
    it, share of its largest work, dispersion.  Filters are strict, a term the lexicon lacks is left out."""
    works = lexicon.agg(F.max("docs").alias("most"))
    lx = lexicon.crossJoin(F.broadcast(works)).where((F.col("count") >= least) & (F.col("docs") / F.col("most") <= max_docs) & (F.col("top_work_share") <= max_work_share) & (F.col("dp") <= max_dp))  # one row
    if pos:
        fits = F.lit(False)
        for x in pos:
            fits = fits | (F.col("pos") == x) | F.startswith(F.col("pos"), F.lit(f"{x}-"))
        lx = lx.where(fits)
    return phi.join(lx.select("term"), "term", "left_semi")


def coherence(phi: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """UMass coherence of each topic's k most frequent terms over chunk co-occurrence."""
    w = Window.partitionBy("topic").orderBy(F.desc("n"), "term")
    top = phi.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("topic", "term", "r")
    d = chunks.select("chunk", F.explode(F.array_distinct("terms")).alias("term")).join(F.broadcast(top.select("term").distinct()), "term")  # topics times k terms
    df = d.groupBy("term").agg(F.count("*").alias("df"))
    co = d.alias("x").join(d.alias("y"), "chunk").where("x.term <> y.term").groupBy(F.col("x.term").alias("t1"), F.col("y.term").alias("t2")).agg(F.count("*").alias("co"))
    pr = top.alias("p").join(top.alias("q"), "topic").where("p.r > q.r").select("topic", F.col("p.term").alias("t1"), F.col("q.term").alias("t2"))
    j = pr.join(co, ["t1", "t2"], "left").join(df.withColumnsRenamed({"term": "t2"}), "t2")
    return j.groupBy("topic").agg(F.round(F.sum(F.ln((F.coalesce("co", F.lit(0)) + 1) / F.col("df"))), 4).alias("coherence"))


def fingerprint(phi: DataFrame) -> DataFrame:
    """One fingerprint of a model's rows, whatever their order: the sums of the four quarters of the rows' MD5, so two
    models agree by chance once in more than 2^128 times."""
    h = F.md5(F.concat_ws("|", "topic", "term", "n"))
    quarter = lambda k: F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("decimal(38,0)")
    return phi.agg(F.concat_ws("-", *(F.sum(quarter(k)).cast("string") for k in range(4))).alias("fingerprint"), F.count("*").alias("rows"))


def modularity(edges: DataFrame, found: DataFrame) -> DataFrame:
    """Weighted modularity of communities (node, community): the share of weight inside them less what chance gives."""
    c = found.select("node", "community")
    e = edges.join(c.withColumnsRenamed({"node": "a", "community": "ca"}), "a").join(c.withColumnsRenamed({"node": "b", "community": "cb"}), "b")
    ends = e.select(F.col("ca").alias("c"), "weight").union(e.select("cb", "weight")).groupBy("c").agg(F.sum("weight").alias("k"))
    m = e.agg(F.sum("weight").alias("m"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)).alias("inside"))
    return ends.agg(F.sum(F.col("k") * F.col("k")).alias("kk"), F.count("*").alias("communities")).crossJoin(m).select("communities", F.round(F.col("inside") / F.col("m") - F.col("kk") / (4 * F.col("m") * F.col("m")), 6).alias("modularity"))  # one row each
