"""Distances between works: z-scores, Delta, attribution, containment of texts, rank agreement."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fumikura.operators import neardup
from fumikura.plans import pairs as blocked
from fumikura.sources.stage import stage


def z_scores(rel: DataFrame, unit: str = "work_stem", zero: str = "tiny") -> DataFrame:
    """(unit, term, z) with the population deviation of each term over the units; a term that never varies gets a
    deviation of 1e-12 (tiny) or is dropped (drop)."""
    m = rel.groupBy("term").agg(F.avg("rel").alias("mu"), F.stddev_pop("rel").alias("sd"))
    m = m.where("sd > 0") if zero == "drop" else m.withColumn("sd", F.when(F.col("sd") > 0, F.col("sd")).otherwise(1e-12))
    return rel.join(F.broadcast(m), "term").select(unit, "term", ((F.col("rel") - F.col("mu")) / F.col("sd")).alias("z"))  # as many rows as terms were asked for


def _vectors(z: DataFrame, unit: str) -> DataFrame:
    return z.groupBy(unit).agg(F.transform(F.array_sort(F.collect_list(F.struct("term", "z"))), lambda x: x["z"]).alias("v"))


def pairs(v: DataFrame, unit: str, metric: str, name: str, digits: int = 9) -> DataFrame:
    """All pairs a < b of the units' vectors, by blocked products: the distance matrix is the result.  Units are works
    or sources, not tokens, and a unit's row is one vector of as many values as terms were asked for."""
    return blocked.all_pairs(stage(v, "vectors"), unit, "v", metric, name, digits)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, y: acc + y)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def delta(rel: DataFrame, unit: str = "work_stem") -> DataFrame:
    """Burrows' Delta: mean absolute difference of z-scores."""
    return pairs(_vectors(z_scores(rel, unit), unit), unit, "delta", "delta")


def cosine_delta(rel: DataFrame, unit: str = "work_stem") -> DataFrame:
    return pairs(_vectors(z_scores(rel, unit, "drop"), unit), unit, "cosine", "delta")


def nearest(dist: DataFrame, value: str) -> DataFrame:
    """(a, b, value): each unit's nearest other one in a table of pairs, ties by name."""
    both = dist.select("a", "b", value).union(dist.select("b", "a", value))
    return both.groupBy("a").agg(F.min(F.struct(value, "b")).alias("m")).select("a", F.col("m.b").alias("b"), F.col(f"m.{value}").alias(value))


def nearest_unit(z: DataFrame, metric: str = "delta", unit: str = "work_stem", digits: int = 5) -> DataFrame:
    """(a, b, value): each unit's nearest other one by its z-scores, ties by name, without a table of pairs: a block
    keeps the nearest one of every unit, and those are merged."""
    v = stage(_vectors(z, unit), "vectors")
    n = blocked.nearest(v, v, unit, "v", metric, 1, metric, digits)
    return n.groupBy(F.col("q").alias("a")).agg(F.min(F.struct(metric, "key")).alias("m")).select("a", F.col("m.key").alias("b"), F.col(f"m.{metric}").alias(metric))


def same_label_rate(nn: DataFrame, labels: DataFrame, unit: str, label: str, blanks: bool = False) -> DataFrame:
    """Share of units whose nearest one has the same label; blank labels are skipped, or count as equal labels."""
    lb = labels.select(F.col(unit).alias("u"), F.col(label).alias("l"))
    j = nn.join(lb.withColumnsRenamed({"u": "a", "l": "la"}), "a", "left").join(lb.withColumnsRenamed({"u": "b", "l": "lb"}), "b", "left")
    if not blanks:
        j = j.where("la is not null and lb is not null")
    return j.agg(F.count("*").alias("units"), F.round(F.count_if(F.col("la").eqNullSafe(F.col("lb"))) / F.nullif(F.count("*"), F.lit(0)), 6).alias("rate"))


def attribution(counts: DataFrame, authors: DataFrame, questioned: str, n: int = 100, per: float = 1e4) -> DataFrame:
    """Delta of one questioned work to every author's profile, by most frequent words, means and deviations of the
    *known* works only; with the word of the largest difference."""
    c = counts.withColumnRenamed("work_stem", "w")
    known = c.where(F.col("w") != questioned)
    top = known.groupBy("term").agg(F.sum("n").alias("all_n")).orderBy(F.desc("all_n"), "term").limit(n).select("term")
    size = c.groupBy("w").agg(F.sum("n").alias("size"))
    grid = size.crossJoin(F.broadcast(top)).join(c, ["w", "term"], "left")
    rel = grid.select("w", "term", (F.coalesce("n", F.lit(0)) * per / F.col("size")).alias("rel"))
    m = rel.where(F.col("w") != questioned).groupBy("term").agg(F.avg("rel").alias("mu"), F.stddev_pop("rel").alias("sd")).where("sd > 0")
    z = rel.join(F.broadcast(m), "term").select("w", "term", ((F.col("rel") - F.col("mu")) / F.col("sd")).alias("z"))
    prof = z.where(F.col("w") != questioned).join(authors.withColumnRenamed("work_stem", "w"), "w").where("author is not null").groupBy("author", "term").agg(F.avg("z").alias("pz"))
    q = z.where(F.col("w") == questioned).select("term", "z")
    d = F.abs(F.col("pz") - F.col("z"))
    return prof.join(F.broadcast(q), "term").groupBy("author").agg(F.round(F.avg(d), 5).alias("delta"), F.max_by("term", F.struct(F.round(d, 9), "term")).alias("strongest"))


def _rows(texts: DataFrame, key: str, shingles) -> tuple[DataFrame, neardup.Shingler]:
    sh = shingles if isinstance(shingles, neardup.Shingler) else neardup.of_column(shingles)
    return texts.select(F.col(key).cast("bigint").alias("k"), sh.column.alias("v")), sh


def similar_sets(texts: DataFrame, key: str, shingles: Column | neardup.Shingler, least: float, measure: str = "containment") -> DataFrame:
    """Pairs a < b of text classes whose shared shingles are at least ``least`` of the smaller set (containment) or of
    the union (jaccard); exact.  ``a_class`` and ``b_class`` are the numbers of copies, so copies aren't multiplied out.
    Texts without a shingle are in no pair."""
    _, p = neardup.similar(*_rows(texts, key, shingles), least, measure)
    return p.select("a", "b", "common", F.round("share", 6).alias(measure), "a_class", "b_class")


def duplicate_links(texts: DataFrame, key: str, shingles: Column | neardup.Shingler, least: float = 0.8) -> DataFrame:
    """One row per text that has shingles: its class, the copies in it, and to how many other classes it is linked by
    a Jaccard similarity of at least ``least``."""
    c, p = neardup.similar(*_rows(texts, key, shingles), least, "jaccard")
    links = p.select(F.col("a").alias("class")).union(p.select("b")).groupBy("class").agg(F.count("*").alias("links"))
    return c.join(links, "class", "left").select(F.col("k").alias(key), "class", "copies", F.coalesce("links", F.lit(0)).alias("links"))


def let(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once a row: a name used inside a lambda would be computed for each element."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def char_shingles(text: Column, k: int = 12, step: int = 6) -> Column:
    none = F.array().cast("array<string>")
    cut = lambda b: F.when(F.length(b) >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.length(b) - k + 1, F.lit(1)), F.lit(step)), lambda p: F.substring(b, p, F.lit(k)))).otherwise(none)
    return let(F.regexp_replace(text, "[\\s\\u3000]", ""), cut)


def word_shingles(words: Column, k: int = 8, step: int = 3, whole: Column | None = None) -> Column:
    """Runs of ``k`` words.  A text of fewer has none; with ``whole`` it has one of all its words, or of ``whole`` (the
    text itself) if it has no word."""
    short = F.array().cast("array<string>")
    few = lambda w: short if whole is None else F.when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array(whole))
    cut = lambda w: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1)), F.lit(step)), lambda p: F.array_join(F.slice(w, p, k), " "))).otherwise(few(w))
    return let(words, cut)


def closest_profiles(profiles: DataFrame, key: str, values: list[str]) -> DataFrame:
    """The pair of units nearest in standardised values (ties by name): the nearest other one of each, then the best."""
    m = profiles.agg(*(F.avg(v).alias(f"m_{v}") for v in values), *(F.stddev_pop(v).alias(f"s_{v}") for v in values))
    z = profiles.where(F.col(key).isNotNull()).crossJoin(F.broadcast(m)).select(key, F.array(*(F.coalesce((F.col(v) - F.col(f"m_{v}")) / F.nullif(F.col(f"s_{v}"), F.lit(0.0)), F.lit(float("nan"))) for v in values)).alias("v"))  # one row
    n = blocked.nearest(z, z, key, "v", "euclidean", 1, "dist", 6)
    return n.select(F.least("q", "key").alias("a"), F.greatest("q", "key").alias("b"), "dist").orderBy("dist", "a", "b").limit(1)


def js_divergence(dist: DataFrame, unit: str, item: str, p: str, size: int = 256, parts: int = 16) -> DataFrame:
    """Jensen-Shannon divergence in bits, 0 to 1, of all pairs of units, from rows of shares.

    An item that only one of the two has adds half its share, so only common items count: the divergence is
    1 - sum over common items of (h(p) + h(q) - h(p + q)) / 2 with h(x) = -x log2 x.  Items are dealt to parts and
    units to blocks; a task adds up one part's items over two blocks in a matrix, so an item that all units have costs
    no rows: what is shuffled is one matrix a part and pair of blocks."""
    d = dist.where((F.col(p) > 0) & F.col(unit).isNotNull()).select(F.col(unit).alias("u"), F.xxhash64(F.col(item).cast("string")).alias("x"), F.col(p).cast("double").alias("p"))
    kt = d.schema["u"].dataType.simpleString()
    blocks = max(1, -(-d.select("u").distinct().count() // size))
    g = d.groupBy(F.pmod(F.xxhash64("u"), F.lit(blocks)).cast("int").alias("blk"), F.pmod("x", F.lit(parts)).cast("int").alias("part")).agg(F.collect_list(F.struct("u", "x", "p")).alias("rows"))
    left = g.select("part", F.col("blk").alias("lb"), F.col("rows").alias("lrows"), F.explode(F.sequence("blk", F.lit(blocks - 1))).alias("blk"))
    j = left.join(g, ["part", "blk"]).select("lb", "blk", "lrows", "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def matrix(rows: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            s = rows.flatten()
            names, u = np.unique(np.array(s.field("u").to_pylist(), object), return_inverse=True)
            x, q = s.field("x").to_numpy(), s.field("p").to_numpy()
            o = np.argsort(x, kind="stable")
            return names, u[o], x[o], q[o]

        def h(z: np.ndarray) -> np.ndarray:
            return -z * np.log2(z)

        for b in batches:
            for i in range(b.num_rows):
                same = b.column("lb")[i].as_py() == b.column("blk")[i].as_py()
                (na, ua, xa, pa_), (nb, ub, xb, pb) = matrix(b.column("lrows").slice(i, 1)), matrix(b.column("rows").slice(i, 1))
                less = np.zeros((len(na), len(nb)))
                items, first = np.unique(xa, return_index=True)
                for k, (x, lo) in enumerate(zip(items, first)):
                    hi = first[k + 1] if k + 1 < len(first) else len(xa)
                    c, e = np.searchsorted(xb, x, "left"), np.searchsorted(xb, x, "right")
                    if e > c:
                        pp, qq = pa_[lo:hi, None], pb[None, c:e]
                        less[np.ix_(ua[lo:hi], ub[c:e])] += (h(pp) + h(qq) - h(pp + qq)) / 2
                r, t = (np.triu_indices(len(na), 1) if same else tuple(z.ravel() for z in np.indices(less.shape)))
                swap = na[r] > nb[t]
                yield pa.RecordBatch.from_arrays([pa.array(np.where(swap, nb[t], na[r]), b.column("lrows").type.value_type.field("u").type), pa.array(np.where(swap, na[r], nb[t]), b.column("lrows").type.value_type.field("u").type), pa.array(less[r, t])], names=["a", "b", "less"])

    s = j.mapInArrow(run, f"a {kt}, b {kt}, less double").groupBy("a", "b").agg(F.sum("less").alias("less"))
    return s.select("a", "b", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.col("less"))), 6).alias("jsd"))


def pca_scores(z: DataFrame, unit: str = "work_stem", k: int = 2) -> DataFrame:
    """Scores of the first k principal components; the sign makes each component's largest loading positive.  The
    covariance of the asked-for terms (a few hundred squared) is decomposed on the driver by MLlib."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = _vectors(z, unit).withColumn("x", array_to_vector("v"))
    model = PCA(k=k, inputCol="x", outputCol="y").fit(v)
    pc = model.pc.toArray()
    sign = [1.0 if abs(c.max()) >= abs(c.min()) else -1.0 for c in pc.T]
    y = vector_to_array(F.col("y"))
    return model.transform(v).select(unit, *(F.round(y[j] * sign[j], 6).alias(f"pc{j + 1}") for j in range(k)))


def ward_clusters(dist: DataFrame, value: str, limit: int = 500) -> DataFrame:
    """Merge steps of Ward's method (step, left, right, height, size) over at most ``limit`` units: a dendrogram is
    drawn from a small distance matrix on the driver; more units are an error, not a sample."""
    rows = dist.select("a", "b", value).limit(limit * (limit - 1) // 2 + 1).collect()
    names = sorted({r[0] for r in rows} | {r[1] for r in rows})
    if len(names) > limit:
        raise ValueError(f"more than {limit} units for a dendrogram")
    n = len(names)
    at = {x: j for j, x in enumerate(names)}
    d = np.zeros((n, n))
    for a, b, v in rows:
        d[at[a], at[b]] = d[at[b], at[a]] = float(v) ** 2
    np.fill_diagonal(d, np.inf)
    size, label, out = np.ones(n), list(names), []
    for step in range(n - 1):
        i, j = divmod(int(np.argmin(d)), n)
        i, j = min(i, j), max(i, j)
        out.append((step + 1, label[i], label[j], round(float(np.sqrt(d[i, j])), 6), int(size[i] + size[j])))
        rest = np.isfinite(d[i]) & np.isfinite(d[j])
        rest[[i, j]] = False
        new = ((size[i] + size) * d[i] + (size[j] + size) * d[j] - size * d[i, j]) / (size[i] + size[j] + size)
        d[i, rest] = d[rest, i] = new[rest]
        d[j, :] = d[:, j] = np.inf
        size[i] += size[j]
        label[i] = min(label[i], label[j])
    return dist.sparkSession.createDataFrame(out, "step int, left string, right string, height double, size int")


def rank_agreement(a: DataFrame, b: DataFrame, va: str, vb: str) -> DataFrame:
    """Spearman's correlation of two tables of pair distances over their common pairs."""
    from fumikura.operators.stats import spearman

    j = a.select("a", "b", F.col(va).alias("x")).join(b.select("a", "b", F.col(vb).alias("y")), ["a", "b"])
    return spearman(j, "x", "y")

