"""Problem 3: a sample that matches target proportions.

Method: systematic unequal-probability sampling.  Works are counted by cell (the combination of the categories);
inclusion probabilities are raked on the cells so that the targets' shares are met as nearly as the cells allow,
and the sample size exactly.  Works stand in the order of their cell and, inside it, of a hash (a random order);
the probabilities are summed up along that order - within ranges of it in parallel, range totals first - and a work
is drawn where the sum passes ``start + j``, one random start for all.  Last, floors are repaired: a linear programme
over classes of cells (``balance``) says how many works each cell gives or takes so that the targets miss as little as
can be, with the fewest moves; undrawn works of a cell come in, or drawn ones go out, in the order of the hash.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fumikura.functions import keys
from fumikura.llm.balance import repair
from fumikura.sources.corpus import works

DIMS = ["period", "genre_main", "author_sex", "register_level"]
#: Cells and targets come to the driver; both are products of categories, not of rows.  More is an error.
MAX_CELLS, MAX_TARGETS, MAX_INCIDENCE = 200_000, 1_000, 50_000_000


def targets(table: DataFrame) -> DataFrame:
    """Targets with values in the writing of ``works``; null shares and floors are 0, a null id is no target,
    repeated rows count once."""
    return table.where("target_id is not null").select(
        "target_id", keys.period_number(F.col("period")).alias("period"), keys.category(F.col("genre_main")).alias("genre_main"),
        keys.sex(F.col("author_sex")).alias("author_sex"), keys.category(F.col("register_level")).alias("register_level"),
        F.coalesce("share_pct", F.lit(0)).alias("share_pct"), F.coalesce("min_items", F.lit(0)).alias("min_items"),
    ).dropDuplicates(["target_id"])


def cells(ws: DataFrame) -> DataFrame:
    """Works per combination of categories (a null is a category of its own)."""
    return ws.groupBy(*DIMS).agg(F.count("*").alias("n"))


def need(share_pct: int, min_items: int, size: int) -> int:
    return max(-(-share_pct * size // 100), min_items)


class Plan:
    """Cells, targets and their incidence on the driver (bounded by the numbers of categories)."""

    def __init__(self, ws: DataFrame, target_table: DataFrame, one_in: int = 5):
        rows = cells(ws).orderBy(*DIMS).limit(MAX_CELLS + 1).collect()
        self.targets = targets(target_table).orderBy("target_id").limit(MAX_TARGETS + 1).collect()
        if len(rows) > MAX_CELLS or len(self.targets) > MAX_TARGETS or len(rows) * len(self.targets) > MAX_INCIDENCE:
            raise ValueError("more cells or targets than categories can form; check the columns")
        self.keys = [tuple(r[d] for d in DIMS) for r in rows]
        self.count = np.array([r["n"] for r in rows], np.int64)
        self.size = int(self.count.sum()) // one_in
        values = [np.array([k[j] for k in self.keys], object) for j in range(len(DIMS))]
        self.match = np.ones((len(self.targets), len(self.keys)), bool)
        for row, t in zip(self.match, self.targets):
            for v, d in zip(values, DIMS):
                if t[d] is not None:
                    row &= v == t[d]
        self.need = np.array([need(t["share_pct"], t["min_items"], self.size) for t in self.targets], np.int64)
        self.have = self.match @ self.count if len(self.keys) else np.zeros(len(self.targets), np.int64)

    def expected(self, rounds: int = 300) -> np.ndarray:
        """Expected draws per cell: raked to the targets' shares, at most the cell's works, summing to the size.

        Rounds end when none changes a cell; targets in conflict make them go on, and the last round counts: what
        it leaves short is repaired exactly afterwards."""
        n = self.count.astype(float)
        if not n.sum():
            return n
        x = n * self.size / n.sum()
        for _ in range(rounds):
            old = x.copy()
            for m, want, have in zip(self.match, self.need, self.have):
                got, want = x[m].sum(), min(want, have)
                if got > 0 and got < want:  # a share is a lower bound; others may exceed it
                    x[m] = np.minimum(n[m], x[m] * want / got)
            for _ in range(50):
                over = x.sum() - self.size
                if abs(over) < 1e-9:
                    break
                free = (x < n) if over < 0 else (x > 0)
                if not free.any():
                    break
                x[free] = np.clip(x[free] * (1 - over / x[free].sum()), 0, n[free])
            if np.abs(x - old).max() < 1e-9:
                break
        return x


def draw(metadata: DataFrame, target_table: DataFrame, one_in: int = 5, seed: int = 42, ranges: int = 256) -> DataFrame:
    """The sample: id and categories of the drawn works, ``how`` = drawn or repaired.

    An empty table gives an empty sample; works without a known category are cells of their own.
    """
    ws = works(metadata).select("id", *DIMS)
    return _draw(ws, Plan(ws, target_table, one_in), seed, ranges)[0]


def _draw(ws: DataFrame, plan: Plan, seed: int, ranges: int) -> tuple[DataFrame, int]:
    """The sample, and how many works the reachable targets must miss in all because they are in conflict."""
    spark = ws.sparkSession
    x = plan.expected()
    start = float(np.random.default_rng(seed).random())
    base = np.concatenate([[0.0], np.cumsum(x)])
    p = x / np.maximum(plan.count, 1)
    # integer crossings of each whole cell: what the scan below will draw from it
    cross = lambda r: np.floor(np.round(base[:-1] + p * r - start, 9)).astype(np.int64)
    got = cross(plan.count) - cross(0)
    change, conflict = repair(plan.match, plan.count, got, plan.need, plan.size)
    # cell table: first prefix sum and probability of each cell, and how many works are put in or taken out
    data = [(*k, i, float(base[i]), float(p[i]), int(change[i])) for i, k in enumerate(plan.keys)]
    table = spark.createDataFrame(data, ", ".join(f"{d} string" for d in DIMS) + ", cell int, base double, p double, change long")
    cond = [ws[d].eqNullSafe(table[d]) for d in DIMS]
    on = cond[0] & cond[1] & cond[2] & cond[3]
    w = ws.join(F.broadcast(table), on).select(ws["id"], *(ws[d] for d in DIMS), "cell", "base", "p", "change", F.xxhash64(F.lit(seed), ws["id"]).alias("h"))  # at most MAX_CELLS rows
    # prefix sums: order inside a cell by hash; totals of hash ranges first, so a large cell is split over tasks
    w = w.withColumn("part", F.shiftrightunsigned("h", 64 - int(math.log2(ranges))).cast("int"))
    parts = w.groupBy("cell", "part").agg(F.count("*").alias("k"))
    before = parts.withColumn("before", F.coalesce(F.sum("k").over(Window.partitionBy("cell").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("k")
    w = w.join(before, ["cell", "part"])
    w = w.withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("cell", "part").orderBy("h", "id")))
    upto = lambda r: F.floor(F.round(F.col("base") + F.col("p") * r - start, 9))
    # the works drawn up to a rank are known from the crossings, so the first drawn or undrawn ones need no ranking
    w = w.withColumn("drawn", upto(F.col("rank")) > upto(F.col("rank") - 1)).withColumn("before_drawn", upto(F.col("rank")) - upto(F.lit(0)))
    added = ~F.col("drawn") & (F.col("change") > 0) & (F.col("rank") - F.col("before_drawn") <= F.col("change"))
    kept = F.col("drawn") & ((F.col("change") >= 0) | (F.col("before_drawn") > -F.col("change")))
    return w.where(added | kept).select("id", *DIMS, F.when(F.col("drawn"), "drawn").otherwise("repaired").alias("how")), conflict


def report(metadata: DataFrame, target_table: DataFrame, one_in: int = 5, seed: int = 42, ranges: int = 256) -> DataFrame:
    """One row per target: need, how many works there are, how many the sample of ``draw`` holds, whether the target
    can be met and is met, and the reason if it isn't: ``too few works``, or ``conflict`` (the least total shortfall
    of all targets that enough works could serve is above zero: a sample of this size can't meet them all)."""
    ws = works(metadata).select("id", *DIMS)
    plan = Plan(ws, target_table, one_in)
    s, conflict = _draw(ws, plan, seed, ranges)
    got = _per_target(cells(s), F.broadcast(targets(target_table)).alias("t"), "sampled", F.sum("n"))  # at most MAX_TARGETS
    known = ws.sparkSession.createDataFrame([(int(t["target_id"]), int(n), int(h)) for t, n, h in zip(plan.targets, plan.need, plan.have)], "target_id bigint, needed bigint, available bigint")
    j = known.join(got, "target_id", "left").select("target_id", "needed", "available", F.coalesce("sampled", F.lit(0)).cast("bigint").alias("sampled"))
    can, met = F.col("available") >= F.col("needed"), F.col("sampled") >= F.col("needed")
    why = F.when(~can, "too few works").when(~met, "conflict" if conflict else "not found")
    return j.select("*", can.alias("can_be_met"), met.alias("is_met"), why.alias("reason"))


def _per_target(cs: DataFrame, t: DataFrame, name: str, agg) -> DataFrame:
    """Cells x targets, both bounded by categories."""
    c = cs.alias("c")
    on = None
    for d in DIMS:
        m = F.col(f"t.{d}").isNull() | (F.col(f"t.{d}") == F.col(f"c.{d}"))
        on = m if on is None else on & m
    return c.join(t, on).groupBy("target_id").agg(agg.alias(name))


def found(metadata: DataFrame, target_table: DataFrame) -> DataFrame:
    """Targets of the report that no sample can meet, since fewer works can serve them than they need."""
    return report(metadata, target_table).where("not can_be_met and sampled < needed").select("target_id")
