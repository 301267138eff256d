"""Whole numbers of works per cell: against search over all samples, and on the whole test tables."""

import itertools
import os

import numpy as np
import pytest

from fumikura.llm import balance, sampling
from fumikura.sources.corpus import table


def _short(match, x, need, have):
    miss = np.maximum(np.minimum(need, have) - match @ x, 0)
    return int(miss[have >= need].sum()), int(miss[have < need].sum())


@pytest.mark.parametrize("seed", range(25))
def test_repair_is_best(seed):
    r = np.random.default_rng(seed)
    cells, targets = int(r.integers(1, 6)), int(r.integers(0, 5))
    count = r.integers(0, 4, cells)
    match = r.random((targets, cells)) < 0.5
    size = int(r.integers(0, count.sum() + 1))
    need = r.integers(0, 6, targets)
    have = match @ count
    got = np.zeros(cells, np.int64)
    for j in r.permutation(np.repeat(np.arange(cells), count))[:size]:
        got[j] += 1
    change, least = balance.repair(match, count, got, need, size)
    x = got + change
    assert x.sum() == size and (x >= 0).all() and (x <= count).all()
    best = min(_short(match, np.array(z), need, have) for z in itertools.product(*(range(c + 1) for c in count)) if sum(z) == size)
    assert _short(match, x, need, have)[0] == best[0] >= least


def test_no_cells():
    change, least = balance.repair(np.zeros((2, 0), bool), np.zeros(0, np.int64), np.zeros(0, np.int64), np.array([1, 2]), 0)
    assert len(change) == 0 and least == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_reachable_targets_are_met(spark, sf):
    """On the whole tables the reachable targets miss exactly the proven least number of works."""
    d = f"/root/testdata/{sf}"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    m, t = table(spark, d, "corpus_metadata_v2"), table(spark, d, "sample_targets")
    plan = sampling.Plan(sampling.works(m).select("id", *sampling.DIMS), t)
    _, least = balance.repair(plan.match, plan.count, np.zeros(len(plan.count), np.int64), plan.need, plan.size)
    rows = sampling.report(m, t).collect()
    assert sum(max(0, r["needed"] - r["sampled"]) for r in rows if r["can_be_met"]) == least
    assert all(r["reason"] is not None for r in rows if not r["is_met"])
    assert sampling.draw(m, t).count() == plan.size
