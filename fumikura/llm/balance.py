"""Whole numbers of works per cell that miss given floors by as little as can be.

``repair`` moves works between cells in one step: a linear programme over classes of cells (cells that serve the same
targets are one class, so its size depends on the targets, not on works or cells) gives the least total shortfall with
the fewest moves, a vertex of it has as many fractional classes as there are targets at most, and these are rounded.
The programme's optimum is a lower bound, so what is left short is proven to be short by conflict.
"""

from __future__ import annotations

import numpy as np

#: Weights: a work short of a floor that enough works could serve, one of a floor that too few can, a work moved.
REACHABLE, UNREACHABLE, MOVE = 1000.0, 1.0, 0.001
_INF = np.inf


def simplex(a: np.ndarray, b: np.ndarray, c: np.ndarray, upper: np.ndarray, basis: np.ndarray, rounds: int = 100_000) -> np.ndarray:
    """Minimum of c x with a x = b, 0 <= x <= upper, from a basis whose columns are +-1 unit vectors and feasible
    with all others at 0.  Bounded primal simplex; the smallest index wins after many steps without progress."""
    m, n = a.shape
    basis = basis.copy()
    at_top = np.zeros(n, bool)
    inside = np.zeros(n, bool)
    inside[basis] = True
    inv = np.linalg.inv(a[:, basis])
    x = np.zeros(n)
    x[basis] = inv @ b
    idle = 0
    for step in range(rounds):
        if step % 200 == 199:  # rounding errors don't pile up
            inv = np.linalg.inv(a[:, basis])
            x[basis] = inv @ (b - a[:, at_top & ~inside] @ upper[at_top & ~inside])
        d = c - (c[basis] @ inv) @ a
        gain = np.where(inside, 0.0, np.where(at_top, d, -d))
        gain[upper <= 0] = 0.0
        if idle > 200:
            better = np.flatnonzero(gain > 1e-9)
            if not len(better):
                return x
            j = int(better[0])
        else:
            j = int(np.argmax(gain))
            if gain[j] <= 1e-9:
                return x
        way = -1.0 if at_top[j] else 1.0
        col = way * (inv @ a[:, j])
        lim = np.full(m, _INF)
        down, up = col > 1e-9, col < -1e-9
        lim[down] = x[basis][down] / col[down]
        lim[up] = (upper[basis][up] - x[basis][up]) / -col[up]
        lim = np.maximum(lim, 0.0)
        r = int(np.argmin(lim))
        t = min(lim[r], upper[j])
        if not np.isfinite(t):
            raise ValueError("the programme has no bound")
        idle = 0 if t > 1e-9 else idle + 1
        x[basis] -= t * col
        x[j] += way * t
        if upper[j] <= lim[r]:  # from one bound to the other
            at_top[j] = ~at_top[j]
            x[j] = upper[j] if at_top[j] else 0.0
            continue
        out = basis[r]
        at_top[out] = col[r] < 0
        x[out] = upper[out] if at_top[out] else 0.0
        inside[out], inside[j], at_top[j] = False, True, False
        basis[r] = j
        p = inv @ a[:, j]
        row = inv[r] / p[r]
        inv -= np.outer(p, row)
        inv[r] = row
    raise ValueError("the programme did not end")


def repair(match: np.ndarray, count: np.ndarray, got: np.ndarray, need: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """Works to add to (positive) or take from each cell, and the proven least number of works short over the
    reachable targets.

    ``match``: targets x cells, whether a cell serves a target; ``count`` works of a cell, ``got`` drawn ones,
    ``need`` per target, ``size`` of the sample (more than all works: all are taken).
    """
    if not len(count):
        return np.zeros(0, np.int64), 0
    size = min(size, int(count.sum()))
    groups, of = np.unique(match.T, axis=0, return_inverse=True)  # classes x targets
    of = of.ravel()
    k = len(groups)
    n = np.bincount(of, weights=count, minlength=k).astype(np.int64)
    g = np.bincount(of, weights=got, minlength=k).astype(np.int64)
    s = groups.T.astype(float)
    have = (s @ n).astype(np.int64)
    goal = np.minimum(need, have)
    weight = np.where(have >= need, REACHABLE, UNREACHABLE)
    t = len(goal)
    # columns: works added, works taken, short, over, sample short, sample over
    a = np.zeros((t + 1, 2 * k + 2 * t + 2))
    a[:t, :k], a[:t, k : 2 * k] = s, -s
    a[t, :k], a[t, k : 2 * k] = 1, -1
    a[:t, 2 * k : 2 * k + t], a[:t, 2 * k + t : 2 * k + 2 * t] = np.eye(t), -np.eye(t)
    a[t, -2:] = 1, -1
    b = np.concatenate([goal - s @ g, [size - g.sum()]])
    c = np.concatenate([np.full(2 * k, MOVE), weight, np.zeros(t), np.full(2, 1e7)])
    upper = np.concatenate([n - g, g, np.full(2 * t + 2, _INF)]).astype(float)
    basis = np.array([2 * k + j + (t if b[j] < 0 else 0) for j in range(t)] + [2 * k + 2 * t + (b[t] < 0)])
    x = simplex(a, b, c, upper, basis)
    least = int(np.ceil(x[2 * k : 2 * k + t][have >= need].sum() - 1e-6)) if t else 0
    want = g + x[:k] - x[k : 2 * k]
    z = np.floor(want + 1e-7).astype(np.int64)
    z = _descend(s, n, z, g, goal, weight, size)
    return _spread(of, z - g, count, got), least


def _descend(s: np.ndarray, n: np.ndarray, z: np.ndarray, g: np.ndarray, goal: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
    """Fill up to the size, then single moves between classes as long as one pays."""
    cost = lambda have: float(weight @ np.maximum(goal - have, 0))
    have = s @ z
    while z.sum() != size:
        way = 1 if z.sum() < size else -1
        after = np.maximum(goal[:, None] - (have[:, None] + way * s), 0)
        v = weight @ after + MOVE * np.sign((z - g) * way + 0.5)
        v[(z >= n) if way > 0 else (z <= 0)] = _INF
        j = int(np.argmin(v))
        z[j] += way
        have = have + way * s[:, j]
    now = cost(have)
    while now > 0:
        best, pick = now - 1e-6, None
        for j in np.flatnonzero(z < n):
            after = weight @ np.maximum(goal[:, None] - (have + s[:, j])[:, None] + s, 0)
            after[z <= 0] = _INF
            i = int(np.argmin(after))
            if after[i] < best:
                best, pick = float(after[i]), (int(j), i)
        if pick is None:
            break
        z[pick[0]] += 1
        z[pick[1]] -= 1
        have = s @ z
        now = cost(have)
    return z


def _spread(of: np.ndarray, change: np.ndarray, count: np.ndarray, got: np.ndarray) -> np.ndarray:
    """A class's change over its cells, in proportion to what each can give or take, whole numbers by largest rest."""
    room = np.where(change[of] > 0, count - got, got).astype(float)
    total = np.bincount(of, weights=room, minlength=len(change))
    part = np.abs(change)[of] * room / np.maximum(total[of], 1)
    out = np.floor(part + 1e-9).astype(np.int64)
    left = np.abs(change) - np.bincount(of, weights=out, minlength=len(change)).astype(np.int64)
    order = np.lexsort((np.arange(len(of)), -(part - out), of))
    first = np.searchsorted(of[order], np.arange(len(change)))
    rank = np.arange(len(of)) - first[of[order]]
    out[order] += (rank < left[of[order]]) & (out[order] < room[order])
    return out * np.sign(change)[of]
