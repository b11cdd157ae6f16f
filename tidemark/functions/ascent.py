"""Quasi-Newton ascent of many small problems side by side: every step evaluates all of them that are still open at once."""

import numpy as np

LONGEST = 1.0    # most that a coordinate moves in one step
TINY = 1e-10     # a step cut down to this share is at the rounding of the values


def _inverse(information):
    """Inverse of a positive matrix, also where it is nearly singular."""
    scale = np.sqrt(np.maximum(np.diag(information), 1e-300))
    w, v = np.linalg.eigh(information / np.outer(scale, scale))
    return (v / np.maximum(w, 1e-8)) @ v.T / np.outer(scale, scale)


def ascend(evaluate, start, gap=1e-6, passes=500):
    """(points, values) at the maximum of every problem: BFGS with halved steps, all from the common `start`.

    evaluate(points, which) -> (values, slopes, information): of the problems `which` at `points`; the information, a matrix that all share, is only
    read at the start. A problem is done when its slopes promise no more than gap / 2.
    """
    first = np.asarray(start, float)
    n = evaluate.problems
    x = np.tile(first, (n, 1))
    f, g, information = evaluate(x, np.arange(n))
    base = _inverse(information)
    h, share, undone = np.tile(base, (n, 1, 1)), np.ones(n), np.ones(n, dtype=bool)

    def step(i):
        p = h[i] @ g[i]
        if not g[i] @ p > 0:
            h[i] = base
            p = base @ g[i]
        return p * min(1.0, LONGEST / max(np.abs(p).max(), 1e-300))

    undone &= np.array([g[i] @ h[i] @ g[i] > gap for i in range(n)])
    for _ in range(passes):
        which = np.flatnonzero(undone)
        if not len(which):
            return x, f
        moves = np.stack([step(i) * share[i] for i in which])
        values, slopes, _ = evaluate(x[which] + moves, which)
        for i, move, value, slope in zip(which, moves, values, slopes):
            promised = g[i] @ move
            if not (np.isfinite(value) and np.isfinite(slope).all() and value - f[i] >= 1e-4 * promised - 1e-12 * abs(f[i])):
                share[i] /= 4
                undone[i] = share[i] > TINY
                continue
            bend = g[i] - slope
            turn = move @ bend
            if turn > 1e-12 * np.sqrt((move @ move) * (bend @ bend)):
                a = np.eye(len(move)) - np.outer(move, bend) / turn
                h[i] = a @ h[i] @ a.T + np.outer(move, move) / turn
            gained = value - f[i]
            x[i] += move
            f[i], g[i] = value, slope
            undone[i] = slope @ h[i] @ slope > gap and not (share[i] == 1.0 and gained < gap / 2)
            share[i] = 1.0
    raise RuntimeError(f"{undone.sum()} of {n} problems have no maximum after {passes} steps")
