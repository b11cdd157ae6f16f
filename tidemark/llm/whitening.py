"""Whitening components of vectors by shifted Cholesky QR.

The distinct vectors are the rows of a tall matrix. Each pass over them centres the rows, takes them through the triangular
factors found so far and sums their Gram matrix, block by block in the tasks and entry by entry in Spark; its Cholesky factor
joins the chain. The first pass adds a small shift to the diagonal, so that it succeeds for any
condition of the matrix, and two more make the rows orthonormal to double precision. The singular values of
the product of the factors are those of the matrix, and its right singular vectors the components.

Only d x d sums reach the driver; d is bounded by DIMENSIONS.
"""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..session import stored

DIMENSIONS = 2_048         # entries of a vector at most
SCALE = 256.0              # steps of the integer grid in a unit
PASSES = 3                 # Cholesky passes: one shifted, two to orthogonality
LEAST = 1e-13              # components with less of the variance than this have no direction of their own
BLOCK = 4_096              # vectors multiplied at once


def grid(vectors, id_col="vec_id", vector_col="embedding"):
    """(id, x): every vector of finite entries on the integer grid, x = floor(256 * c).

    Rows go whose vector is null, empty or holds a null or non-finite entry. Entries beyond 2^52 steps have no exact place on the
    grid and are refused with an error.
    """
    v = F.transform(vectors[vector_col], lambda c: c.cast("double"))
    # NaN is above every number in Spark's order, so that one comparison finds it and both infinities.
    whole = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), v.alias("v")).where(F.coalesce(whole, F.lit(False)))
    step = lambda c: F.when(F.abs(c) < float(1 << 44), F.floor(c * SCALE).cast("long")).otherwise(F.raise_error(F.lit("entry beyond the grid")).cast("long"))
    return rows.select("id", F.transform("v", step).alias("x"))


def dimension(rows):
    """The commonest length of x (of equals, the largest), or None without rows."""
    got = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if got and got[0]["d"] > DIMENSIONS:
        raise ValueError(f"more than {DIMENSIONS} dimensions")
    return got[0]["d"] if got else None


def _blocks(frames):
    for df in frames:
        for at in range(0, len(df), BLOCK):
            yield np.stack(df["x"].iloc[at:at + BLOCK].to_numpy())


def sums(fit):
    """(n, S): number of vectors and exact sum of every entry, as Python integers."""
    def add(frames):
        n, total = 0, 0
        for x in _blocks(frames):
            n += len(x)
            total = total + x.sum(axis=0)
        if n:
            yield pd.DataFrame({"j": np.arange(-1, len(total)), "s": np.concatenate([[n], total]).astype("int64")})

    got = fit.mapInPandas(add, "j int, s long").groupBy("j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    by = {r["j"]: int(r["s"]) for r in got}
    return by.pop(-1, 0), [by[j] for j in range(len(by))]


def _solved(z, factors):
    """Rows z times the inverse of every upper triangular factor in turn, by triangular solves."""
    for r in factors:
        z = np.linalg.solve(r.T, z.T).T if len(r) < 64 else _forward(r, z)
    return z


def _forward(r, z, width=64):
    """z r^-1 by blocked forward substitution."""
    z = z.copy()
    for a in range(0, len(r), width):
        b = min(len(r), a + width)
        z[:, a:b] = np.linalg.solve(r[a:b, a:b].T, z[:, a:b].T).T
        z[:, b:] -= z[:, a:b] @ r[a:b, b:]
    return z


def gram(fit, mean, factors, scale=None):
    """Gram matrix of the centred rows, taken through the factors (and projected by `scale`), summed over all tasks."""
    shared = fit.sparkSession.sparkContext.broadcast((mean, factors, scale))

    def partial(frames):
        mean, factors, scale = shared.value
        total = 0
        for x in _blocks(frames):
            z = _solved(x - mean, factors)
            if scale is not None:
                z = np.column_stack([z @ scale, np.ones(len(z))])
            total = total + z.T @ z
        if not np.isscalar(total):
            i, j = np.triu_indices(len(total))
            yield pd.DataFrame({"i": i.astype("int32"), "j": j.astype("int32"), "g": total[i, j]})

    got = fit.mapInPandas(partial, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).toPandas()
    out = np.zeros((got["i"].max() + 1,) * 2)
    out[got["i"], got["j"]] = out[got["j"], got["i"]] = got["g"]
    return out


def _cholesky(g, n, shifted):
    """Upper triangular factor of g, with a shift where asked or where g has no factor of its own.

    The shift is 11 (n d + d (d + 1)) units of rounding of the norm: above the error of the sums, and
    small enough that the next passes take it out.
    """
    d = len(g)
    unit = 11.0 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2 * max(np.linalg.norm(g, 2), np.finfo(float).tiny)
    shift = unit if shifted else 0.0
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift = max(2 * shift, unit)


def components(fit, keep=4):
    """(n, S, mean, eigenvalues, eigenvectors as columns, all variance, identity error) of the distinct vectors in `fit` (x).

    Up to `keep` components by falling eigenvalue, signed so that the largest entry is positive. Components without
    variance are left out: their whitened values would be 0 / 0.
    """
    n, total = sums(fit)
    if not n:
        return None
    mean = np.array([s / n for s in total])
    factors = []
    for k in range(PASSES):
        factors.append(_cholesky(gram(fit, mean, factors), n, shifted=k == 0))
    r = factors[0]
    for f in factors[1:]:
        r = f @ r
    _, s, vt = np.linalg.svd(r)
    e = s * s / n
    trace = e.sum()
    kept = np.flatnonzero(e > LEAST * trace)[:keep] if trace > 0 else np.zeros(0, dtype=int)
    v = vt[kept].T
    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    error = 0.0
    if len(kept):
        g = gram(fit, mean, [], v / np.sqrt(e[kept])) / n
        cov = g[:-1, :-1] - np.outer(g[-1, :-1], g[-1, :-1])
        error = float(np.abs(cov - np.eye(len(kept))).max())
    return n, total, mean, e[kept], v, trace, error


def whiten(vectors, id_col="vec_id", vector_col="embedding", keep=4):
    """(id, component, n, deviation, whitened, explained, identity_error): one row per vector and component.

    Repeated rows come out as often as they are there, but count once in the fit. Of vectors with different lengths those of the
    commonest length take part. An empty table, or one whose vectors are all equal, has no component and so
    no row. A vector with fewer than `keep` directions of variance has that many rows. A deviation beyond a long is refused.
    Other columns of the input do not matter.
    """
    rows = stored(grid(vectors, id_col, vector_col))
    schema = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    d = dimension(rows)
    if d is None:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size("x") == d)
    found = components(stored(rows.select("x").distinct()), keep)
    n, total, mean, e, v, trace, error = found
    if not len(e):
        return vectors.sparkSession.createDataFrame([], schema)
    shared = vectors.sparkSession.sparkContext.broadcast((n, total, mean, v / np.sqrt(e), e / trace, error))

    def project(frames):
        n, total, mean, weights, explained, error = shared.value
        k = weights.shape[1]
        fits = max(map(abs, total)) < 1 << 62
        for df in frames:
            x = np.stack(df["x"].to_numpy()) if len(df) else np.zeros((0, len(total)), dtype=np.int64)
            far = n * np.abs(x.astype(float)) + np.abs(np.array(total, dtype=float))
            if fits and (not far.size or (far ** 2).sum(axis=1).max() < 2.0 ** 62):
                gap = n * x - np.array(total, dtype=np.int64)
                deviation = (gap * gap).sum(axis=1)
            else:
                deviation = np.array([sum((n * int(a) - s) ** 2 for a, s in zip(row, total)) for row in x], dtype="int64")
            white = (x - mean) @ weights
            yield pd.DataFrame({
                "id": df["id"].repeat(k).to_numpy(), "component": np.tile(np.arange(1, k + 1, dtype="int32"), len(x)), "n": np.int64(n),
                "deviation": deviation.repeat(k), "whitened": white.ravel(), "explained": np.tile(explained, len(x)), "identity_error": error})

    return rows.mapInPandas(project, schema)
