"""Graph measures of many small weighted graphs, edges(unit, i, j, w) with i < j.

A unit's graph has one node per channel, so its matrix is bounded and may sit in a row;
what grows is the number of units.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Window, functions as F
from pyspark.sql.types import DoubleType

from ..functions.fourier import by_length
from ..session import cut_lineage, spread


def strongest(edges, key, density):
    """The strongest share of edges per unit, ties at the cut kept.

    Edges are stored first: weights that are summed again for the cut, or by each reader, can differ
    in their last digits and lose the edge at the cut.
    """
    edges = cut_lineage(edges)
    n = Window.partitionBy(key)
    w = n.orderBy(F.desc("w"))
    k = F.greatest(F.lit(1), F.bround(F.lit(float(density)) * F.count(F.lit(1)).over(n), 0).cast("int"))
    d = edges.withColumns({"_k": k, "_r": F.row_number().over(w)})
    cut = d.where("_r = _k").select(key, F.col("w").alias("_cut"))
    return d.join(cut, key).where("w >= _cut").select(key, "i", "j", "w")


def matrices(edges, key, n_ch, fill=0.0):
    """One row per unit with the symmetric weight matrix as array<array>."""
    m = edges.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.col("i") * n_ch + F.col("j"), F.col("w")))).alias("_m"))
    idx = F.sequence(F.lit(0), F.lit(n_ch - 1))
    at = lambda i, j: F.try_element_at("_m", (F.least(i, j) * n_ch + F.greatest(i, j)).cast("int"))
    return m.select(key, F.transform(idx, lambda i: F.transform(idx, lambda j: F.coalesce(F.when(i == j, F.lit(fill)).otherwise(at(i, j)), F.lit(fill)))).alias("m"))


def _second_smallest(a, normalised):
    """Second-smallest Laplacian eigenvalue, at least 0, of each symmetric weight matrix; see fiedler."""
    n = a.shape[-1]
    one = np.eye(n)
    known = np.isfinite(a).all(axis=(1, 2))
    a = np.where(known[:, None, None], a, 0.0) * (1 - one)
    d = a.sum(axis=-1)
    if normalised:
        inv = np.divide(1.0, np.sqrt(d), out=np.zeros_like(d), where=d > 0)
        whole = d.sum(axis=-1, keepdims=True)
        c, u = np.full(len(a), 2.0), np.sqrt(np.divide(d, whole, out=np.zeros_like(d), where=whole > 0))
        lap = one * (d > 0)[:, None] - a * inv[:, :, None] * inv[:, None]
    else:
        c, u = 2.0 * d.max(axis=-1), np.full(d.shape, 1 / np.sqrt(n))
        lap = one * d[:, None] - a
    top = np.linalg.eigvalsh(c[:, None, None] * (one - u[:, :, None] * u[:, None]) - lap)[:, -1]
    return np.where(known, np.where(c > 0, np.maximum(c - top, 0.0), 0.0), np.nan)


def fiedler(mats, key, normalised=False):
    """(key, fiedler): second-smallest Laplacian eigenvalue of each unit's matrix `m`, at least 0.

    With c above all eigenvalues and u the unit null vector, B = c I - L - c u u' has c minus the
    wanted value as its largest eigenvalue.
    """
    @F.pandas_udf(DoubleType())
    def run(m: pd.Series) -> pd.Series:
        return pd.Series(by_length(m, lambda rows, _: _second_smallest(rows.reshape(len(rows), int(rows.shape[1] ** 0.5), -1), normalised)), dtype="float64")
    # Rows small in bytes but long in work; Spark also fails to take a Python function out of the aggregate of `matrices`.
    return spread(mats.select(key, F.flatten("m").alias("m")), key).select(key, F.coalesce(run("m"), F.lit(float("nan"))).alias("fiedler"))


def clustering(edges, key, n_ch):
    """Average clustering; nodes with fewer than two neighbours count as 0.

    Triangles are intersections of neighbour lists, so no wedge is ever emitted.
    """
    both = edges.select(key, "i", "j").unionByName(edges.select(key, F.col("j").alias("i"), F.col("i").alias("j")))
    nb = both.groupBy(key, "i").agg(F.collect_set("j").alias("nb"))
    e = both.join(nb, [key, "i"]).join(nb.select(key, F.col("i").alias("j"), F.col("nb").alias("nj")), [key, "j"])
    t = e.groupBy(key, "i").agg(F.sum(F.size(F.array_intersect("nb", "nj"))).alias("t2"), F.count(F.lit(1)).alias("deg"))
    c = F.when(F.col("deg") >= 2, F.col("t2") / (F.col("deg") * (F.col("deg") - 1))).otherwise(0.0)
    return t.groupBy(key).agg((F.sum(c) / n_ch).alias("clustering"))


def distances(mats):
    """Adds `d`: all shortest hop counts of a unit by the min-plus closure of its matrix."""
    n = F.size("m")
    start = F.transform("m", lambda r, i: F.transform(r, lambda v, j: F.when(i == j, 0.0).when(v > 0, 1.0).otherwise(1e9)))
    relax = lambda d, k: F.transform(d, lambda r, i: F.transform(r, lambda v, j: F.least(v, F.get(r, k) + F.get(F.get(d, k), j))))
    return mats.withColumn("d", F.aggregate(F.sequence(F.lit(0), n - 1), start, relax))


def path_measures(mats, key):
    """Mean path length (NULL when disconnected), efficiency mean(1/d) and connectivity."""
    d = distances(mats).select(key, F.size("m").alias("_n"), F.flatten("d").alias("_d"))
    off = F.filter("_d", lambda v: v > 0)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    pairs = F.col("_n") * (F.col("_n") - 1)
    far = F.exists("_d", lambda v: v >= 1e9)
    return d.select(key, F.when(~far, total(off) / pairs).alias("path_length"), (total(F.transform(off, lambda v: F.when(v < 1e9, 1.0 / v).otherwise(0.0))) / pairs).alias("efficiency"), (~far).alias("connected"))


def small_world(measures, reference, key):
    """(C / C_ref) / (L / L_ref) with the reference values joined from a table."""
    d = measures.join(reference, key, "left")
    return d.withColumn("sigma", F.try_divide(F.try_divide("clustering", "c_ref"), F.try_divide("path_length", "l_ref")))
