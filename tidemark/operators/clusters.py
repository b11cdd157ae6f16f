"""Connected components and the sign-flip cluster test."""

import pandas as pd
from pyspark.sql import functions as F

from ..functions.tails import t_quantile
from ..session import cut_lineage
from .resample import flipped_sums


def components(nodes, edges, keys):
    """Smallest reachable node per node: edges(keys, i, j), both directions implied.

    Each round takes the minimum label of the neighbours and then jumps to the label's
    own label, which halves paths.  Rounds stop when no label changes; the label table
    is checkpointed every round.
    """
    keys = list(keys)
    both = cut_lineage(edges.select(*keys, "i", "j").unionByName(edges.select(*keys, F.col("j").alias("i"), F.col("i").alias("j"))).distinct())
    lab = cut_lineage(nodes.select(*keys, F.col("node"), F.col("node").alias("root")))
    while True:
        near = both.join(lab.select(*keys, F.col("node").alias("j"), F.col("root").alias("_n")), keys + ["j"]).groupBy(*keys, F.col("i").alias("node")).agg(F.min("_n").alias("_n"))
        step = lab.join(near, keys + ["node"], "left").select(*keys, "node", "root", F.least("root", F.coalesce("_n", "root")).alias("_r"))
        jump = lab.select(*keys, F.col("node").alias("_r"), F.col("root").alias("_rr"))
        new = cut_lineage(step.join(jump, keys + ["_r"], "left").select(*keys, "node", F.least("_r", F.coalesce("_rr", "_r")).alias("root"), (F.least("_r", F.coalesce("_rr", "_r")) != F.col("root")).alias("_moved")))
        lab = new.drop("_moved")
        if new.where("_moved").isEmpty():
            return lab


def cluster_permutation(diffs, adjacency, n_perm, seed):
    """diffs(test, subject, ch, diff) -> observed clusters with their p-values: (test, sgn, root, mass, n_channels, p).

    Replicate 0 is the observed data. A subject's channels lie in one row, which meets all its signs in place; signed sums combine
    before the shuffle. What remains per (test, replicate) is one row of t values, and its clusters
    are found inside the row: the label of a channel is the least channel that it reaches over channels of the same
    sign above the threshold. Channels are those of the adjacency and of the data, a montage of bounded size.
    """
    chans = sorted({c for e in adjacency for c in e} | {r["ch"] for r in diffs.select("ch").distinct().collect()})
    at = {c: k for k, c in enumerate(chans)}
    nb = [sorted({at[j] for i, j in adjacency if at[i] == k} | {at[i] for i, j in adjacency if at[j] == k}) for k in range(len(chans))]
    value = lambda c: F.max(F.when(F.col("ch") == c, F.col("diff")))
    wide = cut_lineage(diffs.groupBy("test", "subject").agg(*[value(c).cast("double").alias(f"d{k}") for k, c in enumerate(chans)]))

    @F.pandas_udf("double")
    def threshold(n: pd.Series) -> pd.Series:
        return n.map(lambda k: float(t_quantile(0.975, k - 1)))

    # One row per test: subjects, and per channel the count and the sum of squares, which no sign changes.
    fixed = wide.groupBy("test").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.struct(F.count(f"d{k}").alias("n"), F.sum(F.col(f"d{k}") ** 2).alias("q")) for k in range(len(chans))]).alias("c"))
    fixed = cut_lineage(fixed.where("n > 1").withColumn("thr", threshold("n")).drop("n"))
    d = [f"d{k}" for k in range(len(chans))]
    flipped = flipped_sums(wide, ["test"], "subject", d, n_perm, seed)
    observed = wide.groupBy("test").agg(*[F.sum(x).alias(x) for x in d]).withColumn("rep", F.lit(0).cast("long"))
    sums = flipped.unionByName(observed).join(fixed, "test").select("test", "rep", "thr", "c", F.array(*d).alias("s"))

    def t_value(s, c):
        var = (c["q"] - s * s / c["n"]) / (c["n"] - 1)
        return F.when((c["n"] > 1) & (var > 0), (s / c["n"]) / F.sqrt(var / c["n"]))

    t = sums.select("test", "rep", "thr", F.zip_with("s", "c", t_value).alias("t")).withColumn("sgn", F.explode(F.array(F.lit(1), F.lit(-1))))
    own = F.transform("t", lambda v, i: F.when(v * F.col("sgn") > F.col("thr"), i))
    near = F.array(*[F.array(*[F.lit(j) for j in js]).cast("array<int>") for js in nb])
    spread_once = lambda lab: F.transform(lab, lambda v, i: F.when(v.isNotNull(), F.least(v, F.array_min(F.transform(F.get(near, i), lambda j: F.get(lab, j))))))
    t = t.withColumn("lab", F.aggregate(F.sequence(F.lit(2), F.lit(max(2, len(chans)))), own, lambda lab, _: spread_once(lab))).where(F.exists("lab", lambda v: v.isNotNull()))
    one = F.transform(F.array_distinct(F.filter("lab", lambda v: v.isNotNull())), lambda r: F.struct(
        r.alias("r"), F.aggregate(F.zip_with("lab", "t", lambda v, x: F.when(v == r, x).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x).alias("mass"),
        F.size(F.filter("lab", lambda v: v == r)).alias("n_channels")))
    mass = cut_lineage(t.select("test", "rep", "sgn", F.inline(one)))
    top = mass.where("rep > 0").groupBy("test", "rep").agg(F.max(F.abs("mass")).alias("mx"))
    obs = mass.where("rep = 0").select("test", "sgn", F.element_at(F.array(*[F.lit(c) for c in chans]), F.col("r") + 1).alias("root"), "mass", "n_channels")
    hits = obs.join(top, "test").where(F.col("mx") >= F.abs("mass")).groupBy("test", "sgn", "root").agg(F.count(F.lit(1)).alias("h"))
    return obs.join(hits, ["test", "sgn", "root"], "left").withColumn("p", (F.coalesce("h", F.lit(0)) + 1) / (n_perm + 1.0)).drop("h")
