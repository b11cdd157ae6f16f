"""Effect sizes, tests, meta-analysis, profiles, projections and sensitivity indices."""

from pyspark.sql import Window, functions as F

from ..functions.draws import normal
from ..functions.exprs import dot
from .resample import resampled, sql_resampled


def profile_interval(curve, keys, grid, ll, drop=1.92):
    """95 % interval where the curve falls `drop` below its maximum.

    Linear interpolation on each side of the maximum (log grid when all of it is
    positive); an end whose outermost value has not fallen that far is NULL.
    Rows per curve are grid points, a bounded number.
    """
    w = Window.partitionBy(*keys).orderBy(grid)
    whole = Window.partitionBy(*keys)
    d = curve.withColumns({"_mx": F.max(ll).over(whole), "_g0": F.max_by(grid, ll).over(whole), "_log": F.min(grid).over(whole) > 0})
    d = d.withColumns({"_d": F.col("_mx") - F.col(ll), "_x": F.when(F.col("_log"), F.log(grid)).otherwise(F.col(grid))})
    d = d.withColumns({"_dn": F.lead("_d").over(w), "_xn": F.lead("_x").over(w), "_dp": F.lag("_d").over(w), "_xp": F.lag("_x").over(w)})
    cross = lambda d1, x1: F.col("_x") + (drop - F.col("_d")) / (F.col(d1) - F.col("_d")) * (F.col(x1) - F.col("_x"))
    left = (F.col(grid) < F.col("_g0")) & (F.col("_d") >= drop) & (F.col("_dn") < drop)
    right = (F.col(grid) > F.col("_g0")) & (F.col("_d") >= drop) & (F.col("_dp") < drop)
    g = d.groupBy(*keys).agg(
        F.max("_g0").alias("mle_grid"), F.bool_and("_log").alias("_log"),
        F.min_by("_d", grid).alias("_e0"), F.max_by("_d", grid).alias("_e1"),
        F.max_by(F.when(left, cross("_dn", "_xn")), F.when(left, F.col(grid))).alias("_lo"),
        F.min_by(F.when(right, cross("_dp", "_xp")), F.when(right, F.col(grid))).alias("_hi"),
    )
    lo, hi = F.when(F.col("_e0") >= drop, F.col("_lo")), F.when(F.col("_e1") >= drop, F.col("_hi"))
    back = lambda v: F.when(F.col("_log"), F.exp(v)).otherwise(v)
    return g.select(*keys, "mle_grid", back(lo).alias("lo"), back(hi).alias("hi"), ((hi - lo) / 3.92).alias("se"),
                    F.when(F.col("_log"), "log").otherwise("linear").alias("scale"))


def profile_unimodal(curve, keys, grid, ll):
    """One interior local maximum and an interior global maximum."""
    w = Window.partitionBy(*keys).orderBy(grid)
    d = curve.withColumns({"_p": F.lag(ll).over(w), "_n": F.lead(ll).over(w), "_k": F.row_number().over(w)})
    peak = F.coalesce((F.col(ll) >= F.col("_p")) & (F.col(ll) >= F.col("_n")), F.lit(False))
    g = d.groupBy(*keys).agg(F.count_if(peak).alias("n_peaks"), F.max_by("_k", ll).alias("_at"), F.max("_k").alias("_c"))
    return g.select(*keys, "n_peaks", ((F.col("n_peaks") == 1) & (F.col("_at") > 1) & (F.col("_at") < F.col("_c"))).alias("unimodal"))


def paired_effect(pairs, keys=()):
    """n, mean difference, d_z and t of (.., diff) rows."""
    g = pairs.groupBy(*keys).agg(F.count("diff").alias("n"), F.avg("diff").alias("mean_diff"), F.stddev_samp("diff").alias("sd"))
    return g.withColumns({"dz": F.try_divide("mean_diff", "sd"), "t": F.try_divide(F.col("mean_diff"), F.col("sd") / F.sqrt("n"))})


def effect_bootstrap(pairs, keys, ident, n_boot, seed):
    """Percentile interval of d_z over reweighted units (0 where a replicate has no spread).

    Squares are summed about the key's mean, so a mean that is large against the spread costs no digits.
    """
    keys = list(keys)
    middle = pairs.groupBy(*keys).agg(F.avg("diff").alias("_mid"))
    # Without keys the means are one row.
    d = pairs.join(middle, keys) if keys else pairs.join(F.broadcast(middle))
    away = F.col("diff") - F.col("_mid")
    r = resampled(d, keys, ident, {"s": away, "ss": away ** 2, "mid": F.col("_mid")}, n_boot, seed)
    off = F.col("s") / F.col("w")
    var = F.try_divide(F.greatest(F.col("ss") - F.col("s") * off, F.lit(0.0)), F.col("w") - 1)
    r = r.withColumn("dz", F.when(var > 0, (F.col("mid") / F.col("w") + off) / F.sqrt(var)).otherwise(0.0))
    # The replicate count is a parameter, so the built-in percentile is bounded here.
    return r.groupBy(*keys).agg(F.percentile("dz", F.lit(0.025)).alias("lo"), F.percentile("dz", F.lit(0.975)).alias("hi"))


def sql_effects(units, ident, n_boot, seed, keys=()):
    """The replicates of effect_bootstrap as a DuckDB subquery."""
    k = "".join(f"{x}," for x in keys)
    over = f"avg(diff) OVER ({'PARTITION BY ' + ','.join(keys) if keys else ''})"
    centred = f"(SELECT *, {over} AS mid, diff-{over} AS away FROM {units}) un"
    r = sql_resampled(centred, ident, {"s": "away", "ss": "away*away", "mid": "mid"}, n_boot, seed, keys)
    return f"(SELECT {k}rep, CASE WHEN v>0 THEN (mid/w+s/w)/sqrt(v) ELSE 0.0 END AS dz FROM (SELECT *, CASE WHEN w>1 THEN greatest(ss-s*s/w,0.0)/(w-1) END AS v FROM {r}))"


def equivalence(pairs, keys=(), bound=0.2):
    """Both one-sided t statistics of the equivalence test and its bound."""
    g = paired_effect(pairs, keys)
    se = F.col("sd") / F.sqrt("n")
    return g.withColumns({"bound": bound * F.col("sd"), "t_lower": (F.col("mean_diff") + bound * F.col("sd")) / se,
                          "t_upper": (F.col("mean_diff") - bound * F.col("sd")) / se})


def fdr_bh(tests, p, q=0.05, order=()):
    """Benjamini-Hochberg adjusted p.

    adj(p) is the running minimum from the top of p*n/rank.  Ranks come from distinct
    p-values counted first; the running minimum scans distinct values only.
    """
    from .ordered import running

    c = tests.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    n = c.agg(F.sum("_c").alias("_n"))
    r = running(c, [], ["_p"], sums={"_rank": F.col("_c")}).join(F.broadcast(n)).withColumn("_v", F.col("_p") * F.col("_n") / F.col("_rank"))
    w = Window.orderBy(F.desc("_b"))
    # Suffix minimum in two steps: within a bucket of ranks, so that small p-values fill no
    # bucket of their own, then over the bucket minima.
    r = r.withColumn("_b", F.floor(F.col("_rank") * 1024 / F.col("_n")))
    tail = r.groupBy("_b").agg(F.min("_v").alias("_m")).select("_b", F.min("_m").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_later"))
    inner = Window.partitionBy("_b").orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, 0)
    adj = r.join(F.broadcast(tail), "_b").select("_p", F.least(F.min("_v").over(inner), F.coalesce("_later", F.lit(1.0)), F.lit(1.0)).alias("p_adj"))
    return tests.join(adj, F.col(p) == F.col("_p"), "left").drop("_p").withColumn("reject", F.col("p_adj") <= q)


def random_effects(studies, keys=()):
    """DerSimonian-Laird pooling of studies(.., d, n): two aggregate passes."""
    v = 1.0 / F.col("n") + F.col("d") ** 2 / (2.0 * F.col("n"))
    s = studies.withColumn("v", v).withColumn("w", 1.0 / F.col("v"))
    s1 = s.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("total_n"), F.sum("w").alias("sw"), F.sum(F.col("w") ** 2).alias("sw2"),
        F.sum(F.col("w") * F.col("d")).alias("swd"), F.sum(F.col("w") * F.col("d") ** 2).alias("swd2"))
    q = F.greatest(F.col("swd2") - F.col("swd") ** 2 / F.col("sw"), F.lit(0.0))
    c = F.col("sw") - F.col("sw2") / F.col("sw")
    s1 = s1.withColumns({"q": q, "_df": F.col("k") - 1, "_c": c}).withColumns({
        "i2": F.when(F.col("q") > 0, F.greatest((F.col("q") - F.col("_df")) / F.col("q") * 100, F.lit(0.0))).otherwise(0.0),
        "tau2": F.when(F.col("_c") > 0, F.greatest((F.col("q") - F.col("_df")) / F.col("_c"), F.lit(0.0))).otherwise(0.0)})
    # Without keys the other side is one row; with keys its size is left to AQE.
    j = s.join(s1.select(*keys, "tau2"), list(keys)) if keys else s.join(F.broadcast(s1.select("tau2")))
    wr = 1.0 / (F.col("v") + F.col("tau2"))
    s2 = j.groupBy(*keys).agg((F.sum(wr * F.col("d")) / F.sum(wr)).alias("pooled"), F.sqrt(1.0 / F.sum(wr)).alias("se"))
    out = s1.join(s2, list(keys)) if keys else s1.join(F.broadcast(s2))
    return out.select(*keys, "k", "total_n", (F.col("swd") / F.col("sw")).alias("fixed"), "q", "i2", "tau2", "pooled", "se",
                      (F.col("pooled") - 1.96 * F.col("se")).alias("lo"), (F.col("pooled") + 1.96 * F.col("se")).alias("hi")), j.withColumn("weight", wr)


def project(deltas, axis, shift, value="d"):
    """Projection on a unit axis (array column/literal) in units of the shift, and the residual norm."""
    along = dot(F.col(value), axis)
    resid = F.zip_with(F.col(value), axis, lambda a, b: a - along * b)
    return deltas.withColumns({"along": along, "c": along / shift, "residual_norm": F.sqrt(dot(resid, resid))})


def sobol(table, outputs, keys=("output", "param")):
    """First-order (Saltelli) and total (Jansen) indices from an evaluation table.

    table(output, param, row, y_a, y_b, y_ab): one row per base row and parameter.
    """
    f = table.groupBy(*keys).agg(
        F.avg(F.col("y_b") * (F.col("y_ab") - F.col("y_a"))).alias("_n1"), F.avg((F.col("y_a") - F.col("y_ab")) ** 2).alias("_nt"),
        F.count(F.lit(1)).alias("n_rows"), F.avg("y_a").alias("_ma"), F.avg("y_b").alias("_mb"), F.var_pop("y_a").alias("_va"), F.var_pop("y_b").alias("_vb"))
    mean = (F.col("_ma") + F.col("_mb")) / 2
    var = (F.col("_va") + F.col("_vb")) / 2 + ((F.col("_ma") - mean) ** 2 + (F.col("_mb") - mean) ** 2) / 2
    return f.withColumn("var_y", var).select(
        *keys, "n_rows", "var_y", F.when(var < 1e-30, 0.0).otherwise(F.col("_n1") / var).alias("s1"),
        F.when(var < 1e-30, 0.0).otherwise(F.col("_nt") / (2 * var)).alias("st"))


def sobol_bootstrap(table, keys, ident, n_boot, seed, scale="raw", probs=(0.025, 0.975)):
    """Percentile intervals of both indices, resampling the base rows `ident`.

    table(keys, ident, y_a, y_b, y_ab). With scale "log" the logarithms are analysed, and outputs that are not
    above zero are missing. Each mean is over the rows that hold its terms. Squares are summed about the key's mean.
    """
    names = ("y_a", "y_b", "y_ab")
    y = table.select(*keys, ident, *[(F.when(F.col(c) > 0, F.log(c)) if scale == "log" else F.col(c)).alias(c) for c in names])
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    middle = y.groupBy(*keys).agg(((zero(F.sum("y_a")) + zero(F.sum("y_b"))) / F.nullif(F.count("y_a") + F.count("y_b"), F.lit(0))).alias("_m"))
    here = lambda c: c.isNotNull().cast("double")
    a, b = F.col("y_a") - F.col("_m"), F.col("y_b") - F.col("_m")
    first, total = F.col("y_b") * (F.col("y_ab") - F.col("y_a")), (F.col("y_a") - F.col("y_ab")) ** 2
    r = resampled(y.join(middle, list(keys)), keys, ident, {
        "n_v": here(a) + here(b), "s_v": zero(a) + zero(b), "q_v": zero(a * a) + zero(b * b),
        "n_f": here(first), "s_f": zero(first), "n_t": here(total), "s_t": zero(total)}, n_boot, seed)
    var = F.col("q_v") / F.col("n_v") - (F.col("s_v") / F.col("n_v")) ** 2
    flat = F.col("var") < 1e-30
    r = r.withColumn("var", var).select(*keys, F.when(flat, 0.0).otherwise(F.col("s_f") / F.col("n_f") / F.col("var")).alias("s1"),
                                        F.when(flat, 0.0).otherwise(F.col("s_t") / F.col("n_t") / (2 * F.col("var"))).alias("st"))
    return r.groupBy(*keys).agg(*[F.percentile(c, F.lit(q)).alias(f"{c}_{n}") for c in ("s1", "st") for n, q in zip(("lo", "hi"), probs)])


def pooled_draws(studies, keys, ident, n_boot, seed):
    """(keys, rep, pooled): inverse-variance pooled effects of effects drawn from N(d, v); studies has d and v."""
    x = F.col("d") + F.sqrt("v") * normal(F.lit(seed), F.col("rep"), *[F.col(c) for c in ident])
    reps = studies.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(int(n_boot)))))
    return reps.groupBy(*keys, "rep").agg((F.sum(x / F.col("v")) / F.sum(1 / F.col("v"))).alias("pooled"))
