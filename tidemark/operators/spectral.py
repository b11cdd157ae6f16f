"""Band powers, the aperiodic fit, phase synchrony, phase-lag graphs and integration."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.exprs import let
from ..functions.fourier import analytic
from .complexity import channels

# Frequency bands in Hz.
BANDS = {"delta": (1.0, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0), "gamma_low": (30.0, 40.0)}


def band_integral(psd, df, lo, hi, closed=False):
    """Trapezoid over lo <= f < hi (<= hi when closed) of a density array with step df."""
    inside = lambda k: (k * df >= lo) & ((k * df <= hi) if closed else (k * df < hi))
    terms = F.zip_with(F.slice(psd, F.lit(1), F.size(psd) - 1), F.slice(psd, F.lit(2), F.size(psd) - 1), lambda a, b: (a + b) / 2 * df)
    kept = F.transform(terms, lambda v, k: F.when(inside(k) & inside(k + 1), v).otherwise(0.0))
    return F.aggregate(kept, F.lit(0.0), lambda s, v: s + v)


def relative_power(psd, df, fmin=1.0, fmax=40.0):
    """{band: share of the power in [fmin, fmax]}."""
    total = F.nullif(band_integral(psd, df, fmin, fmax, closed=True), F.lit(0.0))
    return {b: F.try_divide(band_integral(psd, df, lo, hi), total) for b, (lo, hi) in BANDS.items()}


def log_band(psd, df, lo, hi):
    return F.log(band_integral(psd, df, lo, hi) + 1e-30)


def _line(pts):
    """Least-squares line through points (x, y) flagged `m`."""
    acc = F.aggregate(pts, F.struct(*[F.lit(0.0).alias(c) for c in ("n", "x", "y", "xx", "xy")]), lambda s, p: F.when(p["m"], F.struct(
        (s["n"] + 1.0).alias("n"), (s["x"] + p["x"]).alias("x"), (s["y"] + p["y"]).alias("y"),
        (s["xx"] + p["x"] * p["x"]).alias("xx"), (s["xy"] + p["x"] * p["y"]).alias("xy"))).otherwise(s), lambda s: F.struct(
        F.try_divide(s["n"] * s["xy"] - s["x"] * s["y"], s["n"] * s["xx"] - s["x"] * s["x"]).alias("b"), s["n"].alias("n"), s["x"].alias("x"), s["y"].alias("y")))
    return acc


def aperiodic_fit(df, psd, step, fmin=1.0, fmax=40.0, rounds=5, threshold=1.0):
    """Adds `exponent` and `offset` of a log-log line refitted without high residuals.

    All rounds run inside the row on the (short) spectrum; a row whose mask stops
    changing, or would keep fewer than three points, is frozen.
    """
    idx = F.filter(F.sequence(F.lit(0), F.size(psd) - 1), lambda k: (k * step >= fmin) & (k * step <= fmax) & (k > 0))
    pts = F.transform(idx, lambda k: F.struct(F.log10(k * F.lit(float(step))).alias("x"), F.log10(F.get(psd, k)).alias("y"), F.lit(True).alias("m")))
    d = df.withColumns({"_pts": pts, "_done": F.lit(False)}).withColumn("_fit", _line(F.col("_pts")))
    d = d.withColumns({"_b": F.col("_fit.b"), "_a": (F.col("_fit.y") - F.col("_fit.b") * F.col("_fit.x")) / F.col("_fit.n")})
    for _ in range(rounds):
        resid = lambda p: p["y"] - (F.col("_a") + F.col("_b") * p["x"])
        mom = F.aggregate("_pts", F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), lambda s, p: F.when(p["m"], F.struct(
            (s["n"] + 1.0).alias("n"), (s["s"] + resid(p)).alias("s"), (s["q"] + resid(p) * resid(p)).alias("q"))).otherwise(s),
            lambda s: F.sqrt(F.greatest(s["q"] / s["n"] - (s["s"] / s["n"]) ** 2, F.lit(0.0))))
        d = d.withColumn("_sd", mom)
        d = d.withColumn("_new", F.transform("_pts", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"),
                         F.when(F.col("_sd") > 0, resid(p) < threshold * F.col("_sd")).otherwise(p["m"]).alias("m"))))
        stop = F.col("_done") | (F.size(F.filter("_new", lambda p: p["m"])) < 3) | (F.col("_new") == F.col("_pts"))
        d = d.withColumn("_done", stop).withColumn("_pts", F.when(F.col("_done"), F.col("_pts")).otherwise(F.col("_new"))).withColumn("_fit", _line(F.col("_pts")))
        d = d.withColumns({"_b": F.when(F.col("_done"), F.col("_b")).otherwise(F.col("_fit.b")),
                           "_a": F.when(F.col("_done"), F.col("_a")).otherwise((F.col("_fit.y") - F.col("_fit.b") * F.col("_fit.x")) / F.col("_fit.n"))})
    return d.withColumns({"exponent": -F.col("_b"), "offset": F.col("_a")}).drop("_pts", "_done", "_fit", "_b", "_a", "_sd", "_new")


def kuramoto(df, n_ch, fs, band, trim=0, x="x"):
    """Mean and SD (ddof 0) over time of |mean over channels of exp(i phase)|."""
    d = df.withColumn("_z", analytic(F.col(x), n_ch, fs, band))
    unit = lambda part: channels(F.zip_with(F.col("_z")["re"], F.col("_z")["im"], lambda r, i: F.try_divide(r if part == "re" else i, F.hypot(r, i))), n_ch)
    d = d.withColumns({"_c": unit("re"), "_s": unit("im")})
    n = F.size(F.col("_c")[0])
    over = lambda m, t: F.aggregate(F.transform(m, lambda a: F.get(a, t)), F.lit(0.0), lambda s, v: s + v) / n_ch
    d = d.withColumn("_r", F.transform(F.sequence(F.lit(trim), n - 1 - trim), lambda t: F.hypot(over(F.col("_c"), t), over(F.col("_s"), t))))
    mean = F.aggregate("_r", F.lit(0.0), lambda s, v: s + v) / F.size("_r")
    sq = F.aggregate("_r", F.lit(0.0), lambda s, v: s + v * v) / F.size("_r")
    return d.withColumns({"kuramoto_r": mean, "metastability": F.sqrt(F.greatest(sq - mean * mean, F.lit(0.0)))}).drop("_z", "_c", "_s", "_r")


def phase_lag_edges(df, keys, n_ch, fs, band, x="x"):
    """Weighted phase-lag index of every channel pair, pooled over the epochs of a key.

    Pairs are formed inside the packed row (a number fixed by the cap), and their two
    sums combine before the shuffle.
    """
    d = df.withColumn("_z", analytic(F.col(x), n_ch, fs, band)).withColumns({"_re": channels(F.col("_z")["re"], n_ch), "_im": channels(F.col("_z")["im"], n_ch)})
    pairs = F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j")) for a in range(n_ch) for b in range(a + 1, n_ch)])
    d = d.select(*keys, "_re", "_im", F.inline(pairs))
    prod = lambda p, q: F.zip_with(F.get(p, F.col("i")), F.get(q, F.col("j")), lambda a, b: a * b)
    im = F.zip_with(prod("_im", "_re"), prod("_re", "_im"), lambda a, b: a - b)
    s = d.select(*keys, "i", "j", F.aggregate(im, F.lit(0.0), lambda s, v: s + v).alias("num"), F.aggregate(im, F.lit(0.0), lambda s, v: s + F.abs(v)).alias("den"))
    g = s.groupBy(*keys, "i", "j").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
    return g.select(*keys, "i", "j", F.when(F.col("den") > 0, F.abs("num") / F.col("den")).otherwise(0.0).alias("w"))


def lagged_covariance(df, n_ch, lag, x="x"):
    """Adds s0 (with ridge) and s_lag as flattened n x n arrays."""
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    d = df.withColumn("_c", F.transform(channels(F.col(x), n_ch), lambda a: let(mean(a), lambda m: F.transform(a, lambda v: v - m))))
    n = F.size(F.col("_c")[0])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    s0 = F.flatten(F.transform("_c", lambda a: F.transform("_c", lambda b: dot(a, b) / n)))
    sl = F.flatten(F.transform("_c", lambda a: F.transform("_c", lambda b: dot(F.slice(a, lag + 1, n - lag), F.slice(b, F.lit(1), n - lag)) / (n - lag))))
    d = d.withColumns({"s0": s0, "s_lag": sl}).drop("_c")
    trace = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(n_ch - 1)), lambda k: F.get("s0", k * (n_ch + 1))), F.lit(0.0), lambda s, v: s + v)
    ridge = 1e-10 * trace / n_ch
    return d.withColumn("s0", F.transform("s0", lambda v, k: v + F.when(k % (n_ch + 1) == 0, ridge).otherwise(0.0)))


_PHI = StructType([StructField(c, DoubleType()) for c in ("phi_r", "phi_wms", "norm")])


def _mi(now, cross, past):
    """Gaussian information between a past and a present block."""
    cond = now - cross @ np.linalg.solve(past, np.swapaxes(cross, -1, -2))
    return 0.5 * (np.linalg.slogdet(now)[1] - np.linalg.slogdet(cond)[1])


def _partition_value(s0, sl, n_ch):
    """phi of one bipartition for a batch of units sharing the mask's index sets."""
    def value(a, b):
        sub = lambda m, r, c: m[:, r][:, :, c]
        info = lambda src, dst: _mi(sub(s0, dst, dst), sub(sl, dst, src), sub(s0, src, src))
        every = list(range(n_ch))
        wms = info(every, every) - info(a, a) - info(b, b)
        phi = wms + np.min([info(x, y) for x in (a, b) for y in (a, b)], axis=0)
        ent = [0.5 * (np.linalg.slogdet(sub(s0, p, p))[1] + len(p) * math.log(2 * math.pi * math.e)) for p in (a, b)]
        k = np.abs(np.minimum(*ent))
        return phi, wms, np.where(k > 0, phi / np.where(k > 0, k, 1.0), np.inf)
    return value


def integration(df, unit, n_ch):
    """Minimum-information bipartition: every mask once, exploded; the determinants of
    one mask's rows are computed as a batch; the smallest normalised value wins."""
    masks = [m for m in range(1, 2 ** (n_ch - 1))]

    @F.pandas_udf(_PHI)
    def run(mask: pd.Series, s0: pd.Series, sl: pd.Series) -> pd.DataFrame:
        out = np.full((len(mask), 3), np.nan)
        for m in mask.unique():
            at = np.flatnonzero(mask.to_numpy() == m)
            a = [c for c in range(n_ch) if (int(m) >> c) & 1]
            b = [c for c in range(n_ch) if not (int(m) >> c) & 1]
            mats = [np.stack([np.asarray(q.iloc[k], float).reshape(n_ch, n_ch) for k in at]) for q in (s0, sl)]
            out[at] = np.stack(_partition_value(*mats, n_ch)(a, b), axis=1)
        return pd.DataFrame(out, columns=["phi_r", "phi_wms", "norm"])

    d = df.withColumn("mask", F.explode(F.array(*[F.lit(m) for m in masks]))).withColumn("_p", run("mask", "s0", "s_lag"))
    best = d.groupBy(unit).agg(F.min_by(F.struct("mask", "_p"), F.struct(F.col("_p.norm"), F.col("mask"))).alias("_b"))
    return best.select(unit, F.col("_b.mask").alias("mask"), F.col("_b._p.phi_r").alias("phi_r"), F.col("_b._p.phi_wms").alias("phi_wms"), F.col("_b._p.norm").alias("phi_norm"))
