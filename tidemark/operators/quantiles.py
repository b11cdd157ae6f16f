"""Exact percentiles (linear interpolation) per key, safe for huge keys.

`percentile` keeps every distinct value of a key in one buffer, so it is used only after
a count per key has shown that every key is small.  Otherwise values are first counted
per (key, value), which combines before the shuffle and spreads a hot key over all tasks.  Counts per narrow value band then locate the bands that hold the wanted
ranks, and only the distinct values of those bands are ranked.  A key's band table is
bounded by the bands of a double, and a band spans 1/65536 of a factor of two.
"""

from pyspark.sql import Window, functions as F

from ..session import chunk_rows
from .ordered import _ONE, _keyed, any_above

_BUFFER_ROWS = 500_000  # values of one key that may sit in one aggregation buffer
_BANDS = 65536           # bands per factor of two
_SHIFT = 2048 * _BANDS   # moves every band number of a positive double above zero


def _band(v):
    b = F.floor(F.log2(F.abs(v)) * _BANDS) + F.lit(_SHIFT)
    return F.when(v == 0, F.lit(0)).when(v > 0, b).otherwise(-b).cast("long")


def quantiles(df, keys, value, probs, scan_twice=False):
    """One row per key with a column per entry of probs {name: p}; nulls are ignored.

    scan_twice suits a cheap input with few keys: band counts first, then only the rows
    of the wanted bands are read on, so almost nothing is shuffled.  Otherwise one pass
    over the input counts (key, value) and both steps share that exchange.
    """
    df, ks = _keyed(df.where(F.col(value).isNotNull()), keys)
    v = F.col(value).cast("double")
    if not any_above(df, ks, min(chunk_rows(df.sparkSession), _BUFFER_ROWS)):
        every = F.percentile(v, F.array(*[F.lit(float(p)) for p in probs.values()]))
        out = df.groupBy(*ks).agg(every.alias("_q")).select(*ks, *[F.col("_q")[k].alias(n) for k, n in enumerate(probs)])
        return out.drop(_ONE) if ks == [_ONE] else out
    d = df.select(*ks, _band(v).alias("_b"), v.alias("_v"))
    counts = d.groupBy(*ks, "_b", "_v").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*ks).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    per_band = d.groupBy(*ks, "_b").agg(F.count(F.lit(1)).alias("_bn")) if scan_twice else counts.groupBy(*ks, "_b").agg(F.sum("_n").alias("_bn"))
    bands = (
        per_band
        .withColumns({"_end": F.sum("_bn").over(upto), "_total": F.sum("_bn").over(Window.partitionBy(*ks))})
        .withColumn("_start", F.col("_end") - F.col("_bn"))
    )
    pos = {n: F.lit(float(p)) * (F.col("_total") - 1) for n, p in probs.items()}
    ranks = {(n, s): fn(pos[n]).cast("long") for n in probs for s, fn in (("lo", F.floor), ("hi", F.ceil))}
    inside = lambda r, a, b: (r >= a) & (r < b)
    wanted = None
    for r in ranks.values():
        c = inside(r, F.col("_start"), F.col("_end"))
        wanted = c if wanted is None else (wanted | c)
    cum = F.sum("_n").over(Window.partitionBy(*ks, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    if scan_twice:
        # AQE broadcasts the wanted bands when they are small (keys x probabilities x 2).
        counts = d.join(bands.where(wanted).select(*ks, "_b"), ks + ["_b"], "left_semi").groupBy(*ks, "_b", "_v").agg(F.count(F.lit(1)).alias("_n"))
    rows = counts.join(bands.where(wanted).select(*ks, "_b", "_start", "_total"), ks + ["_b"]).withColumn("_to", F.col("_start") + cum)
    picked = rows.groupBy(*ks).agg(F.max("_total").alias("_total"), *[
        F.max(F.when(inside(r, F.col("_to") - F.col("_n"), F.col("_to")), F.col("_v"))).alias(f"_{n}_{s}")
        for (n, s), r in ranks.items()
    ])
    out = picked.select(*ks, *[
        (F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * (pos[n] - F.floor(pos[n]))).alias(n) for n in probs
    ])
    return out.drop(_ONE) if ks == [_ONE] else out


def median(df, keys, value, name="median"):
    return quantiles(df, keys, value, {name: 0.5})
