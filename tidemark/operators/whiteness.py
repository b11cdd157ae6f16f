"""Autocorrelation statistics and average ranks."""

from pyspark.sql import functions as F

from .ordered import numbered, running


def ljung_box(df, keys, t, value, lags):
    """Q over min(lags, n/4) lags per key; NULL when n < lags + 5, 0 without variance.

    Lag products come from an equi-join on (key, position), so no key meets itself as a
    whole; each row is repeated once per lag.
    """
    keys = list(keys)
    d = numbered(df, keys, [t], "_k")
    m = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("_m"), F.var_pop(value).alias("_c0"))
    m = m.withColumn("_lags", F.least(F.lit(lags), F.floor(F.col("n") / 4)).cast("int"))
    x = d.join(m, keys).select(*keys, "_k", (F.col(value) - F.col("_m")).alias("_x"), "_lags")
    a = x.where("_lags >= 1").select(*keys, F.col("_x").alias("_a"), "_k", F.explode(F.sequence(F.lit(1), F.col("_lags"))).alias("_l")).withColumn("_k", F.col("_k") + F.col("_l"))
    r = a.join(x.select(*keys, "_k", F.col("_x").alias("_b")), keys + ["_k"]).groupBy(*keys, "_l").agg(F.sum(F.col("_a") * F.col("_b")).alias("_s"))
    s = r.join(m, keys).where("_c0 > 1e-15").groupBy(*keys).agg(
        F.sum((F.col("_s") / (F.col("n") * F.col("_c0"))) ** 2 / (F.col("n") - F.col("_l"))).alias("_q"))
    usable = (F.col("_lags") >= 1) & (F.col("n") >= lags + 5)
    return m.join(s, keys, "left").select(
        *keys, "n", F.when(usable, F.col("_lags")).alias("lags"),
        F.when(usable, F.coalesce(F.col("n") * (F.col("n") + 2) * F.col("_q"), F.lit(0.0))).alias("q"))


def average_ranks(df, keys, value, name):
    """Rank of each row in its key, ties sharing their mean rank.

    Equal values are counted first, so the ordered scan sees distinct values only.
    """
    keys = list(keys)
    c = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    r = running(c, keys, [value], sums={"_to": F.col("_c")}).select(*keys, value, (F.col("_to") - (F.col("_c") - 1) / 2.0).alias(name))
    return df.join(r, keys + [value])
