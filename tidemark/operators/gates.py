"""Threshold gates, content locks and fingerprints."""

from pyspark.sql import functions as F


def gate(metrics, thresholds, keys, now):
    """metrics(keys, metric, value) x thresholds(metric, op, bound) -> one verdict per key."""
    ok = (
        F.when(F.col("op") == ">=", F.col("value") >= F.col("bound")).when(F.col("op") == "<=", F.col("value") <= F.col("bound"))
        .when(F.col("op") == "<", F.col("value") < F.col("bound")).otherwise(F.col("value") > F.col("bound"))
    )
    d = metrics.join(thresholds, "metric").withColumn("ok", F.coalesce(ok, F.lit(False)))
    # One entry per threshold, a fixed short list.
    detail = F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", F.round("value", 6).alias("value"))))))
    return d.groupBy(*keys).agg(F.bool_and("ok").alias("passed"), F.count_if(~F.col("ok")).alias("n_failed"), detail.alias("details")).withColumn("time_utc", F.lit(now))


def content_lock(current, recorded, ident, content):
    """Compare SHA-256 of the content with the recorded digest."""
    c = current.select(ident, F.sha2(F.col(content), 256).alias("sha256"))
    d = c.join(recorded.select(ident, F.col("sha256").alias("_locked")), ident, "full_outer")
    status = F.when(F.col("_locked").isNull(), "unlocked").when(F.col("sha256").isNull(), "missing").when(F.col("sha256") == F.col("_locked"), "ok").otherwise("changed")
    return d.select(ident, status.alias("status"))


def fingerprint(df, keys, ident, cols):
    """Order-independent digest of a work set's rows.

    Row digests are summed as numbers in four 32-bit lanes, so a large set combines
    before the shuffle and is never collected; the lane sums identify the set.
    """
    h = F.md5(F.concat_ws("␟", F.col(ident).cast("string"), *[F.coalesce(F.col(c).cast("string"), F.lit("␀")) for c in cols]))
    lane = lambda k: F.sum(F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long"))
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *[lane(k).alias(f"_l{k}") for k in range(4)])
    return g.select(*keys, "n_rows", F.sha2(F.concat_ws("|", "n_rows", *[F.col(f"_l{k}") for k in range(4)]), 256).alias("fingerprint"))


def latest(records, known, key, time):
    """Every known gate with its latest verdict and time."""
    r = records.groupBy(key).agg(F.max_by("passed", time).alias("passed"), F.max(time).alias("time"))
    verdict = F.when(F.col("passed").isNull(), "-").when(F.col("passed"), "PASS").otherwise("FAIL")
    return known.join(r, key, "left").select(*known.columns, verdict.alias("verdict"), "time")


def intervals_overlap(lo1, hi1, lo2, hi2):
    return F.coalesce((lo2 <= hi1) & (lo1 <= hi2), F.lit(False))
