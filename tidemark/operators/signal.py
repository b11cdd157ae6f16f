"""Epoching of sampled signals, artifact rules and channel mapping."""

from itertools import chain

from pyspark.sql import Window, functions as F

from .ordered import numbered, running
from .quantiles import median, quantiles

MAD_SCALE = 1.4826

# Old electrode names and the net positions of the standard channels.
ALIASES = {"T3": "T7", "T4": "T8", "T5": "P7", "T6": "P8"}
NET_CHANNELS = {
    "Fp1": "E22", "Fp2": "E9", "F7": "E33", "F3": "E24", "Fz": "E11", "F4": "E124", "F8": "E122",
    "T7": "E45", "C3": "E36", "Cz": "Cz", "C4": "E104", "T8": "E108", "P7": "E58", "P3": "E52",
    "Pz": "E62", "P4": "E92", "P8": "E96", "O1": "E70", "O2": "E83",
}
# Channel sets of the features.
POSTERIOR = ("Pz", "POz", "P3", "P4", "PO3", "PO4", "O1", "O2", "Oz")
FRONTAL = ("AFz", "Fz", "FCz", "Cz")
COMMON = ("Fp1", "Fp2", "F7", "F3", "Fz", "F4", "F8", "T7", "C3", "Cz", "C4", "T8", "P7", "P3", "Pz", "P4", "P8", "O1", "O2")


def lookup(mapping, key):
    """A fixed dictionary as a map column lookup."""
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.try_element_at(m, key)


def epoch_samples(samples, size):
    """samples(rec, i, ch, v) -> packed rows (rec, epoch, ch, x) of one epoch each.

    An epoch holds at most `size` samples per channel, so the arrays are bounded.
    """
    e = samples.withColumn("epoch", F.floor(F.col("i") / size).cast("long"))
    packed = e.groupBy("rec", "epoch", "ch").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("s"))
    return packed.select("rec", "epoch", "ch", F.transform("s", lambda q: q["v"]).alias("x"))


def peak_to_peak(samples, size):
    """(rec, epoch, ch, ptp) straight from the samples; combines before the shuffle."""
    e = samples.withColumn("epoch", F.floor(F.col("i") / size).cast("long"))
    return e.groupBy("rec", "epoch", "ch").agg((F.max("v") - F.min("v")).alias("ptp"))


def fixed_rule(ptp, limit):
    """reject: any channel above the limit; keep: all channels below it (both strict)."""
    return ptp.groupBy("rec", "epoch").agg(
        F.bool_or(F.col("ptp") > limit).alias("reject"), F.bool_and(F.col("ptp") < limit).alias("keep"))


def adaptive_rule(ptp, channels, limit, n_mad=5.0):
    """Reject when the epoch's largest feature-channel value is above
    max(limit, median + n_mad * scaled MAD) of its recording."""
    mx = ptp.where(F.col("ch").isin(*channels)).groupBy("rec", "epoch").agg(F.max("ptp").alias("mx"))
    med = median(mx, ["rec"], "mx", "med")
    dev = mx.join(med, "rec").withColumn("dev", F.abs(F.col("mx") - F.col("med")))
    mad = median(dev, ["rec"], "dev", "mad")
    cut = F.greatest(F.lit(float(limit)), F.col("med") + n_mad * MAD_SCALE * F.col("mad"))
    return dev.join(mad, "rec").select("rec", "epoch", "mx", cut.alias("cut"), (F.col("mx") > cut).alias("reject"))


def bad_channels(samples, z_limit):
    """Channels whose log variance is a robust outlier within the recording."""
    lv = samples.groupBy("rec", "ch").agg(F.log(F.var_pop("v") + 1e-30).alias("lv"))
    med = median(lv, ["rec"], "lv", "med")
    d = lv.join(med, "rec").withColumn("dev", F.abs(F.col("lv") - F.col("med")))
    mad = median(d, ["rec"], "dev", "mad")
    z = F.col("dev") / (MAD_SCALE * F.col("mad") + 1e-12)
    return d.join(mad, "rec").select("rec", "ch", z.alias("z"), (z > z_limit).alias("bad"))


def average_reference(samples):
    """Subtract the across-channel mean at each sample (a window of one row per channel)."""
    return samples.withColumn("v", F.col("v") - F.avg("v").over(Window.partitionBy("rec", "i")))


def rename_channels(channels, key):
    """channels(key, name) -> (key, target, source): exact name first, then alias."""
    upper = F.upper("name")
    exact = lookup({c.upper(): c for c in COMMON}, upper)
    alias = lookup({k.upper(): v for k, v in ALIASES.items()}, upper)
    d = channels.select(key, "name", F.coalesce(exact, alias).alias("target"), F.when(exact.isNotNull(), 0).otherwise(1).alias("rank"))
    return d.where(F.col("target").isNotNull()).groupBy(key, "target").agg(F.min_by("name", F.struct("rank", "name")).alias("source"))


def net_channels(channels, key):
    """Net-numbered recordings (more than half the names E<n>) mapped by the net table."""
    share = channels.groupBy(key).agg(F.avg(F.col("name").rlike(r"^E\d+$").cast("int")).alias("share")).where("share > 0.5")
    back = lookup({v: k for k, v in NET_CHANNELS.items()}, F.col("name"))
    return channels.join(share.select(key), key, "left_semi").select(key, F.col("name").alias("source"), back.alias("target")).where("target is not null")


def nearest_electrodes(sources, targets, key):
    """Best source by cosine of centred unit vectors for each target of one recording.

    Both sides are one recording's electrodes, a number fixed by the cap, matched by an
    equi-join on the recording.
    """
    n = F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("z").alias("mz")
    centre = sources.groupBy(key).agg(*n)

    def unit(d):
        c = d.join(centre, key).withColumns({a: F.col(a) - F.col(f"m{a}") for a in "xyz"})
        norm = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
        return c.withColumns({a: F.col(a) / norm for a in "xyz"}).drop("mx", "my", "mz")

    s = unit(sources).select(key, F.col("ch").alias("source"), *[F.col(a).alias(f"s{a}") for a in "xyz"])
    t = unit(targets).select(key, F.col("ch").alias("target"), "x", "y", "z")
    cos = F.col("x") * F.col("sx") + F.col("y") * F.col("sy") + F.col("z") * F.col("sz")
    return t.join(s, key).groupBy(key, "target").agg(
        F.min_by("source", F.struct(-cos, "source")).alias("source"), F.max(cos).alias("cosine"))


def repeat_phase(rows, key, i, cols, repeat):
    """Most frequent position (mod repeat) at which a run of identical rows starts."""
    d = running(rows, [key], [i], lags={"_prev": F.struct(*cols)})
    starts = d.where(F.col("_prev").isNotNull() & (F.struct(*cols) != F.col("_prev")))
    counts = starts.groupBy(key, F.pmod(F.col(i), F.lit(repeat)).alias("phase")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.max_by("phase", F.struct("n", -F.col("phase"))).alias("phase"))


def decimate(rows, key, i, cols, repeat):
    ph = repeat_phase(rows, key, i, cols, repeat)
    d = rows.join(ph, key, "left")
    return d.where(F.pmod(F.col(i), F.lit(repeat)) == F.coalesce("phase", F.lit(0))).drop("phase")


def trim_missing_tail(rows, key, i, bad):
    """Cut at the first bad sample, only when the last sample is bad."""
    e = rows.groupBy(key).agg(
        F.min(F.when(bad, F.col(i))).alias("_first"), F.max(F.when(bad, F.col(i))).alias("_lastbad"), F.max(i).alias("_last"))
    return rows.join(e, key).where((F.col("_lastbad").isNull()) | (F.col("_lastbad") < F.col("_last")) | (F.col(i) < F.col("_first"))).drop("_first", "_lastbad", "_last")


def equalise(rows, cond, ident, seed):
    """Deterministic subsample of the smallest condition's size from every condition."""
    from ..functions.draws import uniform

    d = rows.withColumn("_u", uniform(F.lit(seed), F.col(ident)))
    n = rows.groupBy(cond).count().agg(F.min("count").alias("_m"))
    r = numbered(d, [cond], ["_u", ident], "_r")
    return r.join(F.broadcast(n)).where("_r <= _m").drop("_u", "_r", "_m")


def reason_counts(epochs):
    """epochs(rec, epoch, masked, locked, adaptive) -> counts of the combined rules."""
    m = F.col("masked")
    return epochs.groupBy("rec").agg(
        F.count(F.lit(1)).alias("n_epochs"), F.count_if(m).alias("probe_window"),
        F.count_if(~m & F.col("locked")).alias("amplitude"), F.count_if(~m & F.col("adaptive")).alias("amplitude_adaptive"),
        F.count_if(~m & ~F.col("locked")).alias("observed"))


def artifact_survey(epochs, value="mx"):
    """Missing share under each rule side by side and the median amplitude."""
    s = epochs.groupBy("rec").agg(*[F.avg(c.cast("int")).alias(n) for n, c in {
        "probe_only": F.col("masked"), "fixed": F.col("masked") | F.col("locked"),
        "adaptive": F.col("masked") | F.col("adaptive"), "either": F.col("masked") | F.col("locked") | F.col("adaptive")}.items()])
    return s.join(quantiles(epochs, ["rec"], value, {"median_ptp": 0.5}), "rec")
