"""Probe windows, fixed epoch grids and interval masking."""

from pyspark.sql import functions as F


def probe_windows(probes, pad, no_response):
    """[onset, resp_end + pad], or [onset, onset + no_response] without a response."""
    return probes.select(
        "ses", F.col("onset").alias("w_start"),
        F.coalesce(F.col("resp_end") + pad, F.col("onset") + no_response).alias("w_end"),
    )


def epoch_grid(sessions, duration, step):
    """sessions(ses, <duration>) -> epochs 1..floor(duration/step) ending at step*k."""
    n = F.floor(F.col(duration) / step).cast("long")
    return sessions.where(n >= 1).select("ses", F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("epoch")).withColumn(
        "t_end", F.col("epoch") * F.lit(float(step)))


def covered_epochs(windows, step):
    """Every (ses, epoch) a window overlaps: t_end > start and t_end - step < end.

    The window is turned into the epoch numbers it can touch and checked with the exact
    strict bounds, so masking is an equi-join on (ses, epoch) that spreads a long
    session over all tasks instead of comparing all epochs with all windows.
    """
    first = F.greatest(F.floor(F.col("w_start") / step).cast("long"), F.lit(1).cast("long"))
    last = F.ceil(F.col("w_end") / step).cast("long") + 1
    e = windows.where(last >= first).select("ses", "w_start", "w_end", F.explode(F.sequence(first, last)).alias("epoch"))
    end = F.col("epoch") * F.lit(float(step))
    return e.where((end > F.col("w_start")) & (end - step < F.col("w_end"))).select("ses", "epoch").distinct()


def masked_grid(grid, windows, step):
    """The grid with `observed`: FALSE where a window overlaps the epoch."""
    hit = covered_epochs(windows, step).withColumn("_hit", F.lit(True))
    return grid.join(hit, ["ses", "epoch"], "left").withColumn("observed", F.col("_hit").isNull()).drop("_hit")


def session_design(grid, probes, sessions, rated_only=False):
    """Epochs, masked share, probes and length per session."""
    p = probes.where(F.col("rating").isNotNull()) if rated_only else probes
    g = grid.groupBy("ses").agg(F.count(F.lit(1)).alias("n_epochs"), F.count_if(~F.col("observed")).alias("n_masked"))
    n = p.groupBy("ses").agg(F.count(F.lit(1)).alias("n_probes"))
    return (
        sessions.join(g, "ses", "left").join(n, "ses", "left")
        .withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("n_epochs", "n_masked", "n_probes")})
        .withColumn("missing_frac", F.col("n_masked") / F.nullif(F.col("n_epochs"), F.lit(0)))
    )


def probe_schedule(sessions, n_epochs, every):
    """0-based probe epochs every-1, 2*every-1, ... below the session's epoch count."""
    n, p = F.col(n_epochs), F.col(every)
    return sessions.where((p >= 1) & (n >= p)).select(
        "ses", F.explode(F.sequence(p - 1, n - 1, p)).alias("epoch"))


def asof_epoch(probes, grid_step, n_epochs):
    """Last epoch strictly before each probe, clamped to the first epoch.

    On a fixed grid the as-of match is arithmetic: epoch ends at step*k.
    """
    k = F.ceil((F.col("onset") - 1e-9) / grid_step) - 1
    return probes.withColumn("epoch", F.least(F.greatest(k, F.lit(1)), F.col(n_epochs)).cast("long"))


def asof_join(left, right, keys, t, values, slack=1e-9, rows=None):
    """For each left row the latest right row of its key with right.t < left.t - slack,
    clamped to the first right row.  One union and one running scan, no pair blow-up.
    """
    from .ordered import running

    first = right.groupBy(*keys).agg(F.min_by(F.struct(t, *values), F.col(t)).alias("_first"))
    a = left.withColumns({"_side": F.lit(0), "_at": F.col(t) - slack})
    b = right.select(*keys, F.struct(t, *values).alias("_row")).withColumns({"_side": F.lit(1), "_at": F.col("_row")[t]})
    u = a.unionByName(b, allowMissingColumns=True)
    # At equal times left rows sort first, which keeps the match strict.
    d = running(u, keys, ["_at", "_side"], lasts={"_hit": F.col("_row")}, rows=rows).where("_side = 0").join(first, list(keys), "left")
    hit = F.coalesce("_hit", "_first")
    return d.select(*left.columns, hit[t].alias(f"asof_{t}"), *[hit[v].alias(v) for v in values])
