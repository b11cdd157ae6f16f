"""Marker logs -> probe tables -> ratings (sessionisation, routing, diagnostics)."""

from pyspark.sql import functions as F

from .ordered import running

# Fixed values of the two code books.
MARKER_A, RESPONSES_A, INVOLUNTARY_A = 128, (2, 4, 8), 16
MARKER_B, GLITCH_B = 100, 0
CONFIDENCE_RANGE = (1, 7)
ITEMS_B = 6


def trigger_code(text):
    """Integer of a trigger text, NULL for any other text."""
    return F.nullif(F.regexp_extract(text, r"^RS232 Trigger: (\d+)", 1), F.lit("")).try_cast("int")


def probes_a(log):
    """log(ses, eid, t, code) -> one row per probe with its first three responses.

    The probe number is a running count of markers; the rank of a response inside its
    probe is a running count within the probe, so nothing collects a whole probe.
    """
    is_resp = F.col("code").isin(*RESPONSES_A)
    d = running(log, ["ses"], ["t", "eid"], sums={"probe": F.when(F.col("code") == MARKER_A, 1).otherwise(0)})
    d = d.where(F.col("probe") > 0)
    d = running(d, ["ses", "probe"], ["t", "eid"], sums={"rank": F.when(is_resp, 1).otherwise(0)}, root=(log, ["ses"]))
    nth = [F.max(F.when(is_resp & (F.col("rank") == k), F.col("code"))).alias(f"c{k}") for k in (1, 2, 3)]
    return d.groupBy("ses", "probe").agg(
        F.min(F.when(F.col("code") == MARKER_A, F.col("t"))).alias("onset"),
        F.max(F.when(is_resp, F.col("t"))).alias("resp_end"),
        F.count_if(is_resp).alias("n_resp"),
        F.count_if(F.col("code") == INVOLUNTARY_A).alias("involuntary"),
        *nth,
    )


def key_of(code):
    """Pressed key behind a response code: log2."""
    return F.log2(code.cast("double")).cast("int")


def decode_a(probes, matched=None):
    """Answers q1..q3 and rating q1 - q2: the log's keys where matched, else the codes
    when exactly three responses were seen, else NULL."""
    d = probes
    if matched is not None:
        d = d.join(matched, ["ses", "probe"], "left")
    else:
        d = d.withColumns({f"k{i}": F.lit(None).cast("int") for i in (1, 2, 3)} | {"log_row": F.lit(None).cast("long")})
    from_log, full = F.col("log_row").isNotNull(), F.col("n_resp") == 3
    d = d.withColumns({
        f"q{i}": F.when(from_log, F.col(f"k{i}")).when(full, key_of(F.col(f"c{i}"))) for i in (1, 2, 3)
    })
    return d.withColumns({
        "source": F.when(from_log, "behaviour").when(full, "events").otherwise("none"),
        "rating": (F.col("q1") - F.col("q2")).cast("double"),
    })


def probes_b(log, window):
    """log(ses, eid, t, code) -> probes with at most `window` of response time.

    Codes before the first marker belong to the first probe as practice; later codes
    past the limit are counted as late.  The first six codes are kept by rank.
    """
    live = log.where(F.col("code").isNotNull() & (F.col("code") != GLITCH_B))
    marker = F.col("code") == MARKER_B
    d = running(
        live, ["ses"], ["t", "eid"],
        sums={"probe": F.when(marker, 1).otherwise(0)},
        lasts={"onset": F.when(marker, F.col("t"))},
    )
    on_time = ~marker & (F.col("probe") > 0) & (F.col("t") - F.col("onset") <= window)
    late = ~marker & (F.col("probe") > 0) & (F.col("t") - F.col("onset") > window)
    d = d.withColumns({"_ok": on_time, "_late": late, "_mark": marker})
    d = running(d, ["ses", "probe"], ["t", "eid"], sums={"rank": F.when(F.col("_ok"), 1).otherwise(0)}, root=(live, ["ses"]))
    nth = [F.max(F.when(F.col("_ok") & (F.col("rank") == k), F.col("code"))).alias(f"c{k}") for k in range(1, ITEMS_B + 1)]
    p = d.groupBy("ses", "probe").agg(
        F.min("onset").alias("onset"),
        F.max(F.when(F.col("_ok"), F.col("t"))).alias("resp_end"),
        F.count_if("_ok").alias("n_codes"),
        F.count_if("_late").alias("n_late"),
        F.count(F.lit(1)).alias("_rows"),
        *nth,
    )
    practice = p.where("probe = 0").select("ses", F.col("_rows").alias("_practice"))
    return (
        p.where("probe > 0").join(practice, "ses", "left")
        .withColumn("n_practice", F.when(F.col("probe") == 1, F.coalesce("_practice", F.lit(0))).otherwise(0).cast("long"))
        .drop("_rows", "_practice")
    )


def decode_b(p):
    """Answer routing and signed confidence of a code-book B probe table."""
    a, conf = F.col("c1"), F.col("c2")
    lo, hi = CONFIDENCE_RANGE
    valid = F.coalesce(a.isin(1, 2, 3) & conf.between(lo, hi), F.lit(False))
    return p.withColumns({
        "answer": a, "confidence": conf, "sleepiness": F.col("c3"),
        "focus": F.when(a == 1, F.col("c4")),
        "engagement": F.when(a == 2, F.col("c4")),
        "visual": F.when(a == 2, F.col("c5")),
        "auditory": F.when(a == 2, F.col("c6")),
        "sensation": F.when(a == 3, F.col("c4")),
        "valid": valid,
        "rating": F.when(valid, F.when(a == 1, conf).otherwise(-conf)).cast("double"),
    })


def answers_from_presses(presses):
    """presses(ses, probe, ord, key, status) -> first valid press per status 1..3."""
    ok = presses.where(F.col("key").between(0, 3) & F.col("status").between(1, 3))
    return ok.groupBy("ses", "probe").agg(*[
        F.min_by("key", F.when(F.col("status") == s, F.col("ord"))).alias(f"k{s}") for s in (1, 2, 3)
    ])


def decode_diagnostics(d):
    """Per session and in total (grouping sets): matches, known answers, agreement of
    the log's non-zero keys with the codes seen, and the guarded rates."""
    keys = F.array_compact(F.array("k1", "k2", "k3"))
    nz = F.transform(F.filter(keys, lambda k: k != 0), lambda k: F.pow(F.lit(2), k).cast("int"))
    codes = F.array_compact(F.array("c1", "c2", "c3"))
    agree = F.aggregate(F.zip_with(nz, codes, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, v: s + F.coalesce(v, F.lit(0)))
    m = F.col("log_row").isNotNull()
    e = d.select(
        "ses", m.alias("m"), (F.col("q1").isNotNull() & F.col("q2").isNotNull()).alias("known"),
        F.when(m, agree).otherwise(0).alias("agree"), F.when(m, F.size(nz)).otherwise(0).alias("nz"),
        F.when(m, F.size(keys) - F.size(nz)).otherwise(0).alias("zero"),
        F.when(m, F.col("n_resp") - F.size(nz)).otherwise(0).alias("excess"),
    )
    s = e.rollup("ses").agg(
        F.count(F.lit(1)).alias("n_probe"), F.count_if("m").alias("n_matched"), F.count_if("known").alias("n_known"),
        F.sum("agree").cast("long").alias("code_agree"), F.sum("nz").cast("long").alias("code_total"),
        F.sum("zero").cast("long").alias("key0_total"),
        F.sum(F.greatest("excess", F.lit(0))).cast("long").alias("key0_with_trigger"),
        F.sum(F.greatest(-F.col("excess"), F.lit(0))).cast("long").alias("nonzero_without_trigger"),
    )
    rate = lambda a, b: F.round(F.col(a) / F.greatest(F.col(b), F.lit(1)), 6)
    return s.withColumns({
        "match_rate": rate("n_matched", "n_probe"), "known_rate": rate("n_known", "n_probe"),
        "code_agreement": rate("code_agree", "code_total"), "key0_rate": rate("key0_with_trigger", "key0_total"),
    })
