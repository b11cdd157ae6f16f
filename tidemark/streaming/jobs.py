"""Streaming twins of the decoding, epoching and filtering jobs.

Each job takes a streaming frame with an event-time column `ts` (TIMESTAMP) and returns
a streaming frame; run_available drains what is there into a parquet sink.
"""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import kalman as kf
from ..operators.decode import GLITCH_B, INVOLUNTARY_A, MARKER_A, MARKER_B, RESPONSES_A


def run_available(stream, sink, checkpoint, spark, mode="append"):
    """Process everything available, then read the sink back as a table."""
    q = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", sink).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(sink)


def epoch_amplitude(stream, delay, width):
    """Tumbling peak-to-peak and count per session and epoch."""
    return stream.withWatermark("ts", delay).groupBy("ses", F.window("ts", width).alias("w")).agg(
        (F.max("value") - F.min("value")).alias("ptp"), F.count(F.lit(1)).alias("n")).select("ses", F.col("w.start").alias("start"), "ptp", "n")


def segment_power(stream, delay, width, slide):
    """Sliding mean square over half-overlapping segments."""
    return stream.withWatermark("ts", delay).groupBy("ses", F.window("ts", width, slide).alias("w")).agg(
        F.avg(F.col("value") ** 2).alias("power"), F.count(F.lit(1)).alias("n")).select("ses", F.col("w.start").alias("start"), "power", "n")


def inactivity_sessions(stream, delay, gap):
    """Recordings separated by an inactivity gap."""
    return stream.withWatermark("ts", delay).groupBy("ses", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(
        "ses", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def drop_repeats(stream, delay, keys):
    """Repeated deliveries dropped within the watermark."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def masked_epochs(epochs, windows, delay, step_seconds, longest_seconds):
    """Stream-stream interval join: epochs(ses, eid, ts end) with windows(ses, ts start, w_end).

    Left outer: an epoch without any window is emitted once the watermark passes it.
    longest_seconds bounds the windows and so the state; a longer window fails the query.
    """
    e = epochs.select("ses", "eid", F.col("ts").alias("t_end")).withWatermark("t_end", delay)
    longest = F.expr(f"interval {int(longest_seconds)} seconds")
    fits = F.col("w_end") <= F.col("ts") + longest
    w = windows.select(F.col("ses").alias("wses"), F.col("ts").alias("w_start"),
                       F.when(fits, F.col("w_end")).otherwise(F.raise_error(F.lit("a window is longer than longest_seconds")).cast("timestamp")).alias("w_end")).withWatermark("w_start", delay)
    step = F.expr(f"interval {int(step_seconds)} seconds")
    cond = (F.col("ses") == F.col("wses")) & (F.col("t_end") > F.col("w_start")) & (F.col("t_end") - step < F.col("w_end")) & (F.col("t_end") < F.col("w_start") + longest + step)
    return e.join(w, cond, "leftOuter")


_PENDING = "p_ts array<double>, p_eid array<long>, p_code array<int>"


def _due(held, batches, st):
    """(rows the watermark has passed, rows still waiting), each as (ts, eid, code) in order."""
    rows = list(zip(*held))
    for b in batches:
        rows += [(ts.timestamp(), int(eid), int(code)) for ts, eid, code in zip(b["ts"], b["eid"], b["code"])]
    rows.sort()
    now = st.getCurrentWatermarkMs() / 1000.0
    cut = sum(r[0] <= now for r in rows)
    return rows[:cut], rows[cut:]


def _wake(st, times):
    """Event-time timer at the earliest of `times`, if any."""
    if times:
        st.setTimeoutTimestamp(max(int(min(times) * 1000), st.getCurrentWatermarkMs() + 1))


def probe_machine(stream, delay, late_seconds):
    """Marker opens a probe; codes within the limit are its responses, later ones late.

    Rows wait until the watermark has passed them and are then handled in time order, so the
    outcome does not depend on how they are spread over micro-batches.  A probe is emitted
    when the next marker is handled or the watermark passes its limit; codes after that are
    counted on the next emission of the session as late rows of the closed probe.
    """
    out = "ses long, probe long, onset double, n_codes long, n_late long, n_practice long, codes array<int>"
    state = "probe long, onset double, codes array<int>, n long, late long, practice long, open boolean, " + _PENDING

    def step(key, batches, st: GroupState):
        probe, onset, codes, n, late, practice, is_open, *held = st.get if st.exists else (0, None, [], 0, 0, 0, False, [], [], [])
        codes, rows = list(codes), []

        def emit():
            rows.append((key[0], probe, onset, n, late, practice if probe == 1 else 0, codes))

        due, waiting = _due(held, () if st.hasTimedOut else batches, st)
        for at, _, code in due:
            if code == GLITCH_B:
                continue
            if code == MARKER_B:
                if is_open or late:
                    emit()
                probe, onset, codes, n, late, is_open = probe + 1, at, [], 0, 0, True
            elif probe == 0:
                practice += 1
            elif at - onset <= late_seconds:
                n += 1
                codes.append(code)
            else:
                late += 1
        if (is_open and onset + late_seconds <= st.getCurrentWatermarkMs() / 1000.0) or (late and not is_open):
            emit()
            is_open, late = False, 0
        st.update((probe, onset, codes, n, late, practice, is_open, *(map(list, zip(*waiting)) if waiting else ([], [], []))))
        _wake(st, [w[0] for w in waiting[:1]] + ([onset + late_seconds] if is_open else []))
        yield pd.DataFrame(rows, columns=["ses", "probe", "onset", "n_codes", "n_late", "n_practice", "codes"])

    return stream.select("ses", "ts", "eid", "code").withWatermark("ts", delay).groupBy("ses").applyInPandasWithState(
        step, out, state, "append", GroupStateTimeout.EventTimeTimeout)


def open_probe_machine(stream, delay, idle_seconds):
    """Marker opens a probe that runs to the next marker; responses, their codes and
    involuntary marks are kept.

    Rows are handled in time order behind the watermark, as in probe_machine.  A probe is
    emitted when the next marker is handled, and also idle_seconds after the session's latest row;
    should responses follow that, it is emitted again with the new totals, so a reader
    keeps the row with most marks per (ses, probe).  Numbers go on after any pause.
    """
    out = "ses long, probe long, onset double, resp_end double, n_resp long, involuntary long, codes array<int>"
    state = "probe long, onset double, resp_end double, n long, inv long, codes array<int>, last double, news boolean, " + _PENDING

    def step(key, batches, st: GroupState):
        probe, onset, end, n, inv, codes, last, news, *held = st.get if st.exists else (0, None, None, 0, 0, [], 0.0, False, [], [], [])
        codes, rows = list(codes), []
        due, waiting = _due(held, () if st.hasTimedOut else batches, st)
        for at, _, code in due:
            last = at
            if code == MARKER_A:
                if news:
                    rows.append((key[0], probe, onset, end, n, inv, codes))
                probe, onset, end, n, inv, codes, news = probe + 1, at, None, 0, 0, [], True
            elif probe and code in RESPONSES_A:
                end, n, codes, news = at, n + 1, codes + [code], True
            elif probe and code == INVOLUNTARY_A:
                inv, news = inv + 1, True
        if news and last + idle_seconds <= st.getCurrentWatermarkMs() / 1000.0:
            rows.append((key[0], probe, onset, end, n, inv, codes))
            news = False
        st.update((probe, onset, end, n, inv, codes, last, news, *(map(list, zip(*waiting)) if waiting else ([], [], []))))
        _wake(st, [w[0] for w in waiting[:1]] + ([last + idle_seconds] if news else []))
        yield pd.DataFrame(rows, columns=["ses", "probe", "onset", "resp_end", "n_resp", "involuntary", "codes"])

    return stream.select("ses", "ts", "eid", "code").withWatermark("ts", delay).groupBy("ses").applyInPandasWithState(
        step, out, state, "append", GroupStateTimeout.EventTimeTimeout)


def online_filter(stream, params):
    """Latent state kept per session; each rating row yields its prediction before the
    update and its standardised innovation.  stream(ses, t, kind, v0, v1)."""
    grid = {n: [[float({**kf.NOMINAL, **params}[n])]] for n in kf.NAMES}
    out = "ses long, t double, rating double, pred double, pred_var double, z double"
    state = "t double, m0 double, m1 double, p00 double, p01 double, p11 double"

    def step(key, batches, st: GroupState):
        import numpy as np

        p = {n: np.asarray(v) for n, v in grid.items()}
        log = pd.concat(list(batches), ignore_index=True).sort_values(["t", "kind"])
        start, prev = None, None
        if st.exists:
            prev, *start = st.get
            prev = np.array([prev])
        cols = [log[c].to_numpy(float)[None, :] for c in ("t", "kind", "v0", "v1")]
        fin, rows = kf.run_batch(*cols, p, t_prev=prev, start=start, record=True)
        st.update((float(log["t"].iloc[-1]), *[float(x[0, 0]) for x in (fin.m0, fin.m1, fin.p00, fin.p01, fin.p11)]))
        keep = [k for k, kind in enumerate(log["kind"]) if kind == 1]
        val = lambda k, i: float(np.broadcast_to(rows[k][i], (1, 1))[0, 0])
        yield pd.DataFrame([(key[0], float(log["t"].iloc[k]), float(log["v0"].iloc[k]), val(k, 0), val(k, 1), val(k, 4)) for k in keep],
                           columns=["ses", "t", "rating", "pred", "pred_var", "z"])

    return stream.groupBy("ses").applyInPandasWithState(step, out, state, "append", GroupStateTimeout.NoTimeout)


def running_rating_mean(stream):
    """Each rating with the mean of the session's earlier ratings (0 for the first)."""
    def step(key, batches, st: GroupState):
        n, total = st.get if st.exists else (0, 0.0)
        rows = []
        log = pd.concat(list(batches), ignore_index=True).sort_values(["probe"])
        for probe, r in zip(log["probe"], log["rating"]):
            rows.append((key[0], probe, r, total / n if n else 0.0))
            n, total = n + 1, total + r
        st.update((n, total))
        yield pd.DataFrame(rows, columns=["ses", "probe", "rating", "prev_mean"])

    return stream.groupBy("ses").applyInPandasWithState(step, "ses long, probe long, rating double, prev_mean double", "n long, total double", "append", GroupStateTimeout.NoTimeout)
