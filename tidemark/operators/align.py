"""Clock alignment between two event logs and log-to-session assignment."""

import numpy as np
import pandas as pd
from pyspark.sql import Window, functions as F

from ..session import cut_lineage, spread as spread_out
from .ordered import any_above, numbered, running
from .quantiles import median

BAND = 4
PART_ROWS = 4_096   # rows of a key that are joined in one part
PAIRS = 1_000_000   # candidates x marks, or marks x log rows, that are compared at once
FINE = 8            # bins of a cell in which votes are counted
BLOCK = 8_192       # cells of a stretch of time or of offsets


def _near(keys, left, right, tol):
    """Pairs of left.x and right.t of one key closer than tol (right side in 3 cells)."""
    cell = lambda c: F.floor(c / tol).cast("long")
    r = right.withColumn("_cell", F.explode(F.array(*[cell(F.col("t")) + d for d in (-1, 0, 1)])))
    return (
        left.withColumn("_cell", cell(F.col("x"))).join(r, keys + ["_cell"])
        .where(F.abs(F.col("x") - F.col("t")) < tol).drop("_cell")
    )


def _candidates(keys, marks, logs, tol):
    near_rows = marks.withColumn("j", F.explode(F.sequence(F.col("i") - BAND, F.col("i") + BAND)))
    c = F.col("o") - F.col("t")
    return near_rows.join(logs.select(*keys, "j", "t"), keys + ["j"]).select(*keys, "parts", "i", "j", c.alias("c"), F.floor(c / tol).cast("long").alias("cell"))


def sized(keys, marks, logs):
    """marks and logs with `n`, the marks of their key, and `parts`, in how many parts a large key is joined; stored.

    Both lie in the session's full number of partitions by key: their rows are small, but all that a key's marks and log rows make
    together is not, and partitions merged by their bytes would make it in one task.
    """
    n = marks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / PART_ROWS).cast("int"))
    return tuple(cut_lineage(spread_out(d.join(n, keys), *keys)) for d in (marks, logs))


def _met(left, right, keys, ident, spread):
    """left joined with right on keys; where keys are large, right's parts each meet a copy of left's rows."""
    if not spread:
        return spread_out(left.drop("n", "parts"), *keys).join(spread_out(right.drop("n", "parts"), *keys), keys)
    copies = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("n", "parts")
    dealt = right.withColumn("part", F.pmod(F.xxhash64(ident), F.col("parts")).cast("int")).drop("n", "parts")
    return spread_out(copies, *keys, "part").join(spread_out(dealt, *keys, "part"), keys + ["part"])


def _hits(c, o, t, tol):
    """For every offset of c the number of marks o with any of the sorted log rows t within tol of it, as SQL counts them: |(o - c) - t| < tol."""
    out = np.empty(len(c), dtype=np.int64)
    step = max(1, PAIRS // len(o))
    for a in range(0, len(c), step):
        x = o - c[a:a + step, None]
        at = np.searchsorted(t, x)
        near = np.abs(x - t.take(at, mode="clip")) < tol
        near |= np.abs(x - t.take(at - 1, mode="clip")) < tol
        out[a:a + step] = near.sum(axis=1)
    return out


def _most_hits(c, o, t, tol):
    """Upper bounds of `_hits`: intervals of offsets that reach a mark, a little widened, counted at the sorted offsets c."""
    reach = tol + 16 * np.spacing(max(np.abs(o).max(), np.abs(t).max(), np.abs(c).max()))
    turns = np.zeros(len(c) + 1, dtype=np.int64)
    step = max(1, PAIRS // len(t))
    for a in range(0, len(o), step):
        d = o[a:a + step, None] - t[::-1]
        apart = np.diff(d, axis=1) > 2 * reach
        edge = np.ones((len(d), 1), dtype=bool)
        for at, sign in ((np.searchsorted(c, d[np.hstack([edge, apart])] - reach), 1), (np.searchsorted(c, d[np.hstack([apart, edge])] + reach, side="right"), -1)):
            turns += sign * np.bincount(at, minlength=len(turns))
    return np.cumsum(turns[:-1])


def best_candidate(i, o, j, t, tol):
    """(i, j, c, n) of the candidate with the highest score, the first by i and j among equals; None without candidates.

    i and j ascend. All marks and log rows count: candidates are scored in order of an upper bound until no bound reaches the best score.
    """
    low, high = np.searchsorted(j, i - BAND), np.searchsorted(j, i + BAND, side="right")
    many = high - low
    if not many.sum():
        return None
    a = np.repeat(np.arange(len(i)), many)
    b = np.arange(len(a)) + np.repeat(low - np.cumsum(many) + many, many)
    c, t = o[a] - t[b], np.sort(t)
    if len(c) * len(o) <= 20_000:
        n = _hits(c, o, t, tol)
    else:
        order = np.argsort(c, kind="stable")
        most = np.empty(len(c), dtype=np.int64)
        most[order] = _most_hits(c[order], o, t, tol)
        n, turn, step = np.full(len(c), -1), np.argsort(-most, kind="stable"), max(1, PAIRS // len(o))
        for at in range(0, len(turn), step):
            now = turn[at:at + step]
            if most[now[0]] < n.max():
                break
            n[now] = _hits(c[now], o, t, tol)
    best = np.flatnonzero(n == n.max())[0]
    return i[a[best]], j[b[best]], c[best], n[best]


def _arrays(df, keys, place, value):
    """One row per key: `place` and `value` of its rows as arrays, by place."""
    e = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(place, value))).alias("_e"))
    return e.select(*keys, *[F.transform("_e", lambda r: r[c]).alias(c) for c in (place, value)])  # noqa: B023


def _best(tol):
    @F.pandas_udf("i long, j long, c double, n long")
    def run(i: pd.Series, o: pd.Series, j: pd.Series, t: pd.Series) -> pd.DataFrame:
        rows = [best_candidate(*r, tol) or (0, 0, 0.0, 0) for r in zip(i, o, j, t)]
        return pd.DataFrame(rows, columns=["i", "j", "c", "n"])
    return run("i", "o", "j", "t").alias("_b")


def _oversize(df, keys):
    """The keys with more rows than one part, or None if there are none."""
    if not any_above(df, keys, PART_ROWS):
        return None
    return cut_lineage(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > PART_ROWS).select(*keys))


def _summed(frames, names):
    """Rows of (names, cells, fine, bins, counts, logs), sorted by names -> (names, cell, least, most), summed over the rows of equal names."""
    width = FINE * BLOCK
    at, cells, sums = None, None, None

    def out():
        return pd.DataFrame({**{n: [v] * len(cells) for n, v in zip(names, at)}, "cell": cells, "least": sums[0], "most": sums[1]})

    for df in frames:
        for row in zip(*(df[n] for n in names), df["cells"], df["fine"], df["bins"], df["counts"], df["logs"]):
            key, (mine, fine, bins, counts, logs) = row[:len(names)], row[len(names):]
            if key != at:
                if at is not None:
                    yield out()
                at, cells, sums = key, mine, np.zeros((2, len(mine)), dtype=np.int64)
            block = key[names.index("ob")]
            first = bins[0] // width - block - 1
            # Log rows by bin, from one stretch before; the windows of 12 and 27 bins are any() over them.
            seen = np.zeros(2 * width + 64, dtype=np.int64)
            seen[logs - first * width + 17] = 1
            total = np.concatenate([[0], np.cumsum(seen)])
            sure, maybe = total[23:] > total[11:-12], total[27:] > total[:-27]
            for k, (window, place) in enumerate(((sure, fine), (maybe, FINE * mine))):
                index = width - (place - block * width)
                for x, n in zip(bins - bins[0] // width * width, counts):
                    sums[k] += n * window.take(index + x)
    if at is not None:
        yield out()


def offset_votes(keys, marks, logs, cand, spread, tol):
    """(keys, parts, cell): the offset cells of width tol that may hold the best candidate.

    Every mark counts against all log rows of its key, at most once per cell. Times fall into bins of an eighth of a cell: the difference of two bins
    tells which offsets surely and which possibly bring a mark within tol of a log row. So a cell has an upper bound of its
    scores, and the first candidate in it a lower bound of its own; a cell whose upper bound is below another's lower bound is out.
    Stretches of marks meet stretches of offsets and the log rows between them, in parts where keys are large.
    """
    width = FINE * BLOCK
    place = lambda c: F.floor(F.col(c) * (FINE / tol)).cast("long")
    block = lambda c: F.floor(F.col(c) / width).cast("long")
    asked = cand.where("c is not null").groupBy(*keys, "parts", "cell").agg(F.min(place("c")).alias("fine")).withColumn("ob", F.floor(F.col("cell") / BLOCK).cast("long"))
    asked = cut_lineage(asked)
    each = asked.groupBy(*keys, "parts", "ob").agg(F.collect_list(F.struct("cell", "fine")).alias("_e"))
    stretches = marks.where("o is not null").groupBy(*keys, place("o").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    stretches = stretches.groupBy(*keys, block("bin").alias("mb")).agg(F.collect_list(F.struct("bin", "count")).alias("_m"))
    # A stretch of log rows with what the windows reach beyond it, by the difference of the stretches of marks and of offsets.
    seen = logs.where("t is not null").select(*keys, place("t").alias("bin")).distinct()
    steps = F.sequence(F.ceil((F.col("bin") - 8) / width).cast("long") - 1, F.floor((F.col("bin") + 17) / width).cast("long") + 1)
    between = seen.withColumn("step", F.explode(steps)).groupBy(*keys, "step").agg(F.collect_list("bin").alias("logs"))
    met = each.join(stretches, keys).withColumns({"step": F.col("mb") - F.col("ob"), "part": F.pmod("mb", "parts").cast("int") if spread else F.lit(0)}).join(between, [*keys, "step"])
    names = [*keys, "parts", "ob", "part"]
    rows = met.select(*names, F.col("_e.cell").alias("cells"), F.col("_e.fine").alias("fine"), F.col("_m.bin").alias("bins"), F.col("_m.count").alias("counts"), "logs")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*names).schema) + ", cell long, least long, most long"
    votes = spread_out(rows, *names).sortWithinPartitions(*names).mapInPandas(lambda frames: _summed(frames, names), schema)
    bound = cut_lineage(votes.groupBy(*keys, "parts", "cell").agg(F.sum("least").alias("least"), F.sum("most").alias("most")))
    top = bound.groupBy(*keys).agg(F.max("least").alias("_top"))
    return bound.join(top, keys).where(F.col("most") >= F.col("_top")).select(*keys, "parts", "cell")


def offset_scores(keys, marks, logs, tol):
    """marks(keys, i, o, n, parts), logs(keys, j, t, n, parts) of `sized` -> exact scores of the offsets that may be best: (keys, i, j, c, n).

    Candidates are differences of rows at most four places apart. A candidate's score is the number of marks with any
    log row within tol of it. A key's rows meet as arrays in one row, of which the best candidate is left; keys of more than one part are `_swept`.
    """
    long = [k for k in (_oversize(marks, keys), _oversize(logs, keys)) if k is not None]
    long = long[0] if len(long) == 1 else long[0].unionByName(long[1]).distinct() if long else None
    few = lambda d: spread_out(d if long is None else d.join(long, keys, "left_anti"), *keys)
    best = _arrays(few(marks), keys, "i", "o").join(_arrays(few(logs), keys, "j", "t"), keys).select(*keys, _best(tol)).select(*keys, "_b.*").where("n > 0")
    if long is None:
        return best
    return best.unionByName(_swept(keys, *(d.join(long, keys, "left_semi") for d in (marks, logs)), tol).select(best.columns))


def _swept(keys, marks, logs, tol):
    """`offset_scores` of keys with many rows.

    Votes keep a few cells of offsets per key; in these, every mark has a few intervals of offsets that
    reach it, and one ordered pass over interval ends and candidates gives all scores at once.
    """
    cand = _candidates(keys, marks, logs, tol)
    kept = offset_votes(keys, marks, logs, cand, True, tol)
    k, tcell = F.col("cell"), F.floor(F.col("t") / tol).cast("long")
    open_at = _met(kept, marks, keys, "i", True)
    reach = F.sequence(F.floor(F.col("o") / tol - k - 2).cast("long") - 1, F.floor(F.col("o") / tol - k + 1).cast("long") + 1)
    near = open_at.withColumn("_t", F.explode(reach)).join(logs.select(*keys, "t", tcell.alias("_t")), keys + ["_t"]).withColumn("d", F.col("o") - F.col("t"))
    near = near.where((F.col("d") > (k - 1.5) * tol) & (F.col("d") < (k + 2.5) * tol))
    seen = near.groupBy(*keys, "cell", "i").agg(F.array_sort(F.collect_set("d")).alias("d"))
    at = lambda name, ordinal, step, x: F.struct(x.alias("x"), F.lit(ordinal).alias("ord"), F.lit(step).alias("step"))
    begins = F.filter("d", lambda v, m: (m == 0) | (v - F.get("d", m - 1) >= 2 * tol))
    ends = F.filter("d", lambda v, m: (m == F.size("d") - 1) | (F.get("d", m + 1) - v >= 2 * tol))
    turns = F.concat(F.transform(begins, lambda v: at("b", 2, 1, v - tol)), F.transform(ends, lambda v: at("e", 0, -1, v + tol)))
    turns = seen.select(*keys, "cell", F.explode(turns).alias("e")).select(*keys, "cell", "e.x", "e.ord", "e.step", F.lit(None).cast("long").alias("i"), F.lit(None).cast("long").alias("j"))
    asked = cand.join(kept.drop("parts"), keys + ["cell"], "left_semi").select(*keys, "cell", F.col("c").alias("x"), F.lit(1).alias("ord"), F.lit(0).alias("step"), F.col("i").cast("long"), F.col("j").cast("long"))
    swept = running(turns.unionByName(asked), keys + ["cell"], ["x", "ord"], sums={"n": F.col("step").cast("long")}, root=(marks, keys))
    return swept.where("ord = 1").select(*keys, "i", "j", F.col("x").alias("c"), "n")


def pair_scores(marks, logs, tol):
    """marks(grp, ses, i, o), logs(grp, file, j, t) -> (grp, ses, file, score): the score of the best offset for every session and log file of a group.

    Rows travel once, by group; a pair is one row of arrays. Pairs of which one side has more rows than a part are joined by key.
    """
    sides = (marks, ["grp", "ses"], "i", "o"), (logs, ["grp", "file"], "j", "t")
    long = [_oversize(d, by) for d, by, *_ in sides]
    short = [_arrays(spread_out(d if k is None else d.join(k, by, "left_anti"), "grp"), by, *of) for (d, by, *of), k in zip(sides, long)]
    scored = short[0].join(short[1], "grp").select("grp", "ses", "file", _best(tol)).where("_b.n > 0").select("grp", "ses", "file", F.col("_b.n").alias("score"))
    if long == [None, None]:
        return scored
    keys = ["grp", "ses", "file"]
    pairs = marks.select("grp", "ses").distinct().join(logs.select("grp", "file").distinct(), "grp")
    rest = [pairs.join(k, by, "left_semi") for (_, by, *_), k in zip(sides, long) if k is not None]
    rest = cut_lineage(rest[0] if len(rest) == 1 else rest[0].unionByName(rest[1]).distinct())
    many = offset_scores(keys, *sized(keys, marks.join(rest, ["grp", "ses"]), logs.join(rest, ["grp", "file"])), tol)
    return scored.unionByName(many.groupBy(*keys).agg(F.max("n").alias("score")))


def _nearest(keys, marks, logs, best, tol):
    d = marks.join(best, keys).withColumn("x", F.col("o") - F.col("offset"))
    near = _near(keys, d, logs, tol)
    return near.groupBy(*keys, "i").agg(
        F.min(F.struct(F.abs(F.col("x") - F.col("t")).alias("a"), F.col("j"), (F.col("x") - F.col("t")).alias("d"))).alias("m")
    ).select(*keys, "i", "m.j", "m.d")


def align(keys, marks, logs, tol):
    """(offsets(keys, offset), matches(keys, i, j)) after two median refinements.

    Inputs and the running offset are checkpointed: every step reads them several times.
    """
    marks, logs = sized(keys, marks, logs)
    best = cut_lineage(offset_scores(keys, marks, logs, tol).groupBy(*keys).agg(
        F.max_by("c", F.struct("n", -F.col("i"), -F.col("j"))).alias("offset")))
    for _ in range(2):
        step = median(_nearest(keys, marks, logs, best, tol), keys, "d", "_m")
        best = best.join(step, keys, "left").select(*keys, (F.col("offset") + F.coalesce("_m", F.lit(0.0))).alias("offset"))
        best = cut_lineage(best)
    m = _nearest(keys, marks, logs, best, tol)
    # A log row claimed by several marks goes to the earliest one.
    matches = m.groupBy(*keys, "j").agg(F.min("i").alias("i")).select(*keys, "i", "j")
    return best, matches


def assign_greedy(pairs):
    """pairs(grp, left, right, score) -> one-to-one assignment by descending score.

    The pairs are scored once and stored. Each round keeps the pairs that are the best of both their sides (the ones a
    sequential greedy pass would also take) and removes their sides.  Every round
    settles at least one pair per group that has any, so it ends by itself.
    """
    open_pairs, out = cut_lineage(pairs.where("score > 0")), None
    while True:
        order = F.struct("score", -F.col("left"), -F.col("right"))
        bl = open_pairs.groupBy("grp", "left").agg(F.max_by("right", order).alias("right"))
        br = open_pairs.groupBy("grp", "right").agg(F.max_by("left", order).alias("left"))
        won = cut_lineage(open_pairs.join(bl, ["grp", "left", "right"]).join(br, ["grp", "left", "right"]).select("grp", "left", "right", "score"))
        if won.isEmpty():
            return out if out is not None else won
        out = won if out is None else out.unionByName(won)
        open_pairs = cut_lineage(open_pairs.join(won.select("grp", "left"), ["grp", "left"], "left_anti").join(
            won.select("grp", "right"), ["grp", "right"], "left_anti"))


def ordinals(df, t, tie, name):
    """0-based position of every row in its session."""
    return numbered(df, ["ses"], [t, tie], name).withColumn(name, (F.col(name) - 1).cast("long"))


def pick_first(df, keys, order):
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
