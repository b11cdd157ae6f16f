"""One table of vectors streamed past resident pieces of another.

A slot is a piece of the resident side and a part of the other. Its resident rows (at most RESIDENT) are held by one
task; the rows of the other side come after them in Arrow batches and update a running result per resident
row. Pairs never leave the task. Two ways make slots:

* `whole_slots`: every row meets every row. The resident side is cut into P pieces and the other into G parts, so that rows are
  copied P or G times: n * n / RESIDENT copies at most. For symmetric work the pieces are ranges of the id, and a
  row is only sent to pieces of its own range or a later one: one triangle.
* `hashed_slots`: rows meet where a signature of random hyperplanes agrees in one of several tables. A bucket with more than
  RESIDENT rows is cut into several slots, so that no group is held whole. What is found is checked
  exactly; what no table brings together is missed, and `recall_shape` gives the number of tables for a wanted recall.
"""

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

RESIDENT = 65_536          # rows that a slot holds
WORK = 1 << 24             # products of rows that are worth a task of their own
BUCKET = 4_096             # rows of one hash bucket that a slot holds
BATCH = 2_048              # rows multiplied at once, fewer where many are resident:
CELLS = 1 << 21            # products of rows that a task holds at once


def matrix(series):
    return np.stack([np.asarray(v, float) for v in series])


def unit(m):
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _sides(resident, other, keys):
    cols = [*keys, "slot", "side", "id", "v"]
    rest = [c for c in other.columns if c not in cols]
    left, right = resident.withColumn("side", F.lit(0)), other.withColumn("side", F.lit(1))
    for c in rest:
        if c not in left.columns:
            left = left.withColumn(c, F.lit(None).cast(other.schema[c].dataType))
    return left.select(*cols, *rest).unionByName(right.select(*cols, *rest))


def whole_slots(resident, other, triangle=False):
    """Rows of both sides with their slots, dealt so that a partition is a slot.

    resident(id, v), other(id, v, ...). With `triangle` both sides hold the same ids, and a pair meets only in the slot of
    the larger id's range (both ways inside one range).
    """
    n = resident.count()
    m = n if triangle else other.count()
    spark = resident.sparkSession
    tasks = min(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, math.ceil(n * m / WORK)))
    p = max(1, math.ceil(n / RESIDENT), math.isqrt(tasks))
    g = max(1, math.ceil(tasks / p))
    part = F.pmod(F.xxhash64("id"), F.lit(g)).cast("int")
    if triangle and p > 1:
        cuts = resident.approxQuantile("id", [k / p for k in range(1, p)], 0.1 / p)
        piece = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(cuts)]), lambda c: c < F.col("id")))
        reach = F.sequence(piece, F.lit(p - 1))
    else:
        piece, reach = F.pmod(F.hash("id"), F.lit(p)).cast("int"), F.sequence(F.lit(0), F.lit(p - 1))
    left = resident.withColumn("_p", piece).withColumn("slot", F.explode(F.transform(F.sequence(F.lit(0), F.lit(g - 1)), lambda k: F.col("_p") * g + k)))
    right = other.withColumn("_g", part).withColumn("slot", F.explode(F.transform(reach, lambda k: k * g + F.col("_g"))))
    rows = _sides(left.drop("_p"), right.drop("_g"), [])
    return rows.repartitionById(p * g, F.col("slot").cast("int")).sortWithinPartitions("slot", "side", "id")


def planes(tables, bits, dims, seed):
    """Hyperplanes with entries of 1 and -1, [tables][bits][dims], by hash: equal wherever they are drawn."""
    draw = lambda *at: 1 - 2 * (hashlib.md5("|".join(map(str, (seed, *at))).encode()).digest()[0] & 1)
    return [[[draw(t, b, k) for k in range(dims)] for b in range(bits)] for t in range(tables)]


def recall_shape(rows, cosine, recall=0.95, per_bucket=128):
    """(tables, bits) by which a pair of the given cosine shares a bucket with the given probability.

    bits follow the number of rows, so that buckets keep their size as a table grows.
    """
    bits = max(2, round(math.log2(max(4, rows / per_bucket))))
    same = (1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - same))), bits


def hashed_slots(resident, other, tables, bits, seed, dims):
    """Rows of both sides, once per table, with slots of equal signature; vectors need `dims` entries."""
    w = np.array(planes(tables, bits, dims, seed), dtype=float).reshape(tables * bits, dims)
    place = (1 << np.arange(bits)).astype(np.int64)

    @F.pandas_udf("array<long>")
    def signature(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        s = (matrix(v) @ w.T >= 0).reshape(len(v), tables, bits) @ place
        return pd.Series(list(s))

    def keyed(df):
        return df.withColumn("_s", signature("v")).select(*df.columns, F.posexplode("_s").alias("tbl", "bucket"))

    left, right = keyed(resident), keyed(other)
    # Only buckets above the bound are listed: at most (rows x tables) / BUCKET of them.
    large = left.groupBy("tbl", "bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET).select("tbl", "bucket", F.ceil(F.col("n") / BUCKET).cast("int").alias("cuts"))
    cuts = F.coalesce("cuts", F.lit(1))
    left = left.join(large, ["tbl", "bucket"], "left").withColumn("slot", F.pmod(F.xxhash64("id"), cuts).cast("int")).drop("cuts")
    right = right.join(large, ["tbl", "bucket"], "left").withColumn("slot", F.explode(F.sequence(F.lit(0), cuts - 1))).drop("cuts")
    keys = ["tbl", "bucket"]
    rows = _sides(left, right, keys)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *keys, "slot").sortWithinPartitions(*keys, "slot", "side", "id")


def streamed(rows, kernel, schema):
    """Run a kernel over the slots of `rows`: kernel(ids, vectors) opens on the resident rows, take(frame) sees each batch
    of the other side, result() gives the frame of a slot. take() may return a frame of its own."""
    slot_cols = [c for c in ("tbl", "bucket", "slot") if c in rows.columns]

    def run(frames):
        key, held, state = None, [], None

        def opened():
            f = pd.concat(held)
            return kernel(f["id"].to_numpy(), matrix(f["v"]))

        for df in frames:
            at = df[slot_cols].to_numpy()
            side = df["side"].to_numpy()
            turn = np.flatnonzero((at[1:] != at[:-1]).any(axis=1) | (side[1:] != side[:-1])) + 1
            for a, b in zip([0, *turn], [*turn, len(df)]):
                if tuple(at[a]) != key:
                    if state is not None:
                        yield state.result()
                    key, held, state = tuple(at[a]), [], None
                if side[a] == 0:
                    held.append(df.iloc[a:b])
                    continue
                if state is None:
                    if not held:          # nothing resident here meets these rows
                        continue
                    state, held = opened(), []
                step = max(16, min(BATCH, CELLS // len(state.ids)))
                for c in range(a, b, step):
                    out = state.take(df.iloc[c:min(b, c + step)])
                    if out is not None:
                        yield out
        if state is not None:
            yield state.result()

    return rows.mapInPandas(run, schema)


class Softmax:
    """Running maximum, weight sum and weighted value of every resident row over all it has met."""

    def __init__(self, ids, q, scale):
        self.ids, self.q, self.scale = ids, q, scale
        self.m = np.full(len(ids), -np.inf)
        self.s, self.v = np.zeros(len(ids)), None

    def take(self, f):
        x = matrix(f["v"])
        z = self.q @ x.T * self.scale
        m = np.maximum(self.m, z.max(axis=1))
        w, old = np.exp(z - m[:, None]), np.exp(self.m - m)
        v = w @ (matrix(f["val"]) if "val" in f else x)
        self.v = v if self.v is None else self.v * old[:, None] + v
        self.s, self.m = self.s * old + w.sum(axis=1), m

    def result(self):
        return pd.DataFrame({"qid": self.ids, "m": self.m, "s": self.s, "v": list(self.v)})


NEGLIGIBLE = 64.0          # a weight of exp(-64) beside 1: a sum of doubles cannot show 1e11 of them


class Recall:
    """Softmax for sharp scores, of which all but a few of a row are negligible beside its largest.

    Only the others are exponentiated and added. A partial also holds what tells whether the result would attend to itself:
    the second largest score, its own score and its distance from the query (both times the scale), and the largest entry met.
    """

    def __init__(self, ids, q, scale):
        self.ids, self.q, self.scale = ids, q, scale
        self.whole, self.single = bool((q == np.rint(q)).all()), q.astype(np.float32)
        self.m, self.second = np.full(len(ids), -np.inf), np.full(len(ids), -np.inf)
        self.s, self.v, self.bound = np.zeros(len(ids)), np.zeros(q.shape), 0.0

    def take(self, f):
        x = matrix(f["v"])
        self.bound = max(self.bound, float(np.abs(x).max()))
        # Products of small whole numbers are exact in single precision.
        small = self.whole and (x == np.rint(x)).all() and np.abs(self.q).max() * self.bound * x.shape[1] < 1 << 24
        z = self.single @ x.T.astype(np.float32) if small else self.q @ x.T
        top = z.max(axis=1).astype(float) * self.scale
        m = np.maximum(self.m, top)
        self.second = np.maximum(self.second, np.minimum(self.m, top))
        near = np.flatnonzero(top > m - NEGLIGIBLE)
        if not len(near):
            return
        old = np.exp(self.m[near] - m[near])
        self.s[near] *= old
        self.v[near] *= old[:, None]
        self.m = m
        z = z[near]
        at, j = np.divmod(np.flatnonzero(z > ((m[near] - NEGLIGIBLE) / self.scale)[:, None].astype(z.dtype)), z.shape[1])
        i = near[at]
        score = z[at, j].astype(float) * self.scale
        order = np.lexsort((-score, i))
        i, j, score = i[order], j[order], score[order]
        first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        again = first[np.diff(np.r_[first, len(i)]) > 1]
        self.second[i[again]] = np.maximum(self.second[i[again]], score[again + 1])
        w = np.exp(score - m[i])
        self.s[i[first]] += np.add.reduceat(w, first)
        self.v[i[first]] += np.add.reduceat(w[:, None] * x[j], first)

    def result(self):
        x = self.v / self.s[:, None]
        return pd.DataFrame({"qid": self.ids, "m": self.m, "s": self.s, "v": list(self.v), "second": self.second, "own": self.scale * (x * x).sum(axis=1),
                             "off": self.scale * np.abs(x - self.q).sum(axis=1), "bound": self.bound})


class Earlier:
    """Largest cosine of every resident row to a row with a smaller id."""

    def __init__(self, ids, q):
        self.ids, self.q, self.best = ids, unit(q), np.full(len(ids), -np.inf)

    def take(self, f):
        c = self.q @ unit(matrix(f["v"])).T
        c[f["id"].to_numpy()[None, :] >= self.ids[:, None]] = -np.inf
        np.maximum(self.best, c.max(axis=1), out=self.best)

    def result(self):
        some = np.isfinite(self.best)
        return pd.DataFrame({"qid": self.ids[some], "best": self.best[some]})


class Top:
    """The n rows of largest cosine of every resident row, per value of the key; ties go to the smaller id."""

    def __init__(self, ids, q, n, key):
        self.ids, self.q, self.n, self.key, self.found = ids, unit(q), n, key, {}

    def take(self, f):
        iid = f["id"].to_numpy()
        c = np.round(self.q @ unit(matrix(f["v"])).T, 12)
        kinds = f[self.key].to_numpy() if self.key else np.zeros(len(f), dtype=int)
        for k in pd.unique(kinds):
            here = kinds == k
            score, name = c[:, here], iid[here]
            rows = np.arange(len(self.ids))
            if k in self.found:
                best, known = self.found[k]
                if best.shape[1] == self.n:
                    # Rows come by rising id, so that a later one needs a larger cosine.
                    last = np.where(np.isnan(best[:, -1:]), -np.inf, best[:, -1:])
                    rows = np.flatnonzero((score > last).any(axis=1))
                score = np.hstack([best[rows], score[rows]])
                name = np.hstack([known[rows], np.broadcast_to(name, (len(rows), len(name)))])
            else:
                name = np.broadcast_to(name, score.shape)
            # A stable order keeps the smaller id first.
            at = np.argsort(-score, axis=1, kind="stable")[:, :self.n]
            found = np.take_along_axis(score, at, 1), np.take_along_axis(name, at, 1)
            if len(rows) == len(self.ids):
                self.found[k] = found
            else:
                best[rows], known[rows] = found

    def result(self):
        out = []
        for k, (score, name) in self.found.items():
            o = pd.DataFrame({"qid": np.repeat(self.ids, score.shape[1]), "iid": name.ravel(), "cosine": score.ravel()})
            if self.key:
                o[self.key] = k
            out.append(o)
        return pd.concat(out)


class Forest:
    """Edges that connect what the threshold connects: one per row met, and one per resident row that joins another."""

    def __init__(self, ids, q, limit):
        self.ids, self.q, self.limit, self.up = ids, unit(q), limit, np.arange(len(ids))
        self.single = self.q.astype(np.float32)

    def root(self, k):
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def take(self, f):
        name, x = f["id"].to_numpy(), unit(matrix(f["v"]))
        # Single precision errs by less than `doubt` on unit vectors; what lies that close to the limit is multiplied in double precision.
        doubt = 2.0 ** -23 * (x.shape[1] + 4)
        c = x.astype(np.float32) @ self.single.T
        j, i = np.divmod(np.flatnonzero(c > np.float32(self.limit - doubt)), c.shape[1])
        kept = (self.ids[i] != name[j]) & (c[j, i] > self.limit + doubt)
        close = np.flatnonzero((self.ids[i] != name[j]) & ~kept)
        kept[close] = (x[j[close]] * self.q[i[close]]).sum(axis=1) > self.limit
        i, j = i[kept], j[kept]
        if not len(i):
            return None
        while (self.up[self.up] != self.up).any():
            self.up = self.up[self.up]
        at = np.flatnonzero(np.r_[True, j[1:] != j[:-1]])
        ends = np.r_[at[1:], len(i)]
        edges = list(zip(self.ids[i[at]], name[j[at]]))
        # Only rows that meet several trees join any.
        roots = self.up[i]
        for a, b in [(at[k], ends[k]) for k in np.flatnonzero(np.minimum.reduceat(roots, at) != np.maximum.reduceat(roots, at))]:
            first = self.root(i[a])
            for k in i[a + 1:b]:
                r = self.root(k)
                if r != first:
                    self.up[r] = first
                    edges.append((self.ids[k], name[j[a]]))
        return pd.DataFrame(edges, columns=["i", "j"], dtype="int64")

    def result(self):
        return pd.DataFrame({"i": [], "j": []}, dtype="int64")
