"""Resampling as weights: a unit meets every replicate in its own row.

The weight or sign of a unit in replicate r is cut from a hash of (seed, r, unit), so a recomputed task
draws the same.  Units are aggregated rows (subjects, sessions, studies); the replicate side is what Spark spreads.
"""

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..session import spread


# 65536 times the Poisson(1) distribution function, as hexadecimal text.
POISSON = ("5e2d", "bc5a", "eb71", "fb23", "ff10", "ffd9", "fffa", "ffff")
WEIGHTS, HELD, BUNDLE = 2_000_000, 8_000_000, 16  # weights of a slice of units, sums of all keys that a task holds, keys of one product


def poisson_weight(digits):
    """Poisson(1) weight of four hexadecimal digits, by comparing text."""
    out = F.lit(len(POISSON))
    for k in range(len(POISSON) - 1, -1, -1):
        out = F.when(digits < POISSON[k], F.lit(k)).otherwise(out)
    return out


def sql_poisson(digits):
    return "CASE " + " ".join(f"WHEN {digits}<'{x}' THEN {k}" for k, x in enumerate(POISSON)) + f" ELSE {len(POISSON)} END"


def _blocks(units, ident, n_rep, per, seed):
    """Each unit once per block of `per` replicates, with an MD5 that their draws are cut from.

    The units are spread first: what is long is the work per unit, not the table.
    """
    block = F.explode(F.sequence(F.lit(0), F.lit((int(n_rep) - 1) // per)))
    d = spread(units).withColumn("_block", block)
    return d.withColumn("_h", F.md5(F.concat_ws("|", F.lit(seed), F.col("_block").cast("string"), F.col(ident).cast("string"))))


def resampled(units, keys, ident, sums, n_boot, seed):
    """(keys, rep, w, sums): a Poisson bootstrap. Replicate r weighs a unit by a hashed
    Poisson(1) draw, so it needs no numbering and no join, only sums combined before the shuffle.

    sums maps a name to the column whose weighted sum it becomes. A task hashes a unit once for all its keys, and
    a slice of units gives the sums of all replicates as one product of weights and values.
    """
    keys, outs, n_boot, k = list(keys), list(sums), int(n_boot), len(sums)
    d = units.select(*keys, F.col(ident).cast("string").alias("_id"), *[c.cast("double").alias(f"_v{i}") for i, c in enumerate(sums.values())])
    d = spread(d, "_id").sortWithinPartitions("_id")
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in d.select(*keys).schema], "rep int", "w bigint", *[f"`{n}` double" for n in sums]])
    starts = [f"{seed}|{b}" for b in range((n_boot + 7) // 8)]
    bare, heads = [x.encode() for x in starts], [f"{x}|".encode() for x in starts]
    weights = np.searchsorted([int(x, 16) for x in POISSON], np.arange(1 << 16), side="right").astype(np.uint8)
    step = max(1, WEIGHTS // n_boot)

    def draws(ids):
        text = b"".join([md5(h).digest() for x in ids for h in (bare if x is None else [h + x.encode() for h in heads])])
        return weights[np.frombuffer(text, ">u2")].reshape(len(ids), -1)[:, :n_boot].astype(float)

    def flushed(kept, names):
        for key, (w, s, seen) in kept.items():
            at = np.flatnonzero(w)
            cols = [pa.array([v] * len(at), f.type) for v, f in zip(key, names)]
            cols += [pa.array(at + 1, pa.int32()), pa.array(w[at].astype(np.int64))]
            cols += [pa.array(s[i][at], pa.float64(), mask=seen[i][at] == 0) for i in range(k)]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in names] + ["rep", "w", *outs])

    def added(kept, own, w, unit, v, here):
        """Adds the rows of a few keys: `own` is the key, unit the row of w of every row."""
        at, own_at = {}, [0] * len(own)
        for i, key in enumerate(own):
            own_at[i] = at.setdefault(key, len(at))
        units, unit = np.unique(unit, return_inverse=True)
        w = w if len(units) == len(w) else w[units]
        fine = here & np.isfinite(v)
        x = np.zeros((len(units), len(at), 1 + 2 * k))
        np.add.at(x, (unit, own_at), np.concatenate([np.ones((len(v), 1)), np.where(fine, v, 0.0), here], axis=1))
        x = x if not here.all() else x[:, :, :1 + k]
        s = (x.reshape(len(units), -1).T @ w).reshape(len(at), -1, n_boot)
        for key, i in at.items():
            mine = kept.setdefault(key, (np.zeros(n_boot), np.zeros((k, n_boot)), np.zeros((k, n_boot))))
            mine[0][:] += s[i][0]
            mine[1][:] += s[i][1:1 + k]
            mine[2][:] += s[i][1 + k:] if s.shape[1] > 1 + k else s[i][0]
        # A value that is not finite counts only where its weight is above zero.
        for r, c in zip(*np.nonzero(here & ~fine)):
            kept[own[r]][1][c] += np.where(w[unit[r]] > 0, v[r, c], 0.0)

    def run(batches):
        kept, names = {}, []
        for b in batches:
            names = [b.schema.field(i) for i in range(len(keys))]
            ids = b.column(len(keys)).to_pylist()
            turns = np.array([i == 0 or ids[i] != ids[i - 1] for i in range(len(ids))], bool)
            unit, first = np.cumsum(turns) - 1, np.flatnonzero(turns)
            cols = [b.column(len(keys) + 1 + i) for i in range(k)]
            v = np.stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in cols], axis=1)
            here = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in cols], axis=1)
            own = list(zip(*[b.column(i).to_pylist() for i in range(len(keys))])) if keys else [()] * len(ids)
            for a in range(0, len(first), step):
                w = draws([ids[i] for i in first[a:a + step]])
                rows = range(first[a], first[a + step] if a + step < len(first) else len(ids))
                some = sorted({own[i] for i in rows}, key=repr)
                bundle = {key: i // BUNDLE for i, key in enumerate(some)}
                for q in range(0, len(some), BUNDLE):
                    at = [i for i in rows if bundle[own[i]] == q // BUNDLE] if len(some) > BUNDLE else list(rows)
                    added(kept, [own[i] for i in at], w, unit[at] - a, v[at], here[at])
                    if len(kept) * n_boot * (1 + 2 * k) > HELD:
                        yield from flushed(kept, names)
                        kept.clear()
        yield from flushed(kept, names)

    r = d.mapInArrow(run, schema).groupBy(*keys, "rep")
    return r.agg(F.sum("w").alias("w"), *[F.sum(n).alias(n) for n in sums])


def sql_resampled(units, ident, sums, n_boot, seed, keys=()):
    """The same table as a DuckDB subquery over the relation `units`."""
    k = "".join(f"{x}," for x in keys)
    cols = ",".join(f"sum(w*({c})) AS {n}" for n, c in sums.items())
    return f"""(SELECT {k}rep, sum(w) AS w, {cols} FROM (SELECT *, {sql_poisson("substr(md5(concat_ws('|','" + seed + "',(rep-1)//8," + ident + ")),4*((rep-1)%8)+1,4)")} AS w
 FROM {units}, range(1,{n_boot + 1}) q(rep)) GROUP BY {k}rep)"""


def bootstrap_mean(units, keys, ident, value, n_boot, seed, probs=(0.025, 0.975)):
    """Percentile interval of the mean; the replicate count bounds the percentile input."""
    r = resampled(units, keys, ident, {"s": F.col(value)}, n_boot, seed).withColumn("_m", F.col("s") / F.col("w"))
    return r.groupBy(*keys).agg(F.percentile("_m", F.lit(probs[0])).alias("lo"), F.percentile("_m", F.lit(probs[1])).alias("hi"))


def flipped_sums(units, keys, ident, values, n_perm, seed):
    """(keys, rep, values): per permutation the sum of each value under hashed signs of the units."""
    keys = list(keys)
    d = _blocks(units.select(*keys, ident, *values), ident, n_perm, 32, seed)
    signs = F.array(*[F.struct((F.col("_block") * 32 + j + 1).alias("rep"), F.when(F.substring("_h", j + 1, 1) < "8", -1.0).otherwise(1.0).alias("sign")) for j in range(32)])
    d = d.select(*keys, *values, F.inline(signs)).where(F.col("rep") <= int(n_perm))
    return d.groupBy(*keys, F.col("rep").cast("long").alias("rep")).agg(*[F.sum(F.col(v) * F.col("sign")).alias(v) for v in values])


def sign_flips(units, ident, values, n_perm, seed):
    """(rep, values): per permutation the mean of each value under hashed signs."""
    d = _blocks(units.select(ident, *values), ident, n_perm, 32, seed)
    signs = F.array(*[F.struct((F.col("_block") * 32 + j + 1).alias("rep"), F.when(F.substring("_h", j + 1, 1) < "8", -1.0).otherwise(1.0).alias("sign")) for j in range(32)])
    d = d.select(*values, F.inline(signs)).where(F.col("rep") <= int(n_perm))
    return d.groupBy("rep").agg(*[F.avg(F.col(v) * F.col("sign")).alias(v) for v in values])


def sql_sign(ident, seed):
    return f"CASE WHEN substr(md5(concat_ws('|','{seed}',(rep-1)//32,{ident})),((rep-1)%32+1)::INT,1)<'8' THEN -1.0 ELSE 1.0 END"
