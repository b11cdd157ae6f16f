"""Ordered analytics per key that keep working when one key is huge.

A plain window sorts a whole key in one task.  Here, when some key is above a row limit,
rows are range-partitioned on their keys and order columns, whatever the types; a
partition is a chunk, so chunks have about equal numbers of rows however the rows lie in time.
Each chunk is scanned on its own and a table of one summary per (key, chunk) supplies what
earlier chunks carry in.  When no key is above the limit the plain window is used, at the
cost of one count per key.
"""

from functools import reduce

from pyspark.sql import Window, functions as F

from ..session import chunk_rows, cut_lineage

_ONE = "_all"


def _keyed(df, keys):
    """Give a keyless (global) analysis a constant key."""
    return (df, list(keys)) if keys else (df.withColumn(_ONE, F.lit(0)), [_ONE])


_DECIDED = {}


def rows_above(df, keys, rows):
    """(rows of keys with more than `rows` rows, all rows), remembered per logical plan.

    A stale answer costs time, never rows.
    """
    mark = (id(df.sparkSession), df.semanticHash(), tuple(keys), rows)
    if mark not in _DECIDED:
        if len(_DECIDED) > 10_000:
            _DECIDED.clear()
        n = F.col("_n")
        found = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.sum(F.when(n > rows, n)).alias("hot"), F.sum(n).alias("all")).first()
        _DECIDED[mark] = (found["hot"] or 0, found["all"] or 0)
    return _DECIDED[mark]


def any_above(df, keys, rows):
    """Whether any key has more than `rows` rows (one combined count)."""
    return rows_above(df, keys, rows)[0] > 0


def with_chunks(df, keys, order, rows, total):
    """Add `_chunk`: the number of the row's range partition over keys and order.

    Written to the checkpoint folder, so that all readers see the same chunks.
    """
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // rows))
    return cut_lineage(df.repartitionByRange(n, *keys, *order).withColumn("_chunk", F.spark_partition_id().cast("long")))


def running(df, keys, order, sums=None, lags=None, lasts=None, rows=None, root=None):
    """Running values per key in `order`.

    sums:  {out: column} running sum up to and including the row
    lags:  {out: column} the value on the previous row
    lasts: {out: column} the latest non-null value up to and including the row
    root:  (df, keys) of a coarser grouping; when it has no hot key, neither has this
    """
    sums, lags, lasts = sums or {}, lags or {}, lasts or {}
    df, ks = _keyed(df, keys)
    vals = {f"_s_{k}": c for k, c in sums.items()}
    vals.update({f"_g_{k}": F.struct(c.alias("v")) for k, c in lags.items()})
    vals.update({f"_f_{k}": F.when(c.isNotNull(), F.struct(c.alias("v"))) for k, c in lasts.items()})
    names = [c for c in df.columns if c != _ONE and c not in {**sums, **lags, **lasts}]
    rows = rows or chunk_rows(df.sparkSession)
    hot = any_above(*root, rows) if root else True
    hot = hot and any_above(df, ks, rows)
    d = df.withColumns(vals)
    if not hot:
        w = Window.partitionBy(*ks).orderBy(*order)
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        return d.select(
            *names,
            *[F.coalesce(F.sum(f"_s_{k}").over(upto), F.lit(0)).alias(k) for k in sums],
            *[F.lag(f"_g_{k}").over(w)["v"].alias(k) for k in lags],
            *[F.last(f"_f_{k}", True).over(upto)["v"].alias(k) for k in lasts],
        )
    d = with_chunks(d, ks, order, rows, rows_above(df, ks, rows)[1])
    o = F.struct(*[F.col(c) for c in order])
    aggs = [F.sum(f"_s_{k}").alias(f"_cs_{k}") for k in sums]
    aggs += [F.max_by(f"_g_{k}", o).alias(f"_cg_{k}") for k in lags]
    aggs += [F.max_by(f"_f_{k}", F.when(F.col(f"_f_{k}").isNotNull(), o)).alias(f"_cf_{k}") for k in lasts]
    before = Window.partitionBy(*ks).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    parts = d.groupBy(*ks, "_chunk").agg(*aggs)
    carry = parts.select(
        *ks,
        "_chunk",
        *[F.sum(f"_cs_{k}").over(before).alias(f"_cs_{k}") for k in sums],
        *[F.last(f"_cg_{k}", True).over(before).alias(f"_cg_{k}") for k in lags],
        *[F.last(f"_cf_{k}", True).over(before).alias(f"_cf_{k}") for k in lasts],
    )
    d = d.join(carry, ks + ["_chunk"], "left")
    w = Window.partitionBy(*ks, "_chunk").orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return d.select(
        *names,
        *[(F.coalesce(F.sum(f"_s_{k}").over(upto), F.lit(0)) + F.coalesce(F.col(f"_cs_{k}"), F.lit(0))).alias(k) for k in sums],
        *[F.coalesce(F.lag(f"_g_{k}").over(w), F.col(f"_cg_{k}"))["v"].alias(k) for k in lags],
        *[F.coalesce(F.last(f"_f_{k}", True).over(upto), F.col(f"_cf_{k}"))["v"].alias(k) for k in lasts],
    )


def numbered(df, keys, order, name="idx", rows=None):
    """Row number (from 1) per key; with no keys a dense global number."""
    return running(df, keys, order, sums={name: F.lit(1).cast("long")}, rows=rows)


def gaps(df, keys, order, name="gap", rows=None):
    """Difference of the first order column to the previous row of the key."""
    d = running(df, keys, order, lags={"_prev": F.col(order[0])}, rows=rows)
    return d.withColumn(name, F.col(order[0]) - F.col("_prev")).drop("_prev")


def previous_mean(df, keys, order, value, name="prev_mean", rows=None):
    """Mean of strictly earlier values of the key, 0 where there is none."""
    d = running(
        df, keys, order, rows=rows,
        sums={"_c": F.when(F.col(value).isNotNull(), 1).otherwise(0), "_t": F.coalesce(F.col(value), F.lit(0.0))},
    )
    c = F.col("_c") - F.when(F.col(value).isNotNull(), 1).otherwise(0)
    t = F.col("_t") - F.coalesce(F.col(value), F.lit(0.0))
    return d.withColumn(name, F.when(c > 0, t / c).otherwise(0.0)).drop("_c", "_t")


def top_n(df, keys, order, n):
    """First n rows of every key by `order` columns, n a small constant.

    Two passes: a salted pre-selection of n rows per slice, then the final choice, so a
    hot key never reaches one task with more than slices x n rows.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(64)))
    w1 = Window.partitionBy(*keys, "_salt").orderBy(*order)
    w2 = Window.partitionBy(*keys).orderBy(*order)
    pre = salted.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= n).drop("_salt", "_r")
    return pre.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= n)


def union_all(frames):
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
