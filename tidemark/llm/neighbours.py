"""Approximate nearest neighbours by inner product, over low-dimensional stable projections.

A vector gets one more component that makes all norms equal, so that the largest inner product is
the least Euclidean distance. Gaussian (2-stable) projections to a few dimensions are indexed by a
kd-tree. Its upper levels deal the vectors over tasks, the lower ones are built inside a task. A query
visits leaves in increasing projected distance and verifies their vectors exactly, until the
chi-square test says that a vector nearer than the k-th found so far would have shown up with probability P.

Equal vectors are one unit with its smallest ids, which is all that a result can hold of them.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..session import cut_lineage, stored

DIMS = 8                 # of the projection; even, for the closed form of the chi-square distribution
STOP = 0.95              # probability of the stopping test, a lower bound of the expected recall
SAMPLE = 20_000          # projected vectors that the upper kd-tree is fitted on
LEAF_ROWS = 8_192        # units an upper leaf aims at
MOST_LEAVES = 1_024      # bounds the upper tree and its boxes, which are broadcast
BLOCK = 16_384           # units of a leaf that one task searches at once
ASKED = 4_096            # queries that it answers at once
INNER_ROWS = 128         # units of a leaf inside a task
SALTS = 64


def chi_square_cdf(x, dims=DIMS):
    """P(chi-square with `dims` (even) degrees of freedom <= x)."""
    half = np.minimum(np.asarray(x, dtype=float) / 2, 700.0)
    term = total = np.ones_like(half)
    for i in range(1, dims // 2):
        term = term * half / i
        total = total + term
    return 1.0 - np.exp(-half) * total


def projection(dim, dims=DIMS, seed=7):
    return np.random.default_rng(seed).standard_normal((dim + 1, dims))


def project(vectors, largest, matrix):
    """Projections of vectors with the component that lifts their squared norm to `largest`."""
    rest = np.sqrt(np.maximum(0.0, largest - np.einsum("ij,ij->i", vectors, vectors)))
    return vectors @ matrix[:-1] + rest[:, None] * matrix[-1]


def fit_tree(points, leaves):
    """Splits (axis, value) of a kd-tree with `leaves` (a power of two) leaves, in heap order."""
    splits = []
    level = [points]
    while len(level) < leaves:
        below = []
        for p in level:
            axis = int(np.ptp(p, axis=0).argmax()) if len(p) else 0
            value = float(np.median(p[:, axis])) if len(p) else 0.0
            splits.append((axis, value))
            low = p[:, axis] <= value
            below += [p[low], p[~low]]
        level = below
    return np.array(splits, dtype=float).reshape(-1, 2)


def leaf_of(points, splits):
    node = np.zeros(len(points), dtype=np.int64)
    while len(splits) and len(node) and node[0] < len(splits):
        axis, value = splits[node, 0].astype(int), splits[node, 1]
        node = 2 * node + 1 + (points[np.arange(len(points)), axis] > value)
    return node - len(splits)


def box_distance(queries, low, high):
    """(queries, boxes) squared distances in the projection."""
    out = np.zeros((len(queries), len(low)))
    for d in range(queries.shape[1]):
        q = queries[:, d:d + 1]
        out += np.maximum(0.0, np.maximum(low[None, :, d] - q, q - high[None, :, d])) ** 2
    return out


def search(vectors, points, queries, query_points, bounds, largest, k, stop=STOP):
    """(scores, rows), each (queries, k): the best inner products that the incremental search verifies.

    bounds holds a squared distance per query within which k vectors are known already, so that nothing
    beyond it is returned; missing places have row -1.
    """
    n = len(vectors)
    leaves = 1 << max(0, int(np.ceil(np.log2(max(1, n / INNER_ROWS)))))
    leaf = leaf_of(points, fit_tree(points, leaves))
    order = np.argsort(leaf, kind="stable")
    cuts = np.searchsorted(leaf[order], np.arange(leaves + 1))
    groups = [order[a:b] for a, b in zip(cuts, cuts[1:]) if b > a]
    low = np.array([points[g].min(axis=0) for g in groups])
    high = np.array([points[g].max(axis=0) for g in groups])
    away = box_distance(query_points, low, high)
    visits = np.argsort(away, axis=1, kind="stable")
    norms = np.einsum("ij,ij->i", queries, queries)
    best = np.full((len(queries), k), -np.inf)
    rows = np.full((len(queries), k), -1, dtype=np.int64)
    active = np.arange(len(queries))
    for step in range(len(groups)):
        nxt = visits[active, step]
        found = norms[active] + largest - 2 * best[active, -1]
        bound = np.maximum(np.minimum(bounds[active], found), 1e-12)
        go = chi_square_cdf(away[active, nxt] / bound) < stop
        active, nxt = active[go], nxt[go]
        if not len(active):
            break
        for g in np.unique(nxt):
            who, members = active[nxt == g], groups[g]
            scores = np.concatenate([best[who], queries[who] @ vectors[members].T], axis=1)
            names = np.concatenate([rows[who], np.broadcast_to(members, (len(who), len(members)))], axis=1)
            if scores.shape[1] > k:
                top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
                scores, names = np.take_along_axis(scores, top, 1), np.take_along_axis(names, top, 1)
            place = np.argsort(-scores, axis=1, kind="stable")
            best[who], rows[who] = np.take_along_axis(scores, place, 1), np.take_along_axis(names, place, 1)
    beyond = norms[:, None] + largest - 2 * best > (bounds * (1 + 1e-9))[:, None]
    return best, np.where(beyond, -1, rows)


def _matrix(table, column):
    values = table.column(column).combine_chunks()
    flat = values.flatten().to_numpy(zero_copy_only=False).astype("float64")
    return flat.reshape(len(values), -1) if len(values) else flat.reshape(0, 1)


def _search_cell(largest, k, stop):
    def run(data, queries):
        if not data.num_rows or not queries.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "u": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        vectors, asked = _matrix(data, "vec"), _matrix(queries, "query")
        scores, rows = search(vectors, _matrix(data, "point"), asked, _matrix(queries, "query_point"), queries.column("bound").to_numpy(), largest, k, stop)
        q, place = np.nonzero(rows >= 0)
        names = data.column("u").to_numpy()
        hit = rows[q, place]
        exact = np.einsum("ij,ij->i", vectors[hit], asked[q])      # alike for equal vectors, whatever their block
        return pa.table({"q": queries.column("q").to_numpy()[q], "u": names[hit], "score": exact})
    return run


def _valid(e):
    return e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)


def nearest(vectors, is_query, k=20, id_col="vec_id", vector_col="embedding", stop=STOP):
    """(query_id, rank, id, score): for every query row its k nearest other rows found, by inner product.

    is_query is a condition on the rows of vectors. Vectors that are null, zero, of another length than most, or that hold
    null or non-finite components take no part. Ties go to the smaller id. Rows with the query's own id are not its
    candidates; other repeated rows count once per id. An empty table gives an empty result.
    """
    e = F.transform(F.col("e"), lambda x: x.cast("double"))
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].alias("e"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & _valid(F.col("e"))).select("id", e.alias("vec"), "asks")
    length = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim = length[0]["d"] if length else 1
    # One unit per vector: its k + 1 smallest ids. The salt splits a vector that many rows share.
    rows = rows.where(F.size("vec") == dim).withColumn("u", F.xxhash64("vec"))
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS))
    some = rows.groupBy("u", salt.alias("salt")).agg(
        F.slice(F.array_sort(F.collect_set("id")), 1, k + 1).alias("ids"), F.max("asks").alias("asks"), F.first("vec").alias("vec"))
    units = stored(some.groupBy("u").agg(
        F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"), F.max("asks").alias("asks"), F.first("vec").alias("vec")))
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    n, largest = units.agg(F.count("*"), F.coalesce(F.max(norm), F.lit(1.0))).first()
    matrix = projection(dim)
    leaves = min(MOST_LEAVES, 1 << max(0, int(np.ceil(np.log2(max(1, n / LEAF_ROWS))))))
    sample = units.select("vec").orderBy(F.xxhash64("u")).limit(SAMPLE).toPandas()["vec"]
    splits = fit_tree(project(np.stack(sample), largest, matrix), leaves) if n else np.zeros((0, 2))
    located_type = StructType([StructField("point", ArrayType(DoubleType())), StructField("leaf", IntegerType())])

    @pandas_udf(located_type)
    def locate(vec: pd.Series) -> pd.DataFrame:
        points = project(np.stack(vec) if len(vec) else np.zeros((0, len(matrix) - 1)), largest, matrix)
        return pd.DataFrame({"point": list(points), "leaf": leaf_of(points, splits).astype("int32")})

    data = stored(units.withColumn("l", locate("vec")).select("u", "vec", "asks", "l.point", "l.leaf"))
    stats = data.groupBy("leaf").agg(F.count("*").alias("n"), *(F.min(F.col("point")[d]).alias(f"low{d}") for d in range(DIMS)), *(F.max(F.col("point")[d]).alias(f"high{d}") for d in range(DIMS))).toPandas()
    low, high = stats[[f"low{d}" for d in range(DIMS)]].to_numpy(float), stats[[f"high{d}" for d in range(DIMS)]].to_numpy(float)
    names = stats["leaf"].to_numpy()
    subs = vectors.sparkSession.createDataFrame([(int(x), int(-(-c // BLOCK))) for x, c in zip(names, stats["n"])], "leaf int, subs int")
    boxes = vectors.sparkSession.sparkContext.broadcast((names, low, high))

    def visit(asked):
        """Results of the queries (u, vec, point, bound, leaf) in all blocks of their leaves."""
        chunks = asked.groupBy("leaf").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("chunks"))
        sizes = F.broadcast(chunks.join(subs, "leaf"))           # at most MOST_LEAVES rows
        d = data.join(sizes, "leaf").select("u", "vec", "point", "leaf", F.pmod(F.xxhash64("u"), F.col("subs")).cast("int").alias("sub"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        q = asked.join(sizes, "leaf").select(F.col("u").alias("q"), F.col("vec").alias("query"), F.col("point").alias("query_point"), "bound", F.col("leaf").alias("at"), F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("part"), F.pmod(F.xxhash64("u"), F.col("chunks")).cast("int").alias("share"))
        return d.groupBy("leaf", "sub", "chunk").cogroup(q.groupBy("at", "part", "share")).applyInArrow(_search_cell(largest, k + 1, stop), "q long, u long, score double")

    def others(frames):
        leaf_names, lows, highs = boxes.value
        for df in frames:
            if df.empty:
                continue
            away = box_distance(np.stack(df["point"]), lows, highs)
            go = chi_square_cdf(away / np.maximum(df["bound"].to_numpy(), 1e-12)[:, None]) < stop
            go &= leaf_names[None, :] != df["leaf"].to_numpy()[:, None]
            i, j = np.nonzero(go)
            yield df.iloc[i].assign(leaf=leaf_names[j])

    asked = data.where("asks").select("u", "vec", "point", F.lit(float("inf")).alias("bound"), "leaf")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "u")
    home = cut_lineage(visit(asked).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1))
    kth = home.where(F.col("place") == k + 1).select(F.col("q").alias("u"), F.col("score").alias("kth"))
    bound = F.coalesce(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x) + F.lit(largest) - 2 * F.col("kth"), F.lit(float("inf")))
    second = asked.drop("bound").join(kth, "u", "left").select("u", "vec", "point", bound.alias("bound"), "leaf")
    second = stored(second.mapInPandas(others, second.schema))
    found = home.drop("place").unionByName(visit(second))
    kept = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    listed = kept.join(units.select("u", "ids"), "u").select("q", "score", F.explode("ids").alias("id"))
    by_id = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    listed = listed.withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= k + 1)
    # Back to the query rows: equal queries share a list and each leaves its own row out.
    lists = listed.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("list"))
    askers = rows.where("asks").select(F.col("id").alias("query_id"), F.col("u").alias("q")).distinct()
    mine = askers.join(lists, "q").select("query_id", F.slice(F.filter("list", lambda x: x["id"] != F.col("query_id")), 1, k).alias("list"))
    return mine.select("query_id", F.posexplode("list").alias("at", "x")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("id"), F.col("x.score").alias("score"))
