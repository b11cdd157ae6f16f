"""Analytics of a memory store: novelty, write decisions, consolidation and retrieval."""

from pyspark.sql import functions as F

from ..functions.draws import uniform
from .clusters import components
from .ordered import top_n
from .passes import Earlier, Forest, Top, hashed_slots, streamed, whole_slots


def _slots(resident, other, triangle, hashed):
    """Slots by hash tables where `hashed` = (tables, bits, seed, dims) is given, else of everything with everything."""
    return hashed_slots(resident, other, *hashed) if hashed else whole_slots(resident, other, triangle)


def novelty(items, hashed=None):
    """items(id, v) -> 1 - largest cosine to an earlier id (1 for the first).

    With `hashed` only earlier ids that share a bucket count, so that the result may be too large.
    """
    d = items.select("id", "v")
    b = streamed(_slots(d, d, True, hashed), Earlier, "qid long, best double").groupBy("qid").agg(F.max("best").alias("best"))
    return items.select("id").join(b.withColumnRenamed("qid", "id"), "id", "left").select("id", (1 - F.coalesce("best", F.lit(0.0))).alias("novelty"))


def nearest(queries, items, n=1, key=None, hashed=None):
    """The n items of largest cosine per query (and value of `key`): winners per slot, then the final ones.

    With `hashed` they are the largest among the items that share a bucket with the query.
    """
    q = queries.select(F.col("qid").alias("id"), F.col("qv").alias("v"))
    i = items.select(F.col("iid").alias("id"), F.col("iv").alias("v"), *([key] if key else []))
    head = f", {key} {items.schema[key].dataType.simpleString()}" if key else ""
    p = streamed(_slots(q, i, False, hashed), lambda ids, x: Top(ids, x, n, key), f"qid long, iid long, cosine double{head}")
    if hashed:
        p = p.distinct()          # the same pair may share buckets of several tables
    return top_n(p, ["qid", *([key] if key else [])], [F.desc("cosine"), F.col("iid")], n)


def cosine_clusters(items, limit=0.75, smallest=3, hashed=None):
    """Single-linkage clusters of the cosine threshold graph with at least `smallest` items.

    With `hashed` a link needs a shared bucket; every link kept is above the threshold.
    """
    d = items.select("id", "v")
    e = streamed(_slots(d, d, True, hashed), lambda ids, q: Forest(ids, q, limit), "i long, j long").select(F.lit(0).alias("g"), "i", "j")
    lab = components(items.select(F.lit(0).alias("g"), F.col("id").alias("node")), e, ["g"])
    size = lab.groupBy("root").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= smallest)
    return lab.join(size, "root").select(F.col("node").alias("id"), F.col("root").alias("cluster"), "size")


def write_decision(items, theta, a=1.0, b=0.5, novel=0.6):
    """items(.., confidence, error, novelty) -> surprise, score, write flag and trigger."""
    s = F.col("confidence") * F.col("error")
    score = a * s + b * F.col("novelty")
    by_score, by_novelty = score > theta, (F.col("error") == 0) & (F.col("novelty") > novel)
    return items.withColumns({"surprise": s, "score": score, "write": by_score | by_novelty,
                              "trigger": F.when(by_score, "surprise").when(by_novelty, "novelty").otherwise("none")})


def replay_sample(items, ident, horizon, n, seed):
    """Weighted sample without replacement by the smallest -ln(u)/weight keys."""
    w = F.pow("surprise", F.lit(0.6)) * (1 + 0.1 * F.col("age") / F.lit(float(horizon)))
    key = -F.log(F.greatest(uniform(F.lit(seed), F.col(ident)), F.lit(1e-12))) / w
    return items.where(F.col("surprise") > 0).withColumns({"priority": w, "_key": key}).orderBy("_key", ident).limit(n).drop("_key")


def calibration_error(rows, conf, correct, bins=10):
    """Binned |accuracy - confidence| weighted by bin share."""
    b = F.least(F.floor(F.col(conf) * bins), F.lit(bins - 1))
    g = rows.groupBy(b.alias("_b")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(correct).cast("double")).alias("acc"), F.avg(conf).alias("conf"))
    return g.agg((F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n")).alias("ece"))


def calibrate(warm, rows, conf, correct):
    """Isotonic map fitted on warm-up rows, which are first pooled per confidence."""
    from pyspark.ml.regression import IsotonicRegression

    g = warm.groupBy(F.col(conf).alias("features")).agg(F.avg(F.col(correct).cast("double")).alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))
    model = IsotonicRegression(featuresCol="features", labelCol="label", weightCol="weight").fit(g)
    return model.transform(rows.withColumn("features", F.col(conf))).drop("features").withColumnRenamed("prediction", "calibrated")
