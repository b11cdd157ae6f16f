"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time 0 to 1, given by its shape at evenly spaced knots.
Its integral is the source's cumulative demand, scaled so that the whole run demands the source's
target. A source's documents lie one after another on its axis of words, in an order fixed
by a hash, pass after pass; the words below the target are taken, and inverting the cumulative
demand at the first word of each pass of a document gives its training position, by which the mix is range-sorted.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import stored
from .common import WORD, text_of

WEIGHTS = (5, 2, 1)               # of the sources by code point, repeating
#: Relative weight at the knots 0, 1/2 and 1 of training time, repeating like the weights.
SHAPES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
MOST_PASSES = 3
HEX = 3                           # leading hash digits that cut a source's axis into 4096 stretches


def targets(sizes, weights=WEIGHTS, most=MOST_PASSES):
    """sizes with the columns k, weight and target: every source's share of all words.

    sizes has one row per source and its source_size. A target stops at `most` times its source's size and the excess
    goes to the others by weight: sources are capped in increasing order of cap to weight
    as long as the level that the rest would get lies above their cap.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cases = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("k", rank).withColumn("weight", cases.cast("long")).withColumn("cap", F.col("source_size") * most)
    by = Window.orderBy(F.col("cap") / F.col("weight"), "k")
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    whole = F.sum("source_size").over(Window.partitionBy())
    level = (whole - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    levels = ranked.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    first = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("k"), F.col("level")))).over(Window.partitionBy())
    share = first["level"] * F.col("weight")
    return levels.withColumn("target", F.coalesce(F.least(share, F.col("cap").cast("double")), F.col("cap").cast("double"))).drop("cap", "level", "open")


def position(share, shape):
    """Training time at which the cumulative demand of a schedule reaches `share` of its total.

    shape is an array of weights at evenly spaced knots; the demand between two knots is the integral of
    a straight line, so its inverse is the root of a quadratic.
    """
    n = F.size(shape) - 1
    area = F.transform(F.sequence(F.lit(1), n), lambda i: (F.element_at(shape, i) + F.element_at(shape, i + 1)) / 2.0)
    total = F.aggregate(area, F.lit(0.0), lambda a, x: a + x)
    upto = F.transform(F.sequence(F.lit(1), n), lambda i: F.aggregate(F.slice(area, F.lit(1), i - 1), F.lit(0.0), lambda a, x: a + x))
    want = share * total
    i = F.aggregate(upto, F.lit(0), lambda a, x: a + F.when(x <= want, 1).otherwise(0))
    at, w0 = want - F.element_at(upto, i), F.element_at(shape, i)
    slope = F.element_at(shape, i + 1) - w0
    inside = F.when(F.abs(slope) < 1e-12, at / w0).otherwise((F.sqrt(w0 * w0 + 2.0 * slope * at) - w0) / slope)
    return F.least(F.lit(1.0), (F.lit(-1.0) + i + inside) / n)


def placed(docs, weights, shapes, most, id_col, text_col, source_col, keep):
    """Every row of docs with its place `at` on its source's axis, the source's size, target and shape, and `parts`, the words taken in each pass."""
    text = text_of(docs, text_col)
    rows = docs.select(
        docs[id_col].alias("id"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), docs[source_col].cast("string").alias("source"),
        F.md5(F.concat_ws(":", F.coalesce(docs[id_col].cast("string"), F.lit("")), F.length(text).cast("string")).cast("binary")).alias("h"),
        *(docs[c].alias(f"kept_{c}") for c in keep))
    # A key without nulls, so that window and join below share one partitioning.
    rows = rows.withColumn("stretch", F.substring("h", 1, HEX)).withColumn("axis", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    if not keep:
        rows = stored(rows)
    parts = stored(rows.groupBy("axis", "source", "stretch").agg(F.sum("size").alias("n")))
    sizes = parts.groupBy("axis", "source").agg(F.sum("n").alias("source_size"))
    aims = targets(sizes, weights, most)
    ahead = Window.partitionBy("axis").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("axis", "stretch", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    starts = stored(starts.join(aims.select("axis", "k", "source_size", "target"), "axis"))
    inside = Window.partitionBy("axis", "stretch").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = rows.join(starts, ["axis", "stretch"]).withColumn("at", F.col("start") + F.col("inner"))
    goal = F.floor("target")
    left = [F.greatest(F.lit(0), F.least(F.col("size"), goal - F.col("at") - F.col("source_size") * p)) for p in range(most)]
    shape = F.element_at(F.array(*(F.array(*map(F.lit, s)) for s in shapes)), (F.col("k") % len(shapes) + 1).cast("int"))
    return joined.withColumn("shape", shape).withColumn("parts", F.array(*(x.cast("long") for x in left)))


def mix(docs, weights=WEIGHTS, shapes=SHAPES, most=MOST_PASSES, id_col="doc_id", text_col="text", source_col="source", keep=()):
    """(id, size, source, source_size, target, taken, passes, position, *keep) for every row of docs.

    size counts words (null text: 0). taken is the number of words the mix takes from the row,
    over `passes` whole or cut repeats; position, from 0 to 1, is the training time of the first of
    them and null where none is taken; mix_passes has that of every pass. Rows without words are never taken. The order inside a source is that of
    md5 over id and text length, so reruns agree; repeated rows are rows of their own. Null sources form
    one source. An empty table gives an empty result. `keep` names columns of docs to pass on under "kept_<name>".
    """
    rows = placed(docs, weights, shapes, most, id_col, text_col, source_col, keep)
    return rows.select(
        "id", "size", "source", "source_size", "target", F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x).alias("taken"),
        F.size(F.filter("parts", lambda x: x > 0)).alias("passes"),
        F.when(F.get("parts", F.lit(0)) > 0, position(F.col("at") / F.col("target"), F.col("shape"))).alias("position"), *(f"kept_{c}" for c in keep))


def mix_passes(docs, weights=WEIGHTS, shapes=SHAPES, most=MOST_PASSES, id_col="doc_id", text_col="text", source_col="source", keep=()):
    """(id, size, source, source_size, target, pass, taken, position, *keep) for every pass in which the mix takes words of a row of docs.

    pass counts from 1, taken is the number of words taken in it and position the training time of its first word. All
    else is as in `mix`, whose row for a document sums its passes and has the first one's position.
    """
    rows = placed(docs, weights, shapes, most, id_col, text_col, source_col, keep)
    each = rows.select("*", F.posexplode("parts").alias("p", "taken")).where("taken > 0")
    # The demand of each pass begins where the one before it ends.
    share = (F.col("at") + F.col("source_size") * F.col("p")) / F.col("target")
    return each.select(
        "id", "size", "source", "source_size", "target", (F.col("p") + 1).alias("pass"), "taken", position(share, F.col("shape")).alias("position"),
        *(f"kept_{c}" for c in keep))


def curriculum(mixed):
    """The mix, of documents or of passes, range-partitioned and sorted by training position; rows that are not taken come last."""
    order = [F.col("position").asc_nulls_last(), F.col("id").asc_nulls_last()]
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order)
