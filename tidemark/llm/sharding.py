"""Vector bin packing of documents into shards.

Every group of equal texts has a load vector (bytes, words, rows). Light groups are merged
by hash of their text into a fixed number of cells; heavy groups stay items of their own, and
one heavier than a shard's fair share is cut by row into pieces. The items, whose number is bounded by
constants whatever the input, are placed in decreasing size, each into the shard where the dot
product of its load with the residual capacity is highest.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import stored
from .common import WORD, text_of

CELLS = 4096            # hash cells that hold the light groups
HEAVY = 4096            # a group above 1/HEAVY of any load is heavy: at most 3 * HEAVY of them
NUMBER_ROWS = 1_000     # rows that one numbering task aims at


def place(items, n_shards):
    """Shard of each item: items is an array (n, dims) of loads, in shares of the total; the first is the law.

    Items go in decreasing order of their largest load. An item goes to the shard with the
    highest dot product of load and residual capacity among those where it overflows the
    first dimension least, so that this one stays near equal even if the others cannot.
    """
    items = np.asarray(items, dtype="float64")
    residual = np.full((n_shards, items.shape[1]), 1.0 / n_shards)
    shards = np.zeros(len(items), dtype="int32")
    for i in np.lexsort((np.arange(len(items)), -items.max(axis=1))):
        over = np.maximum(0.0, items[i, 0] - residual[:, 0])
        fits = over <= over.min() + 1e-12
        score = np.where(fits, residual @ items[i], -np.inf)
        s = int(score.argmax())
        shards[i] = s
        residual[s] -= items[i]
    return shards


def assign_shards(docs, n_shards=16, id_col="doc_id", text_col="text"):
    """(id, size, text_crc32, shard, slot) for every row of docs.

    size is the UTF-8 length of the text plus 1; null texts count as empty. Equal texts share a
    shard unless their group alone exceeds a shard's fair share of bytes, words or rows.
    slot counts the rows of a shard from 0 without gaps, ordered by hash cell, id and
    text hash. Repeated rows each get a slot; an empty table gives an empty result.
    """
    text = text_of(docs, text_col)
    slim = stored(docs.select(
        docs[id_col].alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
        F.xxhash64(text).alias("h"),
    ))
    total = slim.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("size", "words")), F.count("*").alias("rows")).first()
    whole = [max(1, total[c]) for c in ("size", "words", "rows")]

    loads = [F.sum("size").alias("size"), F.sum("words").alias("words"), F.count("*").alias("rows")]
    groups = slim.groupBy("h").agg(*loads)
    share = F.greatest(*(F.col(c) / F.lit(w) for c, w in zip(("size", "words", "rows"), whole)))
    heavy = groups.where(share > 1.0 / HEAVY).withColumn("pieces", F.ceil(share * n_shards).cast("int"))
    heavy = stored(heavy.select("h", "pieces"))       # at most 3 * HEAVY rows

    cell = F.pmod("h", F.lit(CELLS)).cast("long")
    item = F.when(F.col("pieces").isNull(), cell).otherwise(F.col("h"))
    piece = F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("id", "h"), F.col("pieces")).cast("int")).otherwise(F.lit(0))
    rows = slim.join(F.broadcast(heavy), "h", "left").select(
        "id", "size", "text_crc32", "words", "h", F.col("pieces").isNotNull().alias("own"), item.alias("item"), piece.alias("piece"))

    items = rows.groupBy("own", "item", "piece").agg(*loads).orderBy("own", "item", "piece").toPandas()
    shares = items[["size", "words", "rows"]].to_numpy("float64") / np.array(whole)
    items["shard"] = place(shares, n_shards)
    # Numbering splits an item further by id, in proportion to its rows.
    items["parts"] = np.maximum(1, -(-items["rows"] // NUMBER_ROWS)).astype("int64")
    placed = docs.sparkSession.createDataFrame(
        items[["own", "item", "piece", "shard", "parts"]].astype({"shard": "int32"}) if len(items) else pd.DataFrame(columns=["own"]),
        "own boolean, item long, piece int, shard int, parts long") if len(items) else None
    if placed is None:
        return slim.select("id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    rows = rows.join(F.broadcast(placed), ["own", "item", "piece"]).withColumn(
        "part", F.pmod(F.xxhash64("id"), F.col("parts")))

    unit = ["shard", "own", "item", "piece", "part"]
    before = Window.partitionBy("shard").orderBy("own", "item", "piece", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*unit).agg(F.count("*").alias("n")).select(*unit, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy(*unit).orderBy("id", "h")
    numbered = rows.withColumn("k", F.row_number().over(inside) - 1)
    return numbered.join(starts, unit).select(
        "id", "size", "text_crc32", "shard", (F.col("start") + F.col("k")).cast("long").alias("slot"))
