"""Small column builders the corpus operators share."""

import sys
import types

from pyspark.sql import functions as F

#: A word is a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def text_of(df, column="text"):
    """The text column with null read as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def held_out(doc_id, folds=5, left_out=0):
    """True for the fold that is never learnt from: crc32 of the id as text, modulo `folds`, is `left_out`.

    A null id counts as held out, so that it is never learnt from either.
    """
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == left_out, F.lit(True))


#: Texts that an Arrow batch may hold.
BATCH = 1_000
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def text_batches(df):
    """df, in a session whose Arrow batches hold at most BATCH rows.

    Texts may be long, and a task holds several copies of a batch, on both sides of the
    pipe. The plan reads the setting when it runs, so it stays set in the session.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH_KEY)) <= BATCH:
        conf.set(_BATCH_KEY, str(BATCH))
    return df


#: Buckets of a `mark_near` filter; one holds 32,768 bits, so the filter never exceeds 8 MB, whatever the number of keys.
BUCKETS = 2_048


def mark_near(df, key, wanted):
    """df with the boolean `__near`: false only where the long Column `key` is not among the non-null keys of `wanted`, a table of one long column.

    The keys set bits of a bitmap of bounded size, which is broadcast. So rows that a following join would not meet are known
    before they are shuffled. With many more keys than bits nearly every row is marked, and the join alone decides.
    """
    def place(k):
        return F.xxhash64(k, F.lit(5))

    def bucket(k):
        return F.pmod(place(k), F.lit(BUCKETS))

    def at(k):
        return F.pmod(F.shiftright(place(k), 16), F.lit(32_768))

    name = F.col(wanted.columns[0])
    keys = wanted.where(name.isNotNull()).select(bucket(name).alias("__bucket"), at(name).alias("__at"))
    bits = keys.repartition("__bucket").groupBy("__bucket").agg(F.bitmap_construct_agg("__at").alias("__bits"))
    both = df.withColumn("__place", bucket(key)).withColumn("__at", at(key)).join(F.broadcast(bits), F.col("__place") == F.col("__bucket"), "left")
    byte = F.conv(F.hex(F.expr("substring(__bits, cast(__at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    near = F.getbit(byte, F.col("__at") % 8) == 1
    return both.withColumn("__near", F.coalesce(near, F.lit(False))).drop("__place", "__at", "__bucket", "__bits")


def shuffle_count(df):
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def worker_state(key, make):
    """What make() returned the first time this Python worker asked for `key`; workers outlive tasks.

    A worker holds one such value at a time, so that one stage's tables do not burden the next.
    """
    held = sys.modules.setdefault("tidemark_worker_state", types.ModuleType("tidemark_worker_state")).__dict__
    if held.get("state_key") != key:
        held.pop("state", None)
        held["state"] = make()
        held["state_key"] = key
    return held["state"]
