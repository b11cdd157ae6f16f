"""The given parquet tables and the fixed mapping of each onto a recording study.

events      -> marker log: session = user, time = hours since 2024-01-01
lineitem    -> sampled signal: recording = block of 512 orders, sample = order in the
               block, channel = line number, value = price in thousands
embeddings  -> packed epochs: unit = vector, 8 channels x 8 samples, condition = label
orders      -> ratings over time per customer
documents, pages -> files and logs
"""

from pyspark.sql import functions as F

# Fixed values of the stand-in mapping.
CODE_A = {"signup": 128, "click": 2, "view": 4, "purchase": 8, "error": 16}
HOURS = 3_600_000_000.0
EPOCH_H = 6.0      # epoch length
PAD_H = 2.0        # after the last response
NO_RESPONSE_H = 9.0
LATE_H = 36.0      # late-response limit
BLOCK = 512
EPOCH_SAMPLES = 32


class Tables:
    """Lazy readers for one scale-factor folder."""

    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir = spark, sf_dir

    def path(self, name):
        return f"{self.sf_dir}/{name}.parquet"

    def __getattr__(self, name):
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))

    def markers(self):
        """(ses, eid, t, code, code_b, value): the marker log in both code books."""
        base = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
        code = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in CODE_A.items()])
        code_b = (
            F.when(F.col("event_type") == "signup", 100)
            .when(F.col("event_type") == "error", 0)
            .otherwise(1 + F.pmod(F.floor("value").cast("int"), F.lit(7)))
        )
        return self.events.select(
            F.col("user_id").alias("ses"),
            F.col("event_id").alias("eid"),
            ((F.unix_micros(F.col("ts").cast("timestamp")) - base) / F.lit(HOURS)).alias("t"),
            code.alias("code"),
            code_b.cast("int").alias("code_b"),
            "value",
        )

    def samples(self):
        """(rec, i, ch, v): one value per recording, sample and channel."""
        return self.lineitem.groupBy(
            F.floor(F.col("l_orderkey") / BLOCK).cast("long").alias("rec"),
            F.pmod("l_orderkey", F.lit(BLOCK)).cast("long").alias("i"),
            F.col("l_linenumber").alias("ch"),
        ).agg((F.max("l_extendedprice") / 1000.0).alias("v"))

    def packed(self):
        """(unit, cond, x array<double>) single-channel epochs of 64 samples."""
        return self.embeddings.select(
            F.col("vec_id").alias("unit"), F.col("label").alias("cond"),
            F.transform("embedding", lambda v: v.cast("double")).alias("x"),
        )

    def multichannel(self):
        """(unit, cond, ch, x array<double>): 8 channels x 8 samples per unit."""
        p = self.packed()
        return p.select(
            "unit", "cond",
            F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda c: F.slice("x", c * 8 + 1, 8))).alias("ch", "x"),
        )


# The same mapping as DuckDB text, composed into the oracle queries.
EV = """ev AS (SELECT user_id AS ses, event_id AS eid, (epoch_us(ts)-1704067200000000)/3600000000.0 AS t,
 CASE event_type WHEN 'signup' THEN 128 WHEN 'click' THEN 2 WHEN 'view' THEN 4 WHEN 'purchase' THEN 8 ELSE 16 END AS code,
 CASE event_type WHEN 'signup' THEN 100 WHEN 'error' THEN 0 ELSE 1+(floor(value)::INT % 7) END AS code_b, value FROM events)"""
SIG = """sig AS (SELECT l_orderkey // 512 AS rec, l_orderkey % 512 AS i, l_linenumber AS ch,
 max(l_extendedprice)/1000.0 AS v FROM lineitem GROUP BY 1,2,3)"""
MC = """mc AS (SELECT vec_id AS unit, label AS cond, (k-1)//8 AS ch, (k-1)%8 AS i, embedding[k]::DOUBLE AS x
 FROM embeddings, range(1,65) r(k))"""
