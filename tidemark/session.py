"""Session settings and scale parameters shared by every job."""

import uuid

from pyspark.sql import SparkSession

CHUNK_ROWS_KEY = "spark.tidemark.chunkRows"
DEFAULT_CHUNK_ROWS = 2_000_000


def build_session(app="tidemark", master=None, shuffle_partitions=None, extra=None):
    """A session with adaptive execution, skew handling and a fixed time zone."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.executorEnv.OMP_NUM_THREADS", "1")
        .config("spark.executorEnv.MKL_NUM_THREADS", "1")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def chunk_rows(spark):
    """Rows of one key that a single task may hold before the key is split."""
    return int(spark.conf.get(CHUNK_ROWS_KEY, str(DEFAULT_CHUNK_ROWS)))


def spread(df, *keys):
    """Shuffle into the session's full partition count before compute-heavy rows.

    An explicit count is kept as it is by AQE, which would otherwise merge partitions
    that are small in bytes but long in work.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def shared_dir(spark):
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    A local session (a test run) without one gets a folder of its own; a cluster
    session without one is refused, since a local folder would differ per machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = set_dir.get() if set_dir.isDefined() else None
    if named is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def cut_lineage(df):
    """Write an iteration's state to the reliable checkpoint folder."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def stored(df):
    """Write df as a table in the shared folder and read it back.

    Besides cutting lineage this gives the planner the table's size, so that it
    broadcasts a join side only after its size has been measured.
    """
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
