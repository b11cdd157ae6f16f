"""Scans and sinks of the file formats a recording study comes in."""

import uuid

from pyspark.sql import functions as F

from ..session import shared_dir

# Accepted stage labels.
STAGE_ALIASES = {"W": "W", "WAKE": "W", "N1": "N1", "S1": "N1", "N2": "N2", "S2": "N2", "N3": "N3", "S3": "N3", "S4": "N3", "R": "R", "REM": "R"}
FORMAT_VERSION = 2


def scratch(spark):
    """A new path below the session's shared folder."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def read_tsv(spark, path, schema, coerce=None):
    """Tab-separated scan with a declared schema; columns in `coerce` {name: type} are
    read as text and become NULL where they do not parse."""
    d = spark.read.csv(path, sep="\t", header=True, schema=schema, nullValue="n/a")
    return d.withColumns({c: F.col(c).try_cast(ty) for c, ty in (coerce or {}).items()})


def read_event_column(spark, path, schema, column, index, rate):
    """Only the sparse event column of a wide recording; empty cells dropped."""
    d = spark.read.csv(path, sep="\t", header=True, schema=schema, encoding="ISO-8859-1").select(index, column)
    return d.where(F.col(column).isNotNull() & (F.col(column) != "")).withColumn("onset_s", F.col(index) / F.lit(float(rate)))


def read_sidecars(spark, path, default_rate=256.0):
    """JSON sidecars: duration and sampling rate (default when absent)."""
    d = spark.read.schema("RecordingDuration double, SamplingFrequency double").json(path, multiLine=True)
    return d.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1).alias("name"), F.col("RecordingDuration").alias("duration_s"),
                    F.coalesce("SamplingFrequency", F.lit(default_rate)).alias("sfreq"))


def file_listing(spark, path, pattern="*"):
    """(name, size) of every file below a folder, without reading any content."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return d.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("size"))


def session_catalogue(files, groups):
    """Names like m_task_n12.txt -> group, condition, number, 'n' flag, mapped group."""
    rx = r"^([mc])_(task|med|rest)_(n?)(\d+)\.txt"
    part = lambda k: F.regexp_extract("name", rx, k)
    d = files.where(F.col("name").rlike(rx)).withColumns({"g": part(1), "condition": part(2), "flag": (part(3) == "n").cast("int"), "number": part(4).cast("int")})
    return d.join(groups, "g", "left").withColumn("sub", F.concat("g", F.when(F.col("flag") == 1, "n").otherwise(""), F.col("number").cast("string")))


def read_stages(lines):
    """Stage lines separated by tabs, commas or blanks; headers, unknown labels and bad
    numbers are skipped; labels normalised."""
    p = F.filter(F.split(F.trim("line"), r"[\t,;]+|\s+"), lambda s: s != "")
    alias = F.create_map(*[F.lit(x) for kv in STAGE_ALIASES.items() for x in kv])
    d = lines.withColumn("_p", p).where(F.size("_p") >= 3)
    d = d.withColumns({"stage": F.try_element_at(alias, F.upper(F.col("_p")[0])), "onset_s": F.col("_p")[1].try_cast("double"), "duration_s": F.col("_p")[2].try_cast("double")})
    return d.where("stage is not null and onset_s is not null and duration_s is not null").drop("_p")


def parse_log(lines):
    """Free-text log lines -> kind, question time, or key press."""
    ques = r"MW question asked at time\s+([0-9.]+) second"
    press = r"Key (\S+) \(code \d+\) pressed at time\s+([0-9.]+) seconds, status (\d+)"
    get = lambda rx, k: F.nullif(F.regexp_extract("line", rx, k), F.lit(""))
    d = lines.withColumns({"t_q": get(ques, 1).try_cast("double"), "key": get(press, 1).try_cast("int"), "t_key": get(press, 2).try_cast("double"), "status": get(press, 3).try_cast("int")})
    kind = F.when(F.col("t_q").isNotNull(), "question").when(F.col("t_key").isNotNull(), "key")
    return d.withColumn("kind", kind).where("kind is not null")


def parse_pointer(link):
    """Expected size and MD5 of a link text MD5E-s<size>--<md5>."""
    rx = r"MD5E-s(\d+)--([0-9a-f]{32})"
    return (F.nullif(F.regexp_extract(link, rx, 1), F.lit("")).cast("long").alias("size"), F.nullif(F.regexp_extract(link, rx, 2), F.lit("")).alias("md5"))


def verify_content(rows, ident, content, expected_md5, expected_size):
    """Content against its expected MD5 and size; mismatches get a quarantine name."""
    ok = (F.md5(content) == expected_md5) & (F.octet_length(content) == expected_size)
    status = F.when(expected_md5.isNull(), "unknown").when(ok, "ok").otherwise("bad")
    return rows.select(ident, status.alias("status"), F.when(status == "bad", F.concat(F.col(ident).cast("string"), F.lit(".badmd5"))).alias("quarantine"))


def append_manifest(df, path):
    """Append-only manifest; the header (schema) is written once with the first rows."""
    df.write.mode("append").parquet(path)


def append_new(df, path, spark, keys):
    """Append only units that are not in the sink yet; returns the rows added."""
    done = spark.read.parquet(path).select(*keys).distinct()
    new = df.join(done, keys, "left_anti")
    new.write.mode("append").parquet(path)
    return new


def append_indexed(results, path, index, spark, key, entry):
    """Write-once store with an index: append_new, and one index row (key, entry columns) per unit added.

    The index is append-only; what was added before keeps its row.
    """
    done = spark.read.parquet(index).select(key).distinct()
    added = results.join(done, key, "left_anti")
    # The store first: an index row never names a unit that was not written. A rerun after a loss
    # in between finds the unit in the store and writes its index row only.
    append_new(added, path, spark, [key])
    append_manifest(added.select(key, *entry), index)


def newest_first(index, made, key):
    """Index rows with their place from the newest on, equal times by key."""
    from ..operators.ordered import numbered

    age = F.datediff(F.lit("9999-12-31").cast("date"), F.col(made))
    return numbered(index.withColumn("_age", age), [], ["_age", key], "place").drop("_age")


def recompute_list(expected, results, key):
    """Units without a result, with an old format, or with another log method."""
    r = expected.join(results, key, "left")
    reason = F.when(F.col("format_version").isNull(), "missing").when(F.col("format_version") < FORMAT_VERSION, "old format").when(~F.col("method").startswith("iclabel"), "other method")
    return r.withColumn("reason", reason).where("reason is not null").select(key, "reason")


def run_key(inputs):
    """Key of a run: the first ten digits of the SHA-1 of its inputs as sorted JSON."""
    return F.substring(F.sha1(F.to_json(inputs)), 1, 10)


def flatten_json(df, ident, text):
    """(ident, path, value): every leaf of a JSON document under its dotted path.

    Lists of at most eight numbers are exploded with [i]; other lists stay text.  The walk
    ends at the level where no object is left, however deep the documents are.
    """
    d = df.select(ident, F.lit("").alias("path"), F.try_parse_json(text).alias("v"))
    leaves = None
    while True:
        d = d.withColumn("_k", F.schema_of_variant("v"))
        leaf = d.where(~F.coalesce(F.col("_k").startswith("OBJECT"), F.lit(False))).drop("_k")
        leaves = leaf if leaves is None else leaves.unionByName(leaf)
        inner = d.where(F.col("_k").startswith("OBJECT"))
        if inner.isEmpty():
            break
        m = inner.select(ident, "path", F.expr("try_variant_get(v, '$', 'map<string,variant>')").alias("m"))
        d = m.select(ident, F.col("path").alias("_p"), F.explode("m").alias("k", "v")).select(ident, F.concat(F.when(F.col("_p") == "", "").otherwise(F.concat("_p", F.lit("."))), "k").alias("path"), "v")
    arr = F.expr("try_variant_get(v, '$', 'array<double>')")
    a = leaves.withColumn("_a", F.when(F.schema_of_variant("v").startswith("ARRAY"), arr))
    lists = a.where(F.col("_a").isNotNull() & (F.size("_a") <= 8)).select(ident, "path", F.posexplode("_a").alias("i", "x")).select(
        ident, F.concat("path", F.lit("["), F.col("i").cast("string"), F.lit("]")).alias("path"), F.col("x").cast("string").alias("value"))
    plain = a.where(F.col("_a").isNull() | (F.size("_a") > 8)).select(ident, "path", F.expr("cast(v as string)").alias("value"))
    return lists.unionByName(plain)
