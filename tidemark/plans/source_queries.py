"""File scans, sinks, manifests and catalogues; files are derived from the given tables."""

from pyspark.sql import functions as F

from ..operators.ordered import numbered, running, union_all
from ..sources import files as fs
from ..sources.tables import EV
from .registry import query

R6 = lambda c: F.round(c, 6)


@query("sc1_delimited_scan", "SELECT event_id, user_id, CASE WHEN event_id%7=0 THEN NULL ELSE event_id%9 END AS code, value FROM events")
def sc1(t):
    path = fs.scratch(t.spark) + "/events"
    bad = F.when(F.col("event_id") % 7 == 0, "x?").otherwise((F.col("event_id") % 9).cast("string"))
    t.events.select("event_id", "user_id", bad.alias("code"), "value").write.csv(path, sep="\t", header=True)
    return fs.read_tsv(t.spark, path, "event_id long, user_id long, code string, value double", {"code": "long"})


@query("sc2_event_column_scan", "SELECT event_id AS row_index, concat('RS232 Trigger: ',event_id%9) AS text, round(event_id/2048.0,6) AS onset_s FROM events WHERE event_id%3=0")
def sc2(t):
    path = fs.scratch(t.spark) + "/wide"
    txt = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("RS232 Trigger: "), (F.col("event_id") % 9).cast("string"))).otherwise("")
    wide = t.events.select(F.col("event_id").alias("row_index"), *[(F.col("value") * k).alias(f"c{k}") for k in range(1, 6)], txt.alias("text"))
    wide.write.csv(path, sep="\t", header=True, encoding="ISO-8859-1")
    d = fs.read_event_column(t.spark, path, wide.schema, "text", "row_index", 2048.0)
    return d.select("row_index", "text", R6(F.col("onset_s")).alias("onset_s"))


@query("sc3_json_sidecars", "SELECT n_nationkey AS k, round(n_regionkey*100.5,2) AS duration_s, CASE WHEN n_nationkey%3=0 THEN 256.0 ELSE 128.0+n_nationkey END AS sfreq FROM nation")
def sc3(t):
    path = fs.scratch(t.spark) + "/side"
    js = F.to_json(F.struct((F.col("n_regionkey") * 100.5).alias("RecordingDuration"), F.when(F.col("n_nationkey") % 3 != 0, 128.0 + F.col("n_nationkey")).alias("SamplingFrequency"), "n_nationkey"))
    t.nation.select(js.alias("value")).write.text(path)
    d = t.spark.read.schema("RecordingDuration double, SamplingFrequency double, n_nationkey int").json(path)
    return d.select(F.col("n_nationkey").alias("k"), F.round("RecordingDuration", 2).alias("duration_s"), F.coalesce("SamplingFrequency", F.lit(256.0)).alias("sfreq"))


NAMES = "f AS (SELECT doc_id, concat(CASE WHEN doc_id%2=0 THEN 'm' ELSE 'c' END,'_',CASE doc_id%4 WHEN 0 THEN 'task' WHEN 1 THEN 'med' WHEN 2 THEN 'rest' ELSE 'x' END,'_',CASE WHEN doc_id%5=0 THEN 'n' ELSE '' END,doc_id,'.txt.cpgz') AS name, n_chars AS size FROM documents), c AS (SELECT name, size, regexp_extract(name,'^([mc])_(task|med|rest)_(n?)([0-9]+)[.]txt',1) AS g, regexp_extract(name,'^([mc])_(task|med|rest)_(n?)([0-9]+)[.]txt',2) AS condition, (regexp_extract(name,'^([mc])_(task|med|rest)_(n?)([0-9]+)[.]txt',3)='n')::INT AS flag, regexp_extract(name,'^([mc])_(task|med|rest)_(n?)([0-9]+)[.]txt',4)::INT AS number FROM f WHERE regexp_matches(name,'^([mc])_(task|med|rest)_(n?)([0-9]+)[.]txt'))"


def named_files(t):
    cond = F.when(F.col("doc_id") % 4 == 0, "task").when(F.col("doc_id") % 4 == 1, "med").when(F.col("doc_id") % 4 == 2, "rest").otherwise("x")
    name = F.concat(F.when(F.col("doc_id") % 2 == 0, "m").otherwise("c"), F.lit("_"), cond, F.lit("_"), F.when(F.col("doc_id") % 5 == 0, "n").otherwise(""), F.col("doc_id").cast("string"), F.lit(".txt.cpgz"))
    return t.documents.select(name.alias("name"), F.col("n_chars").alias("size"))


def catalogue(t):
    groups = t.spark.createDataFrame([("m", "expert"), ("c", "novice")], "g string, grp string")
    return fs.session_catalogue(named_files(t), groups)


@query("sc4_session_catalogue", f"WITH {NAMES} SELECT concat(g,CASE WHEN flag=1 THEN 'n' ELSE '' END,number) AS sub, CASE g WHEN 'm' THEN 'expert' ELSE 'novice' END AS grp, condition, number, flag, size, row_number() OVER (PARTITION BY g ORDER BY flag,number,condition) AS pos FROM c")
def sc4(t):
    c = catalogue(t).withColumn("_o", F.col("flag") * 1e12 + F.col("number"))
    return numbered(c, ["g"], ["_o", "condition"], "pos").select("sub", "grp", "condition", "number", "flag", "size", "pos")


@query("sc5_stage_annotations", """WITH l AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'WAKE' WHEN 'view' THEN 's2' WHEN 'purchase' THEN 'REM' WHEN 'signup' THEN 'S4' ELSE 'Label' END AS lab, event_id%11=0 AS broken, value FROM events)
SELECT event_id, CASE lab WHEN 'WAKE' THEN 'W' WHEN 's2' THEN 'N2' WHEN 'REM' THEN 'R' ELSE 'N3' END AS stage, event_id*30.0::DOUBLE AS onset_s, value AS duration_s FROM l WHERE lab<>'Label' AND NOT broken""")
def sc5(t):
    path = fs.scratch(t.spark) + "/stages"
    lab = F.when(F.col("event_type") == "click", "WAKE").when(F.col("event_type") == "view", "s2").when(F.col("event_type") == "purchase", "REM").when(F.col("event_type") == "signup", "S4").otherwise("Label")
    sep = F.when(F.col("event_id") % 3 == 0, "\t").when(F.col("event_id") % 3 == 1, ",").otherwise("  ")
    on = F.when(F.col("event_id") % 11 == 0, "bad").otherwise((F.col("event_id") * 30.0).cast("string"))
    t.events.select(F.concat(lab, sep, on, sep, F.col("value").cast("string"), sep, F.col("event_id").cast("string")).alias("value")).write.text(path)
    lines = t.spark.read.text(path).select(F.col("value").alias("line"))
    last = F.regexp_extract("line", r"(\d+)$", 1).cast("long")
    return fs.read_stages(lines.withColumn("event_id", last)).select("event_id", "stage", "onset_s", "duration_s")


@query("sc6_free_text_log", f"WITH {EV} SELECT eid, CASE WHEN code=128 THEN 'question' ELSE 'key' END AS kind, CASE WHEN code=128 THEN round(t,3) END AS t_q, CASE WHEN code<>128 THEN round(t,3) END AS t_key, CASE WHEN code<>128 THEN (eid%5)::INT END AS key, CASE WHEN code<>128 THEN (eid%4)::INT END AS status FROM ev WHERE code<>16")
def sc6(t):
    path = fs.scratch(t.spark) + "/log"
    tm = F.round("t", 3).cast("decimal(12,3)").cast("string")
    line = F.when(F.col("code") == 128, F.concat(F.lit("MW question asked at time "), tm, F.lit(" second"))).when(F.col("code") == 16, F.lit("# remark")).otherwise(
        F.concat(F.lit("Key "), (F.col("eid") % 5).cast("string"), F.lit(" (code 97) pressed at time "), tm, F.lit(" seconds, status "), (F.col("eid") % 4).cast("string")))
    t.markers().select(F.concat(F.col("eid").cast("string"), F.lit(": "), line).alias("value")).write.text(path)
    lines = t.spark.read.text(path).select(F.col("value").alias("line"))
    return fs.parse_log(lines).select(F.regexp_extract("line", r"^(\d+):", 1).cast("long").alias("eid"), "kind", "t_q", "t_key", "key", "status")


@query("sc7_content_fingerprints", "SELECT doc_id, CASE WHEN doc_id%8=7 THEN 'unknown' WHEN doc_id%8=3 THEN 'bad' ELSE 'ok' END AS status, CASE WHEN doc_id%8=3 THEN concat(doc_id,'.badmd5') END AS quarantine FROM documents")
def sc7(t):
    want = F.when(F.col("doc_id") % 8 == 7, None).when(F.col("doc_id") % 8 == 3, F.md5(F.lit("other"))).otherwise(F.md5("text"))
    return fs.verify_content(t.documents, "doc_id", F.col("text"), want, F.octet_length("text"))


@query("sc7b_pointer_parse", "SELECT doc_id, CASE WHEN doc_id%6=5 THEN NULL ELSE n_chars END AS size, CASE WHEN doc_id%6=5 THEN NULL ELSE md5(text) END AS md5 FROM documents")
def sc7b(t):
    link = F.when(F.col("doc_id") % 6 == 5, "no link").otherwise(F.concat(F.lit(".git/annex/objects/MD5E-s"), F.col("n_chars").cast("string"), F.lit("--"), F.md5("text"), F.lit(".bdf")))
    return t.documents.select("doc_id", *fs.parse_pointer(link))


@query("sc8_file_plan", f"WITH {NAMES}, p AS (SELECT * FROM c WHERE g IN ('m','c') AND condition IN ('task','rest')) SELECT name, size, number%3<>0 AS have, sum(size) OVER (PARTITION BY condition ORDER BY number,flag,g)::BIGINT AS cum_size FROM p")
def sc8(t):
    p = catalogue(t).where("g in ('m','c') and condition in ('task','rest')")
    have = catalogue(t).where("number % 3 <> 0").select("name", F.lit(True).alias("have"))
    d = running(p.join(have, "name", "left").withColumn("have", F.coalesce("have", F.lit(False))), ["condition"], ["number", "flag", "g"], sums={"cum_size": F.col("size")})
    return d.select("name", "size", "have", "cum_size")


@query("sc9_manifest", "SELECT o_orderpriority AS file, count(*) AS n_rows, min(o_orderdate)::VARCHAR AS first_download FROM orders GROUP BY 1")
def sc9(t):
    path = fs.scratch(t.spark) + "/manifest"
    m = t.orders.select(F.col("o_orderpriority").alias("file"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("downloaded"))
    fs.append_manifest(m.where("file < '3'"), path)
    fs.append_manifest(m.where("file >= '3'"), path)
    return t.spark.read.parquet(path).groupBy("file").agg(F.count(F.lit(1)).alias("n_rows"), F.min("downloaded").alias("first_download"))


@query("sc10_resumable_append", "SELECT l_suppkey AS subject, l_returnflag AS condition, count(*) AS n FROM lineitem GROUP BY 1,2")
def sc10(t):
    path = fs.scratch(t.spark) + "/features"
    f = t.lineitem.groupBy(F.col("l_suppkey").alias("subject"), F.col("l_returnflag").alias("condition")).agg(F.count(F.lit(1)).alias("n"))
    f.where("subject % 2 = 0").write.parquet(path)
    fs.append_new(f, path, t.spark, ["subject", "condition"])
    return t.spark.read.parquet(path)


@query("sc11_packed_epochs", "SELECT vec_id AS unit, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)),6) AS total, concat('{\"cond\":',label,'}') AS log FROM embeddings")
def sc11(t):
    path = fs.scratch(t.spark) + "/packed"
    t.embeddings.select(F.col("vec_id").alias("unit"), F.col("embedding").cast("array<float>").alias("x"), F.to_json(F.struct(F.col("label").alias("cond"))).alias("log")).write.parquet(path)
    d = t.spark.read.parquet(path)
    return d.select("unit", F.size("x").alias("n"), R6(F.aggregate(F.transform("x", lambda v: v.cast("double")), F.lit(0.0), lambda s, v: s + v)).alias("total"), "log")


@query("sc12_stale_results", "SELECT c_custkey, CASE WHEN c_custkey%7=0 THEN 'missing' WHEN c_custkey%3=0 THEN 'old format' ELSE 'other method' END AS reason FROM customer WHERE c_custkey%7=0 OR c_custkey%3=0 OR c_custkey%5=0")
def sc12(t):
    r = t.customer.where("c_custkey % 7 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, 1).otherwise(2).alias("format_version"), F.when(F.col("c_custkey") % 5 == 0, "heuristic").otherwise("iclabel 0.8").alias("method"))
    return fs.recompute_list(t.customer.select("c_custkey"), r, "c_custkey")


@query("sc13_csv_sink", "SELECT n_nationkey, n_name, count(c_custkey) AS n_customers FROM nation LEFT JOIN customer ON c_nationkey=n_nationkey GROUP BY 1,2")
def sc13(t):
    path = fs.scratch(t.spark) + "/tables"
    c = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("k"))
    t.nation.join(c, "n_nationkey", "left").select("n_nationkey", "n_name", F.coalesce("k", F.lit(0)).alias("n_customers")).write.csv(path, header=True)
    return t.spark.read.csv(path, header=True, schema="n_nationkey int, n_name string, n_customers long")


WIDTHS = {"benchmark": 2, "conversations": 4, "customer": 5, "documents": 5, "embeddings": 3, "events": 6, "labels": 3, "lineitem": 11, "nation": 3,
          "orders": 6, "pages": 3, "part": 6, "region": 2, "supplier": 4}
NAMED = tuple(WIDTHS)


@query("sc14_dataset_catalogue", " UNION ALL ".join(f"SELECT '{n}' AS dataset, count(*) AS n_rows, {WIDTHS[n]} AS n_cols FROM {n}" for n in NAMED))
def sc14(t):
    return union_all([getattr(t, n).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("dataset"), "n_rows", F.lit(len(getattr(t, n).columns)).alias("n_cols")) for n in NAMED])


@query("sc15_dataset_profile", " UNION ALL ".join(f"SELECT l_returnflag AS grp, '{c}' AS col, round(avg({c}),6) AS mean, round(stddev_samp({c}),6) AS sd, min({c}) AS lo, max({c}) AS hi FROM lineitem GROUP BY 1" for c in ("l_discount", "l_quantity", "l_tax")))
def sc15(t):
    cols = ["l_quantity", "l_discount", "l_tax"]
    a = t.lineitem.groupBy(F.col("l_returnflag").alias("grp")).agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("mean", F.avg), ("sd", F.stddev_samp), ("lo", F.min), ("hi", F.max))])
    return a.select("grp", F.inline(F.array(*[F.struct(F.lit(c).alias("col"), R6(F.col(f"mean_{c}")).alias("mean"), R6(F.col(f"sd_{c}")).alias("sd"), F.col(f"lo_{c}").alias("lo"), F.col(f"hi_{c}").alias("hi")) for c in cols])))


@query("sc15_head_rows", "SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem ORDER BY ALL LIMIT 5")
def sc15h(t):
    """The first rows in key order; keys repeat, so the other columns settle ties."""
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax").orderBy("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax").limit(5)


@query("sc16_run_index", """WITH r AS (SELECT concat('{"clerk":"',o_orderstatus,'","prio":"',o_orderpriority,'"}') AS inputs, max(o_orderdate)::DATE AS made, count(*) AS n FROM orders GROUP BY 1),
k AS (SELECT substr(sha1(inputs),1,10) AS run_key, 'orders' AS kind, inputs, made FROM r) SELECT *, row_number() OVER (ORDER BY made DESC, run_key) AS place FROM k""")
def sc16i(t):
    """Results of two overlapping batches, each indexed once, listed from the newest on."""
    path, index = fs.scratch(t.spark) + "/runs", fs.scratch(t.spark) + "/index"
    inputs = F.struct(F.col("o_orderstatus").alias("clerk"), F.col("o_orderpriority").alias("prio"))
    r = t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").cast("date").alias("made"))
    r = r.select(fs.run_key(inputs).alias("run_key"), F.lit("orders").alias("kind"), F.to_json(inputs).alias("inputs"), "made", "n")
    entry = ["kind", "inputs", "made"]
    r.limit(0).write.parquet(path)
    r.limit(0).select("run_key", *entry).write.parquet(index)
    for batch in (r.where("n % 2 = 0"), r, r):
        fs.append_indexed(batch, path, index, t.spark, "run_key", entry)
    return fs.newest_first(t.spark.read.parquet(index), "made", "run_key").select("run_key", *entry, F.col("place").cast("long").alias("place"))


@query("sc16_result_store", """SELECT substr(sha1(concat('{"clerk":"',o_orderstatus,'","prio":"',o_orderpriority,'"}')),1,10) AS run_key, count(*) AS n FROM orders GROUP BY o_orderstatus,o_orderpriority""")
def sc16(t):
    path = fs.scratch(t.spark) + "/runs"
    k = fs.run_key(F.struct(F.col("o_orderstatus").alias("clerk"), F.col("o_orderpriority").alias("prio")))
    r = t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n")).select(k.alias("run_key"), "n")
    r.where("n % 2 = 0").write.parquet(path)
    fs.append_new(r, path, t.spark, ["run_key"])
    fs.append_new(r, path, t.spark, ["run_key"])
    return t.spark.read.parquet(path)


@query("sc17_flattened_json", "SELECT event_id, path, value FROM (SELECT event_id, 'a.k' AS path, json_extract_string(props,'$.k') AS value FROM events UNION ALL SELECT event_id, 'a.type', event_type FROM events UNION ALL SELECT event_id, concat('b[',i,']'), concat(event_id%10+i,'.0') FROM events, range(0,3) r(i) UNION ALL SELECT event_id, 'id', event_id::VARCHAR FROM events)")
def sc17(t):
    doc = F.to_json(F.struct(F.struct(F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("event_type").alias("type")).alias("a"), F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.col("event_id") % 10 + i).alias("b"), F.col("event_id").alias("id")))
    return fs.flatten_json(t.events.select("event_id", doc.alias("doc")), "event_id", F.col("doc"))
