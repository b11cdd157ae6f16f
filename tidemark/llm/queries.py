"""One registered query per corpus operator, over its whole table, and the DuckDB twins."""

import uuid

from pyspark.sql import functions as F

from ..session import shared_dir, stored
from .common import held_out
from .divergence import LEAST_DOCS, TOP, audit
from .fingerprints import edits
from .langid import identify, train
from .linededup import LEAST_PAGES, MOST_LOST, RATIO, drop_boilerplate
from .mixing import curriculum, mix
from .neighbours import nearest
from .packing import pack, tokenize
from .quality import score as score_quality, train as train_quality
from .sharding import assign_shards
from .simhash import near_duplicates
from .toxicity import score, train as train_toxicity
from .warc import read_archives, write_archives
from .whitening import whiten

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return wrap


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op5_vector_shards")
def op5(spark, sf_dir):
    """Every document into one of 16 shards of near equal bytes, words and rows."""
    return assign_shards(table(spark, sf_dir, "documents"), 16).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


# Base32 of a hexadecimal digest: 5 hex digits make 4 letters.
_BASE32 = """array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (5 * (3 - i % 4))::BIGINT) % 32, 1)
   FOR i IN range(0, 32)], '')"""


@query("op10_warc_round_trip", f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
 CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN page_id <> first THEN first END AS refers_to FROM r
""")
def op10(spark, sf_dir):
    """Archives of all pages, written and read back; revisits take size from their response."""
    path = f"{shared_dir(spark)}/warc/{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    page = F.nullif(F.regexp_extract("record_id", r"^<urn:page:(-?\d*)", 1), F.lit("")).cast("long")
    refers = F.nullif(F.regexp_extract("refers_to", r"^<urn:page:(-?\d*)", 1), F.lit("")).cast("long")
    # The archives are read once; what is kept of a record is small.
    read = stored(read_archives(spark, path, with_payload=False).select(
        page.alias("page_id"), F.col("type").alias("record_type"), F.substring_index("digest", ":", -1).alias("payload_digest"), "payload_bytes", refers.alias("refers_to")))
    responses = read.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("size"))
    return read.join(responses, "payload_digest", "left").select(
        "page_id", F.coalesce("payload_bytes", "size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


_MIX_SQL = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
 md5(coalesce(doc_id::VARCHAR, '') || ':' || length(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM s),
w AS (SELECT *, ([5, 2, 1])[(k % 3 + 1)::INT] AS weight, 3 * source_size AS cap FROM r),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT level AS top FROM l WHERE level * weight <= cap ORDER BY cap / weight, k LIMIT 1),
t AS (SELECT source, k, source_size, coalesce(least(top * weight, cap::DOUBLE), cap::DOUBLE) AS target FROM l LEFT JOIN f ON true),
a AS (SELECT d.*, t.k, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_word
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
b AS (SELECT *, list_transform([0, 1, 2], lambda p: greatest(0, least(size, floor(target)::BIGINT - first_word - source_size * p))) AS parts FROM a),
c AS (SELECT *, first_word / target AS want, CASE k % 3 WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS w0 FROM b),
e AS (SELECT *, (w0 + 1.0) / 2.0 AS a1, (1.0 + (2.0 - w0)) / 2.0 AS a2 FROM c),
g AS (SELECT *, want * (a1 + a2) AS x, a1 <= want * (a1 + a2) AS late FROM e),
i AS (SELECT *, CASE WHEN late THEN x - a1 ELSE x - 0.0 END AS y, CASE WHEN late THEN 1.0::DOUBLE ELSE w0 END AS v,
  CASE WHEN late THEN (2.0 - w0) - 1.0 ELSE 1.0 - w0 END AS slope FROM g)
SELECT doc_id, size::BIGINT AS size, source_size, target, list_sum(parts)::BIGINT AS taken,
 CASE WHEN parts[1] > 0 THEN least(1.0::DOUBLE, (CASE WHEN late THEN 1.0 ELSE 0.0 END + CASE WHEN abs(slope) < 1e-12 THEN y / v ELSE (sqrt(v * v + 2.0 * slope * y) - v) / slope END) / 2) END AS position
FROM i
"""


@query("op3_curriculum_mix", _MIX_SQL)
def op3(spark, sf_dir):
    """Words that the mix takes of every document, in order of training position."""
    mixed = mix(table(spark, sf_dir, "documents"))
    return curriculum(mixed).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "position")


@query("op4_simhash_groups")
def op4(spark, sf_dir):
    """Fingerprint and near-duplicate group of every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


@query("op7_site_line_dedup", f"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
k AS (SELECT *, list_transform(lines, lambda x: trim(x, chr(32) || chr(9) || chr(13) || chr(10) || chr(12) || chr(11))) AS bare FROM d),
p AS (SELECT DISTINCT source, coalesce(text, '') AS text, list_distinct(list_filter(coalesce(bare, []), lambda x: x <> '')) AS keys FROM k),
n AS (SELECT source, count(*) AS host_pages FROM p GROUP BY 1),
u AS (SELECT source, unnest(keys) AS line FROM p),
b AS (SELECT u.source, line, count(*) AS pages FROM u GROUP BY 1, 2 HAVING count(*) >= {LEAST_PAGES}),
h AS (SELECT b.source, list(line) AS drops FROM b JOIN n ON b.source IS NOT DISTINCT FROM n.source WHERE pages > host_pages * {RATIO} GROUP BY 1),
j AS (SELECT k.*, list_transform(bare, lambda x: x <> '' AND coalesce(list_contains(drops, x), false)) AS hit FROM k LEFT JOIN h ON k.source IS NOT DISTINCT FROM h.source),
m AS (SELECT *, coalesce(list_sum(list_transform(range(1, len(lines) + 1), lambda i: CASE WHEN hit[i] THEN length(bare[i]) ELSE 0 END)), 0) AS lost,
  coalesce(list_sum(list_transform(bare, lambda x: length(x))), 0) AS whole FROM j),
r AS (SELECT *, CASE WHEN lost <= whole * {MOST_LOST} THEN coalesce(len(list_filter(hit, lambda x: x)), 0) ELSE 0 END AS lines_dropped FROM m)
SELECT doc_id, coalesce(len(lines), 0)::INT AS lines, lines_dropped::INT AS lines_dropped,
 CASE WHEN lines_dropped > 0 THEN array_to_string(list_filter(lines, lambda x, i: NOT hit[i]), chr(10)) ELSE text END AS text FROM r
""")
def op7(spark, sf_dir):
    """Documents without the lines that are boilerplate of their source."""
    return drop_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "lines", "lines_dropped", "text")


def tokenizer_definition():
    """The default tokenizer, read once by the driver and sent to the tasks."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


@query("op8_pattern_packing")
def op8(spark, sf_dir):
    """The place of every token piece of every document in sequences of 4096."""
    return pack(tokenize(table(spark, sf_dir, "documents"), tokenizer_definition())).withColumnRenamed("doc", "doc_id")


@query("op9_language")
def op9(spark, sf_dir):
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs)
    return identify(docs.select("doc_id", "text"), model, score_out="score").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op1_multiset_fingerprints")
def op1(spark, sf_dir):
    """Fingerprint of every document and of its edited text, and their likeness."""
    return edits(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op6_projected_neighbours")
def op6(spark, sf_dir):
    """The 20 nearest found of every twentieth vector, among all vectors."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0).withColumnRenamed("id", "vec_id")


@query("op2_weak_toxicity")
def op2(spark, sf_dir):
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents")
    model = train_toxicity(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op11_line_quality")
def op11(spark, sf_dir):
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    model = train_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op12_whitening")
def op12(spark, sf_dir):
    """Every vector on the first four whitening components."""
    return whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


_SHARE = "1 + 1000000000 * ({0} + 5)::HUGEINT // ({1} + 5 * {2})"


@query("op13_source_divergence", f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(terms) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY 1, 2 HAVING count(*) >= {LEAST_DOCS}),
w AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY 1),
s AS (SELECT c.lang, c.source, c.term, sum(c.n)::HUGEINT AS n FROM c JOIN k USING (lang, term) GROUP BY 1, 2, 3),
t AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN s USING (lang, source) GROUP BY 1, 2),
p AS (SELECT t.lang, t.source, k.term, coalesce(s.n, 0) AS n, {_SHARE.format("coalesce(s.n, 0)", "t.total", "w.v")} AS p, {_SHARE.format("k.n", "w.total", "w.v")} AS q
  FROM t JOIN k USING (lang) JOIN w USING (lang) LEFT JOIN s ON s.lang = t.lang AND s.source = t.source AND s.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
 UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
y AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM x)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM y WHERE part = 'pair' OR rank <= {TOP}
""")
def op13(spark, sf_dir):
    """Distances between the sources of a language, and the terms that mark each source."""
    return audit(table(spark, sf_dir, "documents"))
