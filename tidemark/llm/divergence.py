"""How far the sources of a language differ in their use of words.

CountVectorizer fits each language's terms (those in enough of its documents, however many they are) and turns every document into
an exact sparse vector. The vectors are summed per source by their indices, never as dense rows. A term's row then
holds its counts in all sources that use it; blocks of such rows give the summed distance of all pairs of sources at once, and
the terms by which a source exceeds its language. All numbers are integers.
"""

import uuid

import numpy as np
import pandas as pd
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..session import shared_dir, stored
from .common import text_batches

LEAST_DOCS = 30            # documents of the language that hold a kept term
TOP = 50                   # terms reported of a source
UNIT, PRIOR = 1_000_000_000, 5
CELLS = 1 << 22            # numbers in a block of terms by sources
_EVERY_TEXT = "\x01"        # stands in every document, so that no vocabulary is empty; it is in no term
# A term is a run of ASCII letters and of anything beyond ASCII: the bytes A-Z become a-z, all other ASCII a blank.
_BYTES = bytes(c | 0x20 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def spaced_terms(text):
    """The terms of each text in order and then the mark, with one blank between."""
    @pandas_udf("string")
    def spaced(texts: pd.Series) -> pd.Series:
        return pd.Series([b" ".join([*t.encode("utf-8", "surrogatepass").translate(_BYTES).split(), b"\x01"]).decode("utf-8", "surrogatepass") for t in texts], dtype=object)

    return spaced(text)


def share(count, total, kept):
    """1 + floor(UNIT (count + PRIOR) / (total + PRIOR kept)), exact for any counts."""
    count, total, kept = (c.cast("decimal(20,0)") for c in (count, total, kept))
    return (F.lit(1) + F.call_function("div", (count + PRIOR) * UNIT, total + kept * PRIOR)).cast("long")


def _vectorised(spark, path, k, least_docs, out):
    """Counts per source and term of language k, and its vocabulary, written below `out`."""
    rows = spark.read.parquet(f"{path}/k={k}").select("s", F.split("terms", " ").alias("terms"))
    model = CountVectorizer(inputCol="terms", outputCol="v", minDF=float(least_docs), vocabSize=(1 << 31) - 1).fit(rows)
    model.write().save(f"{out}/model/{k}")
    vectors = model.transform(rows).select("s", F.unwrap_udt("v").alias("v"))
    pairs = vectors.select("s", F.explode(F.arrays_zip("v.indices", "v.values")).alias("c"))
    counts = pairs.groupBy("s", F.col("c.indices").alias("i")).agg(F.sum(F.col("c.values").cast("long")).alias("n"))
    counts.write.parquet(f"{out}/counts/k={k}")
    names = spark.read.parquet(f"{out}/model/{k}/data").select(F.posexplode("vocabulary").alias("i", "term"))
    names.where(F.col("term") != _EVERY_TEXT).write.parquet(f"{out}/names/k={k}")


def _pair_sums(bases):
    """Distances of all pairs of sources, from rows (k, panel, entries of (s, p)) that come sorted by k and panel.

    bases: k -> p of a term without a count, by source.
    """
    def run(frames):
        key, held, size = None, [], 0

        def block(key, held):
            base = bases.value[key[0]]
            p = np.tile(base, (len(held), 1))
            for row, entries in enumerate(held):
                p[row, [e["s"] for e in entries]] = [e["p"] for e in entries]
            width = max(1, CELLS // len(base))
            at = np.arange(key[1] * width, min(len(base), (key[1] + 1) * width))
            return np.stack([np.abs(p - p[:, [a]]).sum(axis=0) for a in at])

        def frame(key, total):
            width = max(1, CELLS // total.shape[1])
            a, b = np.nonzero(np.ones_like(total, dtype=bool))
            a_s = a + key[1] * width
            real = a_s != b
            return pd.DataFrame({"k": np.int32(key[0]), "a": a_s[real].astype("int32"), "b": b[real].astype("int32"), "value": total[a, b][real]})

        total = 0
        for df in frames:
            for k, panel, entries in zip(df["k"], df["panel"], df["entries"]):
                if (k, panel) != key or (size + 1) * len(bases.value[k]) > CELLS:
                    if held:
                        total = total + block(key, held)
                        held, size = [], 0
                    if (k, panel) != key:
                        if key is not None:
                            yield frame(key, total)
                        key, total = (k, panel), 0
                held.append(entries)
                size += 1
        if held:
            yield frame(key, total + block(key, held))
    return run


def audit(docs, text_col="text", lang_col="lang", source_col="source", least_docs=LEAST_DOCS, top=TOP):
    """(lang, source, part, item, value, rank): distances between sources of a language, and each source's own terms.

    Null texts, languages and sources are read as ''. Every row counts as a document, repeated rows each. A language of fewer
    than `least_docs` documents keeps no term: its pairs have value 0. An empty table gives no row; other columns do
    not matter. Part 'pair' has all other sources of the language, part 'term' the `top` terms whose share in the source is above that in
    the language.

    CountVectorizer holds the vocabulary of one language at a time on the driver. The list of groups (lang, source) is held there
    too; the result has a row per pair of groups of a language, so the list grows with the square root of the result.
    """
    spark = docs.sparkSession
    read = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    rows = docs.select(read(lang_col).alias("lang"), read(source_col).alias("source"), read(text_col).alias("text"))
    w = Window.partitionBy("lang").orderBy("source")
    sizes = stored(rows.groupBy("lang", "source").count())
    listed = sizes.groupBy("lang").agg(F.sum("count").alias("docs")).orderBy("lang").collect()
    number = spark.createDataFrame([(r["lang"], i, r["docs"]) for i, r in enumerate(listed)], "lang string, k int, docs long")
    groups = stored(sizes.join(number, "lang").select("lang", "k", "docs", "source", (F.row_number().over(w) - 1).alias("s")))
    large = [i for i, r in enumerate(listed) if r["docs"] >= least_docs]

    out = f"{shared_dir(spark)}/divergence/{uuid.uuid4().hex}"
    known = groups.where(F.col("docs") >= least_docs).select("lang", "source", "k", "s")
    split = rows.join(known, ["lang", "source"]).select("k", "s", spaced_terms("text").alias("terms"))
    no_terms = groups.where(F.col("docs") < least_docs)
    parts = []
    if large:
        text_batches(split).write.partitionBy("k").parquet(f"{out}/terms")
        for k in large:
            _vectorised(spark, f"{out}/terms", k, least_docs, out)
        names = spark.read.schema("i int, term string, k int").parquet(f"{out}/names")
        counts = spark.read.schema("s int, i int, n long, k int").parquet(f"{out}/counts").join(names, ["k", "i"])
        kept = {r["k"]: r["count"] for r in names.groupBy("k").count().collect()}
        no_terms = no_terms.unionByName(groups.where(F.col("k").isin([k for k in large if k not in kept])))
        bare = groups.where("k in ({})".format(",".join(map(str, kept)) or "-1"))
        v = F.element_at(F.create_map(*(F.lit(x) for pair in kept.items() for x in pair)), F.col("k")) if kept else F.lit(0)
        of_group = bare.join(counts.groupBy("k", "s").agg(F.sum("n").alias("total")), ["k", "s"], "left").select(
            "k", "s", "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), v.cast("long").alias("kept"))
        of_group = stored(of_group.withColumn("p0", share(F.lit(0), F.col("total"), F.col("kept"))))
        whole = of_group.groupBy("k").agg(F.sum("total").alias("whole"))
        placed = counts.join(of_group.select("k", "s", "total", "kept"), ["k", "s"])
        by_term = stored(placed.groupBy("k", "term").agg(
            F.collect_list(F.struct("s", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"))).alias("entries"), F.sum("n").alias("n"), F.max("kept").alias("kept")))
        above = by_term.join(F.broadcast(whole), "k").select("k", "term", share(F.col("n"), F.col("whole"), F.col("kept")).alias("q"), F.explode("entries").alias("e"))
        above = above.select("k", F.col("e.s").alias("s"), F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("e.p") - F.col("q")).alias("value")).where("value > 0")
        ranked = above.withColumn("rank", F.row_number().over(Window.partitionBy("k", "s").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top)
        parts.append(of_group.select("k", "s", "lang", "source").join(ranked, ["k", "s"]).select("lang", "source", "part", "item", "value", "rank"))

        bases = {}
        for r in of_group.select("k", "s", "p0").orderBy("k", "s").toLocalIterator():
            bases.setdefault(r["k"], []).append(r["p0"])
        panels = {k: -(-len(p) // max(1, CELLS // len(p))) for k, p in bases.items()}
        if bases:
            last = F.element_at(F.create_map(*(F.lit(x) for pair in panels.items() for x in pair)), F.col("k")) - 1
            spread = by_term.select("k", F.explode(F.sequence(F.lit(0), last)).alias("panel"), "entries")
            spread = spread.sortWithinPartitions("k", "panel")
            shared = spark.sparkContext.broadcast({k: np.array(p, dtype=np.int64) for k, p in bases.items()})
            sums = spread.mapInPandas(_pair_sums(shared), "k int, a int, b int, value long").groupBy("k", "a", "b").agg(F.sum("value").alias("value"))
            parts.append(_ranked_pairs(of_group, sums.withColumnRenamed("a", "s")))
    # Sources of languages without terms: every pair at distance 0.
    other = no_terms.select("k", F.col("s").alias("b"))
    parts.append(_ranked_pairs(no_terms, no_terms.select("k", "s").join(other, "k").where("s <> b").withColumn("value", F.lit(0).cast("long"))))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


def _ranked_pairs(groups, pairs):
    """Rows of part 'pair' from (k, s, b, value), with names instead of numbers."""
    named = groups.select("k", "s", "lang", "source").join(pairs, ["k", "s"])
    named = named.join(groups.select("k", F.col("s").alias("b"), F.col("source").alias("item")), ["k", "b"])
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return named.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
