"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of n-grams per language are summed by Spark; the log-probability matrix, whose size is
fixed by the number of buckets and the bound on languages, is broadcast, and whole texts are
scored in numpy batches as a sparse gather from it.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import held_out, text_batches, worker_state

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
DOCS_PER_LANGUAGE = 4_000    # expected size of the training sample of one language
MAX_LANGUAGES = 256          # bounds the broadcast matrix
SMOOTHING = 0.2
EVIDENCE = 100               # n-grams that count as independent at most
UNKNOWN = "und"
PIECE = 1 << 20              # code points hashed at once

_MULTIPLIERS = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def letters():
    """A table that says of each code point whether it is a letter."""
    return worker_state(("letters",), lambda: np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))


def pieces(text):
    """(code points, number of them that start an n-gram here) of a lower-cased text, at most PIECE at a time."""
    cps = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    cps = np.where(letters()[cps], cps, np.uint32(32))
    pad = np.full(max(ORDERS) - 1, 32, dtype=np.uint32)
    cps = np.concatenate([cps, pad])
    n = len(cps) - len(pad)
    for at in range(0, n, PIECE):
        yield cps[at:at + PIECE + len(pad)], min(PIECE, n - at)


def gram_buckets(cps, starts):
    """Bucket of every n-gram of each order that starts in the first `starts` places and holds a letter."""
    out = []
    with np.errstate(over="ignore"):
        for order in ORDERS:
            h = np.full(starts, order, dtype=np.uint32)
            blank = np.ones(starts, dtype=bool)
            for k in range(order):
                part = cps[k:k + starts]
                h = (h ^ part) * _MULTIPLIERS[k]
                h ^= h >> np.uint32(15)
                blank &= part == 32
            out.append(np.where(blank, np.uint32(BUCKETS), h >> np.uint32(16)))
    return out


def _count(langs):
    def run(frames):
        at = {v: i for i, v in enumerate(langs)}
        counts = np.zeros((len(langs), BUCKETS + 1), dtype="int64")
        for df in frames:
            for text, lang in zip(df["text"], df["lang"]):
                for cps, starts in pieces(text):
                    for buckets in gram_buckets(cps, starts):
                        counts[at[lang]] += np.bincount(buckets, minlength=BUCKETS + 1)
        rows, cols = np.nonzero(counts[:, :BUCKETS])
        yield pd.DataFrame({"lang": rows.astype("int32"), "bucket": cols.astype("int32"), "n": counts[rows, cols]})
    return run


def train(docs, id_col="doc_id", text_col="text", lang_col="lang", per_language=DOCS_PER_LANGUAGE):
    """(languages, log priors, log-probability matrix) from the rows outside the held-out fold.

    A language with more than `per_language` rows is represented by a hash sample of about that
    many; rows without a text or a language teach nothing. No row to learn from gives no language.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang")).where(
        ~held_out(F.col("id")) & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros(0), np.zeros((0, BUCKETS + 1), dtype="float32")
    part = F.create_map(*(x for v in langs for x in (F.lit(v), F.lit(min(1.0, per_language / sizes[v])))))
    sample = rows.where((F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.element_at(part, F.col("lang")) * (1 << 20)) & F.col("text").isNotNull())
    got = text_batches(sample.select("text", "lang")).mapInPandas(_count(langs), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(langs), BUCKETS))
    counts[got["lang"], got["bucket"]] = got["n"]
    logp = np.log(counts + SMOOTHING) - np.log(counts.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)
    matrix = np.zeros((len(langs), BUCKETS + 1), dtype="float32")    # the last column, for blanks, adds nothing
    matrix[:, :BUCKETS] = logp
    total = sum(sizes.values())
    return langs, np.array([math.log(sizes[v] / total) for v in langs]), matrix


def classify(texts, langs, priors, matrix):
    """(language, score) lists for a batch of texts."""
    owner, arrays, counts = [], [], []
    sums = np.zeros((len(texts), len(langs)))
    grams = np.zeros(len(texts))

    def flush():
        if not arrays:
            return
        flat = np.concatenate(arrays)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        for k in range(len(langs)):
            np.add.at(sums[:, k], owner, np.add.reduceat(matrix[k].take(flat), starts, dtype="float64"))
        np.add.at(grams, owner, np.add.reduceat((flat < BUCKETS).astype("int64"), starts))
        owner.clear(), arrays.clear(), counts.clear()

    held = 0
    for i, text in enumerate(texts):
        for cps, starts in pieces(text or ""):
            for buckets in gram_buckets(cps, starts):
                owner.append(i), arrays.append(buckets), counts.append(len(buckets))
                held += len(buckets)
        if held > PIECE:
            flush()
            held = 0
    flush()
    if not langs:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    z = priors + sums * np.minimum(1.0, EVIDENCE / np.maximum(grams, 1))[:, None]
    best = (sums + priors).argmax(axis=1)
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    known = grams > 0
    return [langs[b] if ok else UNKNOWN for b, ok in zip(best, known)], [float(p[i, b]) if known[i] else 0.0 for i, b in enumerate(best)]


def identify(docs, model, text_col="text", lang_out="lang_pred", score_out="lang_score"):
    """docs with the predicted language and its posterior, from 0 to 1.

    A text that is null or has no letter gets "und" and score 0. The posterior counts at most
    EVIDENCE n-grams as independent, so that it stays informative on long texts. Columns of docs
    that have an output's name are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        lang, score = classify(texts.tolist(), *shared.value)
        return pd.DataFrame({"lang": lang, "score": score})

    out = "__language"
    marked = text_batches(docs).withColumn(out, predict(docs[text_col].cast("string")))
    return marked.withColumn(lang_out, F.col(f"{out}.lang")).withColumn(score_out, F.col(f"{out}.score")).drop(out)
