"""Toxicity by weak supervision.

Many voters, each a lexicon or a pattern, vote on a bounded sample of labelled rows. A generative model
takes the true class as hidden and estimates every voter's hit and false-alarm rates by expectation
maximisation; the noisy label is one voter among them. Voters that agree beyond what
the class explains are correlated and share their weight. A linear classifier on whole-text features is then trained on
the posterior labels, and scores every document.
"""

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from ..session import stored
from .common import held_out, text_batches, worker_state

# Insults that a lexicon voter looks for, by language.
LEXICON = {
    "en": "idiot moron loser pathetic scum stupid trash clown disgusting worthless imbecile dumb jerk fool filthy vermin garbage ugly dimwit crap".split(),
    "de": "idiot trottel dummkopf abschaum versager widerlich wertlos erbärmlich blödmann depp dreckig ungeziefer".split(),
    "fr": "idiot imbécile crétin abruti ordure minable dégoûtant pathétique débile raclure sale connard".split(),
    "es": "idiota imbécil estúpido basura escoria patético asqueroso inútil tonto payaso miserable despreciable".split(),
}
PREFIXES = (4, 5, 6)      # lengths of the word beginnings that are mined as patterns
SAMPLE = 20_000           # labelled rows, about, that the models are fitted on
TERMS = 256               # mined terms at most
LEAST_DOCS = 3            # toxic rows of the sample that a mined term occurs in
LEAST_RATIO = 15.0        # log-likelihood ratio of a mined term
GROUPS = 12               # voters over the mined terms, by hash
CACHE = 300_000           # chunks whose terms a worker remembers
LETTERS = re.compile(r"[^\W\d_]+")
DENSE = 6                 # features beside the terms


def terms_of(chunk):
    """Words of a chunk of text and their beginnings, marked by a hyphen."""
    out = []
    for w in LETTERS.findall(chunk.lower()):
        out.append(w)
        out += [w[:k] + "-" for k in PREFIXES if len(w) >= k]
    return out


class Reader:
    """Features of whole texts: which of the given terms occur and how often."""

    def __init__(self, terms):
        self.at = {t: i for i, t in enumerate(terms)}
        self.lexicon = {k: set(v) for k, v in LEXICON.items()}
        self.cache = {}

    def look(self, chunk):
        found = terms_of(chunk)
        ids = tuple(sorted({self.at[t] for t in found if t in self.at}))
        langs = tuple(k for k, v in self.lexicon.items() if any(t in v for t in found))
        got = (ids, langs) if ids or langs else None
        if len(self.cache) < CACHE:
            self.cache[chunk] = got
        return got

    def read(self, text):
        """(term ids, hits by language, chunk hits, chunks, shouted chunks)."""
        chunks = text.split()
        ids, langs, hits, shout = set(), dict.fromkeys(LEXICON, 0), 0, 0
        cache, look = self.cache, self.look
        for c in set(chunks):
            got = cache[c] if c in cache else look(c)
            if got is not None:
                n = chunks.count(c)
                hits += n
                ids.update(got[0])
                for k in got[1]:
                    langs[k] += n
        return sorted(ids), [langs[k] for k in LEXICON], hits, len(chunks), text.count("!!")


def dense(hits, langs, ids, chunks, shout):
    return [1.0, float(hits > 0), np.log1p(hits), np.log1p(len(ids)), 100.0 * hits / max(chunks, 1), float(sum(langs) > 0)]


def votes(row, groups):
    """0/1 votes of all voters on a sample row (ids, langs, hits, chunks, shout)."""
    ids, langs, hits, chunks, shout = row
    by_group = np.zeros(GROUPS)
    for i in ids:
        by_group[groups[i]] = 1
    return [*(float(x > 0) for x in langs), *by_group, float(len(ids) >= 2), float(hits >= 2), float(hits >= 4),
            float(hits * 200 > chunks), float(sum(langs) >= 2), float(shout > 0 and hits > 0)]


def label_model(v, start, rounds=40):
    """Posterior of the hidden class, by expectation maximisation over 0/1 votes (rows, voters).

    start is the first guess of the posterior. Returns (posterior, hit rates, false-alarm rates, weights): weights
    are below 1 for voters that are correlated given the class.
    """
    q = np.clip(start, 0.05, 0.95)
    weight = np.ones(v.shape[1])
    for step in range(rounds):
        prior = np.clip(q.mean(), 1e-3, 0.999)
        hit = (q @ v + 0.5) / (q.sum() + 1)
        alarm = ((1 - q) @ v + 0.5) / ((1 - q).sum() + 1)
        if step % 10 == 5:
            # What the class leaves unexplained, as correlations between voters.
            r = v - q[:, None] * hit - (1 - q)[:, None] * alarm
            c = r.T @ r / len(v)
            s = np.sqrt(np.maximum(np.diag(c), 1e-9))
            shared = np.maximum(0.0, c / s[:, None] / s[None, :])
            weight = 1.0 / shared.sum(axis=1).clip(1.0)
        logit = np.log(prior / (1 - prior)) + (v * weight) @ np.log(hit / alarm) + ((1 - v) * weight) @ np.log((1 - hit) / (1 - alarm))
        q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return q, hit, alarm, weight


def fit_linear(x, q, penalty=1.0, rounds=30):
    """Weights of a logistic regression on soft labels, by Newton steps; the first feature is the constant."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - q) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def _term_counts(frames):
    for df in frames:
        pos, neg = {}, {}
        for text, toxic in zip(df["text"], df["toxic"]):
            into = pos if toxic else neg
            for t in {t for c in set(text.split()) for t in terms_of(c)}:
                into[t] = into.get(t, 0) + 1
        keys = list(pos.keys() | neg.keys())
        yield pd.DataFrame({"term": keys, "pos": [pos.get(k, 0) for k in keys], "neg": [neg.get(k, 0) for k in keys]}).astype({"pos": "int64", "neg": "int64"})


def _read_sample(terms):
    def run(frames):
        reader = Reader(terms.value)
        for df in frames:
            out = []
            for text, toxic in zip(df["text"], df["toxic"]):
                ids, langs, hits, chunks, shout = reader.read(text)
                out.append((ids, langs, hits, chunks, shout, int(toxic)))
            yield pd.DataFrame(out, columns=["ids", "langs", "hits", "chunks", "shout", "toxic"])
    return run


def train(docs, labels, id_col="doc_id", text_col="text", label_col="toxic", sample=SAMPLE):
    """(terms, weights): the mined terms and the linear classifier.

    Labels come from rows outside the held-out fold only; of these about `sample` are used, chosen by hash. Null labels and
    null texts teach nothing; an id with several labels has the largest. Without any label of either class the
    lexicon alone decides.
    """
    known = labels.select(labels[id_col].cast("long").alias("id"), labels[label_col].cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IS NOT NULL")
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    n = known.count()
    part = min(1.0, sample / max(1, n))
    chosen = stored(known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < part * (1 << 20)))
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    rows = texts.join(F.broadcast(chosen), "id").select("text", "toxic")      # about `sample` rows are broadcast
    counts = text_batches(rows).mapInPandas(_term_counts, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    classes = {r["toxic"]: r["count"] for r in chosen.groupBy("toxic").count().collect()}
    n_pos, n_neg = classes.get(1, 0), classes.get(0, 0)
    if not n_pos or not n_neg:
        return [], np.array([-4.0, 3.0, 2.0, 0.0, 0.0, 3.0])
    rate = float(n_pos) / (n_pos + n_neg)
    both = F.col("pos") + F.col("neg")
    gain = 2 * (F.col("pos") * F.log(F.col("pos") / (both * rate)) + F.when(F.col("neg") > 0, F.col("neg") * F.log(F.col("neg") / (both * (1 - rate)))).otherwise(0.0))
    mined = counts.where((F.col("pos") >= LEAST_DOCS) & (F.col("pos") > both * rate)).withColumn("gain", gain).where(F.col("gain") >= LEAST_RATIO)
    terms = [r["term"] for r in mined.orderBy(F.desc("gain"), "term").limit(TERMS).collect()]
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    seen = rows.mapInPandas(_read_sample(shared), "ids array<int>, langs array<int>, hits int, chunks int, shout int, toxic int").toPandas()
    groups = np.arange(len(terms)) % GROUPS
    read = list(zip(seen["ids"], seen["langs"], seen["hits"], seen["chunks"], seen["shout"]))
    label = seen["toxic"].to_numpy(float)
    v = np.column_stack([np.array([votes(r, groups) for r in read]), label])
    posterior, *_ = label_model(v, label)
    x = np.zeros((len(read), DENSE + len(terms)))
    for i, (ids, langs, hits, chunks, shout) in enumerate(read):
        x[i, :DENSE] = dense(hits, langs, ids, chunks, shout)
        x[i, DENSE + np.asarray(ids, dtype=int)] = 1.0
    return terms, fit_linear(x, posterior)


def score(docs, model, text_col="text", score_out="score"):
    """docs with a toxicity score from 0 to 1 for the whole text; null and empty texts are scored as texts without words.

    A column of docs named like the output is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf(DoubleType())
    def toxicity(texts: pd.Series) -> pd.Series:
        terms, w = shared.value
        reader = worker_state(("reader", tuple(terms)), lambda: Reader(terms))
        out = np.empty(len(texts))
        for i, t in enumerate(texts):
            ids, langs, hits, chunks, shout = reader.read(t or "")
            z = np.dot(w[:DENSE], dense(hits, langs, ids, chunks, shout)) + w[[DENSE + j for j in ids]].sum()
            out[i] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return pd.Series(out)

    return text_batches(docs).withColumn(score_out, toxicity(docs[text_col].cast("string")))
