"""Fingerprints, SimHash groups, line dedup, language and toxicity against brute force."""

import hashlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import fingerprints, langid, linededup, simhash, toxicity

from .conftest import AWKWARD, DOCS


def texts_of(rows):
    return [(r[0], r[1] or "") for r in rows]


# -- fingerprints

def expected_edits(rows):
    order = sorted(texts_of(rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for i, (d, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        k = len(t) // 3
        out.append((d, len(t), hashlib.sha256((t[:len(t) - k] + nxt[:k]).encode()).hexdigest()))
    return out


def test_likeness_of_a_text_of_equal_words(spark):
    """More equal windows than a 16-bit lane holds: the edit changes little and the likeness says so."""
    rows = [(k, "word " * 100_000 + f"end {k}", None, None, None) for k in range(3)]
    got = fingerprints.edits(spark.createDataFrame(rows, DOCS)).collect()
    assert all(r["near_edited"] > 0.99 and r["near_next"] > 0.99 for r in got)


def test_likeness_estimates_the_cosine_of_window_counts(spark):
    import collections
    import math
    import random

    rng = random.Random(3)
    text = lambda: " ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(3000))
    rows = [(k, text() if k % 2 else "same start " * 400 + text(), None, None, None) for k in range(8)]
    texts = {r[0]: r[1] for r in rows}

    def windows(t):
        w = t.split()
        return collections.Counter(zip(w, w[1:], w[2:]))

    for r in fingerprints.edits(spark.createDataFrame(rows, DOCS)).collect():
        a, b = windows(texts[r["id"]]), windows(texts[(r["id"] - 1) % 8])
        dot = lambda p, q: sum(n * q[k] for k, n in p.items())
        assert abs(r["near_next"] - dot(a, b) / math.sqrt(dot(a, a) * dot(b, b))) < 0.45



def test_edits_equal_brute_force(spark, clashing):
    rows = [r for r in AWKWARD if r[0] is not None] + [(10**9, "far away\nfrom the rest", "en", "a", 20), (700, "another bucket", "en", "a", 14)]
    got = fingerprints.edits(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r["id"], r["n_chars"], r["edited_sha256"]) for r in got) == sorted(expected_edits(rows))
    by_text = {}
    for r, (d, t) in zip(sorted(got, key=lambda r: r["id"]), sorted(texts_of(rows))):
        by_text.setdefault(t.strip(), set()).add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(v) == 1 for v in by_text.values())
    assert fingerprints.edits(clashing).count() == len(AWKWARD)


def test_edits_of_an_empty_table_and_of_one_row(spark, nothing):
    assert fingerprints.edits(nothing).count() == 0
    one = fingerprints.edits(spark.createDataFrame([(3, "abcdef", None, None, 6)], DOCS)).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and one["near_next"] == 1.0


def test_paragraphs_add_up_in_any_order(spark):
    d = spark.createDataFrame([("ab", "one two three\nfour five"), ("ba", "four five\n\none two three"), ("a", "one two three"), ("b", "four five"), ("z", "")], "k string, text string")
    got = {r["k"]: r for r in fingerprints.lanes(d, "k").collect()}
    assert got["ab"][1:] == got["ba"][1:] != got["a"][1:]
    pairs = spark.createDataFrame([(got["a"]["identity"], got["b"]["identity"], got["ab"]["identity"], got["a"]["likeness"], got["b"]["likeness"], got["ab"]["likeness"])],
                                  "a array<long>, b array<long>, ab array<long>, c array<long>, d array<long>, cd array<long>")
    r = pairs.select(fingerprints.added("a", "b", 32).alias("sum"), fingerprints.removed("ab", "b", 32).alias("rest"),
                     fingerprints.added("c", "d", 32).alias("likeness_sum"), fingerprints.removed("cd", "d", 32).alias("likeness_rest")).first()
    assert r["sum"] == got["ab"]["identity"] and r["rest"] == got["a"]["identity"]
    assert r["likeness_sum"] == got["ab"]["likeness"] and r["likeness_rest"] == got["a"]["likeness"]
    assert set(got["z"]["identity"]) == {0} and set(got["z"]["likeness"]) == {0}


# -- SimHash

def slow_simhash(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    v = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    return v - (1 << 64) if v >> 63 else v


def slow_components(prints, radius=3):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(prints)):
        for j in range(i):
            if ((prints[i] ^ prints[j]) & (1 << 64) - 1).bit_count() <= radius:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def test_simhash_groups_equal_brute_force(spark, awkward, clashing, nothing):
    rows = [(r[0], r[1]) for r in AWKWARD]
    prints = [slow_simhash(t) for _, t in rows]
    comp = slow_components(prints)
    least = {c: min((d for (d, _), k in zip(rows, comp) if k == c and d is not None), default=None) for c in comp}
    want = sorted(((d, p, least[c]) for (d, _), p, c in zip(rows, prints, comp)), key=repr)
    for table in (awkward, clashing):
        got = [tuple(r) for r in simhash.near_duplicates(table).select("id", "fp", "component").collect()]
        assert sorted(got, key=repr) == want
    assert simhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("chunk", [8192, 8])
def test_links_of_a_dense_key_and_of_chains(spark, chunk):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 2**63, 40)]
    prints = set(base)
    for b in base[:4]:                                   # many fingerprints under one key
        prints |= {b ^ (1 << i) ^ (1 << j) for i in range(0, 12) for j in range(i, 12)}
    chain = base[5]
    for i in range(20):                                  # a chain of links, none of them direct
        chain ^= 0b111 << (3 * i)
        prints.add(chain)
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    edges = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), chunk=chunk)
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    want = slow_components(prints)
    assert [got.get(p, p) for p in prints] == [prints[c] for c in want]


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(2)
    values = rng.integers(0, 2**64, 500, dtype=np.uint64)
    q = int(values[7])
    values[100:150] = [q ^ int(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False))) for _ in range(50)]
    hits = simhash.near(q, simhash.bit_planes(values), radius)
    assert sorted(h for h in hits if h < 500) == [i for i, v in enumerate(values.tolist()) if (v ^ q).bit_count() <= radius]


def test_one_document_of_each_group_stays(spark, awkward):
    kept = [tuple(r) for r in simhash.keep_one(awkward).collect()]
    assert sorted((r[0] for r in kept), key=lambda x: (x is None, x)) == [-9, 1, 2, 5, 6, 7, None]
    assert set(kept) <= set(AWKWARD)


# -- line dedup

def slow_lines(rows, ratio=0.05, least=3, lost=0.5):
    bare = lambda x: x.strip(" \t\r\n\f\x0b")
    out = []
    for d, text, host in rows:
        pages = {t or "" for _, t, h in rows if h == host}
        if text is None:
            out.append((d, 0, 0, None))
            continue
        lines = text.split("\n")
        drop = [bool(bare(x)) and (n := sum(bare(x) in {bare(y) for y in p.split("\n")} for p in pages)) >= least and n > len(pages) * ratio for x in lines]
        gone = sum(len(bare(x)) for x, k in zip(lines, drop) if k)
        if not any(drop) or gone > lost * sum(len(bare(x)) for x in lines):
            out.append((d, len(lines), 0, text))
        else:
            out.append((d, len(lines), sum(drop), "\n".join(x for x, k in zip(lines, drop) if not k)))
    return out


def test_line_dedup_equals_brute_force(spark, clashing, nothing):
    rows = [(i, f"Header  \nunique content number {i} of this page\n{'shared body' if i % 2 else 'x'}\n\nfooter", "s%d" % (i % 3) if i % 7 else None) for i in range(60)]
    rows += [(100 + i, "Header\nfooter", "s1") for i in range(5)] + [(200, None, "s1"), (201, "", "s1"), (202, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lines", F.lit("clash"))
    got = linededup.drop_boilerplate(d).select("doc_id", "lines", "lines_dropped", "text").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(slow_lines(rows), key=repr)
    assert linededup.drop_boilerplate(nothing).count() == 0 and linededup.drop_boilerplate(clashing).count() == len(AWKWARD)


# -- language

SAMPLES = {"en": "the quick brown fox jumps over the lazy dog and runs through the forest with its friends",
           "fr": "le renard brun rapide saute par-dessus le chien paresseux et court dans la forêt avec ses amis",
           "de": "der schnelle braune fuchs springt über den faulen hund und läuft mit seinen freunden durch den wald"}


def test_language_is_learnt_and_told_apart(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.permutation(SAMPLES[k].split())[:8]), k, None, None) for i, k in enumerate(list(SAMPLES) * 60)]
    docs = spark.createDataFrame(rows, DOCS)
    model = langid.train(docs)
    got = langid.identify(docs, model).collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.98
    assert all(0 <= r["lang_score"] <= 1 for r in got)


def test_language_of_awkward_rows(awkward, clashing, nothing):
    got = langid.identify(awkward, langid.train(awkward)).collect()
    for r in got:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
    assert langid.identify(clashing, langid.train(clashing)).select("lang_pred").count() == len(AWKWARD)
    assert langid.train(nothing)[0] == [] and langid.identify(awkward, langid.train(nothing)).where("lang_pred <> 'und'").count() == 0


def test_a_long_text_is_hashed_in_pieces_without_loss(monkeypatch):
    text = "häuser und straßen 1 2 3 bäume " * 50
    whole = np.sort(np.concatenate([b for cps, n in langid.pieces(text) for b in langid.gram_buckets(cps, n)]))
    monkeypatch.setattr(langid, "PIECE", 37)
    parts = np.sort(np.concatenate([b for cps, n in langid.pieces(text) for b in langid.gram_buckets(cps, n)]))
    assert (whole == parts).all()


# -- toxicity

def test_toxicity_is_learnt_from_lexicon_and_stems(spark):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(400):
        words = [f"w{k}" for k in rng.integers(0, 300, 40)]
        bad = i % 8 == 0
        if bad:
            words[5:8] = ["idiot", "scum", "moron"] if i % 16 else [f"zorkel{k}" for k in rng.integers(0, 9999, 3)]
        rows.append((i, " ".join(words), None, None, None))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, DOCS)
    model = toxicity.train(docs, spark.createDataFrame(labels + [(None, 1), (5000, None)], "doc_id long, toxic int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, y in labels)


def test_toxicity_of_awkward_rows(spark, awkward, clashing, nothing):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(awkward, none)
    assert all(r["score"] < 0.5 for r in toxicity.score(clashing, model).collect())
    assert toxicity.score(spark.createDataFrame([(1, "you pathetic idiot", None, None, 3)], DOCS), model).first()["score"] >= 0.5
    assert toxicity.score(nothing, toxicity.train(nothing, none)).count() == 0


def test_label_model_finds_the_accurate_voters():
    rng = np.random.default_rng(4)
    y = rng.random(4000) < 0.2
    rates = [(0.9, 0.02), (0.8, 0.05), (0.7, 0.01), (0.3, 0.3)]
    v = np.column_stack([np.where(y, rng.random(4000) < h, rng.random(4000) < a) for h, a in rates]).astype(float)
    q, hit, alarm, weight = toxicity.label_model(np.column_stack([v, v[:, 1]]), v[:, 0])
    assert ((q > 0.5) == y).mean() > 0.95
    assert abs(hit[0] - 0.9) < 0.05 and abs(alarm[3] - 0.3) < 0.05
    assert weight[1] < 0.75 * weight[0]                  # a voter and its copy share their weight
