import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality as Q

GOOD = "The river runs past the old mill and the meadow beyond it."
BAD = "Buy$$$ now!!! now!!! now!!! now!!! ||| ### 99999"


def corpus(n=240):
    """Documents of good lines, of bad lines, and bad ones that open with a good line."""
    rng = np.random.default_rng(5)
    words = "river mill meadow stone bridge evening light garden house window letter morning".split()
    docs, labels = [], []
    for i in range(n):
        fine = [" ".join(rng.choice(words, 9)).capitalize() + "." for _ in range(rng.integers(1, 8))]
        poor = [" ".join(w + "$$$" for w in rng.choice(words, 6)) + "!!!" for _ in range(rng.integers(3, 8))]
        good = i % 3 != 0
        text = "\n".join(fine if good else (fine[:1] if i % 2 else []) + poor)
        docs.append((i, text, "en", "a", len(text)))
        labels.append((i, int(good), 0))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    from .conftest import DOCS

    docs, labels = corpus()
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def model(tables):
    return Q.train(*tables)


def test_held_out_documents_are_told_apart(tables, model):
    docs, labels = tables
    got = Q.score(docs, model).join(labels, "doc_id").collect()
    unseen = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(unseen) > 40
    assert np.mean([(r.score >= 0.5) == (r.quality == 1) for r in unseen]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_labels_of_the_held_out_fold_do_not_matter(tables, model):
    docs, labels = tables
    fold = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    other = Q.train(docs, labels.withColumn("quality", F.when(fold, 1 - F.col("quality")).otherwise(F.col("quality"))))
    assert np.array_equal(other[2], model[2]) and np.array_equal(other[3], model[3])


def test_messages_equal_a_sum_over_all_labellings():
    rng = np.random.default_rng(1)
    doc = np.array([0, 0, 0, 0, 1, 2, 2, 2])
    e, good, bad = rng.normal(size=8), 0.7, -0.3
    chains = Q.Chains(doc)
    fore, back = chains.messages(e, good, bad)
    for s, n in zip(chains.starts, chains.lens):
        weight = np.zeros((n, 2))
        for code in range(1 << n):
            y = [(code >> j) & 1 for j in range(n)]
            links = sum(good if a and b else bad if not a and not b else 0 for a, b in zip(y, y[1:]))
            w = np.exp(sum(x * v for x, v in zip(e[s:s + n], y)) + links)
            for j in range(n):
                weight[j, y[j]] += w
        assert np.allclose(fore[s:s + n] + back[s:s + n], np.log(weight[:, 1] / weight[:, 0]))


def test_gradient_equals_differences():
    rng = np.random.default_rng(2)
    doc = np.array([0, 0, 0, 1, 1, 2])
    x, y, w = rng.normal(size=(6, 5)), np.array([1.0, 0, 0, 1, 1, 0]), rng.normal(size=7)
    chains = Q.Chains(doc)
    _, slope = chains.loss(x, y, w)
    for j in range(7):
        step = np.zeros(7)
        step[j] = 1e-5
        assert abs((chains.loss(x, y, w + step)[0] - chains.loss(x, y, w - step)[0]) / 2e-5 - slope[j]) < 1e-6


def test_neighbours_reach_a_line():
    own = np.arange(4 * Q.MEASURES).reshape(4, Q.MEASURES) / 100
    x = Q.evidence(own, np.array([0, 0, 0, 1]), np.zeros(Q.MEASURES), np.ones(Q.MEASURES))
    m = Q.MEASURES
    assert np.array_equal(x[:, 1], [1, 0, 0, 1]) and np.array_equal(x[:, 2], [0, 0, 1, 1])
    assert np.array_equal(x[1, 3 + m:3 + 2 * m], own[0]) and np.array_equal(x[1, 3 + 2 * m:], own[2])
    assert not x[0, 3 + m:3 + 2 * m].any() and not x[2, 3 + 2 * m:].any() and not x[3, 3 + m:].any()
    fore, back = Q.Chains(np.zeros(3, dtype=int)).messages(np.array([-4.0, 0.5, -4.0]), 2.0, 2.0)
    assert fore[1] + back[1] < 0                              # the transitions carry the bad lines into the one between


def slow_sums(line):
    words = line.encode().split()
    kinds = np.bincount(Q._CLASS[list(line.encode())], minlength=9)
    return [*kinds, len(words), sum(a == b for a, b in zip(words, words[1:])), len(set(words)), sum(len(w) == 1 for w in words)]


def test_sums_equal_a_plain_count():
    texts = [GOOD + "\n\n" + BAD + "\n" + GOOD, None, "", " \n\t\n", "é!! é!! ü", "x"]
    sums, doc, seen = Q.line_sums(texts)
    lines = [GOOD, BAD, GOOD, "é!! é!! ü", "x"]
    assert doc.tolist() == [0, 0, 0, 4, 5] and seen.tolist() == [False, False, True, False, False]
    for got, line in zip(sums, lines):
        assert [*got[:9], got[11], got[12], got[13], got[16]] == slow_sums(line)


def test_a_line_longer_than_a_piece_is_read_whole(monkeypatch):
    texts = ["alpha beta, gamma " * 40 + "\nshort line\n" + "delta epsilon! " * 30]
    whole = Q.line_sums(texts)[0]
    monkeypatch.setattr(Q, "PIECE", 64)
    cut = Q.line_sums(texts)[0]
    assert np.array_equal(cut[:, :9], whole[:, :9]) and np.array_equal(cut[:, 17:], whole[:, 17:])


def test_awkward_rows(spark, awkward, nothing, clashing, model):
    got = Q.score(awkward, model).collect()
    assert len(got) == awkward.count() and all(0 <= r.score <= 1 for r in got)
    empty = {r.score for r in got if not (r.text or "").strip()}
    assert len(empty) == 1 and empty.pop() < 0.5
    assert len({r.score for r in got if r.doc_id == 1}) == 1
    assert Q.score(nothing, model).count() == 0
    replaced = Q.score(clashing, model)
    assert replaced.columns == clashing.columns and replaced.schema["score"].dataType.simpleString() == "double"


def test_labels_that_teach_nothing(spark, tables, nothing):
    docs, labels = tables
    none = Q.train(docs, labels.limit(0))
    assert Q.qualities(["a", None], none).tolist() == [0.5, 0.5]
    assert Q.train(nothing, labels)[3] == 0.5
    one = Q.train(docs, labels.withColumn("quality", F.lit(1)))
    assert one[2] is None and one[3] > 0.9
    messy = labels.unionByName(spark.createDataFrame([(None, 1, 0), (3, None, 0), (99_999, 1, 0), (7, 1, 0)], labels.schema)).withColumn("text", F.lit("clash"))
    assert Q.train(docs, messy)[2] is not None
