import re
from collections import Counter, defaultdict

import pytest

from tidemark.llm import divergence as D

from .conftest import DOCS


def brute(rows, least, top):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [((lang or ""), (source or ""), re.findall("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+", (text or "").translate(low))) for _, text, lang, source, _ in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = {t for t, n in df.items() if n >= least}
        by = defaultdict(Counter)
        for _, source, terms in mine:
            by[source].update(t for t in terms if t in kept)
        whole = sum(by.values(), Counter())
        p = lambda c, t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))
        for a in by:
            pairs = sorted(((sum(abs(p(by[a], t) - p(by[b], t)) for t in kept), b) for b in by if b != a), key=lambda x: (-x[0], x[1].encode()))
            out |= {(lang, a, "pair", b, v, i + 1) for i, (v, b) in enumerate(pairs)}
            terms = sorted(((p(by[a], t) - p(whole, t), t) for t in by[a] if p(by[a], t) > p(whole, t)), key=lambda x: (-x[0], x[1].encode()))
            out |= {(lang, a, "term", t, v, i + 1) for i, (v, t) in enumerate(terms[:top])}
    return out


ROWS = [(i, " ".join([["Sun", "moon", "étoile", "𝒳x"][i % 4]] * (1 + i % 3) + ["the", "THE", "x_y", "日本"][:1 + i % 4]), ["en", "fr", None][i % 3], ["a", "b", "c", None, ""][i % 5], 5) for i in range(90)]
ROWS += [(1000, "rare words only", "de", "a", 1), (1001, None, "de", "b", 1), (1002, "", "de", None, 1), (1003, "the " * 3000, "en", "only", 1), (1003, "the " * 3000, "en", "only", 1), (1004, "123 ---", "en", "mute", 1)]


@pytest.mark.parametrize("least,top", [(1, 2), (4, 50), (8, 3)])
def test_equals_a_brute_force_version(spark, least, top):
    got = [tuple(r) for r in D.audit(spark.createDataFrame(ROWS, DOCS), least_docs=least, top=top).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(ROWS, least, top)


def test_panels_and_blocks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(D, "CELLS", 7)
    assert {tuple(r) for r in D.audit(spark.createDataFrame(ROWS, DOCS), least_docs=4).collect()} == brute(ROWS, 4, 50)


def test_counts_beyond_a_long_product(spark):
    one = spark.sql("select 20000000000L as c, 30000000000L as n, 7L as v").select(D.share(*(D.F.col(c) for c in "cnv")).alias("p")).first().p
    assert one == 1 + 10**9 * (20000000000 + 5) // (30000000000 + 35)


def test_awkward_rows(awkward, nothing, clashing):
    from .conftest import AWKWARD

    assert {tuple(r) for r in D.audit(awkward, least_docs=2).collect()} == brute(AWKWARD, 2, 50)
    assert {tuple(r) for r in D.audit(clashing, least_docs=2).collect()} == brute(AWKWARD, 2, 50)
    assert {tuple(r) for r in D.audit(awkward).collect()} == brute(AWKWARD, 30, 50)
    assert D.audit(nothing).count() == 0
