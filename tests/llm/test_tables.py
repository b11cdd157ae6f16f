"""Mixing, sharding, packing, neighbours, archives and the pipeline against brute force."""

import base64
import gzip
import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import mixing, neighbours, packing, sharding, warc
from tidemark.llm.queries import tokenizer_definition
from tidemark.session import shared_dir

from .conftest import AWKWARD, DOCS

# -- mixing


def slow_targets(sizes, weights=(5, 2, 1), most=3):
    """Targets by repeated resharing: {source: words}."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        if not free:
            return fixed
        rest = total - sum(fixed.values())
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}


def test_mix_meets_its_targets(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "w " * int(rng.integers(0, 50)), None, s, None) for i, s in enumerate(rng.choice(["a", "b", "c", "d", "é"], 400, p=[0.02, 0.6, 0.3, 0.03, 0.05]))]
    rows += [(1000 + i, "tiny words", None, None, None) for i in range(3)]
    got = mixing.curriculum(mixing.mix(spark.createDataFrame(rows, DOCS))).collect()
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(r[1].split())
    want = slow_targets(sizes)
    assert len(got) == len(rows)
    for s in sizes:
        mine = [r for r in got if r["source"] == s]
        assert math.isclose(mine[0]["target"], want[s], rel_tol=1e-9) and mine[0]["source_size"] == sizes[s]
        assert sum(r["taken"] for r in mine) == math.floor(mine[0]["target"])
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    places = [r["position"] for r in got if r["position"] is not None]
    assert places == sorted(places) and 0 <= places[0] and places[-1] <= 1
    again = mixing.mix(spark.createDataFrame(rows[::-1], DOCS).repartition(3)).collect()
    assert sorted((r["id"], r["taken"], r["position"]) for r in again) == sorted((r["id"], r["taken"], r["position"]) for r in got)


def test_position_inverts_the_cumulative_demand(spark):
    shapes = [[1.5, 1.0, 0.5], [1.0, 1.0], [0.5, 2.0, 0.0, 1.0]]
    rows = [(k, sh, q / 20) for k, sh in enumerate(shapes) for q in range(21)]
    d = spark.createDataFrame(rows, "k int, shape array<double>, share double")
    for r in d.withColumn("u", mixing.position(F.col("share"), F.col("shape"))).collect():
        knots = np.linspace(0, 1, len(r["shape"]))
        fine = np.linspace(0, 1, 60_001)
        w = np.interp(fine, knots, r["shape"])
        cum = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
        assert abs(np.interp(r["u"], fine, cum / cum[-1]) - r["share"]) < 1e-4


def test_mix_of_awkward_rows(awkward, clashing, nothing):
    for table in (awkward, clashing):
        got = mixing.mix(table).collect()
        assert len(got) == len(AWKWARD)
        assert all(r["taken"] == 0 and r["position"] is None for r in got if r["size"] == 0)
    assert mixing.mix(nothing).count() == 0
    blank = mixing.mix(awkward.where("doc_id IN (2, 3, 4)")).collect()
    assert [r["target"] for r in blank] == [0.0] * 3


# -- sharding

def test_shards_are_balanced_and_slots_gapless(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "x" * int(rng.integers(1, 400)) + str(i % 900), None, None, None) for i in range(2000)]
    rows += [(5000 + i, "one-text-that-very-many-rows-share", None, None, None) for i in range(1000)]     # a third of all rows
    got = sharding.assign_shards(spark.createDataFrame(rows, DOCS), 8).toPandas()
    per = got.groupby("shard")
    assert len(per) == 8 and (per["slot"].max() + 1 == per.size()).all() and (per["slot"].nunique() == per.size()).all()
    assert per["size"].sum().max() < 1.03 * per["size"].sum().mean() and per["size"].sum().min() > 0.97 * per["size"].sum().mean()
    even = sharding.assign_shards(spark.createDataFrame(rows[:2000], DOCS), 8).toPandas().groupby("shard")
    assert even["size"].sum().max() < 1.02 * even["size"].sum().mean() and even.size().max() < 1.1 * even.size().mean()
    assert got["size"].sum() == sum(len(r[1].encode()) + 1 for r in rows)
    text = got.merge(__import__("pandas").DataFrame([(r[0], r[1]) for r in rows], columns=["id", "text"]))
    shards = text.groupby("text")["shard"].nunique()
    assert (shards.drop("one-text-that-very-many-rows-share") == 1).all() and 2 <= shards["one-text-that-very-many-rows-share"] <= 4


def test_shards_of_awkward_rows(awkward, clashing, nothing):
    for table in (awkward, clashing):
        got = sharding.assign_shards(table, 4).collect()
        assert sorted((r["id"], r["size"], r["text_crc32"]) for r in got if r["id"] is not None) == sorted(
            (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in AWKWARD if d is not None)
        for s in {r["shard"] for r in got}:
            slots = sorted(r["slot"] for r in got if r["shard"] == s)
            assert slots == list(range(len(slots)))
    assert sharding.assign_shards(nothing).count() == 0


# -- packing

def check_packing(pieces, capacity):
    spans = {}
    for r in pieces:
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in spans.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return len(spans)


def test_tokens_and_pieces_are_exact(spark, awkward, clashing):
    tok = Tokenizer.from_str(tokenizer_definition())
    extra = "İstanbul ΣΑΣ naïve I'll don't ... a.b. x,, 12ab ﬁ ǅ ŉ \x1c gap \x1fx 日本語 テスト。 ok."
    docs = awkward.union(spark.createDataFrame([(77, extra, None, None, None)], DOCS))
    rows = packing.tokenize(docs, tokenizer_definition(), with_ids=True).collect()
    want = []
    for d, t, *_ in [*AWKWARD, (77, extra)]:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(d, i // 4096, i, ids[i:i + 4096]) for i in range(0, len(ids), 4096)]
    assert sorted(((r["doc"], r["piece"], r["start"], r["ids"]) for r in rows), key=repr) == sorted(want, key=repr)
    assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in rows)
    placed = packing.pack(packing.tokenize(clashing, tokenizer_definition())).collect()
    assert check_packing(placed, 4096) == math.ceil(sum(r["length"] for r in placed) / 4096)


@pytest.mark.parametrize("seed", range(4))
def test_plans_place_every_length_once(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(4096, np.exp(rng.normal(6 + seed / 3, 1.2, 3000)).astype(int) + 1)
    histogram = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True))}
    runs, n = packing.plan(histogram)
    got = {}
    fill = np.zeros(n, dtype=np.int64)
    for length, offset, first, count in runs.tolist():
        got[length] = got.get(length, 0) + count
        fill[first:first + count] += length
    assert got == histogram and fill.max() <= 4096
    assert n <= 1.02 * math.ceil(lengths.sum() / 4096) + 1
    assert packing.plan({}) [1] == 0


def test_nnls_finds_a_solution_with_all_counts():
    kinds = packing.patterns(8)
    slots = np.array([(*p, *[0] * (3 - len(p))) for p in kinds])
    x = np.random.default_rng(0).random(len(kinds)) * 10
    b = np.bincount(slots.ravel(), np.repeat(x, 3), minlength=9)
    b[0] = 0
    fit = packing.nnls(slots, b, 3000)
    back = np.bincount(slots.ravel(), np.repeat(fit, 3), minlength=9)
    assert (fit >= 0).all() and np.abs(back[1:] - b[1:]).max() < 1e-2


def test_sequences_hold_the_tokens(spark, awkward, nothing):
    docs = awkward.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    pieces = packing.tokenize(docs, tokenizer_definition(), capacity=16, with_ids=True)
    placed = packing.pack(pieces.drop("ids"), capacity=16, steps=16)
    ids = {r["sequence_id"]: r["ids"] for r in packing.sequences(placed, pieces).collect()}
    by_piece = {(r["doc"], r["piece"]): r["ids"] for r in pieces.collect()}
    for r in placed.collect():
        assert ids[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]] == by_piece[r["doc"], r["piece"]]
    assert packing.pack(packing.tokenize(nothing, tokenizer_definition())).count() == 0


# -- neighbours

def slow_nearest(rows, k):
    out = {}
    valid = [(i, np.array(e, dtype=float)) for i, e in rows if i is not None and e and len(e) == 8 and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    for i, e in valid:
        if i % 5 == 0:
            scores = {}
            for j, f in valid:
                if j != i:
                    scores[j] = float((e * f).sum())
            out[i] = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def test_neighbours_find_most_and_break_ties_by_id(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(8) * rng.choice([0.5, 1, 2])]) for i in range(600)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)]         # a vector that a third of the rows share
    rows += [(2000, None), (2005, [0.0] * 8), (2010, [float("nan")] * 8), (2015, [1.0] * 7), (2020, [None] * 8), (None, [1.0] * 8)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("u", F.lit("clash"))
    got = {}
    for r in neighbours.nearest(d, F.col("vec_id") % 5 == 0, k=10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    want = slow_nearest(rows, 10)
    assert set(got) == set(want)
    hits = total = 0
    for q, expected in want.items():
        mine = sorted(got[q])
        assert [x[0] for x in mine] == list(range(1, len(expected) + 1))
        assert all((-a[2], a[1]) < (-b[2], b[1]) for a, b in zip(mine, mine[1:]))
        total, hits = total + len(expected), hits + len({x[1] for x in mine} & {x[0] for x in expected})
    assert hits >= 0.9 * total
    assert [x[1] for x in sorted(got[1000])] == [x[0] for x in want[1000]]


def test_neighbours_of_few_and_of_no_rows(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = neighbours.nearest(few, F.col("vec_id") == 0, k=20).collect()
    assert sorted((r["rank"], r["id"]) for r in got) == [(1, 2), (2, 1)]
    assert neighbours.nearest(few.where("vec_id > 9"), F.lit(True)).count() == 0


def test_search_stops_early_yet_finds_neighbours():
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((20, 32)) * 4
    x = centres[rng.integers(0, 20, 4000)] + rng.standard_normal((4000, 32)) * 0.3
    q = x[:50] + 0.01
    largest = max(np.einsum("ij,ij->i", x, x).max(), np.einsum("ij,ij->i", q, q).max())
    m = neighbours.projection(32)
    _, rows = neighbours.search(x, neighbours.project(x, largest, m), q, neighbours.project(q, largest, m), np.full(50, np.inf), largest, 10)
    true = np.argsort(-(q @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(rows.tolist(), true.tolist())]) >= 9
    assert abs(float(neighbours.chi_square_cdf(15.507)) - 0.95) < 1e-3


# -- archives

def test_archives_round_trip(spark):
    rows = [(1, "http://a/", "same"), (2, "http://b/", "same"), (9, "http://c/", "same"), (3, None, None), (4, "http://d/\r\nX: y", ""), (5, "u", "é𝒳" * 40_000),
            (5, "u", "é𝒳" * 40_000), (6, "u", "WARC/1.1\r\n\r\n0\r\n\r\n"), (None, "u", "only"), (None, "u", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash")).withColumn("first", F.lit("clash"))
    path = f"{shared_dir(spark)}/warc-test-{np.random.default_rng().integers(1 << 60)}"
    warc.write_archives(pages, path, segment_chars=1000, chunk_chars=300)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(rows) and all(r["status"] == "ok" for r in got)
    page = lambda r: r["record_id"][len("<urn:page:"):].split(":")[0]
    kinds = sorted((page(r), r["type"]) for r in got)
    assert kinds == sorted([("1", "revisit"), ("2", "revisit"), ("9", "response"), ("3", "revisit"), ("4", "response"), ("5", "response"), ("5", "response"), ("6", "response"), ("none", "response"), ("none", "revisit")])
    for r in got:
        if r["type"] == "response":
            text = {p: h for p, _, h in rows}.get(int(page(r)) if page(r) != "none" else -1, "only") or ""
            assert bytes(r["payload"]) == text.encode()
            assert r["digest"] == "sha1:" + base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()
    revisits = [r["refers_to"] for r in got if r["type"] == "revisit"]
    assert set(revisits) <= {r["record_id"] for r in got if r["type"] == "response"} and {r.split(":")[2] for r in revisits} == {"9", "4"}
    again = f"{path}-again"
    warc.write_archives(pages.repartition(3), again, segment_chars=1000, chunk_chars=300)
    ids = lambda found: {r["record_id"] for r in found if "#" not in r["record_id"]}
    assert ids(warc.read_archives(spark, again).collect()) == ids(got) and len(ids(got)) == 8


def test_archives_of_one_member_per_record(spark, tmp_path):
    records = [warc._record("response", f"<r{k}>", warc.HTTP_HEAD + warc.chunked(f"text {k} " * 9000, 500), []).encode() + b"\r\n\r\n" for k in range(6)]
    (tmp_path / "many.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    got = {r["record_id"]: bytes(r["payload"]).decode() for r in warc.read_archives(spark, f"file://{tmp_path}").collect()}
    assert got == {f"<r{k}>": f"text {k} " * 9000 for k in range(6)}


def test_damage_costs_only_its_own_record(spark, tmp_path):
    one = lambda k: warc._record("response", f"<r{k}>", warc.HTTP_HEAD + warc.chunked("abc" * 50, 20), []).encode() + b"\r\n\r\n"
    bad = [one(1).replace(b"WARC/1.1", b"WARK/1.1"), one(1).replace(b"Content-Length: ", b"Content-Length: 9"), one(1).replace(b"Content-Length", b"Content-Girth"), b"\xff\xfe junk"]
    for k, damage in enumerate(bad):
        folder = tmp_path / f"d{k}"
        folder.mkdir()
        (folder / "x.warc.gz").write_bytes(gzip.compress(one(0) + damage + one(2)))
        got = warc.read_archives(spark, f"file://{folder}").collect()
        assert sorted((r["record_id"] or "", r["status"]) for r in got) == [("", "damaged"), ("<r0>", "ok"), ("<r2>", "ok")]
    parts = [bytearray(gzip.compress(one(k))) for k in range(3)]
    parts[1][20:60] = b"\x00" * 40
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "x.warc.gz").write_bytes(b"".join(parts) + gzip.compress(one(3))[:-20])
    got = warc.read_archives(spark, f"file://{tmp_path}/cut").collect()
    assert {r["record_id"] for r in got if r["status"] == "ok"} >= {"<r0>", "<r2>"} and any(r["status"] == "damaged" for r in got)


def _archive(tmp_path, records):
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(b"".join(r.encode() + b"\r\n\r\n" for r in records)))
    return f"file://{tmp_path}"


def test_damaged_segments_are_told(spark, tmp_path):
    body = warc.HTTP_HEAD + warc.chunked("abcdefghij" * 20, 7)
    parts = [body[:100], body[100:200], body[200:]]

    def records(name, numbers, total):
        first = warc._record("response", f"<{name}>", parts[0], [("WARC-Segment-Number", 1)])
        return [warc._record("continuation", f"<{name}.{n}>", parts[n - 1], [("WARC-Segment-Origin-ID", f"<{name}>"), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", total if n == 3 else None)])
                for n in reversed(numbers)] + [first]
    every = records("good", [2, 3], len(body)) + records("gap", [3], len(body)) + records("short", [2, 3], len(body) + 1) + [warc._record("response", "<bad>", warc.HTTP_HEAD + "zz\r\n", [])]
    got = {r["record_id"]: r for r in warc.read_archives(spark, _archive(tmp_path, every)).collect()}
    assert bytes(got["<good>"]["payload"]) == b"abcdefghij" * 20
    assert {k: r["status"] for k, r in got.items()} == {"<good>": "ok", "<gap>": "missing segment", "<short>": "length differs", "<bad>": "broken framing"}


def test_no_page_gives_no_record(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path = f"{shared_dir(spark)}/warc-test-{np.random.default_rng().integers(1 << 60)}"
    warc.write_archives(pages, path)
    assert warc.read_archives(spark, path).count() == 0


# -- pipeline

def test_pipeline_stages_on_awkward_rows(spark, awkward, nothing):
    for docs in (awkward, nothing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, None)
            if name != "packing":
                assert out.columns == docs.columns
                docs = spark.createDataFrame(out.collect(), DOCS)
            else:
                check_packing(out.collect(), 4096)


def test_pipeline_equals_a_brute_force_version(spark, tmp_path):
    from .test_documents import slow_components, slow_lines, slow_simhash

    rng = np.random.default_rng(7)
    vocab = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(80):
        text = "\n".join(["shared header line"] + [" ".join(rng.choice(vocab, 12)) for _ in range(4)])
        rows.append((i, text, "en", "s%d" % (i % 4), len(text)))
    rows += [(200 + i, rows[i][1], "en", rows[i][3], 0) for i in range(10)] + [(300, "123 ...", "en", "s0", 7), (301, None, "en", "s1", None)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()

    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    lines = {d: t for d, _, _, t in slow_lines([(r[0], r[1], r[3]) for r in rows])}
    rows = [(r[0], lines[r[0]], *r[2:]) for r in rows]
    groups = slow_components([slow_simhash(r[1]) for r in rows])
    rows = [r for i, r in enumerate(rows) if rows[groups[i]][0] == r[0]]
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(r[1].split())
    want, copies = slow_targets(sizes), {}
    for s in sizes:
        order = sorted((r for r in rows if r[3] == s), key=lambda r: hashlib.md5(f"{r[0]}:{len(r[1])}".encode()).hexdigest())
        at = 0
        for p in range(3):
            for r in order:
                if at < math.floor(want[s] + 1e-6):
                    copies[r[0]] = copies.get(r[0], 0) + 1
                at += len(r[1].split())
    tok = Tokenizer.from_str(tokenizer_definition())
    texts = {r[0]: r[1] for r in rows}
    assert sorted((r["doc_id"], r["length"]) for r in got) == sorted((d, len(tok.encode(texts[d], add_special_tokens=False).ids) + 1) for d, n in copies.items() for _ in range(n))
    assert check_packing(got, 4096) == math.ceil(sum(r["length"] for r in got) / 4096)
