"""Packing documents into training sequences by patterns from non-negative least squares.

Spark tokenizes and cuts the documents and counts the lengths. From that histogram, at most one
entry per possible length, patterns of up to three lengths that fill a sequence are enumerated, repeat
counts are fitted to it by non-negative least squares and rounded down, and the rest is packed by
best fit into what the patterns leave and into new sequences. The outcome is a list of runs, each
giving a place to so many documents of one length; every piece finds its place by its rank.
"""

import os
import zlib
from array import array
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import stored
from .common import text_batches, worker_state

CAPACITY = 4096
END_ID = 1
STEPS = 512                # pattern lengths are multiples of CAPACITY / STEPS
PATTERN_DOCS = 3
ROWS_PER_TASK = 1_000      # pieces of one length that one ranking task aims at
CACHE = 600_000            # distinct chunks a worker keeps the ids of
SEEN = 1 << 22
MARKS = ".,"


class ChunkTokenizer:
    """Token ids of whole texts, from ids of the chunks between white space.

    The tokenizer's pre-tokenizer never joins across white space, so a text's ids are those of its chunks in
    order. A chunk of letters goes straight to the tokenizer's model, any other through
    the whole tokenizer; a single mark after letters is a token of its own. Texts with control characters that Python
    alone takes for white space go to the tokenizer whole.
    """

    def __init__(self, definition):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark runs the tasks in parallel already
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {}        # what a letter becomes for the model
        self.cache = {}
        self.seen = bytearray(SEEN)      # chunks, by hash, that have been met once

    def encode(self, text):
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode_word(self, word):
        """Ids of a run of plain letters (code points below 0x250, which normalization leaves alone)."""
        if not word.isascii():
            letters = self.letters
            for c in word:
                if c not in letters:
                    letters[c] = self.bytes.pre_tokenize_str(c)[0][0]
            word = "".join([letters[c] for c in word])
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def learn(self, chunk):
        if chunk.isalpha():
            if chunk.isascii() or (max(chunk) < "\u0250" and "\u0130" not in chunk):
                low = chunk.lower()
                return self.encode_word(low) if low == chunk else self.find(low)
        elif chunk[-1] in MARKS and len(chunk) > 1 and chunk[-2].isalpha():
            return self.find(chunk[:-1]) + self.find(chunk[-1])
        return self.encode(chunk)

    def find(self, chunk):
        got = self.cache.get(chunk)
        if got is None:
            got = self.learn(chunk)
            # Most distinct chunks never come back; the second meeting earns a place.
            at = hash(chunk) & (SEEN - 1)
            if not self.seen[at]:
                self.seen[at] = 1
            elif len(self.cache) < CACHE:
                self.cache[chunk] = got
        return got

    def ids(self, text):
        """Little-endian 32-bit ids of a text, as bytes."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self.encode(text)
        chunks = text.split()
        out = list(map(self.cache.get, chunks))
        if None in out:
            out = [self.find(c) if v is None else v for c, v in zip(chunks, out)]
        return b"".join(out)


def _tokenize(definition, capacity, end_id, with_ids):
    def run(frames):
        text = definition.value
        tok = worker_state(("tokenizer", zlib.crc32(text.encode()), len(text)), lambda: ChunkTokenizer(text))
        end = np.array([end_id], dtype="<u4").tobytes()
        for df in frames:
            out = []
            for doc, text in zip(df["doc"], df["text"]):
                ids = tok.ids(text or "") + end
                for k, s in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[s:s + 4 * capacity]
                    row = (doc, k, s // 4, len(piece) // 4, zlib.crc32(piece))
                    out.append((*row, np.frombuffer(piece, "<u4").astype("int32")) if with_ids else row)
            yield pd.DataFrame(out, columns=["doc", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]).astype({"doc": "Int64"})
    return run


def tokenize(docs, definition, id_col="doc_id", text_col="text", capacity=CAPACITY, end_id=END_ID, with_ids=False):
    """(doc, piece, start, length, ids_crc32[, ids]): the token pieces of every row.

    definition is the text of a tokenizers file. A document is its ids and the end id; null texts are
    empty, so they have one piece of length 1. Only longer documents are cut, into pieces of `capacity`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    rows = docs.select(docs[id_col].cast("long").alias("doc"), docs[text_col].cast("string").alias("text"))
    return text_batches(rows).mapInPandas(_tokenize(shared, capacity, end_id, with_ids),
                            "doc long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


def nnls(slots, b, rounds=400):
    """x >= 0 that brings the patterns' sums near b in least squares, by accelerated projected gradients.

    Row j of slots lists where pattern j adds 1; index 0 stands for nowhere.
    """
    def sums(x):
        out = np.bincount(slots.ravel(), np.repeat(x, slots.shape[1]), minlength=len(b))
        out[0] = 0.0
        return out

    v = np.ones(len(slots))
    for _ in range(30):
        v = sums(v)[slots].sum(axis=1)
        norm = np.linalg.norm(v)
        v /= max(norm, 1e-300)
    step = 0.95 / max(norm, 1e-12)
    x = y = np.zeros(len(slots))
    t = 1.0
    for _ in range(rounds):
        r = sums(y) - b
        r[0] = 0.0
        new = np.maximum(0.0, y - step * r[slots].sum(axis=1))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def patterns(steps=STEPS, most=PATTERN_DOCS):
    """Non-increasing tuples of at most `most` lengths, in steps, that fill a sequence exactly."""
    out = []
    for k in range(1, most + 1):
        for head in combinations_with_replacement(range(1, steps + 1), k - 1):
            last = steps - sum(head)
            if last >= (head[-1] if head else 1):
                out.append((*head, last)[::-1])
    return out


def plan(histogram, capacity=CAPACITY, steps=STEPS):
    """Runs (length, offset, first sequence, count) that place `histogram` {length: count}, and the number of sequences."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] = n
    steps = min(steps, capacity)
    width = -(-capacity // steps)
    groups = []       # (count, gap, chain); a chain is (previous chain, length, offset, how many)

    def take(step, n):
        """The n longest documents of a step, as [length, count] runs."""
        out = []
        for length in range(min(capacity, step * width), (step - 1) * width, -1):
            k = min(n, int(left[length]))
            if k:
                left[length] -= k
                n -= k
                out.append([length, k])
        return out

    kinds = [p for p in patterns(capacity // width) if len(p) > 1]
    binned = np.array([0, *(left[(s - 1) * width + 1:min(capacity, s * width) + 1].sum() for s in range(1, capacity // width + 1))], dtype=float)
    slots = np.array([(*p, *[0] * (PATTERN_DOCS - len(p))) for p in kinds], dtype=np.int64).reshape(-1, PATTERN_DOCS)
    fit = np.floor(nnls(slots, binned) + 1e-9).astype(np.int64) if kinds else []
    for j in np.argsort(-np.asarray(fit), kind="stable"):
        p = kinds[j]
        have = [int(left[(s - 1) * width + 1:s * width + 1].sum()) // p.count(s) for s in p]
        n = min(int(fit[j]), *have)
        slots = [take(s, n) for s in p] if n > 0 else []
        while n > 0:
            k = min(s[0][1] for s in slots)
            chain, at = None, 0
            for s in slots:
                chain, at = (chain, s[0][0], at, 1), at + s[0][0]
                s[0][1] -= k
                if not s[0][1]:
                    s.pop(0)
            groups.append((k, capacity - at, chain))
            n -= k

    # Best fit of the rest, longest first. Bit g of `gaps` says that some sequence has a gap of g.
    by_gap, gaps = {}, 0
    for k, gap, chain in groups:
        by_gap.setdefault(gap, []).append((k, chain))
        gaps |= 1 << gap
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            fits = gaps >> length
            if fits:
                gap = length + (fits & -fits).bit_length() - 1
                k, chain = by_gap[gap].pop()
                per = min(gap // length, n)         # a gap takes several of a length at once
                t = min(k, n // per)
                if t < k:
                    by_gap[gap].append((k - t, chain))
            else:
                gap, chain = capacity, None
                per = min(capacity // length, n)
                t = n // per
            if gap < capacity and not by_gap[gap]:
                gaps &= ~(1 << gap)
            rest = gap - per * length
            by_gap.setdefault(rest, []).append((t, (chain, length, capacity - gap, per)))
            gaps |= 1 << rest
            n -= t * per
    runs, first = [], 0
    for groups in by_gap.values():
        for k, chain in groups:
            while chain is not None:
                chain, length, offset, per = chain
                runs += [(length, offset + i * length, first, k) for i in range(per)]
            first += k
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, 4), first


def _place(shared):
    def run(frames):
        runs = shared.value
        ends = np.cumsum(runs[:, 3])
        for df in frames:
            at = np.searchsorted(ends, df["rank"].to_numpy(), side="right")
            inside = df["rank"].to_numpy() - (ends[at] - runs[at, 3])
            yield df.drop(columns="rank").assign(sequence_id=runs[at, 2] + inside, offset=runs[at, 1])
    return run


def pack(pieces, capacity=CAPACITY, steps=STEPS):
    """pieces (doc, piece, start, length, ids_crc32) with sequence_id and offset.

    Every row gets a place, repeated rows and null ids too; a sequence has no gap and no more than
    `capacity` tokens. An empty table gives an empty result.
    """
    pieces = stored(pieces)
    spark = pieces.sparkSession
    histogram = {int(r["length"]): r["count"] for r in pieces.groupBy("length").count().collect()}     # at most `capacity` rows
    runs, _ = plan(histogram, capacity, steps)
    lengths = sorted(histogram)
    base = np.concatenate([[0], np.cumsum([histogram[x] for x in lengths])])
    parts = [(x, -(-histogram[x] // ROWS_PER_TASK), int(b)) for x, b in zip(lengths, base)]
    known = spark.createDataFrame(parts, "length long, parts long, base long")
    rows = pieces.join(F.broadcast(known), "length").withColumn("part", F.pmod(F.xxhash64("doc", "piece"), F.col("parts")))
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("length", "part").agg(F.count("*").alias("n")).select("length", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("length", "part").orderBy("doc", "piece", "ids_crc32")
    ranked = rows.withColumn("k", F.row_number().over(inside) - 1).join(starts, ["length", "part"]).select(
        "doc", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("ahead") + F.col("k")).alias("rank"))
    shared = spark.sparkContext.broadcast(runs)
    return ranked.mapInPandas(_place(shared), "doc long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def sequences(placed, pieces_with_ids):
    """(sequence_id, ids): the token ids of every sequence, at most `capacity` each."""
    both = placed.join(pieces_with_ids.select("doc", "piece", "ids_crc32", "ids").dropDuplicates(["doc", "piece", "ids_crc32"]), ["doc", "piece", "ids_crc32"])
    return both.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("s")).select(
        "sequence_id", F.flatten(F.transform("s", lambda x: x["ids"])).alias("ids"))
