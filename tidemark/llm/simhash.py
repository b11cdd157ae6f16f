"""SimHash near-duplicates with bit-sliced comparison.

Distinct fingerprints are cut into six blocks of bits. Two that differ in at most three
bits agree on three blocks at least, so each of the twenty triples of blocks gives a key and
every link shows up under some key. Fingerprints under one key are compared bit-sliced: bit planes
are stored vertically, one exclusive-or updates 64 distances held in carry-save counters, and a
block is abandoned as soon as all its distances exceed the radius. A key's links leave the task
as a spanning forest, and the forests are joined by alternating star contractions.
"""

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from ..session import cut_lineage, stored
from .common import mark_near, shuffle_count, text_batches

RADIUS = 3
SHINGLE = 3
SEED = 42
BLOCK_BITS = (11, 11, 11, 11, 10, 10)
CHUNK = 8_192          # fingerprints of one key that are compared at once; larger keys are cut into pairs of chunks
HASHES = 1 << 16       # shingle hashes counted at once


def shingle_hashes(text, width=SHINGLE, seed=SEED):
    """Hashes of the word shingles of a text, repeats included, in pieces."""
    words = text.encode("utf-8", "surrogatepass").lower().split()     # bytes: A-Z and ASCII white space only
    if not words:
        return
    if len(words) < width:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], dtype=np.uint64)
        return
    for at in range(0, len(words) - width + 1, HASHES):
        part = words[at:at + HASHES + width - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(width))))
        yield np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in grams), dtype=np.uint64)


def simhash(text, width=SHINGLE, seed=SEED):
    """The 64-bit fingerprint as a signed integer: a bit is set where over half the hashes have it."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    for h in shingle_hashes(text, width, seed):
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<i8")[0])


@pandas_udf(LongType())
def fingerprint_of(texts: pd.Series) -> pd.Series:
    return pd.Series([simhash(t or "") for t in texts], dtype="int64")


def bit_planes(values):
    """(64, words) planes: bit j of word w in plane b is bit b of values[64 w + j]."""
    n = -(-len(values) // 64) * 64
    padded = np.zeros(n, dtype=np.uint64)
    padded[:len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def near(query, planes, radius=RADIUS):
    """Indices j of the sliced values within `radius` bits of `query`; radius is at most 3."""
    width = planes.shape[1]
    at = np.arange(width)                   # blocks of 64 that are still in the running
    one = np.zeros(width, dtype=np.uint64)
    two = np.zeros(width, dtype=np.uint64)
    over = np.zeros(width, dtype=np.uint64)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for b in range(64):
        differs = planes[b, at] ^ (full if query >> b & 1 else np.uint64(0))
        carry = one & differs
        one ^= differs
        again = two & carry
        two ^= carry
        over |= again                       # the counter has passed 3
        if b % 8 == 7:
            live = over != full
            if not live.all():
                at, one, two, over = at[live], one[live], two[live], over[live]
                if not len(at):
                    return np.zeros(0, dtype=np.int64)
    inside = ~over
    for limit, beyond in ((2, one & two), (1, two), (0, one | two)):
        if radius <= limit:
            inside &= ~beyond
    found = np.unpackbits(inside.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    w, j = np.nonzero(found)
    return at[w] * 64 + j


def forest(left, right, radius=RADIUS):
    """Spanning forest edges (i, j into left + right) of the links between left and right, or within left if right is None."""
    both = left if right is None else np.concatenate([left, right])
    base = 0 if right is None else len(left)
    other = left if right is None else right
    planes = bit_planes(other) if len(other) > 16 else None
    tree = np.arange(len(both))              # the tree each fingerprint is in
    edges = []
    for i, q in enumerate(left.tolist()):
        first = i + 1 if right is None else 0
        if planes is not None:
            hits = near(q, planes, radius)
            hits = hits[(hits < len(other)) & (hits >= first)]
        else:
            hits = np.array([j for j in range(first, len(other)) if (q ^ int(other[j])).bit_count() <= radius], dtype=np.int64)
        new = base + hits[tree[base + hits] != tree[i]]
        if len(new):
            trees, at = np.unique(tree[new], return_index=True)
            edges += [(i, int(j)) for j in new[at]]
            tree[np.isin(tree, trees)] = tree[i]
    return both, edges


def _edges_of_cells(radius):
    """Rows (cell..., side, fp) sorted by cell -> forest edges; a cell may straddle batches."""
    def links(fps, sides):
        left, right = fps[sides == 0], fps[sides == 1]
        both, edges = forest(left, right if len(right) else None, radius)
        return [(int(both[i].view(np.int64)), int(both[j].view(np.int64))) for i, j in edges]

    def run(frames):
        held = None
        for df in frames:
            df = df if held is None else pd.concat([held, df], ignore_index=True)
            if df.empty:
                continue
            keys = df[["combo", "key", "a", "b"]].to_numpy()
            cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            ends = [0, *cut.tolist()]
            fps, sides = df["fp"].to_numpy("int64").view(np.uint64), df["side"].to_numpy()
            out = []
            for s, e in zip(ends, ends[1:]):
                out += links(fps[s:e], sides[s:e])
            held = df.iloc[ends[-1]:]
            yield pd.DataFrame(out, columns=["u", "v"], dtype="int64")
        if held is not None and len(held):
            yield pd.DataFrame(links(held["fp"].to_numpy("int64").view(np.uint64), held["side"].to_numpy()), columns=["u", "v"], dtype="int64")
    return run


def links(prints, radius=RADIUS, chunk=CHUNK):
    """Edges (u, v) that connect every pair of distinct fingerprints within `radius` bits; prints has the column fp.

    All pairs under a key are compared, whatever its size; only a spanning forest is returned.
    A key with more than `chunk` fingerprints is cut into chunks and compared chunk by chunk in separate cells.
    """
    if not 0 <= radius <= 3:
        raise ValueError("radius is 0 to 3")
    n = shuffle_count(prints)
    offsets = np.concatenate([[0], np.cumsum(BLOCK_BITS)]).tolist()

    def block(k):
        return F.shiftrightunsigned("fp", offsets[k]).bitwiseAND((1 << BLOCK_BITS[k]) - 1)

    def key(combo):
        out = F.lit(0).cast("long")
        for k in combo:
            out = F.shiftleft(out, BLOCK_BITS[k]).bitwiseOR(block(k))
        return out

    combos = list(combinations(range(len(BLOCK_BITS)), len(BLOCK_BITS) - radius))
    keyed = prints.select("fp", F.posexplode(F.array(*(key(c) for c in combos))).alias("combo", "key"))
    sizes = keyed.groupBy("combo", "key").agg(F.count("*").alias("n")).where("n > 1")
    rows = keyed.join(sizes, ["combo", "key"]).withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int"))
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("chunks")).cast("int")
    # A cell is a pair of chunks; a chunk meets every chunk, itself included, in one cell.
    cells = rows.withColumn("own", own).select("fp", "combo", "key", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("met")).select(
        "combo", "key", F.least("own", "met").alias("a"), F.greatest("own", "met").alias("b"), (F.col("own") > F.col("met")).cast("int").alias("side"), "fp")
    order = ["combo", "key", "a", "b"]
    dealt = cells.repartition(n, *order).sortWithinPartitions(*order, "side", "fp")
    return dealt.mapInPandas(_edges_of_cells(radius), "u long, v long")


def components(edges, rounds=60):
    """(node, root): the smallest node reachable from each node of the undirected edges (u, v).

    Alternates large-star and small-star contractions until no edge changes; a hub is never gathered,
    its smallest neighbour is an aggregate that is joined back.
    """
    edges = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    mark = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = cut_lineage(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs, id_col="doc_id", text_col="text", radius=RADIUS, carry=()):
    """(id, fp, component, *carry) for every row of docs: its fingerprint and the smallest id it is linked with.

    Null and empty texts, and texts without a word, have fingerprint 0 and are linked like any other.
    Equal texts are linked; repeated rows are kept. Null ids take part in links but name no component
    unless nothing else does. An empty table gives an empty result. carry holds further columns, with names of their own.
    """
    rows = stored(text_batches(docs).select(docs[id_col].alias("id"), fingerprint_of(docs[text_col].cast("string")).alias("fp"), *carry))
    distinct = stored(rows.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(distinct.select("fp"), radius))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    classes = stored(rooted.join(named, "root").select("fp", "root", "component"))
    return rows.join(classes, "fp")


def keep_one(docs, id_col="doc_id", text_col="text", radius=RADIUS):
    """docs with one row of every near-duplicate group: that with the smallest id, nulls last."""
    tag = F.xxhash64(*(docs[c] for c in docs.columns))
    return keep_least(docs, stored(near_duplicates(docs, id_col, text_col, radius, [tag.alias("tag")]).select("id", "tag", "root")), tag, id_col)


def keep_least(docs, rows, tag, id_col="doc_id"):
    """docs with one row of every root: that with the smallest id, nulls last; rows has (id, tag, root).

    A row is known by its id and `tag`, a hash of all its columns. Only the rows to drop are looked up; texts
    stay where they are unless the bounded filter of those rows marks them.
    """
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "tag")
    # A table of its own, so that the join deals its rows anew and can split a large group.
    chosen = stored(rows.groupBy("root").agg(F.min(rank).alias("best")))
    marked = rows.join(chosen, "root").withColumn("kept", F.col("best.id").eqNullSafe(F.col("id")) & (F.col("best.tag") == F.col("tag")))
    sets = marked.groupBy("id", "tag").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    out = stored(sets.where(~F.col("kept") | (F.col("n") > 1)))
    same = F.col("__id").eqNullSafe(F.col("id")) & (F.col("__tag") == F.col("tag"))
    tagged = mark_near(docs.withColumn("__id", docs[id_col]).withColumn("__tag", tag), F.col("__tag"), out.select("tag"))
    rest, tagged = tagged.where(~F.col("__near")), tagged.where("__near")
    once = rest.unionByName(tagged.join(out, same, "left_anti"))
    repeated = tagged.join(out.where("kept"), same, "left_semi").dropDuplicates(["__id", "__tag"])
    return once.unionByName(repeated).select(*docs.columns)
