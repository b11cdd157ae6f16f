"""Document fingerprints by a homomorphic multiset hash of paragraphs.

Every paragraph is hashed to a wide vector and a document is the sum of its paragraphs' vectors, lane by
lane modulo a power of two. So the order of paragraphs does not matter, and inserting or deleting
one adds or subtracts its vector. The vector has two parts: identity lanes, uniform 32-bit hashes of the
paragraph, that tell any two different multisets apart, and likeness lanes, where each window of
three words of the paragraph adds +1 or -1, so that the angle between two sums estimates the overlap.
Everything is a DataFrame expression.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import stored
from .common import text_of

IDENTITY, IDENTITY_BITS = 8, 32
LIKENESS, LIKENESS_BITS = 64, 32   # a lane holds as many windows as a counter, so that its sign is right
WHITE = "[\\x20\\x09-\\x0D]+"
BUCKET_BITS = 8          # ids that differ only in these bits are neighbours in one bucket
GROUP_BITS = 12          # buckets of one group


def lanes(pieces, *keys):
    """(*keys, identity array, likeness array): the vector of the multiset of paragraphs of every key.

    pieces has the columns *keys and text. Blank paragraphs do not count; a text without any has the zero vector.
    """
    paragraphs = pieces.select(*keys, F.explode_outer(F.filter(F.split("text", "\\n"), lambda p: F.btrim(p, F.lit(" \t\r\n\f\x0b")) != "")).alias("p"))
    words = paragraphs.select(
        *keys, F.xxhash64("p").alias("h1"), F.xxhash64("p", F.lit(1)).alias("h2"), F.col("p").isNotNull().alias("some"),
        F.split(F.btrim("p", F.lit(" \t\r\n\f\x0b")), WHITE).alias("w"))
    windows = words.select(*keys, "h1", "h2", "some", F.posexplode_outer(
        F.transform("w", lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)))).alias("at", "h"))
    first = F.col("some") & (F.coalesce("at", F.lit(0)) == 0)
    # Two counters share one long: a text has less than 2^31 windows, so the lower never carries over.
    pair = (1 << 32) | 1
    counts = windows.groupBy(*keys).agg(
        *(F.coalesce(F.sum(F.when(first, F.shiftrightunsigned(F.xxhash64("h1", "h2", F.lit(j)), 64 - IDENTITY_BITS))), F.lit(0)).alias(f"i{j}") for j in range(IDENTITY)),
        *(F.coalesce(F.sum(F.shiftrightunsigned("h", j).bitwiseAND(pair)), F.lit(0)).alias(f"l{j}") for j in range(LIKENESS // 2)),
        F.count("h").alias("n"))
    low = [F.col(f"l{j}").bitwiseAND((1 << 32) - 1) for j in range(LIKENESS // 2)]
    high = [F.shiftrightunsigned(f"l{j}", 32) for j in range(LIKENESS // 2)]
    return counts.select(
        *keys, F.array(*(F.pmod(f"i{j}", F.lit(1 << IDENTITY_BITS)) for j in range(IDENTITY))).alias("identity"),
        F.array(*(F.pmod(ones * 2 - F.col("n"), F.lit(1 << LIKENESS_BITS)) for ones in low + high)).alias("likeness"))


def added(a, b, bits):
    """Lanes of the union of two multisets."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + y, F.lit(1 << bits)))


def removed(a, b, bits):
    """Lanes of a multiset less one that it contains."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x - y, F.lit(1 << bits)))


def written(identity, likeness):
    """The fingerprint as lower-case hexadecimal text."""
    part = lambda c, bits: F.array_join(F.transform(c, lambda x: F.lpad(F.hex(x), bits // 4, "0")), "")
    return F.lower(F.concat(part(F.col(identity), IDENTITY_BITS), part(F.col(likeness), LIKENESS_BITS)))


def likeness(a, b, same):
    """0 to 1: the cosine between two documents' likeness lanes, and 1 where `same` holds."""
    half = 1 << (LIKENESS_BITS - 1)
    signed = lambda x: (F.pmod(x + half, F.lit(2 * half)) - half).cast("double")
    dot = lambda c, d: F.aggregate(F.zip_with(c, d, lambda x, y: signed(x) * signed(y)), F.lit(0.0), lambda s, x: s + x)
    a, b = F.col(a), F.col(b)
    size = F.sqrt(dot(a, a) * dot(b, b))
    cosine = F.when(size > 0, dot(a, b) / size).otherwise(0.0)
    return F.when(same, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def buckets(docs, id_col):
    """(bucket, head, before): every bucket of ids, its largest id and the bucket that precedes it in
    descending order; before the first comes the last. Null ids have the lowest bucket, and a null head."""
    bucket = bucket_of(F.col("id"))
    heads = docs.select(docs[id_col].cast("long").alias("id")).groupBy(bucket.alias("bucket")).agg(F.max("id").alias("head"))
    group = F.shiftright("bucket", GROUP_BITS)
    heads = stored(heads.withColumn("group", group))
    inside = Window.partitionBy("group").orderBy("bucket")
    groups = heads.groupBy("group").agg(F.min("bucket").alias("low"))
    groups = groups.withColumn("above", F.lead("low").over(Window.orderBy("group")))
    lowest = heads.agg(F.min("bucket").alias("lowest"))
    return heads.withColumn("next", F.lead("bucket").over(inside)).join(groups, "group").crossJoin(F.broadcast(lowest)).select(
        "bucket", "head", F.coalesce("next", "above", "lowest").alias("before"))


def bucket_of(id_):
    return F.coalesce(F.shiftright(id_, BUCKET_BITS), F.lit(-(1 << 60)).cast("long"))


def edits(docs, id_col="doc_id", text_col="text"):
    """Fingerprints of every document, of its edited text and of the next document.

    Next is the row with the next smaller id, nulls last and repeated ids by text hash; after the last comes the first. The
    edited text has the last third of the code points replaced by as many first ones of the next document.
    Null texts are empty. Rows: (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    Ids fall into buckets of 2^BUCKET_BITS, which are windows of bounded size; a bucket's first
    document also goes to the bucket before, so the texts are shuffled once and all the rest happens in place.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), text_of(docs, text_col).alias("text"))
    heads = stored(buckets(docs, id_col))
    sent = rows.join(heads.select("head", "before"), rows["id"].eqNullSafe(heads["head"]), "left")
    both = F.array(F.struct(bucket_of(F.col("id")).alias("bucket"), F.lit(0).alias("guest")), F.struct(F.col("before").alias("bucket"), F.lit(1).alias("guest")))
    dealt = sent.select("id", "text", F.inline(F.filter(both, lambda x: x["bucket"].isNotNull())))
    order = Window.partitionBy("bucket").orderBy("guest", F.col("id").desc_nulls_last(), F.xxhash64("text"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    lined = dealt.withColumn("next", F.lead("text").over(order)).withColumn("place", F.row_number().over(order)).withColumn(
        "n_chars", F.length("text").cast("long"))
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substring(F.coalesce("next", F.lit("")), F.lit(1), third))
    lined = lined.withColumn("edited", edited)
    texts = F.array(F.struct(F.lit(0).alias("side"), F.col("text")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("text")))
    pieces = lined.select("bucket", "guest", "place", "id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.inline(texts))
    prints = lanes(pieces, "bucket", "guest", "place", "id", "n_chars", "edited_sha256", "side")
    # Both sides and the next place lie in one bucket: still no shuffle.
    along = Window.partitionBy("bucket").orderBy("place", "side")
    placed = prints.withColumns({f"edited_{c}": F.lead(c).over(along) for c in ("identity", "likeness")} | {f"next_{c}": F.lead(c, 2).over(along) for c in ("identity", "likeness")})
    own = placed.where("side = 0 AND guest = 0")
    same = lambda k: (F.col("identity") == F.col(f"{k}_identity")) & (F.col("likeness") == F.col(f"{k}_likeness"))
    return own.select(
        "id", "n_chars", "edited_sha256", written("identity", "likeness").alias("fingerprint"), written("edited_identity", "edited_likeness").alias("edited_fingerprint"),
        likeness("likeness", "edited_likeness", same("edited")).alias("near_edited"), likeness("likeness", "next_likeness", same("next")).alias("near_next"))
