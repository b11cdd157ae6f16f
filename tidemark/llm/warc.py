"""WARC archives: writing with segmentation and chunked framing, and reading them back.

Archives are written and read through Spark's own file sinks and sources, so any store that
Spark reaches will do. A record block longer than the segment size becomes a first segment and
continuation records; the reader groups those by their origin identifier, orders them by
segment number, verifies the total length and only then decodes the chunked transfer framing.
"""

import base64
import hashlib
import zlib

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import functions as F

from .common import text_batches

# Fixed values of the record format.
CRLF = "\r\n"
VERSION = "WARC/1.1"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
HTTP_EMPTY = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
HTTP_TYPE = "application/http; msgtype=response"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = b"\x1f\x8b\x08"

SEGMENT_CHARS = 32_768       # code points of a block per record
CHUNK_CHARS = 8_192          # code points of a payload per transfer chunk
RECORDS_PER_FILE = 1_000     # bounds a file, with the segment size
READ = 1 << 16               # compressed bytes fed at once


def base32_sha1(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(text, size):
    """A payload in chunked transfer framing."""
    parts = []
    for i in range(0, len(text), size):
        piece = text[i:i + size]
        parts.append(f"{len(piece.encode()):X}{CRLF}{piece}{CRLF}")
    return "".join(parts) + f"0{CRLF}{CRLF}"


def unchunk(data):
    """The payload of a chunked body; ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        end = data.index(b"\r\n", at)
        n = int(data[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if data[at + n:at + n + 2] != b"\r\n":
            raise ValueError("chunk does not end where its size says")
        out.append(data[at:at + n])
        at += n + 2


def _record(kind, record_id, block, headers):
    lines = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {DATE}"]
    lines += [f"{k}: {v}" for k, v in headers if v is not None]
    lines += [f"Content-Length: {len(block.encode())}", "", ""]
    return CRLF.join(lines) + block


def _write_rows(segment_chars, chunk_chars):
    def run(frames):
        task, n = TaskContext.get().partitionId(), 0
        for df in frames:
            out = []
            for page, url, html, sha, first, unique in zip(df["page"], df["url"], df["payload"], df["sha1"], df["first"], df["unique"]):
                n += 1
                record_id = f"<urn:page:{page}:{sha[:16]}>" if unique else f"<urn:page:{page}:{sha[:16]}#{task}.{n}>"
                url = None if url is None else " ".join(url.split())
                head = [("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{base64.b32encode(bytes.fromhex(sha)).decode()}")]
                if first is not None and first != page:
                    out.append(_record("revisit", record_id, HTTP_EMPTY, [*head, ("WARC-Refers-To", f"<urn:page:{first}:{sha[:16]}>"), ("WARC-Profile", PROFILE), ("Content-Type", HTTP_TYPE)]))
                    continue
                head.append(("Content-Type", HTTP_TYPE))
                block = HTTP_HEAD + chunked(html, chunk_chars)
                if len(block) <= segment_chars:
                    out.append(_record("response", record_id, block, head))
                    continue
                total = len(block.encode())
                cuts = range(0, len(block), segment_chars)
                for k, i in enumerate(cuts, 1):
                    last = ("WARC-Segment-Total-Length", total if k == len(cuts) else None)
                    part = block[i:i + segment_chars]
                    if k == 1:
                        out.append(_record("response", record_id, part, [*head, ("WARC-Segment-Number", 1)]))
                    else:
                        out.append(_record("continuation", f"{record_id[:-1]}/{k}>", part,
                                           [("WARC-Segment-Origin-ID", record_id), ("WARC-Segment-Number", k), last]))
            yield pd.DataFrame({"value": out})
    return run


def write_archives(pages, path, id_col="page_id", url_col="url", payload_col="html",
                   segment_chars=SEGMENT_CHARS, chunk_chars=CHUNK_CHARS):
    """One record per row of pages below `path`, as gzipped WARC files.

    Of rows with equal payloads (null: empty) that with the largest id becomes a response and the others
    revisit it. Rows that repeat the response's id are responses too; a row without
    an id revisits its group's response if there is one. An empty table writes no record.
    """
    rows = pages.select(
        pages[id_col].cast("long").alias("page"), pages[url_col].cast("string").alias("url"),
        F.coalesce(pages[payload_col].cast("string"), F.lit("")).alias("payload"),
    ).withColumn("sha1", F.sha1(F.col("payload").cast("binary")))
    each = rows.groupBy("sha1", "page").agg(F.count("*").alias("n"))
    first = each.groupBy("sha1").agg(F.max("page").alias("first"), (F.max("n") == 1).alias("unique"))
    rows = rows.join(first, "sha1").select(
        F.coalesce(F.col("page").cast("string"), F.lit("none")).alias("page"), "url", "payload", "sha1", F.col("first").cast("string").alias("first"), "unique")
    records = text_batches(rows).mapInPandas(_write_rows(segment_chars, chunk_chars), "value string")
    # A row of the text sink is a record without its end mark, and the sink's separator is that mark.
    (records.write.option("lineSep", CRLF * 2).option("compression", "gzip")
     .option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


def members(content):
    """(bytes, whether it is whole) of every gzip member of an archive, one after another.

    A broken member yields what came before the break; the search for the next one passes over whatever does not
    hold a record.
    """
    at, searching = 0, False
    while 0 <= at < len(content):
        unzip, out, whole, k = zlib.decompressobj(47), [], False, at
        try:
            for k in range(at, len(content), READ):
                out.append(unzip.decompress(content[k:k + READ]))
                if unzip.eof:
                    whole = True
                    break
        except zlib.error:
            pass
        data = b"".join(out)
        if not searching or data.startswith(VERSION.encode()):
            yield data, whole
            searching = not whole
        at = min(k + READ, len(content)) - len(unzip.unused_data) if whole and not searching else content.find(GZIP, at + 1)


def _record_at(data, at):
    """(headers, block, end) of the record that starts here; a ValueError tells of damage."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split(CRLF)
    if lines[0] != VERSION:
        raise ValueError(f"no record starts at byte {at}")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    if not {"WARC-Record-ID", "WARC-Type", "Content-Length"} <= headers.keys():
        raise ValueError(f"the record at byte {at} lacks a field")
    start = end + 4
    stop = start + int(headers["Content-Length"])
    if not int(headers.get("WARC-Segment-Number", 1)) > 0 or data[stop:stop + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at byte {at} does not end where its length says")
    return headers, data[start:stop], stop + 4


def parse(data):
    """(headers, block) of every record in the bytes of one member; (None, None) for each damaged stretch, up to the next
    place where a record starts."""
    at = 0
    while at < len(data):
        try:
            headers, block, at = _record_at(data, at)
            yield headers, block
        except ValueError:
            yield None, None
            at = data.find(f"{VERSION}{CRLF}WARC-".encode(), at + 1)
            if at < 0:
                return


def decode_block(block):
    """The payload of an HTTP response block."""
    end = block.index(b"\r\n\r\n")
    body = block[end + 4:]
    return unchunk(body) if b"transfer-encoding: chunked" in block[:end].lower() else body


_PARSED = "record_id string, type string, url string, digest string, refers_to string, origin string, segment int, total long, block binary"


def _records(content):
    for data, whole in members(content):
        yield from parse(data)
        if not whole:
            yield None, None


def _read_files(segmented):
    def run(frames):
        for df in frames:
            out = []
            for content in df["content"]:
                for h, block in _records(content):
                    if h is None:
                        if not segmented:
                            out.append((None, "damaged", None, None, None, None, 1, None, None))
                    elif ("WARC-Segment-Number" in h) == segmented:
                        total = h.get("WARC-Segment-Total-Length")
                        out.append((h["WARC-Record-ID"], h["WARC-Type"], h.get("WARC-Target-URI"), h.get("WARC-Payload-Digest"), h.get("WARC-Refers-To"),
                                    h.get("WARC-Segment-Origin-ID", h["WARC-Record-ID"]), int(h.get("WARC-Segment-Number", 1)), None if total is None else int(total), bytes(block)))
                    if len(out) >= 256:
                        yield _frame(out)
                        out = []
            yield _frame(out)
    return run


def _frame(out):
    df = pd.DataFrame(out, columns=[c.split()[0] for c in _PARSED.split(", ")], dtype=object)
    return df


_DECODED = "record_id string, type string, url string, digest string, refers_to string, payload binary, payload_bytes long, payload_digest string, status string"


def _decode(with_payload):
    def run(frames):
        for df in frames:
            out = []
            for rid, kind, url, digest, refers, block, status in zip(df["record_id"], df["type"], df["url"], df["digest"], df["refers_to"], df["block"], df["status"]):
                payload = size = found = None
                if status == "ok" and kind == "response":
                    try:
                        payload = decode_block(bytes(block))
                        size, found = len(payload), base32_sha1(payload)
                        status = "ok" if digest in (None, f"sha1:{found}") else "digest differs"
                    except ValueError:
                        status = "broken framing"
                out.append((rid, kind, url, digest, refers, payload if with_payload else None, size, found, status))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _DECODED.split(", ")], dtype=object)
    return run


def read_archives(spark, path, with_payload=True):
    """One row per logical record of the archives below `path`.

    Records without a segment number are decoded where they are read; only segments are
    shuffled. Archives may have one gzip member or one per record. status is "ok", "missing segment", "length differs",
    "broken framing", "digest differs" or "damaged"; a record that is not ok has no payload. A damaged stretch gives one row
    of type "damaged" without an id, and reading goes on at the next record or member. Payload columns are null for revisits.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    whole = files.mapInPandas(_read_files(False), _PARSED).select(
        "record_id", "type", "url", "digest", "refers_to", "block", F.when(F.col("type") == "damaged", "damaged").otherwise("ok").alias("status"))
    pieces = files.mapInPandas(_read_files(True), _PARSED)
    first = F.col("segment") == 1
    joined = pieces.groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("s"), F.max("total").alias("total"), F.max("segment").alias("n"),
        *(F.max(F.when(first, F.col(c))).alias(c) for c in ("type", "url", "digest", "refers_to")))
    block = F.aggregate("s", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["block"]))
    complete = (F.size("s") == F.col("n")) & F.col("total").isNotNull() & F.col("type").isNotNull() & (F.size(F.array_distinct(F.transform("s", lambda x: x["segment"]))) == F.col("n"))
    joined = joined.withColumn("block", block).select(
        F.col("origin").alias("record_id"), "type", "url", "digest", "refers_to", "block",
        F.when(~complete, F.lit("missing segment")).when(F.octet_length("block") != F.col("total"), F.lit("length differs")).otherwise(F.lit("ok")).alias("status"))
    return whole.unionByName(joined).mapInPandas(_decode(with_payload), _DECODED)
