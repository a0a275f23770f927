"""WARC archives: writing, reading, and assembly of transactions.

Writing: each page becomes a request, a response (or a revisit) and a metadata record,
tied by WARC-Concurrent-To to the response's record id; a record is a gzip member of its own. Of equal
payloads (SHA-256 and length) one is the response, that of the largest page id; the others revisit it.
Spark's text sink writes the members through its commit protocol to any file system; the
line separator is an empty gzip member, so each part is a valid multi-member .warc.gz.

Reading: parts are read whole as binary files, cut into members, and parsed by Content-Length. A part holds at most
PART bytes before compression, or one record: captures are written by size class, so many records to a part as its class allows.

Assembly: request, response and metadata records are joined through their concurrent-to
identifiers, by one aggregation on the capture's id; a revisit then finds its response by id.

Scale: pages are staged once; payloads are not shuffled unless the payloads that repeat are too
many to broadcast (Spark decides by size, with AQE's split of skewed joins beyond). A capture has at most a
few records, whatever repeats. Reading and writing hold one part, or one record, at a time.

Defined cases: a payload of any length that a row can hold is one record, in a part of its own from PART / 4 bytes on; a null payload is empty; null page ids lose against any other (refers_to is null then);
of rows with equal payload and page id one is the response; an empty table gives an empty
result; other columns are not written.
"""

from __future__ import annotations

import base64
import hashlib
import math
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, name

#: Bytes of a part before compression, the bound of the least size class, the factor between classes, and what a record's headers take beside its uri.
PART, CLASS, FACTOR, HEADERS = 64 << 20, 4096, 4, 1024
LEAST = 0
LEVEL = 1
SPACE = uuid.UUID("5f0c2d0e-7f0b-4f0e-9c55-6a3c1d8f2b11")
VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
RECORD = "record_id string, type string, concurrent_to string, target_uri string, refers_to string, payload_digest string, page_id long, payload_bytes long, payload binary"


def member(data: bytes, level: int = LEVEL) -> bytes:
    made = zlib.compressobj(level, zlib.DEFLATED, 31)
    return made.compress(data) + made.flush()


#: Between records: a gzip member without content, no byte of which reads as a line of text.
BETWEEN = member(b"")


def members(data: bytes):
    """The contents of a gzip file's members, of those that have any."""
    view, at = memoryview(data), 0
    while at < len(view):
        one, parts = zlib.decompressobj(31), []
        while not one.eof:
            if at >= len(view):
                raise ValueError("a gzip member is cut off")
            block = view[at : at + 65_536]
            parts.append(one.decompress(block))
            at += len(block)
        at -= len(one.unused_data)
        if content := b"".join(parts):
            yield content


def record(kind: str, id: str, uri: str, body: bytes, headers: dict[str, str]) -> bytes:
    lines = [VERSION, b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: " + id.encode(), b"WARC-Date: " + DATE.encode(), b"WARC-Target-URI: " + uri.encode()]
    lines += [f"{k}: {v}".encode() for k, v in headers.items()]
    return b"\r\n".join([*lines, b"Content-Length: %d" % len(body), b"", body]) + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and body of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("no WARC record")
    headers = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines[1:])}
    n = int(headers["content-length"])
    if len(rest) < n:
        raise ValueError("a WARC record is cut off")
    return headers, rest[:n]


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, '/'.join(map(str, parts)))}>"


def line_safe(uri: str | None) -> str:
    return "".join(uri.split()) if uri else "about:blank"


def write(pages: DataFrame, path: str, space: Workspace, payload: str = "html", id: str = "page_id", url: str = "url", least: int = LEAST, part: int = PART) -> None:
    """Writes archives below path."""
    uri = name(url).cast("string") if url in pages.columns else F.lit(None).cast("string")
    t = pages.select(name(id).cast("long").alias("page_id"), uri.alias("url"), F.coalesce(name(payload).cast("binary"), F.lit(b"")).alias("payload"))
    t = t.withColumn("sha", F.unhex(F.sha2("payload", 256))).withColumn("rid", F.monotonically_increasing_id())
    t = space.write(t, "staged")
    same = t.where(F.octet_length("payload") >= least).groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max_by("rid", "page_id"), F.max("rid")).alias("response"))
    same = space.write(same.where("n > 1").select(F.col("sha").alias("s"), "response"), "repeated")
    t = t.join(same, F.col("sha") == F.col("s"), "left").select("page_id", "url", "payload", "sha", "rid", "response")

    def run(batches):
        for batch in batches:
            made = []
            for page, url, payload, sha, rid, response in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                uri, revisit = line_safe(url), response is not None and response != rid
                own = urn("page", rid) if response is None or revisit else urn("payload", sha.hex())
                known = digest(payload)
                made.append(member(record("request", urn("request", rid), uri, b"GET %s HTTP/1.1\r\n\r\n" % uri.encode(), {"WARC-Concurrent-To": own, "Content-Type": "application/http;msgtype=request"})))
                headers = {"WARC-Payload-Digest": f"sha1:{known}", "Content-Type": "application/http;msgtype=response"}
                if revisit:
                    headers |= {"WARC-Refers-To": urn("payload", sha.hex()), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: %d\r\n\r\n" % len(payload)
                made.append(member(record("revisit" if revisit else "response", own, uri, http if revisit else http + payload, headers)))
                fields = (b"" if page is None else b"page-id: %d\r\n" % page) + b"payload-length: %d\r\n" % len(payload)
                made.append(member(record("metadata", urn("metadata", rid), uri, fields, {"WARC-Concurrent-To": own, "Content-Type": "application/warc-fields"})))
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["value"])

    size = F.octet_length("payload") + 3 * F.coalesce(F.octet_length("url"), F.lit(0)) + HEADERS
    of = F.greatest(F.lit(0), F.ceil(F.log(size / CLASS) / math.log(FACTOR))).cast("int")
    for at in sorted(r.c for r in t.select(of.alias("c")).distinct().collect()) or [0]:  # a payload has at most 2 GB: ten classes
        lines = t.where(of == at).mapInArrow(run, "value binary").select(F.col("value").cast("string"))
        records = max(1, part // (CLASS * FACTOR**at))
        lines.write.mode("append").option("lineSep", BETWEEN.decode("iso-8859-1")).option("encoding", "iso-8859-1").option("maxRecordsPerFile", records).text(path)


def read(spark, path: str, payloads: bool = True) -> DataFrame:
    """One row per record: RECORD. payloads: whether to return them, or only what they weigh and their digests, taken from the bytes read."""

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for data in members(content.as_py()):
                    head, body = parse(data)
                    kind, fields, own = head["warc-type"], {}, None
                    if kind == "metadata":
                        fields = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in body.decode().split("\r\n") if x)}
                    if kind == "response":
                        own = body.partition(b"\r\n\r\n")[2]
                        fields["payload-length"] = len(own)
                    known = digest(own) if own is not None else head.get("warc-payload-digest", "sha1:")[5:] or None
                    if own is not None and head.get("warc-payload-digest") not in (None, f"sha1:{known}"):
                        raise ValueError(f"payload of {head['warc-record-id']} does not match its digest")
                    number = lambda k: int(fields[k]) if k in fields else None  # noqa: E731, B023
                    rows.append((head["warc-record-id"], kind, head.get("warc-concurrent-to"), head.get("warc-target-uri"), head.get("warc-refers-to"), known, number("page-id"), number("payload-length"), own if payloads else None))
                    if len(rows) == 2000:
                        yield arrow(rows)
                        rows = []
                if rows:
                    yield arrow(rows)

    kinds = [pa.string()] * 6 + [pa.int64()] * 2 + [pa.binary()]
    names = [c.split()[0] for c in RECORD.split(", ")]
    arrow = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    # A part is a row here, and a batch must not hold many of them.
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id, and the structs response (a response or revisit record), request, metadata."""
    fields = [c for c in records.columns if c not in ("concurrent_to", "refers_to")]
    one = lambda kinds, more=(): F.first(F.when(F.col("type").isin(*kinds), F.struct(*fields, *more)), ignorenulls=True)
    capture = F.when(F.col("type").isin("request", "metadata"), F.col("concurrent_to")).otherwise(F.col("record_id"))
    return records.groupBy(capture.alias("capture_id")).agg(one(["response", "revisit"], ["refers_to"]).alias("response"), one(["request"]).alias("request"), one(["metadata"]).alias("metadata"))


def captures(records: DataFrame, space: Workspace) -> DataFrame:
    """Assembled captures with refers_to_page: the page id of the capture that a revisit refers to."""
    t = space.write(assemble(records), "captures")
    refers = F.col("response.refers_to")
    wanted = t.where(refers.isNotNull()).select(refers.alias("w")).distinct()
    found = t.join(wanted, F.col("capture_id") == F.col("w"), "left_semi").select(F.col("capture_id").alias("i"), F.col("metadata.page_id").alias("refers_to_page"))
    found = space.write(found, "referred")
    return t.join(found, refers == F.col("i"), "left").drop("i")


def round_trip(pages: DataFrame, payload: str = "html", id: str = "page_id", url: str = "url", least: int = LEAST) -> DataFrame:
    """Writes the pages' archives, reads them back, and returns a row per page: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    space = Workspace(pages.sparkSession)
    path = f"{space.folder}/archives"
    write(pages, path, space, payload, id, url, least)
    t = captures(read(pages.sparkSession, path, payloads=False).drop("payload"), space)
    return t.select(
        F.col("metadata.page_id").alias("page_id"), F.coalesce("response.payload_bytes", "metadata.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"), F.col("refers_to_page").alias("refers_to"),
    )
