"""WARC archives: write pages as records, read the archives back, put segmented records together again.

A record longer than one segment is written as a first record and continuation records, which name the first record's
id, their segment number and, in the last, the total length. Archives are plain record files, each one gzip member, written
by Spark's text writer with the record end as line separator, so a lost executor costs a task attempt and nothing else.
The writer passes bytes on as they are, so payloads need not be text. Files with a member per record are read as well.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainweave.llm.shingles import slices
from rainweave.session import cut_lineage

RECORD_END = "\r\n\r\n"
SEGMENT_BYTES = 64 << 10
CHUNK_BYTES = 8 << 10
RECORDS_PER_FILE = 1024
REVISIT_BYTES = 1000

RECORD = ("record_id string, record_type string, page_id long, url string, origin_id string, segment int, total_length long, "
          "refers_to long, payload_digest string, block binary, problem string")
PAGE_TYPES = ("response", "revisit", "continuation")


def classify(pages: DataFrame, page_id: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """page_id, url, payload, digest, and for revisits the page whose payload is referred to.

    Of equal payloads of at least REVISIT_BYTES the largest page_id is kept in full. Only the maxima of repeated
    digests are joined back, from a written table, so the optimizer can split a digest that very many pages share. A null body is an empty payload; a row without
    page_id is always kept in full; rows that repeat the largest page_id are all kept in full.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(body).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    newest = cut_lineage(rows.where((F.length("payload") >= REVISIT_BYTES) & F.col("page_id").isNotNull()).groupBy("digest")
                         .agg(F.min("page_id").alias("oldest"), F.max("page_id").alias("newest")).where("oldest < newest").drop("oldest"))
    return rows.join(newest, "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(F.col("newest") > F.col("page_id"), F.col("newest")).alias("refers_to"))


def _cuts(data: bytes, size: int) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while at < end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        yield data[at:end]
        at = end


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in chunked transfer framing."""
    return b"".join(b"%x\r\n%s\r\n" % (len(c), c) for c in _cuts(payload, size)) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; raises ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("a chunk is shorter than its header says")
        out.append(body[at:at + size])
        at += size + 2


def _header(fields: list[tuple[str, object]]) -> bytes:
    lines = ["WARC/1.1"] + [f"{k}: {v}" for k, v in fields if v is not None]
    return "\r\n".join(lines).encode() + RECORD_END.encode()


def _records(page_id, url, payload: bytes, digest: str, refers_to, segment: int) -> Iterator[bytes]:
    name = f"<urn:uuid:{uuid.uuid4()}>"
    common = [("WARC-Date", "1970-01-01T00:00:00Z"),
              ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url is not None else None)]
    page = [("WARC-Page-ID", page_id), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if refers_to is not None:
        yield _header([("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common, *page, ("WARC-Refers-To-Page-ID", refers_to),
                       ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Content-Length", 0)])
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        yield _header([("WARC-Type", "response"), ("WARC-Record-ID", name), *common, *page, ("Content-Length", len(block))]) + block
        return
    parts = list(_cuts(block, segment))
    for k, part in enumerate(parts, 1):
        first, last = k == 1, k == len(parts)
        yield _header([("WARC-Type", "response" if first else "continuation"),
                       ("WARC-Record-ID", name if first else f"<urn:uuid:{uuid.uuid4()}>"), *common, *(page if first else []),
                       ("WARC-Segment-Origin-ID", None if first else name), ("WARC-Segment-Number", k),
                       ("WARC-Segment-Total-Length", len(block) if last else None), ("Content-Length", len(part))]) + part


def write_archives(classified: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Writes the rows of classify() as archives. No file holds more than records_per_file * (segment_bytes + header)."""

    def build(batches):
        for batch in slices(batches, "payload"):
            out, held = [], 0
            for row in zip(*(batch.column(n).to_pylist() for n in ("page_id", "url", "payload", "digest", "refers_to"))):
                for record in _records(*row, segment_bytes):
                    out.append(record)
                    held += len(record)
                if held > 8 << 20:
                    yield pa.record_batch([pa.array(out, pa.binary())], ["value"])
                    out, held = [], 0
            yield pa.record_batch([pa.array(out, pa.binary())], ["value"])

    (classified.mapInArrow(build, "value binary").select(F.col("value").cast("string").alias("value")).write.mode("overwrite").option("lineSep", RECORD_END)
     .option("maxRecordsPerFile", records_per_file).option("compression", "gzip").text(path))


def inflate(data: bytes) -> tuple[bytes, str | None]:
    """The bytes of all gzip members (or the data itself, if not compressed), and what is wrong where they end too early."""
    if data[:2] != b"\x1f\x8b":
        return data, None
    parts = []
    while data:
        member = zlib.decompressobj(31)
        try:
            parts.append(member.decompress(data))
        except zlib.error as error:
            return b"".join(parts), f"broken compression: {error}"
        if not member.eof:
            return b"".join(parts), "archive cut short"
        data = member.unused_data
    return b"".join(parts), None


def _fields(header: bytes) -> dict[str, str]:
    first, *lines = header.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no record begins here")
    out, name = {}, None
    for line in lines:
        if line[:1] in (" ", "\t") and name:  # a folded line
            out[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("a header line without a name")
        name = name.strip().lower()
        out[name] = value.strip()
    return out


def _record(data: bytes, at: int) -> tuple[dict, int]:
    """The record that begins at a place, and where the next one does."""
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise ValueError("a header without an end")
    fields = _fields(data[at:end])
    missing = [k for k in ("warc-type", "warc-record-id", "content-length") if not fields.get(k)]
    if missing:
        raise ValueError(f"a header without {missing[0]}")
    whole = lambda key: int(fields[key]) if fields.get(key) else None
    size = whole("content-length")
    block = data[end + 4:end + 4 + size]
    if size < 0 or len(block) != size or data[end + 4 + size:end + 8 + size] != b"\r\n\r\n":
        raise ValueError("a record is shorter than its header says")
    return {"record_id": fields["warc-record-id"], "record_type": fields["warc-type"].lower(), "page_id": whole("warc-page-id"),
            "url": fields.get("warc-target-uri"), "origin_id": fields.get("warc-segment-origin-id"),
            "segment": whole("warc-segment-number"), "total_length": whole("warc-segment-total-length"),
            "refers_to": whole("warc-refers-to-page-id"),
            "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, "block": block}, end + 8 + size


def parse_archive(data: bytes) -> Iterator[dict]:
    """The records of one archive, compressed or not; whatever cannot be read is a record with nothing but a problem.

    After a broken record, reading goes on at the next line that begins one. Names of header fields are not case sensitive.
    """
    data, wrong = inflate(data)
    at = 0
    while at < len(data):
        try:
            record, at = _record(data, at)
        except ValueError as error:
            after = data.find(b"\r\n\r\nWARC/", at)
            if after >= 0 or not wrong:
                yield {"block": b"", "problem": f"broken record: {error}"}
            if after < 0:
                break
            at = after + 4
            continue
        yield record
    if wrong:
        yield {"block": b"", "problem": wrong}


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives in a folder, continuations still apart (columns of RECORD)."""
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
                        ("origin_id", pa.string()), ("segment", pa.int32()), ("total_length", pa.int64()), ("refers_to", pa.int64()),
                        ("payload_digest", pa.string()), ("block", pa.binary()), ("problem", pa.string())])

    def parse(batches):
        for batch in batches:
            for content in batch.column("content"):
                out, held = [], 0
                for record in parse_archive(content.as_py()):
                    out.append(record)
                    held += len(record["block"])
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, held = [], 0
                yield pa.RecordBatch.from_pylist(out, schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, RECORD)


def reassemble(records: DataFrame) -> DataFrame:
    """One row per response or revisit, and one per unreadable part of an archive: page_id, url, record_type, refers_to, payload_digest (as written), payload, problem.

    Continuations are grouped by their origin, ordered by segment number and checked against the total length; a record
    in one piece is not shuffled. A group holds one record, so its size is that record's. problem names a missing or
    repeated segment, a wrong length, broken framing or a digest that does not match, and is null for a sound record;
    payload is null for a revisit and where there is a problem. Other types of record are left out.
    """
    names = ("page_id", "url", "record_type", "refers_to", "payload_digest")
    unread = records.where(F.col("problem").isNotNull()).select(*names, F.lit(None).cast("binary").alias("payload"), "problem")
    records = records.where(F.col("problem").isNull() & F.col("record_type").isin(*PAGE_TYPES))
    single = records.where(F.col("segment").isNull())
    pieces = records.where(F.col("segment").isNotNull()).select(
        F.coalesce("origin_id", "record_id").alias("origin"), *names, "segment", "total_length", "block")
    opening = F.col("segment") == 1
    joined = pieces.groupBy("origin").agg(
        *(F.max(F.when(opening, F.col(n))).alias(n) for n in names), F.max("total_length").alias("total_length"),
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"))
    rows = single.select(*names, F.lit(None).cast("long").alias("total_length"),
                         F.array(F.struct(F.lit(1).alias("segment"), "block")).alias("parts"), F.lit(False).alias("split"))
    rows = rows.unionByName(joined.select(*names, "total_length", "parts", F.lit(True).alias("split")))

    def decode(batches):
        for batch in batches:
            payloads, problems = [], []
            for kind, digest, total, parts, split in zip(*(batch.column(n).to_pylist() for n in (
                    "record_type", "payload_digest", "total_length", "parts", "split"))):
                payload, problem = None, None
                block = b"".join(p["block"] for p in parts)
                if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)):
                    problem = "segments missing or repeated"
                elif split and total != len(block):
                    problem = "total length differs"
                elif kind == "response":
                    try:
                        head, body = block.split(b"\r\n\r\n", 1)
                        payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                        if digest and hashlib.sha1(payload).hexdigest() != digest:
                            payload, problem = None, "digest differs"
                    except ValueError as error:
                        problem = f"broken framing: {error}"
                payloads.append(payload)
                problems.append(problem)
            yield pa.record_batch([*(batch.column(n) for n in names), pa.array(payloads, pa.binary()), pa.array(problems, pa.string())],
                                  [*names, "payload", "problem"])

    sound = rows.mapInArrow(decode, "page_id long, url string, record_type string, refers_to long, payload_digest string, "
                                    "payload binary, problem string")
    return sound.unionByName(unread)


def resolve_revisits(rows: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, problem: a revisit takes its size from its response."""
    rows = cut_lineage(rows.select("page_id", "record_type", "refers_to", "payload_digest",
                                   F.length("payload").cast("long").alias("payload_bytes"), "problem"))
    wanted = rows.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), "payload_digest").distinct()
    # written, so that the many revisits of one response can be split between tasks
    sizes = cut_lineage(rows.where("record_type = 'response'").join(wanted, ["page_id", "payload_digest"], "left_semi")
                        .groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("kept_bytes")))
    return rows.join(sizes, ["refers_to", "payload_digest"], "left").select(
        "page_id", F.when(F.col("record_type") == "revisit", F.col("kept_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        "payload_digest", "record_type", "refers_to", "problem")
