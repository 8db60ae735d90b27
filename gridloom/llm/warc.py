"""WARC archives: writing with segmentation, chunked framing and revisits; reading with segment reassembly.

`write` gives a record per page. Of pages with equal payloads of at least `revisit_from` bytes, the one with the
largest page_id is a response and the others are revisits without a body. Payloads are framed as chunked transfers;
blocks longer than `segment` bytes are cut into a first record and continuation records.

`read` parses archives by content length, groups continuation records by WARC-Segment-Origin-ID, orders them by
WARC-Segment-Number, verifies that the numbers run from 1 and that the block has WARC-Segment-Total-Length bytes,
decodes the chunked framing, and compares the payload's SHA-1 with the one stated (in hex or base 32). Only segmented
records are shuffled. A record that fails a check has complete = false and a null payload; one without its last segment
(which holds the total) fails too.

A record's id names its page and a number of its own; a revisit refers to its response by that record's id. The number
is of the row in the scan, so a DataFrame whose rows come in another order each time it is run must be written first.

A null html is an empty payload; a null page_id is always a response; rows repeated in full give a record each. Extra
columns are ignored. An empty table gives no record. Archives roll after `records_per_file` records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import prepare, scratch, written

SEGMENT, CHUNK, REVISIT_FROM, RECORDS_PER_FILE = 8192, 2048, 1000, 2000
#: Bytes of records that are given out at a time when archives are read.
SLICE = 16 << 20
RECORD = "record_id string, record_type string, target_uri string, refers_to string, digest string, payload_length long, origin_id string, segment int, total_length long, block binary"
_STATUS = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def chunked(payload: bytes, chunk: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(p := payload[i : i + chunk]), p) for i in range(0, len(payload), chunk)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(framed: bytes) -> bytes | None:
    """The payload; None where the framing is broken or ends early. Extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = framed.find(b"\r\n", at)
        size = framed[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9a-fA-F]+", size):
            return None
        n, at = int(size, 16), end + 2
        if not n:
            return b"".join(out)
        if framed[at + n : at + n + 2] != b"\r\n":
            return None
        out.append(framed[at : at + n])
        at += n + 2


def http_payload(block: bytes | None) -> bytes | None:
    """The body of an HTTP response block, chunked framing decoded."""
    head, gap, body = (block or b"").partition(b"\r\n\r\n")
    if not gap:
        return None
    coded = re.search(rb"(?im)^transfer-encoding:.*\bchunked\b", head)
    return dechunked(body) if coded else body


def _head(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block


def record_name(page_id, uid) -> str:
    return f"<urn:gridloom:record:{'' if page_id is None else page_id}:{uid}>"


def page_records(page_id, uid, url, payload: bytes, digest: str, refers_to, segment: int = SEGMENT) -> bytes:
    """All records of a page, less the last record's last line end."""
    name = record_name(page_id, uid)
    uri = None if url is None else re.sub(r"[\r\n]+", " ", url)
    fields = [("WARC-Record-ID", name), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", uri)]
    known = [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Payload-Length", len(payload))]
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        return _head([("WARC-Type", "revisit"), *fields, *known, ("WARC-Profile", profile), ("WARC-Refers-To", refers_to)], b"") + b"\r\n"
    block = _STATUS + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    if len(parts) == 1:
        return _head([("WARC-Type", "response"), *fields, *known], block) + b"\r\n"
    out = [_head([("WARC-Type", "response"), *fields, *known, ("WARC-Segment-Number", 1)], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", len(block))] if k == len(parts) else []
        out.append(_head([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}:{k}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", uri), ("WARC-Segment-Number", k), ("WARC-Segment-Origin-ID", name), *last], part))
    return b"\r\n\r\n".join(out) + b"\r\n"


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", segment: int = SEGMENT, revisit_from: int = REVISIT_FROM, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write the pages' records as gzipped archives into the folder `path`."""
    prepare(pages.sparkSession)
    html = F.coalesce(F.col(html_col).cast("string").cast("binary"), F.lit(b""))
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("payload"))
    pages = pages.withColumn("digest", F.sha1("payload")).withColumn("uid", F.monotonically_increasing_id())
    sums = written(pages.filter(F.length("payload") >= revisit_from).select("page_id", "uid", "digest"), "digests")
    # only payloads that occur more than once are joined, so most runs broadcast this table
    latest = F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "uid")))
    twice = written(sums.groupBy("digest").agg(latest.alias("latest"), F.count("*").alias("n")).filter("n > 1 and latest is not null").select("digest", "latest"), "copies")
    name = F.concat(F.lit("<urn:gridloom:record:"), F.col("latest.page_id").cast("string"), F.lit(":"), F.col("latest.uid").cast("string"), F.lit(">"))
    pages = pages.join(twice, "digest", "left").withColumn("refers_to", F.when(F.col("page_id") < F.col("latest.page_id"), name))

    def run(batches):
        for x in batches:
            rows = zip(*(c.to_pylist() for c in x.columns), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([page_records(*r, segment) for r in rows], pa.binary())], names=["record"])

    records = pages.select("page_id", "uid", "url", "payload", "digest", "refers_to").mapInArrow(run, "record binary")
    # the line end that the writer puts after each row is the last one of the record
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse(data: bytes):
    """The records of an archive, plain or gzipped (any number of members): (fields lower-cased, block). What is
    no record gives no fields and no block, and reading goes on at the next line that begins one."""
    if data[:2] == b"\x1f\x8b":
        out = []
        while data[:2] == b"\x1f\x8b":
            member = zlib.decompressobj(31)
            try:
                out.append(member.decompress(data) + member.flush())
            except zlib.error:
                out.append(b"damaged member")
                data = data[data.find(b"\x1f\x8b\x08", 2) :] if data.find(b"\x1f\x8b\x08", 2) > 0 else b""
                continue
            data = member.unused_data
        data = b"".join([*out, data.strip(b"\0")])
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            yield {}, None
            at = data.find(b"\nWARC/", at) + 1
            if not at:
                return
            continue
        fields = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            fields[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
        size = _number(fields.get("content-length")) or 0
        block = data[end + 4 : end + 4 + size]
        at = end + 4 + size
        yield fields, block if len(block) == size else None
        while data.startswith(b"\r\n", at):
            at += 2


def _number(x: str | None) -> int | None:
    return int(x) if x is not None and x.isdigit() else None


def said_so(payload: bytes, digest: str | None) -> bool:
    """Whether the payload has the digest stated; other digests than SHA-1, and none, can't be compared."""
    kind, _, value = (digest or "").partition(":")
    if kind.lower() != "sha1":
        return True
    found = hashlib.sha1(payload).digest()
    return value.lower() == found.hex() or value.upper() == base64.b32encode(found).decode()


def records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record in the archives below `path`, segments not yet joined."""

    def run(batches):
        for x in batches:
            for content in x.column(0):
                rows, size = [], 0
                for f, block in parse(content.as_py()):
                    digest = f.get("warc-payload-digest")
                    rows.append((f.get("warc-record-id"), f.get("warc-type"), f.get("warc-target-uri"), f.get("warc-refers-to"), digest, _number(f.get("warc-payload-length")), f.get("warc-segment-origin-id"), _number(f.get("warc-segment-number")), _number(f.get("warc-segment-total-length")), block))
                    size += len(block or b"") + 1000
                    if size > SLICE:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    names = [c.split()[0] for c in RECORD.split(", ")]
    types = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]] for c in RECORD.split(", ")]
    prepare(spark)
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,warc}").load(path).select("content").mapInArrow(run, RECORD)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, segments joined: record_id, record_type, target_uri, refers_to, digest, payload_length, payload, complete."""
    found = records(spark, path)
    about = ["record_id", "record_type", "target_uri", "refers_to", "digest", "payload_length"]
    whole = found.filter("segment is null").select(*about, "block", F.col("block").isNotNull().alias("complete"))
    part = found.filter("segment is not null").withColumn("first", F.struct(*about))
    joined = (
        part.groupBy(F.coalesce("origin_id", "record_id").alias("origin"))
        .agg(F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"), F.max("total_length").alias("total"), F.max(F.when(F.col("segment") == 1, F.col("first"))).alias("first"))
        .withColumn("block", F.expr("aggregate(parts, cast('' as binary), (a, x) -> concat(a, x.block))"))
        .withColumn("complete", F.expr("first is not null and transform(parts, x -> x.segment) = sequence(1, size(parts)) and coalesce(length(block) = total, false)"))
        .select("first.*", F.expr("if(complete, block, null)").alias("block"), "complete")
    )

    def run(batches):
        for x in batches:
            n = len(x.schema)
            bodies = [http_payload(b) if kind == "response" else None for kind, b in zip(x.column(1).to_pylist(), x.column(n - 2).to_pylist(), strict=True)]
            good = [ok and (kind != "response" or (body is not None and said_so(body, digest))) for ok, kind, body, digest in zip(x.column(n - 1).to_pylist(), x.column(1).to_pylist(), bodies, x.column(4).to_pylist(), strict=True)]
            bodies = [b if g else None for b, g in zip(bodies, good, strict=True)]
            yield pa.RecordBatch.from_arrays([*x.columns[: n - 2], pa.array(bodies, pa.binary()), pa.array(good, pa.bool_())], names=[*about, "payload", "complete"])

    return whole.unionByName(joined).mapInArrow(run, ", ".join(f"{c} {'long' if c == 'payload_length' else 'string'}" for c in about) + ", payload binary, complete boolean")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "archives")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    out = read(spark, path)
    response = F.col("record_type") == "response"
    number = lambda c: F.regexp_extract(c, r"record:(-?\d+):", 1)
    return out.select(
        F.nullif(number(F.col("record_id")), F.lit("")).cast("long").alias("page_id"),
        F.when(response, F.length("payload")).otherwise(F.col("payload_length")).cast("long").alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.regexp_extract("digest", "^sha1:(.*)$", 1)).alias("payload_digest"),
        "record_type",
        F.nullif(number(F.col("refers_to")), F.lit("")).cast("long").alias("refers_to"),
    )


OP1_SQL = """
with p as (select page_id, coalesce(html, '') as h from pages),
     m as (select h, max(page_id) as latest from p where strlen(h) >= 1000 group by h)
select page_id, cast(strlen(p.h) as bigint) as payload_bytes, sha1(p.h) as payload_digest,
       case when page_id < latest then 'revisit' else 'response' end as record_type,
       case when page_id < latest then latest end as refers_to
from p left join m on p.h = m.h
"""
