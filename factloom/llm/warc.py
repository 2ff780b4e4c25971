"""WARC archives: writing with segmentation and revisit records, and reassembling on reading.

Writing: a payload becomes an HTTP response in chunked transfer framing. A record block longer than SEGMENT bytes is
written as a first segment and continuation records (WARC-Segment-Number, WARC-Segment-Origin-ID, and the total length
on the last). Equal payloads are stored once; the others are revisit records. Spark's text sink writes the files: a
record's terminator, two line ends, is its line separator, and a bound on records bounds a file.

Files are compressed. Reading: files are parsed record by record. Continuations are grouped by their origin identifier, ordered by segment
number and joined; the length is verified against the total, chunked framing is decoded, digests are verified.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_dir, small, staged

SEGMENT, CHUNK, FILE_RECORDS = 16_384, 4_096, 4_096
_LINE = b"\r\n"
_RECORD = "record_id string, record_type string, target string, refers_to string, digest string, origin string, segment int, total long, block binary"
_PAYLOAD = "record_id string, record_type string, target string, refers_to string, digest string, payload binary, problem string"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def frame(payload: bytes, size: int = CHUNK) -> bytes:
    """payload in chunked transfer framing."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(x), x) for x in parts) + b"0\r\n\r\n"


def unframe(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing; chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.index(_LINE, at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != _LINE:
            raise ValueError("a chunk doesn't end where its size says")
        out.append(body[at : at + size])
        at += size + 2


def _head(kind: str, ident: str, fields: dict[str, object], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{ident}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    lines += [f"{k}: {v}" for k, v in fields.items() if v is not None] + [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block


def _clean(x: str | None) -> str | None:
    return None if x is None else " ".join(x.split())


def write_records(ident: str, target: str | None, payload: bytes, refers_to: str | None, segment: int = SEGMENT) -> Iterator[bytes]:
    """The record of one payload, or its segments, without the terminators."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    fields = {"WARC-Target-URI": _clean(target), "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{sha1_base32(payload)}"}
    if refers_to is not None:
        fields |= {"WARC-Refers-To": f"<{refers_to}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Truncated": "length"}
        yield _head("revisit", ident, fields, http)
        return
    block = http + frame(payload)
    if len(block) <= segment:
        yield _head("response", ident, fields, block)
        return
    n = -(-len(block) // segment)
    yield _head("response", ident, fields | {"WARC-Segment-Number": 1}, block[:segment])
    for k in range(1, n):
        more = {"WARC-Segment-Origin-ID": f"<{ident}>", "WARC-Segment-Number": k + 1, "WARC-Segment-Total-Length": len(block) if k == n - 1 else None}
        yield _head("continuation", f"{ident}/{k + 1}", more, block[k * segment : (k + 1) * segment])


def inflate(data: bytes) -> bytes:
    """data, or what it holds if it is gzip: one member, or one for each record."""
    out = []
    while data.startswith(b"\x1f\x8b"):
        z = zlib.decompressobj(31)
        out.append(z.decompress(data))
        data = z.unused_data
    return b"".join(out) or data


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        at = end + 4 + int(fields["content-length"])
        if at > len(data):
            raise ValueError("an archive ends within a record")
        yield fields, data[end + 4 : at]
        while data.startswith(_LINE, at):
            at += 2


def payload_of(block: bytes) -> bytes:
    """The body of an HTTP message, without transfer framing."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(_LINE)[1:])}
    return unframe(body) if fields.get(b"transfer-encoding") == b"chunked" else body


def _ident(x: str | None) -> str | None:
    return x and x.strip("<>")


def _decoded(record: tuple, block: bytes) -> tuple:
    """A row of _PAYLOAD: record is (id, type, target, refers_to, digest)."""
    if record[1] == "revisit":
        return (*record, None, None)
    try:
        payload = payload_of(block)
    except ValueError as e:
        return (*record, None, str(e))
    wrong = record[4] and record[4] != sha1_base32(payload)
    return (*record, payload, "digest" if wrong else None)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])


def _batched(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 200 + sum(len(x) for x in r if isinstance(x, bytes))
        if size > 4 << 20:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def write_archive(pages: DataFrame, path: str, segment: int = SEGMENT) -> None:
    """Write archives of pages (ident, target, payload, refers_to) to path: a record, or its segments, for each row."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for ident, target, payload, refers in zip(*[b.column(i) for i in range(4)]):
                    for x in write_records(ident.as_py(), target.as_py(), payload.as_py() or b"", refers.as_py(), segment):
                        yield (x,)

        return _batched(rows(), "record binary")

    made = pages.select("ident", "target", "payload", "refers_to").mapInArrow(records, "record binary")
    made.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", FILE_RECORDS).option("compression", "gzip").text(path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Rows of _PAYLOAD, one for each logical record: payload null for revisits, problem null if all was verified.

    Records that appear more than once under one identifier are as many rows. A set of segments that is not 1 to n, or
    whose length is not the stated total, is a row with its problem named.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for data in b.column(0):
                    for f, block in parse(inflate(data.as_py())):
                        if "warc-segment-number" not in f and f["warc-type"] in ("response", "revisit"):
                            digest = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
                            yield _decoded((_ident(f["warc-record-id"]), f["warc-type"], f.get("warc-target-uri"), _ident(f.get("warc-refers-to")), digest), block)

        return _batched(rows(), _PAYLOAD)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for data in b.column(0):
                    for f, block in parse(inflate(data.as_py())):
                        if "warc-segment-number" in f:
                            ident = _ident(f["warc-record-id"])
                            digest = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
                            total = f.get("warc-segment-total-length")
                            yield ident, f["warc-type"], f.get("warc-target-uri"), _ident(f.get("warc-refers-to")), digest, _ident(f.get("warc-segment-origin-id")) or ident, int(f["warc-segment-number"]), total and int(total), block

        return _batched(rows(), _RECORD)

    segments = files.mapInArrow(parts, _RECORD)
    # a segment written twice counts once, and tells how often its record appears
    once = segments.groupBy("origin", "segment").agg(F.count(F.lit(1)).alias("times"), *[F.max(c).alias(c) for c in ("total", "block")], *[F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in ("record_type", "target", "refers_to", "digest")])
    whole = once.groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("segment", F.col("block").cast("string").alias("block")))).alias("parts"),
        F.max("total").alias("total"), F.min("times").alias("times"), *[F.max(c).alias(c) for c in ("record_type", "target", "refers_to", "digest")],
    )
    block = F.array_join(F.transform("parts", lambda p: p.block), "").cast("binary")
    numbers = F.transform("parts", lambda p: p.segment)
    whole = whole.select("origin", "record_type", "target", "refers_to", "digest", block.alias("block"), "total", "times", (numbers == F.sequence(F.lit(1), F.size("parts"))).alias("in_order"))
    whole = whole.withColumn("problem", F.when(~F.col("in_order"), "segments missing").when(F.col("total").isNull() | (F.octet_length("block") != F.col("total")), "total length"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for *record, block, problem, times in zip(*[c for c in b.columns]):
                    record = tuple(x.as_py() for x in record)
                    row = (*record, None, problem.as_py()) if problem.is_valid else _decoded(record, block.as_py())
                    for _ in range(times.as_py()):
                        yield row

        return _batched(rows(), _PAYLOAD)

    columns = ("origin", "record_type", "target", "refers_to", "digest", "block", "problem", "times")
    return files.mapInArrow(alone, _PAYLOAD).unionByName(whole.select(*columns).mapInArrow(joined, _PAYLOAD))


def round_trip(pages: DataFrame, least: int = 0, segment: int = SEGMENT) -> DataFrame:
    """Write pages (page_id, url, html) to archives and read them back.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to and problem, one row for each row of pages.
    Of equal payloads of at least `least` bytes the smallest page_id is a response and the others revisit it; rows that
    repeat that page_id are responses too. A null html is an empty payload; a null page_id comes back null and is a
    response only where no row of the group has an id. Extra columns are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("_key", F.sha2("payload", 256))
    first = rows.groupBy("_key").agg(F.min("page_id").alias("first")).withColumnRenamed("_key", "_of")
    # narrow: which rows revisit which page. Payloads don't move.
    large = F.octet_length("payload") >= least
    copies = rows.filter(large).select("page_id", "_key").join(first, F.col("_key") == F.col("_of")).filter(~F.col("page_id").eqNullSafe(F.col("first")))
    copies = copies.groupBy("page_id", "_key").agg(F.first("first").alias("first")).select(F.col("page_id").alias("_id"), F.col("_key").alias("_of"), "first")
    copies = staged(copies, "copies")
    linked = rows.join(small(copies.hint("shuffle_hash"), copies.count()), F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_of")), "left")
    urn = lambda c, key: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(":"), F.substring(key, 1, 16))
    path = shared_dir(spark, "warc")
    write_archive(linked.select(urn(F.col("page_id"), F.col("_key")).alias("ident"), F.col("url").alias("target"), "payload", F.when(F.col("first").isNotNull(), urn(F.col("first"), F.col("_key"))).alias("refers_to")), path, segment)
    back = read_archive(spark, path).select("record_id", "record_type", "refers_to", "digest", "problem", F.octet_length("payload").cast("long").alias("own"))
    page = lambda c: F.expr(f"try_cast(split({c}, ':')[2] as bigint)")
    # a revisit has its length from the response that it names
    sizes = back.filter("record_type = 'response'").groupBy(F.col("record_id").alias("_to")).agg(F.max("own").alias("_full"))
    full = back.join(sizes, F.col("refers_to") == F.col("_to"), "left")
    missing = (F.col("record_type") == "revisit") & F.col("_full").isNull()
    return full.select(
        page("record_id").alias("page_id"), F.coalesce("own", "_full").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type",
        page("refers_to").alias("refers_to"), F.coalesce("problem", F.when(missing, "dangling")).alias("problem"),
    )
