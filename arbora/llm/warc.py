"""WARC archives: writing with revisits and segments, reading with reassembly.

Spark's text writer stores the archives (raw record bytes, gzip per file), so that they
are committed as any table is; ``binaryFile`` reads them back, one file at a time. The
writer bounds the records per file and the bytes per record, hence the memory of a reader.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.common import delivered, new_path, stored, unique_rows

# Payloads shorter than this are never replaced by a revisit.
LEAST_REVISIT = 100
# Bytes of a block that one record carries; the rest goes into continuation records.
SEGMENT_BYTES = 32 * 1024
CHUNK_BYTES = 4 * 1024
# Pages of one file.
FILE_RECORDS = 2_048

# Fixed values of the format.
VERSION = b"WARC/1.1"
DATE = b"2024-01-01T00:00:00Z"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
REVISIT_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

PARSED = (
    "type string, id string, page_id bigint, url string, digest string, refers string, "
    "origin string, segment int, total bigint, block binary"
)
READ = (
    "page_id bigint, url string, record_id string, record_type string, refers_id string, "
    "payload binary, payload_digest string, problem string"
)


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing of ``payload``."""
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at : at + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """Payload of a body in chunked framing; extensions and trailers are passed over."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(parts)
        piece = body[end + 2 : end + 2 + size]
        if len(piece) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut short")
        parts.append(piece)
        at = end + 4 + size


def record(fields: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    """A record without its last CRLF, which the text writer adds as line separator."""
    fields = [*fields, (b"Content-Length", b"%d" % len(block))]
    return VERSION + b"\r\n" + b"".join(k + b": " + v + b"\r\n" for k, v in fields) + b"\r\n" + block + b"\r\n"


def clean_url(url: str | None, name: bytes) -> bytes:
    """A header value in one line; a null or blank URL becomes the record's own name."""
    raw = (url or "").encode()
    raw = b"".join(b"%%%02X" % c if c < 33 or c == 127 else bytes([c]) for c in raw)
    return raw or name.strip(b"<>")


def record_name(key: int) -> bytes:
    return b"<urn:page:%d>" % key


def page_records(key, page_id, url, payload, digest, first, segment_bytes) -> Iterator[bytes]:
    """The records of a page: a revisit, a response, or a response and its continuations."""
    name = record_name(key)
    fields = [(b"WARC-Record-ID", name), (b"WARC-Date", DATE), (b"WARC-Target-URI", clean_url(url, name))]
    if page_id is not None:
        fields.append((b"WARC-Page-ID", b"%d" % page_id))
    fields += [(b"WARC-Payload-Digest", b"sha256:" + digest), (b"Content-Type", b"application/http; msgtype=response")]
    if first is not None:
        fields += [(b"WARC-Refers-To", record_name(first)), (b"WARC-Profile", PROFILE)]
        yield record([(b"WARC-Type", b"revisit"), *fields], REVISIT_HEAD)
        return
    block = HEAD + chunked(payload)
    if len(block) <= segment_bytes:
        yield record([(b"WARC-Type", b"response"), *fields], block)
        return
    yield record([(b"WARC-Type", b"response"), *fields, (b"WARC-Segment-Number", b"1")], block[:segment_bytes])
    for number, at in enumerate(range(segment_bytes, len(block), segment_bytes), 2):
        part = block[at : at + segment_bytes]
        more = [
            (b"WARC-Type", b"continuation"),
            (b"WARC-Record-ID", b"<urn:page:%d:segment:%d>" % (key, number)),
            (b"WARC-Date", DATE),
            (b"WARC-Target-URI", clean_url(url, name)),
            (b"WARC-Segment-Origin-ID", name),
            (b"WARC-Segment-Number", b"%d" % number),
        ]
        if at + segment_bytes >= len(block):
            more.append((b"WARC-Segment-Total-Length", b"%d" % len(block)))
        yield record(more, part)


def write_archives(
    pages: DataFrame,
    path: str,
    id: str = "page_id",
    url: str = "url",
    html: str = "html",
    segment_bytes: int = SEGMENT_BYTES,
    file_records: int = FILE_RECORDS,
) -> None:
    """Write one page per row of ``pages`` to WARC files in the new folder ``path``.

    A null page is an empty payload. Of pages with equal payloads of at least
    ``LEAST_REVISIT`` bytes the one with the smallest id (null first) is a response, the
    others revisit it. Rows that repeat an id are pages of their own.
    """
    rows = unique_rows(pages.select(id, F.col(url).alias("__url"), html), id, html, "__url")
    payload = F.col("text").cast("binary")
    rows = rows.select(
        "doc", "id", F.col("__url").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest")
    )
    long = rows.where(F.octet_length("payload") >= LEAST_REVISIT)
    groups = long.groupBy("digest").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = stored(groups.where("n > 1").select("digest", "first"))
    rows = delivered(rows, groups, "digest", F.lit(96))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            held = 0
            for row in pa.Table.from_batches([batch]).to_pylist():
                first = row["first"] if row["first"] != row["doc"] else None
                digest = row["digest"].encode()
                for one in page_records(row["doc"], row["id"], row["url"], row["payload"], digest, first, segment_bytes):
                    out.append(one)
                    held += len(one)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    records = rows.mapInArrow(write, "value binary").select(F.col("value").cast("string").alias("value"))
    writer = records.write.option("lineSep", "\r\n").option("compression", "gzip")
    writer.option("maxRecordsPerFile", file_records).text(path)


def split_records(data: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """Header fields (names in lower case) and block of every record of an archive."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].split(b"\r\n")
        if not version.startswith(b"WARC/"):
            raise ValueError("a record doesn't begin with its version")
        fields = {}
        for line in lines:
            name, _, value = line.partition(b":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields[b"content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size:
            raise ValueError("an archive ends inside a record")
        yield fields, block
        at = end + 4 + size


def parsed(spark: SparkSession, path: str, segments: bool) -> DataFrame:
    """Records of all archives in ``path``: those in segments, or those that aren't."""

    def number(fields, name):
        return int(fields[name]) if name in fields else None

    def text(fields, name):
        return fields[name].decode("utf-8", "replace") if name in fields else None

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in PARSED.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int64(), *[pa.string()] * 4, pa.int32(), pa.int64(), pa.binary()]
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                rows, held = [], 0
                for fields, block in split_records(data):
                    if (b"warc-segment-number" in fields) != segments:
                        continue
                    digest = text(fields, b"warc-payload-digest")
                    rows.append((
                        text(fields, b"warc-type"), text(fields, b"warc-record-id"),
                        number(fields, b"warc-page-id"), text(fields, b"warc-target-uri"),
                        digest and digest.removeprefix("sha256:"), text(fields, b"warc-refers-to"),
                        text(fields, b"warc-segment-origin-id"), number(fields, b"warc-segment-number"),
                        number(fields, b"warc-segment-total-length"), block,
                    ))
                    held += len(block)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(parse, PARSED)


def reassembled(records: DataFrame) -> DataFrame:
    """One record per origin, its blocks joined in the order of the segment numbers.

    ``problem`` says when numbers are missing or repeated, or the total length is wrong.
    """
    origin = F.coalesce("origin", "id")
    lead = F.when(F.col("segment") == 1, F.struct("type", "id", "page_id", "url", "digest", "refers"))
    whole = records.groupBy(origin.alias("key")).agg(
        F.max(lead).alias("lead"),
        F.max("total").alias("total"),
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"),
    )
    block = F.array_join(F.transform("parts", lambda p: p["block"].cast("string")), "").cast("binary")
    counted = F.transform("parts", lambda p: p["segment"]) == F.sequence(F.lit(1), F.size("parts"))
    whole = whole.select("lead.*", "total", block.alias("block"), counted.alias("counted"))
    return whole.select(
        "type", "id", "page_id", "url", "digest", "refers", "block",
        F.when(~F.col("counted") | F.col("id").isNull(), "segments are missing or repeated")
        .when(F.col("total").isNull() | (F.octet_length("block") != F.col("total")), "the total length is wrong")
        .alias("problem"),
    )


def decode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payloads of HTTP blocks, with chunked framing undone."""
    for batch in batches:
        payloads, problems = [], []
        for kind, block, problem in zip(*(batch[c].to_pylist() for c in ("type", "block", "problem"))):
            payload = None
            if problem is None and kind != "revisit":
                try:
                    head, mark, body = (block or b"").partition(b"\r\n\r\n")
                    if not mark:
                        raise ValueError("no HTTP head")
                    payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                except ValueError as error:
                    problem = f"the block can't be decoded: {error}"
            payloads.append(payload)
            problems.append(problem)
        yield pa.RecordBatch.from_arrays(
            [
                batch["page_id"], batch["url"], batch["id"], batch["type"], batch["refers"],
                pa.array(payloads, pa.binary()), batch["digest"], pa.array(problems, pa.string()),
            ],
            names=[part.split()[0] for part in READ.split(", ")],
        )


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per page record of the archives in ``path``, plain or gzip, any number.

    Segments are grouped by the origin's identifier wherever they lie, so only records in
    segments are shuffled. Damaged groups stay as rows with their ``problem`` named; a
    payload that doesn't have the digest of its header is one, too. Revisits have no
    payload.
    """
    single = parsed(spark, path, False).drop("origin", "segment", "total")
    single = single.withColumn("problem", F.lit(None).cast("string"))
    both = single.unionByName(reassembled(parsed(spark, path, True)))
    read = both.mapInArrow(decode_batches, READ)
    wrong = F.col("payload").isNotNull() & (F.sha2("payload", 256) != F.col("payload_digest"))
    return read.withColumn("problem", F.when(wrong, "the digest is wrong").otherwise(F.col("problem")))


def page_summary(records: DataFrame) -> DataFrame:
    """Per page: id, bytes and digest of the full payload, record type, page it refers to.

    A revisit takes them from the response that it refers to.
    """
    facts = stored(
        records.select(
            "page_id", "record_id", "record_type", "refers_id", "problem",
            F.octet_length("payload").cast("bigint").alias("payload_bytes"),
            F.sha2("payload", 256).alias("payload_digest"),
        )
    )
    responses = facts.where("record_type = 'response'")
    revisits = facts.where("record_type = 'revisit'")
    origins = responses.select(
        F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest"
    )
    found = revisits.drop("payload_bytes", "payload_digest").join(origins, "refers_id", "left")
    own = responses.withColumn("refers_to", F.lit(None).cast("bigint"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem"]
    return own.select(columns).unionAll(found.select(columns))


def round_trip(pages: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back, one row per page."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, segment_bytes=segment_bytes)
    return page_summary(read_archives(pages.sparkSession, path))
