"""WARC archives of pages: monolithic gzip files, their normaliser and the offset index."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bounded_count, broadcast_within, scratch_path, ship_package, spill

# Payloads of fewer bytes are never replaced by a revisit.
REVISIT_BYTES = 0
# Records of one archive file; a file passes through one task.
RECORDS_PER_FILE = 4000
# Bytes that are inflated, and bytes of members that are passed on, at a time.
CHUNK = 1 << 20

# Fixed values of the WARC 1.1 and gzip formats.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
GZIP_WINDOW = 31
CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"

INDEX = (
    "archive string, offset long, length long, record_id string, record_type string, page_id string, uri string, "
    "payload_bytes long, payload_digest string, refers_to string"
)


def base32_sha1(text: Column) -> Column:
    """Base-32 SHA-1 of a text's UTF-8 bytes: each five hex digits are four base-32 digits."""
    digest = F.sha1(text)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _record_id(digest: Column, page: Column) -> Column:
    key = F.md5(F.concat_ws("-", digest, F.coalesce(page, F.lit("none"))))
    cuts = [F.substring(key, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def write_monolithic(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    revisit_bytes: int = REVISIT_BYTES,
    records_per_file: int = RECORDS_PER_FILE,
) -> None:
    """One record per page as gzip files of a single stream each, written by Spark's text sink.

    The smallest page id of an equal payload (by SHA-1) is the response, others are revisits
    with the HTTP header alone; payloads under ``revisit_bytes`` are all responses. Only
    digests and ids are grouped; html meets the repeated digests in place if a count shows
    them to be few, else by a join that Spark may split.
    """
    rows = pages.select(
        F.col(id_col).alias("id"),
        F.regexp_replace(F.col(url_col).cast("string"), "[\\r\\n]", "").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
    ).withColumn("digest", base32_sha1(F.col("html")))
    repeated = spill(
        rows.where(F.octet_length("html") >= revisit_bytes)
        .groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
        .select("digest", "first"),
        "repeated",
    )
    side = broadcast_within(repeated, bounded_count(repeated, 200_000)).withColumnRenamed("digest", "known")
    joined = rows.join(side, rows["digest"] == side["known"], "left")
    revisit = F.col("known").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    id_text, first_text = F.col("id").cast("string"), F.col("first").cast("string")
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.octet_length("html").cast("string"), F.lit(CRLF * 2),
    )
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    header = F.concat_ws(
        CRLF,
        F.lit(VERSION),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("digest"), id_text)),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, line("WARC-Profile", F.lit(PROFILE))),
        F.when(revisit, line("WARC-Refers-To", _record_id(F.col("digest"), first_text))),
        line("X-Page-Id", id_text),
        F.when(revisit, line("X-Refers-To-Page", first_text)),
        F.lit("Content-Type: application/http;msgtype=response"),
        line("Content-Length", F.octet_length(block).cast("string")),
    )
    # the sink ends every row with a line break: the second of the two that end a record
    record = F.concat(header, F.lit(CRLF * 2), block, F.lit(CRLF))
    writer = joined.select(record.alias("value")).write.option("maxRecordsPerFile", records_per_file)
    writer.option("compression", "gzip").option("lineSep", CRLF).text(path)


def _inflated(data: bytes) -> Iterator[bytes]:
    """The content of gzip data (one stream or several), at most ``CHUNK`` bytes at a time."""
    view, at, stream = memoryview(data), 0, zlib.decompressobj(GZIP_WINDOW)
    while at < len(view):
        piece = bytes(view[at : at + CHUNK])
        at += len(piece)
        full = True
        while piece or full:
            if stream.eof:
                piece = (stream.unused_data + piece).lstrip(b"\0")
                if not piece:
                    break
                stream = zlib.decompressobj(GZIP_WINDOW)
            out = stream.decompress(piece, CHUNK)
            piece, full = stream.unconsumed_tail, len(out) == CHUNK or stream.eof
            yield out
    if not stream.eof and len(view):
        raise ValueError("the archive ends inside its stream")


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split(CRLF)[1:]
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, whole record) of each record of an inflated stream; holds one record at a time."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        while (split := held.find(b"\r\n\r\n")) >= 0:
            fields = _fields(bytes(held[:split]))
            end = split + 4 + int(fields["content-length"]) + 4
            if len(held) < end:
                break
            yield fields, bytes(held[:end])
            del held[:end]
    if held:
        raise ValueError("the archive ends inside a record")


def member(record: bytes) -> bytes:
    """A record as a gzip member of its own whose last byte is zero.

    That byte is the highest of the member's size field, zero below 16 MiB; a longer
    record is followed by a zero byte, which gzip readers skip as padding.
    """
    pack = zlib.compressobj(6, zlib.DEFLATED, GZIP_WINDOW)
    out = pack.compress(record) + pack.flush()
    return out if out[-1] == 0 else out + b"\0"


def _batches(rows: Iterator[tuple], schema: pa.Schema, weight: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[weight] or b"")
        if size >= 8 * CHUNK or len(held) >= 4096:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema)


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1].split(".")[0]


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of whole files: archive name, number, member without its last byte."""
    schema = pa.schema([("archive", pa.string()), ("seq", pa.int64()), ("member", pa.binary())])

    def rows():
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                for n, (_, record) in enumerate(records(_inflated(content.as_buffer()))):
                    yield _name(path.as_py()), n, member(record)[:-1]

    return _batches(rows(), schema, 2)


def _described(archive: str, offset: int, length: int, record: bytes) -> tuple:
    """Index row of a record; size and digest come from the payload itself where it is there."""
    head, _, block = record.partition(b"\r\n\r\n")
    fields = _fields(head)
    http, _, payload = block[:-4].partition(b"\r\n\r\n")
    size = int(_fields(http)["content-length"])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response":
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if found != digest or len(payload) != size:
            raise ValueError(f"payload of {fields['warc-record-id']} differs from its header")
    return (
        archive, offset, length, fields["warc-record-id"], fields["warc-type"], fields.get("x-page-id"),
        fields.get("warc-target-uri"), size, digest, fields.get("x-refers-to-page"),
    )


def _walk(data: pa.Buffer) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of each member of an archive."""
    view, at = memoryview(data), 0
    while at < len(view):
        if view[at] == 0:  # padding after a long member
            at += 1
            continue
        stream, parts, end = zlib.decompressobj(GZIP_WINDOW), [], at
        while not stream.eof:
            piece = view[end : end + CHUNK]
            if not len(piece):
                raise ValueError("the archive ends inside a member")
            parts.append(stream.decompress(piece))
            end += len(piece)
        end -= len(stream.unused_data)
        yield at, end - at, b"".join(parts)
        at = end


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [(n, pa.int64() if t == "long" else pa.string()) for n, t in (c.split() for c in INDEX.split(", "))]
    )
    for batch in batches:
        rows = (
            _described(archive.as_py(), *found)
            for archive, content in zip(batch.column(0), batch.column(1))
            for found in _walk(content.as_buffer())
        )
        yield from _batches(rows, schema, 3)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrites monolithic gzip archives with a gzip member per record; returns their offset index.

    Each file is inflated once as a stream, a chunk at a time, and its members are written
    by Spark's text sink under ``target/archives/archive=<name>`` in the order of the stream: a member goes out
    without its last byte, which is zero, and the sink's line separator is that byte. The
    archives are then read back member by member; every payload is checked against its
    digest, and offsets, lengths and header fields go to ``target/index`` as Parquet.
    Tasks that are lost are run again by Spark and leave no partial file.
    """
    ship_package(spark)
    members = _files(spark, source).select("path", "content").mapInArrow(
        _rewritten, "archive string, seq long, member binary"
    )
    ordered = members.sortWithinPartitions("archive", "seq")
    ordered.select("archive", F.col("member").cast("string").alias("value")).write.partitionBy("archive").option(
        "lineSep", "\0"
    ).text(f"{target}/archives")
    archive = F.regexp_extract("path", "archive=([^/]+)/", 1)
    _files(spark, f"{target}/archives").select(archive.alias("archive"), "content").mapInArrow(
        _indexed, INDEX
    ).write.parquet(f"{target}/index")
    return spark.read.schema(INDEX).parquet(f"{target}/index")


def read_records(spark: SparkSession, target: str, wanted: DataFrame) -> DataFrame:
    """(archive, offset, ``record`` binary) of the index rows ``wanted``, by their offsets alone."""

    def cut(batches):
        schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("record", pa.binary())])
        for batch in batches:
            rows = (
                (archive.as_py(), at["offset"], zlib.decompress(content.as_buffer()[at["offset"] : at["offset"] + at["length"]], GZIP_WINDOW))
                for archive, content, places in zip(*batch.columns)
                for at in places.as_py()
            )
            yield from _batches(rows, schema, 2)

    ship_package(spark)
    places = wanted.groupBy("archive").agg(F.collect_list(F.struct("offset", "length")).alias("places"))
    archive = F.regexp_extract("path", "archive=([^/]+)/", 1)
    files = _files(spark, f"{target}/archives").select(archive.alias("archive"), "content")
    return files.join(places, "archive").select("archive", "content", "places").mapInArrow(
        cut, "archive string, offset long, record binary"
    )


def archived_pages(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = REVISIT_BYTES
) -> DataFrame:
    """Index rows of all pages after writing, normalising and reading back, with ``id_col`` in its own type.

    A null html is an empty payload, a null url or id leaves its header field out (a null
    id is read back as null). Repeated pages with the smallest id are all responses. Line
    breaks in a url are removed. An empty table gives an empty index.
    """
    spark = pages.sparkSession
    kind = pages.schema[id_col].dataType
    whole, target = scratch_path(spark, "warc-whole"), scratch_path(spark, "warc")
    write_monolithic(pages, whole, id_col, url_col, html_col, revisit_bytes)
    index = normalise(spark, whole, target)
    return index.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind)).withColumnRenamed("page_id", id_col)
