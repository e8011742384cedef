"""WARC archives: writing with revisit records, and a splittable reader.

Archives are files of gzip members, one record each. Spark's text writer puts them down byte by byte
(its row separator is the zero byte that ends every member of less than 16 MiB; larger records get an
empty member behind them), so any file system that Spark reaches will do. The reader never needs a
whole file in memory: Spark's text reader scans byte ranges for the gzip magic, and a task owns every candidate
member that starts in its range. A candidate is a member if it decompresses to a WARC header; bytes
that merely look like the magic are joined to the member before them, also across ranges, for which
only the few torn pieces are moved.

Defined cases: a NULL payload is empty, a NULL URL is written as no URL. Of rows with equal payloads
of at least ``min_bytes`` those with the largest id are responses and the others revisit it; NULL ids
never are the largest, and where all ids are NULL every row is a response. Shorter payloads are always
responses. Repeated rows give a record each. An empty table gives no records. Records that end before
their stated length are returned with ``truncated`` true. Header fields that cannot be read are NULL and
named in ``error``; a record without a readable length takes all that follows its header. A member whose bytes
are damaged gives a row with nothing but ``error``. Files named ``.gz`` are read as they are, each by one task,
since Hadoop does not split files of that name; any other name is split.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.llm.arrow import add_columns
from loomtext.scratch import materialise
from loomtext.session import ship_package

MAGIC = b"\x1f\x8b\x08"
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
#: Bytes of the shortest gzip header, and of the longest one that is believed.
GZIP_HEADER, LONGEST_HEADER = 10, 4096
VERSION = b"WARC/1."
BATCH_BYTES = 16_000_000
DATE = "1970-01-01T00:00:00Z"
RECORD_SCHEMA = (
    "record_id string, record_type string, url string, payload_digest string, "
    "payload_length bigint, refers_to string, payload binary, truncated boolean, error string"
)
DAMAGED = "damaged member"
#: Has Hadoop hand out the bytes of such files instead of unpacking them by their name.
AS_THEY_ARE = {
    "io.compression.codecs": "org.apache.hadoop.io.compress.PassthroughCodec",
    "io.compress.passthrough.extension": ".gz",
    # The name that the option has in the client that Spark ships.
    "org.apache.hadoop.shaded.io.compress.passthrough.extension": ".gz",
}


def _member(record: bytes) -> bytes:
    """A gzip member without its last byte, which is zero."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = packer.compress(record) + packer.flush()
    if len(record) >= 1 << 24:
        data += EMPTY_MEMBER
    return data[:-1]


def format_record(
    record_id: str,
    kind: str,
    url: str | None,
    payload: bytes,
    length: int,
    sha1: str,
    target: str | None,
) -> bytes:
    """One WARC record. ``sha1`` is hexadecimal; revisits have a header block only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    http += b"Content-Length: %d\r\n\r\n" % length
    block = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:loomtext:{record_id}>"]
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        lines.append(f"WARC-Target-URI: {safe}")
    lines += [
        f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode(),
        f"X-Payload-Length: {length}",
    ]
    if kind == "revisit":
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:loomtext:{target}>",
        ]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(
    pages: DataFrame,
    path: str,
    *,
    record_id: str = "page_id",
    url: str = "url",
    payload: str = "html",
    min_bytes: int = 1000,
) -> None:
    """Writes one record per row to the folder ``path``. Ids are written as text."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col(record_id).alias("id"), F.col(url).alias("url"), body.alias("body")
    ).select(
        "id", "url", "body", F.length("body").cast("long").alias("length"),
        F.sha1("body").alias("sha1"), F.sha2("body", 256).alias("key"),
    )
    long_ones = rows.where(F.col("length") >= min_bytes)
    repeated = materialise(
        long_ones.groupBy("key")
        .agg(F.max("id").alias("target"), F.count("*").alias("n"))
        .where("n > 1 and target is not null")
        .select("key", "target"),
        "repeated-payloads",
    )
    rows = rows.join(repeated, "key", "left")
    revisit = F.col("target").isNotNull() & ~F.col("id").eqNullSafe(F.col("target"))
    rows = rows.select(
        F.col("id").cast("string").alias("id"),
        "url",
        F.when(~revisit, F.col("body")).alias("body"),
        "length",
        "sha1",
        F.when(revisit, F.col("target").cast("string")).alias("target"),
    )

    def compute(batches: Iterator[list[pa.Array]]) -> Iterator[list[pa.Array]]:
        for columns in batches:
            yield [
                pa.array(
                    [
                        _member(
                            format_record(
                                i or "", "response" if to is None else "revisit",
                                u, body or b"", length, sha1, to,
                            )
                        )
                        for i, u, body, length, sha1, to in zip(
                            *[c.to_pylist() for c in columns], strict=True
                        )
                    ],
                    pa.binary(),
                )
            ]

    members = add_columns(rows, [], list(rows.columns), "member binary", compute)
    members.select(F.col("member").cast("string").alias("value")).write.option(
        "lineSep", "\0"
    ).text(path)


def _inflated(data: bytes) -> bytes | None:
    """A whole member's content; None if it is not a whole one."""
    unpacker = zlib.decompressobj(31)
    try:
        content = unpacker.decompress(data)
    except zlib.error:
        return None
    return content if unpacker.eof else None


def _starts_record(data: bytes) -> bool | None:
    """Whether the bytes decompress to a WARC record (or to nothing, as filler); None: too few."""
    if data.startswith(EMPTY_MEMBER):
        return True
    unpacker = zlib.decompressobj(31)
    try:
        head = unpacker.decompress(data[:65536], len(VERSION))
    except zlib.error:
        return False
    if len(head) < len(VERSION) and VERSION.startswith(head) and not unpacker.eof:
        return None if len(data) < LONGEST_HEADER else False
    return head == VERSION


def parse_record(content: bytes) -> tuple | None:
    """The fields of ``RECORD_SCHEMA``; None for filler or records of other types."""
    head, _, block = content.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1."):
        return None
    fields = {}
    for line in head.decode(errors="replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    unread = []

    def number(name: str) -> int | None:
        value = fields.get(name)
        if value is None or value.isdecimal():
            return None if value is None else int(value)
        unread.append(name)
        return None

    stated = number("content-length")
    length = stated if stated is not None else (len(block) if unread else 0)
    _, _, payload = block[:length].partition(b"\r\n\r\n")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    hexed = digest.lower() or None
    if len(digest) == 32:
        try:
            hexed = base64.b32decode(digest, casefold=True).hex()
        except ValueError:
            hexed = None
            unread.append("warc-payload-digest")

    def bare(name: str) -> str | None:
        value = fields.get(name)
        return value and value.strip("<>").removeprefix("urn:loomtext:")

    whole = number("x-payload-length")
    if whole is None and kind == "response":
        whole = len(payload)
    return (
        bare("warc-record-id"), kind, fields.get("warc-target-uri"), hexed, whole,
        bare("warc-refers-to"), payload if kind == "response" else None, len(block) < length,
        f"cannot read {', '.join(unread)}" if unread else None,
    )


NAMES = [field.split()[0] for field in RECORD_SCHEMA.split(", ")]
TYPES = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary(), pa.bool_(), pa.string()]
TORN_SCHEMA = "file string, start bigint, place int, begins boolean, data binary"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes | None, tuple | None]]:
    """Contents of whole members, or torn bytes (file, range, place in range, begins member, bytes).

    Rows hold what lies between two magics of a range, in order.
    """
    block, data, known, place = None, b"", False, 0
    waiting: list[bytes] = []  # candidates of which the first is too short to tell

    def take(more: bool) -> Iterator[tuple]:
        nonlocal data, known, place
        while waiting:
            joined = b"".join(waiting)
            starts = _starts_record(joined)
            if starts is None and more:
                return
            candidate = waiting.pop(0)
            # At the end of a range the undecided starts a member unless one is still open.
            if starts or (starts is None and not data and len(joined) > GZIP_HEADER):
                if data:
                    yield None, (*block, place, known, data)
                    place += 1
                data, known = b"", True
            data += candidate
            if known and (content := _inflated(data)) is not None:
                yield content, None
                data = b""
        if not more and data:
            yield None, (*block, place, known, data)

    for rows in batches:
        for file, start, piece in zip(*[c.to_pylist() for c in rows.columns], strict=True):
            if (file, start) != block:
                yield from take(more=False)
                block, data, known, place = (file, start), b"", False, 0
                if start == 0:
                    continue  # what lies before the first magic of a file
            waiting.append(MAGIC + piece)
            yield from take(more=True)
    yield from take(more=False)


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    arrays = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _torn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
    names = [field.split()[0] for field in TORN_SCHEMA.split(", ")]
    for _, piece in _scan(batches):
        if piece:
            yield _table([piece], names, types)


def _record_table(contents: list[bytes]) -> pa.RecordBatch:
    records = [r for r in map(parse_record, contents) if r]
    return _table(records, NAMES, TYPES)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    contents, size = [], 0
    for content, _ in _scan(batches):
        if content is not None:
            contents.append(content)
            size += len(content)
        if size > BATCH_BYTES:
            yield _record_table(contents)
            contents, size = [], 0
    yield _record_table(contents)


def _mended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        for pieces in rows.column(0).to_pylist():
            try:
                content = zlib.decompressobj(31).decompress(b"".join(p["data"] for p in pieces))
            except zlib.error:
                yield _table([(*[None] * (len(NAMES) - 1), DAMAGED)], NAMES, TYPES)
                continue
            yield _record_table([content])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per response or revisit record of the archives in ``path``, in any order."""
    ship_package(spark)
    pieces = (
        spark.read.options(encoding="ISO-8859-1", **AS_THEY_ARE)
        .option("lineSep", MAGIC.decode("latin-1"))
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.col("value").cast("binary").alias("piece"),
        )
    )
    torn = materialise(pieces.mapInArrow(_torn, TORN_SCHEMA), "torn-members")
    # A torn member is the last bytes of its range and the first bytes of ranges after it.
    by_file = Window.partitionBy("file").orderBy("start", "place")
    mended = (
        torn.withColumn("member", F.sum(F.col("begins").cast("long")).over(by_file))
        .groupBy("file", "member")
        .agg(F.array_sort(F.collect_list(F.struct("start", "place", "data"))).alias("pieces"))
        .select("pieces")
        .mapInArrow(_mended, RECORD_SCHEMA)
    )
    return pieces.mapInArrow(_whole, RECORD_SCHEMA).unionByName(mended)
