"""WARC archives in Zstandard: one frame a record, the dictionary in a leading skippable frame.

An archive is the dictionary frame, then a frame for each record, up to
``ARCHIVE_BYTES`` (a longer record is an archive of its own). Spark's text writer
stores each archive as a file of one row, with an empty skippable frame as the
line separator, which every Zstandard reader passes over; so archives can live
in any file system that Spark can write. The reader takes the dictionary from
the first frame, decodes each record's frame by itself, and checks the version
line, the header names, ``Content-Length`` and, where a payload is stored, its
length and SHA-1. What breaks the format becomes a row with an ``error``: a bad
record alone, a bad frame with the rest of its archive.

Records with equal payloads of at least ``min_revisit_bytes`` are stored once:
the one with the largest id is ``response``, the others ``revisit`` it. Digests
and leaders move over narrow rows; each page crosses the network once, by id.

Defined cases: a null html is an empty payload; a null url leaves the target
header out; rows with a null id are responses and lead nothing; a repeated row
of a leader is a response too; an empty table writes no record; pages of any
length are stored whole (Zstandard and Spark hold up to 2 GB in a value); extra
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import durable, shared_dir

# Frame magics of Zstandard and of its dictionary extension.
FRAME, DICT_FRAME = 0xFD2FB528, 0x184D2A5D
#: A block of one repeated byte, which is stored once.
RUN_BLOCK = 1
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
#: An empty skippable frame, written between rows.
SEPARATOR = struct.pack("<II", 0x184D2A50, 0).decode("ascii")
MIN_REVISIT_BYTES = 1000
#: Bytes of frames after which a task closes an archive and opens the next.
ARCHIVE_BYTES = 32 << 20
#: Bounds of the sample that the dictionary is trained on.
DICT_PAGES, DICT_PAGE_CHARS, DICT_BYTES = 256, 4096, 32 << 10
CREATED = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary trained on the samples; raw content of them if they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def dict_frame(data: bytes) -> bytes:
    return struct.pack("<II", DICT_FRAME, len(data)) + data


def header_value(text: str) -> str:
    """Controls and blanks are percent-encoded, so a value can't end its line."""
    return "".join(c if 0x20 < ord(c) != 0x7F else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def encode_record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    """A WARC record. A revisit keeps the length and digest of the payload, not the payload."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    name = lambda i: f"<urn:inkwell:page:{'null' if i is None else i}>"
    head = [("WARC-Type", kind), ("WARC-Record-ID", name(page_id)), ("WARC-Date", CREATED)]
    if url is not None:
        head.append(("WARC-Target-URI", header_value(url)))
    head += [("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")]
    if kind == "revisit":
        head += [("WARC-Refers-To", name(refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
    head.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


class BadRecord(ValueError):
    """A record or frame that breaks the format."""


def _headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.decode("utf-8").split("\r\n"):
        key, colon, value = line.partition(":")
        if not colon or not key.strip():
            raise BadRecord(f"bad header line {line[:80]!r}")
        out[key.strip().lower()] = value.strip()
    return out


def decode_record(raw: bytes) -> dict:
    """Fields of a record, after its headers and lengths have been checked."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not gap or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise BadRecord("no version line or no end of headers")
    h = _headers(lines)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in h:
            raise BadRecord(f"{name} is missing")
    if not h["content-length"].isdigit() or len(rest) != int(h["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise BadRecord("the block's length is not Content-Length")
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    status, _, lines = http.partition(b"\r\n")
    if not gap or not status.startswith(b"HTTP/"):
        raise BadRecord("no HTTP response in the block")
    length = _headers(lines).get("content-length", "")
    method, _, digest = h.get("warc-payload-digest", "").partition(":")
    if not length.isdigit() or method != "sha1":
        raise BadRecord("no length or digest of the payload")
    digest = base64.b32decode(digest)
    if h["warc-type"] == "response":
        if len(payload) != int(length) or hashlib.sha1(payload).digest() != digest:
            raise BadRecord("the payload's length or digest differs from its header")
    elif h["warc-type"] != "revisit" or payload or "warc-refers-to" not in h:
        raise BadRecord(f"unexpected record of type {h['warc-type']!r}")
    number = lambda x: None if x is None or x.endswith(":null>") else int(x.rpartition(":")[2][:-1])
    return {
        "page_id": number(h["warc-record-id"]), "url": h.get("warc-target-uri"), "payload": payload if h["warc-type"] == "response" else None, "payload_bytes": int(length),
        "payload_digest": digest.hex(), "record_type": h["warc-type"], "refers_to": number(h.get("warc-refers-to")),
    }


def frame_end(data: bytes, at: int) -> int:
    """Where the frame that begins at ``at`` ends, by the sizes in its header and in those of its blocks; nothing is decoded."""
    flags = data[at + 4] if at + 4 < len(data) else 0
    single, checksum = flags >> 5 & 1, flags >> 2 & 1
    at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
    while at + 3 <= len(data):
        block = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if block >> 1 & 3 == RUN_BLOCK else block >> 3)
        if block & 1:  # the last one
            at += 4 * checksum
            break
    else:
        raise BadRecord("the archive ends within a frame")
    if at > len(data):
        raise BadRecord("the archive ends within a frame")
    return at


def frames(data: bytes) -> Iterator[bytes]:
    """The decoded record frames of an archive, each cut out by the sizes of its blocks, so that an archive is read once."""
    at, decoder, first = 0, zstandard.ZstdDecompressor(), True
    while at < len(data):
        if len(data) - at < 8:
            raise BadRecord("the archive ends within a frame")
        magic, size = struct.unpack_from("<II", data, at)
        if magic in SKIPPABLE:
            if at + 8 + size > len(data):
                raise BadRecord("the archive ends within a skippable frame")
            if magic == DICT_FRAME:
                if not first:
                    raise BadRecord("the dictionary is not the first frame")
                raw = data[at + 8 : at + 8 + size]
                if raw[:4] == struct.pack("<I", FRAME):  # a dictionary may itself be compressed
                    raw = zstandard.ZstdDecompressor().decompress(raw)
                if raw:
                    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            at, first = at + 8 + size, False
            continue
        if magic != FRAME:
            raise BadRecord(f"no frame at byte {at}")
        first = False
        end = frame_end(data, at)
        frame = data[at:end]
        one = decoder.decompressobj()
        raw = one.decompress(frame)
        if not one.eof or one.unused_data:
            raise BadRecord("the frame's blocks and its content end apart")
        if zstandard.frame_content_size(frame) not in (-1, len(raw)):
            raise BadRecord("the frame's content size differs")
        at = end
        yield raw


def read_archive(data: bytes) -> Iterator[dict]:
    """The records of an archive; the first one that breaks the format raises."""
    return map(decode_record, frames(data))


def scan_archive(data: bytes) -> Iterator[dict]:
    """The records of an archive, and an ``error`` for each one, and for the frame, that breaks the format."""
    each = frames(data)
    while True:
        try:
            raw = next(each, None)
        except (BadRecord, zstandard.ZstdError) as e:
            yield {"error": str(e)}
            return
        if raw is None:
            return
        try:
            yield decode_record(raw)
        except (ValueError, KeyError) as e:
            yield {"error": str(e)}


def with_record_types(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``id``, ``url``, ``html``, ``kind`` and ``refers_to`` of each page."""
    base = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    long_ = base.where(F.octet_length("html") >= min_revisit_bytes).select("id", F.sha1(F.col("html").cast("binary")).alias("digest"))
    leader = durable(long_.groupBy("digest").agg(F.max("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    follows = long_.join(leader, "digest").where("id < refers_to").select("id", "digest", "refers_to").distinct()
    own = F.xxhash64("id", "digest")
    follows = follows.select(F.col("id").alias("f_id"), F.col("digest").alias("f_digest"), own.alias("f_spread"), "refers_to")
    typed = base.withColumn("digest", F.when(F.octet_length("html") >= min_revisit_bytes, F.sha1(F.col("html").cast("binary"))))
    # short pages and null ids follow nothing; dealt by their place, they do not meet in one task
    typed = typed.withColumn("spread", F.when(F.col("id").isNotNull() & F.col("digest").isNotNull(), own).otherwise(F.monotonically_increasing_id()))
    both = typed.join(follows, (F.col("spread") == F.col("f_spread")) & (F.col("id") == F.col("f_id")) & (F.col("digest") == F.col("f_digest")), "left")
    return both.select("id", "url", "html", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("kind"), "refers_to")


def _archives(batches: Iterator[pa.RecordBatch], dictionary: bytes, level: int, archive_bytes: int) -> Iterator[pa.RecordBatch]:
    """Archives, one a row."""
    compressor = zstandard.ZstdCompressor(level=level, write_content_size=True, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    parts: list[bytes] = []
    size = 0

    def close() -> pa.RecordBatch:
        nonlocal size
        row = pa.RecordBatch.from_arrays([pa.array([b"".join([dict_frame(dictionary), *parts])], pa.binary())], ["archive"])
        parts.clear()
        size = 0
        return row

    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            for r in batch.slice(i, 256).to_pylist():
                frame = compressor.compress(encode_record(r["id"], r["url"], r["html"].encode(), r["kind"], r["refers_to"]))
                if parts and size + len(frame) > archive_bytes:
                    yield close()
                parts.append(frame)
                size += len(frame)
    if parts:
        yield close()


def sample_dictionary(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> bytes:
    """The dictionary for a table: trained on the pages of the smallest id hashes. Only hashes are ranked, then those pages are read."""
    key = F.xxhash64(F.col(id_col).cast("long"))
    keys = [r.k for r in pages.select(key.alias("k")).distinct().orderBy("k").limit(DICT_PAGES).collect()]
    if not keys:
        return b""
    rows = pages.where(key <= keys[-1]).select(key.alias("k"), F.substring(html_col, 1, DICT_PAGE_CHARS).alias("html")).limit(2 * DICT_PAGES).collect()
    return train_dictionary([r.html.encode() for r in sorted(rows, key=lambda r: (r.k, r.html or "")) if r.html])


def write_archives(typed: DataFrame, path: str, dictionary: bytes = b"", level: int = 3, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write records from ``with_record_types`` as archives below ``path``, as many for each task as its bytes need."""
    rows = typed.mapInArrow(lambda batches: _archives(batches, dictionary, level, archive_bytes), "archive binary")
    rows.select(F.col("archive").cast("string")).write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below ``path``; ``error`` is null but for what breaks the format."""
    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, error string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("error", pa.string())])
        for batch in batches:
            for k in range(batch.num_rows):
                rows, size = [], 0
                for r in scan_archive(batch.column(0)[k].as_py()):
                    rows.append(r)
                    size += len(r.get("payload") or b"")
                    if len(rows) == 256 or size > ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, kind)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kind)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(read, schema)


def archive_round_trip(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES, **options) -> DataFrame:
    """Write every page, read the archives back, and return the records."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/inkwell-warc-{uuid.uuid4().hex}"
    write_archives(with_record_types(pages, **options), path, sample_dictionary(pages, options.get("id_col", "page_id"), options.get("html_col", "html")), archive_bytes=archive_bytes)
    return read_archives(spark, path)
