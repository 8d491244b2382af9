"""Operator 6: WARC archives of Zstandard frames, written and read through Spark's file formats.

An archive is a skippable frame that holds the dictionary, then one frame for each record, and
an empty skippable frame after each, which readers skip. That separator is plain ASCII, so
Spark's text sink can write the frames as its lines: archives are committed task by task on any
file system that Spark writes to, and a lost executor leaves no partial archive behind.

Reading takes archives as whole binary files, loads the dictionary from the leading skippable
frame, finds each frame's end from its block headers, decodes one frame per record and checks
the version line, the header fields, the content length, and the payload digest and length.

Records with equal payloads of at least ``revisit_from`` bytes: the one with the largest page_id
is a response, the others are revisits of it that carry the HTTP head only. Which payloads
repeat is found by a partial aggregate over SHA-256 digests; payloads that more than 1 in
``HOT`` pages share are few enough (at most HOT) to broadcast, and all others meet by a shuffle.

Cases: a null html is an empty payload. A null url leaves the target header out. Rows that
share the page_id and payload of a response are responses too. A null page_id is written
without an id, sorts below all others, and is never revisited by a row with an id; among
equal payloads with no id at all, all are responses. Empty tables give archives without
records. Columns other than page_id, url and html are ignored. Payloads are never cut.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, halved, portions

#: A payload of more than 1 in so many pages is decided by a broadcast of at most so many rows.
HOT = 1000
#: Frames of an archive, and about the most bytes; a reader holds one archive.
LINES, ARCHIVE_BYTES = 4096, 64 << 20
#: Magic numbers of the Zstandard format and of its use for WARC (fixed values).
FRAME_MAGIC = 0xFD2FB528
SKIPPABLE_MAGIC = 0x184D2A50
DICTIONARY_MAGIC = 0x184D2A5D
#: An empty skippable frame: the magic number 0x184D2A50 and the length zero.
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Text that most records share, for the dictionary.
SAMPLE = (
    b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: https://www.\r\n"
    b"WARC-Payload-Digest: sha1:\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: \r\n\r\nHTTP/1.1 200 OK\r\n"
    b"Content-Type: text/html; charset=utf-8\r\nContent-Length: \r\n\r\n<!DOCTYPE html><html><head><title></title></head><body><p></p></body></html>\r\n\r\n"
)


class ArchiveError(ValueError):
    """An archive that doesn't hold what its headers say."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest(payload)}"))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def skippable(content: bytes, magic: int = DICTIONARY_MAGIC) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


def frame_end(data: memoryview, at: int) -> int:
    """Where a Zstandard frame ends, from its header and the lengths of its blocks."""
    if at + 6 > len(data):
        raise ArchiveError(f"frame header cut off at byte {at}")
    descriptor = data[at + 4]
    single, checksum, dictionary, size = descriptor >> 5 & 1, descriptor >> 2 & 1, descriptor & 3, descriptor >> 6
    at += 5 + (not single) + (0, 1, 2, 4)[dictionary] + (single, 2, 4, 8)[size]
    last = False
    while not last:
        if at + 3 > len(data):
            raise ArchiveError(f"block header cut off at byte {at}")
        block = int.from_bytes(data[at : at + 3], "little")
        last, kind = bool(block & 1), block >> 1 & 3
        if kind == 3:
            raise ArchiveError(f"reserved block type at byte {at}")
        at += 3 + (1 if kind == 1 else block >> 3)
    at += 4 * checksum
    if at > len(data):
        raise ArchiveError("frame runs past the end of the archive")
    return at


def frames(data: memoryview) -> Iterator[bytes]:
    """The decoded frames of one archive."""
    at, decoder, leading = 0, zstandard.ZstdDecompressor(), True
    while at < len(data):
        if at + 8 > len(data):
            raise ArchiveError(f"magic number cut off at byte {at}")
        magic, length = struct.unpack("<II", data[at : at + 8])
        if magic & 0xFFFFFFF0 == SKIPPABLE_MAGIC:
            if at + 8 + length > len(data):
                raise ArchiveError("skippable frame runs past the end of the archive")
            if leading and magic == DICTIONARY_MAGIC:
                content = bytes(data[at + 8 : at + 8 + length])
                if content[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary may be compressed itself
                    content = decoder.decompressobj().decompress(content)
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
            at += 8 + length
        elif magic == FRAME_MAGIC:
            end = frame_end(data, at)
            inflating = decoder.decompressobj()
            try:
                decoded = inflating.decompress(data[at:end])
            except zstandard.ZstdError as e:
                raise ArchiveError(f"frame at byte {at}: {e}") from None
            if not inflating.eof:
                raise ArchiveError(f"frame at byte {at} doesn't end")
            yield decoded
            at = end
        else:
            raise ArchiveError(f"no frame at byte {at}")
        leading = False


def _page(urn: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d*)>", urn)
    if not found:
        raise ArchiveError(f"odd record id {urn}")
    return int(found[1]) if found[1] else None


def parse(raw: bytes) -> dict:
    """Check one record and take it apart."""
    head, blank, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not blank or lines[0] != VERSION:
        raise ArchiveError("no WARC/1.1 header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ArchiveError("header line without a colon")
        fields[name.decode().lower()] = value.strip().decode()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"} - fields.keys()
    if missing:
        raise ArchiveError(f"header without {', '.join(sorted(missing))}")
    length = fields["content-length"]
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ArchiveError(f"the block has {len(rest) - 4} bytes, its header says {length}")
    http, blank, payload = rest[:-4].partition(b"\r\n\r\n")
    said = re.search(rb"(?im)^content-length: *(\d+)\r?$", http)
    if not blank or not said:
        raise ArchiveError("no HTTP head in the block")
    kind, said_digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        if len(payload) != int(said[1]) or digest(payload) != said_digest:
            raise ArchiveError("the payload differs from its length or digest")
    elif kind != "revisit" or payload or "warc-refers-to" not in fields:
        raise ArchiveError(f"odd {kind} record")
    return {
        "page_id": _page(fields["warc-record-id"]),
        "url": fields.get("warc-target-uri"),
        "payload": payload,
        "payload_bytes": int(said[1]),
        "payload_digest": said_digest,
        "record_type": kind,
        "refers_to": _page(fields["warc-refers-to"]) if kind == "revisit" else None,
    }


def with_responses(pages: DataFrame, revisit_from: int = 0, hot: int = HOT) -> DataFrame:
    """Add ``response_id``: the largest page_id among equal payloads, null where there is none."""
    pages = pages.select(F.col("page_id").cast("long"), "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    pages = pages.withColumn("same", F.unhex(F.sha2("payload", 256)))
    groups = pages.where(F.octet_length("payload") >= revisit_from).groupBy("same", halved("same")).agg(F.count("same").alias("n"), F.max("page_id").alias("response_id")).where("n > 1")
    total = pages.count()
    often = groups.where(F.col("n") * hot > total).select("same", "response_id")  # at most ``hot`` rows
    seldom = groups.where(F.col("n") * hot <= total).select("same", "response_id")
    known = pages.join(F.broadcast(often.withColumn("often", F.lit(True))), "same", "left")
    first = known.where("often").drop("often")
    rest = known.where("often is null").drop("often", "response_id").join(seldom, "same", "left")
    return first.unionByName(rest).drop("same")


def write_archives(pages: DataFrame, path: str, revisit_from: int = 0, lines: int = LINES, most_bytes: int = ARCHIVE_BYTES) -> None:
    """Archives as ``path/part-*``, of at most ``lines`` frames, and of about ``most_bytes`` bytes unless one record has more.

    Spark's sink begins a new file after every ``lines`` lines. An archive that is full before that is filled up with empty lines, which
    are empty skippable frames, so that the next line is the first one of a new file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = zstandard.ZstdCompressionDict(SAMPLE, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        encoder = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True)
        leading = skippable(SAMPLE)
        line = size = 0
        for batch in batches:
            for part in portions(batch, "payload", 256):
                made = []
                for i, url, payload, to in zip(*(column(part, c).to_pylist() for c in ("page_id", "url", "payload", "response_id")), strict=True):
                    frame = encoder.compress(record(i, url, payload, to, to is not None and to != i))
                    if line and size + len(frame) > most_bytes:
                        made += [b""] * (lines - line)
                        line = 0
                    if not line:
                        made.append(leading)
                        line, size = 1, len(leading)
                    made.append(frame)
                    line, size = (line + 1) % lines, size + len(frame)
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["frame"])

    framed = with_responses(pages, revisit_from).select("page_id", "url", "payload", "response_id").mapInArrow(run, "frame binary")
    framed.select(F.col("frame").cast("string").alias("value")).write.mode("overwrite").option("lineSep", SEPARATOR).option("maxRecordsPerFile", lines).text(path)


FIELDS = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of every archive; a damaged archive fails the job with an ArchiveError.

    An archive is read as one row, so it has to fit a task: ``write_archives`` bounds them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in column(batch, "content"):
                held, size = [], 0
                for raw in frames(memoryview(content.as_buffer())):
                    held.append(parse(raw))
                    size += len(raw)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema=FIELDS)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema=FIELDS)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
