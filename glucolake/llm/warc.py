"""WARC archives in Zstandard: one frame a record, a dictionary in a leading skippable frame.

*Writing.*  Each partition makes archives of about ``ARCHIVE_BYTES``: for each it trains a
dictionary on a bounded sample of the archive's first payloads and yields one binary row, a
skippable frame with the dictionary and then one frame per record.  Spark's text writer lays
rows down, one to a file (through its committer and any file system it knows), with an empty
skippable frame as line separator, so a part file is a valid archive, byte for byte.

*Reading.*  Archives come in as binary files, so one must be below 2 GB.  The dictionary is
loaded from the leading skippable frame (itself compressed or not), frames are found by walking
their block headers, each frame is decoded by itself, and record and HTTP headers, lengths and
digests are checked.

Null payloads count as empty.  Records with equal payloads: the least id is the response, the
others revisit it; rows that share that id are all responses; null ids come last.  Empty tables
make no record.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glucolake.llm.shared import batched, fresh_path, steps, texts_of, written

#: Fixed values of the Zstandard format and of its use for WARC.
FRAME_MAGIC, DICTIONARY_MAGIC, SKIPPABLE_MAGIC = 0xFD2FB528, 0x184D2A5D, 0x184D2A50
#: An empty skippable frame; all its bytes are ASCII, so a text writer can put it between rows.
SEPARATOR = struct.pack("<II", SKIPPABLE_MAGIC, 0)
#: Bound of the sample a dictionary is trained on, and of the dictionary.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 256, 1 << 20, 16 << 10, 3
#: Bytes of records from which an archive is closed.
ARCHIVE_BYTES = 32 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"


class ArchiveError(ValueError):
    """An archive, record or header is not what it should be."""


@dataclass
class Record:
    kind: str
    record_id: str
    headers: dict[str, str]
    http_headers: dict[str, str]
    payload: bytes
    payload_digest: str
    payload_length: int
    refers_to: str | None


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(record_id: str, url: str, payload: bytes, refers_to: str | None = None) -> bytes:
    """A response with the payload, or with ``refers_to`` a revisit without it, whose HTTP header still tells the payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', '', url)}", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}",
        *([f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"] if refers_to is not None else []),
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", "",
    ]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def dictionary_frame(content: bytes, compress: bool = True) -> bytes:
    data = zstd.ZstdCompressor(level=LEVEL).compress(content) if compress and content else content
    return struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data


def trained(samples: list[bytes]) -> bytes:
    """A dictionary of a bounded sample; empty where there is too little to learn from."""
    try:
        return zstd.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstd.ZstdError:
        return b""


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at ``at`` ends, by its own headers."""
    if len(data) < at + 8:
        raise ArchiveError("a frame is cut short")
    magic = int.from_bytes(data[at : at + 4], "little")
    if magic & ~0xF == SKIPPABLE_MAGIC:
        end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
    elif magic == FRAME_MAGIC:
        flags = data[at + 4]
        single = flags >> 5 & 1
        end = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
        last = False
        while not last:
            if len(data) < end + 3:
                raise ArchiveError("a frame is cut short")
            head = int.from_bytes(data[end : end + 3], "little")
            last = bool(head & 1)
            end += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        end += 4 * (flags >> 2 & 1)
    else:
        raise ArchiveError(f"no frame begins at byte {at}")
    if end > len(data):
        raise ArchiveError("a frame is cut short")
    return end


def _headers(lines: list[bytes], what: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip() or name != name.strip():
            raise ArchiveError(f"bad {what} header: {line[:80]!r}")
        out[name.decode("ascii", "replace").lower()] = value.strip().decode("utf-8", "replace")
    return out


def parse(data: bytes) -> Record:
    """The record of one decoded frame; raises ``ArchiveError`` unless headers, lengths and digests hold."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise ArchiveError("a frame has no WARC record")
    h = _headers(lines[1:], "WARC")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in h:
            raise ArchiveError(f"a record has no {name}")
    if not h["content-length"].isdigit() or len(rest) != int(h["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ArchiveError(f"{h['warc-record-id']}: its block isn't {h['content-length']} bytes long")
    block = rest[:-4]
    if (d := h.get("warc-block-digest")) and d != f"sha1:{digest(block)}":
        raise ArchiveError(f"{h['warc-record-id']}: its block doesn't match its digest")
    http, payload, kind = {}, block, h["warc-type"]
    if h.get("content-type", "").startswith("application/http"):
        top, gap, payload = block.partition(b"\r\n\r\n")
        status, *more = top.split(b"\r\n")
        if not gap or not re.match(rb"HTTP/\d\.\d \d{3}", status):
            raise ArchiveError(f"{h['warc-record-id']}: its block is no HTTP response")
        http = _headers(more, "HTTP")
    length = int(http.get("content-length", len(payload)))
    told = h.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "revisit":
        if payload or not told or "warc-refers-to" not in h:
            raise ArchiveError(f"{h['warc-record-id']}: a revisit needs a digest, a record it refers to and no payload")
    else:
        if length != len(payload):
            raise ArchiveError(f"{h['warc-record-id']}: its payload isn't {length} bytes long")
        if told and told != digest(payload):
            raise ArchiveError(f"{h['warc-record-id']}: its payload doesn't match its digest")
        told = told or digest(payload)
    refers = h.get("warc-refers-to")
    return Record(kind, h["warc-record-id"].strip("<>"), h, http, payload, told, length, refers and refers.strip("<>"))


def records(archive: bytes) -> Iterator[Record]:
    """Records of an archive's frames, in order."""
    data, at = memoryview(archive), 0
    plain = zstd.ZstdDecompressor()
    decoder, first = plain, True
    while at < len(data):
        end = frame_end(data, at)
        magic = int.from_bytes(data[at : at + 4], "little")
        if magic == DICTIONARY_MAGIC and first:
            content = bytes(data[at + 8 : end])
            if content[:4] == struct.pack("<I", FRAME_MAGIC):
                content = plain.decompressobj().decompress(content)
            if content:
                decoder = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(content))
        elif magic == FRAME_MAGIC:
            try:
                yield parse(decoder.decompressobj().decompress(data[at:end]))
            except zstd.ZstdError as e:
                raise ArchiveError(f"the frame at byte {at} can't be decoded: {e}") from e
        first, at = False, end


def first_of_equal(pages: DataFrame, id_column: str, payload: str) -> DataFrame:
    """``pages`` with ``refers_to``: the least id of rows with an equal payload, null in rows that have it.

    Payloads are equal by their SHA-256: the SHA-1 of the format can be made to collide.
    Only digests of payloads held more than once are shuffled and written; Spark broadcasts them if they are few, else it joins by digest and splits hot ones.
    """
    sha = F.unhex(F.sha2(F.coalesce(F.col(payload), F.lit("")).cast("binary"), 256))
    groups = pages.groupBy(sha.alias("__digest")).agg(F.min(id_column).alias("__first"), F.count("*").alias("__n"))
    groups = written(groups.where("__n > 1").drop("__n"), "equal")
    joined = pages.withColumn("__sha", sha).join(groups, F.col("__sha") == F.col("__digest"), "left")
    return joined.withColumn("refers_to", F.when(~F.col("__first").eqNullSafe(F.col(id_column)), F.col("__first"))).drop("__sha", "__digest", "__first")


def write_archives(pages: DataFrame, path: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html") -> None:
    """Write archives of the rows of ``pages``, a record per row, under ``path``."""
    rows = first_of_equal(pages.select(id_column, url_column, payload_column), id_column, payload_column).select(id_column, url_column, payload_column, "refers_to")

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor, out, weight = None, [], 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], ["archive"])

        for batch in batches:
            for part in steps(batch, 2):
                name = lambda x: f"urn:record:{'' if x is None else x}"
                made = [
                    record(name(i), url or "", payload, None if refers is None else name(refers))
                    for i, url, payload, refers in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts_of(part.column(2)), part.column(3).to_pylist(), strict=True)
                ]
                for at, m in enumerate(made):
                    if compressor is None:
                        sample, room = [], SAMPLE_BYTES
                        for x in made[at : at + SAMPLE_RECORDS]:
                            sample.append(x[: min(room, 8192)])
                            room -= len(sample[-1])
                            if room <= 0:
                                break
                        content = trained(sample)
                        out.append(dictionary_frame(content))
                        compressor = zstd.ZstdCompressor(level=LEVEL, dict_data=zstd.ZstdCompressionDict(content), write_checksum=True) if content else zstd.ZstdCompressor(level=LEVEL, write_checksum=True)
                    out.append(compressor.compress(m))
                    weight += len(out[-1])
                    if weight >= ARCHIVE_BYTES:
                        yield closed()
                        compressor, out, weight = None, [], 0
        if out:
            yield closed()

    # A cast of binary to string keeps the bytes as they are.
    batched(rows).mapInArrow(archives, "archive binary").select(F.col("archive").cast("string")).write.option("lineSep", SEPARATOR.decode("ascii")).option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per record: ``record_id``, ``record_type``, ``url``, ``payload_bytes``, ``payload_digest``, ``refers_to`` and, with ``payloads``, ``payload`` (null in revisits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[: len(names)], kinds, strict=False)], names)

        for batch in batches:
            for i in range(batch.num_rows):
                rows, weight = [], 0
                for r in records(batch.column(0)[i].as_buffer().to_pybytes() if batch.column(0)[i].is_valid else b""):
                    rows.append((r.record_id, r.kind, r.headers.get("warc-target-uri"), r.payload_length, r.payload_digest, r.refers_to, r.payload if payloads and r.kind != "revisit" else None))
                    weight += 500 + len(r.payload) * payloads
                    if weight > 1 << 22:
                        yield batch_of(rows)
                        rows, weight = [], 0
                if rows:
                    yield batch_of(rows)

    fields = ["record_id string", "record_type string", "url string", "payload_bytes long", "payload_digest string", "refers_to string", *["payload binary"] * payloads]
    names = [f.split()[0] for f in fields]
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ", ".join(fields))


def round_trip(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", path: str | None = None) -> DataFrame:
    """Write archives of ``pages`` and read them back: id, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to`` (an id)."""
    spark = pages.sparkSession
    path = path or fresh_path(spark, "archives")
    write_archives(pages, path, id_column, url_column, payload_column)
    kind = pages.schema[id_column].dataType
    # An empty table may leave no part file behind that has a frame; the reader then yields no record.
    back = read_archives(spark, path)
    own = lambda c: F.nullif(F.regexp_replace(c, "^urn:record:", ""), F.lit("")).cast(kind)
    return back.select(own("record_id").alias(id_column), "payload_bytes", "payload_digest", "record_type", own("refers_to").alias("refers_to"))
