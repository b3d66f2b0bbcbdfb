"""Web archives (WARC) as Zstandard files: a dictionary in the leading skippable frame, one frame per record.

Spark's own text writer makes the files: one row is one frame, and the row separator is an empty
skippable frame, which readers pass over. So files appear only when their task commits, in any store Spark writes.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowspark.llm.common import bounded_sample
from flowspark.session import materialize, scratch_path

MIN_DUPLICATE = 100
MAX_ARCHIVE = 1 << 30
# fixed values of the formats
VERSION = b"WARC/1.1"
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAX_HEADER = 1 << 20
SLICE = 128


class ArchiveError(ValueError):
    """An archive that breaks its format."""


@dataclass
class Record:
    kind: str
    headers: dict[str, str]
    payload: bytes
    payload_bytes: int
    digest: str

    def page(self, header: str) -> int | None:
        found = self.headers.get(header, "")
        return int(found[10:-1]) if found.startswith("<urn:page:") and found != "<urn:page:null>" else None


def _line(text: str) -> str:
    """A header value on one line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response record, or a revisit record without payload if it refers to another page."""
    digest = hashlib.sha256(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: <urn:page:{'null' if page is None else page}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_line(url)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
              f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> Record:
    """Check a record's version line, headers, lengths and digest."""
    end = data.find(b"\r\n\r\n", 0, MAX_HEADER)
    if not data.startswith(VERSION + b"\r\n") or end < 0:
        raise ArchiveError("no record header")
    headers = _headers(data[len(VERSION) + 2:end])
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ArchiveError(f"a record without {name}")
    length = headers["content-length"]
    if not length.isdigit() or len(data) != end + 4 + int(length) + 4 or not data.endswith(b"\r\n\r\n"):
        raise ArchiveError(f"content-length {length} does not fit a record of {len(data)} bytes")
    block = data[end + 4:-4]
    body = block.find(b"\r\n\r\n")
    if body < 0:
        raise ArchiveError("no response header")
    http = _headers(block[block.find(b"\r\n") + 2:body])
    payload, kind = block[body + 4:], headers["warc-type"]
    digest = headers.get("warc-payload-digest", "").removeprefix("sha256:")
    size = int(http["content-length"]) if http.get("content-length", "").isdigit() else len(payload)
    if kind == "response":
        if size != len(payload):
            raise ArchiveError(f"payload of {len(payload)} bytes, {size} announced")
        if digest and hashlib.sha256(payload).hexdigest() != digest:
            raise ArchiveError("payload digest differs")
    elif kind == "revisit":
        if payload or not digest or "warc-refers-to" not in headers:
            raise ArchiveError("a revisit record needs a digest, a reference and no payload")
    else:
        raise ArchiveError(f"record type {kind}")
    return Record(kind, headers, payload, size, digest)


def _headers(data: bytes) -> dict[str, str]:
    found = {}
    for line in data.decode("utf-8").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ArchiveError(f"header line {line[:80]!r}")
        found[name.strip().lower()] = value.strip()
    return found


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def frames(data: bytes) -> Iterator[bytes]:
    """Record contents of an archive, one per frame; its dictionary is taken from the leading skippable frame."""
    view, at = memoryview(data), 0
    reader = zstandard.ZstdDecompressor()
    while at < len(data):
        if at + 8 > len(data):
            raise ArchiveError(f"a cut frame at byte {at}")
        magic, size = struct.unpack_from("<II", data, at)
        if magic in SKIPPABLE:
            if at + 8 + size > len(data):
                raise ArchiveError(f"a cut frame at byte {at}")
            if magic == DICTIONARY_MAGIC and at == 0:
                content = bytes(view[8:8 + size])
                if content[:4] == struct.pack("<I", FRAME_MAGIC):
                    content = zstandard.ZstdDecompressor().decompress(content)
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
            at += 8 + size
        elif magic == FRAME_MAGIC:
            end = _frame_end(data, at)
            try:
                work = reader.decompressobj()
                yield work.decompress(view[at:end])
            except zstandard.ZstdError as e:
                raise ArchiveError(f"frame at byte {at}: {e}") from e
            at = end
        else:
            raise ArchiveError(f"no frame at byte {at}")


def _frame_end(data: bytes, at: int) -> int:
    """Where a frame ends: its header, blocks up to the one marked last, and a checksum if it has one."""
    try:
        head = zstandard.frame_header_size(data[at:at + 18])
        checked = zstandard.get_frame_parameters(data[at:at + 18]).has_checksum
    except zstandard.ZstdError as e:
        raise ArchiveError(f"frame header at byte {at}: {e}") from e
    at += head
    last = False
    while not last:
        if at + 3 > len(data):
            raise ArchiveError(f"a cut frame at byte {at}")
        block = int.from_bytes(data[at:at + 3], "little")
        last, kind, size = block & 1, block >> 1 & 3, block >> 3
        at += 3 + (1 if kind == 1 else size)
    at += 4 * checked
    if at > len(data):
        raise ArchiveError(f"a cut frame before byte {at}")
    return at


def _train(pages: DataFrame, rows: int, chars: int, size: int) -> bytes:
    """A compression dictionary from the first characters of at most ``rows`` pages, by hash of their ids; b"" if they are too few."""
    ids = bounded_sample(pages.select("page_id").dropna().distinct(), ["page_id"], rows)
    sample = pages.select("page_id", F.substring("html", 1, chars).alias("html")).dropna().join(
        F.broadcast(ids), "page_id").dropDuplicates(["page_id"]).collect()
    samples = [r.html.encode() for r in sample if r.html]
    if len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(size, samples, k=1024, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def _framed(batches: Iterator[pa.RecordBatch], dictionary: bytes, level: int, date: str) -> Iterator[pa.RecordBatch]:
    loaded = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    writer, first = zstandard.ZstdCompressor(level=level, write_checksum=True, **loaded), bool(dictionary)
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            part = batch.slice(start, SLICE)
            made = [dictionary_frame(dictionary)] if first else []
            first = False
            for page, url, html, refers in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                made.append(writer.compress(record(page, url, (html or "").encode("utf-8", "surrogatepass"), refers, date)))
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])


def with_references(pages: DataFrame, least: int = MIN_DUPLICATE) -> DataFrame:
    """page_id, url, html and ``refers_to``: the smallest page with the same payload, for all others of ``least`` bytes or more.

    Digests of groups are stored first; then both sides of the join are plain shuffles, so Spark can split a
    group with very many copies.
    """
    rows = pages.select("page_id", "url", "html").withColumn("__digest", F.when(
        F.octet_length("html") >= least, F.sha2("html", 256)))
    groups = rows.filter("__digest is not null").groupBy("__digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("__digest", "first")
    joined = rows.join(materialize(groups, "groups"), "__digest", "left")
    return joined.select("page_id", "url", "html", F.when(
        F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, level: int = 3, sample_rows: int = 500, sample_chars: int = 16_384,
                   dictionary_bytes: int = 65_536, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write pages (page_id, url, html) as archives below ``path``, one file per task.

    ``sample_rows`` and ``sample_chars`` bound what the compression dictionary is trained on. A null
    html is an empty payload; a null url has no header; line breaks in urls are escaped. Of equal
    payloads the smallest page is written whole, and repeated rows of that page too.
    """
    dictionary = _train(pages, sample_rows, sample_chars, dictionary_bytes)
    made = with_references(pages).mapInArrow(
        partial(_framed, dictionary=dictionary, level=level, date=date), "value binary")
    made.select(F.col("value").cast("string")).write.option("lineSep", EMPTY_FRAME).option("encoding", "UTF-8") \
        .option("maxRecordsPerFile", 0).text(path)


def _records(batches: Iterator[pa.RecordBatch], payload: bool) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *([pa.binary()] if payload else [])]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if payload else [])]
    for batch in batches:
        for data in batch.column(0):
            rows = []
            for content in frames(data.as_buffer().to_pybytes()):
                r = parse(content)
                row = [r.page("warc-record-id"), r.headers.get("warc-target-uri"), r.payload_bytes, r.digest, r.kind,
                       r.page("warc-refers-to")]
                rows.append(row + [r.payload] if payload else row)
                if len(rows) == SLICE:
                    yield _batch(rows, kinds, names)
                    rows = []
            if rows:
                yield _batch(rows, kinds, names)


def _batch(rows: list[list], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def read_archives(spark: SparkSession, path: str, payload: bool = True, glob: str = "part-*") -> DataFrame:
    """One row per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to and, on request, payload.

    Length and digest of a revisit are those of the page it stands for. A file of more than 1 GiB, a cut
    or damaged frame, or a record whose headers, lengths or digest are wrong fails the read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    content = F.when(F.col("length") <= MAX_ARCHIVE, F.col("content")).otherwise(
        F.raise_error(F.concat(F.lit("archive too large, use more shuffle partitions: "), F.col("path"))))
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" \
        + (", payload binary" if payload else "")
    return files.select(content.alias("content")).mapInArrow(partial(_records, payload=payload), schema)


def archived(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write pages as archives and read the archives back, without payloads."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "archives")
    write_archives(pages, path, **options)
    return read_archives(spark, path, payload=False)
