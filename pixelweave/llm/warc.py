"""WARC archives in zstandard: a dictionary in a leading skippable frame, then one frame for each record.

Writer: payloads with equal SHA-256 and at least `least` bytes are stored once, in the record with the largest page_id (response); the
others are revisit records that refer to it. A task writes archives of bounded size under names of its own attempt; only the names
in the returned list are ever read, so a task run again or twice adds nothing.
Reader: takes one frame at a time, checks the version line, the named fields, the content length, the end mark and the digest.

Defined results: a null html is the empty payload; a null url gives a record without target; rows that repeat a page_id are records
each, and all that hold the largest page_id of their payload are responses; a null page_id raises, as revisits refer by it; a very long
payload is one record, held in memory whole; an empty table gives no archive and no rows; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import files_at, fresh_dir

#: Fixed values of the format: the skippable frame's magic number and a dictionary's.
SKIPPABLE, DICTIONARY = 0x184D2A5D, 0xEC30A437
VERSION = b"WARC/1.1"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "WARC-Payload-Digest", "WARC-Payload-Length")
NAME = "urn:pixelweave:page:"
ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


class WarcError(ValueError):
    pass


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int, url: str | None, payload: bytes, refers_to: int | None = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A response record, or without the payload a revisit of another page's."""
    revisit = refers_to is not None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    fields = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": f"<{NAME}{page_id}>", "WARC-Date": date}
    if url:
        fields["WARC-Target-URI"] = "".join(c if c > " " else f"%{ord(c):02X}" for c in url)
    if revisit:
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<{NAME}{refers_to}>"}
    fields |= {"WARC-Payload-Digest": f"sha1:{digest(payload)}", "WARC-Payload-Length": str(len(payload)), "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of a record; raises WarcError for whatever does not hold."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not sep or version != VERSION:
        raise WarcError(f"not a {VERSION.decode()} record: {version[:20]!r}")
    fields = {}
    for line in lines:
        name, colon, value = line.decode().partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"malformed field {line[:60]!r}")
        fields[name] = value.strip()
    if missing := [f for f in REQUIRED if f not in fields]:
        raise WarcError(f"missing {', '.join(missing)}")
    if not fields["Content-Length"].isdigit():
        raise WarcError("Content-Length is no number")
    length = int(fields["Content-Length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length says {length}; the block has {len(rest) - 4}")
    return fields, rest[:length]


def row(fields: dict[str, str], block: bytes) -> tuple[int, int, str, str, int | None]:
    """A row of ROWS. Of a response the payload itself is measured and must agree with the fields."""
    named = lambda f: int(fields[f].removeprefix(f"<{NAME}").removesuffix(">"))
    kind, said, length = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["WARC-Payload-Length"])
    payload = block.partition(b"\r\n\r\n")[2]
    if kind == "response":
        if digest(payload) != said or len(payload) != length:
            raise WarcError("the payload does not agree with its digest or length")
        return named("WARC-Record-ID"), len(payload), said, kind, None
    if kind != "revisit" or payload:
        raise WarcError(f"unexpected {kind} record")
    return named("WARC-Record-ID"), length, said, kind, named("WARC-Refers-To")


def train(samples: list[bytes], size: int = 32 << 10) -> bytes:
    """A dictionary; with too few samples to train one, their common head as raw content."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(samples) + record(0, "http://", b""))[-size:]


class ArchiveWriter:
    def __init__(self, sink, dictionary: bytes, level: int = 3):
        self.sink = sink
        squeezed = zstandard.ZstdCompressor(level=level).compress(dictionary)
        self.zip = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
        sink.write(struct.pack("<II", SKIPPABLE, len(squeezed)) + squeezed)
        self.size = 8 + len(squeezed)

    def add(self, raw: bytes) -> None:
        frame = self.zip.compress(raw)
        self.sink.write(frame)
        self.size += len(frame)


def read_records(source, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, one frame after the other; never more than a record and a chunk in memory."""
    head = source.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != SKIPPABLE:
        raise WarcError("no dictionary frame leads the archive")
    (n,) = struct.unpack("<I", head[4:])
    dictionary = source.read(n)
    if len(dictionary) != n:
        raise WarcError("the dictionary frame breaks off")
    if dictionary[:4] == struct.pack("<I", 0xFD2FB528):
        dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
    unzip = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    data = source.read(chunk)
    while data:
        one, parts = unzip.decompressobj(), []
        while True:
            try:
                parts.append(one.decompress(data))
            except zstandard.ZstdError as e:
                raise WarcError(f"damaged frame: {e}") from e
            if one.eof:
                data = one.unused_data or source.read(chunk)
                break
            data = source.read(chunk)
            if not data:
                raise WarcError("the last frame breaks off")
        yield b"".join(parts)


def write(pages: DataFrame, folder: str, least: int = 0, most_bytes: int = 64 << 20, samples: int = 256, sample_bytes: int = 64 << 10) -> DataFrame:
    """Writes the archives and returns their list (file string, n_records long). The dictionary is trained on `samples` pages, `sample_bytes` of each; all else covers all."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    taken = [record(0, "http://", bytes(r[0])) for r in rows.select(F.substring("payload", 1, sample_bytes)).limit(samples).collect()]
    dictionary = pages.sparkSession.sparkContext.broadcast(train(taken))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # Only digests travel to find each payload's last page; the join's large keys are split by adaptive execution.
    last = rows.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("digest", "last")
    rows = rows.join(last, "digest", "left").withColumn("refers_to", F.expr(f"CASE WHEN length(payload) >= {least} AND last <> page_id THEN last END"))
    rows = rows.select("page_id", "url", "payload", "refers_to").sortWithinPartitions("page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = sink = name = None
        n, listed = 0, []
        for batch in batches:
            for page_id, url, body, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if page_id is None:
                    raise WarcError("a page without page_id can't be referred to")
                if out is None:
                    name, n = f"{folder}/{uuid.uuid4().hex}.warc.zst", 0
                    fs, at = files_at(name)
                    fs.create_dir(at.rpartition("/")[0], recursive=True)
                    sink = fs.open_output_stream(at)
                    out = ArchiveWriter(sink, dictionary.value)
                out.add(record(page_id, url, body, refers_to))
                n += 1
                if out.size >= most_bytes:
                    sink.close()
                    listed.append((name, n))
                    out = None
        if out is not None:
            sink.close()
            listed.append((name, n))
        if listed:
            yield pa.RecordBatch.from_pydict({"file": [x[0] for x in listed], "n_records": [x[1] for x in listed]})

    return rows.mapInArrow(run, "file string, n_records long")


def read(files: DataFrame) -> DataFrame:
    """Rows of ROWS from the archives of a list (file, n_records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for batch in batches:
            for name, n in zip(batch.column("file").to_pylist(), batch.column("n_records").to_pylist(), strict=True):
                fs, at = files_at(name)
                rows, seen = [], 0
                with fs.open_input_stream(at) as source:
                    for raw in read_records(source):
                        rows.append(row(*parse(raw)))
                        seen += 1
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows = []
                if seen != n:
                    raise WarcError(f"{name} has {seen} records; {n} were written")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return files.select("file", "n_records").mapInArrow(run, ROWS)


def roundtrip(pages: DataFrame, **options) -> DataFrame:
    """write(), then read(). The list of archives, few for each partition, goes through the driver."""
    spark = pages.sparkSession
    listed = [tuple(r) for r in write(pages, fresh_dir(spark, "warc"), **options).collect()]
    files = spark.createDataFrame(listed, "file string, n_records long")
    return read(files.repartition(max(1, len(listed))) if listed else files)


def oracle(least: int = 0) -> str:
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    digits = " || ".join(f"substr('{alphabet}', ((v >> {s}) & 31)::INT + 1, 1)" for s in (15, 10, 5, 0))
    return f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex FROM p),
l AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS last FROM h),
b AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(hex, (5 * i + 1)::INT, 5))::BIGINT) AS vs FROM l)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, array_to_string(list_transform(vs, lambda v: {digits}), '') AS payload_digest,
  CASE WHEN last = page_id OR payload_bytes < {least} THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN last = page_id OR payload_bytes < {least} THEN NULL ELSE last END AS refers_to FROM b"""
