"""Container files: chunk framing as columns, a reader over binaryFile, and a Python data source."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.fixed import CHUNKS, MAGIC

CHANNELS = {0: 1, 1: 2, 2: 3, 3: 4, 4: 3, 5: 3}
COLORS = ("Grayscale", "GrayscaleAlpha", "Rgb", "Rgba", "Yuv420", "Yuv444")
SCHEMA = "path string, seq int, tag string, length long, data binary, crc long"


class ContainerError(ValueError):
    pass


def crc(tag: Column, data: Column) -> Column:
    """CRC-32 of tag and data; the length is not covered."""
    return F.crc32(F.concat(tag.cast("binary"), data))


def frame(tag: Column, data: Column) -> Column:
    """A chunk's bytes, made inside the JVM: tag, little-endian length, data, little-endian crc."""
    little = lambda c: F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(c, 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(4)]))
    return F.concat(tag.cast("binary"), little(F.length(data).cast("long")), data, little(crc(tag, data)))


def header(width: int, height: int, color: int, mode: int, quality: int, alpha: bool = False, animation: bool = False, depth: int = 8) -> bytes:
    return struct.pack("<IIBBBBBBH", width, height, color, mode, quality, alpha | animation << 1, depth, 0, 0)


def parse_header(data: bytes) -> dict:
    if len(data) < 16:
        raise ContainerError("a header has 16 bytes")
    w, h, color, mode, quality, flags, depth, _, _ = struct.unpack_from("<IIBBBBBBH", data)
    if color not in CHANNELS:
        raise ContainerError(f"unknown colour type {color}")
    return {"width": w, "height": h, "color_type": COLORS[color], "compression_mode": ("Lossless", "Lossy", "Mixed")[min(mode, 2)], "quality": quality, "has_alpha": bool(flags & 1), "has_animation": bool(flags & 2), "bit_depth": depth}


def write_file(chunks: list[tuple[bytes, bytes]]) -> bytes:
    every = [*chunks, (b"IEND", b"")]
    return MAGIC + b"".join(t + struct.pack("<I", len(d)) + d + struct.pack("<I", zlib.crc32(t + d)) for t, d in every)


def read_chunks(content: bytes, most: int = 1 << 30) -> Iterator[tuple[str, bytes, int]]:
    """(tag, data, crc) up to and including IEND; raises ContainerError for what does not hold."""
    if content[:8] != MAGIC:
        raise ContainerError("not a container file")
    at = 8
    while True:
        if len(content) < at + 12:
            raise ContainerError("the file breaks off")
        tag, (n,) = content[at : at + 4], struct.unpack_from("<I", content, at + 4)
        if tag not in CHUNKS:
            raise ContainerError(f"unknown chunk {tag!r}")
        if n > most or len(content) < at + 12 + n:
            raise ContainerError(f"chunk of {n} bytes")
        data, (said,) = content[at + 8 : at + 8 + n], struct.unpack_from("<I", content, at + 8 + n)
        if zlib.crc32(tag + data) != said:
            raise ContainerError(f"wrong checksum of {tag!r}")
        yield tag.decode().rstrip("\0"), data, said
        at += 12 + n
        if tag == b"IEND":
            return


def chunks(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """Rows of SCHEMA from all files under path, through Spark's own file reader; PERMISSIVE leaves damaged files out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, content in ((p.as_py(), c.as_py()) for batch in batches for p, c in zip(*batch.columns, strict=True)):
            rows = []
            try:
                rows += [(path, k, t, len(d), d, c) for k, (t, d, c) in enumerate(read_chunks(content))]
            except ContainerError:
                if mode != "PERMISSIVE":
                    raise
            if rows:
                kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "seq", "tag", "length", "data", "crc"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SCHEMA)


class ChunkSource(DataSource):
    """spark.read.format("chunks").option("path", folder): one task for each file, opened through pyarrow's file systems."""

    @classmethod
    def name(cls) -> str:
        return "chunks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ChunkReader(self.options)


class ChunkReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self):
        import pyarrow.fs as pafs

        fs, at = pafs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        return [InputPartition(f.path) for f in fs.get_file_info(pafs.FileSelector(at, recursive=True)) if f.is_file]

    def read(self, partition):
        import pyarrow.fs as pafs

        fs, _ = pafs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        with fs.open_input_file(partition.value) as f:
            for k, (t, d, c) in enumerate(read_chunks(f.read())):
                yield partition.value, k, t, len(d), d, c
