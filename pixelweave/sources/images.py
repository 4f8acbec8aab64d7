"""Images to and from container files: encoding and decoding as DataFrame operators, header scan, sink, and codec comparison.

Rasters are rows (image string, w int, h int, channels int, pixels binary). Metadata travels as bytes in the chunks icc, exif, xmp and custom.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions.fixed import MAGIC
from ..operators import codec
from . import container

CHUNK_OF = {"icc": "ICCP", "exif": "EXIF", "xmp": "XMP", "custom": "CUST"}
QUALITIES = (100, 95, 90, 85, 75, 50, 25)
HEADER = "struct<width:bigint,height:bigint,color_type:string,compression_mode:string,quality:int,has_alpha:boolean,has_animation:boolean,bit_depth:int>"
_MODES = ("Lossless", "Lossy", "Mixed")


def encode(images: DataFrame, config: codec.CodecConfig = codec.CodecConfig(), **metadata: Column) -> DataFrame:
    """(image, encoded): a container file of each raster; null metadata leaves its chunk out. A raster that doesn't fit its size raises CodecError."""
    if config.mode not in ("lossless", "lossy"):
        raise codec.CodecError(f"files have no mode {config.mode}")
    tags = [t for t in CHUNK_OF if t in metadata]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in codec.slices(batches, "pixels"):
            heads, bodies = [], []
            for r in batch.select(["w", "h", "channels", "pixels"]).to_pylist():
                lossless = config.mode == "lossless"
                heads.append(container.header(r["w"], r["h"], r["channels"] - 1, 0 if lossless else 1, 100 if lossless else config.quality, r["channels"] in (2, 4)))
                bodies.append(codec.encode(r["pixels"], r["w"], r["h"], r["channels"], config))
            kept = batch.select(["image", *tags])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(heads, pa.binary()), pa.array(bodies, pa.binary())], names=["image", *tags, "head", "body"])

    wanted = images.select("image", "w", "h", "channels", "pixels", *[metadata[t].cast("binary").alias(t) for t in tags])
    made = wanted.mapInArrow(run, ", ".join(["image string", *[f"{t} binary" for t in tags], "head binary", "body binary"]))
    chunk = lambda tag, data: container.frame(F.rpad(F.lit(tag), 4, "\0"), data)
    none = F.lit(bytearray())
    extra = [F.coalesce(chunk(CHUNK_OF[t], F.col(t)), none) for t in tags]
    body = chunk("IDAT" if config.mode == "lossless" else "IDLS", F.col("body"))
    return made.select("image", F.concat(F.lit(bytearray(MAGIC)), chunk("IHDR", F.col("head")), *extra, body, chunk("IEND", none)).alias("encoded"))


def _decoded(content: bytes) -> dict:
    chunks: dict[str, bytes] = {}
    for tag, data, _ in container.read_chunks(content):
        chunks.setdefault(tag, data)
        if tag in ("IDAT", "IDLS"):
            chunks.setdefault("body", data)
            chunks.setdefault("coded", tag.encode())
    if "IHDR" not in chunks or "body" not in chunks:
        raise container.ContainerError("no header or no image")
    head = container.parse_header(chunks["IHDR"])
    channels = container.CHANNELS[container.COLORS.index(head["color_type"])]
    config = codec.CodecConfig("lossless" if chunks["coded"] == b"IDAT" else "lossy", head["quality"])
    pixels = codec.decode(chunks["body"], head["width"], head["height"], channels, config)
    return {"header": head, **{t: chunks.get(c) for t, c in CHUNK_OF.items()}, "channels": channels, "pixels": pixels, "error": None}


def decode(files: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """(path, header, icc, exif, xmp, custom, channels, pixels, error) of files (path, content). The first header and the first image count.

    Damaged files raise under FAILFAST, give their error under PERMISSIVE, and are left out under DROPMALFORMED.
    """
    if mode not in ("FAILFAST", "PERMISSIVE", "DROPMALFORMED"):
        raise ValueError(f"no such mode: {mode}")
    kinds = {"path": pa.string(), "header": pa.struct([("width", pa.int64()), ("height", pa.int64()), ("color_type", pa.string()), ("compression_mode", pa.string()), ("quality", pa.int32()), ("has_alpha", pa.bool_()), ("has_animation", pa.bool_()), ("bit_depth", pa.int32())])}
    kinds |= {t: pa.binary() for t in CHUNK_OF} | {"channels": pa.int32(), "pixels": pa.binary(), "error": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in codec.slices(batches, "content"):
            for r in batch.to_pylist():
                try:
                    row = _decoded(r["content"] or b"")
                except (container.ContainerError, codec.CodecError, struct.error, ValueError, IndexError) as e:
                    if mode == "FAILFAST":
                        raise
                    row = {"error": str(e) or type(e).__name__}
                if mode == "PERMISSIVE" or not row["error"]:
                    row["path"] = r["path"]
                    yield pa.RecordBatch.from_arrays([pa.array([row.get(n)], t) for n, t in kinds.items()], names=[*kinds])

    layout = f"path string, header {HEADER}, {', '.join(f'{t} binary' for t in CHUNK_OF)}, channels int, pixels binary, error string"
    return files.select("path", "content").mapInArrow(run, layout)


def read_images(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """The images of all files under path; Spark's file reader leaves empty files out."""
    return decode(spark.read.format("binaryFile").load(path), mode)


def _little(data: Column, at: int, n: int) -> Column:
    byte = lambda k: F.conv(F.hex(F.substring(data, at + k + 1, 1)), 16, 10).cast("bigint")
    return sum((byte(k) * (1 << 8 * k) for k in range(1, n)), byte(0))


def headers(files: DataFrame) -> DataFrame:
    """(path, bytes, header) of files (path, content), from their first 36 bytes, inside the JVM; the header is null where these aren't a container's."""
    head = F.substring("content", 1, 36)
    code = lambda names, c: F.element_at(F.array(*map(F.lit, names)), F.least(c, F.lit(len(names) - 1)).cast("int") + 1)
    at = lambda k, n=1: _little(head, 16 + k, n)
    good = (F.substring(head, 1, 8) == F.lit(bytearray(MAGIC))) & (F.substring(head, 13, 4) == F.unhex(F.lit("10000000"))) & (F.substring(head, 9, 4) == F.lit(bytearray(b"IHDR"))) & (F.length(head) == 36)
    good = good & (F.crc32(F.concat(F.substring(head, 9, 4), F.substring(head, 17, 16))) == _little(head, 32, 4)) & (at(8) < len(container.COLORS))
    fields = {"width": at(0, 4), "height": at(4, 4), "color_type": code(container.COLORS, at(8)), "compression_mode": code(_MODES, at(9)), "quality": at(10), "has_alpha": at(11) % 2 == 1, "has_animation": F.shiftright(at(11), 1) % 2 == 1, "bit_depth": at(12)}
    made = F.when(good, F.struct(*[c.alias(n) for n, c in fields.items()]).cast(HEADER))
    return files.select("path", F.length("content").cast("long").alias("bytes"), made.alias("header"))


def info(spark: SparkSession, path: str) -> DataFrame:
    """Size, header and share of the raw size of all files under path."""
    h = headers(spark.read.format("binaryFile").load(path))
    channels = F.element_at(F.create_map(*[F.lit(x) for k, n in container.CHANNELS.items() for x in (container.COLORS[k], n)]), F.col("header.color_type"))
    raw = F.col("header.width") * F.col("header.height") * channels
    return h.select("path", "bytes", "header.*", raw.alias("raw_bytes"), F.round(100 * F.col("bytes") / raw, 4).alias("ratio"))


class ImageSink(DataSource):
    """df.write.format("images").mode("append").option("path", folder).save() for rows (image, encoded): a file image.wk for each row, or with another `extension`.

    Each file is written under another name in the folder and then renamed, so a task that is run again leaves whole files only. The folder must be shared.
    """

    @classmethod
    def name(cls) -> str:
        return "images"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("only mode append")
        return ImageWriter(self.options["path"], self.options.get("extension", "wk"))


class ImageWriter(DataSourceWriter):
    def __init__(self, path: str, extension: str = "wk"):
        self.path, self.extension = path, extension

    def write(self, rows) -> WriterCommitMessage:
        import pyarrow.fs as pafs

        fs, at = pafs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        fs.create_dir(at, recursive=True)
        for r in rows:
            if not r["image"] or "/" in r["image"]:
                raise ValueError(f"not a file name: {r['image']!r}")
            part = f"{at}/.{uuid.uuid4().hex}.part"
            with fs.open_output_stream(part) as f:
                f.write(bytes(r["encoded"]))
            fs.move(part, f"{at}/{r['image']}.{self.extension}")
        return WriterCommitMessage()


def benchmark(images: DataFrame, qualities: tuple[int, ...] = QUALITIES) -> DataFrame:
    """(image, quality, raw_bytes, coded_bytes, ratio, psnr) of each raster at each quality; 100 is lossless. One task an image and quality."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in codec.slices(batches, "pixels"):
            rows = []
            for r in batch.to_pylist():
                config, size = codec.CodecConfig("lossless" if r["quality"] == 100 else "lossy", r["quality"]), (r["w"], r["h"], r["channels"])
                coded = codec.encode(r["pixels"], *size, config)
                off = np.frombuffer(r["pixels"], np.uint8).astype(float) - np.frombuffer(codec.decode(coded, *size, config), np.uint8)
                mse, raw = float((off**2).mean()) if len(off) else 0.0, r["w"] * r["h"] * 3
                rows.append((r["image"], r["quality"], raw, len(coded), round(100 * len(coded) / raw, 4) if raw else None, round(10 * float(np.log10(65025 / mse)), 4) if mse else 99.0))
            if rows:
                kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["image", "quality", "raw_bytes", "coded_bytes", "ratio", "psnr"])

    each = images.select("image", "w", "h", "channels", "pixels", F.explode(F.array(*map(F.lit, qualities))).alias("quality")).repartition("image", "quality")
    return each.mapInArrow(run, "image string, quality int, raw_bytes long, coded_bytes long, ratio double, psnr double")
