"""Ordinary image files to and from rasters: PNG, binary PGM and PPM, uncompressed BMP. JPEG is not read."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..operators import codec
from ..operators.codec import CodecError

# Signature, colour types by channels, samples a pixel by colour type.
PNG = b"\x89PNG\r\n\x1a\n"
PNG_COLOR = {1: 0, 2: 4, 3: 2, 4: 6}
PNG_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_PNM = re.compile(rb"P([56])" + rb"(?:\s|#[^\n]*\n)+(\d+)" * 3 + rb"\s")

Raster = tuple[int, int, int, bytes]


def to_png(w: int, h: int, channels: int, raw: bytes) -> bytes:
    chunk = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    rows = codec.filter_rows(np.frombuffer(raw, np.uint8).reshape(h, w * channels), channels)
    head = struct.pack(">IIBBBBB", w, h, 8, PNG_COLOR[channels], 0, 0, 0)
    return PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def from_png(data: bytes) -> Raster:
    """Samples of 16 bits keep their high byte, those of fewer than 8 are widened; palettes become colours, with alpha if the file gives it."""
    at, parts = len(PNG), {}
    while at < len(data) and b"IEND" not in parts:
        if at + 12 > len(data):
            raise CodecError("the PNG breaks off")
        (n,), tag = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if data[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(tag + body)):
            raise CodecError(f"a PNG chunk's checksum does not hold: {tag!r}")
        parts.setdefault(tag, []).append(body)
        at += 12 + n
    if not {b"IHDR", b"IDAT", b"IEND"} <= set(parts) or len(parts[b"IHDR"][0]) != 13:
        raise CodecError("the PNG lacks a chunk")
    w, h, depth, color, _, _, interlaced = struct.unpack(">IIBBBBB", parts[b"IHDR"][0])
    if interlaced or color not in PNG_SAMPLES or depth not in (1, 2, 4, 8, 16):
        raise CodecError("interlaced PNG files and unknown forms are not read")
    n = PNG_SAMPLES[color]
    try:
        rows = np.frombuffer(zlib.decompress(b"".join(parts[b"IDAT"])), np.uint8)
    except zlib.error as e:
        raise CodecError(str(e)) from e
    width = (w * n * depth + 7) // 8
    if len(rows) != h * (width + 1):
        raise CodecError("the PNG's rows do not fit its size")
    v = codec.unfilter_rows(rows.reshape(h, width + 1), max(1, n * depth // 8))
    if depth == 16:
        v = v[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(v, axis=1).reshape(h, -1, depth)
        v = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(2).astype(np.uint8)[:, : w * n]
        if color == 0:
            v = v * np.uint8(255 // ((1 << depth) - 1))
    if color == 3:
        table = np.frombuffer(parts.get(b"PLTE", [b""])[0], np.uint8).reshape(-1, 3)
        if b"tRNS" in parts:
            alpha = np.full((len(table), 1), 255, np.uint8)
            given = np.frombuffer(parts[b"tRNS"][0], np.uint8)[: len(table)]
            alpha[: len(given), 0] = given
            table = np.hstack([table, alpha])
        if v.size and v.max() >= len(table):
            raise CodecError("a PNG pixel is beyond the palette")
        v, n = table[v], table.shape[1]
    return w, h, n, v.tobytes()


def to_pnm(w: int, h: int, channels: int, raw: bytes) -> bytes:
    if channels not in (1, 3):
        raise CodecError("PGM and PPM hold no alpha")
    return b"P%d\n%d %d\n255\n" % (5 if channels == 1 else 6, w, h) + raw


def from_pnm(data: bytes) -> Raster:
    found = _PNM.match(data)
    if not found:
        raise CodecError("not a binary PGM or PPM")
    kind, w, h, top = map(int, found.groups())
    n, size = 1 if kind == 5 else 3, 1 if top < 256 else 2
    body = data[found.end() : found.end() + w * h * n * size]
    if not 0 < top < 65536 or len(body) < w * h * n * size:
        raise CodecError("the PGM or PPM does not hold its pixels")
    v = np.frombuffer(body, np.uint8 if size == 1 else ">u2").astype(np.uint32)
    return w, h, n, (body if top == 255 else np.minimum((v * 255 + top // 2) // top, 255).astype(np.uint8).tobytes())


def to_bmp(w: int, h: int, channels: int, raw: bytes) -> bytes:
    if channels not in (1, 3):
        raise CodecError("BMP files are written without alpha")
    px = np.frombuffer(raw, np.uint8).reshape(h, w, channels)
    px = (np.repeat(px, 3, 2) if channels == 1 else px)[::-1, :, ::-1].reshape(h, w * 3)
    body = np.pad(px, ((0, 0), (0, -w * 3 % 4))).tobytes()
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def from_bmp(data: bytes) -> Raster:
    """24 or 32 bits a pixel; the fourth byte is not taken for alpha."""
    if len(data) < 54:
        raise CodecError("a BMP has 54 bytes at least")
    (start,), (size, w, h, _, bits, coding) = struct.unpack_from("<I", data, 10), struct.unpack_from("<IiiHHI", data, 14)
    if size < 40 or w < 1 or bits not in (24, 32) or coding not in (0, 3):
        raise CodecError("BMP files with palettes or compression are not read")
    row, n = (w * bits + 31) // 32 * 4, bits // 8
    body = data[start : start + row * abs(h)]
    if len(body) < row * abs(h):
        raise CodecError("the BMP breaks off")
    px = np.frombuffer(body, np.uint8).reshape(abs(h), row)[:, : w * n].reshape(abs(h), w, n)[:, :, 2::-1]
    return w, abs(h), 3, (px[::-1] if h > 0 else px).tobytes()


WRITERS = {"png": to_png, "pgm": to_pnm, "ppm": to_pnm, "bmp": to_bmp}


def parse(data: bytes) -> Raster:
    """(w, h, channels, pixels), by the signature."""
    if data[: len(PNG)] == PNG:
        return from_png(data)
    return from_bmp(data) if data[:2] == b"BM" else from_pnm(data)


def encode(images: DataFrame, extension: str) -> DataFrame:
    """(image, encoded): a file of the extension's form of each raster (image, w, h, channels, pixels); the sink of images writes them out."""
    write = WRITERS[extension]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in codec.slices(batches, "pixels"):
            made = []
            for r in part.to_pylist():
                if len(r["pixels"]) != r["w"] * r["h"] * r["channels"]:
                    raise CodecError(f"{r['image']} does not fit its size")
                made.append(write(r["w"], r["h"], r["channels"], r["pixels"]))
            yield pa.RecordBatch.from_arrays([part.column("image"), pa.array(made, pa.binary())], names=["image", "encoded"])

    return images.select("image", "w", "h", "channels", "pixels").mapInArrow(run, "image string, encoded binary")


def decode(files: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """Rasters (image, w, h, channels, pixels) of files (path, content). Damaged and unknown files raise, or are left out under DROPMALFORMED."""
    if mode not in ("FAILFAST", "DROPMALFORMED"):
        raise ValueError(f"no such mode: {mode}")
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in codec.slices(batches, "content"):
            rows = []
            for r in part.to_pylist():
                try:
                    rows.append((r["path"], *parse(r["content"] or b"")))
                except CodecError:
                    if mode == "FAILFAST":
                        raise
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["image", "w", "h", "channels", "pixels"])

    return files.select("path", "content").mapInArrow(run, "image string, w int, h int, channels int, pixels binary")


def read(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """The rasters of all image files under path, named by their paths."""
    return decode(spark.read.format("binaryFile").load(path), mode)
