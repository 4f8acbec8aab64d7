import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelweave.operators.codec import CodecError
from pixelweave.sources import files, images


@given(st.sampled_from(["png", "pnm", "bmp"]), st.sampled_from([1, 2, 3, 4]), st.integers(1, 9), st.integers(1, 9), st.randoms())
@settings(max_examples=80, deadline=None)
def test_files_come_back(kind, channels, w, h, rnd):
    raw = bytes(rnd.randrange(256) for _ in range(w * h * channels))
    write = {"png": files.to_png, "pnm": files.to_pnm, "bmp": files.to_bmp}[kind]
    if kind != "png" and channels in (2, 4):
        with pytest.raises(CodecError):
            write(w, h, channels, raw)
        return
    data = write(w, h, channels, raw)
    want = (w, h, 3, bytes(v for v in raw for _ in range(3))) if kind == "bmp" and channels == 1 else (w, h, channels, raw)
    assert files.parse(data) == want
    with pytest.raises(CodecError):
        files.parse(data[:-1])


def _png(w, h, depth, color, rows, **more):
    chunk = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    extra = b"".join(chunk(tag.encode(), data) for tag, data in more.items())
    return files.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, color, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_other_forms_of_png():
    assert files.parse(_png(3, 1, 1, 0, b"\0\xa0")) == (3, 1, 1, b"\xff\0\xff")
    assert files.parse(_png(2, 1, 4, 0, b"\0\x1f")) == (2, 1, 1, b"\x11\xff")
    assert files.parse(_png(1, 1, 16, 2, b"\0\x01\x02\x03\x04\x05\x06")) == (1, 1, 3, b"\1\3\5")
    palette = {"PLTE": b"abcdef"}
    assert files.parse(_png(2, 1, 8, 3, b"\0\1\0", **palette)) == (2, 1, 3, b"defabc")
    assert files.parse(_png(2, 1, 2, 3, b"\0\x10", **palette, tRNS=b"\7")) == (2, 1, 4, b"abc\7def\xff")
    for bad in (_png(1, 1, 8, 3, b"\0\5", **palette), _png(1, 1, 8, 0, b"\0\0\0"), b"", b"P5\n2 2\n255\nab", b"BMxx"):
        with pytest.raises(CodecError):
            files.parse(bad)


def test_pnm_comments_and_other_maxima():
    assert files.parse(b"P5 # a comment\n2 # b\n1\n15\n\x0f\x03") == (2, 1, 1, b"\xff\x33")
    assert files.parse(b"P5\n1 1\n65535\n\xff\xff") == (1, 1, 1, b"\xff")


def test_folder_of_images(spark, tmp_path):
    raw = np.random.default_rng(5).integers(0, 256, 5 * 4 * 3).astype(np.uint8).tobytes()
    d = spark.createDataFrame([("a", 5, 4, 3, bytearray(raw)), ("b", 20, 3, 1, bytearray(raw))], "image string, w int, h int, channels int, pixels binary")
    spark.dataSource.register(images.ImageSink)
    files.encode(d, "png").write.format("images").mode("append").option("path", str(tmp_path)).option("extension", "png").save()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.png", "b.png"]
    (tmp_path / "c.png").write_bytes(b"none")
    got = {r["image"].rsplit("/")[-1]: (r["w"], r["h"], r["channels"], bytes(r["pixels"])) for r in files.read(spark, str(tmp_path), "DROPMALFORMED").collect()}
    assert got == {"a.png": (5, 4, 3, raw), "b.png": (20, 3, 1, raw)}
