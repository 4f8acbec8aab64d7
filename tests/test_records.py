import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pixelweave.functions import columns as C
from pixelweave.functions import fixed
from pixelweave.functions import metadata as M
from pixelweave.operators import codec, rangecoder
from pixelweave.sources import container, images

steps = st.lists(st.tuples(st.integers(0, 1), st.integers(1, 255)), max_size=400)


@given(steps)
@settings(max_examples=100, deadline=None)
def test_range_coder_roundtrip(s):
    read = rangecoder.RangeReader(rangecoder.range_encode(s))
    assert [read.take(p) for _, p in s] == [b for b, _ in s]


@pytest.mark.parametrize("v,bits", [(0xAB, 8), (0x1234, 16)])
def test_range_values(v, bits):
    assert rangecoder.RangeReader(rangecoder.range_encode(rangecoder.plain(v, bits))).plain(bits) == v


def test_range_coder_edges():
    assert rangecoder.range_encode([]) == b"\0" and rangecoder.RangeReader(b"").take() == 0
    carries = [(1, 1)] * 50 + [(1, 255)] * 300
    read = rangecoder.RangeReader(rangecoder.range_encode(carries))
    assert all(read.take(p) for _, p in carries)


@given(st.lists(st.integers(-rangecoder.MOST, rangecoder.MOST) | st.just(0), min_size=64, max_size=64))
@settings(max_examples=100, deadline=None)
def test_tokens_roundtrip(v):
    assert rangecoder.decode_block(rangecoder.encode_block(v)) == v


def test_tokens_edges(spark):
    for v in (0, 1, -1, 2, 4, 5, 10, 20, 50, -100, rangecoder.MOST):
        assert rangecoder.decode_block(rangecoder.encode_block([v]), 1) == [v]
    with pytest.raises(codec.CodecError):
        rangecoder.encode_block([rangecoder.MOST + 1])
    assert len(rangecoder.encode_block([0] * 64)) <= 4
    df = spark.createDataFrame([(1, [1, 0, -7]), (2, None), (3, [])], "id int, v array<int>")
    got = rangecoder.decode_tokens(rangecoder.encode_tokens(df, "v", "c"), "c", "b", 3).orderBy("id").collect()
    assert [r["b"] for r in got] == [[1, 0, -7], None, [0, 0, 0]]


def test_probabilities():
    every = [fixed.probability(t, b, c, n) for t in range(4) for b in range(8) for c in range(3) for n in range(11)]
    assert len(every) == 1056 and all(1 <= p <= 254 for p in every)
    assert fixed.probability(0, 1, 2, 3) == 141 and fixed.probability(0, 99, 0, 0) == 199 and fixed.probability(0, 7, 0, 99) == 128


def test_markers(spark):
    for n in (0, 3, 10, 11, 24, 25, 38, 100):
        data, at = bytes(range(n)), 10
        places = [*range(10, n, 14)]
        want = b"".join(data[a:b] + fixed.RESYNC for a, b in zip([0, *places], places)) + data[places[-1] if places else 0 :]
        row = spark.createDataFrame([(bytearray(data),)], "d binary").select(C.insert_markers(F.col("d"), at).alias("m")).select("m", C.find_marker(F.col("m")).alias("f"), C.find_marker(F.col("m"), 11).alias("g")).first()
        assert bytes(row["m"]) == want
        assert row["f"] == (want.find(fixed.RESYNC) if places else None)
        assert row["g"] == (want.find(fixed.RESYNC, 11) if len(places) > 1 else None)


def test_contexts_and_residuals(spark):
    row = spark.range(1).select(C.coefficient_contexts(F.array(*map(F.lit, (5, 1, 0, -3)))).alias("c"), C.reconstruct(F.array(F.lit(250), F.lit(3)), F.array(F.lit(9), F.lit(-9))).alias("r"), C.residual(F.array(F.lit(4)), F.array(F.lit(128))).alias("d")).first()
    assert row["c"] == [0, 2, 1, 0] and row["r"] == [255, 0] and row["d"] == [-124]


def test_exif(spark):
    x = M.exif(make="Canon", model="EOS R5", iso=800, aperture=2.8, artist=F.lit(None).cast("string"))
    row = spark.range(1).select(x.alias("x")).select("x", *[c.alias(n) for n, c in M.camera(F.col("x")).items()]).first()
    assert (row["camera_make"], row["camera_model"], row["iso"], row["aperture"]) == ("Canon", "EOS R5", 800, 2.8)
    assert row["gps_coordinates"] is None and row["orientation"] is None and set(row["x"]) == {"Make", "Model", "ISOSpeedRatings", "FNumber"}
    y = M.set_tag(F.lit(None).cast(M.EXIF), "XResolution", M.exif_value("rational", 1, F.lit(0)))
    z = M.exif_value("uint", F.lit(str(2**64 - 1)).cast("decimal(20,0)"))
    row = spark.range(1).select(M.as_float(M.get_tag(y, "XResolution")).alias("f"), M.as_int(z).alias("i"), M.as_string(z).alias("s"), F.size(M.exif()).alias("n")).first()
    assert row["f"] is None and row["i"] == -1 and row["s"] is None and row["n"] == 0
    with pytest.raises(ValueError):
        M.set_tag(y, "Nothing", z)


def test_xmp_and_animation(spark):
    row = spark.range(1).select(M.xmp(title="t", rating=9).alias("x"), M.xmp().alias("e"), M.add_frame(M.animation(loop_count=3), M.frame(4, 2, F.lit(bytearray(b"ab"))), False).alias("a")).first()
    assert row["x"]["rating"] == 5 and row["x"]["creator"] == [] and row["x"]["custom"] == {} and row["e"]["rating"] is None and row["e"]["title"] is None
    f = row["a"]["frames"][0]
    assert row["a"]["loop_count"] == 3 and (f["delay_ms"], f["is_keyframe"], f["blend_mode"], bytes(f["data"])) == (100, False, "Source", b"ab")
    with pytest.raises(ValueError):
        M.xmp(titel="t")


def _raster(spark):
    return spark.createDataFrame([("a", 3, 2, 3, bytearray(range(18))), ("b", 2, 2, 4, bytearray(range(16)))], "image string, w int, h int, channels int, pixels binary")


def test_files(spark, tmp_path):
    spark.dataSource.register(images.ImageSink)
    lossless = codec.CodecConfig("lossless", 100)
    coded = images.encode(_raster(spark), lossless, custom=F.when(F.col("image") == "a", F.lit("{}")), xmp=F.lit("x"))
    coded.write.format("images").mode("append").option("path", str(tmp_path)).save()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.wk", "b.wk"]
    assert [t for t, _, _ in container.read_chunks((tmp_path / "a.wk").read_bytes())] == ["IHDR", "XMP", "CUST", "IDAT", "IEND"]
    data = (tmp_path / "a.wk").read_bytes()
    (tmp_path / "bad.wk").write_bytes(data[:40] + b"?" + data[41:])
    (tmp_path / "none.wk").write_bytes(b"WK")
    got = {r["path"].rsplit("/", 1)[1]: r for r in images.read_images(spark, str(tmp_path), "PERMISSIVE").collect()}
    assert bytes(got["a.wk"]["pixels"]) == bytes(range(18)) and bytes(got["b.wk"]["pixels"]) == bytes(range(16))
    assert got["a.wk"]["custom"] == b"{}" and got["b.wk"]["custom"] is None and got["bad.wk"]["error"] and got["none.wk"]["error"]
    assert images.read_images(spark, str(tmp_path), "DROPMALFORMED").count() == 2
    with pytest.raises(Exception, match="container|ContainerError"):
        images.read_images(spark, str(tmp_path)).collect()
    info = {r["path"].rsplit("/", 1)[1]: r for r in images.info(spark, str(tmp_path)).collect()}
    assert info["b.wk"]["color_type"] == "Rgba" and info["b.wk"]["has_alpha"] and info["a.wk"]["raw_bytes"] == 18 and info["none.wk"]["width"] is None
    broken = bytearray(data)
    struct.pack_into("<I", broken, 16, 9)
    one = spark.createDataFrame([("p", broken)], "path string, content binary")
    assert images.headers(one).first()["header"] is None
    assert images.decode(one.limit(0)).count() == 0


def test_wrong_rasters_raise(spark):
    with pytest.raises(Exception, match="needs 1[68] bytes"):
        images.encode(_raster(spark).withColumn("pixels", F.lit(bytearray(b"1")))).collect()
    with pytest.raises(codec.CodecError):
        images.encode(_raster(spark), codec.CodecConfig("legacy", 85))


def test_benchmark(spark):
    got = images.benchmark(_raster(spark)).collect()
    assert len(got) == 14 and all(r["psnr"] == 99.0 for r in got if r["quality"] == 100)
