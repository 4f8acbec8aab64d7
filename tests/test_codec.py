import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pixelweave.functions import fixed
from pixelweave.operators import codec
from pixelweave.operators.blocks import forward, int_forward, int_inverse, inverse
from pixelweave.sources import container


@given(st.lists(st.integers(-2000, 2000), min_size=64, max_size=64))
@settings(max_examples=60, deadline=None)
def test_block_code_roundtrip(v):
    assert codec.block_decode(codec.pack(codec.block_code(v))) == v


def test_strict_block_code_loses_a_full_block():
    v = [1] * 64
    assert codec.block_decode(codec.pack(codec.block_code(v, strict=True)), strict=True) != v
    assert codec.block_decode(codec.pack(codec.block_code(v))) == v


@pytest.mark.parametrize("v", [0, 1, 2, 3, 7, 15, 31, 100, 255])
def test_golomb(v):
    assert codec.Bits(codec.pack(codec.golomb(v))).golomb() == v


@given(st.binary(max_size=400))
@settings(max_examples=60, deadline=None)
def test_huffman_roundtrip(data):
    coded = codec.huffman_encode(data)
    assert codec.huffman_decode(coded) == data
    if len(data) > 8:
        with pytest.raises(codec.CodecError):
            codec.huffman_decode(coded[:-1])


@given(st.lists(st.integers(-3000, 3000) | st.just(0), max_size=600))
@settings(max_examples=60, deadline=None)
def test_rle_roundtrip(v):
    assert codec.unrle(codec.rle(np.array(v, np.int64))).tolist() == v


@given(st.integers(1, 4), st.integers(1, 9), st.integers(1, 9), st.randoms())
@settings(max_examples=60, deadline=None)
def test_lossless_is_exact(channels, w, h, rnd):
    raw = bytes(rnd.randrange(256) for _ in range(w * h * channels))
    config = codec.CodecConfig("lossless", 100)
    assert codec.decode(codec.encode(raw, w, h, channels, config), w, h, channels, config) == raw


def test_transforms_invert():
    x = np.random.default_rng(1).integers(-128, 128, (50, 8, 8))
    assert abs(inverse(forward(x)) - x).max() <= 1 and abs(int_inverse(int_forward(x)) - x).max() <= 2
    y = np.random.default_rng(2).integers(-128, 128, (20, 16, 16))
    assert abs(inverse(forward(y, 16), 16) - y).max() <= 1


def test_zigzag_and_prediction():
    z = fixed.zigzag()
    assert z[:6] == [0, 1, 8, 16, 9, 2] and sorted(z) == [*range(64)]
    assert (codec.predict("DC", np.full(8, 100), np.full(8, 100), 100) == 100).all()
    assert codec.best_mode(np.full((8, 8), 128), np.full(8, 128), np.full(8, 128), 128, True)[0] in (0, 1, 2)


def test_bad_payloads_raise():
    config = codec.CodecConfig("lossy", 85)
    for bad in (b"", bytes(262), bytes(259) + b"\4\0\0\0abcd"):
        with pytest.raises(codec.CodecError):
            codec.decode(bad, 8, 8, 3, config)
    with pytest.raises(codec.CodecError):
        codec.encode(b"123", 8, 8, 3, config)


def test_container(spark, tmp_path):
    head = container.header(9, 7, 2, 0, 85)
    data = container.write_file([(b"IHDR", head), (b"IDAT", b"payload")])
    (tmp_path / "a.wk").write_bytes(data)
    (tmp_path / "b.wk").write_bytes(data[:-20])
    got = container.chunks(spark, str(tmp_path), "PERMISSIVE").orderBy("seq").collect()
    assert [r["tag"] for r in got] == ["IHDR", "IDAT", "IEND"] and container.parse_header(bytes(got[0]["data"]))["width"] == 9
    with pytest.raises(container.ContainerError):
        list(container.read_chunks(data[:30] + b"x" + data[31:]))
    (tmp_path / "b.wk").unlink()
    spark.dataSource.register(container.ChunkSource)
    assert spark.read.format("chunks").option("path", str(tmp_path)).load().count() == 3
    framed = spark.range(1).selectExpr("'IHDR' t", f"unhex('{head.hex()}') d").select(container.frame(F.col("t"), F.col("d")).alias("f")).first()["f"]
    assert bytes(framed) == data[8 : 8 + 28]


def test_stream_of_events(spark):
    from pixelweave.streaming.ingest import windowed

    path = "/root/testdata/sf0.001"
    schema = spark.read.parquet(f"{path}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(path)
    q = windowed(stream).writeStream.outputMode("complete").format("memory").queryName("seen").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("seen").groupBy().sum("n").first()[0] == 1000


def _fibonacci_bytes():
    """Counts that give codes of over 16 bits, beyond the decoder's table."""
    counts = [1, 1]
    while len(counts) < 24:
        counts.append(counts[-1] + counts[-2])
    data = np.repeat(np.arange(24, dtype=np.uint8), counts)
    np.random.default_rng(3).shuffle(data)
    return data.tobytes()


def test_huffman_long_codes_and_slices():
    data = _fibonacci_bytes()
    codes = codec.huffman_codes(np.bincount(np.frombuffer(data, np.uint8), minlength=256).tolist())
    assert max(map(len, codes.values())) > codec.PREFIX and len(data) > codec.STEP
    bits = "".join(codes[b] for b in data)
    coded = codec.huffman_encode(data)
    assert coded[1032:] == np.packbits(np.frombuffer(bits.encode(), np.uint8) - 48).tobytes()
    assert codec.huffman_decode(coded) == data
    for n in (codec.STEP - 1, codec.STEP, codec.STEP + 1):
        assert codec.huffman_decode(codec.huffman_encode(bytes(n))) == bytes(n)


def test_row_filters_at_slab_borders(monkeypatch):
    raw = np.random.default_rng(4).integers(0, 256, (40, 30)).astype(np.uint8)
    raw[::3] = np.arange(30)
    whole = codec.filter_rows(raw, 3)
    monkeypatch.setattr(codec, "SLAB", 70)
    assert (codec.filter_rows(raw, 3) == whole).all() and (codec.unfilter_rows(whole, 3) == raw).all()


def test_payloads_are_routed():
    raw = bytes(range(256)) * 3
    for mode in ("lossy", "mixed"):
        config = codec.CodecConfig(mode, 100)
        payload = codec.encode(raw, 16, 16, 3, config)
        assert codec.route(payload, mode) == "lossy" and codec.decode(payload, 16, 16, 3, config) == codec.decode(payload, 16, 16, 3, codec.CodecConfig("lossy", 100))
    old = codec.encode(raw, 16, 16, 3, codec.CodecConfig("legacy", 100))
    assert codec.route(old, "lossy") == "legacy"
    assert codec.decode(old, 16, 16, 3, codec.CodecConfig("lossy", 100)) == codec.decode(old, 16, 16, 3, codec.CodecConfig("legacy", 100))


def test_probabilities_are_set_and_reset():
    table = fixed.Probabilities()
    assert (table.get(0, 1, 0, 0), table.get(0, 9, 2, 3), table.get(1, 1, 0, 0)) == (176, 189, 128)
    table.set(2, 99, 1, 99, 7)
    assert (table.get(2, 7, 1, 10), table.get(2, 7, 1, 9)) == (7, 128)
    table.reset()
    assert table.get(2, 7, 1, 10) == 128


@pytest.mark.parametrize("depth, data, samples", [(8, "00ff", [0, 65535]), (10, "010203041b05", [256, 576, 896, 1216]), (12, "12345678", [4688, 13408]), (16, "3412ff", [4660]), (9, "01", [256]), (10, "01020304", []), (12, "", [])])
def test_unpacked_samples(spark, depth, data, samples):
    from pixelweave.functions import columns

    d = codec.samples(spark.createDataFrame([(1, bytearray.fromhex(data)), (2, None)], "k int, data binary"), "data", depth)
    got = {r["k"]: (r["samples"], r["low"]) for r in d.select("k", "samples", columns.narrow(F.col("samples")).alias("low")).collect()}
    assert got == {1: (samples, [s >> 8 for s in samples]), 2: (None, None)}
