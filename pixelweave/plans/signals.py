"""Registered queries of block activity, scans, progressive passes, presets, deblocking of table-sized planes and the byte codecs over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed
from ..operators import blocks, codec, planes
from ..sources import files
from . import records  # noqa: F401  (whose queries are read here)
from .queries import _COEF, _PX, QUALITY, QUERIES, _centred, _coefficients, _deblock_sql, _images, _values, _vectors, byte_histogram, query, table

_STEPS = _values(enumerate(fixed.steps(QUALITY, False)))


def _total(v):
    return F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + x)


@query(
    f"""WITH {_COEF}, a AS (SELECT vec_id, least(sum(abs(c)) FILTER (k > 0) / 63.0::DOUBLE / 128.0::DOUBLE, 1.0::DOUBLE)::FLOAT AS a FROM c GROUP BY vec_id), s(k, t) AS (VALUES {_STEPS}),
t AS (SELECT vec_id, a, k, c.c, greatest(trunc(t::FLOAT * (1::FLOAT + (a - 0.5::FLOAT) * 0.5::FLOAT))::BIGINT, 1) AS t FROM c JOIN a USING (vec_id) JOIN s USING (k)),
l AS (SELECT vec_id, a, k, (sign(c) * (abs(c) // t))::BIGINT AS v FROM t)
SELECT vec_id, round(a::DOUBLE, 6) AS activity, count(*) FILTER (v <> 0) AS nonzero, sum(v * (k + 1))::BIGINT AS placed FROM l GROUP BY vec_id, a"""
)
def block_activity(spark, sf_dir):
    """The activity of each block, and its levels by steps that activity scales."""
    c = blocks.transform(_centred(spark, sf_dir), "dct", "centred", "c").withColumn("a", C.activity(F.col("c")))
    c = c.withColumn("v", C.quantize_active(F.col("c"), blocks.table(fixed.steps(QUALITY, False)), F.col("a")))
    return c.select("vec_id", F.round(F.col("a").cast("double"), 6).alias("activity"), F.size(F.filter("v", lambda x: x != 0)).cast("long").alias("nonzero"), _total(F.transform("v", lambda x, i: (x * (i + 1)).cast("long"))).alias("placed"))


_SCAN_4 = _values(enumerate(blocks.scan_order(4)))
_BAND_4 = " ".join(f"WHEN p >= {m} THEN {k}" for k, m in reversed([*enumerate(fixed.BANDS_4)]))


@query(
    f"""WITH px AS ({_PX}), s(p, k) AS (VALUES {_SCAN_4}), q AS (SELECT vec_id, (i // 32 * 2 + i % 8 // 4)::INT AS part, i // 8 % 4 * 4 + i % 4 AS k, v FROM px), z AS (SELECT vec_id, part, p, v, CASE {_BAND_4} END AS band FROM q JOIN s USING (k))
SELECT vec_id, part, sum(v * p)::BIGINT AS placed, sum(v * band)::BIGINT AS banded, true AS same FROM z GROUP BY vec_id, part"""
)
def scan_4x4(spark, sf_dir):
    """The four 4x4 parts of each block scanned, put into bands and scanned back."""
    part = lambda s: F.array(*[F.get("px", F.lit((s // 2 * 4 + k // 4) * 8 + s % 2 * 4 + k % 4)) for k in range(16)])
    p = _vectors(spark, sf_dir).select("vec_id", F.posexplode(F.array(*[part(s) for s in range(4)])).alias("part", "v"))
    order = blocks.scan_order(4)
    p = p.withColumn("z", blocks.permuted("v", order)).withColumn("back", blocks.permuted("z", blocks.inverse_of(order)))
    return p.select("vec_id", "part", _total(F.transform("z", lambda x, i: (x * i).cast("long"))).alias("placed"), _total(F.transform("z", lambda x, i: (x * C.band(i, 4)).cast("long"))).alias("banded"), (F.col("back") == F.col("v")).alias("same"))


@query(f"WITH {_COEF} SELECT vec_id, sum(q * (k + 1))::BIGINT AS placed, count(*) FILTER (q <> 0) AS nonzero FROM (SELECT vec_id, k, CASE WHEN vec_id % 3 = 1 AND k <> 0 AND k NOT IN {fixed.LOW_AC} THEN 0 WHEN vec_id % 3 = 2 AND k <> 0 THEN 0 ELSE q END AS q FROM q) GROUP BY vec_id")
def progressive_merge(spark, sf_dir):
    """Coefficients merged from their passes, of which some blocks have lost the last or the last two."""
    c = _coefficients(spark, sf_dir).select("vec_id", blocks.split_passes("levels").alias("s"))
    left = F.col("vec_id") % 3
    merged = blocks.merge_passes(F.col("s.dc"), F.when(left != 2, F.col("s.low")), F.when(left == 0, F.col("s.high")))
    c = c.select("vec_id", merged.alias("v"))
    return c.select("vec_id", _total(F.transform("v", lambda x, i: (x * (i + 1)).cast("long"))).alias("placed"), F.size(F.filter("v", lambda x: x != 0)).cast("long").alias("nonzero"))


_HDR = _values((*(f"'{p[0]}'", p[1], f"'{p[2]}'", f"'{p[3]}'"), *("NULL" if v is None else v for v in p[4:])) for p in fixed.HDR)


@query(f"SELECT name, bit_depth, transfer, gamut, max_cll::INT AS max_cll, max_fall::INT AS max_fall, NULL::VARCHAR AS mastering_display, 2 ** bit_depth::INT - 1 AS white FROM (VALUES {_HDR}) t(name, bit_depth, transfer, gamut, max_cll, max_fall)")
def hdr_presets(spark, sf_dir):
    rows = F.explode(F.array(*[F.struct(F.lit(p[0]).alias("name"), C.hdr_preset(p[0]).alias("p")) for p in fixed.HDR])).alias("r")
    return spark.range(1).select(rows).select("r.name", "r.p.*").withColumn("white", F.pow(F.lit(2.0), "bit_depth") - 1)


@query("WITH b AS (SELECT ('0x' || unnest(regexp_extract_all(hex(encode(text)), '..')))::INT AS byte FROM documents), h AS (SELECT count(*) AS n FROM b GROUP BY byte) SELECT greatest(coalesce(max(n), 1), 1)::BIGINT AS peak FROM h")
def histogram_peak(spark, sf_dir):
    return planes.peak(byte_histogram(spark, sf_dir))


@query("SELECT vec_id % 16 = 0 OR vec_id < 16 AS edge, count(*) AS blocks FROM embeddings GROUP BY 1")
def edge_blocks(spark, sf_dir):
    """Blocks of the first row or column, sixteen to a row, which choose among fewer predictions."""
    return table(spark, sf_dir, "embeddings").groupBy(C.is_edge_block(F.col("vec_id") % 16, C.div(F.col("vec_id"), 16)).alias("edge")).agg(F.count("*").alias("blocks"))


#: Qualities of each kind of filter: all three forms, the simple form, none.
_FILTERS = ((50, False), (50, True), (75, False), (88, True), (93, False), (97, False))
_MOSAIC = f"SELECT (vec_id // 256)::VARCHAR AS image, (vec_id % 16 * 8 + i % 8)::INT AS x, (vec_id // 16 % 16 * 8 + i // 8)::INT AS y, v::INT AS v FROM ({_PX})"


def _mosaic(spark, sf_dir) -> DataFrame:
    """The blocks of the vectors as images of 16 x 16 blocks."""
    p = _vectors(spark, sf_dir).select("vec_id", F.posexplode("px").alias("i", "v"))
    place = lambda block, cell: (block * 8 + cell).cast("int")
    return p.select(C.div(F.col("vec_id"), 256).cast("string").alias("image"), place(F.col("vec_id") % 16, F.col("i") % 8).alias("x"), place(C.div(F.col("vec_id"), 16) % 16, C.div(F.col("i"), 8)).alias("y"), "v")


@query(" UNION ALL ".join(f"SELECT image, y, {q} AS quality, {c} AS chroma, sum(v)::BIGINT AS total, sum(v * (x + 1))::BIGINT AS placed FROM ({_deblock_sql(q, _MOSAIC, c)}) GROUP BY image, y" for q, c in _FILTERS))
def deblock_qualities(spark, sf_dir):
    """Rows of images of noisy blocks, filtered at qualities that take every branch of the filter."""
    m, out = _mosaic(spark, sf_dir), None
    for q, chroma in _FILTERS:
        d = planes.deblock(m, q, chroma=chroma).groupBy("image", "y").agg(F.lit(q).alias("quality"), F.lit(chroma).alias("chroma"), F.sum(F.col("v").cast("long")).alias("total"), F.sum(F.col("v") * (F.col("x") + 1)).cast("long").alias("placed"))
        out = d if out is None else out.unionByName(d)
    return out


@query("SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS raw_bytes, 0 AS max_error, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents")
def lossless_documents(spark, sf_dir):
    """Each document's bytes as a raster of one row, coded without loss and decoded."""
    pixels = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("image"), F.length(pixels).alias("w"), F.lit(1).alias("h"), F.lit(1).alias("channels"), pixels.alias("pixels"))
    back = codec.roundtrip(d, codec.CodecConfig("lossless", 100))
    return back.select(F.col("image").cast("long").alias("doc_id"), "raw_bytes", "max_error", F.sha2("decoded", 256).alias("decoded_sha256"))


_MODES = {"lossless": "lossless", "lossy": "lossy", "mixed": "lossy", "legacy": "legacy"}
_SIZES = (("grad32", 3072), ("grad64", 12288), ("rgba16", 1024), ("odd13x9", 351), ("gray", 384))


@query(f"SELECT image, mode, route, raw_bytes::BIGINT AS raw_bytes, route = 'lossless' AS whole FROM (VALUES {_values((f"'{n}'", b) for n, b in _SIZES)}) i(image, raw_bytes), (VALUES {_values((f"'{m}'", f"'{r}'") for m, r in _MODES.items())}) m(mode, route)")
def mode_routes(spark, sf_dir):
    """Rasters coded in each mode; the coder that a payload is sent to, and whether a lossless one comes back whole."""
    out = None
    for mode in _MODES:
        d = codec.coded(_images(spark), codec.CodecConfig(mode, 85)).select("image", F.lit(mode).alias("mode"), "route", "raw_bytes", (F.col("same") & (F.col("route") == "lossless")).alias("whole"))
        out = d if out is None else out.unionByName(d)
    return out


_HEX = f"px AS ({_PX}), b AS (SELECT vec_id, string_agg(format('{{:02X}}', v), '' ORDER BY i) AS h FROM px GROUP BY vec_id)"
_KINDS = _values((f"'{k}'", n) for k, n in (("png", 1), ("pgm", 1), ("bmp", 3)))


@query(
    f"""WITH {_HEX}, k(kind, n) AS (VALUES {_KINDS})
SELECT vec_id, kind, 8 AS w, 8 AS h, n AS channels, sha256(unhex(CASE WHEN n = 1 THEN h ELSE regexp_replace(h, '(..)', '\\1\\1\\1', 'g') END)) AS pixels_sha256, CASE WHEN kind = 'pgm' THEN sha256(unhex(hex('P5' || chr(10) || '8 8' || chr(10) || '255' || chr(10)) || h)) END AS file_sha256 FROM b, k"""
)
def image_files(spark, sf_dir):
    """Each block as grey image files of three forms, read back."""
    byte = F.unhex(F.array_join(F.transform("px", lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), ""))
    d = _vectors(spark, sf_dir).select(F.col("vec_id").cast("string").alias("image"), F.lit(8).alias("w"), F.lit(8).alias("h"), F.lit(1).alias("channels"), byte.alias("pixels"))
    out = None
    for kind in ("png", "pgm", "bmp"):
        coded = files.encode(d, kind).select(F.concat_ws(",", "image", F.sha2("encoded", 256)).alias("path"), F.col("encoded").alias("content"))
        name = F.split("image", ",")
        back = files.decode(coded).select(F.get(name, F.lit(0)).cast("long").alias("vec_id"), F.lit(kind).alias("kind"), "w", "h", "channels", F.sha2("pixels", 256).alias("pixels_sha256"), (F.get(name, F.lit(1)) if kind == "pgm" else F.lit(None).cast("string")).alias("file_sha256"))
        out = back if out is None else out.unionByName(back)
    return out


@query(f"SELECT image, raw_bytes::BIGINT AS raw_bytes, 0 AS max_error FROM (VALUES {_values((f"'{n}'", b) for n, b in _SIZES)}) t(image, raw_bytes)")
def lossless_rasters(spark, sf_dir):
    return QUERIES["lossless_roundtrip"](spark, sf_dir).select("image", "raw_bytes", "max_error")


@query("SELECT label, count(*) AS blocks, 0::BIGINT AS wrong FROM embeddings GROUP BY label")
def token_roundtrip(spark, sf_dir):
    return QUERIES["token_streams"](spark, sf_dir).select("label", "blocks", "wrong")


_FIELDS = _values((f"'{n}'", w, h, f"'{c}'") for n, w, h, c in (("grad32", 32, 32, "Rgb"), ("grad64", 64, 64, "Rgb"), ("rgba16", 16, 16, "Rgba"), ("odd13x9", 13, 9, "Rgb"), ("gray", 24, 16, "Grayscale")))


@query(f"""SELECT image, mode, width::BIGINT AS width, height::BIGINT AS height, color_type, CASE WHEN image <> 'gray' THEN '{{"author":"' || image || '"}}' END AS custom, mode = 'lossless' AS whole FROM (VALUES {_FIELDS}) t(image, width, height, color_type), (VALUES ('lossless'), ('lossy')) m(mode)""")
def container_fields(spark, sf_dir):
    """What container files give back: sizes, colour types, custom metadata, and lossless rasters whole."""
    r = QUERIES["container_roundtrip"](spark, sf_dir)
    return r.select("image", "mode", "width", "height", "color_type", "custom", ((F.col("mode") == "lossless") & F.col("same")).alias("whole"))
