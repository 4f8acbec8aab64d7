"""Registered queries over metadata, token streams, markers and container files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed
from ..functions import metadata as M
from ..operators import codec, rangecoder
from ..sources import container, images
from .queries import _COEF, _coefficients, _images, _values, query, table

_TYPES = _values((k, f"'{t}'") for k, t in enumerate(fixed.BLOCK_TYPES))
_BANDS = _values((node, b + 1, c, p) for node, bands in fixed.BAND_PROBS.items() for b, row in enumerate(bands) for c, p in enumerate(row))


@query(
    f"""WITH t(k, block_type) AS (VALUES {_TYPES}), b(node, band, context, p) AS (VALUES {_BANDS})
SELECT block_type, x.band::INT AS band, y.context::INT AS context, z.node::INT AS node, coalesce(b.p, 128)::INT AS prob
FROM t, range(8) x(band), range(3) y(context), range(11) z(node) LEFT JOIN b ON t.k = 0 AND b.band = x.band AND b.context = y.context AND b.node = z.node"""
)
def coeff_probabilities(spark, sf_dir):
    rows = [(n, b, c, k, fixed.probability(t, b, c, k)) for t, n in enumerate(fixed.BLOCK_TYPES) for b in range(8) for c in range(3) for k in range(11)]
    return spark.createDataFrame(rows, "block_type string, band int, context int, node int, prob int")


@query(f"WITH {_COEF}, l AS (SELECT *, coalesce(lag(q) OVER (PARTITION BY vec_id ORDER BY p), 0) AS prev FROM q) SELECT least(abs(prev), 2)::INT AS context, count(*) AS n, sum(abs(q))::BIGINT AS total FROM l GROUP BY 1")
def coefficient_contexts(spark, sf_dir):
    c = _coefficients(spark, sf_dir).select(F.explode(F.arrays_zip(C.coefficient_contexts(F.col("q")).alias("context"), F.col("q"))).alias("z")).select("z.*")
    return c.groupBy("context").agg(F.count("*").alias("n"), F.sum(F.abs("q").cast("long")).alias("total"))


@query()
def token_streams(spark, sf_dir):
    """Range-coded token streams of all blocks, and how many decode to other coefficients."""
    coded = rangecoder.encode_tokens(_coefficients(spark, sf_dir).select("vec_id", "label", F.col("q").cast("array<int>").alias("q")), "q", "stream")
    back = rangecoder.decode_tokens(coded, "stream", "back")
    return back.groupBy("label").agg(F.count("*").alias("blocks"), F.sum(F.length("stream").cast("long")).alias("bytes"), F.count_if(F.col("back") != F.col("q")).alias("wrong"))


@query(
    """WITH e AS (SELECT event_id, event_type, value, (props->>'k')::BIGINT AS k, extract(minute FROM ts)::BIGINT AS m FROM events)
SELECT event_id, event_type AS camera_make, 'M' || k AS camera_model, k AS iso, value AS aperture, CASE WHEN m % 7 <> 0 THEN round(k / (m % 7)::DOUBLE, 6) END AS exposure_time, NULL::DOUBLE AS focal_length,
CASE WHEN k % 2 = 0 THEN value + k END AS gps_sum, (CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END + 7 - CASE WHEN k % 2 = 0 THEN 0 ELSE 1 END)::INT AS tags FROM e"""
)
def exif_readings(spark, sf_dir):
    """Exif maps of events: built, changed and read. The exposure is a rational; an integer focal length reads as null; odd k have no longitude."""
    k, m = F.try_variant_get(F.parse_json("props"), "$.k", "bigint"), F.minute("ts")
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value", k.alias("k"), m.cast("bigint").alias("m"))
    k = F.col("k")
    x = M.exif(make=F.col("event_type"), model=F.concat(F.lit("M"), k), iso=k, aperture=F.col("value"), latitude=F.col("value"), longitude=F.when(k % 2 == 0, k), software=F.when(k % 3 == 0, F.lit("s")))
    x = M.set_tag(M.set_tag(x, "ExposureTime", M.exif_value("rational", k, F.col("m") % 7)), "FocalLength", M.exif_value("int", k))
    r = M.camera(F.col("x"))
    gps = r.pop("gps_coordinates")
    exposure = F.round(r["exposure_time"], 6)
    return e.withColumn("x", x).select("event_id", *[r[n].alias(n) for n in ("camera_make", "camera_model", "iso", "aperture", "focal_length")], exposure.alias("exposure_time"), (gps["lat"] + gps["lon"]).alias("gps_sum"), F.size("x").alias("tags"))


@query(
    """SELECT doc_id, 'Doc ' || doc_id AS title, least(greatest(n_chars % 9 - 2, 0), 5)::INT AS rating, 2 AS creators, lang AS subject, source AS origin, NULL::VARCHAR AS rights FROM documents"""
)
def xmp_fields(spark, sf_dir):
    x = M.xmp(title=F.concat(F.lit("Doc "), F.col("doc_id")), rating=F.col("n_chars") % 9 - 2, creator=F.array(F.lit("a")))
    x = M.set_custom(M.xmp_add(M.xmp_add(x, "creator", F.lit("b")), "subject", F.col("lang")), "origin", F.col("source"))
    d = table(spark, sf_dir, "documents").select("doc_id", x.alias("x"))
    return d.select("doc_id", "x.title", "x.rating", F.size("x.creator").alias("creators"), F.get("x.subject", F.lit(0)).alias("subject"), M.get_custom(F.col("x"), "origin").alias("origin"), "x.rights")


@query(f"SELECT name, space, intent, title, about, space IN ('AdobeRGB', 'ProPhotoRGB', 'DisplayP3', 'Rec2020') AS wide, space = 'Rec2020' AS hdr FROM (VALUES {_values(tuple(f"'{v}'" for v in p) for p in fixed.ICC)}) t(name, space, intent, title, about)")
def icc_profiles(spark, sf_dir):
    rows = F.explode(F.array(*[F.struct(F.lit(p[0]).alias("name"), M.icc(p[0]).alias("p")) for p in fixed.ICC])).alias("r")
    wide, hdr = C.icc_flags(F.col("r.p.color_space"))
    return spark.range(1).select(rows).select("r.name", F.col("r.p.color_space").alias("space"), F.col("r.p.rendering_intent").alias("intent"), F.col("r.p.profile_name").alias("title"), F.col("r.p.description").alias("about"), wide.alias("wide"), hdr.alias("hdr"))


@query("SELECT event_id, (props->>'k')::BIGINT AS k_int, NULL::VARCHAR AS k_text, NULL::DOUBLE AS k_float, true AS flag, 1.5::DOUBLE AS ratio, 2 AS left_over, false AS has_ratio FROM events")
def custom_fields(spark, sf_dir):
    """Typed reading of custom fields, of which one is added and one removed."""
    f = M.set_field(M.custom_fields(F.col("props")), "flag", F.parse_json(F.lit("true")))
    f = M.set_field(f, "ratio", F.parse_json(F.lit("1.5")))
    e = table(spark, sf_dir, "events").select("event_id", f.alias("f"))
    left, f = M.remove_field(F.col("f"), "ratio"), F.col("f")
    return e.select("event_id", M.get_typed(f, "k", "int").alias("k_int"), M.get_typed(f, "k", "string").alias("k_text"), M.get_typed(f, "k", "float").alias("k_float"), M.get_typed(f, "flag", "bool").alias("flag"), M.get_typed(f, "ratio", "float").alias("ratio"), F.size(left).alias("left_over"), F.map_contains_key(left, "ratio").alias("has_ratio"))


@query(
    """SELECT event_type, count(*) AS animations, sum(round(value)::BIGINT + 100)::BIGINT AS duration_ms, count(*)::BIGINT AS keyframes, sum(user_id % 10)::BIGINT AS offsets FROM events GROUP BY event_type"""
)
def animation_frames(spark, sf_dir):
    """A two-frame animation of each event: a keyframe with the event's delay, and a delta frame."""
    first = M.frame(8, 8, F.lit(None), delay_ms=F.round("value").cast("long"), x_offset=F.col("user_id") % 10)
    a = M.add_frame(M.add_frame(M.animation(), first, True), M.frame(8, 8, F.lit(None), blend_mode="Over"), False)
    e = table(spark, sf_dir, "events").select("event_type", "user_id", "value").select("event_type", a.alias("a"))
    total = lambda f: F.aggregate("a.frames", F.lit(0).cast("long"), lambda s, x: s + f(x))
    return e.groupBy("event_type").agg(F.count("*").alias("animations"), F.sum(total(lambda x: x["delay_ms"])).alias("duration_ms"), F.sum(total(lambda x: x["is_keyframe"].cast("long"))).alias("keyframes"), F.sum(total(lambda x: x["x_offset"])).alias("offsets"))


@query(
    """WITH d AS (SELECT doc_id, octet_length(encode(text)) AS n, hex(encode(text)) AS h FROM documents),
m AS (SELECT doc_id, n, CASE WHEN n > 256 THEN (n - 257) // 260 + 1 ELSE 0 END AS k, h FROM d),
r AS (SELECT doc_id, n, k, array_to_string(list_concat([substr(h, 1, 512)], [substr(h, 513 + j * 520, 520) for j in range(0, k)]), 'FFD00000') AS h FROM m)
SELECT doc_id, k::BIGINT AS markers, (n + 4 * k)::BIGINT AS bytes, CASE WHEN k > 0 THEN 256 END::INT AS first_at, md5(h) AS hex_md5 FROM r"""
)
def resync_markers(spark, sf_dir):
    marked = C.insert_markers(F.encode("text", "utf-8"), 256)
    d = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("n"), marked.alias("b"))
    return d.select("doc_id", C.div(F.length("b") - F.col("n"), 4).alias("markers"), F.length("b").cast("long").alias("bytes"), C.find_marker(F.col("b")).alias("first_at"), F.md5(F.hex("b")).alias("hex_md5"))


def _files(spark, config):
    author = F.concat(F.lit('{"author":"'), F.col("image"), F.lit('"}'))
    return images.encode(_images(spark).repartition("image"), config, custom=F.when(F.col("image") != "gray", author)).select(F.col("image").alias("path"), F.col("encoded").alias("content"))


@query()
def container_roundtrip(spark, sf_dir):
    """Rasters to container files and back, lossless and lossy."""
    out = []
    for mode in ("lossless", "lossy"):
        back = images.decode(_files(spark, codec.CodecConfig(mode, 85))).withColumnRenamed("path", "image")
        out.append(back.join(_images(spark).select("image", F.col("pixels").alias("raw")), "image").select("image", F.lit(mode).alias("mode"), "header.width", "header.height", "header.color_type", (F.col("pixels") == F.col("raw")).alias("same"), F.col("custom").cast("string").alias("custom")))
    return out[0].unionByName(out[1])


@query(
    f"""SELECT * FROM (VALUES {_values(((f"'{i}'"), w, h, f"'{c}'", "'Lossy'", 85, str(a)) for i, w, h, c, a in (('grad32', 32, 32, 'Rgb', False), ('grad64', 64, 64, 'Rgb', False), ('rgba16', 16, 16, 'Rgba', True), ('odd13x9', 13, 9, 'Rgb', False), ('gray', 24, 16, 'Grayscale', False)))}) t(path, width, height, color_type, compression_mode, quality, has_alpha)"""
)
def header_scan(spark, sf_dir):
    return images.headers(_files(spark, codec.CodecConfig("lossy", 85))).select("path", "header.width", "header.height", "header.color_type", "header.compression_mode", "header.quality", "header.has_alpha")


@query()
def codec_benchmark(spark, sf_dir):
    """Size and fidelity of each raster at each quality."""
    return images.benchmark(_images(spark))
