"""The registered queries of the codec's operators, with SQL for each that SQL can express."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed
from ..operators import blocks, codec, planes
from ..sources import container

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
QUALITY = 85


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = re.sub(r"\bby\b", '"by"', sql)  # a column; keywords are in capitals
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.from_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")).drop("embedding")


def _centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).withColumn("centred", F.transform("px", lambda x: x - 128))


def _coefficients(spark: SparkSession, sf_dir: str, quality: int = QUALITY) -> DataFrame:
    """Adds q: quantized coefficients in scan order."""
    c = blocks.transform(_centred(spark, sf_dir), "dct", "centred", "c")
    return c.withColumn("levels", blocks.quantized("c", quality)).withColumn("q", blocks.permuted("levels", fixed.zigzag()))


def _values(rows) -> str:
    return ", ".join(f"({', '.join(map(str, r))})" for r in rows)


_STEPS = fixed.steps(QUALITY, False)
_PX = "SELECT vec_id, label, i - 1 AS i, least(greatest(round(128 + 127 * embedding[i]::DOUBLE), 0), 255)::BIGINT AS v FROM embeddings, range(1, 65) r(i)"
_W = _values((k, i, repr(float(fixed.basis()[k // 8, i // 8] * fixed.basis()[k % 8, i % 8]))) for k in range(64) for i in range(64))
_ZZ = _values((p, i, _STEPS[i]) for p, i in enumerate(fixed.zigzag()))
#: px, c (transform coefficients), q (quantized, p: place in the scan).
_COEF = f"""px AS ({_PX}), w(k, i, w) AS (VALUES {_W}), zz(p, k, t) AS (VALUES {_ZZ}),
c AS (SELECT vec_id, label, k, round(round(sum((v - 128) * w), 6))::BIGINT AS c FROM px JOIN w USING (i) GROUP BY ALL),
q AS (SELECT vec_id, label, p, k, c, (sign(c) * ((abs(c) + t // 2) // t))::BIGINT AS q FROM c JOIN zz USING (k))"""


@query(f"WITH {_COEF} SELECT label, count(DISTINCT vec_id) AS blocks, count(*) FILTER (q <> 0) AS nonzero, sum(q * p)::BIGINT AS scan_sum FROM q GROUP BY label")
def dct_quant_zigzag_by_label(spark, sf_dir):
    per = _coefficients(spark, sf_dir).select("label", F.size(F.filter("q", lambda x: x != 0)).alias("n"), F.aggregate(F.transform("q", lambda x, i: (x * i).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x).alias("s"))
    return per.groupBy("label").agg(F.count("*").alias("blocks"), F.sum("n").cast("long").alias("nonzero"), F.sum("s").alias("scan_sum"))


@query(
    f"""WITH {_COEF}, back AS (SELECT vec_id, label, w.i, round(round(sum(c * w), 6))::BIGINT + 128 AS b FROM c JOIN w USING (k) GROUP BY ALL)
SELECT label, max(abs(b - v))::INT AS max_error, sum(abs(b - v))::BIGINT AS total_error FROM back JOIN px USING (vec_id, label, i) GROUP BY label"""
)
def idct_roundtrip_error(spark, sf_dir):
    c = blocks.transform(_centred(spark, sf_dir), "dct", "centred", "c")
    b = blocks.transform(c, "idct", "c", "back").withColumn("e", F.zip_with("back", "centred", lambda a, b: F.abs(a - b)))
    return b.groupBy("label").agg(F.max(F.array_max("e")).alias("max_error"), F.sum(F.aggregate("e", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total_error"))


_B16 = fixed.basis(16)


@query(
    f"""WITH px AS ({_PX}), g AS (SELECT vec_id // 4 AS g, (vec_id % 4 // 2) * 8 + i // 8 AS y, (vec_id % 2) * 8 + i % 8 AS x, v - 128 AS v FROM px),
b(u, x, w) AS (VALUES {_values((u, x, repr(float(_B16[u, x]))) for u in range(16) for x in range(16))}),
r AS (SELECT g, y, u, sum(v * w) AS s FROM g JOIN b USING (x) GROUP BY ALL),
c AS (SELECT g, b.u AS vv, r.u, round(round(sum(s * w), 6))::BIGINT AS c FROM r JOIN b ON b.x = r.y GROUP BY ALL)
SELECT g, max(c) FILTER (u = 0 AND vv = 0) AS dc, sum(abs(c))::BIGINT AS total FROM c WHERE g IN (SELECT vec_id // 4 FROM embeddings GROUP BY 1 HAVING count(*) = 4) GROUP BY g"""
)
def dct16_blocks(spark, sf_dir):
    v = _centred(spark, sf_dir).select(C.div(F.col("vec_id"), 4).alias("g"), (F.col("vec_id") % 4).alias("k"), "centred")
    four = v.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("k", "centred"))).alias("parts")).where(F.size("parts") == 4)
    cell = lambda i: F.get(F.get(F.col("parts"), (C.div(i, 128) * 2 + C.div(i % 16, 8)).cast("int"))["centred"], (C.div(i, 16) % 8 * 8 + i % 8).cast("int"))
    big = four.select("g", F.transform(F.sequence(F.lit(0), F.lit(255)), cell).alias("v"))
    c = blocks.transform(big, "dct16", "v", "c")
    return c.select("g", F.get("c", F.lit(0)).cast("long").alias("dc"), F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + F.abs(x)).alias("total"))


_IM = fixed.int_basis()


@query(
    f"""WITH px AS ({_PX}), b(u, x, w) AS (VALUES {_values((u, x, int(_IM[u, x])) for u in range(8) for x in range(8))}),
r AS (SELECT vec_id, i // 8 AS y, u, sum((v - 128) * w)::BIGINT AS s FROM px JOIN b ON b.x = i % 8 GROUP BY ALL),
c AS (SELECT vec_id, b.u AS vv, r.u, (sum(s * w)::BIGINT + 2048) >> 12 AS c FROM r JOIN b ON b.x = r.y GROUP BY ALL)
SELECT vec_id, max(c) FILTER (u = 0 AND vv = 0) AS dc, sum(abs(c))::BIGINT AS total FROM c GROUP BY vec_id"""
)
def int_dct(spark, sf_dir):
    c = blocks.transform(_centred(spark, sf_dir), "int_dct", "centred", "c")
    return c.select("vec_id", F.get("c", F.lit(0)).cast("long").alias("dc"), F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + F.abs(x)).alias("total"))


@query(
    f"""WITH px AS ({_PX}), e AS (SELECT *, CASE WHEN i % 8 >= 1 AND i >= 8 THEN abs(v - lag(v, 1) OVER o) + abs(v - lag(v, 8) OVER o) ELSE 0 END AS e FROM px WINDOW o AS (PARTITION BY vec_id ORDER BY i)),
s AS (SELECT vec_id, sum(v)::BIGINT AS sum, sum(v * v)::BIGINT AS sum_sq, min(v)::INT AS low, max(v)::INT AS high, sum(e)::BIGINT AS edges FROM e GROUP BY vec_id),
m AS (SELECT *, sum / 64 AS mean, greatest(0, sum_sq / 64 - (sum / 64) * (sum / 64)) AS variance, edges / (49 * 510.0::DOUBLE) AS d FROM s),
t AS (SELECT *, (CASE WHEN mean < 40 THEN -2 WHEN mean > 215 THEN -1 ELSE 0 END) + (CASE WHEN variance < 50 THEN 2 WHEN variance > 1500 THEN -2 ELSE 0 END) + (CASE WHEN d > 0.25 THEN -2 WHEN d < 0.03 THEN 1 ELSE 0 END) AS k FROM m)
SELECT vec_id, sum, sum_sq, low, high, edges, CASE WHEN variance > 5000 OR variance < 1 OR mean < 5 OR mean > 250 THEN {QUALITY} ELSE least(greatest({QUALITY} + least(greatest(k, -5), 5), 75), 95) END AS qp FROM t"""
)
def block_stats_qp(spark, sf_dir):
    return blocks.block_qp(_vectors(spark, sf_dir), QUALITY).select("vec_id", "sum", "sum_sq", "low", "high", "edges", "qp")


def _base_rows() -> str:
    rows = []
    for chroma, base in ((0, fixed.LUMA), (1, fixed.CHROMA)):
        rows += [(chroma, i, v, fixed.GENTLE_CHROMA[i] if chroma else v, c) for (i, v), c in zip(enumerate(base), fixed.csf_base(bool(chroma)), strict=True)]
    return _values(rows)


@query(
    f"""WITH b(chroma, i, v, gentle, csf) AS (VALUES {_base_rows()}), s AS (SELECT q, CASE WHEN q < 50 THEN 5000 // q ELSE 200 - 2 * q END AS s FROM range(1, 101) r(q)),
k AS (SELECT q, chroma = 1 AS chroma, i, unnest(['adaptive', 'aggressive', 'size', 'csf', 'legacy', 'lossless']) AS kind,
  unnest([CASE WHEN q >= 80 THEN gentle ELSE v END * s, v * CASE WHEN q < 50 THEN s * 11 // 10 ELSE greatest(15, s * 11 // 10) END, v * greatest(15, s * 115 // 100), csf * s, v * s, 100]) AS x FROM b, s)
SELECT q::INT AS q, chroma, kind, i::INT AS i, least(greatest((x + 50) // 100, 1), 255)::INT AS step FROM k"""
)
def quant_tables(spark, sf_dir):
    rows = [(q, chroma, kind, fixed.steps(q, chroma, kind)) for q in range(1, 101) for chroma in (False, True) for kind in ("adaptive", "aggressive", "size", "csf", "legacy", "lossless")]
    return spark.createDataFrame(rows, "q int, chroma boolean, kind string, steps array<int>").select("q", "chroma", "kind", F.posexplode("steps").alias("i", "step"))


def _gradient_sql(w: int, h: int, step: int, blue: int, image: str = "g") -> str:
    return f"SELECT '{image}' AS image, (id % {w})::INT AS x, (id // {w})::INT AS y, (id % {w} * {step} % 256)::INT AS r, (id // {w} * {step} % 256)::INT AS g, {blue} AS b FROM range({w * h}) t(id)"


def _color_sql(space: str) -> str:
    (o1, *a), (o2, *b), (o3, *c), (wr, gb, gr, wb) = fixed.COLOR[space]
    full = space == "full"
    d = "1.0::DOUBLE" if full else "255.0::DOUBLE"
    lin = lambda o, m: f"round(round({o}::DOUBLE + {m[0]}::DOUBLE * r / {d} + {m[1]}::DOUBLE * g / {d} + {m[2]}::DOUBLE * b / {d}, 6))::INT"
    lo, hy, hc = (0, 255, 255) if full else (16, 235, 240)
    y1 = "yy::DOUBLE" if full else "(yy - 16.0::DOUBLE) * 255.0::DOUBLE / 219.0::DOUBLE"
    ch = lambda v: f"({v} - 128.0::DOUBLE)" if full else f"(({v} - 128.0::DOUBLE) * 255.0::DOUBLE / 224.0::DOUBLE)"
    back = lambda e: f"least(greatest(round(round({e}, 6))::INT, 0), 255)"
    return f"""SELECT '{space}' AS space, x, y, yy, cb, cr, {back(f"{y1} + {wr}::DOUBLE * {ch('cr')}")} AS r2, {back(f"{y1} + {gb}::DOUBLE * {ch('cb')} + {gr}::DOUBLE * {ch('cr')}")} AS g2, {back(f"{y1} + {wb}::DOUBLE * {ch('cb')}")} AS b2
FROM (SELECT x, y, least(greatest({lin(o1, a)}, {lo}), {hy}) AS yy, least(greatest({lin(o2, b)}, {lo}), {hc}) AS cb, least(greatest({lin(o3, c)}, {lo}), {hc}) AS cr FROM p)"""


@query(f"WITH p AS ({_gradient_sql(64, 64, 4, 200)}) " + " UNION ALL ".join(_color_sql(s) for s in fixed.COLOR))
def rgb_ycbcr_roundtrip(spark, sf_dir):
    p = planes.gradient(spark, "g", 64, 64, 4, 200)
    out = None
    for space in fixed.COLOR:
        y, cb, cr = C.rgb_to_ycbcr(F.col("r"), F.col("g"), F.col("b"), space)
        s = p.select(F.lit(space).alias("space"), "x", "y", y.alias("yy"), cb.alias("cb"), cr.alias("cr"))
        r, g, b = C.ycbcr_to_rgb(F.col("yy"), F.col("cb"), F.col("cr"), space)
        s = s.select("*", r.alias("r2"), g.alias("g2"), b.alias("b2"))
        out = s if out is None else out.unionByName(s)
    return out


def _plane(spark: SparkSession, w: int = 64, h: int = 64, step: int = 4) -> DataFrame:
    return planes.gradient(spark, "g", w, h, step, 0).select("image", "x", "y", ((F.col("r") * 3 + F.col("g") * 5) % 256).alias("v"))


def _plane_sql(w: int = 64, h: int = 64, step: int = 4) -> str:
    return f"SELECT image, x, y, ((r * 3 + g * 5) % 256)::INT AS v FROM ({_gradient_sql(w, h, step, 0)})"


@query(f"WITH p AS ({_plane_sql(13, 9)}) SELECT X.k::INT AS x, Y.k::INT AS y, ((sum(v) + 2) // 4)::INT AS v FROM range(7) X(k), range(5) Y(k), range(2) dx(d), range(2) dy(d), p WHERE p.x = least(2 * X.k + dx.d, 12) AND p.y = least(2 * Y.k + dy.d, 8) GROUP BY 1, 2")
def chroma_down(spark, sf_dir):
    return planes.downsample(_plane(spark, 13, 9)).select("x", "y", "v")


@query(
    f"""WITH p AS ({_plane_sql(16, 16)}), f AS (SELECT X.k AS x, Y.k AS y FROM range(32) X(k), range(32) Y(k))
SELECT f.x::INT AS x, f.y::INT AS y, round((a.v * (1 - (f.x % 2) * 0.5) + b.v * (f.x % 2) * 0.5) * (1 - (f.y % 2) * 0.5) + (c.v * (1 - (f.x % 2) * 0.5) + d.v * (f.x % 2) * 0.5) * (f.y % 2) * 0.5)::INT AS v
FROM f, p a, p b, p c, p d WHERE a.x = f.x // 2 AND a.y = f.y // 2 AND b.x = least(f.x // 2 + 1, 15) AND b.y = a.y AND c.x = a.x AND c.y = least(f.y // 2 + 1, 15) AND d.x = b.x AND d.y = c.y"""
)
def chroma_up(spark, sf_dir):
    return planes.upsample(_plane(spark, 16, 16)).select("x", "y", "v")


@query(f"WITH p AS ({_plane_sql(13, 9)}) SELECT (X.k // 8)::INT AS bx, (Y.k // 8)::INT AS by, (Y.k % 8 * 8 + X.k % 8)::INT AS i, v FROM range(16) X(k), range(16) Y(k), p WHERE p.x = least(X.k, 12) AND p.y = least(Y.k, 8)")
def edge_pad_blocks(spark, sf_dir):
    return planes.pad(_plane(spark, 13, 9)).select("bx", "by", "i", "v")


@query(
    """WITH m AS (SELECT vec_id::VARCHAR AS image, 100 + vec_id % 300 AS w, 60 + vec_id % 200 AS h FROM embeddings)
SELECT image, c.k::INT AS tile_col, r.k::INT AS tile_row, c.k * 64 AS x, r.k * 64 AS y, least(64, w - c.k * 64) AS width, least(64, h - r.k * 64) AS height FROM m, range(8) c(k), range(8) r(k) WHERE c.k * 64 < w AND r.k * 64 < h"""
)
def tile_grid(spark, sf_dir):
    m = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("image"), (100 + F.col("vec_id") % 300).alias("w"), (60 + F.col("vec_id") % 200).alias("h"))
    t = planes.tiles(m, 64)
    return t.select("image", "tile_col", "tile_row", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "width", "height")


_PRED = """n AS (SELECT *, coalesce(lag(v) OVER (PARTITION BY ch, y ORDER BY x), 0) AS l, coalesce(lag(v) OVER (PARTITION BY ch, x ORDER BY y), 0) AS u FROM s),
m AS (SELECT *, coalesce(lag(u) OVER (PARTITION BY ch, y ORDER BY x), 0) AS c FROM n),
t AS (SELECT *, CASE WHEN abs(u - c) <= abs(l - c) AND abs(u - c) <= abs(l + u - 2 * c) THEN l WHEN abs(l - c) <= abs(l + u - 2 * c) THEN u ELSE c END AS p FROM m),
d AS (SELECT x, y, ch, ((v % 256) + 256) % 256 AS d0, ((v - l) % 256 + 256) % 256 AS d1, ((v - u) % 256 + 256) % 256 AS d2, ((v - (l + u) // 2) % 256 + 256) % 256 AS d3, ((v - p) % 256 + 256) % 256 AS d4 FROM t)"""
_RGB = f"s AS (SELECT x, y, unnest(['r', 'g', 'b']) AS ch, unnest([r, g, b]) AS v FROM ({_gradient_sql(32, 32, 8, 128)}))"


def _samples(spark: SparkSession) -> DataFrame:
    return planes.gradient(spark, "g", 32, 32, 8, 128).unpivot(["image", "x", "y"], ["r", "g", "b"], "ch", "v")


@query(f"WITH {_RGB}, {_PRED} SELECT x, y, ch, d0::INT AS d0, d1::INT AS d1, d2::INT AS d2, d3::INT AS d3, d4::INT AS d4 FROM d")
def predictor_residuals(spark, sf_dir):
    return planes.predictor_residuals(_samples(spark)).select("x", "y", "ch", *[f"d{k}" for k in range(5)])


@query(
    f"""WITH {_RGB}, {_PRED}, c AS (SELECT y, unnest([0, 1, 2, 3, 4]) AS predictor, unnest([{", ".join(f"sum(least(d{k}, 256 - d{k}))" for k in range(5))}])::BIGINT AS score FROM d GROUP BY y)
SELECT y, predictor, score FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY score, predictor) AS n FROM c) WHERE n = 1"""
)
def row_predictor_choice(spark, sf_dir):
    return planes.predictor_choice(_samples(spark)).select("y", "predictor", "score")


def _intra_sql() -> str:
    t, s = lambda i: f"t[least(greatest({i}, 0), 15) + 1]", lambda i: f"s[least(greatest({i}, 0), 15) + 1]"
    n = 8
    forms = [
        "(list_sum(t[1:8]) + list_sum(s[1:8]) + 8) // 16",
        s("y"),
        t("x"),
        f"({t('x + y + 1')} + {t('x + y + 2')} + 1) // 2",
        f"CASE WHEN x > y THEN {t('x - y - 1')} WHEN x < y THEN {s('y - x - 1')} ELSE c END",
        f"CASE WHEN x - y // 2 >= 0 THEN {t('x - y // 2')} ELSE {s('-(x - y // 2) - 1')} END",
        f"CASE WHEN y - x // 2 >= 0 THEN {s('y - x // 2')} ELSE {t('-(y - x // 2) - 1')} END",
        f"CASE WHEN y % 2 = 0 THEN {t('x + y // 2')} ELSE ({t('x + y // 2')} + {t('x + y // 2 + 1')} + 1) // 2 END",
        f"CASE WHEN x % 2 = 0 THEN {s('y + x // 2')} ELSE ({s('y + x // 2')} + {s('y + x // 2 + 1')} + 1) // 2 END",
        f"least(greatest((({n} - 1 - x) * {s('y')} + (x + 1) * {t('7')} + ({n} - 1 - y) * {t('x')} + (y + 1) * {s('7')} + {n}) // 16, 0), 255)",
        f"least(greatest({t('x')} + {s('y')} - c, 0), 255)",
    ]
    return f"""WITH p AS ({_plane_sql(32, 32, 8)}), k AS (SELECT x // 8 AS bx, y // 8 AS by, x % 8 AS x, y % 8 AS y, v FROM p),
top AS (SELECT bx, by + 1 AS by, list(v ORDER BY x) AS t FROM k WHERE y = 7 GROUP BY ALL), lef AS (SELECT bx + 1 AS bx, by, list(v ORDER BY y) AS s FROM k WHERE x = 7 GROUP BY ALL),
e AS (SELECT [128, 128, 128, 128, 128, 128, 128, 128] AS e),
b AS (SELECT k.*, list_concat(coalesce(t, e), e) AS t, list_concat(coalesce(s, e), e) AS s, coalesce(c.v, 128) AS c FROM k, e LEFT JOIN top ON top.bx = k.bx AND top.by = k.by LEFT JOIN lef ON lef.bx = k.bx AND lef.by = k.by LEFT JOIN k c ON c.bx = k.bx - 1 AND c.by = k.by - 1 AND c.x = 7 AND c.y = 7),
m AS (SELECT bx, by, v, unnest(range(11)) AS mode, unnest([{", ".join(f"({f})::BIGINT" for f in forms)}]) AS g FROM b),
a AS (SELECT bx, by, mode, sum(abs(v - g))::BIGINT AS sad FROM m WHERE mode < 3 OR (bx > 0 AND by > 0) GROUP BY ALL)
SELECT bx::INT AS bx, by::INT AS by, mode::INT AS mode, sad FROM (SELECT *, row_number() OVER (PARTITION BY bx, by ORDER BY sad, mode) AS n FROM a) WHERE n = 1"""


@query(_intra_sql())
def intra_mode_choice(spark, sf_dir):
    """Modes from raw neighbours: blocks with their borders, one row each, scored in NumPy."""
    p = planes.pad(_plane(spark, 32, 32, 8))
    b = p.groupBy("bx", "by").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("v"))
    side = lambda dx, dy, name: b.select((F.col("bx") + dx).alias("bx"), (F.col("by") + dy).alias("by"), F.col("v").alias(name))
    near = b.join(side(0, 1, "above"), ["bx", "by"], "left").join(side(1, 0, "beside"), ["bx", "by"], "left").join(side(1, 1, "across"), ["bx", "by"], "left")

    def run(batches):
        import pyarrow as pa

        none = [128] * 64
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                v, a, s, c = (np.array(r[n] or none).reshape(8, 8) for n in ("v", "above", "beside", "across"))
                rows.append((r["bx"], r["by"], *codec.best_mode(v, a[7], s[:, 7], int(c[7, 7]), not (r["bx"] and r["by"]))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["bx", "by", "mode", "sad"])

    return near.mapInArrow(run, "bx int, by int, mode int, sad long")


def _deblock_sql(quality: int, plane: str, chroma: bool = False) -> str:
    strength, threshold, sharpness, simple, enabled = fixed.deblock_row(quality)
    level = max(1, strength * (8 - min(sharpness, 7)) // 8)
    level = max(1, level * 3 // 4) if chroma else level
    if not enabled:
        return plane

    def one(source: str, along: str, order: str) -> str:
        taps = ", ".join(f"{'lag' if k < 0 else 'lead'}(v, {abs(k)}) OVER o AS t{k + 5}" for k in range(-5, 5))
        cases = []
        for k, place in ((-2, 6), (-1, 7), (0, 0), (1, 1)):
            p2, p1, p0, q0, q1, q2 = (f"t{j - k + 5}" for j in range(-3, 3))
            gap = f"abs({p0} - {q0})"
            on = f"({gap} <= {threshold} OR ({gap} < {4 * level} AND greatest(abs({p1} - {p0}), abs({q1} - {q0})) < {2 * level}))"
            flat = f"greatest(abs({p2} - {p1}), abs({p1} - {p0}), abs({q1} - {q0}), abs({q2} - {q1})) < {level}"
            low = f"least(greatest(3 * ({q0} - {p0}) // 8, -{level}), {level})"
            mid = f"least(greatest((3 * ({q0} - {p0}) + least(greatest({p1} - {q1}, -128), 127) + 4) >> 3, -{level}), {level})"
            a = {-2: p1, -1: f"{p0} + {low}", 0: f"{q0} - {low}", 1: q1}[k]
            b = {-2: f"{p1} + (({mid} + 1) >> 1)", -1: f"{p0} + {mid}", 0: f"{q0} - {mid}", 1: f"{q1} - (({mid} + 1) >> 1)"}[k]
            c = {-2: f"({p2} + 2 * {p1} + 2 * {p0} + {q0} + 3) // 6", -1: f"({p1} + 2 * {p0} + 2 * {q0} + {q1} + 3) // 6", 0: f"({p0} + 2 * {q0} + 2 * {q1} + {q2} + 3) // 6", 1: f"({q0} + 2 * {q1} + 3 * {q2} + 3) // 6"}[k]
            value = a if simple else f"CASE WHEN {flat} AND {gap} < {max(1, level // 2)} THEN {c} WHEN {flat} THEN {b} ELSE {a} END"
            cases.append(f"WHEN {order} % 8 = {place} AND {p2} IS NOT NULL AND {q2} IS NOT NULL AND {on} THEN least(greatest({value}, 0), 255)")
        return f"SELECT image, x, y, (CASE {' '.join(cases)} ELSE v END)::INT AS v FROM (SELECT *, {taps} FROM ({source}) WINDOW o AS (PARTITION BY image, {along} ORDER BY {order}))"

    return one(one(plane, "y", "x"), "x", "y")


@query(f"SELECT x, y, v FROM ({_deblock_sql(50, _plane_sql(48, 40, 3))})")
def deblock_edges(spark, sf_dir):
    return planes.deblock(_plane(spark, 48, 40, 3), 50).select("x", "y", "v")


@query("WITH b AS (SELECT ('0x' || unnest(regexp_extract_all(hex(encode(text)), '..')))::INT AS byte FROM documents) SELECT byte, count(*) AS n FROM b GROUP BY byte")
def byte_histogram(spark, sf_dir):
    return codec.byte_counts(table(spark, sf_dir, "documents"), "text")


@query(
    """WITH b AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS h, generate_subscripts(regexp_extract_all(hex(encode(text)), '..'), 1) AS i FROM documents),
v AS (SELECT doc_id, i, ('0x' || h)::INT AS v FROM b), d AS (SELECT (v - coalesce(lag(v) OVER (PARTITION BY doc_id ORDER BY i), 0) + 256) % 256 AS byte FROM v) SELECT byte::INT AS byte, count(*) AS n FROM d GROUP BY byte"""
)
def byte_residuals(spark, sf_dir):
    return codec.byte_counts(table(spark, sf_dir, "documents"), "text", residual=True)


@query(f"WITH p AS ({_gradient_sql(64, 64, 4, 200)}) SELECT ch, v, count(*) AS n FROM (SELECT unnest(['r', 'g', 'b']) AS ch, unnest([r, g, b]) AS v FROM p) GROUP BY ch, v")
def channel_histogram(spark, sf_dir):
    return planes.gradient(spark, "g", 64, 64, 4, 200).unpivot(["image"], ["r", "g", "b"], "ch", "v").groupBy("ch", "v").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_COEF}, z AS (SELECT vec_id, p, q, sum((q <> 0)::INT) OVER (PARTITION BY vec_id ORDER BY p) AS g FROM q), r AS (SELECT count(*) AS run FROM z WHERE q = 0 GROUP BY vec_id, g)
SELECT run::INT AS run, count(*) AS n FROM r GROUP BY run"""
)
def zero_run_lengths(spark, sf_dir):
    return _coefficients(spark, sf_dir).select(F.explode(blocks.zero_runs("q")).alias("run")).groupBy("run").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_COEF}, z AS (SELECT vec_id, p, q, p - coalesce(lag(p) OVER (PARTITION BY vec_id ORDER BY p), -1) - 1 AS run FROM q WHERE q <> 0),
b AS (SELECT vec_id, sum(2 + 2 * length(bin(abs(q))) - 1 + (run // 32) * 12 + CASE WHEN run % 32 > 0 THEN 2 * length(bin(run % 32)) ELSE 0 END) AS bits FROM z GROUP BY vec_id)
SELECT vec_id, (7 + coalesce(bits, 0))::INT AS bits, ((7 + coalesce(bits, 0) + 7) // 8)::INT AS bytes FROM (SELECT DISTINCT vec_id FROM px) LEFT JOIN b USING (vec_id)"""
)
def exp_golomb_bits(spark, sf_dir):
    b = _coefficients(spark, sf_dir).select("vec_id", blocks.block_bits("q").alias("bits"))
    return b.withColumn("bytes", C.div(F.col("bits") + 7, 8).cast("int"))


_TOKEN = " ".join(f"WHEN abs(q) >= {m} THEN '{n}'" for n, m, _ in reversed(fixed.TOKENS))


@query(f"WITH {_COEF} SELECT CASE {_TOKEN} END AS token, count(*) AS n FROM q GROUP BY 1")
def token_classes(spark, sf_dir):
    return _coefficients(spark, sf_dir).select(F.explode("q").alias("q")).groupBy(C.token(F.col("q")).alias("token")).agg(F.count("*").alias("n"))


_BAND = " ".join(f"WHEN p >= {m} THEN {k}" for k, m in reversed([*enumerate(fixed.BANDS_8)]))


@query(f"WITH {_COEF} SELECT CASE {_BAND} END AS band, sum(abs(q))::BIGINT AS total, count(*) AS n FROM q GROUP BY 1")
def coeff_bands(spark, sf_dir):
    p = _coefficients(spark, sf_dir).select(F.posexplode("q").alias("p", "q"))
    return p.groupBy(C.band(F.col("p")).alias("band")).agg(F.sum(F.abs("q")).alias("total"), F.count("*").alias("n"))


@query(
    f"""WITH {_COEF}, b AS (SELECT vec_id % 16 AS bx, vec_id // 16 AS by, max((p > 0 AND q <> 0)::INT) AS f FROM q GROUP BY vec_id),
n AS (SELECT f, coalesce(lag(f) OVER (PARTITION BY by ORDER BY bx), 0) + coalesce(lag(f) OVER (PARTITION BY bx ORDER BY by), 0) AS context FROM b) SELECT context::INT AS context, count(*) AS n, sum(f)::BIGINT AS nonzero FROM n GROUP BY context"""
)
def block_contexts(spark, sf_dir):
    b = _coefficients(spark, sf_dir).select((F.col("vec_id") % 16).alias("bx"), C.div(F.col("vec_id"), 16).alias("by"), F.exists(F.slice("q", 2, 63), lambda x: x != 0).alias("nonzero"))
    return planes.block_contexts(b).groupBy("context").agg(F.count("*").alias("n"), F.sum(F.col("nonzero").cast("long")).alias("nonzero"))


@query(f"WITH {_COEF} SELECT CASE WHEN k = 0 THEN 'dc' WHEN k IN {fixed.LOW_AC} THEN 'low' ELSE 'high' END AS scan_pass, sum(abs(q))::BIGINT AS total, count(*) AS n FROM q GROUP BY 1")
def progressive_passes(spark, sf_dir):
    """Passes as arrays of their coefficients; all three hold all coefficients."""
    c = _coefficients(spark, sf_dir).select(blocks.split_passes("levels").alias("s"))
    parts = c.select(F.explode(F.array(*[F.struct(F.lit(n).alias("scan_pass"), F.col(f"s.{n}").alias("v")) for n in blocks.PASSES])).alias("p")).select("p.*")
    return parts.groupBy("scan_pass").agg(F.sum(F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + F.abs(x))).alias("total"), F.sum(F.size("v").cast("long")).alias("n"))


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("anim_id"), "event_id", "ts", (F.col("event_type") == "signup").alias("is_keyframe"), F.round("value").cast("long").alias("delay_ms"))
    return e.withColumn("idx", F.row_number().over(Window.partitionBy("anim_id").orderBy("ts", "event_id")) - 1)


_FRAMES = "f AS (SELECT user_id AS anim_id, event_id, event_type = 'signup' AS is_keyframe, round(value)::BIGINT AS delay_ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events)"


@query(f"WITH {_FRAMES} SELECT event_id, idx::INT AS idx, max(CASE WHEN is_keyframe THEN idx END) OVER (PARTITION BY anim_id ORDER BY idx)::INT AS keyframe_idx FROM f")
def keyframe_before(spark, sf_dir):
    return planes.keyframes_before(_frames(spark, sf_dir)).select("event_id", "idx", "keyframe_idx")


@query(f"WITH {_FRAMES} SELECT anim_id, count(*) AS frames, count(*) FILTER (is_keyframe) AS keyframes, sum(delay_ms)::BIGINT AS duration_ms FROM f GROUP BY anim_id")
def animation_totals(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("anim_id")).agg(F.count("*").alias("frames"), F.count_if(F.col("event_type") == "signup").alias("keyframes"), F.sum(F.round("value").cast("long")).alias("duration_ms"))


def _pair(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """A plane and itself moved by (3, -2), borders repeated."""
    ref = _plane(spark, 32, 32, 5)
    at = ref.select("image", F.col("x").alias("rx"), F.col("y").alias("ry"), "v")
    move = ref.select("image", "x", "y", F.least(F.col("x") + 3, F.lit(31)).alias("rx"), F.greatest(F.col("y") - 2, F.lit(0)).alias("ry"))
    return move.join(at, ["image", "rx", "ry"]).select("image", "x", "y", "v"), ref


_PAIR = f"ref AS ({_plane_sql(32, 32, 5)}), cur AS (SELECT a.x, a.y, b.v FROM ref a JOIN ref b ON b.x = least(a.x + 3, 31) AND b.y = greatest(a.y - 2, 0))"
_SEARCH = """s AS (SELECT c.x // 8 AS bx, c.y // 8 AS by, dx, dy, sum(abs(c.v - r.v))::BIGINT AS sad FROM cur c, range(-4, 5) a(dx), range(-4, 5) b(dy), ref r WHERE r.x = least(greatest(c.x + dx, 0), 31) AND r.y = least(greatest(c.y + dy, 0), 31) GROUP BY ALL),
m AS (SELECT bx::INT AS bx, by::INT AS by, dx::INT AS dx, dy::INT AS dy, sad FROM (SELECT *, row_number() OVER (PARTITION BY bx, by ORDER BY sad, dy, dx) AS n FROM s) WHERE n = 1)"""


@query(f"WITH {_PAIR}, {_SEARCH} SELECT bx, by, dx, dy, sad FROM m")
def motion_full_search(spark, sf_dir):
    cur, ref = _pair(spark)
    return planes.full_search(cur, ref, 32, 32, 8, 4).drop("image")


@query(f"WITH {_PAIR}, {_SEARCH} SELECT g.x, g.y, r.v FROM ref g JOIN m ON m.bx = g.x // 8 AND m.by = g.y // 8 JOIN ref r ON r.x = least(greatest(g.x + dx, 0), 31) AND r.y = least(greatest(g.y + dy, 0), 31)")
def motion_compensate(spark, sf_dir):
    cur, ref = _pair(spark)
    return planes.compensate(ref, planes.full_search(cur, ref, 32, 32, 8, 4), 32, 32, 8).drop("image")


def _packed(spark: SparkSession) -> DataFrame:
    p = lambda df: df.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("s"))
    byte = lambda: F.unhex(F.array_join(F.transform("s", lambda q: F.lpad(F.hex(q["v"].cast("long")), 2, "0")), ""))
    cur, ref = _pair(spark)
    return p(cur).select("image", byte().alias("cur")).join(p(ref).select("image", byte().alias("ref")), "image").select("image", F.lit(32).alias("w"), F.lit(32).alias("h"), "cur", "ref")


def _search(how: str) -> Query:
    def run(spark, sf_dir):
        return codec.motion_search(_packed(spark), 8, 4, how).drop("image")

    run.__name__ = f"motion_{how}"
    return run


for _how in ("diamond", "hexagon", "step"):
    query()(_search(_how))


@query(
    f"""WITH v AS (SELECT k, k / 256.0::DOUBLE AS v FROM range(1, 257) r(k))
SELECT k, round(pow(greatest(pow(v, {1 / fixed.PQ[1]}::DOUBLE) - {fixed.PQ[2]}::DOUBLE, 0) / ({fixed.PQ[3]}::DOUBLE - {fixed.PQ[4]}::DOUBLE * pow(v, {1 / fixed.PQ[1]}::DOUBLE)), {1 / fixed.PQ[0]}::DOUBLE), 6) AS pq,
round(pow(({fixed.PQ[2]}::DOUBLE + {fixed.PQ[3]}::DOUBLE * pow(v, {fixed.PQ[0]}::DOUBLE)) / (1 + {fixed.PQ[4]}::DOUBLE * pow(v, {fixed.PQ[0]}::DOUBLE)), {fixed.PQ[1]}::DOUBLE), 6) AS pq_inverse,
round(CASE WHEN v <= 0.5 THEN v * v / 3.0::DOUBLE ELSE (exp((v - {fixed.HLG[2]}::DOUBLE) / {fixed.HLG[0]}::DOUBLE) + {fixed.HLG[1]}::DOUBLE) / 12.0::DOUBLE END, 6) AS hlg,
round(CASE WHEN v <= 1.0::DOUBLE / 12 THEN sqrt(3 * v) ELSE {fixed.HLG[0]}::DOUBLE * ln(12 * v - {fixed.HLG[1]}::DOUBLE) + {fixed.HLG[2]}::DOUBLE END, 6) AS hlg_inverse FROM v"""
)
def hdr_curves(spark, sf_dir):
    v = spark.range(1, 257).select(F.col("id").alias("k"), (F.col("id") / 256.0).alias("v"))
    x = F.col("v")
    return v.select("k", *[F.round(f(x), 6).alias(n) for n, f in (("pq", C.pq_eotf), ("pq_inverse", C.pq_oetf), ("hlg", C.hlg_eotf), ("hlg_inverse", C.hlg_oetf))])


@query("SELECT v, ((v * 1023 + 127) // 255)::INT AS to10, ((v * 4095 + 127) // 255)::INT AS to12, ((v * 65535 + 127) // 255)::INT AS to16, (((v * 1023 + 127) // 255 * 255 + 511) // 1023)::INT AS back FROM range(256) r(v)")
def bit_depth_convert(spark, sf_dir):
    v = spark.range(256).select(F.col("id").alias("v"))
    x = F.col("v")
    return v.select("v", C.bit_depth(x, 8, 10).alias("to10"), C.bit_depth(x, 8, 12).alias("to12"), C.bit_depth(x, 8, 16).alias("to16"), C.bit_depth(C.bit_depth(x, 8, 10), 10, 8).alias("back"))


_DEPTHS = {
    8: ("..", "[g * 257]"),
    10: (".{10}", "[(((g >> (32 - 8 * k)) & 255) << 2 | ((g >> (6 - 2 * k)) & 3)) << 6 for k in range(4)]"),
    12: (".{6}", "[(((g >> (16 - 8 * k)) & 255) << 4 | ((g >> (4 - 4 * k)) & 15)) << 4 for k in range(2)]"),
    16: (".{4}", "[(g & 255) * 256 + (g >> 8)]"),
}
_UNPACKED = " UNION ALL ".join(f"SELECT doc_id, {d} AS depth, flatten([{e} for g in [('0x' || p)::BIGINT for p in regexp_extract_all(h, '{r}')]]) AS v FROM d" for d, (r, e) in _DEPTHS.items())


@query(
    f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), u AS ({_UNPACKED})
SELECT doc_id, depth, len(v)::INT AS samples, coalesce(list_sum(v), 0)::BIGINT AS total, coalesce(list_sum([x * ((i - 1) % 997) for x, i in v]), 0)::BIGINT AS placed, coalesce(list_sum([x >> 8 for x in v]), 0)::BIGINT AS total8 FROM u"""
)
def unpack_samples(spark, sf_dir):
    """The bytes of each document as packed samples of 8, 10, 12 and 16 bits, widened to 16 bits and narrowed to 8; summed where they are unpacked."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("b"))

    def run(batches):
        import pyarrow as pa

        for part in codec.slices(batches, "b"):
            rows = []
            for doc, b in zip(*(c.to_pylist() for c in part.columns), strict=True):
                for depth in _DEPTHS:
                    v = codec.unpack(b, depth).astype(np.int64)
                    rows.append((doc, depth, len(v), int(v.sum()), int(v @ (np.arange(len(v)) % 997)), int((v >> 8).sum())))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "depth", "samples", "total", "placed", "total8"])

    return d.mapInArrow(run, "doc_id long, depth int, samples int, total long, placed long, total8 long")


@query(
    """SELECT event_id, (props->>'k')::BIGINT AS as_int, props->>'k' AS as_text, CASE WHEN value IS NOT NULL THEN round((props->>'k')::BIGINT / 7.0::DOUBLE, 6) END AS as_rational, NULL::DOUBLE AS int_as_float,
least(greatest((props->>'k')::BIGINT, 0), 5) AS rating, props->>'missing' IS NULL AS missing FROM events"""
)
def metadata_coercion(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "value", F.parse_json("props").alias("m"))
    k = F.try_variant_get("m", "$.k", "bigint")
    return e.select("event_id", C.as_int(F.lit("int"), k.cast("string")).alias("as_int"), F.try_variant_get("m", "$.k", "string").alias("as_text"), F.round(C.as_float(F.lit("rational"), F.lit(None), k, F.lit(7.0)), 6).alias("as_rational"),
                    C.as_float(F.lit("int"), k.cast("string"), k, F.lit(1.0)).alias("int_as_float"), F.least(F.greatest(k, F.lit(0)), F.lit(5)).alias("rating"), F.try_variant_get("m", "$.missing", "string").isNull().alias("missing"))


@query()
def huffman_code_lengths(spark, sf_dir):
    """Code lengths of the 256 byte values, a bounded table, from their counts over all documents."""
    counts = [0] * 256
    for r in byte_histogram(spark, sf_dir).collect():
        counts[r["byte"]] = r["n"]
    rows = [(s, counts[s], len(c)) for s, c in sorted(codec.huffman_codes(counts).items())]
    return spark.createDataFrame(rows, "byte int, n long, bits int")


# Fixed value: the reversed polynomial of CRC-32; its table comes from the rule below.
_POLYNOMIAL = 0xEDB88320


def _crc_sql(h: str) -> str:
    """CRC-32 of hexadecimal bytes, by a table of 256 remainders."""
    table = [*range(256)]
    for _ in range(8):
        table = [v >> 1 ^ _POLYNOMIAL * (v & 1) for v in table]
    return f"xor(4294967295, list_reduce([('0x' || b)::BIGINT for b in regexp_extract_all({h}, '..')], lambda c, b: xor(c >> 8, (CAST([{', '.join(map(str, table))}] AS BIGINT[]))[1 + (xor(c, b) & 255)]), 4294967295::BIGINT))"


@query(
    f"""WITH d AS (SELECT doc_id, octet_length(encode(text)) AS n, hex(encode(text)) AS h FROM documents), c AS (SELECT *, {_crc_sql("hex('CUST') || h")} AS crc FROM d),
f AS (SELECT *, [format('{{:08X}}', n), format('{{:08X}}', crc)] AS w FROM c), l AS (SELECT *, [substr(x, 7, 2) || substr(x, 5, 2) || substr(x, 3, 2) || substr(x, 1, 2) for x in w] AS e FROM f)
SELECT doc_id, crc, (n + 12)::BIGINT AS framed, sha256(unhex(hex('CUST') || e[1] || h || e[2])) AS sha256 FROM l"""
)
def chunk_crc(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit("CUST").alias("tag"), F.encode("text", "utf-8").alias("data"))
    f = container.frame(F.col("tag"), F.col("data"))
    return d.select("doc_id", container.crc(F.col("tag"), F.col("data")).alias("crc"), F.length(f).cast("long").alias("framed"), F.sha2(f, 256).alias("sha256"))


def _images(spark: SparkSession) -> DataFrame:
    rows = []
    for name, w, h, c, f in (("grad32", 32, 32, 3, lambda x, y: (8 * x, 8 * y, 128)), ("grad64", 64, 64, 3, lambda x, y: (4 * x, 4 * y, 200)), ("rgba16", 16, 16, 4, lambda x, y: (16 * x, 16 * y, 100, 8 * (x + y))), ("odd13x9", 13, 9, 3, lambda x, y: (19 * x, 28 * y, 60)), ("gray", 24, 16, 1, lambda x, y: (7 * x + 3 * y,))):
        rows.append((name, w, h, c, bytearray(v % 256 for y in range(h) for x in range(w) for v in f(x, y))))
    return spark.createDataFrame(rows, "image string, w int, h int, channels int, pixels binary")


def _roundtrip(name: str, config: codec.CodecConfig) -> Query:
    def run(spark, sf_dir):
        return codec.roundtrip(_images(spark).repartition("image"), config).select("image", "raw_bytes", "coded_bytes", "max_error", "psnr")

    run.__name__ = name
    return run


for _name, _config in (("lossless_roundtrip", codec.CodecConfig("lossless", 100)), ("lossy_roundtrip", codec.CodecConfig("lossy", 85)), ("legacy_roundtrip", codec.CodecConfig("legacy", 85))):
    query()(_roundtrip(_name, _config))
