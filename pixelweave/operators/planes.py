"""Operators on pixels as rows (image, x, y, value columns): windows within rows or columns of an image, and joins on coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import div, paeth


def gradient(spark: SparkSession, image: str, w: int, h: int, step: int, blue: int) -> DataFrame:
    """A closed-form image: (x step, y step, blue) modulo 256."""
    p = spark.range(w * h).select(F.lit(image).alias("image"), (F.col("id") % w).cast("int").alias("x"), div(F.col("id"), w).cast("int").alias("y"))
    return p.select("*", (F.col("x") * step % 256).alias("r"), (F.col("y") * step % 256).alias("g"), F.lit(blue).alias("b"))


def pad(px: DataFrame, size: int = 8) -> DataFrame:
    """Pads each image to multiples of `size` by its last column and row; adds bx, by, i. Edge pixels multiply in place: no join."""
    edge = px.groupBy("image").agg(F.max("x").alias("right"), F.max("y").alias("bottom"))
    p = px.join(edge, "image")
    upto = lambda c, last: F.when(F.col(c) == F.col(last), F.sequence(F.col(c), (F.col(last) + size - F.col(last) % size - 1).cast("int"))).otherwise(F.array(F.col(c)))
    p = p.withColumn("px_", F.explode(upto("x", "right"))).withColumn("py_", F.explode(upto("y", "bottom")))
    keep = [c for c in px.columns if c not in ("x", "y")]
    p = p.select(*keep, F.col("px_").alias("x"), F.col("py_").alias("y"))
    return p.withColumns({"bx": div(F.col("x"), size).cast("int"), "by": div(F.col("y"), size).cast("int"), "i": (F.col("y") % size * size + F.col("x") % size).cast("int")})


def tiles(images: DataFrame, size: int) -> DataFrame:
    """(image, tile_col, tile_row, x, y, width, height) of images (image, w, h); edge tiles are cropped."""
    n = lambda c: F.sequence(F.lit(0), (div(F.col(c) + size - 1, size) - 1).cast("int"))
    t = images.withColumn("tile_col", F.explode(n("w"))).withColumn("tile_row", F.explode(n("h")))
    x, y = F.col("tile_col") * size, F.col("tile_row") * size
    return t.select("image", "tile_col", "tile_row", x.alias("x"), y.alias("y"), F.least(F.lit(size), F.col("w") - x).alias("width"), F.least(F.lit(size), F.col("h") - y).alias("height"))


def predictor_residuals(samples: DataFrame, value: str = "v", line: tuple[str, ...] = ("image", "ch")) -> DataFrame:
    """Residuals d0 to d4 modulo 256 of each sample by None, Sub, Up, Average and Paeth. Two windows, one along rows and one along columns."""
    v = F.col(value)
    along, down = Window.partitionBy(*line, "y").orderBy("x"), Window.partitionBy(*line, "x").orderBy("y")
    zero = lambda c: F.coalesce(c, F.lit(0))
    s = samples.withColumn("up", zero(F.lag(v).over(down)))
    s = s.withColumns({"left": zero(F.lag(v).over(along)), "corner": zero(F.lag("up").over(along))})
    left, up = F.col("left"), F.col("up")
    guesses = [F.lit(0), left, up, div(left + up, 2).cast("int"), paeth(left, up, F.col("corner"))]
    return s.withColumns({f"d{k}": F.pmod(v - g, F.lit(256)).cast("int") for k, g in enumerate(guesses)})


def predictor_choice(samples: DataFrame, value: str = "v") -> DataFrame:
    """(image, y, predictor, score): each row's filter with the least sum of min(d, 256 - d), ties to the lowest filter."""
    d = predictor_residuals(samples, value)
    cost = lambda k: F.sum(F.least(F.col(f"d{k}"), 256 - F.col(f"d{k}"))).alias(f"s{k}")
    rows = d.groupBy("image", "y").agg(*[cost(k) for k in range(5)])
    best = F.least(*[F.struct(F.col(f"s{k}").alias("score"), F.lit(k).alias("predictor")) for k in range(5)])
    return rows.select("image", "y", best["predictor"].alias("predictor"), best["score"].cast("long").alias("score"))


def downsample(plane: DataFrame, value: str = "v") -> DataFrame:
    """2x2 means, rounded half up, with the last column and row repeated."""
    even = pad(plane, 2)
    return even.groupBy("image", F.col("bx").alias("x"), F.col("by").alias("y")).agg(div(F.sum(value) + 2, 4).cast("int").alias(value))


def upsample(small: DataFrame, value: str = "v") -> DataFrame:
    """Twice the size, bilinear with phases 0 and 1/2 and clamped neighbours. Neighbours come from windows; each sample becomes four."""
    along, down = Window.partitionBy("image", "y").orderBy("x"), Window.partitionBy("image", "x").orderBy("y")
    v = F.col(value)
    s = small.withColumn("e", F.coalesce(F.lead(v).over(along), v))
    s = s.withColumns({"s": F.coalesce(F.lead(v).over(down), v), "se": F.coalesce(F.lead("e").over(down), F.col("e"))})
    quarter = lambda dx, dy, x: F.struct((2 * F.col("x") + dx).alias("x"), (2 * F.col("y") + dy).alias("y"), x.cast("int").alias(value))
    half = lambda a, b: div(a + b + 1, 2)
    four = F.array(quarter(0, 0, v), quarter(1, 0, half(v, F.col("e"))), quarter(0, 1, half(v, F.col("s"))), quarter(1, 1, div(v + F.col("e") + F.col("s") + F.col("se") + 2, 4)))
    return s.select("image", F.explode(four).alias("p")).select("image", "p.*")


def _edge(v: str, order, at: Column, config: tuple, chroma: bool = False) -> Column:
    """The filtered sample. Its place in the row of eight says which of the samples p1, p0, q0, q1 around an edge it is."""
    strength, threshold, sharpness, simple, enabled = config
    if not enabled:
        return F.col(v)
    level = max(1, strength * (8 - min(sharpness, 7)) // 8)
    level = max(1, level * 3 // 4) if chroma else level
    near = lambda k: (F.lead(v, k) if k >= 0 else F.lag(v, -k)).over(order).cast("int")
    limit = lambda c, low, high: F.least(F.greatest(c, F.lit(low)), F.lit(high))
    out = F.col(v)
    for k, place in ((-2, 6), (-1, 7), (0, 0), (1, 1)):
        p2, p1, p0, q0, q1, q2 = (near(j - k) for j in (-3, -2, -1, 0, 1, 2))
        gap = F.abs(p0 - q0)
        on = (gap <= threshold) | ((gap < 4 * level) & (F.greatest(F.abs(p1 - p0), F.abs(q1 - q0)) < 2 * level))
        flat = F.greatest(F.abs(p2 - p1), F.abs(p1 - p0), F.abs(q1 - q0), F.abs(q2 - q1)) < level
        strong = flat & (gap < max(1, level // 2))
        low = limit(div(3 * (q0 - p0), 8), -level, level)
        mid = limit(F.shiftright((3 * (q0 - p0) + limit(p1 - q1, -128, 127) + 4).cast("int"), 3), -level, level)
        outer = F.shiftright((mid + 1).cast("int"), 1)
        own = {-2: p1, -1: p0, 0: q0, 1: q1}[k]
        by_low = {-1: p0 + low, 0: q0 - low}.get(k, own)
        by_mid = {-2: p1 + outer, -1: p0 + mid, 0: q0 - mid, 1: q1 - outer}[k]
        # The last sum counts q2 three times, as streams of the format do.
        by_sum = div({-2: p2 + 2 * p1 + 2 * p0 + q0, -1: p1 + 2 * p0 + 2 * q0 + q1, 0: p0 + 2 * q0 + 2 * q1 + q2, 1: q0 + 2 * q1 + 3 * q2}[k] + 3, 6)
        value = by_low if simple else F.when(strong, by_sum).when(flat, by_mid).otherwise(by_low)
        whole = p2.isNotNull() & q2.isNotNull()
        out = F.when((F.pmod(at, F.lit(8)) == place) & whole & on, limit(value.cast("int"), 0, 255)).otherwise(out)
    return out


def deblock(plane: DataFrame, quality: int, value: str = "v", chroma: bool = False) -> DataFrame:
    """All vertical edges, then all horizontal ones on the result: one window pass each, as edges touch disjoint samples."""
    config = fixed.deblock_row(quality)
    across, down = Window.partitionBy("image", "y").orderBy("x"), Window.partitionBy("image", "x").orderBy("y")
    once = plane.withColumn(value, _edge(value, across, F.col("x"), config, chroma))
    return once.withColumn(value, _edge(value, down, F.col("y"), config, chroma))


def peak(counts: DataFrame, n: str = "n") -> DataFrame:
    """(peak): the greatest count of a histogram, 1 at least."""
    return counts.agg(F.greatest(F.coalesce(F.max(n), F.lit(1)), F.lit(1)).alias("peak"))


def block_contexts(blocks: DataFrame, flag: str = "nonzero") -> DataFrame:
    """Adds context: how many of the left and the upper block are non-zero."""
    left = F.coalesce(F.lag(F.col(flag).cast("int")).over(Window.partitionBy("by").orderBy("bx")), F.lit(0))
    top = F.coalesce(F.lag(F.col(flag).cast("int")).over(Window.partitionBy("bx").orderBy("by")), F.lit(0))
    return blocks.withColumn("context", left + top)


def full_search(cur: DataFrame, ref: DataFrame, w: int, h: int, size: int, reach: int, value: str = "v") -> DataFrame:
    """(image, bx, by, dx, dy, sad): the offset of least absolute difference, ties in row-major order. Candidates are a fixed (2 reach + 1)^2 a pixel."""
    span = F.sequence(F.lit(-reach), F.lit(reach))
    c = cur.select("image", "x", "y", F.col(value).alias("c"), F.explode(span).alias("dy")).withColumn("dx", F.explode(span))
    inside = lambda c, n: F.least(F.greatest(c, F.lit(0)), F.lit(n - 1))
    c = c.withColumns({"rx": inside(F.col("x") + F.col("dx"), w), "ry": inside(F.col("y") + F.col("dy"), h)})
    r = ref.select("image", F.col("x").alias("rx"), F.col("y").alias("ry"), F.col(value).alias("r"))
    bx, by = div(F.col("x"), size).cast("int").alias("bx"), div(F.col("y"), size).cast("int").alias("by")
    sad = c.join(r, ["image", "rx", "ry"]).groupBy("image", bx, by, "dx", "dy").agg(F.sum(F.abs(F.col("c") - F.col("r"))).cast("long").alias("sad"))
    best = sad.groupBy("image", "bx", "by").agg(F.min(F.struct("sad", "dy", "dx")).alias("m"))
    return best.select("image", "bx", "by", "m.dx", "m.dy", "m.sad")


def compensate(ref: DataFrame, vectors: DataFrame, w: int, h: int, size: int, value: str = "v") -> DataFrame:
    """The prediction of each pixel: the reference at its block's offset, clamped to the frame."""
    grid = ref.select("image", "x", "y", div(F.col("x"), size).cast("int").alias("bx"), div(F.col("y"), size).cast("int").alias("by"))
    inside = lambda c, n: F.least(F.greatest(c, F.lit(0)), F.lit(n - 1))
    p = grid.join(vectors, ["image", "bx", "by"]).withColumns({"rx": inside(F.col("x") + F.col("dx"), w), "ry": inside(F.col("y") + F.col("dy"), h)})
    r = ref.select("image", F.col("x").alias("rx"), F.col("y").alias("ry"), F.col(value))
    return p.join(r, ["image", "rx", "ry"]).select("image", "x", "y", value)


def keyframes_before(frames: DataFrame) -> DataFrame:
    """Adds keyframe_idx: the last keyframe at or before each frame of its animation; a window within each animation."""
    w = Window.partitionBy("anim_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumn("keyframe_idx", F.last(F.when(F.col("is_keyframe"), F.col("idx")), ignorenulls=True).over(w))
