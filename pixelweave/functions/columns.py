"""Column functions of the codec: everything here stays inside Spark's generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def clamp(c: Column, low, high) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def half_away(c: Column) -> Column:
    """Rounds halves away from zero; 6 decimals first, so that sums in another order agree."""
    return F.round(F.round(c, 6)).cast("int")


def rgb_to_ycbcr(r: Column, g: Column, b: Column, space: str = "full") -> tuple[Column, Column, Column]:
    if space == "rgb":
        return r, g, b
    scale = 1.0 if space == "full" else 255.0
    rows = fixed.COLOR[space][:3]
    out = [half_away(F.lit(o) + F.lit(wr) * r / scale + F.lit(wg) * g / scale + F.lit(wb) * b / scale) for o, wr, wg, wb in rows]
    highs = (255, 255, 255) if space == "full" else (235, 240, 240)
    return tuple(clamp(c, 0 if space == "full" else 16, h) for c, h in zip(out, highs, strict=True))


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column, space: str = "full") -> tuple[Column, Column, Column]:
    if space == "rgb":
        return y, cb, cr
    wr, gb, gr, wb = fixed.COLOR[space][3]
    full = space == "full"
    y1 = y.cast("double") if full else (y - 16.0) * 255.0 / 219.0
    b1, r1 = ((c - 128.0) if full else (c - 128.0) * 255.0 / 224.0 for c in (cb, cr))
    return tuple(clamp(half_away(c), 0, 255) for c in (y1 + F.lit(wr) * r1, y1 + F.lit(gb) * b1 + F.lit(gr) * r1, y1 + F.lit(wb) * b1))


def div(a: Column, b) -> Column:
    """Integer division towards zero."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def quantize(v: Column, t: Column) -> Column:
    return F.signum(v).cast("int") * div(F.abs(v) + div(t, 2), t).cast("int")


def dequantize(v: Column, t: Column) -> Column:
    return clamp(v * t, -32768, 32767)


def quantize_legacy(v: Column, t: Column) -> Column:
    return div(v, t).cast("int")


def paeth(a: Column, b: Column, c: Column) -> Column:
    p = a + b - c
    pa, pb, pc = F.abs(p - a), F.abs(p - b), F.abs(p - c)
    return F.when((pa <= pb) & (pa <= pc), a).when(pb <= pc, b).otherwise(c)


def bit_depth(v: Column, old: int, new: int) -> Column:
    top, to = (1 << old) - 1, (1 << new) - 1
    return div(v.cast("long") * to + top // 2, top).cast("int")


def narrow(v: Column) -> Column:
    """8-bit samples of 16-bit ones."""
    return F.transform(v, lambda x: F.shiftright(x, 8))


def hdr_preset(name: str) -> Column:
    """Bit depth, transfer curve, gamut and light levels of a preset; none has a mastering display."""
    _, depth, transfer, gamut, cll, fall = next(p for p in fixed.HDR if p[0] == name)
    return F.struct(F.lit(depth).alias("bit_depth"), F.lit(transfer).alias("transfer"), F.lit(gamut).alias("gamut"), F.lit(cll).cast("int").alias("max_cll"), F.lit(fall).cast("int").alias("max_fall"), F.lit(None).cast("string").alias("mastering_display"))


def activity(v: Column) -> Column:
    """Mean magnitude of a block's coefficients but the first, by 128, at most 1; a 32-bit float."""
    total = F.aggregate(F.slice(v, 2, 63), F.lit(0).cast("long"), lambda a, x: a + F.abs(x.cast("long")))
    return F.least(total / F.lit(63.0) / F.lit(128.0), F.lit(1.0)).cast("float")


def quantize_active(v: Column, steps: Column, factor: Column) -> Column:
    """Levels by steps scaled with 1 + (factor - 1/2) / 2 in 32-bit floats, cut to integers of at least 1; quotients are cut as well."""
    real = lambda x: F.lit(x).cast("float")
    scale = real(1) + (factor.cast("float") - real(0.5)) * real(0.5)
    return F.zip_with(v, steps, lambda a, t: quantize_legacy(a, F.greatest((t.cast("float") * scale).cast("int"), F.lit(1))))


def is_edge_block(bx: Column, by: Column) -> Column:
    return (bx == 0) | (by == 0)


def pq_eotf(v: Column) -> Column:
    m1, m2, c1, c2, c3 = fixed.PQ
    p = F.pow(v, F.lit(1 / m2))
    return F.pow(F.greatest(p - c1, F.lit(0.0)) / (F.lit(c2) - F.lit(c3) * p), F.lit(1 / m1))


def pq_oetf(v: Column) -> Column:
    m1, m2, c1, c2, c3 = fixed.PQ
    p = F.pow(v, F.lit(m1))
    return F.pow((F.lit(c1) + F.lit(c2) * p) / (F.lit(1.0) + F.lit(c3) * p), F.lit(m2))


def hlg_eotf(v: Column, strict: bool = False) -> Column:
    """The standard inverse; strict: with the offset inside the exponent, as some encoders have it."""
    a, b, c = fixed.HLG
    above = F.exp((v - c) / a + b) / 12.0 if strict else (F.exp((v - c) / a) + b) / 12.0
    return F.when(v <= 0.5, v * v / 3.0).otherwise(above)


def hlg_oetf(v: Column) -> Column:
    a, b, c = fixed.HLG
    return F.when(v <= 1.0 / 12.0, F.sqrt(3.0 * v)).otherwise(a * F.log(F.greatest(12.0 * v - b, F.lit(1e-12))) + c)


def ladder(v: Column, firsts, names=None) -> Column:
    """The class of v by the ascending first values of the classes."""
    names = [*(names or range(len(firsts)))]
    pairs = [*zip(firsts, names, strict=True)]
    return reduce(lambda out, p: F.when(v >= p[0], F.lit(p[1])).otherwise(out), pairs[1:], F.lit(names[0]))


def token(v: Column) -> Column:
    return ladder(F.abs(v), [t[1] for t in fixed.TOKENS], [t[0] for t in fixed.TOKENS])


def band(i: Column, size: int = 8) -> Column:
    return ladder(i, fixed.BANDS_8 if size == 8 else fixed.BANDS_4)


def golomb_bits(v: Column) -> Column:
    """Length of the order-0 Exp-Golomb code of v >= 0."""
    return (2 * F.length(F.bin(v.cast("long") + 1)) - 1).cast("int")


def qp(base: int, mean: Column, variance: Column, density: Column) -> Column:
    """A block's quality from its statistics; falls back to the base for extreme blocks."""
    b = max(1, min(100, base))
    extreme = (variance > 5000) | (variance < 1) | (mean < 5) | (mean > 250)
    shift = F.when(mean < 40, -2).when(mean > 215, -1).otherwise(0) + F.when(variance < 50, 2).when(variance > 1500, -2).otherwise(0) + F.when(density > 0.25, -2).when(density < 0.03, 1).otherwise(0)
    return F.when(extreme, b).otherwise(clamp(clamp(clamp(shift, -5, 5) + b, b - 10, b + 10), 1, 100))


def icc_flags(space: Column) -> tuple[Column, Column]:
    """(is_wide_gamut, is_hdr) of a colour space name."""
    return space.isin("AdobeRGB", "ProPhotoRGB", "DisplayP3", "Rec2020"), space == "Rec2020"


def as_int(kind: Column, v: Column) -> Column:
    return F.when(kind == "int", v.try_cast("bigint"))


def as_float(kind: Column, v: Column, num: Column, den: Column) -> Column:
    """Floats, and rationals unless the denominator is 0; integers are not floats."""
    return F.when(kind == "float", v.try_cast("double")).when(kind == "rational", F.try_divide(num, den))


def residual(v: Column, guess: Column) -> Column:
    return F.zip_with(v, guess, lambda a, b: a - b)


def reconstruct(guess: Column, left: Column) -> Column:
    return F.zip_with(guess, left, lambda a, b: clamp(a + b, 0, 255))


def coefficient_contexts(v: Column) -> Column:
    """0, 1 or 2 for each coefficient: the magnitude of the one before it, 0 at the start."""
    return F.transform(v, lambda x, i: F.when(i == 0, F.lit(0)).otherwise(F.least(F.abs(F.get(v, i - 1)).cast("int"), F.lit(2))))


def insert_markers(data: Column, interval: int) -> Column:
    """Bytes with a marker put in after `interval` bytes, and then after each interval + 4 further bytes of data."""
    s = F.decode(data, "ISO-8859-1")  # one character a byte
    step, n = interval + len(fixed.RESYNC), F.length(data)
    later = F.when(n > interval, F.transform(F.sequence(F.lit(0), div(n - 1 - interval, step).cast("int")), lambda k: F.substring(s, interval + 1 + k * step, F.lit(step))))
    return F.encode(F.array_join(F.concat(F.array(F.substring(s, 1, interval)), F.coalesce(later, F.array().cast("array<string>"))), fixed.RESYNC.decode("latin-1")), "ISO-8859-1")


def find_marker(data: Column, start: int = 0) -> Column:
    """Offset of the first marker at or after start; null if there is none."""
    return F.nullif(F.locate(fixed.RESYNC.decode("latin-1"), F.decode(data, "ISO-8859-1"), start + 1), F.lit(0)) - 1
