"""Whole-image codecs and bit coders. Their recurrences run in NumPy, one image at a time, inside Arrow batches."""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from .blocks import forward, inverse


class CodecError(ValueError):
    pass


@dataclass(frozen=True)
class CodecConfig:
    """mode: lossless, lossy, mixed (coded as lossy) or legacy. strict: keep the 6-bit count that loses blocks whose last coefficient is not zero."""

    mode: str = "lossy"
    quality: int = 85
    strict: bool = False


# Row filters.


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    p = a + b - c
    pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))


SLAB = 1 << 20  # bytes of rows that are filtered at once


def filter_rows(raw: np.ndarray, channels: int) -> np.ndarray:
    """Rows of bytes as filter number and residuals, each row by its cheapest filter."""
    out = np.empty((len(raw), raw.shape[1] + 1), np.uint8)
    step = max(1, SLAB // max(1, raw.shape[1]))
    shift = lambda m: np.hstack([np.zeros((len(m), channels), np.int16), m])[:, : m.shape[1]]
    for at in range(0, len(raw), step):
        x = raw[at : at + step].astype(np.int16)
        up = np.vstack([raw[at - 1 : at].astype(np.int16) if at else np.zeros_like(x[:1]), x[:-1]])
        left, corner = shift(x), shift(up)
        best, least = np.zeros(len(x), np.uint8), None
        chosen = out[at : at + step, 1:]
        for k, guess in enumerate((np.int16(0), left, up, (left + up) // 2, _paeth(left, up, corner))):
            d = (x - guess).astype(np.uint8)
            cost = np.minimum(d, 0 - d).sum(1, dtype=np.int64)
            better = np.ones(len(x), bool) if least is None else cost < least
            best[better], chosen[better] = k, d[better]
            least = cost if least is None else np.minimum(cost, least)
        out[at : at + step, 0] = best
    return out


def _undo(kind: int, d: list[int], above: list[int]) -> list[int]:
    """One channel of a row by Average or Paeth, whose guesses need the sample before."""
    now, a, c = [], 0, 0
    for x, b in zip(d, above, strict=True):
        if kind == 3:
            guess = (a + b) >> 1
        else:
            pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - c - c)
            guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
            c = b
        a = (x + guess) & 255
        now.append(a)
    return now


def unfilter_rows(coded: np.ndarray, channels: int) -> np.ndarray:
    out = np.zeros((len(coded), coded.shape[1] - 1), np.uint8)
    above = np.zeros(out.shape[1], np.uint8)
    for y, row in enumerate(coded):
        kind, d, now = row[0], row[1:], out[y]
        if kind in (1, 3, 4):
            for c in range(channels):
                part = d[c::channels]
                now[c::channels] = np.cumsum(part, dtype=np.uint8) if kind == 1 else _undo(int(kind), part.tolist(), above[c::channels].tolist())
        else:
            now[:] = d + above if kind == 2 else d
        above = now
    return out


# Huffman: counts, lengths and bits.


def huffman_codes(counts) -> dict[int, str]:
    """Codes of the symbols counted. The two rarest nodes join, of equal ones those that came last; a lone symbol has the code 0."""
    nodes = [(n, -i, s, None) for i, (s, n) in enumerate((s, n) for s, n in enumerate(counts) if n)]
    if len(nodes) == 1:
        return {nodes[0][2]: "0"}
    heap, born = [*nodes], len(nodes)
    heapq.heapify(heap)
    while len(heap) > 1:
        right, left = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (left[0] + right[0], -born, None, (left, right)))
        born += 1
    codes: dict[int, str] = {}
    stack = [(heap[0], "")] if heap else []
    while stack:
        node, code = stack.pop()
        if node[3] is None:
            codes[node[2]] = code
        else:
            stack += [(node[3][0], code + "0"), (node[3][1], code + "1")]
    return codes


STEP = 1 << 16  # symbols coded, or bytes decoded, at once
PREFIX = 16  # bits of a code that one look into the decoder's table resolves


def huffman_encode(data: bytes) -> bytes:
    """256 counts, the length, the coded length, then the bits."""
    raw = np.frombuffer(data, np.uint8)
    counts = np.bincount(raw, minlength=256)
    sizes, values = np.zeros(256, np.int64), np.zeros(256, np.uint64)
    for s, code in huffman_codes(counts.tolist()).items():
        sizes[s], values[s] = len(code), int(code, 2)
    body, rest = bytearray(), np.zeros(0, np.uint8)
    for at in range(0, len(raw), STEP):
        part = raw[at : at + STEP]
        size = sizes[part]
        ends = np.cumsum(size)
        left = np.repeat(ends, size) - np.arange(ends[-1]) - 1  # bits of its code behind each bit
        bits = (np.repeat(values[part], size) >> left.astype(np.uint64)).astype(np.uint8) & 1
        bits = np.concatenate([rest, bits])
        whole = len(bits) & ~7
        body += np.packbits(bits[:whole]).tobytes()
        rest = bits[whole:]
    body += np.packbits(rest).tobytes()
    return counts.astype("<u4").tobytes() + struct.pack("<II", len(data), len(body)) + bytes(body)


def huffman_decode(data: bytes) -> bytes:
    """Symbol and length of the code at every bit are looked up for a slice of bytes at once; then the codes are followed from bit to bit."""
    if len(data) < 1032:
        raise CodecError("the Huffman stream is shorter than its tables")
    counts = np.frombuffer(data[:1024], "<u4").tolist()
    n, size = struct.unpack_from("<II", data, 1024)
    body = data[1032 : 1032 + size]
    if len(body) < size:
        raise CodecError("the Huffman stream breaks off")
    symbols, sizes, long = np.zeros(1 << PREFIX, np.uint8), np.zeros(1 << PREFIX, np.uint8), {}
    for s, code in huffman_codes(counts).items():
        if len(code) > PREFIX:
            long[code] = s
            continue
        first = int(code, 2) << (PREFIX - len(code))
        last = first + (1 << (PREFIX - len(code)))
        symbols[first:last], sizes[first:last] = s, len(code)
    padded, out, at = np.frombuffer(body + bytes(2), np.uint8).astype(np.uint32), bytearray(), 0
    while at < 8 * size and len(out) < n:
        base = at >> 3
        three = [padded[base + k : base + STEP + k] for k in range(3)]
        m = len(three[2])
        wide = three[0][:m] << 16 | three[1][:m] << 8 | three[2]
        window = (wide[:, None] >> np.arange(8, 0, -1, dtype=np.uint32) & 0xFFFF).reshape(-1)
        lengths, begun, i = sizes[window].tobytes(), [], at - 8 * base
        while i < 8 * m and (step := lengths[i]):
            begun.append(i)
            i += step
        out += symbols[window[begun]].tobytes()
        at = 8 * base + i
        if i < 8 * m and len(out) < n:
            bits = "".join(format(b, "08b") for b in body[at >> 3 : (at >> 3) + 40])[at & 7 :]
            code = next((bits[:k] for k in range(PREFIX + 1, len(bits) + 1) if bits[:k] in long), None)
            if code is None:
                break
            out.append(long[code])
            at += len(code)
    if len(out) < n or (len(out) == n and at > 8 * size):
        raise CodecError("the Huffman stream holds too few symbols")
    return bytes(out[:n])


# Exp-Golomb blocks.


def golomb(v: int) -> str:
    bits = bin(v + 1)[2:]
    return "0" * (len(bits) - 1) + bits


def block_code(v: list[int], strict: bool = False) -> str:
    """Bits of a scanned block. Beyond the strict form, a full block is marked by the count 63 and one more bit."""
    last = max((i for i, x in enumerate(v) if x), default=-1)
    if last < 0:
        return "0000001"
    count = last + 1
    head = format(count % 64 if strict else min(count, 63), "06b") + "0"
    if not strict and count >= 63:
        head += "1" if count == 64 else "0"
    out, run = [head], 0
    for x in v[: last + 1]:
        if x == 0:
            run += 1
            continue
        while run:
            out.append("0" + golomb(min(run, 32) - 1))
            run -= min(run, 32)
        out.append("1" + golomb(abs(x) - 1) + ("1" if x < 0 else "0"))
    return "".join(out)


class Bits:
    def __init__(self, data: bytes):
        self.bits, self.at = "".join(format(b, "08b") for b in data), 0

    def take(self, n: int) -> int:
        part = self.bits[self.at : self.at + n].ljust(n, "0")
        self.at += n
        return int(part, 2) if n else 0

    def golomb(self) -> int:
        zeros = 0
        while not self.take(1):
            zeros += 1
            if zeros > 16:
                return 0
        return (1 << zeros | self.take(zeros)) - 1


def block_decode(data: bytes, strict: bool = False) -> list[int]:
    bits, out = Bits(data), []
    count = bits.take(6)
    if bits.take(1):
        return [0] * 64
    if not strict and count == 63:
        count += bits.take(1)
    while len(out) < count:
        if bits.take(1):
            size = bits.golomb() + 1
            out.append(-size if bits.take(1) else size)
        else:
            out += [0] * (bits.golomb() + 1)
    return (out + [0] * 64)[:64]


def pack(bits: str) -> bytes:
    return np.packbits(np.frombuffer(bits.encode(), np.uint8) - 48).tobytes()


# Intra prediction.


def predict(mode: str, top: np.ndarray, left: np.ndarray, corner: int, n: int = 8) -> np.ndarray:
    """The 8x8 prediction of a mode from 8 upper and 8 left neighbours, padded to 16 with 128."""
    t, s = (np.concatenate([v[:n], np.full(n, 128)]).astype(np.int64) for v in (top, left))
    y, x = np.mgrid[:n, :n]
    pick = lambda v, i: v[np.clip(i, 0, 2 * n - 1)]
    if mode == "DC":
        return np.full((n, n), (t[:n].sum() + s[:n].sum() + n) // (2 * n))
    if mode == "Horizontal":
        return s[y]
    if mode == "Vertical":
        return t[x]
    if mode == "DownLeft":
        return (pick(t, x + y + 1) + pick(t, x + y + 2) + 1) // 2
    if mode == "DownRight":
        return np.where(x > y, pick(t, x - y - 1), np.where(x < y, pick(s, y - x - 1), corner))
    if mode in ("VerticalRight", "HorizontalDown"):
        (u, v, a, b) = (x, y, t, s) if mode == "VerticalRight" else (y, x, s, t)
        i = u - v // 2
        return np.where(i >= 0, pick(a, i), pick(b, -i - 1))
    if mode in ("VerticalLeft", "HorizontalUp"):
        (u, v, a) = (x, y, t) if mode == "VerticalLeft" else (y, x, s)
        i = u + v // 2
        return np.where(v % 2 == 0, pick(a, i), (pick(a, i) + pick(a, i + 1) + 1) // 2)
    if mode == "Planar":
        return np.clip(((n - 1 - x) * s[y] + (x + 1) * t[n - 1] + (n - 1 - y) * t[x] + (y + 1) * s[n - 1] + n) // (2 * n), 0, 255)
    return np.clip(t[x] + s[y] - corner, 0, 255)


def best_mode(block: np.ndarray, top: np.ndarray, left: np.ndarray, corner: int, edge: bool) -> tuple[int, int]:
    """(mode, absolute difference): the least difference, the earlier mode at ties; blocks of the first row or column choose of three."""
    sads = [int(abs(block - predict(m, top, left, corner)).sum()) for m in fixed.MODES[: 3 if edge else None]]
    return int(np.argmin(sads)), min(sads)


def _neighbours(plane: np.ndarray, y: int, x: int) -> tuple[np.ndarray, np.ndarray, int]:
    top = plane[y - 1, x : x + 8] if y else np.full(8, 128)
    left = plane[y : y + 8, x - 1] if x else np.full(8, 128)
    return top, left, int(plane[y - 1, x - 1]) if x and y else 128


def _qp(block: np.ndarray, base: int) -> int:
    b = block.astype(np.float64)
    mean, variance = b.mean(), max(0.0, (b * b).mean() - b.mean() ** 2)
    density = (abs(b[1:, 1:] - b[1:, :-1]).sum() + abs(b[1:, 1:] - b[:-1, 1:]).sum()) / (49 * 510)
    if variance > 5000 or variance < 1 or mean < 5 or mean > 250:
        return base
    shift = (-2 if mean < 40 else -1 if mean > 215 else 0) + (2 if variance < 50 else -2 if variance > 1500 else 0) + (-2 if density > 0.25 else 1 if density < 0.03 else 0)
    return int(np.clip(base + np.clip(shift, -5, 5), max(1, base - 10), min(100, base + 10)))


_ZIGZAG = np.array(fixed.zigzag())


def _rebuild(levels: np.ndarray, guess: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Shared by both directions, so that predictions never drift."""
    return np.clip(guess + inverse(np.clip(levels * steps, -32768, 32767).reshape(8, 8)), 0, 255).astype(np.int64)


def encode_plane(plane: np.ndarray, quality: int, chroma: bool, strict: bool = False) -> bytes:
    """Modes, qualities and coefficients of a padded plane, each behind its length."""
    h, w = plane.shape
    seen, modes, qps, coded = np.zeros_like(plane, dtype=np.int64), bytearray(), bytearray(), bytearray()
    for y in range(0, h, 8):
        for x in range(0, w, 8):
            block, around = plane[y : y + 8, x : x + 8].astype(np.int64), _neighbours(seen, y, x)
            mode, _ = best_mode(block, *around, edge=not (x and y))
            guess, q = predict(fixed.MODES[mode], *around), _qp(block, quality)
            steps = np.array(fixed.steps(q, chroma))
            c = forward(block - guess).reshape(-1)
            levels = np.sign(c) * ((abs(c) + steps // 2) // steps)
            bits = pack(block_code(levels[_ZIGZAG].tolist(), strict))
            modes.append(mode)
            qps.append(q)
            coded += struct.pack(">H", len(bits)) + bits
            seen[y : y + 8, x : x + 8] = _rebuild(levels, guess, steps)
    return b"".join(struct.pack("<I", len(p)) + bytes(p) for p in (modes, qps, coded))


def decode_plane(data: bytes, at: int, h: int, w: int, chroma: bool, strict: bool = False) -> tuple[np.ndarray, int]:
    parts = []
    for _ in range(3):
        (n,) = struct.unpack_from("<I", data, at)
        parts.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    modes, qps, coded = parts
    plane, k, pos = np.zeros((h, w), np.int64), 0, 0
    for y in range(0, h, 8):
        for x in range(0, w, 8):
            (n,) = struct.unpack_from(">H", coded, pos)
            levels = np.zeros(64, np.int64)
            levels[_ZIGZAG] = block_decode(coded[pos + 2 : pos + 2 + n], strict)
            pos += 2 + n
            guess = predict(fixed.MODES[modes[k]], *_neighbours(plane, y, x))
            plane[y : y + 8, x : x + 8] = _rebuild(levels, guess, np.array(fixed.steps(qps[k], chroma)))
            k += 1
    return plane, at


def _to_ycc(rgb: np.ndarray) -> np.ndarray:
    m = np.array([r[1:] for r in fixed.COLOR["full"][:3]])
    return np.clip(np.floor(rgb @ m.T + np.array([0.0, 128.0, 128.0]) + 0.5), 0, 255).astype(np.int64)


def _to_rgb(ycc: np.ndarray) -> np.ndarray:
    wr, gb, gr, wb = fixed.COLOR["full"][3]
    y, b, r = ycc[..., 0].astype(float), ycc[..., 1] - 128.0, ycc[..., 2] - 128.0
    return np.clip(np.floor(np.stack([y + wr * r, y + gb * b + gr * r, y + wb * b], -1) + 0.5), 0, 255).astype(np.uint8)


def _padded(plane: np.ndarray) -> np.ndarray:
    h, w = plane.shape
    return np.pad(plane, ((0, -h % 8), (0, -w % 8)), "edge")


def rle(values: np.ndarray) -> bytes:
    """Zero runs as 00 n, small values as 01 and sign-magnitude, others as 02 and 16 bits."""
    out, run = bytearray(), 0
    for v in [*values.tolist(), None]:
        if v == 0 and run < 255:
            run += 1
            continue
        if run:
            out += bytes((0, run))
            run = 0
        if v == 0:
            run = 1
        elif v is not None:
            out += bytes((1, abs(v) | (v < 0) << 7)) if abs(v) <= 127 else b"\x02" + struct.pack("<H", abs(v) | (v < 0) << 15)
    return bytes(out)


def unrle(data: bytes) -> np.ndarray:
    out, i = [], 0
    while i < len(data):
        if data[i] == 0:
            out += [0] * data[i + 1]
            i += 2
        elif data[i] == 1:
            out.append((data[i + 1] & 127) * (-1 if data[i + 1] & 128 else 1))
            i += 2
        elif data[i] == 2:
            (v,) = struct.unpack_from("<H", data, i + 1)
            out.append((v & 0x7FFF) * (-1 if v & 0x8000 else 1))
            i += 3
        else:
            i += 1
    return np.array(out, np.int64)


def encode(raw: bytes, w: int, h: int, channels: int, config: CodecConfig) -> bytes:
    if len(raw) != w * h * channels:
        raise CodecError(f"{w} x {h} x {channels} needs {w * h * channels} bytes, not {len(raw)}")
    px = np.frombuffer(raw, np.uint8).reshape(h, w, channels)
    if config.mode == "lossless":
        return huffman_encode(filter_rows(px.reshape(h, w * channels), channels).tobytes())
    rgb = px[..., :3] if channels >= 3 else np.repeat(px[..., :1], 3, 2)
    planes = [_padded(p) for p in np.moveaxis(_to_ycc(rgb), 2, 0)]
    lossy = config.mode in ("lossy", "mixed")
    tables = b"".join(np.array(fixed.steps(config.quality, c, "aggressive" if lossy else "legacy"), "<u2").tobytes() for c in (False, True))
    if lossy:
        body = zlib.compress(b"".join(encode_plane(p, config.quality, k > 0, config.strict) for k, p in enumerate(planes)), 9)
        return bytes((1, 1, 1)) + tables + struct.pack("<I", len(body)) + body
    every = []
    for k, p in enumerate(planes):
        steps = np.array(fixed.steps(config.quality, k > 0, "legacy"))
        b = p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).swapaxes(1, 2).reshape(-1, 8, 8)
        c = forward(b - 128).reshape(-1, 64)
        every.append((np.sign(c) * (abs(c) // steps))[:, _ZIGZAG].reshape(-1))
    return tables + huffman_encode(rle(np.concatenate(every)))


def route(data: bytes, mode: str) -> str:
    """The coder of a payload: lossless by its mode; else legacy if it begins with steps of 16 bits, whose second byte is 0, and lossy if it begins with flags."""
    return "lossless" if mode == "lossless" else "lossy" if len(data) > 259 and data[:3] == bytes((1, 1, 1)) else "legacy"


def decode(data: bytes, w: int, h: int, channels: int, config: CodecConfig) -> bytes:
    """The raster. A lossy alpha channel, which the stream doesn't hold, becomes 255; grey comes back as the red of the colour planes."""
    if config.mode == "lossless":
        rows = np.frombuffer(huffman_decode(data), np.uint8)
        if len(rows) != h * (1 + w * channels):
            raise CodecError("the body does not fit the size")
        return unfilter_rows(rows.reshape(h, -1), channels).tobytes()
    ph, pw = h + -h % 8, w + -w % 8
    if len(data) < 263:
        raise CodecError("a payload has 263 bytes at least")
    if route(data, config.mode) == "lossy":
        (n,) = struct.unpack_from("<I", data, 259)
        try:
            body = zlib.decompress(data[263 : 263 + n])
        except zlib.error as e:
            raise CodecError(str(e)) from e
        at, planes = 0, []
        for k in range(3):
            plane, at = decode_plane(body, at, ph, pw, k > 0, config.strict)
            planes.append(deblock_plane(plane, config.quality, k > 0))
    else:
        values, planes = unrle(huffman_decode(data[256:])).reshape(3, -1, 64), []
        for k in range(3):
            levels = np.zeros_like(values[k])
            levels[:, _ZIGZAG] = values[k]
            b = np.clip(inverse((levels * np.array(fixed.steps(config.quality, k > 0, "legacy"))).reshape(-1, 8, 8)) + 128, 0, 255)
            planes.append(b.reshape(ph // 8, pw // 8, 8, 8).swapaxes(1, 2).reshape(ph, pw))
    rgb = _to_rgb(np.stack(planes, -1)[:h, :w])
    if channels <= 2:
        rgb = rgb[..., :1]
    return (np.dstack([rgb, np.full((h, w, 1), 255, np.uint8)]) if channels in (2, 4) else rgb).tobytes()


def deblock_plane(plane: np.ndarray, quality: int, chroma: bool = False) -> np.ndarray:
    """Vertical edges, then horizontal ones, all edges of a direction at once."""
    strength, threshold, sharpness, simple, enabled = fixed.deblock_row(quality)
    if not enabled:
        return plane
    level = max(1, strength * (8 - min(sharpness, 7)) // 8)
    level = max(1, level * 3 // 4) if chroma else level
    cut = lambda a, b: np.sign(a) * (abs(a) // b)
    for turn in range(2):
        p = plane.T.copy() if turn else plane.copy()
        e = np.arange(8, p.shape[1] - 2, 8)
        p2, p1, p0, q0, q1, q2 = (p[:, e + k] for k in range(-3, 3))
        gap = abs(p0 - q0)
        on = (gap <= threshold) | ((gap < 4 * level) & (np.maximum(abs(p1 - p0), abs(q1 - q0)) < 2 * level))
        flat = (abs(p2 - p1) < level) & (abs(p1 - p0) < level) & (abs(q1 - q0) < level) & (abs(q2 - q1) < level)
        strong = flat & (gap < max(1, level // 2)) & (not simple)
        low = np.clip(cut(3 * (q0 - p0), 8), -level, level)
        mid = np.clip((3 * (q0 - p0) + np.clip(p1 - q1, -128, 127) + 4) >> 3, -level, level)
        flat, outer = flat & (not simple), (mid + 1) >> 1
        new = {-2: (p1, p1 + outer, (p2 + 2 * p1 + 2 * p0 + q0 + 3) // 6), -1: (p0 + low, p0 + mid, (p1 + 2 * p0 + 2 * q0 + q1 + 3) // 6), 0: (q0 - low, q0 - mid, (p0 + 2 * q0 + 2 * q1 + q2 + 3) // 6), 1: (q1, q1 - outer, (q0 + 2 * q1 + 3 * q2 + 3) // 6)}
        for k, (a, b, c) in new.items():
            p[:, e + k] = np.where(on, np.clip(np.where(strong, c, np.where(flat, b, a)), 0, 255), p[:, e + k])
        plane = p.T if turn else p
    return plane


SLICE = 64 << 20  # bytes of rasters that are Python objects at once


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose binaries in a column have SLICE bytes, or one row."""
    for batch in batches:
        upto = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE, "right")))
            yield batch.slice(at, end - at)
            at = end


def roundtrip(images: DataFrame, config: CodecConfig) -> DataFrame:
    """(image, raw_bytes, coded_bytes, decoded, max_error, psnr) of rasters (image, w, h, channels, pixels)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "pixels"):
            rows = []
            for r in part.to_pylist():
                size = (r["w"], r["h"], r["channels"])
                coded = encode(r["pixels"], *size, config)
                back = decode(coded, *size, config)
                diff = np.frombuffer(r["pixels"], np.uint8).astype(int) - np.frombuffer(back, np.uint8)
                mse = float((diff**2).mean()) if len(diff) else 0.0
                rows.append((r["image"], len(r["pixels"]), len(coded), back, int(abs(diff).max(initial=0)), 99.0 if not mse else round(10 * float(np.log10(65025 / mse)), 4)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.float64()), strict=True)], names=["image", "raw_bytes", "coded_bytes", "decoded", "max_error", "psnr"])

    return images.select("image", "w", "h", "channels", "pixels").mapInArrow(run, "image string, raw_bytes long, coded_bytes long, decoded binary, max_error int, psnr double")


def coded(images: DataFrame, config: CodecConfig) -> DataFrame:
    """(image, raw_bytes, payload, route, same): payloads of rasters in a mode, the coder that each is sent to, and whether decoding gives the raster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "pixels"):
            rows = []
            for r in part.to_pylist():
                size = (r["w"], r["h"], r["channels"])
                payload = encode(r["pixels"], *size, config)
                rows.append((r["image"], len(r["pixels"]), payload, route(payload, config.mode), decode(payload, *size, config) == r["pixels"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.binary(), pa.string(), pa.bool_()), strict=True)], names=["image", "raw_bytes", "payload", "route", "same"])

    return images.select("image", "w", "h", "channels", "pixels").mapInArrow(run, "image string, raw_bytes long, payload binary, route string, same boolean")


# Motion search.

RINGS = {"large": ((0, 0), (-2, 0), (2, 0), (0, -2), (0, 2), (-1, -1), (1, -1), (-1, 1), (1, 1)), "small": ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)), "hexagon": ((0, 0), (-2, 0), (2, 0), (-1, -2), (1, -2), (-1, 2), (1, 2)), "square": tuple((x, y) for y in (-1, 0, 1) for x in (-1, 0, 1))}


def motion(cur: np.ndarray, ref: np.ndarray, bx: int, by: int, size: int, reach: int, how: str) -> tuple[int, int, int]:
    """(dx, dy, absolute difference) of a block by full, diamond, hexagon or step search."""
    h, w = cur.shape
    ys, xs = np.arange(by * size, min(h, by * size + size)), np.arange(bx * size, min(w, bx * size + size))
    block, memo = cur[np.ix_(ys, xs)].astype(int), {}

    def sad(dx: int, dy: int) -> float:
        if max(abs(dx), abs(dy)) > reach:
            return float("inf")
        if (dx, dy) not in memo:
            memo[dx, dy] = int(abs(block - ref[np.ix_(np.clip(ys + dy, 0, h - 1), np.clip(xs + dx, 0, w - 1))].astype(int)).sum())
        return memo[dx, dy]

    def ring(center, points, step=1):
        return min(((sad(center[0] + step * x, center[1] + step * y), k) for k, (x, y) in enumerate(points)))

    if how == "full":
        s, dy, dx = min((sad(dx, dy), dy, dx) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1))
        return dx, dy, int(s)
    center = (0, 0)
    if how == "step":
        step = max(1, reach // 2)
        while step:
            _, k = ring(center, RINGS["square"], step)
            center = (center[0] + step * RINGS["square"][k][0], center[1] + step * RINGS["square"][k][1])
            step //= 2
        return (*center, int(sad(*center)))
    outer, inner = (RINGS["large"], RINGS["small"]) if how == "diamond" else (RINGS["hexagon"], RINGS["square"])
    for _ in range(16):
        _, k = ring(center, outer)
        if outer[k] == (0, 0):
            break
        center = (center[0] + outer[k][0], center[1] + outer[k][1])
    # The refinement moves its centre as it goes.
    best = sad(*center)
    for x, y in inner:
        if (s := sad(center[0] + x, center[1] + y)) < best:
            best, center = s, (center[0] + x, center[1] + y)
    return (*center, int(best))


def motion_search(pairs: DataFrame, size: int, reach: int, how: str) -> DataFrame:
    """(image, bx, by, dx, dy, sad) of plane pairs (image, w, h, cur, ref)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "cur"):
            rows = []
            for r in batch.to_pylist():
                cur, ref = (np.frombuffer(r[c], np.uint8).reshape(r["h"], r["w"]) for c in ("cur", "ref"))
                rows += [(r["image"], bx, by, *motion(cur, ref, bx, by, size, reach, how)) for by in range(-(-r["h"] // size)) for bx in range(-(-r["w"] // size))]
            if rows:
                cols = [*zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), *(pa.array(c, pa.int32()) for c in cols[1:5]), pa.array(cols[5], pa.int64())], names=["image", "bx", "by", "dx", "dy", "sad"])

    return pairs.select("image", "w", "h", "cur", "ref").mapInArrow(run, "image string, bx int, by int, dx int, dy int, sad long")


def unpack(data: bytes, depth: int) -> np.ndarray:
    """16-bit samples of packed bytes. 8 bits: the byte twice; 10: four high bytes, then a byte of their low pairs; 12: two high bytes, then a byte
    of their low halves; 16: little-endian; other depths: the byte, 8 bits up. A last group that is not whole is dropped."""
    size = {10: 5, 12: 3, 16: 2}.get(depth, 1)
    g = np.frombuffer(data, np.uint8, len(data) // size * size).reshape(-1, size).astype(np.uint16)
    if depth == 16:
        return g[:, 0] | g[:, 1] << 8
    if size == 1:
        return g[:, 0] * (257 if depth == 8 else 256)
    low = depth - 8
    down = 8 - low * np.arange(1, size, dtype=np.uint16)
    return ((g[:, :-1] << low | g[:, -1:] >> down & (1 << low) - 1) << 16 - depth).reshape(-1)


def samples(df: DataFrame, column: str, depth: int) -> DataFrame:
    """Adds `samples`, the unpacked array of a binary column; null where that is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column):
            made = [None if v is None else unpack(v, depth).astype(np.int32) for v in part.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.list_(pa.int32()))], names=[*part.schema.names, "samples"])

    return df.mapInArrow(run, df.withColumn("samples", F.expr("cast(null as array<int>)")).schema)


def byte_counts(df: DataFrame, column: str, residual: bool = False) -> DataFrame:
    """(byte, n): bytes of a text or binary column (residual: Sub residuals of one-row rasters), counted per batch, then summed. Nothing is exploded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(256, np.int64)
            for v in batch.column(0):
                raw = np.frombuffer(v.as_py() or b"", np.uint8)
                if len(raw):
                    n += np.bincount(np.diff(raw, prepend=np.uint8(0)) if residual else raw, minlength=256)
            yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int32()), pa.array(n, pa.int64())], names=["byte", "n"])

    return df.select(F.col(column).cast("binary").alias("v")).mapInArrow(run, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).where("n > 0")
