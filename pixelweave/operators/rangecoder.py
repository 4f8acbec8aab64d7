"""Binary range coder and the token tree of coefficients, a block at a time inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import fixed
from .codec import CodecError

Step = tuple[int, int]
FULL, LEAST = (1 << 32) - 1, 1 << 24
#: Largest magnitude that the last class holds.
MOST = fixed.TOKENS[-1][1] + (1 << fixed.TOKENS[-1][2]) - 1


def plain(v: int, bits: int) -> list[Step]:
    """A value's bits, highest first, each as likely as not."""
    return [(v >> k & 1, 128) for k in reversed(range(bits))]


def range_encode(steps: Iterable[Step]) -> bytes:
    """The low end of the interval that (bit, probability of a zero in 256ths) steps lead to, trailing zero bytes left out.

    The interval's low end is one integer that grows by a byte as the width is scaled up, so carries need no care; streams are of a block's length.
    """
    low, width, grown = 0, FULL, 4
    for bit, prob in steps:
        zero = width * min(255, max(1, prob)) >> 8
        if bit:
            low += zero
        width = width - zero if bit else zero
        while width < LEAST:
            low, width, grown = low << 8, width << 8, grown + 1
    return low.to_bytes(grown, "big").rstrip(b"\0") or b"\0"


class RangeReader:
    """Reads steps back; past the end there are zero bytes."""

    def __init__(self, data: bytes):
        self.left, self.width = iter(data), FULL
        self.at = int.from_bytes(bytes(next(self.left, 0) for _ in range(4)), "big")

    def take(self, prob: int = 128) -> int:
        zero = self.width * min(255, max(1, prob)) >> 8
        bit = int(self.at >= zero)
        self.at, self.width = (self.at - zero, self.width - zero) if bit else (self.at, zero)
        while self.width < LEAST:
            self.at, self.width = self.at << 8 | next(self.left, 0), self.width << 8
        return bit

    def plain(self, bits: int) -> int:
        v = 0
        for _ in range(bits):
            v = v << 1 | self.take()
        return v


@cache
def token_steps(v: int) -> tuple[Step, ...]:
    """A coefficient's steps: it is no end, its class up the ladder, its extra bits, its sign."""
    size = abs(v)
    if size > MOST:
        raise CodecError(f"a coefficient of {v} has no token")
    kind = max(k for k, t in enumerate(fixed.TOKENS) if t[1] <= size)
    _, least, bits = fixed.TOKENS[kind]
    ladder = [(1, p) for p in fixed.CLASS_PROBS[:kind]] + [(0, p) for p in fixed.CLASS_PROBS[kind : kind + 1]]
    extra = [(b, p) for (b, _), p in zip(plain(size - least, bits), fixed.EXTRA_PROBS.get(kind, ()), strict=True)]
    return ((0, fixed.END_PROB), *ladder, *extra, *([(int(v < 0), 128)] if size else []))


def encode_block(values: list[int]) -> bytes:
    """Tokens up to the last coefficient that isn't zero, and an end token if any are left out."""
    n = max((i + 1 for i, v in enumerate(values) if v), default=0)
    steps = [s for v in values[:n] for s in token_steps(v)]
    return range_encode(steps + [(1, fixed.END_PROB)] * (n < len(values)))


def decode_block(data: bytes, length: int = 64) -> list[int]:
    read, out = RangeReader(data), []
    while len(out) < length and not read.take(fixed.END_PROB):
        kind = 0
        while kind < len(fixed.CLASS_PROBS) and read.take(fixed.CLASS_PROBS[kind]):
            kind += 1
        extra = 0
        for p in fixed.EXTRA_PROBS.get(kind, ()):
            extra = extra << 1 | read.take(p)
        size = fixed.TOKENS[kind][1] + extra
        out.append(-size if kind and read.take() else size)
    return out + [0] * (length - len(out))


def _mapped(df: DataFrame, source: str, target: str, kind: pa.DataType, sql: str, f) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if v is None else f(v) for v in batch.column(source).to_pylist()]
            yield batch.append_column(target, pa.array(made, kind))

    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, `{target}` {sql}")


def encode_tokens(df: DataFrame, source: str, target: str) -> DataFrame:
    """Adds each block's token stream; null blocks give null."""
    return _mapped(df, source, target, pa.binary(), "binary", encode_block)


def decode_tokens(df: DataFrame, source: str, target: str, length: int = 64) -> DataFrame:
    return _mapped(df, source, target, pa.list_(pa.int32()), "array<int>", lambda d: decode_block(d, length))
