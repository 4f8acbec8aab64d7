"""Operators on 8x8 blocks: a block is a row with an array of 64 values in raster order. None of them shuffles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import clamp, div, qp


def from_vectors(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """Adds `px`: 64 pixels clamp(round(128 + 127 e)) of a vector column."""
    return df.withColumn("px", F.transform(F.col(vec).cast("array<double>"), lambda e: clamp(F.round(128 + 127 * e), 0, 255).cast("int")))


def _round(x: np.ndarray) -> np.ndarray:
    x = np.round(x, 6)
    return (np.sign(x) * np.floor(np.abs(x) + 0.5)).astype(np.int32)


def forward(x: np.ndarray, n: int = 8) -> np.ndarray:
    b = fixed.basis(n)
    return _round(b @ x @ b.T)


def inverse(c: np.ndarray, n: int = 8) -> np.ndarray:
    b = fixed.basis(n)
    return _round(b.T @ c @ b)


def int_forward(x: np.ndarray) -> np.ndarray:
    m = fixed.int_basis()
    return ((m @ (x.astype(np.int64) @ m.T)) + 2048) >> 12


def int_inverse(c: np.ndarray) -> np.ndarray:
    """The two shifts of 6 leave a gain of 64 over the forward transform; it is taken out here."""
    m = fixed.int_basis()
    rows = ((c.astype(np.int64) @ m) + 32) >> 6
    return ((((m.T @ rows) + 32) >> 6) + 32) >> 6


KERNELS = {"dct": forward, "idct": inverse, "dct16": lambda x: forward(x, 16), "idct16": lambda x: inverse(x, 16), "int_dct": int_forward, "int_idct": int_inverse}


def transform(df: DataFrame, kernel: str, source: str, target: str) -> DataFrame:
    """Adds `target`: the transform of the block in `source`, as one matrix product for each Arrow batch."""
    n = 16 if kernel.endswith("16") else 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = KERNELS[kernel]
        for batch in batches:
            x = np.asarray(batch.column(source).flatten(), dtype=np.float64).reshape(-1, n, n)
            out = f(x.astype(np.int64) if kernel.startswith("int") else x).astype(np.int32).reshape(-1)
            col = pa.FixedSizeListArray.from_arrays(pa.array(out), n * n).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, col], names=[*batch.schema.names, target])

    good = df.where(F.size(source) == n * n)
    return good.mapInArrow(run, good.withColumn(target, F.expr("cast(null as array<int>)")).schema)


def table(values: list[int]) -> Column:
    """A small constant array; a fixed 64 entries, so nothing is joined."""
    return F.array(*[F.lit(v) for v in values])


def quantized(v: str, quality: int, chroma: bool = False) -> Column:
    t = table(fixed.steps(quality, chroma))
    return F.zip_with(F.col(v), t, lambda a, b: (F.signum(a) * div(F.abs(a) + div(b, 2), b)).cast("int"))


def dequantized(v: str, quality: int, chroma: bool = False) -> Column:
    return F.zip_with(F.col(v), table(fixed.steps(quality, chroma)), lambda a, b: clamp(a * b, -32768, 32767))


def permuted(v: str, order: list[int]) -> Column:
    """Scans (order = fixed.zigzag()) and unscans (the inverse permutation)."""
    return F.transform(table(order), lambda i: F.get(F.col(v), i))


def inverse_of(order: list[int]) -> list[int]:
    out = [0] * len(order)
    for k, i in enumerate(order):
        out[i] = k
    return out


#: Places of each pass of a progressive scan.
PASSES = {"dc": [0], "low": [*fixed.LOW_AC], "high": [i for i in range(1, 64) if i not in fixed.LOW_AC]}


def split_passes(v: str) -> Column:
    """The coefficients of each pass, as a struct of arrays."""
    return F.struct(*[permuted(v, places).alias(name) for name, places in PASSES.items()])


def merge_passes(dc: Column, low: Column, high: Column) -> Column:
    """The 64 coefficients; those of missing or short passes are 0."""
    source = {i: F.get(part, F.lit(k)) for part, places in zip((dc, low, high), PASSES.values(), strict=True) for k, i in enumerate(places)}
    return F.array(*[F.coalesce(source[i], F.lit(0)) for i in range(64)])


def scan_order(n: int = 8) -> list[int]:
    """The permutation that scans n x n blocks; that of 4x4 blocks is the inverse of the diagonal scan, as in streams of the format."""
    return inverse_of(fixed.zigzag(4)) if n == 4 else fixed.zigzag(n)


def stats(df: DataFrame, px: str = "px") -> DataFrame:
    """Adds sum, sum_sq, low, high, edges of each block, and mean, variance, contrast, density from them."""
    v = F.col(px)
    total = lambda f: F.aggregate(F.transform(v, f), F.lit(0).cast("long"), lambda a, x: a + x)
    edge = F.transform(v, lambda x, i: F.when((i % 8 >= 1) & (i >= 8), F.abs(x - F.get(v, i - 1)) + F.abs(x - F.get(v, i - 8))).otherwise(0).cast("long"))
    out = df.withColumns({"sum": total(lambda x: x.cast("long")), "sum_sq": total(lambda x: (x * x).cast("long")), "low": F.array_min(v), "high": F.array_max(v), "edges": F.aggregate(edge, F.lit(0).cast("long"), lambda a, x: a + x)})
    mean = F.col("sum") / 64
    return out.withColumns({"mean": mean, "variance": F.greatest(F.lit(0.0), F.col("sum_sq") / 64 - mean * mean), "contrast": (F.col("high") - F.col("low")) / 255.0, "density": F.col("edges") / (49 * 510.0)})


def block_qp(df: DataFrame, base: int) -> DataFrame:
    return stats(df).withColumn("qp", qp(base, F.col("mean"), F.col("variance"), F.col("density")))


def zero_runs(v: str) -> Column:
    """Lengths of the runs of zeros of an array, each at most 255."""
    start = F.struct(F.expr("cast(array() as array<int>)").alias("runs"), F.lit(0).alias("n"))
    step = lambda a, x: F.when(x == 0, F.struct(F.when(a["n"] == 255, F.array_append(a["runs"], F.lit(255))).otherwise(a["runs"]).alias("runs"), F.when(a["n"] == 255, 1).otherwise(a["n"] + 1).alias("n"))).otherwise(
        F.struct(F.when(a["n"] > 0, F.array_append(a["runs"], a["n"])).otherwise(a["runs"]).alias("runs"), F.lit(0).alias("n"))
    )
    return F.aggregate(v, start, step, lambda a: F.when(a["n"] > 0, F.array_append(a["runs"], a["n"])).otherwise(a["runs"]))


def block_bits(v: str) -> Column:
    """Bits of a block in the run and magnitude syntax: 7, and for each item a flag, its Exp-Golomb code and a sign."""
    bits = lambda x: (2 * F.length(F.bin(x.cast("long") + 1)) - 1).cast("int")
    start = F.struct(F.lit(0).alias("bits"), F.lit(0).alias("run"))
    whole = lambda run: div(run, 32).cast("int") * (F.lit(1) + bits(F.lit(31))) + F.when(run % 32 > 0, 1 + bits(F.greatest(run % 32 - 1, F.lit(0)))).otherwise(0)
    step = lambda a, x: F.when(x == 0, F.struct(a["bits"].alias("bits"), (a["run"] + 1).alias("run"))).otherwise(
        F.struct((a["bits"] + whole(a["run"]) + 2 + bits(F.abs(x) - 1)).cast("int").alias("bits"), F.lit(0).alias("run"))
    )
    return F.lit(7) + F.aggregate(v, start, step)["bits"]
