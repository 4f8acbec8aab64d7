"""Mixing sources to target weights by Poisson replication.

A source with weight w of the mix and c of all characters C is repeated w * C / c times on average. Each document's number of copies
inverts the Poisson distribution with that mean at a uniform number hashed from the seed and the document's id, so a task run again
gives the same copies. The copies are then dealt out and sorted by a hash of seed, id and copy: a global shuffle.

Defined results: a null source is a source of its own, which `weights` may name by None; null and empty texts count no characters; a source without
any has rate 1, unless `weights` gives it none; rows with a null doc_id share one uniform number, repeated rows have equal counts;
a source that `weights` leaves out has weight 0 and is dropped, so weights that name no source present give an empty result; weights that are negative or
not finite raise; very long texts are copied whole; an empty table gives an empty result. Columns of docs whose names clash with the added
ones are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import cut, whole_text

ADDED = ("rate", "copies", "copy", "mix_key")
#: So many sources are broadcast with their distributions at most; with more of them an ordinary join is used.
MOST_BROADCAST = 2_000


def uniform(seed: int, *parts: Column) -> Column:
    """52 bits of an MD5 as a number in (0, 1)."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = 0.5) -> DataFrame:
    """(source, rate) by the given weights, or by the power of each source's characters: a small table in the shared folder, a row for each source."""
    sizes = docs.groupBy("source").agg(F.sum(F.length(whole_text())).alias("chars"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow(F.col("chars").cast("double"), F.lit(power)))
        unmeasured = F.lit(1.0)
    else:
        if not all(math.isfinite(v) and v >= 0 for v in weights.values()):
            raise ValueError("weights are finite numbers of at least 0")
        pairs = [x for k, v in weights.items() if k is not None for x in (F.lit(k), F.lit(float(v)))]
        named = F.create_map(*pairs)[F.col("source")] if pairs else F.lit(None).cast("double")
        sizes = sizes.withColumn("weight", F.when(F.col("source").isNull(), F.lit(float(weights.get(None, 0)))).otherwise(F.coalesce(named, F.lit(0.0))))
        unmeasured = F.when(F.col("weight") > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    sizes = cut(sizes, "sources")
    # Weights of sources without characters have nothing to be spent on.
    all_weight, all_chars = sizes.where("chars > 0").agg(F.sum("weight"), F.sum("chars")).first()
    rate = F.col("weight") / F.lit(all_weight or 1.0) * F.lit(all_chars or 0).cast("long") / F.col("chars")
    return sizes.select("source", F.when(F.col("chars") > 0, rate).otherwise(unmeasured).alias("rate"))


def copies(rate: Column, u: Column) -> Column:
    """The smallest k whose cumulative Poisson probability reaches u. The terms are summed in logarithms from 0 on; beyond a mean of
    500 the sum starts 12 standard deviations below it, where what is left out lies below the tail that 52 bits can tell apart."""
    first = F.greatest(F.lit(0.0), F.when(rate > 500, F.floor(rate - 12 * F.sqrt(rate))).otherwise(F.lit(0.0))).cast("long")
    last = (rate + 40 * F.sqrt(rate) + 40).cast("long")
    # ln(k!) for the first term: exact product for small k; Stirling's series beyond.
    k = first.cast("double")
    log_factorial = F.when(first == 0, F.lit(0.0)).otherwise(k * F.log(k) - k + 0.5 * F.log(2 * F.lit(3.141592653589793) * k) + 1 / (12 * k) - 1 / (360 * k * k * k))
    start = F.struct(F.exp(-rate + F.when(first > 0, k * F.log(rate)).otherwise(0.0) - log_factorial).alias("p"), F.lit(0.0).alias("sum"), F.lit(-1).cast("long").alias("k"))
    step = lambda a, i: F.when(a["k"] >= 0, a).otherwise(
        F.struct((a["p"] * rate / (i + 1).cast("double")).alias("p"), (a["sum"] + a["p"]).alias("sum"), F.when(a["sum"] + a["p"] >= u, i).otherwise(F.lit(-1).cast("long")).alias("k"))
    )
    found = F.aggregate(F.sequence(first, last), start, step)["k"]
    return F.when(rate <= 0, F.lit(0).cast("long")).otherwise(F.when(found >= 0, found).otherwise(last))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = 0.5, seed: int = 17) -> DataFrame:
    """docs with each row as often as its count says, in a random order that the seed fixes; plus rate, copies, copy (from 1) and mix_key."""
    docs = docs.drop(*ADDED)
    table = rates(docs, weights, power)
    small = table.count() <= MOST_BROADCAST
    rows = docs.join(F.broadcast(table) if small else table, docs["source"].eqNullSafe(table["source"])).drop(table["source"])
    rows = rows.withColumn("copies", copies(F.col("rate"), uniform(seed, F.col("doc_id"))))
    rows = rows.withColumn("copy", F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1).cast("long"), F.col("copies"))).otherwise(F.expr("cast(array() as array<bigint>)"))))
    key = F.md5(F.concat_ws(":", F.lit(f"{seed}/order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("copy").cast("string")))
    return rows.withColumn("mix_key", key).repartition("mix_key").sortWithinPartitions("mix_key")


def oracle(power: float = 0.5, seed: int = 17) -> str:
    """DuckDB's form for rates up to 500: a recursive sum of the Poisson terms of each source, which each document's uniform number inverts."""
    return f"""
WITH RECURSIVE s AS (SELECT source, sum(length(coalesce(text, '')))::BIGINT AS chars FROM documents GROUP BY source),
t AS (SELECT sum(pow(chars::DOUBLE, {power})) AS aw, sum(chars) AS ac FROM s),
r AS (SELECT source, CASE WHEN chars > 0 THEN pow(chars::DOUBLE, {power}) / aw * ac / chars ELSE 1.0 END AS rate FROM s, t),
f AS (SELECT source, rate, 0::BIGINT AS k, exp(-rate) AS p, exp(-rate) AS cum FROM r
      UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), cum + p * rate / (k + 1) FROM f WHERE k < rate + 40 * sqrt(rate) + 40),
d AS (SELECT doc_id, source, lang, length(coalesce(text, '')) AS n_chars, (('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents),
c AS (SELECT d.doc_id, d.source, d.lang, d.n_chars, (SELECT min(f.k) FROM f WHERE f.source IS NOT DISTINCT FROM d.source AND f.cum >= d.u) AS copies FROM d)
SELECT doc_id, source, lang, n_chars::BIGINT AS n_chars, copies, k AS copy, md5('{seed}/order:' || coalesce(doc_id::VARCHAR, '') || ':' || k::VARCHAR) AS mix_key
FROM c, LATERAL (SELECT unnest(range(1, copies + 1)) AS k)"""
