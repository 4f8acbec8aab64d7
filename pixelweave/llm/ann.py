"""Nearest neighbours by largest inner product, with vantage-point trees.

Vectors are centred (which changes all products of a query alike) and lifted by one coordinate to equal length; queries are scaled to that
length too. There the largest inner product is the smallest distance, and the triangle inequality holds. Vectors are dealt into
shards by a hash; a task holds the vantage-point tree of one shard and lets the queries stream by. Each query first descends to the leaf
nearest to it; then the tree is walked once for all queries of a block. A child is skipped when `factor` times the lower bound of its distances exceeds the
distance of the k-th found: factor 1 is exact, larger factors skip more. A query's best of all shards are merged by a window whose
group limit works before the shuffle. Each vector is shuffled once, each query once for each shard.

Among ties the smallest ids win: all vectors within rounding of the k-th product are kept until their exact products, summed in the order
of the components, decide. Of equal vectors only the k + 1 with the smallest ids can be in a result (a query may leave itself out), so
others need no search: hot vectors cost no more than rare ones, and nothing is lost.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows with a null id; vectors
of different dimensions are no candidates for each other; rows that repeat an id are rows each, as queries and as candidates; with fewer candidates
than k all are returned; an empty table gives an empty result; other columns are left out. Memory: a task holds one shard, one batch of
queries and a bounded list of candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import cut

RESULT = "query long, query_id long, row long, vec_id long, score double"
#: Rows of a shard at least and at most; between them a shard is a fourth of a core's share.
SHARD = 25_000, 250_000
#: Queries that walk a tree together, and candidates held before the exact products thin them out.
BLOCK, HELD = 512, 2_000_000


class VpTree:
    """points: n x d, of any length. Nodes keep the range of distances to the vantage point on either side.

    A node is (leaf number, places) or (vantage, near range, near child, far range, far child).
    """

    def __init__(self, points: np.ndarray, leaf: int = 128, seed: int = 0):
        n, d = points.shape
        self.original, self.leaf, self.leaves = points, leaf, 0
        self.scale = (float(np.abs(points).max()) if n else 0.0) or 1.0
        scaled = points / self.scale
        self.centre = scaled.mean(0) if n else np.zeros(d)
        centred = scaled - self.centre
        squares = (centred**2).sum(1)
        self.length = float(np.sqrt(squares.max())) if n else 0.0
        self.points = np.hstack([centred, np.sqrt(np.maximum(self.length**2 - squares, 0))[:, None]])
        #: Bounds of rounding, in products and in distances.
        self.product_slack = 8 * (d + 16) * np.finfo(float).eps * self.length * (self.length + float(np.sqrt((self.centre**2).sum())) + np.sqrt(d))
        self.distance_slack = 4 * np.sqrt(self.product_slack)
        self.rng = np.random.default_rng(seed)
        self.root = self._build(np.arange(n))

    def _build(self, idx: np.ndarray):
        if len(idx) <= self.leaf:
            self.leaves += 1
            return self.leaves - 1, idx
        # Of some drawn points the vantage is that whose distances to some others spread most.
        drawn, others = (self.points[self.rng.choice(idx, min(n, len(idx)), replace=False)] for n in (24, 256))
        spread = (((drawn[:, None] - others[None]) ** 2).sum(2) ** 0.5).std(1)
        vantage = int(idx[((self.points[idx] - drawn[spread.argmax()]) ** 2).sum(1).argmin()])
        d = np.sqrt(((self.points[idx] - self.points[vantage]) ** 2).sum(1))
        order = np.argsort(d, kind="stable")
        idx, d, half = idx[order], d[order], len(idx) // 2
        return vantage, (d[0], d[half - 1]), self._build(idx[:half]), (d[half], d[-1]), self._build(idx[half:])

    def exact(self, queries: np.ndarray, rows: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Products of original vectors, summed in the order of the components, so that equal vectors score equally wherever they stand."""
        s = np.zeros(len(rows))
        for j in range(queries.shape[1]):
            s += self.original[places, j] * queries[rows, j]
        return s

    def search(self, queries: np.ndarray, k: int, factor: float = 1.0, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query, place, exact product) of each query's k best, best first, ties to smaller places; and how many products the tree made.

        own: the place of each query itself, -1 if it has none.
        """
        n = len(queries)
        empty = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if not n or not len(self.points) or not k:
            return *empty, 0
        size = np.abs(queries).max(1)
        unit = queries / np.where(size > 0, size, 1)[:, None]
        norm = np.sqrt((unit**2).sum(1))
        q = np.hstack([unit * (self.length / np.where(norm > 0, norm, 1))[:, None], np.zeros((n, 1))])
        best, kth = np.full((n, k), -np.inf), np.full(n, -np.inf)
        home = np.full(n, -1)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        made = held = 0

        def thinned() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            rows, places, s = (np.concatenate(x) for x in zip(*found, strict=True)) if found else empty
            close = s >= kth[rows] - self.product_slack
            rows, places, s = rows[close], places[close], s[close]
            e = self.exact(queries, rows, places)
            order = np.lexsort((places, -e, rows))
            nth = np.arange(len(order)) - np.searchsorted(rows[order], rows[order])
            order = order[nth < k]
            return rows[order], places[order], s[order]

        def scan(rows: np.ndarray, places: np.ndarray) -> None:
            nonlocal made, held, found
            step = max(1, HELD // len(places))
            for lo in range(0, len(rows), step):
                some = rows[lo : lo + step]
                s = q[some] @ self.points[places].T
                made += s.size
                if own is not None:
                    s[own[some][:, None] == places[None, :]] = -np.inf
                best[some] = np.partition(np.hstack([best[some], s]), -k, axis=1)[:, -k:]
                kth[some] = best[some].min(1)
                x, y = np.nonzero((s >= kth[some][:, None] - self.product_slack) & (s > -np.inf))
                found.append((some[x], places[y], s[x, y]))
                held += len(x)
                if held > HELD:
                    found = [thinned()]
                    held = len(found[0][0])

        def distance(rows: np.ndarray, vantage: int) -> np.ndarray:
            nonlocal made
            made += len(rows)
            return np.sqrt(np.maximum(2 * self.length**2 - 2 * (q[rows] @ self.points[vantage]), 0))

        def descend(node, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if len(node) == 2:
                home[rows] = node[0]
                scan(rows, node[1])
                return
            vantage, near, left, far, right = node
            first = distance(rows, vantage) <= (near[1] + far[0]) / 2
            descend(left, rows[first])
            descend(right, rows[~first])

        def walk(node, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if len(node) == 2:
                rows = rows[home[rows] != node[0]]
                if len(rows):
                    scan(rows, node[1])
                return
            vantage, near, left, far, right = node
            d = distance(rows, vantage)
            for (low, high), child in ((near, left), (far, right)):
                bound = np.maximum(np.maximum(low - d, d - high) - self.distance_slack, 0)
                reach = np.sqrt(np.maximum(2 * self.length**2 - 2 * (kth[rows] - self.product_slack), 0))
                open_ = factor * bound <= reach
                walk(child, rows[open_])

        descend(self.root, np.arange(n))
        walk(self.root, np.arange(n))
        rows, places, _ = thinned()
        return rows, places, self.exact(queries, rows, places), made


def search_stream(batches: Iterator[pa.RecordBatch], k: int, factor: float, leaf: int) -> Iterator[pa.RecordBatch]:
    """Rows of RESULT from rows (dim, shard, side, vec_id, row, vector) sorted in this order: of each shard its points (side 0), then its queries (side 1)."""
    key, points, tree, ids, rows, by_row = None, [], None, None, None, None
    for batch in filter(len, batches):
        dims, shards, sides, vec_ids, row_ids = (np.asarray(batch.column(i)) for i in range(5))
        changes = np.flatnonzero((np.diff(dims) != 0) | (np.diff(shards) != 0) | (np.diff(sides) != 0)) + 1
        for lo, hi in zip([0, *changes.tolist()], [*changes.tolist(), len(dims)], strict=True):
            now, d = (dims[lo], shards[lo]), int(dims[lo])
            if now != key:
                key, points, tree = now, [], None
            x = np.asarray(batch.column(5).slice(lo, hi - lo).flatten(), dtype=np.float64).reshape(-1, d)
            if sides[lo] == 0:
                points.append((vec_ids[lo:hi], row_ids[lo:hi], x))
                continue
            if not points:
                continue
            if tree is None:
                ids, rows, vectors = (np.concatenate(c) for c in zip(*points, strict=True))
                by_row, points = np.argsort(rows, kind="stable"), [()]
                tree = VpTree(vectors, leaf)
            for at in range(lo, hi, BLOCK):
                block = slice(at, min(hi, at + BLOCK))
                mine = row_ids[block]
                place = by_row[np.minimum(np.searchsorted(rows, mine, sorter=by_row), len(rows) - 1)]
                own = np.where(rows[place] == mine, place, -1)
                of, places, scores, _ = tree.search(x[at - lo : block.stop - lo], k, factor, own)
                cols = mine[of], vec_ids[block][of], rows[places], ids[places], scores
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query", "query_id", "row", "vec_id", "score"])


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the rows that take part."""
    v = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & v.isNotNull())
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.where(~F.exists(v, bad) & F.exists(v, lambda x: x != 0))


def nearest(vectors: DataFrame, is_query, k: int = 20, factor: float = 1.0, shard_rows: int | None = None, leaf: int = 128, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest of each row for which the condition is_query over vec_id holds."""
    spark = vectors.sparkSession
    # Row numbers are fixed by writing them.
    rows = cut(usable(vectors, id_col, vec_col).withColumn("row", F.monotonically_increasing_id()), "vectors")
    same = Window.partitionBy("vector").orderBy("vec_id", "row")
    points = rows.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1).drop("nth")
    n = rows.count()
    shard_rows = shard_rows or min(max(n // (4 * spark.sparkContext.defaultParallelism), SHARD[0]), SHARD[1])
    shards = max(1, -(-n // shard_rows))
    left = points.withColumns({"dim": F.size("vector"), "side": F.lit(0), "shard": F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")})
    right = rows.where(is_query).withColumns({"dim": F.size("vector"), "side": F.lit(1), "shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))})
    cols = ["dim", "shard", "side", "vec_id", "row", "vector"]
    dealt = left.select(cols).union(right.select(cols)).repartition(4 * shards, "dim", "shard").sortWithinPartitions(*cols[:5])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return search_stream(batches, k, factor, leaf)

    by_query = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    found = dealt.mapInArrow(run, RESULT).withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


def oracle(k: int = 20, every: int = 20) -> str:
    return f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
u AS (SELECT * FROM v WHERE len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS score FROM u q JOIN u c ON q.vec_id <> c.vec_id AND q.vec_id % {every} = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= {k}"""
