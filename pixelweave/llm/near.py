"""Near-duplicates by MinHash with tensored banding.

Instead of a band of its own for each table, a table's key joins one of SIDE left bands with one of SIDE right bands: SIDE ** 2 tables
from 2 * SIDE * WIDTH minhashes. Texts of equal sets are one class from the start, so nodes are classes.

1. In each table's bucket the members are paired with two members only: one that shares most bands with others, where a
   group's original is found, and one drawn by a hash. Pairs of similar sketch are confirmed on full sets. That is linear in bucket entries
   and joins most.
2. Buckets that still hold more than one component are settled whole. In those of at most HOT members all sketches are compared, and
   what comes near to the similarity is confirmed. Members of larger ones are gathered by their left band, with their full sets: all outside
   the largest component are compared with all members, block by block, and only links leave the task.

So for every pair of a bucket, the ends are in one component, or their sketches or sets were compared. A pair of Jaccard
similarity 0.8 shares a table with probability 0.997. Sets are compared as sorted 64-bit hashes of shingles, classes by a 128-bit
digest of these.

Defined results: null and empty texts, and texts without words, have the empty set and are linked with nothing; a text of fewer
words than a shingle is one shingle; rows with a null doc_id are linked with nothing, have a null component and are kept; rows that
share a doc_id are rows each, linked by their own texts; very long texts are taken whole; an empty table gives an empty result; other
columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import cut, release, remove, whole_text
from ._words import begin_words, mix, shingle_set

SIDE, WIDTH = 10, 3
HASHES = 2 * SIDE * WIDTH
#: Pairs whose share of equal minhashes falls so far below the threshold are not confirmed: over four standard deviations of the estimate.
SLACK = 0.22
#: Orders by which buckets choose.
TURNS = 4
#: Members of a bucket whose sketches are all compared in one go, at most. Members of a block of a larger one, on average.
HOT, BLOCK = 64, 512
#: Shingles whose occurrences in two blocks are multiplied at a time.
COLUMNS = 4096
#: Classes that hold at least one of so many rows are joined by broadcast: there are no more than that of them.
MOST_HOT = 1000
_SEEDS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """The minhashes of non-empty sets, one row each, as int32."""
    every = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), HASHES), np.int32)
    for k, seed in enumerate(_SEEDS):
        x = (every ^ seed) * np.uint64(0x9FB21C651E98DF25)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        out[:, k] = (np.minimum.reduceat(x, starts) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def keyed_text() -> list:
    """What identifies a row's text: its doc_id, and a hash that sets apart rows that share one."""
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("th")]


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, th, n_shingles, digest, sketch) of each row; digest and sketch are null for the empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        begin_words()
        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                sets, total, hi = [], 0, lo
                while hi < batch.num_rows and total < 200_000:
                    sets.append(shingle_set(batch.column(2)[hi].as_py(), size))
                    total += len(sets[-1])
                    hi += 1
                full = [i for i, s in enumerate(sets) if len(s)]
                digests: list[bytes | None] = [None] * len(sets)
                rows: list[np.ndarray | None] = [None] * len(sets)
                if full:
                    for i, row in zip(full, sketch([sets[i] for i in full]), strict=True):
                        digests[i], rows[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), row
                known = [c.slice(lo, hi - lo) for c in batch.columns[:2]]
                made = [pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(rows, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*known, *made], names=["doc_id", "th", "n_shingles", "digest", "sketch"])
                lo = hi

    return docs.select(*keyed_text(), whole_text().alias("text")).mapInArrow(run, "doc_id long, th long, n_shingles long, digest binary, sketch array<int>")


def bands(side: int) -> list:
    """The band keys of one side, from a sketch column."""
    return [F.xxhash64(F.lit(side * SIDE + i), *[F.get("sketch", F.lit((side * SIDE + i) * WIDTH + k)) for k in range(WIDTH)]) for i in range(SIDE)]


def entries(reps: DataFrame) -> DataFrame:
    """(key, left, id, pop, copies): the table keys of each class that shares a left and a right band with some other, with their left bands; pop: how many entries its bands have."""
    sided = reps.select("id", F.posexplode(F.array(*bands(0), *bands(1))).alias("at", "band"))
    shared = sided.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    pop = sided.join(shared, "band").groupBy("id").agg(F.sum("n").alias("pop"), F.min("at").alias("first"), F.max("at").alias("last"))
    pop = pop.where((F.col("first") < SIDE) & (F.col("last") >= SIDE)).select("id", "pop")
    left, right = ([F.col(f"{c}{i}") for i in range(SIDE)] for c in "lr")
    split = reps.select("id", "copies", *[b.alias(f"l{i}") for i, b in enumerate(bands(0))], *[b.alias(f"r{i}") for i, b in enumerate(bands(1))]).join(pop, "id")
    tables = F.array(*[F.struct(F.xxhash64(a, b).alias("key"), a.alias("left")) for a in left for b in right])
    return split.select("id", "pop", "copies", F.explode(tables).alias("t")).select("t.key", "t.left", "id", "pop", "copies")


def shingle_sets(docs: DataFrame, need: DataFrame, size: int) -> DataFrame:
    """(id, s): the sorted 64-bit shingle hashes of the texts that need (id, doc_id, th) names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Equal rows mostly meet in one task; the few that don't only make equal pairs.
        seen: set[int] = set()
        begin_words()
        for batch in batches:
            ids, sets, held = [], [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if i not in seen:
                    seen.add(i)
                    ids.append(i)
                    sets.append(shingle_set(text.as_py(), size).tobytes())
                    held += len(sets[-1])
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["id", "s"])
                    ids, sets, held = [], [], 0
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["id", "s"])

    texts = docs.where("doc_id IS NOT NULL").select(*keyed_text(), whole_text().alias("text")).join(need, ["doc_id", "th"]).select("id", "text")
    return texts.mapInArrow(run, "id long, s binary")


def candidates(keyed: DataFrame, seed: int) -> DataFrame:
    """Distinct (id, pivot) pairs: each entry with its bucket's two chosen members."""
    # Most popular is the text that shares most bands, with more or less noise, or that has most exact copies.
    # The choice goes by one of TURNS orders of all documents, so a large group's tables share a few members, who all have their turn.
    turn = F.pmod(F.col("key"), F.lit(TURNS))
    noise = F.pmod(F.xxhash64(F.lit(~seed), "id", turn), F.lit(256))
    by_pop = F.col("pop") * (1024 + F.when(turn == 0, F.shiftright(noise, 4)).when(turn == 1, F.shiftright(noise, 1)).otherwise(noise))
    popular = F.max_by("id", F.when(turn == 2, F.shiftleft(F.col("copies"), 32) + F.col("pop")).otherwise(by_pop))
    drawn = F.min_by("id", F.xxhash64(F.lit(seed), "id", turn))
    chosen = keyed.groupBy("key").agg(F.count("*").alias("n"), popular.alias("p"), drawn.alias("q")).where("n > 1").drop("n")
    pairs = keyed.select("key", "id").join(chosen, "key").select("id", F.explode(F.array_distinct(F.array("p", "q"))).alias("pivot")).where("id <> pivot")
    return pairs.distinct()


def likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Distinct (id, pivot), id having the smaller set: pairs whose sizes allow the similarity and whose sketches come near to it."""
    a = reps.select("id", F.col("sketch").alias("sa"), F.col("n_shingles").alias("na"))
    b = reps.select(F.col("id").alias("pivot"), F.col("sketch").alias("sb"), F.col("n_shingles").alias("nb"))
    same = sum((F.when(F.get("sa", F.lit(k)) == F.get("sb", F.lit(k)), 1).otherwise(0) for k in range(HASHES)), F.lit(0))
    near = pairs.join(a, "id").join(b, "pivot").where((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (same >= int(HASHES * (percent / 100 - SLACK))))
    turned = (F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("id") > F.col("pivot")))
    return near.select(F.when(turned, F.col("pivot")).otherwise(F.col("id")).alias("id"), F.when(turned, F.col("id")).otherwise(F.col("pivot")).alias("pivot")).distinct()


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (u, v) of pairs (id, pivot) whose full sets have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    a, b = sets.select("id", F.col("s").alias("sa")), sets.select(F.col("id").alias("pivot"), F.col("s").alias("sb"))
    both = pairs.join(a, "id").join(b, "pivot").select(F.least("id", "pivot").alias("u"), F.greatest("id", "pivot").alias("v"), "sa", "sb")
    return both.mapInArrow(run, "u long, v long")


def unsettled(keyed: DataFrame, links: DataFrame) -> DataFrame:
    """(key, left, id, c, n): the entries of buckets of n > 2 members, in more than one component; c: the entry's component. Of two members the pair was compared."""
    c = links.select(F.col("v").alias("id"), F.col("u").alias("c"))
    at = keyed.select("key", "left", "id").join(c, "id", "left").select("key", "left", "id", F.coalesce("c", "id").alias("c"))
    several = at.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n")).where("low <> high AND n > 2").select("key", "n")
    return at.join(several, "key").select("key", "left", "id", "c", "n")


def small_buckets(opened: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Distinct (id, pivot), id having the smaller set: the pairs of entries of a bucket, in different components, whose sizes and sketches allow the similarity.

    The sketches compared have one byte of each minhash, which can only add pairs.
    """
    low = int(HASHES * (percent / 100 - SLACK))
    short = F.transform("sketch", lambda x: (x.bitwiseAND(F.lit(255)) - 128).cast("tinyint"))
    entry = opened.select("key", "id", "c").join(reps.select("id", short.alias("sketch"), "n_shingles"), "id")

    def compared(ids: np.ndarray, c: np.ndarray, n: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        small, large = np.minimum(n[:, None], n[None]), np.maximum(n[:, None], n[None])
        x, y = np.nonzero((c[:, None] != c[None]) & (ids[:, None] < ids[None]) & (100 * small >= percent * large))
        near = (s[x] == s[y]).sum(1) >= low
        x, y = x[near], y[near]
        turned = n[x] > n[y]
        return ids[np.where(turned, y, x)], ids[np.where(turned, x, y)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in (*batches, None):
            if batch is not None and not batch.num_rows:
                continue
            if batch is None and rest is None:
                return
            table = pa.Table.from_batches([x for x in (rest, batch) if x is not None]).combine_chunks()
            key, ids, c, n = (table.column(i).to_numpy() for i in range(4))
            s = np.asarray(table.column(4).combine_chunks().flatten()).reshape(len(key), -1)
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            # The last bucket may go on in the next batch.
            ends = [*cuts.tolist(), *([len(key)] if batch is None else [])]
            pairs = [compared(ids[i:j], c[i:j], n[i:j], s[i:j]) for i, j in zip([0, *ends], ends, strict=False)]
            if batch is not None:
                rest = table.slice(ends[-1] if ends else 0).combine_chunks().to_batches()[0]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*pairs, strict=True)], names=["id", "pivot"])

    dealt = entry.select("key", "id", "c", "n_shingles", "sketch").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "id long, pivot long").distinct()


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of each set of a with each of b: products of 0-1 matrices over the shingles that stand in both blocks, COLUMNS at a time."""
    values, place = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    row = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    mine = np.bincount(place[row < len(a)], minlength=len(values)) > 0
    theirs = np.bincount(place[row >= len(a)], minlength=len(values)) > 0
    shared = mine & theirs
    number = np.cumsum(shared) - 1
    taken = shared[place]
    row, place = row[taken], number[place[taken]]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    out = np.zeros((len(a), len(b)), np.float32)
    for lo in range(0, int(shared.sum()), COLUMNS):
        i, j = np.searchsorted(place, (lo, lo + COLUMNS))
        m = np.zeros((len(a) + len(b), COLUMNS), np.float32)
        m[row[i:j], place[i:j] - lo] = 1
        out += m[: len(a)] @ m[len(a) :].T
    return out


def large_buckets(opened: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links (u, v) between members of a left band, in different components, by full sets; found in blocks of those outside the band's largest component and of all."""
    member = opened.groupBy("left", "id").agg(F.min("c").alias("c"))
    held = member.groupBy("left", "c").agg(F.count("*").alias("n")).groupBy("left").agg(F.max_by("c", F.struct("n", "c")).alias("big"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("m")).where("m > 0")
    entry = member.join(held, "left")
    count = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    deal = lambda seed, c: F.pmod(F.xxhash64(F.lit(seed), "id"), count(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), count(c) - 1))
    cols = ["left", "o", "e", "side", "id", "c", "big"]
    outside = entry.where("c <> big").withColumns({"o": deal(1, "m"), "side": F.lit(0)}).withColumn("e", every("n")).select(cols)
    members = entry.withColumns({"e": deal(2, "n"), "side": F.lit(1)}).withColumn("o", every("m")).select(cols)

    def compared(side: list[list]) -> tuple[np.ndarray, np.ndarray]:
        if not side[0] or not side[1]:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        (a, ca, _, sa), (b, cb, big, sb) = (list(zip(*rows, strict=True)) for rows in side)
        na, nb = (np.array([len(x) for x in s]) for s in (sa, sb))
        a, ca, b, cb, big = map(np.array, (a, ca, b, cb, big))
        both = overlaps(sa, sb).astype(np.int64)
        # Two members outside the largest component meet twice.
        ok = (ca[:, None] != cb[None]) & ((cb == big)[None] | (a[:, None] < b[None])) & (100 * both >= percent * (na[:, None] + nb[None] - both))
        x, y = np.nonzero(ok)
        return np.minimum(a[x], b[y]), np.maximum(a[x], b[y])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, side = None, [[], []]
        for batch in (*batches, None):
            out = []
            if batch is None:
                out.append(compared(side))
            else:
                for *now, s, i, c, big, raw in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                    if now != key:
                        out.append(compared(side))
                        key, side = now, [[], []]
                    side[s].append((i, c, big, np.frombuffer(raw, np.uint64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["u", "v"])

    dealt = outside.union(members).join(sets, "id").select(*cols, "s").repartition("left", "o", "e").sortWithinPartitions("left", "o", "e", "side")
    return dealt.mapInArrow(run, "u long, v long")


def stars(edges: DataFrame, name: str = "stars") -> DataFrame:
    """Connected components of edges (u, v) as rows (v, u): each node that isn't the smallest of its component, and that smallest.

    Alternates large stars and small stars. Each is a partial minimum and a join whose hot keys adaptive execution splits; each pair of steps is a table in the shared folder.
    """
    now = cut(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), name)
    state = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select("v", "m")
        smaller = large.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v").distinct()
        least = smaller.groupBy("u").agg(F.min("v").alias("m"))
        small = smaller.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select("e.v", "e.m")
        after = cut(small.where("v <> m").select(F.col("m").alias("u"), "v").distinct(), name)
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        remove(now)
        now = after
        if mark == state:
            return now
        state = mark


def _joined(links: DataFrame, found: DataFrame) -> DataFrame:
    """Components after more links: only the components that these join are worked on."""
    c = links.select(F.col("v").alias("n"), F.col("u").alias("c"))
    ends = found.join(c.withColumnsRenamed({"n": "u", "c": "cu"}), "u", "left").join(c.withColumnsRenamed({"n": "v", "c": "cv"}), "v", "left")
    over = stars(ends.select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")))
    moved = links.join(over.select(F.col("v").alias("u"), F.col("u").alias("to")), "u", "left").select(F.coalesce("to", "u").alias("u"), "v")
    after = cut(moved.union(over.select("u", "v")), "stars")
    for x in (links, found, over):
        remove(x)
    release(after.sparkSession)
    return after


def classified(docs: DataFrame, size: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows has (doc_id, th, n_shingles, digest, row); classes (digest, row, doc_id, th, copies, component_id, first): its first row
    and number of rows, the component's smallest doc_id, and whether the class is the one of its component that holds it (of several that with the first row)."""
    # Row numbers are fixed by writing them.
    base = cut(sketches(docs, size).withColumn("row", F.monotonically_increasing_id()), "sketches")
    full = base.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    classes = full.groupBy("digest").agg(F.min(F.struct("doc_id", "row", "th")).alias("r"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    reps = cut(classes.select("digest", F.col("r.row").alias("id"), "r.doc_id", "r.th", "copies", "n_shingles", "sketch"), "classes")
    keyed = cut(entries(reps), "entries")
    sets = cut(shingle_sets(docs, reps.select("id", "doc_id", "th").join(keyed.select("id").distinct(), "id"), size), "sets")
    tried = cut(likely(candidates(keyed, 0), reps, percent), "tried")
    links = stars(confirm(tried, sets, percent))
    opened = cut(unsettled(keyed, links), "opened")
    remove(keyed)
    release(docs.sparkSession)
    # Sizes and sketches have been compared there, and full sets need not be compared twice.
    few = confirm(small_buckets(opened.where(F.col("n") <= HOT), reps, percent).join(tried, ["id", "pivot"], "left_anti"), sets, percent)
    many = large_buckets(opened.where(F.col("n") > HOT), sets, percent)
    links = _joined(links, cut(few.union(many), "links"))
    remove(tried)
    remove(opened)
    remove(sets)
    # The component's name is its smallest doc_id.
    nodes = links.select(F.col("v").alias("id"), F.col("u").alias("c")).union(links.select(F.col("u").alias("id"), F.col("u").alias("c")).distinct())
    named = nodes.join(reps.select("id", "doc_id"), "id")
    least = named.groupBy("c").agg(F.min(F.struct("doc_id", "id")).alias("least"))
    named = named.join(least, "c").select("id", F.col("least.doc_id").alias("component_id"), (F.col("id") == F.col("least.id")).alias("first"))
    found = reps.drop("sketch", "n_shingles").join(named, "id", "left")
    found = found.select("digest", F.col("id").alias("row"), "doc_id", "th", "copies", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("first", F.lit(True)).alias("first"))
    return base.drop("sketch"), cut(found, "found")


def with_class(base: DataFrame, classes: DataFrame, *cols: str) -> DataFrame:
    """Rows with a doc_id and a set, with columns of their classes. Classes of many copies are few and joined by broadcast."""
    rows = base.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    n = classes.agg(F.sum("copies")).first()[0] or 0
    hot = F.col("copies") * MOST_HOT >= max(n, 1)
    wanted = lambda f: F.broadcast(classes.where(hot & (F.col("copies") > 1)).select("digest", *cols)) if f else classes.where(~(hot & (F.col("copies") > 1))).select("digest", *cols)
    return rows.join(wanted(True), "digest").unionByName(rows.join(wanted(True), "digest", "left_anti").join(wanted(False), "digest"))


def components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row."""
    base, classes = classified(docs, size, percent)
    out = with_class(base, classes, "component_id").select("doc_id", "n_shingles", "component_id")
    out = out.union(base.where("doc_id IS NULL OR digest IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component. Rows with a null doc_id, and rows without words, all stay.

    Of rows equal in doc_id and text, and so of one class, that with the smallest hash of all its columns stays.
    """
    base, classes = classified(docs, size, percent)
    empty = base.where("doc_id IS NOT NULL AND digest IS NULL").select("doc_id", "th", F.lit(True).alias("every")).distinct()
    keys = classes.where("first").select("doc_id", "th", F.lit(False).alias("every")).union(empty)
    keys = keys.select(F.col("doc_id").alias("key id"), F.col("th").alias("key th"), F.col("every").alias("key every"))
    own = docs.withColumns({"own id": F.col("doc_id").cast("long"), "own th": F.xxhash64(whole_text())})
    joined = own.join(keys, (F.col("own id") == F.col("key id")) & (F.col("own th") == F.col("key th")))
    order = Window.partitionBy("own id", "own th").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    kept = joined.withColumn("own nth", F.row_number().over(order)).where("`key every` OR `own nth` = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
    return kept.unionByName(docs.where("doc_id IS NULL"))
