"""Byte-level BPE by a pair occurrence index.

A partition's batch of texts is cut into pretokens; those not met before by this worker are laid out in one linked list of symbols.
An index maps each adjacent pair to all its positions. Active ranks are taken in ascending order from a heap; each merge touches
just the listed positions and adds the two new neighbours to the lists of their pairs.

Defined results: a null text is the empty text and has no ids; repeated rows are encoded each; an empty table gives an empty
result; a long text or a long pretoken is encoded whole (the index costs n log n); other columns, whatever their names, are left out.
"""

from __future__ import annotations

import heapq
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import begin, whole_text

#: Fixed value: the pattern of the byte-level pretokenizer.
PRETOKENS = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: What a model may not have.
OPTIONS = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
#: A worker forgets its chunks beyond so many; speed only.
CACHE = 150_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes for themselves, the others for the next letters from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def _sorted_once(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) > 1 else x


class PairIndexBPE:
    """Encoder and decoder for one tokenizer file (the JSON text of the tokenizers library)."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        form = spec.get("pre_tokenizer") or {}
        plain = not any(spec["model"].get(k) for k in OPTIONS) and not any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if spec.get("normalizer") or form.get("type") != "ByteLevel" or form.get("add_prefix_space") or not form.get("use_regex", True) or not plain:
            raise ValueError("only plain byte-level BPE is encoded: no normalizer, no prefix space, the pattern of the library, no options of the model")
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        self.byte_id = [vocab[x] for x in letters]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.merge_of = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        self.new_of = [x[2] for x in self.merge_of]
        rank = {a << 32 | b: r for r, (a, b, _) in reversed([*enumerate(self.merge_of)])}
        self.pair_keys = np.array(sorted(rank), np.int64)
        self.pair_ranks = np.array([rank[x] for x in self.pair_keys.tolist()], np.int64)
        of_letter = {x: b for b, x in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(of_letter[x] for x in token) if all(x in of_letter for x in token) else token.encode()
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.mark = "\udcff"  # never in a text: sets a special token apart from the same letters
        self._forget()

    def _forget(self) -> None:
        """Ids are kept as bytes of little-endian int32."""
        self.pretoken_ids = {self.mark + t: struct.pack("<i", i) for t, i in self.special.items()}
        self.chunk_ids: dict[str, bytes] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs; one beyond the last for pairs that never merge."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], len(self.new_of))

    def merge_all(self, pretokens: list[bytes]) -> list[bytes]:
        """The ids of each pretoken. One index covers all of them; a -1 between two pretokens keeps them apart."""
        none = len(self.new_of)
        if not pretokens or not none:
            return [np.array([self.byte_id[b] for b in p], "<i4").tobytes() for p in pretokens]
        sizes = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
        ends = np.cumsum(sizes + 1)
        sym = np.full(ends[-1], -1, np.int64)
        inside = np.ones(ends[-1], bool)
        inside[ends - 1] = False
        sym[inside] = np.array(self.byte_id)[np.frombuffer(b"".join(pretokens), np.uint8)]
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        places: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(positions: np.ndarray) -> None:
            """Adds positions to the lists of the pairs that begin there now."""
            ranks = self._ranks(sym[positions], sym[after[positions]])
            if len(positions) < 3:
                groups = [(r, positions[i : i + 1]) for i, r in enumerate(ranks.tolist()) if r < none]
            else:
                order = np.argsort(ranks, kind="stable")
                ranks, positions = ranks[order], positions[order]
                cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
                groups = [(int(ranks[i]), positions[i:j]) for i, j in zip(cuts, cuts[1:], strict=False) if ranks[i] < none]
            for r, at in groups:
                if r in places:
                    places[r].append(at)
                else:
                    places[r] = [at]
                    heapq.heappush(active, r)

        note(np.flatnonzero(inside))
        while active:
            r = heapq.heappop(active)
            lists = places.pop(r)
            i = lists[0] if len(lists) == 1 else np.concatenate(lists)
            a, b, new = self.merge_of[r]
            i = i[sym[i] == a]
            i = i[sym[after[i]] == b]
            if a == b and len(i) > 1:  # of overlapping places the left one goes first
                taken, last = [], -1
                for x in _sorted_once(i).tolist():
                    if x != last:
                        taken.append(x)
                        last = int(after[x])
                i = np.array(taken)
            elif len(lists) > 1:
                i = _sorted_once(i)
            if not len(i):
                continue
            j = after[i]
            k = after[j]
            sym[i], sym[j] = new, -2
            after[i], before[k] = k, i
            h = before[i]
            h = h[h >= 0]
            note(_sorted_once(np.concatenate((i, h[sym[h] >= 0]))))
        live = sym != -2
        kept, split = sym[live], np.cumsum(live)[ends - 1] - 1
        ids, out, start = kept.astype("<i4").tobytes(), [], 0
        for end in (split * 4).tolist():
            out.append(ids[start:end])
            start = end + 4
        return out

    def learn(self, chunks: set[str]) -> None:
        """Fills the cache with chunks: pieces of text between pretoken boundaries."""
        known = self.pretoken_ids
        parts = {}
        for c in chunks:
            if self.at_special and "<" in c and self.at_special.search(c):
                parts[c] = [p for i, x in enumerate(self.at_special.split(c)) for p in ([self.mark + x] if i % 2 else PRETOKENS.findall(x))]
            else:
                parts[c] = PRETOKENS.findall(c)
        fresh = [*{p for ps in parts.values() for p in ps if p not in known}]
        known.update(zip(fresh, self.merge_all([p.encode() for p in fresh]), strict=True))
        for c, ps in parts.items():
            self.chunk_ids[c] = known[ps[0]] if len(ps) == 1 else b"".join(map(known.__getitem__, ps))

    def chunks(self, text: str) -> list[str]:
        """Cuts before each space that follows a non-space and precedes one; a pretoken always begins there."""
        if "  " in text:
            return regex.split(r"(?<=\S)(?= \S)", text)
        first, *rest = text.split(" ")
        return [first, *(" " + x for x in rest)] if first or not rest else [" " + x for x in rest]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.chunk_ids) > CACHE:
            self._forget()
        pieces = [self.chunks(t) if t else [] for t in texts]
        known = self.chunk_ids
        self.learn({c for p in pieces for c in p if c not in known})
        return [np.frombuffer(b"".join(map(known.__getitem__, p)), "<i4") for p in pieces]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_MADE: dict[int, PairIndexBPE] = {}


def encoder(content: bytes) -> PairIndexBPE:
    """One encoder for each file and Python worker."""
    key = zlib.crc32(content)
    if key not in _MADE:
        _MADE[key] = PairIndexBPE(content)
    return _MADE[key]


def _slices(texts: pa.Array, most: int = 5 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch with about so many bytes of text each."""
    sizes = pa.compute.binary_length(texts).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + (n or 0) > most:
            yield start, i
            start, total = i, 0
        total += n or 0
    if sizes:
        yield start, len(sizes)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """Rows (id_col, ids array<int>[, decoded string]), one for each row of docs. path: a byte-level BPE file that the driver reads."""
    with open(path, "rb") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        begin("bpe", _MADE.clear)
        own = encoder(content.value)
        for batch in batches:
            for lo, hi in _slices(batch.column(1)):
                ids = own.encode_batch(batch.column(1).slice(lo, hi - lo).to_pylist())
                offsets = np.cumsum([0, *map(len, ids)])
                values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                cols = [batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))]
                if decode:
                    cols.append(pa.array([own.decode(x.tolist()) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "ids", "decoded"][: 2 + decode]
    out = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>" + ", decoded string" * decode)
    return out.withColumnRenamed("id", id_col)


def digest(encoded: DataFrame) -> DataFrame:
    """n_tokens and the SHA-256 digests of the decimal ids and of the decoded text."""
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
