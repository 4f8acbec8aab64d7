"""Token ids in files of byte or bit planes.

A file holds documents of one partition in ascending order, and about `most_ids` ids. Its ids are cut into blocks of a fixed number of ids; each block
is transposed into four byte planes or 32 bit planes, each plane compressed alone with zstandard, which adds a checksum. Layout, all little-endian:

    "PWID" | version u32 | planes in a block u32 | ids in a block u32
    planes, one after the other
    index: for each block its number of ids u32, then for each plane its offset u64 and length u32
    documents: for each its id i64 and its number of ids u64
    number of blocks u64 | number of documents u64 | offset of the index u64 | crc32 of index and documents u32 | "PWIX"

Defined results: a null text is empty and holds the end id alone; documents with equal ids keep an order by text; a null doc_id
raises, as the order is by doc_id; rows that repeat a doc_id are documents each, in the order of their texts; a very long text is held in memory
whole, with its ids; an empty table gives no files and no rows; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import begin, files_at, fresh_dir, whole_text
from .bpe import byte_letters

HEAD, TAIL = struct.Struct("<4sIII"), struct.Struct("<QQQI4s")
#: A worker forgets its words beyond so many; speed only.
CACHE = 800_000
_MADE: dict[int, WordIds] = {}
#: The pretokens of the word tokenizer; normalizer and pretokenizer as its file has them.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
FORM = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
]
PRETOKENS = regex.compile(PATTERN)
HIGH = re.compile("[\u02b0-\U0010ffff]")
LETTERS = dict(enumerate(byte_letters()))


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """ids (uint32) as 4 byte planes, lowest first, or 32 bit planes."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [raw[:, k].tobytes() for k in range(4)]
    return [np.packbits(raw[:, k // 8] >> (k % 8) & 1).tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    raw = np.zeros((n, 4), np.uint8)
    for k, p in enumerate(planes):
        if len(planes) == 4:
            raw[:, k] = np.frombuffer(p, np.uint8)
        else:
            raw[:, k // 8] |= np.unpackbits(np.frombuffer(p, np.uint8), count=n) << (k % 8)
    return raw.reshape(-1).view("<u4")


class IdFileWriter:
    def __init__(self, sink, block: int = 65_536, bits: bool = False, level: int = 3):
        self.sink, self.block, self.bits = sink, block, bits
        self.zip = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.at, self.index, self.docs, self.waiting, self.held = 0, [], [], [], 0
        self._put(HEAD.pack(b"PWID", 1, 32 if bits else 4, block))

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.docs.append(struct.pack("<qQ", doc_id, len(ids)))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            every = np.concatenate(self.waiting)
            whole = len(every) // self.block * self.block
            for i in range(0, whole, self.block):
                self._flush(every[i : i + self.block])
            self.waiting, self.held = [every[whole:].copy()], len(every) - whole

    def _flush(self, ids: np.ndarray) -> None:
        entry = struct.pack("<I", len(ids))
        for p in to_planes(ids, self.bits):
            z = self.zip.compress(p)
            entry += struct.pack("<QI", self.at, len(z))
            self._put(z)
        self.index.append(entry)

    def close(self) -> None:
        if self.held:
            self._flush(np.concatenate(self.waiting))
        start, body = self.at, b"".join(self.index) + b"".join(self.docs)
        self._put(body + TAIL.pack(len(self.index), len(self.docs), start, zlib.crc32(body), b"PWIX"))


class IdFileReader:
    """source: a seekable binary file. Reads one block at a time; blocks can be taken in any order through the index."""

    def __init__(self, source):
        self.source = source
        size = source.seek(0, 2) or source.tell()
        source.seek(0)
        magic, version, self.planes, self.block = HEAD.unpack(source.read(HEAD.size))
        source.seek(size - TAIL.size)
        n_blocks, n_docs, start, crc, end = TAIL.unpack(source.read(TAIL.size))
        if magic != b"PWID" or version != 1 or end != b"PWIX":
            raise ValueError("not an id file")
        source.seek(start)
        body = source.read(size - TAIL.size - start)
        if zlib.crc32(body) != crc:
            raise ValueError("the id file's index is damaged")
        step = 4 + 12 * self.planes
        self.index = [body[i * step : (i + 1) * step] for i in range(n_blocks)]
        self.docs = [struct.unpack_from("<qQ", body, n_blocks * step + 16 * i) for i in range(n_docs)]
        self.unzip = zstandard.ZstdDecompressor()

    def read_block(self, i: int) -> np.ndarray:
        (n,) = struct.unpack_from("<I", self.index[i])
        planes = []
        for k in range(self.planes):
            at, length = struct.unpack_from("<QI", self.index[i], 4 + 12 * k)
            self.source.seek(at)
            planes.append(self.unzip.decompress(self.source.read(length)))
        return from_planes(planes, n)

    def __iter__(self) -> Iterator[tuple[int, np.ndarray]]:
        block, i = np.zeros(0, "<u4"), 0
        for doc_id, n in self.docs:
            parts, need = [], n
            while need:
                if not len(block):
                    block, i = self.read_block(i), i + 1
                parts.append(block[:need])
                block = block[need:]
                need = n - sum(map(len, parts))
            yield doc_id, np.concatenate(parts) if parts else np.zeros(0, "<u4")


def check_form(content: bytes) -> None:
    """Raises for a tokenizer file with other steps before its model than those that encode_words() relies on."""
    spec = json.loads(content)
    if [spec.get("normalizer"), spec.get("pre_tokenizer")] != FORM:
        raise ValueError("this tokenizer normalizes or splits texts in another way than encode_words()")


class WordIds(dict):
    """The ids of each word as little-endian u32, made when a word is first asked for. content: a tokenizer file."""

    def __init__(self, content: bytes):
        from tokenizers import Tokenizer

        check_form(content)
        self.own = Tokenizer.from_buffer(content)
        self.own.no_truncation()
        self.own.no_padding()
        self.pieces: dict[str, bytes] = {}

    def forget(self) -> None:
        self.clear()
        self.pieces.clear()

    def _piece(self, p: str) -> bytes:
        found = self.pieces.get(p)
        if found is None:
            letters = p if p.isascii() else p.encode().decode("latin-1").translate(LETTERS)
            ids = [t.id for t in self.own.model.tokenize(letters)]
            found = self.pieces[p] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def __missing__(self, raw: bytes) -> bytes:
        w = raw.decode()
        # Without special tokens or marks to compose, the tokenizer's steps before its model are lower case and a split.
        if raw.isalpha():
            found = self._piece(w.lower())
        elif "<|" in w or not w.isprintable() or not w.isascii() and max(w) >= "\u02b0":
            found = np.array(self.own.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
        else:
            found = b"".join(map(self._piece, PRETOKENS.findall(w.lower())))
        self[raw] = found
        return found


def encode_words(texts: list[str], content: bytes) -> list[bytes]:
    """Each text's ids as little-endian u32. The tokenizer drops white space and never joins across it, so words are encoded one by one and remembered."""
    key = zlib.crc32(content)
    if key not in _MADE:
        _MADE[key] = WordIds(content)
    known = _MADE[key]
    if len(known) > CACHE:
        known.forget()
    # Below U+02B0 lower case and composition depend on no neighbour, so these texts share their words in lower case.
    return [b"".join(map(known.__getitem__, (t.lower() if "<|" not in t and (t.isascii() or not HIGH.search(t)) else t).encode().split())) for t in texts]


def write(docs: DataFrame, path: str, folder: str, end_id: int = 1, block: int = 65_536, bits: bool = False, partitions: int | None = None, most_ids: int = 1 << 26) -> DataFrame:
    """Writes the files and returns their list (part int, nth int, file string, n_docs long, n_ids long), which holds ascending doc_ids in the order of part and nth.

    A task writes to a name of its own attempt, so that a task run again or twice leaves no half-written file in the list.
    """
    spark = docs.sparkSession
    with open(path, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        begin("ids", _MADE.clear)
        part, nth, out = TaskContext.get().partitionId(), 0, None

        def closed() -> pa.RecordBatch:
            out.close()
            out.sink.close()
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "nth": pa.array([nth], pa.int32()), "file": [name], "n_docs": [len(out.docs)], "n_ids": [ids_n]})

        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                rows = batch.slice(lo, 1000)
                for doc_id, raw in zip(rows.column(0).to_pylist(), encode_words(rows.column(1).to_pylist(), content.value), strict=True):
                    if doc_id is None:
                        raise ValueError("a document without doc_id has no place in the order")
                    if out is None:
                        name, ids_n = f"{folder}/ids-{part:06d}-{nth:06d}-{uuid.uuid4().hex}.pwid", 0
                        fs, at = files_at(name)
                        fs.create_dir(at.rpartition("/")[0], recursive=True)
                        out = IdFileWriter(fs.open_output_stream(at), block, bits)
                    ids = np.append(np.frombuffer(raw, "<u4"), np.array([end_id], "<u4"))
                    out.add(doc_id, ids)
                    ids_n += len(ids)
                    if ids_n >= most_ids:
                        yield closed()
                        out, nth = None, nth + 1
        if out is not None:
            yield closed()

    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    dealt = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return dealt.mapInArrow(run, "part int, nth int, file string, n_docs long, n_ids long")


def read(files: DataFrame) -> DataFrame:
    """Rows (doc_id long, start long, n_tokens long, ids_crc32 long) from the files of a list (part, file, base long); base: ids in all files before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                fs, at = files_at(name)
                rows, start = [], base
                with fs.open_input_file(at) as source:
                    for doc_id, ids in IdFileReader(source):
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                if rows:
                    yield _rows(rows)

    return files.select("file", "base").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def roundtrip(docs: DataFrame, path: str, **options) -> DataFrame:
    """write() and read() through a folder in the shared one. The list of files, a row for each, goes through the driver."""
    spark = docs.sparkSession
    listed = sorted(tuple(r) for r in write(docs, path, fresh_dir(spark, "ids"), **options).collect())
    bases = np.cumsum([0, *(r[4] for r in listed)]).tolist()
    rows = [(r[2], b) for r, b in zip(listed, bases, strict=False)]
    files = spark.createDataFrame(rows, "file string, base long")
    return read(files.repartition(max(1, len(rows))) if rows else files)
