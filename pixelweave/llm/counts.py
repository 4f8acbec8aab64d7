"""Token counts of a unigram tokenizer without its ids: count-only Viterbi.

Aho-Corasick enumerates all vocabulary matches in a word; dynamic programming over the ends carries the best score and its number of
pieces. Ties as in the tokenizers library: at each position the candidates come by ascending length and a later one wins only with
a larger score, and the unknown piece of one character is tried when no vocabulary piece of one character begins there. Adjacent unknown
characters fuse into one piece, which byte fallback turns into one token for each byte.

The vocabulary is that of a sentencepiece file with its own scores, read as a unigram model; nothing is trained. Of a BPE file these scores
are ranks of merges: the counts are those of a unigram model with such scores, not of that file's own merging.

Defined results: null and empty texts have 0 tokens and score 0; other columns are left out; repeated rows are counted each; an
empty table gives an empty result. Texts are counted whole; a word's cost is its length times its matches.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import begin, whole_text

SPACE = "▁"
#: A worker forgets its words beyond so many; speed only.
CACHE = 250_000
#: Fixed value: how far below the lowest score an unknown character lies.
UNKNOWN_PENALTY = 10.0
_MADE: dict[int, CountingViterbi] = {}


def vocabulary(path: str) -> list[tuple[str, float]]:
    """The pieces and scores of a sentencepiece file, in the order of their ids."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(own.id_to_piece(i), float(own.get_score(i))) for i in range(own.vocab_size())]


class CountingViterbi:
    """unk: the id of the unknown piece. Byte fallback holds if all of <0x00> to <0xFF> are in the vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]], unk: int = 0):
        self.trie = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(pieces):
            if piece:
                self.trie.add_word(piece, (len(piece), score, i == unk))
        self.trie.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unk_score = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        names = {p for p, _ in pieces}
        self.fallback = all(f"<0x{b:02X}>" in names for b in range(256))
        self.known: dict[str, tuple[int, float]] = {}

    def count(self, word: str) -> tuple[int, float]:
        """Number of tokens and score of a word, its space mark included."""
        n = len(word)
        if self.single.issuperset(word):
            # Matches come by ascending end and, for one end, the longest first: in the order of their starts.
            best, pieces = [float("-inf")] * (n + 1), [0] * (n + 1)
            best[0] = 0.0
            for end, (length, score, _) in self.trie.iter(word):
                if (total := best[end + 1 - length] + score) > best[end + 1]:
                    best[end + 1], pieces[end + 1] = total, pieces[end + 1 - length] + 1
            return pieces[n], best[n]
        starts: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, (length, score, _) in self.trie.iter(word):
            starts[end + 1 - length].append((length, score))
        best: list[float | None] = [None] * (n + 1)
        pieces, unknown = [0] * (n + 1), [False] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            base, count = best[i], pieces[i]
            for length, score in sorted(starts[i]):
                if best[i + length] is None or base + score > best[i + length]:
                    best[i + length], pieces[i + length], unknown[i + length] = base + score, count + 1, False
            if word[i] not in self.single and (best[i + 1] is None or base + self.unk_score > best[i + 1]):
                if self.fallback:
                    more = len(word[i].encode("utf-8", "surrogatepass"))
                else:
                    more = 0 if i and unknown[i] else 1
                best[i + 1], pieces[i + 1], unknown[i + 1] = base + self.unk_score, count + more, True
        return pieces[n], best[n]

    def count_text(self, text: str) -> tuple[int, float]:
        """A text's words are its parts between spaces, each with a space mark before it."""
        if not text:
            return 0, 0.0
        words = text.replace(SPACE, " ").split(" ")
        if not words[0] and len(words) > 1:
            del words[0]
        known, total, score = self.known, 0, 0.0
        for w in words:
            if w not in known:
                if len(known) > CACHE:
                    known.clear()
                known[w] = self.count(SPACE + w)
            n, s = known[w]
            total += n
            score += s
        return total, score


def counter(key: int, pieces) -> CountingViterbi:
    """One counter for each file and Python worker; pieces: a broadcast vocabulary."""
    if key not in _MADE:
        _MADE[key] = CountingViterbi(pieces.value)
    return _MADE[key]


def count_tokens(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Rows (the columns of keep, n_tokens long, score double), one for each row of docs. path: a sentencepiece file that the driver reads."""
    spark = docs.sparkSession
    pieces = spark.sparkContext.broadcast(vocabulary(path))
    key = zlib.crc32(path.encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("counts", _MADE.clear)
        own = counter(key, pieces)
        for batch in batches:
            found = [own.count_text(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            cols = batch.columns[:-1] + [pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "n_tokens", "score"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, whole_text(text_col).alias("whole text")).mapInArrow(run, f"{kinds}, n_tokens long, score double")
