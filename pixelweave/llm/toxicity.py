"""Toxicity by a weighted lexicon that Aho-Corasick matches in folded texts.

Folding: compatibility forms, lower case, look-alike letters of other scripts, and digits or signs standing for letters inside words.
The lexicon holds whole words and word beginnings with their log odds, learned from labelled documents; phrases of two words that hold
an entry but are rare in toxic documents become exceptions. A logistic curve over the matched weight, plain and divided by the
text's length, gives the score.

Learning takes at most SAMPLE labelled documents (those with the smallest hash of their id), a bound of the model; every whole text of the
table is scored. An entry needs LEAST toxic documents of the sample, log odds of LEAST_ODDS, and so many toxic ones among its documents that by
chance less than one of all terms would have as many: rare words count too, and nothing else limits their number.

Defined results: null and empty texts get the score of a text without matches; rows with a null doc_id are scored, are held out
of nothing and teach nothing; of labels that repeat a doc_id the highest counts, of documents that share a labelled doc_id the one with the smallest
hash of its text teaches; repeated rows are scored each; very long texts are scored whole; without labels of both kinds the score is the share of
toxic labels (0 if there are none); an empty table gives an empty result. Columns of docs that clash with added ones are replaced.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import begin, cut, remove, whole_text

SAMPLE = 20_000
LEAST, LEAST_ODDS = 4, 2.5
PREFIXES = range(4, 9)
#: Letters that look like Latin ones, and what digits and signs stand for.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ɡ": "g", "һ": "h", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s",
    "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "ı": "i", "ł": "l", "ø": "o", "ⅼ": "l",
}
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"}
_LETTERS, _SIGNS = str.maketrans(LOOK_ALIKES), str.maketrans(STANDS_FOR)
_SIGNED = re.compile(r"(?=[^\W\d_]*[0-9@$!|€])[\w@$!|€]*[^\W\d_][\w@$!|€]*")
_TAIL = re.compile(r"[!|]+$")
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """The folded text: ' word word ... word ', or a space if it has no words."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if not text.isascii():
        text = text.translate(_LETTERS)
    text = _SIGNED.sub(lambda m: _TAIL.sub("", m[0]).translate(_SIGNS), text)
    words = _WORD.findall(text)
    return f" {' '.join(words)} " if words else " "


def terms(folded: str) -> set[str]:
    """What a text may teach: its words ' word ', their beginnings ' begi', and its pairs ' word word '."""
    words = folded.split()
    out = {f" {w} " for w in words} | {f" {a} {b} " for a, b in zip(words, words[1:], strict=False)}
    return out | {f" {w[:n]}" for w in {*words} for n in PREFIXES if len(w) > n}


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    bias: float = -30.0
    slope: tuple[float, float] = (0.0, 0.0)

    def __post_init__(self):
        self.machine = None

    def __getstate__(self):
        return self.weights, self.exceptions, self.bias, self.slope

    def __setstate__(self, state):
        self.weights, self.exceptions, self.bias, self.slope = state
        self.machine = None

    def compiled(self) -> ahocorasick.Automaton:
        if self.machine is None:
            self.machine = ahocorasick.Automaton()
            for entry, w in self.weights.items():
                self.machine.add_word(entry, (len(entry), w))
            for phrase in self.exceptions:
                self.machine.add_word(phrase, (len(phrase), None))
            self.machine.make_automaton()
        return self.machine

    def holds(self, folded: str) -> bool:
        """Whether any entry is in the folded text."""
        return bool(len(self.compiled())) and next(self.machine.iter(folded), None) is not None

    def features(self, text: str) -> tuple[float, float]:
        """log(1 + weight), and the weight for each hundred words. Of entries that begin at one word the heaviest counts; none in an exception does."""
        if not len(self.compiled()):
            return 0.0, 0.0
        folded = fold(text)
        found: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        for end, (length, w) in self.machine.iter(folded):
            start = end + 1 - length
            if w is None:
                excused.append((start, end))
            elif w > found.get(start, 0.0):
                found[start] = w
        for start, end in excused:
            for at in [a for a in found if start <= a < end]:
                del found[at]
        total = sum(found.values())
        return math.log1p(total), 100.0 * total / (20 + folded.count(" "))

    def score(self, text: str) -> float:
        a, b = self.features(text)
        x = self.bias + self.slope[0] * a + self.slope[1] * b
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Bias and slopes by Newton's method."""
    x = np.hstack([np.ones((len(x), 1)), x])
    b = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -40, 40)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least: int = LEAST, least_odds: float = LEAST_ODDS) -> Model:
    """A model from the labelled documents that are not held out."""
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    taken = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # The sample is read again and again, the whole table only once.
    texts = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(taken), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one"))
    texts = cut(texts.select("toxic", F.col("one.text").alias("text")), "sample")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Whole words, beginnings and pairs of each distinct text count once; "" counts the texts.
        begin("toxicity")
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                toxic, texts = (c.to_pylist() for c in batch.slice(lo, 100).columns)
                out: dict[str, list[int]] = {}
                for y, t in zip(toxic, texts, strict=True):
                    for x in terms(fold(t)) | {""}:
                        n = out.setdefault(x, [0, 0])
                        n[y > 0] += 1
                yield pa.RecordBatch.from_arrays([pa.array([*out], pa.string()), pa.array([n[0] for n in out.values()], pa.int64()), pa.array([n[1] for n in out.values()], pa.int64())], names=["term", "clean", "toxic"])

    counts = texts.dropDuplicates().mapInArrow(emit, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = cut(counts.where((F.col("clean") >= least) | (F.col("toxic") >= least)), "terms")
    per_class = texts.dropDuplicates().agg(F.count(F.when(F.col("toxic") == 0, 1)), F.count(F.when(F.col("toxic") > 0, 1))).first()
    n_clean, n_toxic = per_class
    if not n_clean or not n_toxic:
        remove(texts)
        remove(counts)
        return Model(bias=30.0 if n_toxic else -30.0)
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (n_clean + 1.0))
    word_pair = F.col("term").rlike("^ [^ ]+ [^ ]+ $")
    # The exponent of Chernoff's bound on so many of the term's documents being toxic by chance.
    base, share = n_toxic / (n_clean + n_toxic), F.col("toxic") / (F.col("clean") + F.col("toxic"))
    evidence = F.col("toxic") * F.log(share / base) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - share) / (1 - base))).otherwise(0.0)
    n_terms = counts.where(~word_pair).count()
    best = counts.where(~word_pair & (F.col("term") != "") & (F.col("toxic") >= least)).withColumn("odds", odds).where((F.col("odds") >= least_odds) & (evidence >= math.log(max(2, n_terms))))
    weights = {r["term"]: r["odds"] for r in best.collect()}
    pairs = counts.where(word_pair & (F.col("clean") >= least) & (odds < 0)).select("term")
    found = Model(weights)

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([found.holds(t) for t in batch.column(0).to_pylist()], pa.bool_()))

    model = Model(weights, sorted(r["term"] for r in pairs.mapInArrow(inside, pairs.schema).collect()) if weights else [])
    remove(counts)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in found], pa.float64()), pa.array([b for _, b in found], pa.float64())], names=["toxic", "a", "b"])

    rows = np.array([tuple(r) for r in texts.mapInArrow(measure, "toxic int, a double, b double").collect()], dtype=float)
    remove(texts)
    rows = rows[np.lexsort(rows.T)]
    bias, a, b = _logistic(rows[:, 1:], (rows[:, 0] > 0).astype(float))
    model.bias, model.slope = float(bias), (float(a), float(b))
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with the score of each whole text in one more column. The text passes through Python once, beside all other columns."""
    docs = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("toxicity")
        own = shared.value
        for batch in batches:
            scores = pa.array([own.score(t.as_py() or "") for t in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, name])

    schema = docs.withColumn(name, F.lit(0.0)).schema
    return docs.mapInArrow(run, schema)
