"""A quality classifier: random-indexing word vectors pooled per document, then a two-layer network with a temperature.

Every feature of a word (the word in lower case, its last three characters, its shape) has a bucket, and every bucket a sparse
ternary index vector from a seeded generator.  A bucket's context vector is the sum of the index vectors of the words
around it in the training sample; a word's vector is the sum of its buckets' normalised context vectors, and a document's
the mean over its words, with the share of words that repeat the one before.  A network with one hidden layer is trained on these; its logits are divided by a temperature
fitted on documents that the training didn't see.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_RE, held_out, map_texts, slices

#: Labelled documents that a model is fitted on at most: the first by a hash of the id.
SAMPLE_ROWS = 5_000
BUCKETS, DIM, NONZERO, REACH = 1 << 16, 48, 6, 2
HIDDEN, EPOCHS, SEED = 24, 300, 7
THRESHOLD = 0.3

_WORDS = re.compile(WORD_RE)
_LETTERS, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")


def _case(letters: str) -> str:
    return "a" if letters.islower() else "A" if letters.isupper() and len(letters) > 1 else "B"


def features(word: str) -> tuple[int, int, int]:
    """The word's buckets: itself in lower case, its end, its shape (runs of letters by case, digits, other characters)."""
    shape = _case(word) if word.isalpha() else _LETTERS.sub(lambda m: _case(m[0]), _DIGITS.sub("9", word))[:12]
    mask = BUCKETS - 1
    return zlib.crc32(("w" + word.lower()).encode()) & mask, zlib.crc32(("e" + word[-3:]).encode()) & mask, zlib.crc32(("s" + shape).encode()) & mask


class WordVectors:
    """Word vectors from context vectors; words are remembered as rows of one matrix of bounded size."""

    ROWS = 150_000

    def __init__(self, context: np.ndarray) -> None:
        self.context = context
        self._reset()

    def _reset(self) -> None:
        self.row: dict[str, int] = {}
        self.matrix = np.zeros((1024, DIM), np.float32)

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self.row) > self.ROWS:
            self._reset()
        new = [w for w in dict.fromkeys(words) if w not in self.row]
        if new:
            at, n = len(self.row), len(self.row) + len(new)
            if n > len(self.matrix):
                grown = np.zeros((max(n, 2 * len(self.matrix)), DIM), np.float32)
                grown[:at] = self.matrix[:at]
                self.matrix = grown
            buckets = np.array([features(w) for w in new])
            self.matrix[at:n] = self.context[buckets[:, 0]] + self.context[buckets[:, 1]] + self.context[buckets[:, 2]]
            self.row.update(zip(new, range(at, n), strict=True))
        return np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))

    def pool(self, text: str) -> np.ndarray:
        """The mean word vector, and the share of words that repeat the one before."""
        words = _WORDS.findall(text)
        out = np.zeros(DIM + 1, np.float32)
        if words:
            total, again, last = np.zeros(DIM, np.float64), 0, None
            for at in range(0, len(words), 20_000):
                part = words[at : at + 20_000]
                again += sum(map(str.__eq__, part[1:], part)) + (part[0] == last)
                last = part[-1]
                counts = np.bincount(self.rows(part))
                seen = np.flatnonzero(counts)
                total += counts[seen] @ self.matrix[seen]
            out[:DIM] = total / len(words)
            out[DIM] = again / len(words)
        return out


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """By bucket, where its index vector isn't zero, and its signs there."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, DIM, (BUCKETS, NONZERO)), rng.choice(np.array([-1.0, 1.0]), (BUCKETS, NONZERO))


def context_vectors(texts: list[str]) -> np.ndarray:
    """Sums of the neighbours' index vectors, scaled to length one; zero for buckets that the texts don't have."""
    where, sign = index_vectors()
    total = np.zeros(BUCKETS * DIM)
    known: dict[str, tuple[int, int, int]] = {}
    for text in texts:
        words = _WORDS.findall(text)
        for w in words:
            if w not in known:
                known[w] = features(w)
        if len(words) < 2:
            continue
        b = np.array([known[w] for w in words])
        for shift in range(1, REACH + 1):
            for own, other in ((b[:-shift], b[shift:]), (b[shift:], b[:-shift])):
                for k in range(3):  # of the neighbour: each of its buckets
                    cells = (own[:, :, None] * DIM + where[other[:, k]][:, None, :]).ravel()
                    signs = np.broadcast_to(sign[other[:, k]][:, None, :], (len(own), 3, NONZERO)).ravel()
                    np.add.at(total, cells, signs)
    out = total.reshape(BUCKETS, DIM)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


@dataclass
class Network:
    """logit = w2 . relu(w1 x + b1) + b2, over standardised features, divided by the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(((x - self.mean) / self.scale) @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))

    @classmethod
    def constant(cls, p: float) -> Network:
        """For a sample without both labels: the same probability for every document."""
        z = np.zeros(DIM + 1)
        return cls(z, z + 1, np.zeros((DIM + 1, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Network:
        """Adam on the mean log loss with weight decay; the temperature on a fifth of the rows, held out."""
        if len(y) < 10 or y.min() == y.max():
            return cls.constant((y.sum() + 1) / (len(y) + 2))
        rng = np.random.default_rng(SEED)
        order = rng.permutation(len(y))
        held, rest = order[: len(y) // 5], order[len(y) // 5 :]
        xs, ys = x[rest], y[rest]
        mean, scale = xs.mean(0), xs.std(0) + 1e-6
        xs = (xs - mean) / scale
        p = [rng.normal(0, 1 / np.sqrt(xs.shape[1]), (xs.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        for t in range(1, EPOCHS + 1):
            z = xs @ p[0] + p[1]
            h = np.maximum(z, 0)
            d = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - ys) / len(ys)
            dz = np.outer(d, p[2]) * (z > 0)
            grads = [xs.T @ dz + 1e-3 * p[0], dz.sum(0), h.T @ d + 1e-3 * p[2], np.array([d.sum()])]
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - 0.02 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        net = cls(mean, scale, p[0], p[1], p[2], float(p[3][0]))
        z = net.logits(x[held])
        grid = np.geomspace(0.25, 8, 61)
        loss = [np.logaddexp(0, np.where(y[held] == 1, -z, z) / t).mean() for t in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
        return net


@dataclass
class Model:
    context: np.ndarray
    network: Network


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> Model:
    """A model from labelled documents outside the held-out fold, at most ``limit`` of them.

    Labels that are null, or whose document is missing, are left aside; of an id's repeated labels the smallest counts, of its
    repeated documents each.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.where(~held_out(F.col("doc_id"), 5, 0)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(limit).collect()
    texts, y = [r["text"] or "" for r in rows], np.array([r["quality"] for r in rows], float)
    context = context_vectors(texts)
    vectors = WordVectors(context)
    x = np.array([vectors.pool(t) for t in texts], float).reshape(len(texts), DIM + 1)
    return Model(context, Network.fit(x, y))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each row's whole text.

    A null text is scored as the empty one, whose pooled vector is zero.  Null ids stay null (their fold is the empty text's);
    repeated rows are scored each; other columns are left aside.  One scan, no shuffle; the model's size is fixed.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def kernel():
        vectors = WordVectors(sent.value.context)

        def f(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
            x = np.array([vectors.pool(t) for t in texts], float).reshape(len(texts), DIM + 1)
            return pa.record_batch([batch.column(0), pa.array(sent.value.network.probabilities(x))], ["doc_id", "score"])

        return f

    out = map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = WordVectors(sent.value.context)
        for batch, texts in slices(batches):
            x = np.array([vectors.pool(t) for t in texts], float).reshape(len(texts), DIM + 1)
            yield batch.filter(pa.array(sent.value.network.probabilities(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
