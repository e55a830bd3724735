"""Quality scores from random-indexing word vectors and a small network.

A word has a sparse random index vector, given by its hash. Its word vector is the sum of the index
vectors of its neighbours over the whole corpus; words share VOCABULARY hash buckets. Each
word also has a shape (capitals, small letters, digits and marks, runs shortened, or a sign that it
repeats a word just before), with vectors of the same kind. A document is the mean of the unit vectors of its
words, and of its shapes. A network of two layers, trained here on a bounded sample of labelled
rows, turns that into a score; a temperature fitted on rows kept from training calibrates it.

Only the sample for training is bounded (SAMPLE rows, by least hash); vectors count every text, and
every text is scored whole.

Defined results: a null text is empty; an empty text has the zero vector and gets the network's
score for it; labels that are null are left aside, of repeated ones the least counts; without labels of both kinds
every score is the share of ones, or 0.5; repeated rows get equal scores; other columns stay
behind in scores() and are kept by good(); an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, arrow_schema, keyed, memo, record_batch, small_batches, text_of

VOCABULARY = 1 << 14
DIMENSIONS = 32
NONZERO = 4
SAMPLE = 20_000
HIDDEN = 24
LONGEST = 32
FOLDS, HELD_OUT = 3, 1

_SHAPES = VOCABULARY // 4  # buckets below are shapes', the rest words'
_REPEAT = 0
_random = np.random.default_rng(2)
_PLACES = np.stack([_random.permutation(DIMENSIONS)[:NONZERO] for _ in range(VOCABULARY)]).astype(np.int64)
_SIGNS = _random.choice([-1.0, 1.0], (VOCABULARY, NONZERO))
_CLASSES = [(re.compile("[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile("[a-zß-öø-ÿ]+"), "a"), (re.compile("[0-9]+"), "0"), (re.compile(r"(.)\1+"), r"\1")]


def shape_of(word: str) -> str:
    """A for capitals, a for small letters, 0 for digits, marks as they are; runs shortened to one."""
    body, tail = (word[:-1], word[-1]) if word[-1] in ",.;:!?" else (word, "")
    if body.isalpha():
        if body.islower():
            return "a" + tail
        if body.isupper():
            return "A" + tail
        if body[0].isupper() and body[1:].islower():
            return "Aa" + tail
    shape = word
    for pattern, sign in _CLASSES:
        shape = pattern.sub(sign, shape)
    return shape


class Codes(dict):
    """Word to word bucket << 16 | shape bucket, remembered; forgotten when they are many."""

    LIMIT = 400_000

    def __missing__(self, word: str) -> int:
        if len(self) > self.LIMIT:
            self.clear()
        shape = shape_of(word)
        a = xxhash.xxh3_64_intdigest(word) % (VOCABULARY - _SHAPES) + _SHAPES
        b = xxhash.xxh3_64_intdigest(shape) % (_SHAPES - 1) + 1
        value = self[word] = a << 16 | b
        return value


def words_of(text: str) -> list[str]:
    """Words between white space; a run of more than LONGEST characters (base64, prose without blanks) is cut into words of that length."""
    words = text.split()
    if words and len(max(words, key=len)) > LONGEST:
        words = [w[at : at + LONGEST] for w in words for at in range(0, len(w), LONGEST)]
    return words


def encode(texts: list[str], codes: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, shape buckets and document numbers of all words of the texts, in order."""
    lists = [words_of(t) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in lists])
    both = np.fromiter(map(codes.__getitem__, chain.from_iterable(lists)), np.int64, len(owner))
    words, shapes = both >> 16, both & 0xFFFF
    for lag in (1, 2):
        again = (both[lag:] == both[:-lag]) & (owner[lag:] == owner[:-lag])
        shapes[lag:][again] = _REPEAT
    return words, shapes, owner


def neighbour_sums(words: np.ndarray, shapes: np.ndarray, owner: np.ndarray, total: np.ndarray) -> None:
    """Add to total (VOCABULARY * DIMENSIONS) the index vectors of each word's and shape's neighbours."""
    near = owner[1:] == owner[:-1]
    for one, other in ((slice(1, None), slice(None, -1)), (slice(None, -1), slice(1, None))):
        for target, context in ((words, words), (words, shapes), (shapes, shapes)):
            t, c = target[one][near] * DIMENSIONS, context[other][near]
            for k in range(NONZERO):
                total += np.bincount(t + _PLACES[c, k], _SIGNS[c, k], len(total))


def word_vectors(docs: DataFrame) -> np.ndarray:
    """VOCABULARY x DIMENSIONS unit vectors, from all texts. Sums per task meet in an aggregate by bucket."""
    fields = [f"v{i}" for i in range(DIMENSIONS)]
    schema = "bucket int, " + ", ".join(f"{f} long" for f in fields)
    target = arrow_schema(schema)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, total = memo("codes", Codes), np.zeros(VOCABULARY * DIMENSIONS)
        for batch in batches:
            words, shapes, owner = encode(batch.column(0).to_pylist(), codes)
            if len(words):
                neighbour_sums(words, shapes, owner, total)
        table = total.reshape(VOCABULARY, DIMENSIONS).astype(np.int64)
        used = np.flatnonzero(table.any(axis=1))
        if len(used):
            yield record_batch({"bucket": pa.array(used), **{f: pa.array(table[used, i]) for i, f in enumerate(fields)}}, target)

    sums = docs.select(text_of().alias("text")).mapInArrow(run, schema)
    rows = sums.groupBy("bucket").agg(*[F.sum(f).alias(f) for f in fields]).collect()
    out = np.zeros((VOCABULARY, DIMENSIONS))
    for r in rows:
        out[r[0]] = r[1:]
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.maximum(length, 1e-9)).astype(np.float32)


def pooled(texts: list[str], codes: Codes, vectors: np.ndarray) -> np.ndarray:
    """Per text, the mean vectors of its words and of its shapes, side by side."""
    words, shapes, owner = encode(texts, codes)
    n = np.maximum(np.bincount(owner, minlength=len(texts)), 1).astype(np.float32)
    out = np.zeros((len(texts), 2 * DIMENSIONS), np.float32)
    for part, ids in ((0, words), (DIMENSIONS, shapes)):
        for i in range(DIMENSIONS):
            out[:, part + i] = np.bincount(owner, vectors[ids, i], len(texts)) / n
    return out


@dataclass
class Network:
    """Inputs standardised, one hidden layer of tanh, one output; a temperature divides the output."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def constant(share: float) -> Network:
    share = min(max(share, 1e-6), 1 - 1e-6)
    one = np.ones(2 * DIMENSIONS)
    return Network(0 * one, one, np.zeros((len(one), 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 1, epochs: int = 60) -> Network:
    """Adam on logistic loss with weight decay; a fifth of the rows is kept for the temperature."""
    if len(y) < 10 or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.5)
    random = np.random.default_rng(seed)
    kept = np.zeros(len(y), bool)
    kept[random.permutation(len(y))[: max(2, len(y) // 5)]] = True
    x = x.astype(np.float64)
    net = Network(x[~kept].mean(0), x[~kept].std(0) + 1e-3, random.normal(0, 0.2, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), random.normal(0, 0.2, HIDDEN), 0.0)
    z, t = (x[~kept] - net.mean) / net.scale, y[~kept].astype(np.float64)
    weights = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for epoch in range(epochs):
        rate = 0.01 * 0.5 ** (epoch / 20)
        order = random.permutation(len(t))
        for at in range(0, len(t), 128):
            some = order[at : at + 128]
            hidden = np.tanh(z[some] @ weights[0] + weights[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ weights[2] + weights[3][0], -60, 60))) - t[some]) / len(some)
            back = np.outer(error, weights[2]) * (1 - hidden**2)
            gradients = [z[some].T @ back + 1e-4 * weights[0], back.sum(0), hidden.T @ error + 1e-4 * weights[2], np.array([error.sum()])]
            step += 1
            for w, g, m, v in zip(weights, gradients, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = weights[0], weights[1], weights[2], float(weights[3][0])
    logits, truth = net.logits(x[kept]), y[kept]
    choices = np.exp(np.linspace(-2, 2.5, 91))
    losses = [np.logaddexp(0, np.where(truth == 1, -logits, logits) / c).mean() for c in choices]
    net.temperature = float(choices[int(np.argmin(losses))])
    return net


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, label: str = "quality", sample: int = SAMPLE) -> Network:
    """Fit on at most about `sample` labelled rows outside the held-out fold, drawn by least hash."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(f"doc_id is not null and y in (0, 1) and crc32(cast(doc_id as string)) % {FOLDS} != {HELD_OUT}")
    usable = usable.groupBy("doc_id").agg(F.min("y").alias("y"))
    n = usable.count()
    if n > sample:
        usable = usable.filter(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    rows = keyed(docs).select("doc_id", "text").join(F.broadcast(usable), "doc_id").select("doc_id", "text", "y")

    def run(batch):
        codes = memo("codes", Codes)
        return {"doc_id": batch.column(0), "y": batch.column(2), "x": list(pooled(batch.column(1).to_pylist(), codes, vectors))}

    got = arrow_map(rows, run, "doc_id long, y int, x array<float>").toArrow()
    if not got.num_rows:
        return constant(0.5)
    x = np.stack(got.column("x").to_pylist())
    y = got.column("y").to_numpy()
    order = np.lexsort((x[:, 0], got.column("doc_id").to_numpy()))
    return fit(x[order], y[order])


def model(docs: DataFrame, labels: DataFrame, label: str = "quality") -> tuple[np.ndarray, Network]:
    vectors = word_vectors(docs)
    return vectors, train(docs, labels, vectors, label)


def scores(docs: DataFrame, vectors: np.ndarray, network: Network) -> DataFrame:
    """doc_id, score for each row of docs."""

    def run(batch):
        codes = memo("codes", Codes)
        return {"doc_id": batch.column(0), "score": network.scores(pooled(batch.column(1).to_pylist(), codes, vectors))}

    return arrow_map(keyed(docs).select("doc_id", "text"), run, "doc_id long, score double")


def good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose text scores at least the threshold, with all their columns."""
    vectors, network = model(docs, labels)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = memo("codes", Codes)
        for batch in batches:
            texts = [t or "" for t in batch.column(place).cast(pa.string()).to_pylist()]
            if texts:
                yield batch.filter(pa.array(network.scores(pooled(texts, codes, vectors)) >= threshold))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
