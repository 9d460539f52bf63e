"""Quality of documents by random indexing and a small neural network.

Each word counts as two terms, its letters in lower case and its shape (runs of
lower-case letters, capitals and digits each written once, other signs as they
are, runs of one sign written once; a word said again has that for its shape). A
term has a random index vector with a few entries
of +1 and -1; its context vector is the sum of the index vectors of the
terms around it in the training sample. A document is the mean of its words'
vectors, and a network with one hidden layer turns that into a probability, which
a temperature fitted on rows kept from the training makes honest.

The model is fitted on a bounded sample: the ``SAMPLE`` labelled rows with the
smallest hash of their key, less those that the ``SAMPLE_CHARS`` characters left
have no room for. Terms that
are rare in it share one vector. All documents are scored, whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from prosegauge.llm.common import small_batches

SAMPLE = 8000
SAMPLE_CHARS = 16_000_000
DIMENSIONS = 64
ENTRIES = 6
WINDOW = 2
HIDDEN = 24
LEAST = 8
RARE = "\0rare"
AGAIN = "\1again"

LOWER, UPPER, DIGITS, SAME = re.compile(r"[^\W\d_A-Z]+"), re.compile(r"[A-Z]+"), re.compile(r"\d+"), re.compile(r"(.)\1+")
LETTERS = re.compile(r"[\W\d_]+")


def terms(word: str) -> tuple[str, str]:
    shape = SAME.sub(r"\1", LOWER.sub("a", UPPER.sub("A", DIGITS.sub("0", word))))
    return LETTERS.sub("", word).lower(), "\1" + shape[:12]


def index_vector(term: str) -> np.ndarray:
    """A sparse random vector that depends on the term alone."""
    rng = np.random.default_rng(xxhash.xxh64_intdigest(term.encode(), 5))
    v = np.zeros(DIMENSIONS, np.float32)
    v[rng.choice(DIMENSIONS, ENTRIES, replace=False)] = rng.choice([-1.0, 1.0], ENTRIES)
    return v


class Words:
    """The vectors of known terms; row 0 is for all others."""

    def __init__(self, texts: list[str]):
        seen: Counter[str] = Counter()
        for text in texts:
            seen.update(x for a, b in self.split(text) for x in (a, b))
        self.row = {t: k + 1 for k, t in enumerate(sorted(t for t, n in seen.items() if n >= LEAST and t))}
        del seen
        self.known: dict[str, tuple[int, int]] = {}
        index = np.stack([index_vector(RARE), *map(index_vector, self.row)])
        context = np.zeros_like(index)
        for text in texts:
            pair = self.rows(text)
            if not len(pair):
                continue
            own = index[pair[:, 0]] + index[pair[:, 1]]
            around = np.zeros_like(own)
            for d in range(1, min(WINDOW + 1, len(own))):
                around[d:] += own[:-d]
                around[:-d] += own[d:]
            for column in pair.T:
                order = np.argsort(column, kind="stable")
                first = np.flatnonzero(np.diff(column[order], prepend=-1))
                context[column[order[first]]] += np.add.reduceat(around[order], first, axis=0)
        context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
        self.vectors = (index / np.sqrt(ENTRIES) + context).astype(np.float32)

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    @staticmethod
    def split(text: str | None) -> Iterator[tuple[str, str]]:
        """Each word's terms; a word that is the one before it again has that for its shape."""
        before = None
        for word in (text or "").split():
            letters, shape = terms(word)
            yield letters, AGAIN if word == before else shape
            before = word

    def rows(self, text: str | None) -> np.ndarray:
        """The rows of each word's two terms."""
        known, get = self.known, self.row.get
        if len(known) > 200_000:  # what is met again soon enough
            known.clear()
        again, before, flat = get(AGAIN, 0), None, []
        for w in (text or "").split():
            pair = known.get(w)
            if pair is None:
                a, b = terms(w)
                pair = known[w] = (get(a, 0), get(b, 0))
            flat.append((pair[0], again) if w == before else pair)
            before = w
        return np.array(flat, np.int64).reshape(-1, 2)

    def pooled(self, text: str | None) -> np.ndarray:
        """The mean of the words' vectors, for each kind of term; zeros without a word."""
        at = self.rows(text)
        if not len(at):
            return np.zeros(2 * DIMENSIONS, np.float32)
        return np.concatenate((self.vectors[at[:, 0]].mean(axis=0), self.vectors[at[:, 1]].mean(axis=0)))


class Network:
    """Two layers, trained by Adam on the cross entropy, with a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, epochs: int = 60, seed: int = 3):
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(x))
        kept, fitted = order[: len(x) // 6], order[len(x) // 6 :]
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = (x - self.mean) / self.scale
        self.layers = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, HIDDEN), np.zeros(1)]
        first, second = [np.zeros_like(p) for p in self.layers], [np.zeros_like(p) for p in self.layers]
        step = 0
        for _ in range(epochs):
            rng.shuffle(fitted)
            for k in range(0, len(fitted), 128):
                rows = fitted[k : k + 128]
                step += 1
                for p, g, m, v in zip(self.layers, self.gradient(z[rows], y[rows]), first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= 0.004 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.temperature = 1.0
        if len(kept) and len(set(y[kept])) > 1:
            logit = self.logit(x[kept])
            loss = lambda t: np.logaddexp(0, -(2 * y[kept] - 1) * logit / t).mean()
            self.temperature = float(min(np.geomspace(0.25, 8, 101), key=loss))

    def gradient(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        w, b, u, c = self.layers
        h = np.tanh(x @ w + b)
        d = (1 / (1 + np.exp(-(h @ u + c))) - y) / len(y)
        dh = d[:, None] * u * (1 - h * h)
        return [x.T @ dh + 1e-4 * w, dh.sum(axis=0), h.T @ d + 1e-4 * u, d.sum(keepdims=True)]

    def logit(self, x: np.ndarray) -> np.ndarray:
        w, b, u, c = self.layers
        # sums in one order whatever the other rows are, so that equal texts have equal scores
        h = np.tanh(np.einsum("ij,jk->ik", (x - self.mean) / self.scale, w) + b)
        return np.einsum("ij,j->i", h, u) + c

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


class Quality:
    def __init__(self, texts: list[str | None], labels: list[int]):
        self.words = Words([t or "" for t in texts])
        self.prior = (sum(labels) + 1) / (len(labels) + 2)
        both = len(set(labels)) > 1
        self.network = Network(np.stack([self.words.pooled(t) for t in texts]).astype(np.float64), np.array(labels, np.float64)) if both else None

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability of label 1. Without both labels in training: their share, for all."""
        if self.network is None or not texts:
            return np.full(len(texts), self.prior)
        return self.network.probability(np.stack([self.words.pooled(t) for t in texts]).astype(np.float64))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Quality:
    """Fit on labelled rows; rows with a null label or key are left out.

    A key with several labels counts once, with the largest; of several rows with
    one key each is a training row.
    """
    rows = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y in (0, 1)")
    rows = rows.groupBy("k").agg(F.max("y").alias("y"))
    chosen = rows.orderBy(F.xxhash64("k"), "k").limit(SAMPLE)  # bounded, so it may be broadcast
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("text"))
    sized = texts.select("k", F.coalesce(F.length("text"), F.lit(0)).alias("n")).join(F.broadcast(chosen), "k")
    sizes = sized.orderBy(F.xxhash64("k"), "k", "n").limit(SAMPLE).collect()
    room, ids = SAMPLE_CHARS, []
    for r in sizes:
        if r["n"] <= room:
            room -= r["n"]
            ids.append((r["k"], r["y"]))
    if not ids:
        return Quality([], [])
    spark = docs.sparkSession
    picked = spark.createDataFrame(sorted(set(ids)), "k long, y int")
    got = texts.join(F.broadcast(picked), "k").orderBy("k", "text").limit(SAMPLE).collect()
    return Quality([r["text"] for r in got], [r["y"] for r in got])


def score(docs: DataFrame, model: Quality, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a score column, 0 to 1; a column of that name is replaced.

    Null and empty texts are scored like any other, from a vector of zeros.
    Repeated rows are kept; an empty table stays so.
    """
    small_batches(docs.sparkSession)
    kept = docs.select(F.col(text).alias("_text"), *[c for c in docs.columns if c != name])
    out = StructType(kept.schema.fields[1:]).add(name, DoubleType())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            scores = model.score(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores, pa.float64())], names=[*batch.schema.names[1:], name])

    return kept.mapInArrow(run, out)
