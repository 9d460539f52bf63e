"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. The vector of a letter trigram is
the product (binding) of its letters' vectors, the first rotated twice, the second
once, so that order counts. A text is the sum (bundle) of its trigrams' vectors;
a language's prototype is the bundle of its training texts. A document gets the
language whose prototype has the largest cosine with the document's vector, after
the mean of the prototypes' directions, which says nothing about the language, has
been taken from both.

Runs of characters other than letters count as one gap, so word starts and ends
are trigrams too. Case is ignored. The letter memory has a fixed number of slots:
a-z have their own and any other letter is assigned one by its code point.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from prosegauge.llm.common import batches, columns, small_batches

DIMENSIONS = 1024
SLOTS = 64
SEED = 20_011
UNKNOWN = "und"
#: What is worked on at once: code points of texts, counts of texts by trigrams, vectors of trigrams.
CHARS, CELLS, VECTORS = 1_500_000, 4_000_000, 16_384


@cache
def letter_slots() -> np.ndarray:
    """The slot of each code point; 0 for what is no letter."""
    slots = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        if (c := chr(cp)).isalpha():
            low = c.lower()
            k = ord(low[0])
            slots[cp] = k - 96 if 97 <= k <= 122 else 27 + (k * 2_654_435_761 % (1 << 32)) * (SLOTS - 27) // (1 << 32)
    return slots


@cache
def letter_vectors(dimensions: int) -> np.ndarray:
    return np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SLOTS, dimensions))


def trigram_vectors(codes: np.ndarray, dimensions: int) -> np.ndarray:
    """One bound vector for each trigram code."""
    one = letter_vectors(dimensions)
    return np.roll(one, 2, axis=1)[codes // SLOTS**2] * np.roll(one, 1, axis=1)[codes // SLOTS % SLOTS] * one[codes % SLOTS]


def trigram_counts(texts: list[str | None], cells: int | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """Trigram codes that occur in the texts, and how often each text has each; None for several texts with more than ``cells`` counts."""
    slot = letter_slots()
    lengths = [len(t) + 2 if t else 2 for t in texts]
    line = " " + "  ".join(t or "" for t in texts) + " "
    x = slot[np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)]
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), lengths)
    kept = np.ones(len(x), bool)
    kept[1:] = (x[1:] != 0) | (x[:-1] != 0) | (owner[1:] != owner[:-1])
    x, owner = x[kept].astype(np.int32), owner[kept]
    codes, whose = x[:-2] * SLOTS**2 + x[1:-1] * SLOTS + x[2:], owner[:-2]
    inside = (whose == owner[2:]) & (codes > 0)
    codes, whose = codes[inside], whose[inside]
    there = np.zeros(SLOTS**3, np.int32)
    there[codes] = 1
    known = np.flatnonzero(there)
    if cells and len(texts) > 1 and len(texts) * len(known) > cells:
        return None
    there[known] = np.arange(len(known))
    counts = np.bincount(whose * len(known) + there[codes], minlength=len(texts) * len(known))
    return known, counts.reshape(len(texts), len(known))


def counted(texts: list[str | None]) -> Iterator[tuple[list[str | None], np.ndarray, np.ndarray]]:
    """``trigram_counts`` of all texts, of fewer at once where they have very many trigrams or are very long."""
    made = trigram_counts(texts, CELLS) if sum(len(t or "") for t in texts) <= CHARS or len(texts) < 2 else None
    if made is None:
        half = len(texts) // 2
        yield from counted(texts[:half])
        yield from counted(texts[half:])
    else:
        yield texts, *made


def bundles(texts: list[str | None], dimensions: int) -> np.ndarray:
    """The bundle of each text, as float32 (sums of ones, exact below 2^24)."""
    out = []
    for part, known, counts in counted(texts):
        sums = np.zeros((len(part), dimensions), np.float32)
        for k in range(0, len(known), VECTORS):
            sums += counts[:, k : k + VECTORS].astype(np.float32) @ trigram_vectors(known[k : k + VECTORS], dimensions).astype(np.float32)
        out.append(sums)
    return np.concatenate(out) if out else np.zeros((0, dimensions), np.float32)


class Profiles:
    """Languages and their prototypes."""

    def __init__(self, languages: list[str], vectors: np.ndarray):
        self.languages = languages
        unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        self.common = unit.mean(axis=0) if len(unit) > 1 else np.zeros(vectors.shape[1])
        away = unit - self.common
        self.away = (away / np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)).astype(np.float32)
        self.common = self.common.astype(np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text. Without a letter (or null): und, 0."""
        x = bundles(texts, self.common.shape[0])
        size = np.linalg.norm(x, axis=1, keepdims=True)
        some = size[:, 0] > 0
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        x = x / np.maximum(size, 1e-12) - self.common
        cos = (x @ self.away.T) / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        best = cos.argmax(axis=1)
        score = np.clip(cos[np.arange(len(best)), best].astype(np.float64), 0, 1)
        return [self.languages[k] if s else UNKNOWN for k, s in zip(best, some, strict=True)], np.where(some, score, 0.0)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS) -> Profiles:
    """Prototypes from every row whose language and text are not null.

    Each task sums trigram counts by language and sends one bundle for each; the
    cluster adds them up. What reaches the driver is one vector for each language.
    """
    small_batches(labelled.sparkSession)
    schema = pa.schema([("lang", pa.string()), ("at", pa.int32()), ("sum", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in it:
            texts, langs = columns(batch, "text", "lang")
            at = 0
            for part, known, counts in counted(texts):
                mine_of, at = langs[at : at + len(part)], at + len(part)
                for one in set(mine_of):
                    mine = counts[[k for k, x in enumerate(mine_of) if x == one]].sum(axis=0)
                    sums.setdefault(one, np.zeros(SLOTS**3, np.int64))[known] += mine
        for one, total in sums.items():
            codes = np.flatnonzero(total)
            vector = np.zeros(dimensions, np.int64)
            for k in range(0, len(codes), 4096):
                part = codes[k : k + 4096]
                vector += np.rint(total[part].astype(np.float64) @ trigram_vectors(part, dimensions).astype(np.float64)).astype(np.int64)
            yield from batches(((one, k, int(v)) for k, v in enumerate(vector)), schema)

    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null and text is not null")
    summed = rows.mapInArrow(run, "lang string, at int, sum long").groupBy("lang", "at").agg(F.sum("sum").alias("sum"))
    vectors: dict[str, np.ndarray] = {}
    for r in summed.collect():
        vectors.setdefault(r["lang"], np.zeros(dimensions))[r["at"]] = r["sum"]
    languages = sorted(vectors)
    return Profiles(languages, np.array([vectors[x] for x in languages]).reshape(len(languages), dimensions))


def identify(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; columns of those names are replaced.

    Only the text is read for it. A null text and one without letters are ``und``
    with score 0; equal cosines go to the language first in order. Repeated rows
    are kept.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kept = docs.select([c for c in docs.columns if c not in ("lang_pred", "score")])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            langs, scores = profiles.predict(batch.column(batch.schema.get_field_index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores)], names=[*batch.schema.names, "lang_pred", "score"])

    out = StructType([*kept.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType())
    return kept.mapInArrow(run, out)
