"""A hidden Markov language model and the unigram base it is held against.

Words are hashed to 64 bits. Documents are encoded once into blocks of bounded
size; several blocks share a vocabulary, and its words, not each of their tokens,
are what is counted across the cluster: rows of a word and its count are added up,
and the sums are joined back. However frequent a word is, a vocabulary has it once.
No list of all words is ever held by one task or the driver.

The model emits a word class from a hidden state and a word from its class. The
most frequent words are classes of their own, the others share classes by how
they end, and within a class a word has its share of the training counts. Words
not met in training are one class; a state's probability for it follows Good and
Turing from the words met once. States are trained by Baum-Welch: tasks send
expected counts by class, which the cluster adds up and the driver (a table of
fixed size) turns into the next model. A few rounds on one block set the start;
all training documents take part in each of the rounds that follow.

The scaled forward recursion (and, in training, the backward one) runs through all
texts of a block at once. Long texts have blocks of their own. What is longer than
``CHUNK`` tokens is cut, and the parts run side by side: the product of a part's
matrices tells how it carries a state from its start to its end, so each part begins
with exactly the state that the text before it leads to, and ends with what follows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.common import batches, columns, materialize, release, small_batches

STATES = 8
OWN = 2048
ENDINGS = 2048
BLOCK_CHARS = 3_000_000
#: Blocks that share a vocabulary, and the words after which a new one is begun.
SHARED, WORDS = 8, 500_000
#: Texts of more characters are long.
LONG_CHARS = 12_000
CHUNK = 16_384
WARM, ROUNDS = 8, 5
END = xxhash.xxh64_intdigest(b"")  # no word is empty

#: A row for each vocabulary. ``docs`` are the numbers of documents in its blocks, ``tokens`` the blocks.
BLOCK = "block long, doc_id array<long>, held array<boolean>, n array<int>, docs array<int>, tokens array<binary>, words array<long>, endings array<short>, seen array<long>"

READY = "block long, doc_id array<long>, held array<boolean>, n array<int>, docs array<int>, tokens array<binary>, count binary, class binary"


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at the six ASCII white-space characters."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def pack(tokens: np.ndarray) -> bytes:
    """Tokens by planes of their bytes, compressed: the high planes are nearly empty."""
    planes = np.ascontiguousarray(tokens.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


class Vocabulary:
    """Documents gathered into blocks, their tokens as indices into the words met so far."""

    def __init__(self):
        self.index: dict[bytes, int] = {b"": 0}
        self.seen = np.zeros(1, np.int64)
        self.doc_id: list = []
        self.held: list[bool] = []
        self.n: list[int] = []
        self.docs: list[int] = []
        self.tokens: list[bytes] = []

    def add(self, rows: list[tuple[int | None, str | None, bool]]) -> None:
        """One block."""
        index, parts = self.index, []
        put = index.setdefault
        for _, text, _ in rows:
            line = [put(w, len(index)) for w in words_of(text)]
            line.append(0)
            parts.append(np.array(line, np.uint32))
        n, held = [len(p) for p in parts], [h for _, _, h in rows]
        tokens = np.concatenate(parts)
        seen = np.bincount(tokens[~np.repeat(held, n)], minlength=len(index))
        seen[: len(self.seen)] += self.seen
        self.seen = seen
        self.doc_id += [r[0] for r in rows]
        self.held += held
        self.n += n
        self.docs.append(len(rows))
        self.tokens.append(pack(tokens))

    def full(self) -> bool:
        return len(self.tokens) >= SHARED or len(self.index) >= WORDS

    def row(self, block: int) -> tuple:
        h, index = xxhash.xxh64_intdigest, self.index
        words = np.fromiter((h(w) for w in index), np.uint64, len(index)).view(np.int64)
        ends = (np.fromiter((h(w[-3:]) for w in index), np.uint64, len(index)) % np.uint64(ENDINGS)).astype(np.int16)
        return block, self.doc_id, self.held, self.n, self.docs, self.tokens, words, ends, self.seen


def blocks(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, held)`` -> one row for each vocabulary, with the blocks that share it."""
    kinds = {"block": pa.int64(), "doc_id": pa.list_(pa.int64()), "held": pa.list_(pa.bool_()), "n": pa.list_(pa.int32()), "docs": pa.list_(pa.int32()), "tokens": pa.list_(pa.binary()), "words": pa.list_(pa.int64()), "endings": pa.list_(pa.int16()), "seen": pa.list_(pa.int64())}
    schema = pa.schema(list(kinds.items()))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, made = TaskContext.get().partitionId() << 32, Vocabulary()
        waiting: tuple[list, list] = [], []
        room = [BLOCK_CHARS, BLOCK_CHARS]

        for batch in it:
            for row in zip(*columns(batch, "doc_id", "text", "held"), strict=True):
                size = len(row[1] or "")
                long = size > LONG_CHARS
                waiting[long].append(row)
                room[long] -= size + 50
                if room[long] < 0:
                    made.add(waiting[long])
                    waiting[long].clear()
                    room[long] = BLOCK_CHARS
                    if made.full():
                        yield from batches(iter([made.row(number)]), schema)
                        number, made = number + 1, Vocabulary()
        for rows in waiting:
            if rows:
                made.add(rows)
        if made.tokens:
            yield from batches(iter([made.row(number)]), schema)

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text", "held").mapInArrow(run, BLOCK)


class Counts(NamedTuple):
    """Totals of the training tokens, and what the classes need."""

    tokens: int
    words: int
    own: np.ndarray  # hashes of the words with classes of their own, sorted
    mass: np.ndarray  # by ending: the sum of (count + 1) over the other known words
    once: np.ndarray  # by ending: the share of tokens whose word occurs once


def count_words(made: DataFrame) -> tuple[Counts, DataFrame]:
    """Totals, and ``(word, ending, count)``: training counts of all words met."""
    rows = made.select(F.explode(F.arrays_zip("words", "endings", "seen")).alias("w"))
    summed = rows.groupBy(F.col("w.words").alias("word")).agg(F.first("w.endings").alias("ending"), F.sum("w.seen").alias("count"))
    words = materialize(summed, "hmm-words")
    known = words.where("count > 0")
    sums = known.groupBy("ending").agg(F.sum(F.col("count") + 1).alias("mass"), F.sum("count").alias("tokens"), F.sum((F.col("count") == 1).cast("long")).alias("once"), F.count("*").alias("words")).collect()  # ENDINGS rows at most
    frequent = known.orderBy(F.desc("count"), "word").limit(OWN).collect()
    mass, tokens, once = np.zeros(ENDINGS), np.zeros(ENDINGS), np.zeros(ENDINGS)
    for r in sums:
        mass[r["ending"]], tokens[r["ending"]], once[r["ending"]] = r["mass"], r["tokens"], r["once"]
    for r in frequent:
        mass[r["ending"]] -= r["count"] + 1
        tokens[r["ending"]] -= r["count"]
        once[r["ending"]] -= r["count"] == 1
    own = np.sort(np.array([r["word"] for r in frequent], np.int64).view(np.uint64))
    return Counts(sum(r["tokens"] for r in sums), sum(r["words"] for r in sums), own, mass, once / np.maximum(tokens, 1)), words


UNKNOWN = OWN + ENDINGS


def classes(words: np.ndarray, endings: np.ndarray, counts: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The class of each word: its own, its ending's, or the one of unknown words."""
    at = np.searchsorted(own, words)
    mine = (at < len(own)) & (own[np.minimum(at, max(0, len(own) - 1))] == words) if len(own) else np.zeros(len(words), bool)
    return np.where(counts == 0, UNKNOWN, np.where(mine, at, OWN + endings.astype(np.int64))).astype(np.uint16)


def with_counts(made: DataFrame, counts: Counts, words: DataFrame) -> DataFrame:
    """Blocks with the count and class of each word of their vocabulary in place of the hashes."""
    met = made.select("block", F.posexplode("words").alias("at", "word")).join(words.select("word", "count"), "word")

    def gather(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each vocabulary from the counts of its words, which come in order."""
        schema = pa.schema([("block", pa.int64()), ("count", pa.binary())])
        now, held = None, []
        for batch in it:
            block, count = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if held and block[a] != now:
                    yield from batches(iter([(now, np.concatenate(held).tobytes())]), schema)
                    held = []
                now = int(block[a])
                held.append(count[a:b].copy())
        if held:
            yield from batches(iter([(now, np.concatenate(held).tobytes())]), schema)

    small_batches(made.sparkSession, 100_000)  # of two numbers each
    in_order = met.select("block", "at", "count").repartition("block").sortWithinPartitions("block", "at").select("block", "count")
    told = materialize(in_order.mapInArrow(gather, "block long, count binary"), "hmm-told")
    names = ("block", "doc_id", "held", "n", "docs", "tokens")
    kinds = {"block": pa.int64(), "doc_id": pa.list_(pa.int64()), "held": pa.list_(pa.bool_()), "n": pa.list_(pa.int32()), "docs": pa.list_(pa.int32()), "tokens": pa.list_(pa.binary()), "count": pa.binary(), "class": pa.binary()}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            made = []
            for k in range(batch.num_rows):
                words, endings = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in (len(names), len(names) + 1))
                count = np.frombuffer(batch.column(len(names) + 2)[k].as_py(), np.int64)
                made.append((count.tobytes(), classes(words.view(np.uint64), endings, count, counts.own).tobytes()))
            added = [pa.array(x, pa.binary()) for x in zip(*made, strict=True)]
            yield pa.RecordBatch.from_arrays([c.cast(kind) for c, kind in zip([*batch.columns[: len(names)], *added], kinds.values(), strict=True)], names=list(kinds))

    joined = made.drop("seen").join(told, "block").select(*names, "words", "endings", "count")
    small_batches(made.sparkSession, 2)
    ready = materialize(joined.mapInArrow(run, READY), "hmm-ready")
    release(told)
    return ready


class Sequences(NamedTuple):
    """Sequences of classes to run through together, longest first."""

    start: np.ndarray
    length: np.ndarray
    owner: np.ndarray  # which text each belongs to
    step: np.ndarray  # which part of its text
    last: np.ndarray  # whether it is the text's last part


def cut(n: np.ndarray, chunk: int) -> Sequences:
    """Texts laid end to end, of ``n`` tokens each, as sequences of ``chunk`` at most."""
    parts = -(-n // chunk)
    owner = np.repeat(np.arange(len(n)), parts)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat(np.cumsum(n) - n, parts) + step * chunk
    length = np.minimum(chunk, np.repeat(n, parts) - step * chunk)
    order = np.lexsort((start, -length))
    return Sequences(start[order], length[order], owner[order], step[order], (step + 1 == np.repeat(parts, parts))[order])


class Steps(NamedTuple):
    """The tokens of sequences step by step: those of a step lie side by side, the longest sequence's first."""

    at: np.ndarray  # token of each place
    live: np.ndarray  # by step: how many sequences still run
    first: np.ndarray  # by step: its first place


def steps(seqs: Sequences) -> Steps:
    longest = int(seqs.length.max(initial=0))
    live = np.searchsorted(-seqs.length, -np.arange(longest), side="left")
    first = np.cumsum(live) - live
    rank = np.repeat(np.arange(len(seqs.length)), seqs.length)
    t = np.arange(len(rank)) - np.repeat(np.cumsum(seqs.length) - seqs.length, seqs.length)
    at = np.empty(len(rank), np.int64)
    at[first[t] + rank] = seqs.start[rank] + t
    return Steps(at, live, first)


class Model:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, np.ascontiguousarray(emit.T)

    @classmethod
    def random(cls, counts: Counts, seed: int = 1) -> Model:
        rng = np.random.default_rng(seed)
        stay = np.full((STATES, STATES), 0.1 / STATES) + np.eye(STATES) * 0.9
        return cls.estimated(np.ones(STATES), stay * 100, rng.gamma(0.5, 1.0, (STATES, UNKNOWN)), counts)

    @classmethod
    def estimated(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, counts: Counts) -> Model:
        """From expected counts. Every class with a known word has some probability in every state."""
        known = np.concatenate((np.arange(OWN) < len(counts.own), counts.mass > 0))
        total = (emit * known).sum(axis=1)
        unknown = (emit[:, OWN:] @ counts.once + 0.5) / (total + 1) if known.any() else np.ones(len(emit))
        kept = np.where(known, emit + 0.01, 0)
        kept /= np.maximum(kept.sum(axis=1, keepdims=True), 1e-300)
        full = np.hstack((kept * (1 - unknown)[:, None], unknown[:, None]))
        return cls((start + 0.1) / (start + 0.1).sum(), (move + 0.1) / (move + 0.1).sum(axis=1, keepdims=True), full)

    def through(self, classes: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """For each sequence the scaled product of its matrices: from the state before it to the one at its end."""
        k, order = len(self.start), np.argsort(-length, kind="stable")
        at, left, live = start[order], length[order], len(order)
        out = np.broadcast_to(np.eye(k), (live, k, k)).copy()
        for t in range(int(left.max(initial=0))):
            while live and left[live - 1] <= t:
                live -= 1
            x = (out[:live].reshape(-1, k) @ self.move).reshape(-1, k, k) * self.emit[classes[at[:live] + t]][:, None, :]
            out[:live] = x / x.sum(axis=(1, 2))[:, None, None]
        back = np.empty_like(out)
        back[order] = out
        return back

    def forward(self, emitted: np.ndarray, run: Steps, enter: np.ndarray, ahead: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The scale of each place, and each sequence's state at its end; the states of all places go to ``ahead``."""
        scale, state, one, move = np.empty(len(emitted)), enter.copy(), np.ones(len(self.start)), self.move
        for t, (live, at) in enumerate(zip(run.live.tolist(), run.first.tolist(), strict=True)):
            here = state[:live]
            x = here @ move if t else here
            x = x * emitted[at : at + live]
            s = scale[at : at + live] = x @ one
            np.divide(x, s[:, None], out=here)
            if ahead is not None:
                ahead[at : at + live] = here
        return scale, state

    def entering(self, classes: np.ndarray, seqs: Sequences) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each sequence: the state before its first token, what the first token's is expected to be, and its product of matrices.

        The state before is zero, and the product not made, where a text begins.
        """
        k, m = len(self.start), len(seqs.start)
        before, matrices = np.zeros((m, k)), np.zeros((m, k, k))
        later = np.flatnonzero(seqs.step)
        if len(later):
            matrices[later] = self.through(classes, seqs.start[later], seqs.length[later])
            first = np.flatnonzero((seqs.step == 0) & ~seqs.last)
            some = Sequences(*(x[first] for x in seqs))
            run = steps(some)
            _, state = self.forward(self.emit[classes[run.at]], run, np.tile(self.start, (len(first), 1)))
            ends = dict(zip(some.owner.tolist(), state, strict=True))
            for j in later[np.lexsort((seqs.step[later], seqs.owner[later]))].tolist():  # a text's parts in order
                before[j] = ends[int(seqs.owner[j])]
                x = before[j] @ matrices[j]
                ends[int(seqs.owner[j])] = x / x.sum()
        enter = np.where((seqs.step == 0)[:, None], self.start, before @ self.move)
        return before, enter, matrices

    def likelihood(self, classes: np.ndarray, n: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
        """The natural log of each text's probability, by the scaled forward recursion."""
        seqs = cut(n, chunk)
        run = steps(seqs)
        scale, _ = self.forward(self.emit[classes[run.at]], run, self.entering(classes, seqs)[1])
        owner = np.repeat(np.arange(len(n)), n)
        return np.bincount(owner[run.at], weights=np.log(scale), minlength=len(n))

    def expected(self, classes: np.ndarray, n: np.ndarray, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of starts, moves and emissions (Baum-Welch)."""
        seqs = cut(n, chunk)
        run, k = steps(seqs), len(self.start)
        kinds = classes[run.at]
        emitted, ahead = self.emit[kinds], np.empty((len(classes), k))
        before, enter, matrices = self.entering(classes, seqs)
        scale, end = self.forward(emitted, run, enter, ahead)
        behind, moves = np.ones((len(seqs.start), k)), np.zeros((k, k))
        later = np.flatnonzero(seqs.step)
        part = {(int(seqs.owner[j]), int(seqs.step[j])): j for j in np.flatnonzero(~seqs.last | (seqs.step > 0)).tolist()}
        for j in later[np.lexsort((-seqs.step[later], seqs.owner[later]))].tolist():  # a text's parts from its end
            i = part[int(seqs.owner[j]), int(seqs.step[j]) - 1]
            x = matrices[j] @ behind[j]
            behind[i] = x / (x @ end[i])
        emitted /= scale[:, None]
        live, first, back = run.live.tolist(), run.first.tolist(), np.ascontiguousarray(self.move.T)
        for t in range(len(live) - 1, 0, -1):
            m, at, then = live[t], first[t], first[t - 1]
            mine = behind[:m]
            weight = emitted[at : at + m] * mine
            ahead[at : at + m] *= mine
            moves += ahead[then : then + m].T @ weight
            np.matmul(weight, back, out=mine)
        head = slice(0, len(seqs.start))
        moves += before.T @ (emitted[head] * behind)
        ahead[head] *= behind
        start = ahead[head][seqs.step == 0].sum(axis=0)
        emit = np.stack([np.bincount(kinds, weights=ahead[:, j], minlength=UNKNOWN)[:UNKNOWN] for j in range(k)])
        return start, moves * self.move, emit


def chosen(classes: np.ndarray, n: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens and lengths of the kept texts."""
    return classes[np.repeat(keep, n)], n[keep]


def parts(held: list, n: list, docs: list, tokens: list) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """The blocks of a row: which documents, whether each is held out, their lengths, their tokens."""
    at = 0
    for size, packed in zip(docs, tokens, strict=True):
        here = slice(at, at + size)
        yield here, np.array(held[here], bool), np.array(n[here], np.int64), unpack(packed)
        at += size


def train(ready: DataFrame, counts: Counts, rounds: int = ROUNDS, warm: int = WARM) -> Model:
    """Baum-Welch over all training texts, started on those of one block."""
    model = Model.random(counts)
    if not counts.tokens:
        return model
    small_batches(ready.sparkSession, 2)
    first = ready.select("block").orderBy(F.xxhash64("block")).first()["block"]
    some = ready.where(F.col("block") == first).select("held", "n", F.slice("docs", 1, 1).alias("docs"), F.slice("tokens", 1, 1).alias("tokens"), "class")
    for r in some.limit(1).collect():
        for _, held, n, tokens in parts(r["held"], r["n"], r["docs"], r["tokens"]):
            part = chosen(np.frombuffer(r["class"], np.uint16)[tokens].astype(np.int64), n, ~held)
            for _ in range(warm if len(part[1]) else 0):
                model = Model.estimated(*model.expected(*part), counts)
    for _ in range(rounds):
        model = Model.estimated(*gathered(ready, model), counts)
    return model


def gathered(ready: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts over all training texts: a row for each class from each task, summed by the cluster."""
    k = len(model.start)
    schema = pa.schema([("at", pa.int32()), *((f"c{j}", pa.float64()) for j in range(k))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, 1 + k + UNKNOWN))
        for batch in it:
            for *row, cls in zip(*columns(batch, "held", "n", "docs", "tokens", "class"), strict=True):
                cls = np.frombuffer(cls, np.uint16)
                for _, held, n, tokens in parts(*row):
                    part = chosen(cls[tokens].astype(np.int64), n, ~held)
                    if len(part[1]):
                        start, moves, emit = model.expected(*part)
                        sums += np.hstack((start[:, None], moves, emit))
        some = np.flatnonzero(sums.any(axis=0))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(row[some]) for row in sums)], schema=schema)

    small_batches(ready.sparkSession, 2)
    rows = ready.select("held", "n", "docs", "tokens", "class").mapInArrow(run, "at int, " + ", ".join(f"c{j} double" for j in range(k)))
    sums = np.zeros((k, 1 + k + UNKNOWN))
    for r in rows.groupBy("at").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(k)]).collect():  # a row for each class
        sums[:, r["at"]] = r[1:]
    return sums[:, 0], sums[:, 1 : 1 + k], sums[:, 1 + k :]


def score(ready: DataFrame, counts: Counts, model: Model) -> DataFrame:
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    schema = pa.schema([(c.split()[0], kind) for c, kind in zip(out.split(", "), kinds, strict=True)])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for ids, *row, count, cls in zip(*columns(batch, "doc_id", "held", "n", "docs", "tokens", "count", "class"), strict=True):
                count, cls = np.frombuffer(count, np.int64).astype(np.float64), np.frombuffer(cls, np.uint16).astype(np.int64)
                unigram = np.log10((count + 1) / (counts.tokens + counts.words + 1))
                ends = (cls >= OWN) & (cls < UNKNOWN)
                share = np.where(ends, np.log10((count + 1) / np.maximum(counts.mass[np.clip(cls - OWN, 0, ENDINGS - 1)], 1)), 0.0)
                for here, held, n, tokens in parts(*row):
                    starts = np.cumsum(n) - n
                    add = lambda x: np.add.reduceat(x[tokens], starts)  # noqa: B023, E731
                    likely = model.likelihood(cls[tokens], n) / np.log(10) + add(share)
                    known = add((count > 0).astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[here], pa.int64()), pa.array(held), pa.array(n), pa.array(known), pa.array(np.full(len(n), counts.tokens)), pa.array(add(unigram)), pa.array(likely)], schema=schema)

    small_batches(ready.sparkSession, 2)
    return ready.select("doc_id", "held", "n", "docs", "tokens", "count", "class").mapInArrow(run, out)


def language_model(docs: DataFrame, held: str = "held", key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row of ``docs``.

    ``held`` marks the rows not learnt from. A null or empty text is the end token
    alone. Repeated rows count as often as they occur; an empty table gives no
    rows; without training rows every token is unknown and all scores are 0.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(held), F.lit(False)).alias("held"))
    made = materialize(blocks(rows), "hmm-blocks")
    counts, words = count_words(made)
    ready = with_counts(made, counts, words)
    release(made, words)
    return score(ready, counts, train(ready, counts))
