"""Best-fit packing: the plan against plain best-fit decreasing, the pieces against the tokenizer."""

import random
import zlib
from bisect import bisect_left, insort

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from prosegauge.llm import packing, tokens


def plain_gaps(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        at = bisect_left(gaps, n)
        left = (gaps.pop(at) if at < len(gaps) else capacity) - n
        if left:
            insort(gaps, left)
    return gaps


def runs_of(lengths):
    return [packing.Run(packing.WAITS, n, 0, lengths.count(n)) for n in set(lengths)]


def gaps_of(runs, lengths, capacity):
    """Every document placed once, sequences without holes; what they have left."""
    rows, seen = {}, set()
    for p in runs:
        for k in range(p.count if p.kind == packing.PLACED else 0):
            assert (p.size, p.first + k) not in seen
            seen.add((p.size, p.first + k))
            rows.setdefault(p.sequence + k // p.each, []).append((p.offset + k % p.each * p.size, p.size))
    assert seen == {(n, k) for n in set(lengths) for k in range(lengths.count(n))}
    left = []
    for placed in rows.values():
        at = 0
        for start, n in sorted(placed):
            assert start == at
            at += n
        assert at <= capacity
        left += [capacity - at] if at < capacity else []
    return sorted(left)


@settings(max_examples=150, deadline=None)
@given(st.sampled_from([1, 7, 10, 64]).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=120))))
def test_a_sweep_equals_best_fit_decreasing(case):
    capacity, lengths = case
    runs = packing.sweep(runs_of(lengths), capacity, 0)
    left = gaps_of(runs, lengths, capacity)
    assert left == plain_gaps(lengths, capacity)
    assert sorted(r.size for r in runs if r.kind == packing.GAP for _ in range(r.count)) == left


@pytest.mark.parametrize("capacity,seed", [(16, 1), (100, 2), (1024, 3)])
def test_supersteps_place_all_and_open_hardly_more(spark, capacity, seed):
    r = random.Random(seed)
    lengths = [min(capacity, max(1, int(r.lognormvariate(np.log(capacity) * 0.8, 0.9)))) for _ in range(3000)]
    state = spark.createDataFrame(runs_of(lengths), packing.STATE)
    for step, (low, high) in enumerate(packing.bands(capacity)):
        state = packing.superstep(state, low, high, step, capacity)
    runs = [packing.Run(*x) for x in state.collect()]
    left = gaps_of(runs, lengths, capacity)
    sequences = lambda gaps: (sum(lengths) + sum(gaps)) // capacity
    assert sequences(left) <= sequences(plain_gaps(lengths, capacity)) * 1.002 + 1


def test_bands_cover_all_lengths():
    for capacity in (1, 2, 5, 1024, 1000):
        covered = [n for low, high in packing.bands(capacity) for n in range(high, low, -1)]
        assert covered == list(range(capacity, 0, -1))


def test_lengths_beyond_the_capacity_are_refused():
    with pytest.raises(ValueError):
        packing.sweep([packing.Run(packing.WAITS, 11, 0, 1)], 10, 0)


def test_ids_are_the_tokenizers():
    r = random.Random(0)
    texts = ["", "Hello, world's!", "  a\n\n b\t", "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y <|endof", "ünïcödé 日本語 🚀🚀", "x" * 5000, " " * 3000 + "y", "1234567 12 a1b2", " \x00\x85"]
    texts += ["".join(r.choices("ab c\n.,'1é\t", k=200)) for _ in range(50)]
    encoder = tokens.encoder(tokens.default_path())
    reference = Tokenizer.from_file(tokens.default_path())
    assert 50256 in encoder.ids(texts[3])
    for t in texts:
        assert encoder.ids(t).tolist() == reference.encode(t, add_special_tokens=False).ids
    assert encoder.ids(None).tolist() == []


def test_a_very_long_text(spark):
    long = "many words, " * 60_000
    got = packing.pack(spark.createDataFrame([(1, long), (2, "short")], "doc_id long, text string")).collect()
    n = len(tokens.encoder(tokens.default_path()).ids(long)) + 1
    assert sum(x["length"] for x in got if x["doc_id"] == 1) == n
    assert sorted((x["piece"], x["start"]) for x in got if x["doc_id"] == 1)[1] == (1, n % 1024 or 1024)
    assert len({x["sequence_id"] for x in got}) == -(-n // 1024)


def test_pieces_and_places(spark):
    rows = [(1, "one two three"), (2, None), (3, ""), (4, "word " * 70), (4, "word " * 70), (None, "null key"), (5, "a b c " * 30), (5, "other text, same key")]
    rows += [(10 + k, "the same text again") for k in range(25)]
    docs = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "doc_id long, text string, length int, sequence_id int")
    got = packing.pack(docs, capacity=16).collect()
    encode, want = tokens.encoder(tokens.default_path()).ids, []
    for i, t in rows:
        ids = np.append(encode(t), 2).astype("<u4")
        first = len(ids) % 16 or 16
        cuts = [0, *range(first, len(ids), 16)] if len(ids) > 16 else [0]
        for k, at in enumerate(cuts):
            part = ids[at : (cuts + [len(ids)])[k + 1]]
            want.append((i, k, at, len(part), zlib.crc32(part.tobytes())))
    key = lambda x: str(tuple(x)[:5])
    assert sorted((tuple(x)[:5] for x in got), key=str) == sorted(want, key=str)
    sequences = {}
    for x in sorted(got, key=key):
        sequences.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for placed in sequences.values():
        at = 0
        for start, n in sorted(placed):
            assert start == at
            at += n
        assert at <= 16
    used = [sum(n for _, n in p) for p in sequences.values()]
    lengths = [w[3] for w in want]
    assert sum(used) == sum(lengths) and len(used) <= (sum(lengths) + sum(plain_gaps(lengths, 16))) // 16 + 1
    assert packing.pack(docs.limit(0)).count() == 0


def test_windows_of_the_order_are_packed_apart(spark, tmp_path):
    r = random.Random(4)
    rows = [(k, " ".join(["word"] * r.randint(0, 40))) for k in range(400)] + [(7, None), (None, "null key"), (5, "a b c " * 30), (5, "a b c " * 30)]
    r.shuffle(rows)
    at = 0
    for k, n in enumerate((3, 0, 40, 61, 300)):  # the largest file is the last, and Spark reads it first
        file = spark.createDataFrame(rows[at : at + n], "doc_id long, text string").coalesce(1)
        file.write.parquet(str(tmp_path / str(k)))
        for part in (tmp_path / str(k)).glob("part-*"):
            part.rename(tmp_path / f"part-{k:05d}-{9 - k}.parquet")
        at += n
    assert at == len(rows)
    docs = spark.read.parquet(str(tmp_path / "part-*"))
    assert [tuple(x) for x in docs.collect()] != rows
    got = packing.pack_in_order(docs, capacity=16, window=10).collect()
    pieces = lambda found: sorted(str(tuple(x)[:5]) for x in found)
    assert pieces(got) == pieces(packing.pack(docs, capacity=16).collect())
    assert [(x["sequence_id"], x["offset"]) for x in got] == sorted((x["sequence_id"], x["offset"]) for x in got)
    found = {}
    for x in got:
        assert x["offset"] == sum(y["length"] for y in found.get(x["sequence_id"], []))
        found.setdefault(x["sequence_id"], []).append(x)
    assert max(x["offset"] + x["length"] for x in got) <= 16
    sequences, encode = iter(found.values()), tokens.encoder(tokens.default_path()).ids
    for first in range(0, len(rows), 10):
        window = rows[first : first + 10]
        lengths = [n for _, t in window for _, n in packing.cut(len(encode(t)) + 1, 16)]
        mine = [next(sequences) for _ in range((sum(lengths) + sum(plain_gaps(lengths, 16))) // 16)]
        assert sorted(x["length"] for s in mine for x in s) == sorted(lengths)
        assert sorted(str(x["doc_id"]) for s in mine for x in s if x["piece"] == 0) == sorted(str(i) for i, _ in window)
    assert next(sequences, None) is None
    assert packing.pack_in_order(docs.limit(0)).count() == 0


def test_the_order_of_frames_that_are_not_files(spark):
    rows = [(k, "word " * (k % 7)) for k in range(60, 0, -1)]
    got = packing.pack_in_order(spark.createDataFrame(rows, "doc_id long, text string"), capacity=8, window=1).collect()
    assert [x["doc_id"] for x in got] == [i for i, _ in rows]
