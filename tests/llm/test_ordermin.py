"""Order MinHash against a plain Python version, and its edges."""

import hashlib
import random
import re
import struct

import xxhash

from prosegauge.llm import ordermin as om

SCHEMA = "doc_id long, text string, sig int, next string"


def chained(*values):
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed


def signature(text):
    words = re.findall(r"[^ \t\n\x0b\f\r]{1,8}", text or "")
    if not words:
        return [0] * om.PARTS
    kmers = [tuple(words[i : i + om.K]) for i in range(max(1, len(words) - om.K + 1))]
    seen, rows = {}, []
    for position, kmer in enumerate(kmers):
        h = chained(*kmer) >> 29
        k = seen[h] = seen.get(h, -1) + 1
        rows.append((chained_int(h, k) >> 29 if k else h, position))
    parts = {}
    for h, position in sorted(rows):
        part = parts.setdefault(h >> 29, [])
        if len(part) < om.LEAST:
            part.append((position, h))
    codes = {p: chained(*[h for _, h in sorted(v)]) & 0xFFFF for p, v in parts.items()}
    return [codes[min((p for p in codes if p >= j), default=min(codes))] for j in range(om.PARTS)]


# an int is hashed as four bytes, unlike a long
def chained_int(seed_value, k):
    return xxhash.xxh64_intdigest(struct.pack("<i", k), xxhash.xxh64_intdigest(struct.pack("<q", seed_value), 42))


def edited(text, after):
    third = len(text) // 3
    return text[: len(text) - third] + after[:third]


def check(spark, rows):
    got = sorted(map(tuple, om.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    want = []
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        e = edited(t, n)
        a, b, c = signature(t), signature(e), signature(n)
        near = [(sum(x == y for x, y in zip(a, z)) / om.PARTS) ** (1 / om.LEAST) for z in (b, c)]
        hexed = ["".join(f"{x:04x}" for x in z) for z in (a, b)]
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), *hexed, *near))
    assert got == sorted(want, key=str)


def test_matches_plain_version(spark):
    words = "one two three four five six seven eight nine ten elevenandtwelve é".split()
    texts = [" ".join(words[(i * i + 3 * k + k // 7) % len(words)] for k in range(n)) for i, n in enumerate((1, 2, 3, 4, 10, 60, 400, 900))]
    texts += [None, "", " \n\t ", "x" * 500, "a b a b a b a b", "🚀 ünï códe 🚀 " * 5, texts[6], "same " * 700]
    check(spark, [(i * 7, t) for i, t in enumerate(texts)])


def test_repeated_rows_null_keys_and_ties(spark):
    check(spark, [(5, "a b c d"), (5, "a b c d"), (5, "z y x"), (None, "p q r"), (None, None), (1, "last one here")])


def test_lone_row_is_its_own_next(spark):
    check(spark, [(3, "abc def ghi jkl")])


def test_empty_table_and_extra_columns(spark):
    assert om.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    odd = spark.createDataFrame([(1, "a b c d", 9, "x"), (2, "a b c d", 8, "y")], SCHEMA)
    rows = om.fingerprints(odd).collect()
    assert rows[0]["fingerprint"] == rows[1]["fingerprint"] and rows[0]["near_next"] == 1.0


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(om, "RANGE", 3)
    check(spark, [(i * i % 97, f"text {i} of some words to tell apart {i * 7}") for i in range(60)] + [(None, "null key")])


def test_order_matters(spark):
    a = " ".join(f"word{i}" for i in range(300))
    moved = " ".join([f"word{i}" for i in range(150, 300)] + [f"word{i}" for i in range(150)])
    rows = {r["doc_id"]: r for r in om.fingerprints(spark.createDataFrame([(2, a), (1, moved)], "doc_id long, text string")).collect()}
    # nearly the same k-mers, but those that met across the halves have changed places
    assert 0.3 < rows[2]["near_next"] < 0.9


def test_very_long_texts(spark):
    r = random.Random(9)
    long = " ".join(f"w{r.randrange(5000)}" for _ in range(40_000))
    check(spark, [(3, long), (2, "short"), (1, long[::-1])])
