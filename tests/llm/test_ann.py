"""The permutation index against brute force, and vectors that take no part."""

import math

import numpy as np
from pyspark.sql import functions as F

from prosegauge.llm import ann


def brute(rows, is_query, k=5):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if is_query(i):
            near = [(-float(np.dot(q, v) / math.sqrt(np.dot(q, q)) / math.sqrt(np.dot(v, v))), j) for j, v in good if j != i and len(v) == len(q)]
            out[i] = sorted(near)[:k]
    return out


def rows_of(found):
    out = {}
    for r in found.collect():
        out.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    return out


def test_recall_and_exact_scores(spark):
    r = np.random.default_rng(0)
    rows = [(i, r.normal(size=32).astype(np.float32).tolist()) for i in range(3000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = rows_of(ann.search(table, F.col("vec_id") % 50 == 0))
    want = brute(rows, lambda i: i % 50 == 0)
    assert got.keys() == want.keys()
    hits = sum(len({v for v, _ in got[q].values()} & {j for _, j in want[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.9
    vectors = {i: np.array(v) for i, v in rows}
    for q, found in got.items():
        assert sorted(found) == [1, 2, 3, 4, 5]
        order = [(-found[k][1], found[k][0]) for k in range(1, 6)]
        assert order == sorted(order)
        for v, score in found.values():
            a, b = vectors[q], vectors[v]
            assert math.isclose(score, a @ b / np.linalg.norm(a) / np.linalg.norm(b), rel_tol=1e-12)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [3.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (50, [0.0, 1.0]), (9, [1.0, 1.0, 1.0]), (100, [1.0, 1.0, 0.5]), (None, [1.0, 0.0]), (150, [5.0]), (0, [1.0, 0.0])]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got = rows_of(ann.search(table, F.col("vec_id") % 50 == 0))
    assert [got[0][k][0] for k in sorted(got[0])] == [0, 1, 2, 50]  # ties to the smaller id; the row that is repeated finds itself once
    assert {v for v, _ in got[50].values()} == {0, 1, 2}
    assert [v for v, _ in got[100].values()] == [9]
    assert 150 not in got and 4 not in got
    assert ann.search(table.limit(0), F.lit(True)).count() == 0
    assert ann.search(table.where("vec_id = 3"), F.lit(True)).count() == 0


def test_common_vector(spark):
    r = np.random.default_rng(1)
    same = r.normal(size=16).tolist()
    rows = [(i, same if i % 3 else r.normal(size=16).tolist()) for i in range(900)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = rows_of(ann.search(table, F.col("vec_id") % 50 == 0, part=100))
    want = brute(rows, lambda i: i % 50 == 0)
    for q in (50, 100, 200):
        assert [got[q][k][0] for k in range(1, 6)] == [j for _, j in want[q]] == [1, 2, 4, 5, 7]


def test_sizes_of_vectors_do_not_matter(spark):
    tiny, huge = 5e-324, 1.7e308
    rows = [(0, [1e200, 1e200]), (1, [1.0, 1.0]), (2, [tiny, tiny]), (3, [huge, -huge]), (50, [1e-310, 1e-310]), (4, [1e308, 0.0]), (5, [-1e-200, -1e-200])]
    got = rows_of(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0))
    for q, other in ((0, 50), (50, 0)):
        found = [got[q][k] for k in range(1, 6)]
        assert {v for v, _ in found[:3]} == {other, 1, 2} and [v for v, _ in found[3:]] == [4, 3]
        assert np.allclose([s for _, s in found], [1, 1, 1, math.sqrt(0.5), 0])


def test_rows_that_share_an_id(spark):
    rows = [(50, [1.0, 0.0]), (50, [1.0, 0.1]), (50, [1.0, 0.1]), (1, [0.0, 1.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    assert len(got) == 9 and {r["query_id"] for r in got} == {50}
    assert sorted(r["vec_id"] for r in got) == [1, 1, 1, *[50] * 6]
    assert sum(r["rank"] == 1 and math.isclose(r["score"], 1) for r in got) == 2


def test_work_is_less_than_all_pairs_where_vectors_lie_in_clusters(spark, monkeypatch):
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 24))
    rows = [(i, (centres[i % 40] + 0.1 * r.normal(size=24)).tolist()) for i in range(4000)]
    read = {}
    made = ann.files_to_read
    monkeypatch.setattr(ann, "files_to_read", lambda *a: read.update(made(*a)) or read)
    got = rows_of(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, part=300))
    want = brute(rows, lambda i: i % 50 == 0)
    assert sum(len({v for v, _ in got[q].values()} & {j for _, j in want[q]}) for q in want) / (5 * len(want)) >= 0.95
    assert read[24] <= 30  # of 126 files


def test_footrule_agreement():
    r = np.random.default_rng(2)
    x = r.normal(size=(40, 8))
    pivots = ann.spread(ann.unit(r.normal(size=(64, 8))), 12)
    places = ann.order(ann.unit(x), pivots, 5)
    got = ann.agreement(places, places[:5], 12)
    for q in range(5):
        for v in range(40):
            a = {p: k for k, p in enumerate(places[q])}
            b = {p: k for k, p in enumerate(places[v])}
            footrule = sum(abs(a.get(p, 5) - b.get(p, 5)) for p in range(12))
            assert footrule == 2 * sum(5 - k for k in range(5)) - 2 * got[q, v]
