"""Approximate nearest neighbours by a permutation index.

A set of pivots is chosen once. A vector is represented by its nearest pivots in
order of nearness and posted in the inverted files of the first few (``POSTED``),
with that order and the vector itself. A query reads the files of its own nearest
pivots only. In each it ranks the entries by Spearman's footrule distance (a
pivot that a vector doesn't name among its first ``NAMED`` counts as named last),
and the nearest share of the file, ties at the edge included, is ranked again by
the exact cosine. The files' best are merged.

How many files a query reads is settled by measurement: for a bounded number of
queries the nearest rows are found by brute force over all rows, and as many files
are read as have ``RECALL`` of these. Vectors that lie in clusters need few; vectors
without any structure, as if drawn at random, need a good part of all.

Pivots are chosen far from one another from a bounded sample (``SAMPLE`` distinct
vectors with the smallest hash, ``SAMPLE_CELLS`` components), twice as many as the square root of the number
of vectors and ``MOST_PIVOTS`` at most. Every vector is indexed. Equal vectors are
one entry, with as many of their ids as a query may want. A file
that many vectors name is cut, by a hash, into parts of ``PART`` entries or so, and the
queries of a part into blocks, so a task holds one part and one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ShortType, StructField, StructType

from prosegauge.llm.common import batches, materialize, release, small_batches

SAMPLE, SAMPLE_CELLS = 8192, 4_000_000
MOST_PIVOTS = 1024
POSTED = 4
NAMED = 64
PART = 4096
QUERIES = 512
#: Of a file's entries, the share that is ranked again, and how many at least.
RERANKED = 0.3
LEAST = 96
#: Queries that the number of files is settled by, and the share of their nearest rows that the files hold.
TUNED = 128
RECALL = 0.97

SHORTS = ArrayType(ShortType())


def usable(vector: Column) -> Column:
    """Not null, with no null or non-finite component, and not all zero."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def scaled(x: np.ndarray) -> np.ndarray:
    """Each vector times a power of two, which is exact, so that its largest component is near 1 and no product overflows or vanishes."""
    _, power = np.frexp(np.abs(x).max(axis=-1, keepdims=True))
    return np.ldexp(x, -power)


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spread(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Farthest-first choice among unit vectors."""
    chosen, near = [0], sample @ sample[0]
    while len(chosen) < min(pivots, len(sample)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, sample @ sample[chosen[-1]])
    return sample[chosen]


def order(x: np.ndarray, pivots: np.ndarray, named: int) -> np.ndarray:
    """Each unit vector's nearest pivots, nearest first."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :named].astype(np.int32)


def cosine(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    """In double precision, the same way for each row whatever the others are; vectors of any finite size."""
    rows, one = scaled(rows), scaled(one)
    return np.clip((rows * one).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((one * one).sum())), -1, 1)


def agreement(places: np.ndarray, asked: np.ndarray, pivots: int) -> np.ndarray:
    """Half of what footrule distance falls short of its largest value, for each query (rows) and vector (columns).

    Both are given by their first pivots in order, n of them. A pivot that both
    name, at places a and b, takes (n - a) + (n - b) - |a - b| off the distance:
    twice n - max(a, b).
    """
    n = places.shape[1]
    of = np.full((len(asked), pivots), n, np.int16)
    of[np.arange(len(asked))[:, None], asked] = np.arange(n, dtype=np.int16)
    out = np.zeros((len(asked), len(places)), np.int32)
    for a in range(n):
        out += n - np.maximum(of[:, places[:, a]], np.int16(a))
    return out


def best(ids: list[list[int]], cids: np.ndarray, vectors: np.ndarray, near: np.ndarray, own_id: int, own_cid: int, q: np.ndarray, k: int, reranked: float) -> Iterator[tuple[int, float, list[int]]]:
    """``(cid, cosine, ids)`` of a file's best ``k`` entries for one query, less one row of its own id from its own entry."""
    asked = max(LEAST, 2 * k, int(np.ceil(reranked * len(near))))
    found = np.arange(len(near)) if asked >= len(near) else np.flatnonzero(near >= np.partition(near, len(near) - asked)[len(near) - asked])
    score, rows = cosine(vectors[found], q), []
    # as many by score as could matter, and all that tie with the last
    edge = np.sort(score)[::-1][min(k, len(score) - 1)]
    for at in np.flatnonzero(score >= edge):
        others = list(ids[found[at]])
        if cids[found[at]] == own_cid and own_id in others:  # if it isn't, the others are enough
            others.remove(own_id)
        if others:
            rows.append((-float(score[at]), others[0], int(cids[found[at]]), others))
    for s, _, cid, others in sorted(rows)[:k]:
        yield cid, -s, others


def entries(rows: DataFrame, k: int) -> DataFrame:
    """``rows(h, id, x)``, h a hash of x -> ``(cid, dim, ids, h, x)``: distinct vectors with their smallest ids, sorted, one more than ``k``."""
    # with the hash first, sorts hardly ever compare two vectors
    smallest = Window.partitionBy("h", "x").orderBy("id")
    few = rows.select("h", "id", "x").withColumn("r", F.row_number().over(smallest)).where(F.col("r") <= k + 1)
    made = few.groupBy("h", "x").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return materialize(made.select(F.monotonically_increasing_id().alias("cid"), F.size("x").alias("dim"), "ids", "h", "x"), "ann-entries")


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False).reshape(-1, dim)


def by_dimension(batch: pa.RecordBatch, x: str) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    dims = batch.column(batch.schema.get_field_index("dim")).to_numpy(zero_copy_only=False)
    for dim in np.unique(dims):
        part = batch.filter(pa.array(dims == dim))
        yield int(dim), part, part.column(part.schema.get_field_index(x)).flatten().to_numpy(zero_copy_only=False).reshape(-1, int(dim))


def widened(rows: DataFrame, *names: str) -> StructType:
    return StructType([*rows.schema.fields, *(StructField(n, SHORTS) for n in names)])


def ordered(rows: DataFrame, chosen: dict[int, np.ndarray], named: int) -> DataFrame:
    """``rows(..., dim, x)`` with ``perm``, the nearest pivots in order (all that there are where ``named`` is 0)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for dim, part, x in by_dimension(batch, "x"):
                perm = order(unit(x), chosen[dim], named or len(chosen[dim])).astype(np.int16)
                made = pa.ListArray.from_arrays(pa.array(np.arange(len(perm) + 1) * perm.shape[1], pa.int32()), pa.array(perm.ravel(), pa.int16()))
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, "perm"])

    small_batches(rows.sparkSession, 2048)
    return rows.mapInArrow(run, widened(rows, "perm"))


def nearest_of_some(known: DataFrame, asked: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """The ``k`` entries nearest each of a few queries, by brute force over all: ``(dim, at, cid)``."""
    schema = pa.schema([("dim", pa.int32()), ("at", pa.int32()), ("cid", pa.int64()), ("score", pa.float64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for dim, part, x in by_dimension(batch, "x"):
                if dim not in asked:
                    continue
                own, q = asked[dim]
                cids = part.column(0).to_numpy(zero_copy_only=False)
                score = np.where(own[:, None] == cids, -2, unit(q) @ unit(x).T)
                rows = ((dim, a, int(cids[j]), float(score[a, j])) for a in range(len(q)) for j in np.argsort(-score[a])[:k] if score[a, j] > -2)
                yield from batches(rows, schema)

    small_batches(known.sparkSession, 8192)
    found = known.select("cid", "dim", "x").mapInArrow(run, "dim int, at int, cid long, score double")
    first = Window.partitionBy("dim", "at").orderBy(F.desc("score"), "cid")
    return found.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k).select("dim", "at", "cid")


def files_to_read(posts: DataFrame, known: DataFrame, queries: DataFrame, chosen: dict[int, np.ndarray], k: int, recall: float) -> dict[int, int]:
    """How many files hold the share ``recall`` of some queries' nearest rows, for each length of vectors."""
    some = queries.select("dim", "cid", "x").withColumn("r", F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("x"), "cid"))).where(F.col("r") <= TUNED)
    asked: dict[int, list] = {}
    for r in some.collect():  # bounded for each length of vectors
        asked.setdefault(r["dim"], []).append((r["cid"], r["x"]))
    arrays = {d: (np.array([c for c, _ in v], np.int64), np.array([x for _, x in v], np.float64)) for d, v in asked.items()}
    truth = nearest_of_some(known, arrays, k)
    # the places that a query gives the pivots under which its nearest rows are posted
    needed: dict[int, list[int]] = {d: [] for d in chosen}
    place = {d: np.argsort(order(unit(x), chosen[d], len(chosen[d])), axis=1) for d, (_, x) in arrays.items()}
    for r in truth.join(posts.select("cid", F.slice("perm", 1, POSTED).alias("under")), "cid").collect():  # k for each of these queries
        needed[r["dim"]].append(int(place[r["dim"]][r["at"]][r["under"]].min()) + 1)
    return {d: int(np.quantile(v, recall, method="higher")) if v else 1 for d, v in needed.items()}


def search(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", part: int = PART, reranked: float = RERANKED, recall: float = RECALL) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows nearest each query row, nearest first.

    Ties go to the smaller id. Vectors that are null, all zero, or hold null or
    non-finite components take no part, nor do rows without an id; vectors of any
    finite size do. A query row's candidates are all other rows, among them
    those that share its id; rows that are alike in id and vector are as many
    queries and as many candidates. Vectors are compared with vectors of their own
    length only. Fewer than ``k`` candidates are returned all; an empty table
    gives no rows.
    """
    spark = vectors.sparkSession
    x = F.transform(F.col(vector), lambda v: v.cast("double") + F.lit(0.0))  # -0.0 is 0.0
    rows = vectors.where(F.col(key).isNotNull()).where(usable(F.col(vector))).select(F.col(key).cast("long").alias("id"), x.alias("x"), F.coalesce(is_query, F.lit(False)).alias("query")).withColumn("h", F.xxhash64("x"))
    known = entries(rows, k)
    totals = known.groupBy("dim").agg(F.count("*").alias("n")).collect()  # a row for each length of vectors
    if not totals:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    chosen = {}
    for t in totals:
        sample = known.where(F.col("dim") == t["dim"]).select("h", "x").orderBy("h", "x").limit(min(SAMPLE, max(1, SAMPLE_CELLS // t["dim"]))).collect()  # bounded
        pivots = min(MOST_PIVOTS, max(16, int(2 * t["n"] ** 0.5)))
        chosen[t["dim"]] = spread(unit(np.random.default_rng(0).permutation(np.array([r["x"] for r in sample], np.float64))), pivots)
    posts = materialize(ordered(known.drop("h"), chosen, NAMED), "ann-posts")
    queries = materialize(rows.where("query").join(known.select("cid", "dim", "h", "x"), ["h", "x"]).select("cid", "dim", "id", "x", F.monotonically_increasing_id().alias("q")), "ann-queries")
    probes = files_to_read(posts, known, queries, chosen, k, recall)
    posted = posts.withColumn("pivot", F.explode(F.slice("perm", 1, POSTED)))
    # a row for each pivot
    counted = posted.groupBy("dim", "pivot").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / part).cast("int"))
    sizes = materialize(counted, "ann-sizes")
    held = posted.join(F.broadcast(sizes.select("dim", "pivot", "parts")), ["dim", "pivot"])
    held = held.withColumn("part", F.pmod(F.xxhash64("cid"), "parts").cast("int"))
    place = ["dim", "pivot", "part"]
    files = materialize(held.groupBy(*place).agg(F.collect_list(F.struct("cid", "ids", "x", "perm")).alias("f")).select(*place, F.col("f.cid").alias("cids"), F.col("f.ids").alias("ids"), F.flatten("f.x").alias("xs"), F.flatten("f.perm").alias("perms")), "ann-files")
    # a query reads as many files as measured, and more where these are too small to hold LEAST entries
    lengths: dict[int, np.ndarray] = {d: np.zeros(len(p), np.int64) for d, p in chosen.items()}
    for r in sizes.collect():  # a row for each pivot
        lengths[r["dim"]][r["pivot"]] = r["n"]
    enough = POSTED * max(LEAST, 2 * k + 2)

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for dim, some, x in by_dimension(batch, "x"):
                perm = order(unit(x), chosen[dim], len(chosen[dim])).astype(np.int16)
                filled = np.cumsum(lengths[dim][perm], axis=1)
                n = np.maximum(probes[dim], (filled < enough).sum(axis=1) + 1)
                named = min(NAMED, perm.shape[1])
                reads = pa.array([p[:m] for p, m in zip(perm, n, strict=True)], pa.list_(pa.int16()))
                firsts = pa.array(list(perm[:, :named]), pa.list_(pa.int16()))
                yield pa.RecordBatch.from_arrays([*some.columns, firsts, reads], names=[*some.schema.names, "perm", "reads"])

    small_batches(spark, 2048)
    asked = queries.mapInArrow(read, widened(queries, "perm", "reads")).withColumn("pivot", F.explode("reads")).drop("reads")
    asked = asked.join(F.broadcast(sizes.select("dim", "pivot", "parts")), ["dim", "pivot"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = asked.groupBy("dim", "pivot").agg(F.ceil(F.count("*") / F.max("parts") / QUERIES).cast("int").alias("blocks"))  # a row for each pivot
    asked = asked.join(F.broadcast(blocks), ["dim", "pivot"]).withColumn("block", F.pmod(F.xxhash64("q"), "blocks").cast("int"))
    asked = asked.groupBy(*place, "block").agg(F.collect_list(F.struct("q", "cid", "id", "x", "perm")).alias("a"))
    asked = asked.select(*place, F.col("a.q").alias("q"), F.col("a.cid").alias("qcid"), F.col("a.id").alias("qid"), F.flatten("a.x").alias("qx"), F.flatten("a.perm").alias("qperm"))
    met = asked.join(files, place).select("dim", "q", "qcid", "qid", "qx", "qperm", "cids", "ids", "xs", "perms")
    schema = pa.schema([("q", pa.int64()), ("query_id", pa.int64()), ("cid", pa.int64()), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(batch.num_rows):
                dim = batch.column(0)[i].as_py()
                q, qcid, qid, qx, qperm, cids, ids, xs, perms = (batch.column(c)[i].values for c in range(1, 10))
                q, qcid, qid, cids = (c.to_numpy(zero_copy_only=False) for c in (q, qcid, qid, cids))
                qx, xs = (c.to_numpy(zero_copy_only=False).reshape(-1, dim) for c in (qx, xs))
                qperm, perms = (c.to_numpy(zero_copy_only=False).reshape(len(n), -1) for c, n in ((qperm, q), (perms, cids)))
                own, rows, step = ids.to_pylist(), [], max(1, (1 << 20) // len(cids))
                for at in range(0, len(q), step):
                    near = agreement(perms, qperm[at : at + step], len(chosen[dim]))
                    for j, line in enumerate(near, at):
                        rows += [(int(q[j]), int(qid[j]), *hit) for hit in best(own, cids, xs, line, int(qid[j]), int(qcid[j]), qx[j], k, reranked)]
                yield from batches(iter(rows), schema)

    # one meeting at a time
    sent = met.repartition(spark.sparkContext.defaultParallelism * 4)
    small_batches(spark, 4)
    found = sent.mapInArrow(run, "q long, query_id long, cid long, score double, ids array<long>")
    # an entry that several files hold has one score
    single = found.groupBy("q", "query_id", "cid").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
    nearest = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    listed = single.select("q", "query_id", "score", F.explode("ids").alias("vec_id"))
    out = materialize(listed.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "ann-nearest")
    release(known, posts, queries, sizes, files)
    return out
