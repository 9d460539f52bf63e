"""Near-duplicate groups by SimHash, compared exactly in tiles.

A document's fingerprint has a bit for each of 64 positions, set where more than
half of its word shingles' hashes have it set. Distinct fingerprints are sorted
into classes by the bit counts of their two halves, classes are cut into tiles of
bounded size, and two tiles meet only where their bit counts differ by no more
than the radius, since any pair beyond differs in more bits than that. Within a
pair of tiles numpy compares all fingerprints by exclusive-or and bit counts.
No pair within the radius is missed.

Size: a pair of tiles yields at most a spanning forest of its links, never all
pairs of a group. Exact copies are one fingerprint. The comparisons themselves
grow with the square of the distinct fingerprints (less what is skipped), spread
over tasks by pairs of tiles; no task holds more than two tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.common import batches, columns, materialize, release, small_batches
from prosegauge.llm.graph import components

SEED = 42
WIDTH = 4
RADIUS = 4
TILE = 4096


def shingle_hashes(text: str | None, width: int = WIDTH, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of ``width`` words, A-Z lower-cased, joined by one space.

    Fewer words: one run of all of them. No words (or null): no hashes. Words are
    what lies between the six ASCII white-space characters.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    m = max(1, n - width + 1)
    cuts = zip(starts[:m].tolist(), ends[min(width, n) - 1 :].tolist(), strict=True)
    return np.fromiter((h(line[a:b], seed) for a, b in cuts), np.uint64, m)


def fingerprint(hashes: np.ndarray) -> int:
    """64 bits, each set where over half of the hashes have it; 0 without hashes."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``(doc_id, fp)``, fp the fingerprint's 64 bits as a signed long; a row for each row of ``docs``."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, texts = columns(batch, "doc_id", "text")
            yield from batches(((i, _signed(fingerprint(shingle_hashes(t, width)))) for i, t in zip(ids, texts, strict=True)), schema)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def linked(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles (or within one): node, its root."""
    every = a if b is None else np.concatenate((a, b))
    against, shift = (a, 0) if b is None else (b, len(a))
    label = np.arange(len(every))
    step = max(1, (1 << 19) // max(1, len(against)))
    for at in range(0, len(a), step):
        near = np.bitwise_count(a[at : at + step, None] ^ against[None, :]) <= radius
        if b is None:
            hit = np.flatnonzero(near.sum(axis=1) > 1)
        else:
            hit = np.flatnonzero(near.any(axis=1))
        for i in hit:
            met = np.unique(label[np.append(np.flatnonzero(near[i]) + shift, at + i)])
            if len(met) > 1:
                label[np.isin(label, met)] = met[0]
    moved = np.flatnonzero(label != np.arange(len(every)))
    return every[moved], every[label[moved]]


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``distinct(fp)`` -> a table of ``edges(src, dst)`` that connect exactly what links within the radius connect."""
    spark = distinct.sparkSession
    low = F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    classed = distinct.select("fp", low.cast("int").alias("lo"), F.bit_count(F.shiftrightunsigned("fp", 32)).cast("int").alias("hi"))
    # at most 33 x 33 rows: one for each pair of bit counts
    sizes = classed.groupBy("lo", "hi").agg(F.ceil(F.count("*") / tile).cast("int").alias("cuts"))
    cut = classed.join(F.broadcast(sizes), ["lo", "hi"]).withColumn("cut", F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int"))
    tiles = materialize(cut.groupBy("lo", "hi", "cut").agg(F.collect_list("fp").alias("fps")), "simhash-tiles")
    span = range(-radius, radius + 1)
    ahead = [(x, y) for x in span for y in span if abs(x) + abs(y) <= radius and (x, y) >= (0, 0)]
    step = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ahead]))
    left = tiles.select(F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"), F.col("cut").alias("cut_a"), F.col("fps").alias("a"))
    here = left.select("lo_a", "hi_a", "cut_a", step.alias("s")).select("*", (F.col("lo_a") + F.col("s.x")).alias("lo"), (F.col("hi_a") + F.col("s.y")).alias("hi"))
    # which tiles meet is settled on their names; the contents follow once for each meeting
    meet = here.join(tiles.select("lo", "hi", "cut"), ["lo", "hi"]).where("lo <> lo_a or hi <> hi_a or cut >= cut_a").drop("s")
    meet = materialize(meet, "simhash-meet")
    pairs = meet.join(left, ["lo_a", "hi_a", "cut_a"]).join(tiles.withColumnRenamed("fps", "b"), ["lo", "hi", "cut"])
    same = F.expr("lo = lo_a and hi = hi_a and cut = cut_a")
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for k in range(batch.num_rows):
                a, b = (np.ascontiguousarray(batch.column(n)[k].values.to_numpy(zero_copy_only=False)).view(np.uint64) for n in (0, 1))
                src, dst = linked(a, None if batch.column(2)[k].as_py() else b, radius)
                if len(src):
                    yield pa.RecordBatch.from_arrays([pa.array(src.view(np.int64)), pa.array(dst.view(np.int64))], schema=schema)

    small_batches(spark, 64)
    made = materialize(pairs.select("a", "b", same.alias("same")).repartition(spark.sparkContext.defaultParallelism * 4).mapInArrow(run, "src long, dst long"), "simhash-links")
    release(tiles, meet)
    return made


def groups(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``prints(doc_id, fp)`` -> ``(doc_id, fp, component_id)``: the smallest doc_id reachable by links.

    Rows are kept one for one: repeated rows and equal doc_ids come out as often
    as they went in. A row without doc_id takes part but gives no component its
    name; a component of such rows alone has a null component_id.
    """
    known = links(prints.select("fp").distinct(), radius, tile)
    roots = components(known)
    release(known)
    rooted = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialize(rooted.select("doc_id", "fp", "root"), "simhash-rooted")
    names = materialize(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "simhash-names")
    return rooted.join(names, "root").select("doc_id", "fp", "component_id")


def hexadecimal(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """A row for each document: ``doc_id, fingerprint, component_id``.

    Texts that are null, empty or hold no word have fingerprint zero and are
    linked like any other. An empty table gives no rows. Other columns of
    ``docs`` are neither read nor returned.
    """
    prints = materialize(fingerprints(docs, key, text, width), "simhash-prints")
    return groups(prints, radius).select("doc_id", hexadecimal().alias("fingerprint"), "component_id")
