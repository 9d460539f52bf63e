"""Document fingerprints by Order MinHash, in Spark SQL functions alone.

A text is cut into tokens, runs of up to eight characters without white space. Its
k-mers are every ``K`` tokens in a row, numbered by occurrence, so that the second
time a k-mer occurs it counts as another. All are hashed once; the leading bits of
the hash deal them into ``PARTS`` parts, and in each part the ``LEAST`` smallest
are taken, put back into the order they have in the text and hashed as a tuple.
The parts' hashes are the signature. Two texts share a part's hash where both the
k-mers and their order agree, which follows edit distance where plain MinHash sees
only sets. A part without k-mers takes the hash of the next part that has one.

Everything is done on arrays within the row: a hash and a position share one long,
so that one sort brings equal k-mers together by position, and the number of an
occurrence is its distance from the first, found by doubling steps. No row is
exploded and nothing is shuffled for a fingerprint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 3
LEAST = 2
PARTS = 64
TOKEN = r"\S{1,8}"
#: Of a long: 35 bits of hash above 28 bits of position; the sign stays clear.
POSITION_BITS = 28
PART_SHIFT = 63 - 6
#: Rows whose successors are looked up together, and how many such ranges at most.
RANGE, RANGES = 2000, 10_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hash(packed: Column) -> Column:
    return F.shiftright(packed, POSITION_BITS)


def _part(packed: Column) -> Column:
    return F.shiftright(packed, PART_SHIFT)


def _pack(hashed: Column, position: Column) -> Column:
    high = F.shiftleft(F.shiftrightunsigned(hashed, 64 - (63 - POSITION_BITS)), POSITION_BITS)
    return high.bitwiseOR(F.least(position.cast("long"), F.lit((1 << POSITION_BITS) - 1)))


def _kmers(words: Column) -> Column:
    """Sorted (hash, position) of each k-mer; all tokens at once where there are fewer."""
    each = F.transform(words, lambda w, i: _pack(F.xxhash64(w, *[F.get(words, i + k) for k in range(1, K)]), i))
    return F.sort_array(F.slice(each, F.lit(1), F.greatest(F.size(words) - (K - 1), F.lit(1))))


def _numbered(kmers: Column) -> Column:
    """The k-mers after the first of their kind get a hash of their own, by occurrence."""
    again = F.filter(F.sequence(F.lit(1), F.size(kmers) - 1), lambda i: _hash(F.get(kmers, i)) == _hash(F.get(kmers, i - 1)))
    again = F.when(F.size(kmers) > 1, again).otherwise(F.array().cast("array<int>"))
    steps = F.filter(F.array(*[F.lit(1 << k) for k in range(POSITION_BITS - 1, -1, -1)]), lambda s: s < F.size(kmers))

    def renamed(steps: Column, i: Column) -> Column:
        me = F.get(kmers, i)
        first = F.aggregate(steps, i, lambda at, s: F.when((at >= s) & (_hash(F.get(kmers, at - s)) == _hash(me)), at - s).otherwise(at))
        return _pack(F.xxhash64(_hash(me), i - first), me.bitwiseAND(F.lit((1 << POSITION_BITS) - 1)))

    def merged(dups: Column) -> Column:
        firsts = F.filter(kmers, lambda x, i: (i == 0) | (_hash(x) != _hash(F.get(kmers, i - 1))))
        others = let(steps, lambda s: F.transform(dups, lambda i: renamed(s, i)))
        return F.when(F.size(dups) == 0, kmers).otherwise(F.sort_array(F.concat(firsts, others)))

    return let(again, merged)


def _tuples(kmers: Column) -> Column:
    """(part, hash of its tuple) for each part that has k-mers, in order of parts."""

    def of(least: Column) -> Column:
        low = F.lit((1 << POSITION_BITS) - 1)

        def one(x: Column, i: Column) -> Column:
            y = F.get(least, i + 1)
            two = _part(x) == _part(y)
            turned = two & (y.bitwiseAND(low) < x.bitwiseAND(low))
            a = F.when(turned, _hash(y)).otherwise(_hash(x))
            b = F.when(two, F.when(turned, _hash(x)).otherwise(_hash(y)))
            code = F.xxhash64(a, b).bitwiseAND(F.lit(0xFFFF))
            return F.when((i == 0) | (_part(x) != _part(F.get(least, i - 1))), F.shiftleft(_part(x), 16).bitwiseOR(code))

        return F.filter(F.transform(least, one), lambda x: x.isNotNull())

    return let(F.filter(kmers, lambda x, i: (i < LEAST) | (_part(x) != _part(F.get(kmers, i - LEAST)))), of)


def _filled(tuples: Column) -> Column:
    """A hash for every part: its own, or the next part's that has one, going round."""

    def of(j: Column) -> Column:
        later = F.get(F.filter(tuples, lambda x: F.shiftright(x, 16) >= j), F.lit(0))
        return F.coalesce(later, F.get(tuples, F.lit(0)), F.lit(0).cast("long"))

    sparse = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), of)
    full = F.when(F.size(tuples) == PARTS, tuples).otherwise(sparse)
    return F.transform(full, lambda x: x.bitwiseAND(F.lit(0xFFFF)).cast("int"))


def signature(text: Column) -> Column:
    """``PARTS`` numbers of 16 bits; all 0 for a text without tokens (null included)."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    return let(let(let(let(words, _kmers), _numbered), _tuples), _filled)


def written(sig: Column) -> Column:
    """A signature as lower-case hex."""
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x)), 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1: the share of equal parts, its root of ``LEAST`` taken, as a part needs that many k-mers to agree."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return F.pow(equal / F.lit(PARTS), F.lit(1.0 / LEAST))


def with_next(rows: DataFrame, key: str, carried: list[str], text: str) -> DataFrame:
    """Each row with ``next``, a struct of the ``carried`` columns of the row after it.

    The order is by ``key`` descending, nulls last, then by ``text``; after the
    last row comes the first. Ranges of the key are ordered on their own. The first
    rows of each range are also sent to the range before it, so no range has to
    wait for another and none holds more than its rows.
    """
    spark = rows.sparkSession
    n = rows.select(key).count()
    many = min(RANGES, -(-n // RANGE))
    cuts = rows.select(F.percentile_approx(key, [k / many for k in range(1, many)], 100_000)).first()[0] if many > 1 else []
    cuts = sorted(set(cuts or []), reverse=True)
    steps = F.array(*[F.lit(1 << k) for k in range(max(1, len(cuts)).bit_length() - 1, -1, -1)])
    at = F.array(*map(F.lit, cuts)).cast("array<long>")
    # how many cuts lie above the key, by doubling steps
    found = F.aggregate(steps, F.lit(0), lambda k, s: F.when((k + s <= len(cuts)) & (F.get(at, k + s - 1) > F.col(key)), k + s).otherwise(k)) if cuts else F.lit(0)
    ranged = rows.withColumn("_range", F.when(F.col(key).isNull(), len(cuts) + 1).otherwise(found))
    heads = sorted((r["_range"], r["head"]) for r in ranged.groupBy("_range").agg(F.max(key).alias("head")).collect())  # at most RANGES + 2
    before = spark.createDataFrame([(r, h, heads[k - 1][0]) for k, (r, h) in enumerate(heads)], "_range int, _head long, _before int")
    led = ranged.join(F.broadcast(before), "_range")
    own, sent = F.struct(F.col("_range").alias("r"), F.lit(False).alias("sent")), F.struct(F.col("_before").alias("r"), F.lit(True).alias("sent"))
    to = F.explode(F.when(F.col(key).eqNullSafe(F.col("_head")), F.array(own, sent)).otherwise(F.array(own)))
    dealt = led.select(*rows.columns, to.alias("_to")).select(*rows.columns, F.col("_to.r").alias("_r"), F.col("_to.sent").alias("_sent"))
    after = Window.partitionBy("_r").orderBy("_sent", F.desc_nulls_last(key), text)
    return dealt.withColumn("next", F.lead(F.struct(*carried)).over(after)).where(~F.col("_sent")).drop("_r", "_sent")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The edited text is the text with its last third (rounded down) replaced by as
    many of the first code points of the next document, or all it has; the next is
    the one after it by descending key (rows of one key by their text, null keys
    last), and after the last comes the first, so a lone row is its own next. A
    null text counts as empty; an empty text is like an empty text only. Repeated
    rows come out as often as they went in, an empty table gives no rows, other
    columns are neither read nor returned.
    """
    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    signed = base.withColumn("sig", signature(F.col("text")))
    paired = with_next(signed, "doc_id", ["text", "sig"], "text")
    n = F.length("text").cast("long")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - third), F.substring(F.col("next.text"), F.lit(1), third))
    made = paired.select("doc_id", n.alias("n_chars"), "sig", F.col("next.sig").alias("next_sig"), edited.alias("edited"))
    made = made.withColumn("edited_sig", F.when(F.lit(True), signature(F.col("edited"))))
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written(F.col("sig")).alias("fingerprint"),
        written(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
