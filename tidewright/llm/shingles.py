"""Sets of word shingles, and the exact search for sets that are alike.

Two texts are near copies if the Jaccard similarity of their sets of word
shingles (as 64-bit hashes) is at least ``ALIKE``.

Beside the pairs that an index proposes, the search uses a prefix filter: with
the shingles of every set in one common order, sets that are alike share a
shingle among the first ``size - ceil(0.8 size) + 1`` of each. Any common order
is right; common shingles come last, so that lists stay short. Which ones are
common is estimated from a bounded sample, and only speed depends on it.

Only distinct sets are searched. First the proposed pairs are compared and,
for every set, that with the list head (the member that is in most lists) whom
it meets in most lists; then all pairs of a list whose ends are not connected yet. So a
large group of near copies costs its members, not its pairs. Lists longer than
``LIST_ROWS`` are dealt into chunk pairs. A pair that passes is first held to
the bound that two sketches give: a sketch counts a set's shingles by bucket,
and sets share no more than the lesser counts of all buckets. What is left is
verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, slices, small
from .graph import components

#: Least similarity, as a fraction.
ALIKE = (4, 5)
#: Documents sampled for common shingles, sampled documents that make one common, common shingles at most.
SAMPLE_DOCS, COMMON_DOCS, MOST_COMMON = 5000, 3, 50_000
#: Members of a list that are paired under one key; shingles a bucket of a sketch, about.
LIST_ROWS, BUCKET = 2048, 4


def hashes(text: str, n_words: int, seed: int) -> bytes:
    """The packed big-endian hashes of a text's word shingles, repeats included.

    A-Z are lower-cased and words part at ASCII white space only. Fewer words
    than a shingle are one shingle; no words have none.
    """
    words = text.encode().lower().split()
    joined = b" ".join(words)
    if len(words) <= n_words:
        return xxhash.xxh64_digest(joined, seed) if words else b""
    begins = [0]
    for w in words:
        begins.append(begins[-1] + len(w) + 1)
    digest = xxhash.xxh64_digest
    return b"".join([digest(joined[a : b - 1], seed) for a, b in zip(begins, begins[n_words:], strict=False)])


def as_set(found: bytes) -> np.ndarray:
    """The sorted distinct hashes."""
    return np.unique(np.frombuffer(found, ">u8").astype(np.uint64))


def _signature(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes())


def _common(texts: DataFrame, n_words: int, seed: int) -> np.ndarray:
    """Shingles of many texts in a sample, the least common first."""
    every = max(texts.count() // SAMPLE_DOCS, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [as_set(hashes(t or "", n_words, seed)).view(np.int64) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], names=["shingle"])

    drawn = texts.select("text").filter(F.pmod(F.xxhash64("text", F.lit(7)), F.lit(every)) == 0)
    counted = drawn.mapInArrow(run, "shingle long").groupBy("shingle").count().filter(F.col("count") >= COMMON_DOCS)
    rows = counted.orderBy(F.desc("count"), "shingle").limit(MOST_COMMON).select("shingle").toArrow()
    return rows["shingle"].to_numpy()[::-1].astype(np.int64).view(np.uint64)


def prefix(found: np.ndarray, common: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The first shingles of a set: any two sets that are alike share one of them.

    ``common`` are the shingles that come last, in order; ``order`` sorts them by value.
    """
    rank = np.zeros(len(found), np.int64)
    if len(common):
        at = order[np.minimum(np.searchsorted(common, found, sorter=order), len(common) - 1)]
        known = common[at] == found
        rank[known] = at[known] + 1
    a, b = ALIKE
    return found[np.lexsort((found, rank))][: len(found) - -(-a * len(found) // b) + 1]


def sketch(found: np.ndarray) -> bytes:
    """A set's shingles counted by their last bits, about ``BUCKET`` a bucket; empty if a byte can't hold a count."""
    buckets = 1 << min(max(int(len(found) // BUCKET).bit_length(), 3), 14)
    counts = np.bincount((found & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else b""


def most_shared(a: bytes, b: bytes) -> float:
    """The most shingles that sets with these sketches can share."""
    if not a or not b:
        return np.inf
    x, y = (np.frombuffer(s, np.uint8).astype(np.int64) for s in sorted((a, b), key=len))
    return int(np.minimum(x, y.reshape(-1, len(x)).sum(axis=0)).sum())


def _possible(pairs: DataFrame, distinct: DataFrame) -> DataFrame:
    """The pairs (u, v) that may be alike by their sketches, materialised."""
    of = lambda end: distinct.select(F.col("sig").alias(end), F.col("n").alias(f"n_{end}"), F.col("sketch").alias(f"sketch_{end}"))
    both = pairs.join(of("u"), "u").join(of("v"), "v").select("u", "v", (F.col("n_u") + F.col("n_v")).alias("n"), "sketch_u", "sketch_v")
    a, b = ALIKE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            n, x, y = (batch.column(i).to_pylist() for i in (2, 3, 4))
            keep = [(a + b) * most_shared(s, t) >= a * k for k, s, t in zip(n, x, y, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return cut(both.mapInArrow(run, "u long, v long"))


def _signed(texts: DataFrame, common: np.ndarray, sign: Callable[[bytes], int], n_words: int, seed: int) -> DataFrame:
    """The rows of ``texts`` without text, with the set's simhash, sig, n, prefix and sketch."""
    order = np.argsort(common)
    kept = [c for c in texts.columns if c != "text"]
    added = T._parse_datatype_string("simhash long, sig long, n int, prefix array<long>, sketch binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names = batch.schema.names
            found = [hashes(t or "", n_words, seed) for t in batch.column(names.index("text")).to_pylist()]
            sets = [as_set(x) for x in found]
            firsts = [prefix(s, common, order).view(np.int64) if len(s) else [] for s in sets]
            made = [
                pa.array(np.array([sign(x) for x in found], np.uint64).view(np.int64)),
                pa.array(np.array([_signature(s) for s in sets], np.uint64).view(np.int64)),
                pa.array([len(s) for s in sets], pa.int32()),
                pa.array(firsts, pa.list_(pa.int64())),
                pa.array([sketch(s) for s in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in kept), *made], names=[*kept, *added.names])

    return texts.mapInArrow(run, T.StructType([*(texts.schema[c] for c in kept), *added.fields]))


def _sets(texts: DataFrame, n_words: int, seed: int) -> DataFrame:
    """(sig, shingles) of ``texts`` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [as_set(hashes(t or "", n_words, seed)) for t in batch.column(0).to_pylist()]
            sigs = np.array([_signature(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(sigs), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["sig", "shingles"])

    return texts.select("text").mapInArrow(run, "sig long, shingles array<long>")


def _may_alike(n_a: Column, at_a: Column, n_b: Column, at_b: Column) -> Column:
    """Whether sets may be alike whose first common shingle stands at these positions."""
    a, b = ALIKE
    most = F.least(n_a - at_a, n_b - at_b)
    return (b * F.least(n_a, n_b) >= a * F.greatest(n_a, n_b)) & ((a + b) * most >= a * (n_a + n_b))


def _verified(pairs: DataFrame, texts: DataFrame, distinct: DataFrame, n_words: int, seed: int) -> DataFrame:
    """The pairs (u, v) whose whole sets are alike, materialised.

    The sets are made again from the row that ``distinct`` names for each signature.
    """
    ends = pairs.select(F.col("u").alias("sig")).union(pairs.select(F.col("v").alias("sig"))).distinct()
    wanted = cut(distinct.join(ends, "sig").select("key"))
    # Rows that repeat a key and a text have the same set.
    sets = _sets(texts.join(small(wanted), "key", "left_semi"), n_words, seed).dropDuplicates(["sig"])
    x = sets.select(F.col("sig").alias("u"), F.col("shingles").alias("x"))
    y = sets.select(F.col("sig").alias("v"), F.col("shingles").alias("y"))
    a, b = ALIKE
    shared = F.size(F.array_intersect("x", "y"))
    return cut(pairs.join(x, "u").join(y, "v").filter((a + b) * shared >= a * (F.size("x") + F.size("y"))).select("u", "v"))


def _lists(distinct: DataFrame) -> DataFrame:
    """(sig, shingle, n, at, members, lists): the postings of lists of two sets at least."""
    postings = distinct.select("sig", "n", F.posexplode("prefix").alias("at", "shingle"))
    long = postings.groupBy("shingle").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    found = cut(postings.join(long, "shingle"))
    return cut(found.join(found.groupBy("sig").agg(F.count(F.lit(1)).alias("lists")), "sig"))


def _pairs(lists: DataFrame, list_rows: int) -> DataFrame:
    """Distinct pairs (u, v) of a list that may be alike and have different roots."""
    chunks = F.ceil(F.col("members") / list_rows).cast("int")
    own = F.pmod(F.xxhash64("sig"), chunks).cast("int")
    dealt = lists.withColumn("own", own).withColumn("last", chunks - 1)
    left = dealt.select("shingle", F.col("own").alias("i"), F.explode(F.sequence("own", "last")).alias("j"), F.col("sig").alias("u"), F.col("n").alias("n_u"), F.col("at").alias("at_u"), F.col("root").alias("root_u"))
    right = dealt.select("shingle", F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"), F.col("sig").alias("v"), F.col("n").alias("n_v"), F.col("at").alias("at_v"), F.col("root").alias("root_v"))
    met = left.join(right, ["shingle", "i", "j"]).filter((F.col("root_u") != F.col("root_v")) & ((F.col("i") < F.col("j")) | (F.col("u") < F.col("v"))))
    return met.filter(_may_alike(F.col("n_u"), F.col("at_u"), F.col("n_v"), F.col("at_v"))).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def classes(texts: DataFrame, proposed: Callable[[DataFrame], DataFrame], sign: Callable[[bytes], int], n_words: int, seed: int, list_rows: int = LIST_ROWS) -> tuple[DataFrame, DataFrame]:
    """(sig, key) with the least key of every set of ``texts`` (key, text), and (sig, root) of all sets that are alike with another.

    Rows with one key have one text. ``proposed`` gives, from (sig, simhash),
    pairs (u, v) to compare first.
    """
    signed = _signed(texts, _common(texts, n_words, seed), sign, n_words, seed)
    distinct = cut(signed.groupBy("sig").agg(F.first("simhash").alias("simhash"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"), F.min("key").alias("key")))
    lists = _lists(distinct)
    head = lists.groupBy("shingle").agg(F.max(F.struct("lists", "sig", "n", "at")).alias("head"))
    star = lists.join(head, "shingle").filter((F.col("sig") != F.col("head.sig")) & _may_alike(F.col("n"), F.col("at"), F.col("head.n"), F.col("head.at")))
    met = star.groupBy("sig", F.col("head.sig").alias("u")).agg(F.count(F.lit(1)).alias("met"))
    best = met.groupBy("sig").agg(F.max_by("u", F.struct("met", "u")).alias("u"))
    first = cut(best.select(F.least("u", "sig").alias("u"), F.greatest("u", "sig").alias("v")).union(proposed(distinct)).distinct())
    near = _verified(_possible(first, distinct), texts, distinct, n_words, seed)
    roots = cut(components(near, "u", "v")).select(F.col("node").alias("sig"), "root")
    rest = lists.join(small(roots), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    pairs = _possible(_pairs(rest, list_rows).join(first, ["u", "v"], "left_anti"), distinct)
    if not pairs.isEmpty():
        more = _verified(pairs, texts, distinct, n_words, seed)
        roots = cut(components(near.union(more), "u", "v")).withColumnRenamed("node", "sig")
    return distinct.select("sig", "key"), small(roots)
