"""SimHash near-duplicates over an inverted index of byte positions.

A fingerprint has eight positional bytes. Fingerprints that differ in at most
four bits differ in at most four bytes, so they share at least four of the
eight: the guaranteed count. Lists of single positional bytes hold 1/256 of
all fingerprints each, and tallying them would take time with the square of
the corpus. So the index keeps lists for the intersections of three positions.
Any four positions contain one of ``TRIPLES``, twenty sets of three; hence
every pair that shares four positional bytes meets in some list. In a list the
shared positional bytes of every pair are counted, pairs below the guaranteed
count are dropped, and the rest are verified bit by bit. No pair is missed.

Only distinct fingerprints are indexed: copies join their class afterwards.
Within a list the members are searched breadth first, which yields a spanning
forest of its links (at most one edge a member) instead of all pairs. A list
longer than ``LIST_ROWS`` is dealt into chunks and every pair of chunks is
searched in a task of its own, so no list is collected into one task and none
is capped.

``near_duplicates`` gives the classes of linked fingerprints. ``first_copies``
gives one row of each class of texts whose sets of ``SET_WORDS``-word shingles
are alike by 0.8 or more: there the index only proposes, the sets themselves
are compared, and since fingerprints of such sets differ in about ten of 64
bits, too many for any positional byte to be sure, an exact prefix filter
(``shingles``) finds the pairs that the index can't.

Defined results: null, empty and white-space texts have fingerprint zero and
are linked like any other; texts with fewer words than a shingle are one
shingle; repeated rows stay and share their class; rows with a null id keep
their fingerprint and take the least id of their class; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shingles
from .common import cut, join_hot, parts, slices, small, table
from .graph import components

#: Words of a shingle, seed of its hash, bits in which linked fingerprints may differ.
SHINGLE_WORDS, HASH_SEED, MAX_BITS = 4, 42, 4
#: Words of a shingle where sets of shingles are compared.
SET_WORDS = 5
POSITIONS = 8
#: Positional bytes that a linked pair is sure to share.
SHARED = POSITIONS - MAX_BITS
#: Members of a list that one task compares with each other.
LIST_ROWS = 2048


def covering(positions: int = POSITIONS, four: int = SHARED, three: int = SHARED - 1) -> list[tuple[int, ...]]:
    """Sets of three positions such that any four positions contain one of them.

    The positions are split into three rings of nearly equal size; a set is
    taken if it lies in one ring or has two positions in a ring and one in the
    next.
    """
    ring = [p % 3 for p in range(positions)]
    taken = []
    for c in combinations(range(positions), three):
        n = [sum(ring[p] == r for p in c) for r in range(3)]
        if max(n) == 3 or any(n[r] == 2 and n[(r + 1) % 3] == 1 for r in range(3)):
            taken.append(c)
    assert all(any(set(t) <= set(q) for t in taken) for q in combinations(range(positions), four))
    return taken


TRIPLES = covering()


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats counted."""
    return of_hashes(shingles.hashes(text, shingle_words, HASH_SEED))


def of_hashes(found: bytes) -> int:
    """The SimHash of packed big-endian 64-bit hashes: each bit that is set in over half of them."""
    count = len(found) // 8
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), 8 * 16_384):
        some = np.frombuffer(found, np.uint8, min(8 * 16_384, len(found) - at), at)
        ones += np.unpackbits(some.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big")


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "simhash") -> DataFrame:
    """``df`` without its text, with each text's fingerprint as a signed long."""
    kept = [c for c in df.columns if c not in (text, out)]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names = batch.schema.names
            found = np.array([fingerprint(t or "") for t in batch.column(names.index(text)).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in kept), pa.array(found.view(np.int64))], names=[*kept, out])

    return df.select(*kept, text).mapInArrow(run, schema)


def postings(distinct: DataFrame, column: str) -> DataFrame:
    """(list, member): every fingerprint in its twenty lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8192):
            member = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            byte = [(member >> np.uint64(8 * p)) & np.uint64(255) for p in range(POSITIONS)]
            for k, (a, b, c) in enumerate(TRIPLES):
                key = (byte[a] << np.uint64(16)) | (byte[b] << np.uint64(8)) | byte[c] | np.uint64(k << 24)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0)], names=["list", "member"])

    return distinct.select(column).mapInArrow(run, "list long, member long")


def linked(apart: np.ndarray) -> np.ndarray:
    """Of pairs as differing bits: which share the guaranteed count of positional bytes and are verified."""
    shared = (apart.view(np.uint8).reshape(-1, POSITIONS) == 0).sum(axis=1)
    hit = shared >= SHARED
    hit[hit] = np.bitwise_count(apart[hit]) <= MAX_BITS
    return hit


def forest(members: np.ndarray, other: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``members``, or between them and ``other``.

    Breadth first: a member that has been reached isn't compared again as a
    target, so a dense list costs far less than its pairs.
    """
    sides = [members] if other is None else [members, other]
    todo = [np.arange(len(s)) for s in sides]
    edges: list[tuple[int, int]] = []

    def near(value: np.uint64, side: int) -> np.ndarray:
        if not len(todo[side]):
            return todo[side]
        hit = linked(sides[side][todo[side]] ^ value)
        found = todo[side][hit]
        todo[side] = todo[side][~hit]
        return found

    while len(todo[0]):
        start, todo[0] = todo[0][0], todo[0][1:]
        queue = [(0, start)]
        while queue:
            side, at = queue.pop()
            to = 0 if other is None else 1 - side
            value = sides[side][at]
            for x in near(value, to).tolist():
                edges.append((int(value), int(sides[to][x])))
                queue.append((to, x))
        if other is not None and not len(todo[1]):
            break
    return edges


def links(distinct: DataFrame, column: str, list_rows: int = LIST_ROWS) -> DataFrame:
    """(u, v): edges that join the same fingerprints as all links do.

    Lists are told apart by (list, chunk i, chunk j). Lists of at most
    ``list_rows`` members have the one chunk pair (0, 0).
    """
    spark = distinct.sparkSession
    index = postings(distinct, column)
    long_lists = index.groupBy("list").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > list_rows)
    # At most (members x lists / list_rows) rows; Spark broadcasts them only if they are few.
    marked = index.join(long_lists, "list", "left")
    chunks = F.ceil(F.col("n") / list_rows).cast("int")
    own = F.pmod(F.xxhash64("member"), chunks).cast("int")
    dealt = marked.select(
        "list",
        "member",
        F.when(F.col("n").isNull(), 0).otherwise(own).alias("own"),
        F.explode(F.when(F.col("n").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), chunks - 1))).alias("with"),
    ).select("list", "member", "own", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"))
    grouped = dealt.repartition(parts(spark), "list", "i", "j").sortWithinPartitions("list", "i", "j", "own", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # columns of the group that may go on in the next batch

        def search(rows: list[np.ndarray], begins: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
            member, own, i, j = rows[1].view(np.uint64), rows[2], rows[3], rows[4]
            edges: list[tuple[int, int]] = []
            # Pairs in lists of two, which are most, in one step.
            two = begins[(ends - begins == 2) & (i[begins] == j[begins])]
            hit = two[linked(member[two] ^ member[two + 1])]
            edges += zip(member[hit].tolist(), member[hit + 1].tolist(), strict=True)
            more = (ends - begins > 2) | ((ends - begins == 2) & (i[begins] != j[begins]))
            for a, b in zip(begins[more].tolist(), ends[more].tolist(), strict=True):
                if i[a] == j[a]:
                    edges += forest(member[a:b])
                else:
                    middle = a + int(np.searchsorted(own[a:b], j[a]))
                    if a < middle < b:
                        edges += forest(member[a:middle], member[middle:b])
            ends_ = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ends_[:, 0].copy()), pa.array(ends_[:, 1].copy())], names=["u", "v"])

        for batch in batches:
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("list", "member", "own", "i", "j")]
            if held:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            if not len(rows[0]):
                continue
            new = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[3][1:] != rows[3][:-1]) | (rows[4][1:] != rows[4][:-1])) + 1
            begins = np.concatenate([[0], new])
            held = [x[begins[-1] :] for x in rows]
            if len(new):
                yield search(rows, begins[:-1], begins[1:])
        if held:
            yield search(held, np.array([0]), np.array([len(held[0])]))

    return grouped.select("list", "member", "own", "i", "j").mapInArrow(run, "u long, v long")


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, simhash, component_id) for every row of ``df``."""
    hashed = cut(with_fingerprint(df.select(F.col(id_column).alias("doc"), F.col(text).alias("text")), "text"))
    classes = cut(hashed.groupBy("simhash").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("rows")))
    edges = links(classes.select("simhash"), "simhash")
    joined = small(cut(components(edges, "u", "v")))
    # The least id of a component, over its fingerprints; the others are classes of their own.
    member = classes.join(joined.withColumnRenamed("node", "simhash"), "simhash").select("simhash", "first", "root")
    least = cut(member.groupBy("root").agg(F.min("first").alias("least")))
    found = joined.join(small(least), "root").select(F.col("node").alias("simhash"), "least")
    labels = cut(classes.join(found, "simhash", "left").select("simhash", F.coalesce("least", "first").alias("component_id"), "rows"))
    return join_hot(hashed, labels, "simhash", "rows").select(F.col("doc").alias(id_column), "simhash", "component_id")


def proposed(signed: DataFrame) -> DataFrame:
    """(u, v) of ``sig``: sets with equal or linked fingerprints, joined as all their links join them."""
    heads = cut(signed.groupBy("simhash").agg(F.min("sig").alias("head")))
    equal = signed.select("simhash", "sig").join(heads, "simhash").filter("sig <> head").select(F.col("head").alias("u"), F.col("sig").alias("v"))
    at = lambda end: heads.select(F.col("simhash").alias(end), F.col("head").alias(f"{end}_head"))
    near = links(heads.select("simhash"), "simhash").join(at("u"), "u").join(at("v"), "v")
    return equal.union(near.select("u_head", "v_head")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def first_copies(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """The least ``keys`` of each class of texts that are alike by their sets of shingles.

    Rows with equal keys have equal texts.
    """
    sign = lambda found: of_hashes(found) if found else 0
    distinct, classes = shingles.classes(df.select(F.struct(*keys).alias("key"), F.col(text).alias("text")), proposed, sign, SET_WORDS, HASH_SEED)
    first = distinct.join(classes, "sig", "left").groupBy(F.coalesce("root", "sig")).agg(F.min("key").alias("first"))
    return first.select("first.*")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the least id among its near copies."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")
