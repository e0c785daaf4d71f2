"""Pack token sequences in the order of a space-filling curve.

Each document's hashed byte 4-gram vector is projected to ``DIMENSIONS``
numbers and placed on a Hilbert curve. The curve is cut into stretches that
hold about equally many documents; one shuffle brings each stretch into one
partition, in curve order, where its documents are tokenised and laid end to
end into sequences. Only the curve key is computed before the shuffle.

Documents are cut where a sequence is full. What is left at the end of a
partition is cut into sequences whose lengths are powers of two, which need no
padding. So no sequence at all is padded unless it is too short for the
pieces.

Copies share one key; the id is the second key of a stretch's ends, so a group
of copies of any size is dealt over many stretches; rows that repeat id and text
are told apart by a third, spread from their number in their task, which comes
out the same in whatever order a task reads them. A task holds one batch and one open
sequence. Its input is sorted by all its columns, so a task that runs again
makes the same pieces with the same sequence ids.

Defined results: a null or empty text gives one piece that holds the end id
alone; null ids are kept; repeated rows each get pieces of their own; an empty
table gives no pieces; other columns are left out.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import byte_letters
from .common import parts, slices, table

#: Tokens of a full sequence, the id that ends a document.
CONTEXT, END_ID = 2048, 1
#: Buckets of the hashed vector, dimensions and bits a dimension of the curve.
BUCKETS, DIMENSIONS, BITS = 1024, 4, 12
#: White-space pieces whose ids a worker remembers, beside those of one slice.
CACHE_PIECES = 600_000
SEED = 20_240_601
#: Documents whose keys decide where the stretches of the curve end.
SAMPLE = 20_000
#: A character with an id of its own, set between pieces that are encoded together.
MARK = "\x01"
#: Latin letters, which lower-casing and composition take one by one (but for the
#: dotted capital I), and the punctuation that is taken off their end.
_LATIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,;:!?%&$#*|]*)").fullmatch


@lru_cache(maxsize=1)
def projection() -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((BUCKETS, DIMENSIONS))


def hashed(text: str) -> np.ndarray:
    """The text's hashed byte 4-gram counts."""
    raw = text.encode()
    # The 4-grams that start at bytes 0, 4, 8, ..., then at 1, 5, 9, ..., and so on.
    grams = np.concatenate([np.frombuffer(raw, "<u4", max(0, len(raw) - i) // 4, min(i, len(raw))) for i in range(4)])
    return np.bincount((grams * np.uint32(0x9E3779B1)) >> np.uint32(22), minlength=BUCKETS)


def cells(points: np.ndarray) -> np.ndarray:
    """Projected points as cells of the curve's grid; the normal distribution spreads them."""
    spread = np.frompyfunc(lambda x: 0.5 * math.erfc(-x / math.sqrt(2)), 1, 1)(points).astype(float)
    return np.clip((spread * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)


def hilbert(grid: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Each row's place along the Hilbert curve through a ``bits``-bit grid.

    The coordinates are turned into the curve's transposed index by undoing the
    excess reflections from the top bit down and then Gray-encoding; the
    index's bits are read across the dimensions.
    """
    x = grid.astype(np.int64).T.copy()
    dims = len(x)
    level = np.int64(1 << (bits - 1))
    while level > 1:
        low = level - 1
        for d in range(dims):
            flip = (x[d] & level) != 0
            swap = np.where(flip, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[d] ^= swap
        level >>= 1
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn, level = np.zeros_like(x[0]), np.int64(1 << (bits - 1))
    while level > 1:
        turn ^= np.where((x[-1] & level) != 0, level - 1, 0)
        level >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> b) & 1)
    return key


def curve_keys(texts: list[str]) -> np.ndarray:
    """Each text's place on the curve; equal texts share it.

    The counts are damped by the square root and brought to unit length, which
    by then is the square root of their sum.
    """
    counts = np.array([hashed(t) for t in texts]).reshape(-1, BUCKETS)
    vectors = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
    return hilbert(cells(vectors @ projection()))


def deal(df: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc, text, curve_key, stretch): the documents with their stretch of the curve.

    Stretches lie between quantiles of (key, id, salt) over about ``sample`` rows
    drawn at random, as Spark's own range shuffle would draw them; unlike that,
    the keys of the others are computed once. The sample decides nothing but
    how even the stretches are.
    """
    spark = df.sparkSession
    wanted = 4 * parts(spark)
    n = df.count()
    drawn = df.sample(min(1.0, sample / max(n, 1)), SEED).mapInArrow(_keyed(None), _KEYED).select("curve_key", "at", "salt").collect()
    points = sorted((r[0], r[1], r[2]) for r in drawn)
    bounds = sorted({points[len(points) * i // wanted] for i in range(1, wanted)}) if points else []
    return df.mapInArrow(_keyed(bounds), _KEYED)


_KEYED = "doc long, text string, curve_key long, at long, salt long, stretch int"


def _keyed(bounds: list[tuple[int, int, int]] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeats: dict[tuple[int, int, int], int] = {}

        def salt(key: int, at: int, text: str) -> int:
            row = (key, at, hash(text))
            k = repeats[row] = repeats.get(row, -1) + 1
            return k * 0x9E3779B1 & 0xFFFFFFFF

        for batch in slices(batches):
            if not batch.num_rows:
                continue
            texts = [t or "" for t in batch.column(1).to_pylist()]
            keys = curve_keys(texts).tolist()
            at = [-(1 << 63) if d is None else d for d in batch.column(0).to_pylist()]
            salts = [salt(*x) for x in zip(keys, at, texts, strict=True)]
            stretch = [bisect_right(bounds, x) if bounds else 0 for x in zip(keys, at, salts, strict=True)]
            text = batch.column(1) if bounds is not None else pa.nulls(batch.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), text, *(pa.array(x, pa.int64()) for x in (keys, at, salts)), pa.array(stretch, pa.int32())], names=["doc", "text", "curve_key", "at", "salt", "stretch"])

    return run


class Pieces:
    """The library's ids of white-space separated pieces, remembered.

    The tokenizer drops white space and never joins across it, so a text's ids
    are those of its pieces one after the other. Only ASCII spaces and line
    ends separate here; the library sees any other white space itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.kind = np.dtype("<u2") if self.library.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.merges, self.letters = self.library.model.tokenize, byte_letters()
        self.marker = self.library.encode(MARK, add_special_tokens=False).ids[0]
        self.cache: dict[str, bytes] = {"": b""}

    def learn(self, new: list[str]) -> None:
        """Remember the ids of new pieces.

        Latin letters with or without punctuation after them are the tokens of
        the letters and then those of the punctuation, as the tokenizer never
        joins the two. Such letters are one word for its merges whatever stands
        around them, so the library's model takes them directly, lower-cased
        and in its byte alphabet. All other pieces go through the whole library.
        """
        cache, letters, merges, code = self.cache, self.letters, self.merges, self.code
        whole = []
        for w in new:
            if w.isascii() and w.isalpha():
                base, stops = w.lower(), ""
                if base == w:  # not in the cache, or it wouldn't be new
                    cache[w] = array(code, [t.id for t in merges(w)]).tobytes()
                    continue
            elif (m := _LATIN(w)) is not None and "\u0130" not in w:
                base, stops = m.groups()
                base = base.lower()
            else:
                whole.append(w)
                continue
            if (ids := cache.get(base)) is None:
                spelt = base if base.isascii() else "".join(map(letters.__getitem__, base.encode()))
                ids = cache[base] = array(code, [t.id for t in merges(spelt)]).tobytes()
            if stops:
                if stops not in cache:
                    self.ask([stops])
                ids += cache[stops]
            cache[w] = ids
        self.ask(whole)

    def ask(self, new: list[str]) -> None:
        """Encode many pieces in one call of the library, with a marker between them.

        The marker's id comes from its own character alone, so it can't come
        out of a piece without that character; the others go one by one.
        """
        width = self.kind.itemsize
        for w in [w for w in new if MARK in w]:
            self.cache[w] = np.array(self.library.encode(w, add_special_tokens=False).ids, self.kind).tobytes()
        new = [w for w in new if MARK not in w]
        for start in range(0, len(new), 2000):
            some = new[start : start + 2000]
            ids = np.array(self.library.encode_batch_fast([f" {MARK} ".join(some)], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(ids == self.marker)
            begins = np.append(0, ends + 1) * width
            raw = ids.tobytes()
            for w, a, b in zip(some, begins.tolist(), np.append(ends * width, len(raw)).tolist(), strict=True):
                self.cache[w] = raw[a:b]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's ids; copies among ``texts`` are encoded once."""
        different = list(dict.fromkeys(texts))
        split = [t.replace("\n", " ").split(" ") for t in different]
        words = list(chain.from_iterable(split))
        found = list(map(self.cache.get, words))
        if missing := [i for i, x in enumerate(found) if x is None]:
            if len(self.cache) > CACHE_PIECES:  # what this slice uses stays
                self.cache = {"": b""} | {w: x for w, x in zip(words, found, strict=True) if x is not None}
            self.learn(list({words[i] for i in missing}))
            for i in missing:
                found[i] = self.cache[words[i]]
        ends = list(accumulate(map(len, split), initial=0))
        ids = {t: np.frombuffer(b"".join(found[a:b]), self.kind) for t, a, b in zip(different, ends, ends[1:], strict=False)}
        return [ids[t] for t in texts]


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def lay(documents: Iterator[tuple[int | None, np.ndarray]], context: int, first: int) -> Iterator[tuple]:
    """Lay documents end to end: (id, start, ids, tokens of the document, sequence, offset).

    Sequences are numbered from ``first``. What is left at the end goes into
    sequences of powers of two, the longest first.
    """
    sequence, offset, open_ = first, 0, []
    for doc, ids in documents:
        at, n = 0, len(ids)
        while at < n:
            take = min(context - offset, n - at)
            open_.append((doc, at, ids[at : at + take], n, sequence, offset))
            at, offset = at + take, offset + take
            if offset == context:
                yield from open_
                sequence, offset, open_ = sequence + 1, 0, []
    while offset:
        room, used, rest = 1 << (offset.bit_length() - 1), 0, []
        for doc, at, ids, n, _, _ in open_:
            here = ids[: max(0, room - used)]
            if len(here):
                yield doc, at, here, n, sequence, used
                used += len(here)
            if len(here) < len(ids):
                rest.append((doc, at + len(here), ids[len(here) :], n, 0, 0))
        sequence, offset, open_ = sequence + 1, offset - room, rest


def pack(df: DataFrame, vocabulary: str, id_column: str = "doc_id", text: str = "text", context: int = CONTEXT, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents: id, start, length, doc_tokens, sequence_id, offset, token_ids.

    ``token_ids`` is binary: the piece's ids as little-endian unsigned 32-bit
    integers.
    """
    spark = df.sparkSession
    keyed = deal(df.select(F.col(id_column).cast("long").alias("doc"), F.col(text).alias("text")))
    dealt = keyed.repartition(parts(spark), "stretch").sortWithinPartitions("stretch", "curve_key", "doc", "salt", "text")
    schema = T.StructType(
        [T.StructField(id_column, T.LongType())]
        + [T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")]
        + [T.StructField("token_ids", T.BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, kind = pieces_of(vocabulary), None

        def documents() -> Iterator[tuple[int | None, np.ndarray]]:
            nonlocal kind
            for batch in slices(batches):
                kind = batch.schema.field(0).type
                ids = tokens.encode([t or "" for t in batch.column(1).to_pylist()])
                for doc, x in zip(batch.column(0).to_pylist(), ids, strict=True):
                    yield doc, np.append(x.astype("<u4"), np.uint32(end_id)).astype("<u4")

        def made(rows: list[tuple]) -> pa.RecordBatch:
            doc, start, ids, n, sequence, offset = zip(*rows, strict=True)
            columns = [pa.array(doc, kind), *(pa.array(x, pa.int64()) for x in (start, map(len, ids), n, sequence, offset)), pa.array([x.tobytes() for x in ids], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        rows: list[tuple] = []
        for row in lay(documents(), context, TaskContext.get().partitionId() << 40):
            rows.append(row)
            if len(rows) == 1024:
                yield made(rows)
                rows = []
        if rows:
            yield made(rows)

    return dealt.select("doc", "text").mapInArrow(run, schema)


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all documents, with a checksum in place of their ids."""
    import public_tokenizers

    out = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
