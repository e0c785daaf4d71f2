"""Byte-level BPE: speculate with greedy longest match, verify, mend the rest.

A sequence of tokens is the BPE encoding of its bytes exactly when every
adjacent pair is the encoding of the pair's own bytes. So a word is first cut
greedily into the longest vocabulary entries; then one vectorised pass looks
every adjacent pair of every new word up in the table of compatible pairs
(a pair that is met for the first time is decided by merging its few bytes);
only words with an incompatible pair go through the exact merges.

Words are cached per worker within a fixed bound, so memory does not follow
the corpus. Rows are independent: the operator is one narrow pass, without a
shuffle, and a lost task is simply run again.

Defined results: null text encodes like the empty text (no ids, decoded to the
empty text); very long texts are encoded whole; the strings of special tokens
in a text become the special ids, as in the library's default; repeated rows
and extra columns of any name pass through unchanged.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, table

#: Words (beside those of one slice) and pairs a worker remembers at most.
CACHE_WORDS = 400_000
CACHE_PAIRS = 400_000
#: The rank of a pair that never merges.
_NEVER = 1 << 62

# The split pattern of byte-level BPE and Unicode's white space.
_SPACE = r"\t-\r \x85\xa0  -     　"
_SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + _SPACE + r"\p{L}\p{N}]+"
    r"|[" + _SPACE + r"]+(?![^" + _SPACE + r"])|[" + _SPACE + r"]+"
)


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in vocabulary files.

    Printable Latin-1 bytes stand for themselves, the others take the code
    points from 256 on in ascending order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ByteBPE:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        of_letter = {c: b for b, c in byte_letters().items()}
        vocab: dict[str, int] = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.id_of = {bytes(of_letter[c] for c in s): i for s, i in vocab.items()}
        self.bytes_of: list[bytes] = [b""] * self.size
        for s, i in self.id_of.items():
            self.bytes_of[i] = s
        # A pair of ids as one number; its rank is its place among the merges, which gives the id that it becomes.
        self.rank = {vocab[a] << 32 | vocab[b]: r for r, (a, b) in reversed(list(enumerate(pairs)))}
        self.becomes = [vocab[a + b] for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.by_byte = [self.id_of[bytes([b])] for b in range(256)]
        # A token that merging its own bytes does not give can never be proposed.
        self.proposals = {s: i for s, i in self.id_of.items() if self.merge(s) == [i]}
        self.reach: dict[bytes, int] = {}
        for s in self.proposals:
            self.reach[s[:3]] = max(self.reach.get(s[:3], 2), len(s))
        self.words = regex.compile(_SPLIT)
        self.apart = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # No word of the split pattern can be a special string: those are cut out before.
        self.cache: dict[str, bytes] = {s: i.to_bytes(4, "little") for s, i in self.special.items()}
        self.compatible: dict[int, bool] = {}

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the pair of the lowest rank first, leftmost of equals."""
        ids, rank = [self.by_byte[b] for b in word], self.rank.get
        ranks = [rank(a << 32 | b, _NEVER) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (low := min(ranks)) < _NEVER:
            i = ranks.index(low)
            ids[i] = self.becomes[low]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(ids[i] << 32 | ids[i + 1], _NEVER)
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 32 | ids[i], _NEVER)
        return ids

    def long_merge(self, word: bytes) -> list[int]:
        """Exact merging for long words: a heap of pairs over linked positions."""
        import heapq

        ids: list[int] = [self.by_byte[b] for b in word]
        n = len(ids)
        before, after, heap = list(range(-1, n - 1)), [*range(1, n), -1], []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (r := self.rank.get(ids[i] << 32 | ids[j])) is not None:
                heapq.heappush(heap, (r, i, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = self.becomes[r], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [t for t in ids if t >= 0]

    def greedy(self, word: bytes) -> list[int]:
        """The longest proposal from the left, again and again."""
        out, at, end, known, reach = [], 0, len(word), self.proposals, self.reach
        while at < end:
            stop = min(end, at + reach.get(word[at : at + 3], 2))
            while stop > at + 1 and word[at:stop] not in known:
                stop -= 1
            out.append(known[word[at:stop]])
            at = stop
        return out

    def learn(self, new: list[str]) -> None:
        """Put the encodings of ``new`` words into the cache."""
        raw = [w.encode() for w in new]
        guess = [self.greedy(w) for w in raw]
        sizes = np.fromiter(map(len, guess), np.int64, len(guess))
        flat = np.fromiter(chain.from_iterable(guess), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(guess)), sizes)
        inside = np.flatnonzero(owner[:-1] == owner[1:]) if len(flat) else np.zeros(0, np.int64)
        keys, back = np.unique(flat[inside] * self.size + flat[inside + 1], return_inverse=True)
        fits = np.fromiter(map(self.fits, keys.tolist()), bool, len(keys))
        failing = np.unique(owner[inside[~fits[back]]])
        for i in failing.tolist():
            guess[i] = self.merge(raw[i]) if len(raw[i]) <= 64 else self.long_merge(raw[i])
        for w, ids in zip(new, guess, strict=True):
            self.cache[w] = np.array(ids, "<u4").tobytes()

    def fits(self, key: int) -> bool:
        """Whether merging the bytes of the pair gives the pair."""
        if (known := self.compatible.get(key)) is None:
            a, b = divmod(key, self.size)
            if len(self.compatible) >= CACHE_PAIRS:
                self.compatible.clear()
            known = self.compatible[key] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def pieces(self, text: str) -> list[str]:
        """The words of a text; the strings of special tokens are words of their own."""
        if self.apart is None or not any(s in text for s in self.special):
            return self.words.findall(text)
        return [x for part in self.apart.split(text) for x in ([part] if part in self.special else self.words.findall(part))]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        different = list(dict.fromkeys(texts))
        split = [self.pieces(t) for t in different]
        words = list(chain.from_iterable(split))
        found = list(map(self.cache.get, words))
        if missing := [i for i, x in enumerate(found) if x is None]:
            if len(self.cache) > CACHE_WORDS:  # what this slice uses stays
                self.cache = {s: i.to_bytes(4, "little") for s, i in self.special.items()} | {w: x for w, x in zip(words, found, strict=True) if x is not None}
            self.learn(list({words[i] for i in missing}))
            for i in missing:
                found[i] = self.cache[words[i]]
        ends = list(accumulate(map(len, split), initial=0))
        ids = {t: b"".join(found[a:b]) for t, a, b in zip(different, ends, ends[1:], strict=False)}
        return [ids[t] for t in texts]

    def decode(self, packed: bytes) -> str:
        """The text of packed ids, special tokens included."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def model(path: str) -> ByteBPE:
    return ByteBPE(path)


def encode_decode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the packed token ids of its text and the text they decode to.

    ``ids`` is binary: little-endian unsigned 32-bit integers. ``text`` itself is
    left out of the result; every other column stays (one named like an
    output column is replaced).
    """
    kept = [c for c in df.columns if c not in (text, ids, decoded)]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(vocabulary)
        for batch in slices(batches):
            packed = bpe.encode([t or "" for t in batch.column(batch.schema.names.index(text)).to_pylist()])
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(names.index(c)) for c in kept), pa.array(packed, pa.binary()), pa.array(map(bpe.decode, packed), pa.string())],
                names=[*kept, ids, decoded],
            )

    return df.select(*kept, text).mapInArrow(run, schema)


def unpack(ids):
    """A column of packed ids as an array of integers (for small results)."""
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(ids) / 4, F.lit(1)).cast("int")),
        lambda i: F.conv(F.hex(F.reverse(F.substring(ids, i * 4 - 3, 4))), 16, 10).cast("long"),
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and round trip as digests."""
    import public_tokenizers

    out = encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
