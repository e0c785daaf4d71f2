"""Language identification: the family first, then the language within it.

Texts are hashed letter 2- and 3-gram profiles. Languages whose mean profiles
are most alike form families (average linkage, about the square root of their
number). A softmax classifier predicts the family; within it, one linear
support vector machine for each pair of languages votes, margins breaking
ties.

Learning reads about ``MAX_DOCS`` different texts a language, chosen by a hash
of the text, so rows that repeat a text or an id add nothing to it. Their
profiles (``2 * BUCKETS`` small numbers each) meet in one task, which fits the
machines; only these reach the driver. Prediction is one narrow pass over
whole texts.

Defined results: null text and text without a letter (Unicode category L) are
``und`` with score 0; rows with a null language are never learnt from; with
one language, it is predicted for every text with a letter; without any,
``und``; repeated rows get equal results and are learnt once; other columns
pass through (ones named like an output are replaced); an empty table gives an
empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, slices, table

#: Texts a language (in expectation) that learning uses; buckets of either profile.
MAX_DOCS, BUCKETS = 800, 1024
PENALTY, STEPS, SEED = 1e-4, 300, 11
NONE = "und"

_LETTER = regex.compile(r"\p{L}")
_PLAIN = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def profile(text: str) -> np.ndarray:
    """The damped, normalised counts of hashed byte 2- and 3-grams of the letters."""
    raw = np.frombuffer(b" " + text.lower().encode().translate(_PLAIN) + b" ", np.uint8).astype(np.uint32)
    two = raw[:-1] | raw[1:] << np.uint32(8)
    three = two[:-1] | raw[2:] << np.uint32(16)
    # White space runs carry nothing.
    two = two[two != 0x2020]
    out = np.empty(2 * BUCKETS)
    shift = np.uint32(32 - 10)
    out[:BUCKETS] = np.bincount((two * np.uint32(0x9E3779B1)) >> shift, minlength=BUCKETS)
    out[BUCKETS:] = np.bincount((three * np.uint32(0x85EBCA77)) >> shift, minlength=BUCKETS)
    out = np.sqrt(out)
    return out / max(float(np.sqrt(out @ out)), 1e-9)


def families(means: dict[str, np.ndarray]) -> list[list[str]]:
    """Languages in groups of like mean profiles: average linkage down to about their square root."""
    centre = np.mean(list(means.values()), axis=0)
    at = {k: (v - centre) / max(float(np.linalg.norm(v - centre)), 1e-9) for k, v in means.items()}
    groups = [[k] for k in sorted(means)]
    while len(groups) > max(1, round(len(means) ** 0.5)):
        alike = {(i, j): float(np.mean([at[a] @ at[b] for a in groups[i] for b in groups[j]])) for i, j in combinations(range(len(groups)), 2)}
        i, j = max(alike, key=lambda p: (alike[p], -p[0], -p[1]))
        groups[i] += groups.pop(j)
    return groups


def softmax_fit(x: np.ndarray, y: np.ndarray, classes: int) -> np.ndarray:
    """Weights of a softmax classifier by accelerated gradient steps; classes count alike."""
    w = np.zeros((x.shape[1], classes), x.dtype)
    ahead, share = w.copy(), 1 / np.bincount(y, minlength=classes)[y]
    share = (share / share.sum()).astype(x.dtype)
    for step in range(STEPS):
        z = x @ ahead
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        new = ahead - 4.0 * (x.T @ (p * share[:, None]) + PENALTY * ahead)
        ahead, w = new + step / (step + 3) * (new - w), new
    return w.astype(np.float64)


def svm_fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A linear machine with squared hinge loss; ``y`` is 1 or -1, classes count alike."""
    w = np.zeros(x.shape[1], x.dtype)
    y = y.astype(x.dtype)
    ahead, share = w.copy(), (np.where(y > 0, 1 / max((y > 0).sum(), 1), 1 / max((y < 0).sum(), 1)) / 2).astype(x.dtype)
    for step in range(STEPS):
        short = np.maximum(0, 1 - y * (x @ ahead))
        new = ahead - 0.25 * (x.T @ (-2 * share * y * short) + PENALTY * ahead)
        ahead, w = new + step / (step + 3) * (new - w), new
    return w.astype(np.float64)


@dataclass
class Hierarchy:
    groups: list[list[str]]
    family: np.ndarray
    pairs: dict[tuple[str, str], np.ndarray]

    def predict(self, rows: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The language and score of each profile."""
        if not self.groups:
            return [NONE] * len(rows), np.zeros(len(rows))
        rows = np.hstack([rows, np.ones((len(rows), 1))])
        z = rows @ self.family
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        names, score = np.empty(len(rows), object), p.max(axis=1)
        for g, group in enumerate(self.groups):
            mine = np.flatnonzero(best == g)
            votes, margin = np.zeros((len(mine), len(group))), np.zeros((len(mine), len(group)))
            for i, j in combinations(range(len(group)), 2):
                m = rows[mine] @ self.pairs[group[i], group[j]]
                votes[:, i] += m > 0
                votes[:, j] += m <= 0
                margin[:, i] += m
                margin[:, j] -= m
            rank = votes + 0.5 * np.tanh(margin)
            won = rank.argmax(axis=1)
            names[mine] = np.array(group, object)[won]
            if len(group) > 1:
                score[mine] *= 1 / (1 + np.exp(-4 * np.clip(margin[np.arange(len(mine)), won] / (len(group) - 1), -8, 8)))
        return names.tolist(), score


def fit(x: np.ndarray, names: list[str]) -> Hierarchy:
    languages = sorted(set(names))
    if not languages:
        return Hierarchy([], np.zeros((2 * BUCKETS + 1, 1)), {})
    named = np.array(names, object)
    groups = families({k: x[named == k].mean(axis=0) for k in languages})
    member = {k: g for g, group in enumerate(groups) for k in group}
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    family = softmax_fit(x, np.array([member[k] for k in names]), len(groups))
    pairs = {}
    for group in groups:
        for a, b in combinations(group, 2):
            two = (named == a) | (named == b)
            pairs[a, b] = svm_fit(x[two], np.where(named[two] == a, 1.0, -1.0))
    return Hierarchy(groups, family, pairs)


def learn(df: DataFrame, may_learn: Column, text: str = "text", lang: str = "lang", max_docs: int = MAX_DOCS) -> Hierarchy:
    """Learn from the rows of ``df`` with a language that ``may_learn`` admits."""
    known = df.filter(may_learn & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return fit(np.zeros((0, 2 * BUCKETS), np.float32), [])
    same = F.xxhash64("text", F.lit(SEED))
    rates = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(max_docs / n))])
    some = known.withColumn("same", same).filter(F.pmod("same", F.lit(1 << 30)) / float(1 << 30) < rates[F.col("lang")])

    def profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = [(k, h, profile(t).astype(np.float32).tobytes()) for t, k, h in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), strict=True) if t and _LETTER.search(t)]
            k, h, x = zip(*keep, strict=True) if keep else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(h, pa.int64()), pa.array(x, pa.binary())], names=["lang", "same", "x"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), strict=True))
        names, packed = [r[0] for r in rows], b"".join(r[2] for r in rows)
        del rows
        model = fit(np.frombuffer(packed, np.float32).reshape(-1, 2 * BUCKETS), names)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    profiles = some.select("text", "lang", "same").mapInArrow(profiled, "lang string, same long, x binary")
    different = profiles.groupBy("lang", "same").agg(F.first("x").alias("x"))
    return pickle.loads(different.repartition(1).mapInArrow(fitted, "model binary").first()["model"])


def predict(df: DataFrame, model: Hierarchy, text: str = "text", out: str = "lang_pred", score: str = "lang_score", drop_text: bool = False) -> DataFrame:
    """``df`` with every text's language and score."""
    kept = [c for c in df.columns if c not in (out, score) and not (drop_text and c == text)]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(out, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names = batch.schema.names
            texts = [t or "" for t in batch.column(names.index(text)).to_pylist()]
            found, scores = model.predict(np.array([profile(t) for t in texts]).reshape(-1, 2 * BUCKETS))
            letters = [bool(_LETTER.search(t)) for t in texts]
            found = [k if ok else NONE for k, ok in zip(found, letters, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in kept), pa.array(found, pa.string()), pa.array(np.where(letters, scores, 0.0))], names=[*kept, out, score])

    return df.select(*dict.fromkeys([*kept, text])).mapInArrow(run, schema)


def held_out(id_column: str = "doc_id") -> Column:
    """The fold that is never learnt from."""
    return F.coalesce(fold(id_column, 4) == 2, F.lit(False))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, ~held_out())
    out = predict(docs.select("doc_id", "text"), model, score="score", drop_text=True)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
