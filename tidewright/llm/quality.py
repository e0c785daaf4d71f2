"""Document quality by Bradley-Terry ranking of labelled pairs.

A document's strength is a linear function of scale-free features of its whole
text (shares of character kinds, repeats of words and lines, word lengths). It
is learnt from preference pairs, a good document over a bad one, by logistic
loss on the difference of their features. The threshold is the quantile of the
strengths, over all labelled documents that may be learnt from, that their
share of bad labels asks for: midway between the strength at that quantile and
the next. The score is the logistic function of the strength above it.

The weights are learnt from about ``MAX_LABELLED`` labelled ids a class, chosen
by a hash of the id; only their features reach the driver. The quantile covers
all labelled documents and is a Spark aggregate. Scoring is one narrow pass.

Defined results: null text is the empty text, whose features are all zero and
which is scored like any other; labels that are null or neither 0 nor 1 are
ignored, as are ids labelled both 0 and 1 and null ids; repeated labels of an
id count once; of rows that repeat an id the one with the least features is
learnt, while all of them count in the quantile; without labelled documents of
both classes every score is 0.5; repeated rows get equal scores; other columns
pass through (one named like the score is replaced); an empty table gives an
empty result.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fold, slices, table

#: Labelled documents a class (in expectation) and preference pairs that learning uses at most.
MAX_LABELLED, PAIRS = 8000, 30_000
RIDGE, STEPS, SEED = 1e-3, 60, 7
#: Ranks that the approximate quantile tells apart.
RANKS = 100_000

_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
_MARKS = [ord(c) for c in "!?|#$%&*,.;:-_/\\()[]{}<>@=+~^'\""]
FEATURES = 16 + len(_MARKS)


def features(text: str) -> np.ndarray:
    """Scale-free features of a whole text."""
    x = np.zeros(FEATURES)
    if not text:
        return x
    raw = np.frombuffer(text.encode(), np.uint8)
    n = np.bincount(raw, minlength=256) / len(raw)
    words, lines = text.split(), text.split("\n")
    upper, lower, other = n[_UPPER].sum(), n[_LOWER].sum(), n[128:].sum()
    letters = max(upper + lower + other, 1e-9)
    x[0:8] = 1, upper / letters, lower / letters, other / letters, n[_DIGIT].sum(), n[32], n[10], letters
    if words:
        k = len(words)
        different = len(set(words))
        x[8] = sum(map(operator.eq, words, words[1:])) / k
        x[9] = different / k
        x[10] = np.log1p(different) / np.log1p(k)
        x[11] = min(len(text) / k, 40) / 10
        x[12] = np.log1p(k) / 10
    x[13] = len(set(lines)) / len(lines)
    x[14] = min(n.max(), 1)
    x[15] = -(n[n > 0] * np.log(n[n > 0])).sum() / 5
    x[16:] = np.sqrt(n[_MARKS])
    return x


def with_features(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the features of each text as packed doubles instead of the text."""
    kept = [c for c in df.columns if c not in (text, out)]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names = batch.schema.names
            rows = [features(t or "").tobytes() for t in batch.column(names.index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in kept), pa.array(rows, pa.binary())], names=[*kept, out])

    return df.select(*kept, text).mapInArrow(run, schema)


@dataclass
class Ranking:
    """Strengths are ``weights`` times standardised features; ``threshold`` parts good from bad."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    scale: float

    def strength(self, rows: np.ndarray) -> np.ndarray:
        return ((rows - self.mean) / self.spread) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.strength(rows) - self.threshold) / self.scale, -30, 30)))


def rank(good: np.ndarray, bad: np.ndarray, pairs: int = PAIRS) -> Ranking:
    """Fit strengths to pairs of a good and a bad row; the threshold is left at 0."""
    both = np.concatenate([good, bad]) if len(good) and len(bad) else np.zeros((2, FEATURES))
    mean, spread = both.mean(axis=0), np.maximum(both.std(axis=0), 1e-6)
    if not len(good) or not len(bad):
        return Ranking(mean, spread, np.zeros(FEATURES), 0.0, 1.0)
    draw = np.random.default_rng(SEED)
    n = min(pairs, 20 * max(len(good), len(bad)))
    apart = (good[draw.integers(len(good), size=n)] - bad[draw.integers(len(bad), size=n)]) / spread
    w = np.zeros(FEATURES)
    for _ in range(STEPS):  # Newton's method on the ridge-penalised logistic loss of the differences
        p = 1 / (1 + np.exp(np.clip(apart @ w, -30, 30)))
        gradient = -(apart * p[:, None]).mean(axis=0) + RIDGE * w
        curve = (apart * (p * (1 - p))[:, None]).T @ apart / n + RIDGE * np.eye(FEATURES)
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    found = Ranking(mean, spread, w, 0.0, 1.0)
    found.scale = float(max(np.abs(np.median(found.strength(good)) - np.median(found.strength(bad))) / 8, 1e-6))
    return found


def threshold(strengths: DataFrame) -> float:
    """Of (strength, label): midway between the quantile that the share of label 0 asks for and the next strength."""
    share = strengths.agg(F.avg(1 - F.col("label"))).first()[0]
    at = strengths.agg(F.percentile_approx("strength", float(share), RANKS)).first()[0]
    after = strengths.filter(F.col("strength") > at).agg(F.min("strength")).first()[0]
    return at if after is None else (at + after) / 2


def learn(df: DataFrame, labels: DataFrame, may_learn: Column, id_column: str = "doc_id", text: str = "text", label: str = "quality", max_labelled: int = MAX_LABELLED) -> Ranking:
    """Learn from the rows of ``labels`` that ``may_learn``, a condition on the id, admits."""
    known = labels.filter(may_learn & F.col(label).isin(0, 1) & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("doc"))
    known = known.agg(F.min(F.col(label).cast("int")).alias("label"), F.max(F.col(label).cast("int")).alias("_most")).filter("label = _most").drop("_most")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(counts) < 2:
        return rank(np.zeros((0, FEATURES)), np.zeros((0, FEATURES)))
    # A share of each class by hash: about max_labelled ids of either, however many there are.
    draw = F.pmod(F.xxhash64("doc", F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    some = known.filter(draw < F.when(F.col("label") == 1, max_labelled / counts[1]).otherwise(max_labelled / counts[0]))
    texts = df.select(F.col(id_column).alias("doc"), F.col(text).alias("text"))
    found = with_features(texts.join(F.broadcast(some), "doc"), "text", "x").groupBy("doc").agg(F.first("label").alias("label"), F.min("x").alias("x"))
    rows = found.orderBy("doc").select("label", "x").collect()
    of = lambda k: np.frombuffer(b"".join(bytes(r["x"]) for r in rows if r["label"] == k)).reshape(-1, FEATURES)
    model = rank(of(1), of(0))
    if not model.weights.any():
        return model
    model.threshold = threshold(cut(strengths(texts, model).join(known, "doc").select("strength", "label")))
    return model


def strengths(df: DataFrame, model: Ranking) -> DataFrame:
    """(doc, strength) of ``df`` (doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = np.array([features(t or "") for t in batch.column(1).to_pylist()]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.strength(rows))], names=["doc", "strength"])

    return df.filter("doc IS NOT NULL").select("doc", "text").mapInArrow(run, f"doc {df.schema['doc'].dataType.simpleString()}, strength double")


def score(df: DataFrame, model: Ranking, text: str = "text", out: str = "score", drop_text: bool = False) -> DataFrame:
    """``df`` with every text's score, from 0 to 1; documents of at least 0.5 pass."""
    kept = [c for c in df.columns if c != out and not (drop_text and c == text)]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names = batch.schema.names
            rows = np.array([features(t or "") for t in batch.column(names.index(text)).to_pylist()]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in kept), pa.array(model.score(rows))], names=[*kept, out])

    return df.select(*dict.fromkeys([*kept, text])).mapInArrow(run, schema)


def held_out(id_column: str = "doc_id") -> Column:
    """The fold whose labels are never learnt."""
    return F.coalesce(fold(id_column, 3) == 1, F.lit(False))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"), ~held_out())
    out = score(docs, model, drop_text=True)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
