"""Document fingerprints by winnowing, in DataFrame expressions only.

Every ``GRAM`` consecutive code points are hashed; in every window of
``WINDOW`` hashes the least is selected, the rightmost of equals. A hash and
its position are packed into one number (the hash above, the position counted
down below), so the least number of a window is the rightmost least hash.
Minima of windows of 2, 4, 8, ... hashes lead to those of the whole window.

A passage of ``GRAM + WINDOW - 1`` code points that two texts share has a
window of its own in both, so they share a selected hash: the match guarantee.
Texts shorter than that have one window of all their hashes, and texts
shorter than a gram one hash of the whole text.

A text edited by replacing its end by the start of another has, but for the
windows around the seam, windows of the two texts. So its fingerprint is put
together from theirs, and only the seam is hashed again.

The next document by descending id is found in buckets between quantiles of
(id, hash of the text): a window function runs within a bucket, and the first
row of a bucket is also sent to the end of the bucket before it. Texts are
shuffled once; no task sees more than its buckets, and the rows of one id
spread over many of them by their texts. Only rows that repeat both id and
text, which are each other's next, stay in one bucket.

Defined results: null text is the empty text, whose fingerprint is the empty
string; two empty fingerprints have likeness 1, an empty and another 0; rows
that repeat an id follow each other by descending hash of their texts, then by
text; rows with a null id come last; a
table of one row is its own next; an empty table gives an empty result; other
columns are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parts, table

#: Code points of a gram, hashes of a window (a power of two).
GRAM, WINDOW = 8, 16
#: Code points of the shortest passage that is sure to be found.
GUARANTEE = GRAM + WINDOW - 1
_LAST = (1 << 31) - 1
_NO_ID = -(1 << 63)


def _packed(hashed: Column, position: Column) -> Column:
    return F.shiftleft(F.shiftrightunsigned(hashed, 33), 31).bitwiseOR(F.lit(_LAST).cast("long") - position)


def _grams(text: Column) -> Column:
    """The packed hash of every gram, or of the whole of a text that is shorter; none for the empty text."""
    grams = F.regexp_extract_all(text, F.lit("(?s)(?=(.{%d}))." % GRAM), F.lit(1))
    whole = F.array(_packed(F.xxhash64(text), F.lit(0)))
    return (
        F.when(F.char_length(text) >= GRAM, F.transform(grams, lambda g, i: _packed(F.xxhash64(g), i)))
        .when(F.char_length(text) > 0, whole)
        .otherwise(F.slice(whole, 1, 0))
    )


def with_minima(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the packed minimum of every window of a text, in order.

    Each step takes minima of windows twice as wide; windows that pass the end
    are cut short there, and are left out at last if there is a full one. The
    steps are columns of their own, so none is computed twice.
    """
    df = df.withColumn(out, _grams(F.col(text)))
    step = 1
    while step < WINDOW:
        later = F.slice(out, F.lit(step + 1), F.greatest(F.size(out), F.lit(1)))
        df = df.withColumn(out, F.zip_with(out, later, lambda a, b: F.least(a, b)))
        step *= 2
    full = F.char_length(text) - F.lit(GUARANTEE - 1)
    return df.withColumn(out, F.slice(out, F.lit(1), F.greatest(full, F.least(F.size(out), F.lit(1)))))


def few_minima(text: Column) -> Column:
    """The same for a short text, window by window."""
    window = lambda g: F.transform(F.sequence(F.lit(1), F.greatest(F.size(g) - (WINDOW - 1), F.lit(1))), lambda i: F.array_min(F.slice(g, i, F.lit(WINDOW))))
    return F.filter(F.transform(F.array(_grams(text)), window)[0], lambda m: m.isNotNull())


def written(selected: Column) -> Column:
    """Selected hashes and positions as ``hash:position`` in hexadecimal, by position."""
    return F.array_join(F.transform(selected, lambda x: F.concat(F.hex(F.shiftright(x, 31)), F.lit(":"), F.hex(F.lit(_LAST).cast("long") - x.bitwiseAND(F.lit(_LAST).cast("long"))))), ",")


def hashes(selected: Column) -> Column:
    """The set of selected hashes."""
    return F.array_distinct(F.transform(selected, lambda x: F.shiftright(x, 31)))


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes of two sets by all their hashes; 1 for two empty sets."""
    sizes = F.struct(F.size(F.array_intersect(a, b)).cast("double").alias("both"), (F.size(a) + F.size(b)).alias("sum"))
    share = lambda n: F.when(n["sum"] > n["both"], n["both"] / (n["sum"] - n["both"])).otherwise(F.lit(1.0))
    return F.transform(F.array(sizes), share)[0]


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``df`` with the winnowed fingerprint of a column of texts."""
    whole = with_minima(df.withColumn("__text", F.coalesce(F.col(text), F.lit(""))), "__text", "__minima")
    return whole.withColumn(out, written(F.array_distinct("__minima"))).drop("__text", "__minima")


def in_buckets(docs: DataFrame, order: Sequence[str], text: str, sample: int = 20) -> DataFrame:
    """``docs`` with ``bucket`` and ``edge``: rows near in descending ``order`` share a bucket.

    The first row of a bucket is repeated, with ``edge`` 1, in the bucket
    before it (that of the first one in the last). What reaches the driver is
    about ``sample`` values a bucket, which decide nothing but how even the
    buckets are, and each bucket's first value; there are four buckets a
    partition at most.
    """
    spark = docs.sparkSession
    wanted = 4 * parts(spark)
    value = F.struct(*order)
    n = docs.count()
    drawn = sorted((tuple(r) for r in docs.select(*order).sample(min(1.0, sample * wanted / max(n, 1)), 7).collect()), reverse=True)
    bounds = sorted({drawn[len(drawn) * (i + 1) // wanted] for i in range(wanted - 1)}, reverse=True) if drawn else []
    if bounds:
        # How many boundaries lie above the value: whole blocks first, then within one block.
        as_value = lambda b: F.struct(*(F.lit(x).alias(c) for x, c in zip(b, order, strict=True)))
        width = max(1, int(len(bounds) ** 0.5))
        blocks = [bounds[i : i + width] for i in range(0, len(bounds), width)]
        passed = F.size(F.filter(F.array(*(as_value(b[-1]) for b in blocks)), lambda b: b > value))
        table_ = F.array(*(F.array(*map(as_value, b)) for b in blocks))
        inside = F.when(passed < len(blocks), F.size(F.filter(F.element_at(table_, F.least(passed + 1, F.lit(len(blocks)))), lambda b: b > value))).otherwise(0)
        docs = docs.withColumn("bucket", (passed * width + inside).cast("long"))
    else:
        docs = docs.withColumn("bucket", F.lit(0).cast("long"))
    firsts = sorted((r["bucket"], *r["first"]) for r in docs.groupBy("bucket").agg(F.max(value).alias("first")).collect())
    rows = [(*first[1:], firsts[i - 1][0]) for i, first in enumerate(firsts)]
    schema = ", ".join([*(f"`{c}` long" for c in order), "before long"])
    # One row of those that repeat a bucket's first value: they have one text.
    edges = docs.join(F.broadcast(spark.createDataFrame(rows, schema)), list(order)).groupBy(*order, "before").agg(F.min(text).alias(text))
    edges = edges.select(*(F.col(c) if c in (*order, text) else F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in docs.columns if c != "bucket"), F.col("before").alias("bucket"))
    return docs.withColumn("edge", F.lit(0)).unionByName(edges.withColumn("edge", F.lit(1)))


def edited(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's fingerprint and that of its text with its last half replaced.

    The last floor(n/2) code points give way to the first as many (or all) of
    the next document, by descending id; the first follows the last. Columns:
    the id, n_chars, edited, fingerprint, edited_fingerprint, near_edited,
    near_next.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_column).alias("doc"), F.coalesce(F.col(id_column).cast("long"), F.lit(_NO_ID)).alias("at"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.withColumn("same", F.xxhash64("text"))
    dealt = in_buckets(docs, ["at", "same"], "text").repartition(parts(spark), "bucket")
    keys = [F.col("bucket"), F.col("edge"), F.col("at").desc(), F.col("same").desc(), F.col("text")]
    own = with_minima(dealt.sortWithinPartitions(*keys), "text", "m")
    own = own.withColumn("s", F.array_distinct("m")).withColumn("n", F.char_length("text"))
    window = Window.partitionBy("bucket").orderBy(*keys[1:])
    ahead = own.withColumns({f"next_{c}": F.lead(c).over(window) for c in ("text", "m", "s", "n")}).filter("edge = 0")

    reach = F.lit(GUARANTEE - 1)
    cut_at = ahead.withColumn("half", F.floor(F.col("n") / 2).cast("int"))
    cut_at = cut_at.withColumn("keep", F.col("n") - F.col("half")).withColumn("take", F.least("half", "next_n"))
    cut_at = cut_at.withColumn("head", F.expr("substring(text, 1, keep)")).withColumn("tail", F.expr("substring(next_text, 1, take)"))
    keep, take = F.col("keep"), F.col("take")
    before, after = F.least(keep, reach), F.least(take, reach)
    cut_at = cut_at.withColumn("seam", F.concat(F.substring("head", keep - before + 1, before), F.substring("tail", F.lit(1), after)))
    seam = F.col("seam")
    # The seam counts if it has a full window, or is all of the edited text.
    seamed = F.when((F.char_length(seam) >= GUARANTEE) | (F.char_length(seam) == keep + take), few_minima(seam)).otherwise(F.slice(F.col("m"), 1, 0))
    later = lambda values, by: F.transform(values, lambda x: x - by.cast("long"))
    chosen = F.array_distinct(
        F.concat(
            F.slice("m", F.lit(1), F.greatest(keep - reach, F.lit(0))),
            later(seamed, keep - before),
            later(F.slice(F.col("next_m"), F.lit(1), F.greatest(take - reach, F.lit(0))), keep),
        )
    )
    done = cut_at.withColumn("e", chosen).withColumn("edited", F.concat("head", "tail")).withColumn("h", hashes(F.col("s")))
    done = done.withColumn("h_edited", hashes(F.col("e"))).withColumn("h_next", hashes(F.col("next_s")))
    return done.select(
        F.col("doc").alias(id_column),
        F.col("n").cast("long").alias("n_chars"),
        "edited",
        written(F.col("s")).alias("fingerprint"),
        written(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("h"), F.col("h_edited")).alias("near_edited"),
        likeness(F.col("h"), F.col("h_next")).alias("near_next"),
    )


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text; the edited text as a digest."""
    out = edited(table(spark, sf_dir, "documents"))
    return out.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).drop("edited")
