"""Text statistics over whole drafts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scorable(raw: Column, marker: str = "SCORE_END") -> Column:
    """The text before an end marker comment."""
    return F.regexp_replace(raw, rf"(?is)<!--\s*{marker}.*", "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("([A-Za-z0-9']+)"), F.lit(1))


def sentences(text: Column) -> Column:
    """Parts that end in ``.``, ``!`` or ``?`` before white space and a capital, digit or quote."""
    parts = F.split(F.trim(text), r"(?<=[.!?])\s+(?=[A-Z0-9\"'])")
    return F.filter(parts, lambda s: F.trim(s) != "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, r"\n\s*\n"), lambda s: F.trim(s) != "")


def per_thousand(count: Column, total: Column) -> Column:
    return F.when(total > 0, count.cast("double") * 1000 / total).otherwise(F.lit(0.0))


def spread(lengths: Column, least: int = 3) -> Column:
    """Population deviation by mean of an array of numbers; null for fewer than ``least`` or mean 0.

    The array is read once, for its count, sum and sum of squares.
    """
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("square"))
    add = lambda a, x: F.struct((a["n"] + 1).alias("n"), (a["sum"] + x).alias("sum"), (a["square"] + x * x).alias("square"))

    def of(a: Column) -> Column:
        mean = a["sum"] / a["n"]
        return F.when((a["n"] >= least) & (a["sum"] > 0), F.sqrt(F.greatest(a["square"] / a["n"] - mean * mean, F.lit(0.0))) / mean)

    return F.aggregate(lengths, zero, add, of)


def word_count(text: Column) -> Column:
    """How many words a text has: each becomes a mark, and all but the marks go."""
    marked = F.regexp_replace(F.translate(text, "\x01", " "), "[A-Za-z0-9']+", "\x01")
    return F.char_length(F.regexp_replace(marked, "[^\x01]+", ""))


def word_counts(parts: Column) -> Column:
    return F.transform(parts, lambda s: word_count(s).cast("double"))


def phrase_hits(drafts: DataFrame, key: str, text: str, phrases: Sequence[str]) -> DataFrame:
    """(key, line_no, phrase) for every line with a phrase, quoted lines left out.

    A phrase's end must be a word's end if it is a letter or digit there.
    """

    def pattern(p: str) -> str:
        quoted = "".join(c if c.isalnum() or c == " " else "\\" + c for c in p)
        return "(?i)" + (r"\b" if p[0].isalnum() else "") + quoted + (r"\b" if p[-1].isalnum() else "")

    lines = drafts.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line")).filter(~F.ltrim("line").startswith(">"))
    hit = F.filter(F.array(*(F.when(F.col("line").rlike(pattern(p)), F.lit(p)) for p in phrases)), lambda x: x.isNotNull())
    return lines.select(key, (F.col("at") + 1).alias("line_no"), F.explode(hit).alias("phrase"))
