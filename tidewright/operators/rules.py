"""Ordered rules, the first match of which decides, compiled to one expression."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A label and what a lower-cased text must hold for it; any of the tests is enough.

    A label of None ends the cascade without a label, so that a later source
    may answer; a tuple labels several fields.
    """

    label: str | tuple[str | None, ...] | None
    anywhere: Sequence[str] = ()
    words: Sequence[str] = ()
    starts: Sequence[str] = ()
    ends: Sequence[str] = ()
    exact: Sequence[str] = ()
    pattern: str | None = None

    def test(self, low: Column) -> Column:
        """All tokens of a kind go into one alternation, so a long list is one regular expression."""
        quoted = lambda tokens: "|".join("".join(c if c.isalnum() else "\\" + c for c in t) for t in tokens)
        tests = []
        if self.anywhere:
            tests.append(low.rlike(quoted(self.anywhere)))
        if self.words:
            tests.append(low.rlike(rf"\b(?:{quoted(self.words)})\b"))
        if self.starts:
            tests.append(low.rlike(f"^(?:{quoted(self.starts)})"))
        if self.ends:
            tests.append(low.rlike(f"(?:{quoted(self.ends)})$"))
        if self.exact:
            tests.append(low.isin(*self.exact))
        if self.pattern:
            tests.append(low.rlike(self.pattern))
        out = tests[0]
        for t in tests[1:]:
            out = out | t
        return out


@dataclass(frozen=True)
class RuleSet:
    """Rules in order; with ``fields``, labels are tuples and the result is a struct."""

    rules: Sequence[Rule]
    otherwise: str | tuple[str | None, ...] | None = None
    fields: Sequence[str] = field(default=())

    def _label(self, label) -> Column:
        if not self.fields:
            return F.lit(label).cast("string")
        values = label if label is not None else (None,) * len(self.fields)
        return F.struct(*(F.lit(v).cast("string").alias(n) for n, v in zip(self.fields, values, strict=True)))

    def on(self, text: Column) -> Column:
        """The label of a text; null and empty texts get the default."""
        low = F.lower(F.coalesce(text, F.lit("")))
        out = F
        for rule in self.rules:
            out = out.when(rule.test(low), self._label(rule.label))
        return out.otherwise(self._label(self.otherwise))


#: Kinds of test that a row of a rule table may name; the others than pattern take one token a row.
TESTS = ("anywhere", "words", "starts", "ends", "exact", "pattern")


def rule_set(rows: DataFrame, otherwise=None, fields: Sequence[str] = (), most: int = 20_000) -> RuleSet:
    """The rules of a table (rank, test, token and the label, or a column for each of ``fields``), in order of rank.

    Rows of one rank are one rule: any of their tokens is enough, and they
    have one label; null labels end the cascade. A table of more than ``most``
    rows, an unknown test and a rank with two labels or patterns are refused.
    """
    names = list(fields) or ["label"]
    found = rows.select("rank", "test", "token", *names).orderBy("rank", "test", "token").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rules")
    by_rank: dict = {}
    for r in found:
        if r["test"] not in TESTS:
            raise ValueError(f"no such test: {r['test']}")
        by_rank.setdefault(r["rank"], []).append(r)
    rules = []
    for rank, some in by_rank.items():
        labels = {tuple(r[n] for n in names) for r in some}
        tokens = {t: [r["token"] for r in some if r["test"] == t] for t in TESTS}
        if len(labels) > 1 or len(tokens["pattern"]) > 1:
            raise ValueError(f"rank {rank} has two labels or patterns")
        label = labels.pop()
        tests = {t: [x.lower() for x in v] for t, v in tokens.items() if t != "pattern"} | {"pattern": next(iter(tokens["pattern"]), None)}
        rules.append(Rule((None if label == (None,) * len(names) else label) if fields else label[0], **tests))
    return RuleSet(rules, otherwise, fields)


def cascade(*labels: Column) -> Column:
    """The first source that answers."""
    return F.coalesce(*labels)


def hits(text: Column, terms: Sequence[str]) -> Column:
    """How many of the terms a text holds, each once."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(0)
    for t in terms:
        out = out + low.contains(t.lower()).cast("int")
    return out


def points(*tests: Column) -> Column:
    """How many of the tests hold; unknown counts as no."""
    out = F.lit(0)
    for t in tests:
        out = out + F.coalesce(t, F.lit(False)).cast("int")
    return out
