"""Secret scanning: fixed patterns, plus formats learnt as probabilistic automata.

The fixed patterns find the base spans. Their distinct values are the labelled
credentials: per kind, a prefix tree of the values' character classes is
generalised by merging states whose outgoing and ending frequencies don't
differ more than Hoeffding's bound allows. The automaton, the values' common
prefix and their lengths give any string a format likelihood; a Markov model
of all other tokens gives the other side. Every other token of a text, from the
least length of a labelled value up and over the same characters, is scored,
then without dots and equals signs around it, then its parts between them; the
first that passes is added as an ``inferred`` span where it is at least as likely as
the least likely of the labelled values but a few, and likelier than an
ordinary token by more than chance makes of so few values.

Every text is scanned whole and twice: to learn, and to find. The first scan
leaves the labelled values and the counts of class pairs over every other token; they are checkpointed. The driver
reads at most ``MAX_VALUES`` distinct values a kind of at most ``MAX_LENGTH``
characters, chosen by hash, and the summed counts. A token is scored once for
many texts, and a text without a token that passes is not looked at again.

Defined results: null text is like empty text, without spans; spans are in
code points, the end exclusive; repeated rows each carry their spans; a kind
with few labelled values needs a clearer likelihood; without any base span in
the corpus nothing is inferred; an empty table gives an empty result; other
columns of any name pass through.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, slices, table

#: Distinct labelled values a kind that learning reads at most, and their length; distinct tokens that a task holds, with their counts or scores.
MAX_VALUES, MAX_LENGTH, HELD_TOKENS = 2000, 256, 100_000
#: Labelled values below which each sets the threshold by what the others say.
FEW = 8
#: Significance of a merge; labelled values that may fall below the threshold.
ALPHA, MISSED = 0.05, 0.005
KINDS = ("assign", "access", "hex", "inferred")

# The patterns of the base spans.
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
_PART = re.compile(r"[A-Za-z0-9+/_-]{6,}")
# All bytes but those of a token are spaces.
_SEPARATE = bytes(b if re.match(rb"[A-Za-z0-9+/_.=-]", bytes([b])) else 32 for b in range(256))


def runs(text: str) -> list[bytes]:
    """What ``_TOKEN`` finds in a text."""
    return [w for w in text.encode().translate(_SEPARATE).split() if len(w) > 5]


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the fixed patterns, by start and then kind."""
    found = []
    if "=" in text or ":" in text:
        found += [("assign", *m.span(), m[1]) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if len(max(text.split(), key=len, default="")) >= 16:
        for run in _RUN.finditer(text):  # the other two kinds lie within such runs
            s, at = run[0], run.start()
            if len(s) >= 20 and "AKIA" in s:
                found += [("access", at + m.start(), at + m.end(), m[0]) for m in _ACCESS.finditer(s) if len(m[0]) >= 20]
            if len(s) >= 24:
                found += [("hex", at + m.start(), at + m.end(), m[0]) for m in _HEX.finditer(s) if len(m[0]) >= 24]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def forms_of(run: str, at: int = 0) -> list[tuple[int, int, str]]:
    """A token's (start, end, value): whole, without signs around it, its parts."""
    found = [(at, at + len(run), run)]
    if "." in run or "=" in run:
        bare = run.strip(".=")
        if len(bare) >= 6 and bare != run:
            start = at + len(run) - len(run.lstrip(".="))
            found.append((start, start + len(bare), bare))
        found += [(at + x.start(), at + x.end(), x[0]) for x in _PART.finditer(run) if x[0] != bare]
    return found


def other_tokens(text: str, spans: list[tuple[str, int, int, str]]) -> Iterator[list[tuple[int, int, str]]]:
    """The forms of every token; none overlaps a base span."""
    taken = [(s[1], s[2]) for s in spans]
    for m in _TOKEN.finditer(text):
        run, at = m[0], m.start()
        found = forms_of(run, at)
        if any(a < m.end() and at < b for a, b in taken):
            # What a base span leaves of the token.
            left = "".join(" " if any(a <= i < b for a, b in taken) else c for i, c in enumerate(run, at))
            found = [(at + x.start(), at + x.end(), x[0]) for p in (_TOKEN, _PART) for x in p.finditer(left)]
        if found:
            yield found


def inferred(text: str, spans: list[tuple[str, int, int, str]], passes) -> list[tuple[int, int, str]]:
    """The tokens that pass, longest form first; none overlaps another."""
    out = []
    for forms in other_tokens(text, spans):
        mine: list[tuple[int, int, str]] = []
        for a, b, value in forms:
            if passes(value) and not any(x < b and a < y for x, y, _ in mine):
                mine.append((a, b, value))
        out += sorted(mine)
    return out


_SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def observe(df: DataFrame, text: str = "text") -> DataFrame:
    """(kind, value, n): labelled values, and as kind ``pair`` the counts of class pairs in all other tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: Counter = Counter()
        pairs = np.zeros(1 << 16, np.int64)

        def spend() -> None:
            if tokens:
                classes = np.frombuffer(b"^" + b"^".join(tokens).translate(_CLASSES), np.uint8).astype(np.uint16)
                weight = np.repeat(np.fromiter(tokens.values(), np.int64, len(tokens)), [len(t) + 1 for t in tokens])[:-1]
                inside = classes[1:] != ord("^")
                found = (classes[:-1] << 8 | classes[1:])[inside]
                pairs[:] += np.bincount(found, weight[inside], 1 << 16).astype(np.int64)
            tokens.clear()

        def rows(found: list[tuple[str, str, int]]) -> pa.RecordBatch:
            kind, value, n = zip(*found, strict=True) if found else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(value, pa.string()), pa.array(n, pa.int64())], names=["kind", "value", "n"])

        for batch in slices(batches):
            labelled: Counter = Counter()
            for t in batch.column(0).to_pylist():
                spans = base_spans(t) if t else []
                labelled.update((s[0], s[3]) for s in spans if len(s[3]) <= MAX_LENGTH)
                if spans:
                    tokens.update(forms[0][2].encode() for forms in other_tokens(t, spans))
                elif t:
                    tokens.update(runs(t))
                if len(tokens) > HELD_TOKENS:
                    spend()
            yield rows([(*k, n) for k, n in labelled.items()])
        spend()
        yield rows([("pair", chr(k >> 8) + chr(k & 255), int(pairs[k])) for k in np.flatnonzero(pairs).tolist()])

    return df.select(text).mapInArrow(run, "kind string, value string, n long")


# A character's class: digit, hexadecimal letter, other letter, or itself.
_CLASSES = bytes(ord("9") if 48 <= b <= 57 else ord("H") if 65 <= b <= 70 else ord("A") if 71 <= b <= 90 else ord("h") if 97 <= b <= 102 else ord("a") if 103 <= b <= 122 else b for b in range(256))
_CLASS_OF = {b: c for b, c in enumerate(_CLASSES) if b < 128}


def shape(value: str) -> str:
    """Every character's class."""
    return value.translate(_CLASS_OF)


_SIZE = {"9": 10, "h": 6, "a": 20, "H": 6, "A": 20}


@dataclass
class Automaton:
    """A probabilistic automaton over character classes, with what else a format fixes."""

    prefix: str
    moves: list[dict[str, tuple[int, float]]]
    lengths: dict[int, float]
    threshold: float = -math.inf
    #: By how much a character a token must be likelier than an ordinary one.
    margin: float = 0.0
    least: float = field(default=1e-4)

    def score(self, value: str) -> float:
        """Mean log likelihood a character: classes by the automaton, the character within its class, and the length."""
        if not value.startswith(self.prefix):
            return -math.inf
        rest = value[len(self.prefix) :]
        total, state = math.log(self.lengths.get(len(value), self.least**2)), 0
        for c in shape(rest):
            state, p = self.moves[state].get(c, (state, self.least))
            total += math.log(max(p, self.least) / _SIZE.get(c, 1))
        return total / max(len(value), 1)


def _alike(f1: float, n1: float, f2: float, n2: float, bound: float) -> bool:
    return abs(f1 / n1 - f2 / n2) < bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))


def infer(values: list[str], alpha: float = ALPHA) -> Automaton:
    """Merge compatible states of the values' prefix tree, nearest the root first."""
    counted = Counter(v[:i] for v in values for i in range(1, 17))
    prefix = max((p for p, n in counted.items() if n >= 0.9 * len(values)), key=len, default="")
    kept = [v for v in values if v.startswith(prefix)]
    n, end, to = [0], [0], [{}]
    for v in kept:
        state = 0
        n[0] += 1
        for c in shape(v[len(prefix) :]):
            if c not in to[state]:
                to[state][c] = len(n)
                n.append(0)
                end.append(0)
                to.append({})
            state = to[state][c]
            n[state] += 1
        end[state] += 1
    # What a state passes on by a class: kept apart, since a merged child counts other ways in too.
    passed = [{c: n[s] for c, s in moves.items()} for moves in to]
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def compatible(a: int, b: int) -> bool:
        todo, seen = [(a, b)], set()
        while todo:
            a, b = todo.pop()
            if (a, b) in seen or a == b:
                continue
            seen.add((a, b))
            if not n[a] or not n[b]:
                continue
            if not _alike(end[a], n[a], end[b], n[b], bound) and min(n[a], n[b]) > 20:
                return False
            for c in to[a].keys() | to[b].keys():
                if not _alike(passed[a].get(c, 0), n[a], passed[b].get(c, 0), n[b], bound):
                    return False
                if c in to[a] and c in to[b]:
                    todo.append((to[a][c], to[b][c]))
        return True

    def fold(a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if a == b:
                continue
            n[a] += n[b]
            end[a] += end[b]
            for c, s in to[b].items():
                passed[a][c] = passed[a].get(c, 0) + passed[b][c]
                if c in to[a]:
                    todo.append((to[a][c], s))
                else:
                    to[a][c] = s

    red = [0]
    while blue := [(r, c) for r in red for c in sorted(to[r]) if to[r][c] not in red]:
        parent, c = max(blue, key=lambda x: (n[to[x[0]][x[1]]], -x[0]))
        state = to[parent][c]
        for r in red:
            if compatible(r, state):
                to[parent][c] = r
                fold(r, state)
                break
        else:
            red.append(state)
    number = {s: i for i, s in enumerate(red)}
    moves = []
    for s in red:
        total = sum(passed[s].values()) + end[s] or 1
        moves.append({c: (number[t], passed[s][c] / total) for c, t in to[s].items()})
    lengths = Counter(map(len, kept))
    return Automaton(prefix, moves, {k: v / len(kept) for k, v in lengths.items()})


@dataclass
class Ordinary:
    """A Markov chain of the characters' classes in ordinary tokens."""

    pairs: dict[tuple[str, str], float]
    least: float = 1e-4

    def score(self, value: str) -> float:
        classes = "^" + shape(value)
        return sum(math.log(self.pairs.get(x, self.least) / _SIZE.get(x[1], 1)) for x in zip(classes, classes[1:], strict=False)) / max(len(value), 1)


def ordinary(pairs: Iterable[tuple[str, int]]) -> Ordinary:
    """From (class pair, count) rows."""
    counts: dict[str, Counter] = defaultdict(Counter)
    for (a, b), n in pairs:
        counts[a][b] += n
    return Ordinary({(a, b): k / sum(c.values()) for a, c in counts.items() for b, k in c.items()})


@dataclass
class Formats:
    automata: dict[str, Automaton]
    plain: Ordinary

    def score(self, value: str) -> tuple[str, float]:
        """The format that fits best, and by how much above its threshold; below 0: none."""
        best = ("", -1.0)
        for kind, a in self.automata.items():
            mine = a.score(value)
            over = mine - a.threshold
            if over >= 0 and over > best[1] and mine - self.plain.score(value) > a.margin:
                best = (kind, over)
        return best


def learn(labelled: dict[str, list[str]], pairs: Iterable[tuple[str, int]]) -> Formats:
    """One automaton a kind; half of the values set its threshold, of few values each as the others see it."""
    automata = {}
    for kind, values in labelled.items():
        if not values:
            continue
        if len(values) < FEW:
            a = infer(values)
            others = [infer(values[:i] + values[i + 1 :]).score(v) for i, v in enumerate(values)] if len(values) > 1 else []
            scores = sorted([*others, *map(a.score, values)])
        else:
            a = infer(values[::2])
            scores = sorted(a.score(v) for v in values[1::2])
        a.threshold = next((x for x in scores[int(MISSED * len(scores)) :] if x > -math.inf), math.inf)
        a.margin = math.sqrt(math.log(2 / ALPHA) / (2 * len(values)))
        automata[kind] = a
    return Formats(automata, ordinary(pairs))


def learn_from(df: DataFrame, text: str = "text", max_values: int = MAX_VALUES) -> Formats:
    """Learn from at most ``max_values`` distinct values a kind, chosen by hash, and from all other tokens."""
    seen = cut(observe(df, text))

    def some(kind: str) -> list[str]:
        values = seen.filter(F.col("kind") == kind).select("value").distinct()
        return [r[0] for r in values.orderBy(F.xxhash64("value"), "value").limit(max_values).collect()]

    labelled = {k: some(k) for k in KINDS[:3]}
    pairs = seen.filter("kind = 'pair'").groupBy("value").agg(F.sum("n").alias("n")).collect()
    return learn({k: v for k, v in labelled.items() if v}, [(r["value"], r["n"]) for r in pairs])


class Judge:
    """Finds the spans of texts, with the verdicts on the latest tokens kept."""

    def __init__(self, formats: Formats):
        self.formats = formats
        self.known: dict[str, bool] = {}
        self.seen: set[bytes] = set()
        self.hot: set[bytes] = set()

    def passes(self, value: str) -> bool:
        if (found := self.known.get(value)) is None:
            if len(self.known) > HELD_TOKENS:
                self.known.clear()
            found = self.known[value] = self.formats.score(value)[1] >= 0
        return found

    def spans(self, text: str | None) -> tuple[list[tuple[str, int, int, str]], list[tuple[str, int, int, str]]]:
        """The base spans of a text, and those inferred."""
        if not text:
            return [], []
        base = base_spans(text)
        if not base:
            tokens = set(runs(text))
            for w in tokens - self.seen:
                if any(self.formats.score(v)[1] >= 0 for _, _, v in forms_of(w.decode())):
                    self.hot.add(w)
            if len(self.seen) > HELD_TOKENS:
                self.seen.clear()
            self.seen |= tokens
            if self.hot.isdisjoint(tokens):
                return [], []
        more = [("inferred", *x) for x in inferred(text, base, self.passes)]
        if len(self.hot) > HELD_TOKENS:  # both go, so that a token is hot whenever it is seen
            self.hot.clear()
            self.seen.clear()
        return base, more


def find_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without its text, with ``base`` and ``spans``: base and inferred ones together."""
    formats = learn_from(df, text)
    kept = [c for c in df.columns if c not in (text, "base", "spans")]
    added = T._parse_datatype_string(f"base {_SPAN}, spans {_SPAN}")
    schema = T.StructType([df.schema[c] for c in kept] + list(added.fields))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(formats)
        as_rows = lambda spans: [dict(zip(("kind", "start", "end", "value"), s, strict=True)) for s in spans]
        for batch in slices(batches):
            names = batch.schema.names
            base, spans = [], []
            for t in batch.column(names.index(text)).to_pylist():
                known, more = judge.spans(t)
                base.append(as_rows(known))
                spans.append(as_rows(sorted(known + more, key=lambda s: (s[1], KINDS.index(s[0])))))
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in kept), pa.array(base, span), pa.array(spans, span)], names=[*kept, "base", "spans"])

    return df.select(*kept, text).mapInArrow(run, schema)


def redact(df: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``df`` with every found span of ``text`` replaced by ``mask``; null stays null."""
    formats = learn_from(df, text)

    def clean(value: str, judge: Judge) -> str:
        base, more = judge.spans(value)
        spans = [(s[1], s[2]) for s in base + more]
        out, at = [], 0
        for a, b in sorted(spans):
            if b > at:
                if a >= at:
                    out += [value[at:a], mask]
                at = b
        return "".join([*out, value[at:]]) if spans else value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(formats)
        for batch in slices(batches):
            i = batch.schema.names.index(text)
            cleaned = pa.array([None if t is None else clean(t, judge) for t in batch.column(i).to_pylist()], pa.string())
            yield batch.set_column(i, pa.field(text, pa.string()), cleaned)

    return df.mapInArrow(run, df.schema)


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets: counts and digest of the base spans, and all spans."""
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"),
        _joined("spans").alias("spans"),
    )
