"""Joins the funnel needs beyond plain equi-joins, all planned as equi-joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest_pairs(df: DataFrame, left: str, right: str, names: tuple[str, str], outer: bool = False) -> DataFrame:
    """One row for each position of two arrays; the shorter is padded with null, null is empty."""
    kind = df.schema[left].dataType.simpleString()
    empty = F.array().cast(kind)
    zipped = F.arrays_zip(F.coalesce(F.col(left), empty).alias("l"), F.coalesce(F.col(right), empty).alias("r"))
    spread = df.withColumn("__pair", (F.explode_outer if outer else F.explode)(zipped))
    return spread.withColumn(names[0], F.col("__pair")["l"]).withColumn(names[1], F.col("__pair")["r"]).drop("__pair")


def alias_table(reps: DataFrame, key: str, email: str, nicknames: Mapping[str, str]) -> DataFrame:
    """(kind, alias, key): every spelling under which a rep may sign."""
    low = F.lower(key)
    plain = [("email", F.lower(email)), ("name", low), ("local", low)]
    nick = [F.when(F.col(key) == rep, F.struct(F.lit("name").alias("kind"), F.lit(n.lower()).alias("alias"))) for n, rep in nicknames.items()]
    all_ = F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("alias")) for k, v in plain), *nick)
    spread = reps.select(F.col(key), F.explode(F.filter(all_, lambda a: a.isNotNull())).alias("a"))
    return spread.select("a.kind", "a.alias", key).filter("alias IS NOT NULL AND alias <> ''").distinct()


def match_alias(signed: DataFrame, email: str, name: str, aliases: DataFrame) -> DataFrame:
    """``signed`` joined to each rep that its e-mail, first name or local part stands for.

    The alternatives are exploded to (kind, alias) and joined once by equality,
    in place of a join on a disjunction.
    """
    first = F.lower(F.split_part(F.coalesce(name, F.lit("")), F.lit(" "), F.lit(1)))
    local = F.lower(F.split_part(F.col(email), F.lit("@"), F.lit(1)))
    ways = [("email", F.lower(email)), ("name", first), ("local", local)]
    keys = F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("alias")) for k, v in ways))
    spread = signed.withColumn("__a", F.explode(keys)).select("*", "__a.*").drop("__a")
    return spread.join(aliases, ["kind", "alias"]).drop("kind", "alias")


def spine(grains: Sequence[DataFrame], key: str, zero: Sequence[str] = ()) -> DataFrame:
    """All keys of several grains with the columns of each, missing counts as zero.

    A key is in a grain once. The grains are laid below each other and grouped
    once, so each is planned once, and the null key is a key like any other.
    """
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), grains)
    names = list(dict.fromkeys(c for g in grains for c in g.columns if c != key))
    out = both.groupBy(key).agg(*(F.max(c).alias(c) for c in names))
    return out.fillna(0, subset=list(zero)) if zero else out


def longest_prefix(df: DataFrame, code: str, prefixes: DataFrame, excluded: DataFrame, out: str = "label") -> DataFrame:
    """``df`` with the label of the longest matching prefix; excluded prefixes veto.

    ``prefixes`` is (prefix, label). Each different code is cut to the lengths
    that prefixes have and joined by equality; a null code has no label.
    """
    every = prefixes.select("prefix").union(excluded.select("prefix"))
    lengths = every.agg(F.coalesce(F.collect_set(F.length("prefix")), F.array().cast("array<int>")).alias("__n"))
    codes = df.select(F.col(code).alias("__code")).filter("__code IS NOT NULL").distinct().crossJoin(F.broadcast(lengths))
    cuts = F.transform(F.filter("__n", lambda n: n <= F.length("__code")), lambda n: F.substring(F.col("__code"), F.lit(1), n))
    spread = codes.select("__code", F.explode(cuts).alias("prefix"))
    label = spread.join(prefixes, "prefix").groupBy("__code").agg(F.max_by("label", F.length("prefix")).alias(out))
    vetoed = spread.join(excluded, "prefix", "left_semi").select("__code").distinct()
    label = label.join(vetoed, "__code", "left_anti")
    return df.join(label, F.col(code) == F.col("__code"), "left").drop("__code")


def lookup(df: DataFrame, side: DataFrame, on: str, value: str, default: Column | str) -> DataFrame:
    """``df`` with ``value`` from ``side``, or ``default``."""
    fallback = default if isinstance(default, Column) else F.lit(default)
    return df.join(side.select(on, value), on, "left").withColumn(value, F.coalesce(value, fallback))
