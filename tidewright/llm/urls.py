"""URL filters: written rules first, then a tree of path templates learnt per host.

Level by level, the children of a (host, template prefix) are counted with
their good and bad labels. A child keeps its own branch if it has support and its
share of bad labels differs from that of all its siblings together by a
two-proportion test, however many siblings it has. All other children, variable
segments such as numbers and branches that are statistically alike, become one
wildcard branch. Of the branches that differ, those of like share (in steps of
``STEP`` on the arcsine scale, where shares are equally noisy) that the same
test doesn't tell from the others of their step are merged into one. A template
is rejected if its share of bad labels, smoothed towards the share in the whole
table, reaches ``REJECT``.

In a template ``*`` is the wildcard branch and ``*n*`` the merged one of step n;
a star in a path is written ``%2A``.

Every step groups by keys that contain the segment or joins on them, so a host
with a third of all pages is counted by many tasks and pre-aggregated in each.
Pages whose key is null or many pages have don't meet in a task to get their label.
Branches that are kept (by their support, at most one in ``MIN_PAGES`` pages)
and templates are broadcast where they are counted to be few, else Spark splits
skewed joins. Each level is checkpointed. The levels end where no page is left
that shares its node with enough pages and labels for a branch below it: there
the rest of every path is wildcards, one a segment.

Defined results: a null url, or one without ``://``, has empty host and path,
no rule and the template of the empty path; a url without labels anywhere is
allowed; repeated urls are judged alike and repeated labels of a key count
once, bad if any of them is; a key that is null has no label; other columns
pass through (ones named like an output are replaced); an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_hot, small, table
from .html import host_of

#: Pages and labels that a branch of its own needs.
MIN_PAGES, MIN_LABELS = 20, 8
#: Steps of branches that may merge, in radians of the arcsine of the share's root.
STEP = 0.2
#: Normal quantile beyond which two branches differ; labels' worth of smoothing; share of bad labels that rejects.
DIFFERENT, STRENGTH, REJECT = 2.58, 10.0, 0.5
OUT = ("host", "path", "rule", "verdict", "template", "bad_share")


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains, below a path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    at = F.locate("://", url)
    rest = F.regexp_extract(F.substring(url, at + 3, F.length(url)), "(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.when(at > 0, rest), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def _same(a: Column, b: Column) -> Column:
    """Whether two (bad, labelled) counts may come from one share."""
    bad_a, n_a, bad_b, n_b = a["bad"], a["labelled"], b["bad"], b["labelled"]
    share = (bad_a + bad_b) / F.greatest(n_a + n_b, F.lit(1))
    noise = F.sqrt(share * (1 - share) * (1 / F.greatest(n_a, F.lit(1)) + 1 / F.greatest(n_b, F.lit(1))))
    apart = F.abs(bad_a / F.greatest(n_a, F.lit(1)) - bad_b / F.greatest(n_b, F.lit(1)))
    return (n_a < MIN_LABELS) | (n_b < MIN_LABELS) | (apart <= DIFFERENT * noise)


def templates(urls: DataFrame) -> DataFrame:
    """``urls`` (key, host, path, bad: true, false or null) with ``template``."""
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    now = cut(urls.withColumn("s", parts).withColumn("template", F.lit("")))
    node = ["host", "template"]
    level = 0
    while True:
        level += 1
        now = now.withColumn("seg", F.get("s", F.lit(level - 1)))
        child = now.filter("seg IS NOT NULL").groupBy(*node, "seg").agg(
            F.count(F.lit(1)).alias("pages"),
            F.count("bad").alias("labelled"),
            F.sum(F.when(F.col("bad"), 1).otherwise(0)).alias("bad"),
        )
        all_ = child.groupBy(*node).agg(F.sum("pages").alias("all_pages"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
        mine = F.struct("bad", "labelled")
        rest = F.struct((F.col("all_bad") - F.col("bad")).alias("bad"), (F.col("all_labelled") - F.col("labelled")).alias("labelled"))
        able = child.filter((F.col("pages") >= MIN_PAGES) & (F.col("labelled") >= MIN_LABELS))
        # Nodes only split further down, so below a level without such a node there is no branch.
        if all_.filter((F.col("all_pages") >= MIN_PAGES) & (F.col("all_labelled") >= 2 * MIN_LABELS)).isEmpty():
            left = F.greatest(F.size("s") - F.lit(level - 1), F.lit(0))
            return now.withColumn("template", F.concat("template", F.repeat(F.lit("/*"), left))).drop("s", "seg")
        apart = cut(able.join(all_, node).filter(~_same(mine, rest)).select(*node, "seg", "bad", "labelled"))
        at = F.floor(F.asin(F.sqrt(F.col("bad") / F.col("labelled"))) / STEP).cast("string")
        apart = apart.withColumn("step", at)
        like = apart.groupBy(*node, "step").agg(F.sum("bad").alias("all_bad"), F.sum("labelled").alias("all_labelled"))
        # A branch alone in its step has no others, so nothing to merge with.
        merged = (F.col("all_labelled") > F.col("labelled")) & _same(mine, rest)
        own = F.when(merged, F.concat(F.lit("/*"), "step", F.lit("*"))).otherwise(F.concat(F.lit("/"), F.replace("seg", F.lit("*"), F.lit("%2A"))))
        named = cut(apart.join(like, [*node, "step"]).select(*node, "seg", own.alias("own")))
        step = F.when(F.col("seg").isNull(), F.lit("")).otherwise(F.coalesce("own", F.lit("/*")))
        # Each level is read twice by the next: without a cut the plan would double with every level.
        now = cut(now.join(small(named), [*node, "seg"], "left").withColumn("template", F.concat("template", step)).drop("seg", "own"))


def judge(pages: DataFrame, labels: DataFrame, key: Column, url: str = "url", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``pages`` with host, path, rule, verdict, template and bad_share.

    ``labels`` has columns ``key`` and ``bad``; ``key`` is the expression on
    ``pages`` that meets it.
    """
    kept = [c for c in pages.columns if c not in OUT]
    known = labels.filter("key IS NOT NULL AND bad IS NOT NULL").groupBy("key").agg(F.max("bad").alias("bad"))
    keyed = pages.select(F.struct(*kept).alias("row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), key.alias("key"))
    counted = keyed.filter("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    side = cut(counted.join(known, "key", "left"))
    labelled = join_hot(keyed.filter("key IS NOT NULL"), side, "key", "rows")
    named = templates(labelled.unionByName(keyed.filter("key IS NULL").withColumn("bad", F.lit(None).cast("boolean"))).drop("key"))
    count = named.groupBy("host", "template").agg(F.count("bad").alias("n"), F.sum(F.when(F.col("bad"), 1).otherwise(0)).alias("bad_n"))
    prior = named.agg(F.coalesce(F.avg(F.col("bad").cast("double")), F.lit(0.0))).first()[0]
    purity = count.select("host", "template", ((F.col("bad_n") + F.lit(STRENGTH * prior)) / (F.col("n") + F.lit(STRENGTH))).alias("bad_share"))
    rule = longest_rule(F.col("host"), F.col("path"), rules)
    out = named.join(small(cut(purity)), ["host", "template"]).withColumn("by", rule)
    verdict = F.coalesce("by.verdict", F.when(F.col("bad_share") >= REJECT, "block").otherwise("allow"))
    return out.select("row.*", "host", "path", F.col("by.rule").alias("rule"), verdict.alias("verdict"), "template", "bad_share")


def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url.

    A page shows the document whose id ends its path; it is bad if that
    document is labelled as of low quality or toxic.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    key = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1).try_cast("long")
    return judge(pages, labels, key).select("page_id", "host", "path", "rule", "verdict", "template", "bad_share")
