"""Text sources and sinks with explicit schemas."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Headers that name a column of urls, best first.
URL_HEADERS = ("url", "link", "imdb", "href", "website", "company_url")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder; under a local master a temporary one where none is named."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    master = spark.sparkContext.master
    if not shared and (not master.startswith("local") or master.startswith("local-cluster")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='tidewright-')}/{name}-{uuid.uuid4().hex}"


def url_column(df: DataFrame, domain: str, headers: Sequence[str] = URL_HEADERS) -> DataFrame:
    """(url): the column whose header names urls, else one whose header is a url of the domain itself, else the first; rows of the domain only."""
    low = {c: c.strip().lower() for c in df.columns}
    named = [c for h in headers for c in df.columns if h in low[c]]
    itself = [c for c in df.columns if domain in low[c]]
    column = (named or itself or df.columns)[0]
    urls = df.select(F.trim(F.col(f"`{column}`")).alias("url"))
    if not named and itself:
        urls = urls.unionByName(df.sparkSession.createDataFrame([(column.strip(),)], "url string"))
    return urls.filter(F.lower("url").contains(domain))


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Fixed columns in a fixed order, with a header; absent columns are empty."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns]
    df.select(*shown).write.option("header", True).option("emptyValue", "").option("quoteAll", True).csv(path)


def read_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    return spark.read.option("header", True).schema(", ".join(f"`{c}` string" for c in columns)).csv(path).fillna("")


def write_buckets(df: DataFrame, path: str, bucket: str) -> None:
    """JSON lines, a folder a bucket."""
    df.write.partitionBy(bucket).json(path)


def read_buckets(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
