"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one step of a Python worker turns into Python objects at a time.
SLICE_ROWS = 256
#: Rows of a batch between an executor and its workers, both of which hold it with its whole texts.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's rows of a batch to ``BATCH_ROWS``, if there are more."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only under a local master, as in tests, a temporary one takes its place
    where none is set.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidewright-"))
        named = context.getCheckpointDir()
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage."""
    bound_batches(df.sparkSession)
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Unlike a checkpoint's, its size is known from its files. Spark estimates a
    join as the product of its sides and a checkpoint keeps the estimate of
    its plan, so in a loop that joins the numbers would square in every round.
    """
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(side: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """``side``, marked for broadcast only if it was counted to have few rows.

    ``side`` must be materialised. Beyond ``most_rows`` the join is Spark's to plan.
    """
    return F.broadcast(side) if side.count() <= most_rows else side


def join_hot(rows: DataFrame, side: DataFrame, key: str, count: str, most_keys: int = 1000) -> DataFrame:
    """``rows`` joined to ``side``, whose ``count`` says how many of the rows have each ``key``.

    Keys with over 1/``most_keys`` of all rows, of which there can be no more
    than that, are broadcast; so no task gets the rows of a hot key. Keys are
    not null and ``side`` is materialised.
    """
    bar = F.lit((side.agg(F.sum(count)).first()[0] or 0) / most_keys)
    hot = side.filter(F.col(count) > bar).drop(count)
    names = [c for c in hot.columns if c != key]
    marked = rows.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), key, "left")
    done = marked.filter("__hot").select(*rows.columns, *names)
    rest = marked.filter("__hot IS NULL").select(*rows.columns).join(side.filter(F.col(count) <= bar).drop(count), key)
    return done.union(rest.select(*done.columns))


def parts(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(id_column: str, modulus: int):
    """crc32 of the id's decimal text, modulo ``modulus``."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % F.lit(modulus)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows, which bounds a worker's memory."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def batch_like(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    """A record batch of the given columns under ``schema``."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for f, c in ((f, columns[f.name]) for f in schema)],
        schema=schema,
    )
