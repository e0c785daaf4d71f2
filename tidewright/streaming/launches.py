"""Streams against durable state: first-seen ids, and an append log with its keyed truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from tidewright.operators import dedupe


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at ``path``, empty where nothing has been written yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).parquet(path) if exists else spark.createDataFrame([], schema)


def announce_new(events: DataFrame, key: str, ordinal: str, seen_path: str, out_path: str, checkpoint: str) -> DataStreamWriter:
    """A stream that announces each id once, ever.

    Each batch's ids that the seen set lacks are added to it, and only the rows
    that were added are announced. While the seen set is empty the batch fills
    it silently. Both tables are keyed by batch, so a batch that runs again
    overwrites what it wrote before.
    """
    schema = T.StructType([f for f in events.schema.fields if f.name != ordinal])

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        with_batch = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
        seen = _read(spark, seen_path, with_batch).filter(F.col("batch") < number)
        first = seen.limit(1).count() == 0
        new = dedupe.insert_absent(seen, batch, [key], ordinal).select(*schema.names).persist()
        try:
            new.write.mode("overwrite").parquet(f"{seen_path}/batch={number}")
            if not first:
                new.write.mode("overwrite").parquet(f"{out_path}/batch={number}")
        finally:
            new.unpersist()

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def append_log(events: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Every result as it comes."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)


def compacted(log: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """The log's final truth: the last row of each key."""
    return dedupe.keep_last(log, keys, ordinal)
