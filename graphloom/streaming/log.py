"""The change log as a stream: appended Parquet files are applied to a state table batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.operators import versions


def follow(spark: SparkSession, path: str):
    return spark.readStream.schema(versions.LOG_SCHEMA).parquet(path)


def properties_stream(log: DataFrame) -> DataFrame:
    """The newest value of each (id, key) so far; a complete-mode aggregation over the followed log."""
    from pyspark.sql import functions as F

    return log.filter("op = 'set'").groupBy("id", "key").agg(F.max_by("value", "tx_id").alias("value"))


def apply_to(log: DataFrame, state_path: str, checkpoint: str):
    """Starts a query that appends each batch's committed changes to ``state_path``; a repeated batch replaces itself."""

    def batch(df: DataFrame, n: int) -> None:
        versions.committed(df).write.mode("overwrite").parquet(f"{state_path}/batch={n}")

    return log.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
