"""Snippets that arrive as files, kept as the newest state of every node."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from taproot.operators.current import current_rows


def follow(spark: SparkSession, source: str, schema, target: str, checkpoint: str, keys: list[str], order: list[str]) -> StreamingQuery:  # noqa: ANN001
    """Read new Parquet files of ``source`` and write each batch's newest rows under ``target``, one folder a batch.

    A batch that is run again overwrites its own folder, so rows are neither lost nor doubled.  :func:`snapshot` joins
    the batches.
    """

    def write(rows: DataFrame, batch: int) -> None:
        current_rows(rows, keys, order).write.mode("overwrite").parquet(f"{target}/batch={batch}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot(spark: SparkSession, target: str, keys: list[str], order: list[str]) -> DataFrame:
    return current_rows(spark.read.parquet(target).drop("batch"), keys, order)
