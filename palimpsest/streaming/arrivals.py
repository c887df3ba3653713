"""Scanning files as they arrive: a report depends on one file only, so no state and no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import scan

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def watch(spark: SparkSession, folder: str, output: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Adds the reports of new files below ``folder`` to the Parquet table ``output``, a partition ``epoch`` for each batch.

    A batch that is met again after a failure has the same epoch and the same files, so it replaces what it had written: each
    file is reported once.
    """
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").load(folder)

    def write(batch: DataFrame, epoch: int) -> None:
        done = scan.scan(batch.select(F.col("path").alias("file_id"), F.col("path").alias("name"), "content"))
        done.reports().write.mode("overwrite").parquet(f"{output.rstrip('/')}/epoch={epoch}")
        done.release()

    stream = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()
