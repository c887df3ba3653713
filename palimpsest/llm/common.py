"""Small helpers that several operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import on_workers


#: Rows of an Arrow batch. Whole texts travel to Python, so a batch of Spark's own default would hold tens of megabytes.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    on_workers(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's ``spark.checkpoint.dir``.

    Only a session on one machine may name none (tests); a temporary folder is taken then.
    """
    on_workers(spark)
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir is not set; on a cluster it must name a folder that all executors share")
    made = os.path.join(tempfile.gettempdir(), f"palimpsest-shared-{os.getpid()}")
    os.makedirs(made, exist_ok=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """``checkpoint()`` into the shared folder, so that a lost executor never takes the rows with it."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back; columnar and compressed, unlike ``cut``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Removes a table that was written in the shared folder and is not read any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def parts_for(rows: int, each: int, least: int = 64) -> int:
    """How many parts keep about ``each`` rows in a part; never fewer than ``least`` so that small tables spread too."""
    return max(least, -(-rows // each))


def crc_mod(column: str, modulus: int) -> "F.Column":
    """crc32 of the id's decimal text, modulo ``modulus`` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def grouped(batches: Iterator, keys: list[str]) -> Iterator:
    """Regroup pandas batches, sorted by ``keys`` within the partition, into one frame for each key."""
    import numpy as np
    import pandas as pd

    held: list = []
    last = None
    for pdf in batches:
        if not len(pdf):
            continue
        k = pdf[keys].to_numpy()
        edges = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1), len(k)]
        for a, b in zip(edges, edges[1:]):
            now = tuple(k[a])
            if held and now != last:
                yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
                held = []
            last = now
            held.append(pdf.iloc[a:b])
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]


def slim(run):
    """``run`` over the batches of a task, after which its Python worker, which serves later stages too, gives free memory back."""
    def slimmed(batches):
        yield from run(batches)
        give_back()

    return slimmed


def give_back() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)  # glibc keeps freed pages otherwise
    except (AttributeError, OSError):  # another C library
        pass
