"""Document-exposure analytics on Spark."""

from __future__ import annotations

import os


def on_workers(spark) -> None:
    """Lets Python workers on this machine import the package from where the driver has it.

    A session may have been started from another folder. On a cluster the package is installed or sent along
    (``--py-files``); a path that an executor does not have changes nothing there.
    """
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([home, *paths])


def dealt(rows, key: str):
    """Rows from which far more work or wider rows follow, dealt out to all cores by key: a few MB are one or two splits of a file."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)
