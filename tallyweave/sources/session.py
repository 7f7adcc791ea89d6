"""A session set up as the library's queries expect it."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that hold for data of any size; the number of shuffle partitions and memory are the cluster's.
SETTINGS = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.parquet.filterPushdown": "true"}


def session(name: str, master: str | None = None, shared: str | None = None, **more: str) -> SparkSession:
    """shared: the folder that driver and executors share (spark.checkpoint.dir). more: further settings, _ standing for a dot."""
    settings = SETTINGS | ({"spark.checkpoint.dir": shared} if shared else {}) | {k.replace("_", "."): v for k, v in more.items()}
    builder = SparkSession.builder.appName(name).config(map=settings)
    return (builder.master(master) if master else builder).getOrCreate()
