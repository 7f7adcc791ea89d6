"""Retention that frees space: transfers kept by the month they ended in, so that pruning rewrites or drops only months that hold expired ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.loose import is_true
from . import tables

def _ended() -> Column:
    return F.coalesce("completed_date", "date")


def _month(at: Column) -> Column:
    """202401 of a time in January 2024, 0 without one."""
    return F.coalesce(F.year(at) * 100 + F.month(at), F.lit(0)).cast("int")


def write(transfers: DataFrame, path: str) -> None:
    """Writes transfers (id, status, date, completed_date and others) by month; ranges of month and id, so that no month is one task."""
    rows = transfers.withColumn("month", _month(_ended()))
    rows.repartitionByRange("month", "id").write.mode("overwrite").partitionBy("month").parquet(path)


def prune(spark: SparkSession, path: str, as_of: Column, days: int = 30) -> tuple[int, int]:
    """Deletes closed transfers that ended `days` days before as_of or earlier; how many months were rewritten and dropped.

    Only months up to that day's are read. One that has nothing else goes as a folder; others are written anew and take the place
    of the old files once they are whole. A prune that broke off is run again: what it has done already is not done twice.
    """
    before = as_of - F.make_dt_interval(F.lit(days))
    closed = F.col("status").isin("completed", "cancelled")
    expired = is_true(closed & ~is_true(_ended() > before))
    rows = spark.read.parquet(path).where(F.col("month") <= _month(before))
    counts = rows.groupBy("month").agg(F.count_if(expired).alias("old"), F.count("*").alias("n")).where("old > 0").collect()  # a row a month
    partly = [r["month"] for r in counts if r["old"] < r["n"]]
    if partly:
        kept = rows.where(F.col("month").isin(partly) & ~expired)
        kept.repartitionByRange("month", "id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
    wholly = [r["month"] for r in counts if r["old"] == r["n"]]
    for month in wholly:
        tables.delete(spark, f"{path}/month={month}")
    spark.catalog.refreshByPath(path)
    return len(partly), len(wholly)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("month")
