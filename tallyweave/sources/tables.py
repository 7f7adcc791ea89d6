"""Tables of the ledger: reading, seeding, overwriting, upserting, deleting and committing them.

A store of tables is a folder with one Parquet folder for each. Facts are appended and the latest version of a row counts, so
nothing is rewritten for one record; reference tables are small and are overwritten. Several tables change together through a
commit: all files of a batch are written first, and the batch counts once its entry is in the log (commit_log).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Mapping

from py4j.protocol import Py4JError
from pyspark import StorageLevel
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import SCHEMAS
from .commit_log import CommitLog, State

REFERENCE_TABLES = ("product_types", "categories", "products", "stores", "users", "thresholds")
FACT_TABLES = ("transactions", "deleted_transactions", "transfers", "cost_history", "stock_takes", "deliveries")


def _hadoop_path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _hadoop_path(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    """Drops a table or a whole store."""
    where, fs = _hadoop_path(spark, path)
    fs.delete(where, True)


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table of the store; an empty one where nothing has been written yet."""
    path = f"{root}/{table}"
    if not exists(spark, path):
        return spark.createDataFrame([], SCHEMAS[table])
    return spark.read.schema(SCHEMAS[table]).parquet(path) if table in SCHEMAS else spark.read.parquet(path)


def read_all(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {t: read(spark, root, t) for t in SCHEMAS}


def overwrite(df: DataFrame, root: str, table: str) -> None:
    """Replaces a table. What df reads must not be that table: write a new version beside it and commit that instead."""
    df.write.mode("overwrite").parquet(f"{root}/{table}")


def append(df: DataFrame, root: str, table: str) -> None:
    df.write.mode("append").parquet(f"{root}/{table}")


def seed(spark: SparkSession, root: str, tables: Mapping[str, list[dict]]) -> list[str]:
    """Writes literal rows into those tables that are empty; their names come back."""
    done = []
    for table, rows in tables.items():
        if read(spark, root, table).isEmpty():
            overwrite(spark.createDataFrame(rows, SCHEMAS[table]), root, table)
            done.append(table)
    return done


def latest(versions: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """One row for each key, the last by `version`. An aggregation: partial maxima are taken before the shuffle."""
    rest = [c for c in versions.columns if c not in key]
    last = versions.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("last"))
    return last.select(*(F.col(c) if c in key else F.col("last")[c].alias(c) for c in versions.columns))


def upserted(base: DataFrame, changes: DataFrame, key: list[str], version: list[str] | None = None) -> DataFrame:
    """base with the rows of `changes` in place of those of the same key; of several changes to one key the last by `version`.

    Without version the other columns decide, in their order, so that the same row counts whatever the order of the changes.
    """
    one = latest(changes, key, version or [c for c in changes.columns if c not in key])
    return base.join(one.select(*key), key, "left_anti").select(*changes.columns).unionByName(one)


def lookup(spark: SparkSession, root: str, table: str, key: str, value) -> DataFrame:
    """The rows of a table with this key; the filter reaches the scan."""
    return read(spark, root, table).where(F.col(key) == F.lit(value))


def refreshed(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table as it is now, whatever of its files the session has kept."""
    spark.catalog.refreshByPath(f"{root}/{table}")
    return read(spark, root, table)


def without(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return base.join(keys.select(key), key, "left_anti")


def counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """table_name, n_rows."""
    frames = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, df in tables.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# --- commits over several tables -------------------------------------------------------------------------------------


def commit(spark: SparkSession, root: str, batch_id: int, tables: Mapping[str, DataFrame], writer: str | None = None, epoch: int | None = None) -> bool:
    """Appends to several tables at once. A batch that is committed already changes nothing; one that broke off is written anew."""
    return CommitLog(spark, root).commit(tables, batch_id, writer, epoch)


def committed(spark: SparkSession, root: str, table: str, state: State | None = None) -> DataFrame:
    """The rows of a table's committed batches, from packs as far as there are any; at the last number, or at that of a state."""
    return CommitLog(spark, root).read(table, state)


def _last_pack(spark: SparkSession, root: str, table: str) -> int:
    return CommitLog(spark, root).state().last_pack(table)


def pack(spark: SparkSession, root: str, table: str, key: str) -> int | None:
    """Writes the committed batches since the last pack as one, in order of key; its number, or None where there are no such batches."""
    return CommitLog(spark, root).pack(table, key)


def delete_packed(spark: SparkSession, root: str, table: str) -> int:
    """Deletes the folders of batches that are in packs, for when nobody reads them any more; how many there were.

    Their batches still count, so one that is run again changes nothing. Not for tables that snapshot() reads.
    """
    return CommitLog(spark, root).delete_packed(table)


def save_all(spark: SparkSession, root: str, version: int, tables: Mapping[str, DataFrame]) -> bool:
    """Replaces several tables, such as all reference tables, at once: readers of snapshot() see all new ones or none.

    meta, if among them, gets its data version one higher.
    """
    new = {t: versioned(df) if t == "meta" else df for t, df in tables.items()}
    return commit(spark, root, version, new)


def snapshot(spark: SparkSession, root: str, table: str, state: State | None = None) -> DataFrame:
    """The rows that the last committed version of a table has."""
    log = CommitLog(spark, root)
    state = state or log.state()
    return log.read(table, state, max((x["batch"] for x in state.live.get(table, {}).values()), default=None))


def as_views(spark: SparkSession, root: str, names: Iterable[str], state: State | None = None, cached: bool = False) -> State:
    """Temporary views of committed tables for SQL, all at one number, that of a state or the last; the state that they show.

    cached: kept on the executors once they are read, in memory as far as it goes, then on disk. Views made again show what is new
    and drop what was kept.
    """
    log = CommitLog(spark, root)
    state = state or log.state()
    for name in names:
        if spark.catalog.tableExists(name) and spark.catalog.isCached(name):
            spark.catalog.uncacheTable(name)
        log.read(name, state).createOrReplaceTempView(name)
        if cached:
            spark.catalog.cacheTable(name, StorageLevel.MEMORY_AND_DISK)
    return state


def with_retry(work: Callable[[], None], attempts: int = 4, first_wait_s: float = 0.5) -> None:
    """Runs work until it succeeds, waiting twice as long after each failure; the last failure is raised."""
    for n in range(attempts):
        try:
            return work()
        except AnalysisException:  # a query that can't be planned won't be the next time
            raise
        except Exception:
            if n == attempts - 1:
                raise
            time.sleep(first_wait_s * 2**n)


# --- JSON ------------------------------------------------------------------------------------------------------------


def read_export(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One table of exports in JSON, each a file with an object that holds an array of rows for each table."""
    schema = f"struct<{table} array<struct<{SCHEMAS[table]}>>>"
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("x"))
    return whole.select(F.inline(F.col(f"x.{table}")))


def read_or_backup(spark: SparkSession, root: str, table: str, backup: str) -> DataFrame:
    """A table of the store, or the same table from its JSON backup where the store is missing or files of it are broken.

    Footers tell; a page that is broken behind a sound footer shows when the rows are read.
    """
    if exists(spark, f"{root}/{table}"):
        try:
            rows = read(spark, root, table)
            rows.count()  # the footers of all files, no more
            return rows
        except (PySparkException, Py4JError):  # broken files
            pass
    return read_export(spark, backup, table)


def sync_config(pages: DataFrame) -> DataFrame:
    """The configuration in pages of (ConfigType, ConfigData), ConfigData being JSON text: the first of type sync_config."""
    found = pages.where(F.col("ConfigType") == "sync_config").orderBy("ConfigData").limit(1)
    return found.select(F.from_json("ConfigData", "map<string,string>").alias("config"))


def versioned(meta: DataFrame) -> DataFrame:
    """meta with its data version one higher."""
    bumped = F.when(F.col("key") == "_v", (F.coalesce(F.col("value").try_cast("bigint"), F.lit(0)) + 1).cast("string")).otherwise(F.col("value"))
    return meta.withColumn("value", bumped)
