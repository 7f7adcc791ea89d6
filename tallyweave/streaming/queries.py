"""Streaming queries over the driver's event log, run to the end of what is there."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger, transfers
from ..plans.oracle import ORACLE as plans_oracle
from ..plans.oracle import sql
from ..sources import bindings, retention, tables, transfer_store
from ..sources.commit_log import CommitLog
from . import merge, stock


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: in spark.checkpoint.dir, or one of our own where that is unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    root = root or "file://" + tempfile.mkdtemp(prefix="tallyweave-stream-")
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex[:12]}"


def _replayed_log(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """The synchronised log as a stream of two sets of files, the second of which holds a part of the first again."""
    log = bindings.sync_log(spark, sf_dir)
    log.write.parquet(f"{folder}/log")
    log.where(F.col("SyncTimestamp") > F.lit("2024-01-20").cast("timestamp")).write.mode("append").parquet(f"{folder}/log")
    return merge.read_log(spark, f"{folder}/log", log.schema, per_trigger=2)


def stream_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """txn_id of the ledger after the whole log, with replays, has been merged in micro-batches."""
    folder = _folder(spark)
    merge.start(_replayed_log(spark, sf_dir, folder), f"{folder}/store", f"{folder}/checkpoint").awaitTermination()
    return merge.ledger(spark, f"{folder}/store").select("txn_id")


def stream_merge_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As stream_merge, with every second micro-batch packed and the batches in packs deleted."""
    folder = _folder(spark)
    merge.start(_replayed_log(spark, sf_dir, folder), f"{folder}/store", f"{folder}/checkpoint", pack_every=2).awaitTermination()
    for table in ("transactions", "deleted_transactions"):
        tables.delete_packed(spark, f"{folder}/store", table)
    return merge.ledger(spark, f"{folder}/store").select("txn_id")


def stream_merge_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As stream_merge_packed, with transactions in buckets of their id, so that merging doesn't shuffle the ledger."""
    folder = _folder(spark)
    merge.start(_replayed_log(spark, sf_dir, folder), f"{folder}/store", f"{folder}/checkpoint", pack_every=2, buckets=8).awaitTermination()
    return merge.ledger(spark, f"{folder}/store").select("txn_id")


def stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """batch, live, added, overlap, marks: counts taken while the log, then a part of it again, was merged."""
    folder, log = _folder(spark), bindings.sync_log(spark, sf_dir)
    root = f"{folder}/store"
    for n, rows in enumerate((log, log.where(F.col("SyncTimestamp") > F.lit("2024-01-20").cast("timestamp")))):
        rows.write.parquet(f"{folder}/log{n}")
        stream = merge.read_log(spark, f"{folder}/log{n}", log.schema)
        epoch = CommitLog(spark, root).claim(merge.WRITER)
        run = merge.merge_batch(root, epoch=epoch)
        stream.writeStream.foreachBatch(lambda batch, _, run=run, n=n: run(batch, n)).option("checkpointLocation", f"{folder}/checkpoint{n}").trigger(availableNow=True).start().awaitTermination()
    seen = CommitLog(spark, root).history().where("note is not null")
    return seen.select("batch", *(F.col("note")[c].alias(c) for c in ("live", "added", "overlap", "marks")))


def transfer_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, status, version, units of transfers after steps that were saved as versions with their entries: made, received, cancelled, received again."""
    log = CommitLog(spark, f"{_folder(spark)}/store")
    first = bindings.transfers(spark, sf_dir)
    transfer_store.save(log, 0, first, transfers.sent_entries(first), "headers", "entries")
    rows = transfer_store.current(log, transfers="headers")
    for step in (1, 1):  # a step that is run again changes nothing
        got = transfers.received(rows.where("id % 4 = 0"), bindings.receipts(rows))
        transfer_store.save(log, step, got, transfers.receipt_entries(got), "headers", "entries")
    rows = transfer_store.current(log, transfers="headers")
    off = rows.where("id % 3 = 0")
    transfer_store.save(log, 2, transfers.cancelled(off), transfers.cancel_entries(off), "headers", "entries")
    state = log.state()
    sign = F.when(F.col("type") == "transfer_out", -F.col("qty")).otherwise(F.col("qty"))
    units = log.read("entries", state).groupBy(F.col("transfer_id").alias("id")).agg(F.sum(sign).cast("bigint").alias("units"))
    return transfer_store.current(log, state, "headers", ("id", "status", "version")).join(units, "id", "left")


def store_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL over views of a store says: status, n, qty of transfers and what the ledger has of them, at the number before the last commit."""
    log = CommitLog(spark, f"{_folder(spark)}/store")
    rows = bindings.ledger(spark, sf_dir).select("txn_id", "type", "qty", "transfer_id")
    log.commit({"v_ledger": rows.where("transfer_id % 2 = 0"), "v_transfers": bindings.transfer_headers(spark, sf_dir)}, 0)
    log.commit({"v_ledger": rows.where("transfer_id % 2 = 1")}, 1)
    tables.as_views(spark, log.root, ("v_ledger", "v_transfers"), log.state(0))
    return spark.sql("SELECT status, count(*) AS n, sum(qty) AS qty FROM v_ledger JOIN v_transfers ON transfer_id = id GROUP BY status")


def retention_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, status, completed_date of the transfers that are left of a table by month once it is pruned."""
    path = f"{_folder(spark)}/transfers"
    retention.write(bindings.transfer_headers(spark, sf_dir), path)
    retention.prune(spark, path, F.lit("2000-01-01").cast("timestamp_ntz"))
    return retention.read(spark, path).select("id", "status", F.date_format("completed_date", "yyyy-MM-dd").alias("completed_date"))


def stream_on_hand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """store_id, product_id, on_hand: running sums over the log once, as its last trigger leaves them."""
    folder = _folder(spark)
    log = _typed(bindings.sync_log(spark, sf_dir))
    log.write.parquet(f"{folder}/log")
    sums = merge.on_hand(merge.without_replays(merge.read_log(spark, f"{folder}/log", log.schema)))

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/sums/batch={batch_id}")

    sums.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{folder}/sums").groupBy("store_id", "product_id").agg(F.max_by("on_hand", "batch").cast("bigint").alias("on_hand"))
    return last.select(F.col("store_id").cast("string"), F.col("product_id").cast("string"), "on_hand")


def _typed(log: DataFrame) -> DataFrame:
    """The log with types that move stock."""
    return log.withColumn("Type", F.when(F.col("Type") == "purchase", "out").when(F.col("Type") == "deleted", "deleted").otherwise("in"))


def stream_on_hand_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """store_id, product_id, on_hand kept up to date by a stream in which rows and their tombstones come in any order and batch, some twice."""
    folder = _folder(spark)
    log = _typed(bindings.sync_log(spark, sf_dir))
    log.repartition(4, F.xxhash64("TransactionId")).write.parquet(f"{folder}/log")
    log.where(F.col("SyncTimestamp") > F.lit("2024-01-25").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{folder}/log")
    stream = merge.read_log(spark, f"{folder}/log", log.schema, per_trigger=2)
    stock.start(stream, f"{folder}/store", f"{folder}/checkpoint", pack_every=2).awaitTermination()
    return stock.on_hand(spark, f"{folder}/store")


def commit_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """store_id, product_id, on_hand of a ledger and its deletions that were committed together in parts, some more than once.

    One part is begun by a driver that dies before its entry is in the log, one is committed twice, and one is tried by a writer
    whose successor has claimed the store. Both tables are read at one number. The pack has the ledger in buckets of the id, so what
    packs it is its only shuffle: the deletions are brought to it.
    """
    from ..sources.commit_log import StaleWriter

    root = f"{_folder(spark)}/store"
    log, rows = CommitLog(spark, root), bindings.ledger(spark, sf_dir).select("txn_id", "type", "store_id", "product_id", "qty", "transfer_id")

    def part(n: int) -> dict[str, DataFrame]:
        mine = rows.where(F.col("transfer_id") % 4 == n)
        return {"ledger": mine, "ledger_deleted": mine.where("transfer_id % 17 = 0").select("txn_id")}

    old = log.claim("import")
    log.commit(part(0), 0, "import", old)
    part(1)["ledger"].write.parquet(f"{root}/_data/ledger/died")  # and nothing in the log
    new = log.claim("import")
    try:
        log.commit(part(1), 1, "import", old)
    except StaleWriter:
        pass
    for n in (1, 2, 2, 3, 0):
        log.commit(part(n), n, "import", new)
    log.pack("ledger", "txn_id", bucket_rows=bindings.LINES_A_TASK)
    state = log.state()
    return ledger.on_hand(ledger.removed(log.read_bucketed("ledger", state), log.read("ledger_deleted", state)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (stream_merge, stream_merge_packed, stream_merge_bucketed, stream_metrics, retention_prune, transfer_versions, store_views, stream_on_hand, stream_on_hand_after_delete, commit_recovered)}

_MERGED = """SELECT CAST(event_id AS VARCHAR) AS txn_id FROM events WHERE event_type <> 'error' AND CAST(event_id AS VARCHAR) NOT IN
    (SELECT coalesce(json_extract_string(props, '$.k'), CAST(event_id AS VARCHAR)) FROM events WHERE event_type = 'error')"""
ORACLE: dict[str, str] = {
    "stream_merge": _MERGED,
    "stream_merge_packed": _MERGED,
    "stream_merge_bucketed": _MERGED,
    "stream_metrics": """SELECT CAST(n AS BIGINT) AS batch, count(*) FILTER (event_type <> 'error') AS live, CASE n WHEN 0 THEN count(*) FILTER (event_type <> 'error') ELSE 0 END AS added,
        CASE n WHEN 0 THEN 0 ELSE count(*) FILTER (event_type <> 'error') END AS overlap, count(*) FILTER (event_type = 'error') AS marks
        FROM events, range(2) r(n) WHERE n = 0 OR ts > TIMESTAMP '2024-01-20' GROUP BY n""",
    "transfer_versions": sql("""
        SELECT t.id, CASE WHEN t.id % 3 = 0 AND coalesce(s.status, t.status) IN ('draft', 'in_transit') THEN 'cancelled' ELSE coalesce(s.status, t.status) END AS status,
               CASE WHEN t.id % 3 = 0 AND coalesce(s.status, t.status) IN ('draft', 'in_transit') THEN 2 WHEN s.status IS NOT NULL THEN 1 ELSE CAST(0 AS BIGINT) END AS version,
               CAST(CASE WHEN t.status = 'in_transit' AND o.units IS NOT NULL THEN -o.units + CASE WHEN t.id % 4 = 0 THEN coalesce(s.units, 0) WHEN t.id % 3 = 0 THEN o.units ELSE 0 END END AS BIGINT) AS units
        FROM t LEFT JOIN (SELECT transfer_id, sum(sent_qty) AS units FROM sums GROUP BY 1) o ON o.transfer_id = t.id
        LEFT JOIN (SELECT id, CASE WHEN bool_and(CASE WHEN product_id % 11 = 0 THEN 0 ELSE came END = sent_qty) IS NOT FALSE THEN 'completed' ELSE 'received' END AS status, sum(sent_qty) FILTER (CASE WHEN product_id % 11 = 0 THEN 0 ELSE came END = sent_qty) AS units
                   FROM t LEFT JOIN came ON transfer_id = id WHERE status = 'in_transit' AND id % 4 = 0 GROUP BY id) s ON s.id = t.id"""),
    "store_views": sql("SELECT status, count(*) AS n, CAST(sum(qty) AS BIGINT) AS qty FROM ledger JOIN t ON transfer_id = id WHERE transfer_id % 2 = 0 GROUP BY status"),
    "retention_prune": plans_oracle["transfer_prune"],
    "stream_on_hand": """SELECT CAST(user_id % 7 AS VARCHAR) AS store_id, CAST(event_id % 50 AS VARCHAR) AS product_id,
        CAST(sum(CASE event_type WHEN 'purchase' THEN -1 WHEN 'error' THEN 0 ELSE 1 END * CAST(trunc(value) AS BIGINT)) AS BIGINT) AS on_hand
        FROM events GROUP BY 1, 2""",
    "stream_on_hand_after_delete": """SELECT CAST(user_id % 7 AS VARCHAR) AS store_id, CAST(event_id % 50 AS VARCHAR) AS product_id,
        CAST(sum(CASE event_type WHEN 'purchase' THEN -1 ELSE 1 END * CAST(trunc(value) AS BIGINT)) AS BIGINT) AS on_hand
        FROM events WHERE event_type <> 'error' AND CAST(event_id AS VARCHAR) NOT IN (SELECT coalesce(json_extract_string(props, '$.k'), CAST(event_id AS VARCHAR)) FROM events WHERE event_type = 'error') GROUP BY 1, 2""",
    "commit_recovered": plans_oracle["on_hand_after_delete"],
}
