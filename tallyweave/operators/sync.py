"""Merging of synchronised changes: pages of transactions pulled by ingest time, batches pushed and acknowledged.

What is pulled may hold rows pulled before, rows of this device, several copies of a row, and tombstones that come before or
after what they remove. The merge is independent of that order: it is an anti-join against all tombstones.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.loose import first_text, is_true, whole_number
from ..sources.tables import latest

DELETED = "deleted"
BATCH = 50
LOOKBACK_S = 10
STALE_H = 12
ROWS_A_BUCKET = 100_000


def to_wire(ledger: DataFrame, device: str) -> DataFrame:
    """Transactions as they are sent; a row without a device gets this one. TargetTransactionId is null but for tombstones."""
    target = F.col("target_txn_id").cast("string") if "target_txn_id" in ledger.columns else F.lit(None).cast("string")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return ledger.select(
        F.col("txn_id").alias("TransactionId"), text("date").alias("Date"), text("store_id").alias("StoreId"), text("product_id").alias("ProductId"), text("type").alias("Type"), F.coalesce("qty", F.lit(0)).cast("bigint").alias("Qty"),
        text("staff_name").alias("StaffName"), text("reason").alias("Reason"), first_text("device_id", default=device).alias("DeviceId"), F.unix_millis(F.col("created_at").cast("timestamp")).alias("Timestamp"), text("transfer_id").alias("TransferId"),
        F.nullif(target, F.lit("")).alias("TargetTransactionId"),
    )


def to_migration(ledger: DataFrame) -> DataFrame:
    """Transactions of an old store as they are sent, all in the name of one device; quantities that are no numbers are 0."""
    rows = ledger.withColumns({"qty": whole_number(F.col("qty").cast("string")), "device_id": F.lit("migration_v2")})
    wire = to_wire(rows, "migration_v2")
    return wire.withColumn("Timestamp", F.coalesce("Timestamp", F.lit(0)))


def pushed(ledger: DataFrame, post: Callable[[list[dict]], dict], device: str, size: int = BATCH, tries: int = 4, wait_s: float = 2.0) -> DataFrame:
    """batch_no, txn_ids, sent, processed, error: what is unsynced, posted in batches by the executors, with what the service answered.

    post takes the rows of a batch and returns the answer; a batch that fails is posted again after a wait that grows. The service
    knows rows by their TransactionId, so a task that runs again does no harm. Write the result before it is used twice.
    """
    rows = batched(unsynced(ledger), size)
    wire = to_wire(rows.withColumn("txn_id", F.struct("txn_id", "batch_no")), device)
    wire = wire.select(F.col("TransactionId.batch_no").alias("batch_no"), F.col("TransactionId.txn_id").alias("TransactionId"), *wire.columns[1:])

    def send(batch):
        import time

        import pandas as pd

        body = batch.drop(columns="batch_no").astype(object).where(lambda x: x.notna(), None).to_dict("records")
        answer, error = {}, None
        for n in range(tries):
            try:
                answer, error = post(body) or {}, None
                break
            except Exception as e:  # whatever the service or the network says
                error = str(e)
                if n + 1 < tries:
                    time.sleep(wait_s * (n + 1))
        done = pd.array([answer.get("processedCount")], dtype="Int64")
        return pd.DataFrame({"batch_no": batch["batch_no"].iloc[:1], "txn_ids": [batch["TransactionId"].tolist()], "sent": len(batch), "processed": done, "error": [error]})

    return wire.groupBy("batch_no").applyInPandas(send, "batch_no bigint, txn_ids array<string>, sent bigint, processed bigint, error string")


def confirmed(acks: DataFrame) -> DataFrame:
    """txn_id of all rows of batches that the service has confirmed as a whole: those that marked_synced() is to mark."""
    return acks.where(acknowledged(F.col("processed"), F.col("sent"))).select(F.explode("txn_ids").alias("txn_id"))


def push_totals(acks: DataFrame) -> DataFrame:
    """batches, sent, failed: rows of confirmed batches, and of those that failed or weren't confirmed as a whole."""
    ok = acknowledged(F.col("processed"), F.col("sent"))
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("sent"))), F.lit(0)).cast("bigint")
    return acks.agg(F.count("*").alias("batches"), total(ok).alias("sent"), total(~ok).alias("failed"))


def from_wire(pulled: DataFrame) -> DataFrame:
    """Received rows as transactions, marked as synced; quantities that are no numbers are 0."""
    return pulled.select(
        F.col("TransactionId").alias("txn_id"), F.col("Type").alias("type"), F.col("ProductId").alias("product_id"), whole_number(F.col("Qty").cast("string")).alias("qty"), F.col("StoreId").alias("store_id"), F.nullif("TransferId", F.lit("")).alias("transfer_id"),
        F.substring("Date", 1, 10).try_cast("date").alias("date"), F.col("StaffName").alias("staff_name"), F.col("Reason").alias("reason"), F.timestamp_millis("Timestamp").alias("created_at"), F.col("DeviceId").alias("device_id"), F.lit(True).alias("synced"), F.nullif("TargetTransactionId", F.lit("")).alias("target_txn_id"),
    )


def window(log: DataFrame, since: datetime | None, until: datetime, lookback_s: int = LOOKBACK_S, time: str = "SyncTimestamp") -> DataFrame:
    """The rows ingested after `since` less the lookback, up to `until`; all up to it where since is null. The filter reaches the scan."""
    out = log.where(F.col(time) <= F.lit(until))
    return out if since is None else out.where(F.col(time) > F.lit(since) - F.make_dt_interval(secs=F.lit(float(lookback_s))))


def one_copy(pulled: DataFrame) -> DataFrame:
    """One row of each TransactionId: of several copies the last ingested, then the last written, then the last by the other columns."""
    first = [c for c in ("SyncTimestamp", "Timestamp") if c in pulled.columns]
    return latest(pulled, ["TransactionId"], [*first, *(c for c in pulled.columns if c not in (*first, "TransactionId"))])


def live(pulled: DataFrame) -> DataFrame:
    """One row of each TransactionId that is neither blank nor a tombstone, as one_copy() has it."""
    return one_copy(pulled.where(~F.col("Type").eqNullSafe(DELETED) & (first_text(F.col("TransactionId").cast("string")) != "")))


def marks(pulled: DataFrame) -> DataFrame:
    """One row of each tombstone."""
    return one_copy(pulled.where(F.col("Type") == DELETED))


def targets(pulled: DataFrame) -> DataFrame:
    """txn_id of what tombstones remove: their target, or themselves where they name none."""
    target = first_text(F.col("TargetTransactionId").cast("string"), F.col("TransactionId").cast("string"))
    return pulled.where(F.col("Type") == DELETED).select(target.alias("txn_id")).where("txn_id <> ''").distinct()


def merged_ids(local: DataFrame, pulled: DataFrame, device: str | None = None) -> DataFrame:
    """txn_id of the ledger after the pull: local rows and new ones of other devices, without what any tombstone removes."""
    new = live(pulled)
    if device is not None:
        new = new.where(~F.col("DeviceId").cast("string").eqNullSafe(device))
    both = local.select(F.col("txn_id").cast("string").alias("txn_id")).unionByName(new.select(F.col("TransactionId").cast("string").alias("txn_id"))).distinct()
    return both.join(targets(pulled), "txn_id", "left_anti")


def merged(local: DataFrame, pulled: DataFrame, device: str | None = None) -> DataFrame:
    """The ledger itself after the pull, as from_wire() gives it."""
    new = live(pulled)
    if device is not None:
        new = new.where(~F.col("DeviceId").eqNullSafe(device))
    added = from_wire(new).join(local.select("txn_id"), "txn_id", "left_anti")
    return local.unionByName(added, allowMissingColumns=True).join(targets(pulled), "txn_id", "left_anti")


def merged_in_order(local: DataFrame, pulled: DataFrame) -> DataFrame:
    """txn_id after a pull whose tombstones remove only what was there before it; what came with them stays. For comparison."""
    before = local.select(F.col("txn_id").cast("string").alias("txn_id")).distinct()
    kept = before.join(targets(pulled), "txn_id", "left_anti")
    new = live(pulled).select(F.col("TransactionId").cast("string").alias("txn_id")).join(before, "txn_id", "left_anti")
    return kept.unionByName(new)


def overlap(local: DataFrame, pulled: DataFrame) -> DataFrame:
    """overlap: how many pulled rows were there already."""
    known = live(pulled).select(F.col("TransactionId").cast("string").alias("txn_id")).join(local.select(F.col("txn_id").cast("string").alias("txn_id")), "txn_id", "left_semi")
    return known.agg(F.count("*").alias("overlap"))


def unsynced(ledger: DataFrame) -> DataFrame:
    return ledger.where(~is_true(F.col("synced")))


def acknowledged(processed: Column, sent: Column) -> Column:
    """Whether a push counts as received: the server's count must be there and equal what was sent. Its status changes nothing."""
    return is_true(processed == sent)


def marked_synced(ledger: DataFrame, batch: DataFrame) -> DataFrame:
    """The ledger with the rows of an acknowledged batch (txn_id) marked."""
    sent = batch.select("txn_id", F.lit(True).alias("sent")).distinct()
    joined = ledger.join(sent, "txn_id", "left")
    return joined.withColumn("synced", is_true(F.col("sent")) | is_true(F.col("synced"))).select(*ledger.columns)


def batched(ledger: DataFrame, size: int = BATCH, buckets: int | None = None) -> DataFrame:
    """ledger with batch_no, from 0: runs of `size` rows, all full but the last, in order of the hash bucket and id of a row.

    Without `buckets` their number follows the rows, about ROWS_A_BUCKET in each.

    Rows are numbered within their buckets and the buckets' counts give where each begins, so that no task numbers them all.
    """
    buckets = buckets or ledger.count() // ROWS_A_BUCKET + 1
    spread = ledger.withColumn("_bucket", F.pmod(F.xxhash64("txn_id"), F.lit(buckets)))
    counts = spread.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_bucket").orderBy("txn_id")
    numbered = spread.join(starts, "_bucket").withColumn("_at", F.col("_start") + F.row_number().over(within) - 1)
    return numbered.select(*ledger.columns, F.floor(F.col("_at") / size).cast("bigint").alias("batch_no"))


def stale(log: DataFrame, now: datetime, hours: int = STALE_H, device: str = "DeviceId", time: str = "SyncTimestamp") -> DataFrame:
    """device_id, last_sync of devices whose last row is more than `hours` hours before now."""
    last = log.groupBy(F.col(device).alias("device_id")).agg(F.max(time).alias("last_sync"))
    return last.where(F.col("last_sync") < F.lit(now) - F.make_dt_interval(hours=F.lit(hours)))


def leader(claims: DataFrame) -> DataFrame:
    """tab_id of the tab that leads: the first started, of equals the smallest id."""
    return claims.agg(F.min_by("tab_id", F.struct("started_at", "tab_id")).alias("tab_id"))
