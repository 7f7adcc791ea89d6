"""Stock on hand kept up to date from the synchronised log, deletions included.

What is known of each transaction is kept in the store: what it moves, and that its tombstone has come, whichever was first. A new
row makes what it moves, a tombstone the inverse of what its target has moved; replays and rows deleted already make nothing. So
whatever the order, and whatever micro-batch a row and its tombstone are in, what is made adds up to the stock of the rows that
remain. A batch's changes are added up for each store and product and committed with what is new to know, under its number; packs
add up batches.

What is known grows with the transactions, since a tombstone may name any. A batch is joined with it, so a batch costs what it has
and a look at all that is known: few large batches suit it better than many small ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.loose import first_text
from ..operators.ledger import delta
from ..operators.sync import DELETED
from ..sources.commit_log import CommitLog

TABLE, KNOWN = "stock_changes", "stock_known"


def _rows(log: DataFrame) -> DataFrame:
    """id, gone (a tombstone of it), at, store_id, product_id, moved of wire transactions."""
    gone = F.col("Type").eqNullSafe(DELETED)
    own = F.col("TransactionId").cast("string")
    ident = F.when(gone, first_text(F.col("TargetTransactionId").cast("string"), own)).otherwise(first_text(own))
    at = F.coalesce(F.unix_micros("SyncTimestamp"), F.lit(0))
    rows = log.select(ident.alias("id"), gone.alias("gone"), at.alias("at"), F.col("StoreId").cast("string").alias("store_id"), F.col("ProductId").cast("string").alias("product_id"), delta("Type", F.col("Qty").try_cast("bigint")).cast("bigint").alias("moved"))
    return rows.where("id <> ''")


def changes(log: DataFrame, known: DataFrame) -> DataFrame:
    """What a batch of wire transactions tells that is not known: id, row and gone (what is new), store_id, product_id, moved, n (what it does to stock).

    n is 1 where a transaction has come, -1 where it has gone, else 0.
    """
    one = F.struct("at", F.coalesce("store_id", F.lit("")).alias("s"), F.coalesce("product_id", F.lit("")).alias("p"), "moved", "store_id", "product_id")
    told = _rows(log).groupBy("id").agg(F.bool_or("gone").alias("gone"), F.max(F.when(~F.col("gone"), one)).alias("found"))  # of several copies the last by ingest time
    was = known.groupBy("id").agg(F.max("moved").alias("was_moved"), F.max("store_id").alias("was_store"), F.max("product_id").alias("was_product"), F.bool_or("gone").alias("was_gone"))
    had, had_gone = F.col("was_moved").isNotNull(), F.coalesce("was_gone", F.lit(False))
    got, is_gone = F.col("found.moved").isNotNull(), had_gone | F.col("gone")
    there, was_there = (had | got) & ~is_gone, had & ~had_gone
    either = lambda old, new: F.when(had, F.col(old)).otherwise(F.col(f"found.{new}")).alias(new)
    n = F.when(there & ~was_there, 1).when(was_there & ~there, -1).otherwise(0).cast("bigint")
    out = told.join(was, "id", "left").select("id", (got & ~had).alias("row"), (is_gone & ~had_gone).alias("gone"), either("was_store", "store_id"), either("was_product", "product_id"), either("was_moved", "moved"), n.alias("n"))
    return out.where("row or gone")


def keep_batch(root: str, pack_every: int = 64, buckets: int | None = None):
    """A function for foreachBatch: adds up a batch's changes and commits them, and what is known from now on, under its number.

    buckets: lays what is known out in so many buckets of the id, so that it isn't shuffled with each batch.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        log = CommitLog(batch.sparkSession, root)
        found = changes(batch, log.read_bucketed(KNOWN)).persist()
        try:
            sums = found.where("n <> 0").groupBy("store_id", "product_id").agg(F.sum(F.col("n") * F.col("moved")).cast("bigint").alias("moved"), F.sum("n").cast("bigint").alias("n"))
            facts = found.select("id", *(F.when(F.col("row"), F.col(c)).alias(c) for c in ("store_id", "product_id", "moved")), "gone")
            log.commit({TABLE: sums, KNOWN: facts}, batch_id, buckets={KNOWN: ("id", buckets)} if buckets else None)
        finally:
            found.unpersist()
        if (batch_id + 1) % pack_every == 0:
            log.pack(TABLE, "product_id", sums=["moved", "n"])
            log.pack(KNOWN, "id")

    return run


def start(log: DataFrame, root: str, checkpoint: str, every: str | None = None, pack_every: int = 64, buckets: int | None = None) -> StreamingQuery:
    """Keeps the stock at root up to date with the log: with all there is, then ends; or `every` so often, until stopped."""
    writer = log.writeStream.foreachBatch(keep_batch(root, pack_every, buckets)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def on_hand(spark: SparkSession, root: str) -> DataFrame:
    """store_id, product_id, on_hand of what has any transaction left."""
    rows = CommitLog(spark, root).read(TABLE)
    sums = rows.groupBy("store_id", "product_id").agg(F.sum("moved").cast("bigint").alias("on_hand"), F.sum("n").alias("n"))
    return sums.where("n > 0").drop("n")
