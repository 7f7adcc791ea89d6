"""Continuous merging of the synchronised log: file or paged sources, micro-batches that may be replayed, derived views.

Time is ingest time throughout: business dates are never a cursor, so late entries aren't lost. A micro-batch is committed under
its own number, so a batch that is run again after a failure changes nothing. A stream that starts claims the store: one that was
thought dead and still runs can't commit any more.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions.loose import first_text
from ..operators import sync
from ..operators.ledger import delta
from ..sources import tables
from ..sources.commit_log import CommitLog


def read_log(spark: SparkSession, path: str, schema, per_trigger: int | None = None) -> DataFrame:
    """The log as a stream of Parquet files; SyncTimestamp as a timestamp, which watermarks need."""
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


#: The name under which a merging stream claims its store.
WRITER = "merge"
#: The name of what is observed of the rows that a stream pulls.
PULLED = "pulled"


def merge_batch(root: str, device: str | None = None, pack_every: int = 64, epoch: int | None = None, buckets: int | None = None):
    """A function for foreachBatch: appends what is new in the batch to the store at root, and packs every so many batches.

    The counts of what was pulled, new and marked stand in the log's history; those of new and marked are of what was written, since
    what is observed above a shuffle that turns out empty is never told. buckets: lays transactions out in so many buckets of txn_id,
    so that the ledger isn't shuffled to find what it has already.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        log = CommitLog(spark, root)
        batch = batch.persist()
        try:
            new = sync.live(batch)
            if device is not None:
                new = new.where(~F.col("DeviceId").eqNullSafe(device))
            new = sync.from_wire(new)
            # packs are in order of txn_id, so the files that hold none of the batch's range of ids aren't read
            least, most, live = new.agg(F.min("txn_id"), F.max("txn_id"), F.count("*")).first()
            rows, gone = unknown(log, new, least, most), sync.from_wire(sync.marks(batch))
            note = lambda n: {"live": live, "added": n["transactions"], "overlap": live - n["transactions"], "marks": n["deleted_transactions"]}
            layout = {"transactions": ("txn_id", buckets)} if buckets else None
            log.commit({"transactions": rows, "deleted_transactions": gone}, batch_id, WRITER, epoch, layout, note)
            if (batch_id + 1) % pack_every == 0:
                for table in ("transactions", "deleted_transactions"):
                    log.pack(table, "txn_id")
        finally:
            batch.unpersist()

    return run


def unknown(log: CommitLog, new: DataFrame, least: str | None, most: str | None) -> DataFrame:
    """The rows of new, whose ids lie between least and most, that the store's transactions don't have."""
    known = log.read_bucketed("transactions").where(F.col("txn_id").between(least, most)).select("txn_id")
    return new.join(known, "txn_id", "left_anti")


class Progress(StreamingQueryListener):
    """Collects what start() observes of each micro-batch: rows pulled, and the last ingest time among them, by batch id.

    late: rows of any stream that came after its horizon and that its state didn't take, by batch id; the batch view has them.
    spark.streams.addListener(Progress())
    """

    def __init__(self) -> None:
        self.pulled: dict[int, int] = {}
        self.latest: dict[int, datetime | None] = {}
        self.late: dict[int, int] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.late[event.progress.batchId] = sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)
        seen = event.progress.observedMetrics.get(PULLED)
        if seen is not None:
            self.pulled[event.progress.batchId], self.latest[event.progress.batchId] = seen["n"], seen["latest"]

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def lag(self, now: datetime) -> timedelta | None:
        """How far the last row that was pulled lies behind now."""
        times = [t for t in self.latest.values() if t is not None]
        return now - max(times) if times else None


def start(log: DataFrame, root: str, checkpoint: str, device: str | None = None, every: str | None = None, pack_every: int = 64, buckets: int | None = None) -> StreamingQuery:
    """Merges the log into the store at root: all there is, then ends; or `every` so often, such as 30 seconds, until stopped."""
    epoch = CommitLog(log.sparkSession, root).claim(WRITER)
    log = log.observe(PULLED, F.count(F.lit(1)).alias("n"), F.max("SyncTimestamp").alias("latest"))
    writer = log.writeStream.foreachBatch(merge_batch(root, device, pack_every, epoch, buckets)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def ledger(spark: SparkSession, root: str, at: int | None = None) -> DataFrame:
    """The merged ledger: committed transactions without what any committed tombstone removes, both read at one number, the last or `at`."""
    state = CommitLog(spark, root).state(at)
    rows = tables.committed(spark, root, "transactions", state)
    gone = tables.committed(spark, root, "deleted_transactions", state).select(first_text("target_txn_id", "txn_id").alias("txn_id")).distinct()
    return rows.join(gone, "txn_id", "left_anti")


def without_replays(log: DataFrame, time: str = "SyncTimestamp", horizon: str = "10 minutes") -> DataFrame:
    """The stream with each TransactionId once, for replays that come within the horizon of ingest time: bounded state."""
    return log.withWatermark(time, horizon).dropDuplicatesWithinWatermark(["TransactionId"])


def on_hand(log: DataFrame) -> DataFrame:
    """A running sum for each store and product, for output mode update or complete; tombstones need the batch view."""
    return log.groupBy(F.col("StoreId").alias("store_id"), F.col("ProductId").alias("product_id")).agg(F.sum(delta("Type", F.col("Qty").try_cast("bigint"))).alias("on_hand"))
