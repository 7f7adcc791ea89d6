"""Stock on hand from an append-only ledger of typed transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The types of transactions that add and take stock. Tombstones and unknown types do neither.
INFLOW = ("in", "return_in", "transfer_in", "adjustment_in")
OUTFLOW = ("out", "transfer_out", "wastage", "adjustment_out")

# Fixed value: the reason that a tombstone gives, before the id.
REASON = "Transaction deleted: "


def sign(kind: Column | str = "type") -> Column:
    kind = F.col(kind) if isinstance(kind, str) else kind
    return F.when(kind.isin(*INFLOW), 1).when(kind.isin(*OUTFLOW), -1).otherwise(0)


def delta(kind: Column | str = "type", qty: Column | str = "qty") -> Column:
    qty = F.col(qty) if isinstance(qty, str) else qty
    return sign(kind) * F.coalesce(qty, F.lit(0)).cast("bigint")


def on_hand(ledger: DataFrame) -> DataFrame:
    """store_id, product_id, on_hand: the sum of signed quantities. Sums are partial before the shuffle, so a hot product is no burden."""
    return ledger.groupBy("store_id", "product_id").agg(F.sum(delta()).cast("bigint").alias("on_hand"))


def running_balance(ledger: DataFrame) -> DataFrame:
    """txn_id, balance: on hand of the transaction's store and product after it, in order of date and txn_id.

    Balances at the start of each day come from daily sums, and only a day's own rows meet in a window: a store and product
    that hold much of the ledger are spread over its days.
    """
    rows = ledger.select("store_id", "product_id", "date", "txn_id", delta().alias("delta"))
    daily = rows.groupBy("store_id", "product_id", "date").agg(F.sum("delta").alias("moved"))
    before = Window.partitionBy("store_id", "product_id").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    opening = daily.select(F.col("store_id").alias("s"), F.col("product_id").alias("p"), F.col("date").alias("d"), F.coalesce(F.sum("moved").over(before), F.lit(0)).alias("opening"))
    same = F.col("store_id").eqNullSafe(F.col("s")) & F.col("product_id").eqNullSafe(F.col("p")) & F.col("date").eqNullSafe(F.col("d"))
    within = Window.partitionBy("store_id", "product_id", "date").orderBy("txn_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(opening, same).select("txn_id", (F.col("opening") + F.sum("delta").over(within)).cast("bigint").alias("balance"))


def removed(ledger: DataFrame, ids: DataFrame) -> DataFrame:
    """The ledger without the transactions whose txn_id is in ids; stock on hand is then computed anew, never patched."""
    return ledger.join(ids.select("txn_id"), "txn_id", "left_anti")


def archived(ledger: DataFrame, ids: DataFrame) -> DataFrame:
    """The transactions that removed() leaves out, as they were."""
    return ledger.join(ids.select("txn_id"), "txn_id", "left_semi")


def tombstones(ledger: DataFrame, ids: DataFrame) -> DataFrame:
    """txn_id, type, store_id, product_id, qty, reason, target_txn_id: one marker for each removed transaction.

    They are rows of the ledger like others and unsynced until a push of them is confirmed, so that one that fails stays queued.
    """
    gone = archived(ledger, ids).dropDuplicates(["txn_id"])
    return gone.select(F.concat(F.lit("del_"), "txn_id").alias("txn_id"), F.lit("deleted").alias("type"), "store_id", "product_id", F.lit(0).cast("bigint").alias("qty"), F.concat(F.lit(REASON), "txn_id").alias("reason"), F.col("txn_id").alias("target_txn_id"), F.lit(False).alias("synced"))


def type_summary(ledger: DataFrame) -> DataFrame:
    """type, n, units, signed_units."""
    return ledger.groupBy("type").agg(F.count("*").alias("n"), F.sum("qty").cast("bigint").alias("units"), F.sum(delta()).cast("bigint").alias("signed_units"))


def by_lineage(ledger: DataFrame, transfers: DataFrame) -> DataFrame:
    """transfer_id, status, n, net: what the ledger holds of each transfer."""
    moved = ledger.groupBy("transfer_id").agg(F.count("*").alias("n"), F.sum(delta()).cast("bigint").alias("net"))
    return transfers.select(F.col("id").alias("transfer_id"), "status").join(moved, "transfer_id")
