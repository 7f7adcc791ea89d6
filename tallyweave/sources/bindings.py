"""The ledger's tables as views of the driver's Parquet tables (FIXTURES.md has the rules)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The type of a ledger row and the status of a transfer, by remainder.
TYPES = ["in", "out", "transfer_in", "transfer_out", "return_in", "wastage", "adjustment_in", "adjustment_out", "deleted"]
STATUSES = ["draft", "in_transit", "received", "flagged", "completed", "cancelled"]
ROLES = ["director", "head_office", "franchisee", "store_manager", "staff"]
#: Lines that a task sums and nests, so that what it holds doesn't grow with the table.
LINES_A_TASK = 250_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], n) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    active = F.when(key % 10 == 0, F.lit(None).cast("boolean")).otherwise(key % 10 != 1)
    return _table(spark, sf_dir, "part").select(key.alias("id"), F.col("p_name").alias("name"), active.alias("active"), F.col("p_size").cast("bigint").alias("size"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), _pick(ROLES, F.col("c_custkey") % 5).alias("role"), F.col("c_nationkey").alias("nation"))


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, store_id: the stores of a user's nation."""
    return users(spark, sf_dir).select(F.col("id").alias("user_id"), "nation").join(stores(spark, sf_dir).select(F.col("id").alias("store_id"), "nation"), "nation").select("user_id", "store_id")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    qty = F.col("l_quantity").cast("bigint")
    return _table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")), qty.cast("string")).alias("txn_id"),
        _pick(TYPES, (F.col("l_orderkey") + F.col("l_linenumber")) % 9).alias("type"), F.col("l_partkey").alias("product_id"), qty.alias("qty"), F.col("l_suppkey").alias("store_id"), F.col("l_orderkey").alias("transfer_id"),
        F.col("l_shipdate").cast("date").alias("date"), F.col("l_linestatus").alias("staff_name"), F.col("l_returnflag").alias("reason"), F.col("l_shipdate").alias("created_at"),
        (F.col("l_orderkey") % 10).cast("string").alias("device_id"), F.when(F.col("l_orderkey") % 3 == 0, True).when(F.col("l_orderkey") % 3 == 1, False).alias("synced"),
    )


def thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A global row for each product, and one for each store and product whose keys' sum divides by 4."""
    size = F.col("p_size").cast("bigint")
    common = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.lit(None).cast("bigint").alias("store_id"), size.alias("min_qty"), F.when(size % 5 == 0, 0).otherwise(2 * size).cast("bigint").alias("optimum_qty"))
    own = pairs(spark, sf_dir).where((F.col("product_id") + F.col("store_id")) % 4 == 0)
    return common.unionByName(own.select("product_id", "store_id", F.lit(5).cast("bigint").alias("min_qty"), F.lit(60).cast("bigint").alias("optimum_qty")))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """store_id, product_id of all stores and products that the ledger has together."""
    return _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("store_id"), F.col("l_partkey").alias("product_id")).distinct()


def transfer_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as transfers, without their items."""
    n = _table(spark, sf_dir, "supplier").count()
    status, cust, order = _pick(STATUSES, F.col("o_orderkey") % 6), F.col("o_custkey"), F.col("o_orderkey")
    came = status.isin("received", "flagged", "completed")
    ended = F.col("o_orderdate") + F.make_dt_interval((order % 45).cast("int"))
    return _table(spark, sf_dir, "orders").select(
        order.alias("id"), F.col("o_orderdate").alias("date"), F.col("o_orderdate").alias("created_at"), (cust % n).cast("bigint").alias("from_store"), ((cust + 1 + order % (n - 1)) % n).cast("bigint").alias("to_store"),
        status.alias("status"), F.when(F.col("o_orderpriority") == "5-LOW", "Excess").alias("return_reason"), F.concat(F.lit("user-"), (cust % 5).cast("string")).alias("created_by"),
        F.when(came, F.concat(F.lit("user-"), (cust % 7).cast("string"))).alias("received_by"), F.when(came, F.col("o_orderdate") + F.make_dt_interval(F.lit(1))).alias("received_date"), F.when(status.isin("completed", "cancelled"), ended).alias("completed_date"),
    )


def _sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey, l_partkey, sent: lines of one order and product summed; dealt by order, which serves what groups or joins by it.

    Tasks get some LINES_A_TASK each, which a number given to repartition() keeps from being put together.
    """
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.col("l_quantity").cast("bigint").alias("qty"))
    tasks = lines.count() // LINES_A_TASK + 1
    dealt = lines.repartition(tasks, "l_orderkey") if tasks > spark.sparkContext.defaultParallelism else lines.repartition("l_orderkey")
    return dealt.groupBy("l_orderkey", "l_partkey").agg(F.sum("qty").cast("bigint").alias("sent"))


def _came(part, sent):
    return F.when(part % 4 != 0, sent).when(part % 8 == 0, sent - 1).otherwise(sent + 1)


def _item_state(status, part, sent, came):
    known = status.isin("received", "flagged", "completed")
    return F.when(known, F.when(came == sent, "accepted").when(status == "completed", "resolved").otherwise("flagged")).when((status == "draft") & (part % 2 == 0), "confirmed").otherwise("pending")


def transfer_items(spark: SparkSession, sf_dir: str, headers: DataFrame | None = None) -> DataFrame:
    """The items of the headers' transfers (of all, without headers), as operators.transfers.items_of() has them: nothing is collected into arrays."""
    headers = transfer_headers(spark, sf_dir) if headers is None else headers
    part, sent, status = F.col("l_partkey"), F.col("sent"), F.col("transfer_status")
    rows = _sums(spark, sf_dir).join(headers.select(F.col("id").alias("transfer_id"), "from_store", "to_store", F.col("status").alias("transfer_status")), F.col("l_orderkey") == F.col("transfer_id"))
    known = status.isin("received", "flagged", "completed")
    return rows.select("transfer_id", "from_store", "to_store", "transfer_status", part.alias("product_id"), sent.alias("sent_qty"), F.when(known, _came(part, sent)).alias("received_qty"), _item_state(status, part, sent, _came(part, sent)).alias("status"))


def transfer_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, item_count, total_units of transfers that have items."""
    return _sums(spark, sf_dir).groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("item_count"), F.sum("sent").cast("bigint").alias("total_units"))


def page_units(spark: SparkSession, sf_dir: str, page: DataFrame) -> DataFrame:
    """The same for one page of headers, whose few rows choose the lines before these are grouped."""
    lines = _table(spark, sf_dir, "lineitem").join(F.broadcast(page.select(F.col("id").alias("l_orderkey"))), "l_orderkey", "left_semi")
    sums = lines.groupBy("l_orderkey", "l_partkey").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("sent"))
    return sums.groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("item_count"), F.sum("sent").cast("bigint").alias("total_units"))


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as transfers, lines of one product summed into an item; an order without lines has no items.

    Lines are dealt by order once, which serves both groupings and the join.
    """
    headers, sums = transfer_headers(spark, sf_dir), _sums(spark, sf_dir)
    part, status = F.col("l_partkey"), F.col("status")
    came = _came(part, F.col("sent"))
    nested = sums.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(part.alias("product_id"), F.col("sent").alias("sent_qty"), came.alias("received_qty")))).alias("lines"))
    known = status.isin("received", "flagged", "completed")
    state = lambda i: _item_state(status, i["product_id"], i["sent_qty"], i["received_qty"])
    item = lambda i: F.struct(i["product_id"].alias("product_id"), i["sent_qty"].alias("sent_qty"), F.when(known, i["received_qty"]).alias("received_qty"), state(i).alias("status"), *_said(state(i)))
    joined = headers.join(nested, F.col("id") == F.col("l_orderkey"), "left")
    none = F.array().cast("array<struct<product_id: bigint, sent_qty: bigint, received_qty: bigint, status: string, flag_note: string, resolved_by: string, resolved_action: string>>")
    return joined.select(*headers.columns, F.coalesce(F.transform("lines", item), none).alias("items"))


def _said(state):
    """What is said of an item: resolved ones have been accepted by the first user."""
    done = state == "resolved"
    return F.when(done, "as counted").otherwise("").alias("flag_note"), F.when(done, "user-0").alias("resolved_by"), F.when(done, "accept_as_is").alias("resolved_action")


def receipts(transfers: DataFrame) -> DataFrame:
    """What comes of transfers in transit: as items have it, nothing of products that divide by 11."""
    from ..operators.transfers import items_of

    rows = items_of(transfers.where("status = 'in_transit'")).where("product_id % 11 <> 0")
    came = F.when(F.col("product_id") % 4 != 0, F.col("sent_qty")).when(F.col("product_id") % 8 == 0, F.col("sent_qty") - 1).otherwise(F.col("sent_qty") + 1)
    return rows.select("transfer_id", "product_id", came.alias("received_qty"))


def actions(items: DataFrame) -> DataFrame:
    """Flagged items with what is done about them."""
    action = F.element_at(F.array(F.lit("accept_as_is"), F.lit("adjust"), F.lit("reject")), (F.col("product_id") % 3 + 1).cast("int"))
    return items.where("status = 'flagged'").withColumn("action", action).withColumn("action_qty", F.floor(F.col("sent_qty") / 2).cast("bigint"))


def sync_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as synchronised transactions; errors are tombstones of the transaction that props.k names."""
    deleted = F.col("event_type") == "error"
    return _table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("TransactionId"), F.date_format("ts", "yyyy-MM-dd").alias("Date"), (F.col("user_id") % 7).cast("string").alias("StoreId"), (F.col("event_id") % 50).cast("string").alias("ProductId"),
        F.when(deleted, "deleted").otherwise(F.col("event_type")).alias("Type"), F.col("value").cast("bigint").cast("string").alias("Qty"), F.lit("").alias("StaffName"), F.lit("").alias("Reason"), F.col("user_id").cast("string").alias("DeviceId"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("Timestamp"), F.lit("").alias("TransferId"), F.when(deleted, F.get_json_object("props", "$.k")).alias("TargetTransactionId"), F.col("ts").cast("timestamp").alias("SyncTimestamp"),
    )


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of commands, as operators.replay.COMMAND has them, made of orders and lines; many of them aren't allowed."""
    n = _table(spark, sf_dir, "supplier").count()
    k, cust, part, sent = F.col("l_orderkey"), F.col("o_custkey"), F.col("l_partkey"), F.col("sent")
    heads = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = lambda p, q: F.sort_array(F.collect_list(F.struct(p.alias("product_id"), q.alias("qty"))))
    edited = F.when((k % 2 == 0) & (part % 3 == 0), sent + 2).otherwise(sent)
    came = F.when(part % 4 == 0, sent - 1).otherwise(edited)
    whole = _sums(spark, sf_dir).groupBy("l_orderkey").agg(
        lines(part, sent).alias("all"), lines(part, edited).alias("edits"), lines(F.when(part % 11 != 0, part), came).alias("came"), F.min(part).alias("low"), F.max(part).alias("high"),
    ).join(heads, k == F.col("o_orderkey"))
    none = F.lit(None).cast("array<struct<product_id: bigint, qty: bigint>>")

    def command(seq: int, step: str, when=F.lit(True), product=None, lines=none):
        value = F.lit(None).cast("bigint") if product is None else F.col(product)
        return F.when(when, F.struct(F.lit(seq).cast("bigint").alias("seq"), F.lit(step).alias("step"), value.alias("product_id"), F.lit(None).cast("string").alias("action"), F.lit(None).cast("bigint").alias("qty"), lines.alias("lines")))

    steps = F.array(command(0, "create", lines=F.col("all")), command(1, "confirm", product="low"), command(2, "confirm", k % 3 == 0, "high"), command(3, "submit", lines=F.col("edits")), command(4, "cancel", k % 7 == 0), command(5, "receive", lines=F.filter("came", lambda x: x["product_id"].isNotNull())), command(10**9, "submit"))
    ends = [k.alias("transfer_id"), (cust % n).cast("bigint").alias("from_store"), F.when(k % 29 == 0, cust % n).otherwise((cust + 1 + k % (n - 1)) % n).cast("bigint").alias("to_store"), (k % 2 == 0).alias("draft")]
    first = whole.select(*ends, F.explode(F.array_compact(steps)).alias("c")).select("transfer_id", "c.seq", "c.step", "from_store", "to_store", "draft", "c.product_id", "c.action", "c.qty", "c.lines")
    action = F.element_at(F.array(F.lit("accept_as_is"), F.lit("adjust"), F.lit("reject")), (part % 3 + 1).cast("int"))
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    flags = _sums(spark, sf_dir).where((part % 4 == 0) | (part % 11 == 0)).select(k.alias("transfer_id"), (part + 10).alias("seq"), F.lit("resolve").alias("step"), null("bigint", "from_store"), null("bigint", "to_store"), null("boolean", "draft"), part.alias("product_id"), action.alias("action"), F.floor(sent / 2).cast("bigint").alias("qty"), none.alias("lines"))
    return first.unionByName(flags)
