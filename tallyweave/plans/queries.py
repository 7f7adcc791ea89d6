"""The ledger's queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import loose as values
from ..operators import ledger, replay, sync, thresholds, transfers, views
from ..sources import bindings as b
from ..sources import loose_json as loose
from ..sources import tables

Query = Callable[[SparkSession, str], DataFrame]
#: The bounds of the incremental window of the synchronised log, the user whose stores count, and this device.
SINCE, UNTIL = datetime(2024, 1, 15, tzinfo=timezone.utc), datetime(2024, 1, 20, tzinfo=timezone.utc)
USER, DEVICE = 2, "7"
AS_OF = datetime(2000, 1, 1)


def _stock(s, d):
    return ledger.on_hand(b.ledger(s, d))


def _gone(s, d):
    return b.ledger(s, d).where("transfer_id % 17 = 0").select("txn_id")


def _mine(s, d):
    return b.memberships(s, d).where(F.col("user_id") == USER).select("store_id")


def _local(log):
    """What the device has before the pull, deleted rows left out."""
    return sync.window(log, None, SINCE).where("Type <> 'deleted'").select(F.col("TransactionId").alias("txn_id"))


def _date(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd") for n in names})


def on_hand(s, d):
    return _stock(s, d)


def running_balance(s, d):
    return ledger.running_balance(b.ledger(s, d))


def on_hand_after_delete(s, d):
    return ledger.on_hand(ledger.removed(b.ledger(s, d), _gone(s, d)))


def deleted_archive(s, d):
    return ledger.archived(b.ledger(s, d), _gone(s, d)).select("txn_id", "type", "store_id", "product_id", "qty")


def tombstones(s, d):
    return ledger.tombstones(b.ledger(s, d), _gone(s, d)).drop("reason", "synced")


def txn_type_summary(s, d):
    return ledger.type_summary(b.ledger(s, d))


def ledger_lineage(s, d):
    return ledger.by_lineage(b.ledger(s, d), b.transfers(s, d))


def threshold_resolved(s, d):
    return thresholds.resolved(b.pairs(s, d), b.thresholds(s, d))


def shortfall_by_store(s, d):
    return thresholds.shortfall(_stock(s, d), b.thresholds(s, d))


def low_stock(s, d):
    return thresholds.low_stock(_stock(s, d), b.thresholds(s, d))


def threshold_upsert(s, d):
    edits = b.products(s, d).where("id % 3 = 0").select(F.col("id").alias("product_id"), F.when(F.col("id") % 2 == 0, F.lit("*")).alias("store_id"), F.when(F.col("id") % 9 != 0, 7).cast("bigint").alias("min_qty"), F.lit(70).cast("bigint").alias("optimum_qty"))
    return thresholds.upserted(b.thresholds(s, d), edits)


def stocktake_draft(s, d):
    counted = _stock(s, d).select("store_id", "product_id", F.greatest(F.lit(0), "on_hand").alias("counted"))
    return thresholds.stock_take_draft(counted, b.thresholds(s, d))


def stocktake_transfer(s, d):
    """The drafts from head office that a stock take makes."""
    made = transfers.from_stock_take(stocktake_draft(s, d), 0, F.lit(AS_OF), F.lit("user-9"))
    return made.select("id", "from_store", "to_store", "status", "created_by", "notes", F.size("items").cast("bigint").alias("n_items"), F.aggregate("items", F.lit(0).cast("bigint"), lambda a, i: a + i["sent_qty"]).alias("units"))


def stocktake_errors(s, d):
    counted = _stock(s, d).select("store_id", "product_id", F.lit(1000).alias("counted")).where("store_id % 3 = 0").unionByName(_stock(s, d).select("store_id", "product_id", F.lit(0).alias("counted")).where("store_id % 3 = 1"))
    return transfers.without_shortfall(counted, thresholds.stock_take_draft(counted, b.thresholds(s, d)))


def threshold_saved(s, d):
    edits = b.products(s, d).where("id % 3 = 0").select(F.col("id").alias("product_id"))
    return thresholds.saved_count(b.products(s, d), edits)


def product_picker(s, d):
    return views.picker(b.products(s, d), _stock(s, d), 0, 1, b.thresholds(s, d))


def _hub(tab: str) -> Query:
    def run(s, d):
        return views.hub_summary(views.in_tab(b.transfer_headers(s, d), tab, _mine(s, d)), b.transfer_units(s, d))

    return run


def hub_page(s, d):
    return _hub_page(s, d, "in_transit", 1)


def hub_last_page(s, d):
    return _hub_page(s, d, "drafts", 10**9)


def _hub_page(s, d, tab: str, number: int):
    """The page is cut from the headers; only then the items of its few rows are summed."""
    rows = views.page_by_counts(views.in_tab(b.transfer_headers(s, d), tab), number)
    return views.hub_summary(rows, b.page_units(s, d, rows))


def hub_page_count(s, d):
    return views.page_count(views.in_tab(b.transfer_headers(s, d), "completed"))


def hub_visibility(s, d):
    return views.visible(b.transfer_headers(s, d), _mine(s, d)).select("id", "from_store", "to_store")


def transfer_list(s, d):
    return _date(views.listed(b.transfer_headers(s, d), "received", 3).select("id", "date", "from_store", "to_store"), "date")


def product_search(s, d):
    return views.products_found(b.products(s, d), " RED ")


def transfer_units(s, d):
    return views.unit_totals(b.transfers(s, d))


def transfer_names(s, d):
    return views.named(b.transfer_headers(s, d), b.stores(s, d))


def transfer_item_names(s, d):
    return views.item_names(b.transfers(s, d), b.products(s, d))


def notification_payload(s, d):
    done = views.notifications(b.transfers(s, d).where("status in ('in_transit', 'completed')"), b.stores(s, d), b.products(s, d))
    get = lambda name: F.get_json_object("payload", f"$.{name}")
    return done.select("transfer_id", get("type").alias("type"), get("fromStore").alias("from_name"), get("toStore").alias("to_name"), get("totalItems").cast("bigint").alias("total_items"), get("totalUnits").cast("bigint").alias("total_units"), get("items[0].product").alias("first_product"),
        F.substring(get("date"), 1, 10).alias("date"), F.coalesce(get("createdBy"), get("receivedBy")).alias("person"), F.json_array_length(get("flaggedItems")).cast("bigint").alias("n_flagged"), get("flaggedItems[0].action").alias("first_action"))


def capability_matrix(s, d):
    return transfers.capability_matrix(b.users(s, d))


def flag_diff(s, d):
    return views.differences(b.transfer_items(s, d))


def transfer_create(s, d):
    requests = _requests(s, d)
    made = transfers.created(requests, F.lit(AS_OF))
    return transfers.sent_entries(made)


def _requests(s, d):
    """Requests made of orders: some lack a store, some name the same store twice, some returns lack a reason."""
    item = lambda i: F.struct(i["product_id"].alias("product_id"), i["sent_qty"].alias("qty"))
    k = F.col("id") % 13
    return b.transfers(s, d).select("id", F.when(k != 1, F.col("from_store")).alias("from_store"), F.when(k == 2, F.col("from_store")).otherwise(F.col("to_store")).alias("to_store"), F.transform("items", item).alias("items"), (F.col("status") == "draft").alias("is_draft"),
        (k == 3).alias("is_return"), "return_reason", F.lit(None).cast("string").alias("created_by"), F.lit("").alias("notes"))


def transfer_validate(s, d):
    return transfers.violations(_requests(s, d))


def transfer_draft_confirm(s, d):
    rows = b.transfers(s, d)
    picks = transfers.items_of(rows).where("product_id % 5 = 0").select("transfer_id", "product_id")
    return transfers.items_of(transfers.toggled(rows, picks)).where("transfer_status = 'draft'").select("transfer_id", "product_id", "status")


def transfer_draft_submit(s, d):
    rows = b.transfers(s, d)
    edits = transfers.items_of(rows).where("product_id % 3 = 0").select("transfer_id", "product_id", (F.col("sent_qty") + 2).alias("qty"))
    return transfers.sent_entries(transfers.submitted(rows, edits, F.lit(AS_OF)))


def transfer_receive(s, d):
    rows = b.transfers(s, d)
    done = transfers.received(rows, b.receipts(rows), F.lit("user-9"), F.lit(AS_OF))
    items = done.select(F.col("id").alias("transfer_id"), F.col("status").alias("transfer_status"), "received_by", *_days(done, "received_date", "completed_date"), F.explode("items").alias("i"))
    return items.select("transfer_id", "i.product_id", "i.sent_qty", "i.received_qty", F.col("i.status").alias("item_status"), "transfer_status", "received_by", "received_date", "completed_date")


def _days(df, *names):
    return [F.date_format(df[n], "yyyy-MM-dd").alias(n) for n in names]


def transfer_receive_entries(s, d):
    rows = b.transfers(s, d)
    return transfers.receipt_entries(transfers.received(rows, b.receipts(rows)))


def transfer_resolve_flags(s, d):
    return transfers.resolution_entries(b.actions(b.transfer_items(s, d, b.transfer_headers(s, d).where("status = 'received'"))))


def transfer_resolved_status(s, d):
    rows = b.transfers(s, d).where("status = 'received'")
    acts = b.actions(transfers.items_of(rows)).where("product_id % 16 <> 0").select("transfer_id", "product_id", "action", F.when(F.col("action") == "reject", "broken").alias("note"))
    done = transfers.resolved(rows, acts, F.lit("user-8"), F.lit(AS_OF))
    said = lambda name: F.array_max(F.transform("items", lambda i: i[name])).alias(name)
    n = F.size(F.filter("items", lambda i: i["resolved_by"] == "user-8")).cast("bigint")
    return done.select("id", "status", *_days(done, "completed_date"), said("resolved_action"), said("flag_note"), n.alias("n_resolved"))


def transfer_cancel(s, d):
    return transfers.cancel_entries(b.transfers(s, d))


def transfer_cancelled(s, d):
    done = transfers.cancelled(b.transfer_headers(s, d), F.lit(AS_OF))
    return done.select("id", "status", *_days(done, "completed_date"))


def transfer_ledger(s, d):
    """The ledger rows of everything that is sent, received, cancelled and resolved, with reasons."""
    rows, stores, who, at = b.transfers(s, d), b.stores(s, d), F.lit("user-9"), F.lit(AS_OF)
    got = transfers.received(rows, b.receipts(rows), who, at)
    steps = [(transfers.sent_entries(rows), "sent"), (transfers.receipt_entries(got), "received"), (transfers.cancel_entries(rows), "cancelled")]
    flagged = b.actions(b.transfer_items(s, d, b.transfer_headers(s, d).where("status = 'received'")))
    out = transfers.resolution_ledger(flagged, stores, who, at)
    for entries, step in steps:
        out = out.unionByName(transfers.ledger_entries(entries, rows, stores, step, who, at))
    return _date(out, "date").drop("created_at")


def transfer_by_id(s, d):
    found = transfers.by_id(b.transfer_headers(s, d), 7)
    return found.select("id", "status", *_days(found, "date"))


def prune_count(s, d):
    return transfers.prune_count(b.transfer_headers(s, d), F.lit(AS_OF))


def transfer_conservation(s, d):
    rows = b.transfer_items(s, d, b.transfer_headers(s, d).where("status = 'received'"))
    accepted = rows.where("status = 'accepted'").select("transfer_id", "product_id", F.col("to_store").alias("store_id"), F.lit("transfer_in").alias("type"), F.col("received_qty").alias("qty"))
    return transfers.conservation(rows, accepted.unionByName(transfers.resolution_entries(b.actions(rows))))


def transfer_prune(s, d):
    kept = transfers.pruned(b.transfer_headers(s, d), F.lit(AS_OF))
    return kept.select("id", "status", *_days(kept, "completed_date"))


def _unsynced(s, d):
    """What is to be pushed: rows of the ledger that aren't synced, and the tombstones of what is removed."""
    rows = b.ledger(s, d)
    return sync.unsynced(rows.unionByName(ledger.tombstones(rows, _gone(s, d)), allowMissingColumns=True))


def sync_push_batch(s, d):
    return sync.to_wire(_unsynced(s, d), "dev")


def wire_round_trip(s, d):
    """What another device gets of a push."""
    return sync.from_wire(sync.to_wire(_unsynced(s, d), "dev")).select("txn_id", "type", "product_id", "qty", "store_id", "transfer_id", "reason", "device_id", "synced", "target_txn_id")


def transfer_replay(s, d):
    return replay.final_states(replay.replayed(b.commands(s, d)))


def transfer_replay_refused(s, d):
    return replay.refusals(replay.replayed(b.commands(s, d)))


def _answers(s, d):
    """batch_no, status, processed: answers to pushes, made of events. Some are of a part, some say nothing of how many."""
    e = s.read.parquet(f"{d}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("bigint")
    status = F.when(F.col("event_type") == "click", "ok").when(F.col("event_type") == "view", "SUCCESS").when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "")
    return e.select(F.col("event_id").alias("batch_no"), status.alias("status"), F.when(k % 10 != 0, F.when(k % 7 == 0, 49).otherwise(50)).cast("bigint").alias("processed"))


def sync_ack_matrix(s, d):
    """Which answers count as confirmation of a push of 50 rows."""
    said = _answers(s, d).groupBy("status", "processed").agg(F.count("*").alias("n"))
    return said.select("status", "processed", "n", sync.acknowledged(F.col("processed"), F.lit(50)).alias("synced"))


def sync_mark_synced(s, d):
    rows = b.ledger(s, d)
    return sync.marked_synced(rows, rows.where("transfer_id % 2 = 0")).groupBy("synced").agg(F.count("*").alias("n"))


def sync_pull_merge(s, d):
    log = b.sync_log(s, d)
    return sync.merged_ids(_local(log), sync.window(log, SINCE, UNTIL), DEVICE)


def sync_bootstrap(s, d):
    log = b.sync_log(s, d)
    return sync.merged_ids(_local(log).where(F.lit(False)), sync.window(log, None, UNTIL))


def sync_bootstrap_in_order(s, d):
    log = b.sync_log(s, d)
    return sync.merged_in_order(_local(log).where(F.lit(False)), sync.window(log, None, UNTIL))


def sync_merged_rows(s, d):
    """The merged ledger itself."""
    log = b.sync_log(s, d)
    local = sync.from_wire(sync.live(sync.window(log, None, SINCE)))
    return sync.merged(local, sync.window(log, SINCE, UNTIL), DEVICE).select("txn_id", "type", "product_id", "qty", "synced")


def sync_leader(s, d):
    claims = s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("tab_id"), F.date_trunc("hour", "ts").alias("started_at"))
    return sync.leader(claims)


def migration_wire(s, d):
    return sync.to_migration(b.ledger(s, d))


def _acks(s, d, rows):
    """Batches of rows, as sync.pushed() has them, with the answers that they got; some got none."""
    sent = sync.batched(rows).groupBy("batch_no").agg(F.count("*").alias("sent"))
    return sent.join(_answers(s, d), "batch_no", "left")


def push_totals(s, d):
    """Totals of the whole push: of all rows that sync_push_batch sends."""
    return sync.push_totals(_acks(s, d, _unsynced(s, d)))


def sync_confirmed(s, d):
    """How many rows of each device are synced once the confirmed batches are marked."""
    rows = b.ledger(s, d)
    batches = sync.batched(sync.unsynced(rows)).select("txn_id", "batch_no")
    done = batches.join(_acks(s, d, sync.unsynced(rows)).where(sync.acknowledged(F.col("processed"), F.col("sent"))), "batch_no", "left_semi")
    return sync.marked_synced(rows, done).groupBy("synced").agg(F.count("*").alias("n"))


def sync_replay(s, d):
    """Two pulls that overlap, as one: rows that come twice count once."""
    log = b.sync_log(s, d)
    both = sync.window(log, None, UNTIL).unionByName(sync.window(log, SINCE, UNTIL))
    return sync.from_wire(sync.live(both)).groupBy("store_id").agg(F.count("*").alias("n"), F.sum("qty").cast("bigint").alias("qty"))


def sync_tombstones(s, d):
    return sync.targets(sync.window(b.sync_log(s, d), None, UNTIL))


def sync_overlap(s, d):
    log = b.sync_log(s, d)
    return sync.overlap(_local(log), sync.window(log, SINCE, UNTIL, 86_400))


def stale_devices(s, d):
    out = sync.stale(b.sync_log(s, d), datetime(2024, 1, 30, 12, tzinfo=timezone.utc))
    return out.select("device_id", F.unix_seconds("last_sync").alias("last_sync_s"))


def migration_batches(s, d):
    return sync.batched(b.ledger(s, d)).groupBy("batch_no").agg(F.count("*").alias("n"))


def latest_versions(s, d):
    """The last version of each order line, versions being the lines of one order and product in order of line number."""
    rows = b.ledger(s, d).select("transfer_id", "product_id", "txn_id", "qty")
    return tables.latest(rows, ["transfer_id", "product_id"], ["qty", "txn_id"])


def table_counts(s, d):
    return tables.counts({"stores": b.stores(s, d), "products": b.products(s, d), "users": b.users(s, d), "transactions": b.ledger(s, d), "transfers": b.transfers(s, d)})


def store_upsert(s, d):
    """Stores with the names of some of them changed, and one that is new."""
    base = b.stores(s, d).select("id", "name")
    changes = base.where("id % 2 = 0").select((F.col("id") + 5).alias("id"), F.upper("name").alias("name"))
    changes = changes.unionByName(base.where("id % 4 = 0").select((F.col("id") + 5).alias("id"), F.lower("name").alias("name")))  # a second change of some
    return tables.upserted(base, changes, ["id"])


def json_props(s, d):
    rows = s.read.parquet(f"{d}/events.parquet")
    k = F.from_json("props", "k bigint")["k"]
    return rows.groupBy("event_type").agg(F.sum(k).cast("bigint").alias("k_sum"), F.count_if(k > 50).alias("k_high"), F.max(F.length("props")).cast("bigint").alias("longest"))


def loose_json(s, d):
    """problem, event_type, n, k_sum of the events' properties as loose JSON, some of which are broken or of other types."""
    e = s.read.parquet(f"{d}/events.parquet")
    m = F.col("event_id") % 7
    text = F.when(m == 0, F.substring("props", 1, 4)).when(m == 1, "[1, 2]").when(m == 2, '{"k": {"x": 1}}').when(m == 3, F.concat(F.lit('{"k": "'), F.get_json_object("props", "$.k"), F.lit(' pieces"}'))).when(m == 4, '{"k": null}').otherwise(F.col("props"))
    done = loose.typed(loose.parsed(e.select("event_type", text.alias("value"))), "k bigint", loose=("k",))
    return done.groupBy("problem", "event_type").agg(F.count("*").alias("n"), F.sum("k").cast("bigint").alias("k_sum"))


def loose_conversations(s, d):
    """role, n, chars of all conversations, written as JSON texts and read again."""
    c = s.read.parquet(f"{d}/conversations.parquet")
    texts = c.select(F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("value"))
    done = loose.typed(loose.parsed(texts), "conv_id bigint, turn bigint, role string, text string")
    return done.where("problem is null").groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("bigint").alias("chars"))


def value_rules(s, d):
    """The loose value rules over texts and numbers of the part table."""
    p = s.read.parquet(f"{d}/part.parquet")
    digits = F.regexp_replace("p_brand", "[^0-9]", "")
    return p.select(
        "p_partkey", values.first_truthy(F.col("p_size") % 5, F.col("p_size") % 3, F.lit(-1)).cast("bigint").alias("truthy"), values.whole_number(F.concat(F.lit(" "), digits, F.lit("x"))).alias("parsed"),
        values.whole_number("p_type").alias("no_number"), F.translate(F.lower("p_name"), "_", " ").alias("lowered"), F.lpad(digits, 5, "0").alias("padded"),
    )


def map_items(s, d):
    """Items of a map of quantities by product, as an edited order holds them; only positive quantities count."""
    lines = s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_partkey", (F.col("l_quantity").cast("bigint") - 10).alias("qty"))
    maps = lines.groupBy("l_orderkey", "l_partkey").agg(F.sum("qty").alias("qty")).groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_partkey", "qty"))).alias("m"))
    rows = maps.select(F.col("l_orderkey").alias("id"), F.explode(F.map_entries(F.map_filter("m", lambda k, v: v > 0))).alias("e"))
    return rows.select("id", F.col("e.key").alias("product_id"), F.col("e.value").alias("qty"))


def value_rules_more(s, d):
    """Hexadecimal, powers, joined lists, numbers told from text, and maps."""
    p = s.read.parquet(f"{d}/part.parquet")
    size = F.col("p_size").cast("bigint")
    m = F.create_map(F.lit("size"), size, F.lit("key"), F.col("p_partkey"))
    return p.select(
        "p_partkey", F.lpad(F.lower(F.hex(size)), 4, "0").alias("hex"), F.conv(F.hex(size), 16, 10).cast("bigint").alias("unhex"), F.pow(size, F.lit(2)).cast("bigint").alias("squared"), F.array_join(F.split("p_name", " "), "|").alias("joined"),
        F.col("p_brand").try_cast("double").isNull().alias("not_a_number"), F.array_join(F.array_sort(F.map_keys(m)), ",").alias("keys"), F.aggregate(F.map_values(m), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), F.map_concat(m, F.create_map(F.lit("more"), F.lit(1).cast("bigint")))["more"].alias("more"),
    )


QUERIES: dict[str, Query] = {f"hub_{t}": _hub(t) for t in views.TABS} | {
    f.__name__: f
    for f in (
        on_hand, running_balance, on_hand_after_delete, deleted_archive, tombstones, txn_type_summary, ledger_lineage, threshold_resolved, shortfall_by_store, low_stock, threshold_upsert, stocktake_draft, product_picker,
        hub_page, hub_last_page, hub_page_count, hub_visibility, transfer_list, product_search, transfer_units, transfer_names, transfer_item_names, notification_payload, capability_matrix, flag_diff,
        transfer_create, transfer_validate, transfer_draft_confirm, transfer_draft_submit, transfer_receive, transfer_receive_entries, transfer_resolve_flags, transfer_resolved_status, transfer_cancel, transfer_cancelled, transfer_conservation, transfer_prune,
        sync_push_batch, sync_ack_matrix, sync_mark_synced, sync_pull_merge, sync_bootstrap, sync_bootstrap_in_order, sync_replay, sync_tombstones, sync_overlap, stale_devices, migration_batches, latest_versions, table_counts, store_upsert, json_props, loose_json, loose_conversations, value_rules,
        transfer_ledger, transfer_by_id, prune_count, stocktake_transfer, stocktake_errors, threshold_saved, sync_merged_rows, sync_leader, migration_wire, push_totals, sync_confirmed, wire_round_trip, transfer_replay, transfer_replay_refused, map_items, value_rules_more,
    )
}
