"""Transfers between stores: every step of their life as a transformation of all of them at once.

Transfers have nested items; a step works on the array of each row, so it shuffles nothing but what it joins. Items of one
product are taken as one (bindings sum them). Each step gives new rows and the ledger entries that it makes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.loose import every, first_text, is_true, some, wire_id

# What may become of a transfer, by the step.
TRANSITIONS = {"submit": ("draft",), "receive": ("in_transit",), "resolve": ("received", "in_transit"), "cancel": ("draft", "in_transit")}
# Who may take a step.
CAPABILITIES = {
    "create": ("director", "head_office", "franchisee", "store_manager"),
    "receive": ("director", "head_office", "franchisee", "store_manager", "staff"),
    "resolve": ("director", "head_office", "franchisee"),
    "set_thresholds": ("director", "head_office"),
    "cancel": ("director", "head_office"),
    "view_history": ("director", "head_office", "franchisee", "store_manager"),
}
EMITTED = ["transfer_id", "product_id", "store_id", "type", "qty"]
# The reasons that entries give, by the step; a store's name or a number of units follows or stands in between.
REASONS = {"sent": "Transfer to ", "received": "Received from ", "cancelled": "Transfer cancelled — stock returned", "accept_as_is": "Flag resolved — accepted as-is from ", "adjust": "Flag resolved — adjusted qty from ", "reject": "Rejected — full qty returned to ", "short": "Shortfall returned — ", "remainder": "Adjustment remainder returned — "}
NO_SHORTFALL = "No shortfalls detected"


def _guard(transfers: DataFrame, step: str) -> DataFrame:
    return transfers.where(F.col("status").isin(*TRANSITIONS[step]))


def _entry(store: str, kind: str, qty: Column, when: Column | None = None) -> Column:
    entry = F.struct(F.col(store).alias("store_id"), F.lit(kind).alias("type"), qty.cast("bigint").alias("qty"))
    return entry if when is None else F.when(when, entry)


def _emitted(rows: DataFrame, *entries: Column) -> DataFrame:
    """The ledger entries of rows of (transfer_id, product_id); those that are null aren't made."""
    if len(entries) == 1:
        return rows.select("transfer_id", "product_id", entries[0].alias("e")).where("e is not null").select("transfer_id", "product_id", "e.*")
    return rows.select("transfer_id", "product_id", F.explode(F.array_compact(F.array(*entries))).alias("e")).select("transfer_id", "product_id", "e.*")


def _set(rows: DataFrame, **values: Column) -> DataFrame:
    """rows with those of the columns set that they have."""
    return rows.withColumns({c: v for c, v in values.items() if c in rows.columns})


def ledger_entries(emitted: DataFrame, transfers: DataFrame, stores: DataFrame, step: str, staff: Column, at: Column) -> DataFrame:
    """Entries of a step ("sent", "received" or "cancelled") as ledger rows: id, date, staff and the reason, with the other store's name."""
    other = {"sent": "to_store", "received": "from_store"}.get(step)
    reason = F.lit(REASONS[step])
    rows = emitted
    if other:
        ends = transfers.select(F.col("id").alias("transfer_id"), F.col(other).alias("other"))
        rows = rows.join(ends, "transfer_id").join(stores.select(F.col("id").alias("other"), F.col("name").alias("other_name")), "other", "left")
        reason = F.concat(reason, F.coalesce("other_name", F.lit("")))
    return _as_ledger(rows, step, reason, staff, at)


def resolution_ledger(flagged: DataFrame, stores: DataFrame, staff: Column, at: Column) -> DataFrame:
    """The entries of resolution_entries() as ledger rows, each with its reason."""
    acts = flagged.select("transfer_id", "product_id", "action", "from_store", "to_store")
    names = stores.select(F.col("id").alias("from_store"), F.col("name").alias("from_name"))
    rows = resolution_entries(flagged).join(acts, ["transfer_id", "product_id"]).join(names, "from_store", "left")
    units = F.concat(F.col("qty").cast("string"), F.lit(" units"))
    name, back = F.coalesce("from_name", F.lit("")), F.col("store_id") == F.col("from_store")
    reason = (
        F.when(F.col("action") == "reject", F.concat(F.lit(REASONS["reject"]), name))
        .when(back & (F.col("action") == "accept_as_is"), F.concat(F.lit(REASONS["short"]), units))
        .when(back, F.concat(F.lit(REASONS["remainder"]), units))
        .when(F.col("action") == "accept_as_is", F.concat(F.lit(REASONS["accept_as_is"]), name))
        .otherwise(F.concat(F.lit(REASONS["adjust"]), name))
    )
    return _as_ledger(rows, "resolved", reason, staff, at)


def _as_ledger(rows: DataFrame, step: str, reason: Column, staff: Column, at: Column) -> DataFrame:
    ident = wire_id(F.lit("txn"), "transfer_id", F.lit(step), "product_id", "store_id")
    return rows.select(ident.alias("txn_id"), *EMITTED, F.to_date(at).alias("date"), F.coalesce(staff, F.lit("unknown")).alias("staff_name"), reason.alias("reason"), at.alias("created_at"))


def from_stock_take(lines: DataFrame, head_office, at: Column, staff: Column) -> DataFrame:
    """One draft from head office for each store of lines (store_id, product_id, qty to order), as created() has them."""
    items = F.sort_array(F.collect_list(F.struct("product_id", F.col("qty").cast("bigint").alias("qty"))))
    asked = lines.where("qty > 0").groupBy("store_id").agg(items.alias("items"))
    made = asked.select(
        wire_id(F.lit("draft"), "store_id").alias("id"), F.lit(head_office).cast(lines.schema["store_id"].dataType).alias("from_store"), F.col("store_id").alias("to_store"), "items", F.lit(True).alias("is_draft"),
        F.lit(False).alias("is_return"), F.lit(None).cast("string").alias("return_reason"), staff.alias("created_by"), F.lit("Auto-generated from stock take").alias("notes"))
    return created(made, at)


def without_shortfall(counted: DataFrame, lines: DataFrame) -> DataFrame:
    """store_id, error: the stores that were counted and need nothing."""
    none = counted.select("store_id").distinct().join(lines.where("qty > 0").select("store_id"), "store_id", "left_anti")
    return none.select("store_id", F.lit(NO_SHORTFALL).alias("error"))


def by_id(transfers: DataFrame, ident) -> DataFrame:
    """The transfer of this id, or no row."""
    return transfers.where(F.col("id") == F.lit(ident)).limit(1)


def items_of(transfers: DataFrame) -> DataFrame:
    """A row for each item: transfer_id, from_store, to_store, transfer_status and the item's fields."""
    rows = transfers.select(F.col("id").alias("transfer_id"), "from_store", "to_store", F.col("status").alias("transfer_status"), F.explode("items").alias("item"))
    return rows.select("transfer_id", "from_store", "to_store", "transfer_status", "item.*")


def violations(requests: DataFrame) -> DataFrame:
    """id, violation of each request that can't become a transfer: missing fields, the same store twice, or a return without a reason."""
    empty = F.coalesce(F.size("items"), F.lit(0)) <= 0
    problem = (
        F.when(F.col("from_store").isNull() | F.col("to_store").isNull() | empty, "missing fields")
        .when(F.col("from_store") == F.col("to_store"), "same store")
        .when(is_true(F.col("is_return")) & (first_text("return_reason") == ""), "no return reason")
    )
    return requests.select("id", problem.alias("violation")).where("violation is not null")


def created(requests: DataFrame, at: Column) -> DataFrame:
    """Transfers from requests (id, from_store, to_store, items of product_id and qty, is_draft, return_reason, created_by, notes)."""
    item = lambda i: F.struct(i["product_id"].alias("product_id"), i["qty"].cast("bigint").alias("sent_qty"), F.lit(None).cast("bigint").alias("received_qty"), F.lit("pending").alias("status"))
    sound = requests.join(violations(requests).select("id"), "id", "left_anti")
    return sound.select(
        "id", at.alias("date"), at.alias("created_at"), "from_store", "to_store", F.coalesce("created_by", F.lit("unknown")).alias("created_by"),
        F.when(is_true(F.col("is_draft")), "draft").otherwise("in_transit").alias("status"), F.nullif("return_reason", F.lit("")).alias("return_reason"), F.transform("items", item).alias("items"), first_text("notes").alias("notes"),
    )


def sent_entries(transfers: DataFrame) -> DataFrame:
    """What transfers in transit take from the store they come from."""
    return _emitted(items_of(transfers.where(F.col("status") == "in_transit")), _entry("from_store", "transfer_out", F.col("sent_qty")))


def toggled(transfers: DataFrame, picks: DataFrame) -> DataFrame:
    """Drafts with the items in picks (transfer_id, product_id) confirmed, or pending again if they were; the other rows as they are."""
    p = picks.groupBy(F.col("transfer_id").alias("id")).agg(F.collect_set("product_id").alias("picked"))
    flip = lambda i: F.when(is_true(F.array_contains("picked", i["product_id"])), i.withField("status", F.when(i["status"] == "confirmed", "pending").otherwise("confirmed"))).otherwise(i)
    joined = transfers.join(p, "id", "left")
    return joined.withColumn("items", F.when(F.col("status") == "draft", F.transform("items", flip)).otherwise(F.col("items"))).select(*transfers.columns)


def submitted(transfers: DataFrame, edits: DataFrame, at: Column) -> DataFrame:
    """Drafts put in transit: confirmed items only, with the quantities of edits (transfer_id, product_id, qty) where there are any."""
    e = edits.groupBy(F.col("transfer_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("product_id", F.col("qty").cast("bigint")))).alias("edits"))
    kept = F.filter("items", lambda i: i["status"] == "confirmed")
    edit = lambda i: i.withField("sent_qty", F.coalesce(F.try_element_at("edits", i["product_id"]), i["sent_qty"])).withField("status", F.lit("pending"))
    joined = _guard(transfers, "submit").withColumn("items", kept).where(F.size("items") > 0).join(e, "id", "left")
    return joined.withColumn("items", F.transform("items", edit)).withColumn("status", F.lit("in_transit")).withColumn("date", at).select(*transfers.columns)


def received(transfers: DataFrame, receipts: DataFrame, by: Column | None = None, at: Column | None = None) -> DataFrame:
    """Transfers in transit after receipts (transfer_id, product_id, received_qty): items accepted or flagged, transfers completed or received.

    An item without a receipt has received 0; of several receipts of an item the smallest counts. received_by and received_date
    become `by` and `at`, and completed_date `at` where nothing is flagged, in rows that have these columns.
    """
    r = receipts.groupBy(F.col("transfer_id").alias("id"), "product_id").agg(F.min("received_qty").cast("bigint").alias("qty"))
    r = r.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("product_id", "qty"))).alias("got"))
    got = lambda i: F.coalesce(F.try_element_at("got", i["product_id"]), F.lit(0).cast("bigint"))
    judge = lambda i: i.withField("received_qty", got(i)).withField("status", F.when(got(i) == i["sent_qty"], "accepted").otherwise("flagged"))
    joined = _guard(transfers, "receive").join(r, "id", "left").withColumn("items", F.transform("items", judge))
    flagged = some("items", lambda i: i["status"] == "flagged")
    done = joined.withColumn("status", F.when(flagged, "received").otherwise("completed"))
    if by is not None:
        done = _set(done, received_by=by)
    if at is not None:
        done = _set(done, received_date=at, completed_date=F.when(F.col("status") == "completed", at))
    return done.select(*transfers.columns)


def receipt_entries(done: DataFrame) -> DataFrame:
    """What received() puts into stock: accepted items, at the store they were sent to."""
    return _emitted(items_of(done).where(F.col("status") == "accepted"), _entry("to_store", "transfer_in", F.col("received_qty")))


def resolution_entries(flagged: DataFrame) -> DataFrame:
    """What the resolution of flagged items (transfer_id, product_id, from_store, to_store, sent_qty, received_qty, action, action_qty) puts into stock.

    accept_as_is and adjust put what came to the store it was sent to, and what is missing back; reject puts all back. Where more
    came than was sent nothing goes back, so units are made: conservation() shows them.
    """
    came = F.when(F.col("action") == "accept_as_is", F.col("received_qty")).when(F.col("action") == "adjust", F.col("action_qty"))
    back = F.when(F.col("action") == "reject", F.col("sent_qty")).otherwise(F.col("sent_qty") - came)
    return _emitted(flagged, _entry("to_store", "transfer_in", came, came.isNotNull()), _entry("from_store", "transfer_in", back, (F.col("action") == "reject") | (back > 0)))


def resolved(transfers: DataFrame, actions: DataFrame, by: Column | None = None, at: Column | None = None) -> DataFrame:
    """Transfers with the flagged items that actions (transfer_id, product_id, action, note) name resolved; completed if none is left.

    Items that have resolved_by, resolved_action and flag_note get who, what and the note; completed transfers their completed_date.
    """
    item = {f.name for f in transfers.schema["items"].dataType.elementType}
    who = F.lit(None).cast("string") if by is None else by
    a = actions.groupBy(F.col("transfer_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("product_id", F.struct("action", "note")))).alias("acts"))
    act = lambda i: F.try_element_at("acts", i["product_id"])
    said = lambda i: {"resolved_by": who, "resolved_action": act(i)["action"], "flag_note": F.coalesce(act(i)["note"], F.lit(""))}

    def marked(i: Column) -> Column:
        out = i.withField("status", F.lit("resolved"))
        for name, value in said(i).items():
            out = out.withField(name, value) if name in item else out
        return out

    settle = lambda i: F.when((i["status"] == "flagged") & act(i).isNotNull(), marked(i)).otherwise(i)
    joined = _guard(transfers, "resolve").join(a, "id", "left").withColumn("items", F.transform("items", settle))
    done = every("items", lambda i: i["status"].isin("accepted", "resolved"))
    done = done & F.col("acts").isNotNull()
    if at is not None:
        joined = _set(joined, completed_date=F.when(done, at).otherwise(F.col("completed_date")) if "completed_date" in joined.columns else at)
    return joined.withColumn("status", F.when(done, "completed").otherwise(F.col("status"))).select(*transfers.columns)


def cancelled(transfers: DataFrame, at: Column | None = None) -> DataFrame:
    """Drafts and transfers in transit as cancelled, their completed_date being `at`."""
    out = _guard(transfers, "cancel").withColumn("status", F.lit("cancelled"))
    return out if at is None else _set(out, completed_date=at)


def cancel_entries(transfers: DataFrame) -> DataFrame:
    """What cancelling puts back: the items of transfers in transit; drafts have taken nothing."""
    return _emitted(items_of(transfers.where(F.col("status") == "in_transit")), _entry("from_store", "transfer_in", F.col("sent_qty")))


def conservation(items: DataFrame, entries: DataFrame) -> DataFrame:
    """transfer_id, product_id, sent_qty, credited_qty, imbalance: what was sent against what entries have put back or in.

    imbalance is 0, but for items of which more came than was sent.
    """
    got = entries.groupBy("transfer_id", "product_id").agg(F.sum("qty").cast("bigint").alias("credited"))
    joined = items.select("transfer_id", "product_id", "sent_qty").join(got, ["transfer_id", "product_id"], "left")
    credited = F.coalesce("credited", F.lit(0)).cast("bigint")
    return joined.select("transfer_id", "product_id", "sent_qty", credited.alias("credited_qty"), (credited - F.col("sent_qty")).alias("imbalance"))


def pruned(transfers: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """The transfers that are kept: open ones, and closed ones whose completed_date (else date) is after as_of less `days` days."""
    ended = F.coalesce("completed_date", "date")
    return transfers.where(~F.col("status").isin("completed", "cancelled") | is_true(ended > as_of - F.make_dt_interval(F.lit(days))))


def prune_count(transfers: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """pruned: how many transfers pruned() leaves out."""
    gone = ~(~F.col("status").isin("completed", "cancelled") | is_true(F.coalesce("completed_date", "date") > as_of - F.make_dt_interval(F.lit(days))))
    return transfers.agg(F.count_if(gone).alias("pruned"))


def capability_matrix(users: DataFrame) -> DataFrame:
    """users (id, role) by what they may do: id, capability, allowed."""
    named = F.array(*(F.struct(F.lit(name).alias("capability"), is_true(F.col("role").isin(*roles)).alias("allowed")) for name, roles in CAPABILITIES.items()))
    return users.select("id", F.inline(named))
