"""What users look at: transfers by role, tab and page, product search, names, units, and messages about transfers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.loose import any_of, first_truthy, is_true, iso_time
from .transfers import items_of

PAGE = 15
TABS = ("all", "in_transit", "needs_receiving", "flagged", "completed", "drafts")


def visible(transfers: DataFrame, stores: DataFrame) -> DataFrame:
    """Transfers from or to one of `stores` (store_id); directors and head offices see all and don't need this.

    One row may match on either side: two joins on equal keys and a filter, rather than one join on an alternative.
    """
    mine = stores.select("store_id").distinct()
    a, b = mine.select(F.col("store_id").alias("a")), mine.select(F.col("store_id").alias("b"))
    joined = transfers.join(a, F.col("from_store") == F.col("a"), "left").join(b, F.col("to_store") == F.col("b"), "left")
    return joined.where(F.col("a").isNotNull() | F.col("b").isNotNull()).select(*transfers.columns)


def in_tab(transfers: DataFrame, tab: str, stores: DataFrame | None = None) -> DataFrame:
    """The transfers of a tab; an unknown tab shows all. needs_receiving: those on their way to `stores`, or to any without it."""
    status = {"in_transit": ["in_transit"], "needs_receiving": ["in_transit"], "flagged": ["flagged", "received"], "completed": ["completed"], "drafts": ["draft"]}.get(tab)
    out = transfers if status is None else transfers.where(F.col("status").isin(*status))
    if tab == "needs_receiving" and stores is not None:
        out = out.join(stores.select(F.col("store_id").alias("to_store")), "to_store", "left_semi").select(*transfers.columns)
    return out


def units(items: Column | str = "items") -> Column:
    """Units sent with the items of a transfer."""
    return F.aggregate(items, F.lit(0).cast("bigint"), lambda s, i: s + first_truthy(i["sent_qty"]))


def hub_rows(transfers: DataFrame) -> DataFrame:
    """id, created_at, status, from_store, to_store, item_count, total_units."""
    return transfers.select("id", iso_time("created_at").alias("created_at"), "status", "from_store", "to_store", F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("item_count"), F.coalesce(units(), F.lit(0)).cast("bigint").alias("total_units"))


def hub_summary(headers: DataFrame, units: DataFrame) -> DataFrame:
    """hub_rows() of headers without items, from units (id, item_count, total_units) of those that have any."""
    joined = headers.join(units, "id", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return joined.select("id", iso_time("created_at").alias("created_at"), "status", "from_store", "to_store", count("item_count"), count("total_units"))


def newest_first(transfers: DataFrame) -> DataFrame:
    return transfers.orderBy(F.desc_nulls_last("created_at"), "id")


def page(transfers: DataFrame, number: int, size: int = PAGE) -> DataFrame:
    """Page `number`, from 0, of the transfers, newest first; beyond the last page, the last."""
    last = max(1, -(-transfers.count() // size)) - 1
    at = max(0, min(number, last))
    return newest_first(transfers).offset(at * size).limit(size)


#: Steps by which the ranges of page_by_counts() get finer, and rows that it sorts rather than look closer.
STEPS, SORTED = ("year", "day", "hour", "minute", "second"), 10_000


def page_by_counts(transfers: DataFrame, number: int, size: int = PAGE) -> DataFrame:
    """As page(), but the counts of ranges of created_at tell in which one the page lies: only its rows are sorted, and few are skipped.

    Counts are added up before the shuffle, and the driver gets one for each range of a step: years, then the days of the years
    that the page lies in, and so on while those hold more than SORTED rows. Bounds on created_at reach the scan.
    """
    at = F.col("created_at")
    rows, skip, total, begin = transfers, 0, None, 0
    for step in STEPS:
        found = rows.groupBy(F.date_trunc(step, at).alias("b")).agg(F.count("*").alias("n")).orderBy(F.desc_nulls_last("b")).collect()
        if total is None:
            total = sum(r["n"] for r in found)
            begin = max(0, min(number, max(1, -(-total // size)) - 1)) * size
        before, chosen = skip, []
        for r in found:
            if before + r["n"] > begin and before < begin + size:
                skip = before if not chosen else skip
                chosen.append(r)
            before += r["n"]
        known = [r["b"] for r in chosen if r["b"] is not None]
        if not chosen:
            break
        # all of the range as bounds that the scan can skip by; the last moment of a step is the one before the next step
        past = F.lit(max(known)) + F.expr(f"interval 1 {step}") if known else None
        inside = (at >= F.lit(min(known))) & (at < past) if known else F.lit(False)
        rows = rows.where(inside | at.isNull() if len(known) < len(chosen) else inside)
        if sum(r["n"] for r in chosen) <= SORTED or not known:
            break
    return newest_first(rows).offset(begin - skip).limit(size)


def page_count(transfers: DataFrame, size: int = PAGE) -> DataFrame:
    return transfers.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("bigint").alias("pages"))


def listed(transfers: DataFrame, status: str | None = None, store_id=None) -> DataFrame:
    """Transfers by status and store (either end), latest date first."""
    out = transfers if status is None else transfers.where(F.col("status") == status)
    out = out if store_id is None else out.where((F.col("from_store") == store_id) | (F.col("to_store") == store_id))
    return out.orderBy(F.desc_nulls_last("date"), "id")


def is_active(active: Column | str = "active") -> Column:
    """Anything but false."""
    return ~(F.col(active) if isinstance(active, str) else active).eqNullSafe(F.lit(False))


def products_found(products: DataFrame, query: str) -> DataFrame:
    """id, name of active products whose name or id holds the query, whatever the case; an empty query finds all."""
    q = query.strip().lower()
    found = any_of([F.contains(F.lower(F.col(c).cast("string")), F.lit(q)) for c in ("name", "id")])
    out = products.where(is_active())
    return (out.where(is_true(found)) if q else out).select("id", "name")


def named(transfers: DataFrame, stores: DataFrame) -> DataFrame:
    """transfer_id, from_name, to_name, label: the stores' names, and the status in words."""
    one = lambda side: stores.select(F.col("id").alias(f"{side}_store"), F.col("name").alias(f"{side}_name"))
    joined = transfers.join(one("from"), "from_store", "left").join(one("to"), "to_store", "left")
    return joined.select(F.col("id").alias("transfer_id"), "from_name", "to_name", F.translate("status", "_", " ").alias("label"))


def item_names(transfers: DataFrame, products: DataFrame) -> DataFrame:
    """transfer_id, product_id, product, sent, received: received as text, '-' before it is known."""
    p = products.select(F.col("id").alias("product_id"), F.col("name").alias("product"))
    rows = items_of(transfers).join(p, "product_id", "left")
    return rows.select("transfer_id", "product_id", "product", F.col("sent_qty").alias("sent"), F.coalesce(F.col("received_qty").cast("string"), F.lit("-")).alias("received"))


def differences(items: DataFrame) -> DataFrame:
    """transfer_id, product_id, sent_qty, received_qty, diff, diff_text, state: unmatched before receipt, matched or mismatch after."""
    diff = F.col("received_qty") - F.col("sent_qty")
    text = F.when(diff > 0, F.concat(F.lit("+"), diff.cast("string"))).otherwise(diff.cast("string"))
    state = F.when(F.col("received_qty").isNull(), "unmatched").when(diff == 0, "matched").otherwise("mismatch")
    return items.select("transfer_id", "product_id", "sent_qty", "received_qty", diff.alias("diff"), text.alias("diff_text"), state.alias("state"))


def unit_totals(transfers: DataFrame) -> DataFrame:
    """transfer_id, item_count, selected, total_units, text: how many items, how many with a positive quantity, and both in words."""
    n, total = F.coalesce(F.size("items"), F.lit(0)), F.coalesce(units(), F.lit(0))
    text = F.concat(n.cast("string"), F.when(n == 1, " item").otherwise(" items"), F.lit(", "), total.cast("string"), F.when(total == 1, " unit").otherwise(" units"))
    chosen = F.coalesce(F.size(F.filter("items", lambda i: i["sent_qty"] > 0)), F.lit(0))
    return transfers.select(F.col("id").alias("transfer_id"), n.cast("bigint").alias("item_count"), chosen.cast("bigint").alias("selected"), total.cast("bigint").alias("total_units"), text.alias("text"))


def notifications(transfers: DataFrame, stores: DataFrame, products: DataFrame) -> DataFrame:
    """transfer_id, payload: the JSON text of a message about each transfer; that of a completed one tells what came and what was flagged."""
    rows = transfers.select("id", F.posexplode("items").alias("at", "i")).join(products.select(F.col("id").alias("p"), F.col("name").alias("product")), F.col("i.product_id") == F.col("p"), "left")
    named_items = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "product", "i"))).alias("found"))
    names = named(transfers, stores).select(F.col("transfer_id").alias("id"), "from_name", "to_name")
    joined = transfers.join(names, "id").join(named_items, "id", "left").withColumn("found", F.coalesce("found", F.array()))
    done = F.col("status") == "completed"
    sent = F.transform("found", lambda x: F.struct(x["product"].alias("product"), x["i"]["sent_qty"].alias("qty")))
    came = F.transform("found", lambda x: F.struct(x["product"].alias("product"), x["i"]["sent_qty"].alias("sent"), x["i"]["received_qty"].alias("received"), x["i"]["status"].alias("status")))
    settled = F.filter("found", lambda x: x["i"]["status"] == "resolved")
    flagged = F.transform(settled, lambda x: F.struct(x["product"].alias("product"), x["i"]["sent_qty"].alias("sent"), x["i"]["received_qty"].alias("received"), x["i"]["resolved_action"].alias("action"), x["i"]["flag_note"].alias("note"), x["i"]["resolved_by"].alias("resolvedBy")))
    ends = [F.col("from_name").alias("fromStore"), F.col("to_name").alias("toStore")]
    made = F.struct(F.lit("transfer_created").alias("type"), *ends, iso_time("date").alias("date"), F.col("created_by").alias("createdBy"), sent.alias("items"), F.size("found").alias("totalItems"), units().alias("totalUnits"))
    over = F.struct(F.lit("transfer_completed").alias("type"), *ends, iso_time("completed_date").alias("date"), F.col("received_by").alias("receivedBy"), came.alias("items"), flagged.alias("flaggedItems"))
    return joined.select(F.col("id").alias("transfer_id"), F.when(done, F.to_json(over)).otherwise(F.to_json(made)).alias("payload"))


def picker(products: DataFrame, stock: DataFrame, origin, destination, thresholds: DataFrame) -> DataFrame:
    """id, at_origin, at_destination, optimum, shortfall of active products, for an order from one store to another."""
    from .thresholds import resolved, wanted

    at = lambda store, name: stock.where(F.col("store_id") == store).select(F.col("product_id").alias("id"), F.col("on_hand").alias(name))
    rows = products.where(is_active()).select("id").join(at(origin, "o"), "id", "left").join(at(destination, "d"), "id", "left")
    rows = resolved(rows.select("id", F.col("id").alias("product_id"), F.lit(destination).alias("store_id"), "o", "d"), thresholds)
    have, best = F.coalesce("d", F.lit(0)), wanted()
    return rows.select("id", F.coalesce("o", F.lit(0)).cast("bigint").alias("at_origin"), have.cast("bigint").alias("at_destination"), best.alias("optimum"), F.greatest(F.lit(0), best - have).cast("bigint").alias("shortfall"))
