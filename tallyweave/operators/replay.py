"""The life of transfers replayed from a log of commands: an ordered fold of each transfer's commands, refusing what isn't allowed.

Commands are dealt by transfer and sorted within partitions, and each task folds them as they come: it holds the items of one
transfer, never its history. So a history may be of any length, and a transfer with a large part of all commands takes one task's
time but no more memory than its items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .transfers import TRANSITIONS

LINE = "struct<product_id: bigint, qty: bigint>"
#: A command: create has both stores, draft and lines; confirm and resolve a product; submit may have edits and receive receipts as lines.
COMMAND = f"transfer_id bigint, seq bigint, step string, from_store bigint, to_store bigint, draft boolean, product_id bigint, action string, qty bigint, lines array<{LINE}>"
_ITEM = "struct<product_id: bigint, sent_qty: bigint, received_qty: bigint, status: string>"
_ENTRY = "struct<product_id: bigint, store_id: bigint, type: string, qty: bigint>"
OUTCOME = f"transfer_id bigint, seq bigint, step string, error string, status string, entries array<{_ENTRY}>, items array<{_ITEM}>"

# Why a command is refused.
EXISTS, FIELDS, SAME, UNKNOWN = "transfer exists", "missing fields", "same store", "unknown step"
NOT_ALLOWED = {"confirm": "not a draft", "submit": "not a draft", "receive": "not in transit", "resolve": "invalid transfer", "cancel": "cannot cancel"}
NO_ITEM, NO_FLAG, NOTHING = "item not found", "flagged item not found", "no confirmed items"


class Transfer:
    """A transfer as its commands so far have left it. Each step returns why it is refused, or None; entries are what it moves."""

    def __init__(self) -> None:
        self.status, self.items, self.ends = None, {}, (None, None)
        self.entries: list[dict] = []

    def take(self, c: dict) -> str | None:
        self.entries = []
        step = c["step"]
        if step == "create":
            return self.create(c)
        allowed = {**TRANSITIONS, "confirm": ("draft",)}.get(step)
        if allowed is None:
            return UNKNOWN
        return getattr(self, step)(c) if self.status in allowed else NOT_ALLOWED[step]

    def move(self, product, end: int, kind: str, qty) -> None:
        self.entries.append({"product_id": product, "store_id": self.ends[end], "type": kind, "qty": qty})

    def send(self) -> None:
        for p, item in self.items.items():
            self.move(p, 0, "transfer_out", item["sent_qty"])

    def create(self, c: dict) -> str | None:
        if self.status is not None:
            return EXISTS
        if c["from_store"] is None or c["to_store"] is None or not c["lines"]:
            return FIELDS
        if c["from_store"] == c["to_store"]:
            return SAME
        self.ends, self.status = (c["from_store"], c["to_store"]), "draft" if c["draft"] else "in_transit"
        self.items = {x["product_id"]: {"sent_qty": x["qty"], "received_qty": None, "status": "pending"} for x in c["lines"]}
        if not c["draft"]:
            self.send()

    def confirm(self, c: dict) -> str | None:
        item = self.items.get(c["product_id"])
        if item is None:
            return NO_ITEM
        item["status"] = "pending" if item["status"] == "confirmed" else "confirmed"

    def submit(self, c: dict) -> str | None:
        kept = {p: x for p, x in self.items.items() if x["status"] == "confirmed"}
        if not kept:
            return NOTHING
        edits = {x["product_id"]: x["qty"] for x in c["lines"] or ()}
        self.items = {p: {"sent_qty": edits.get(p, x["sent_qty"]), "received_qty": None, "status": "pending"} for p, x in kept.items()}
        self.status = "in_transit"
        self.send()

    def receive(self, c: dict) -> None:
        came = {x["product_id"]: x["qty"] for x in reversed(c["lines"] or ())}  # of several receipts the first
        for p, item in self.items.items():
            item["received_qty"] = came.get(p, 0)
            item["status"] = "accepted" if item["received_qty"] == item["sent_qty"] else "flagged"
            if item["status"] == "accepted":
                self.move(p, 1, "transfer_in", item["received_qty"])
        self.status = "received" if any(x["status"] == "flagged" for x in self.items.values()) else "completed"

    def resolve(self, c: dict) -> str | None:
        p = c["product_id"]
        item = self.items.get(p)
        if item is None or item["status"] != "flagged":
            return NO_FLAG
        item["status"] = "resolved"
        kept = {"accept_as_is": item["received_qty"], "adjust": c["qty"]}.get(c["action"])
        if kept is not None:
            self.move(p, 1, "transfer_in", kept)
        back = item["sent_qty"] if c["action"] == "reject" else item["sent_qty"] - kept if kept is not None else 0
        if back > 0 or c["action"] == "reject":
            self.move(p, 0, "transfer_in", back)
        if all(x["status"] in ("accepted", "resolved") for x in self.items.values()):
            self.status = "completed"

    def cancel(self, c: dict) -> None:
        if self.status == "in_transit":
            for p, item in self.items.items():
                self.move(p, 0, "transfer_in", item["sent_qty"])
        self.status = "cancelled"


def replayed(commands: DataFrame) -> DataFrame:
    """transfer_id, seq, step, error, status, entries, items: what became of each command of the log (COMMAND).

    error is null if it was taken; status is the transfer's after it, null where there is none; items stand in the last row of a
    transfer alone. Commands of one seq are taken in order of their other columns; those without a transfer_id are left out.
    """
    names = [c.split()[0] for c in COMMAND.split(", ") if c.split()[0] in commands.columns]
    # dealt by a hash of the id: Spark leaves out a repartition by what a union's sides are dealt by already, then coalesces each side alone
    rows = commands.select(*names).where("transfer_id is not null").repartition(F.xxhash64("transfer_id")).sortWithinPartitions("transfer_id", "seq", *(c for c in names if c not in ("transfer_id", "seq")))

    def fold(frames):
        import pyarrow as pa

        held, transfer, now = None, None, object()

        def close(row: dict) -> dict:
            row["items"] = [{"product_id": p, **x} for p, x in transfer.items.items()]
            return row

        for frame in frames:
            out = []
            for c in frame.to_pylist():
                if c["transfer_id"] != now:
                    if held is not None:
                        out.append(close(held))
                    held, now, transfer = None, c["transfer_id"], Transfer()
                if held is not None:
                    out.append(held)
                error = transfer.take(c)
                held = {"transfer_id": now, "seq": c["seq"], "step": c["step"], "error": error, "status": transfer.status, "entries": [] if error else transfer.entries, "items": None}
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if held is not None:
            yield pa.RecordBatch.from_pylist([close(held)], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(OUTCOME))
    return rows.mapInArrow(fold, OUTCOME)


def final_states(outcomes: DataFrame) -> DataFrame:
    """transfer_id, status, accepted, refused, units_out, units_in: a row for each transfer of the log."""
    units = lambda kind: F.aggregate(F.filter("entries", lambda e: e["type"] == kind), F.lit(0).cast("bigint"), lambda s, e: s + e["qty"])
    rows = outcomes.select("transfer_id", "seq", "status", "error", units("transfer_out").alias("o"), units("transfer_in").alias("i"), F.col("items").isNotNull().alias("last"))
    total = lambda c: F.sum(c).cast("bigint")
    return rows.groupBy("transfer_id").agg(F.max(F.when(F.col("last"), F.col("status"))).alias("status"), F.count_if(F.col("error").isNull()).alias("accepted"), F.count("error").alias("refused"), total("o").alias("units_out"), total("i").alias("units_in"))


def refusals(outcomes: DataFrame) -> DataFrame:
    """step, error, n."""
    return outcomes.where("error is not null").groupBy("step", "error").agg(F.count("*").alias("n"))
