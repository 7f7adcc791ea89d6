"""Truth tables, properties and stores of the ledger, on small tables."""

from datetime import date, datetime, timezone

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyweave.functions import loose
from tallyweave.operators import ledger, sync, thresholds, transfers, views
from tallyweave.plans.queries import QUERIES
from tallyweave.schemas import SCHEMAS
from tallyweave.sources import bindings, tables

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
TXN = "txn_id string, type string, product_id string, qty long, store_id string, date date"


def test_signs(spark):
    kinds = [*ledger.INFLOW, *ledger.OUTFLOW, "deleted", "unknown", None]
    rows = spark.createDataFrame([(k,) for k in kinds], "type string").select("type", ledger.sign().alias("s")).collect()
    assert {r["type"]: r["s"] for r in rows} == {**dict.fromkeys(ledger.INFLOW, 1), **dict.fromkeys(ledger.OUTFLOW, -1), "deleted": 0, "unknown": 0, None: 0}


@SLOW
@given(st.lists(st.tuples(st.sampled_from([*ledger.INFLOW, *ledger.OUTFLOW, "deleted"]), st.sampled_from("ab"), st.integers(0, 50), st.integers(1, 4)), min_size=1, max_size=40))
def test_balance_is_a_fold_and_ends_on_hand(spark, entries):
    rows = [(f"t{i:03d}", k, p, q, "s", date(2024, 1, d)) for i, (k, p, q, d) in enumerate(entries)]
    df = spark.createDataFrame(rows, TXN)
    got = {r[0]: r[1] for r in ledger.running_balance(df).collect()}
    sums = {}
    for i, k, p, q, _, d in sorted(rows, key=lambda r: (r[2], r[5], r[0])):
        sums[p] = sums.get(p, 0) + (q if k in ledger.INFLOW else -q if k in ledger.OUTFLOW else 0)
        assert got[i] == sums[p]
    assert {r["product_id"]: r["on_hand"] for r in ledger.on_hand(df).collect()} == sums


def test_loose_values(spark):
    row = spark.range(1).select(
        loose.first_truthy(F.lit(0), F.lit(None), F.lit(7)).alias("a"), loose.first_truthy(F.lit(0), F.lit(None)).alias("b"), loose.whole_number(F.lit(" 12abc")).alias("c"), loose.whole_number(F.lit("abc")).alias("d"), loose.whole_number(F.lit("9" * 30)).alias("e"),
        loose.every(F.expr("cast(array() as array<int>)"), lambda x: x > 0).alias("f"), loose.some(F.expr("cast(array() as array<int>)"), lambda x: x > 0).alias("g"), loose.every(F.expr("array(1, null)"), lambda x: x > 0).alias("h"),
        loose.first_where(F.expr("array(1, 5, 7)"), lambda x: x > 3).alias("i"), loose.first_where(F.expr("array(1)"), lambda x: x > 3).alias("j"), loose.first_text(F.lit(""), F.lit("x")).alias("k"),
    ).first()
    assert tuple(row) == (7, 0, 12, 0, 0, True, False, False, 5, None, "x")


def test_thresholds_fall_back_and_zero_optimum_falls_through(spark):
    t = spark.createDataFrame([("p", None, 4, 0), ("p", "s", 2, 9), ("q", "*", 3, 8)], "product_id string, store_id string, min_qty long, optimum_qty long")
    stock = spark.createDataFrame([("s", "p", 1), ("u", "p", 1), ("u", "q", 9), ("u", "r", 0)], "store_id string, product_id string, on_hand long")
    got = {(r[0], r[1]): (r[3], r[4]) for r in thresholds.shortfall(stock, t).collect()}
    assert got == {("s", "p"): (9, 8), ("u", "p"): (4, 3), ("u", "q"): (8, 0), ("u", "r"): (0, 0)}
    assert {tuple(r)[:2] for r in thresholds.low_stock(stock, t).collect()} == {("s", "p"), ("u", "p")}


@SLOW
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 25), st.sampled_from(["accept_as_is", "adjust", "reject"]), st.integers(0, 20)), min_size=1, max_size=12))
def test_what_is_sent_is_accounted_for(spark, cases):
    rows = [("t", f"p{i}", "a", "b", s, r, k, q) for i, (s, r, k, q) in enumerate(cases)]
    items = spark.createDataFrame(rows, "transfer_id string, product_id string, from_store string, to_store string, sent_qty long, received_qty long, action string, action_qty long")
    got = {r["product_id"]: r["imbalance"] for r in transfers.conservation(items, transfers.resolution_entries(items)).collect()}
    for i, (sent, came, action, qty) in enumerate(cases):
        kept = {"accept_as_is": came, "adjust": qty, "reject": 0}[action]
        assert got[f"p{i}"] == max(0, kept - sent)


def test_states(spark):
    item = "struct<product_id: string, sent_qty: bigint, received_qty: bigint, status: string>"
    rows = [(s, s, [("p", 3, None, "confirmed"), ("q", 2, None, "pending")], "a", "b", datetime(2024, 1, 1)) for s in ("draft", "in_transit", "received", "completed", "cancelled")]
    t = spark.createDataFrame(rows, f"id string, status string, items array<{item}>, from_store string, to_store string, date timestamp")
    none = spark.createDataFrame([], "transfer_id string, product_id string, qty long, received_qty long")
    assert {r["id"] for r in transfers.cancelled(t).collect()} == {"draft", "in_transit"}
    sent = transfers.submitted(t, none, F.lit(datetime(2024, 2, 1))).collect()
    assert [(r["id"], r["status"], [i["product_id"] for i in r["items"]]) for r in sent] == [("draft", "in_transit", ["p"])]
    got = transfers.received(t, spark.createDataFrame([("in_transit", "p", 3)], "transfer_id string, product_id string, received_qty long")).collect()
    assert [(r["status"], [i["status"] for i in r["items"]]) for r in got] == [("received", ["accepted", "flagged"])]
    assert transfers.cancel_entries(t).count() == 2


def test_pages_partition_the_list_in_order(spark):
    rows = [(i, datetime(2024, 1, 1 + i % 3)) for i in range(37)]
    t = spark.createDataFrame(rows, "id long, created_at timestamp")
    want = [i for i, _ in sorted(rows, key=lambda r: (-r[1].timestamp(), r[0]))]
    assert [r["id"] for n in range(3) for r in views.page(t, n).collect()] == want
    assert [r["id"] for r in views.page(t, 99).collect()] == want[30:]
    assert views.page(t.where("false"), 3).isEmpty() and views.page_count(t.where("false")).first()[0] == 1


WIRE = "TransactionId string, Type string, DeviceId string, TargetTransactionId string"


@SLOW
@given(st.lists(st.tuples(st.integers(0, 6), st.booleans(), st.integers(0, 6)), max_size=15), st.randoms())
def test_merge_ignores_order_and_replays(spark, rows, random):
    made = [(f"d{i}" if gone else str(t), "deleted" if gone else "in", "x", str(target) if gone else None) for i, (t, gone, target) in enumerate(rows)]
    local = spark.createDataFrame([("0",), ("1",)], "txn_id string")
    shuffled = [*made, *made]
    random.shuffle(shuffled)
    ids = [{r[0] for r in sync.merged_ids(local, spark.createDataFrame(x, WIRE)).collect()} for x in (made, shuffled)]
    want = {"0", "1"} | {r[0] for r in made if r[1] == "in"}
    assert ids[0] == ids[1] == want - {r[3] for r in made if r[1] == "deleted"}


def test_store_of_tables(spark, tmp_path):
    root = str(tmp_path)
    assert tables.read(spark, root, "stores").isEmpty()
    stores = [{"id": "a", "name": "A", "type": "x", "active": True}]
    assert tables.seed(spark, root, {"stores": stores}) == ["stores"] and tables.seed(spark, root, {"stores": stores}) == []
    tables.append(tables.read(spark, root, "stores").withColumn("id", F.lit("b")), root, "stores")
    assert sorted(r["id"] for r in tables.read(spark, root, "stores").collect()) == ["a", "b"]
    backup = tmp_path / "backup.json"
    backup.write_text('{"meta": [\n{"key": "_v", "value": "3"}]}')
    meta = tables.read_or_backup(spark, root, "meta", str(backup))
    assert [tuple(r) for r in tables.versioned(meta).collect()] == [("_v", "4")]
    tables.delete(spark, f"{root}/stores")
    assert tables.read(spark, root, "stores").isEmpty()


def test_a_broken_commit_does_not_count(spark, tmp_path):
    root, one = str(tmp_path), spark.createDataFrame([("k", "1")], "key string, value string")
    one.write.parquet(f"{root}/meta/batch=0")  # written, but without its manifest
    assert tables.committed(spark, root, "meta").isEmpty()
    assert tables.commit(spark, root, 0, {"meta": one}) and not tables.commit(spark, root, 0, {"meta": one})
    assert tables.committed(spark, root, "meta").count() == 1


def test_retries_end(spark):
    calls = []

    def fails():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return None

    tables.with_retry(fails, first_wait_s=0)
    assert len(calls) == 3


def test_windows_and_stale_devices(spark):
    at = lambda d: datetime(2024, 1, d, tzinfo=timezone.utc)
    log = spark.createDataFrame([("x", at(1)), ("y", at(9)), ("x", at(2))], "DeviceId string, SyncTimestamp timestamp")
    assert [r["device_id"] for r in sync.stale(log, at(9)).collect()] == ["x"]
    assert sync.window(log, at(2), at(9), 0).count() == 1 and sync.window(log, at(2), at(9), 1).count() == 2 and sync.window(log, None, at(8)).count() == 2


def test_stores_of_tables_change_together(spark, tmp_path):
    root = f"file://{tmp_path}/all"
    frames = lambda name: {"stores": spark.createDataFrame([("a", name, "s", True)], SCHEMAS["stores"]), "meta": spark.createDataFrame([("_v", "3")], SCHEMAS["meta"])}
    assert tables.snapshot(spark, root, "stores").isEmpty()
    assert tables.save_all(spark, root, 1, frames("old")) and tables.save_all(spark, root, 2, frames("new")) and not tables.save_all(spark, root, 2, frames("newer"))
    assert [r["name"] for r in tables.snapshot(spark, root, "stores").collect()] == ["new"] and tables.snapshot(spark, root, "meta").first()["value"] == "4"
    tables.append(frames("x")["stores"], root + "/t", "stores")
    assert tables.lookup(spark, root + "/t", "stores", "id", "a").count() == 1 and tables.lookup(spark, root + "/t", "stores", "id", "b").isEmpty()
    tables.append(frames("x")["stores"], root + "/t", "stores")
    assert tables.refreshed(spark, root + "/t", "stores").count() == 2


def test_upserts_keep_one_row_of_a_key(spark):
    base = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id int, name string, n int")
    changes = spark.createDataFrame([(1, "x", 1), (1, "y", 3), (1, "z", 2), (3, "c", 1), (3, "c", 1)], base.schema)
    assert sorted(map(tuple, tables.upserted(base, changes, ["id"], ["n"]).collect())) == [(1, "y", 3), (2, "b", 0), (3, "c", 1)]
    assert sorted(map(tuple, tables.upserted(base, changes, ["id"]).collect())) == [(1, "z", 2), (2, "b", 0), (3, "c", 1)]


def test_broken_stores_fall_back(spark, tmp_path):
    (tmp_path / "meta").mkdir()
    (tmp_path / "meta" / "part-0.parquet").write_bytes(b"PAR1 broken PAR1")
    backup = tmp_path / "backup.json"
    backup.write_text('{"meta": [{"key": "_v", "value": "9"}]}')
    assert tables.read_or_backup(spark, f"file://{tmp_path}", "meta", str(backup)).first()["value"] == "9"


def test_push_retries_marks_and_counts(spark):
    rows = spark.createDataFrame([(f"t{i}", "in", "p", 1, "s", None, None, None, "r", None, "d", i % 3 == 0, None) for i in range(40)], SCHEMAS["transactions"])
    asked = spark.sparkContext.accumulator(0)

    def post(body: list) -> dict:
        asked.add(1)
        if any(x["TransactionId"] == "t1" for x in body):
            raise OSError("no")
        return {"processedCount": len(body) - any(x["TransactionId"] == "t2" for x in body)}

    found = sync.pushed(rows, post, "dev", size=5, tries=3, wait_s=0)
    acks = spark.createDataFrame(found.collect(), found.schema)
    ids = {i for r in acks.collect() for i in r["txn_ids"]}
    assert ids == {f"t{i}" for i in range(40) if i % 3} and asked.value == 6 + 2
    bad = {i for r in acks.collect() if r["error"] or r["processed"] != r["sent"] for i in r["txn_ids"]}
    assert {"t1", "t2"} <= bad
    done = sync.marked_synced(rows, sync.confirmed(acks))
    assert {r["txn_id"] for r in done.collect() if not r["synced"]} == bad
    totals = sync.push_totals(acks).first()
    assert tuple(totals) == (6, len(ids - bad), len(bad))


def test_push_totals_are_of_all_that_is_pushed(spark, sf):
    """Tombstones too: as many rows as sync_push_batch sends, in batches that are full but for the last."""
    n = QUERIES["sync_push_batch"](spark, sf).count()
    total = QUERIES["push_totals"](spark, sf).first()
    assert total["sent"] + total["failed"] == n and total["batches"] == -(-n // sync.BATCH) and total["sent"] > 0


def test_drafts_of_stock_takes(spark):
    lines = spark.createDataFrame([(1, 5, 3), (1, 6, 0), (2, 5, 4)], "store_id long, product_id long, qty long")
    made = transfers.from_stock_take(lines, 0, F.lit(datetime(2024, 1, 1)), F.lit("me")).collect()
    assert sorted((r["from_store"], r["to_store"], r["status"], r["created_by"], [(i["product_id"], i["sent_qty"]) for i in r["items"]]) for r in made) == [(0, 1, "draft", "me", [(5, 3)]), (0, 2, "draft", "me", [(5, 4)])]
    counted = spark.createDataFrame([(1, 5), (3, 5)], "store_id long, product_id long")
    assert [tuple(r) for r in transfers.without_shortfall(counted, lines).collect()] == [(3, "No shortfalls detected")]


def test_pages_by_counts_are_the_same(spark, monkeypatch):
    monkeypatch.setattr(views, "SORTED", 5)
    rows = [(i, None if i % 11 == 0 else datetime(2020 + i % 4, 1 + i % 3, 1 + i % 2, i % 5, 0, i % 7)) for i in range(237)]
    t = spark.createDataFrame(rows, "id long, created_at timestamp").withColumn("status", F.lit("x")).cache()
    for n in (0, 3, 7, 14, 15, 10**9):
        assert [r["id"] for r in views.page_by_counts(t, n).collect()] == [r["id"] for r in views.page(t, n).collect()]
    assert views.page_by_counts(t.where("false"), 3).isEmpty() and [r["id"] for r in views.page_by_counts(t.where("created_at is null"), 1).collect()] == [r["id"] for r in views.page(t.where("created_at is null"), 1).collect()]


@pytest.mark.parametrize("name", ["transfer_items", "transfers"])
def test_tasks_follow_the_lines(spark, sf, monkeypatch, name):
    """What a task holds of orders' lines doesn't grow with them, and the rows stay the same."""
    made, before = getattr(bindings, name), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        want = sorted(map(str, made(spark, sf).collect()))
        monkeypatch.setattr(bindings, "LINES_A_TASK", 500, raising=False)
        rows, least = made(spark, sf), spark.read.parquet(f"{sf}/lineitem.parquet").count() // 500 + 1
        assert least > 4 and rows.rdd.getNumPartitions() == least and sorted(map(str, rows.collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
