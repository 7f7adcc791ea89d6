"""Stock kept by a stream, pushes as a sink, and the replay of commands."""

import json
import random
import threading
from datetime import datetime, timedelta, timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import ledger, replay, sync, thresholds
from tallyweave.schemas import SCHEMAS, WIRE
from tallyweave.sources.commit_log import CommitLog
from tallyweave.streaming import merge, push, stock

AT = datetime(2024, 1, 1, tzinfo=timezone.utc)


def _wire(ident, kind, qty=1, target=None, store="s", product="p", at=0):
    return (ident, "2024-01-01", store, product, kind, str(qty), "", "", "d", 0, "", target, AT + timedelta(seconds=at))


def test_stock_in_any_order(spark, tmp_path):
    rng = random.Random(3)
    rows = [_wire(f"t{i}", rng.choice(["in", "out", "note"]), rng.randrange(9), store=rng.choice("ab"), at=i) for i in range(60)]
    rows += [_wire(f"x{i}", "deleted", 0, f"t{rng.randrange(80)}", at=100 + i) for i in range(25)] + [_wire("t7", "deleted", at=200), _wire("", "in"), _wire(None, "in")]
    rows += rng.sample(rows, 30)
    rng.shuffle(rows)
    for n in range(3):  # micro-batches of a file each
        spark.createDataFrame(rows[n::3], WIRE).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/log")
    log = merge.read_log(spark, f"file://{tmp_path}/log", spark.createDataFrame([], WIRE).schema, per_trigger=1)
    root = f"file://{tmp_path}/store"
    stock.start(log, root, f"file://{tmp_path}/c", pack_every=2).awaitTermination(240)
    gone = {r[11] or r[0] for r in rows if r[4] == "deleted"}
    left = {r[0]: r for r in rows if r[0] and r[4] != "deleted" and r[0] not in gone}
    want = {}
    for r in left.values():
        key = (r[2], r[3])
        want[key] = want.get(key, 0) + int(r[5]) * {"in": 1, "out": -1}.get(r[4], 0)
    assert {(r["store_id"], r["product_id"]): r["on_hand"] for r in stock.on_hand(spark, root).collect()} == want and gone & {r[0] for r in rows}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) is None or "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


class Service:
    """Knows rows by their id; refuses, or confirms a part of, what it is told to."""

    def __init__(self):
        self.rows, self.posts, self.down, self.partial = {}, 0, set(), set()
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):  # noqa: N802
                rows = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["data"]["transactions"]
                outer.posts += 1
                ids = {r["TransactionId"] for r in rows}
                self.send_response(500 if ids & outer.down else 200)
                self.end_headers()
                if not ids & outer.down:
                    outer.rows.update({r["TransactionId"]: r for r in rows})
                    self.wfile.write(json.dumps({"status": "ok", "processedCount": len(rows) - len(ids & outer.partial)}).encode())

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}"


def test_push_as_a_stream(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMAS["transactions"]).schema
    rows = spark.createDataFrame([(f"t{i}", "in", "p", i, "s", None, None, None, "r", None, "d", i % 3 == 0, None) for i in range(60)], schema)
    queued = ledger.tombstones(rows, rows.where("txn_id in ('t3', 't4')"))
    rows.unionByName(queued.select(*queued.columns), allowMissingColumns=True).coalesce(2).write.parquet(f"file://{tmp_path}/ledger")
    service, acks = Service(), f"file://{tmp_path}/acks"
    spark.dataSource.register(push.PushService)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/ledger")
        wire = sync.to_wire(sync.unsynced(stream), "dev")
        writer = wire.writeStream.format("push_service").option("url", service.url).option("acks", acks).option("size", "7").option("tries", "2").option("wait_s", "0")
        query = writer.option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination(240)

    service.down = {"t1"}
    with pytest.raises(Exception, match="NotConfirmed|500"):
        run()
    service.down, service.partial = set(), {"t2"}
    with pytest.raises(Exception, match="NotConfirmed|confirmed"):
        run()
    service.partial = set()
    run()
    want = {f"t{i}" for i in range(60) if i % 3} | {"del_t3", "del_t4"}
    got = [r["txn_id"] for r in push.acknowledged(spark, acks).collect()]
    assert sorted(got) == sorted(want) and set(service.rows) == want
    assert service.rows["del_t3"]["TargetTransactionId"] == "t3" and service.rows["del_t3"]["Reason"] == "Transaction deleted: t3" and "TargetTransactionId" not in service.rows["t1"]
    told = push.manifests(spark, acks).collect()
    assert sorted(r["name"] for r in told) == [f"epoch-{n:012d}" for n in range(2)] and sum(r["sent"] for r in told) == len(want)
    # nothing new, nothing posted; looking at acknowledgements posts nothing
    before = service.posts
    run()
    assert service.posts == before and push.acknowledged(spark, acks).count() == len(want)
    done = sync.marked_synced(rows, push.acknowledged(spark, acks))
    assert done.where("not synced").isEmpty()
    # as a batch
    sync.to_wire(rows.where("txn_id = 't0'"), "dev").write.format("push_service").option("url", service.url).option("acks", acks).mode("append").save()
    assert push.acknowledged(spark, acks).count() == len(want) + 1
    service.server.shutdown()


def test_tombstones_there_and_back(spark):
    rows = spark.createDataFrame([("t1", "in", "p", 3, "s"), ("t2", "in", "p", 3, "s")], "txn_id string, type string, product_id string, qty long, store_id string")
    wire = sync.to_wire(rows.unionByName(ledger.tombstones(rows, rows.where("txn_id = 't1'")), allowMissingColumns=True).withColumns({c: F.lit(None).cast("string") for c in ("date", "staff_name", "device_id", "transfer_id", "created_at")}), "dev")
    assert {r["txn_id"] for r in sync.targets(wire).collect()} == {"t1"}
    assert {r["txn_id"] for r in sync.merged(rows.select("txn_id"), wire).collect()} == {"t2"}
    back = {r["txn_id"]: r["target_txn_id"] for r in sync.from_wire(wire).collect()}
    assert back == {"t1": None, "t2": None, "del_t1": "t1"}


def test_copies_are_chosen_alike(spark):
    copies = [_wire("t", "in", q, at=q % 5) for q in range(40)]
    got = {sync.live(spark.createDataFrame(random.Random(n).sample(copies, 40), WIRE).repartition(n)).first()["Qty"] for n in range(1, 6)}
    assert got == {"9"}  # of those last ingested (4, 9, ... 39) the last as text


def test_one_threshold_a_key(spark):
    t = spark.createDataFrame([("p", None, 4, 8), ("p", "*", 3, 9), ("q", "s", 2, 1), ("q", "s", 1, 5)], "product_id string, store_id string, min_qty long, optimum_qty long")
    pairs = spark.createDataFrame([("s", "p"), ("s", "q"), ("u", "q")], "store_id string, product_id string")
    assert sorted(map(tuple, thresholds.resolved(pairs, t).collect()), key=str) == [("s", "p", 3, 9), ("s", "q", 1, 5), ("u", "q", None, None)]


def test_replay(spark):
    line = lambda *x: [{"product_id": p, "qty": q} for p, q in x]
    c = lambda t, n, step, a=None, b=None, draft=None, p=None, action=None, q=None, lines=None: (t, n, step, a, b, draft, p, action, q, lines)
    rows = [
        c(1, 0, "create", 5, 6, True, lines=line((1, 3), (2, 4))), c(1, 1, "submit"), c(1, 2, "confirm", p=1), c(1, 3, "confirm", p=9), c(1, 4, "submit", lines=line((1, 7))), c(1, 5, "receive", lines=line((1, 6), (1, 7))), c(1, 6, "resolve", p=2, action="reject"),
        c(1, 7, "resolve", p=1, action="accept_as_is"), c(1, 8, "cancel"), c(1, 9, "fly"), c(2, 0, "create", 5, 5, False, lines=line((1, 3))), c(2, 1, "cancel"), c(3, 0, "create", 5, 6, False, lines=line((1, 3))), c(3, 1, "create", 5, 6, False, lines=line((1, 3))), c(3, 2, "cancel"),
        c(4, 0, "create", 5, None, False, lines=line((1, 3))), c(None, 0, "create"),
    ]
    done = replay.replayed(spark.createDataFrame(rows, replay.COMMAND).repartition(3)).collect()
    said = {(r["transfer_id"], r["seq"]): r for r in done}
    assert len(done) == len(rows) - 1
    assert [said[1, n]["error"] for n in range(10)] == [None, "no confirmed items", None, "item not found", None, None, "flagged item not found", None, "cannot cancel", "unknown step"]
    assert [said[1, n]["status"] for n in (0, 4, 5, 7, 9)] == ["draft", "in_transit", "received", "completed", "completed"]
    assert [tuple(e) for e in said[1, 4]["entries"]] == [(1, 5, "transfer_out", 7)] and [tuple(e) for e in said[1, 7]["entries"]] == [(1, 6, "transfer_in", 6), (1, 5, "transfer_in", 1)]
    assert [tuple(i) for i in said[1, 9]["items"]] == [(1, 7, 6, "resolved")] and said[1, 8]["items"] is None
    assert said[2, 0]["error"] == "same store" and said[2, 1]["error"] == "cannot cancel" and said[2, 1]["status"] is None and said[4, 0]["error"] == "missing fields" and said[3, 1]["error"] == "transfer exists"
    assert tuple(replay.final_states(spark.createDataFrame(done, replay.OUTCOME)).where("transfer_id = 3").first()) == (3, "cancelled", 2, 1, 3, 3)


def test_long_histories_are_folded_as_they_come(spark):
    create = spark.range(1).selectExpr("1L transfer_id", "-1L seq", "'create' step", "1L from_store", "2L to_store", "true draft", "null product_id", "array(struct(1L product_id, 5L qty)) lines")
    toggles = spark.range(30_001).selectExpr("1L transfer_id", "id seq", "'confirm' step", "null from_store", "null to_store", "null draft", "1L product_id", "null lines")
    cast = lambda df: df.selectExpr("transfer_id", "seq", "step", "cast(from_store as long) from_store", "cast(to_store as long) to_store", "cast(draft as boolean) draft", "cast(product_id as long) product_id", "cast(null as string) action", "cast(null as long) qty", f"cast(lines as array<{replay.LINE}>) lines")
    done = replay.replayed(cast(toggles).unionByName(cast(create)))
    last = done.where("items is not null").collect()
    assert len(last) == 1 and last[0]["items"][0]["status"] == "confirmed" and done.where("error is null").count() == 30_002


def _dealt_apart(spark):
    """Commands of two sides that are dealt by transfer already, of which only the smaller is put together to fewer partitions; and how many transfers."""
    n = 400
    lines = "transform(sequence(1, 60), x -> struct(x + 0L product_id, id * x qty))"
    rest = "cast(null as long) product_id, cast(null as string) action, cast(null as long) qty"
    create = spark.range(n).selectExpr("id transfer_id", "0L seq", "'create' step", "1L from_store", "2L to_store", "false draft", *rest.split(", "), f"{lines} lines").repartition("transfer_id")
    cancel = spark.range(n).selectExpr("id transfer_id", "1L seq", "'cancel' step", "null from_store", "null to_store", "null draft", *rest.split(", "), "null lines").repartition("transfer_id")
    return create.unionByName(cancel), n


def _with_small_partitions(spark, act):
    conf = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        return act()
    finally:
        for k in conf:
            spark.conf.unset(k)


def test_replay_of_sides_dealt_already(spark):
    commands, n = _dealt_apart(spark)
    done = _with_small_partitions(spark, lambda: replay.final_states(replay.replayed(commands)).collect())
    assert len(done) == n and {(r["status"], r["accepted"], r["refused"]) for r in done} == {("cancelled", 2, 0)}


def test_refusals_of_sides_dealt_already(spark):
    commands, _ = _dealt_apart(spark)
    assert _with_small_partitions(spark, lambda: replay.refusals(replay.replayed(commands)).collect()) == []


def test_stock_is_joined_not_asked_row_by_row(spark, tmp_path):
    log, root = spark.createDataFrame([_wire("a", "in", 5), _wire("b", "out", 2, at=1), _wire("x", "deleted", 0, "c")], WIRE), f"file://{tmp_path}"
    run = stock.keep_batch(root, buckets=3)
    run(log, 0)
    run(log, 0)  # run again, as after a failure
    run(log, 1)  # all replays
    later = spark.createDataFrame([_wire("y", "deleted", 0, "a"), _wire("c", "in", 9), _wire("b", "in", 4, at=2), _wire("d", "in", 1, store=None)], WIRE)
    run(later, 2)
    assert sorted(map(tuple, stock.on_hand(spark, root).collect()), key=str) == [("s", "p", -2), (None, "p", 1)]
    known = CommitLog(spark, root).read_bucketed(stock.KNOWN)
    assert {tuple(r) for r in known.groupBy("id").agg(F.max("moved"), F.bool_or("gone")).collect()} == {("a", 5, True), ("b", -2, False), ("c", 9, True), ("d", 1, False)}
    plan = stock.changes(later, known)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Bucketed: true" in plan and "TransformWithState" not in plan
