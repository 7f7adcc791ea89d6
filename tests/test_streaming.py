"""Streams against the batch views of the same log."""

from pyspark.sql import functions as F

from tallyweave.operators import sync
from tallyweave.sources import bindings, tables
from tallyweave.streaming import merge, paged
from tallyweave.streaming.queries import QUERIES


def test_merge_in_batches_equals_the_batch_merge(spark, sf):
    log = bindings.sync_log(spark, sf)
    want = {r[0] for r in sync.merged_ids(log.where(F.lit(False)).select(F.col("TransactionId").alias("txn_id")), log).collect()}
    for name in ("stream_merge", "stream_merge_packed"):
        got = [r[0] for r in QUERIES[name](spark, sf).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_running_sums_equal_the_batch_sums(spark, sf):
    log = bindings.sync_log(spark, sf)
    kind = F.when(F.col("Type") == "purchase", -1).when(F.col("Type") == "deleted", 0).otherwise(1)
    want = log.groupBy("StoreId", "ProductId").agg(F.sum(kind * F.col("Qty").cast("bigint")).alias("n"))
    assert {tuple(r) for r in QUERIES["stream_on_hand"](spark, sf).collect()} == {tuple(r) for r in want.collect()}


def test_a_batch_run_again_changes_nothing(spark, sf, tmp_path):
    log = bindings.sync_log(spark, sf).where("cast(TransactionId as int) < 50")
    run = merge.merge_batch(str(tmp_path), device="3")
    for batch in (0, 0, 1):
        run(log, batch)
    rows = [r[0] for r in merge.ledger(spark, str(tmp_path)).select("txn_id").collect()]
    assert len(rows) == len(set(rows)) > 0
    assert merge.ledger(spark, str(tmp_path)).where("device_id = '3'").isEmpty()
    assert tables.committed(spark, str(tmp_path), "transfers").isEmpty()


def test_packs_hold_what_the_batches_held(spark, sf, tmp_path):
    log, root = bindings.sync_log(spark, sf), str(tmp_path)
    run = merge.merge_batch(root, pack_every=2)
    for batch in range(5):
        run(log.where(f"pmod(cast(TransactionId as int), 7) in ({batch}, {batch + 1})"), batch)  # half of it came before
    rows = sorted(r[0] for r in merge.ledger(spark, root).select("txn_id").collect())
    whole = sync.merged_ids(log.where(F.lit(False)).select(F.col("TransactionId").alias("txn_id")), log.where("pmod(cast(TransactionId as int), 7) < 6"))
    assert rows == sorted(r[0] for r in whole.collect()) and len(rows) > 0
    assert tables._last_pack(spark, root, "transactions") == 3
    assert tables.delete_packed(spark, root, "transactions") == 4 and tables.delete_packed(spark, root, "deleted_transactions") == 4
    assert tables.delete_packed(spark, root, "transactions") == 0
    # a pack that broke off has no manifest
    tables.committed(spark, root, "transactions").write.parquet(f"{root}/_packed/transactions/batch=4")
    run(log, 2)  # a batch run again, whose turn it isn't to pack
    assert sorted(r[0] for r in merge.ledger(spark, root).select("txn_id").collect()) == rows
    assert tables.pack(spark, root, "transactions", "txn_id") == 4 and tables.pack(spark, root, "transactions", "txn_id") is None
    assert sorted(r[0] for r in merge.ledger(spark, root).select("txn_id").collect()) == rows
    plan = tables.committed(spark, root, "transactions").where(F.col("txn_id").between("1", "2"))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(txn_id,1)" in plan and "LessThanOrEqual(txn_id,2)" in plan


def test_batches_without_new_rows_are_committed(spark, sf, tmp_path):
    log, root = bindings.sync_log(spark, sf), str(tmp_path)
    run = merge.merge_batch(root, pack_every=1)
    run(log.where(F.lit(False)), 0)
    run(log.where(F.col("Type") == sync.DELETED), 1)
    assert tables.committed(spark, root, "transactions").isEmpty()
    run(log, 2)
    whole = sync.merged_ids(log.where(F.lit(False)).select(F.col("TransactionId").alias("txn_id")), log)
    assert {r[0] for r in merge.ledger(spark, root).select("txn_id").collect()} == {r[0] for r in whole.collect()}


class Service:
    """Answers pulls as the real one would: items ingested after `since`, up to the watermark, a page at a time."""

    def __init__(self, n: int, now: int) -> None:
        self.items = [{"TransactionId": f"t{i}", "Timestamp": i, "at": i} for i in range(n)]
        self.now, self.calls = now, []

    def __call__(self, body: dict) -> dict:
        self.calls.append(body)
        until = body["watermark"] or self.now
        found = [x for x in self.items if body["since"] < x["at"] <= until]
        return {"items": found[body["skip"] : body["skip"] + body["top"]], "serverTimestamp": self.now}


def test_pages_are_pulled_to_the_end_and_the_cursor_moves():
    service = Service(25, 100)
    items, until = paged.pull(service, 0, page=10, lookback_ms=5)
    assert len(items) == 24 and until == 100 and [c["skip"] for c in service.calls] == [0, 10, 20]
    assert {c["watermark"] for c in service.calls[1:]} == {100}
    assert paged.pull(service, 500, page=10, lookback_ms=5) == ([], 500)  # an empty pull moves nothing
    assert len(paged.pull(service, 20, page=10, lookback_ms=5)[0]) == 9  # the lookback reads some again


def test_paged_reader_gives_the_same_rows_again():
    service = Service(25, 100)

    class Reader(paged.PagedReader):
        def fetch(self, body):
            return service(body)

    reader = Reader({"url": "http://localhost", "page": "7", "lookback_ms": "0"})
    rows, end = reader.read(reader.initialOffset())
    rows = list(rows)
    assert len(rows) == 24 and end == {"at": 100} and list(reader.readBetweenOffsets({"at": 0}, end)) == rows
    assert len(rows[0]) == len(paged.PagedPull({}).schema().split(", "))


def test_ranges_are_read_page_by_page_and_give_all_rows():
    service = Service(25, 100)

    class Reader(paged.RangeReader):
        def fetch(self, body):
            return service(body)

    reader = Reader({"url": "http://localhost", "page": "3", "lookback_ms": "0", "ranges": "5"})
    end = reader.latestOffset()
    assert end == {"at": 100} and [c["top"] for c in service.calls] == [1]
    parts = reader.partitions(reader.initialOffset(), end)
    assert len(parts) == 5 and [p.since for p in parts] == [0, 20, 40, 60, 80]
    service.calls.clear()
    first = reader.read(parts[0])
    next(first)
    assert len(service.calls) == 1  # a page at a time
    rows = [x for p in parts for x in reader.read(p)]
    assert sorted(r[0] for r in rows) == sorted(f"t{i}" for i in range(1, 25)) and reader.partitions(end, end) == []
    assert isinstance(paged.PagedPull({"url": "http://localhost"}).streamReader(None), paged.RangeReader)


def test_the_source_streams_from_a_service(spark, tmp_path):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    service = Service(25, 100)

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            answer = json.dumps(service(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(answer)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(paged.PagedPull)
    stream = spark.readStream.format("paged_pull").option("url", f"http://127.0.0.1:{server.server_port}").option("page", "3").load()
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination(60)
    server.shutdown()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 24
    got = paged.row({"TransactionId": "t", "SyncTimestamp": 1_700_000_000_000})
    assert got[-1] == paged.row({"SyncTimestamp": "2023-11-14T22:13:20Z"})[-1] and paged.row({})[-1] is None
    assert stream.withWatermark("SyncTimestamp", "10 minutes").isStreaming


class Counting:
    """A service of many rows at few times, that counts and says where pages end."""

    def __init__(self, times, now):
        self.rows = sorted((t, f"t{i:05d}") for i, t in enumerate(times))
        self.now, self.calls = now, []

    def __call__(self, body):
        self.calls.append(body)
        until = body["watermark"] or self.now
        found = [r for r in self.rows if body["since"] < r[0] <= until]
        if body.get("count"):
            return {"count": len(found)}
        found = [r for r in found if "after" not in body or list(r) > body["after"]][body["skip"] :][: body["top"]]
        items = [{"TransactionId": i, "Timestamp": t, "SyncTimestamp": t} for t, i in found]
        return {"items": items, "serverTimestamp": self.now} | ({"next": list(found[-1])} if found else {})


def test_ranges_hold_their_share():
    import random

    start, rng = 1_700_000_000_000, random.Random(1)
    service = Counting([start + int(rng.random() ** 3 * 10_000_000) for _ in range(5000)], start + 20_000_000)

    class Reader(paged.RangeReader):
        def fetch(self, body):
            return service(body)

    reader = Reader({"url": "x", "page": "100", "ranges": "16", "count": "true"})
    parts = reader.partitions({"at": 0}, reader.latestOffset())
    sizes = [len(list(reader.read(p))) for p in parts]
    assert sum(sizes) == 5000 and max(sizes) <= 2 * sum(sizes) / len(sizes) and len([c for c in service.calls if c.get("count")]) < 150
    pages = [c for c in service.calls if c["top"] == 100]
    assert any("after" in c for c in pages) and all(c["skip"] == 0 for c in pages)
    # rows that come in meanwhile shift no page
    first = reader.read(parts[0])
    got = [next(first)[0] for _ in range(100)]
    service.rows = sorted(service.rows + [(parts[0].since + 1, f"s{n}") for n in range(50)])
    got += [r[0] for r in first]
    assert len(got) == len(set(got)) == sizes[0]


def test_a_service_without_a_clock():
    class Reader(paged.RangeReader):
        def fetch(self, body):
            return {"items": []}

        def clock(self):
            return 5_000

    reader = Reader({"url": "x"})
    assert reader.latestOffset() == {"at": 5_000} and [paged.milliseconds(x) for x in ("2023-11-14T22:13:20Z", 7, "7", None, "never")] == [1_700_000_000_000, 7, 7, None, None]


def test_bounds_reach_the_service(spark):
    import json
    import threading
    from datetime import datetime, timezone
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    at = 1_700_000_000_000
    service = Counting([at + 1000 * n for n in range(400)], at + 10_000_000)

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            answer = json.dumps(service(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(answer)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(paged.PagedPull)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    time = lambda n: datetime.fromtimestamp((at + 1000 * n) / 1000, timezone.utc)
    load = lambda: spark.read.format("paged_pull").option("url", f"http://127.0.0.1:{server.server_port}").option("page", "20").option("count", "true").load()
    c = F.col("SyncTimestamp")
    cases = [((c > time(100)) & (c <= time(150)), 50), ((c >= time(100)) & (c < time(150)) & (F.col("TransactionId") != "t00120"), 49), (c == time(7), 1), (c > time(1000), 0)]
    for where, n in cases:
        service.calls.clear()
        assert load().where(where).count() == n
        asked = [x for x in service.calls if x["top"] == 20]
        assert all(x["since"] >= at + 6000 for x in asked) and sum(len(service(x)["items"]) for x in list(asked)) <= n + 3
    assert load().count() == 400
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    server.shutdown()
