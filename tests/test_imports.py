"""Loose JSON, retention by month, buckets of the ledger, and what is observed on the side."""

import os
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from tallyweave.operators import sync, transfers
from tallyweave.schemas import SCHEMAS
from tallyweave.sources import bindings, loose_json, retention, tables
from tallyweave.sources.commit_log import CommitLog
from tallyweave.streaming import merge
from tallyweave.streaming.queries import QUERIES


def test_loose_json(spark):
    texts = ['{"a": 1, "b": "x"}', '{"a": "12 boxes"}', '{"a": "none", "b": null}', '{"a": {"c": 1}}', '{"b": 7}', "[1]", '"x"', "{", None, "null", '{"a": 3, "b": "y", "c": [1]}']
    df = loose_json.parsed(spark.createDataFrame(list(enumerate(texts)), "i int, value string"))
    got = {r["i"]: (r["a"], r["b"], r["problem"]) for r in loose_json.typed(df, "a bigint, b string", loose=("a",)).collect()}
    assert {i: got[i] for i in (0, 1, 2, 4, 10)} == {0: (1, "x", None), 1: (12, None, None), 2: (0, None, None), 4: (None, "7", None), 10: (3, "y", None)}
    assert [got[i][2] for i in (3, 5, 6, 7, 8, 9)] == ["a is not bigint", "not an object", "not an object", "not JSON", "not JSON", "not an object"]
    assert loose_json.typed(df, "a bigint").where("i = 1").first()["problem"] == "a is not bigint"
    assert {r["problem"]: r["n"] for r in loose_json.problems(loose_json.typed(df, "a bigint", loose=("a",))).collect()}["not an object"] == 3
    assert loose_json.shape(spark.createDataFrame([('{"k": 1}',), ('{"k": 2, "m": "x"}',)], "value string")).first()["shape"] == "OBJECT<k: BIGINT, m: STRING>"


def test_broken_files_lose_no_good_row(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"transactions": [{"id": "t1", "type": "in", "qty": "3x"},\n {"id": "t2", "qty": 4, "date": "never"}, 7, {"id": "t3", "qty": 5, "date": "2024-01-02"}], "meta": []}')
    (tmp_path / "b.json").write_text('{"transactions": [{"id": "t4"')
    (tmp_path / "c.json").write_text('{"meta": []}')
    rows, rejects = loose_json.import_table(spark, f"file://{tmp_path}", "transactions", names={"txn_id": "id"})
    assert sorted((r["txn_id"], r["qty"], str(r["date"])) for r in rows.collect()) == [("t1", 3, "None"), ("t3", 5, "2024-01-02")] and rows.columns == [c.split()[0] for c in SCHEMAS["transactions"].split(", ")]
    assert sorted((os.path.basename(r["file"]), r["problem"]) for r in rejects.collect()) == [("a.json", "date is not date"), ("a.json", "not an object"), ("b.json", "not JSON"), ("c.json", "no array of rows")]


def test_pruning_rewrites_only_months_that_hold_expired_rows(spark, tmp_path):
    path, at = f"file://{tmp_path}/t", lambda y, m, d: datetime(y, m, d)
    rows = [(1, "completed", at(2023, 1, 1), at(2023, 1, 5)), (2, "cancelled", at(2023, 1, 1), at(2023, 1, 9)), (3, "completed", at(2023, 3, 1), at(2023, 3, 2)), (4, "draft", at(2023, 3, 1), None), (5, "draft", at(2023, 5, 1), None),
            (6, "completed", at(2023, 6, 1), at(2023, 6, 20)), (7, "completed", at(2023, 6, 1), at(2023, 6, 2)), (8, "completed", at(2023, 9, 1), None), (9, "completed", None, None), (10, "received", None, None)]
    df = spark.createDataFrame(rows, "id long, status string, date timestamp, completed_date timestamp")
    retention.write(df, path)
    files = lambda: {(os.path.join(d, f), os.stat(os.path.join(d, f)).st_mtime_ns) for d, _, names in os.walk(tmp_path / "t") for f in names if f.startswith("part-")}
    before, as_of = files(), F.lit(at(2023, 7, 10))
    want = sorted(r["id"] for r in transfers.pruned(df, as_of).collect())
    assert retention.prune(spark, path, as_of) == (3, 1)  # March, June and what has no time are written anew, January goes
    assert sorted(r["id"] for r in retention.read(spark, path).collect()) == want == [4, 5, 6, 8, 10]
    after = files()
    assert {os.path.basename(os.path.dirname(f)) for f, _ in before & after} == {"month=202305", "month=202309"} and not (tmp_path / "t" / "month=202301").exists()
    assert retention.prune(spark, path, as_of) == (0, 0) and files() == after


def test_the_ledger_is_not_shuffled_to_find_what_it_has(spark, sf, tmp_path):
    log, root = bindings.sync_log(spark, sf), f"file://{tmp_path}"
    run = merge.merge_batch(root, pack_every=3, buckets=4)
    plain = merge.merge_batch(root + "-plain", pack_every=3)
    for batch in range(4):
        for r in (run, plain):
            r(log.where(f"pmod(cast(TransactionId as int), 5) in ({batch}, {batch + 1})"), batch)
    ids = lambda r: sorted(x[0] for x in merge.ledger(spark, r).select("txn_id").collect())
    assert ids(root) == ids(root + "-plain") and len(ids(root)) > 0
    store = CommitLog(spark, root)
    assert len(store.state().live["transactions"]) == 2 and store.read_bucketed("transactions").count() == store.read("transactions").count()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = merge.unknown(store, sync.from_wire(sync.live(log)), "0", "zz")._jdf.queryExecution().executedPlan().toString()
        known = plan[plan.index("SortMergeJoin") :].split("\n   +- ", 1)[1]  # the second of the join's sides
        assert "Bucketed: true" in known and "SelectedBucketsCount: 4 out of 4" in known and "Exchange" not in known
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # so that the plan shows what a scan prunes
        one = store.read_bucketed("transactions").where("txn_id = '7'")._jdf.queryExecution().executedPlan().toString()
        assert "SelectedBucketsCount: 1 out of 4" in one
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_counts_come_on_the_side(spark, sf, tmp_path):
    seen = merge.Progress()
    spark.streams.addListener(seen)
    try:
        log, root = bindings.sync_log(spark, sf), f"file://{tmp_path}/store"
        log.repartition(2).write.parquet(f"file://{tmp_path}/log")
        stream = merge.read_log(spark, f"file://{tmp_path}/log", log.schema, per_trigger=1)
        merge.start(stream, root, f"file://{tmp_path}/c").awaitTermination(120)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    finally:
        spark.streams.removeListener(seen)
    notes = [r["note"] for r in CommitLog(spark, root).history().where("note is not null").collect()]
    assert len(notes) == 2 and sum(n["live"] for n in notes) == sum(n["added"] for n in notes) == log.where("Type <> 'deleted'").count()
    assert sum(n["marks"] for n in notes) == log.where("Type = 'deleted'").count() and all(n["overlap"] == 0 for n in notes)
    assert sum(seen.pulled.values()) == log.count() and len(seen.pulled) == 2
    last = log.agg(F.max("SyncTimestamp")).first()[0]
    assert seen.lag(last + timedelta(hours=1)) == timedelta(hours=1) and merge.Progress().lag(datetime.now(timezone.utc)) is None


def test_footers_tell_broken_stores(spark, tmp_path):
    good = spark.createDataFrame([("k", "1")], SCHEMAS["meta"])
    tables.overwrite(good, f"file://{tmp_path}", "meta")
    (tmp_path / "b.json").write_text('{"meta": [{"key": "k", "value": "2"}]}')
    assert tables.read_or_backup(spark, f"file://{tmp_path}", "meta", f"file://{tmp_path}/b.json").first()["value"] == "1"
    assert set(QUERIES) >= {"retention_prune", "stream_metrics"}


def test_a_bucketed_merge_of_nothing_new_is_counted(spark, sf, tmp_path):
    log, root = bindings.sync_log(spark, sf), f"file://{tmp_path}"
    for batch in range(2):
        merge.merge_batch(root, buckets=3)(log, batch)
    notes = {r["batch"]: r["note"] for r in CommitLog(spark, root).history().collect()}
    live, marks = (log.where(f"Type {sign} 'deleted'").count() for sign in ("<>", "="))
    assert notes == {0: {"live": live, "added": live, "overlap": 0, "marks": marks}, 1: {"live": live, "added": 0, "overlap": live, "marks": marks}}
