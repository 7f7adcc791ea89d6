"""Versioned transfers, views of the store, and the session's configuration."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tallyweave.schemas import WIRE
from tallyweave.sources import tables, transfer_store
from tallyweave.sources.commit_log import CommitLog
from tallyweave.streaming import config, merge

ENTRY = "transfer_id string, product_id string, store_id string, type string, qty long"


def _transfers(spark, *rows):
    return spark.createDataFrame(rows, "id string, status string").select("id", "status", F.lit(None).cast("bigint").alias("version"))


def test_a_step_that_fails_leaves_the_version_before(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}")
    save = lambda step, rows, entries=None: transfer_store.save(log, step, rows, entries, "heads", "entries")
    assert save(0, _transfers(spark, ("a", "in_transit"), ("b", "draft")))
    entry = spark.createDataFrame([("a", "p", "s", "transfer_in", 3)], ENTRY)
    with pytest.raises(Exception, match="no stock"):
        save(1, _transfers(spark, ("a", "completed")), entry.withColumn("qty", F.raise_error(F.lit("no stock")).cast("long")))
    now = lambda state=None: {r["id"]: (r["status"], r["version"]) for r in transfer_store.current(log, state, "heads").collect()}
    assert now() == {"a": ("in_transit", 0), "b": ("draft", 0)} and "entries" not in log.state().live
    before = log.state()
    assert save(1, _transfers(spark, ("a", "completed")), entry) and not save(1, _transfers(spark, ("a", "cancelled")), entry)
    assert now() == {"a": ("completed", 1), "b": ("draft", 0)} and log.read("entries").count() == 1 and now(before)["a"] == ("in_transit", 0)
    assert transfer_store.versions(log, transfers="heads").count() == 3


def test_tasks_follow_the_versions(spark, tmp_path, monkeypatch):
    """What a task sorts of stored versions doesn't grow with them, the last ones stay the same, and only what is asked for is moved."""
    log = CommitLog(spark, f"file://{tmp_path}")
    for step, every in enumerate((1, 2, 3)):
        ids = spark.range(0, 600, every).selectExpr("id", f"'s{step}' status", "array(id) items", "null version")
        assert transfer_store.save(log, step, ids, None, "many")
    want = sorted(map(str, transfer_store.current(log, transfers="many").collect()))
    monkeypatch.setattr(transfer_store, "VERSIONS_A_TASK", 100, raising=False)
    rows = transfer_store.current(log, transfers="many")
    assert rows.rdd.getNumPartitions() == 12 and sorted(map(str, rows.collect())) == want and len(want) == 600
    few = transfer_store.current(log, transfers="many", columns=("id", "status"))
    assert few.columns == ["id", "status"] and "items" not in few._jdf.queryExecution().executedPlan().toString()
    assert {r["id"]: r["status"] for r in few.collect()} == {i: "s2" if i % 3 == 0 else "s1" if i % 2 == 0 else "s0" for i in range(600)}


def test_views_show_one_number(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}")
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id int")
    log.commit({"tv_a": rows(1, 2), "tv_b": rows(1)}, 0)
    state = tables.as_views(spark, log.root, ["tv_a", "tv_b"], cached=True)
    assert spark.sql("SELECT count(*) FROM tv_a JOIN tv_b USING (id)").first()[0] == 1 and spark.catalog.isCached("tv_a")
    log.commit({"tv_b": rows(2)}, 1)
    assert spark.sql("SELECT count(*) FROM tv_b").first()[0] == 1
    later = tables.as_views(spark, log.root, ["tv_a", "tv_b"])
    assert later.version == state.version + 1 and spark.sql("SELECT count(*) FROM tv_b").first()[0] == 2 and not spark.catalog.isCached("tv_a")


def test_configuration(spark):
    config.clear(spark)
    urls = {"pushUrl": "http://a", "pullUrl": "http://b"}
    item = lambda data, kind="sync_config": {"ConfigType": kind, "ConfigData": data}
    assert config.load(spark) == {}
    for answer in ({}, {"items": None}, {"items": []}, {"items": [item(json.dumps({"pushUrl": "x"}))]}, {"items": [item("{broken")]}, {"items": [item(urls, "other"), None]}):
        assert config.load(spark, fetch=lambda _, a=answer: a) == {}
    assert config.load(spark, fetch=lambda _: {"items": [item(1, "other"), item(json.dumps(urls)), item({"pushUrl": "later", "pullUrl": "later"})]}) == urls

    def down(_):
        raise OSError("down")

    assert config.load(spark, fetch=down) == urls and config.load(spark, url="http://127.0.0.1:9/none") == urls and config.load(spark) == urls  # kept in the session
    assert config.load(spark.newSession()) == {}
    assert config.fetched(spark, {"items": [item(urls)]}) == urls
    config.clear(spark)
    assert config.load(spark) == {}


def test_late_rows_are_counted(spark, tmp_path):
    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    row = lambda i, minutes: (f"t{i}", "2024-01-01", "s", "p", "in", "1", "", "", "d", 0, "", None, at + timedelta(minutes=minutes))
    schema = spark.createDataFrame([], WIRE).schema
    seen = merge.Progress()
    spark.streams.addListener(seen)
    try:
        for n, rows in enumerate(([row(0, 0), row(1, 100)], [row(2, 5), row(3, 95)], [row(4, 1)])):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/log")
            sums = merge.on_hand(merge.without_replays(merge.read_log(spark, f"file://{tmp_path}/log", schema)))
            sums.writeStream.outputMode("update").format("noop").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(120)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    finally:
        spark.streams.removeListener(seen)
    assert sum(seen.late.values()) == 2
