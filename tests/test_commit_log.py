"""The log of commits: broken off at each step, with writers side by side, read at any number."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import sync
from tallyweave.sources import bindings, commit_log, tables
from tallyweave.sources.commit_log import CommitLog, Conflict, StaleWriter
from tallyweave.streaming import merge


class Died(BaseException):
    """What a driver that is killed leaves no time to handle."""


def _rows(spark, *values):
    return spark.createDataFrame([(str(v), "1") for v in values], "key string, value string")


def _keys(log, table="meta", at=None):
    return sorted(r["key"] for r in log.read(table, log.state(at)).collect())


def _files(root):
    return [os.path.join(d, f) for d, _, names in os.walk(root) for f in names]


@pytest.mark.parametrize("step", ["first table", "second table", "aside", "entry", "after"])
def test_killed_at_each_step(spark, tmp_path, monkeypatch, step):
    root = f"file://{tmp_path}"
    log = CommitLog(spark, root)
    both = lambda *v: {"meta": _rows(spark, *v), "stores": spark.createDataFrame([(x, x, "s", True) for x in map(str, v)], "id string, name string, type string, active boolean")}
    assert log.commit(both(1), 0)

    def die(*_):
        raise Died

    with monkeypatch.context() as m:
        m.setattr(CommitLog, "_delete", lambda *_: None)  # the dead clean up nothing
        if step in ("first table", "second table"):
            write, left = CommitLog._write, [step == "second table"]
            m.setattr(CommitLog, "_write", lambda self, *a: write(self, *a) if left and left.pop() else die())
        elif step == "after":
            put = CommitLog._put
            m.setattr(CommitLog, "_put", lambda self, *a: put(self, *a) and die())
        elif step == "entry":
            m.setattr(CommitLog, "_put", die)
        else:
            os.makedirs(tmp_path / "_log", exist_ok=True)
            (tmp_path / "_log" / ".aside-x").write_text('{"ver')
            m.setattr(CommitLog, "_put", die)
        with pytest.raises(Died):
            log.commit(both(2), 1)
    done = step == "after"
    assert _keys(log) == (["1", "2"] if done else ["1"]) and log.read("stores").count() == (2 if done else 1)
    # run again, as a restarted stream does: nothing is lost, nothing comes twice
    assert log.commit(both(2), 1) != done and not log.commit(both(2), 1)
    assert _keys(log) == ["1", "2"] and log.read("stores").count() == 2
    assert log.clean(older_than_s=-60) == {"first table": 0, "second table": 1, "entry": 2, "aside": 3, "after": 0}[step]
    assert _keys(log) == ["1", "2"] and not [f for f in _files(tmp_path) if ".aside" in f]


def test_a_failure_changes_no_table(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}")
    broken = _rows(spark, 2).withColumn("value", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        log.commit({"stores": spark.createDataFrame([("a", "A", "s", True)], "id string, name string, type string, active boolean"), "meta": broken}, 0)
    assert log.read("stores").isEmpty() and log.read("meta").isEmpty() and log.state().version == -1
    assert not [f for f in _files(tmp_path) if f.endswith(".parquet")]
    assert log.commit({"meta": _rows(spark, 2)}, 0)


def test_two_writers_one_wins(spark, tmp_path):
    root, won, lost = f"file://{tmp_path}", [], []
    barrier = threading.Barrier(2)

    def write(name):
        log = CommitLog(spark, root)
        barrier.wait()
        for batch in range(3):
            (won if log.commit({"meta": _rows(spark, f"{batch}")}, batch) else lost).append((name, batch))

    threads = [threading.Thread(target=write, args=(n,)) for n in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    log = CommitLog(spark, root)
    assert sorted(b for _, b in won) == [0, 1, 2] and len(lost) == 3
    assert _keys(log) == ["0", "1", "2"] and log.state().batches == [[0, 2]]
    assert log._put("x.json", {"a": 1}) and not log._put("x.json", {"a": 2}) and log._load("_log/x.json") == {"a": 1}


def test_an_older_epoch_is_shut_out(spark, tmp_path, monkeypatch):
    log = CommitLog(spark, f"file://{tmp_path}")
    old = log.claim("w")
    assert log.commit({"meta": _rows(spark, 1)}, 0, "w", old)
    # the successor claims while the old one is writing
    write = CommitLog._write
    monkeypatch.setattr(CommitLog, "_write", lambda self, *a: (write(self, *a), monkeypatch.undo(), log.claim("w"))[0])
    with pytest.raises(StaleWriter):
        log.commit({"meta": _rows(spark, 2)}, 1, "w", old)
    new = log.state().epochs["w"]
    assert new == old + 1 and _keys(log) == ["1"]
    assert log.commit({"meta": _rows(spark, 2)}, 1, "w", new) and log.commit({"meta": _rows(spark, 3)}, 2, "other", 1)
    assert len([f for f in _files(tmp_path) if f.endswith(".parquet")]) >= 3 and _keys(log) == ["1", "2", "3"]


def test_states_are_written_whole_and_read_at_any_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commit_log, "CHECKPOINT", 4)
    log = CommitLog(spark, f"file://{tmp_path}")
    for n in range(10):
        assert log.commit({"meta": _rows(spark, n)}, 2 * n)
    names = log._names("_log")
    assert [n for n in names if n.startswith("state-")] == [f"state-{3:020d}.json", f"state-{7:020d}.json"]
    assert [len(_keys(log, at=n)) for n in (0, 3, 4, 9)] == [1, 4, 5, 10]
    loaded = []
    monkeypatch.setattr(CommitLog, "_load", lambda self, name, load=CommitLog._load: (loaded.append(name), load(self, name))[1])
    assert log.state().batches == [[2 * n, 2 * n] for n in range(10)] and len(loaded) == 3
    assert log.commit({"meta": _rows(spark, "x")}, 1) and log.state().batches[0] == [0, 2]


def test_packs(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}")
    for n in range(6):
        log.commit({"meta": _rows(spark, n, n + 10)}, n)
        if n % 2:
            assert log.pack("meta", "key") == n
    before = log.state()
    assert sum(x.get("pack", False) for x in before.live["meta"].values()) == 3
    log.commit({"meta": _rows(spark, 6)}, 6)
    stale = log.state()
    assert log.pack("meta", "key") == 6 and len(log.state().live["meta"]) == 1  # more packs than batches: all in one
    assert sorted(_keys(log)) == sorted([str(x) for n in range(6) for x in (n, n + 10)] + ["6"])
    assert sorted(_keys(log, at=before.version)) == sorted(str(x) for n in range(6) for x in (n, n + 10))
    state, CommitLog.state = CommitLog.state, lambda self, at=None, states=[stale]: states.pop() if states else state(self, at)
    try:
        with pytest.raises(Conflict):
            log.pack("meta", "key")
    finally:
        CommitLog.state = state
    assert log.delete_packed("meta") == 10 and log.delete_packed("meta") == 0 and len(_keys(log)) == 13


def test_a_dead_stream_cannot_write_behind_its_successor(spark, sf, tmp_path):
    log, root = bindings.sync_log(spark, sf).where("cast(TransactionId as int) < 60"), f"file://{tmp_path}"
    epoch = CommitLog(spark, root).claim(merge.WRITER)
    merge.merge_batch(root, epoch=epoch)(log.where("cast(TransactionId as int) < 30"), 0)
    CommitLog(spark, root).claim(merge.WRITER)
    with pytest.raises(StaleWriter):
        merge.merge_batch(root, epoch=epoch)(log, 1)
    merge.merge_batch(root, epoch=epoch + 1)(log, 1)
    got = {r[0] for r in merge.ledger(spark, root).select("txn_id").collect()}
    assert got == {r[0] for r in sync.merged_ids(log.where("false").select(F.col("TransactionId").alias("txn_id")), log).collect()}
    # both tables at the number of the first batch
    first = {r[0] for r in merge.ledger(spark, root, at=1).select("txn_id").collect()}
    early = log.where("cast(TransactionId as int) < 30")
    assert first == {r[0] for r in sync.merged_ids(early.where("false").select(F.col("TransactionId").alias("txn_id")), early).collect()}
    assert tables._last_pack(spark, root, "transactions") == -1


def test_a_packed_ledger_in_buckets_is_not_shuffled_again(spark, tmp_path, sf):
    """A table of no schema of ours is packed into buckets that follow its rows; what is removed from it is brought to them."""
    log, rows = CommitLog(spark, f"file://{tmp_path}"), bindings.ledger(spark, sf).select("txn_id", "qty", "transfer_id")
    for n in range(2):
        log.commit({"packed_ledger": rows.where(F.col("transfer_id") % 2 == n)}, n)
    total = rows.count()
    log.pack("packed_ledger", "txn_id", bucket_rows=total // 9)
    state = log.state()
    (folder,) = state.live["packed_ledger"].values()
    assert folder["pack"] and folder["buckets"] == ["txn_id", 10]
    gone = rows.where("transfer_id % 17 = 0").select("txn_id").repartition(3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = log.read_bucketed("packed_ledger", state).join(gone, "txn_id", "left_anti")
        plan = kept._jdf.queryExecution().executedPlan().toString()
        got = sorted(tuple(r) for r in kept.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # the ledger's side goes from the scan to the join without an exchange
    assert "Bucketed: true" in plan and "Exchange" not in plan[: plan.index("FileScan parquet")], plan
    assert got == sorted(tuple(r) for r in rows.join(gone, "txn_id", "left_anti").collect()) and 0 < len(got) < total
    # a second pack, of the same layout, goes with the first
    log.commit({"packed_ledger": rows.limit(0)}, 2)
    log.pack("packed_ledger", "txn_id", bucket_rows=total // 9)
    assert log.read_bucketed("packed_ledger").count() == total
