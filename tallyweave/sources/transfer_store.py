"""Transfers as versions: a step appends a new version of what it changes, together with the ledger entries that it makes, or neither."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .commit_log import CommitLog, State
from .tables import latest

TRANSFERS, ENTRIES = "transfers", "transactions"
#: Versions that a task sorts, with their items, so that what it holds doesn't grow with the table.
VERSIONS_A_TASK = 60_000


def save(log: CommitLog, step: int, changed: DataFrame, entries: DataFrame | None = None, transfers: str = TRANSFERS, ledger: str = ENTRIES) -> bool:
    """Commits changed transfers as versions of number `step`, with the entries of the step. False if that step is committed already.

    If either can't be written, neither is there, and current() is what it was before the step.
    """
    rows = {transfers: changed.drop("version").withColumn("version", F.lit(step).cast("bigint"))}
    return log.commit(rows if entries is None else rows | {ledger: entries}, step)


def versions(log: CommitLog, state: State | None = None, transfers: str = TRANSFERS) -> DataFrame:
    """All versions of all transfers."""
    return log.read(transfers, state)


def current(log: CommitLog, state: State | None = None, transfers: str = TRANSFERS, columns: tuple[str, ...] | None = None) -> DataFrame:
    """The last version of each transfer at a state, or the last; of `columns` alone, if given, so that nothing else is moved.

    Versions are dealt by id to tasks of some VERSIONS_A_TASK each, where each is sorted once; of one id they stand in different
    folders, so partial maxima would save next to nothing.
    """
    rows = versions(log, state, transfers)
    tasks = rows.count() // VERSIONS_A_TASK + 1
    if columns is not None:
        rows = rows.select(*dict.fromkeys(("id", "version", *columns)))
    if tasks > log.spark.sparkContext.defaultParallelism:
        rows = rows.repartition(tasks, "id")
    out = latest(rows, ["id"], ["version"])
    return out if columns is None else out.select(*columns)
