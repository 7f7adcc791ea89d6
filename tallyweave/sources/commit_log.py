"""A log of commits, so that several tables change together, once, and one of several writers wins.

A store is a folder. The rows of a commit are written first, each attempt in folders of its own, which nobody reads. The commit
then counts by a single act: its entry, which names those folders, is put in the log under the next number, if there is none of
that number yet. Entries are written aside and put in place without overwriting, so that one is whole or absent, and of two
writers who reach for a number one gets it; the other reads what it has missed and tries the next, or gives up where that rules
its commit out. What a driver that died has left behind is in no entry: nothing reads it, and clean() deletes it.

A writer may claim an epoch. From then on commits of older epochs are refused, whatever they have written already: a driver that
was thought dead can't write behind its successor.

All tables are read at one number, that of the last entry or any before it. Every CHECKPOINT entries the state is written as a
whole, and readers begin from there.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from ..schemas import SCHEMAS

#: Entries after which the state is written as a whole.
CHECKPOINT = 32
_LOG, _DATA = "_log", "_data"


class StaleWriter(Exception):
    """A later epoch has been claimed."""


class Conflict(Exception):
    """What a commit replaces has been replaced meanwhile."""


@dataclass
class State:
    """What entries up to a number amount to."""

    version: int = -1
    epochs: dict[str, int] = field(default_factory=dict)
    #: Numbers of batches that are committed, as ranges: [first, last], ascending.
    batches: list[list[int]] = field(default_factory=list)
    #: By table, then folder: the batch that it holds, or of a pack the last.
    live: dict[str, dict[str, dict]] = field(default_factory=dict)
    #: Folders that packs have taken the place of and that still stand.
    packed: dict[str, list[str]] = field(default_factory=dict)

    def has(self, batch: int) -> bool:
        return any(a <= batch <= b for a, b in self.batches)

    def _add_batch(self, batch: int) -> None:
        ranges = sorted([*self.batches, [batch, batch]])
        self.batches = ranges[:1]
        for a, b in ranges[1:]:
            if a <= self.batches[-1][1] + 1:
                self.batches[-1][1] = max(b, self.batches[-1][1])
            else:
                self.batches.append([a, b])

    def apply(self, entry: dict) -> None:
        self.version = entry["version"]
        if entry.get("epoch") is not None:
            self.epochs[entry["writer"]] = max(entry["epoch"], self.epochs.get(entry["writer"], 0))
        if entry.get("batch") is not None:
            self._add_batch(entry["batch"])
        for table, folders in entry.get("drop", {}).items():
            for f in folders:
                self.live.get(table, {}).pop(f, None)
            self.packed.setdefault(table, []).extend(folders)
        for table, folders in entry.get("gone", {}).items():
            self.packed[table] = [f for f in self.packed.get(table, []) if f not in set(folders)]
        for table, folders in entry.get("add", {}).items():
            self.live.setdefault(table, {}).update(folders)

    def last_pack(self, table: str) -> int:
        return max((x["batch"] for x in self.live.get(table, {}).values() if x.get("pack")), default=-1)


class CommitLog:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    # --- files ---

    def _path(self, relative: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{relative}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, relative: str) -> list[str]:
        path, fs = self._path(relative)
        try:
            return sorted(x.getPath().getName() for x in fs.listStatus(path))
        except Py4JJavaError as e:
            if "FileNotFoundException" in str(e.java_exception):
                return []
            raise

    def _load(self, relative: str) -> dict:
        path, fs = self._path(relative)
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, name: str, content: dict) -> bool:
        """Puts a file of the log in place, whole; False, and nothing changed, where there is one of that name."""
        jvm, aside = self.spark._jvm, f"{_LOG}/.aside-{uuid.uuid4().hex}"
        source, fs = self._path(aside)
        target, _ = self._path(f"{_LOG}/{name}")
        out = fs.create(source, True)
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        out.close()
        try:
            if fs.getScheme() == "file":  # a rename on a local disk overwrites; a link doesn't
                link = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
                jvm.java.nio.file.Files.createLink(link(target), link(source))
            else:
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
                context.rename(source, target, none)
            return True
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        finally:
            fs.delete(source, False)

    # --- reading ---

    def state(self, at: int | None = None) -> State:
        """The state at a number, or the last. The driver holds names of folders, never rows."""
        names = [n for n in self._names(_LOG) if n.endswith(".json") and not n.startswith(".")]
        whole = [n for n in names if n.startswith("state-") and (at is None or int(n[6:-5]) <= at)]
        state = State(**self._load(f"{_LOG}/{whole[-1]}")) if whole else State()
        for n in names:
            if n[0].isdigit() and state.version < int(n[:-5]) and (at is None or int(n[:-5]) <= at):
                state.apply(self._load(f"{_LOG}/{n}"))
        return state

    def read(self, table: str, state: State | None = None, batch: int | None = None) -> DataFrame:
        """A table's rows at a state; of one batch alone, if asked for."""
        folders = (state or self.state()).live.get(table, {})
        paths = [f"{self.root}/{f}" for f, x in folders.items() if batch is None or x["batch"] == batch]
        if not paths:
            return self.spark.createDataFrame([], SCHEMAS[table])
        reader = self.spark.read.schema(SCHEMAS[table]) if table in SCHEMAS else self.spark.read
        return reader.parquet(*paths)

    def read_bucketed(self, table: str, state: State | None = None) -> DataFrame:
        """As read(), with the buckets that all folders of the table are laid out in known to Spark.

        A join on the key then moves only the other side, and a row is looked for in its bucket alone. Plain rows where folders
        have other layouts or none. The session knows the table by a name of its own until the next state is read. A table without
        a schema of ours has that of its files.
        """
        state = state or self.state()
        folders = state.live.get(table, {})
        laid_out = {tuple(x.get("buckets", ())) for x in folders.values()}
        if len(laid_out) != 1 or () in laid_out:
            return self.read(table, state)
        (key, n), stem = laid_out.pop(), f"tallyweave_{hashlib.sha256(self.root.encode()).hexdigest()[:12]}_{table}"
        name = f"{stem}_{state.version}"
        if not self.spark.catalog.tableExists(name):
            for t in self.spark.catalog.listTables(pattern=f"{stem}_*"):
                self.spark.sql(f"DROP TABLE IF EXISTS {t.name}")
            columns = SCHEMAS.get(table) or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.read(table, state).schema)
            self.spark.sql(f"CREATE TABLE {name} ({columns}, _folder INT) USING parquet PARTITIONED BY (_folder) CLUSTERED BY ({key}) SORTED BY ({key}) INTO {n} BUCKETS LOCATION '{self.root}/{_DATA}/{table}'")
            parts = " ".join(f"PARTITION (_folder={i}) LOCATION '{self.root}/{f}'" for i, f in enumerate(folders))
            self.spark.sql(f"ALTER TABLE {name} ADD {parts}")
        return self.spark.table(name).drop("_folder")

    def history(self) -> DataFrame:
        """version, batch, time, note (map) of the entries that are in the log."""
        schema = "version bigint, batch bigint, time double, note map<string, bigint>"
        if not any(n[0].isdigit() for n in self._names(_LOG)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("pathGlobFilter", "[0-9]*.json").json(f"{self.root}/{_LOG}")

    # --- writing ---

    def claim(self, writer: str) -> int:
        """A new epoch of this writer: commits of older ones are refused from now on."""
        while True:
            state = self.state()
            epoch = state.epochs.get(writer, 0) + 1
            if self._append(state, {"writer": writer, "epoch": epoch}):
                return epoch

    def _append(self, state: State, entry: dict) -> bool:
        """Puts entry in the log after state; False if there is a later entry by now."""
        number = state.version + 1
        if not self._put(f"{number:020d}.json", entry | {"version": number, "time": time.time()}):
            return False
        if (number + 1) % CHECKPOINT == 0:
            state.apply(entry | {"version": number})
            self._put(f"state-{number:020d}.json", vars(state))
        return True

    def commit(self, tables: Mapping[str, DataFrame], batch: int | None = None, writer: str | None = None, epoch: int | None = None, buckets: Mapping[str, tuple[str, int]] | None = None, note: Callable[[dict[str, int]], dict] | None = None) -> bool:
        """Appends rows to several tables at once. False, and nothing done, if the batch is committed already.

        If anything fails, no table has changed and what was written is deleted. StaleWriter if a later epoch has been claimed.
        buckets: of tables whose rows are laid out in so many buckets of a key, for read_bucketed(). note: gives what history()
        shows of the commit, from how many rows of each table were written (footers tell).
        """
        written: dict[str, dict] = {}
        told: dict = {}
        try:
            while True:
                state = self.state()
                self._allow(state, writer, epoch)
                if batch is not None and state.has(batch):
                    self._delete(f for x in written.values() for f in x)
                    return False
                if not written:
                    for table, df in tables.items():
                        written[table] = self._write(df, table, {"batch": state.version + 1 if batch is None else batch}, (buckets or {}).get(table))
                    told = {"note": note({t: self.read(t, State(live={t: x})).count() for t, x in written.items()})} if note else {}
                    continue  # writing takes long: look again before the entry
                if self._append(state, {"add": written} | ({} if batch is None else {"batch": batch}) | ({} if writer is None else {"by": [writer, epoch]}) | told):
                    return True
        except BaseException:
            self._delete(f for x in written.values() for f in x)
            raise

    def pack(self, table: str, key: str, sums: list[str] | None = None, bucket_rows: int | None = None) -> int | None:
        """Writes a table's batches since the last pack as one, in order of key; its number, or None where there are none.

        Files have narrow ranges of keys, so a filter on the key skips most of them. Once there are as many packs as batches went
        into one, they are packed together, so the folders of a table stay few. sums: columns to add up for each of the others.
        bucket_rows: lays what isn't in buckets yet out in buckets of the key, about so many rows in each, for read_bucketed().
        What is packed stays for readers of older numbers until delete_packed().
        """
        state = self.state()
        live = state.live.get(table, {})
        chosen = {f: x for f, x in live.items() if not x.get("pack")}
        if not chosen:
            return None
        packs = {f: x for f, x in live.items() if x.get("pack")}
        if len(packs) > len(chosen):
            chosen |= packs
        last = max(x["batch"] for x in chosen.values())
        rows = self.read(table, State(live={table: chosen}))
        if sums:
            rows = rows.groupBy(*(c for c in rows.columns if c not in sums)).agg({c: "sum" for c in sums}).toDF(*(c for c in rows.columns if c not in sums), *sums).select(*rows.columns)
        laid_out = {tuple(x["buckets"]) if "buckets" in x else None for x in chosen.values()}
        bucket = laid_out.pop() if len(laid_out) == 1 else None
        if bucket is None and bucket_rows:
            bucket = key, max(rows.count() // bucket_rows + 1, self.spark.sparkContext.defaultParallelism)
        added = self._write(rows if bucket else rows.repartitionByRange(key).sortWithinPartitions(key), table, {"batch": last, "pack": True}, bucket)
        while not self._append(state, {"add": {table: added}, "drop": {table: sorted(chosen)}}):
            state = self.state()
            if not chosen.keys() <= state.live.get(table, {}).keys():  # someone else has packed them
                self._delete(added)
                raise Conflict(f"{table} has been packed meanwhile")
        return last

    def delete_packed(self, table: str) -> int:
        """Deletes the folders of a table that packs have taken the place of, for when nobody reads an older number; how many there were."""
        state = self.state()
        old = state.packed.get(table, [])
        if old:
            self._delete(old)
            while not self._append(state, {"gone": {table: old}}):
                state = self.state()
        return len(old)

    def clean(self, older_than_s: float = 86_400) -> int:
        """Deletes what was written that long ago and is in no entry: leavings of drivers that died; how many folders or files."""
        state, gone = self.state(), 0
        known = {f for x in state.live.values() for f in x} | {f for x in state.packed.values() for f in x}
        before = (time.time() - older_than_s) * 1000
        for relative in [f"{_DATA}/{t}/{n}" for t in self._names(_DATA) for n in self._names(f"{_DATA}/{t}")] + [f"{_LOG}/{n}" for n in self._names(_LOG) if n.startswith(".aside-")]:
            path, fs = self._path(relative)
            if relative not in known and fs.getFileStatus(path).getModificationTime() < before:
                gone += fs.delete(path, True)
        return gone

    def _allow(self, state: State, writer: str | None, epoch: int | None) -> None:
        if writer is not None and epoch is not None and state.epochs.get(writer, 0) > epoch:
            raise StaleWriter(f"{writer} has epoch {state.epochs[writer]}, this is {epoch}")

    def _write(self, df: DataFrame, table: str, about: dict, bucket: tuple[str, int] | None = None) -> dict[str, dict]:
        folder = f"{_DATA}/{table}/{uuid.uuid4().hex}"
        try:
            if bucket is None:
                df.write.parquet(f"{self.root}/{folder}")
            else:
                key, n = bucket
                name = f"tallyweave_{uuid.uuid4().hex}"  # only saved tables are written in buckets; the files stay when it goes
                try:
                    df.repartition(n, key).write.format("parquet").bucketBy(n, key).sortBy(key).option("path", f"{self.root}/{folder}").saveAsTable(name)
                finally:
                    self.spark.sql(f"DROP TABLE IF EXISTS {name}")
                about = about | {"buckets": [key, n]}
        except BaseException:
            self._delete([folder])
            raise
        return {folder: about}

    def _delete(self, folders) -> None:
        for f in folders:
            path, fs = self._path(f)
            fs.delete(path, True)
