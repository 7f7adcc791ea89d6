"""A sink that pushes transactions to a service, once for each micro-batch.

spark.dataSource.register(PushService); to_wire(rows).writeStream.format("push_service").option("url", ...).option("acks", ...)

Tasks post their rows in batches and wait for the service's count; a batch that fails or isn't confirmed whole is posted again
after a wait that grows, and in the end fails its task, so that the micro-batch isn't committed and a restart posts it again. The
service knows rows by their TransactionId. What a task has had confirmed it writes to a file of ids in the folder of
acknowledgements; its commit message, which is all that the driver gets, names the file. The commit of a micro-batch puts one
manifest in place that names its files: acknowledged() reads those, so ids of attempts that weren't committed don't count.

Options: url, acks (a folder that all executors share), size (rows in a post), tries, wait_s, device.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

from ..operators.sync import BATCH
from .paged import post

#: Fields that a row has only if they say something.
OPTIONAL = ("TargetTransactionId",)


class NotConfirmed(Exception):
    """The service hasn't confirmed a batch as a whole."""


@dataclass
class Pushed(WriterCommitMessage):
    """What a task has pushed."""

    sent: int
    posts: int
    file: str | None


def _folder(uri: str):
    """The file system of a folder, and its path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


class _Push:
    def __init__(self, options) -> None:
        self.url, self.acks = options["url"], options["acks"]
        self.size, self.tries, self.wait = int(options.get("size", BATCH)), int(options.get("tries", 4)), float(options.get("wait_s", 2.0))

    def post(self, body: dict) -> dict:
        return post(self.url, body)

    def write(self, iterator) -> Pushed:
        ids, part, posts = [], [], 0
        for row in iterator:
            part.append({k: v for k, v in row.asDict().items() if k not in OPTIONAL or v})
            if len(part) == self.size:
                posts += self.send(part)
                ids += [x["TransactionId"] for x in part]
                part = []
        if part:
            posts += self.send(part)
            ids += [x["TransactionId"] for x in part]
        return Pushed(len(ids), posts, self.keep(ids) if ids else None)

    def send(self, rows: list[dict]) -> int:
        problem = None
        for n in range(self.tries):
            try:
                answer = self.post({"data": {"transactions": rows}}) or {}
                if answer.get("processedCount") == len(rows):
                    return n + 1
                problem = f"confirmed {answer.get('processedCount')} of {len(rows)}"
            except Exception as e:  # whatever the service or the network says
                problem = str(e)
            if n + 1 < self.tries:
                time.sleep(self.wait * (n + 1))
        raise NotConfirmed(problem)

    def keep(self, ids: list[str]) -> str:
        import pyarrow as pa
        import pyarrow.parquet as pq

        files, path = _folder(self.acks)
        name = f"ids-{uuid.uuid4().hex}.parquet"
        files.create_dir(path)
        pq.write_table(pa.table({"txn_id": pa.array(ids, pa.string())}), f"{path}/{name}", filesystem=files)
        return name

    def conclude(self, messages, name: str) -> None:
        """Puts the manifest in place; a commit that is run again puts the same."""
        files, path = _folder(self.acks)
        said = [m for m in messages if m is not None]
        content = {"sent": sum(m.sent for m in said), "posts": sum(m.posts for m in said), "files": sorted(m.file for m in said if m.file)}
        files.create_dir(path)
        aside = f"{path}/.aside-{uuid.uuid4().hex}"
        with files.open_output_stream(aside) as out:
            out.write(json.dumps(content).encode())
        files.move(aside, f"{path}/{name}.json")


class PushStream(_Push, DataSourceStreamWriter):
    def commit(self, messages, batchId: int) -> None:  # noqa: N803
        self.conclude(messages, f"epoch-{batchId:012d}")

    def abort(self, messages, batchId: int) -> None:  # noqa: N803
        """Files of ids stay without a manifest, and so don't count."""


class PushBatch(_Push, DataSourceWriter):
    def commit(self, messages) -> None:
        self.conclude(messages, f"push-{time.time_ns():020d}")

    def abort(self, messages) -> None:
        """As of a stream."""


class PushService(DataSource):
    @classmethod
    def name(cls) -> str:
        return "push_service"

    def streamWriter(self, schema, overwrite: bool) -> PushStream:  # noqa: N802
        return PushStream(self.options)

    def writer(self, schema, overwrite: bool) -> PushBatch:
        return PushBatch(self.options)


def manifests(spark: SparkSession, acks: str) -> DataFrame:
    """name, sent, posts, files of each committed push."""
    rows = spark.read.schema("sent bigint, posts bigint, files array<string>").option("pathGlobFilter", "*.json").json(acks)
    return rows.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("name"), "sent", "posts", "files")


def acknowledged(spark: SparkSession, acks: str) -> DataFrame:
    """txn_id of all rows that the service has confirmed in committed pushes: those that marked_synced() is to mark."""
    named = manifests(spark, acks).select(F.explode("files").alias("file"))
    ids = spark.read.schema("txn_id string").option("pathGlobFilter", "ids-*.parquet").parquet(acks)
    return ids.select("txn_id", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file")).join(named, "file", "left_semi").select("txn_id")
