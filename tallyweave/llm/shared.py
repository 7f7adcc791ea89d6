"""Shared storage, connected components and word hashing for the training-data operators."""

from __future__ import annotations

import atexit
import math
import re
import tempfile
import uuid
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not root:
        root = getattr(spark, "_tallyweave_dir", None) or "file://" + tempfile.mkdtemp(prefix="tallyweave-")
        spark._tallyweave_dir = root
    path = f"{root.rstrip('/')}/tallyweave-{spark.sparkContext.applicationId}"
    if not getattr(spark, "_tallyweave_cleanup", False):
        spark._tallyweave_cleanup = True
        atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: the lineage ends there, and a lost executor takes nothing with it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of rows that a Python worker gets at a time, or one larger row.
BATCH_BYTES = 4 << 20


def mapped(df: DataFrame, work, schema) -> DataFrame:
    """df.mapInPandas(work, schema) with batches of bounded bytes, which the session keeps to from then on."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInPandas(work, schema)


def mapped_rows(df: DataFrame, work, schema) -> DataFrame:
    """As mapped(), by Arrow batches: columns that work passes on stay as they are. pandas would make whole numbers with nulls floats."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(work, schema)


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.expr("coalesce(bit_xor(xxhash64(u, v)), 0)")).first()
    return row[0], row[1]


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of the undirected edges (u, v), both long: rows (id, component), component being its smallest id.

    Alternating large-star and small-star steps. Each step takes the smallest neighbour by an aggregation with partial sums
    on the map side and joins it back, so that no node's neighbours ever meet in one task. Nulls and loops are ignored.
    """
    spark = edges.sparkSession
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # every edge now runs from a node to a smaller one; the small star hangs all smaller neighbours on the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("a")), F.struct(F.col("u").alias("a")))).alias("x"), "m")
        edges = written(small.select(F.col("x.a").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()) if before[0] else spark.createDataFrame([], "id long, component long")


# --- word and shingle hashes, whole batches at a time ---------------------------------------------------------------

_BASE = np.uint64(0x9DDFEA08EB382D69)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: Characters, and bytes of them at most, that are hashed at a time.
PIECE, _PIECE_BYTES = 1 << 16, 1 << 18
_SPACES = "\t\n\v\f\r "
_POWERS: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    """The base's powers up to a piece's length and their inverses; of one size, whatever the texts."""
    if not _POWERS:
        for base in (_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64))):
            out = np.full(_PIECE_BYTES + 8, base, dtype=np.uint64)
            out[0] = 1
            _POWERS.append(np.multiply.accumulate(out))
    return _POWERS


def _long_word(word: np.ndarray) -> np.ndarray:
    """The hash of one word longer than a piece, as _piece() has it."""
    up, total = _powers()[0], 0
    for at in range(0, len(word), _PIECE_BYTES):
        part = word[at : at + _PIECE_BYTES].astype(np.uint64) + np.uint64(1)
        total += int((part * up[: len(part)]).sum(dtype=np.uint64)) * pow(int(_BASE), at, 1 << 64)
    return mix(np.array([total + len(word) & (2**64 - 1)], dtype=np.uint64))


def _piece(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of raw, which ends between words, and where they begin. The base begins anew at each word."""
    buf = _LOWER[np.frombuffer(raw, dtype=np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[buf], [True]))))
    start, end = edge[::2], edge[1::2]
    if len(buf) > _PIECE_BYTES:
        return np.concatenate([_long_word(buf[a:b]) for a, b in zip(start, end, strict=True)] or [np.zeros(0, np.uint64)]), start
    up, down = _powers()
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), start


def _pieces(text: str):
    """text cut between words into pieces, longer only where a word is."""
    at = 0
    while len(text) - at > PIECE:
        cut = max(text.rfind(c, at, at + PIECE) for c in _SPACES)
        if cut < 0:
            cut = min((x for c in _SPACES if (x := text.find(c, at + PIECE)) >= 0), default=len(text))
        yield text[at : cut + 1]
        at = cut + 1
    yield text[at:]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, A-Z in lower case, and where the words of each text begin (one entry more than texts)."""
    found, counts = [np.zeros(0, np.uint64)], np.zeros(len(texts) + 1, dtype=np.int64)
    for i, j in batches(texts, PIECE):
        if len(texts[i]) > PIECE:
            for piece in _pieces(texts[i]):
                found.append(_piece(piece.encode("utf-8", "surrogatepass"))[0])
                counts[i + 1] += len(found[-1])
        else:
            raw = [t.encode("utf-8", "surrogatepass") for t in texts[i:j]]
            hashes, start = _piece(b" ".join(raw) + b" ")
            found.append(hashes)
            counts[i + 1 : j + 1] = np.diff(np.searchsorted(start, np.cumsum([0] + [len(x) + 1 for x in raw])))
    return np.concatenate(found), np.cumsum(counts)


def _distinct(x: np.ndarray) -> np.ndarray:
    """x sorted in place, each value once."""
    x.sort()
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of `width` words; of all its words if it has fewer; none without words."""
    words, at = word_hashes(texts)
    runs = []
    n = len(words)
    if n >= width:
        rolled = np.zeros(n - width + 1, dtype=np.uint64)
        for j in range(width):
            rolled *= np.uint64(0x9E3779B97F4A7C15)
            rolled += words[j : n - width + 1 + j]
        rolled += np.uint64(width)
        for a in range(0, len(rolled), PIECE):
            rolled[a : a + PIECE] = mix(rolled[a : a + PIECE])
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= width:
            runs.append(_distinct(rolled[a : b - width + 1]))
        elif b > a:
            whole = reduce(lambda x, y: (x * 0x9E3779B97F4A7C15 + int(y)) & (2**64 - 1), words[a:b], 0)
            runs.append(mix(np.array([whole + (b - a) & (2**64 - 1)], dtype=np.uint64)))
        else:
            runs.append(np.zeros(0, dtype=np.uint64))
    return runs


def batches(texts, limit: int = 1 << 20):
    """Consecutive slices (from, to) of about `limit` characters at most, or of a single longer text."""
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if len(texts) > begin:
        yield begin, len(texts)


def match_floor(coordinates: int, similarity: float, miss: float = 1e-6) -> int:
    """The largest number of equal coordinates that a pair of this similarity falls short of with probability `miss` at most."""
    below, t = 0.0, 0
    while t < coordinates:
        below += math.comb(coordinates, t) * similarity**t * (1 - similarity) ** (coordinates - t)
        if below > miss:
            break
        t += 1
    return max(1, t)
