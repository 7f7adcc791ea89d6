"""Exact top-k inner-product search by norm-bucketed retrieval.

Vectors are grouped into buckets of similar length and these into blocks of bounded size. Each query first meets the longest
vectors alone: its k best of them count, and the last of these is its least score. Blocks that are too short for every query of
a block of queries never meet it. Lanes then meet their other blocks in order of falling length and keep every
query's k best so far; the higher of both scores gives a local cosine threshold for the block at hand. A threshold above 1
prunes the block for that query. A high one prunes by coordinates: only vectors whose coordinates lie in the feasible ranges of
the query's largest ones are verified. Any other prunes by length, and all longer ones are verified. Verified products are exact
integers: doubles hold them below 2^53, above it they are worked out as whole numbers of any size.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part, nor do rows with a null id;
components beyond 2^62 count as that, and scores beyond a long as the largest or smallest long, so that they tie; vectors of
different dimension aren't compared; repeated rows of one id are one query, with the smallest vector, and with merge=False
candidates each; ties go to the smaller id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import mapped, written

#: Vectors and queries in a block.
BLOCK, QUERY_BLOCK = 2048, 1024
#: The longest vectors that give queries their least scores.
SEEDS = 2048
#: Local cosine thresholds from which coordinates prune.
COORDINATE_FROM = 0.9
FOCUS = 3
#: Below it, sums of products of whole numbers are exact as doubles.
EXACT = 2.0**53


def quantized(vectors: DataFrame, scale: int = 256, merge: bool = True) -> DataFrame:
    """vec_id, v (array<long>): floor(scale * x) for each component x as double. merge: one row for each id."""
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    sound = rows.where("v is not null and size(v) > 0 and coalesce(forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')), false)")
    whole = sound.select("vec_id", F.transform("v", lambda x: F.floor(F.greatest(F.lit(-(2.0**62)), F.least(F.lit(2.0**62), x * scale))).cast("long")).alias("v"))
    return whole.groupBy("vec_id").agg(F.min("v").alias("v")) if merge else whole


def _norm() -> F.Column:
    return F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def _blocks(rows: DataFrame, size: int, *more: str) -> DataFrame:
    """Blocks of vectors of equal dimension and similar length: dim, bucket, block, longest, n, members.

    With a floor, a least score of each, also need: the length below which no vector reaches any of them.
    """
    # lengths in one bucket differ by a tenth at most
    rows = rows.withColumn("norm", _norm()).withColumn("dim", F.size("v")).withColumn("bucket", F.floor(F.log(F.greatest("norm", F.lit(1.0))) / np.log(1.1)).cast("int"))
    counts = rows.groupBy("dim", "bucket").agg(F.ceil(F.count("*") / size).cast("long").alias("n"))
    spread = rows.join(counts, ["dim", "bucket"]).withColumn("block", F.expr("pmod(xxhash64(vec_id), n)"))
    members = F.sort_array(F.collect_list(F.struct("norm", "vec_id", "v", *more)), asc=False)
    need = [F.min(F.when(F.col("floor").isNull() | (F.col("floor") <= 0), float("-inf")).when(F.col("norm") > 0, F.col("floor") / F.col("norm") * (1 - 1e-9)).otherwise(float("inf"))).alias("need")] if "floor" in more else []
    return spread.groupBy("dim", "bucket", "block").agg(F.max("norm").alias("longest"), F.count("*").alias("n"), members.alias("members"), *need)


def _unpack(members) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.array([m["vec_id"] for m in members], dtype=np.int64), np.array([m["norm"] for m in members]), np.stack([m["v"] for m in members])


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if scores.dtype == object:
        order = sorted(range(len(ids)), key=lambda j: (-scores[j], ids[j]))[:k]
    else:
        order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


class _Queries:
    """A block of queries and the best of each so far."""

    def __init__(self, members, k: int) -> None:
        self.ids, self.norms, self.whole = _unpack(members)
        self.x, self.k = self.whole.astype(np.float64), k
        least = [m["floor"] for m in members]
        # a bound, so rounded down where it isn't exact
        self.least = np.array([-np.inf if pd.isna(f) else float(f) if abs(f) < EXACT else float(f) - abs(float(f)) * 1e-12 for f in least])
        self.state = [(np.zeros(0), np.zeros(0, dtype=np.int64))] * len(self.ids)
        self.verified = 0

    def floors(self) -> np.ndarray:
        own = np.array([float(s[0][self.k - 1]) if len(s[0]) >= self.k else -np.inf for s in self.state])
        return np.maximum(np.where(np.abs(own) < EXACT, own, own - np.abs(own) * 1e-12), self.least)

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(ids):
            s = self.state[i]
            self.state[i] = _best(np.concatenate((s[0], scores)), np.concatenate((s[1], ids)), self.k)

    def results(self) -> pd.DataFrame:
        size = [len(s[1]) for s in self.state]
        scores = [int(x) for s in self.state for x in s[0]]
        return pd.DataFrame({"query_id": np.repeat(self.ids, size), "rank": np.concatenate([np.arange(1, n + 1) for n in size]), "vec_id": np.concatenate([s[1] for s in self.state]), "score": np.array(scores, dtype=np.int64)})


class _Block:
    """One block of vectors, longest first."""

    def __init__(self, members) -> None:
        self.ids, self.norms, self.whole = _unpack(members)
        self.x = self.whole.astype(np.float64)
        self.unit = self.x / np.maximum(self.norms, 1e-300)[:, None]

    def search(self, q: _Queries) -> None:
        floor, reach = q.floors(), q.norms * self.norms[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(reach > 0, floor / reach, np.where(floor > 0, np.inf, -np.inf))
        open_ = local <= 1 + 1e-9
        focused = open_ & (local >= COORDINATE_FROM)
        for i in np.flatnonzero(focused):
            self.verify(q, i, self.feasible(q.x[i] / q.norms[i], min(local[i], 1.0)))
        rest = np.flatnonzero(open_ & ~focused)
        if not len(rest):
            return
        # by length: below the shortest length that any of the open queries still needs, nothing is verified
        need = np.where(q.norms[rest] > 0, floor[rest] / np.maximum(q.norms[rest], 1e-300), -np.inf).min()
        upto = int(np.searchsorted(-self.norms, -(need * (1 - 1e-9)), side="right")) if need > 0 else len(self.norms)
        if reach[rest].max() >= EXACT:
            for i in rest:
                self.verify(q, i, np.arange(upto))
            return
        q.verified += len(rest) * upto
        scores = q.x[rest] @ self.x[:upto].T
        scores[q.ids[rest][:, None] == self.ids[:upto]] = -np.inf
        for row, i in enumerate(rest):
            s = scores[row]
            last = max(np.partition(s, upto - q.k)[upto - q.k], floor[i]) if upto > 4 * q.k else floor[i]
            take = np.flatnonzero((s >= last) & np.isfinite(s))
            q.add(i, s[take], self.ids[take])

    def feasible(self, hat: np.ndarray, c: float) -> np.ndarray:
        """The vectors whose coordinates, at the largest of hat, allow a cosine of c."""
        ok = np.ones(len(self.ids), dtype=bool)
        for f in np.argsort(-np.abs(hat))[:FOCUS]:
            spread = np.sqrt(max(0.0, (1 - c * c) * (1 - hat[f] ** 2)))
            low = -np.inf if hat[f] < -c else hat[f] * c - spread
            high = np.inf if hat[f] > c else hat[f] * c + spread
            ok &= (self.unit[:, f] >= low - 1e-9) & (self.unit[:, f] <= high + 1e-9)
        return np.flatnonzero(ok)

    def verify(self, q: _Queries, i: int, take: np.ndarray) -> None:
        take = take[self.ids[take] != q.ids[i]]
        q.verified += len(take)
        if q.norms[i] * self.norms[0] < EXACT:
            q.add(i, self.x[take] @ q.x[i], self.ids[take])
        else:
            q.add(i, np.array([min(max(sum(map(int.__mul__, a, q.whole[i].tolist())), -(2**63)), 2**63 - 1) for a in self.whole[take].tolist()], dtype=object), self.ids[take])


def _searched(asked: DataFrame, dealt: DataFrame, k: int, tasks: int, verified=None) -> DataFrame:
    """query_id, rank, vec_id, score: of each block of queries the k best in each lane it meets. Rows hold one block, of queries first."""
    queries = asked.select("lane", "qblock", F.lit(0).alias("kind"), F.lit(0.0).alias("longest"), "members")
    # what is too short for all of a block's queries goes before any vector is moved to them
    met = asked.select("lane", "qblock", "dim", "need").join(dealt, ["dim", "lane"]).where("longest >= need")
    bare = F.transform("members", lambda m: F.struct(m["norm"], m["vec_id"], m["v"], F.lit(None).cast("long").alias("floor")))
    rows = queries.unionByName(met.select("lane", "qblock", F.lit(1).alias("kind"), "longest", bare.alias("members")))

    def search(frames):
        current, q = None, None
        for frame in frames:
            for lane, qblock, kind, members in zip(frame["lane"], frame["qblock"], frame["kind"], frame["members"], strict=True):
                if (lane, qblock) != current:
                    if q is not None:
                        yield q.results()
                    current, q = (lane, qblock), None
                if kind == 0:
                    q = _Queries(members, k)
                elif q is not None:
                    before = q.verified
                    _Block(members).search(q)
                    if verified is not None:
                        verified.add(q.verified - before)
        if q is not None:
            yield q.results()

    dealt_out = rows.repartition(tasks, "lane", "qblock").sortWithinPartitions("lane", "qblock", "kind", F.desc("longest"))
    return mapped(dealt_out, search, "query_id long, rank int, vec_id long, score long")


def top_k(queries: DataFrame, items: DataFrame, k: int = 5, block: int = BLOCK, query_block: int = QUERY_BLOCK, lanes: int = 24, seeds: int = SEEDS, verified=None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k items of largest inner product but itself; both have vec_id, v (array<long>).

    verified: an accumulator for the number of products that are worked out.
    """
    stored = written(_blocks(items, block), "blocks")
    # the buckets of the longest vectors of each dimension, and as many blocks of the last of them as make up `seeds`
    before = Window.partitionBy("dim").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    buckets = stored.groupBy("dim", "bucket").agg(F.sum("n").alias("held"), F.count("*").alias("blocks"))
    first = buckets.withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0))).where(F.col("before") < seeds)
    first = first.select("dim", "bucket", F.ceil((seeds - F.col("before")) * F.col("blocks") / F.col("held")).alias("take"))
    key = ["dim", "bucket"]
    longest = stored.join(first, key).where(F.col("block") < F.col("take"))
    others = stored.join(first, key, "left").where(F.col("take").isNull() | (F.col("block") >= F.col("take")))
    count = stored.select("dim").count()

    def blocks(rows: DataFrame) -> DataFrame:
        return written(_blocks(rows, query_block, "floor").select("dim", F.monotonically_increasing_id().alias("qblock"), "need", "members"), "queries")

    plain = blocks(queries.withColumn("floor", F.lit(None).cast("long"))).withColumn("lane", F.lit(0))
    groups = max(1, plain.select("dim").count())
    seeded = written(_searched(plain, longest.select("dim", "longest", "members", F.lit(0).alias("lane")), k, groups, verified), "seeded")
    floors = seeded.where(F.col("rank") == k).groupBy("query_id").agg(F.min("score").alias("floor"))
    asked = blocks(queries.join(floors.withColumnRenamed("query_id", "vec_id"), "vec_id", "left"))
    # each query block goes to every lane, each block of items to one; a lane holds about as many of one as of the other
    lanes = int(max(1, min(lanes, count), count / 64))
    dealt = others.select("dim", "longest", "members", F.expr(f"pmod(xxhash64(dim, bucket, block), {lanes})").cast("int").alias("lane"))
    met = asked.withColumn("lane", F.explode(F.expr(f"sequence(0, {lanes - 1})")))
    found = _searched(met, dealt, k, min(100_000, lanes * groups), verified).unionByName(seeded)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
