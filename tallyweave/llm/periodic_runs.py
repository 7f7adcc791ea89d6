r"""Runs of repeated words: maximal stretches of a text that have a period, by queries on a harmonic grid.

A run of period p and at least 2p words covers two neighbouring points jp and (j+1)p of the grid of p. How far the words after
both agree, and those before, gives the whole run. These longest common extensions come from a suffix array of the words, its
table of common prefixes with range minima, and the same of the words reversed. All p up to half the words have n/p points each,
so a text of n words asks about n log n of them; points whose words differ need no query. A stretch found with several periods
keeps the smallest.

Texts are worked on where they are: nothing is shuffled, and texts are taken together up to GROUP words, or one longer text
alone, in tables of about 200 bytes a word. A run has two equal stretches of six words, so texts in which no six words come
twice have no runs and need no tables.

Defined cases: null texts are empty; a text without words has no runs; repeated rows and null doc_ids are rows of their own;
words are whatever stands between white space of ASCII, and compared byte by byte; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WORD, mapped_rows

#: Words of a run at least, unless twice its period is more.
LEAST = 12
#: Words whose tables are built together, and points of the grid that are looked at together.
GROUP, POINTS = 1 << 16, 1 << 19
_RUN = "struct<start: bigint, length: bigint, period: bigint>"


def looped(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) in which a tenth, by the check sum of doc_id, repeat some of their words from one on to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.floor(h / 10).cast("long").alias("g"), F.when(h % 10 == 0, F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))).alias("words"))
    rows = rows.withColumn("n", F.size("words").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)).cast("long") + 1)
    rest = (F.col("n") - F.col("a")).cast("int")
    part = lambda of, start, n: F.slice(of, start.cast("int"), n.cast("int"))
    tail = part(F.flatten(F.array_repeat(part(F.col("words"), F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(F.concat(part(F.col("words"), F.lit(1), F.col("a")), tail), " ")).otherwise(F.col("text")).alias("text"))


class _Extensions:
    """Longest common prefixes of the suffixes of x, whose last number stands nowhere else."""

    def __init__(self, x: np.ndarray) -> None:
        order, levels = _suffixes(x)
        self.rank = levels[-1]
        # of suffixes next to each other, by the ranks that comparing 1, 2, 4, ... numbers has given
        common = np.zeros(len(x), dtype=np.int32)
        at = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
        a, b = order[at - 1].astype(np.int64), order[at].astype(np.int64)
        n = np.zeros(len(at), dtype=np.int64)
        for j in range(len(levels) - 1, -1, -1):
            n += (levels[j][a + n] == levels[j][b + n]).astype(np.int64) << j
        common[at] = n
        self.minima = [common]
        while (2 << (len(self.minima) - 1)) <= len(x):
            last, half = self.minima[-1], 1 << (len(self.minima) - 1)
            self.minima.append(np.minimum(last[:-half], last[half:]))

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers from i on equal those from j on, for different i and j."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(i), dtype=np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.minima[k][low[at]], self.minima[k][high[at] - (1 << k) + 1])
        return out


def _suffixes(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order of the suffixes of x, and their ranks by the first 1, 2, 4, ... numbers until all differ.

    Suffixes that agree so far have the place of the first of them as their rank; only these are sorted on.
    """
    n = len(x)
    order = np.argsort(x, kind="stable")
    new = np.concatenate(([True], x[order[1:]] != x[order[:-1]]))
    place = np.arange(n)
    rank = np.empty(n, dtype=np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, place, 0))
    levels, k = [rank], 1
    open_ = np.flatnonzero(~(new & np.concatenate((new[1:], [True]))))
    while len(open_):
        at = order[open_]
        key = rank[at].astype(np.int64) * n + rank[at + k]
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[open_] = at
        new = np.concatenate(([True], key[1:] != key[:-1]))
        rank = rank.copy()
        rank[at] = np.maximum.accumulate(np.where(new, open_, 0))
        levels.append(rank)
        open_ = open_[~(new & np.concatenate((new[1:], [True])))]
        k *= 2
    return order, levels


def _grid(sizes: np.ndarray, begins: np.ndarray):
    """The points of all periods, as arrays of the period, where a point stands and that it is of its text; POINTS of them or one period's at a time."""
    text = np.repeat(np.arange(len(sizes)), sizes // 2)
    period = np.arange(len(text)) - np.repeat(np.cumsum(sizes // 2) - sizes // 2, sizes // 2) + 1
    points = (sizes[text] - 1) // period
    ends = np.cumsum(points)
    a = 0
    while a < len(text):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + POINTS, side="right")))
        which = np.repeat(np.arange(a, b), points[a:b])
        nth = np.arange(len(which)) - np.repeat(ends[a:b] - points[a:b] - (ends[a - 1] if a else 0), points[a:b])
        yield period[which], begins[text[which]] + nth * period[which]
        a = b


def _found(numbers: list[np.ndarray]) -> list[np.ndarray]:
    """The runs of each text, whose words are numbered from 0: rows of start, length, period by start, then period."""
    sizes = np.array([len(x) for x in numbers], dtype=np.int64)
    # one array of all texts, their words told apart, with a number of its own before, between and after them
    x, free = [np.zeros(1, dtype=np.int64)], 1
    for ids in numbers:
        own = int(ids.max(initial=-1)) + 1
        x.append(np.concatenate((ids + free, [free + own])))
        free += own + 1
    begins = 1 + np.cumsum(sizes + 1) - (sizes + 1)
    x = np.concatenate(x)
    ahead, back, last = _Extensions(x), _Extensions(x[::-1].copy()), len(x) - 1
    found = [np.zeros((3, 0), dtype=np.int64)]
    for period, a in _grid(sizes, begins):
        same = np.flatnonzero(x[a] == x[a + period])
        p, a = period[same], a[same]
        before = back.of(last - (a - 1), last - (a - 1 + p))
        first = before < p  # at other points the same run is met again
        p, a, before = p[first], a[first], before[first]
        length = before + p + ahead.of(a, a + p)
        long = length >= np.maximum(LEAST, 2 * p)
        found.append(np.stack((a - before, length, p))[:, long])
    start, length, period = np.concatenate(found, axis=1)
    by = np.lexsort((period, length, start))
    start, length, period = start[by], length[by], period[by]
    least = np.concatenate(([True], (start[1:] != start[:-1]) | (length[1:] != length[:-1])))[: len(start)]
    start, length, period = start[least], length[least], period[least]
    by = np.lexsort((period, start))
    start, length, period = start[by], length[by], period[by]
    cuts = np.searchsorted(start, begins)
    return [np.stack((start[i:j] - b, length[i:j], period[i:j]), axis=1) for b, i, j in zip(begins, cuts, [*cuts[1:], len(start)], strict=True)]


def _may_have_runs(ids: np.ndarray) -> bool:
    """Whether any LEAST / 2 words in a row come twice; by hashes, so now and then wrongly true."""
    if len(ids) < LEAST:
        return False
    width = LEAST // 2
    h = np.zeros(len(ids) - width + 1, dtype=np.uint64)
    for j in range(width):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += ids[j : len(ids) - width + 1 + j].astype(np.uint64)
    h.sort()
    return bool((h[1:] == h[:-1]).any())


def _runs(texts: list[list[bytes]]) -> list[np.ndarray]:
    """The runs of each list of words."""
    out = [np.zeros((0, 3), dtype=np.int64)] * len(texts)
    held, size = [], 0

    def settle() -> None:
        nonlocal held, size
        for (i, _), runs in zip(held, _found([ids for _, ids in held]) if held else [], strict=True):
            out[i] = runs
        held, size = [], 0

    for i, words in enumerate(texts):
        number = {w: n for n, w in enumerate(dict.fromkeys(words))}
        ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        if _may_have_runs(ids):
            if size + len(ids) > GROUP:
                settle()
            held.append((i, ids))
            size += len(ids)
    settle()
    return out


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by a space."""
    if not len(runs):
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(depth[:-1]) == 0
    return b" ".join([words[i] for i in np.flatnonzero(kept)])


def _work(frames):
    import pyarrow as pa

    for frame in frames:
        texts = [(x or b"").split() for x in frame.column("text").cast(pa.binary()).to_pylist()]
        runs = _runs(texts)
        flat = np.concatenate([np.zeros((0, 3), dtype=np.int64), *runs])
        each = pa.StructArray.from_arrays([pa.array(flat[:, k].copy()) for k in range(3)], names=["start", "length", "period"])
        offsets = pa.array(np.concatenate(([0], np.cumsum([len(r) for r in runs]))).astype(np.int32))
        collapsed = pa.array([_collapsed(w, r) for w, r in zip(texts, runs, strict=True)], pa.binary()).view(pa.string())
        yield pa.RecordBatch.from_arrays([frame.column("doc_id"), pa.ListArray.from_arrays(offsets, each), collapsed], names=["doc_id", "runs", "collapsed"])


def runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs (array of start, length, period, by start, then period), collapsed: the text without the repetitions of its runs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped_rows(docs.select("doc_id", "text"), _work, f"doc_id {kind}, runs array<{_RUN}>, collapsed string")


def digests(done: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli of the longest run, and digests of all runs and of the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    rows = done.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("x"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("x.start"), F.col("x.length"), -F.col("x.period")
    return rows.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.expr("1000 * x.length div -x.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
