"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors are rotated and split into low-dimensional blocks. Vectors within squared distance e of each other are within
their proportional share of e in at least one block, so each block is range-joined on a grid, and what any of them finds is
verified on whole vectors. A pair counts in the first block where it is within the share, so no list of pairs has to be
deduplicated: tasks return the number of links of the vectors at home in their cell and a spanning forest of them.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, or have a null label, link with
nothing; vectors of different dimension never link; rows with a null vec_id are left out; repeated rows are vectors of their
own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, mapped, written

BLOCKS = 8
#: Steps of the rotated coordinates, which are held as integers so that every task sees the same distances.
SCALE = 1 << 20
#: Vectors at home in one task's cell, and others that they meet there.
CELL_ROWS = 4096
#: Vectors of a label that one cell may hold on average before a further coordinate cuts the cells. A further coordinate
#: doubles the copies that are shuffled and leaves four fifths of the comparisons, of which a copy costs some ten thousand.
CELL_AIM = 8192
_SLACK = 1e-5


def _rotation(dim: int) -> np.ndarray:
    return np.linalg.qr(np.random.Generator(np.random.PCG64(dim)).standard_normal((dim, dim)))[0]


def _rotated(x: np.ndarray) -> np.ndarray:
    unit = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return np.round(unit @ _rotation(x.shape[1]) * SCALE)


def _layout(dim: int, similarity: float) -> list[tuple[int, int, float]]:
    """First and last coordinate of each block, and its share of the squared distance."""
    cuts = np.linspace(0, dim, min(BLOCKS, dim) + 1).round().astype(int)
    return [(a, b, (2 - 2 * similarity) * (b - a) / dim + _SLACK) for a, b in itertools.pairwise(cuts.tolist())]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def vector_duplicates(vectors: DataFrame, similarity: float = 0.98, cell_rows: int = CELL_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept: vectors of equal label, linked at cosine >= similarity."""
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("v"))
    sound = "label is not null and v is not null and size(v) > 0 and coalesce(forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')), false) and exists(v, x -> x <> 0)"
    rows = rows.withColumn("sound", F.coalesce(F.expr(sound), F.lit(False))).withColumn("f1", F.xxhash64("v")).withColumn("f2", F.xxhash64(F.lit("v"), "v"))
    sets = written(rows.where("sound").groupBy("label", "f1", "f2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w"), F.any_value("v").alias("v")), "vectors")
    most = sets.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    grid = int(max(1, np.ceil(np.log(max(most, 1) / CELL_AIM) / np.log(2.5))))

    def place(frames):
        for frame in frames:
            size = frame["v"].map(len).to_numpy()
            for dim in np.unique(size).tolist():
                own = frame[size == dim]
                y = _rotated(np.stack(own["v"].to_numpy()).astype(float))
                for b, (first, last, share) in enumerate(_layout(dim, similarity)):
                    g = min(grid, last - first)
                    r = np.sqrt(share) * SCALE + 1
                    cell = np.floor(y[:, first : first + g] / (2 * r))
                    side = np.where(y[:, first : first + g] - cell * 2 * r < r, -1, 1)
                    for move in itertools.product((0, 1), repeat=g):
                        at = (cell + side * np.array(move)).astype(int)
                        yield pd.DataFrame({"label": own["label"].to_numpy(), "dim": dim, "block": b, "cell": [",".join(map(str, c)) for c in at.tolist()], "home": not any(move), "rep": own["rep"].to_numpy(), "w": own["w"].to_numpy(), "v": own["v"].to_numpy()})

    key = ["label", "dim", "block", "cell"]
    label = sets.schema["label"].dataType.simpleString()
    placed = mapped(sets.select("label", "rep", "w", "v"), place, f"label {label}, dim int, block int, cell string, home boolean, rep long, w long, v array<double>")
    # the rows of a heavy cell are cut on both sides: its home rows and all its rows meet in pairs of chunks of bounded size
    cut = lambda n: F.ceil(n / cell_rows).cast("long")
    heavy = placed.groupBy(*key).agg(F.count_if("home").alias("h"), F.count("*").alias("n")).where((F.col("n") > cell_rows) & (F.col("h") > 0)).select(*key, cut(F.col("h")).alias("homes"), cut(F.col("n")).alias("others"))
    own, other = F.expr("pmod(xxhash64(rep, 1), homes)"), F.expr("pmod(xxhash64(rep, 2), others)")
    role = lambda i, j, home, met: F.struct(i.alias("i"), j.alias("j"), home.alias("home"), met.alias("met"))
    as_home = F.transform(F.expr("sequence(0L, others - 1)"), lambda j: role(own, j, F.lit(True), F.lit(False)))
    as_met = F.transform(F.expr("sequence(0L, homes - 1)"), lambda i: role(i, other, F.lit(False), F.lit(True)))
    light = F.array(role(F.lit(0).cast("long"), F.lit(0).cast("long"), F.col("home"), F.lit(True)))
    roles = F.when(F.col("homes").isNull(), light).when(F.col("home"), F.concat(as_home, as_met)).otherwise(as_met)
    spread = placed.join(heavy, key, "left").select(*key, "rep", "w", "v", F.explode(roles).alias("role")).select(*key, "rep", "w", "v", "role.*")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        dim, block = int(frame["dim"].iloc[0]), int(frame["block"].iloc[0])
        frame = frame.sort_values("rep")
        home, met = (np.flatnonzero(frame[c].to_numpy()) for c in ("home", "met"))
        layout = _layout(dim, similarity)
        if not len(home) or not len(met):
            return pd.DataFrame({"u": [], "links": [], "v": []}).astype(np.int64)
        x = np.stack(frame["v"].to_numpy()).astype(float)
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        y, rep, w = _rotated(x), frame["rep"].to_numpy(), frame["w"].to_numpy()
        first, last, share = layout[block]
        part = y[:, first:last]
        square = np.einsum("ij,ij->i", part, part)
        links, left, right = np.zeros(len(frame), dtype=np.int64), [home[:0]], [home[:0]]
        for at in range(0, len(home), 256):
            some = home[at : at + 256]
            near = square[some][:, None] + square[met] - 2 * part[some] @ part[met].T <= share * SCALE**2
            near &= rep[some][:, None] != rep[met]
            a, b = np.nonzero(near)
            a, b = some[a], met[b]
            for c in range(0, len(a), 50_000):
                i, j = a[c : c + 50_000], b[c : c + 50_000]
                ok = np.einsum("ij,ij->i", x[i], x[j]) / (norm[i] * norm[j]) >= similarity
                i, j = i[ok], j[ok]
                if block and len(i):
                    gap = (y[i] - y[j]) ** 2
                    seen = np.zeros(len(i), dtype=bool)
                    for lo, hi, budget in layout[:block]:
                        seen |= gap[:, lo:hi].sum(axis=1) <= budget * SCALE**2
                    i, j = i[~seen], j[~seen]
                np.add.at(links, i, w[j])
                left.append(i)
                right.append(j)
        i, j = np.concatenate(left), np.concatenate(right)
        root = _forest(len(frame), i, j)
        used = np.unique(np.concatenate((i, j)))
        return pd.DataFrame({"u": rep[used], "links": links[used], "v": rep[root[used]]})

    found = written(spread.groupBy(*key, "i", "j").applyInPandas(compare, "u long, links long, v long"), "links")
    comps = connected_components(found.select("u", "v")).withColumnsRenamed({"id": "rep", "component": "c"})
    counts = found.groupBy("u").agg(F.sum("links").alias("links")).withColumnRenamed("u", "rep")
    classes = sets.select("label", "f1", "f2", "rep", "w").join(counts, "rep", "left").join(comps, "rep", "left")
    classes = classes.select("label", "f1", "f2", F.lit(True).alias("sound"), (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("c", "rep").alias("c"))
    out = rows.select("vec_id", "label", "f1", "f2", "sound").join(classes, ["label", "f1", "f2", "sound"], "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
