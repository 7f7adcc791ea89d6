"""Near-duplicate documents by a signature-coordinate inverted join.

Every distinct shingle set gets a MinHash signature. Its coordinate values are posted as (coordinate, value) tokens; a pair
above the match threshold has at least t tokens in common, so it shares one of its first m - t + 1 tokens in order of
frequency (prefix), m being the tokens of a document that any other document has at all. Short posting lists are joined and
the collisions counted. Long lists are skipped: who reaches the threshold by frequent tokens alone is put in one candidate
group through the list's smallest id, so that a list never becomes pairs. Candidate groups, cut into parts of bounded size,
are then confirmed on full shingle sets by a breadth-first search that compares only what isn't linked yet. What is in several
parts is compared in blocks of bounded size, if it shares one of the rare shingles that a link must share.

Defined cases: null text is empty; a text without words has no shingles and links with nothing; rows with a null doc_id link
with nothing and are left out of the links; rows that share a doc_id are one document for links, whatever their texts, and appear once each; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batches, connected_components, mapped, match_floor, mix, shingle_sets, written

#: Coordinates of a signature.
COORDINATES = 32
#: Posting lists above this length are skipped rather than joined.
LONG_LIST = 64
#: Shingles in one part of a candidate group.
PART_SHINGLES = 1 << 20
#: Shingles counted to order them by frequency, and the most frequent that are told apart; any order gives the same links.
COUNTED_SHINGLES, FREQUENT = 1 << 24, 1 << 17
#: Shingles hashed at a time.
HASHED = 1 << 17


def _family(k: int, seed: int = 20) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.Generator(np.random.PCG64(seed)).integers(0, 2**63, size=(2, k), dtype=np.uint64)
    return draw[0] * np.uint64(2) + np.uint64(1), draw[1]


def signatures(docs: DataFrame, width: int, coordinates: int = COORDINATES) -> DataFrame:
    """doc_id, n_shingles, f1 and f2 (128 bits that stand for the set), signature (null for empty sets)."""

    def sketch(frames):
        a, b = _family(coordinates)
        for frame in frames:
            texts = frame["text"].fillna("").tolist()
            for i, j in batches(texts):
                sets = shingle_sets(texts[i:j], width)
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                f1, f2 = np.zeros((2, j - i), dtype=np.uint64)
                signed = [None] * (j - i)
                if len(full):
                    least = np.full((len(full), coordinates), np.iinfo(np.uint64).max, dtype=np.uint64)
                    # sets in runs of some size, and a larger set piece by piece
                    for lo, hi in batches([sets[x] for x in full], HASHED):
                        every = np.concatenate([sets[x] for x in full[lo:hi]])
                        own = full[lo:hi]
                        for p in range(0, len(every), HASHED) if hi - lo == 1 else [0]:
                            flat = every[p : p + HASHED] if hi - lo == 1 else every
                            at = np.concatenate(([0], np.cumsum(sizes[own])[:-1])) if hi - lo > 1 else np.zeros(1, dtype=np.int64)
                            f1[own] += np.add.reduceat(mix(flat), at)
                            f2[own] += np.add.reduceat(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), at)
                            for c in range(coordinates):
                                least[lo:hi, c] = np.minimum(least[lo:hi, c], np.minimum.reduceat(flat * a[c] + b[c], at))
                    for x, row in zip(full.tolist(), least.view(np.int64), strict=True):
                        signed[x] = row
                yield pd.DataFrame({"doc_id": frame["doc_id"].iloc[i:j].to_numpy(), "n_shingles": sizes, "f1": f1.view(np.int64), "f2": f2.view(np.int64), "signature": signed})

    plain = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mapped(plain, sketch, "doc_id long, n_shingles long, f1 long, f2 long, signature array<long>")


def candidate_edges(sets: DataFrame, t: int, long_list: int = LONG_LIST) -> DataFrame:
    """Edges (u, v) over sets (rep, signature): each pair with t equal coordinates is connected by them."""
    posted = sets.select("rep", F.explode("signature").alias("token"))
    counts = posted.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    ordered = posted.join(counts, "token").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("all")).where(F.size("all") >= t)
    ordered = written(ordered.select("rep", F.col("all.token").alias("tokens"), F.expr(f"slice(all, 1, size(all) - {t - 1})").alias("prefix")), "prefixes")
    postings = ordered.select("rep", "tokens", F.col("prefix.token").alias("first"), F.explode("prefix").alias("p")).select("rep", "tokens", "first", "p.*")
    short = postings.where(F.col("df") <= long_list).drop("df")
    other = short.toDF("rep2", "tokens2", "first2", "token")
    # a pair is taken at the first token that both prefixes have, so it is met once
    pairs = short.join(other, "token").where("rep < rep2").where("array_intersect(first, first2)[0] = token").where(f"size(array_intersect(tokens, tokens2)) >= {t}")
    skipped = postings.where(F.col("df") > long_list).select("token", "rep")
    hubs = skipped.groupBy("token").agg(F.min("rep").alias("hub"))
    # a document hangs on the smallest of its hubs, and so do the other hubs: as connected as with an edge to each, but fewer
    held = skipped.join(hubs, "token").groupBy("rep").agg(F.collect_set("hub").alias("hubs"))
    return pairs.select(F.col("rep").alias("u"), F.col("rep2").alias("v")).unionByName(_stars(held))


def _stars(held: DataFrame) -> DataFrame:
    return held.select(F.explode(F.array_union("hubs", F.array("rep"))).alias("u"), F.array_min("hubs").alias("v")).where("u <> v").distinct()


def _linked_groups(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """A label for each set; equal labels for those connected by links, found breadth first among what isn't reached yet."""
    n = len(sets)
    label = np.full(n, -1)
    size = np.array([len(s) for s in sets])
    terms, flat = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.concatenate(([0], np.cumsum(size)))
    left = np.arange(n)
    left_flat, left_at = flat, at[:-1]
    mark = np.zeros(len(terms), dtype=np.int32)
    for seed in range(n):
        if label[seed] >= 0:
            continue
        label[seed], queue = seed, [seed]
        while queue:
            x = queue.pop()
            keep = label[left] < 0
            if keep.sum() < 0.7 * len(left):
                left = left[keep]
                left_flat = np.concatenate([flat[at[i] : at[i + 1]] for i in left]) if len(left) else flat[:0]
                left_at = np.concatenate(([0], np.cumsum(size[left])[:-1])).astype(np.int64) if len(left) else at[:0]
            if not len(left):
                break
            own = flat[at[x] : at[x + 1]]
            mark[own] = 1
            common = np.add.reduceat(mark[left_flat], left_at)
            mark[own] = 0
            near = left[(den * common >= num * (size[x] + size[left] - common)) & (label[left] < 0)]
            label[near] = seed
            queue += near.tolist()
    return label


def _by_group(frames, keys: list[str], work):
    """Calls work(frame) for each run of equal keys in a sorted stream and passes on what it returns, a group at a time."""
    held: list[pd.DataFrame] = []
    last = None
    out: list[pd.DataFrame] = []
    for frame in frames:
        change = (frame[keys] != frame[keys].shift()).any(axis=1).to_numpy().nonzero()[0].tolist() if len(frame) else []
        for a, b in zip(change, [*change[1:], len(frame)], strict=True):
            key = tuple(frame[keys].iloc[a])
            if held and key != last:
                out.append(work(pd.concat(held) if len(held) > 1 else held[0]))
                held = []
            last = key
            held.append(frame.iloc[a:b])
        if sum(map(len, out)) > 5000:
            yield pd.concat(out)
            out = []
    if held:
        out.append(work(pd.concat(held) if len(held) > 1 else held[0]))
    if out:
        yield pd.concat(out)


def near_duplicates(docs: DataFrame, width: int = 5, similarity: tuple[int, int] = (80, 100), long_list: int = LONG_LIST, part_shingles: int = PART_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: documents linked when den * intersection >= num * union of their shingle sets."""
    num, den = similarity
    t = match_floor(COORDINATES, num / den)
    signed = written(signatures(docs, width), "signatures")
    sets = written(signed.where("n_shingles > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.any_value("n_shingles").alias("n"), F.any_value("signature").alias("signature")), "sets")
    groups = connected_components(candidate_edges(sets, t, long_list)).withColumnsRenamed({"id": "rep", "component": "cand"})
    sized = groups.join(sets.select("rep", "n"), "rep")
    parts = sized.groupBy("cand").agg(F.ceil(F.sum("n") / part_shingles).cast("long").alias("parts"))
    members = written(sized.join(parts, "cand").select("cand", "rep", "n", "parts", F.expr("pmod(xxhash64(rep), parts)").alias("part")), "members")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))

    def confirm(frames):
        def work(group: pd.DataFrame) -> pd.DataFrame:
            found = shingle_sets(group["text"].fillna("").tolist(), width)
            reps = group["rep"].to_numpy()
            ok = [i for i, s in enumerate(found) if len(s)]
            label = _linked_groups([found[i] for i in ok], num, den) if ok else np.zeros(0, dtype=int)
            least = pd.Series(reps[ok]).groupby(label).transform("min").to_numpy() if ok else reps[:0]
            return pd.DataFrame({"u": reps[ok], "v": least, "parts": group["parts"].to_numpy()[ok], "cand": group["cand"].to_numpy()[ok]})

        return _by_group(frames, ["cand", "part"], work)

    held = members.join(texts, "rep").select("cand", "part", "parts", "rep", "text")
    linked = written(mapped(held.repartition("cand", "part").sortWithinPartitions("cand", "part"), confirm, "u long, v long, parts long, cand long"), "linked")
    # a group of one part is done: the smallest id reached there is the component
    found = linked.where("parts = 1").groupBy("u").agg(F.min("v").alias("component"))
    several = linked.where("parts > 1").select("u", "v", "cand", "parts")
    if not several.isEmpty():
        found = found.unionByName(_across_parts(several, members, texts, width, num, den, part_shingles))
    placed = sets.select("f1", "f2", "rep").join(found.withColumnRenamed("u", "rep"), "rep", "left").select("f1", "f2", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", "f1", "f2").join(placed, ["f1", "f2"], "left").withColumn("component", F.coalesce("component", "doc_id"))
    # ids that come with several sets connect what these belong to
    several = signed.groupBy("doc_id").agg(F.min(F.struct("f1", "f2")).alias("lo"), F.max(F.struct("f1", "f2")).alias("hi")).where("lo < hi").select("doc_id")
    if not several.isEmpty():
        out = written(out, "several-sets")
        joined = connected_components(out.join(several, "doc_id").where("component <> doc_id").select(F.col("doc_id").alias("u"), F.col("component").alias("v")).distinct())
        out = out.join(joined.toDF("component", "least"), "component", "left").withColumn("component", F.coalesce("least", "component"))
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept"))


def _prefixes(rows: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """token, rep, component: the shingles of each row (cand, rep, component, n, text), of which linked rows of a cand share one.

    Of n shingles in a fixed order the first n - ceil(n * num / den) + 1 are such; in order of frequency these are rare ones.
    """
    total = rows.agg(F.sum("n")).first()[0] or 0

    def shingles(frames):
        for frame in frames:
            texts = frame["text"].fillna("").tolist()
            for i, j in batches(texts):
                yield pd.DataFrame({"token": np.concatenate(shingle_sets(texts[i:j], width)).view(np.int64)})

    counted = mapped(rows.where(F.expr(f"pmod(xxhash64(rep, 1), {max(1, -(-total // COUNTED_SHINGLES))}) = 0")).select("text"), shingles, "token long")
    often = counted.groupBy("token").count().where("count > 1").orderBy(F.desc("count"), "token").limit(FREQUENT).collect()
    often = sorted((r["token"], r["count"]) for r in often)
    known, counts = np.array([-(2**63), *(t for t, _ in often)], dtype=np.int64), np.array([0, *(n for _, n in often)], dtype=np.int64)

    def first(frames):
        for frame in frames:
            texts = frame["text"].fillna("").tolist()
            cand, rep, component = (frame[c].to_numpy() for c in ("cand", "rep", "component"))
            for i, j in batches(texts):
                taken = []
                for x in shingle_sets(texts[i:j], width):
                    x = x.view(np.int64)
                    at = np.searchsorted(known, x, "right") - 1
                    order = np.lexsort((x, np.where(known[at] == x, counts[at], 0)))
                    taken.append(x[order[: len(x) + num * len(x) // -den + 1]] if len(x) else x)
                n = [len(x) for x in taken]
                yield pd.DataFrame({"cand": np.repeat(cand[i:j], n), "token": np.concatenate(taken), "rep": np.repeat(rep[i:j], n), "component": np.repeat(component[i:j], n)})

    tokens = mapped(rows.select("cand", "rep", "component", "text"), first, "cand long, token long, rep long, component long")
    return tokens.select(F.xxhash64("cand", "token").alias("token"), "rep", "component")


def _blocks(rows: DataFrame, texts: DataFrame, width: int, num: int, den: int, part_shingles: int) -> DataFrame:
    """cand, sub, part, moving, component, rep, text: blocks (cand, sub, part) in which all that can still be linked meets.

    Rows (cand, rep, n, component) that share a prefix shingle with another component are grouped by these; what isn't in
    the largest component of its group moves. Moving rows and all rows are cut into pieces of about part_shingles, each pair a block.
    """
    open_cands = rows.groupBy("cand").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("cand")
    rows = rows.join(open_cands, "cand")
    posted = written(_prefixes(rows.join(texts, "rep"), width, num, den), "shingles")
    live = posted.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("rep").alias("hub")).where("lo < hi").select("token", "hub")
    groups = connected_components(_stars(posted.join(live, "token").groupBy("rep").agg(F.collect_set("hub").alias("hubs")))).toDF("rep", "cand")
    rows = written(rows.drop("cand").join(groups, "rep"), "open")
    sizes = rows.groupBy("cand", "component").agg(F.count("*").alias("count"), F.sum("n").alias("n"))
    largest = F.max_by(F.struct("component", "n"), F.struct("count", "component"))
    pieces = lambda x: F.greatest(F.lit(1), F.ceil(x / part_shingles)).cast("long")
    cut = sizes.groupBy("cand").agg(largest.alias("main"), F.sum("n").alias("n")).select("cand", F.col("main.component").alias("main"), pieces(F.col("n") - F.col("main.n")).alias("subs"), pieces(F.col("n")).alias("parts"))
    rows = rows.join(cut, "cand")
    every = lambda n: F.explode(F.expr(f"sequence(0L, {n} - 1)"))
    moving = rows.where("component <> main").select("cand", F.expr("pmod(xxhash64(rep, 2), subs)").alias("sub"), every("parts").alias("part"), F.lit(True).alias("moving"), "component", "rep")
    staying = rows.select("cand", every("subs").alias("sub"), F.expr("pmod(xxhash64(rep, 3), parts)").alias("part"), F.lit(False).alias("moving"), "component", "rep")
    # never broadcast: rows for each piece look as few as the rows they are exploded from
    return moving.unionByName(staying).hint("merge").join(texts, "rep").select("cand", "sub", "part", "moving", "component", "rep", "text")


def _across_parts(several: DataFrame, members: DataFrame, texts: DataFrame, width: int, num: int, den: int, part_shingles: int = PART_SHINGLES) -> DataFrame:
    """Components of candidate groups that were cut into parts."""
    loops = several.select("u", F.col("u").alias("component"), "cand")
    inner = connected_components(several.select("u", "v"))
    state = written(loops.join(inner.withColumnsRenamed({"id": "u", "component": "c"}), "u", "left").select("u", F.coalesce("c", "component").alias("component"), "cand").distinct(), "state")
    rows = written(members.where("parts > 1").select("rep", "n").join(state.withColumnRenamed("u", "rep"), "rep"), "rows")
    both = _blocks(rows, texts, width, num, den, part_shingles)

    def confirm(frames):
        def work(group: pd.DataFrame) -> pd.DataFrame:
            found = shingle_sets(group["text"].fillna("").tolist(), width)
            size = np.array([len(s) for s in found])
            moving, reps, comp = group["moving"].to_numpy(bool), group["rep"].to_numpy(), group["component"].to_numpy()
            stay = np.flatnonzero(~moving & (size > 0))
            u, v = [], []
            if len(stay):
                flat = np.concatenate([found[i] for i in stay])
                terms, flat = np.unique(flat, return_inverse=True)
                at = np.concatenate(([0], np.cumsum(size[stay])[:-1]))
                for x in np.flatnonzero(moving & (size > 0)):
                    mark = np.zeros(len(terms), dtype=np.int32)
                    where = np.searchsorted(terms, found[x])
                    where = where[where < len(terms)]
                    mark[where[np.isin(terms[where], found[x])]] = 1
                    common = np.add.reduceat(mark[flat], at)
                    near = stay[(den * common >= num * (size[x] + size[stay] - common)) & (comp[stay] != comp[x])]
                    for c in np.unique(comp[near]):
                        u.append(comp[x])
                        v.append(c)
            return pd.DataFrame({"u": np.array(u, dtype=np.int64), "v": np.array(v, dtype=np.int64)})

        return _by_group(frames, ["cand", "sub", "part"], work)

    more = mapped(both.repartition("cand", "sub", "part").sortWithinPartitions("cand", "sub", "part"), confirm, "u long, v long")
    joined = connected_components(more).select(F.col("id").alias("component"), F.col("component").alias("least"))
    return state.join(joined, "component", "left").groupBy("u").agg(F.min(F.coalesce("least", "component")).alias("component"))


def kept_documents(docs: DataFrame, width: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """One row of each group of near-duplicates, that of the smallest doc_id; rows without words are all kept, once for each doc_id, and so are rows with a null doc_id.

    Of rows that share that doc_id the one with the longest text stays, of these the one with the least hash of all columns, so reruns agree.
    """
    kept = near_duplicates(docs, width, similarity).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    named = docs.where("doc_id is not null")
    named = named.join(kept, named["doc_id"] == kept["kept_id"], "left_semi")
    whole = F.struct(*(named[c] for c in named.columns))
    rank = F.struct(-F.length(F.coalesce(named["text"].cast("string"), F.lit(""))), F.xxhash64(whole))
    one = named.groupBy(named["doc_id"].alias("kept_id")).agg(F.min_by(whole, rank).alias("whole"))
    return one.select(*(F.col("whole")[c].alias(c) for c in docs.columns)).unionByName(docs.where("doc_id is null"))
