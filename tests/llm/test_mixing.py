import re
from bisect import bisect_right
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyweave.llm import mixing
from tallyweave.llm.shared import read_table


def _targets(sizes):
    """Targets by filling up: those above their limit stop there, and the rest is shared anew until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    fixed = {}
    while True:
        left = sum(sizes.values()) - sum(fixed.values())
        free = {s: weight[s] for s in names if s not in fixed}
        share = {s: left * w / sum(free.values()) for s, w in free.items()}
        over = {s: 3 * sizes[s] for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return {**fixed, **share}
        fixed |= over


def _size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def _hold(df):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in df.select("doc_id", "text", "source").collect()]
    sizes = Counter()
    for _, text, source in docs:
        sizes[source] += _size(text)
    want = _targets(sizes)
    source_of = {(d, _size(t)): s for d, t, s in docs}
    rows = mixing.Mix(df).taken().collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["size"]) for r in rows) == sorted(((d is None, d or 0), _size(t)) for d, t, _ in docs)
    taken = Counter()
    for r in rows:
        s = source_of[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(3, 0.02 * want[s])
    return sorted(str(tuple(r)) for r in rows)


def test_hard_cases_and_reruns(doc_cases):
    assert _hold(doc_cases) == _hold(doc_cases.repartition(7))


def test_whole_table(spark, sf):
    df = read_table(spark, sf, "documents")
    assert _hold(df) == _hold(df.repartition(5))


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 100, "b": 1, "c": 1}, {"a": 5, "b": 50, None: 500}, {"a": 0, "b": 7}, {"a": 0}, {**{f"s{i:02d}": 1 + i % 3 for i in range(60)}, "t": 200, None: 90}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    want = _targets(sizes)
    for r in mixing.targets(df).collect():
        assert abs(r["target"] - want[r["source"]]) < 1e-9 * max(1, want[r["source"]])


def test_permutation(spark):
    for n in (1, 2, 7, 1000):
        rows = spark.range(n).select(mixing.permuted(mixing.F.col("id"), mixing.F.lit(n).cast("long"), mixing.F.lit(5)).alias("p")).collect()
        assert sorted(r["p"] for r in rows) == list(range(n))


def test_shards_hold_their_draws(spark, sf):
    mix = mixing.Mix(read_table(spark, sf, "documents"))
    per_shard = mix.slots.groupBy("shard").count().collect()
    assert sorted(r["shard"] for r in per_shard) == list(range(len(per_shard)))
    assert all(r["count"] == mixing.SHARD for r in per_shard if r["shard"] < len(per_shard) - 1)
    assert mix.draws().agg({"blocks": "sum"}).first()[0] == sum(r["count"] for r in per_shard)


def test_draws_are_multinomial_and_reconciled(spark, sf):
    mix = mixing.Mix(read_table(spark, sf, "documents"), shard=512)
    slots = {r["source"]: r["slots"] for r in mix.totals.collect()}
    total = sum(slots.values())
    drawn, kept = Counter(), Counter()
    for r in mix.drawn.collect():
        drawn[r["shard"]] += r["drawn"]
        kept[r["source"]] += r["kept"]
        assert 0 <= r["kept"] <= r["drawn"] and r["begin"] + r["kept"] <= max(slots[r["source"]], r["begin"])
        # a shard's draw is near its share: within six standard deviations of a binomial one
        p, n = slots[r["source"]] / total, min(512, total - 512 * r["shard"])
        assert abs(r["drawn"] - n * p) <= 6 * (n * p * (1 - p)) ** 0.5 + 6
    assert all(drawn[h] == min(512, total - 512 * h) for h in drawn) and sum(drawn.values()) == total
    assert all(kept[s] <= slots[s] for s in slots) and len({r["drawn"] for r in mix.drawn.where("source is not null").collect()}) > 3
    rows = mix.slots.collect()
    assert Counter(r["source"] for r in rows) == slots and len({(r["shard"], r["slot"]) for r in rows}) == total
    assert "draws-" in mix.taken()._jdf.queryExecution().optimizedPlan().toString() or "shard" in mix.taken()._jdf.queryExecution().optimizedPlan().toString()


def test_each_number_draws_the_owner_of_its_slot(spark):
    """Sources of a slot or two that share a run of slots, beside one of many runs."""
    words = lambda n: " ".join(["w"] * n)
    rows = [(i, words(1 + i % 3), f"s{i:04d}") for i in range(600)] + [(1000 + i, words(2000), "t" if i % 2 else None) for i in range(40)]
    mix = mixing.Mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), shard=128)
    totals = sorted((r["low"], r["slots"], r["source"]) for r in mix.totals.collect())
    assert sum(n <= 9 for _, n, _ in totals) > mixing.OWNED and max(n for _, n, _ in totals) > mixing.OWNED
    numbers = spark.range(mix.all).select(F.pmod(F.xxhash64(F.lit("draw"), F.lit(mix.seed), "id"), F.lit(mix.all)).alias("x"), "id").collect()
    lows = [low for low, _, _ in totals]
    want = Counter((r["id"] // 128, totals[bisect_right(lows, r["x"]) - 1][2]) for r in numbers)
    assert want == {(r["shard"], r["source"]): r["drawn"] for r in mix.drawn.collect()}


def test_nothing_made_for_each_slot_is_broadcast(spark, sf):
    """Exploded rows are estimated as few as what they come from, so Spark would broadcast them at any size."""
    mix = mixing.Mix(read_table(spark, sf, "documents"))
    lines = mix.spans._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-*(0123456789)"))
    inside = None
    for line in lines:
        if inside is not None and depth(line) <= inside:
            inside = None
        if inside is None and "BroadcastExchange" in line:
            inside = depth(line)
        assert inside is None or "sequence(" not in line


def _taken_by_hand(mix):
    """Words taken of each row, counted word by word from the slots."""
    times = Counter((r["source"], r["block"]) for r in mix.slots.collect())
    out = Counter()
    for r in mix.docs.collect():
        out[r["doc_id"], r["size"], sum(times[r["source"], r["first"] + (r["start"] + i) // r["width"]] for i in range(r["size"]))] += 1
    return out


def test_taken_is_what_the_slots_say(spark, sf, doc_cases):
    for df in (doc_cases, read_table(spark, sf, "documents")):
        mix = mixing.Mix(df)
        assert _taken_by_hand(mix) == Counter((r["doc_id"], r["size"], r["taken"]) for r in mix.taken().collect())


def test_mixed_documents_have_the_words_taken(doc_cases, no_docs):
    # with rows alike in every column, and rows that have but their doc_id, text and source in common
    again = doc_cases.where("doc_id in (1, 2, 6)").withColumn("lang", mixing.F.lit("zz"))
    df = doc_cases.unionByName(again).unionByName(again)
    want = Counter((r["doc_id"], r["taken"]) for r in mixing.Mix(df).taken().collect() if r["taken"])
    made = mixing.mixed_documents(df)
    assert made.columns == df.columns
    rows = made.collect()
    assert Counter((r["doc_id"], _size(r["text"])) for r in rows) == want and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert mixing.mixed_documents(no_docs).isEmpty() and mixing.Mix(no_docs).taken().isEmpty()
