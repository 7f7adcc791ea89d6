import itertools
import random
import re

import pytest

from tallyweave.llm import minhash_dedup


def _sets(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def _brute(rows, width, num, den):
    ids = sorted({r[0] for r in rows})
    sets = {i: [] for i in ids}
    for i, t in rows:
        sets[i].append(_sets(t, width))
    near = {i: set() for i in ids}
    for a, b in itertools.combinations(ids, 2):
        if any(x and y and den * len(x & y) >= num * len(x | y) for x in sets[a] for y in sets[b]):
            near[a].add(b)
            near[b].add(a)
    comp = {}
    for i in ids:
        if i not in comp:
            seen, todo = {i}, [i]
            while todo:
                todo += (new := near[todo.pop()] - seen)
                seen |= new
            comp |= dict.fromkeys(seen, i)
    return sorted((i, len(_sets(t, width)), comp[i], comp[i] == i) for i, t in rows)


def _variants(seed=1, n=140):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    seeds = [[r.choice(vocabulary) for _ in range(r.randint(30, 120))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = list(r.choice(seeds))
        for _ in range(r.randint(0, 3)):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize(("long_list", "part_shingles"), [(64, 1 << 20), (2, 1 << 20), (64, 500), (2, 300)])
def test_links_are_those_of_all_pairs(spark, long_list, part_shingles):
    rows = _variants()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component string").repartition(3)
    got = minhash_dedup.near_duplicates(df, 3, (85, 100), long_list, part_shingles)
    assert sorted(tuple(r) for r in got.collect()) == _brute(rows, 3, 85, 100)


def _templated(n=60):
    """Documents of which each shares half its words with all others and is linked with the next one at most."""
    half = [f"t{i}" for i in range(40)]
    rows = [(i, " ".join(half + [f"u{i // 2 if i < 10 else i}x{j}" for j in range(40)] + [f"e{i}"])) for i in range(n)]
    return rows


def test_blocks_across_parts_are_thinned_and_bounded(spark, monkeypatch):
    rows, seen = _templated(), []
    blocks = minhash_dedup._blocks
    monkeypatch.setattr(minhash_dedup, "_blocks", lambda *a: (seen.append(blocks(*a)), seen[-1])[1])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = minhash_dedup.near_duplicates(df, 3, (80, 100), 2, 400)
    assert sorted(tuple(r) for r in got.collect()) == _brute(rows, 3, 80, 100)
    # only the ten that have something rare in common meet again, at most two at a time
    assert {r["rep"] for r in seen[0].collect()} <= set(range(10))
    assert max(r["count"] for r in seen[0].groupBy("cand", "sub", "part").count().collect()) <= 4
    # many of no component: pieces on both sides are bounded
    rows = _variants(5, 60)
    wide = spark.createDataFrame([(1, i, len(_sets(t, 3)), i) for i, t in rows], "cand long, rep long, n long, component long")
    texts = spark.createDataFrame(rows, "rep long, text string")
    found = minhash_dedup._blocks(wide, texts, 3, 85, 100, 300).withColumn("n", minhash_dedup.F.size(minhash_dedup.F.split("text", " ")))
    assert max(r["n"] for r in found.groupBy("cand", "sub", "part", "moving").agg(minhash_dedup.F.sum("n").alias("n")).collect()) < 1500


def test_hard_cases(spark, doc_cases, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in doc_cases.collect() if r["doc_id"] is not None]
    got = minhash_dedup.near_duplicates(doc_cases, 3, (85, 100))
    assert sorted(tuple(r) for r in got.collect()) == _brute(rows, 3, 85, 100)
    assert minhash_dedup.near_duplicates(no_docs).isEmpty()
    kept = minhash_dedup.kept_documents(doc_cases)
    assert kept.columns == doc_cases.columns
    want = [i for i, _, _, first in _brute(rows, 5, 80, 100) if first]
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(x for x in got if x is not None) == sorted(set(want)) and got.count(None) == 1


def test_rows_of_one_id_are_chosen_alike(spark):
    rows = [(1, f"{'w ' * (i % 7)}tail {i}", i) for i in range(40)] + [(2, None, 1), (2, "", 2), (2, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long")
    seen = {tuple(sorted(tuple(r) for r in minhash_dedup.kept_documents(df.repartition(n)).collect())) for n in (1, 5, 9)}
    assert len(seen) == 1
    (one, two), = seen
    assert one[0] == 1 and len(one[1]) == max(len(t) for i, t, _ in rows if i == 1) and two[0] == 2


def test_ids_with_several_texts_are_one_document(spark):
    rows = [(i % 100 if i % 3 else i, t) for i, t in _variants(7, 140)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = minhash_dedup.near_duplicates(df, 3, (85, 100))
    assert sorted(tuple(r) for r in got.collect()) == _brute(rows, 3, 85, 100)
    one = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (2, "e f g h"), (3, "e f g h"), (4, "k l m n"), (4, None), (5, "k l m n"), (5, "")], "doc_id long, text string")
    found = {(r["doc_id"], r["component_id"]) for r in minhash_dedup.near_duplicates(one, 3, (85, 100)).collect()}
    assert found == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}
