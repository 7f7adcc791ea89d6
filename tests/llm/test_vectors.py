import numpy as np

from tallyweave.llm import topk_search, vector_dedup
from tallyweave.llm.queries import op1_topk_search, op2_vector_dedup
from tallyweave.llm.shared import read_table


def _cases(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(6).tolist(), i % 3) for i in range(120)]
    rows += [(200, None, 1), (201, [], 1), (202, [float("nan")] * 6, 1), (203, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (204, [float("inf")] + [0.0] * 5, 1), (205, [0.0] * 6, 1), (206, [1.0, 2.0], 1), (207, [2.0, 4.0], 1), (None, [1.0] * 6, 1)]
    rows += [(300 + i, rows[5][1], 2) for i in range(40)] + [(400, rows[5][1], None), (401, [2 * x for x in rows[5][1]], 2), (401, [2 * x for x in rows[5][1]], 2), (402, rows[5][1], 1)]
    rows += [(500 + i, (np.array(rows[7][1]) + 0.02 * i * rng.standard_normal(6)).tolist(), 1) for i in range(30)]
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, label int, rep string, v string").repartition(4), rows


def _sound(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v)


def _top(rows, every, k):
    found = {}
    for i, v, _ in rows:
        if i is not None and _sound(v):
            q = [int(np.floor(256 * x)) for x in v]
            found[i] = min(found.get(i, q), q)
    out = set()
    for i, q in found.items():
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, w)), j) for j, w in found.items() if j != i and len(w) == len(q))
            out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])}
    return out


def test_top_k_is_exact(spark):
    df, rows = _cases(spark)
    vectors = topk_search.quantized(df)
    for block in (7, 2048):
        got = [tuple(r) for r in topk_search.top_k(vectors.where("vec_id % 3 = 0"), vectors, 4, block=block, query_block=5, lanes=3).collect()]
        assert len(got) == len(set(got)) and set(got) == _top(rows, 3, 4)


def test_products_are_pruned(spark):
    """Vectors of many lengths: the longest give least scores, and far fewer products than all are verified."""
    rng = np.random.default_rng(8)
    rows = [(i, (rng.standard_normal(8) * (10.0 if i % 50 == 7 else rng.random())).tolist(), 0) for i in range(1500)]
    vectors = topk_search.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3))
    verified = spark.sparkContext.accumulator(0)
    got = {tuple(r) for r in topk_search.top_k(vectors.where("vec_id % 10 = 0"), vectors, 5, block=50, query_block=40, seeds=30, verified=verified).collect()}
    assert got == _top(rows, 10, 5)
    assert 0 < verified.value < 0.5 * 150 * 1500


def test_huge_components_and_repeated_candidates(spark):
    rows = [(0, [4e6, 1.0, 3.0]), (1, [4e6, 1.0, 5.0]), (2, [4e6 + 1 / 256, 1.0, 3.0]), (3, [1e300, 0.0, 0.0]), (4, [-1e300, 1.0, 1.0]), (5, [1.0, 1.0, 1.0]), (1, [4e6, 1.0, 5.0]), (6, [2e9, 2e9, 2e9]), (7, [2e9, 2e9, 2e9 + 1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q, every = topk_search.quantized(df), topk_search.quantized(df, merge=False)
    whole = [(i, [min(max(int(np.floor(256 * x)), -(2**62)), 2**62) for x in v]) for i, v in rows]
    for r in (0, 1, 6):
        scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(dict(whole)[r], w)))), j) for j, w in whole if j != r)
        want = [(r, n + 1, j, -s) for n, (s, j) in enumerate(scores[:4])]
        got = sorted(tuple(x) for x in topk_search.top_k(q.where(f"vec_id = {r}"), every, 4).collect())
        assert got == want


def test_top_k_of_the_table(spark, sf):
    rows = [(r[0], r[1], r[2]) for r in read_table(spark, sf, "embeddings").select("vec_id", "embedding", "label").collect()]
    assert {tuple(r) for r in op1_topk_search(spark, sf).collect()} == _top(rows, 50, 5)


def _links(rows, least):
    """n_links, component of each row; rows that share an id are vectors of their own."""
    ok = [i for i, (_, v, label) in enumerate(rows) if _sound(v) and label is not None and any(v)]
    near = {i: set() for i in range(len(rows))}
    for a in ok:
        for b in ok:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], dtype=float), np.array(rows[b][1], dtype=float)
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= least:
                    near[a].add(b)
                    near[b].add(a)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            todo += (new := near[todo.pop()] - seen)
            seen |= new
        out.append((len(near[i]), min(rows[j][0] for j in seen)))
    return out


def test_vector_duplicates_are_exact(spark):
    df, rows = _cases(spark)
    rows = [r for r in rows if r[0] is not None]
    want = sorted((r[0], n, c, r[0] == c) for r, (n, c) in zip(rows, _links(rows, 0.98)))
    for cell in (5, 4096):
        assert sorted(tuple(r) for r in vector_dedup.vector_duplicates(df, 0.98, cell).collect()) == want


def test_vector_duplicates_of_the_table(spark, sf):
    rows = [tuple(r) for r in read_table(spark, sf, "embeddings").select("vec_id", "embedding", "label").collect()]
    want = {(r[0], n, c, r[0] == c) for r, (n, c) in zip(rows, _links(rows, 0.98))}
    assert {tuple(r) for r in op2_vector_dedup(spark, sf).collect()} == want


def test_empty_tables(spark):
    df, _ = _cases(spark)
    none = topk_search.quantized(df.where("false"))
    assert topk_search.top_k(none, none).isEmpty()
    assert vector_dedup.vector_duplicates(df.where("false")).isEmpty()


def test_no_vector_is_met_twice_and_none_passes_a_window(spark, sf):
    rows = read_table(spark, sf, "embeddings")
    verified = spark.sparkContext.accumulator(0)
    found = topk_search.top_k(topk_search.quantized(rows.where("vec_id % 50 = 0")), topk_search.quantized(rows, merge=False), 5, block=40, seeds=100, verified=verified)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.split("\n") if "Window [" in line and "members" in line]
    n = rows.count()
    assert found.count() == 5 * rows.where("vec_id % 50 = 0").count() and 0 < verified.value <= rows.where("vec_id % 50 = 0").count() * (n - 1) + n
