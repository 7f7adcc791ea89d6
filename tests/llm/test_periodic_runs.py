import hashlib
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyweave.llm import periodic_runs
from tallyweave.llm.queries import op11_periodic_runs
from tallyweave.llm.shared import read_table


def _brute(words) -> list[tuple[int, int, int]]:
    """Runs by comparing every word with every other at each distance."""
    found, n = {}, len(words)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(12, 2 * p) and j > i:
                found.setdefault((i, j - i + p), p)
            i = max(i + 1, j)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def _want(doc_id, text, loops: bool = True):
    """The row of a document, worked out the plain way."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if loops and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + i % p] for i in range(n - a)]
    runs = _brute(words)
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    s, m, p = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
    return (len(runs), s, m, p, 1000 * m // p if m else None, sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


FIELDS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
TEXT = st.builds(lambda words, n, tail: (words * n)[:120] + tail, st.lists(st.sampled_from("abc"), max_size=30), st.integers(0, 8), st.lists(st.sampled_from("abcdefgh"), max_size=40))


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_brute_force(texts):
    texts = [[w.encode() for w in x] for x in texts]
    assert [list(map(tuple, r.tolist())) for r in periodic_runs._runs(texts)] == [_brute(x) for x in texts]


def test_points_and_groups_change_nothing(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [[b"%d" % x for x in np.resize(rng.integers(0, 4, rng.integers(1, 40)), rng.integers(0, 200))] for _ in range(40)]
    before = [r.tolist() for r in periodic_runs._runs(texts)]
    monkeypatch.setattr(periodic_runs, "POINTS", 7)
    monkeypatch.setattr(periodic_runs, "GROUP", 300)
    assert [r.tolist() for r in periodic_runs._runs(texts)] == before and any(before)


def test_table(spark, sf):
    rows = op11_periodic_runs(spark, sf)
    got = {r["doc_id"]: tuple(r[c] for c in FIELDS) for r in rows.collect()}
    short = {r["doc_id"]: r["text"] for r in read_table(spark, sf, "documents").collect() if len(r["text"] or "") < 6000}
    assert len(short) > 50 and {d: got[d] for d in short} == {d: _want(d, t) for d, t in short.items()}
    assert any(r[0] for r in got.values()) and len(got) == read_table(spark, sf, "documents").count()


def test_hard_cases(spark, doc_cases, no_docs):
    got = sorted(tuple(r[c] for c in FIELDS) for r in periodic_runs.digests(periodic_runs.runs(doc_cases)).collect() if r["doc_id"] not in (6, 7))
    rows = doc_cases.select("doc_id", "text").collect()
    assert got == sorted(_want(r["doc_id"], r["text"], loops=False) for r in rows if r["doc_id"] not in (6, 7)) and len(got) == len(rows) - 2
    long = {r["doc_id"]: r for r in periodic_runs.runs(doc_cases.where("doc_id in (6, 7)")).collect()}
    # 60,000 words of period 2 * lcm(997, 31) > 30,000: none; a text of one word has one run
    assert all(len(r["runs"]) == 0 for r in long.values())
    one = spark.createDataFrame([(1, "a " * 50_000), (2, "a b\x0bc\x1fd\t" * 20_000)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in periodic_runs.runs(one).collect()}
    assert [tuple(x) for x in found[1]["runs"]] == [(0, 50_000, 1)] and found[1]["collapsed"] == "a"
    assert [tuple(x) for x in found[2]["runs"]] == [(0, 60_000, 3)] and found[2]["collapsed"] == "a b c\x1fd"
    for f in (periodic_runs.looped, periodic_runs.runs):
        assert f(no_docs).isEmpty()
    assert {(r["doc_id"], r["text"]) for r in periodic_runs.looped(doc_cases.where("doc_id is null or text is null")).collect()} >= {(3, "")}
