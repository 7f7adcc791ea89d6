"""The pipeline against what its stages must do, worked out here from their inputs."""

import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tallyweave.llm import mixing  # noqa: E402
from tallyweave.llm.queries import QUERIES  # noqa: E402
from tallyweave.llm.shared import read_table, written  # noqa: E402

from .test_minhash import _brute  # noqa: E402


def test_stages(spark, sf):
    docs = read_table(spark, sf, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "MinHash near-dedup", "PII", "mixing sources to target weights", "packing"]
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(written(stage(spark, seen[-1], sf), "test"))
    assert all(df.columns == docs.columns for df in seen[:-1])
    _, good, unique, clean, mixed, packed = seen

    kept = {r["doc_id"] for r in good.select("doc_id").collect()}
    labels = {r["doc_id"]: r["quality"] for r in read_table(spark, sf, "labels").collect()}
    assert np.mean([(d in kept) == (q > 0) for d, q in labels.items() if q is not None]) > 0.9

    texts = [(r["doc_id"], r["text"]) for r in good.collect()]
    assert sorted(r["doc_id"] for r in unique.collect()) == sorted(i for i, _, _, first in _brute(texts, 5, 80, 100) if first)

    before = {r["doc_id"]: r["text"] for r in unique.collect()}
    after = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert before.keys() == after.keys() and not any(re.search(r"[\w.]+@\w+\.\w", t or "") for t in after.values())

    taken = {r["doc_id"]: r["taken"] for r in mixing.Mix(clean).taken().collect()}
    assert {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in mixed.collect()} == {d: n for d, n in taken.items() if n}

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r["doc_id"]: 1 + len(tok.encode(r["text"], add_special_tokens=False).ids) for r in mixed.collect()}
    rows = packed.toPandas()
    assert rows.groupby("doc_id")["length"].sum().to_dict() == want

    again = QUERIES["pipeline"](spark, sf).toPandas()
    key = ["doc_id", "start"]
    assert again.groupby("doc_id")["length"].sum().to_dict() == want and set(again.columns) == set(rows.columns) and key[0] in again


def _through(spark, sf, docs):
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(written(stage(spark, seen[-1], sf), "test"))
    return seen


def test_hard_cases(spark, sf, doc_cases):
    # ids of the table come again with other texts, beside nulls, empty and very long texts, repeated rows and clashing columns
    docs = read_table(spark, sf, "documents").unionByName(doc_cases, allowMissingColumns=True)
    docs = docs.unionByName(docs.where("doc_id % 20 = 1"))
    seen, again = _through(spark, sf, docs), _through(spark, sf, docs.repartition(7))
    assert all(df.columns == docs.columns for df in seen[:-1])
    for a, b in zip(seen, again, strict=True):
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    good, unique, clean, mixed, packed = seen[1:]
    # a document that the classifier keeps has a copy in what is left, and no id comes twice
    ids = [r["doc_id"] for r in unique.select("doc_id").collect() if r["doc_id"] is not None]
    texts = [(r["doc_id"], r["text"]) for r in good.collect() if r["doc_id"] is not None]
    assert len(ids) == len(set(ids)) and sorted(ids) == sorted({i for i, _, _, first in _brute(texts, 5, 80, 100) if first})
    assert clean.count() == unique.count() == len(ids) + good.where("doc_id is null").count()
    assert all(r["text"] and r["n_chars"] == len(r["text"]) for r in mixed.collect())
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in mixed.collect():
        want[r["doc_id"]] += 1 + len(tok.encode(r["text"], add_special_tokens=False).ids)
    got = Counter()
    for r in packed.select("doc_id", "length").collect():
        got[r["doc_id"]] += r["length"]
    assert got == want


def test_empty_table(spark, sf, no_docs):
    assert all(df.isEmpty() for df in _through(spark, sf, no_docs))
