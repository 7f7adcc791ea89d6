"""Ids beyond 2^53 stay whole where another row of the same batch has none."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import archives, minhash_dedup, mixing, ordinal, packing, pii

IDS = [2**60 + 1, None, -(2**60) - 3, 7]
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, f"some text of row {i} for m{i}@example.org", "a", 2**61 + i if i % 2 else None, bool(i % 2) or None) for i, d in enumerate(IDS)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, flag boolean").withColumn("other", docs_other()).coalesce(1)


def docs_other():
    return F.when(F.col("doc_id") > 0, F.array(F.col("doc_id"), F.lit(None).cast("long")))


def _ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=lambda x: (x is None, x))


@pytest.mark.parametrize(
    "work",
    [
        lambda docs: ordinal.scored(docs, ordinal.fit([], np.zeros(0, dtype=int), np.zeros(0))),
        pii.find,
        pii.redacted,
        lambda docs: ordinal.selected(docs, ordinal.fit([], np.zeros(0, dtype=int), np.zeros(0)), 0.5),
        lambda docs: packing.pack(docs, PATH),
        minhash_dedup.kept_documents,
        mixing.mixed_documents,
        lambda docs: mixing.Mix(docs).taken(),
    ],
    ids=["scored", "find", "redacted", "selected", "pack", "kept_documents", "mixed_documents", "taken"],
)
def test_ids_stay_whole(docs, work):
    got = work(docs)
    assert set(_ids(got)) <= set(IDS) and len(set(_ids(got))) >= 2
    if set(got.columns) == set(docs.columns):
        want = {r["doc_id"]: r for r in docs.collect()}
        for r in got.collect():
            assert r["flag"] == want[r["doc_id"]]["flag"] and r["other"] == want[r["doc_id"]]["other"]


def test_page_ids_stay_whole(spark):
    pages = spark.createDataFrame([(d, f"http://e.example/{i}", "x" * 200 if i < 3 else "y") for i, d in enumerate(IDS)], "page_id long, url string, html string").coalesce(1)
    rows = archives.convert(pages, unnamed=True).collect()
    assert {r["page_id"] for r in rows} == set(IDS)
    assert {r["refers_to"] for r in rows} == {None, min(d for d in IDS[:3] if d is not None)}
