import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyweave.llm import packing
from tallyweave.llm.shared import read_table

PATH = public_tokenizers.path("word_bpe_49k.json")


def _tokens(texts):
    tok = Tokenizer.from_file(PATH)
    return [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for t in texts]


def _hold(df, docs, capacity):
    rows = packing.pack(df, PATH, capacity=capacity).toPandas()
    want = sorted((-1 if d is None else d, ids.tobytes()) for d, ids in docs)
    # rows that share an id are told apart by taking pieces in turn
    left = {}
    for d, raw in want:
        left.setdefault(d, []).append(raw)
    for d, some in rows.assign(doc_id=rows["doc_id"].fillna(-1).astype(int)).groupby("doc_id"):
        assert some["length"].sum() == sum(len(x) // 4 for x in left[d])
        assert (some["length"] * 4 == some["ids"].map(len)).all()
        for _, p in some.iterrows():
            assert any(len(x) == 4 * p["doc_tokens"] and x[4 * p["start"] : 4 * (p["start"] + p["length"])] == p["ids"] for x in left[d])
        if len(left[d]) == 1:
            whole = some.sort_values("start")
            assert b"".join(whole["ids"]) == left[d][0] and (whole["start"] == whole["length"].cumsum() - whole["length"]).all()
    assert set(rows["doc_id"].fillna(-1).astype(int)) == set(left)
    padded = 0
    for _, some in rows.groupby("sequence_id"):
        some = some.sort_values("offset")
        assert (some["offset"] == some["length"].cumsum() - some["length"]).all()
        total = some["length"].sum()
        assert total <= capacity
        padded += 0 if total & (total - 1) == 0 else capacity - total
    assert padded == 0
    return rows


def test_pieces_hold_every_token_once(spark, doc_cases):
    docs = [(r["doc_id"], r["text"]) for r in doc_cases.collect()]
    rows = _hold(doc_cases, list(zip([d for d, _ in docs], _tokens([t for _, t in docs]))), 64)
    made = packing.digests(packing.pack(doc_cases, PATH, capacity=64)).toPandas()
    assert sorted(made["ids_crc32"]) == sorted(zlib.crc32(x) for x in rows["ids"])


def test_whole_table(spark, sf):
    df = read_table(spark, sf, "documents")
    docs = [tuple(r) for r in df.select("doc_id", "text").collect()]
    _hold(df, list(zip([d for d, _ in docs], _tokens([t for _, t in docs]))), 2048)


def test_empty(no_docs):
    assert packing.pack(no_docs, PATH).isEmpty()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_words_are_encoded_as_texts_are(text):
    encoder = test_words_are_encoded_as_texts_are.__dict__.setdefault("encoder", packing.WordEncoder(PATH))
    assert encoder.encode([text])[0] == np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 3), max_size=6), st.integers(1, 64))
def test_fill_is_closest_to_capacity(lengths, room):
    best = {0}
    for size, n in lengths.items():
        best |= {a + size * k for a in best for k in range(n + 1) if a + size * k <= room}
    chosen = packing.fill(lengths, room)
    assert sum(k * v for k, v in chosen.items()) == max(best)
    assert all(v <= lengths[k] for k, v in chosen.items())


@pytest.mark.parametrize("text", ["it's", "İstanbul ﬁne", "a b", "<|endoftext|>", "x<|startoftext|>y", "１２３", "don't 'S we'Ll", "½x²", "a\x1cb", "a\u0085b", " "])
def test_hard_words(text):
    encoder = packing.WordEncoder(PATH)
    assert encoder.encode([text])[0] == np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
