"""Small tables of hard cases: nulls, empty and very long texts, ties, repeated rows, other columns whose names clash."""

import pytest

LONG = " ".join(f"word{i % 997} Long{i % 31}" for i in range(30_000))
CLASHING = ["size", "source_size", "rep", "u", "v", "token", "key", "n", "component", "cand", "part", "bucket", "target", "taken", "block", "kept_id", "r_key", "runs", "pieces", "label2"]


@pytest.fixture(scope="session")
def doc_cases(spark):
    base = "the quick brown fox jumps over the lazy dog while seven grey geese fly north again today"
    rows = [
        (1, base, "en", "a"), (2, base, "en", None), (2, base, "en", None), (3, None, None, "b"), (4, "", "en", "a"), (5, " \n\t ", "en", "a"), (6, LONG, "en", "c"), (7, LONG + " tail", "en", "c"),
        (8, "one", "en", "b"), (9, "One", "en", "b"), (10, base.upper() + "!", "en", "é"), (11, "two words", "de", "é"), (None, base + " more", "en", "a"), (12, "mail a.b@example.org or 10.0.0.1, +1 (555) 123-4567 é 4111 1111 1111 1111", "en", "b"),
        (13, " nbsp space İstanbul ﬁ 日本語テキスト <|endoftext|> it's 12'34", "xx", "a"),
    ]
    rows = [(*r, len(r[1] or ""), *["x"] * len(CLASHING)) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)).repartition(3)


@pytest.fixture(scope="session")
def no_docs(doc_cases):
    return doc_cases.where("false")
