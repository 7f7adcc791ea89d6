import hashlib
from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyweave.llm import chat_format
from tallyweave.llm.queries import op12_chat_format

SCHEMA = "conv_id long, turn long, role string, text string"
TRAPS = ["### ", "</turn>", "<turn>", "\\", "\n", "### Assistant:\n", "\n</turn>\n", "\n<turn>\n", "x", "é", "日", "$1", ""]


def _want(rows) -> dict:
    """Digests worked out the plain way."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn is not None, turn or 0, role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {}
    for conv, found in groups.items():
        found.sort()
        learned = "".join(t for _, _, r, t in found if r == "assistant")
        out[conv] = (len(found), sha("".join(f"{r}\n{t}\n" for _, _, r, t in found)), len(learned), sha(learned))
    return out


def _got(df) -> dict:
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat_format.digests(chat_format.formatted(df)).collect()}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.one_of(st.none(), st.integers(0, 3)), st.sampled_from(["user", "assistant", "system", "User", "=", "tool:\n x", "", None]), st.one_of(st.none(), st.lists(st.sampled_from(TRAPS), max_size=6).map("".join))), min_size=1, max_size=25))
def test_round_trip(spark, rows):
    assert _got(spark.createDataFrame(rows, SCHEMA)) == _want(rows)


def test_template_and_mask(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b\\"), (1, 2, "assistant", "x </turn>"), (1, 3, "assistant", "y")]
    done = chat_format.formatted(spark.createDataFrame(rows, SCHEMA)).first()
    assert done["formatted"] == "### User:\na\n<turn>\nb\\\n</turn>\n### Assistant:\nx \\</turn>\n<turn>\ny\n</turn>\n"
    assert [done["formatted"][m["start"] : m["start"] + m["length"]] for m in done["loss_mask"]] == ["x \\</turn>", "y"]


def test_hard_cases(spark):
    long = "word </turn> " * 200_000
    rows = [(None, None, None, None), (None, 1, "assistant", long), (1, 0, "user", "same"), (1, 0, "user", "same"), (1, 0, "assistant", "same"), (2, 5, "assistant", ""), (2, None, "user", " \n")]
    rows += [(3, i, "assistant" if i % 3 else "user", f"t{i}") for i in range(600)]
    clash = ["formatted", "turns", "pieces", "t", "found", "loss_mask"]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in clash})
    assert _got(df.repartition(5)) == _want(rows)
    assert chat_format.digests(chat_format.formatted(df.where("false"))).isEmpty()


def test_no_python_in_the_plan(spark, sf):
    df = op12_chat_format(spark, sf)
    plan = df._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExistingRDD")) and plan.count("Exchange hashpartitioning") == 1 * plan.count("== Physical Plan ==")
