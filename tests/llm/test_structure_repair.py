import hashlib
import re
import zlib
from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyweave.llm import structure_repair
from tallyweave.llm.queries import op13_structure_repair
from tallyweave.llm.shared import read_table

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\v\f\r"


def _cheapest(turns):
    """(cost, audit, repaired) by trying all edits towards every conversation that the grammar allows."""
    seen, faults = set(), []
    for role, text in turns:
        said = text.rstrip(SPACE)
        faults.append("gone" if not said or (role, text) in seen else "broken" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    found = []

    def go(i, target, cost, audit, made):
        if i == len(turns) and not target:
            found.append((cost, audit, made))
        if i < len(turns):
            (role, text), fault = turns[i], faults[i]
            go(i + 1, target, cost + 4, audit + "D", made)
            if target and fault != "gone":
                extra = 3 * (fault == "broken")
                if role[:1] == target[0]:
                    go(i + 1, target[1:], cost + extra, audit + "K", [*made, (role, text)])
                if target[0] != "s":
                    go(i + 1, target[1:], cost + 3 + extra, audit + "R", [*made, ({"u": "user", "a": "assistant"}[target[0]], text)])
        if target and target[0] != "s":
            go(i, target[1:], cost + 3, audit + "I", [*made, ({"u": "user", "a": "assistant"}[target[0]], "")])

    for n in range(len(turns) // 2 + 2):
        for head in ("", "s") if n else ("",):
            go(0, head + "ua" * n, 0, "", [])
    return min(found, key=lambda x: x[:2])


TURNS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", None]), st.sampled_from(["A b.", "C d", " ", "E!\n", "", "é?", None])), max_size=5)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(TURNS, min_size=1, max_size=8))
def test_brute_force(spark, conversations):
    rows = [(c, i, role, text) for c, turns in enumerate(conversations) for i, (role, text) in enumerate(turns)]
    df = structure_repair.turns(spark.createDataFrame(rows, SCHEMA))
    for chunk in (2, 64):
        got = {r["conv_id"]: (r["cost"], r["audit"], [tuple(x) for x in r["repaired"]]) for r in structure_repair.repaired(df, chunk).collect()}
        space = lambda x: " " if x is None else x
        assert got == {c: _cheapest([(space(r), space(t)) for r, t in turns]) for c, turns in enumerate(conversations) if turns}


def _figures(rows) -> dict:
    """What the query returns, but for cost, audit and repair: damage and faults worked out turn by turn."""
    space = lambda x: " " if x is None else x
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = "user" if fault == 4 else space(role), "" if fault == 1 else re.sub("[.!?]", "", space(text)) if fault == 2 else space(text)
        groups[conv] += [(turn is not None, turn or 0, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    out = {}
    for conv, found in groups.items():
        found.sort()
        seen, counts = set(), dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, _, role, text in found:
            said = text.rstrip(SPACE)
            fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None
            if fault:
                counts[fault] += 1
            seen.add((role, text))
        numbers = {n for known, n, _, _ in found if known}
        initials = [role[:1] for _, _, role, _ in found]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out[conv] = (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *counts.values(), illegal)
    return out


def test_hard_cases(spark):
    long = "a sentence. " * 100_000 + "end"
    rows = [(None, None, None, None), (None, 1, "assistant", long), (1, 0, "user", "same."), (1, 0, "user", "same."), (1, 0, "assistant", "same."), (2, 5, "assistant", ""), (2, None, "user", " \n"), (2, 2**60, "user", "far.")]
    rows += [(3, i, "assistant" if i % 3 else "user", f"t{i}.") for i in range(500)]
    rows += [(c, 0, "user", "x.") for c in range(100, 160)]  # some of these lose their only turn
    clash = ["turns", "letters", "c", "audit", "said", "flags", "judged", "fault"]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in clash}).repartition(5)
    done = structure_repair.digests(structure_repair.repaired(structure_repair.damaged(df))).collect()
    assert {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal")) for r in done} == _figures(rows)
    nothing = [r for r in done if not r["audit"]]
    assert nothing and all(r["cost"] == 0 and r["repaired_sha256"] == hashlib.sha256(b"").hexdigest() for r in nothing)
    chunks = [{r["conv_id"]: (r["cost"], r["audit"]) for r in structure_repair.repaired(structure_repair.damaged(df), n).collect()} for n in (7, 1000)]
    assert chunks[0] == chunks[1]
    assert structure_repair.digests(structure_repair.repaired(structure_repair.damaged(df.where("false")))).isEmpty()


def test_every_conversation_follows_the_grammar(spark, sf):
    rows = read_table(spark, sf, "conversations")
    done = structure_repair.repaired(structure_repair.damaged(rows)).collect()
    assert len(done) == rows.select("conv_id").distinct().count() == op13_structure_repair(spark, sf).count()
    assert all(re.fullmatch("(s?(ua)+)?", "".join(t["role"][:1] for t in r["repaired"])) for r in done)
    assert all(sum(x != "I" for x in r["audit"]) == len(r["turns"]) for r in done)
