"""Repair of the structure of conversations: the cheapest edits after which roles follow system? (user assistant)+, or nothing is left.

A turn is kept (0), gets the role of a user or an assistant (3), or is deleted (4); an empty turn of either can be put in anywhere
(3). Blank turns and those said before must be deleted; one that breaks off costs 3 more if it stays. Of equally cheap edits
those whose initials K, R, D, I come first in ASCII are taken.

Spark collects and sorts the turns of each conversation, finds faults with array expressions, and deals conversations by the hash
of conv_id to batches of bounded bytes. Within a batch DuckDB runs one recursive query over all of its conversations: each
recursion advances one turn and keeps, for each state of the grammar, the least cost and its audit. A conversation of more than
CHUNK turns is cut: each of its chunks is worked out from every state that it may begin in, so that the depth of recursion is
bounded, and a second recursion puts chunks together. Only a letter for each turn enters DuckDB, and only audits leave it; the
edits are made by Spark.

That the least (cost, audit) of each state suffices: a turn's edits read I*, then K, R or D, so no audit of a number of turns is
the beginning of another of the same number, and what is appended can't change which of two comes first.

Defined cases: a null is one space in every column but for the order, in which turns with a null number come first; turns of equal
numbers go by role, then text; rows with a null conv_id are one conversation; other columns are ignored; an empty table gives an
empty result. A conversation is one row, so it has to fit in one (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import mapped_rows

#: Turns that a recursion goes through.
CHUNK = 64
FIGURES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
_SPACE, _ENDS, _LEGAL = " \t\n\v\f\r", ".!?", ("su", "ua", "au")

# States of the grammar: 0 nothing yet, 1 after a system turn, 2 after a user, 3 after an assistant.
# Costs of the edits.
_COSTS = {"R": 3, "D": 4, "I": 3, "broken": 3}
#: The batch table has c and letters: for each turn s, u, a or x by its role, in upper case if it breaks off, d if it must go.
_SQL = f"""
WITH RECURSIVE
puts(s, t, n) AS (VALUES (0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (0, 2, 1), (0, 3, 2), (1, 2, 1), (1, 3, 2), (2, 3, 1), (3, 2, 1)),
outs(role, s, t) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
letters(letter) AS (SELECT unnest(['s', 'u', 'a', 'x', 'S', 'U', 'A', 'X', 'd'])),
single(letter, s, t, cost, edit) AS (
    SELECT letter, s, s, {_COSTS["D"]}, 'D' FROM letters, (VALUES (0), (1), (2), (3)) v(s)
    UNION ALL SELECT letter, s, t, CASE WHEN letter = upper(letter) THEN {_COSTS["broken"]} ELSE 0 END, 'K' FROM letters JOIN outs ON lower(letter) = role
    UNION ALL SELECT letter, s, t, {_COSTS["R"]} + CASE WHEN letter = upper(letter) THEN {_COSTS["broken"]} ELSE 0 END, 'R' FROM letters, outs WHERE letter <> 'd' AND role <> 's'),
edits AS (
    SELECT letter, puts.s, single.t, min({{'cost': n * {_COSTS["I"]} + cost, 'audit': repeat('I', n) || edit}}) AS best
    FROM puts JOIN single ON puts.t = single.s GROUP BY letter, puts.s, single.t),
lines AS (SELECT c, unnest(range(length(letters))) AS place, unnest(string_split(letters, '')) AS letter FROM batch WHERE letters <> ''),
turns AS MATERIALIZED (SELECT c, place // $chunk AS k, place % $chunk AS i, letter FROM lines),
step(c, k, b, i, s, cost, audit) AS (
    SELECT c, k, b, CAST(0 AS BIGINT), b, 0, '' FROM (SELECT DISTINCT c, k FROM turns), (VALUES (0), (1), (2), (3)) v(b) WHERE k > 0 OR b = 0
    UNION ALL
    SELECT c, k, b, i + 1, t, best.cost, best.audit FROM (
        SELECT step.c, step.k, step.b, step.i, edits.t, min({{'cost': step.cost + edits.best.cost, 'audit': step.audit || edits.best.audit}}) AS best
        FROM step JOIN turns ON step.c = turns.c AND step.k = turns.k AND step.i = turns.i JOIN edits ON edits.letter = turns.letter AND edits.s = step.s
        GROUP BY step.c, step.k, step.b, step.i, edits.t)),
sizes AS (SELECT c, k, count(*) AS n FROM turns GROUP BY c, k),
ends AS MATERIALIZED (SELECT step.c, step.k, b, s, cost, audit FROM step JOIN sizes ON step.c = sizes.c AND step.k = sizes.k AND i = n),
joined(c, k, s, cost, audit) AS (
    SELECT c, k, s, cost, audit FROM ends WHERE k = 0
    UNION ALL
    SELECT c, k, s, best.cost, best.audit FROM (
        SELECT ends.c, ends.k, ends.s, min({{'cost': joined.cost + ends.cost, 'audit': joined.audit || ends.audit}}) AS best
        FROM joined JOIN ends ON ends.c = joined.c AND ends.k = joined.k + 1 AND ends.b = joined.s GROUP BY ends.c, ends.k, ends.s)),
last AS (SELECT c, max(k) AS k FROM sizes GROUP BY c),
found AS (
    SELECT joined.c, min({{'cost': cost + n * {_COSTS["I"]}, 'audit': audit || repeat('I', n)}}) AS best
    FROM joined JOIN last ON joined.c = last.c AND joined.k = last.k JOIN puts ON puts.s = joined.s AND puts.t IN (0, 3) GROUP BY joined.c)
SELECT batch.c, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit FROM batch LEFT JOIN found ON batch.c = found.c ORDER BY batch.c"""


def _cheapest(frames, chunk: int):
    """For each Arrow batch its columns but letters, with cost and audit."""
    import duckdb
    import pyarrow as pa

    con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
    for frame in frames:
        if not frame.num_rows:
            continue
        con.register("batch", pa.table({"c": pa.array(range(frame.num_rows), pa.int64()), "letters": frame.column("letters")}))
        found = con.execute(_SQL, {"chunk": chunk}).fetchall()
        con.unregister("batch")
        kept = [n for n in frame.schema.names if n != "letters"]
        made = [pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.string())]
        yield pa.RecordBatch.from_arrays([*(frame.column(n) for n in kept), *made], names=[*kept, "cost", "audit"])


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (array of turn, role, text in order) from rows of conv_id, turn, role, text; nulls but of turn as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = conversations.select("conv_id", F.struct(F.col("turn").cast("bigint").alias("turn"), space("role"), space("text")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations, as turns() has them, with faults by the check sum of conv_id:turn: rows dropped, emptied, cut, repeated, or said by a user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(space("role")).alias("role"), fault.alias("fault"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text")).alias("text"))
    # what is dropped stays as no copies, so that its conversation is there still
    copies = F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1)
    t = F.array_repeat(F.struct(F.col("turn").cast("bigint").alias("turn"), "role", "text"), copies)
    return rows.select("conv_id", t.alias("t")).groupBy("conv_id").agg(F.sort_array(F.flatten(F.collect_list("t"))).alias("turns"))


def _faults(rows: DataFrame) -> DataFrame:
    """rows of conv_id, turns with letters, and counts of what is wrong with the turns as they are."""
    # sorted by what is said, a turn said before follows one that says the same; sorted by place again, flags stand as the turns do
    said = F.sort_array(F.transform("turns", lambda t, i: F.struct(t["role"].alias("role"), t["text"].alias("text"), i.alias("i"))))
    rows = rows.select("conv_id", "turns", said.alias("said"))
    before = F.concat(F.array(F.lit(None).cast("struct<role: string, text: string, i: int>")), F.slice("said", F.lit(1), F.size("said")))
    same = lambda p: (p["x"]["role"] == p["y"]["role"]) & (p["x"]["text"] == p["y"]["text"])
    pairs = F.slice(F.arrays_zip(F.col("said").alias("x"), before.alias("y")), F.lit(1), F.size("said"))
    rows = rows.select("conv_id", "turns", F.sort_array(F.transform(pairs, lambda p: F.struct(p["x"]["i"].alias("i"), F.coalesce(same(p), F.lit(False)).alias("again")))).alias("flags"))

    def judged(p: Column) -> Column:
        text = F.rtrim(p["t"]["text"], F.lit(_SPACE))
        fault = F.when(text == "", "blank").when(p["f"]["again"], "duplicate").when(~F.substring(text, -1, 1).isin(*_ENDS), "truncated")
        return F.struct(F.substring(p["t"]["role"], 1, 1).alias("initial"), fault.alias("fault"))

    rows = rows.select("conv_id", "turns", F.transform(F.arrays_zip(F.col("turns").alias("t"), F.col("flags").alias("f")), judged).alias("judged"))

    def letter(j: Column) -> Column:
        role = F.when(j["initial"].isin("s", "u", "a"), j["initial"]).otherwise("x")
        return F.when(j["fault"].isin("blank", "duplicate"), "d").when(j["fault"] == "truncated", F.upper(role)).otherwise(role)

    count = lambda fault: F.size(F.filter("judged", lambda j: j["fault"] == fault)).cast("long").alias(fault)
    initials = F.transform("judged", lambda j: j["initial"])
    next_to = F.arrays_zip(F.slice(initials, F.lit(1), F.greatest(F.size(initials) - 1, F.lit(0))).alias("x"), F.slice(initials, F.lit(2), F.size(initials)).alias("y"))
    illegal = F.size(F.filter(next_to, lambda p: ~F.concat(p["x"], p["y"]).isin(*_LEGAL))).cast("long")
    numbers = F.filter(F.transform("turns", lambda t: t["turn"]), lambda n: n.isNotNull())
    gaps = F.coalesce(F.array_max(numbers) - F.array_min(numbers) + 1 - F.size(F.array_distinct(numbers)), F.lit(0)).cast("long")
    return rows.select("conv_id", "turns", gaps.alias("gaps"), count("blank"), count("duplicate"), count("truncated"), illegal.alias("illegal"), F.array_join(F.transform("judged", letter), "").alias("letters"))


def _edited(rows: DataFrame) -> DataFrame:
    """rows of turns and audit with the repaired conversation, an array of role and text.

    Roles that edits give are known by their place: after a leading system turn, users and assistants take turns.
    """
    none = F.lit(None).cast("string")
    item = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    put_in = lambda n: F.array_repeat(item(none, F.lit("")), n)

    def made(p: Column) -> Column:
        edit = F.substring(p["e"], -1, 1)
        stays = F.array(item(F.when(edit == "K", p["t"]["role"]), p["t"]["text"]))
        return F.concat(put_in(F.length(p["e"]) - 1), F.when(edit == "D", put_in(F.lit(0))).otherwise(stays))

    each = F.arrays_zip(F.col("turns").alias("t"), F.regexp_extract_all("audit", F.lit("(I*[KRD])"), F.lit(1)).alias("e"))
    rows = rows.withColumn("repaired", F.concat(F.flatten(F.transform(each, made)), put_in(F.length(F.regexp_extract("audit", r"(I*)\z", 1)))))
    first = F.try_element_at("repaired", F.lit(1))["role"]
    rows = rows.withColumn("lead", F.when(F.substring(first, 1, 1) == "s", 1).otherwise(0))
    by_place = lambda i: F.when((i - F.col("lead")) % 2 == 0, "user").otherwise("assistant")
    return rows.withColumn("repaired", F.transform("repaired", lambda x, i: item(F.coalesce(x["role"], by_place(i)), x["text"]))).drop("lead")


def repaired(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Conversations, as turns() has them, with gaps, blank, duplicate, truncated, illegal, cost (long), audit and the repaired turns (role, text)."""
    found = _faults(rows)
    fields = [f for f in found.schema if f.name != "letters"]
    schema = T.StructType([*fields, T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())])
    return _edited(mapped_rows(found, lambda frames: _cheapest(frames, chunk), schema))


def digests(done: DataFrame) -> DataFrame:
    """Repaired conversations with the digest of their turns in place of these."""
    text = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return done.select("conv_id", *FIGURES, F.sha2(text, 256).alias("repaired_sha256"))
