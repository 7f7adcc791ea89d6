r"""Chat formatting by relational means: a conversation's turns as one marked text, with a loss mask, in Spark expressions only.

The turns of a conversation are collected as structs and sorted; an array aggregation merges adjacent turns of one role into a
block; blocks are concatenated:

    ### User:
    text of a turn
    <turn>
    text of the next turn of the same role
    </turn>

A control string (### with a space, <turn>, </turn>) inside a text gets a backslash before it, whatever stands there already, and
reading takes one away again: in a formatted text a control string without a backslash before it is a mark. Marks follow a line
end of their own, so that a text may end with a backslash. User, Assistant and System stand for the roles in lower case; any
other role is written =, then URL-encoded. Turns are read back by splitting at the marks, and what a model learns from by the
spans of the loss mask, which hold the assistant's texts and no marks.

Defined cases: null texts and roles are empty; turns with a null number come first, and equal numbers go by role, then text;
repeated rows are turns of their own; rows with a null conv_id are one conversation; other columns are ignored; an empty table
gives an empty result. One conversation is one training example: it is one row, so it has to fit in one (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The roles that have names of their own in the template.
NAMES = {"user": "User", "assistant": "Assistant", "system": "System"}
LEARNED = "assistant"
_CONTROL = r"(</?turn>|### )"
_OPEN, _COLON, _NEXT, _CLOSE = "### ", ":\n", "\n<turn>\n", "\n</turn>\n"
_TURNS = "array<struct<role: string, text: string>>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\" + _CONTROL, "$1")


def _named(role: Column) -> Column:
    out = F.concat(F.lit("="), F.url_encode(role))
    for known, name in NAMES.items():
        out = F.when(role == known, F.lit(name)).otherwise(out)
    return out


def _role(name: Column) -> Column:
    out = F.url_decode(F.substring(name, 2, 1 << 30))
    for known, own in NAMES.items():
        out = F.when(name == own, F.lit(known)).otherwise(out)
    return out


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text in order), from rows of conv_id, turn, role, text."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select("conv_id", F.struct("turn", empty("role"), empty("text")).alias("t"))
    found = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("found"))
    return found.select("conv_id", F.transform("found", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _blocks(found: Column) -> Column:
    """Adjacent turns of one role as one: an array of role, texts."""
    none = F.array().cast("array<struct<role: string, texts: array<string>>>")
    block = lambda role, texts: F.array(F.struct(role.alias("role"), texts.alias("texts")))

    def add(done: Column, t: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), block(t["role"], F.concat(last["texts"], F.array(t["text"]))))
        return F.when(last["role"].eqNullSafe(t["role"]), longer).otherwise(F.concat(done, block(t["role"], F.array(t["text"]))))

    return F.aggregate(found, none, add)


def _pieces(blocks: Column) -> Column:
    """The formatted text in pieces: marks, and texts, of which those to learn from have learn."""
    piece = lambda chars, learn: F.struct(chars.alias("chars"), learn.alias("learn"))

    def of(b: Column) -> Column:
        mark = lambda i: F.when(i == 0, F.concat(F.lit(_OPEN), _named(b["role"]), F.lit(_COLON))).otherwise(F.lit(_NEXT))
        texts = F.transform(b["texts"], lambda x, i: F.array(piece(mark(i), F.lit(False)), piece(escaped(x), b["role"] == LEARNED)))
        return F.concat(F.flatten(texts), F.array(piece(F.lit(_CLOSE), F.lit(False))))

    return F.flatten(F.transform(blocks, of))


def _spans(pieces: Column) -> Column:
    """start (from 0) and length, in code points, of the pieces to learn from."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: bigint, length: bigint>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        n = F.length(p["chars"]).cast("long")
        span = F.array(F.struct(acc["at"].alias("start"), n.alias("length")))
        return F.struct((acc["at"] + n).alias("at"), F.when(p["learn"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(pieces, start, step, lambda acc: acc["spans"])


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_mask (array of start, length) from rows of conv_id, turn, role, text."""
    pieces = turns(conversations).select("conv_id", _pieces(_blocks(F.col("turns"))).alias("pieces"))
    text = F.array_join(F.transform("pieces", lambda p: p["chars"]), "")
    return pieces.select("conv_id", text.alias("formatted"), _spans(F.col("pieces")).alias("loss_mask"))


def read_turns(text: Column) -> Column:
    """The turns (role, text) of a formatted text."""

    def of(block: Column) -> Column:
        name = F.substring_index(block, _COLON, 1)
        role = _role(F.substr(name, F.lit(len(_OPEN) + 1)))
        body = F.substr(block, F.length(name) + len(_COLON) + 1)
        return F.transform(F.split(body, _NEXT), lambda x: F.struct(role.alias("role"), unescaped(x).alias("text")))

    blocks = F.split(text, _CLOSE)
    return F.flatten(F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), of)).cast(_TURNS)


def read_learned(text: Column, mask: Column) -> Column:
    """The texts under the loss mask, in order."""
    return F.transform(mask, lambda s: unescaped(F.substr(text, (s["start"] + 1).cast("int"), s["length"].cast("int"))))


def digests(done: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of formatted conversations, read back from them."""
    read = done.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), F.array_join(read_learned(F.col("formatted"), F.col("loss_mask")), "").alias("learned"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    count = lambda c: F.length(c).cast("long")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), count("learned").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), count("formatted").alias("formatted_chars"),
    )
