"""Column forms of the loose value rules that ledger records are written by."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_truthy(*values: Column | str, default=0) -> Column:
    """The first value that is neither null nor zero, else `default`. For text use first_text."""
    return F.coalesce(*(F.nullif(F.col(v) if isinstance(v, str) else v, F.lit(0)) for v in values), F.lit(default))


def first_text(*values: Column | str, default: str = "") -> Column:
    """The first value that is neither null nor empty, else `default`."""
    return F.coalesce(*(F.nullif(F.col(v) if isinstance(v, str) else v, F.lit("")) for v in values), F.lit(default))


def whole_number(text: Column | str) -> Column:
    """The integer that a text begins with after white space, 0 where there is none or it exceeds 64 bits."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def is_true(condition: Column) -> Column:
    """The condition, null being false."""
    return F.coalesce(condition, F.lit(False))


def every(items: Column | str, test) -> Column:
    """Whether all items pass; true for an empty or null array, an undecided test counts as failed."""
    return F.coalesce(F.forall(items, lambda x: is_true(test(x))), F.lit(True))


def some(items: Column | str, test) -> Column:
    """Whether any item passes; false for an empty or null array."""
    return F.coalesce(F.exists(items, lambda x: is_true(test(x))), F.lit(False))


def first_where(items: Column | str, test) -> Column:
    """The first item that passes, in the order of the array; null where none does."""
    return F.try_element_at(F.filter(items, lambda x: is_true(test(x))), F.lit(1))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def iso_time(ts: Column | str) -> Column:
    """yyyy-MM-ddTHH:mm:ss.SSSZ of a UTC timestamp."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def wire_id(*parts: Column | str) -> Column:
    """A deterministic identifier from its parts, so that a task that runs again makes the same one."""
    return F.concat_ws("_", *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts))
