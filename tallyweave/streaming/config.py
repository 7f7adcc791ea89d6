"""Where a session's pulls and pushes go: from the service's configuration, kept for as long as the session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.loose import first_where
from .paged import post

# The kind of item that holds the addresses, and their names in it.
KIND, PUSH, PULL = "sync_config", "pushUrl", "pullUrl"
_KEPT = {PUSH: "tallyweave.sync.push", PULL: "tallyweave.sync.pull"}


def fetched(spark: SparkSession, answer: dict) -> dict[str, str]:
    """The addresses in an answer {items: [{ConfigType, ConfigData}]}, of its first item of the kind; none unless both are there.

    ConfigData is JSON text or an object.
    """
    import json

    items = answer.get("items")
    rows = [(str(x.get("ConfigType")), d if isinstance(d := x.get("ConfigData"), str) else json.dumps(d)) for x in items if isinstance(x, dict)] if isinstance(items, list) else []
    one = spark.createDataFrame([(rows,)], "items array<struct<kind: string, data: string>>").select(first_where("items", lambda i: i["kind"] == KIND)["data"].alias("data"))
    found = one.select(F.try_variant_get(v := F.try_parse_json("data"), f"$.{PUSH}", "string").alias(PUSH), F.try_variant_get(v, f"$.{PULL}", "string").alias(PULL)).first().asDict()
    return found if all(found.values()) else {}


def load(spark: SparkSession, url: str | None = None, fetch: Callable[[dict], dict] | None = None) -> dict[str, str]:
    """The addresses, from the service at url if it answers, else those that the session has kept; empty if there are none."""
    found: dict[str, str] = {}
    if url or fetch:
        try:
            found = fetched(spark, (fetch or (lambda body: post(url, body)))({}))
        except (OSError, ValueError):  # not there, or no JSON
            found = {}
    if found:
        save(spark, found[PUSH], found[PULL])
        return found
    kept = {name: spark.conf.get(key, None) for name, key in _KEPT.items()}
    return kept if all(kept.values()) else {}


def save(spark: SparkSession, push: str, pull: str) -> None:
    """Keeps addresses in the session, never beyond it."""
    spark.conf.set(_KEPT[PUSH], push)
    spark.conf.set(_KEPT[PULL], pull)


def clear(spark: SparkSession) -> None:
    for key in _KEPT.values():
        spark.conf.unset(key)
