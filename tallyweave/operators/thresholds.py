"""Least and best quantities of products: a global row, which a store's own row overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.loose import first_truthy

EVERY_STORE = "*"


def _is_global():
    return F.col("store_id").isNull() | (F.col("store_id").cast("string") == EVERY_STORE)


def resolved(pairs: DataFrame, thresholds: DataFrame) -> DataFrame:
    """pairs (store_id, product_id and whatever else) with min_qty and optimum_qty: the store's row as a whole, else the global one.

    Of several rows of one key the least (min_qty, optimum_qty) counts, nulls first: a table has no first row.
    """
    least = F.min(F.struct("min_qty", "optimum_qty"))
    own = thresholds.where(~_is_global()).groupBy("store_id", "product_id").agg(least.alias("own"))
    common = thresholds.where(_is_global()).groupBy("product_id").agg(least.alias("common"))
    joined = pairs.join(own, ["store_id", "product_id"], "left").join(common, "product_id", "left").withColumn("t", F.coalesce("own", "common"))
    return joined.select(*pairs.columns, F.col("t.min_qty").alias("min_qty"), F.col("t.optimum_qty").alias("optimum_qty"))


def wanted():
    """The optimum, or the least quantity where that is null or zero, or zero."""
    return first_truthy("optimum_qty", "min_qty").cast("bigint")


def shortfall(stock: DataFrame, thresholds: DataFrame) -> DataFrame:
    """store_id, product_id, on_hand, optimum, shortfall (0 where there is none)."""
    rows = resolved(stock, thresholds).withColumn("optimum", wanted())
    return rows.select("store_id", "product_id", "on_hand", "optimum", F.greatest(F.lit(0), F.col("optimum") - F.col("on_hand")).cast("bigint").alias("shortfall"))


def low_stock(stock: DataFrame, thresholds: DataFrame) -> DataFrame:
    """store_id, product_id, on_hand, min_qty of what is below its least quantity."""
    return resolved(stock, thresholds).where(F.col("on_hand") < F.col("min_qty")).select("store_id", "product_id", "on_hand", F.col("min_qty").cast("bigint").alias("min_qty"))


def upserted(base: DataFrame, edits: DataFrame) -> DataFrame:
    """store_key, product_id, min_qty, optimum_qty: base with edits over it; an edit that is null in a column keeps what was there."""
    def keyed(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.coalesce(F.col("store_id").cast("string"), F.lit(EVERY_STORE)).alias("store_key"), "product_id", F.struct("min_qty", "optimum_qty").alias(name))

    both = keyed(base, "old").join(keyed(edits, "new"), ["store_key", "product_id"], "full_outer")
    pick = lambda c: F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}")).cast("bigint").alias(c)
    return both.select("store_key", "product_id", pick("min_qty"), pick("optimum_qty"))


def saved_count(products: DataFrame, edits: DataFrame) -> DataFrame:
    """saved: how many active products have an edit."""
    named = products.where(~F.col("active").eqNullSafe(F.lit(False))).select(F.col("id").alias("product_id"))
    return named.join(edits.select("product_id"), "product_id", "left_semi").agg(F.count("*").alias("saved"))


def stock_take_draft(counted: DataFrame, thresholds: DataFrame) -> DataFrame:
    """store_id, product_id, qty to order for each counted line that is below its optimum."""
    rows = resolved(counted, thresholds).withColumn("optimum", wanted())
    return rows.where((F.col("optimum") != 0) & (F.col("counted") < F.col("optimum"))).select("store_id", "product_id", (F.col("optimum") - F.col("counted")).cast("bigint").alias("qty"))
