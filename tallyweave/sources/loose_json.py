"""Import of loose JSON: documents are parsed as VARIANT and fields taken by type; what doesn't fit is kept with the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import _parse_datatype_string

from ..functions.loose import whole_number
from ..schemas import SCHEMAS

# Why a row is rejected.
NOT_JSON, NOT_AN_OBJECT, NO_ROWS = "not JSON", "not an object", "no array of rows"


def _is_object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT<")


def _is_null(v: Column, path: str) -> Column:
    """Whether a field is absent or null."""
    found = F.try_variant_get(v, path, "variant")
    return found.isNull() | F.coalesce(F.is_variant_null(found), F.lit(True))


def typed(rows: DataFrame, schema: str, variant: str = "v", loose: tuple[str, ...] = (), names: dict[str, str] | None = None) -> DataFrame:
    """rows with the fields of a VARIANT column as columns of schema, and problem: null, or why the row doesn't fit.

    A field that is absent or null is null. One that is there but isn't of its type makes the row unfit, but for those in `loose`,
    whole numbers that may be text: what these begin with counts, else 0. names: of fields in JSON, where they differ.
    """
    v, fields = F.col(variant), _parse_datatype_string(schema).fields
    path = lambda f: f"$.{(names or {}).get(f.name, f.name)}"

    def value(f: T.StructField) -> Column:
        got = F.try_variant_get(v, path(f), f.dataType.simpleString())
        if f.name not in loose:
            return got
        is_text = F.schema_of_variant(F.try_variant_get(v, path(f), "variant")) == "STRING"
        return F.coalesce(got, F.when(is_text, whole_number(F.try_variant_get(v, path(f), "string"))))

    wrong = [F.when(~_is_null(v, path(f)) & value(f).isNull(), F.lit(f"{f.name} is not {f.dataType.simpleString()}")) for f in fields]
    problem = F.when(v.isNull(), NOT_JSON).when(~_is_object(v), NOT_AN_OBJECT).otherwise(F.coalesce(*wrong) if len(wrong) > 1 else wrong[0])
    return rows.select(*(c for c in rows.columns if c != variant), *(value(f).alias(f.name) for f in fields), problem.alias("problem"))


def parsed(texts: DataFrame, text: str = "value") -> DataFrame:
    """texts with v, the VARIANT of a column of JSON text; null where it isn't JSON."""
    return texts.withColumn("v", F.try_parse_json(text))


def import_table(spark: SparkSession, path: str, table: str, loose: tuple[str, ...] = ("qty",), names: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """One table of exports in JSON (objects that hold an array of rows for each table): the rows that fit, and rejects (file, row, problem).

    A file that isn't JSON or has no such array is one reject; one row that doesn't fit is a reject and the others of its file stay.
    """
    files = parsed(spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("file")))
    found = F.try_variant_get("v", f"$.{table}", "array<variant>")
    whole = F.when(F.col("v").isNull(), NOT_JSON).when(found.isNull(), NO_ROWS)
    bad_files = files.where(whole.isNotNull()).select("file", F.col("value").alias("row"), whole.alias("problem"))
    rows = files.select("file", F.explode(found).alias("v")).withColumn("row", F.to_json("v"))
    done = typed(rows, SCHEMAS[table], loose=loose, names=names)
    good = done.where("problem is null").drop("file", "row", "problem")
    return good, bad_files.unionByName(done.where("problem is not null").select("file", "row", "problem"))


def shape(texts: DataFrame, text: str = "value") -> DataFrame:
    """shape: the type that all JSON texts have in common, worked out from all of them."""
    return parsed(texts, text).agg(F.schema_of_variant_agg("v").alias("shape"))


def problems(done: DataFrame) -> DataFrame:
    """problem, n, of typed() rows; those that fit have none."""
    return done.groupBy("problem").agg(F.count("*").alias("n"))
