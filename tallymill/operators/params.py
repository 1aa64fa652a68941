"""Free-form parameters as variants: what they hold, found by aggregation, and typed reading of any path."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_variant(params: Column) -> Column:
    """JSON text as a variant; null for null and for text that is not JSON."""
    return F.try_parse_json(params)


def value_class(value: Column) -> Column:
    """``object``, ``list``, ``text``, ``flag``, ``none`` or ``number`` of a variant."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("ARRAY"), "list")
        .when(kind == "STRING", "text")
        .when(kind == "BOOLEAN", "flag")
        .when(kind == "VOID", "none")
        .otherwise("number")
    )


def param_schema(rows: DataFrame, by: Sequence[str], params: str = "task_params") -> DataFrame:
    """Rows, rows that are not JSON (null is neither) and the merged schema of all others, nested fields included, per group.

    The schema is an aggregate with partial results, so no group is gathered; fields whose types do not
    go together are ``VARIANT`` in it.
    """
    value = as_variant(F.col(params))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(params).isNotNull() & value.isNull()).alias("broken"),
        F.schema_of_variant_agg(value).alias("schema"),
    )


def param_fields(rows: DataFrame, by: Sequence[str], params: str = "task_params") -> DataFrame:
    """One row per group, top-level field and class of its values: how many rows have it.

    A field with several rows has mixed types; rows whose parameters are no object have no fields.
    """
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    held = rows.select(*keys, as_variant(F.col(params)).alias("_v")).filter(F.schema_of_variant("_v").startswith("OBJECT"))
    each = held.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("_v").outer()))
    named = each.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(by)], F.col("key").alias("field"), value_class(F.col("value")).alias("class"))
    return named.groupBy(*by, "field", "class").agg(F.count(F.lit(1)).alias("n"))


def read_params(rows: DataFrame, fields: Mapping[str, tuple[str, str]], params: str = "task_params") -> DataFrame:
    """``rows`` with a column per field, given as name: (path, type), such as ``{"unit": ("$.answer.unit", "string")}``.

    The text is parsed once per row.  A path that a row lacks, a value that does not cast and broken text read as null.
    """
    parsed = rows.withColumn("_params", as_variant(F.col(params)))
    return parsed.withColumns({name: F.try_variant_get("_params", path, kind) for name, (path, kind) in fields.items()}).drop("_params")
