"""Plain-text sources: captured logs, delimited reference tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Metrics of a captured log and how they are written.
LOG_METRICS = {
    "accuracy": r"Avg Accuracy.*?:\s+([\d.]+)%",
    "normalized_accuracy": r"Norm(?:alized)? Accuracy.*?:\s+([\d.]+)%",
    "valid_tests": r"Valid Tests.*?:\s+(\d+/\d+)",
    "parse_errors": r"Parse Errors.*?:\s+(\d+)",
    "success_rate": r"Success Rate.*?:\s+([\d.]+)%",
    "perfect_scores": r"Perfect Scores.*?:\s+(\d+)",
}
# Length tiers of word lists.
LENGTH_TIERS = (("short", 3, 5), ("medium", 6, 9), ("long", 10, 15), ("extra_long", 16, 999))


def log_metrics(content: Column) -> dict[str, Column]:
    """Metrics of one log text; a missing number is 0, missing counts are ``0/0``."""
    out = {}
    for name, pattern in LOG_METRICS.items():
        found = F.nullif(F.regexp_extract(content, pattern, 1), F.lit(""))
        if name == "valid_tests":
            out[name] = F.coalesce(found, F.lit("0/0"))
        elif name in ("parse_errors", "perfect_scores"):
            out[name] = F.coalesce(found.try_cast("int"), F.lit(0))
        else:
            out[name] = F.coalesce(found.try_cast("double"), F.lit(0.0))
    return out


def name_parts(name: Column) -> dict[str, Column]:
    """Model and styles of ``<model>_<version>_<user>_<system>``; the styles are the last two parts."""
    parts = F.split(name, "_")
    head = F.slice(parts, 1, F.greatest(F.size(parts) - 2, F.lit(0)))
    return {
        "model": F.array_join(head, ":"),
        "user_style": F.try_element_at(parts, F.lit(-2)),
        "system_style": F.try_element_at(parts, F.lit(-1)),
    }


def read_legacy_logs(spark: SparkSession, path: str, name_pattern: str = r"([^/]+)\.[^./]+$") -> DataFrame:
    """One row per log file: metrics from the text, model and styles from its name.

    ``name_pattern`` picks the name out of the file path.
    """
    logs = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    named = logs.select("value", F.regexp_extract("_metadata.file_path", name_pattern, 1).alias("name"))
    p = name_parts(F.col("name"))
    return named.select(
        *[c.alias(n) for n, c in p.items()],
        F.concat(p["user_style"], F.lit("+"), p["system_style"]).alias("config"),
        *[c.alias(n) for n, c in log_metrics(F.col("value")).items()],
    )


def last_table_accuracy(content: Column) -> Column:
    """Percentage of the last ``| name | nn% |`` row of a captured table."""
    found = F.regexp_extract_all(content, F.lit(r"\|\s*([^|]+?)\s*\|\s*([\d.]+)%\s*\|"), F.lit(2))
    return F.try_element_at(found, F.lit(-1)).try_cast("double")


def length_tier(word: Column) -> Column:
    tier = None
    for name, low, high in LENGTH_TIERS:
        fits = F.length(word).between(low, high)
        tier = F.when(fits, name) if tier is None else tier.when(fits, name)
    return tier


def read_delimited_refs(
    spark: SparkSession, path: str, columns: Sequence[str], sep: str = ",", header: bool = False, lower: Sequence[str] = ()
) -> DataFrame:
    """Reference rows with ``#`` comments skipped, rows of another width dropped, texts trimmed, copies removed."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = (
        spark.read.schema(schema)
        .option("sep", sep)
        .option("comment", "#")
        .option("header", header)
        .option("mode", "DROPMALFORMED")
        .option("columnPruning", False)
        .csv(path)
    )
    tidy = [F.trim(F.lower(c) if c in lower else F.col(c)).alias(c) for c in columns]
    return rows.select(*tidy).dropDuplicates()


def flag(text: Column) -> Column:
    """Truth value written as text."""
    return F.lower(F.trim(text)) == "true"
