"""Small projections over response rows: tokens, displays, bands, free-form parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymill.functions.text import strip_ws

# Parameter names that may hold the expected answer, in order.
EXPECTED_KEYS = ("expected_answer", "expected_state", "expected_next_state", "expected_fallacy")


def token_estimate(*texts: Column) -> Column:
    """A quarter of the characters, rounded down."""
    total = F.lit(0)
    for text in texts:
        total = total + F.coalesce(F.length(text), F.lit(0))
    return F.floor(total / 4).cast("bigint")


def json_param(params: Column, name: str) -> Column:
    """One top-level field of a JSON text column, as text."""
    return F.get_json_object(params, f"$.{name}")


def display_value(value: Column) -> Column:
    """A scalar as is, a list joined by blanks, a list of lists joined by `` | ``."""
    rows = F.from_json(value, "array<array<string>>")
    items = F.from_json(value, "array<string>")
    two_d = F.array_join(F.transform(rows, lambda r: F.array_join(r, " ")), " | ")
    return F.coalesce(
        F.when(value.startswith("[["), two_d).when(value.startswith("["), F.array_join(items, " ")),
        value,
        F.lit("N/A"),
    )


def expected_display(params: Column) -> Column:
    """Readable expected answer from the parameters; 0 and false are values, not absences."""
    return display_value(F.coalesce(*[json_param(params, key) for key in EXPECTED_KEYS]))


def thinking_split(raw: Column, reasoning: Column) -> Column:
    """Struct of the reasoning text (or null) and the response without it."""
    raw = F.coalesce(raw, F.lit(""))
    tag = r"(?s)<think>(.*?)</think>"
    without = strip_ws(F.regexp_replace(raw, tag, ""))
    has_reasoning = F.coalesce(reasoning, F.lit("")) != ""
    has_tag = raw.rlike(tag)
    return F.struct(
        F.when(has_reasoning, reasoning).when(has_tag, strip_ws(F.regexp_extract(raw, tag, 1))).alias("thinking"),
        F.when(has_reasoning | has_tag, without).otherwise(raw).alias("clean"),
    )


def is_usable_response(status: Column, raw: Column) -> Column:
    """Finished, not blank and not a time-out notice."""
    text = F.lower(strip_ws(F.coalesce(raw, F.lit(""))))
    return (status == "success") & (text != "") & (text != "timed out")


def band(value: Column, high: float, low: float, labels: tuple[str, str, str], strict: bool = False) -> Column:
    """Three-way band.  ``strict`` uses > high and < low with the middle label between."""
    if strict:
        return F.when(value > high, labels[0]).when(value < low, labels[2]).otherwise(labels[1])
    return F.when(value >= high, labels[0]).when(value >= low, labels[1]).otherwise(labels[2])


def accuracy_badge(accuracy: Column) -> Column:
    return band(accuracy, 0.8, 0.5, ("success", "warning", "danger"))


def accuracy_class(accuracy: Column) -> Column:
    return band(accuracy, 0.7, 0.3, ("high", "med", "low"), strict=True)


def accuracy_colour(percent: Column) -> Column:
    return band(percent, 70, 50, ("green", "orange", "red"))


def stability(std_percent: Column) -> Column:
    return F.when(std_percent < 5, "stable").when(std_percent < 10, "variable").otherwise("unstable")
