"""Seeded draws from weights that are a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.operators.assemble import running, seeded_draw

#: Range of the drawn number: 13 hex digits.
DRAWS = 1 << 52


def weight_bounds(weights: DataFrame, group: str, category: str, weight: str) -> DataFrame:
    """(group, category, low, high): the half-open range of each category on its group's line of weights.

    Weights are whole numbers; those of repeated categories add up, null and non-positive ones have no range.
    Categories follow each other in their own order, whatever the number of them.
    """
    kept = weights.filter(F.col(weight) > 0).groupBy(group, category).agg(F.sum(F.col(weight).cast("long")).alias("_w"))
    placed = running(kept, [F.col(category).asc_nulls_first()], "_w", [group])
    return placed.select(group, category, F.col("_before").alias("low"), (F.col("_before") + F.col("_w")).alias("high"))


def weighted_draw(rows: DataFrame, weights: DataFrame, seed: str, identity: Sequence[str], *, group: str, category: str, weight: str, per_bin: int = 100_000) -> DataFrame:
    """``rows`` with a ``category`` drawn by the weights of their group, the same for the same seed and identity.

    A row's draw is a place on its group's line of weights.  The line is cut into bins by the number of rows and
    categories of the group, a category lies in each bin that it touches, and within a bin the category of a row is
    the last that begins at or before its place: one sort per bin, however many categories there are, and a group
    of a third of all rows spreads over many bins.  Rows of a group without weights have a null category; null is
    a group of its own.  A column of ``rows`` named like ``category`` is replaced.
    """
    bounds = weight_bounds(weights, group, category, weight)
    mine = rows.groupBy(F.col(group).alias("_group")).agg(F.count(F.lit(1)).alias("_rows"))
    lines = bounds.groupBy(F.col(group).alias("_line")).agg(F.max("high").alias("_total"), F.count(F.lit(1)).alias("_categories"))
    sized = mine.join(lines, F.equal_null("_group", "_line"), "left").select(
        "_group", "_total", F.ceil((F.col("_rows") + F.coalesce("_categories", F.lit(0))) / per_bin).alias("_bins")
    )
    digits = F.substring(seeded_draw(seed, *[F.col(c) for c in identity]), 1, 13)
    kept = [c for c in rows.columns if c != category]
    drawn = (
        rows.select(F.struct(*kept).alias("_row"), F.col(group).alias("_own"), F.conv(digits, 16, 10).cast("long").alias("_draw"))
        .join(sized, F.equal_null("_own", "_group"))
        .select("_group", "_total", "_bins", "_row", _scaled(F.col("_draw"), F.col("_total"), F.lit(DRAWS)).alias("_at"))
        .withColumn("_bin", F.coalesce(_scaled(F.col("_at"), F.col("_bins"), F.col("_total")), F.lit(-1)))
    )
    touched = F.sequence(_scaled(F.col("low"), F.col("_bins"), F.col("_total")), _scaled(F.col("high") - 1, F.col("_bins"), F.col("_total")))
    starts = (
        bounds.withColumnRenamed(group, "_own")
        .join(sized, F.equal_null("_own", "_group"))
        .select("_group", F.explode(touched).alias("_bin"), F.col("low").alias("_at"), F.struct(F.col(category).alias("name")).alias("_category"))
    )
    both = starts.withColumn("_row", F.lit(None).cast(drawn.schema["_row"].dataType)).unionByName(
        drawn.select("_group", "_bin", "_at", "_row", F.lit(None).cast(starts.schema["_category"].dataType).alias("_category"))
    )
    upto = Window.partitionBy("_group", "_bin").orderBy("_at", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    last = both.withColumn("_last", F.last("_category", ignorenulls=True).over(upto))
    return last.filter("_row is not null").select("_row.*", F.col("_last.name").alias(category))


def _scaled(a: Column, b: Column, c: Column) -> Column:
    """a * b / c rounded down, without overflow; null for a null."""
    wide = lambda x: x.cast("decimal(19,0)")
    return F.call_function("div", wide(a) * wide(b), wide(c))
