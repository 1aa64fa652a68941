"""Mergeable summaries of large logs, each with a stated error, and exact answers started from one.

A summary is one row per part of the log (a run, a day).  Summaries of parts merge into that of the whole, so
a new run costs only its own pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.session import checkpoint_root

QUARTILES = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}


# --------------------------------------------------------------------------- quantiles


def rank_error(k: int) -> float:
    """Error of a quantile sketch of size k, as a share of all rows, that 99 in 100 answers keep."""
    return 2.296 / k**0.9723


def quantile_sketches(rows: DataFrame, by: Sequence[str], value: Column, k: int = 800) -> DataFrame:
    """``by`` and one quantile sketch (KLL) of the values; nulls are left out, a group of nulls has an empty sketch."""
    return rows.groupBy(*by).agg(F.kll_sketch_agg_double(value.cast("double"), k).alias("sketch"))


def merge_quantiles(parts: DataFrame, by: Sequence[str], k: int = 800) -> DataFrame:
    """Sketches of parts as one sketch per coarser group."""
    return parts.groupBy(*by).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"))


def sketched_quantiles(sketches: DataFrame, points: Mapping[str, float] = QUARTILES) -> DataFrame:
    """Count and approximate quantiles of each sketch; least and largest value are exact. An empty sketch has nulls."""
    n = F.kll_sketch_get_n_double("sketch")
    found = {name: F.when(n > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(p))) for name, p in points.items()}
    keys = [c for c in sketches.columns if c != "sketch"]
    return sketches.select(*keys, n.alias("n"), *[c.alias(name) for name, c in found.items()])


def rank_distance(rows: DataFrame, by: str, value: Column, found: DataFrame, points: Mapping[str, float] = QUARTILES) -> DataFrame:
    """How far, as a share of the group's rows, each found quantile lies from the place it stands for.

    ``found`` has one row per group.  A value that many rows share covers all their places.
    """
    values = rows.select(F.col(by).alias("_by"), value.cast("double").alias("_v")).filter("_v is not null")
    pairs = values.join(found, F.equal_null("_by", by))
    below = {name: F.count_if(F.col("_v") < F.col(name)) for name in points}
    upto = {name: F.count_if(F.col("_v") <= F.col(name)) for name in points}
    n = F.count(F.lit(1))
    return pairs.groupBy(by).agg(
        n.alias("n"), *[F.greatest(below[x] / n - p, p - upto[x] / n, F.lit(0.0)).alias(x) for x, p in points.items()]
    )


# --------------------------------------------------------------------------- distinct values


def distinct_error(lg_k: int) -> float:
    """Relative standard error of merged distinct-count sketches of 2 ** lg_k registers."""
    return 1.04 / 2 ** (lg_k / 2)


def distinct_sketches(rows: DataFrame, by: Sequence[str], dimensions: Sequence[str], lg_k: int = 12) -> DataFrame:
    """``by`` and one distinct-count sketch (HyperLogLog) per dimension; null counts as ``unknown``."""
    named = [F.hll_sketch_agg(F.coalesce(F.col(d).cast("string"), F.lit("unknown")), lg_k).alias(d) for d in dimensions]
    return rows.groupBy(*by).agg(*named)


def sketched_dimensions(parts: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """(dimension, estimate, comparable) over the union of the parts' sketches; without parts every estimate is 0."""
    whole = parts.agg(*[F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(d)), F.lit(0)).alias(d) for d in dimensions])
    listed = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("estimate")) for d in dimensions])
    return whole.select(F.inline(listed)).withColumn("comparable", F.col("estimate") > 1)


# --------------------------------------------------------------------------- frequent texts


def text_buckets(rows: DataFrame, text: str, buckets: int = 1 << 16) -> DataFrame:
    """(bucket, n): rows per hash bucket of the text. ``n`` is an upper bound for every text of the bucket.

    Tables of parts merge by adding ``n`` per bucket; there are never more than ``buckets`` rows.
    """
    return rows.groupBy(_bucket(text, buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def frequent_texts(rows: DataFrame, text: str, n: int = 3, buckets: int = 1 << 16, first: int = 64) -> DataFrame:
    """The ``n`` most frequent texts with exact counts; ties go to the smaller text, null is a text (the smallest).

    Made for texts that are mostly different, where a count per text would shuffle nearly all rows:

    1. rows are counted per hash bucket, which bounds the count of each text from above;
    2. texts of the ``first`` fullest buckets are counted exactly, and the n-th of them bounds the n-th
       of all from below (0 if there are fewer);
    3. texts of every bucket that reaches this bound are counted exactly.

    A text left out stands in a bucket below the bound, so the answer is that of a full count.
    """
    checkpoint_root(rows.sparkSession)
    rows = rows.select(F.col(text).alias("_text"), _bucket(text, buckets).alias("_bucket"))
    sizes = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows")).checkpoint()

    def counted(some: DataFrame) -> DataFrame:
        # at most one row of two numbers per bucket, so broadcasting them is safe
        inside = rows.join(F.broadcast(some.select("_bucket")), "_bucket")
        return inside.groupBy("_text").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "_text").limit(n)

    fullest = counted(sizes.orderBy(F.desc("_rows"), "_bucket").limit(first))
    bound = fullest.agg(F.when(F.count(F.lit(1)) == n, F.min("count")).otherwise(0)).scalar()
    return counted(sizes.filter(F.col("_rows") >= bound)).select(F.col("_text").alias(text), "count")


def _bucket(text: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(buckets))
