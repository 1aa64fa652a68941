"""Texts matched against a whole catalogue by the words that they share."""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.functions.text import words

# Largest set that is looked up by combinations of words, most combinations of one set for one size of the other.
SMALL, COMBINATIONS = 16, 64


def _entries(texts: DataFrame, text: str) -> DataFrame:
    """(_text, _id, _words) of the distinct texts that have a word; texts of one word set have one ``_id``."""
    known = texts.select(F.col(text).alias("_text")).distinct().withColumn("_words", F.array_sort(words(F.col("_text"))))
    return known.filter(F.size("_words") > 0).withColumn("_id", F.array_join("_words", " "))


def _ordered(sets: DataFrame, rarity: DataFrame) -> DataFrame:
    """``sets`` with ``_size`` and ``_order``, their words with the rarest first."""
    listed = sets.select("_id", F.explode("_words").alias("_word")).join(rarity, "_word")
    order = F.transform(F.array_sort(F.collect_list(F.struct("_n", "_word"))), lambda x: x["_word"])
    return sets.drop("_words").join(listed.groupBy("_id").agg(order.alias("_order")), "_id").withColumn("_size", F.size("_order"))


def _least(size: Column, threshold: float) -> Column:
    """Shared words that a set of this size needs at least; rounding errors are left out of the ceiling."""
    return F.ceil(size * threshold - 1e-9).cast("int")


def _chosen(threshold: float) -> list[tuple[int, int, list[int]]]:
    """(size, other, places): the words under which a small set meets small sets of the size ``other``.

    Two sets that share at least t words share at least k of the first size - t + k of each, for every k up to t.  So
    they meet under a combination of k such words; k is as large as ``COMBINATIONS`` allows, one at least.
    """
    out = []
    for a in range(1, SMALL + 1):
        for b in range(ceil(threshold * a - 1e-9), SMALL + 1):
            if ceil(threshold * b - 1e-9) > a:
                break
            t = max(1, ceil(threshold * (a + b) / (1 + threshold) - 1e-9))
            most = max(a, b) - t
            k = max(k for k in range(1, t + 1) if k == 1 or comb(most + k, k) <= COMBINATIONS)
            out += [(a, b, list(x)) for x in combinations(range(a - t + k), k)]
    return out


def _small_keys(sets: DataFrame, chosen: DataFrame, own: str, other: str) -> DataFrame:
    """Small sets under the combinations of their rarest words, once for each size of the other side."""
    met = sets.join(F.broadcast(chosen), "_size")
    return met.withColumn("_key", F.array_join(F.transform("_places", lambda i: F.get("_order", i)), " ")).withColumnsRenamed({"_size": own, "_other": other})


def _prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """Sets that are large, or may meet a large one, under their rarest words: so many that two as similar as ``threshold`` share one."""
    met = sets.filter(F.col("_size") > F.lit(SMALL * threshold - 1e-9))
    return met.withColumn("_key", F.explode(F.slice("_order", F.lit(1), F.col("_size") - _least(F.col("_size"), threshold) + 1)))


def fuzzy_lookup(rows: DataFrame, text: str, catalogue: DataFrame, entry: str, threshold: float = 0.7) -> DataFrame:
    """``rows`` with ``match``, ``similarity`` and ``n_matches``: the catalogue entry with the most similar word set.

    Similarity is words shared over words in either; entries below ``threshold`` (above 0, at most 1) do not count.  Ties
    go to the smaller entry.  Rows without words, without a match and null texts have null, null and 0.

    Texts of the same words are one set.  A prefix filter finds the candidates: words are ordered by how few sets of
    both sides hold them, and two sets as similar as that share some of the first words of each.  Sets of at most
    ``SMALL`` words meet under combinations of as many words as they must share (``_chosen``), so that words which all
    texts hold make no candidates; with a larger set on either side they meet under single rare words.
    """
    spark = rows.sparkSession
    left, right = _entries(rows, text), _entries(catalogue, entry)
    asked = left.select("_id", "_words").distinct()
    listed = right.groupBy("_id", "_words").agg(F.min("_text").alias("_entry"), F.count(F.lit(1)).alias("_entries"))
    both = asked.unionByName(listed.select("_id", "_words"))
    rarity = both.select(F.explode("_words").alias("_word")).groupBy("_word").agg(F.count(F.lit(1)).alias("_n"))
    a = _ordered(asked, rarity).withColumnsRenamed({"_id": "_a"})
    b = _ordered(listed, rarity).withColumnsRenamed({"_id": "_b"})
    chosen = spark.createDataFrame(_chosen(threshold), "_size int, _other int, _places array<int>")
    sides = ["_a", "_b", "_asize", "_bsize", "_entry", "_entries"]
    small = _small_keys(a, chosen, "_asize", "_bsize").drop("_order", "_places").join(_small_keys(b, chosen, "_bsize", "_asize").drop("_order", "_places"), ["_key", "_asize", "_bsize"])
    near = (F.col("_bsize") >= _least(F.col("_asize"), threshold)) & (F.col("_asize") >= _least(F.col("_bsize"), threshold))
    plain = [_prefixes(x, threshold).drop("_order").withColumnsRenamed({"_size": size}) for x, size in ((a, "_asize"), (b, "_bsize"))]
    large = plain[0].join(plain[1], "_key").filter(near & (F.greatest("_asize", "_bsize") > SMALL))
    pairs = small.select(*sides).unionByName(large.select(*sides)).distinct()
    shared = F.size(F.array_intersect(F.split("_a", " "), F.split("_b", " ")))
    scored = pairs.withColumn("_shared", shared).withColumn("_s", F.col("_shared") / (F.col("_asize") + F.col("_bsize") - F.col("_shared")))
    kept = scored.filter(F.col("_s") >= threshold - 1e-12)
    best = kept.groupBy("_a").agg(
        F.min_by("_entry", F.struct(-F.col("_s"), F.col("_entry"))).alias("_match"), F.max("_s").alias("_best"), F.sum("_entries").alias("_count")
    )
    found = left.select("_text", F.col("_id").alias("_a")).join(best, "_a")
    own = [c for c in rows.columns if c not in ("match", "similarity", "n_matches")]
    return rows.join(found, F.col(text) == F.col("_text"), "left").select(
        *(rows[c] for c in own), F.col("_match").alias("match"), F.col("_best").alias("similarity"), F.coalesce("_count", F.lit(0)).alias("n_matches")
    )
