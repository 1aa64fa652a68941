"""Bounded samples from which classifiers learn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_of(key: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5))


def chosen(keys: DataFrame, n: int) -> DataFrame:
    """At most n rows of (id, ...): those of the smallest hashed ids, the same for any partitioning."""
    return keys.orderBy(F.xxhash64("id"), "id").limit(n)


def labelled(labels: DataFrame, label: str, key: str) -> DataFrame:
    """(id, label) of the learning folds. Rows without id or label teach nothing; of an id labelled twice the larger holds."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & (fold_of(F.col(key)) != 0))
    return known.groupBy(F.col(key).alias("id")).agg(F.max(label).cast("int").alias("label"))


def texts(docs: DataFrame, few: DataFrame, text: str, key: str) -> DataFrame:
    """(id, _text and the columns of ``few``) of the documents in ``few``.

    ``few`` is a sample of a stated number of ids, so it is broadcast and no text is shuffled.
    """
    return docs.select(F.col(key).alias("id"), F.col(text).alias("_text")).join(F.broadcast(few), "id")
