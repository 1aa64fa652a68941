"""Toxicity with a factorization machine over hashed terms.

The score of a text is sigmoid(bias + sum of weights + sum over pairs of factor products) of the hashed
terms that stand in it, so a pair such as an insult with a group mention can weigh more than its parts.

Learning uses a bounded sample of labelled rows: (1) one aggregation counts, per hashed term, in how
many toxic and other texts it stands, and the terms that tell the classes apart best are kept; (2) the
machine is fitted by mini-batches on the sample reduced to those terms.  Scoring is one pass over all
whole texts; the fitted numbers (a few megabytes at most) are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm.arrays import ALNUM, Slice, slices, words
from tallymill.llm.sampling import chosen, labelled, texts

#: Hashed terms: 2 ** BITS. Counts per term are at most so many rows.
BITS = 20
#: Most terms that the machine sees, and the least chi-squared gain of one.
TERMS, GAIN = 1024, 15.0
#: Bound of the learning sample: labelled rows, those of the smallest hashed ids.
SAMPLE = 30_000
FACTORS = 8


@dataclass
class Machine:
    """Fitted numbers: which hashed terms have a place, their weights and factors."""

    place: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def margins(self, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Margin of each of n texts, given its (text, term place) pairs; each pair at most once."""
        sums = np.zeros((n, self.factor.shape[1]))
        squares = np.zeros(n)
        np.add.at(sums, doc, self.factor[term])
        np.add.at(squares, doc, (self.factor[term] ** 2).sum(axis=1))
        linear = np.bincount(doc, self.weight[term], minlength=n)
        return self.bias + linear + 0.5 * ((sums**2).sum(axis=1) - squares)


def terms(part: Slice, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hashed term) of a slice, each pair once."""
    w = words(part, ALNUM)
    pairs = np.unique((w.doc.astype(np.uint64) << np.uint64(bits)) | (w.hashes >> np.uint64(64 - bits)))
    return (pairs >> np.uint64(bits)).astype(np.int64), (pairs & np.uint64((1 << bits) - 1)).astype(np.int64)


def term_rows(rows: DataFrame, bits: int) -> DataFrame:
    """(term, label) of (label, _text): every distinct hashed term of every text."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                doc, term = terms(part, bits)
                yield pa.RecordBatch.from_arrays([pa.array(term), batch.column(0).take(pa.array(doc + part.first))], ["term", "label"])

    return rows.select("label", "_text").mapInArrow(listed, "term long, label int")


def choose(rows: DataFrame, toxic: float, every: float, n_terms: int) -> np.ndarray:
    """The terms whose presence differs most between labels, by a chi-squared statistic of their counts.

    ``rows`` are (term, label) of ``every`` texts, ``toxic`` of which have label 1.  Counts are
    partially aggregated; the rows that reach the driver are the chosen ones.
    """
    expected = F.col("n") * toxic / every
    counts = rows.groupBy("term").agg(F.sum("label").alias("t"), F.count("*").alias("n"))
    gains = counts.where("n >= 3").withColumn("gain", (F.col("t") - expected) ** 2 / (expected + 1.0)).where(F.col("gain") >= GAIN)
    return np.array(sorted(r.term for r in gains.orderBy(F.desc("gain"), "term").limit(n_terms).collect()), np.int64)


def fit(doc: np.ndarray, term: np.ndarray, labels: np.ndarray, place: np.ndarray, *, factors: int = FACTORS, steps: int = 2500, batch: int = 256, rate: float = 0.02, decay: float = 2e-5, seed: int = 7) -> Machine:
    """Fits by Adam on the logistic loss. ``doc`` is sorted; ``labels`` has one entry per document."""
    random, size = np.random.default_rng(seed), int(place.max() + 1) if len(place) else 1
    share = float(np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3))
    params = [np.array([np.log(share / (1 - share))]), np.zeros(size), random.normal(0, 0.01, (size, factors))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    bounds, step = np.searchsorted(doc, np.arange(len(labels) + 1)), 0
    while len(labels) and step < steps:
        order = random.permutation(len(labels))
        for k in range(0, len(order), batch):
            chosen = order[k : k + batch]
            lengths = bounds[chosen + 1] - bounds[chosen]
            at = np.repeat(bounds[chosen] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            d, t = np.repeat(np.arange(len(chosen)), lengths), term[at]
            bias, weight, factor = params
            v = factor[t]
            sums = np.zeros((len(chosen), factors))
            np.add.at(sums, d, v)
            squares = np.bincount(d, (v**2).sum(axis=1), minlength=len(chosen))
            margin = bias[0] + np.bincount(d, weight[t], minlength=len(chosen)) + 0.5 * ((sums**2).sum(axis=1) - squares)
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[chosen]) / len(chosen)
            slope_v = np.zeros_like(factor)
            np.add.at(slope_v, t, error[d][:, None] * (sums[d] - v))
            slopes = [np.array([error.sum()]), np.bincount(t, error[d], minlength=size) + decay * weight, slope_v + decay * factor]
            step += 1
            for p, m, s, g in zip(params, first, second, slopes):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Machine(place, float(params[0][0]), params[1], params[2])


def learn(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", text: str = "text", key: str = "doc_id", bits: int = BITS, n_terms: int = TERMS, sample: int = SAMPLE) -> Machine:
    """The machine learned from labelled rows of the learning folds.

    Without rows of both labels, or without a term that tells them apart, the machine is constant:
    the share of label 1, or one half without any row.
    """
    few = chosen(labelled(labels, label, key), sample)
    toxic, every = few.agg(F.sum("label"), F.count("*")).first()
    toxic, every = float(toxic or 0), float(every)
    taught = texts(docs, few, text, key)
    best = choose(term_rows(taught, bits), toxic, every, n_terms) if 0 < toxic < every else np.zeros(0, np.int64)
    place = np.full(1 << bits, -1, np.int32)
    place[best] = np.arange(len(best))
    if not len(best):
        share = min(max(toxic / every if every else 0.5, 1e-6), 1 - 1e-6)
        return Machine(place, float(np.log(share / (1 - share))), np.zeros(1), np.zeros((1, FACTORS)))
    wanted = docs.sparkSession.sparkContext.broadcast(place)

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(2)):
                doc, term = terms(part, bits)
                at = wanted.value[term]
                doc, at = doc[at >= 0], at[at >= 0]
                size = part.last - part.first
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=size))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(at))
                yield pa.RecordBatch.from_arrays([*(c.slice(part.first, size) for c in batch.columns[:2]), lists], ["id", "label", "terms"])

    kind = taught.schema["id"].dataType.simpleString()
    rows = taught.select("id", "label", "_text").mapInArrow(reduced, f"id {kind}, label int, terms array<int>")
    table = rows.orderBy(F.xxhash64("id"), "terms").limit(sample).select("label", "terms").toArrow()
    lists = table["terms"].combine_chunks()
    counts = np.diff(lists.offsets.to_numpy())
    return fit(np.repeat(np.arange(len(counts)), counts), lists.values.to_numpy().astype(np.int64), table["label"].to_numpy().astype(float), place)


def score(docs: DataFrame, machine: Machine, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), bits: int = BITS) -> DataFrame:
    """``keep`` and score (0 to 1). Null and empty texts have no terms: their score is that of the bias alone."""
    fitted = docs.sparkSession.sparkContext.broadcast(machine)
    names = [*keep, "score"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(0)):
                size = part.last - part.first
                doc, term = terms(part, bits)
                at = fitted.value.place[term]
                margin = fitted.value.margins(doc[at >= 0], at[at >= 0], size)
                chance = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(part.first, size) for k in places), pa.array(chance)], names)

    # a kept text column goes to the tasks once
    columns = [text, *(c for c in keep if c != text)]
    places = [columns.index(c) for c in keep]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*columns).mapInArrow(scored, f"{kinds}, score double")
