"""Quality by positive-unlabelled learning: trusted positives, unlabelled web text, an estimated prior.

A small network on statistics of a text minimises the non-negative unbiased risk
``prior * R_positive(+) + max(0, R_unlabelled(-) - prior * R_positive(-))``: known bad texts are never
used.  The class prior is estimated from a first fit: where a score is so high that only good texts
reach it, the share of unlabelled texts above it is the prior times the share of positives above it.
Learning uses bounded samples; scoring is one pass over all whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm.arrays import NOT_BLANK, Slice, fold, slices, words
from tallymill.llm.sampling import chosen, fold_of, labelled, texts

#: Bounds of the learning samples: trusted positives and unlabelled texts.
POSITIVES, UNLABELLED = 15_000, 25_000
HIDDEN = 24

_KINDS = {
    "letter": [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)],
    "upper": range(0x41, 0x5B),
    "digit": range(0x30, 0x3A),
    "line": [0x0A],
    "stop": [0x2E, 0x3F],
    "comma": [0x2C, 0x3B],
    "shout": [0x21],
    "bar": [0x7C],
    "symbol": [0x23, 0x24, 0x25, 0x26, 0x2A, 0x40, 0x5E, 0x7E, 0x3C, 0x3E, 0x5C],
}
FEATURES = (*_KINDS, "words", "word_length", "distinct", "distinct_pairs", "repeats", "capitals", "odd_ends")


def features(part: Slice) -> np.ndarray:
    """One row of statistics per text; all zero for a text without words."""
    w = words(part, NOT_BLANK)
    texts_, n = len(w.counts), np.maximum(w.counts, 1)
    size = np.maximum(np.diff(part.offsets), 1)
    columns = []
    for members in _KINDS.values():
        table = np.zeros(256, bool)
        table[list(members)] = True
        total = np.concatenate([[0], np.cumsum(table[part.data])])
        columns.append(np.diff(total[part.offsets]) / size)
    sums = lambda values: np.bincount(w.doc, values, minlength=texts_)
    distinct = lambda doc, values: np.bincount(np.unique(np.stack([doc.astype(np.uint64), values]), axis=1)[0].astype(np.int64), minlength=texts_)
    columns += [np.log1p(w.counts), sums((w.end - w.start).astype(float)) / n, distinct(w.doc, w.hashes) / n]
    if len(w.hashes) > 1:
        same = w.doc[1:] == w.doc[:-1]
        pairs = fold(w.hashes, 2)[same]
        columns.append(distinct(w.doc[1:][same], pairs) / n)
        columns.append(np.bincount(w.doc[1:], same & (w.hashes[1:] == w.hashes[:-1]), minlength=texts_) / n)
    else:
        columns += [np.zeros(texts_), np.zeros(texts_)]
    first, last = part.data[w.start], part.data[w.end - 1]
    columns.append(sums((first >= 0x41) & (first <= 0x5A)) / n)
    plain = ((last | 32) >= 0x61) & ((last | 32) <= 0x7A) | (last >= 0x80) | np.isin(last, [0x2E, 0x2C])
    columns.append(sums(~plain) / n)
    return np.stack(columns, axis=1).astype(np.float32)


@dataclass
class Network:
    """One hidden layer on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]

    def margins(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ a + b) @ c + d[0]


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, steps: int = 1500, batch: int = 512, rate: float = 0.01, decay: float = 1e-4, seed: int = 3) -> Network:
    """Minimises the non-negative risk with the logistic loss by Adam on random batches of both samples.

    Where a batch's negative part falls below zero, the step goes uphill on that part, as the
    non-negative estimator asks, so that the network doesn't learn the positives by heart.
    """
    random = np.random.default_rng(seed)
    every = np.concatenate([positive, unlabelled])
    net = Network(every.mean(axis=0), every.std(axis=0) + 1e-3, [])
    width = every.shape[1]
    net.layers = [random.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), random.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in net.layers], [np.zeros_like(p) for p in net.layers]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, steps + 1):
        p, u = positive[random.integers(len(positive), size=batch)], unlabelled[random.integers(len(unlabelled), size=batch)]
        x = np.clip((np.concatenate([p, u]) - net.mean) / net.scale, -8, 8)
        a, b, c, d = net.layers
        hidden = np.tanh(x @ a + b)
        margin = hidden @ c + d[0]
        loss_negative = np.logaddexp(0, margin)
        negative = loss_negative[batch:].mean() - prior * loss_negative[:batch].mean()
        up, down = sigmoid(margin), -sigmoid(-margin)  # slopes of the losses against label 0 and label 1
        slope = np.concatenate([-prior * up[:batch], up[batch:]]) / batch
        if negative < 0:
            slope = -slope
        else:
            slope[:batch] += prior * down[:batch] / batch
        back = slope[:, None] * c * (1 - hidden**2)
        slopes = [x.T @ back + decay * a, back.sum(axis=0), hidden.T @ slope + decay * c, np.array([slope.sum()])]
        for q, m, s, g in zip(net.layers, first, second, slopes):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return net


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled: the least ratio of their shares above a score.

    Only scores that at least half of the positives reach are looked at.  The least of noisy ratios is
    somewhat low, which is the safe side: too high a prior makes bad texts pass.  Scores must come from
    texts that the fit has not seen.
    """
    positive, unlabelled = np.sort(positive), np.sort(unlabelled)
    at = np.quantile(positive, np.linspace(0.0, 0.5, 51))
    above = lambda x: 1 - np.searchsorted(x, at) / len(x)
    p, u = above(positive), above(unlabelled)
    ratio = u / np.maximum(p, 1e-9)
    return float(np.clip(ratio.min(), 0.05, 0.98))


def measure(rows: DataFrame) -> DataFrame:
    """(id, features) of (id, _text)."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                x = features(part)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, len(x)), lists], ["id", "x"])

    return rows.select("id", "_text").mapInArrow(measured, f"id {rows.schema['id'].dataType.simpleString()}, x array<float>")


def _matrix(rows: DataFrame, n: int) -> np.ndarray:
    table = measure(rows).orderBy(F.xxhash64("id"), "x").limit(n).select("x").toArrow()
    return table["x"].combine_chunks().values.to_numpy().reshape(-1, len(FEATURES)).astype(float)


def learn(docs: DataFrame, labels: DataFrame, *, label: str = "quality", text: str = "text", key: str = "doc_id", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[Network | None, float]:
    """The network and the estimated prior, from the learning folds; None and 0.5 without positives or texts."""
    trusted = chosen(labelled(labels, label, key).where("label = 1").select("id"), positives)
    web = chosen(docs.where(F.col(key).isNotNull() & (fold_of(F.col(key)) != 0)).select(F.col(key).alias("id")).distinct(), unlabelled)
    p, u = _matrix(texts(docs, trusted, text, key), positives), _matrix(texts(docs, web, text, key), unlabelled)
    if not len(p) or not len(u):
        return None, 0.5
    prior = 0.5
    if min(len(p), len(u)) >= 2:
        halves = [(fit(p[k::2], u[k::2], prior, steps=700), p[1 - k :: 2], u[1 - k :: 2]) for k in (0, 1)]
        prior = float(np.mean([estimate_prior(net.margins(x), net.margins(y)) for net, x, y in halves]))
    return fit(p, u, prior), prior


def score(docs: DataFrame, net: Network | None, prior: float, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and score (0 to 1). Null and empty texts are scored on zero statistics; without a network all get the prior."""
    fitted = docs.sparkSession.sparkContext.broadcast(net)
    names = [*keep, "score"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(0)):
                size = part.last - part.first
                chance = np.full(size, prior) if fitted.value is None else 1 / (1 + np.exp(-np.clip(fitted.value.margins(features(part).astype(float)), -30, 30)))
                yield pa.RecordBatch.from_arrays([*(c.slice(part.first, size) for c in batch.columns[1:]), pa.array(chance)], names)

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(F.col(text).alias("_text"), *(F.col(c) for c in keep)).mapInArrow(scored, f"{kinds}, score double")
