"""Spelling variants: words that differ by one code point, found with pivotal grams.

All bigrams have one global order, rarest first.  The prefix of a word is its three rarest bigrams (two
for every edit, and one); of these, dynamic programming chooses two disjoint ones of the least total
frequency as its pivots.  One edit destroys at most one of them, and the other stands in the prefix of
whichever word ends its prefix later, so pivots of all words are joined with prefixes of all words.
An edit also lies within one quarter of the word: what stands before and after that quarter is equal and
part of the key, and places of the bigram may differ by at most one.  Every pair so met is verified by
its edit distance.  A word has at most some 90 x (2 x length + 1) near words, so no group of
pairs grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.llm.arrays import Slice, mix, powers, slices
from tallymill.session import scratch_path

LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Distinct letters of lower-cased words, a-z and U+00C0 to U+00FF, so at most 8,100 bigrams.
ALPHABET = 26 + 64
EDITS, GRAM = 1, 2
#: Parts of a word of which an edit leaves all but one untouched.
PARTS = 4
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
KEYS = "word string, n long, length int, longer boolean, first int, last int, pivot boolean, key long"


def word_of(key: Column, run: Column, every: int = 31) -> Column:
    """The lower-cased run; where ``every`` divides the crc32 of ``<key>:<run>``, without the code point that the crc32 names."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    return F.when(F.pmod(h, F.lit(every)) == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def words(docs: DataFrame, *, text: str = "text", key: str = "doc_id", least_length: int = 7, least_count: int = 2) -> DataFrame:
    """(word, n) of all words of at least ``least_length`` letters and ``least_count`` occurrences in the corpus.

    Shorter runs cannot become long enough, so they are not read.  Null and empty texts have no words, a
    null key counts as empty, repeated rows count each.
    """
    runs = F.regexp_extract_all(docs[text], F.lit(f"{LETTERS}{{{least_length},}}+"), F.lit(0))
    found = docs.select(docs[key].alias("_key"), F.explode(runs).alias("_run"))
    lowered = F.when(F.rlike("_run", F.lit("[A-Z]")), F.translate("_run", UPPER, LOWER)).otherwise(F.col("_run"))
    counted = found.select("_key", lowered.alias("_run")).select(word_of(F.col("_key"), F.col("_run")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where((F.length("word") >= least_length) & (F.col("n") >= least_count))


def _letters(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Letter numbers of a slice of words and the bounds of each word in them; U+00C0 to U+00FF are 0xC3 and one more byte."""
    lead = part.data == 0xC3
    codes = np.where(part.data >= 0x80, part.data.astype(np.int64) - 0x80 + 26, part.data.astype(np.int64) - 0x61)[~lead]
    before = np.zeros(len(part.data) + 1, np.int64)
    np.cumsum(~lead, out=before[1:])
    return codes, before[part.offsets]


def _grams(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number, word and place of every bigram."""
    size = np.maximum(np.diff(bounds) - 1, 0)
    word = np.repeat(np.arange(len(size)), size)
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    at = bounds[word] + place
    return codes[at] * ALPHABET + codes[at + 1], word, place


def gram_counts(vocabulary: DataFrame, *, word: str = "word") -> np.ndarray:
    """How often each bigram stands in the distinct words. At most 8,100 numbers a task and in all."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ALPHABET * ALPHABET, np.int64)
        for batch in batches:
            for part in slices(batch.column(0)):
                total += np.bincount(_grams(*_letters(part))[0], minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["gram", "n"])

    out = np.zeros(ALPHABET * ALPHABET, np.int64)
    for row in vocabulary.select(word).mapInArrow(counted, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[row.gram] = row.n
    return out


def prefixes(word: np.ndarray, place: np.ndarray, rank: np.ndarray, n: int = EDITS * GRAM + 1) -> np.ndarray:
    """Which bigrams are in their word's prefix: the n least of it by rank, and those equal to the last of these."""
    order = np.lexsort((place, rank, word))
    first = np.searchsorted(word[order], np.arange(word[-1] + 1 if len(word) else 0))
    last = rank[order][np.minimum(first + n - 1, len(word) - 1)]
    return rank <= last[word]


def pivots(word: np.ndarray, place: np.ndarray, cost: np.ndarray, n: int = EDITS + 1) -> np.ndarray:
    """Which prefix bigrams (in order of word and place) are pivots: n disjoint ones of the least total cost.

    Dynamic programming over places: ``best[:, j]`` is the least cost of a choice whose last member is the
    j-th bigram of a prefix.  Words are taken together by the size of their prefix up to a factor of two.
    """
    size = np.bincount(word)
    first = np.cumsum(size) - size
    chosen = np.zeros(len(word), bool)
    for c in np.unique(np.ceil(np.log2(np.maximum(size, 1)))):
        some = np.flatnonzero((size > 0) & (np.ceil(np.log2(np.maximum(size, 1))) == c))
        column = np.arange(int(size[some].max()))
        real = column < size[some][:, None]
        at = np.where(real, first[some][:, None] + column, 0)
        places, costs = np.where(real, place[at], -1), np.where(real, cost[at], np.inf)
        best, came = costs, []
        for _ in range(n - 1):
            least = np.minimum.accumulate(best, axis=1)
            fresh = np.concatenate([np.ones((len(some), 1), bool), best[:, 1:] < least[:, :-1]], axis=1)
            where = np.maximum.accumulate(np.where(fresh, column, 0), axis=1)
            before = np.concatenate([places[:, :1], places[:, :-1]], axis=1)
            back = np.where(before + GRAM <= places, column - 1, column - 2)  # places rise, so all bigrams before this one are disjoint from it
            source = np.where(back >= 0, np.take_along_axis(where, np.maximum(back, 0), axis=1), 0)
            best = np.where(back >= 0, np.take_along_axis(least, np.maximum(back, 0), axis=1), np.inf) + costs
            came.append(source)
        rows, last = np.arange(len(some)), best.argmin(axis=1)
        chosen[at[rows, last]] = True
        for source in reversed(came):
            last = source[rows, last]
            chosen[at[rows, last]] = True
    return chosen


def _spans(codes: np.ndarray):
    """A function (from, to) that hashes any runs of the letters."""
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(codes)), out=total[1:])
    back = powers(_INVERSE, len(codes) + 1)
    return lambda a, b: mix((total[b] - total[a]) * back[a] + (b - a).astype(np.uint64))


def keys(vocabulary: DataFrame, counts: np.ndarray) -> DataFrame:
    """One row for every word, prefix bigram, shorter length and quarter: all else is what two near words have in common.

    ``longer`` marks rows that stand for the longer one of two words of different lengths.  A bigram that
    stands in a word several times is one row with its first and last place.
    """
    rank = np.empty(len(counts), np.int64)
    rank[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(0), 1 << 17):
                codes, bounds = _letters(part)
                gram, word, place = _grams(codes, bounds)
                inside = prefixes(word, place, rank[gram])
                gram, word, place = gram[inside], word[inside], place[inside]
                pivot = pivots(word, place, counts[gram].astype(np.float64))
                order = np.lexsort((place, gram, word))
                gram, word, place, pivot = gram[order], word[order], place[order], pivot[order]
                each = np.flatnonzero(np.diff(word * len(counts) + gram, prepend=-1))
                pivot, first, last = np.logical_or.reduceat(pivot, each), place[each], place[np.append(each[1:], len(word)) - 1]
                gram, word = gram[each], word[each]
                span, length = _spans(codes), np.diff(bounds)[word]
                start, end = bounds[word], bounds[word + 1]
                column = batch.column(0).slice(part.first, part.last - part.first).take(pa.array(word))
                n = batch.column(1).slice(part.first, part.last - part.first).take(pa.array(word))
                for longer in (False, True):
                    shorter = length - longer
                    for k in range(PARTS):
                        a, b = start + shorter * k // PARTS, end - (shorter - shorter * (k + 1) // PARTS)
                        same = mix(span(start, a) * np.uint64(_BASE) + span(b, end))
                        key = mix(same * np.uint64(_BASE) + (gram + ALPHABET * ALPHABET * (PARTS * shorter + k)).astype(np.uint64))
                        made = [
                            column,
                            n,
                            pa.array(length, pa.int32()),
                            pa.array(np.full(len(word), longer)),
                            pa.array(first, pa.int32()),
                            pa.array(last, pa.int32()),
                            pa.array(pivot),
                            pa.array(key.view(np.int64)),
                        ]
                        yield pa.RecordBatch.from_arrays(made, ["word", "n", "length", "longer", "first", "last", "pivot", "key"])

    return vocabulary.select("word", "n").mapInArrow(keyed, KEYS)


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b) with a < b: all pairs of words exactly one inserted, deleted or replaced code point apart, once each."""
    made = keys(vocabulary, gram_counts(vocabulary))
    a, b = made.where("pivot").alias("a"), made.alias("b")
    fits = (
        (F.col("a.key") == F.col("b.key"))
        & ~(F.col("a.longer") & F.col("b.longer"))
        & (F.col("a.first") - EDITS <= F.col("b.last"))
        & (F.col("b.first") - EDITS <= F.col("a.last"))
        & (F.abs(F.col("a.length") - F.col("b.length")) <= EDITS)
        & (F.col("a.word") != F.col("b.word"))
    )
    met = a.join(b, fits).where(F.levenshtein(F.col("a.word"), F.col("b.word"), EDITS) == EDITS)
    turned = F.col("a.word") > F.col("b.word")
    side = lambda c, x, y: F.when(turned, F.col(f"{x}.{c}")).otherwise(F.col(f"{y}.{c}"))
    return met.select(side("word", "b", "a").alias("a"), side("word", "a", "b").alias("b"), side("n", "b", "a").alias("n_a"), side("n", "a", "b").alias("n_b")).distinct()


def roots(forms: DataFrame, depth: int) -> DataFrame:
    """(word, root): forms followed to the last. Steps double each round, so chains of ``depth`` take log2(depth) of them."""
    reach = forms.select("word", F.col("form").alias("root"))
    for _ in range(ceil(log2(depth)) if depth > 1 else 0):
        path = scratch_path(forms.sparkSession, "roots")
        reach.write.parquet(path)
        reach = forms.sparkSession.read.parquet(path)
        onward = reach.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        reach = reach.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"))
    return reach


def group(docs: DataFrame, *, text: str = "text", key: str = "doc_id", least_length: int = 7, least_count: int = 2, ratio: int = 10) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    A word's form is its near word of the largest n (ties: the smallest in code-point order), if that n is at
    least ``ratio`` times its own; the root is where forms end.  Words, near pairs and forms are tables in the
    shared folder, so a lost executor costs no more than the stage it was in.  Without words the result is empty.
    """
    if least_length < GRAM * (EDITS + 1):
        raise ValueError("a word needs three bigrams: least_length must be 4 or more")
    spark = docs.sparkSession
    kept = []
    for name, make in (
        ("words", lambda: words(docs, text=text, key=key, least_length=least_length, least_count=least_count)),
        ("near", lambda: near_pairs(kept[0])),
    ):
        path = scratch_path(spark, name)
        make().write.parquet(path)
        kept.append(spark.read.parquet(path))
    vocabulary, pairs = kept
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_a").alias("n"), F.col("n_b").alias("other_n"))
    both = both.union(pairs.select("b", "a", "n_b", "n_a"))
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word")))
    nearest = both.groupBy("word").agg(F.count("*").alias("n_near"), F.any_value("n").alias("n"), best.alias("best"))
    large = -F.col("best.n") >= F.col("n") * ratio
    near = nearest.select("word", "n_near", F.when(large, F.col("best.word")).alias("form"), F.when(large, -F.col("best.n")).alias("form_n"))
    path = scratch_path(spark, "forms")
    near.write.parquet(path)
    near = spark.read.parquet(path)
    most = (vocabulary.agg(F.max("n")).first()[0] or 0) // least_count
    ends = roots(near.where("form is not null"), _steps(most, ratio))
    out = vocabulary.join(near, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def _steps(most: int, ratio: int) -> int:
    """How often ``ratio`` divides ``most``: no chain of forms is longer."""
    steps = 0
    while ratio > 1 and most >= ratio:
        most, steps = most // ratio, steps + 1
    return steps
