"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

The items are the stated query set: they go block by block (a bounded number of words each) into an
automaton that is broadcast, and every document's words stream through it.  At each word the state
tells the longest run of words ending there that also stands in an item; where the run reaches the
window length, the window's words are hit.  Words that no item has send the automaton back to its
start, so only stretches of item words that are long enough are walked; the rest is skipped with
array operations.  There is no shuffle of documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallymill.llm.arrays import ALNUM, Slice, slices, words

#: Item words in one automaton: bounds what is broadcast at a time (some 100 MB); more items make more blocks.
BLOCK_WORDS = 200_000


@dataclass
class Automaton:
    """Suffix automaton of all items; words are numbered by their place in ``vocabulary`` (sorted hashes)."""

    window: int
    vocabulary: np.ndarray
    next: list[dict[int, int]] = field(default_factory=list)
    link: list[int] = field(default_factory=list)
    length: list[int] = field(default_factory=list)
    #: Of the state whose strings have a window's length: items with that window.
    windows: dict[int, tuple[int, ...]] = field(default_factory=dict)
    #: Of a state, short items (fewer words than a window) by their number of words.
    short: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    shortest: int = 0

    def _state(self, length: int, link: int, arcs: dict[int, int]) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _extend(self, last: int, word: int) -> int:
        """The state of the item's words so far with one more word."""
        nxt, link, length = self.next, self.link, self.length
        if word in nxt[last]:  # known from another item
            target = nxt[last][word]
            return target if length[target] == length[last] + 1 else self._split(last, target, word)
        new, at = self._state(length[last] + 1, 0, {}), last
        while at >= 0 and word not in nxt[at]:
            nxt[at][word] = new
            at = link[at]
        if at >= 0:
            target = nxt[at][word]
            link[new] = target if length[target] == length[at] + 1 else self._split(at, target, word)
        return new

    def _split(self, at: int, target: int, word: int) -> int:
        """A copy of ``target`` for its strings that are no longer than those of ``at`` with ``word``."""
        nxt, link = self.next, self.link
        copy = self._state(self.length[at] + 1, link[target], dict(nxt[target]))
        while at >= 0 and nxt[at].get(word) == target:
            nxt[at][word] = copy
            at = link[at]
        link[target] = copy
        return copy

    def step(self, state: int, matched: int, word: int) -> tuple[int, int]:
        """State and matched length after one more word of a text."""
        nxt, link = self.next, self.link
        while state and word not in nxt[state]:
            state = link[state]
            matched = self.length[state]
        return (nxt[state][word], matched + 1) if word in nxt[state] else (0, 0)

    def at_length(self, state: int, n: int) -> int:
        """The state of the last n words of what ``state`` has matched."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state


def build(items: list[tuple[object, np.ndarray]], window: int) -> Automaton:
    """An automaton of (item id, word hashes); items without words are left out."""
    items = [(k, h) for k, h in items if len(h)]
    vocabulary = np.unique(np.concatenate([h for _, h in items])) if items else np.zeros(0, np.uint64)
    made = Automaton(window, vocabulary)
    made._state(0, -1, {})
    numbered = [(k, np.searchsorted(vocabulary, h).tolist()) for k, h in items]
    for _, item in numbered:
        last = 0
        for word in item:
            last = made._extend(last, word)
    windows: dict[int, dict] = {}
    for k, item in numbered:
        state = matched = 0
        for word in item:
            state, matched = made.step(state, matched, word)
            if matched >= window:
                windows.setdefault(made.at_length(state, window), {})[k] = None
        if len(item) < window:
            made.short.setdefault(made.at_length(state, len(item)), []).append((k, len(item)))
    made.windows = {state: tuple(ids) for state, ids in windows.items()}
    made.shortest = min([window, *(len(item) for _, item in numbered)])
    return made


def hits(made: Automaton, hashes: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, list[set]]:
    """Which words lie inside an occurring window, and the items of each document's windows.

    ``hashes`` are the words of several documents in order, ``doc`` the document of each.
    """
    hit = np.zeros(len(hashes) + 1, np.int64)
    found: list[set] = [set() for _ in range(n_docs)]
    if not len(hashes) or not len(made.vocabulary):
        return hit[:-1] > 0, found
    place = np.minimum(np.searchsorted(made.vocabulary, hashes), len(made.vocabulary) - 1)
    known = made.vocabulary[place] == hashes
    breaks = np.flatnonzero(np.diff(known.astype(np.int8)) | (np.diff(doc) != 0)) + 1
    starts, ends = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(hashes)]])
    worth = known[starts] & (ends - starts >= made.shortest)
    window, link = made.window, made.link
    for a, b in zip(starts[worth].tolist(), ends[worth].tolist()):
        state = matched = 0
        items = found[doc[a]]
        for k, word in enumerate(place[a:b].tolist(), a):
            state, matched = made.step(state, matched, word)
            if matched >= window:
                hit[k - window + 1] += 1
                hit[k + 1] -= 1
                items.update(made.windows[made.at_length(state, window)])
            if made.short and matched >= made.shortest:
                at = state
                while at > 0:
                    for item, n in made.short.get(at, ()):
                        if n <= matched and made.length[link[at]] < n <= made.length[at]:
                            hit[k - n + 1] += 1
                            hit[k + 1] -= 1
                            items.add(item)
                    at = link[at]
    return np.cumsum(hit[:-1]) > 0, found


def blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[object, np.ndarray]]]:
    """Items with their word hashes, read partition by partition, in blocks of a bounded number of words.

    Items with equal ids are separate passages of one item; items without words count for nothing.  The words
    of an item without an id are hit like any other's, but it is not among the items that are named.
    """
    held, size = [], 0
    for row in benchmark.select(benchmark[item_id].alias("k"), benchmark[text].alias("t")).where("t is not null").toLocalIterator():
        part = next(slices(pa.array([row.t])))
        hashes = words(part, ALNUM).hashes
        if held and size + len(hashes) > BLOCK_WORDS:
            yield held
            held, size = [], 0
        held.append((row.k, hashes))
        size += len(hashes)
    yield held


def _scan(docs: DataFrame, benchmark: DataFrame, one, fields: list[T.StructField], text: str, keep: tuple[str, ...], window: int, item_id: str, item_text: str) -> DataFrame:
    """``keep`` and what ``one`` makes of each text's words, hits and items; all blocks are applied to each slice."""
    context = docs.sparkSession.sparkContext
    automata = [context.broadcast(build(block, window)) for block in blocks(benchmark, item_id, item_text)]
    schema = T.StructType([docs.schema[c] for c in keep] + fields)
    kinds = {T.LongType: pa.int64(), T.BooleanType: pa.bool_(), T.StringType: pa.string(), T.DoubleType: pa.float64()}

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            for part in slices(texts):
                size = part.last - part.first
                w = words(part, ALNUM)
                hit, items = np.zeros(len(w.hashes), bool), [set() for _ in range(size)]
                for automaton in automata:
                    more, found = hits(automaton.value, w.hashes, w.doc, size)
                    hit |= more
                    for mine, new in zip(items, found):
                        mine |= new
                bounds = np.concatenate([[0], np.cumsum(w.counts)])
                rows = []
                for k in range(size):
                    span = slice(bounds[k], bounds[k + 1])
                    rows.append(one(part, k, hit[span], w.start[span], w.end[span], items[k], not texts[part.first + k].is_valid))
                made = [pa.array([r[i] for r in rows], kinds[type(f.dataType)]) for i, f in enumerate(fields)]
                rest = [c.slice(part.first, size) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([*rest, *made], schema.names)

    return docs.select(docs[text].alias("_text"), *(docs[c] for c in keep)).mapInArrow(scanned, schema)


def report(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 and contaminated.

    Null and empty texts have no words and no items; the hash is then that of the empty string.
    Every row is answered, repeated rows each; an empty benchmark contaminates nothing.
    """
    names = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType())]

    def one(part: Slice, k: int, hit: np.ndarray, start: np.ndarray, end: np.ndarray, items: set, null: bool) -> tuple:
        items = items - {None}
        joined = ",".join(sorted(map(str, items)))
        n = int(hit.sum())
        return len(hit), n, len(items), hashlib.sha256(joined.encode()).hexdigest(), n > 0

    return _scan(docs, benchmark, one, [T.StructField(n, t) for n, t in names], text, keep, window, item_id, item_text)


def clean(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, most_words: int = 0, most_coverage: float = 0.5, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``keep``, the text without contaminated spans, ``coverage`` and ``dropped``.

    A span is a maximal stretch of hit words; it goes if it has more than ``most_words`` words.  Where
    more than ``most_coverage`` of a text's words are hit, little else is left and ``dropped`` is true
    (the text is then empty).  What stands between the words before and after a removed span becomes
    one blank.  A text without hits is returned as it is, null too.
    """
    names = [("text", T.StringType()), ("coverage", T.DoubleType()), ("dropped", T.BooleanType())]

    def one(part: Slice, k: int, hit: np.ndarray, start: np.ndarray, end: np.ndarray, items: set, null: bool) -> tuple:
        raw = part.text(k)
        if not hit.any():
            return None if null else raw.decode(), 0.0, False
        coverage = float(hit.mean())
        if coverage > most_coverage:
            return "", coverage, True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
        pieces, at, base = [], 0, int(part.offsets[k])
        for a, b in zip(edge[::2], edge[1::2]):
            if b - a > most_words:
                pieces.append(raw[at : int(start[a]) - base].rstrip())
                at = int(end[b - 1]) - base
        pieces.append(raw[at:].lstrip())
        return b" ".join(pieces).decode(), coverage, False

    return _scan(docs, benchmark, one, [T.StructField(n, t) for n, t in names], text, keep, window, item_id, item_text)


