"""Byte-level BPE encoding and decoding with padded matrices of token ids.

A text is split by the vocabulary's pattern.  The distinct pieces of a slice of texts that are not
tokens themselves are laid out by length in padded matrices, one row a piece.  In each round every
row merges its leftmost pair of the lowest rank: ranks of pairs come from one hashed table, the
merged row is moved together by one place, and rows without a pair left leave the matrix.  Work is
per text, so there is no shuffle; the vocabulary (a file of some 50,000 tokens) is broadcast.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallymill.llm.arrays import slices

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
NO_RANK = np.int32(2**31 - 1)
#: Pieces of more bytes are merged one by one with a heap: a row of n tokens takes n rounds of n steps.
LONGEST_ROW = 512
#: Pieces remembered between slices of one task; the memory starts anew when it is full.
REMEMBERED = 150_000


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PairTable:
    """Rank of the token that two adjacent tokens make, by open addressing over one array."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        keys, values = np.array(keys, np.uint64), np.array(values, np.int32)
        bits = max(10, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1), np.uint64)
        self.values = np.full(1 << bits, NO_RANK, np.int32)
        self.probes, todo, place = 0, np.arange(len(keys)), self._slot(keys)
        while len(todo):
            self.probes += 1
            free = np.flatnonzero(self.values[place] == NO_RANK)
            _, first = np.unique(place[free], return_index=True)
            put = free[first]
            self.keys[place[put]], self.values[place[put]] = keys[todo[put]], values[todo[put]]
            rest = np.setdiff1d(np.arange(len(todo)), put, assume_unique=True)
            todo, place = todo[rest], (place[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        place = self._slot(keys)
        found = np.where(self.keys[place] == keys, self.values[place], NO_RANK)
        open_ = np.flatnonzero((found == NO_RANK) & (self.values[place] != NO_RANK))
        for _ in range(self.probes):
            if not len(open_):
                break
            place[open_] = (place[open_] + 1) & self.mask
            found[open_] = np.where(self.keys[place[open_]] == keys[open_], self.values[place[open_]], NO_RANK)
            open_ = open_[(found[open_] == NO_RANK) & (self.values[place[open_]] != NO_RANK)]
        return found


def gather(begin: np.ndarray, length: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of runs laid end to end: run k has ``length[k]`` places from ``begin[k]``; ``ends`` is cumsum(length)."""
    return np.repeat(begin - (ends - length), length) + np.arange(ends[-1])


class Pieces(dict):
    """Numbers pieces in the order in which they are first asked for."""

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        return number


class Codec:
    """Encodes bytes of pieces to ids and ids to bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern, self.pairs = ranks, regex.compile(pattern), PairTable(ranks)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        tokens = sorted(ranks.items(), key=lambda x: x[1])
        size = tokens[-1][1] + 1
        self.length = np.zeros(size, np.int64)
        self.length[[r for _, r in tokens]] = [len(t) for t, _ in tokens]
        self.begin = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.bytes = np.frombuffer(b"".join(t for t, _ in tokens), np.uint8)
        self.forget()

    def merge_rows(self, raw: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of like length, one padded row each: the ids end to end, and how many each has."""
        count, width = len(sizes), int(sizes.max())
        filled = np.arange(width) < sizes[:, None]
        result = np.zeros((count, width), np.int32)
        result[filled] = self.byte[np.frombuffer(raw, np.uint8)]
        ids = result.copy()
        rank = np.full((count, width), NO_RANK, np.int32)
        both = filled[:, 1:]
        rank[:, :-1][both] = self.pairs.ranks(ids[:, :-1][both], ids[:, 1:][both])
        lengths, row, sizes = sizes.copy(), np.arange(count), sizes.copy()
        while len(row):
            lines, columns = np.arange(len(row)), np.arange(width)
            at = rank.argmin(axis=1)  # the first of equal ranks: the leftmost pair
            lowest = rank[lines, at]
            live = lowest != NO_RANK
            if not live.all():
                done = ~live
                result[row[done], :width] = ids[done]
                lengths[row[done]] = sizes[done]
                row, sizes, at, lowest = row[live], sizes[live], at[live], lowest[live]
                if not len(row):
                    break
                width = int(sizes.max())
                ids, rank, lines, columns = ids[live, :width], rank[live, :width], lines[: len(row)], columns[:width]
            take = columns + (columns > at[:, None])
            take[:, -1] = width - 1
            take += (lines * width)[:, None]
            ids, rank = ids.ravel()[take], rank.ravel()[take]
            ids[lines, at] = lowest
            sizes -= 1
            rank[lines, sizes - 1] = NO_RANK
            right = np.flatnonzero(at + 1 < sizes)
            left = np.flatnonzero(at > 0)
            both_rows, both_at = np.concatenate([right, left]), np.concatenate([at[right], at[left] - 1])
            rank[both_rows, both_at] = self.pairs.ranks(ids[both_rows, both_at], ids[both_rows, both_at + 1])
        return result[np.arange(result.shape[1]) < lengths[:, None]], lengths

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece, with a heap of (rank, place) and links to neighbours."""
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        first = self.pairs.ranks(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(r), k) for k, r in enumerate(first) if r != NO_RANK]
        heapq.heapify(heap)
        kept: dict[tuple[int, int], int] = {}

        def rank(k: int) -> int:
            if k < 0 or after[k] >= n:
                return int(NO_RANK)
            pair = ids[k], ids[after[k]]
            if pair not in kept:
                kept[pair] = int(self.pairs.ranks(np.array(pair[:1]), np.array(pair[1:]))[0])
            return kept[pair]

        while heap:
            r, k = heapq.heappop(heap)
            if not alive[k] or rank(k) != r:
                continue
            gone = after[k]
            ids[k], alive[gone], after[k] = r, False, after[gone]
            if after[k] < n:
                before[after[k]] = k
            for j in (k, before[k]):
                if (again := rank(j)) != NO_RANK:
                    heapq.heappush(heap, (again, j))
        return np.array([x for x, live in zip(ids, alive) if live], np.int32)

    def learn(self, pieces: list[str]) -> None:
        """Ids of new pieces, from the vocabulary, from matrices by length, or from the heap, put into the pool."""
        raw = [piece.encode("utf-8", "surrogatepass") for piece in pieces]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        whole = np.array([-1 if (r := self.ranks.get(x)) is None else r for x in raw], np.int64)
        group = np.where(whole >= 0, 0, np.where(sizes > LONGEST_ROW, -1, 2 + np.ceil(np.log2(np.maximum(sizes, 4))).astype(np.int64)))
        parts, lengths, order = [], [], []
        for kind in np.unique(group):
            some = np.flatnonzero(group == kind)
            if kind == 0:
                parts.append(whole[some].astype(np.int32))
                lengths.append(np.ones(len(some), np.int64))
            elif kind == -1:
                long = [self.merge_long(raw[k]) for k in some]
                parts += long
                lengths.append(np.array([len(x) for x in long]))
            else:
                step = max(1, (1 << 21) >> int(kind))
                for k in range(0, len(some), step):
                    now = some[k : k + step]
                    made, count = self.merge_rows(b"".join([raw[j] for j in now]), sizes[now])
                    parts.append(made)
                    lengths.append(count)
            order.append(some)
        lengths = np.concatenate(lengths)
        begin = np.empty(len(raw), np.int64)
        length = np.empty(len(raw), np.int64)
        order = np.concatenate(order)
        begin[order], length[order] = self.pool_size + np.cumsum(lengths) - lengths, lengths
        self.pool_begin.append(begin)
        self.pool_length.append(length)
        self.pool += parts
        self.pool_size += int(lengths.sum())

    def forget(self) -> None:
        self.known, self.pool, self.pool_begin, self.pool_length, self.pool_size = Pieces(), [], [], [], 0

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the bounds of each text in them."""
        if len(self.known) > REMEMBERED:
            self.forget()
        found = [self.pattern.findall(text) for text in texts]
        counts = np.array([len(x) for x in found], np.int64)
        had = len(self.known)
        index = np.fromiter(map(self.known.__getitem__, chain.from_iterable(found)), np.int64, int(counts.sum()))
        if len(self.known) > had:
            self.learn(list(islice(reversed(self.known), len(self.known) - had))[::-1])
            self.pool = [np.concatenate(self.pool)]
            self.pool_begin, self.pool_length = [np.concatenate(self.pool_begin)], [np.concatenate(self.pool_length)]
        bounds = np.zeros(len(texts) + 1, np.int64)
        if not len(index):
            return np.zeros(0, np.int32), bounds
        length = self.pool_length[0][index]
        ends = np.cumsum(length)
        np.cumsum(counts, out=bounds[1:])
        bounds = np.concatenate([[0], ends])[bounds]
        return self.pool[0][gather(self.pool_begin[0][index], length, ends)], bounds

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids: one gather over all tokens' bytes."""
        length = self.length[ids]
        ends = np.cumsum(length)
        return self.bytes[gather(self.begin[ids], length, ends)].tobytes() if len(ids) else b""


_codecs: dict[str, Codec] = {}


def _codec(ranks, pattern: str, key: str) -> Codec:
    """One codec for a Python worker: its tables and remembered pieces serve all its tasks."""
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(ranks.value, pattern)
    return _codecs[key]


def _checked(docs: DataFrame, columns: tuple[str, ...]) -> None:
    if missing := [c for c in columns if c not in docs.columns]:
        raise ValueError(f"no column {missing}")


def encode(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN, digests: bool = False) -> DataFrame:
    """``keep`` columns and ``ids`` (array of int), or with ``digests`` counts and hashes of ids and decoded bytes.

    Null and empty texts have no ids.  Every row is answered, repeated rows each.  Columns of the
    input not named in ``keep`` are dropped, so their names cannot clash.
    """
    _checked(docs, (text, *keep))
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    key = f"{path}\n{pattern}"
    fields = [docs.schema[c] for c in keep]
    added = (
        [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
        if digests
        else [T.StructField("ids", T.ArrayType(T.IntegerType()))]
    )
    names = [f.name for f in fields + added]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks, pattern, key)
        sha = lambda raw: hashlib.sha256(raw).hexdigest()
        for batch in batches:
            column = batch.column(0)
            for part in slices(column, 1 << 20):
                ids, bounds = codec.encode([x or "" for x in column.slice(part.first, part.last - part.first).to_pylist()])
                if digests:
                    each = [ids[a:b] for a, b in zip(bounds, bounds[1:])]
                    made = [
                        pa.array(np.diff(bounds)),
                        pa.array([sha(x.astype("<u4").tobytes()) for x in each]),
                        pa.array([sha(codec.decode(x)) for x in each]),
                    ]
                else:
                    made = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))]
                rest = [batch.column(k + 1).slice(part.first, part.last - part.first) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*rest, *made], names)

    return docs.select(docs[text].alias("_text"), *(docs[c] for c in keep)).mapInArrow(encoded, T.StructType(fields + added))


def decode(encoded: DataFrame, *, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), path: str = VOCABULARY) -> DataFrame:
    """``keep`` columns and ``text``: the bytes of the ids as UTF-8.

    Null ids give a null text.  Bytes that are no UTF-8 (ids cut within a character) become U+FFFD.
    """
    _checked(encoded, (ids, *keep))
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(path))
    fields = [encoded.schema[c] for c in keep] + [T.StructField("text", T.StringType())]
    names = [f.name for f in fields]

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks, public_tokenizers.PATTERN, f"{path}\n{public_tokenizers.PATTERN}")
        for batch in batches:
            lists = batch.column(0)
            texts = [codec.decode(np.asarray(x.values, np.int64)).decode("utf-8", "replace") if x.is_valid else None for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], names)

    return encoded.select(encoded[ids].alias("_ids"), *(encoded[c] for c in keep)).mapInArrow(decoded, T.StructType(fields))
