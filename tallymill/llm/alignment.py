"""Alignment of two tokenizers: which tokens cover the same bytes, counted with inverted pair bitmaps.

A link is a pair of occurrences, one token of each tokenizer, whose byte ranges overlap.  Documents are
numbered within blocks.  For each pair of ids and block a posting holds compressed bitmaps of document
numbers, one for each binary digit of the number of links a document has of that pair: the plane of
digit k has the documents with that digit set.  The planes OR-merged and popcounted give the documents
of a pair, the planes' popcounts times 2^k its links.  Corpus-wide counts need those numbers only; bitmaps
travel once, with the counts of their pair, to the block whose documents they name, where the
postings return each document's scores.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymill.llm.arrays import slices
from tallymill.session import scratch_path

BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Documents of a block at most, so that a number takes 16 bits; and links after which a block is closed.
BLOCK_DOCS, BLOCK_LINKS = 1 << 16, 1 << 22
#: A plane of this many documents or more is a bitmap of the block's documents, else a list of their numbers, which is shorter.
DENSE = BLOCK_DOCS // 16
#: Bits of a B id in a key of pair and document.
B_BITS = 24
SLICE = 1 << 18
NONE = np.zeros(0, np.int64)


@dataclass
class Tokens:
    """Ids of some texts end to end: ``ends`` are the bytes up to each token's end, ``bounds`` those of the texts."""

    ids: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    data: np.ndarray


class Vocabulary:
    """Bytes of every id of a tokenizer, end to end."""

    def __init__(self, pieces: list[bytes]):
        self.length = np.array([len(p) for p in pieces], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(pieces), np.uint8)

    def read(self, lists: list[np.ndarray]) -> Tokens:
        bounds = np.zeros(len(lists) + 1, np.int64)
        np.cumsum([len(x) for x in lists], out=bounds[1:])
        ids = np.concatenate([NONE, *lists]).astype(np.int64)
        length = self.length[ids]
        ends = np.cumsum(length)
        at = np.arange(int(length.sum())) + np.repeat(self.begin[ids] - (ends - length), length)
        return Tokens(ids, ends, bounds, self.data[at])


def _byte_letters() -> dict[str, int]:
    """The byte behind each letter of a byte-level vocabulary: printable Latin-1 stands for itself, others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    return letters | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


class Pair:
    """Both tokenizers; A encodes space and text, B the text, to which it adds a space itself.

    Where A's merges stand in the order of the ids they make, merging by least rank gives the same ids as
    merging by the list, and the faster library does it from the same file; else the file's own library.
    """

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        letters = _byte_letters()
        size = self.a.get_vocab_size(with_added_tokens=True)
        entries = [self.a.id_to_token(k) or "" for k in range(size)]
        self.bytes_a = Vocabulary([bytes(letters[c] for c in x) if all(c in letters for c in x) else x.encode() for x in entries])
        piece = lambda k: bytes([int(self.b.id_to_piece(k)[3:-1], 16)]) if self.b.is_byte(k) else self.b.id_to_piece(k).replace("▁", " ").encode()
        self.bytes_b = Vocabulary([piece(k) for k in range(self.b.get_piece_size())])

        self.ranked = None
        with open(byte_level) as file:
            model = json.load(file)["model"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if all(model["vocab"].get(x + y) == 256 + k for k, (x, y) in enumerate(merges)) and len(model["vocab"]) - len(merges) in (256, 257):
            ranks = {bytes(letters[c] for c in x): k for x, k in model["vocab"].items() if k < 256 + len(merges)}
            self.ranked = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode_a(self, texts: list[str]) -> list[np.ndarray]:
        if self.ranked is not None:
            return [self.ranked.encode_to_numpy(" " + t) if t else NONE for t in texts]
        made = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        return [np.array(x.ids if t else [], np.int64) for t, x in zip(texts, made)]

    def encode(self, texts: list[str]) -> tuple[Tokens, Tokens]:
        """Tokens of both; a text whose bytes do not come out of both has none."""
        lists = [self.encode_a(texts), [np.array(x if t else [], np.int64) for t, x in zip(texts, self.b.encode(texts, num_threads=1))]]
        want = [b" " + t.encode() if t else b"" for t in texts]
        made = [v.read(x) for v, x in zip((self.bytes_a, self.bytes_b), lists)]
        if wrong := {k for side in made for k in self._wrong(side, want)}:
            made = [v.read([NONE if k in wrong else y for k, y in enumerate(x)]) for v, x in zip((self.bytes_a, self.bytes_b), lists)]
        return made[0], made[1]

    @staticmethod
    def _wrong(side: Tokens, want: list[bytes]) -> list[int]:
        """Texts whose tokens' bytes are not those wanted."""
        data, ends = side.data.tobytes(), np.concatenate([[0], side.ends])[side.bounds]
        if data == b"".join(want) and np.array_equal(np.diff(ends), [len(w) for w in want]):
            return []
        return [k for k, w in enumerate(want) if data[ends[k] : ends[k + 1]] != w]


_pairs: dict[tuple[str, str], Pair] = {}


def _pair(byte_level: str, pieces: str) -> Pair:
    """One pair of tokenizers for a Python worker."""
    if (byte_level, pieces) not in _pairs:
        _pairs[byte_level, pieces] = Pair(byte_level, pieces)
    return _pairs[byte_level, pieces]


@dataclass
class Links:
    """Links of some texts in order: text, A id, B id; and where groups end, for each token."""

    text: np.ndarray
    a: np.ndarray
    b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    groups: np.ndarray


def link(a: Tokens, b: Tokens) -> Links:
    """All overlapping pairs of occurrences.

    Both tokenizers cut the same bytes, so between two neighbouring cuts of either lies one token of
    each: the pieces between all cuts are the links, and cuts of both end the groups.
    """
    total = int(a.ends[-1]) if len(a.ends) else 0
    cut_a, cut_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
    cut_a[a.ends], cut_b[b.ends] = True, True
    cuts, shared = np.flatnonzero(cut_a | cut_b), np.flatnonzero(cut_a & cut_b)
    before = lambda marks, at: np.cumsum(marks, dtype=np.int64)[at] - marks[at]
    of_a, of_b = before(cut_a, cuts), before(cut_b, cuts)
    text = np.searchsorted(a.bounds, of_a, "right") - 1
    both = cut_a & cut_b
    groups = np.bincount(np.searchsorted(a.bounds, before(cut_a, shared), "right") - 1, minlength=len(a.bounds) - 1)
    return Links(text, a.ids[of_a], b.ids[of_b], before(both, a.ends), before(both, b.ends), groups)


def group_texts(a: Tokens, b: Tokens, links: Links) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each text: its groups in order, decimal ids. Written as one array of digits."""
    count = int(max(links.group_a.max(initial=-1), links.group_b.max(initial=-1))) + 1
    in_a, in_b = np.bincount(links.group_a, minlength=count), np.bincount(links.group_b, minlength=count)
    ids = np.empty(len(a.ids) + len(b.ids), np.int64)
    mark = np.full(len(ids), ord(","), np.uint8)
    at_a = np.arange(len(a.ids)) + (np.cumsum(in_b) - in_b)[links.group_a]
    at_b = np.arange(len(b.ids)) + np.cumsum(in_a)[links.group_b]
    ids[at_a], ids[at_b] = a.ids, b.ids
    ends = np.cumsum(in_a + in_b)
    mark[ends - in_b - 1], mark[ends - 1] = ord("|"), ord(";")
    wide = max(1, len(str(int(ids.max(initial=0)))))
    digits = np.empty((len(ids), wide + 1), np.uint8)
    rest = ids.copy()
    for k in range(wide - 1, -1, -1):
        digits[:, k] = rest % 10 + 48
        rest //= 10
    digits[:, wide] = mark
    length = 1 + np.searchsorted(10 ** np.arange(1, wide + 1), ids, "right")
    shown = np.arange(wide + 1) >= wide - length[:, None]
    data = digits[shown].tobytes()
    stop = np.concatenate([[0], np.cumsum(length + 1)])
    bounds = stop[a.bounds + b.bounds]
    return [data[x : y - 1] if y > x else b"" for x, y in zip(bounds, bounds[1:])]


@dataclass
class Block:
    """Links of the documents of one block, as sorted keys (pair, document) with their numbers."""

    docs: int = 0
    links: int = 0
    keys: list[np.ndarray] = field(default_factory=list)
    counts: list[np.ndarray] = field(default_factory=list)

    def add(self, links: Links, docs: int) -> None:
        pair = (links.a.astype(np.uint64) << np.uint64(B_BITS)) | links.b.astype(np.uint64)
        keys, counts = np.unique((pair << np.uint64(16)) | (links.text + self.docs).astype(np.uint64), return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.docs += docs
        self.links += len(keys)

    def postings(self) -> Iterator[tuple[np.ndarray, ...]]:
        """(a, b, documents, links, planes) of all pairs, some thousand at a time."""
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        pair, doc = keys >> np.uint64(16), (keys & np.uint64(0xFFFF)).astype(np.uint16)
        edges = np.append(np.flatnonzero(np.diff(pair, prepend=pair[:1] + np.uint64(1))), len(pair))
        for first in range(0, len(edges) - 1, 1 << 16):
            some = edges[first : first + (1 << 16) + 1]
            lo, hi = some[0], some[-1]
            yield (pair[some[:-1]] >> np.uint64(B_BITS), pair[some[:-1]] & np.uint64((1 << B_BITS) - 1), np.diff(some), np.add.reduceat(counts[lo:hi], some[:-1] - lo), planes(doc[lo:hi], counts[lo:hi], some - lo))


def planes(doc: np.ndarray, counts: np.ndarray, edges: np.ndarray) -> pa.ListArray:
    """For each pair the planes of its documents' numbers of links, lowest digit first, as compressed bitmaps.

    A plane of less than ``DENSE`` documents is the list of their 16-bit numbers, a larger one a bitmap.
    """
    pair = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    digits = np.frexp(np.maximum.reduceat(counts, edges[:-1]).astype(np.float64))[1].astype(np.int64)
    slot = np.cumsum(digits) - digits
    at, members = [], []
    for k in range(int(digits.max())):
        some = np.flatnonzero((counts >> k) & 1)
        at.append(slot[pair[some]] + k)
        members.append(doc[some])
    at, members = np.concatenate(at), np.concatenate(members)
    order = np.argsort(at, kind="stable")
    at, members = at[order], members[order]
    size = np.bincount(at, minlength=int(digits.sum()))
    stop = np.cumsum(size)
    raw, width = members.astype("<u2").tobytes(), size * 2
    if size.max() >= DENSE:
        parts, width = [], width.copy()
        for k in range(len(size)):
            some = members[stop[k] - size[k] : stop[k]]
            if size[k] >= DENSE:
                parts.append(np.packbits(np.bincount(some, minlength=BLOCK_DOCS).astype(bool), bitorder="little").tobytes())
                width[k] = len(parts[-1])
            else:
                parts.append(some.astype("<u2").tobytes())
        raw = b"".join(parts)
    offsets = np.concatenate([[0], np.cumsum(width)]).astype(np.int32)
    values = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(digits)]).astype(np.int32)), values)


def members(plane: bytes) -> np.ndarray:
    """Document numbers of a compressed bitmap."""
    if len(plane) == BLOCK_DOCS // 8:
        return np.flatnonzero(np.unpackbits(np.frombuffer(plane, np.uint8), bitorder="little"))
    return np.frombuffer(plane, "<u2").astype(np.int64)


def align(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> tuple[DataFrame, DataFrame]:
    """Documents (``keep``, block, number, n_a, n_b, n_groups, n_links, groups_sha256) and postings (block, a, b, n_docs, n_links, planes).

    Both are written in one pass to the shared folder.  Texts that are null, empty, or that a tokenizer
    does not give back byte for byte have no tokens and no links.  Every row is a document of its own,
    repeated rows too; columns not named in ``keep`` are dropped, so their names cannot clash.
    """
    fields = [T.StructField(f"k{k}", docs.schema[c].dataType) for k, c in enumerate(keep)]
    schema = T.StructType(
        [T.StructField("block", T.LongType()), T.StructField("posting", T.BooleanType()), *fields]
        + [T.StructField(c, T.LongType()) for c in ("number", "n_a", "n_b", "n_groups")]
        + [T.StructField("groups_sha256", T.StringType())]
        + [T.StructField(c, T.LongType()) for c in ("a", "b", "n_docs", "n_links")]
        + [T.StructField("planes", T.ArrayType(T.BinaryType()))]
    )
    names = schema.names

    def row(block: int, n: int, **columns) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_schema

        made = {"block": pa.array(np.full(n, block, np.int64)), "posting": pa.array(np.full(n, "planes" in columns))} | columns
        return pa.RecordBatch.from_arrays([made[f.name].cast(f.type) if f.name in made else pa.nulls(n, f.type) for f in to_arrow_schema(schema)], names)

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(byte_level, pieces)
        task, closed, block = TaskContext.get().partitionId() << 32, 0, Block()

        def close() -> Iterator[pa.RecordBatch]:
            if block.links:
                for a, b, n_docs, n_links, made in block.postings():
                    yield row(task + closed, len(a), a=pa.array(a), b=pa.array(b), n_docs=pa.array(n_docs), n_links=pa.array(n_links), planes=made)

        for batch in batches:
            for part in slices(batch.column(0), SLICE):
                first, size = part.first, part.last - part.first
                for at in range(first, first + size, BLOCK_DOCS):
                    n = min(BLOCK_DOCS, first + size - at)
                    if block.docs + n > BLOCK_DOCS or block.links > BLOCK_LINKS:
                        yield from close()
                        closed, block = closed + 1, Block()
                    a, b = pair.encode([x or "" for x in batch.column(0).slice(at, n).to_pylist()])
                    links = link(a, b)
                    shown = [hashlib.sha256(x).hexdigest() if x else "" for x in group_texts(a, b, links)]
                    yield row(
                        task + closed,
                        n,
                        **{f"k{k}": batch.column(k + 1).slice(at, n) for k in range(len(keep))},
                        number=pa.array(np.arange(block.docs, block.docs + n)),
                        n_a=pa.array(np.diff(a.bounds)),
                        n_b=pa.array(np.diff(b.bounds)),
                        n_groups=pa.array(links.groups),
                        n_links=pa.array(np.bincount(links.text, minlength=n)),
                        groups_sha256=pa.array(shown),
                    )
                    block.add(links, n)
        yield from close()

    path = scratch_path(docs.sparkSession, "alignment")
    made = docs.select(docs[text].alias("_text"), *(docs[c].alias(f"k{k}") for k, c in enumerate(keep))).mapInArrow(aligned, schema)
    made.write.partitionBy("posting").parquet(path)
    both = docs.sparkSession.read.schema(schema).parquet(path)
    rows = both.where("not posting").select("block", "number", *(F.col(f"k{k}").alias(c) for k, c in enumerate(keep)), "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return rows, both.where("posting").select("block", "a", "b", "n_docs", "n_links", "planes")


def pair_counts(postings: DataFrame) -> DataFrame:
    """(a, b, n_docs, n_links, best) over the corpus: documents and links of each pair, and whether no pair of its b has more links.

    Documents of two blocks are never the same, so the popcounts of the blocks' merged planes add up.
    """
    counted = postings.groupBy("a", "b").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))
    top = counted.groupBy("b").agg(F.max("n_links").alias("_top"))
    return counted.join(top, "b").select("a", "b", "n_docs", "n_links", (F.col("n_links") == F.col("_top")).alias("best"))


def scores(postings: DataFrame, counts: DataFrame) -> DataFrame:
    """(block, number, n_best, count_sum): each document's links with the most frequent partner of their b, and its links' counts in all.

    Postings come sorted by block, so a task keeps the sums of one block's documents at a time.
    """
    priced = postings.select("block", "a", "b", "planes").join(counts.select("a", "b", F.col("n_links").alias("count"), "best"), ["a", "b"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best, total = None, None, None

        def done() -> Iterator[pa.RecordBatch]:
            if block is not None:
                some = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), block)), pa.array(some), pa.array(best[some]), pa.array(total[some])], ["block", "number", "n_best", "count_sum"])

        for batch in batches:
            column = lambda k: batch.column(k).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            blocks, price, top, lists = column(0), column(1), column(2).astype(bool), batch.column(3)
            edges = np.append(np.flatnonzero(np.diff(blocks, prepend=blocks[:1] - 1)), len(blocks))
            for lo, hi in zip(edges, edges[1:]):
                if blocks[lo] != block:
                    yield from done()
                    block, best, total = int(blocks[lo]), np.zeros(BLOCK_DOCS, np.int64), np.zeros(BLOCK_DOCS, np.int64)
                some = lists.slice(lo, hi - lo)
                flat = some.flatten()
                size = np.diff(np.asarray(some.offsets))
                digit = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
                worth, good = np.repeat(price[lo:hi], size) << digit, np.repeat(top[lo:hi], size).astype(np.int64) << digit
                offsets = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1].astype(np.int64)
                width = np.diff(offsets)
                dense = width == BLOCK_DOCS // 8
                raw = flat.buffers()[2]
                for k in np.flatnonzero(dense):
                    who = members(flat[int(k)].as_py())
                    best[who] += good[k]
                    total[who] += worth[k]
                data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
                if dense.any():
                    data = data[np.repeat(~dense, width)]
                who, n = np.frombuffer(data.tobytes(), "<u2"), np.where(dense, 0, width // 2)
                np.add.at(best, who, np.repeat(good, n))
                np.add.at(total, who, np.repeat(worth, n))
        yield from done()

    dealt = priced.repartition("block").sortWithinPartitions("block").select("block", "count", "best", "planes")
    return dealt.mapInArrow(summed, "block long, number long, n_best long, count_sum long")


def report(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), **files: str) -> DataFrame:
    """``keep``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document; see ``align``."""
    rows, postings = align(docs, text=text, keep=keep, **files)
    counts = pair_counts(postings)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    scored = scores(postings, counts).withColumnsRenamed({"block": "_block", "number": "_number"})
    out = rows.join(scored, (rows.block == scored._block) & (rows.number == scored._number), "left")
    return out.select(*(rows[c] for c in keep), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
