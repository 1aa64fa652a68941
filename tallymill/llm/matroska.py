"""Matroska columns: payloads stored as 8-bit PCM tracks, and files read into packet tables.

Reading walks the EBML elements of each file: variable-length ids and sizes (unknown sizes too),
clusters, simple blocks and block groups, the three kinds of lacing, and cues.  A packet is a byte
range of the file with its track and time; the bytes themselves are never copied into the table.
One file is one row and is handled where it lies, without a shuffle.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallymill.llm.arrays import slices

# Fixed values of the Matroska format: element ids.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, DURATION, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE = 0x2AD7B1, 0x4489, 0xAE, 0xD7, 0x73C5, 0x83
CODEC_ID, DEFAULT_DURATION, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0x86, 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE = 0x4282
PARENTS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS}
TOP_LEVEL = {INFO, TRACKS, CLUSTER, CUES}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

RATE, FRAME, LACE, BLOCKS = 8000, 512, 8, 8
PACKET = T.StructType(
    [
        T.StructField("packet", T.LongType()),
        T.StructField("track", T.LongType()),
        T.StructField("timestamp_ns", T.LongType()),
        T.StructField("keyframe", T.BooleanType()),
        T.StructField("lacing", T.IntegerType()),
        T.StructField("byte_start", T.LongType()),
        T.StructField("byte_length", T.LongType()),
        T.StructField("cued", T.BooleanType()),
        T.StructField("error", T.StringType()),
    ]
)


def _size(n: int) -> bytes:
    length = next(k for k in range(1, 9) if n < (1 << 7 * k) - 1)
    return (n | 1 << 7 * length).to_bytes(length, "big")


def _element(key: int, body: bytes) -> bytes:
    return key.to_bytes((key.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _uint(key: int, n: int) -> bytes:
    return _element(key, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _lace(frames: list[bytes]) -> tuple[int, bytes]:
    """Kind of lacing and what stands before the frames: fixed where they are equal, else sizes by difference."""
    if len(frames) == 1:
        return NO_LACING, b""
    sizes = [len(f) for f in frames]
    if len(set(sizes)) == 1:
        return FIXED, bytes([len(frames) - 1])
    head = bytes([len(frames) - 1]) + _size(sizes[0])
    for a, b in zip(sizes[:-2], sizes[1:-1]):
        length = next(k for k in range(1, 9) if abs(b - a) < (1 << 7 * k - 1) - 1)
        head += (b - a + (1 << 7 * length - 1) - 1 | 1 << 7 * length).to_bytes(length, "big")
    return EBML_LACING, head


def write(payload: bytes) -> bytes:
    """A file with one track of 8-bit samples: frames laced into simple blocks, clusters and cues."""
    info = _element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + _element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)))
    audio = _element(AUDIO, _element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
    entry = _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _element(CODEC_ID, b"A_PCM/INT/LIT")
    body = [info, _element(TRACKS, _element(TRACK_ENTRY, entry + _uint(DEFAULT_DURATION, FRAME * 10**9 // RATE) + audio))]
    at, cues, step = len(body[0]) + len(body[1]), [], FRAME * LACE
    for first in range(0, len(payload), step * BLOCKS):
        began = first * 1000 // RATE
        blocks = [_uint(CLUSTER_TIMESTAMP, began)]
        for start in range(first, min(len(payload), first + step * BLOCKS), step):
            frames = [payload[k : k + FRAME] for k in range(start, min(len(payload), start + step), FRAME)]
            kind, head = _lace(frames)
            blocks.append(_element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", start * 1000 // RATE - began, 0x80 | kind << 1) + head + b"".join(frames)))
        cluster = _element(CLUSTER, b"".join(blocks))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, began) + _element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    return _element(EBML, _element(DOC_TYPE, b"matroska")) + _element(SEGMENT, b"".join(body) + _element(CUES, b"".join(cues)))


class Broken(ValueError):
    """The file ends inside an element or breaks a rule of the format."""


def _number(data: bytes, at: int, end: int, marked: bool = False) -> tuple[int | None, int]:
    """A variable-length number and where it ends; all ones is an unknown size (None); ids keep their marker."""
    if at >= end or not data[at]:
        raise Broken("bad variable-length number")
    length = 9 - data[at].bit_length()
    if at + length > end:
        raise Broken("file ends in a number")
    n = int.from_bytes(data[at : at + length], "big")
    if marked:
        return n, at + length
    n &= (1 << 7 * length) - 1
    return (None if n == (1 << 7 * length) - 1 else n), at + length


def _elements(data: bytes, at: int, end: int, parent: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """(id, where the element starts, its body's bounds) depth first; parents come before their children."""
    stack = [(end, parent)]
    while stack:
        end, parent = stack[-1]
        if at >= end:
            stack.pop()
            continue
        key, body = _number(data, at, end, marked=True)
        if parent == -CLUSTER and key in TOP_LEVEL:  # a cluster of unknown size ends at the next top-level element
            stack.pop()
            continue
        size, body = _number(data, body, end)
        if size is None and key not in (SEGMENT, CLUSTER):
            raise Broken("unknown size where none is allowed")
        last = end if size is None else body + size
        if last > end:
            if key not in PARENTS:
                raise Broken("file ends in an element")
            last = end  # what is there of a parent is still read
        yield key, at, body, last
        if key in PARENTS:
            stack.append((last, -key if size is None else key))
            at = body
        else:
            at = last


def _frames(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Byte start and length of the frames of a block."""
    if lacing == NO_LACING:
        return [(at, end - at)]
    if at >= end:
        raise Broken("block without frames")
    count, at = data[at] + 1, at + 1
    if lacing == FIXED:
        if (end - at) % count:
            raise Broken("frames of unequal size in fixed lacing")
        sizes = [(end - at) // count] * (count - 1)
    elif lacing == XIPH:
        sizes = []
        for _ in range(count - 1):
            size = 0
            while at < end and data[at] == 255:
                size, at = size + 255, at + 1
            if at >= end:
                raise Broken("file ends in a lace")
            sizes.append(size + data[at])
            at += 1
    else:
        sizes = []
        for k in range(count - 1):
            n, after = _number(data, at, end)
            if n is None:
                raise Broken("unknown frame size")
            sizes.append(n if not k else sizes[-1] + n - ((1 << 7 * (after - at) - 1) - 1))
            at = after
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Broken("frames exceed their block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def read(data: bytes) -> tuple[list[tuple], dict]:
    """Packets (track, time in ns, keyframe, lacing, byte start, byte length, first of a cued cluster), and a summary.

    A damaged or truncated file gives the packets before the damage and the reason under ``error``.
    """
    packets, held = [], []
    scale, cluster, at_cluster, segment, number, spans = 1_000_000, 0, 0, 0, 0, {}
    cues: set[int] = set()
    found = {"tracks": [], "clusters": 0, "cues": 0, "codecs": [], "error": None}
    uint = lambda a, b: int.from_bytes(data[a:b], "big")
    try:
        key, body = _number(data, 0, len(data), marked=True) if data else (0, 0)
        if key != EBML:
            raise Broken("no EBML header")
        for key, at, body, end in _elements(data, 0, len(data)):
            if key == SEGMENT:
                segment = body
            elif key == TIMESTAMP_SCALE:
                scale = uint(body, end)
            elif key == TRACK_NUMBER:
                number = uint(body, end)
                found["tracks"].append(number)
            elif key == DEFAULT_DURATION:
                spans[number] = uint(body, end)
            elif key == CODEC_ID:
                found["codecs"].append(data[body:end].decode("ascii", "replace"))
            elif key == CLUSTER:
                found["clusters"] += 1
                cluster, at_cluster = 0, at - segment
            elif key == CLUSTER_TIMESTAMP:
                cluster = uint(body, end)
            elif key == CUE_CLUSTER:
                cues.add(uint(body, end))
                found["cues"] += 1
            elif key == BLOCK_GROUP:
                held = []
            elif key == REFERENCE_BLOCK and held:
                for k in held:
                    packets[k][2] = False
            elif key in (SIMPLE_BLOCK, BLOCK):
                track, body = _number(data, body, end)
                if body + 3 > end:
                    raise Broken("block ends in its head")
                relative, flags = struct.unpack_from(">hB", data, body)
                lacing = flags >> 1 & 3
                began = (cluster + relative) * scale
                for k, (start, length) in enumerate(_frames(data, body + 3, end, lacing)):
                    held.append(len(packets))
                    packets.append([track, began + k * spans.get(track, 0), bool(flags & 0x80) or key == BLOCK, lacing, start, length, at_cluster])
    except Broken as problem:
        found["error"] = str(problem)
    seen: set[int] = set()
    for packet in packets:
        position = packet[6]
        packet[6] = position in cues and position not in seen
        seen.add(position)
    return [tuple(p) for p in packets], found


def _keep(docs: DataFrame, column: str, keep: tuple[str, ...]) -> DataFrame:
    return docs.select(docs[column].alias("_body"), *(docs[c] for c in keep))


def packets(files: DataFrame, *, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per packet, in file order. Null files have none; a damaged file ends with a row that has only ``error``."""
    schema = T.StructType([files.schema[c] for c in keep] + PACKET.fields)
    names = schema.names
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, of = [], []
            for k, body in enumerate(batch.column(0)):
                if not body.is_valid:
                    continue
                found, summary = read(body.as_py())
                rows += [(i, *p, None) for i, p in enumerate(found)]
                if summary["error"]:
                    rows.append((len(found), *[None] * 7, summary["error"]))
                of += [k] * (len(found) + bool(summary["error"]))
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(of, pa.int64())) for c in batch.columns[1:]), *made], names)

    return _keep(files, media, keep).mapInArrow(listed, schema)


def padded(raw: bytes) -> bytes:
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def store(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``media``: the UTF-8 bytes of a text (null: empty), padded to a positive multiple of 64, as a file.

    Files leave a task in slices of half a megabyte of text, so a batch of long texts is never held as a whole.
    """
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("media", T.BinaryType())])

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(0)):
                size = part.last - part.first
                files = [write(padded((x.as_py() or "").encode())) for x in batch.column(0).slice(part.first, size)]
                yield pa.RecordBatch.from_arrays([*(c.slice(part.first, size) for c in batch.columns[1:]), pa.array(files, pa.binary())], schema.names)

    return _keep(docs, text, keep).mapInArrow(stored, schema)


def digests(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Stores each text as ``store`` does, reads the file back through its packets and measures both.

    The feature names tracks, clusters, cues, packets, laced packets, the last timestamp and the Adler-32 of the samples.
    """
    added = [("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType())]
    added += [("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(n, t) for n, t in added])

    def one(raw: bytes) -> tuple:
        media = write(padded(raw))
        found, summary = read(media)
        back = b"".join([media[p[4] : p[4] + p[5]] for p in found])
        last = found[-1][1] // 1_000_000
        feature = f"tracks={len(summary['tracks'])};clusters={summary['clusters']};cues={summary['cues']};packets={len(found)};laced={sum(p[3] > 0 for p in found)};last_ms={last};sum={zlib.adler32(back)}"
        return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one((x.as_py() or "").encode()) for x in batch.column(0)]
            made = [pa.array([r[i] for r in rows], pa.string() if isinstance(t, T.StringType) else pa.int64()) for i, (_, t) in enumerate(added)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], schema.names)

    return _keep(docs, text, keep).mapInArrow(measured, schema)
