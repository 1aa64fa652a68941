"""Decontamination, BPE and Matroska against brute force and exact round trips."""

from __future__ import annotations

import hashlib
import os
import random
import re
import struct
import zlib

import pytest
import tiktoken
from pyspark.sql import functions as F
from pyspark.sql import types as T

import public_tokenizers
from tallymill.llm import bpe, decontaminate, matroska

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def word_list(text):
    return W.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def python_hits(text, items, window):
    d = word_list(text)
    hit, found = [0] * len(d), set()
    for k, t in items:
        i = word_list(t)
        for w in [i] if 0 < len(i) < window else [i[j : j + window] for j in range(len(i) - window + 1)]:
            for p in range(len(d) - len(w) + 1):
                if d[p : p + len(w)] == w:
                    found.add(k)
                    hit[p : p + len(w)] = [1] * len(w)
    return d, hit, found


ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])


@pytest.mark.parametrize("window", [2, 3, 10])
def test_hits(spark, make_docs, window, monkeypatch):
    rng = random.Random(window)
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 20)  # several automata
    alphabet = ["a", "B", "é,", "c.", "x1"]
    items = [(k, " ".join(rng.choices(alphabet, k=rng.randint(0, 14)))) for k in range(9)] + [(1, "a b " * 7), (20, None), (None, "a b c d"), (21, "")]
    texts = [" ".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(60)] + ["", None, "...", "é" * 70_000, "a b " * 30_000]
    got = {r.doc_id: r for r in decontaminate.report(make_docs(texts), spark.createDataFrame(items, ITEMS), window=window).collect()}
    real = [(k, t) for k, t in items if k is not None and t]
    for k, text in enumerate(texts):
        if text and len(text) > 50_000:
            assert got[k].n_words == len(word_list(text))
            continue
        d, hit, found = python_hits(text, real, window)
        r = got[k]
        joined = ",".join(sorted(map(str, found)))
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(d), sum(hit), len(found), any(hit))
        assert r.items_sha256 == hashlib.sha256(joined.encode()).hexdigest()


def test_item_without_an_id(spark, make_docs):
    """Its words are hit, but it is not named."""
    passage = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(None, passage), (None, None)], ITEMS)
    got = decontaminate.report(make_docs(["x " + passage, "clean"]), bench).orderBy("doc_id").collect()
    assert [(r.n_hit, r.n_items, r.contaminated) for r in got] == [(11, 0, True), (0, 0, False)]
    assert got[0].items_sha256 == hashlib.sha256(b"").hexdigest()


def test_clean(spark, make_docs):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], ITEMS)
    item = "One, two three four five six seven eight nine ten eleven"
    docs = ["before it all stands some other text of words, " + item + "! and after it there is more text to be read", item, "clean text", None, "", "one two three"]
    got = {r.doc_id: r for r in decontaminate.clean(make_docs(docs), bench).collect()}
    assert got[0].text == "before it all stands some other text of words, ! and after it there is more text to be read"
    assert got[1].dropped and [got[k].text for k in (2, 3, 4, 5)] == ["clean text", None, "", "one two three"]
    assert not decontaminate.report(decontaminate.clean(make_docs(docs), bench), bench).where("contaminated").count()


def test_no_items_no_docs(spark, make_docs):
    none = spark.createDataFrame([], ITEMS)
    assert decontaminate.report(make_docs(["a b"]), none).first().n_hit == 0
    assert decontaminate.report(make_docs([]), spark.createDataFrame([(1, "a")], ITEMS)).count() == 0


def awkward(rng):
    bits = [" ", "a", "é", "ß", "  ", "\n", "1", "23", "%%%", "the", "日本", "😀", "\u0301", "\u00a0", "\u212a", "ing", "'s", "\t", "\u200b", "\x85", "\x1c", "aaaa", "--", "<|endoftext|>"]
    return ["".join(rng.choices(bits, k=rng.randint(0, 60))) for _ in range(800)] + ["a" * 3000, "ab" * 2000, "é" * 2000, "=-" * 3000, " " * 2000, "", None, "x" * 200_000]


def test_bpe_is_exact(make_docs, rng):
    texts = awkward(rng)
    ranks = bpe.read_ranks()
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = bpe.encode(make_docs(texts))
    got = {r.doc_id: r.ids for r in encoded.collect()}
    for k, text in enumerate(texts):
        if text is None or len(text) < 100_000:
            assert got[k] == want.encode_ordinary(text or ""), text
    back = {r.doc_id: r.text for r in bpe.decode(encoded).collect()}
    assert all(back[k] == (text or "") for k, text in enumerate(texts))


def test_bpe_digests(make_docs):
    row = bpe.encode(make_docs(["the day"]), digests=True).first()
    ids = bpe.encode(make_docs(["the day"])).first().ids
    assert row.n_tokens == len(ids)
    assert row.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
    assert row.decoded_sha256 == hashlib.sha256(b"the day").hexdigest()


def test_bpe_forgets(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    codec = bpe.Codec(bpe.read_ranks(), public_tokenizers.PATTERN)
    texts = ["some words here", "other words there", "more of them"]
    for text in texts * 2:
        ids, bounds = codec.encode([text, ""])
        assert codec.decode(ids) == text.encode() and list(bounds) == [0, len(ids), len(ids)]


def test_bpe_empty_and_repeated(make_docs):
    assert bpe.encode(make_docs([])).count() == 0
    docs = make_docs([(1, "a"), (1, "a"), (None, "a")]).withColumns({"ids": F.lit(1), "n_tokens": F.lit(2)})
    assert bpe.encode(docs).count() == 3 and bpe.encode(docs, digests=True).count() == 3


def test_matroska_round_trip(make_docs):
    texts = ["", None, "a", "é" * 32, "x" * 64, "y" * 65, "long " * 9_000, "x" * 64]
    stored = matroska.store(make_docs(texts))
    files = {r.doc_id: bytes(r.media) for r in stored.collect()}
    found = matroska.packets(stored).orderBy("doc_id", "packet").collect()
    digest = {r.doc_id: r for r in matroska.digests(make_docs(texts)).collect()}
    for k, text in enumerate(texts):
        raw = (text or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        rows = [r for r in found if r.doc_id == k]
        assert b"".join(files[k][r.byte_start : r.byte_start + r.byte_length] for r in rows) == payload
        times = [r.timestamp_ns for r in rows]
        assert times == sorted(set(times)) and {r.track for r in rows} == {1} and not any(r.error for r in rows)
        d = digest[k]
        assert (d.n_bytes, d.payload_bytes, d.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (d.tail_crc32, d.media_bytes, d.media_sha256) == (zlib.crc32(payload[-64:]), len(files[k]), hashlib.sha256(files[k]).hexdigest())
    assert digest[4].feature == digest[7].feature


def element(key, body, unknown=False):
    size = b"\x01" + b"\xff" * 7 if unknown else matroska._size(len(body))
    return key.to_bytes((key.bit_length() + 7) // 8, "big") + size + body


def test_matroska_lacing_groups_and_unknown_sizes():
    frames = [os.urandom(n) for n in (300, 2, 700)]
    xiph = b"\x02" + b"\xff\x2d" + b"\x02" + b"".join(frames)
    ebml = b"\x02" + matroska._size(300) + (300 - 2).to_bytes(2, "big")[:0] + ((2 - 300 + 8191) | 1 << 14).to_bytes(2, "big") + b"".join(frames)
    block = lambda lace, body: b"\x81" + struct.pack(">hB", 5, lace << 1) + body
    group = element(matroska.BLOCK_GROUP, element(matroska.BLOCK, block(1, xiph)) + element(matroska.REFERENCE_BLOCK, b"\x01"))
    cluster = element(matroska.CLUSTER, element(matroska.CLUSTER_TIMESTAMP, b"\x07") + element(matroska.SIMPLE_BLOCK, block(3, ebml)) + element(0xEC, b"void") + group, unknown=True)
    media = element(matroska.EBML, b"") + element(matroska.SEGMENT, cluster + cluster, unknown=True)
    found, summary = matroska.read(media)
    assert summary["error"] is None and summary["clusters"] == 2
    assert [media[p[4] : p[4] + p[5]] for p in found] == frames * 4
    assert {p[1] for p in found} == {12_000_000} and [p[2] for p in found[3:6]] == [False] * 3


def test_matroska_damage(spark):
    media = matroska.write(bytes(range(256)) * 300)
    whole, _ = matroska.read(media)
    for cut in range(0, len(media), 997):
        found, summary = matroska.read(media[:cut])
        assert [p[:6] for p in found] == [p[:6] for p in whole][: len(found)]
        assert summary["error"] or len(found) == len(whole) or cut == 0
    files = spark.createDataFrame([(1, bytearray(media[:5000])), (2, None), (3, bytearray(b"no file")), (4, bytearray())], "doc_id long, media binary")
    rows = matroska.packets(files).collect()
    assert {r.doc_id for r in rows if r.error} == {1, 3, 4} and not [r for r in rows if r.doc_id == 2]
