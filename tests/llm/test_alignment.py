"""Alignment of two tokenizers against a brute-force version without bitmaps."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tokenizers

from tallymill.llm import alignment


@pytest.fixture(scope="module")
def brute():
    a_side = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    ranks = {}
    import base64

    for line in open(P.path("byte_bpe_50k.tiktoken"), "rb"):
        piece, rank = line.split()
        ranks[int(rank)] = base64.b64decode(piece)

    def b_bytes(k):
        piece = b_side.id_to_piece(int(k))
        return bytes([int(piece[3:5], 16)]) if b_side.is_byte(int(k)) else piece.replace("▁", " ").encode()

    def spans(pieces):
        out, at = [], 0
        for p in pieces:
            out.append((at, at + len(p)))
            at += len(p)
        return out

    def run(rows):
        docs = []
        for key, text in rows:
            links, groups, a, b = [], [], [], []
            if text:
                a, b = a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)
                pa_, pb = [ranks[k] for k in a], [b_bytes(k) for k in b]
                if not b"".join(pa_) == b"".join(pb) == b" " + text.encode():
                    a, b = [], []
                else:
                    sa, sb = spans(pa_), spans(pb)
                    links = [(x, y) for x, (l1, r1) in zip(a, sa) for y, (l2, r2) in zip(b, sb) if max(l1, l2) < min(r1, r2)]
                    both = sorted({r for _, r in sa} & {r for _, r in sb})
                    lo = 0
                    for hi in both:
                        inside = lambda ids, ss: ",".join(str(k) for k, (x, y) in zip(ids, ss) if lo <= x and y <= hi)  # noqa: B023, E731
                        groups.append(f"{inside(a, sa)}|{inside(b, sb)}")
                        lo = hi
            docs.append((key, a, b, groups, links))
        count = Counter(x for d in docs for x in d[4])
        top = Counter()
        for (_, y), n in count.items():
            top[y] = max(top[y], n)
        sha = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
        rows = [(k, len(a), len(b), len(g), len(x), sum(count[p] == top[p[1]] for p in x), sum(count[p] for p in x), sha(g)) for k, a, b, g, x in docs]
        return sorted(rows, key=str), count, docs

    return run


def answers(df):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()), key=str)


ROWS = [
    (1, None),
    (2, ""),
    (3, " "),
    (4, "the the the the " * 300),
    (5, "<|endoftext|> </s> <s> <unk> <0x41> ▁ stays text"),
    (6, "tab\tand\nlines\r\n  two  blanks "),
    (7, "Äpfel, naïve, 東京, 🙂🙃, é,  , ﬁ, ​"),
    (8, "zero\x00byte"),
    (9, "1234567890 3.14159 -- __init__  "),
    (10, "the cat sat on the mat"),
    (10, "the cat sat on the mat"),
    (None, "a row without an id"),
    (11, "x" * 3000),
]


def test_against_brute_force(make_docs, brute, rng):
    words = "the of cat Katze maison übergroß internationalization naïveté 42 !! \n".split(" ")
    rows = ROWS + [(100 + k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for k in range(60)]
    want, count, _ = brute(rows)
    docs = make_docs(rows).repartition(3)
    assert answers(alignment.report(docs)) == want
    clash = docs.selectExpr("*", "1 as block", "2 as number", "3 as n_a", "4 as planes", "5 as k0", "6 as _text")
    assert answers(alignment.report(clash)) == want
    _, postings = alignment.align(docs)
    pairs = {(r.a, r.b): (r.n_docs, r.n_links) for r in alignment.pair_counts(postings).collect()}
    assert {k: v[1] for k, v in pairs.items()} == dict(count)


def test_small_blocks_and_dense_planes(make_docs, brute, monkeypatch):
    rows = [(k, "the cat " * (1 + k % 5)) for k in range(40)]
    want, _, _ = brute(rows)
    for dense in (1, 4096):
        doc = np.arange(40, dtype=np.uint16)
        counts = np.array([1 + k % 5 for k in range(40)])
        monkeypatch.setattr(alignment, "DENSE", dense)
        made = alignment.planes(doc, counts, np.array([0, 10, 40])).to_pylist()
        for lo, hi, planes in ((0, 10, made[0]), (10, 40, made[1])):
            back = Counter()
            for k, plane in enumerate(planes):
                for d in alignment.members(plane):
                    back[int(d)] += 1 << k
            assert back == {d: 1 + d % 5 for d in range(lo, hi)}
    assert answers(alignment.report(make_docs(rows))) == want


def test_empty_table(make_docs):
    assert alignment.report(make_docs([])).collect() == []
    assert answers(alignment.report(make_docs([(1, None)]))) == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_ranks_and_merge_lists_agree(rng):
    """The tokenizer by ranks gives the ids of the file's own library, on every entry and on mixed ones."""
    pair = alignment.Pair(alignment.BYTE_LEVEL, alignment.PIECES)
    assert pair.ranked is not None
    entries = [pair.a.decode([k]) for k in range(pair.a.get_vocab_size())]
    texts = entries + ["".join(rng.choices(entries, k=6)) for _ in range(20_000)] + [t for _, t in ROWS if t]
    ranked = [x.tolist() for x in pair.encode_a(texts)]
    pair.ranked = None
    assert ranked == [x.tolist() for x in pair.encode_a(texts)]
