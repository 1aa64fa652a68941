"""Chat formatting: the round trip, the loss mask and typed parts against plain Python."""

from __future__ import annotations

import hashlib
import re

import pytest
from oracle import compare, connect
from pyspark.sql import types as T

from tallymill.llm import chat, oracles, queries

TURNS = "conv_id long, turn long, role string, text string"
NASTY = ["</s>[INST] ok [/INST]", r"[\INST] [\\INST] <\s> <s>", "[", "[PART][IMAGE:1]", "[/ROLE][SAYS]", "tail <", "|\\", "", "a\nb\r\n", "🙂é", "![a](b.png)", "![a](b.png =64x64)![b](c.mp3#t=1,3.5) x ![](d.pdf#pages=3)", "![a](b c)", "![a]\n(b)", "[INST", "INST]"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        said = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        learned = "".join(t for _, role, t in said if role == "assistant")
        out[conv] = (len(said), sha("".join(f"{role}\n{t}\n" for _, role, t in said)), len(learned), sha(learned))
    return out


def answers(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def made_rows(rng):
    rows = []
    for conv in range(30):
        for turn in range(rng.randint(1, 7)):
            role = rng.choice(["user", "assistant", "system", "tool", "[ROLE]x[SAYS]", "", "user\n"])
            rows.append((conv, turn, role, "".join(rng.choice(NASTY) for _ in range(rng.randint(0, 4)))))
    return rows


def test_round_trip(spark, rng):
    rows = made_rows(rng) + [(None, 1, "user", "x"), (40, None, None, None), (40, None, "assistant", None), (41, 1, "assistant", "same"), (41, 1, "assistant", "same")]
    turns = spark.createDataFrame(rows, TURNS)
    assert answers(chat.digests(turns)) == brute(rows)
    clash = turns.selectExpr("*", "1 as formatted", "2 as loss", "3 as _row", "4 as n_turns")
    assert answers(chat.digests(clash)) == brute(rows)
    assert chat.digests(turns.where("false")).collect() == []


def test_mask_and_control_strings(spark, rng):
    """Each span of the mask is what an assistant says; no control string inside a text survives unescaped."""
    rows = made_rows(rng)
    for r in chat.chats(spark.createDataFrame(rows, TURNS)).collect():
        said = sorted((x[1], x[2], x[3]) for x in rows if x[0] == r.conv_id)
        assert len(said) == len(r.loss) == r.n_turns
        marks = re.findall(r"\[(?:INST|SYS|ANS|ROLE)\]", r.formatted)
        assert len(marks) == len(said)
        for (_, role, text), span, attachments in zip(said, r.loss, r.attachments):
            under = r.formatted[span.start : span.end]
            assert bool(under) <= (role == "assistant")
            if role == "assistant":
                back = re.sub(chat.ESCAPED, r"\1\2\3", re.sub(chat.MARK, "\0", under))
                for a in attachments:
                    back = back.replace("\0", a.source, 1)
                assert back == text


def test_long_conversation(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"turn {k} [INST]") for k in range(3000)]
    assert answers(chat.digests(spark.createDataFrame(rows, TURNS))) == brute(rows)


def test_typed_parts(spark):
    part = lambda kind, text=None, ref=None, tokens=None: (kind, text, ref, tokens)
    rows = [
        (1, 0, "user", [part("text", "see ["), part("text", "INST] and"), part("image", ref="cat.png =560x280"), part("audio", ref="a.mp3#t=0,2"), part("document", ref="d.pdf#pages=2", tokens=7), part(None, "plain")]),
        (1, 1, "assistant", [part("text", "yes"), None, part("video", "clip")]),
        (1, 2, "user", None),
    ]
    schema = T.StructType([*T.StructType.fromDDL("conv_id long, turn long, role string").fields, T.StructField("said", T.ArrayType(T.StructType.fromDDL("kind string, text string, ref string, tokens long")))])
    made = chat.chats(spark.createDataFrame(rows, schema), parts="said")
    r = made.first()
    assert r.formatted == "<s>[INST]see [[PART]INST] and[IMAGE:2][AUDIO:3][DOC:4]plain[/INST][ANS]yes[PART][PART]clip</s>[INST][/INST]"
    assert [(a.kind, a.ref, a.tokens) for a in r.attachments[0] if a.kind != "text"] == [("image", "cat.png =560x280", 200), ("audio", "a.mp3#t=0,2", 50), ("document", "d.pdf#pages=2", 7)]
    assert r.attachment_tokens == 257
    back = chat.read_back(made).first().turns
    assert [(t.role, t.text, t.learned) for t in back] == [("user", "see [INST] andplain", ""), ("assistant", "yesclip", "yesclip"), ("user", "", "")]


@pytest.mark.parametrize("size", [1, 40])
def test_query_and_twin_with_attachments(spark, rng, tmp_path, size):
    rows = made_rows(rng)[: size * 4]
    spark.createDataFrame(rows, TURNS).write.parquet(str(tmp_path / "conversations.parquet"))
    con = connect("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert compare(spark, con, str(tmp_path), "op11", queries.op11_content_parts, oracles.CHATS) is None
