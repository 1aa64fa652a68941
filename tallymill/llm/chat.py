r"""Chat formatting with typed content parts; native columns only.

A message is a list of parts: text, image, audio or document.  A visitor flattens it: text is escaped,
any other part becomes a placeholder with the part's number, and is recorded with its reference and the
number of tokens that it will take.  A conversation is ``<s>`` and its turns:

    [SYS]...[/SYS]   [INST]...[/INST]   [ANS]...</s>   [ROLE]any other role[SAYS]...[/ROLE]

Inside texts and roles a control string gets a backslash after its first character, or one more where
it has some, so texts can say anything and come back as they were.  What assistants say is under the loss
mask.  A conversation is one string by definition, so its turns meet in one task; they are shuffled once, as
they came, and formatted there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.llm.spans import CHUNK, let

KINDS = {"image": "IMAGE", "audio": "AUDIO", "document": "DOC"}
#: Opening and closing marks of a role's turn.
FRAMES = {"user": ("[INST]", "[/INST]"), "system": ("[SYS]", "[/SYS]"), "assistant": ("[ANS]", "</s>")}
OTHER = ("[ROLE]", "[SAYS]", "[/ROLE]")
BEGIN = "<s>"
NAMES = r"/?s>|/?INST\]|/?SYS\]|ANS\]|/?ROLE\]|SAYS\]|PART\]|(?:IMAGE|AUDIO|DOC):"
PLAIN, ESCAPED = rf"([<\[])(\\*)({NAMES})", rf"([<\[])\\(\\*)({NAMES})"
TURN = r"(?=\[(?:INST|SYS|ANS|ROLE)\])"
MARK = r"\[(?:(?:IMAGE|AUDIO|DOC):[0-9]+|PART)\]"
#: An attachment written into a text: ``![title](reference)``, with `` =640x480`` for the size of an image.
INLINE = r"!\[[^\[\]\n]*\]\([^()\x20\n]+(?:\x20=[0-9]+x[0-9]+)?\)"
SOUNDS, PAGES = r"\.(?:mp3|wav|flac|ogg|m4a)(?:[#\x20)]|$)", r"\.(?:pdf|docx|pptx|xlsx|txt|html)(?:[#\x20)]|$)"

#: Pixels of a patch's side, patches of an image at least, at most and by default; tokens of a second and by default; of a page.
PATCH, PATCHES, IMAGE = 28, (4, 16384), 256
SECOND, SOUND = 25, 750
PAGE = 1024

PART = "struct<kind:string,text:string,ref:string,tokens:long>"
ATTACHMENT = "struct<part:int,kind:string,ref:string,tokens:long,source:string>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(PLAIN), F.lit(r"$1\\$2$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(ESCAPED), F.lit("$1$2$3"))


def _number(text: Column, pattern: str, group: int = 1) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found.cast("double"))


def attachment_tokens(kind: Column, ref: Column) -> Column:
    """Tokens of an attachment: patches of an image by `` =WxH``, seconds of a sound by ``#t=a,b``, pages of a document by ``#pages=n``."""
    patches = F.ceil(_number(ref, r"\x20=([0-9]+)x", 1) / PATCH) * F.ceil(_number(ref, r"\x20=[0-9]+x([0-9]+)", 1) / PATCH)
    image = F.coalesce(F.greatest(F.lit(PATCHES[0]), F.least(F.lit(PATCHES[1]), patches)), F.lit(IMAGE))
    clip = r"#t=([0-9]+(?:\.[0-9]+)?),([0-9]+(?:\.[0-9]+)?)"
    sound = F.coalesce(F.ceil(F.greatest(_number(ref, clip, 2) - _number(ref, clip, 1), F.lit(0.0)) * SECOND), F.lit(SOUND))
    pages = F.coalesce(_number(ref, r"#pages=([0-9]+)"), F.lit(1.0)) * PAGE
    return F.when(kind == "image", image).when(kind == "audio", sound).when(kind == "document", pages).otherwise(0).cast("long")


def parts_of(text: Column) -> Column:
    """The typed parts of a text with attachments written into it: texts and attachments in turn, which joined are the text."""

    def attached(mark: Column) -> Column:
        ref = F.regexp_extract(mark, r"\]\((.*)\)$", 1)
        kind = F.when(F.rlike(ref, F.lit(SOUNDS)), "audio").when(F.rlike(ref, F.lit(PAGES)), "document").otherwise("image")
        return F.struct(kind.alias("kind"), mark.alias("text"), ref.alias("ref"), attachment_tokens(kind, ref).alias("tokens"))

    plain = lambda t: F.struct(F.lit("text").alias("kind"), t.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("long").alias("tokens"))
    cut = lambda: let(
        F.struct(F.split(text, INLINE, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(INLINE), F.lit(0)).alias("marks")),
        lambda s: F.filter(F.flatten(F.zip_with(s.gaps, F.transform(s.marks, attached), lambda g, m: F.array(plain(g), m))), lambda p: p.isNotNull()),
    )
    return F.when(F.contains(text, F.lit("](")), cut()).otherwise(F.array(plain(text)))


def flatten(parts: Column) -> Column:
    """Struct of content (escaped texts and placeholders in order) and attachments (one entry per mark in it).

    A text that follows a text is parted from it by ``[PART]``, an entry of kind ``text``.  A null part, and
    one of unknown kind, counts as its text.
    """

    def visit(p: Column, k: Column) -> Column:
        other = F.coalesce(p.kind, F.lit("text")).isin(*KINDS)
        after = (k > 0) & ~other & ~F.coalesce(F.get(parts, k - 1).kind, F.lit("text")).isin(*KINDS)
        name = F.element_at(F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair)), p.kind)
        words = F.coalesce(p.text, F.lit(""))
        placed = F.when(other, F.concat(F.lit("["), name, F.lit(":"), k.cast("string"), F.lit("]"))).otherwise(F.concat(F.when(after, "[PART]").otherwise(""), escape(words)))
        entry = F.struct(
            k.alias("part"),
            F.when(other, p.kind).otherwise("text").alias("kind"),
            F.when(other, p.ref).alias("ref"),
            F.when(other, F.coalesce(p.tokens, attachment_tokens(p.kind, p.ref))).otherwise(0).cast("long").alias("tokens"),
            F.when(other, words).otherwise("").alias("source"),
        )
        return F.struct(placed.alias("placed"), F.when(other | after, entry).alias("entry"))

    return let(
        F.transform(parts, visit),
        lambda seen: F.struct(
            F.array_join(F.transform(seen, lambda s: s.placed), "").alias("content"),
            F.filter(F.transform(seen, lambda s: s.entry), lambda e: e.isNotNull()).cast(f"array<{ATTACHMENT}>").alias("attachments"),
        ),
    )


def _running(lengths: Column, first: int) -> Column:
    """Where each piece begins, given the lengths of all; chunk by chunk, so that long lists are not copied per piece."""
    starts = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / CHUNK).cast("int"))
    chunks = lambda: F.transform(starts, lambda c: F.slice(lengths, c * CHUNK + 1, CHUNK))
    total = lambda part, start: F.aggregate(part, start, lambda a, n: a + n)
    offsets = lambda all_: F.aggregate(
        all_,
        F.struct(F.lit(first).cast("long").alias("at"), F.array().cast("array<long>").alias("out")),
        lambda a, c: F.struct(total(c, a.at).alias("at"), F.array_append(a.out, a.at).alias("out")),
        lambda a: a.out,
    )
    within = lambda c, at: F.transform(c, lambda _, k: total(F.slice(c, F.lit(1), k), at))
    return F.when(F.size(lengths) == 0, F.array().cast("array<long>")).otherwise(let(chunks(), lambda all_: F.flatten(F.zip_with(all_, offsets(all_), within))))


def chats(turns: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", parts: str | None = None) -> DataFrame:
    """One row per conversation: ``key``, n_turns, formatted, loss, attachments, attachment_tokens.

    ``loss`` has one span (start, end; code points) of ``formatted`` per turn, empty where nothing is learned;
    ``attachments`` has one list per turn.  ``parts`` names a column of typed parts (kind, text, ref, tokens);
    without it the parts of ``text`` are taken.  Turns are ordered by turn, then role, then content, nulls first;
    null roles and texts count as empty, rows that repeat are turns each, a null key is a conversation.
    """
    said = F.coalesce(turns[text], F.lit("")) if parts is None else turns[parts].cast(f"array<{PART}>")
    rows = turns.select(turns[key].alias("_key"), F.struct(turns[turn].alias("turn"), F.coalesce(turns[role], F.lit("")).alias("role"), said.alias("said")).alias("_row"))
    grouped = rows.groupBy("_key").agg(F.array_sort(F.collect_list("_row")).alias("_rows"))

    def framed(r: Column) -> Column:
        def frame(body: Column) -> Column:
            opened = F.concat(F.lit(OTHER[0]), escape(r.role), F.lit(OTHER[1]))
            closed = F.lit(OTHER[2])
            for name, (o, c) in FRAMES.items():
                opened, closed = F.when(r.role == name, F.lit(o)).otherwise(opened), F.when(r.role == name, F.lit(c)).otherwise(closed)
            return let(
                F.struct(opened.alias("opened"), closed.alias("closed")),
                lambda m: F.struct(
                    F.concat(m.opened, body.content, m.closed).alias("piece"),
                    F.length(m.opened).alias("before"),
                    F.when(r.role == "assistant", F.length(body.content)).otherwise(0).alias("learned"),
                    body.attachments.alias("attachments"),
                ),
            )

        content = flatten(parts_of(r.said)) if parts is None else flatten(F.coalesce(r.said, F.array().cast(f"array<{PART}>")))
        return let(content, frame)

    made = grouped.select(F.col("_key"), F.transform("_rows", framed).alias("_turns"))
    starts = _running(F.transform("_turns", lambda t: F.length(t.piece).cast("long")), len(BEGIN))
    span = lambda t, at: F.struct((at + F.when(t.learned > 0, t.before).otherwise(0)).alias("start"), (at + F.when(t.learned > 0, t.before + t.learned).otherwise(0)).alias("end"))
    tokens = F.aggregate(F.flatten(F.transform("_turns", lambda t: t.attachments)), F.lit(0).cast("long"), lambda a, x: a + x.tokens)
    return made.select(
        F.col("_key").alias(key),
        F.size("_turns").cast("long").alias("n_turns"),
        F.concat(F.lit(BEGIN), F.array_join(F.transform("_turns", lambda t: t.piece), "")).alias("formatted"),
        F.zip_with("_turns", starts, span).alias("loss"),
        F.transform("_turns", lambda t: t.attachments).alias("attachments"),
        tokens.alias("attachment_tokens"),
    )


def _said(content: Column, attachments: Column) -> Column:
    """The text that a content was made of."""
    whole = lambda: F.array_join(
        F.flatten(F.zip_with(F.split(content, MARK, -1), F.transform(attachments, lambda a: a.source), lambda g, s: F.array(unescape(g), F.coalesce(s, F.lit(""))))), ""
    )
    return F.when(F.size(attachments) > 0, whole()).otherwise(unescape(content))


def read_back(formatted: DataFrame, *, keep: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """``keep``, turns (role, text) and learned (the text under the loss mask, turn by turn), read from the output of ``chats``."""
    pieces = F.split(F.substr("formatted", F.lit(len(BEGIN) + 1)), TURN, -1)
    split = formatted.select(*keep, F.filter(pieces, lambda p: p != "").alias("_pieces"), "loss", "attachments")
    starts = _running(F.transform("_pieces", lambda p: F.length(p).cast("long")), len(BEGIN))
    both = F.arrays_zip(F.col("_pieces").alias("piece"), F.col("loss").alias("loss"), F.col("attachments").alias("attachments"), starts.alias("start"))

    def turn(t: Column) -> Column:
        between = lambda o, c: F.substr(t.piece, F.lit(o + 1), F.length(t.piece) - (o + c))
        at = F.locate(OTHER[1], t.piece)
        cases = F.struct(
            unescape(F.substr(t.piece, F.lit(len(OTHER[0]) + 1), at - 1 - len(OTHER[0]))).alias("role"),
            F.substr(t.piece, at + len(OTHER[1]), F.length(t.piece) - (at + len(OTHER[1]) - 1) - len(OTHER[2])).alias("content"),
        )
        for name, (o, c) in FRAMES.items():
            cases = F.when(F.startswith(t.piece, F.lit(o)), F.struct(F.lit(name).alias("role"), between(len(o), len(c)).alias("content"))).otherwise(cases)
        under = F.substr(t.piece, (t.loss.start - t.start + 1).cast("int"), (t.loss.end - t.loss.start).cast("int"))
        learned = F.when(t.loss.end > t.loss.start, _said(under, t.attachments)).otherwise("")
        return let(cases, lambda c: F.struct(c.role.alias("role"), _said(c.content, t.attachments).alias("text"), learned.alias("learned")))

    return split.select(*keep, F.transform(both, turn).alias("turns"))


def digests(turns: DataFrame, *, key: str = "conv_id", **columns: str | None) -> DataFrame:
    """``key``, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, attachment_tokens, all read back from the formatted conversations."""
    made = chats(turns, key=key, **columns).withColumn("formatted_chars", F.length("formatted").cast("long"))
    back = read_back(made, keep=(key, "formatted_chars", "attachment_tokens"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    learned = F.array_join(F.transform("turns", lambda t: t.learned), "")
    out = back.select(key, F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), learned.alias("_learned"), "formatted_chars", "attachment_tokens")
    return out.select(key, "n_turns", "turns_sha256", F.length("_learned").cast("long").alias("loss_chars"), F.sha2("_learned", 256).alias("loss_sha256"), "formatted_chars", "attachment_tokens")
