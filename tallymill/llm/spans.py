"""Places of pattern matches in a text column, with built-in column functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,value:string>"
NONE = f"array<{SPAN}>"
#: Matches handled by one running sum; longer lists go chunk by chunk, so no text makes quadratic work.
CHUNK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def empty(kind: str = NONE) -> Column:
    return F.array().cast(kind)


def matches(text: Column, pattern: Column, group: int | None = None) -> Column:
    """Start, end (code points, end exclusive) and text of all leftmost non-overlapping matches.

    The pieces between the matches and the matches alternate, so running sums of their lengths are
    the places.  With ``group`` the value is that group, the place still that of the whole match.
    Null text gives null; a text without matches gives an empty array.
    """

    def placed(found: Column) -> Column:
        size = F.size(found.whole)
        lengths = lambda part: F.zip_with(part.gaps, part.whole, lambda g, w: F.length(g) + F.length(w))
        starts = F.sequence(F.lit(0), F.floor((size - 1) / CHUNK).cast("int"))
        part = lambda c: F.struct(*(F.slice(found[x], c * CHUNK + 1, CHUNK).alias(x) for x in ("gaps", "whole", "value")))
        total = lambda c: F.aggregate(lengths(part(c)), F.lit(0), lambda a, n: a + n)
        offsets = F.aggregate(
            starts,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda a, c: F.struct((a.at + total(c)).alias("at"), F.array_append(a.out, a.at).alias("out")),
            lambda a: a.out,
        )

        def chunk(at: Column, p: Column) -> Column:
            return F.aggregate(
                F.sequence(F.lit(0), F.size(p.whole) - 1),
                F.struct(at.alias("at"), empty().alias("out")),
                lambda a, k: let(
                    F.struct((a.at + F.length(F.get(p.gaps, k))).alias("start"), F.get(p.whole, k).alias("whole"), F.get(p.value, k).alias("value")),
                    lambda m: let(
                        m.start + F.length(m.whole),
                        lambda end: F.struct(
                            end.alias("at"),
                            F.array_append(a.out, F.struct(m.start.alias("start"), end.alias("end"), m.value.alias("value"))).alias("out"),
                        ),
                    ),
                ),
                lambda a: a.out,
            )

        return F.when(size <= 0, empty()).otherwise(F.flatten(F.zip_with(offsets, starts, lambda at, c: let(part(c), lambda p: chunk(at, p)))))

    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    value = whole if group is None else F.regexp_extract_all(text, pattern, F.lit(group))
    return let(F.struct(whole.alias("whole"), value.alias("value"), F.split(text, pattern, -1).alias("gaps")), placed)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans with a kind, in their order, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def named(kind: str, spans: Column) -> Column:
    """Spans as (start, end, kind), without their text."""
    return F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), F.lit(kind).alias("kind")))


def cut(text: Column, spans: Column, replacement: Callable[[Column], Column]) -> Column:
    """The text with each span replaced. Spans are sorted by start; what overlaps an earlier one adds to it."""
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda a, s: F.struct(
        F.greatest(a.at, s.end).alias("at"),
        F.when(s.start >= a.at, F.concat(a.out, F.array(F.substring(text, a.at + 1, s.start - a.at), replacement(s)))).otherwise(a.out).alias("out"),
    )
    finish = lambda a: F.concat(F.array_join(a.out, ""), F.substring(text, a.at + 1, F.length(text)))
    return F.aggregate(spans, state, step, finish)
