"""Ordered extraction rules evaluated as one lazy column expression.

A rule turns a text into a value or null.  ``cascade`` tries rules in order and
keeps the first hit with its strategy name and confidence.  The hit is carried
as ``<rule number><separator><value>`` through ``coalesce``, which stops at the
first hit, so later patterns are not run on rows that are already answered.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymill.functions.text import first_match, last_match, strip_verification_tail, strip_ws

SEPARATOR = "\u0001"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), 0)


@dataclass(frozen=True)
class Rule:
    """One strategy: a pattern whose last match (or first) is cleaned, or a free column function.

    A rule that is ``kept`` reads the text without its verification section, which is cut off once for all of them.
    """

    strategy: str
    confidence: float
    pattern: str | Column | None = None
    group: int = 1
    clean: Callable[[Column], Column] | None = None
    find: Callable[[Column], Column] | None = None
    first: bool = False
    kept: bool = False

    def value(self, text: Column) -> Column:
        if self.find is not None:
            found = self.find(text)
        else:
            found = (first_match if self.first else last_match)(text, self.pattern, self.group)
        return found if self.clean is None else let(found, self.clean)


def tried(text: Column, rules: Sequence[Rule], base: int = 0) -> Column:
    """Encoded first hit of the rules, numbered from ``base``; the text is cut when the first rule asks for that."""

    def encoded(part: Sequence[tuple[int, Rule]], kept: Column) -> list[Column]:
        return [F.concat(F.lit(f"{base + i}{SEPARATOR}"), r.value(kept if r.kept else text)) for i, r in part]

    numbered = list(enumerate(rules))
    cut = next((i for i, r in numbered if r.kept), len(numbered))
    none = F.lit(None).cast("string")
    rest = [let(strip_verification_tail(text), lambda kept: F.coalesce(*encoded(numbered[cut:], kept), none))] if numbered[cut:] else []
    return F.coalesce(*encoded(numbered[:cut], text), *rest, none)


def hit(text: Column, rules: Sequence[Rule]) -> Column:
    """Encoded first hit of the rules, null if none hits.

    The rules run on a variable (``let``), so none of them ends up in the generated code of the row, whose
    method the JVM compiles only while it is short (8,000 bytes).
    """
    return let(text, lambda t: tried(t, rules))


def decode(
    encoded: Column, rules: Sequence[Rule], text: Column, failed: str | Column = "failed", sure: float = 0.0, blank_label: str = "empty"
) -> Column:
    """Struct of value, strategy, confidence and error from an encoded hit.

    Without a hit the strategy is ``blank_label`` for a blank text and ``failed`` otherwise, the latter
    with confidence ``sure``.
    """
    index = F.substring_index(encoded, SEPARATOR, 1).cast("int")
    names = F.array(*[F.lit(r.strategy) for r in rules])
    levels = F.array(*[F.lit(float(r.confidence)) for r in rules])
    blank = F.coalesce(strip_ws(text), F.lit("")) == ""
    value = F.substring(encoded, F.length(F.substring_index(encoded, SEPARATOR, 1)) + 2, F.length(encoded))
    return F.struct(
        value.alias("value"),
        F.when(encoded.isNotNull(), F.get(names, index)).when(blank, blank_label).otherwise(failed).alias("strategy"),
        F.when(encoded.isNotNull(), F.get(levels, index)).when(blank, 0.0).otherwise(sure).alias("confidence"),
        F.when(encoded.isNotNull(), F.lit(None).cast("string"))
        .when(blank, "Empty response")
        .otherwise("No strategy succeeded")
        .alias("error"),
    )


def by_kind(kind: Column, table: dict[str, Sequence[Rule]], default: str, text: Column) -> tuple[Column, list[Rule]]:
    """Encoded hit of the rule list that ``kind`` selects, with all rules numbered in one list."""
    rules: list[Rule] = []
    offsets: dict[str, int] = {}
    for name, part in table.items():
        offsets[name] = len(rules)
        rules.extend(part)

    def numbered(name: str, t: Column) -> Column:
        return tried(t, table[name], offsets[name])

    def of_kind(t: Column) -> Column:
        chosen = None
        for name in table:
            if name != default:
                chosen = F.when(kind == name, numbered(name, t)) if chosen is None else chosen.when(kind == name, numbered(name, t))
        return numbered(default, t) if chosen is None else chosen.otherwise(numbered(default, t))

    return let(text, of_kind), rules
