"""Text columns: normalising, splitting, end-first matching.

Answers stand at the end of a response, so every matcher here prefers the last
occurrence.  Everything is a native column; nothing leaves the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters normalised before matching.
CURLY_QUOTES = "\u2018\u2019\u201c\u201d\u2032\u2033"
STRAIGHT_QUOTES = "''\"\"'\""
WIDE_SPACES = "\u00a0\u202f\u2009\u200b"

# Fixed value: header that opens a verification section of a response.
VERIFICATION_HEADER = (
    r"(?:^|\n)\s*(?:"
    r"(?:\*{0,2}|#{1,3}\s*)"
    r"(?:verification|verify|check(?:ing)?|confirm(?:ation|ing)?|"
    r"validate|validation|proof|double[\s-]?check)"
    r"(?:\s*\*{0,2})\s*[:.]?"
    r"|let(?:['\u2019]s|\s+us|\s+me)\s+(?:verify|check|confirm|double[\s-]?check|trace)"
    r"|to\s+(?:verify|check|confirm|double[\s-]?check)"
    r"|(?:working|counting|going)\s+(?:backward|forward|back)\b"
    r"|this\s+(?:confirms?|matches|verif(?:ies|y))\b"
    r")"
)

WHITE = " \t\n\r\x0b\x0c"


def strip_ws(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def strip_chars(text: Column, chars: str) -> Column:
    """Remove any of ``chars`` from both ends."""
    return F.btrim(text, F.lit(chars))


def rstrip_chars(text: Column, chars: str) -> Column:
    return F.rtrim(text, F.lit(chars))


def straighten(text: Column) -> Column:
    """Curly quotes and primes to ASCII, special spaces to plain ones."""
    return F.translate(text, CURLY_QUOTES + WIDE_SPACES, STRAIGHT_QUOTES + " " * len(WIDE_SPACES))


def strip_markdown(text: Column) -> Column:
    return F.regexp_replace(text, r"\*{1,2}|_{1,2}", "")


def collapse_ws(text: Column) -> Column:
    return strip_ws(F.regexp_replace(text, r"\s+", " "))


def text_normalise(text: Column) -> Column:
    """Comparable form: straight quotes, no markdown marks, single spaces, bare edges, lower case."""
    flat = collapse_ws(strip_markdown(straighten(text)))
    return F.lower(strip_ws(strip_chars(flat, ".,;:!?\"'`")))


def words(text: Column) -> Column:
    """Word set of a text: lower case, punctuation dropped, distinct."""
    flat = F.regexp_replace(F.lower(text), r"[^\w\s]", "")
    return word_set(flat)


def word_list(flat: Column) -> Column:
    """What stands between white space.  Split at single blanks, as Spark compiles any longer pattern of a split anew for each row."""
    return F.array_remove(F.split(F.regexp_replace(flat, r"[\t-\r]", " "), " "), "")


def word_set(flat: Column) -> Column:
    return F.array_distinct(word_list(flat))


def _pattern(pattern: str | Column) -> Column:
    return pattern if isinstance(pattern, Column) else F.lit(looked_ahead(pattern))


def looked_ahead(pattern: str) -> str:
    """A pattern that begins with a choice of words, with a test for their first characters before it; others as they are.

    The words are then only tried one by one at places where one of them can begin.
    """
    flags, rest = re.match(r"((?:\(\?[a-zA-Z]+\))?)(.*)", pattern, re.DOTALL).groups()
    first = openings(rest) if rest.startswith("(?:") and len(alternatives(rest)) == 1 else None
    return pattern if not first else f"{flags}(?=[{''.join(dict.fromkeys(re.findall(r'\\?.', first)))}]){rest}"


def all_matches(text: Column, pattern: str | Column, group: int = 0) -> Column:
    return F.regexp_extract_all(text, _pattern(pattern), F.lit(group))


def last_match(text: Column, pattern: str | Column, group: int = 0) -> Column:
    """Last match of ``pattern`` (or its group), null if there is none."""
    return F.try_element_at(all_matches(text, pattern, group), F.lit(-1))


def first_match(text: Column, pattern: str | Column, group: int = 0) -> Column:
    return F.try_element_at(all_matches(text, pattern, group), F.lit(1))


#: Matches whose offsets are summed up in one go.
RUN = 64


def places(text: Column, pattern: str) -> Column:
    """Start offsets of all matches of ``pattern``, in order: running sums over what lies between and in the matches.

    Sums run within groups of ``RUN`` matches and over the groups, so arrays that grow by appending stay short.
    """

    def offsets(part: Column, start: Column) -> Column:
        state = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))

        def step(a: Column, x: Column) -> Column:
            return F.struct((a["at"] + x["gap"] + x["own"]).alias("at"), F.array_append(a["out"], a["at"] + x["gap"]).alias("out"))

        return F.aggregate(part, state, step, lambda a: a["out"])

    def whole(x: Column) -> Column:
        return F.aggregate(x, F.lit(0), lambda a, s: a + s["gap"] + s["own"])

    def all_offsets(parts: Column) -> Column:
        sizes = F.transform(parts, lambda x: F.struct(F.lit(0).alias("gap"), whole(x).alias("own")))
        return F.flatten(F.zip_with(parts, offsets(sizes, F.lit(0)), offsets))

    steps = F.zip_with(
        F.split(text, pattern, -1),
        all_matches(text, pattern),
        lambda gap, own: F.struct(F.length(gap).alias("gap"), F.coalesce(F.length(own), F.lit(0)).alias("own")),
    )

    def parted(xs: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(xs) - 1, F.lit(RUN)), lambda i: F.slice(xs, i, F.least(F.lit(RUN), F.size(xs) - i)))

    found = F.get(F.transform(F.transform(F.array(steps), parted), all_offsets), 0)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<int>"))


def last_n(items: Column, n: int) -> Column:
    return F.reverse(F.slice(F.reverse(items), 1, n))


def last_n_matches(text: Column, pattern: str | Column, n: int = 1, group: int = 0) -> Column:
    return last_n(all_matches(text, pattern, group), n)


def last_sentences(text: Column, n: int = 3) -> Column:
    """Last ``n`` sentences; a sentence ends at ``.``, ``!`` or ``?`` before white space."""
    parts = F.split(strip_ws(text), r"(?<=[.!?])\s+")
    return last_n(F.filter(parts, lambda p: strip_ws(p) != ""), n)


def strip_verification_tail(text: Column) -> Column:
    """Cut a text at its first verification header, unless nothing would be left."""
    head = F.regexp_replace(text, f"(?is){VERIFICATION_HEADER}.*", "")  # no shorter without a header

    def cut(h: Column) -> Column:
        return F.when(h == text, text).otherwise(F.coalesce(F.nullif(F.rtrim(h, F.lit(WHITE)), F.lit("")), text))

    return F.get(F.transform(F.array(head), cut), 0)


def last_position(text: Column, pattern: str) -> Column:
    """Start offset of the last place where ``pattern`` matches, -1 if it never does.

    Only what stands before it may cross lines; a dot in the pattern itself stays within one.
    """
    before = F.try_element_at(all_matches(text, f"^((?s:.*))(?:{pattern})", 1), F.lit(1))
    return F.coalesce(F.length(before), F.lit(-1))


def last_start(text: Column, patterns: Sequence[str]) -> Column:
    """Start of the last of all non-overlapping matches of each pattern, -1 if there are none."""

    def start(p: str) -> Column:
        after = F.length(F.element_at(F.split(text, p, -1), -1))
        return F.when(text.rlike(p), F.length(text) - after - F.length(last_match(text, p)))

    return F.greatest(F.lit(-1), *(F.coalesce(start(p), F.lit(-1)) for p in patterns))


def last_keyword_position(text: Column, keywords: Sequence[str]) -> Column:
    """Start offset of the last occurrence of any keyword pattern, ignoring case; -1 if none.

    The search from the end, which goes back one place at a time, only runs on texts with one of them.
    """
    low = F.lower(text)
    return F.when(low.rlike(any_of(keywords)), last_position(low, "|".join(f"(?:{k})" for k in keywords))).otherwise(-1)


def alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern, as far as they stand outside groups and classes."""
    out, depth = [""], 0
    for token in re.findall(r"\\.|\[(?:\\.|[^\]])*\]|.", pattern, re.DOTALL):
        depth += (token == "(") - (token == ")")
        if token == "|" and depth == 0:
            out.append("")
        else:
            out[-1] += token
    return out


def openings(pattern: str) -> str | None:
    """Characters, as a class, one of which begins every match of a pattern of letters, digits and plain groups; null if unknown."""
    found = ""
    for part in alternatives(pattern):
        if part.startswith("(?:"):
            end = next(k for k in range(3, len(part) + 1) if part[:k].endswith(")") and _closed(part[:k]))
            own, after, rest = openings(part[3 : end - 1]), part[end : end + 1], part[end + 1 :]
        elif part.startswith("\\d") or part[:1].isalnum() and part[:1].isascii():
            size = 2 if part[0] == "\\" else 1
            own, after, rest = part[:size], part[size : size + 1], part[size + 1 :]
        else:
            return None
        # what may be left out lets the next part begin
        more = openings(rest) if after == "?" else None if after in ("*", "{") else ""
        if own is None or more is None:
            return None
        found += own + more
    return found


def _closed(pattern: str) -> bool:
    tokens = re.findall(r"\\.|\[(?:\\.|[^\]])*\]|.", pattern, re.DOTALL)
    return tokens.count("(") == tokens.count(")")


def any_of(patterns: Sequence[str]) -> str:
    """One case-insensitive pattern that matches wherever any of ``patterns`` does.

    Patterns that begin at the edge of a word share the test for it, which is made only before characters that begin one of them.
    """
    bounded, first, others = [], "", []
    for p in (x for whole in patterns for x in alternatives(whole)):
        inner = p.removeprefix("(?s:") if p.endswith(")") else p
        opens = openings(inner[2:] if inner is p else inner[2:-1]) if inner.startswith(r"\b") else None
        if opens is None:
            others.append(p)
        else:
            bounded.append(p if inner is not p else p[2:])
            first += opens
    edge = [f"(?=[{''.join(dict.fromkeys(re.findall(r'\\?.', first.lower())))}])\\b(?:{'|'.join(f'(?:{p})' for p in bounded)})"] if bounded else []
    return "(?i)" + "|".join(edge + [f"(?:{p})" for p in others])


def says_any(text: Column, phrases: Sequence[str]) -> Column:
    """Does the lower-cased text contain any of the literal phrases?"""
    return F.lower(text).rlike(by_first([p[0] for p in phrases], [p[1:] for p in phrases], quote=True))


def by_first(firsts: Sequence[str], rests: Sequence[str], quote: bool = False) -> str:
    """Choice of words given as first character and rest, grouped by the first character, which is tested before any of them is tried."""
    groups: dict[str, list[str]] = {}
    for first, rest in zip(firsts, rests):
        groups.setdefault(first, []).append(f"\\Q{rest}\\E" if quote and rest else rest)
    mark = lambda c: c if c.isalnum() else f"\\{c}"
    return f"(?=[{''.join(map(mark, groups))}])(?:" + "|".join(f"{mark(c)}(?:{'|'.join(r)})" for c, r in groups.items()) + ")"


#: Patterns that are looked for together before each is counted.
TOGETHER = 8


def count_hits(text: Column, patterns: Sequence[str]) -> Column:
    """How many of the patterns occur in the text."""
    total = F.lit(0)
    for part in (patterns[k : k + TOGETHER] for k in range(0, len(patterns), TOGETHER)):
        each = F.lit(0)
        for p in part:
            each = each + text.rlike(any_of([p])).cast("int")
        total = total + F.when(~text.rlike(any_of(part)), 0).otherwise(each)
    return total
