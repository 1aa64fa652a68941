"""Answers that are lists: rankings, rows of cells, grids of cells."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymill.functions.cascade import let
from tallymill.functions.rules import last_of, lines_of
from tallymill.functions.text import all_matches, last_match, strip_ws

# Headings of ranking and reasoning sections.
RANKING_HEADING = "RANKING|CLASIFICACIÓN|CLASSEMENT"
REASONING_HEADING = "REASONING|RAZONAMIENTO|RAISONNEMENT"
# Words that mark a line or a sentence as a ranked statement.
PROBABILITY_PHRASES = (
    "most probable|least probable|más probable|menos probable|plus probable|moins probable"
)
STATEMENT_PHRASES = "is a|works|trabaja|es |est |travaille"
# Marks, likelihoods and brackets taken off a ranking entry, one step each, in this order; each
# with the characters one of which it needs.
ENTRY_STEPS = (
    ("*", r"\*\*([^*]+)\*\*", "$1"),
    ("*", r"\*([^*]+)\*", "$1"),
    ("_", r"__([^_]+)__", "$1"),
    ("_", r"_([^_]+)_", "$1"),
    (":-–—", r"(?i)\s*[:\-–—]\s*(?:Most|Least|Very|Highly)?\s*(?:Likely|Unlikely|Probable|Improbable|Possible)\s*", ""),
    ("(", r"(?i)\s*\([^)]*(?:likely|probable|fit|match|possible)[^)]*\)\s*", ""),
    ("(", r"\s*\([^)]*\d+[^)]*\)\s*$", ""),
    ("(", r"\s*\([^)]*\)\s*$", ""),
)
# Where an explanation begins; the first of each list that the entry contains cuts it.
ENTRY_DASHES = ("–", "—", " - ")
ENTRY_SENTENCES = (". This", ". It", ". He", ". She", ". Given", ". While")


def _cut_at_first(entry: Column, marks: tuple[str, ...]) -> Column:
    """The entry before the first of ``marks``, by their order, that it contains."""
    cases = [F.when(entry.contains(m), strip_ws(F.substring_index(entry, m, 1))) for m in marks]
    return F.coalesce(*cases, entry)


def clean_entry(text: Column) -> Column:
    """Entry without marks, likelihoods, brackets and explanations.

    A colon ends the entry unless what stands before it joins two statements.
    """

    def stripped(entry: Column) -> Column:
        done = entry
        for needed, pattern, replacement in ENTRY_STEPS:
            done = let(
                done,
                lambda e: F.when(reduce(or_, [e.contains(c) for c in needed]), F.regexp_replace(e, pattern, replacement)).otherwise(e),
            )
        return done

    def before_colon(entry: Column) -> Column:
        head = F.substring_index(entry, ":", 1)
        return F.when(entry.contains(":") & ~head.contains(" and "), strip_ws(head)).otherwise(entry)

    undashed = let(let(text, stripped), lambda t: _cut_at_first(t, ENTRY_DASHES))
    return strip_ws(let(let(undashed, before_colon), lambda t: _cut_at_first(t, ENTRY_SENTENCES)))


def cleaned(entries: Column, longer_than: int) -> Column:
    return F.filter(F.transform(entries, clean_entry), lambda s: F.length(s) > longer_than)


def numbered_lines(text: Column) -> Column:
    """What stands behind the number of each numbered line, in order."""
    return F.transform(all_matches(text, r"(?m)^[ \t]*\d+\.[ \t]*(.*)$", 1), strip_ws)


def ranking_section(text: Column) -> Column:
    return F.regexp_extract(text, rf"(?isu)(?:{RANKING_HEADING}):?\s*(.*?)(?=(?:{REASONING_HEADING}):|\z)", 1)


def probability_lines(text: Column) -> Column:
    return F.transform(F.filter(lines_of(text), lambda s: F.lower(s).rlike(PROBABILITY_PHRASES)), strip_ws)


def statement_sentences(text: Column) -> Column:
    parts = F.transform(F.split(text, "[.!?]"), strip_ws)
    return F.filter(parts, lambda s: (F.length(s) > 10) & F.lower(s).rlike(STATEMENT_PHRASES))


def distinct_entries(entries: Column, limit: int | None = None, threshold: float = 0.85) -> Column:
    """Entries without near copies: same letters, word subsets, or word overlap above the threshold.

    ``limit`` keeps the first entries that are left; by default all are kept.  A fold over the list, since an entry is compared with the entries kept so
    far.  Words and letters of each entry are taken once, before the fold.
    """

    def bare(entry: Column) -> Column:
        return F.struct(entry.alias("entry"), strip_ws(F.regexp_replace(F.lower(entry), r"[^a-z0-9\s]", "")).alias("bare"))

    # with a word missing, n words and more overlap by (n - 1) / (n + 1) at most: up to this n only subsets are near
    few = int((1 + threshold) / (1 - threshold)) - 1 if 0 <= threshold < 1 else 0

    def shape(e: Column) -> Column:
        def of(said: Column) -> Column:
            return F.struct(e["entry"].alias("entry"), F.array_distinct(said).alias("words"), F.array_join(said, "").alias("letters"))

        return let(F.split(e["bare"], r"\s+"), of)

    def within(a: Column, b: Column) -> Column:
        return F.forall(a["words"], lambda w: F.array_contains(b["words"], w))

    def near(a: Column, b: Column) -> Column:
        shorter = F.least(F.size(a["words"]), F.size(b["words"]))
        subset = F.when(F.size(a["words"]) <= F.size(b["words"]), within(a, b)).otherwise(within(b, a))

        def alike(common: Column) -> Column:
            return (common == shorter) | (common / (F.size(a["words"]) + F.size(b["words"]) - common) > threshold)

        overlap = let(F.size(F.array_intersect(a["words"], b["words"])), alike)
        return (a["letters"] == b["letters"]) | F.when(shorter <= few, subset).otherwise(overlap)

    def add(kept: Column, entry: Column) -> Column:
        return F.when(F.exists(kept, lambda k: near(entry, k)), kept).otherwise(F.concat(kept, F.array(entry)))

    long_enough = F.filter(F.transform(entries, bare), lambda e: F.length(e["bare"]) >= 5)
    empty = F.array().cast("array<struct<entry:string,words:array<string>,letters:string>>")
    kept = F.aggregate(F.transform(long_enough, shape), empty, add)
    entries_left = F.transform(kept, lambda e: e["entry"])
    return entries_left if limit is None else F.slice(entries_left, 1, limit)


#: Name, lines read from the text, and how they become entries.
RANKING_STRATEGIES = (
    ("explicit_ranking_section", lambda t: numbered_lines(ranking_section(t)), lambda lines: cleaned(lines, 3)),
    ("numbered_list_fallback", numbered_lines, lambda lines: cleaned(lines, 3)),
    ("probability_keyword", probability_lines, lambda lines: F.transform(lines, clean_entry)),
    ("sentence_extraction", statement_sentences, lambda lines: F.array_distinct(cleaned(lines, 5))),
)


def extract_ranking(text: Column, at_least: int = 6, limit: int | None = None) -> Column:
    """Struct of items and strategy: the first way to read the text that gives enough distinct items.

    ``limit`` is the most items of an answer; by default all.  Lines are cleaned and compared only where
    there are enough of them, as cleaning adds none.
    """

    def attempt(name: str, read, entries) -> Column:
        items = let(read(text), lambda lines: F.when(F.size(lines) >= at_least, distinct_entries(entries(lines), limit)))
        return let(items, lambda i: F.when(F.size(i) >= at_least, F.struct(i.alias("items"), F.lit(name).alias("strategy"))))

    none = F.struct(F.lit(None).cast("array<string>").alias("items"), F.lit("failed").alias("strategy"))
    return F.coalesce(*[attempt(*strategy) for strategy in RANKING_STRATEGIES], none)


# --------------------------------------------------------------------------- cells


def to_cells(marks: Column) -> Column:
    return F.transform(marks, lambda m: m.cast("int"))


def _last_block(rows: Column, fits, height: Column) -> Column:
    """The last ``height`` consecutive rows that all fit, null if there are none."""
    n = F.size(rows)
    starts = F.when(n >= height, F.sequence(n - height + 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    good = F.filter(starts, lambda s: F.forall(F.slice(rows, s, height), fits))
    start = F.get(good, 0)
    return F.when(start.isNotNull(), F.slice(rows, F.coalesce(start, F.lit(1)), height))


def separated_marks(line: Column, live: Column, dead: Column) -> Column:
    """Cells of a line whose marks stand apart: any other digit counts as live, other characters are dropped."""
    binary = F.replace(F.replace(line, live, F.lit("1")), dead, F.lit("0"))
    kept = F.regexp_replace(F.regexp_replace(binary, "[2-9]", "1"), r"[^01\s]", "")
    return F.filter(F.split(strip_ws(kept), r"\s+"), lambda t: t.isin("0", "1"))


def extract_grid(text: Column, height: Column, width: Column, live: Column | None = None, dead: Column | None = None) -> Column:
    """Struct of a grid of 0/1 cells and the strategy that found it, searched from the end.

    Works on the array of lines of one response, so nothing is exploded or shuffled.
    """
    live = F.lit("1") if live is None else F.coalesce(live, F.lit("1"))
    dead = F.lit("0") if dead is None else F.coalesce(dead, F.lit("0"))
    lines = F.split(strip_ws(text), "\n")
    apart = F.transform(lines, lambda s: separated_marks(s, live, dead))
    digits = F.transform(lines, lambda s: all_matches(s, "[01]", 0))

    def grid(rows: Column) -> Column:
        return F.transform(rows, lambda r: to_cells(F.slice(r, 1, width)))

    def found(name: str, rows: Column) -> Column:
        return let(rows, lambda r: F.when(r.isNotNull(), F.struct(grid(r).alias("grid"), F.lit(name).alias("strategy"))))

    marker = r"(?:next|result|grid|state|generation|output):"
    after = F.regexp_extract(F.lower(text), rf"(?s)^.*{marker}(.*)$", 1)
    after_digits = F.filter(F.transform(F.split(after, "\n"), lambda s: all_matches(s, "[01]", 0)), lambda r: F.size(r) > 0)
    marked = F.slice(after_digits, 1, F.greatest(height, F.lit(1)))
    cells = height * width

    def ending(everything: Column) -> Column:
        """The last cells of the text cut into rows."""
        start = F.size(everything) - cells
        cut = F.transform(F.sequence(F.lit(0), height - 1), lambda i: F.slice(everything, start + i * width + 1, width))
        return F.when(start >= 0, cut)

    shape_known = (height > 0) & (width > 0)
    return F.when(
        shape_known,
        F.coalesce(
            found("line_scan_reverse", let(apart, lambda rs: _last_block(rs, lambda r: F.size(r) == width, height))),
            found(
                "marker_search",
                let(marked, lambda m: F.when((F.size(m) == height) & F.forall(m, lambda r: F.size(r) == width), m)),
            ),
            found("digit_extraction", let(digits, lambda rs: _last_block(rs, lambda r: F.size(r) >= width, height))),
            found("last_resort", let(all_matches(text, "[01]", 0), ending)),
        ),
    )


# What stands before a row of cells.
STATE_MARKERS = (
    r"(?i)(?:final\s+answer|next\s+state|next\s+row|next|answer|result)\s*:?\s*([^\n]+)",
    r"(?i)(?:the\s+)?(?:next|resulting|final)\s+(?:state|row|generation)\s+(?:is|=|:)?\s*([^\n]+)",
)


def cells_in(text: Column, shortest: int = 8) -> Column:
    """A row of at least ``shortest`` cells in a text: marks that stand apart, else all binary digits."""
    bare = F.regexp_replace(strip_ws(text), r"(?i)^(?:state|row|generation|answer|result)\s*:?\s*", "")

    def fit(marks: Column) -> Column:
        return F.when(F.size(marks) >= shortest, marks)

    return F.coalesce(fit(all_matches(bare, r"\b[01]\b", 0)), fit(all_matches(bare, "[01]", 0)))


def extract_cells(text: Column, size: Column) -> Column:
    """Struct of a row of 0/1 cells and the strategy that found it; ``size`` is the wanted width, all cells if unknown."""
    digits = all_matches(text, r"\b[01]\b", 0)
    take = F.when(size > 0, size).otherwise(F.size(digits))
    ending = F.when(
        F.size(digits) >= 8, F.slice(digits, F.greatest(F.size(digits) - take + 1, F.lit(1)), take)
    )
    blocks = all_matches(text, r"(?s)```(?:python|text)?\s*\n?(.+?)\n?```", 1)

    def found(name: str, marks: Column) -> Column:
        return let(marks, lambda m: F.when(m.isNotNull(), F.struct(to_cells(m).alias("cells"), F.lit(name).alias("strategy"))))

    return F.coalesce(
        *[found("marker_search", cells_in(last_match(text, p, 1))) for p in STATE_MARKERS],
        found("line_scan", last_of(F.transform(F.split(text, "\n"), lambda s: cells_in(s)))),
        found("code_block", last_of(F.transform(blocks, lambda s: cells_in(s)))),
        found("digit_extraction", ending),
    )
