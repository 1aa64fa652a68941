"""Names and kinds: task families, model keys, quantizations, sizes.  All native columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Task families and the short names that also stand for them.
TASK_FAMILIES = (
    "arithmetic",
    "game_of_life",
    "linda_fallacy",
    "ascii_shapes",
    "cellular_automata_1d",
    "object_tracking",
    "sally_anne",
    "carwash",
    "inverted_cup",
    "strawberry",
    "measure_comparison",
    "grid_tasks",
    "time_arithmetic",
    "misquote",
    "false_premise",
    "family_relations",
    "encoding_cipher",
    "symbol_arithmetic",
)
TASK_ALIASES = {
    "gol": "game_of_life",
    "linda": "linda_fallacy",
    "c14": "cellular_automata_1d",
    "tracking": "object_tracking",
    "false_belief": "sally_anne",
}
# Families whose ids may also start with the family name, in the legacy reading.
LEGACY_PREFIXED = (
    "carwash",
    "inverted_cup",
    "strawberry",
    "measure_comparison",
    "grid_tasks",
    "time_arithmetic",
    "misquote",
    "false_premise",
    "family_relations",
    "encoding_cipher",
    "symbol_arithmetic",
)
# Quantization tags in order of preference.
QUANTIZATION_TAGS = ("F16", "F32", "Q2_K", "Q3_K", "Q4_K_M", "Q4_K_S", "Q5_K_M", "Q5_K_S", "Q6_K", "Q8_0")
# Model families and the words that mark them, first hit wins.
MODEL_FAMILY_WORDS = {
    "qwen": ("qwen", "qwq"),
    "gemma": ("gemma",),
    "llama": ("llama", "lama"),
    "phi": ("phi",),
    "mistral": ("mistral", "minstral"),
    "neural": ("neural",),
    "openchat": ("openchat",),
    "dolphin": ("dolphin",),
    "acemath": ("acemath",),
}
# Size units in bytes.
SIZE_UNITS = {"B": 1, "KB": 1024, "MB": 1024**2, "GB": 1024**3, "TB": 1024**4}


def _first_hit(cases: list[tuple[Column, str]], default: Column) -> Column:
    (head, value), *rest = cases
    chain = F.when(head, value)
    for condition, result in rest:
        chain = chain.when(condition, result)
    return chain.otherwise(default)


def sql_literal(value: object) -> str:
    """A Python value as a Spark SQL literal."""
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value!r}D" if isinstance(value, float) else str(value)


def literal_map(values: dict) -> Column:
    """A dictionary of fixed size as a map literal, made in one call."""
    return F.expr("map(" + ", ".join(sql_literal(x) for pair in values.items() for x in pair) + ")")


def one_of(value: Column, options: Iterable[str]) -> Column:
    """Membership in a fixed list; Spark keeps a longer list as a hash set, so a look-up costs the same however long it is."""
    return value.isin(*options)


def looked_up(values: dict[str, str], key: Column) -> Column:
    """Value of a key in a fixed dictionary, null if it has none; the entries are only gone through for a key among them."""
    return F.when(one_of(key, values), F.try_element_at(literal_map(values), key))


def task_type_from_id(test_id: Column, legacy: bool = False) -> Column:
    """Task family named in a test id, ``unknown`` if none.

    The default reads whole name segments with the longest family first, so
    ``multi_1_time_arithmetic`` is ``time_arithmetic``.  ``legacy`` keeps the
    first-match order in which ``_arithmetic`` shadows the longer names.
    """
    if legacy:
        cases = []
        for family in TASK_FAMILIES:
            marks = ["_linda"] if family == "linda_fallacy" else [f"_{family}"]
            marks += [f"_{a}" for a, f in TASK_ALIASES.items() if f == family and a != "linda"]
            hit = test_id.contains(marks[0])
            for mark in marks[1:]:
                hit = hit | test_id.contains(mark)
            if family in LEGACY_PREFIXED:
                hit = hit | test_id.startswith(f"{family}_")
            cases.append((hit, family))
        return _first_hit(cases, F.lit("unknown"))
    names = sorted([*TASK_FAMILIES, *TASK_ALIASES], key=len, reverse=True)
    found = F.regexp_extract(test_id, f"(?:^|_)({'|'.join(names)})(?:_|$)", 1)
    return F.coalesce(
        F.try_element_at(literal_map(TASK_ALIASES), found), F.nullif(found, F.lit("")), F.lit("unknown")
    )


def test_family(test_id: Column) -> Column:
    """The id without its ``multi_<n>_`` prefix and trailing ``_<n>`` groups."""
    return F.regexp_replace(F.regexp_replace(test_id, r"^multi_\d+_", ""), r"(_\d+)+$", "")


test_family.__test__ = False  # not a pytest case


def model_key(name: Column, quantization: Column) -> Column:
    """``name (quantization)``, or the name alone; a missing name is ``unknown``."""
    named = F.coalesce(name, F.lit("unknown"))
    return F.when(F.coalesce(quantization, F.lit("")) == "", named).otherwise(
        F.concat(named, F.lit(" ("), quantization, F.lit(")"))
    )


def model_short_name(name: Column) -> Column:
    """Display name: registry path and tag dropped; uncensored builds by size."""
    size = F.regexp_extract(name, r"(?i)llama[\d.]+_(\d+)b", 1)
    return (
        F.when(name.startswith("hf.co/"), F.substring_index(F.substring_index(name, "/", -1), ":", 1))
        .when(name.contains(":"), F.substring_index(name, ":", 1))
        .when(
            F.lower(name).contains("uncensored") & (size != ""),
            F.concat(F.lit("llama3.2:"), size, F.lit("b-uncensored")),
        )
        .otherwise(name)
    )


def model_file_name(name: Column) -> Column:
    """Name usable in a file name: ``:`` and ``/`` to ``-``, known suffixes dropped."""
    flat = F.regexp_replace(name, "[:/]", "-")
    for suffix in ("-instruct", "-chat", "-base"):
        flat = F.regexp_replace(flat, f"(?i){suffix}$", "")
    return flat


def slug(name: Column) -> Column:
    """Lower case, other characters to single dashes, no dash at either end."""
    dashed = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-")
    return F.when(F.coalesce(name, F.lit("")) == "", "unknown").otherwise(F.regexp_replace(dashed, "^-+|-+$", ""))


def model_family(name: Column) -> Column:
    low = F.lower(name)
    cases = [(low.contains(w), family) for family, words in MODEL_FAMILY_WORDS.items() for w in words]
    return _first_hit(cases, F.lit("other"))


def quantization_of(name: Column) -> Column:
    up = F.upper(name)
    return _first_hit([(up.contains(q), q) for q in QUANTIZATION_TAGS], F.lit(None).cast("string"))


def parse_size(text: Column) -> Column:
    """``"4.7 GB"`` to bytes; unknown unit gives the bare number, anything else 0."""
    parts = F.split(F.trim(text), r"\s+")
    number = F.get(parts, 0).try_cast("double")
    factor = F.coalesce(F.try_element_at(literal_map(SIZE_UNITS), F.upper(F.get(parts, 1))), F.lit(1))
    return F.when((F.size(parts) == 2) & number.isNotNull(), (number * factor).cast("bigint")).otherwise(
        F.lit(0).cast("bigint")
    )


def fixed(number: Column, digits: int) -> Column:
    """A number with a fixed count of decimals, rounded on its exact value and without grouping."""
    return F.regexp_replace(F.format_number(number, digits), ",", "")


def param_size(name: Column, size_bytes: Column) -> Column:
    """Parameter count shown in the name (``:7b``), else estimated as bytes / 6."""
    shown = F.regexp_extract(name, r":(\d+\.?\d*)[bB]", 1).try_cast("double")
    guess = size_bytes.cast("double") / 6
    return (
        F.when(shown < 1, F.concat(fixed(shown * 1000, 0), F.lit("M")))
        .when(shown.isNotNull(), F.concat(fixed(shown, 1), F.lit("B")))
        .when((size_bytes > 0) & (guess < 1e9), F.concat(fixed(guess / 1e6, 1), F.lit("M")))
        .when(size_bytes > 0, F.concat(fixed(guess / 1e9, 1), F.lit("B")))
        .otherwise("Unknown")
    )


def size_bucket(size_bytes: Column) -> Column:
    return (
        F.when(size_bytes < 2e9, "< 2B").when(size_bytes < 8e9, "2-8B").when(size_bytes < 15e9, "8-15B").otherwise("> 15B")
    )
