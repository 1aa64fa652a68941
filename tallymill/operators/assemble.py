"""Assembling labelled test tables: combinations, prompts, ids, labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.functions import vocab
from tallymill.functions.identity import fixed, literal_map
from tallymill.functions.text import strip_ws
from tallymill.session import checkpoint_root

LETTERS = "abcdefghijklmnopqrstuvwxyz"


# --------------------------------------------------------------------------- combining


def config_matrix(cases: DataFrame, axes: Mapping[str, Sequence[str]]) -> DataFrame:
    """Each case in every combination of the listed values: one generator per axis, no join."""
    out = cases
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def seeded_draw(seed: str, *identity: Column) -> Column:
    """Hash of seed and row identity: an order that depends on neither input order nor partitioning."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[c.cast("string") for c in identity]))


def seeded_uniform(seed: str, *identity: Column) -> Column:
    """Number in [0, 1) from the first 13 hex digits of the draw."""
    digits = F.substring(seeded_draw(seed, *identity), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(2**52))


def fill_to_count(rows: DataFrame, count: int | Column, identity: Sequence[str], seed: str = "42") -> DataFrame:
    """Exactly ``count`` rows: whole rounds of all rows, then the first of the shuffled rows.

    One way for every size: rows are numbered in the order of their draw, and those up to the rest get
    one round more.  ``count`` may be a scalar subquery; the number of rows is one itself.
    """
    n = rows.agg(F.count(F.lit(1))).scalar()
    drawn = rows.withColumn("draw", seeded_draw(seed, *[F.col(c) for c in identity]))
    wanted = F.lit(count) if isinstance(count, int) else count
    placed = number_rows(drawn, ["draw", *identity], "_place").withColumns({"_wanted": wanted, "_all": n})
    rounds = F.floor(F.col("_wanted") / F.col("_all")) + (F.col("_place") <= F.col("_wanted") % F.col("_all")).cast("int")
    turns = F.when(rounds > 0, F.sequence(F.lit(0), rounds.cast("int") - 1))
    return placed.withColumn("round", F.explode(turns)).drop("_place", "_wanted", "_all")


def weighted_pick(weights: Mapping[str, float], seed: str, *identity: Column) -> Column:
    """Category drawn with the given weights, the same for the same seed and row."""
    total = float(sum(weights.values()))
    u, below, pick = seeded_uniform(seed, *identity), 0.0, None
    names = list(weights)
    for name in names[:-1]:
        below += weights[name] / total
        pick = F.when(u < below, name) if pick is None else pick.when(u < below, name)
    return F.lit(names[-1]) if pick is None else pick.otherwise(names[-1])


def number_rows(rows: DataFrame, order: Sequence[str], name: str = "number") -> DataFrame:
    """Consecutive numbers from 1 in a total order, without one task seeing all rows.

    Rows are range-partitioned and sorted on the full order, and numbered within
    their partition.  A reliable checkpoint fixes that layout, so that a lost
    executor cannot re-sample other boundaries; then each partition is shifted
    by the rows before it (one row per partition).
    """
    checkpoint_root(rows.sparkSession)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid_out = (
        rows.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
        .checkpoint()
    )
    shifts = carried(laid_out.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")))
    # as many rows as partitions, so broadcasting them is safe
    return laid_out.join(F.broadcast(shifts), "_part").withColumn(name, F.col("_shift") + F.col("_row") + 1).drop(
        "_part", "_row", "_shift"
    )


def carried(sizes: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """(``within``, _part, _shift): how many rows of the group lie in partitions before, from (``within``, _part, _n).

    There is one row per partition and group of it, a list that is short however many rows there are.
    """
    listed = sizes.groupBy(*within).agg(F.sort_array(F.collect_list(F.struct("_part", "_n"))).alias("_all"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<_part:int,_shift:bigint>>").alias("out"))
    step = lambda a, x: F.struct((a.at + x["_n"]).alias("at"), F.array_append(a.out, F.struct(x["_part"].alias("_part"), a.at.alias("_shift"))).alias("out"))
    return listed.select(*within, F.inline(F.aggregate("_all", start, step, lambda a: a.out)))


def ranked(rows: DataFrame, measure: str, name: str = "rank", within: Sequence[str] = (), descending: bool = True) -> DataFrame:
    """Rank of each row by a measure, ties sharing the least, without one task seeing all rows; nulls rank last.

    The rank of a value is one more than the rows with better values.  Rows are first counted per value, then
    values are range-partitioned, counts are summed up within each partition, and the partitions' totals are
    carried over.  A reliable checkpoint fixes the partitions, so a lost executor cannot redraw their bounds.
    """
    order = F.desc_nulls_last(measure) if descending else F.asc_nulls_last(measure)
    counted = rows.groupBy(*within, measure).agg(F.count(F.lit(1)).alias("_n"))
    placed = running(counted, [order], "_n", within)
    values = placed.select(*(F.col(c).alias(f"_{k}") for k, c in enumerate([*within, measure])), (F.col("_before") + 1).alias(name))
    match = [F.equal_null(rows[c], values[f"_{k}"]) for k, c in enumerate([*within, measure])]
    return rows.join(values, match).select(*rows.columns, name)


def running(counted: DataFrame, order: Sequence[Column | str], amount: str, within: Sequence[str] = ()) -> DataFrame:
    """``counted`` with ``_before``: the sum of a long ``amount`` over the group's rows that come before, in a total order.

    Rows are range-partitioned by group and order and summed up within each partition, then the partitions'
    totals are carried over, so a group of any size lies over many tasks.  A reliable checkpoint fixes the
    partitions, so a lost executor cannot redraw their bounds.  The first row of a group has 0.
    """
    checkpoint_root(counted.sparkSession)
    parts = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid_out = counted.repartitionByRange(parts, *within, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    shifts = carried(laid_out.groupBy(*within, "_part").agg(F.sum(amount).alias("_n")), within)
    before = F.sum(amount).over(Window.partitionBy("_part", *within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    shifted = laid_out.withColumn("_inside", F.coalesce(before, F.lit(0))).alias("l").join(shifts.alias("s"), _same("l", "s", [*within, "_part"]))
    return shifted.select(*(F.col(f"l.{c}") for c in counted.columns), (F.col("_shift") + F.col("_inside")).alias("_before"))


def _same(a: str, b: str, keys: Sequence[str]) -> list[Column]:
    return [F.equal_null(F.col(f"{a}.{c}"), F.col(f"{b}.{c}")) for c in keys]


def assign_ids(cases: DataFrame, task: str, order: Sequence[str]) -> DataFrame:
    """``multi_<running number>_<task>`` in the given order."""
    numbered = number_rows(cases, order)
    return numbered.withColumn("test_id", F.format_string("multi_%04d_%s", F.col("number"), F.col(task)))


# --------------------------------------------------------------------------- prompts


def pick_template(
    templates: Mapping[str, Mapping[str, str]], language: Column, style: Column, base: str = "en", plain: str = "casual"
) -> Column:
    """Template of a language and style; an unknown language reads as ``base``, an unknown style as ``plain``."""
    flat = {f"{lang}|{name}": text for lang, styles in templates.items() for name, text in styles.items()}
    known = F.when(language.isin(*templates), language).otherwise(base)
    table = literal_map(flat)
    return F.coalesce(
        F.try_element_at(table, F.concat_ws("|", known, style)),
        F.try_element_at(table, F.concat_ws("|", known, F.lit(plain))),
        F.lit(""),
    )


def render(template: Column, variables: Mapping[str, Column]) -> Column:
    """Template with ``{name}`` replaced by each variable."""
    for name, value in variables.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return strip_ws(template)


def full_prompt(system: Column, user: Column) -> Column:
    """System text, blank line, user text; the user text alone where there is no system text."""
    return F.when(F.coalesce(system, F.lit("")) == "", user).otherwise(F.concat(system, F.lit("\n\n"), user))


def config_json(fields: Mapping[str, Column]) -> Column:
    """Flat configuration as JSON text with sorted keys, ``": "`` and ``", "`` between parts.

    Text columns are quoted; pass numbers already cast to text via ``raw:<name>``.
    """
    parts = []
    for key in sorted(fields, key=lambda k: k.removeprefix("raw:")):
        name = key.removeprefix("raw:")
        value = fields[key].cast("string")
        if not key.startswith("raw:"):
            escaped = F.regexp_replace(F.regexp_replace(value, r"\\", r"\\\\"), '"', r'\\"')
            value = F.concat(F.lit('"'), escaped, F.lit('"'))
        parts.append(F.concat(F.lit(f'"{name}": '), F.coalesce(value, F.lit("null"))))
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def config_hash(fields: Mapping[str, Column]) -> Column:
    return F.substring(F.sha2(config_json(fields), 256), 1, 16)


def plan_counts(plans: DataFrame, produced: DataFrame, task: str) -> DataFrame:
    """Planned cases per task and per prompt configuration against the produced ones.

    ``plans`` holds ``levels``, ``targets``, ``per_target`` and ``configs`` per task.
    """
    planned = F.col("levels") * F.col("targets") * F.col("per_target")
    made = produced.groupBy(task).agg(F.count(F.lit(1)).alias("produced"))
    return plans.join(made, task, "left").select(
        task,
        planned.cast("bigint").alias("planned"),
        F.greatest(F.floor(planned / F.col("configs")), F.lit(1)).cast("bigint").alias("per_config"),
        F.coalesce("produced", F.lit(0)).alias("produced"),
        (F.coalesce("produced", F.lit(0)) - planned).cast("bigint").alias("surplus"),
    )


# --------------------------------------------------------------------------- string labels


def letter_count(word: Column, letter: Column) -> Column:
    low = F.lower(word)
    return F.length(low) - F.length(F.replace(low, F.lower(letter), F.lit("")))


def characters(word: Column) -> Column:
    return F.filter(F.split(F.lower(word), ""), lambda c: c != "")


def letter_positions(word: Column, letter: Column) -> Column:
    """0-based places of a letter."""
    marked = F.transform(characters(word), lambda c, i: F.when(c == F.lower(letter), i))
    return F.filter(marked, lambda i: i.isNotNull())


def nth_letter(word: Column, n: Column) -> Column:
    return F.substring(word, n, F.lit(1))


def is_anagram(a: Column, b: Column) -> Column:
    return F.array_sort(characters(a)) == F.array_sort(characters(b))


def missing_letters(sentence: Column) -> Column:
    """Letters of the alphabet a sentence lacks; none for a pangram."""
    return F.array_except(F.array(*[F.lit(c) for c in LETTERS]), F.array_distinct(characters(sentence)))


def is_lipogram(sentence: Column, letter: Column) -> Column:
    return ~F.lower(sentence).contains(F.lower(letter))


# --------------------------------------------------------------------------- encodings


def caesar(text: Column, shift: int) -> Column:
    """Letters moved by ``shift`` places, case kept; a negative shift decodes."""
    k = shift % 26
    moved = LETTERS[k:] + LETTERS[:k]
    return F.translate(text, LETTERS + LETTERS.upper(), moved + moved.upper())


def to_morse(text: Column) -> Column:
    """Codes separated by blanks, words by `` / ``; characters without a code are dropped."""
    table = literal_map(vocab.MORSE)

    def word(w: Column) -> Column:
        codes = F.transform(F.split(w, ""), lambda c: F.try_element_at(table, c))
        return F.array_join(F.filter(codes, lambda c: c.isNotNull()), " ")

    words = F.transform(F.split(F.upper(text), r"\s+"), word)
    return F.array_join(F.filter(words, lambda w: w != ""), " / ")


def from_morse(code: Column) -> Column:
    table = literal_map({v: k for k, v in vocab.MORSE.items()})

    def word(w: Column) -> Column:
        letters = F.transform(F.split(w, r"\s+"), lambda c: F.coalesce(F.try_element_at(table, c), F.lit("")))
        return F.array_join(letters, "")

    return F.array_join(F.transform(F.split(code, " / "), word), " ")


# --------------------------------------------------------------------------- table questions


def table_answers(
    rows: DataFrame, table: Sequence[str], order: str, numeric: str, label: str, wanted: Column, threshold: Column
) -> DataFrame:
    """Answers per table: first cell, column total, value count, filter count, label of the maximum.

    The maximum goes to the first of its rows; all five are partial aggregates.
    """
    value = F.col(numeric)
    return rows.groupBy(*table).agg(
        F.min_by(label, order).alias("first_cell"),
        fixed(F.sum(value), 2).alias("column_total"),
        F.count_if(wanted).alias("value_count"),
        F.count_if(threshold).alias("filter_count"),
        F.min_by(label, F.struct(-value, F.col(order))).alias("arg_max"),
    )


# --------------------------------------------------------------------------- quantities


def unit_category(symbol: Column) -> Column:
    return F.try_element_at(literal_map({s: c for s, (c, _, _) in vocab.UNITS.items()}), symbol)


def to_base(value: Column, symbol: Column) -> Column:
    """Value in the base unit of its category; temperatures in Kelvin."""
    factor = F.try_element_at(literal_map({s: f for s, (_, f, _) in vocab.UNITS.items() if f is not None}), symbol)
    return (
        F.when(symbol == "K", value)
        .when(symbol == "°C", value + 273.15)
        .when(symbol == "°F", (value - 32) * 5.0 / 9.0 + 273.15)
        .otherwise(value * factor)
    )


def compare_quantities(v1: Column, u1: Column, v2: Column, u2: Column, larger: bool = True) -> Column:
    """``first``, ``second``, ``equal`` or ``incomparable``."""
    a, b = to_base(v1, u1), to_base(v2, u2)
    equal = F.abs(a - b) <= 1e-9 * F.greatest(F.abs(a), F.abs(b))
    first = a > b if larger else a < b
    return (
        F.when(unit_category(u1) != unit_category(u2), "incomparable")
        .when(equal, "equal")
        .when(first, "first")
        .otherwise("second")
    )


# --------------------------------------------------------------------------- times


def shift_clock(minutes: Column, delta: Column) -> Column:
    return F.pmod(minutes + delta, F.lit(1440))


def duration_text(minutes: Column) -> Column:
    """``2 hours and 25 minutes``, ``1 hour``, ``45 minutes``."""
    h, m = F.floor(minutes / 60).cast("int"), F.pmod(minutes, F.lit(60)).cast("int")

    def unit(n: Column, name: str) -> Column:
        return F.concat(n.cast("string"), F.when(n == 1, f" {name}").otherwise(f" {name}s"))

    return (
        F.when((h > 0) & (m > 0), F.concat(unit(h, "hour"), F.lit(" and "), unit(m, "minute")))
        .when(h > 0, unit(h, "hour"))
        .otherwise(unit(m, "minute"))
    )


def shift_weekday(day_index: Column, offset: Column) -> Column:
    """Day name ``offset`` days on from an index with Monday as 0."""
    return F.get(F.array(*[F.lit(d) for d in vocab.DAY_NAMES]), F.pmod(day_index + offset, F.lit(7)).cast("int"))


def is_leap_year(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def date_label(text: Column) -> Column:
    """``valid`` for a date that exists, else ``impossible``."""
    return F.when(F.try_to_date(text, "yyyy-M-d").isNotNull(), "valid").otherwise("impossible")


# --------------------------------------------------------------------------- hazards


def expand_hazards(rows: DataFrame, severity: str, keep: Sequence[str], products: Sequence[str]) -> DataFrame:
    """Rows of the kept severities, each in a plain and a described variant.

    Product columns hold ``;`` lists, of which the plain variant names the first;
    an empty severity passes as ``UNKNOWN``.
    """
    level = F.upper(F.coalesce(F.col(severity), F.lit("")))
    kept = rows.filter((level == "") | level.isin(*keep))
    firsts = {c: F.trim(F.get(F.split(F.col(c), ";"), 0)) for c in products}
    variants = F.array(*[F.struct(F.lit(hard).alias("hard_mode"), F.lit(name).alias("variant")) for name, hard in (("plain", False), ("described", True))])
    return (
        kept.withColumns(firsts)
        .withColumn("hazard_severity", F.coalesce(F.nullif(level, F.lit("")), F.lit("UNKNOWN")))
        .withColumn("v", F.explode(variants))
        .select("*", "v.hard_mode", "v.variant")
        .drop("v")
    )


def testset_qa(cases: DataFrame, by: Sequence[str]) -> DataFrame:
    """Cases, blank prompts and distinct parameter names per task."""
    keys = F.explode_outer(F.json_object_keys("task_params"))

    def blank(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")) == ""

    counts = cases.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(blank("system_prompt")).alias("empty_system"),
        F.count_if(blank("user_prompt")).alias("empty_user"),
    )
    names = cases.select(*by, keys.alias("key")).filter("key is not null").groupBy(*by, "key").agg(F.count(F.lit(1)))
    per_task = names.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list("key")), ",").alias("parameters"))
    return counts.join(per_task, list(by), "left")


testset_qa.__test__ = False  # not a pytest case

