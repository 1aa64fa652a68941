"""Joins between results, test sets and earlier versions of the same results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.operators.aggregate import ratio, rounded, totals_row
from tallymill.operators.assemble import number_rows, seeded_draw, seeded_uniform
from tallymill.operators.score import jaccard


def join_testset(results: DataFrame, cases: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Result rows with their test cases.  A plain equi-join: the runtime picks broadcast by
    measured size, and splits skewed partitions of a sort-merge join."""
    return results.join(cases, list(keys), "left")


def with_styles(results: DataFrame, cases: DataFrame) -> DataFrame:
    """Result rows with the styles and language of their test case, joined by configuration and test.

    Producers write styles into the test set only; a style that a row already has stays.
    """
    said = lambda key: F.try_element_at("prompt_metadata", F.lit(key)).alias(f"_{key}")
    # a null configuration is one like others; in two columns it is a plain key, so cases are shuffled once for both steps
    key = lambda: (F.coalesce("config_hash", F.lit("")), F.isnull("config_hash"), F.col("test_id"))
    names = ("_config", "_bare", "_test")
    named = cases.select(*(x.alias(n) for x, n in zip(key(), names)), *map(said, ("user_style", "system_style", "language")))
    joined = results.join(named.dropDuplicates([*names]), [x == F.col(n) for x, n in zip(key(), names)], "left")
    columns = {x: F.coalesce(x, f"_{x}") for x in ("user_style", "system_style")} | {"language": F.col("_language")}
    return joined.withColumns(columns).drop(*names, "_user_style", "_system_style", "_language")


def lookup_join(rows: DataFrame, lookup: DataFrame, key: str, lookup_key: str) -> DataFrame:
    """Left join with a dictionary table, unhinted for the same reason."""
    return rows.join(lookup, rows[key] == lookup[lookup_key], "left")


def with_previous_turn(turns: DataFrame, text: str = "text") -> DataFrame:
    """Each turn with the text of the turn numbered one before it.

    A join on (conversation, turn) instead of a window per conversation, so a
    conversation of any length spreads over all tasks.
    """
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col(text).alias("prompt"))
    return turns.join(before, ["conv_id", "turn"], "left")


def keep_old_if_failed(new: Column, old: Column) -> Column:
    """The new value, or the old one where the new extraction failed."""
    return F.coalesce(new, old)


def change_label(old: Column, new: Column) -> Column:
    return F.when(~old & new, "improved").when(old & ~new, "regressed").otherwise("unchanged")


def rescore_rows(rows: DataFrame) -> DataFrame:
    """Compare old and new verdicts held in ``old_correct``, ``new_correct`` (null where the new
    extraction failed), ``old_value`` and ``new_value``."""
    old = F.coalesce(F.col("old_correct"), F.lit(False))
    new = keep_old_if_failed(F.col("new_correct"), old)
    changed = F.col("new_correct").isNotNull() & (
        F.coalesce("old_value", F.lit("")) != F.coalesce("new_value", F.lit(""))
    )
    return rows.withColumns({"old": old, "new": new, "change": change_label(old, new), "parse_changed": changed})


def rescore_diff(rows: DataFrame, by: str = "task_type") -> DataFrame:
    """Counts of improved and regressed rows and both accuracies per task, plus a total."""
    n = F.count(F.lit(1))
    better, worse = F.count_if(F.col("change") == "improved"), F.count_if(F.col("change") == "regressed")
    return totals_row(
        rescore_rows(rows),
        by,
        [
            n.alias("total"),
            F.count_if("parse_changed").alias("parse_changed"),
            better.alias("improved"),
            worse.alias("regressed"),
            F.count_if(F.col("change") == "unchanged").alias("unchanged"),
            rounded(ratio(F.count_if("old"), n)).alias("old_accuracy"),
            rounded(ratio(F.count_if("new"), n)).alias("new_accuracy"),
            (better - worse).alias("net"),
        ],
    )


VERSION_KEYS = ("config_hash", "test_id", "model_name")


def version_diff(old: DataFrame, new: DataFrame, order: Sequence[str], keys: Sequence[str] = VERSION_KEYS, value: str = "value", correct: str = "correct", carry: Sequence[str] = ()) -> DataFrame:
    """Full join of two versions of a log: keys, ``carry``, old_value, new_value, old_correct, new_correct, parse_changed, change.

    ``change`` is added, removed, improved, regressed or unchanged.  Both versions go into one aggregation by
    key, which is a full join that takes null keys as equal: each task reduces its rows to one per key
    first, so neither a hot model nor a key that repeats is shuffled whole.  Of rows of one version with the
    same key the last by ``order`` counts; ``carry`` columns come from the new version where it has the row.
    A row without a verdict counts as wrong.
    """
    said = F.struct(F.struct(*order).alias("at"), F.col(value).alias("value"), F.coalesce(F.col(correct), F.lit(False)).alias("correct"), *carry).alias("_row")
    sides = [df.select(*keys, F.lit(side).alias("_new"), said) for side, df in ((False, old), (True, new))]
    last = lambda side: F.max_by("_row", F.when(F.col("_new") == side, F.struct("_row.at", "_row.correct", "_row.value")))
    both = sides[0].unionByName(sides[1]).groupBy(*keys).agg(last(False).alias("o"), last(True).alias("n"))
    a, b = F.col("o.correct"), F.col("n.correct")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise(change_label(a, b))
    held = F.col("o").isNotNull() & F.col("n").isNotNull()
    return both.select(
        *keys,
        *(F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in carry),
        F.col("o.value").alias("old_value"),
        F.col("n.value").alias("new_value"),
        a.alias("old_correct"),
        b.alias("new_correct"),
        (held & ~F.equal_null("o.value", "n.value")).alias("parse_changed"),
        change.alias("change"),
    )


def version_counts(diff: DataFrame, by: str) -> DataFrame:
    """Rows of each kind of change and the accuracy of either version, per group and in all."""
    kinds = ("added", "removed", "improved", "regressed", "unchanged")
    share = lambda c: rounded(ratio(F.count_if(c), F.count(c)))
    return totals_row(
        diff,
        by,
        [
            F.count(F.lit(1)).alias("total"),
            *(F.count_if(F.col("change") == k).alias(k) for k in kinds),
            F.count_if("parse_changed").alias("parse_changed"),
            share("old_correct").alias("old_accuracy"),
            share("new_correct").alias("new_accuracy"),
        ],
    )


def mismatch_pairs(items: DataFrame, pool: DataFrame, item_group: str, pool_group: str, identity: str, member: str, partners: int = 3, seed: str = "42") -> DataFrame:
    """Items paired with ``partners`` pool members of other groups, drawn by seed and item identity.

    Members are numbered group by group, each group in the order of its members' draws, so a group is a
    range of numbers.  An item draws a place outside its own group's range and takes the next places too
    (going round), which are different members.  The pairs come out of an equi-join on the number, which
    is unique: no group name, however hot, decides where a pair is made.  With fewer other members than
    ``partners`` an item gets them all; rows of ``items`` without a group may get any member.
    """
    draw = seeded_draw(seed, F.col(member))
    members = number_rows(pool.withColumn("_draw", draw), [pool_group, "_draw", member], "_number").drop("_draw").withColumn("_number", F.col("_number") - 1)
    ranges = members.groupBy(F.col(pool_group).alias("_g")).agg(F.min("_number").alias("_low"), F.count(F.lit(1)).alias("_size"))
    total = pool.agg(F.count(F.lit(1))).scalar()
    placed = items.join(ranges, items[item_group] == F.col("_g"), "left").withColumns(
        {"_low": F.coalesce("_low", F.lit(0)), "_size": F.coalesce("_size", F.lit(0)), "_total": total}
    )
    others = F.col("_total") - F.col("_size")
    first = F.floor(seeded_uniform(seed, F.col(identity)) * others)
    turns = F.when(others > 0, F.sequence(F.lit(0), F.least(F.lit(partners), others) - 1))
    drawn = placed.withColumn("_turn", F.explode(turns)).withColumn("_at", (first + F.col("_turn")) % others)
    number = F.when(F.col("_at") < F.col("_low"), F.col("_at")).otherwise(F.col("_at") + F.col("_size"))
    return drawn.withColumn("_n", number).join(members, F.col("_n") == F.col("_number")).drop("_g", "_low", "_size", "_total", "_turn", "_at", "_n", "_number")


def empty_prompt_check(cases: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cases with a blank system or user prompt, counted."""

    def blank(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")) == ""

    return cases.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(blank("system_prompt")).alias("empty_system"),
        F.count_if(blank("user_prompt")).alias("empty_user"),
    )


def missing_cases(cases: DataFrame, results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Test cases for which no result row exists."""
    return cases.join(results, list(keys), "left_anti")


def set_overlap(a: Column, b: Column) -> Column:
    """Struct of intersection size, union size, subset either way, and Jaccard."""
    both, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.struct(
        both.alias("common"),
        union.alias("combined"),
        (F.size(F.array_except(a, b)) == 0).alias("a_in_b"),
        (F.size(F.array_except(b, a)) == 0).alias("b_in_a"),
        rounded(jaccard(a, b)).alias("jaccard"),
    )
