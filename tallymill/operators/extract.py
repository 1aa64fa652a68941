"""Extraction over a DataFrame of responses: adds an ``answer`` struct per row.

The answer has one typed slot per kind of answer: ``value`` (text, number or
truth value as text), ``second`` (second answer of a pair), ``items`` (ranking),
``cells`` and ``grid``.  Parameters come from columns named in ``params``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.functions import lists, rules
from tallymill.functions.cascade import Rule, by_kind, decode, hit, let
from tallymill.functions.refusal import compliance, leanings, parts, refusal_rules, signals, tidy_text
from tallymill.functions.text import strip_verification_tail, strip_ws
from tallymill.operators.aggregate import rounded

ANSWER_TYPE = (
    "struct<value:string,second:string,items:array<string>,cells:array<int>,grid:array<array<int>>,"
    "strategy:string,confidence:double,error:string>"
)


class Params:
    """Access to parameter columns; a parameter nobody supplies is null."""

    def __init__(self, columns: Mapping[str, Column]):
        self._columns = dict(columns)

    def text(self, name: str) -> Column:
        return self._columns[name].cast("string") if name in self._columns else F.lit(None).cast("string")

    def integer(self, name: str) -> Column:
        return self._columns[name].cast("int") if name in self._columns else F.lit(None).cast("int")

    def array(self, name: str, kind: str = "string") -> Column:
        return self._columns.get(name, F.lit(None)).cast(f"array<{kind}>")


def answer_struct(
    value: Column | None = None,
    second: Column | None = None,
    items: Column | None = None,
    cells: Column | None = None,
    grid: Column | None = None,
    strategy: Column | None = None,
    confidence: Column | None = None,
    error: Column | None = None,
) -> Column:
    def slot(col: Column | None, kind: str, name: str) -> Column:
        return (F.lit(None) if col is None else col).cast(kind).alias(name)

    return F.struct(
        slot(value, "string", "value"),
        slot(second, "string", "second"),
        slot(items, "array<string>", "items"),
        slot(cells, "array<int>", "cells"),
        slot(grid, "array<array<int>>", "grid"),
        slot(strategy, "string", "strategy"),
        slot(confidence, "double", "confidence"),
        slot(error, "string", "error"),
    )


class Extraction:
    """How one task is extracted.

    ``find`` encodes the hit of a row and ``read`` opens it into the answer
    struct.  ``prepare`` lists steps of columns to make first; each step gets
    the text and the columns of the steps before it.  The steps stay separate
    projections, so what several rules need is computed once per row.
    """

    def __init__(
        self,
        find: Callable[[Column, Params], Column],
        read: Callable[[Column, Column, Params], Column],
        prepare: Sequence[Callable[[Column, dict[str, Column]], dict[str, Column]]] = (),
    ):
        self.find = find
        self.read = read
        self.prepare = prepare

    def prepared(self, df: DataFrame, text: Column, mark: str, only: Column | None = None) -> DataFrame:
        done: dict[str, Column] = {}
        for step in self.prepare:
            new = step(text, done)
            df = df.withColumns({f"{mark}{k}": v if only is None else F.when(only, v) for k, v in new.items()})
            done.update({k: F.col(f"{mark}{k}") for k in new})
        return df


#: Confidence of the tasks that report a guess when every rule has failed.
GUESS = 0.1


def by_rules(
    make: Callable[[Params], Sequence[Rule]], failed: str = "failed", fallback: str | None = None, sure: float = 0.0, blank: str = "empty"
) -> Extraction:
    """One rule list for the task.  ``fallback`` is the value reported together with the error, ``sure`` its confidence."""

    def read(found: Column, text: Column, p: Params) -> Column:
        d = decode(found, make(p), text, failed, sure, blank)
        value = d["value"] if fallback is None else F.coalesce(d["value"], F.lit(fallback))
        return answer_struct(value=value, strategy=d["strategy"], confidence=d["confidence"], error=d["error"])

    return Extraction(lambda text, p: hit(text, make(p)), read)


def by_sub_type(
    make: Callable[[Params], dict[str, Sequence[Rule]]], key: str, default: str, failed: Mapping[str, str] | str = "failed", sure: float = 0.0
) -> Extraction:
    """A rule list per value of a parameter.  ``failed`` is the label of failure, or one per value of the parameter."""

    def kind(p: Params) -> Column:
        return F.coalesce(p.text(key), F.lit(default))

    def find(text: Column, p: Params) -> Column:
        return by_kind(kind(p), make(p), default, text)[0]

    def read(found: Column, text: Column, p: Params) -> Column:
        label = failed
        if not isinstance(failed, str):
            label = F.coalesce(*[F.when(kind(p) == k, v) for k, v in failed.items()], F.lit(failed[default]))
        d = decode(found, [r for part in make(p).values() for r in part], text, label, sure)
        return answer_struct(value=d["value"], strategy=d["strategy"], confidence=d["confidence"], error=d["error"])

    return Extraction(find, read)


def _pair_read(found: Column, text: Column, p: Params) -> Column:
    d = decode(found, rules.YES_NO_PAIR, text, "fallback")
    second = F.nullif(F.substring_index(d["value"], "|", -1), F.lit(""))
    first = F.substring_index(d["value"], "|", 1)
    return answer_struct(first, second, strategy=d["strategy"], confidence=d["confidence"], error=d["error"])


def _list_read(field: str, slot: str) -> Callable[[Column, Column, Params], Column]:
    def read(found: Column, text: Column, p: Params) -> Column:
        missing = F.when(found[field].isNull(), "No strategy succeeded")
        strategy = F.coalesce(found["strategy"], F.lit("failed"))
        sure = F.when(found[field].isNotNull(), 1.0).otherwise(0.0)
        return answer_struct(**{slot: found[field]}, strategy=strategy, confidence=sure, error=missing)

    return read


_REFUSAL_COLUMNS = ("text", "clean", "tail", "short_tail", "refuses", "hedges", "opens", "closes", "ratio", "instructs", "complies", "mixed", "lean")


def _refusal_rules() -> Sequence[Rule]:
    return refusal_rules({k: F.col(f"_false_premise_{k}") for k in _REFUSAL_COLUMNS})


def _refusal_read(found: Column, text: Column, p: Params) -> Column:
    d = decode(found, _refusal_rules(), text, "fallback", GUESS)
    return answer_struct(value=d["value"], strategy=d["strategy"], confidence=d["confidence"], error=d["error"])


def _letters(p: Params) -> dict[str, Sequence[Rule]]:
    n = p.integer("word_length")
    return {
        "count": rules.letter_count_rules(n),
        "reverse": rules.reversed_word_rules(n),
        "nth_letter": rules.NTH_LETTER,
        "anagram": rules.BOOLEAN,
        "pangram": rules.BOOLEAN,
        "lipogram": rules.BOOLEAN,
    }


def _quantities(p: Params) -> dict[str, Sequence[Rule]]:
    v1, v2 = p.text("value1"), p.text("value2")
    return {
        "quantity": rules.quantity_rules(v1, p.text("unit1_symbol"), v2, p.text("unit2_symbol")),
        "decimal": rules.decimal_rules(v1, v2),
    }


EXTRACTIONS: dict[str, Extraction] = {
    "arithmetic": by_rules(lambda p: rules.ARITHMETIC),
    "family_relations": by_rules(lambda p: rules.FAMILY, "fallback"),
    "strawberry": by_sub_type(_letters, "sub_type", "count"),
    "grid_tasks": by_rules(lambda p: rules.TABLE_QUESTION, "no_match"),
    "symbol_arithmetic": by_rules(lambda p: rules.symbol_rules(p.array("symbols"))),
    "ascii_shapes": by_sub_type(lambda p: rules.SHAPES, "question_type", "dimensions"),
    "object_tracking": by_rules(lambda p: rules.location_rules(p.array("locations"), p.text("object"))),
    "sally_anne": by_rules(lambda p: rules.container_rules(p.text("container_a"), p.text("container_b")), "fallback", blank="none"),
    "encoding_cipher": by_sub_type(lambda p: rules.DECODING, "task_mode", "decode_only"),
    "carwash": by_rules(lambda p: rules.CARWASH, "fallback", "other", GUESS),
    "inverted_cup": by_rules(lambda p: rules.INVERTED_CUP, "fallback", "wrong", GUESS),
    "time_arithmetic": by_sub_type(
        lambda p: rules.time_rules(F.coalesce(p.text("time_format"), F.lit("12h")) == "12h"), "question_mode", "result_time", "none"
    ),
    "measure_comparison": by_sub_type(
        _quantities, "comparison_type", "quantity", {"quantity": "fallback", "decimal": "decimal_fallback"}, GUESS
    ),
    "misquote": Extraction(lambda text, p: hit(text, rules.YES_NO_PAIR), _pair_read),
    "false_premise": Extraction(
        lambda text, p: hit(text, _refusal_rules()),
        _refusal_read,
        (lambda text, done: tidy_text(text), *(lambda text, done, step=step: step(done) for step in (parts, signals, compliance, leanings))),
    ),
    "linda_fallacy": Extraction(lambda text, p: lists.extract_ranking(text), _list_read("items", "items")),
    "cellular_automata_1d": Extraction(
        lambda text, p: lists.extract_cells(strip_ws(text), F.coalesce(p.integer("width"), F.lit(16))),
        _list_read("cells", "cells"),
    ),
    "game_of_life": Extraction(
        lambda text, p: lists.extract_grid(text, p.integer("rows"), p.integer("cols"), p.text("live_cell"), p.text("dead_cell")),
        _list_read("grid", "grid"),
    ),
}


def extract(
    responses: DataFrame,
    task: str,
    text: str,
    params: Mapping[str, Column] | None = None,
    strip_tail: bool = False,
    output: str = "answer",
) -> DataFrame:
    """Responses of one task with their ``answer`` struct; a narrow projection, no shuffle."""
    p = Params(params or {})
    step = EXTRACTIONS[task]
    source = F.coalesce(F.col(text), F.lit(""))
    source = strip_verification_tail(source) if strip_tail else source
    ready = step.prepared(responses.withColumn("_text", source), F.col("_text"), f"_{task}_")
    found = ready.withColumn("_hit", step.find(F.col("_text"), p))
    out = found.withColumn(output, step.read(F.col("_hit"), F.col("_text"), p))
    return out.select(*responses.columns, output)


def extract_by_task(
    responses: DataFrame,
    task_column: str,
    text: str,
    params: Mapping[str, Column] | None = None,
    output: str = "answer",
    tasks: Sequence[str] | None = None,
) -> DataFrame:
    """Responses of all tasks in one pass: each row runs only the rules of its own task.

    With ``tasks`` only the rules of those are built and compiled.
    """
    p = Params(params or {})
    steps = {t: e for t, e in EXTRACTIONS.items() if tasks is None or t in tasks}
    source = F.coalesce(F.col(text), F.lit(""))
    ready = responses.withColumn("_text", source)
    for task, step in steps.items():
        ready = step.prepared(ready, F.col("_text"), f"_{task}_", F.col(task_column) == task)
    hits = ready.withColumns(
        {
            f"_hit_{task}": F.when(F.col(task_column) == task, step.find(F.col("_text"), p))
            for task, step in steps.items()
        }
    )
    chosen = None
    for task, step in steps.items():
        # opened on a variable, as the generated method for the answers of all tasks would be too long to be compiled
        answer = let(F.col(f"_hit_{task}"), lambda found, read=step.read: read(found, F.col("_text"), p))
        is_task = F.col(task_column) == task
        chosen = F.when(is_task, answer) if chosen is None else chosen.when(is_task, answer)
    unknown = answer_struct(strategy=F.lit("failed"), confidence=F.lit(0.0), error=F.lit("Unknown task"))
    answered = unknown if chosen is None else chosen.otherwise(unknown)
    return hits.withColumn(output, answered).select(*responses.columns, output)


def extraction_report(extracted: DataFrame, by: Sequence[str], answer: str = "answer") -> DataFrame:
    """Rows per strategy with their share of the group, mean confidence and failures."""
    from pyspark.sql import Window

    a = F.col(answer)
    per = extracted.groupBy(*by, a["strategy"].alias("strategy")).agg(
        F.count(F.lit(1)).alias("n"),
        rounded(F.avg(a["confidence"])).alias("mean_confidence"),
        F.count_if(a["error"].isNotNull()).alias("failed"),
    )
    group = Window.partitionBy(*by)
    return per.withColumn("share", rounded(F.col("n") / F.sum("n").over(group)))
