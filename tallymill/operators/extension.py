"""Scorers per task, open to the user: register a task with its extraction, score and metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.operators import score
from tallymill.operators.aggregate import rounded, taxonomy
from tallymill.operators.extract import Params, extract_by_task

ScoreFn = Callable[[Column, Column, Params], Column]


@dataclass(frozen=True)
class ScorerSpec:
    """What a task needs: a score from (answer struct, expected text, parameters), and extra metrics.

    The score column is a struct that starts with ``correct``, ``match_type``
    and ``accuracy``.  ``metrics`` are aggregate columns by name, or a function
    that makes them (columns need a session); ``dimensions`` are the parameters
    by which the task's results are broken down.
    """

    task: str
    score: ScoreFn
    metrics: Mapping[str, Column] | Callable[[], Mapping[str, Column]] = field(default_factory=dict)
    dimensions: Sequence[str] = ()

    def aggregates(self) -> Mapping[str, Column]:
        return self.metrics() if callable(self.metrics) else self.metrics


class ScorerBook:
    """Scorers by task name, written out rather than discovered."""

    def __init__(self, specs: Sequence[ScorerSpec] = ()):
        self._specs: dict[str, ScorerSpec] = {}
        for spec in specs:
            self.register(spec)

    def register(self, spec: ScorerSpec, replace: bool = False) -> ScorerSpec:
        if spec.task in self._specs and not replace:
            raise ValueError(f"task {spec.task!r} already has a scorer")
        self._specs[spec.task] = spec
        return spec

    def get(self, task: str) -> ScorerSpec | None:
        return self._specs.get(task)

    def __iter__(self) -> Iterator[ScorerSpec]:
        return iter(self._specs.values())

    def tasks(self) -> list[str]:
        return sorted(self._specs)

    def copy(self) -> "ScorerBook":
        return ScorerBook(list(self))


def _base(verdict: Column) -> Column:
    return F.struct(*[verdict[c].alias(c) for c in ("correct", "match_type", "accuracy")])


def score_by_task(
    rows: DataFrame,
    book: ScorerBook,
    task: str,
    answer: str,
    expected: str,
    params: Mapping[str, Column],
    output: str = "verdict",
) -> DataFrame:
    """Verdict of each row by the scorer of its task; an unknown task is labelled ``unknown``.

    One conditional struct per row: no shuffle, and each row evaluates its own scorer only.
    """
    p = Params(params)
    chosen = None
    for spec in book:
        verdict = _base(spec.score(F.col(answer), F.col(expected), p))
        is_task = F.col(task) == spec.task
        chosen = F.when(is_task, verdict) if chosen is None else chosen.when(is_task, verdict)
    unknown = F.struct(F.lit(False).alias("correct"), F.lit("unknown").alias("match_type"), F.lit(0.0).alias("accuracy"))
    return rows.withColumn(output, unknown if chosen is None else chosen.otherwise(unknown))


def extract_and_score(
    rows: DataFrame, book: ScorerBook, task: str, text: str, expected: str, params: Mapping[str, Column], tasks: Sequence[str] | None = None
) -> DataFrame:
    """From raw responses to verdicts in one narrow pass.

    ``tasks`` names the tasks that occur: only their rules become part of the plan.  Rows of other
    tasks are labelled unknown.
    """
    if tasks is not None:
        book = ScorerBook([spec for spec in book if spec.task in tasks])
    return score_by_task(extract_by_task(rows, task, text, params, tasks=tasks), book, task, "answer", expected, params)


#: Parameters of the tasks in ``task_params``: their names and types.
PARAM_FIELDS = """
  expected_answer string, expected_next_state string, rows int, cols int, live_cell string, dead_cell string, width int, word_length int,
  sub_type string, question_type string, question_mode string, time_format string, task_mode string, comparison_type string,
  correct_position string, value1 string, unit1_symbol string, value2 string, unit2_symbol string, is_impossible string,
  symbols array<string>, commuted_answers array<string>, regrouped_answers array<string>, locations array<string>, object string,
  initial_location string, container_a string, container_b string, conjunction_item string, component_a string, component_b string, plaintext string"""


def rescore(rows: DataFrame, book: ScorerBook, tasks: Sequence[str] | None = None) -> DataFrame:
    """Old and new verdicts of exploded result rows of any tasks, for ``compare.rescore_diff``.

    Reads ``task_type``, ``task_params`` (JSON), ``raw_response``, ``parsed_answer``, ``status`` and
    ``correct``.  Rows that failed, have no response, or whose task has no scorer are left out.
    Extraction, expected value and scorer go by the row's task; where extraction fails the new
    verdict is null, which keeps the old one.
    """
    known = [t for t in book.tasks() if tasks is None or t in tasks]
    usable = rows.filter((F.col("status") == "success") & (F.coalesce("raw_response", F.lit("")) != "") & F.col("task_type").isin(known))
    read = usable.withColumn("_p", F.from_json("task_params", PARAM_FIELDS))
    params = {f: F.col(f"_p.{f}") for f in read.select("_p.*").columns if not f.startswith("expected")} | {"raw_response": F.col("raw_response")}
    expected = F.coalesce(F.nullif("_p.expected_answer", F.lit("")), F.col("_p.expected_next_state"))
    scored = extract_and_score(read.withColumn("_expected", expected), book, "task_type", "raw_response", "_expected", params, known)
    failed = F.col("answer.error").isNotNull()
    return scored.select(
        *rows.columns,
        F.col("correct").alias("old_correct"),
        F.when(~failed, F.col("verdict.correct")).alias("new_correct"),
        F.col("parsed_answer").alias("old_value"),
        F.coalesce("answer.value", F.to_json("answer.items"), F.to_json("answer.cells"), F.to_json("answer.grid")).alias("new_value"),
    )


def task_metrics(scored: DataFrame, spec: ScorerSpec, by: Sequence[str] = ()) -> DataFrame:
    """Base aggregate of a task with the metrics its scorer declares."""
    out = scored.select("*", "verdict.*")
    base = [F.count(F.lit(1)).alias("total"), F.count_if("correct").alias("correct")]
    return out.groupBy(*by).agg(*base, *[c.alias(n) for n, c in spec.aggregates().items()])


def pandas_scorer(fn: Callable[[pd.Series, pd.Series], pd.DataFrame]) -> Callable[[Column, Column], Column]:
    """Opt-in scorer for rules without a column form: Arrow batches in, verdict struct out.

    ``fn`` takes the answers and the expected values of a batch and returns a
    frame with ``correct``, ``match_type`` and ``accuracy``.
    """

    @F.pandas_udf("correct boolean, match_type string, accuracy double")
    def scorer(answer: pd.Series, expected: pd.Series) -> pd.DataFrame:
        return fn(answer, expected)

    return scorer


def _text_score(fn: Callable[[Column, Column], Column]) -> ScoreFn:
    return lambda answer, expected, p: fn(answer["value"], expected)


def _letters(answer: Column, expected: Column, p: Params) -> Column:
    kind = F.coalesce(p.text("sub_type"), F.lit("count"))
    value = answer["value"]
    return (
        F.when(kind.isin("anagram", "pangram", "lipogram"), _base(score.score_boolean(value, expected)))
        .when(kind.isin("reverse", "nth_letter"), _base(score.score_text(value, expected)))
        .otherwise(_base(score.score_integer(value, expected)))
    )


def _shapes(answer: Column, expected: Column, p: Params) -> Column:
    kind = F.coalesce(p.text("question_type"), F.lit("dimensions"))
    value = answer["value"]
    same = score.score_boolean(value, expected)["correct"]
    label = F.when(value.isNull(), "parse_error").when(same, "exact").otherwise("mismatch")
    truth = _base(score.by_label(label, ("exact",)))
    return (
        F.when(kind == "count", _base(score.score_count(value, expected)))
        .when(kind == "position", truth)
        .otherwise(_base(score.score_dimensions(value, expected)))
    )


def _rates(*names: str) -> Callable[[], Mapping[str, Column]]:
    return lambda: {name: rate for name, rate in taxonomy().items() if name in names}


def _mean_accuracy() -> Mapping[str, Column]:
    return {"cell_accuracy": rounded(F.avg(F.when(F.col("match_type") != "parse_error", F.col("accuracy"))))}


def _failed(answer: Column) -> Column:
    return answer["error"].isNotNull()


DEFAULT_SCORERS = ScorerBook(
    [
        ScorerSpec("arithmetic", _text_score(score.score_numeric)),
        ScorerSpec(
            "game_of_life",
            lambda a, e, p: score.score_grid(a["grid"], F.from_json(e, "array<array<int>>")), metrics=_mean_accuracy),
        ScorerSpec(
            "linda_fallacy",
            lambda a, e, p: score.score_ranking(
                a["items"], p.text("conjunction_item"), p.text("component_a"), p.text("component_b")
            ), metrics=_rates("fallacy_rate")),
        ScorerSpec("ascii_shapes", _shapes, dimensions=("question_type",)),
        ScorerSpec("cellular_automata_1d", lambda a, e, p: score.score_cells(a["cells"], F.from_json(e, "array<int>")), metrics=_mean_accuracy),
        ScorerSpec("object_tracking", lambda a, e, p: score.score_synonym(a["value"], e, p.text("initial_location")), metrics=_rates("parse_error_rate")),
        ScorerSpec(
            "sally_anne", lambda a, e, p: score.score_belief(a["value"], e, p.text("container_a"), p.text("container_b")), metrics=_rates("reality_trap_rate")),
        ScorerSpec(
            "carwash", lambda a, e, p: score.score_trap(a["value"], F.coalesce(e, F.lit("drive")), "walk", _failed(a))
        ),
        ScorerSpec(
            "inverted_cup", lambda a, e, p: score.score_trap(a["value"], F.coalesce(e, F.lit("flip")), None, _failed(a))
        ),
        ScorerSpec("strawberry", _letters, dimensions=("sub_type",)),
        ScorerSpec(
            "measure_comparison",
            lambda a, e, p: score.score_equal_incomparable(
                a["value"],
                e,
                F.coalesce(p.text("comparison_type"), F.lit("same_unit")),
                F.when(p.text("correct_position") == "first", F.concat_ws(" ", p.text("value1"), p.text("unit1_symbol"))).when(
                    p.text("correct_position") == "second", F.concat_ws(" ", p.text("value2"), p.text("unit2_symbol"))
                ),
            ), metrics=_rates("decimal_trap_accuracy"), dimensions=("comparison_type",)),
        ScorerSpec("grid_tasks", _text_score(score.score_graded_text)),
        ScorerSpec(
            "time_arithmetic",
            lambda a, e, p: score.score_temporal(
                a["value"],
                e,
                F.coalesce(p.text("question_mode"), F.lit("result_time")),
                F.coalesce(p.text("is_impossible") == "true", F.lit(False)),
            ), metrics=_rates("impossible_detection_rate", "hallucination_rate", "false_refusal_rate"), dimensions=("question_mode",)),
        ScorerSpec("misquote", lambda a, e, p: score.score_two_axis(a["value"], a["second"], a["strategy"])),
        ScorerSpec("false_premise", lambda a, e, p: score.score_refusal(a["value"]), metrics=_rates("hedge_rate", "compliance_rate")),
        ScorerSpec("family_relations", _text_score(score.score_direction)),
        ScorerSpec(
            "encoding_cipher",
            lambda a, e, p: score.score_decoded(
                a["value"], e, F.coalesce(p.text("task_mode"), F.lit("decode_only")), p.text("raw_response"), p.text("plaintext")
            ), metrics=_rates("refusal_rate", "hallucinated_execution_rate", "wrong_decode_rate"), dimensions=("task_mode",)),
        ScorerSpec(
            "symbol_arithmetic",
            lambda a, e, p: score.score_alternates(a["value"], e, p.array("commuted_answers"), p.array("regrouped_answers")), metrics=_rates("commutativity_rate", "associativity_rate", "undefined_detection_rate")),
    ]
)
