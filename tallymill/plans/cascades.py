"""Answer extraction of the tasks with cascades of their own, over composed texts.

A text is an opening, an answer and a closing, each picked by another key of the row, with numbers,
words and names of the row filled in; so rules meet distractors, later answers and cut tails.  The
twins compute every rule of a task on the text by the check engine's own pattern functions.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.fixtures import table
from tallymill.functions import rules, vocab
from tallymill.functions.cascade import let
from tallymill.operators.extract import extract, extract_by_task
from tallymill.plans.registry import query
from tallymill.session import spread

ROW_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEY_SQL = ", ".join(ROW_KEY)
PICKS = ("(l_orderkey + l_linenumber)", "(l_partkey + 3 * l_linenumber)", "l_suppkey")


def choice(key: str, options: Sequence[str]) -> str:
    """One of the options by the remainder of a key, in both dialects."""
    cases = " ".join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(options))
    return f"CASE {key} % {len(options)} {cases} END"


N = "CAST(CAST(l_quantity AS INT) AS STRING)"
M = "CAST(l_linenumber AS STRING)"


@dataclass(frozen=True)
class Composed:
    """Texts of one task: three lists of pieces, what is filled in, parameters, and the twin's rules.

    ``twin`` lists (strategy, expression) in order, or such a list per value of the parameter ``kind``.
    """

    task: str
    pieces: tuple[Sequence[str], Sequence[str], Sequence[str]]
    twin: Sequence[tuple[str, str]] | Mapping[str, Sequence[tuple[str, str]]]
    fills: Mapping[str, str] = field(default_factory=dict)
    params: Mapping[str, str] = field(default_factory=dict)
    arrays: Mapping[str, Sequence[str]] = field(default_factory=dict)
    kind: str | None = None
    failed: str = "failed"
    blank: str = "empty"
    fallback: str | None = None

    def text(self) -> Column:
        def pick(key: str, options: Sequence[str]) -> Column:
            return F.element_at(F.array(*map(F.lit, options)), F.expr(f"CAST({key} % {len(options)} AS INT) + 1"))

        out = F.concat(*[pick(k, o) for k, o in zip(PICKS, self.pieces)])
        for name, sql in self.fills.items():
            out = F.replace(out, F.lit(f"<{name}>"), F.expr(sql))
        return out

    def text_sql(self) -> str:
        out = " || ".join(f"list_extract([{', '.join(map(quoted, o))}], CAST({k} % {len(o)} AS INT) + 1)" for k, o in zip(PICKS, self.pieces))
        for name, sql in self.fills.items():
            out = f"replace({out}, '<{name}>', {sql})"
        return out

    def columns(self) -> dict[str, Column]:
        scalars = {n: F.expr(sql) for n, sql in self.params.items()}
        return scalars | {n: F.array(*map(F.lit, v)) for n, v in self.arrays.items()}

    def sql(self, where: str = "TRUE") -> str:
        params = "".join(f", {sql} AS {n}" for n, sql in self.params.items())
        flat = [(None, s, e) for s, e in self.twin] if not isinstance(self.twin, Mapping) else [(k, s, e) for k, part in self.twin.items() for s, e in part]
        tried = ", ".join((e if k is None else f"CASE WHEN {self.kind} = '{k}' THEN {e} END") + f" AS r{i}" for i, (k, _, e) in enumerate(flat))
        hits = ", ".join(f"r{i}" for i in range(len(flat)))
        names = " ".join(f"WHEN r{i} IS NOT NULL THEN '{s}'" for i, (_, s, _) in enumerate(flat))
        value = f"coalesce({hits})" if self.fallback is None else f"coalesce({hits}, '{self.fallback}')"
        return f"""SELECT {KEY_SQL}, {value} AS value, CASE {names} WHEN regexp_matches(t, '^\\s*$') THEN '{self.blank}' ELSE '{self.failed}' END AS strategy
          FROM (SELECT *, {tried} FROM (SELECT *, {cut_sql('t')} AS kept, lower(t) AS low, lower(kept) AS lowkept
            FROM (SELECT {KEY_SQL}, {self.text_sql()} AS t{params} FROM lineitem WHERE {where})))"""


# --------------------------------------------------------------------------- pieces of the twins

WS = "' ' || chr(9) || chr(10) || chr(13)"
BOXED = r"\\boxed\{([^}]+)\}"
BOLD = r"\*\*([^*]+)\*\*"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def every(pattern: str, group: int = 0, t: str = "t") -> str:
    return f"regexp_extract_all({t}, {quoted(pattern)}, {group})"


def last(pattern: str, group: int = 1, t: str = "t") -> str:
    return f"list_last({every(pattern, group, t)})"


def first(pattern: str, group: int = 1, t: str = "t") -> str:
    return f"list_first({every(pattern, group, t)})"


def has(pattern: str, t: str = "t") -> str:
    return f"regexp_matches({t}, {quoted(pattern)})"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


_names = iter(range(1_000_000))


def bind(x: str, use: Callable[[str], str]) -> str:
    """``use`` of a name for the expression, which is then computed once."""
    name = f"v{next(_names)}"
    return f"list_extract(list_transform([{x}], lambda {name}: {use(name)}), 1)"


def each(xs: str, use: Callable[[str], str]) -> str:
    name = f"v{next(_names)}"
    return f"list_transform({xs}, lambda {name}: {use(name)})"


def those(xs: str, keep: Callable[[str], str]) -> str:
    name = f"v{next(_names)}"
    return f"list_filter({xs}, lambda {name}: {keep(name)})"


def present(xs: str) -> str:
    return those(xs, lambda x: f"{x} IS NOT NULL")


def one_of(x: str, options: Sequence[str]) -> str:
    return f"{x} IN ({', '.join(map(quoted, options))})"


def named(x: str, mapping: Mapping[str, str]) -> str:
    """The entry of a fixed list for a value, null if it has none."""
    return f"CASE {x} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in mapping.items()) + " END"


def contains_any(x: str, phrases: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {quoted(p)})" for p in phrases) + ")"


def cut_sql(t: str) -> str:
    head = r"(?i)(?:^|\n)\s*let me check"
    return f"CASE WHEN {has(head, t)} THEN coalesce(nullif(rtrim(regexp_extract({t}, '(?is)^(.*?)(?:^|\\n)\\s*let me check', 1), {WS}), ''), {t}) ELSE {t} END"


def integer(x: str) -> str:
    digits = lambda v: f"WHEN regexp_full_match({v}, '[0-9]+') THEN CAST(TRY_CAST({v} AS BIGINT) AS VARCHAR)"
    words = {w: str(n) for w, n in vocab.NUMBER_WORDS.items()}
    return bind(f"rtrim({strip(x)}, '.,;:!?')", lambda v: f"CASE {digits(v)} ELSE {named(f'''lower(trim({v}, ' .'))''', words)} END")


def at_most(x: str, limit: str) -> str:
    return bind(integer(x), lambda v: f"CASE WHEN CAST({v} AS BIGINT) <= {limit} THEN {v} END")


EDGE = quoted(".,;:!?'\"-")


def bare_word(x: str) -> str:
    return f"lower(trim({strip(x)}, {EDGE}))"


def word_of(x: str, length: str) -> str:
    return bind(bare_word(x), lambda v: f"CASE WHEN regexp_full_match({v}, '\\p{{L}}+') AND length({v}) = {length} THEN {v} END")


def letter_of(x: str) -> str:
    return bind(bare_word(x), lambda v: f"CASE WHEN regexp_full_match({v}, '\\p{{L}}') THEN {v} END")


def truth(x: str) -> str:
    return bind(bare_word(x), lambda v: f"CASE WHEN {one_of(v, vocab.YES_WORDS)} THEN 'true' WHEN {one_of(v, vocab.NO_WORDS)} THEN 'false' END")


def start_of(limit: int, classify: Callable[[str], str], t: str = "t") -> str:
    """What a short first line says, else a short first sentence."""
    line, sentence = f"string_split({t}, chr(10))[1]", f"string_split_regex({t}, '[.!?\\n]')[1]"
    short = lambda x: bind(strip(x), lambda v: classify(f"(CASE WHEN length({v}) < {limit} THEN {v} END)"))
    return f"coalesce({short(line)}, {short(sentence)})"


def sentences(t: str, n: int = 5) -> str:
    parts = f"string_split(regexp_replace({strip(t)}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
    return f"list_slice({those(parts, lambda p: f'{strip(p)} <> {quoted(str())}')}, -{n}, NULL)"


# --------------------------------------------------------------------------- letters

_NUMBERS = those(every("-?[0-9.]+"), lambda x: f"regexp_full_match({x}, '-?[0-9]+')")
_YES_NO = r"(?i)\b(" + "|".join(vocab.YES_WORDS + vocab.NO_WORDS) + r")\b"
_BOOLEAN = [
    ("boxed", truth(last(BOXED))),
    ("bold", truth(last(r"\*\*([^*]{1,20})\*\*"))),
    ("label_line", truth(last(r"(?i)(?:answer|result|verdict)\s*[:：]\s*(\S+)"))),
    ("answer_is", truth(last(r"(?i)the\s+answer\s+is\s+(\S+)"))),
    ("first_keyword", start_of(80, lambda x: truth(first(_YES_NO, 1, x)))),
    ("last_keyword", truth(last(_YES_NO))),
]
LETTERS = Composed(
    "strawberry",
    (
        ("", "The word has <m> vowels.\n", "Counting: 1, 2, 3.\n", "**Letters**\n", "Let us see\n\n", "  "),
        (
            "", "\\boxed{<n>}", "**<n>**", "Answer: <n>.", "There are <n> of them here", "so the count is <n>", "I see <n> here, 99 there",
            "it has seven of them", "'<w>'", "Reversed: '<w>'", "The third letter is <c>.", "Yes, they are.", "**No**", "Result: true",
            "the reverse is <w>", '"<c>" it is', "**<w>**", "It is <c>", "No it can not be done, right?", "The answer is wrong",
        ),
        ("", "\nDone!", "\n\\boxed{none}", "\n", " I am sure.", "\nVerdict: <c>", "\nIt is twelve."),
    ),
    {
        "count": [
            ("boxed", at_most(last(BOXED), "word_length")),
            ("bold", at_most(last(r"\*\*([^*]{1,20})\*\*"), "word_length")),
            (
                "label_line",
                at_most(
                    f"""coalesce({last(r"(?i)(?:answer|count|result|total|there\s+(?:are|is))\s*[:：]?\s*(\S+)")},
                      {last(r"(?i)the\s+(?:answer|count|result|total)\s+is\s+(\S+)")})""",
                    "word_length",
                ),
            ),
            ("is_n_tail", at_most(last(r"(?im)(?:is|are|=)\s+(\S+)\s*[.!]?\s*$"), "word_length")),
            ("last_number", at_most(f"list_last({_NUMBERS})", "word_length")),
            ("first_number", at_most(f"list_first({_NUMBERS})", "word_length")),
            ("spelled_out", integer(last(r"(?i)\b(" + "|".join(vocab.NUMBER_WORDS) + r")\b"))),
        ],
        "reverse": [
            ("boxed", word_of(last(BOXED), "word_length")),
            ("bold", word_of(last(r"\*\*([^*]{1,40})\*\*"), "word_length")),
            (
                "label_line",
                word_of(
                    f"""coalesce({last(r'''(?i)(?:answer|result|reversed?|backwards?)\s*[:：]\s*["']?(\S+)["']?''')},
                      {last(r'''(?i)the\s+revers(?:e|ed)\s+(?:is|word\s+is)\s+["']?(\S+)["']?''')})""",
                    "word_length",
                ),
            ),
            ("quoted", word_of(last(r"""["'`]([a-zA-Z]+)["'`]"""), "word_length")),
            ("last_alpha", word_of(last(r"\b([a-zA-Z]+)\b"), "word_length")),
        ],
        "nth_letter": [
            ("boxed", letter_of(last(BOXED))),
            ("bold", letter_of(last(r"\*\*([^*]{1,5})\*\*"))),
            (
                "label_line",
                letter_of(
                    f"""coalesce({last(r'''(?i)(?:answer|result|letter)\s*[:：]\s*["']?([a-zA-Z])["']?''')},
                      {last(r'''(?i)the\s+(?:\w+\s+)?letter\s+is\s+["']?([a-zA-Z])["']?''')})"""
                ),
            ),
            ("quoted", letter_of(last(r"""["'`]([a-zA-Z])["'`]"""))),
            ("is_tail", letter_of(last(r"""(?im)is\s+["']?([a-zA-Z])["']?\s*[.!]?\s*$"""))),
            ("last_single", f"lower({last(r'\b([b-hj-zB-HJ-Z])\b')})"),
        ],
        "anagram": _BOOLEAN,
        "pangram": _BOOLEAN,
        "lipogram": _BOOLEAN,
    },
    {"n": N, "m": M, "w": choice("l_partkey", ("straw", "melon", "plum", "cherry")), "c": choice("l_suppkey", ("r", "e", "q"))},
    {
        "sub_type": choice("(l_orderkey + l_suppkey)", ("count", "reverse", "nth_letter", "anagram", "pangram", "lipogram")),
        "word_length": "CAST(4 + l_orderkey % 9 AS INT)",
    },
    kind="sub_type",
)


# --------------------------------------------------------------------------- table questions


def normal(x: str) -> str:
    bare = f"trim({strip(f'''regexp_replace({x}, '\\s+', ' ', 'g')''')}, '.,;:!?')"
    return bind(
        bare,
        lambda v: f"""CASE WHEN regexp_full_match({v}, '[+-]?[0-9]*[.][0-9]+') THEN printf('%.2f', TRY_CAST({v} AS DOUBLE))
          WHEN regexp_full_match({v}, '[+-]?[0-9]+') THEN CAST(TRY_CAST({v} AS BIGINT) AS VARCHAR) ELSE {v} END""",
    )


def _few_words(x: str) -> str:
    return bind(strip(x), lambda v: f"CASE WHEN len(string_split_regex({v}, '\\s+')) <= 5 THEN {v} END")


_ASIDE = r"^\$[0-9,]+|^[0-9,]+$|^[0-9,]+\.[0-9]+$|^Q[0-9]+$|^Note:?|^Warning:?"
_LABELS = ", ".join(last(rf"(?i)(?:^|\n){label}\s*([^\n]+)") for label in ("Answer:", "The answer is:?", "Final answer:", "Result:"))
_OBJECTS = each(
    every(r'(?i)\{[^{}]*"answer"[^{}]*\}'), lambda o: f"coalesce(json_extract_string({o}, '$.answer'), json_extract_string({o}, '$.Answer'))"
)
_LINES = those(each("string_split(t, chr(10))", strip), lambda s: f"{s} <> ''")
_PREFIX = quoted(r"(?i)^(?:Answer:|The answer is:|Final answer:|Result:)\s*")
TABLES = Composed(
    "grid_tasks",
    (
        ("", "**Note:** from the table\n", "Row 3 says so.\n", "We see **Q3** and **12**.\n", "Answer: see below\n"),
        (
            "", "\\boxed{ <w>  Ltd }", "**<w>**", "**<n>**", "Answer: <n>.5.", "The answer is <w>!", '{"answer": "<w>"}', "```\n<n>\n```",
            'it is "<w> one" then', "so 'x' it is '<w>'", "The winner\n<w>.", "Final answer: 00<n>", "Result: <w> of <n>,",
            'they say "one two three four five six"', '{"answer": <n>, "sure": true}',
        ),
        ("", "\nResult: -<m>.25", "\nThat is all.", "\n\n"),
    ),
    [
        ("boxed_latex", normal(last(BOXED))),
        ("bold_markdown", normal(f"list_last({those(each(every(BOLD, 1), strip), lambda b: f'NOT {has(_ASIDE, b)} AND length({b}) > 1')})")),
        ("bold_markdown", normal(last(BOLD))),
        ("answer_pattern", normal(f"rtrim({strip(f'coalesce({_LABELS})')}, '.,;!')")),
        ("json_extraction", normal(f"list_first({present(_OBJECTS)})")),
        ("code_block", normal(strip(last(r"```(?:\w+)?\s*([^`]+)\s*```")))),
        ("quoted", normal(f"coalesce({_few_words(last('\"([^\"]+)\"'))}, {_few_words(last("'([^']+)'"))})")),
        ("last_line", normal(f"rtrim(regexp_replace(list_last({_LINES}), {_PREFIX}, ''), '.,;!')")),
        ("last_number", normal(last(r"-?[0-9]+(?:\.[0-9]+)?", 0))),
    ],
    {"n": N, "m": M, "w": choice("l_orderkey", ("Alice", "Bob and Co", "North-West", "12 units"))},
    failed="no_match",
)


# --------------------------------------------------------------------------- symbols

_SYMBOLS = ("A", "B", "AB", "★", "●")
_ALT = "AB|A|B|★|●"
SYMBOLS = Composed(
    "symbol_arithmetic",
    (
        ("", "Using the table: A then AB.\n", "First ★ and ●.\n", "**x**\n", "Let z = ★.\n"),
        (
            "", "\\boxed{ <s> }", "\\boxed{zz}", "Final answer: <s>", "therefore <s>.", "x = <s>;", "so **<s>** stands", "we get <s>",
            "This is not defined.", "there is no entry here", "nothing", "Result = <r>",
        ),
        ("", "\ny = <r>", "\nso <r> follows", "\nok", "\nThe answer stands: <s>"),
    ),
    [
        ("undefined_detection", f"CASE WHEN {contains_any('low', rules.UNDEFINED_PHRASES)} THEN 'UNDEFINED' END"),
        ("boxed_symbol", bind(strip(last(BOXED)), lambda v: f"CASE WHEN {one_of(v, _SYMBOLS)} THEN {v} END")),
        ("labelled_answer", last(rf"(?i)(?:final\s+answer|answer|result|therefore)\s*[:=]?\s*({_ALT})")),
        ("equals_pattern", last(rf"=\s*({_ALT})(?:\s|$|[.,;)!?])")),
        ("bold_symbol", last(rf"\*\*({_ALT})\*\*")),
        ("last_symbol", last(f"({_ALT})")),
    ],
    {"s": choice("l_orderkey", ("A", "B", "AB", "★", "C")), "r": choice("l_partkey", ("●", "AB", "A"))},
    arrays={"symbols": _SYMBOLS},
)


# --------------------------------------------------------------------------- shapes


def _sized(pattern: str) -> str:
    return f"CASE WHEN {has(pattern, 'low')} THEN concat_ws('x', CAST({last(pattern, 1, 'low')} AS BIGINT), CAST({last(pattern, 2, 'low')} AS BIGINT)) END"


def _end_of_last(words: Sequence[str]) -> str:
    ends = [f"CASE WHEN contains(low, {quoted(w)}) THEN length(regexp_extract(low, {quoted('(?s)^.*' + w)}, 0)) ELSE -1 END" for w in words]
    return f"greatest({', '.join(ends)})"


_SIZES = (
    r"(\d+)\s*[x×✕✖]\s*(\d+)",
    r"(\d+)\s*by\s*(\d+)",
    r"width\s*[=:]\s*(\d+).*?height\s*[=:]\s*(\d+)",
    r"(\d+)\s*wide.*?(\d+)\s*(?:tall|high)",
    r"(\d+)\s*columns.*?(\d+)\s*rows",
    r"width.*?(\d+).*?height.*?(\d+)",
    r"(\d+)\s*(?:characters?|symbols?|[a-z]+s?)\s*(?:across|wide).*?(\d+)\s*(?:lines?|rows?|tall|down|high)",
)
_COUNTS = (r"(?:answer|count|total|number)\s*:?\s*(\d+)", r"(?:there are|there's|has)\s*(\d+)", r"(?:=|equals)\s*(\d+)", r"^\s*(\d+)\s*$")
_POS = _end_of_last(("yes", "true", "present", "exists", "there is", "correct"))
_NEG = _end_of_last(("no", "false", "not present", "absent", "doesn't exist", "incorrect", "not", "isn't"))
SHAPES = Composed(
    "ascii_shapes",
    (
        ("", "The shape is made of stars.\n", "I count 3 rows first.\n", "Width: <m> at the top. "),
        (
            "", "It is <n>x<m>", "<n> by <m>", "width = <n>, height = <m>", "<n> wide and <m> tall", "<n> columns, <m> rows", "<n>, <m>",
            "Answer: <n>", "there are <n> stars", "it equals <n>", "  <n>  ", "about 0<n> of 5", "Yes, it is present.", "It is not present",
            "It isn't there, absent", "true", "<n> stars wide and <m> lines down", "the width is <n> and the height <m>",
        ),
        ("", "\nCorrect.", "\nNo more.", "\n", " 7"),
    ),
    {
        "dimensions": [
            ("dimensions_wxh", f"coalesce({', '.join(map(_sized, _SIZES))})"),
            ("dimensions_fallback", bind(every("[0-9]+"), lambda v: f"CASE WHEN len({v}) = 2 THEN array_to_string({v}, 'x') END")),
        ],
        "count": [
            ("count_keywords", f"CAST(CAST(coalesce({', '.join(last(p, 1, 'low') for p in _COUNTS)}) AS BIGINT) AS VARCHAR)"),
            ("count_fallback", f"CAST(CAST({last('[0-9]+', 0)} AS BIGINT) AS VARCHAR)"),
        ],
        "position": [("position_boolean", f"CASE WHEN {_POS} >= 0 OR {_NEG} >= 0 THEN CASE WHEN {_POS} > {_NEG} THEN 'true' ELSE 'false' END END")],
    },
    {"n": N, "m": M},
    {"question_type": choice("(l_orderkey + l_suppkey)", ("dimensions", "count", "position"))},
    kind="question_type",
)


# --------------------------------------------------------------------------- places

_PLACES = ("counter", "table", "shelf")
_FOLDED = vocab.inverted(rules.FOLDED_LOCATIONS)
_WORD = r"(?:the )?(\w+)"


def folded(x: str) -> str:
    return bind(f"regexp_replace(regexp_replace({strip(f'lower({x})')}, '\\.$', ''), '^the\\s+', '')", lambda v: f"coalesce({named(v, _FOLDED)}, {v})")


def _no_stop(x: str) -> str:
    return bind(x, lambda v: f"CASE WHEN NOT {one_of(v, rules.STOP_WORDS)} THEN {v} END")


def _tokens(t: str, blank: str) -> str:
    return those(f"string_split_regex(lower(regexp_replace({t}, '[^\\w\\s]', '{blank}', 'g')), '\\s+')", lambda w: f"{w} <> ''")


def _telling(tokens: str, longer: int) -> str:
    return those(tokens, lambda w: f"NOT {one_of(w, rules.STOP_WORDS)} AND length({w}) > {longer}")


def _around(before: str) -> str:
    return f"list_last(regexp_extract_all(lowkept, lower(object) || {quoted(' ' + before)}, 1))"


def _known(b: str) -> str:
    places = f"[{', '.join(map(quoted, _PLACES))}]"
    fold = folded(b)
    return f"coalesce(list_first({those(places, lambda k: f'contains({b}, {k})')}), CASE WHEN {one_of(fold, _PLACES)} THEN {fold} END)"


_NAMED = r"\b(counter|table|shelf)\b"
PLACES = Composed(
    "object_tracking",
    (
        ("", "We start at the fridge. ", "The <o> fell early.\n", "**Thinking**\n"),
        (
            "", "Counter.", "<l>", "The answer is: <l> area", "It's on the <l>", "currently on the kitchen", "Keys sat **<l>** near **table** ok",
            "The <o> is on the <l>.", "The <o> remains on <l> and stays", "<o> would be at the worktop now", "It landed near the countertop",
            "found on a desk", "nothing known moves", "The <o> rests on the ground.", "in the <l>",
        ),
        ("", "\nLet me check: table table", " Then all is done", "\nstill in <l>", "."),
    ),
    [
        (
            "single_word",
            folded(
                bind(
                    _tokens("t", ""),
                    lambda ws: f"CASE WHEN len({_telling(ws, 1)}) = 1 THEN {_telling(ws, 1)}[1] WHEN len({ws}) = 1 THEN {ws}[1] END",
                )
            ),
        ),
        (
            "answer_prefix",
            folded(
                "coalesce("
                + ", ".join(
                    _no_stop(last(p, 1, "low"))
                    for p in (
                        r"(?:answer|location|place)[:\s]+(\w+)",
                        r"the answer is[:\s]+(\w+)",
                        r"(?:it's|it is|that's|that is) (?:on|in|at) " + _WORD,
                        r"(?:still|now|currently) (?:on|in|at) " + _WORD,
                        r"^(?:on|in|at) " + _WORD,
                    )
                )
                + ")"
            ),
        ),
        ("bold_keyword", folded(f"list_first({present(each(each(every(r'\*\*([^*]{1,40})\*\*', 1), lambda b: strip(f'lower({b})')), _known))})")),
        ("first_sentence_location", folded(first(_NAMED, 1, r"lower(regexp_extract(kept, '^([^\n.]+[.]?)', 1))"))),
        (
            "sentence_pattern",
            folded(
                "coalesce("
                + ", ".join(
                    _no_stop(x)
                    for x in (
                        _around("is (?:on|in|at|sitting on) " + _WORD),
                        _around("(?:remains|stayed|fell|dropped) (?:on|onto|to|at) " + _WORD),
                        _around("(?:would be|will be|should be|must be) (?:on|in|at) " + _WORD),
                        _around("(?:ended up|landed|rests) (?:on|in|at) " + _WORD),
                        last("(?:located|found|resting|sitting) (?:on|in|at) " + _WORD, 1, "lowkept"),
                        last("is (?:on|in|at) " + _WORD + r"(?:\.|$)", 1, "lowkept"),
                    )
                )
                + ")"
            ),
        ),
        ("location_keyword", folded(f"coalesce({last(_NAMED, 1, 'lowkept')}, {last(r'\b(' + '|'.join(sorted(_FOLDED, key=len, reverse=True)) + r')\b', 1, 'lowkept')})")),
        ("last_word", folded(bind(_tokens("kept", " "), lambda ws: f"coalesce(list_last({_telling(ws, 2)}), list_last({ws}))"))),
    ],
    {"l": choice("l_partkey", ("counter", "shelf", "Table", "worktop", "microwave")), "o": choice("l_orderkey", ("grape", "key"))},
    {"object": choice("l_orderkey", ("grape", "key"))},
    {"locations": _PLACES},
)


# --------------------------------------------------------------------------- containers

_SYNONYMS = [v for vs in vocab.CONTAINER_SYNONYMS.values() for v in vs]
_A, _B = "container_a", "container_b"


def spelled(x: str) -> str:
    whole = lambda v, c: f"regexp_matches({v}, '\\b' || lower({c}) || '\\b')"
    bare = f"regexp_replace({strip(f'lower({x})')}, '^(?:(?:the|a|an|in|at)\\s+)+', '')"
    return bind(bare, lambda v: f"CASE WHEN {whole(v, _A)} THEN {_A} WHEN {whole(v, _B)} THEN {_B} WHEN {one_of(v, _SYNONYMS)} THEN {v} END")


def _either(x: str) -> str:
    return bind(x, lambda v: f"CASE {v} WHEN lower({_A}) THEN {_A} WHEN lower({_B}) THEN {_B} END")


def _mentions(c: str) -> str:
    near = [("look in the ", ""), ("look for.*in.*", ""), ("search.*", ""), ("answer.*", ""), ("in the ", ""), ("the ", "\\."), ("\\*\\*", "\\*\\*")]
    extra = " + ".join(f"CASE WHEN regexp_matches(lowkept, '{a}' || lower({c}) || '{b}') THEN 2 ELSE 0 END" for a, b in near)
    return f"(len(regexp_extract_all(lowkept, lower({c}))) + {extra})"


def _article(s: str, c: str) -> str:
    return f"regexp_matches({s}, 'the\\s+\\*?\\*?' || lower({c}) || '\\b')"


_LOOKS = (
    r"will\s+(?:naturally\s+)?look\s+(?:for\s+(?:the\s+\w+\s+)?)?in\s+the\s+(\w+)",
    r"will\s+(?:naturally\s+)?look\s+for\s+(?:his|her|the|their)\s+\w+\s+in\s+(?:the\s+)?(\w+)",
    r"will\s+search\s+(?:for\s+(?:the\s+\w+\s+)?)?in\s+the\s+(\w+)",
    r"will\s+(?:check|search)\s+the\s+(\w+)",
    r"(?:look|search)\s+in\s+the\s+(\w+)",
)
_SPLIT = "string_split_regex(lowkept, '[.!?\\n]+')"
_SENTENCE = each(_SPLIT, lambda s: f"CASE WHEN {_article(s, _A)} THEN {_A} WHEN {_article(s, _B)} THEN {_B} END")
CONTAINERS = Composed(
    "sally_anne",
    (
        ("", "Anne moved it to the <b>. ", "Sally left. The <a> stays.\n", "**Reasoning:** long words stand here\n"),
        (
            "", "\\boxed{\\text{<a>}}", "\\boxed{the <b>}", "She picks **the <a>**", "**Answer**: the <b>", 'The answer is "<a>"',
            "Sally will look for the marble in the <a>", "Sally will search the <b>", "She will look for her ball in <a>", "They go for the <b>!",
            '{"location": "<a>"}', "<a> or <b>", "**hamper**", "look in a <b>", "nobody knows", "so she searches a <b>, her <b>",
        ),
        ("", "\nNot the <b>.", "\nLet me check: <a>", "\nSo it ends"),
    ),
    [
        ("boxed_text", spelled(last(r"\\boxed\{\\text\{([^}]+)\}\}"))),
        ("boxed", spelled(last(BOXED))),
        ("bold_markdown", spelled(f"list_last({those(each(every(BOLD, 1), strip), lambda b: f'''len(string_split_regex({b}, '\\s+')) <= 3''')})")),
        (
            "answer_pattern",
            f"""coalesce({spelled(last(r'\*?\*?answer\*?\*?\s*:\s*(?:the\s+)?(\w+)', 1, 'low'))},
              {spelled(last(r'''answer\s+is\s+(?:the\s+)?["']?(\w+)''', 1, 'low'))})""",
        ),
        ("look_pattern", f"coalesce({', '.join(_either(last(p, 1, 'low')) for p in _LOOKS)})"),
        ("last_sentence", f"list_last({present(_SENTENCE)})"),
        ("json", spelled(first(r'(?i)\{[^}]*"(?:answer|location|container)"\s*:\s*"([^"]+)"[^}]*\}'))),
        ("direct_match", f"CASE WHEN {_mentions(_A)} > 0 AND {_mentions(_A)} >= {_mentions(_B)} THEN {_A} WHEN {_mentions(_B)} > 0 THEN {_B} END"),
    ],
    {"a": choice("l_orderkey", ("basket", "Drawer")), "b": choice("l_suppkey", ("box", "Bag"))},
    {_A: choice("l_orderkey", ("basket", "Drawer")), _B: choice("l_suppkey", ("box", "Bag"))},
    failed="fallback",
    blank="none",
)


# --------------------------------------------------------------------------- decoded texts

_QUOTES = quoted("\"'`")
_REFUSED = f"CASE WHEN {has('(?i)' + '|'.join(f'(?:{p})' for p in rules.DECODE_REFUSALS))} THEN '__REFUSAL__' END"


def _filled(x: str) -> str:
    return f"nullif({strip(x)}, '')"


def _unquoted(x: str) -> str:
    return f"nullif(trim({strip(x)}, {_QUOTES}), '')"


def _letters(x: str) -> str:
    return bind(x, lambda v: f"CASE WHEN regexp_full_match({v}, '\\p{{L}}+') THEN lower({v}) END")


_HEADED = (
    r"(?i)(?:\*\*|#{1,3}\s*)(?:decoded\s+(?:message|text)|plaintext|the\s+message|answer|result|output)"
    r"\s*(?:\([^)]*\)\s*:?)?\s*\*?\*?\s*\n+\s*(.+)"
)
DECODED = Composed(
    "encoding_cipher",
    (
        ("", "Working on it.\n", "I rotate by <m>: \n", "Here it is, as an AI model I cannot know all. ", "12 "),
        (
            "", "```\n<w> two\n```", "`<w>`", 'It says "<w> me"', "the text 'to <w>' ok", "Decoded message: <w> now", 'Answer = "<w>"',
            "## Result\n<w> at dawn", "<w>", "'<w>'", "the word is: <w>", "It was **<w>** here 1", "potentially harmful", "I refuse to do it", "34",
            "**Decoded text**\n\n'<w> up'",
        ),
        ("", "\nEnd", "\n", " 9", "\n5"),
    ),
    {
        "decode_only": [
            ("refusal_detected", _REFUSED),
            ("code_block", _filled(last(r"(?s)```[^\n]*\n(.*?)```"))),
            ("code_block", _filled(last(r"`([^`]+)`"))),
            ("quoted_text", _filled(last(r'"([^"]{2,})"'))),
            ("quoted_text", _filled(last(r"'([^']{2,})'"))),
            ("labelled_answer", _unquoted(last(r"(?i)(?:decoded\s+(?:message|text)|plaintext|the\s+message\s+(?:says|reads|is))\s*[:=]\s*(.+)"))),
            ("labelled_answer", _unquoted(last(r"(?i)(?:answer|result|output)\s*[:=]\s*(.+)"))),
            ("labelled_answer", _unquoted(last(_HEADED))),
            ("full_response", bind(strip("t"), lambda s: f"CASE WHEN length({s}) <= 500 AND NOT contains({s}, chr(10)) THEN {_unquoted(s)} END")),
        ],
        "decode_and_act": [
            ("refusal_detected", _REFUSED),
            ("single_word", _letters(strip(f"trim({strip('t')}, {_QUOTES})"))),
            ("labelled_word", _letters(last(r"""(?i)(?:answer|the\s+word\s+is|response)\s*[:=]\s*["']?(\w+)"""))),
            ("quoted_word", _letters(last(r"""["'](\w+)["']"""))),
            ("bold_word", _letters(last(r"\*\*(\w+)\*\*"))),
            ("last_alpha_token", f"lower({last(r'\b([a-zA-Z]{2,})\b')})"),
        ],
    },
    {"m": M, "w": choice("l_orderkey", ("Apple", "river", "north4", "Stone"))},
    {"task_mode": choice("(l_orderkey + l_suppkey)", ("decode_only", "decode_and_act"))},
    kind="task_mode",
)


# --------------------------------------------------------------------------- recommendations


def _any(patterns: Sequence[str], x: str) -> str:
    return has("(?i)" + "|".join(f"(?:{p})" for p in patterns), x)


def starts(x: str, pattern: str) -> str:
    """Offsets of all matches, from the lengths of what lies between and in them."""
    found, gaps = every(pattern, 0, x), f"string_split_regex({x}, {quoted(pattern)})"
    total = lambda xs: f"coalesce(list_sum({each(xs, lambda s: f'length({s})')}), 0)"
    return bind(
        found,
        lambda f: bind(
            gaps, lambda g: each(f"range(1, len({f}) + 1)", lambda i: f"CAST({total(f'list_slice({g}, 1, {i})')} + {total(f'list_slice({f}, 1, {i} - 1)')} AS BIGINT)")
        ),
    )


def _if_only(x: str, at: str) -> str:
    around = f"substr({x}, greatest({at} - 120, 0) + 1, {at} + 80 - greatest({at} - 120, 0))"
    conditions = (rules.CONDITION_BEFORE_WALK, rules.WALK_WITH_CONDITION, rules.WALK_DISMISSED)
    return bind(around, lambda v: "(" + " OR ".join(has(p, v) for p in conditions) + ")")


def drive_or_walk(x: str) -> str:
    def later(v: str) -> str:
        walks = those(f"flatten([{', '.join(starts(v, p) for p in rules.WALK)}])", lambda at: f"NOT {_if_only(v, at)}")
        drives = f"flatten([{', '.join(starts(v, p) for p in rules.DRIVE)}])"
        return f"CASE WHEN coalesce(list_max({drives}), -1) > coalesce(list_max({walks}), -1) THEN 'drive' ELSE 'walk' END"

    def said(v: str) -> str:
        drives = f"({_any(rules.DRIVE, v)} AND NOT {has(rules.DRIVE_TAKEN_BACK, v)})"
        walks = f"({_any(rules.WALK, v)} AND NOT {has(rules.WALK_TAKEN_BACK, v)})"
        return f"CASE WHEN {drives} AND NOT {walks} THEN 'drive' WHEN {walks} AND NOT {drives} THEN 'walk' WHEN {drives} AND {walks} THEN {later(v)} END"

    return bind(f"lower({x})", said)


def _firm_bold() -> str:
    pattern = r"\*\*([^*]{1,50})\*\*"
    firm = lambda said, at: bind(drive_or_walk(said), lambda r: f"CASE WHEN NOT ({r} = 'walk' AND {_if_only('low', at)}) THEN {r} END")
    both = bind(
        every(pattern, 1),
        lambda b: bind(starts("t", pattern), lambda s: each(f"range(1, len({b}) + 1)", lambda i: firm(f"list_extract({b}, {i})", f"list_extract({s}, {i})"))),
    )
    return f"list_last({present(both)})"


CARWASH = Composed(
    "carwash",
    (
        ("", "It is only 50 m away.\n", "Drive. It is a car wash. ", "You could walk if you want, but think. ", "Walking back is silly. "),
        (
            "", "\\boxed{walk}", "so **drive** it there", "**Walk** instead", "Recommendation: take your car", "You should walk there", "definitely drive",
            "the car will need it to be there", "go on foot", "you do not walk to it", "don't drive", "However, if you like, walk it", "a stroll is fine",
            "**walk** and **drive**",
        ),
        ("", "\nWalking won't wash it.", "\nOnly walk if it rains. Drive else.", "\nHello there.", "\nthe only reason to go on foot is sport"),
    ),
    [
        ("boxed", drive_or_walk(last(BOXED))),
        ("bold", _firm_bold()),
        ("first_sentence", start_of(120, drive_or_walk)),
        ("label_line", drive_or_walk(last(r"(?i)(?:answer|recommendation|decision|verdict|conclusion|my\s+(?:advice|recommendation))\s*[:：]\s*([^\n.]{1,120})"))),
        (
            "strong_intro",
            drive_or_walk(
                last(
                    r"(?i)(?:you\s+should|i\s+(?:would|recommend|suggest)|definitely|clearly|obviously|"
                    r"the\s+(?:answer|best\s+option|right\s+choice)\s+is|go\s+(?:ahead\s+and)?)\s+([^\n.]{1,80})",
                    0,
                )
            ),
        ),
        ("full_text", drive_or_walk("t")),
        ("last_sentences", f"list_last({present(each(sentences('t'), drive_or_walk))})"),
    ],
    failed="fallback",
    fallback="other",
)


def flip_or_not(x: str) -> str:
    return bind(x, lambda v: f"CASE WHEN {_any(rules.FLIP, v)} THEN 'flip' WHEN {_any(rules.NOT_FLIP, v)} THEN 'wrong' END")


CUPS = Composed(
    "inverted_cup",
    (
        ("", "The cup is upside down.\n", "Drill a hole? ", "You could throw it away. "),
        (
            "", "\\boxed{flip it}", "**turn it over**", "Solution: cut a hole in the base", "You should drill a hole... or simply flip it over",
            "just return it to the shop", "the opening should face up", "**saw it**", "place it right side up", "Nothing helps", "rotate the cup 180",
            "It cannot be used", "Answer: tilt the cup",
        ),
        ("", "\nThat is all.", "\nDone. Discard it.", "\nInvert it"),
    ),
    [
        ("boxed", flip_or_not(last(BOXED))),
        ("bold", flip_or_not(last(r"\*\*([^*]{1,80})\*\*"))),
        ("label_line", flip_or_not(last(r"(?i)(?:answer|action|solution|recommendation|suggestion|step\s+1|first(?:ly)?)\s*[:：]\s*([^\n.]{1,150})"))),
        (
            "strong_recommendation",
            flip_or_not(
                last(
                    r"(?i)(?:you\s+(?:should|need\s+to|just\s+need\s+to|can)|simply|just|"
                    r"all\s+you\s+(?:need\s+to\s+do|have\s+to\s+do)(?:\s+is)?|the\s+(?:solution|answer|fix)\s+is\s+to)\s+([^\n.]{1,100})",
                    0,
                )
            ),
        ),
        ("full_text", flip_or_not("t")),
        ("last_sentences", f"list_last({present(each(sentences('t'), flip_or_not))})"),
    ],
    failed="fallback",
    fallback="wrong",
)


# --------------------------------------------------------------------------- times

_C12, _C24 = rules.CLOCK_12, rules.CLOCK_24
_TWELVE = "time_format = '12h'"


def clock(x: str) -> str:
    part = lambda v, p, g: f"TRY_CAST(regexp_extract({v}, {quoted(p)}, {g}) AS INT)"

    def read(v: str) -> str:
        h, m, h24, m24 = part(v, _C12, 1), part(v, _C12, 2), part(v, _C24, 1), part(v, _C24, 2)
        half = f"upper(replace(regexp_extract({v}, {quoted(_C12)}, 3), '.', ''))"
        on_twelve = f"printf('%d:%02d %s', CASE WHEN {h24} % 12 = 0 THEN 12 ELSE {h24} % 12 END, {m24}, CASE WHEN {h24} < 12 THEN 'AM' ELSE 'PM' END)"
        return f"""CASE WHEN {has(_C12, v)} THEN CASE WHEN {h} BETWEEN 1 AND 12 AND {m} BETWEEN 0 AND 59 THEN printf('%d:%02d %s', {h}, {m}, {half}) END
          WHEN {h24} BETWEEN 0 AND 23 AND {m24} BETWEEN 0 AND 59 THEN CASE WHEN {_TWELVE} THEN {on_twelve} ELSE printf('%02d:%02d', {h24}, {m24}) END END"""

    return bind(x, read)


_NOT_REAL = ("impossible", "doesn't exist", "invalid")
_DENIALS = ("impossible", "invalid", "doesn't", "does not")


def _impossible(x: str) -> str:
    return f"CASE WHEN {contains_any(f'lower({x})', _NOT_REAL)} THEN 'impossible' END"


_DAYS = vocab.inverted(vocab.DAY_NAMES)


def _days(x: str) -> str:
    return present(each(f"string_split_regex({strip(x)}, '[\\s,.:;]+')", lambda w: named(f"lower({w})", _DAYS)))


def minutes(x: str) -> str:
    part = lambda v, p, g: f"TRY_CAST(regexp_extract({v}, {quoted(p)}, {g}) AS BIGINT)"
    both = lambda v: f"{part(v, rules.HOURS_MINUTES, 1)} * 60 + {part(v, rules.HOURS_MINUTES, 2)}"
    return bind(x, lambda v: f"CAST(coalesce({both(v)}, {part(v, rules.MINUTES, 1)}, {part(v, rules.HOURS, 1)} * 60) AS VARCHAR)")


def _plain_minutes(x: str) -> str:
    return bind(f"TRY_CAST({x} AS BIGINT)", lambda v: f"CASE WHEN {v} BETWEEN 1 AND 1440 THEN CAST({v} AS VARCHAR) END")


def duration(x: str) -> str:
    return bind(x, lambda v: f"coalesce({minutes(first(rules.DURATION, 0, v))}, {_plain_minutes(first(r'\b([0-9]{1,5})\b', 1, v))})")


def valid(x: str) -> str:
    no = lambda v: f"({has(r'\bno\b', v)} OR {contains_any(v, _DENIALS)})"
    yes = lambda v: f"({has(r'\byes\b', v)} OR {contains_any(v, ('valid', 'exists'))})"
    return bind(f"lower({x})", lambda v: f"CASE WHEN {no(v)} THEN 'impossible' WHEN {yes(v)} THEN 'valid' END")


_FINAL, _LABEL = last(rules.FINAL_LABEL, 1, "kept"), last(rules.TIME_LABEL, 1, "kept")
_CONTENT = strip(last(r"(?i)(?:final\s+answer|answer|result)\s*[:=]\s*(?:\*{0,2})\s*\n*\s*(.+)"))
_SAID = first(r"(?i)^(?:\s*(?:#{1,3}\s*)?(?:\*\*)?)\s*(yes|no)\b")
TIMES = Composed(
    "time_arithmetic",
    (
        ("", "Start at 2:05 PM. ", "3 days before Friday.\n", "No. ", "It takes a while.\n", "**Yes** "),
        (
            "", "\\boxed{4:30 pm}", "**14:05**", "Final answer: <h>:<mm> PM", "Final answer: impossible", "from 10:00 to <h>:15", "The time is: <h>:45 a.m.",
            "**Friday is Tuesday**", "Es ist Mittwoch", "Answer: <d>", "It takes 1 hour and <n> minutes", "**<n> min**", "Duration: 2 hours", "about <n>",
            "This date does not exist.", "it is a valid date", "Result: no", "\\boxed{<d>}", "**it is real**", "25:61",
        ),
        ("", "\nLet me check: 9:00 AM Monday 5 minutes", "\nOk.", "\nIt was so", "\nMon, then <d>"),
    ),
    {
        "result_time": [
            ("boxed", clock(last(BOXED))),
            ("bold", clock(last(BOLD))),
            ("label_refusal", _impossible(_FINAL)),
            ("final_answer_label", clock(_FINAL)),
            ("time_pattern_12h", f"CASE WHEN {_TWELVE} THEN {clock(last(_C12, 0, 'kept'))} END"),
            ("time_pattern_24h", clock(last(_C24, 0, "kept"))),
            ("label_refusal", _impossible(_LABEL)),
            ("label_line", clock(_LABEL)),
        ],
        "duration": [
            ("boxed", duration(last(BOXED))),
            ("bold", duration(last(BOLD))),
            ("label_line", duration(last(rules.TIME_LABEL))),
            ("duration_pattern", minutes(last(rules.DURATION, 0, "kept"))),
            ("last_number", _plain_minutes(last(r"\b([0-9]{1,5})\b", 1, "kept"))),
        ],
        "day": [
            ("boxed", f"list_first({_days(last(BOXED))})"),
            ("bold", f"list_last({_days(last(BOLD))})"),
            ("final_answer_label", f"list_last({_days(_FINAL)})"),
            ("label_line", f"list_last({_days(_LABEL)})"),
            ("day_pattern", named(f"lower({last(r'(?i)\b(' + '|'.join(sorted(_DAYS, key=len, reverse=True)) + r')\b', 1, 'kept')})", _DAYS)),
        ],
        "date_validity": [
            ("first_yes_no", f"CASE lower({_SAID}) WHEN 'no' THEN 'impossible' WHEN 'yes' THEN 'valid' END"),
            ("label_yes_no", bind(_CONTENT, lambda c: f"CASE WHEN length({c}) < 80 THEN {valid(c)} END")),
            ("boxed", valid(last(BOXED))),
            ("bold", valid(first(BOLD))),
            ("refusal_keyword", f"CASE WHEN {contains_any('low', rules.IMPOSSIBLE_PHRASES)} THEN 'impossible' END"),
            ("validity_keyword", f"CASE WHEN {contains_any('low', rules.VALID_PHRASES)} THEN 'valid' END"),
        ],
    },
    {
        "n": N,
        "h": "CAST(1 + l_linenumber AS STRING)",
        "mm": choice("l_partkey", ("05", "30", "59")),
        "d": choice("l_orderkey", ("Mon", "viernes", "Sunday", "later")),
    },
    {
        "question_mode": choice("(l_orderkey + l_suppkey)", ("result_time", "duration", "day", "date_validity")),
        "time_format": choice("l_partkey", ("12h", "24h")),
    },
    kind="question_mode",
    failed="none",
)

CASCADES = {c.task: c for c in (LETTERS, TABLES, SYMBOLS, SHAPES, PLACES, CONTAINERS, DECODED, CARWASH, CUPS, TIMES)}


def rows_of(spark, sf: str) -> DataFrame:
    return spread(table(spark, sf, "lineitem").select(*ROW_KEY, "l_quantity"))


def _register(case: Composed) -> None:
    @query(f"extract_{case.task}", case.sql())
    def _(spark, sf):
        columns = case.columns()
        rows = rows_of(spark, sf).withColumns({"raw_response": case.text(), **columns})
        out = extract(rows, case.task, "raw_response", {n: F.col(n) for n in columns})
        return out.select(*ROW_KEY, "answer.value", "answer.strategy")


for _case in CASCADES.values():
    _register(_case)


_TURN = "(l_orderkey + l_partkey + l_linenumber)"
_TURNS = [f"{_TURN} % {len(CASCADES)} = {i}" for i in range(len(CASCADES))]
_ALL_SQL = " UNION ALL ".join(f"SELECT '{c.task}' AS task, * FROM ({c.sql(where)})" for c, where in zip(CASCADES.values(), _TURNS))


@query("extract_all_tasks", _ALL_SQL)
def _(spark, sf):
    """All tasks in one pass: rows of ten tasks in turn, each with its own text and parameters, rules of all eighteen in the plan."""
    text = None
    for case, where in zip(CASCADES.values(), _TURNS):
        turn = F.expr(where)
        text = F.when(turn, case.text()) if text is None else text.when(turn, case.text())
    # on a variable, which keeps this step out of the one generated method of its stage: with the texts of all
    # tasks that would be too long to be compiled
    task = let(F.expr(f"{_TURN} % {len(CASCADES)}"), lambda turn: F.coalesce(*[F.when(turn == i, name) for i, name in enumerate(CASCADES)]))
    params = {n: c for case in CASCADES.values() for n, c in case.columns().items()}
    rows = rows_of(spark, sf).withColumns({"raw_response": text, "task": task, **params})
    out = extract_by_task(rows, "task", "raw_response", {n: F.col(n) for n in params})
    return out.select("task", *ROW_KEY, "answer.value", "answer.strategy")
