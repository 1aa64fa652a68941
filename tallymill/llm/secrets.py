"""Secret scan: three fixed patterns, and a battery of randomness tests for other tokens; native columns only.

For each long token an encoding is inferred from its characters (decimal, hex, base32, base64).  Three
tests ask whether its symbols could be uniform and independent: chi-squared of the symbol counts, runs
above and below the middle of the alphabet, and serial correlation; the least p-value, times three, is
the token's score.  A token counts as a secret only above a score at which, for its length, ordinary
text would seldom pass: that threshold comes from the corpus itself, by false-discovery control against
decoys, which are words of ordinary text run together.  Counts of scores per length are the only thing
that is aggregated; they are a few hundred rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.llm.spans import cut, empty, joined, let, matches, named

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
#: Tokens that the tests look at. They begin where a run of their characters does, so shorter runs are tried once.
TOKEN_START = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20}"
TOKEN = TOKEN_START + r"[A-Za-z0-9+/_-]*+={0,2}"
#: Ordinary words in a row; without their blanks they are a decoy.
WORDS = r"(?<![A-Za-z])[a-z]{2,14}+(?: [a-z]{2,14}+){4,11}+"
KINDS = ("assign", "access", "hex", "random")

DIGITS = "0123456789"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS = UPPER.lower()
ALPHABETS = (
    (r"^[0-9]+$", DIGITS),
    (r"^[0-9a-f]+$", DIGITS + "abcdef"),
    (r"^[0-9A-F]+$", DIGITS + "ABCDEF"),
    (r"^[A-Z2-7]+$", UPPER + "234567"),
    (r"", UPPER + LETTERS + DIGITS + "+/"),
)
#: Lengths from which tokens are judged together: thresholds are learned for each.
LENGTHS = (20, 32, 48, 96)
BINS = 20


def tail(z: Column) -> Column:
    """Chance that a standard normal exceeds z >= 0 on one side (Abramowitz and Stegun 7.1.26 for erf)."""
    x = z / 2**0.5
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.greatest(0.5 * poly * F.exp(-x * x), F.lit(0.0))


def upper_tail(z: Column) -> Column:
    return F.when(z >= 0, tail(F.abs(z))).otherwise(1.0 - tail(F.abs(z)))


def _occurrences(v: Column, c: Column) -> Column:
    """How often a symbol stands in a text: what the text loses without it."""
    return (F.length(v) - F.length(F.replace(v, c, F.lit("")))).cast("double")


def _chi_tail(n: Column, squares: Column, k: float) -> Column:
    """Chance of a chi-squared as large as that of n symbols of k with this sum of squared counts (Wilson and Hilferty)."""
    chi = F.greatest(squares * k / n - n, F.lit(0.0))
    spread = 2.0 / (9.0 * (k - 1.0))
    return let((F.pow(chi / (k - 1.0), F.lit(1 / 3)) - (1.0 - spread)) / spread**0.5, upper_tail)


def _uniform(v: Column, k: float) -> Column:
    """Chi-squared of the symbol counts against equal shares."""
    counts = F.transform(F.array_distinct(F.filter(F.split(v, ""), lambda c: c != "")), lambda c: _occurrences(v, c))
    return _chi_tail(F.length(v).cast("double"), F.aggregate(counts, F.lit(0.0), lambda t, c: t + c * c), k)


def _runs(v: Column, high: str) -> Column:
    """Runs of symbols of the upper and the lower half of the alphabet, counted as matches of the two classes."""
    halves = F.struct(
        F.length(v).cast("double").alias("n"),
        (F.length(v) - F.length(F.regexp_replace(v, f"[{high}]+", ""))).cast("double").alias("high"),
        (F.regexp_count(v, F.lit(f"[{high}]+")) + F.regexp_count(v, F.lit(f"[^{high}]+"))).cast("double").alias("runs"),
    )

    def p(s: Column) -> Column:
        both = 2.0 * s.high * (s.n - s.high)
        wide = F.sqrt(F.greatest(both * (both - s.n) / (s.n * s.n * (s.n - 1.0)), F.lit(0.0)))
        return F.when(wide > 0, 2.0 * tail(F.abs(s.runs - both / s.n - 1.0) / wide)).otherwise(0.0)

    return let(halves, p)


def _serial(v: Column, alphabet: str) -> Column:
    """Correlation of each symbol's number with the next one's, the first following the last."""

    def p(x: Column) -> Column:
        n = F.size(x).cast("double")
        add = lambda values: F.aggregate(values, F.lit(0.0), lambda a, y: a + y)
        sums = F.struct(add(x).alias("sum"), add(F.transform(x, lambda y: y * y)).alias("squares"), add(F.transform(x, lambda y, i: y * F.get(x, F.pmod(i + 1, F.size(x))))).alias("around"))

        def of(s: Column) -> Column:
            variance = n * s.squares - s["sum"] * s["sum"]
            serial = (n * s.around - s["sum"] * s["sum"]) / F.when(variance > 0, variance)
            return F.coalesce(2.0 * tail(F.abs(serial + 1.0 / (n - 1.0)) * (n - 1.0) * F.sqrt(n - 2.0) / n), F.lit(0.0))

        return let(sums, of)

    return let(F.transform(F.filter(F.split(v, ""), lambda c: c != ""), lambda c: (F.position(c, F.lit(alphabet)) - 1).cast("double")), p)


def battery(token: Column) -> Column:
    """Score of a token in [0, 1]: small where uniform independent symbols are implausible.

    The score is three times the least of three p-values.  Tests are made in turn: once one gives less than
    the lowest threshold there can be (one bin), the token can no longer pass, and what stands is its score.
    """

    def tested(v: Column, alphabet: str) -> Column:
        high = alphabet[(len(alphabet) + 1) // 2 :]
        below = lambda p: 3.0 * p < 1.0 / BINS
        rest = lambda u: let(
            F.least(u, _runs(v, high)), lambda r: F.when(below(r), 3.0 * r).otherwise(F.least(F.lit(1.0), 3.0 * F.least(r, _serial(v, alphabet))))
        )
        return let(_uniform(v, float(len(alphabet))), lambda u: F.when(below(u), 3.0 * u).otherwise(rest(u)))

    return let(F.translate(token, "-_=", "+/"), lambda v: F.coalesce(*(F.when(F.rlike(v, F.lit(p)), tested(v, a)) for p, a in ALPHABETS)))


def length_class(n: Column) -> Column:
    return sum((F.when(n >= least, 1).otherwise(0) for least in LENGTHS), F.lit(-1))


def base_spans(text: Column) -> Column:
    """Struct of the spans of the three fixed patterns, in text order each."""
    gated = lambda gate, spans: F.when(F.rlike(text, F.lit(gate)), spans).otherwise(empty())
    assign = F.filter(matches(text, F.lit(ASSIGN), 1), lambda s: F.length(s.value) >= 12)
    access = F.filter(matches(text, F.lit(ACCESS)), lambda s: F.length(s.value) >= 18)
    return F.struct(
        gated(r"(?i:passw|secret|token|api_?key)", assign).alias("assign"),
        gated("AKIA", access).alias("access"),
        gated("[0-9a-f]{16}", matches(text, F.lit(HEX))).alias("hex"),
    )


def _rows(docs: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    return docs.select(*(docs[c] for c in keep), F.coalesce(docs[text], F.lit("")).alias("_text"))


def _tokens(text: Column) -> Column:
    """Tokens with their score and length class."""
    scored = F.transform(
        matches(text, F.lit(TOKEN)),
        lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), length_class(F.length(s.value)).alias("length"), battery(s.value).alias("score")),
    )
    return F.when(F.rlike(text, F.lit(TOKEN_START)), scored).otherwise(F.array().cast("array<struct<start:int,end:int,length:int,score:double>>"))


def thresholds(docs: DataFrame, *, text: str = "text", rate: float = 0.02) -> list[float]:
    """Per length class the least score at which the estimated false-discovery rate is at most ``rate``.

    Every run of ordinary words in a text is a decoy and stands for ordinary text.  Above a score, the share
    of decoys times the number of tokens, over the tokens found there, is the rate.  A length class
    without decoys takes the next shorter one's threshold; without any the middle of the scores.
    All rows are counted; what reaches the driver is a count per class, kind and bin.
    """
    body = F.col("_text")
    marked = lambda values, decoy: F.transform(values, lambda v: F.struct(v.alias("v"), F.lit(decoy).alias("decoy")))
    runs = F.transform(F.regexp_extract_all(body, F.lit(WORDS), F.lit(0)), lambda w: F.replace(w, F.lit(" "), F.lit("")))
    both = F.concat(marked(F.regexp_extract_all(body, F.lit(TOKEN), F.lit(0)), False), marked(runs, True))
    rows = _rows(docs, text, ()).select(F.explode(both).alias("t")).select("t.v", "t.decoy", F.length("t.v").alias("n")).where(F.col("n") >= LENGTHS[0])
    # A decoy has the letters a to z only, so its symbols are counted one by one in compiled code; hardly any gets beyond the first test.
    letters = sum((F.pow(_occurrences(F.col("v"), F.lit(c)), F.lit(2.0)) for c in LETTERS), F.lit(0.0))
    counted = rows.withColumn("squares", F.when(F.col("decoy") & F.rlike("v", F.lit("[g-z]")), letters))
    first = counted.withColumn("first", 3.0 * _chi_tail(F.col("n").cast("double"), F.col("squares"), float(len(ALPHABETS[-1][1]))))
    score = F.when(F.col("first") < 1.0 / BINS, F.col("first")).otherwise(battery(F.col("v")))
    found = first.select(length_class(F.col("n")).alias("length"), "decoy", score.alias("score"))
    binned = found.groupBy("length", "decoy", F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n")).collect()
    out: list[float] = []
    for length in range(len(LENGTHS)):
        above = lambda decoy, bin_: sum(r.n for r in binned if r.length == length and r.decoy == decoy and r.bin >= bin_)  # noqa: B023, E731
        decoys_n, tokens_n = above(True, 0), above(False, 0)
        passing = [b for b in range(1, BINS) if above(True, b) / max(decoys_n, 1) * tokens_n <= rate * max(above(False, b), 1)]
        learned = min(passing) / BINS if decoys_n and passing else None
        out.append(learned if learned is not None else (out[-1] if out else 0.5))
    return out


def ordered(spans: Column) -> Column:
    """Spans by start, then by kind as listed."""
    rank = lambda kind: F.array_position(F.array(*map(F.lit, KINDS)), kind)
    ranked = F.transform(spans, lambda s: F.struct(s.start.alias("start"), rank(s.kind).alias("rank"), s.end.alias("end"), s.kind.alias("kind")))
    return F.transform(F.array_sort(ranked), lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind")))


def scan(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rate: float = 0.02) -> DataFrame:
    """``keep``, _text, base (spans of the fixed patterns) and random (added spans), as arrays of (start, end, kind).

    Null and empty texts have none.  A random token that lies inside a base span is not added.  Every row
    is answered, repeated rows each; other columns are dropped.
    """
    least = thresholds(docs, text=text, rate=rate)
    body = F.col("_text")
    rows = _rows(docs, text, keep).withColumn("_base", base_spans(body))
    base = ordered(F.concat(*(named(k, F.col(f"_base.{k}")) for k in KINDS[:3])))
    passes = lambda t: t.score >= F.element_at(F.array(*map(F.lit, least)), t.length + 1)
    free = lambda t: ~F.exists(F.col("base"), lambda b: (b.start <= t.start) & (t.end <= b.end))
    return rows.withColumn("base", base).select(
        *keep,
        "_text",
        *(F.size(f"_base.{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        "base",
        named("random", F.filter(_tokens(body), lambda t: passes(t) & free(t))).alias("random"),
    )


def digests(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, n_assign, n_access, n_hex, base_sha256 and spans."""
    return scan(docs, text=text, keep=keep).select(*keep, "n_assign", "n_access", "n_hex", F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(ordered(F.concat("base", "random"))).alias("spans"))


def redact(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), mark: str = "[SECRET]") -> DataFrame:
    """``keep`` and the text with every span replaced by ``mark``; null stays null."""
    marked = scan(docs.withColumn("_null", F.col(text).isNull()), text=text, keep=(*keep, "_null"))
    body = F.when(F.size(F.concat("base", "random")) > 0, cut(F.col("_text"), ordered(F.concat("base", "random")), lambda s: F.lit(mark))).when(~F.col("_null"), F.col("_text"))
    return marked.select(*keep, body.alias(text))
