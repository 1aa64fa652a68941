"""PII: fixed patterns for protected values, and terms that give such a value away; native columns only.

Protected values are e-mail addresses, IP addresses, card and phone numbers.  A term (a word outside
every one of them) discloses a value if seeing the term makes the value likely: over the corpus, the
share of the documents with the term in which that value stands, and how many bits it adds over the
value's own frequency.  Terms beyond both thresholds are generalised like the value itself, at all
their places in every document, whether the value stands there or not.

A document is an id and a text; a repeated row counts once.  Pairs are made only of values that can
still reach the thresholds: those of at least SUPPORT documents and not too many for BITS.  Counts are
partial aggregations over all documents; joins are on the value, the term or the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.llm.spans import cut, empty, joined, let, matches, named
from tallymill.session import scratch_path

#: The local part starts a run of its characters, or where the match before ended: the leftmost start, found without retries.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
KINDS = ("email", "ip", "card", "phone", "term")
GENERAL = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}

LETTER = r"A-Za-z0-9\x{80}-\x{10FFFF}"
TERM = rf"(?<![{LETTER}])[{LETTER}]{{4,}}+(?![{LETTER}])"
#: A term needs so many documents with the value, such a share of its documents, and so many bits.
SUPPORT, SHARE, BITS = 2, 0.5, 3.0


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn check: every second from the right doubled, nine off above nine, sum a multiple of ten."""
    symbols = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    doubled = F.transform(symbols, lambda c, k: let(c.cast("int") * (k % 2 + 1), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def base_spans(text: Column) -> Column:
    """Struct of the spans (start, end, value) of the four patterns that hold, in text order each."""
    gated = lambda gate, spans: F.when(F.rlike(text, F.lit(gate)), spans).otherwise(empty())
    in_range = lambda s: F.rlike(s.value, F.lit(rf"^{PART}(?:\.{PART}){{3}}$"))
    card = lambda s: let(_digits(s.value), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False))
    phone = lambda s: F.length(_digits(s.value)).between(8, 15)
    return F.struct(
        gated("@[A-Za-z0-9-]", matches(text, F.lit(EMAIL))).alias("email"),
        gated(r"[0-9]\.[0-9]", F.filter(matches(text, F.lit(IP)), in_range)).alias("ip"),
        gated(r"[0-9](?:[\x20-]?[0-9]){15}", F.filter(matches(text, F.lit(CARD)), card)).alias("card"),
        gated(r"\+[0-9][\x20().0-9-]", F.filter(matches(text, F.lit(PHONE)), phone)).alias("phone"),
    )


def _values(base: Column) -> Column:
    """The distinct protected values, each with its kind."""
    return F.array_distinct(F.concat(*(F.transform(base[k], lambda s, k=k: F.concat(F.lit(f"{k}:"), F.lower(s.value))) for k in KINDS[:4])))


def _masked(text: Column, base: Column) -> Column:
    """The text with a blank for each code point of the spans ``base`` (sorted by start): places stay, terms touch no value."""
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        first = F.greatest(a.at, s.start)
        blank = F.repeat(F.lit(" "), F.greatest(s.end - first, F.lit(0)))
        return F.struct(F.greatest(a.at, s.end).alias("at"), F.concat(a.out, F.array(F.substring(text, a.at + 1, first - a.at), blank)).alias("out"))

    finish = lambda a: F.concat(F.array_join(a.out, ""), F.substring(text, a.at + 1, F.length(text)))
    return F.when(F.size(base) > 0, F.aggregate(base, state, step, finish)).otherwise(text)


def _terms(masked: Column) -> Column:
    """The distinct terms of a masked text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(masked, F.lit(TERM), F.lit(0)), F.lower))


def _rows(docs: DataFrame, text: str, keep: tuple[str, ...], key: str) -> DataFrame:
    body = F.coalesce(docs[text], F.lit(""))
    return docs.select(*(docs[c] for c in keep), docs[key].alias("_id"), body.alias("_text"))


def _kept(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again: used twice, computed once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _of(left: DataFrame, right: DataFrame) -> Column:
    """Same document: id, null or not, and content; ``right`` has them as _i and _h."""
    return left["_hash"].eqNullSafe(right["_h"]) & left["_id"].eqNullSafe(right["_i"])


def disclosing(found: DataFrame) -> DataFrame:
    """Terms beyond the thresholds for some value.

    ``found`` has _id, _hash, _values and _terms of every row.  All counts are of distinct documents.
    """
    rows, n_docs = found.agg(F.count("*"), F.count_distinct(F.struct("_id", "_hash"))).first()
    terms = found.select("_id", "_hash", F.explode("_terms").alias("term"))
    if n_docs < rows:
        terms = terms.distinct()
    n_terms = terms.groupBy("term").agg(F.count("*").alias("n_term"))
    mentions = found.where(F.size("_values") > 0).select("_id", "_hash", F.explode("_values").alias("value")).distinct()
    n_values = mentions.groupBy("value").agg(F.count("*").alias("n_value"))
    # no term can disclose any other value: its share is at most 1, its documents are at most the value's
    able = _kept(n_values.where((F.col("n_value") >= SUPPORT) & (F.log2(n_docs / F.col("n_value")) >= BITS)), "pii-values")
    bearing = found.where(F.size("_values") > 0).select(F.col("_id").alias("_i"), F.col("_hash").alias("_h"), "_terms").dropDuplicates(["_i", "_h"])
    wanted = mentions.join(able.select("value"), "value")
    pairs = wanted.join(bearing, _of(wanted, bearing)).select("value", F.explode("_terms").alias("term"))
    together = pairs.groupBy("value", "term").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= SUPPORT)
    counted = together.join(n_terms, "term").join(able, "value")
    share = F.col("n_both") / F.col("n_term")
    return counted.where((share >= SHARE) & (F.log2(share * n_docs / F.col("n_value")) >= BITS)).select("term").distinct()


def scan(docs: DataFrame, *, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, _id, _hash, n_email, n_ip, n_card, n_phone, base and added spans as arrays of (start, end, kind).

    Null and empty texts have none.  Every row is answered, repeated rows each; rows without an id are
    told apart by their text.
    """
    rows = _rows(docs, text, keep, key).withColumn("_hash", F.xxhash64("_text")).withColumn("_base", base_spans(F.col("_text")))
    base = F.concat(*(named(k, F.col(f"_base.{k}")) for k in KINDS[:4]))
    masked = rows.withColumn("base", base).withColumn("_masked", _masked(F.col("_text"), F.array_sort("base")))
    values = _values(F.col("_base"))
    found = _kept(
        masked.select(
            *keep,
            "_id",
            "_hash",
            *(F.size(f"_base.{k}").cast("long").alias(f"n_{k}") for k in KINDS[:4]),
            "base",
            values.alias("_values"),
            _terms(F.col("_masked")).alias("_terms"),
        ),
        "pii",
    )
    reveal = _kept(disclosing(found), "pii-terms")
    hits = found.select("_id", "_hash", "base", F.explode("_terms").alias("term")).join(reveal, "term")
    holders = hits.groupBy(F.col("_id").alias("_i"), F.col("_hash").alias("_h")).agg(F.first("base").alias("base"), F.collect_set("term").alias("terms"))
    whole = rows.select("_id", "_hash", "_text")
    held = whole.join(holders, _of(whole, holders))
    places = F.filter(matches(_masked(F.col("_text"), F.array_sort("base")), F.lit(TERM)), lambda t: F.array_contains(F.col("terms"), F.lower(t.value)))
    added = held.select("_i", "_h", named("term", places).alias("added")).dropDuplicates(["_i", "_h"])
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    return found.join(added, _of(found, added), "left").drop("_values", "_terms", "_i", "_h").withColumn("added", F.coalesce("added", none))


def digests(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The id column, n_email, n_ip, n_card, n_phone, base_sha256 and spans."""
    found = scan(docs, text=text, key=key, keep=())
    counts = [f"n_{k}" for k in KINDS[:4]]
    return found.select(F.col("_id").alias(key), *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"))


def sanitise(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The id column and the text with values and disclosing terms generalised to their kind; null stays null.

    Spans come back to the texts by id and content, so a repeated row gets the same text.
    """
    found = scan(docs, text=text, key=key, keep=()).select("_id", "_hash", F.concat("base", "added").alias("spans")).dropDuplicates(["_id", "_hash"])
    ranked = F.array_sort(F.transform("spans", lambda s: F.struct(s.start.alias("start"), (-s.end).alias("stop"), s.end.alias("end"), s.kind.alias("kind"))))
    general = F.create_map(*(F.lit(x) for pair in GENERAL.items() for x in pair))
    rows = docs.select(F.col(key), F.col(text).alias("_text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_h"))
    both = rows.join(found, rows[key].eqNullSafe(found["_id"]) & (rows["_h"] == found["_hash"]), "left")
    body = F.when(F.size("spans") > 0, cut(F.col("_text"), ranked, lambda s: general[s.kind])).otherwise(F.col("_text"))
    return both.select(key, body.alias(text))
