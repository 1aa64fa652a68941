"""License scan: ordered signature rules behind a keyword prefilter, with native columns only.

A text is read as its words (letters A-Z in either case), so rules see neither punctuation nor line
breaks.  Which of a few dozen keywords stand in it is found in one pass; only the rules of those
keywords run.  Every detection is an interval of the word text with a rank; one that lies inside
another of equal or better rank is suppressed.  Work is per row: no shuffle, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.llm.spans import let, matches

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

NOTICE, VERSIONED, MENTION = 1, 2, 3
SCORES = {NOTICE: 0.95, VERSIONED: 0.85, MENTION: 0.6}


@dataclass(frozen=True)
class Family:
    """Licenses of one name: label, keyword that must stand in the text, name as a pattern over words, versions."""

    label: str
    keyword: str
    name: str
    versions: tuple[str, ...] = ()


#: Hand-written names; versions are written with blanks, as their digits are words of their own.
FAMILIES = (
    Family("apache", "apache", r"apache(?: software)?", ("2 0", "1 1", "1 0")),
    Family("mit", "mit", r"(?:mit|mit x11)"),
    Family("mit", "expat", r"expat"),
    Family("gpl", "gpl", r"(?:gnu )?gpl", ("3 0", "2 0", "1 0", "3", "2", "1")),
    Family("lgpl", "lgpl", r"(?:gnu )?lgpl", ("3 0", "2 1", "2 0", "3", "2")),
    Family("agpl", "agpl", r"(?:gnu )?agpl", ("3 0", "3", "1 0")),
    Family("gpl", "general", r"(?:gnu )?general public", ("3 0", "2 0", "1 0", "3", "2", "1")),
    Family("lgpl", "lesser", r"(?:gnu )?lesser general public", ("3 0", "2 1", "3")),
    Family("lgpl", "library", r"(?:gnu )?library general public", ("2 0", "2")),
    Family("agpl", "affero", r"(?:gnu )?affero general public", ("3 0", "3", "1 0")),
    Family("gfdl", "documentation", r"(?:gnu )?free documentation", ("1 3", "1 2", "1 1")),
    Family("bsd", "bsd", r"(?:modified |simplified |new |revised |original )?bsd(?: [0-4] clause)?"),
    Family("mpl", "mozilla", r"mozilla public", ("2 0", "1 1", "1 0")),
    Family("mpl", "mpl", r"mpl", ("2 0", "1 1", "1 0")),
    Family("epl", "eclipse", r"eclipse public", ("2 0", "1 0")),
    Family("edl", "eclipse", r"eclipse distribution", ("1 0",)),
    Family("cddl", "cddl", r"cddl", ("1 1", "1 0")),
    Family("cddl", "distribution", r"common development and distribution", ("1 1", "1 0")),
    Family("cpl", "common", r"common public", ("1 0",)),
    Family("ipl", "ibm", r"ibm public", ("1 0",)),
    Family("eupl", "eupl", r"eupl", ("1 2", "1 1", "1 0")),
    Family("eupl", "european", r"european union public", ("1 2", "1 1", "1 0")),
    Family("osl", "open", r"open software", ("3 0", "2 1", "2 0", "1 1", "1 0")),
    Family("afl", "academic", r"academic free", ("3 0", "2 1", "2 0", "1 2", "1 1")),
    Family("artistic", "artistic", r"artistic", ("2 0", "1 0")),
    Family("bsl", "boost", r"boost software", ("1 0",)),
    Family("busl", "business", r"business source", ("1 1", "1 0")),
    Family("isc", "isc", r"isc"),
    Family("zlib", "zlib", r"zlib(?: libpng)?"),
    Family("libpng", "libpng", r"libpng", ("2",)),
    Family("libpng", "png", r"png reference library", ("2",)),
    Family("python", "python", r"python software foundation", ("2 0", "2")),
    Family("php", "php", r"php", ("3 01", "3 0")),
    Family("postgresql", "postgresql", r"postgresql"),
    Family("ruby", "ruby", r"ruby"),
    Family("unlicense", "unlicense", r"(?:the )?unlicense"),
    Family("wtfpl", "wtfpl", r"wtfpl", ("2",)),
    Family("ofl", "sil", r"sil open font", ("1 1", "1 0")),
    Family("ofl", "ofl", r"ofl", ("1 1", "1 0")),
    Family("odbl", "database", r"open database", ("1 0",)),
    Family("odc-by", "attribution", r"open data commons attribution", ("1 0",)),
    Family("pddl", "dedication", r"public domain dedication and", ("1 0",)),
    Family("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?"),
    Family("openssl", "openssl", r"openssl"),
    Family("vim", "vim", r"vim"),
    Family("w3c", "w3c", r"w3c(?: software(?: notice)?(?: and)?)?"),
    Family("ms-pl", "microsoft", r"microsoft public"),
    Family("ms-rl", "microsoft", r"microsoft reciprocal"),
    Family("apsl", "apple", r"apple public source", ("2 0", "1 2", "1 1", "1 0")),
    Family("cecill", "cecill", r"cecill(?: b| c)?", ("2 1", "2 0", "1 1", "1 0")),
    Family("mulan", "mulan", r"mulan(?: permissive software| psl)?", ("2", "1")),
    Family("elastic", "elastic", r"elastic", ("2 0",)),
    Family("sspl", "server", r"server side public", ("1",)),
    Family("polyform", "polyform", r"polyform (?:noncommercial|small business|shield|strict)", ("1 0 0",)),
    Family("cc-by", "cc", r"cc by", ("4 0", "3 0", "2 5", "2 0", "1 0")),
    Family("cc-by-sa", "cc", r"cc by sa", ("4 0", "3 0", "2 5", "2 0", "1 0")),
    Family("cc-by-nd", "cc", r"cc by nd", ("4 0", "3 0", "2 5", "2 0", "1 0")),
    Family("cc-by-nc", "cc", r"cc by nc", ("4 0", "3 0", "2 5", "2 0", "1 0")),
    Family("cc-by-nc-sa", "cc", r"cc by nc sa", ("4 0", "3 0", "2 5", "2 0", "1 0")),
    Family("cc-by-nc-nd", "cc", r"cc by nc nd", ("4 0", "3 0", "2 5", "2 0", "1 0")),
    Family("cc0", "cc0", r"cc0", ("1 0",)),
    Family("cc-by", "creative", r"creative commons attribution", ("4 0", "3 0", "2 5", "2 0", "1 0")),
    Family("cc-by-sa", "creative", r"creative commons attribution share ?alike", ("4 0", "3 0", "2 5", "2 0", "1 0")),
    Family("cc-by-nc", "creative", r"creative commons attribution non ?commercial", ("4 0", "3 0", "2 5", "2 0", "1 0")),
    Family("cc-by-nd", "creative", r"creative commons attribution no ?deriv(?:ative)?s?", ("4 0", "3 0", "2 5", "2 0", "1 0")),
    Family("cc0", "creative", r"creative commons (?:zero|cc0)", ("1 0",)),
)

#: Hand-written signatures of texts and notices: label, keyword, pattern.
SIGNATURES = (
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", r"may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display"),
    ("zlib", "altered", r"altered source versions must be plainly marked as such"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "fuck", r"do what the fuck you want to public licen[sc]e"),
    ("gpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("lgpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e"),
    ("agpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e"),
    ("apache-2.0", "apache", r"apache org licenses licen[sc]e 2 0"),
    ("public-domain", "public", r"(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", "domain", r"public domain"),
    ("reserved", "reserved", r"(?:all|some|no) rights reserved"),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)[0-9][0-9](?: (?:19|20)?[0-9][0-9])*"),
    ("warranty", "warranty", r"(?:without warranty of any kind|without any warranty)"),
    ("warranty", "warranties", r"without warranties or conditions of any kind"),
    ("proprietary", "proprietary", r"proprietary and confidential"),
    ("cc-by", "creativecommons", r"creativecommons org licenses by [1-4] [05]"),
    ("cc-by-sa", "creativecommons", r"creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by-nc", "creativecommons", r"creativecommons org licenses by nc [1-4] [05]"),
    ("cc-by-nd", "creativecommons", r"creativecommons org licenses by nd [1-4] [05]"),
    ("cc0", "creativecommons", r"creativecommons org publicdomain zero 1 0"),
)


def rules() -> list[tuple[str, str, str, int]]:
    """All rules (keyword, label, pattern, rank): the signatures, then each family's notices, versions and names."""
    out = [(keyword, label, pattern, NOTICE) for label, keyword, pattern in SIGNATURES]
    for f in FAMILIES:
        named = rf"(?:the )?(?:{f.name})(?: public)?(?: licen[sc]es?)?"
        under = r"(?:licen[sc]ed|released|distributed|available|provided|published) under (?:the terms of |a |an )?"
        for v in f.versions:
            label = f"{f.label}-{v.replace(' ', '.')}"
            version = rf"(?: version| v| ver| international| unported)? ?v?{v}(?: or(?: any)? later(?: version)?| only| or newer)?"
            out.append((f.keyword, label, rf"{under}{named}{version}", NOTICE))
            out.append((f.keyword, label, rf"{named}{version}", VERSIONED))
        out.append((f.keyword, f.label, rf"{under}{named}", VERSIONED))
        out.append((f.keyword, f.label, rf"(?:{f.name})(?: public)? licen[sc]e" if f.name not in ("cc by",) else rf"(?:{f.name})", MENTION))
        out.append((f.keyword, f.label, rf"spdx licen[sc]e identifier (?:{f.name})", NOTICE))
    return out


def gate(of: list[tuple[str, str, str, int]]) -> str:
    """Pattern of a keyword (group 1) as a whole word, or with a version glued to it, as in GPLv3; longer keywords first."""
    keywords = sorted({"cc", "general", "reserved"} | {r[0] for r in of}, key=lambda k: (-len(k), k))
    return rf"(?i)(?<!{WORD})({'|'.join(keywords)})(?:v?[0-9]+)?(?!{WORD})"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def rule_table(of: list[tuple[str, str, str, int]]) -> Column:
    """A constant map from keyword to its rules."""
    by: dict[str, list[str]] = {}
    for keyword, label, pattern, rank in of:
        by.setdefault(keyword, []).append(f"named_struct('label', {_quoted(label)}, 'pattern', {_quoted(f'(?<= )(?:{pattern})(?= )')}, 'rank', {rank})")
    return F.expr("map(" + ", ".join(f"{_quoted(k)}, array({', '.join(v)})" for k, v in by.items()) + ")")


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


FOUND = "array<struct<start:int,stop:int,rank:int,label:string>>"


def detections(norm: Column, keywords: Column, of: list[tuple[str, str, str, int]] | None = None) -> Column:
    """All detections of the rules of ``keywords`` in word text: start, negated end, rank, label, sorted."""
    table = rule_table(rules() if of is None else of)
    active = F.flatten(F.transform(F.array_distinct(keywords), lambda k: table[k]))
    by_rule = lambda r: F.when(
        F.rlike(norm, r.pattern),
        F.transform(
            matches(norm, r.pattern),
            lambda s: F.struct(s.start.alias("start"), (-s.end).alias("stop"), r.rank.alias("rank"), r.label.alias("label")),
        ),
    ).otherwise(F.array().cast(FOUND))
    return F.array_sort(F.flatten(F.transform(active, by_rule)))


def resolve(found: Column) -> Column:
    """Labels and best rank of what stays: nothing that lies inside a detection of equal or better rank.

    Detections come by start, longest first, so an interval is inside an earlier one exactly if the
    furthest end so far among those of equal or better rank reaches its own end.
    """
    state = F.struct(*(F.lit(-1).alias(f"reach{r}") for r in SCORES), F.array().cast("array<string>").alias("labels"), F.lit(9).alias("best"))

    def step(a: Column, d: Column) -> Column:
        end = -d.stop
        reach = F.coalesce(*(F.when(d["rank"] == r, a[f"reach{r}"]) for r in SCORES))
        stays = reach < end
        return F.struct(
            *(F.when(d["rank"] <= r, F.greatest(a[f"reach{r}"], end)).otherwise(a[f"reach{r}"]).alias(f"reach{r}") for r in SCORES),
            F.when(stays, F.array_union(a.labels, F.array(d.label))).otherwise(a.labels).alias("labels"),
            F.when(stays, F.least(a.best, d["rank"])).otherwise(a.best).alias("best"),
        )

    return F.aggregate(found, state, step, lambda a: F.struct(a.labels.alias("labels"), a.best.alias("best")))


def scan(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), of: list[tuple[str, str, str, int]] | None = None) -> DataFrame:
    """``keep`` and n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null and empty texts have no words, no places and no labels; their score is 0.  Every row is
    answered, repeated rows each; other columns of the input are dropped.
    """
    of = rules() if of is None else of
    rows = docs.select(*(docs[c] for c in keep), F.coalesce(docs[text], F.lit("")).alias("_text"))
    body = F.col("_text")

    def base(norm: Column, words: Column, phrase: str) -> Column:
        k = len(phrase.split())

        def placed(gaps: Column) -> Column:
            n = F.size(gaps) - 1
            first = _blanks(F.get(gaps, F.lit(0))) - 1
            last = words - (_blanks(F.element_at(gaps, -1)) - 1) - k
            return F.struct(n.alias("n"), F.when(n > 0, first).alias("first"), F.when(n > 0, last).alias("last"))

        return let(F.split(norm, rf"(?<= ){phrase}(?= )", -1), placed)

    def read(norm: Column) -> Column:
        return let(
            F.struct(
                *(base(norm, F.col("n_words"), p).alias(f"p{i}") for i, p in enumerate(PHRASES)),
                let(detections(norm, F.transform(F.col("_found"), lambda x: F.translate(x, UPPER, LOWER)), of), resolve).alias("own"),
            ),
            lambda s: F.struct(
                sum((s[f"p{i}"].n for i in range(1, len(PHRASES))), s.p0.n).cast("long").alias("n_base"),
                F.array_min(F.array(*(s[f"p{i}"].first for i in range(len(PHRASES))))).cast("long").alias("first_word"),
                F.array_max(F.array(*(s[f"p{i}"].last for i in range(len(PHRASES))))).cast("long").alias("last_word"),
                F.array_compact(F.array(*(F.when(s[f"p{i}"].n > 0, F.lit(label)) for i, label in enumerate(PHRASES.values())))).alias("base"),
                s.own.labels.alias("own"),
                s.own.best.alias("best"),
            ),
        )

    norm = F.concat(F.lit(" "), F.trim(F.translate(F.regexp_replace(body, NO_WORD + "+", " "), UPPER, LOWER)), F.lit(" "))
    counted = rows.withColumn("n_words", F.regexp_count(body, F.lit(WORD + "+")).cast("long")).withColumn("_found", F.regexp_extract_all(body, F.lit(gate(of)), F.lit(1)))
    scanned = counted.withColumn("_scan", F.when(F.size("_found") > 0, let(norm, read)))
    s = F.col("_scan")
    nothing = F.array().cast("array<string>")
    labels = F.array_union(F.coalesce(s.base, nothing), F.coalesce(s.own, nothing))
    score = F.coalesce(*(F.when(s.best == r, F.lit(v)) for r, v in SCORES.items()), F.when(F.size(s.base) > 0, F.lit(SCORES[MENTION])), F.lit(0.0))
    return scanned.select(
        *keep,
        "n_words",
        F.coalesce(s.n_base, F.lit(0).cast("long")).alias("n_base"),
        s.first_word.alias("first_word"),
        s.last_word.alias("last_word"),
        F.array_join(F.array_sort(F.coalesce(s.base, nothing)), ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        score.alias("score"),
    )
