"""License scans: ordered signature rules over the words of a text.

Texts without any of a few root words are passed by. In the others the words, lower-cased and each between
spaces, form one string; a signature is tried only if its keyword stands there. Every match is an interval of
that string. An interval inside another one that is longer, or as long and of a rule of higher priority, is
suppressed; what remains gives the labels, and its most telling rule the score.

Everything is one projection of built-in expressions: no shuffle, no Python, and memory is that of one text.

Cases: a null or empty text has no words and no labels; rows keep their order and number, so repeated rows,
null ids and other columns do no harm; several places of one phrase all count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.llm.common import BREAK, BREAK_ANY_CASE, bind, lower_ascii, words

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


@dataclass(frozen=True)
class Signature:
    label: str
    pattern: str
    keyword: str
    priority: int
    confidence: float


def _signatures() -> list[Signature]:
    found: list[Signature] = []

    def rule(label: str, keyword: str, priority: int, confidence: float, *patterns: str) -> None:
        found.extend(Signature(label, p, keyword, priority, confidence) for p in patterns)

    # Identifiers, as in file headers: SPDX-License-Identifier: X
    names = {
        "mit": "mit", "apache": "apache 2 0", "gpl-2": "gpl 2 0(?: only| or later)?", "gpl-3": "gpl 3 0(?: only| or later)?", "lgpl-2.1": "lgpl 2 1(?: only| or later)?",
        "lgpl-3": "lgpl 3 0(?: only| or later)?", "agpl-3": "agpl 3 0(?: only| or later)?", "bsd-2": "bsd 2 clause", "bsd-3": "bsd 3 clause", "bsd-0": "0bsd", "isc": "isc",
        "mpl-2": "mpl 2 0", "epl-1": "epl 1 0", "epl-2": "epl 2 0", "cddl-1": "cddl 1 [01]", "unlicense": "unlicense", "cc0": "cc0 1 0", "zlib": "zlib", "wtfpl": "wtfpl",
        "bsl-1": "bsl 1 0", "eupl-1.2": "eupl 1 2", "artistic-2": "artistic 2 0", "ofl-1.1": "ofl 1 1", "ncsa": "ncsa", "postgresql": "postgresql", "python-2": "psf 2 0",
        "php-3": "php 3 01?", "ruby": "ruby", "x11": "x11", "afl-3": "afl 3 0", "osl-3": "osl 3 0", "ms-pl": "ms pl", "ms-rl": "ms rl", "vim": "vim", "curl": "curl", "openssl": "openssl",
        "cc-by": "cc by [1-4] [05]", "cc-by-sa": "cc by sa [1-4] [05]", "cc-by-nc": "cc by nc [1-4] [05]", "cc-by-nd": "cc by nd [1-4] [05]", "cc-by-nc-sa": "cc by nc sa [1-4] [05]", "cc-by-nc-nd": "cc by nc nd [1-4] [05]",
    }
    for label, name in names.items():
        rule(label, "spdx", 90, 1.0, f" spdx license identifier {name} ")
    # Notices: licensed under the X; released under X; this file is under X
    full = {
        "apache-2": "apache license(?: version)? 2(?: 0)?", "apache-1.1": "apache(?: software)? license(?: version)? 1 1", "apache": "apache(?: software)? license",
        "gpl-2": "gnu general public license(?: version| v)? ?2(?: 0)?", "gpl-3": "gnu general public license(?: version| v)? ?3(?: 0)?", "gpl": "gnu general public license",
        "lgpl-2.1": "gnu lesser general public license(?: version| v)? ?2 1", "lgpl-3": "gnu lesser general public license(?: version| v)? ?3", "lgpl": "gnu (?:lesser|library) general public license",
        "agpl-3": "gnu affero general public license(?: version| v)? ?3", "agpl": "gnu affero general public license", "gfdl": "gnu free documentation license",
        "mit": "(?:mit|expat) license", "x11": "x11 license", "isc": "isc license", "bsd": "(?:modified |simplified |new )?bsd license", "bsd-2": "(?:2|two) clause bsd license", "bsd-3": "(?:3|three) clause bsd license", "bsd-4": "(?:4|four) clause bsd license",
        "mpl-1.1": "mozilla public license(?: version| v)? ?1 1", "mpl-2": "mozilla public license(?: version| v)? ?2 0", "mpl": "mozilla public license", "epl": "eclipse public license", "cpl": "common public license", "ipl": "ibm public license",
        "cddl-1": "common development and distribution license", "eupl": "european union public licen[cs]e", "zlib": "zlib(?: libpng)? license", "bsl-1": "boost software license", "busl": "business source license", "sspl": "server side public license",
        "artistic": "artistic license", "artistic-2": "artistic license(?: version)? 2 0", "ofl": "sil open font license", "wtfpl": "do what the fuck you want to public license", "psf": "python software foundation license", "php": "php license", "ruby": "ruby license",
        "ms-pl": "microsoft public license", "ms-rl": "microsoft reciprocal license", "afl": "academic free license", "osl": "open software license", "ncsa": "university of illinois (?:ncsa )?open source license", "postgresql": "postgresql license", "w3c": "w3c software(?: notice and)? license",
        "cecill": "cecill(?: free software)? license", "openssl": "openssl license", "vim": "vim license", "qpl": "q public license", "sleepycat": "sleepycat license", "watcom": "sybase open watcom public license", "elastic": "elastic license", "commons-clause": "commons clause(?: license)?",
        "cc-by": "creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?", "cc-by-sa": "creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?", "cc-by-nc": "creative commons attribution non ?commercial(?: [1-4] [05])?(?: licen[cs]e)?",
        "cc-by-nd": "creative commons attribution no ?deriv(?:ative)?s?(?: [1-4] [05])?(?: licen[cs]e)?", "cc-by-nc-sa": "creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: licen[cs]e)?", "cc-by-nc-nd": "creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [1-4] [05])?(?: licen[cs]e)?",
        "odbl": "open database license", "odc-by": "open data commons attribution license", "pddl": "public domain dedication and license",
    }
    plain = {"cc-by": "creative", "cc-by-sa": "creative", "cc-by-nc": "creative", "cc-by-nd": "creative", "cc-by-nc-sa": "creative", "cc-by-nc-nd": "creative", "commons-clause": "clause"}
    for label, name in full.items():
        key = plain.get(label, "licen")
        rule(label, key, 80, 0.95, f" (?:licensed|released|distributed|published|available|provided) under (?:the |a |an )?(?:terms (?:and conditions )?of (?:the |a )?)?{name} ")
        rule(label, key, 50, 0.7, f" {name} ")
    # Short names
    short = {
        "gpl": "(?:l|a)?gpl", "gpl-2": "gpl ?v?2", "gpl-3": "gpl ?v?3", "lgpl": "lgpl", "lgpl-2.1": "lgpl ?v?2 1", "lgpl-3": "lgpl ?v?3", "agpl": "agpl", "agpl-3": "agpl ?v?3",
    }
    for label, name in short.items():
        if label != "gpl":
            rule(label, "gpl", 40, 0.6, f" {name} ", f" gnu {name} ")
    rule("gpl", "gpl", 30, 0.5, " gpl ", " gnu gpl ")
    for label, name in {"cc-by": "cc by", "cc-by-sa": "cc by sa", "cc-by-nc": "cc by nc", "cc-by-nd": "cc by nd", "cc-by-nc-sa": "cc by nc sa", "cc-by-nc-nd": "cc by nc nd"}.items():
        rule(label, "cc", 45, 0.6, f" {name} ", f" {name} [1-4] [05] ", f" licensed under (?:a |the )?{name}(?: [1-4] [05])? ")
    rule("cc0", "cc0", 45, 0.8, " cc0 ", " cc0 1 0(?: universal)? ")
    rule("cc0", "creative", 45, 0.8, " creative commons zero(?: 1 0)?(?: universal)? ")
    # Sentences of the license texts themselves
    rule("mit", "permission", 70, 0.9, " permission is hereby granted free of charge to any person obtaining a copy of this software ", " the above copyright notice and this permission notice shall be included in all copies or substantial portions ")
    rule("isc", "permission", 70, 0.9, " permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted ")
    rule("bsd", "redistribution", 70, 0.9, " redistribution and use in source and binary forms with or without modification are permitted ", " redistributions of source code must retain the above copyright notice ", " redistributions in binary form must reproduce the above copyright notice ")
    rule("bsd-3", "endorse", 75, 0.9, " neither the name of (?:the )?\\S+(?: \\S+){0,6} nor the names of its contributors may be used to endorse ")
    rule("bsd-4", "advertising", 75, 0.9, " all advertising materials mentioning features or use of this software ")
    rule("apache", "compliance", 70, 0.9, " you may not use this file except in compliance with the license ")
    rule("apache-2", "apache", 70, 0.95, " apache org licenses license 2 0 ")
    rule("gpl", "redistribute", 70, 0.9, " you can redistribute it and or modify it under the terms of the gnu general public license ")
    rule("lgpl", "redistribute", 75, 0.95, " you can redistribute it and or modify it under the terms of the gnu lesser general public license ")
    rule("agpl", "redistribute", 75, 0.95, " you can redistribute it and or modify it under the terms of the gnu affero general public license ")
    rule("mpl", "source code form", 75, 0.95, " this source code form is subject to the terms of the mozilla public license ")
    rule("unlicense", "unencumbered", 75, 0.95, " this is free and unencumbered software released into the public domain ")
    rule("zlib", "altered", 75, 0.9, " altered source versions must be plainly marked as such ")
    rule("wtfpl", "fuck", 60, 0.9, " you just do what the fuck you want to ")
    rule("public-domain", "public domain", 60, 0.7, " (?:dedicated|released|placed) (?:in|to|into) the public domain ", " is in the public domain ", " public domain dedication ")
    rule("proprietary", "rights reserved", 20, 0.4, " all rights reserved ")
    rule("proprietary", "confidential", 25, 0.5, " proprietary and confidential ", " confidential and proprietary ")
    return found


SIGNATURES = _signatures()
#: A text with none of these holds no keyword of a signature and no base phrase.
ROOTS = ("licen", "spdx", "gpl", "creative", "cc", "clause", "permission", "redistribut", "endorse", "advertising", "compliance", "apache", "source code", "unencumbered", "altered", "fuck", "public domain", "rights reserved", "confidential")
#: What can stand between the parts of a keyword in the text is one character or more, so only whole words are looked for there.
PROBE = tuple(dict.fromkeys(r.split()[0] for r in ROOTS if r != "cc"))


def _wide(phrase: str) -> str:
    return phrase.replace(" ", "  ")


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def _detections(line: Column) -> Column:
    """Intervals that no other one suppresses; line has each word between two spaces of its own."""
    kind = "array<struct<label:string,pattern:string,keyword:string,priority:int,confidence:double>>"
    rules = F.expr("array(" + ",".join(f"named_struct('label','{s.label}','pattern',r'{_pattern(s.pattern)}','keyword','{_wide(s.keyword)}','priority',{s.priority},'confidence',{s.confidence}D)" for s in SIGNATURES) + ")").cast(kind)

    def intervals(r: Column) -> Column:
        def place(pieces: Column, found: Column) -> Column:
            before = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,neg_end:int,neg_priority:int,label:string,confidence:double>>").alias("out"))

            def step(a: Column, m: Column, i: Column) -> Column:
                start = a["at"] + F.length(F.get(pieces, i))
                end = start + F.length(m)
                one = F.struct(start.alias("start"), (-end).alias("neg_end"), (-r["priority"]).alias("neg_priority"), r["label"].alias("label"), r["confidence"].alias("confidence"))
                return F.struct(end.alias("at"), F.concat(a["out"], F.array(one)).alias("out"))

            numbered = F.transform(found, lambda m, i: F.struct(m.alias("m"), i.alias("i")))
            return F.aggregate(numbered, before, lambda a, x: step(a, x["m"], x["i"]), lambda a: a["out"])

        return bind(F.split(line, r["pattern"], -1), lambda p: bind(F.regexp_extract_all(line, r["pattern"], F.lit(0)), lambda m: place(p, m)))

    tried = F.filter(rules, lambda r: F.contains(line, r["keyword"]))
    ordered = F.sort_array(F.flatten(F.transform(tried, intervals)))
    empty = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<label:string,confidence:double>>").alias("kept"))

    def survive(a: Column, d: Column) -> Column:
        inside = -d["neg_end"] <= a["end"]
        one = F.array(F.struct(d["label"].alias("label"), d["confidence"].alias("confidence")))
        return F.struct(F.greatest(a["end"], -d["neg_end"]).alias("end"), F.when(inside, a["kept"]).otherwise(F.concat(a["kept"], one)).alias("kept"))

    return F.aggregate(ordered, empty, survive, lambda a: a["kept"])


def _pattern(p: str) -> str:
    """A signature over single spaces, as one over words that have a space at each side of their own."""
    out = p.strip(" ")
    return f" {out.replace(' ?', '(?:  )?').replace(' ', '  ') if ' ?' not in out else _optional(out)} "


def _optional(p: str) -> str:
    parts = p.split(" ?")
    return "(?:  )?".join(x.replace(" ", "  ") for x in parts)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score, for each row of docs."""
    text = F.coalesce("text", F.lit(""))
    raw = docs.select("doc_id", text.alias("text"))
    plain = F.lower("text")
    gate = F.lit(False)
    for root in PROBE:
        gate |= F.contains(plain, F.lit(root))
    gate |= F.contains(plain, F.lit("cc")) & F.rlike(plain, F.lit(f"cc(?:{BREAK}by|0)"))
    gated = raw.withColumn("n_words", F.size(words(F.col("text"), BREAK_ANY_CASE)).cast("long")).withColumn("gated", gate)
    line = F.when(F.col("gated"), F.concat(F.lit(" "), F.array_join(words(lower_ascii(F.col("text")), BREAK), "  "), F.lit(" "))).otherwise(F.lit(""))

    def results(s: Column) -> Column:
        phrases = {f" {_wide(p)} ": (p, label) for p, label in BASE.items()}
        times = {p: ((F.length(s) - F.length(F.replace(s, F.lit(w), F.lit("")))) / len(w)).cast("long") for w, (p, _) in phrases.items()}
        first = [F.when(F.contains(s, F.lit(w)), (_spaces(F.substring_index(s, w, 1)) / 2).cast("long")) for w in phrases]
        last = [F.when(F.contains(s, F.lit(w)), F.col("n_words") - (_spaces(F.substring_index(s, w, -1)) / 2).cast("long") - len(p.split())) for w, (p, _) in phrases.items()]
        base = F.filter(F.array(*[F.when(F.contains(s, F.lit(w)), F.lit(label)) for w, (_, label) in phrases.items()]), lambda x: x.isNotNull())
        return F.struct(
            sum(times.values(), F.lit(0)).cast("long").alias("n_base"), F.array_min(F.array(*first)).alias("first_word"), F.array_max(F.array(*last)).alias("last_word"),
            F.array_sort(base).alias("base"), _detections(s).alias("kept"),
        )

    none = F.lit(None).cast("struct<n_base:bigint,first_word:bigint,last_word:bigint,base:array<string>,kept:array<struct<label:string,confidence:double>>>")
    found = gated.select("doc_id", "n_words", F.when(F.col("gated"), bind(line, results)).otherwise(none).alias("r"))
    labels = F.array_sort(F.array_distinct(F.concat("r.base", F.transform("r.kept", lambda k: k["label"]))))
    score = F.array_max(F.concat(F.transform("r.kept", lambda k: k["confidence"]), F.transform("r.base", lambda _: F.lit(0.7))))
    return found.select(
        "doc_id", "n_words", F.coalesce("r.n_base", F.lit(0)).cast("long").alias("n_base"), F.col("r.first_word").alias("first_word"), F.col("r.last_word").alias("last_word"),
        F.coalesce(F.array_join("r.base", ","), F.lit("")).alias("base_labels"), F.coalesce(F.array_join(labels, ","), F.lit("")).alias("labels"), F.coalesce(score, F.lit(0.0)).alias("score"),
    )
