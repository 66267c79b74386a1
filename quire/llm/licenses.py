"""License scan by ordered signature rules, in Spark's own functions only.

A text becomes its words, lower-cased (A-Z) and joined by single spaces. Rules are regular expressions over that form, each
with a label, a keyword and a rank; a rule is tried only where its keyword occurs, and none where no keyword of any does. A
detection that lies inside one of a better rank (or of the same rank and longer) is dropped. Rules are the notices below and, for
each license name, the name with its version, the same after "licensed under" and the like, and the SPDX identifier, also alone
with its version and as a further part of an expression with OR or AND.

Defined cases: null text counts as empty; no detection gives empty labels, null places and score 0; each row stands for
itself; other columns are ignored; an empty table gives an empty result; very long texts and words are read whole.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import ascii_lower

#: Fixed phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Licenses: label, keyword, names as patterns over words, versions (empty: none asked for).
FAMILIES = [
    ("apache", "apache", ["apache( software)? license"], ["2 0", "1 1", "1 0"]),
    ("mit", "mit", ["mit license", "mit expat license", "expat license"], []),
    ("mit-0", "mit no attribution", ["mit no attribution( license)?"], []),
    ("mit-0", "mit 0", ["mit 0"], []),
    ("bsd-2-clause", "bsd", ["bsd 2 clause( simplified)?( license)?", "simplified bsd license", "freebsd license"], []),
    ("bsd-3-clause", "bsd", ["bsd 3 clause( new| revised)?( license)?", "(new|revised|modified) bsd license"], []),
    ("bsd-4-clause", "bsd", ["bsd 4 clause( license)?", "original bsd license"], []),
    ("bsd", "bsd", ["bsd( style)? license"], []),
    ("0bsd", "0bsd", ["0bsd"], []),
    ("gpl", "gpl", ["(gnu )?gpl"], ["1 0", "2 0", "3 0", "1", "2", "3"]),
    ("gpl", "general public", ["(gnu )?general public licen[cs]e"], ["1 0", "2 0", "3 0", "1", "2", "3"]),
    ("lgpl", "lgpl", ["(gnu )?lgpl"], ["2 0", "2 1", "3 0", "2", "3"]),
    ("lgpl", "lesser general", ["(gnu )?lesser general public licen[cs]e", "(gnu )?library or lesser general public licen[cs]e"], ["2 0", "2 1", "3 0", "2", "3"]),
    ("agpl", "agpl", ["(gnu )?agpl"], ["1 0", "3 0", "3"]),
    ("agpl", "affero", ["(gnu )?affero general public licen[cs]e"], ["1 0", "3 0", "3"]),
    ("gfdl", "free documentation", ["(gnu )?free documentation licen[cs]e"], ["1 1", "1 2", "1 3"]),
    ("mpl", "mozilla", ["mozilla public licen[cs]e"], ["1 0", "1 1", "2 0"]),
    ("mpl", "mpl", ["mpl"], ["1 0", "1 1", "2 0"]),
    ("epl", "eclipse", ["eclipse public licen[cs]e"], ["1 0", "2 0"]),
    ("edl", "eclipse", ["eclipse distribution licen[cs]e"], ["1 0"]),
    ("eupl", "european union", ["european union public licen[cs]e"], ["1 0", "1 1", "1 2"]),
    ("eupl", "eupl", ["eupl"], ["1 0", "1 1", "1 2"]),
    ("cddl", "common development", ["common development and distribution licen[cs]e"], ["1 0", "1 1"]),
    ("cpl", "common public", ["common public licen[cs]e"], ["1 0"]),
    ("artistic", "artistic", ["artistic licen[cs]e"], ["1 0", "2 0"]),
    ("isc", "isc", ["isc licen[cs]e"], []),
    ("zlib", "zlib", ["zlib( libpng)? licen[cs]e"], []),
    ("bsl", "boost", ["boost software licen[cs]e"], ["1 0"]),
    ("busl", "business source", ["business source licen[cs]e"], ["1 0", "1 1"]),
    ("sspl", "server side public", ["server side public licen[cs]e"], ["1"]),
    ("unlicense", "unlicense", ["(the )?unlicense"], []),
    ("wtfpl", "wtfpl", ["wtfpl"], ["2"]),
    ("psf", "python", ["python software foundation licen[cs]e", "psf licen[cs]e"], ["2"]),
    ("postgresql", "postgresql", ["postgresql licen[cs]e"], []),
    ("openssl", "openssl", ["openssl licen[cs]e"], []),
    ("php", "php", ["php licen[cs]e"], ["3 0", "3 01"]),
    ("ruby", "ruby", ["ruby licen[cs]e"], []),
    ("ofl", "open font", ["(sil )?open font licen[cs]e"], ["1 0", "1 1"]),
    ("osl", "open software", ["open software licen[cs]e"], ["1 0", "2 0", "2 1", "3 0"]),
    ("afl", "academic free", ["academic free licen[cs]e"], ["1 1", "1 2", "2 0", "2 1", "3 0"]),
    ("ms-pl", "microsoft", ["microsoft public licen[cs]e"], []),
    ("ms-rl", "microsoft", ["microsoft reciprocal licen[cs]e"], []),
    ("odbl", "open database", ["open (data commons open )?database licen[cs]e"], ["1 0"]),
    ("pddl", "public domain dedication", ["open data commons public domain dedication and licen[cs]e"], ["1 0"]),
    ("cc0", "cc0", ["cc0( universal)?"], ["1 0"]),
    ("cc0", "creative commons", ["creative commons zero"], ["1 0"]),
    ("cc-by", "cc by", ["cc by"], ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-sa", "cc by", ["cc by sa"], ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nd", "cc by", ["cc by nd"], ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc", "cc by", ["cc by nc"], ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc-sa", "cc by", ["cc by nc sa"], ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc-nd", "cc by", ["cc by nc nd"], ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by", "creative commons", ["creative commons attribution"], ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-sa", "creative commons", ["creative commons attribution share ?alike"], ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nd", "creative commons", ["creative commons attribution no ?deriv(ative)?s?( works)?"], ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc", "creative commons", ["creative commons attribution non ?commercial"], ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc-sa", "creative commons", ["creative commons attribution non ?commercial share ?alike"], ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc-nd", "creative commons", ["creative commons attribution non ?commercial no ?deriv(ative)?s?( works)?"], ["1 0", "2 0", "2 5", "3 0", "4 0"]),
]

#: Sentences without a license's name: label, keyword, pattern.
NOTICES = [
    ("reserved", "reserved", "all rights (are )?reserved"),
    ("reserved", "vorbehalten", "alle rechte vorbehalten"),
    ("reserved", "tous droits", "tous droits (réservés|reserves)"),
    ("reserved", "reservados", "todos los derechos reservados"),
    ("public-domain", "public domain", "(is|are|was|been|released|placed|dedicated)( in| into| to)? the public domain"),
    ("mit", "permission is hereby", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission to use", "permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("copyright", "copyright", "copyright( c| ©)?( [12][0-9]{3})+"),
    ("copyright", "copyrighted", "(this|the) (work|text|document|material|software|file) is copyrighted"),
    ("public-domain", "public domain", "(no|without) copyright public domain"),
    ("cc0", "waived", "has waived all copyright and related( or| and)? neighboring rights"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("apache", "apache", "licensed to the apache software foundation"),
    ("apache-2.0", "apache", "apache org licenses license 2 0"),
    ("gpl", "redistribute it", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "gnu org", "gnu org (licenses|copyleft) gpl"),
    ("lgpl", "gnu org", "gnu org (licenses|copyleft) lesser"),
    ("agpl", "affero", "remote network interaction use with the gnu (affero )?general public license"),
    ("mpl", "mozilla", "this source code form is subject to the terms of the mozilla public license"),
    ("mpl", "mozilla org", "mozilla org mpl"),
    ("bsd-3-clause", "endorse or promote", "neither the name of .{1,400}? may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software must display"),
    ("zlib", "altered source", "altered source versions must be plainly marked as such"),
    ("bsl", "boost", "boost org license 1 0"),
    ("wtfpl", "what the", "do what the (fuck|f) you want to public licen[cs]e"),
    ("artistic", "copyright holder reserves", "the copyright holder reserves the right to refuse"),
    ("mit", "substantial portions", "shall be included in all copies or substantial portions of the software"),
    ("ms-pl", "microsoft", "microsoft permissive licen[cs]e"),
    ("cc-by", "creativecommons", "creativecommons org licenses by [1-4] [05]"),
    ("cc-by-sa", "creativecommons", "creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by-nd", "creativecommons", "creativecommons org licenses by nd [1-4] [05]"),
    ("cc-by-nc", "creativecommons", "creativecommons org licenses by nc [1-4] [05]"),
    ("cc-by-nc-sa", "creativecommons", "creativecommons org licenses by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", "creativecommons", "creativecommons org licenses by nc nd [1-4] [05]"),
    ("cc0", "creativecommons", "creativecommons org publicdomain zero 1 0"),
    ("proprietary", "trade secret", "trade secrets? (and|or) confidential information"),
    ("proprietary", "unauthorized", "unauthori[sz]ed (copying|reproduction|distribution|use)( or distribution)? .{0,400}?(is )?(strictly )?prohibited"),
    ("proprietary", "for internal use", "for internal use only"),
    ("proprietary", "proprietary", "(confidential and proprietary|proprietary and confidential)"),
    ("proprietary", "permission", "(may not be (reproduced|copied|redistributed)|reproduction (is )?prohibited) without( prior| written| express)* permission"),
]

GRANT = "(licen[cs]ed|released|distributed|published|available|provided)( for use)? under( the)?( terms of)?( the)? "
#: Between a name and its version, which may be glued to it by a v.
NUMBER = "(?:( licen[cs]e)?( v| version)? (v ?)?|v)"
#: What stands before a further license of an expression; the license alone is the detection.
EXPRESSION = "(?<=spdx license identifier .{1,120} (?:or|and) )"

#: Rank (smaller is better) and confidence of the kinds of rules.
KINDS = {"spdx": (1, 0.99), "granted version": (2, 0.98), "granted": (3, 0.95), "version": (4, 0.9), "name": (5, 0.7), "notice": (6, 0.8), "phrase": (7, 0.5)}


def rules() -> list[tuple[str, str, str, int, float]]:
    """label, keyword, pattern, rank, confidence."""
    out = [(label, keyword, pattern, *KINDS["notice"]) for label, keyword, pattern in NOTICES]
    listed = set()
    for label, keyword, names, versions in FAMILIES:
        name, plain = f"(?:{'|'.join(names)})", label.replace("-", " ")
        for v in versions or [""]:
            full, number = label, ""
            if v:
                number = v if " " in v else f"{v} 0"
                full = f"{label}-{number.replace(' ', '.')}"
                out.append((full, keyword, f"{GRANT}{name}{NUMBER}{v}", *KINDS["granted version"]))
                out.append((full, keyword, f"{name}{NUMBER}{v}", *KINDS["version"]))
            if full not in listed:  # once a license, whatever names it has
                listed.add(full)
                identifier = f"{plain} {number}( only| or later)?" if v else plain
                out.append((full, "spdx", f"spdx license identifier {identifier}", *KINDS["spdx"]))
                out.append((full, "spdx", f"{EXPRESSION}{identifier}", *KINDS["spdx"]))
                if v and label == keyword:
                    out.append((full, keyword, identifier, *KINDS["version"]))
        out.append((label, keyword, f"{GRANT}{name}", *KINDS["granted"]))
        out.append((label, keyword, name, *KINDS["name"]))
    return out


_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def gates() -> list[str]:
    """Words of which each rule's matches hold one: "licen" where a pattern always has it, else the rule's keyword; phrases likewise."""
    out = {"licen" if "licen" in phrase else phrase for phrase in PHRASES} | {"spdx"}
    out |= {"licen" if "licen" in pattern and "(" not in pattern else keyword for _, keyword, pattern in NOTICES}
    for label, keyword, names, versions in FAMILIES:
        out |= {"licen" if "licen" in re.sub(r"\([^()]*\)\??", "", name) else keyword for name in names}
        if versions and label == keyword:  # its identifier stands alone
            out.add(keyword)
    return sorted(g for g in out if not any(other != g and f" {other} " in f" {g} " for other in out))


def _gate(text: Column) -> Column:
    """Whether any gate occurs; between its words there may be whatever parts words."""
    low, found = F.lower(text), F.lit(False)
    for g in sorted(gates(), key=lambda g: " " in g):
        words = g.split()
        one = F.contains(low, F.lit(max(words, key=len)))
        found = found | (one & low.rlike(_BREAKS.join(map(re.escape, words))) if len(words) > 1 else one)
    return found


def _spans(words: Column, pattern: Column) -> Column:
    """(start, end) of a pattern's matches, from the pieces between them and the matches' lengths."""
    whole = F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )"))
    lengths = F.transform(F.arrays_zip(F.split(words, whole, -1).alias("gap"), F.regexp_extract_all(words, whole, F.lit(0)).alias("hit")), lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit")))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + x["gap"]
        end = at + F.coalesce(x["hit"], F.lit(0))
        return F.struct(end.alias("at"), F.when(x["hit"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(at.alias("start"), end.alias("end"))))).alias("out"))

    return F.aggregate(lengths, start, step, lambda acc: acc["out"])


def _by_keyword() -> Column:
    groups: dict[str, list] = {}
    for label, keyword, pattern, rank, confidence in rules():
        groups.setdefault(keyword, []).append(F.struct(F.lit(label).alias("label"), F.lit(pattern).alias("pattern"), F.lit(rank).alias("rank"), F.lit(confidence).alias("confidence")))
    return F.array(*[F.struct(F.lit(k).alias("keyword"), F.array(*v).alias("rules")) for k, v in groups.items()])


def _place(words: Column, start: Column) -> Column:
    """Which word begins at a character of ' w0 w1 ... '."""
    before = F.substring(words, F.lit(1), start)
    return (F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit(""))) - 1).cast("long")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    joined = F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(F.col("text")), _BREAKS, " ")), F.lit(" "))
    rows = rows.select("doc_id", F.regexp_count("text", F.lit(_WORD)).cast("long").alias("n_words"), F.when(_gate(F.col("text")), joined).alias("words"))

    phrases = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(phrase).alias("pattern")) for phrase, label in PHRASES.items()])
    base = F.filter(F.transform(phrases, lambda p: F.struct(p["label"].alias("label"), _spans(F.col("words"), p["pattern"]).alias("spans"))), lambda x: F.size(x["spans"]) > 0)
    live = F.flatten(F.transform(F.filter(_by_keyword(), lambda g: F.contains(F.col("words"), g["keyword"])), lambda g: g["rules"]))
    found = F.flatten(F.transform(live, lambda r: F.transform(_spans(F.col("words"), r["pattern"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), r["rank"].alias("rank"), r["label"].alias("label"), r["confidence"].alias("confidence")))))
    rows = rows.withColumn("base", F.when(F.col("words").isNotNull(), base)).withColumn("found", F.when(F.col("words").isNotNull(), F.array_distinct(found)))

    def inside(x: Column, y: Column) -> Column:
        better = (y["rank"] < x["rank"]) | ((y["rank"] == x["rank"]) & (y["end"] - y["start"] > x["end"] - x["start"]))
        return (y["start"] <= x["start"]) & (x["end"] <= y["end"]) & better

    rows = rows.withColumn("kept", F.filter("found", lambda x: ~F.exists(F.col("found"), lambda y: inside(x, y))))
    starts = F.flatten(F.transform("base", lambda b: F.transform(b["spans"], lambda s: s["start"])))
    rows = rows.withColumn("starts", starts)
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"])))
    labels = F.array_sort(F.array_distinct(F.concat(F.transform("base", lambda b: b["label"]), F.transform("kept", lambda k: k["label"]))))
    phrase_score = F.when(F.size("base") > 0, F.lit(KINDS["phrase"][1])).otherwise(F.lit(0.0))
    best = F.greatest(F.coalesce(F.array_max(F.transform("kept", lambda k: k["confidence"])), F.lit(0.0)), phrase_score)
    return rows.select(
        "doc_id",
        "n_words",
        F.coalesce(F.size("starts"), F.lit(0)).cast("long").alias("n_base"),
        _place(F.col("words"), F.array_min("starts")).alias("first_word"),
        _place(F.col("words"), F.array_max("starts")).alias("last_word"),
        F.coalesce(F.array_join(base_labels, ","), F.lit("")).alias("base_labels"),
        F.coalesce(F.array_join(labels, ","), F.lit("")).alias("labels"),
        F.coalesce(best, F.lit(0.0)).alias("score"),
        F.coalesce(F.size("kept"), F.lit(0)).cast("long").alias("n_detections"),
    )
