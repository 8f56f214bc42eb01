"""License detection by ordered signature rules, in DataFrame functions only.

A rule is a regular expression over words that are joined by single spaces, anchored at
a place. It has a keyword as its first word; only places with a keyword are tried, and
only in texts where a word starts with one of the gates. Detections that lie inside another one
are suppressed; of equal intervals the rule with the better priority stays.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.llm.fingerprints import let
from quillrank.llm.shared import clean_text, table, unused

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    score: float
    base: bool = False

    @property
    def keyword(self) -> str:
        return self.pattern.split(" ")[0]


def _versions(*numbers: str) -> list[tuple[str, str]]:
    """(label part, pattern) of version numbers: 2.0 is the words 2 0."""
    return [(n, n.replace(".", " ")) for n in numbers]


def build_rules() -> list[Rule]:
    """All rules, best priority first; families are spelled out over their versions and wordings."""
    rules = [Rule(label, phrase, 0.5, True) for phrase, label in BASE]
    named: list[Rule] = []
    # GNU family: full name, short name, with and without "or later"
    for short, full, versions in (
        ("gpl", "general public license", ("1", "2", "2.0", "3", "3.0")),
        ("lgpl", "lesser general public license", ("2", "2.0", "2.1", "3", "3.0")),
        ("lgpl", "library general public license", ("2", "2.0")),
        ("agpl", "affero general public license", ("1", "3", "3.0")),
        ("fdl", "free documentation license", ("1.1", "1.2", "1.3")),
    ):
        for version, words in _versions(*versions):
            major = version.removesuffix(".0")
            for start in (f"gnu {full}", full):
                named.append(Rule(f"{short}-{major}+", rf"{start} (?:as published by the free software foundation )?(?:either )?(?:version |v){words} (?:of the license )?or (?:at your option )?(?:any )?later", 1.0))
                named.append(Rule(f"{short}-{major}", rf"{start} (?:as published by the free software foundation )?(?:either )?(?:version |v)?{words}", 0.95))
            named.append(Rule(f"{short}-{major}+", rf"{short} {words} or later", 1.0))
            named.append(Rule(f"{short}-{major}", rf"{short} (?:v |version )?{words}", 0.9))
            named.append(Rule(f"{short}-{major}", rf"{short}v{words}", 0.9))
        named.append(Rule(short, f"gnu {full}", 0.85))
    # Creative Commons: every combination of terms, in letters and in words
    wording = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?"}
    for combination in (("by",), ("by", "sa"), ("by", "nd"), ("by", "nc"), ("by", "nc", "sa"), ("by", "nc", "nd")):
        label = "cc-" + "-".join(combination)
        letters = " ".join(combination)
        words = " ".join(wording[t] for t in combination)
        for version, number in _versions("1.0", "2.0", "2.5", "3.0", "4.0"):
            named.append(Rule(f"{label}-{version}", f"cc {letters} {number}", 1.0))
            named.append(Rule(f"{label}-{version}", f"creative commons {words} {number}", 1.0))
            named.append(Rule(f"{label}-{version}", f"creative commons {words} (?:international|unported|generic|license) {number}", 1.0))
        if len(combination) > 1:
            named.append(Rule(label, f"cc {letters}", 0.9))
        named.append(Rule(label, f"creative commons {words}", 0.85))
    for pattern in ("cc0 1 0", "cc0", "cc zero", "creative commons zero", "creative commons cc0"):
        named.append(Rule("cc0", pattern, 0.95))
    named.append(Rule("cc", "creative commons", 0.6))
    # Permissive and reciprocal licenses with versions
    for label, names, versions in (
        ("apache", ("apache license", "apache software license", "apache public license"), ("1.0", "1.1", "2.0", "2")),
        ("mpl", ("mozilla public license", "mpl"), ("1.0", "1.1", "2.0")),
        ("epl", ("eclipse public license", "epl"), ("1.0", "2.0")),
        ("cddl", ("common development and distribution license", "cddl"), ("1.0", "1.1")),
        ("cpl", ("common public license",), ("0.5", "1.0")),
        ("eupl", ("european union public license", "european union public licence", "eupl"), ("1.0", "1.1", "1.2")),
        ("osl", ("open software license", "osl"), ("1.0", "1.1", "2.0", "2.1", "3.0")),
        ("afl", ("academic free license", "afl"), ("1.1", "1.2", "2.0", "2.1", "3.0")),
        ("artistic", ("artistic license",), ("1.0", "2.0")),
        ("bsl", ("boost software license",), ("1.0",)),
        ("ms-pl", ("microsoft public license",), ("1.0",)),
        ("odbl", ("open database license", "odbl"), ("1.0",)),
        ("ofl", ("sil open font license", "open font license", "ofl"), ("1.0", "1.1")),
        ("zpl", ("zope public license",), ("1.1", "2.0", "2.1")),
        ("python", ("python software foundation license", "python license"), ("2", "2.0")),
        ("php", ("php license",), ("3.0", "3.01")),
        ("w3c", ("w3c software license",), ("2", "2015")),
        ("lppl", ("latex project public license", "lppl"), ("1.0", "1.1", "1.2", "1.3")),
        ("cecill", ("cecill license", "cecill"), ("1.0", "2.0", "2.1")),
        ("openssl", ("openssl license",), ("1.0",)),
        ("bsl-1.1", ("business source license",), ("1.1",)),
        ("sspl", ("server side public license",), ("1",)),
        ("unicode", ("unicode license",), ("3",)),
    ):
        for name in names:
            for version, number in _versions(*versions):
                named.append(Rule(f"{label}-{version}", rf"{name} (?:version |v )?{number}", 1.0))
                named.append(Rule(f"{label}-{version}", rf"{name} v{number}", 1.0))
            if " " in name:
                named.append(Rule(label, name, 0.85))
    for n, word in (("0", "zero"), ("2", "two"), ("3", "three"), ("4", "four")):
        for pattern in (f"bsd {n} clause", f"bsd {word} clause", f"{n} clause bsd", f"{word} clause bsd"):
            named.append(Rule(f"bsd-{n}-clause", rf"{pattern}(?: license)?", 0.95))
    for label, phrases in {
        "mit": ("mit license", "license mit", "licensed under the mit", "released under the mit", "permission is hereby granted free of charge to any person obtaining a copy"),
        "bsd": ("bsd license", "bsd style license", "redistribution and use in source and binary forms with or without modification are permitted"),
        "isc": ("isc license", "permission to use copy modify and or distribute this software for any purpose"),
        "zlib": ("zlib license", "zlib libpng license"),
        "unlicense": ("the unlicense", "this is free and unencumbered software released into the public domain"),
        "wtfpl": ("wtfpl", "do what the fuck you want to public license"),
        "public-domain": ("public domain", "released into the public domain", "dedicated to the public domain"),
        "apache-2.0": ("licensed under the apache license version 2 0", "apache 2 0", "apache2"),
        "gpl": ("licensed under the gpl", "license gpl", "gnu gpl", "gnu general public"),
        "proprietary": ("proprietary and confidential", "confidential and proprietary", "unauthorized copying of this file", "may not be reproduced", "no part of this publication may be reproduced"),
        "reserved": ("copyright c all rights reserved", r"copyright (?:c )?(?:19|20)\d\d(?: \S+){1,4} all rights reserved", "tous droits reserves", "alle rechte vorbehalten", "todos los derechos reservados", "tous droits réservés"),
        "copyright": (r"copyright (?:c )?(?:19|20)\d\d", r"(?:c|©) (?:19|20)\d\d", "copyright c"),
        "license-tag": (r"spdx license identifier \S+", r"license \S+ 2 0"),
    }.items():
        for phrase in phrases:
            named.append(Rule(label, phrase, 0.8 if label not in ("copyright", "license-tag") else 0.4))
    # longer patterns are more specific: they come first among the rules that are not base
    named.sort(key=lambda r: (-r.score, -len(r.pattern)))
    seen: set[tuple[str, str]] = set()
    unique = [r for r in named if not ((r.label, r.pattern) in seen or seen.add((r.label, r.pattern)))]
    return unique + rules


def _spelled(keyword: str) -> list[str]:
    if keyword.startswith("(?:") and keyword.endswith(")"):
        return keyword[3:-1].split("|")
    return [keyword]


def most_words(pattern: str) -> int:
    """Words of the longest match of a pattern, optional parts included."""

    def spaces(i: int) -> tuple[int, int]:
        longest = here = 0
        while i < len(pattern) and pattern[i] != ")":
            if pattern[i] == "|":
                longest, here, i = max(longest, here), 0, i + 1
                continue
            if pattern.startswith("(?:", i):
                n, i = spaces(i + 3)
                i += 1
            elif pattern[i] in "([.^$" or re.match(r"\\[^Sd]", pattern[i:]):
                raise ValueError(f"no bound on the words of {pattern}")
            else:
                n, i = int(pattern[i] == " "), i + (2 if pattern[i] == "\\" else 1)
            often = re.match(r"\?|\{(?:\d+,)?(\d+)\}|[*+]|\{", pattern[i:])
            if often:
                if n and often[0] in ("*", "+", "{"):
                    raise ValueError(f"no bound on the words of {pattern}")
                n, i = n * int(often[1] or 1), i + often.end()
            here += n
        return max(longest, here), i

    return spaces(0)[0] + 1


def words_of(text: Column) -> Column:
    """Words after lower-casing A-Z only."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


#: Each rule needs a word that starts with one of these (checked against the rules).
GATES = (
    "afl", "agpl", "apache", "bsd", "cc", "cddl", "cecill", "confidential", "copyright", "creative", "droits", "epl", "eupl", "fdl",
    "gpl", "lgpl", "licen", "lppl", "mpl", "odbl", "ofl", "osl", "permission", "public", "redistribution", "released", "reproduced",
    "reserv", "rights", "spdx", "unauthorized", "unlicen", "vorbehalten", "wtfpl",
)
_YEAR = r"(?:c|©) (?:19|20)\d\d"
_MARK = "\x01"
_NOT_WORD = "".join(rf"\x{c:02X}" for c in range(128) if not chr(c).isalnum())  # single characters: a class of them is one look-up


def _trie(words: list[str]) -> str:
    """A pattern of some words that tries each letter once."""
    if words == [""]:
        return ""
    heads = {w[0]: sorted({x[1:] for x in words if x and x[0] == w[0]}) for w in words if w}
    inner = "|".join(head + _trie(rest) for head, rest in sorted(heads.items()))
    return f"(?:{inner})" + ("?" if "" in words else "")


def check_gates(rules: list[Rule]) -> None:
    """Raises for a rule that could match without a gate: optional parts and alternatives don't count."""
    for r in rules:
        fixed = r.pattern
        while (less := re.sub(r"\(\?:[^()]*\)(?:\?|\{[\d,]+\})?", " ", fixed)) != fixed:
            fixed = less
        if r.pattern != _YEAR and not any(w.startswith(GATES) for w in re.findall(r"[^\s?]+(?!\S*\?)", fixed)):
            raise ValueError(f"no gate for {r.pattern}")


def marks_of(text: Column) -> Column:
    """A mark for each word, followed by the gate that it starts with (or the c before a year).

    One pass counts the words and tells whether any rule can match.
    """
    gate = rf"(?:{_trie(sorted(GATES))}|[c©](?=[{_NOT_WORD}]++(?:19|20)\d\d))"
    # the word at the end leaves no tail without a word
    return F.regexp_replace(F.concat(text, F.lit(" 0")), rf"[{_NOT_WORD}]*+(?=[^{_NOT_WORD}])((?i:{gate}))?+[^{_NOT_WORD}]*+", f"{_MARK}$1")


def _literal(pattern: str) -> str:
    """The plain text that a pattern starts with."""
    plain = re.match(r"[a-z0-9 ]*", pattern)[0]
    return plain[:-1] if pattern[len(plain) : len(plain) + 1] in ("?", "*") else plain


def detections(words: Column, rules: list[Rule]) -> Column:
    """Array of (start, end, label, score, base, priority): every match of a rule, before suppression."""
    by_word: dict[str, list] = {}
    for i, r in enumerate(rules):
        rule = {"literal": _literal(r.pattern), "pattern": rf"^(?:{r.pattern})(?= |$)", "label": r.label, "score": r.score, "base": r.base, "priority": i}
        for word in _spelled(r.keyword):
            by_word.setdefault(word, []).append(rule)
    # the rules are fixed by build_rules(), some hundreds of them: a constant of the plan
    listed = F.from_json(F.lit(json.dumps(by_word)), "map<string, array<struct<literal: string, pattern: string, label: string, score: double, base: boolean, priority: int>>>")
    span = max(most_words(r.pattern) for r in rules)  # words that a rule may look at, from its place

    def at_place(w: Column, i: Column) -> Column:
        def tried(ahead: Column) -> Column:
            hits = F.transform(
                F.filter(F.element_at(listed, F.get(w, i)), lambda r: F.startswith(ahead, r["literal"])),
                lambda r: F.struct(r.alias("rule"), F.regexp_substr(ahead, r["pattern"]).alias("match")),
            )
            return F.transform(
                F.filter(hits, lambda h: h["match"].isNotNull()),
                lambda h: F.struct(
                    i.cast("long").alias("start"),
                    (i + F.size(F.split(h["match"], " ")) - 1).cast("long").alias("end"),
                    *(h["rule"][k].alias(k) for k in ("label", "score", "base", "priority")),
                ),
            )

        return let(F.array_join(F.slice(w, i + 1, span), " "), tried)

    def of_words(w: Column) -> Column:
        places = F.filter(F.transform(w, lambda x, i: F.when(x.isin(sorted(by_word)), i)), lambda i: i.isNotNull())
        return F.flatten(F.transform(places, lambda i: at_place(w, i)))

    return let(words, of_words)


def unsuppressed(found: Column) -> Column:
    """Struct of reach, labels (distinct) and score of the detections that no other one of the text contains.

    In order of start, longer ones first, then by priority, a detection lies inside an
    earlier one exactly if some earlier end reaches its own end. Base rules are not
    suppressed here; they have their own columns.
    """
    order = F.array_sort(F.transform(F.filter(found, lambda d: ~d["base"]), lambda d: F.struct(d["start"], (-d["end"]).alias("back"), d["priority"], d["label"], d["score"])))
    nothing = F.struct(F.lit(-1).cast("long").alias("reach"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))

    def step(acc: Column, d: Column) -> Column:
        kept = F.struct((-d["back"]).alias("reach"), F.array_union(acc["labels"], F.array(d["label"])).alias("labels"), F.greatest(acc["score"], d["score"]).alias("score"))
        return F.when(-d["back"] > acc["reach"], kept).otherwise(acc)

    return F.aggregate(order, nothing, step)


def scan(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """`docs` with n_words, n_base, first_word, last_word, base_labels, labels, score.

    Columns of these names are replaced. A null text is empty: no words, empty labels,
    score 0. Each row is judged alone and by itself, whatever its doc_id, so repeated rows
    get equal answers; a text of any length is searched whole; an empty table gives an
    empty result.
    """
    rules = rules or build_rules()
    check_gates(rules)
    added = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    taken = {*docs.columns, *added}
    text, marks, gates, found, base, other = (unused(c, taken) for c in ("plain", "marks", "gates", "found", "base", "other"))
    rows = docs.drop(*added).withColumn(text, clean_text()).withColumn(marks, marks_of(F.col(text)))
    rows = rows.withColumn(gates, F.replace(marks, F.lit(_MARK), F.lit("")))
    words = F.when(F.col(gates) != "", words_of(F.col(text))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn(found, detections(words, rules))
    rows = rows.withColumn(base, F.filter(found, lambda d: d["base"])).withColumn(other, unsuppressed(F.col(found)))
    own = F.array_distinct(F.transform(base, lambda d: d["label"]))
    starts = F.transform(base, lambda d: d["start"])
    return rows.select(
        *(c for c in docs.columns if c not in added),
        (F.length(marks) - F.length(gates) - 1).cast("long").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(own), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(own, F.col(other)["labels"])), ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max(F.transform(base, lambda d: d["score"])), F.lit(0.0)), F.col(other)["score"]).alias("score"),
    )


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
