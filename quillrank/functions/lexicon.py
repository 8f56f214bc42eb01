"""Term lists as data, compiled to one expression per list.

A term with a space, a hyphen, a digit or more than four characters matches as a plain
substring; a shorter one only between characters that are neither letter, digit nor
underscore (spelled out, so that any SQL engine agrees on letters beyond ASCII).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LEFT, RIGHT = r"(^|[^\p{L}\p{N}_])", r"([^\p{L}\p{N}_]|$)"
TOKEN = r"[a-z0-9+#./-]+"


def _escape(term: str) -> str:
    return re.sub(r"([.^$*+?()\[\]{}|\\])", r"\\\1", term)


def pattern(term: str) -> str:
    loose = len(term) > 4 or bool(re.search(r"[\s\d-]", term))
    return _escape(term) if loose else f"{LEFT}{_escape(term)}{RIGHT}"


def any_of(text: Column, terms: list[str] | tuple[str, ...]) -> Column:
    """True if at least one term is present."""
    return F.lower(text).rlike("|".join(map(pattern, terms))) if terms else F.lit(False)


def count_of(text: Column, terms: list[str] | tuple[str, ...]) -> Column:
    """Number of terms that are present (not of occurrences: terms may overlap)."""
    return reduce(lambda a, b: a + b, (F.lower(text).rlike(pattern(t)).cast("int") for t in terms), F.lit(0))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def first_clause(text: Column, least: int = 4, most: int = 14) -> Column:
    """Up to `most` words before the first full stop or semicolon; null below `least` words."""
    clause = F.trim(F.regexp_replace(F.get(F.split(text, "[.;]"), F.lit(0)), r"\s+", " "))
    words = F.split(clause, " ")
    return F.when((F.length(clause) > 0) & (F.size(words) >= least), F.array_join(F.slice(words, 1, most), " "))


def bucket(text: Column, groups: dict[str, list[str]], default: str) -> Column:
    """Name of the first group that has a term in the text (plain substrings)."""
    out = F.lit(default)
    for name, terms in reversed(list(groups.items())):
        out = F.when(F.lower(text).rlike("|".join(map(_escape, terms))), F.lit(name)).otherwise(out)
    return out


def seniority(title: Column, levels: dict[str, float]) -> Column:
    """0.5, or the best level whose key is in the title; keys below 0.5 never lower it."""
    hits = [F.when(F.lower(title).contains(k), F.lit(v)) for k, v in levels.items()]
    return F.greatest(F.lit(0.5), F.lit(0.5), *hits)
