"""Other spellings of a JSON text that a lenient reader must take alike, at any depth and without a schema.

A text is cut into tokens (strings whole, so nothing inside them is taken for structure),
tokens are rewritten, and the text is put together again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKENS = r'("(?:[^"\\]|\\.)*"|[{}\[\]:,]|[^"{}\[\]:,\s]+)'
NUMBER = r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$"


def json_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKENS), F.lit(1))


def sorted_keys(text: Column) -> Column:
    """Keys of every object in alphabetical order."""
    return F.to_json(F.parse_json(text))


def _rewritten(text: Column, change: Callable[[Column, Column, Column], Column]) -> Column:
    """The text with each token replaced by change(tokens, token, its place); a text is cut into tokens once, not once a token."""
    rewritten = lambda tokens: F.array_join(F.transform(tokens, lambda t, i: change(tokens, t, i)), "")
    return F.get(F.transform(F.array(json_tokens(text)), rewritten), F.lit(0))


def with_unknown_fields(text: Column, name: str = "_unknown") -> Column:
    """A field that no schema knows, first in every object."""
    field = f'"{name}":[{{}},null]'
    added = lambda follows: F.concat(F.lit("{" + field), F.when(follows == "}", "").otherwise(","))
    return _rewritten(text, lambda tokens, t, i: F.when(t == "{", added(F.get(tokens, i + 1))).otherwise(t))


def with_quoted_numbers(text: Column) -> Column:
    """Every number as a string."""
    return _rewritten(text, lambda _, t, i: F.when(t.rlike(NUMBER), F.concat(F.lit('"'), t, F.lit('"'))).otherwise(t))
