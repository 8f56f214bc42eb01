"""Scalar expressions with the engine's null, NaN and boundary rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def num(value: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.nanvl(value.cast("double"), F.lit(default)), F.lit(float(default)))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Between low and high; null becomes low, NaN becomes high (coalesce first where that matters)."""
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), x))


def ratio(part: Column, whole: Column, default: float = 0.0) -> Column:
    """part / whole where whole > 0, else the default (ANSI division never sees zero)."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(float(default)))


def parse_date(text: Column) -> Column:
    """Date from the first ten characters, Y-M-D with one or two digits; anything else is null."""
    first = F.substring(text, 1, 10)
    return F.when(first.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), first.try_cast("date"))


def months(start: Column, end: Column) -> Column:
    """Whole months by calendar month; days of the month do not count."""
    return (F.year(end) - F.year(start)) * 12 + (F.month(end) - F.month(start))


def gauss(x: Column, mean: float, sd: float) -> Column:
    return F.exp(-F.pow(x - mean, F.lit(2.0)) / (2 * sd * sd))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalised(v: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    norm = F.sqrt(dot(v, v))
    safe = F.when(norm == 0, F.lit(1.0)).otherwise(norm)
    return F.transform(v, lambda x: x.cast("double") / safe)


def prefix(v: Column, size: int) -> Column:
    """The first `size` numbers of a vector, renormalised."""
    return l2_normalised(F.slice(v, 1, size))


def min_max_stats(df: DataFrame, *names: str) -> DataFrame:
    """One row: <name>_low and <name>_high over the finite values of each column."""
    parts = []
    for n in names:
        value = F.when(~F.isnan(F.col(n).cast("double")), F.col(n).cast("double"))
        parts += [F.min(value).alias(f"{n}_low"), F.max(value).alias(f"{n}_high")]
    return df.agg(*parts)


def min_max(value: Column, low: Column, high: Column) -> Column:
    """Position between low and high, clipped to [0, 1]; a constant column is 0."""
    return F.when(high > low, clamp((value.cast("double") - low) / (high - low))).otherwise(F.lit(0.0))


def fixed(x: Column, digits: int) -> Column:
    """A number as text with so many digits after the point (0 to 3), rounded as its exact binary value says, ties to even.

    The fraction of a double times 2^52 is a whole number, so digits, remainder and ties are
    told in integers; text formatting by decimal digits would round 2.25 and 0.35 otherwise.
    """
    scale, one, half = 10**digits, 1 << 52, 1 << 51
    size = F.abs(x.cast("double"))
    whole = F.floor(size)
    shifted = (size - whole) * F.lit(float(one))
    bits = F.floor(shifted)
    left = (shifted - bits) * scale  # bits of small numbers beyond those
    scaled = bits * scale + F.floor(left)
    digit, rest = F.shiftright(scaled, 52), scaled.bitwiseAND(one - 1)
    lower = whole * scale + digit
    up = (rest > half) | ((rest == half) & ((left > F.floor(left)) | (lower % 2 == 1)))
    n = lower + up.cast("long")
    text = n.cast("string")
    if digits:
        text = F.concat(((n - n % scale) / scale).cast("long").cast("string"), F.lit("."), F.lpad((n % scale).cast("string"), digits, "0"))
    return F.concat(F.when(x < 0, "-").otherwise(""), text)


def python_int(text: Column) -> Column:
    """The digits of an id as a number; none is 0."""
    return F.coalesce(F.regexp_replace(text, r"\D", "").try_cast("bigint"), F.lit(0).cast("bigint"))


def deduped(values: Column) -> Column:
    """An array's values in order, each once."""
    return F.array_distinct(values)
