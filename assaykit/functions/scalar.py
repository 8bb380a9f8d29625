"""Column-building functions: stable hashes, text normalisation, safe ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


def stable_digest(seed: str, *columns: Column | str) -> Column:
    """Hex SHA-256 of the seed and the columns, the sort key of every sampler."""
    return F.sha2(F.concat_ws(SEPARATOR, F.lit(seed), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]), 256)


def stable_fraction(seed: str, *columns: Column | str) -> Column:
    """A number in [0, 1) from the first 13 hex digits (52 bits) of the digest."""
    return F.conv(F.substring(stable_digest(seed, *columns), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def ratio(a: Column, b: Column) -> Column:
    """a/b as double, NULL where b is 0."""
    return F.when(b != 0, a.cast("double") / b)


def exact_mean(value: Column) -> Column:
    """The mean of doubles as decimals of twelve places: the same in whatever order they are added."""
    return F.sum(value.cast("decimal(28,12)")).cast("double") / F.count(value)


def normalised(text: Column) -> Column:
    """Lower case, runs of other than letters and digits as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def single_spaced(text: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(text, "[ \t\n\r\f\x0B]+", " "))


def squeezed(text: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed."""
    return single_spaced(F.lower(text))
