"""Functions of the user: batch scorers on Arrow batches, and named rules that build columns."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_rules: dict[str, Callable[..., Column]] = {}


def score_with(df: DataFrame, function: Callable[[pd.DataFrame], list[float]], batch_rows: int = 1024) -> DataFrame:
    """All columns plus ``score``: the function gets at most so many rows and returns one number each, in their order.

    A wrong number of scores, or one that is no number between 0 and 1, is an error. Rows keep their columns, so the key tells their order.
    """
    names = [c for c in df.columns if c != "score"]

    def run(frames):
        for frame in frames:
            for at in range(0, len(frame), batch_rows):
                part = frame.iloc[at : at + batch_rows].reset_index(drop=True)
                scores = pd.Series(list(function(part)), dtype=float)
                if len(scores) != len(part) or not scores.between(0, 1).all():
                    raise ValueError("a scorer must give one score between 0 and 1 for each row")
                yield part.assign(score=scores)

    df = df.select(*[F.col(f"`{c}`") for c in names])
    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType())]))


def register_rule(name: str, rule: Callable[..., Column]) -> None:
    """Name a function that builds a column; a name is given once."""
    if name in _rules and _rules[name] is not rule:
        raise ValueError(f"the rule {name} exists")
    _rules[name] = rule


def rule(name: str, *args) -> Column:
    """The column that a named rule builds."""
    if name not in _rules:
        raise KeyError(f"no rule {name}; there are {sorted(_rules)}")
    return _rules[name](*args)
