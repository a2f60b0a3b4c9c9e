"""Text similarity that built-in functions lack, in Arrow batches."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The matching-blocks ratio of two texts; 0 if either is null."""
    return pd.Series([0.0 if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def at_least(a: str | None, b: str | None, least: float) -> bool:
    """Whether two texts, none empty, have that ratio; its upper bounds are asked first."""
    if not a or not b:
        return False
    m = SequenceMatcher(None, a, b)
    return m.real_quick_ratio() >= least and m.quick_ratio() >= least and m.ratio() >= least


def can_reach(a: Column, b: Column, least: float) -> Column:
    """Whether the lengths alone allow that ratio: twice the shorter over both."""
    return 2 * F.least(F.length(a), F.length(b)) >= least * (F.length(a) + F.length(b))


def within(a: Column, b: Column, least: float) -> Column:
    """Whether lengths and edits allow that ratio: each unmatched character is one edit at most, so that few may be needed."""
    few = F.floor((1 - least) * (F.length(a) + F.length(b)) + 1e-6).cast("int")
    return can_reach(a, b, least - 1e-9) & (F.call_function("levenshtein", a, b, few) >= 0)
