"""Joins on a key that may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than one in this many rows; so there are fewer hot keys than this.
HOT_ONE_IN = 1000


def hot_keys(counts: DataFrame, key: str, n: str, total: int, one_in: int = HOT_ONE_IN) -> DataFrame:
    """The keys of ``counts`` (key, n) with more than ``total / one_in`` rows: fewer than ``one_in``."""
    return counts.where(F.col(n) > total / one_in).select(key).distinct()


def hot_join(left: DataFrame, right: DataFrame, on: list[str], hot_on: str, hot: DataFrame, how: str = "inner", grows: bool = False) -> DataFrame:
    """``left`` join ``right``, where hot values of ``hot_on`` never go through one task.

    ``hot`` has fewer than :data:`HOT_ONE_IN` values (see :func:`hot_keys`) and
    ``right`` few rows for each, so rows of hot keys meet a broadcast side and
    stay where they are; all others are joined by a shuffle. ``how`` is inner
    or left. With ``grows`` the rest of ``right`` is never broadcast, not even
    where statistics find it small.
    """
    mark = F.broadcast(hot.select(F.col(hot_on).alias("_hot")).distinct())
    flagged = left.join(mark, left[hot_on] == mark["_hot"], "left")
    is_hot = F.col("_hot").isNotNull()
    few = right.join(mark, right[hot_on] == mark["_hot"], "left_semi")
    some = flagged.where(is_hot).drop("_hot").join(F.broadcast(few), on, how)
    rest = flagged.where(~is_hot).drop("_hot").join(right.hint("merge") if grows else right, on, how)
    return some.unionByName(rest)
