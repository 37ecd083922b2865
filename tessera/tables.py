"""Readers of the fixed tables and the views several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    c = F.col(c) if isinstance(c, str) else c
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def blank(c: Column | str) -> Column:
    """True for null and for text without a visible character."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.regexp_replace(c, r"^\s+|\s+$", "") == "", F.lit(True))


def current_rows(symbols: DataFrame, *columns: str) -> DataFrame:
    """One row for each fqn: the one with the latest indexed_at, then the largest id.

    Rows without an fqn are no symbols. A null indexed_at counts as earliest.
    The maximum of a struct is combined before the shuffle, so an fqn that holds
    a third of all rows costs its reducer one row for each input task.
    """
    rest = [c for c in columns if c not in ("fqn", "indexed_at", "id")]
    packed = F.struct("indexed_at", "id", *rest)
    out = symbols.where(F.col("fqn").isNotNull()).groupBy("fqn").agg(F.max(packed).alias("_cur"))
    return out.select("fqn", *[F.col(f"_cur.{c}").alias(c) for c in ("indexed_at", "id", *rest)])


def live_rows(symbols: DataFrame, *columns: str) -> DataFrame:
    """The current rows that are not deleted."""
    wanted = ("deleted_at", *[c for c in columns if c != "deleted_at"])
    return current_rows(symbols, *wanted).where(F.col("deleted_at").isNull())
