"""Ranks within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.hotjoin import hot_join, hot_keys
from tessera.session import materialize

#: Quantile buckets that a group is split into before rows are ordered.
BUCKETS = 64
#: Rows that the largest group may have to be ordered by one task.
WHOLE_ROWS = 100_000


def grouped_rank(df: DataFrame, group: list[str], score: str, name: str = "rank", buckets: int = BUCKETS, whole: int = WHOLE_ROWS) -> DataFrame:
    """``df`` with the competition rank of ``score`` (highest first) inside ``group``; equal scores share a rank.

    Exact for groups of any size and skew. If a count proves that no group has
    more than ``whole`` rows, one window ranks them. Else equal scores are first reduced to
    one row with a count; the distinct scores of a group are cut into quantile
    buckets, and the rank is the number of rows in higher buckets plus the rank
    inside the bucket. So no task orders more than about one bucket of a group,
    and hot groups and hot ties meet their few rows by broadcast.
    ``score`` and the group columns must not be null; repeated rows count. The
    result has the columns of ``df`` and ``name`` (long).
    """
    largest = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_k")).agg(F.coalesce(F.max("_k"), F.lit(0))).first()[0]
    if largest <= whole:
        return df.withColumn(name, F.rank().over(Window.partitionBy(*group).orderBy(F.col(score).desc())).cast("long"))
    of_group, of_tie = F.xxhash64(*group), F.xxhash64(*group, score)
    tied = materialize(df.groupBy(*group, score).agg(F.count(F.lit(1)).alias("_n")).withColumn("_g", of_group).withColumn("_t", of_tie), "ties")
    groups = tied.groupBy("_g").agg(F.count(F.lit(1)).alias("_k"))
    totals = tied.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    hot_groups = materialize(hot_keys(groups, "_g", "_k", totals[0]), "hot-groups")
    hot_ties = materialize(hot_keys(tied, "_t", "_n", totals[1]), "hot-ties")
    cuts = tied.groupBy(*group).agg(F.percentile_approx(score, [i / buckets for i in range(1, buckets)], 1000).alias("_cuts")).withColumn("_g", of_group)
    placed = hot_join(tied, cuts, [*group, "_g"], "_g", hot_groups)
    placed = placed.withColumn("_b", F.aggregate("_cuts", F.lit(0), lambda acc, c: acc + (c < F.col(score)).cast("int"))).drop("_cuts")
    sizes = placed.groupBy(*group, "_g", "_b").agg(F.sum("_n").alias("_size"))
    per_group = Window.partitionBy(*group).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_above", F.coalesce(F.sum("_size").over(per_group), F.lit(0))).drop("_size")
    in_bucket = Window.partitionBy(*group, "_b").orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranks = placed.withColumn("_in", F.coalesce(F.sum("_n").over(in_bucket), F.lit(0)))
    ranks = hot_join(ranks, offsets, [*group, "_g", "_b"], "_g", hot_groups)
    ranks = ranks.select(*group, score, "_t", (F.col("_above") + F.col("_in") + 1).alias(name))
    return hot_join(df.withColumn("_t", of_tie), ranks, [*group, score, "_t"], "_t", hot_ties).drop("_t")


def numbered(df: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """``df`` with its row number in an order of columns, from 1.

    Rows are spread by ranges of the order and counted range by range, so no
    task holds all rows; the counts, one for each range, meet in one. Equal
    rows are numbered in any order.
    """
    placed = materialize(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "numbered")
    counts = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    upper = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_p", F.coalesce(F.sum("_n").over(upper), F.lit(0)).alias("_before"))
    local = placed.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    return local.join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + F.col("_i")).drop("_p", "_i", "_before")
