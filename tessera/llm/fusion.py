"""One ranking from scores of different scales: reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.rank import grouped_rank
from tessera.session import materialize

#: The constant added to each rank.
RRF_K = 60


def clean_hits(hits: DataFrame) -> DataFrame:
    """query_id, src, fqn, best: each item once a source, with its best score.

    source is compared without case and surrounding blanks; a null or blank
    source is one source of its own, ''. Hits without a score (null or NaN),
    query or item do not count; infinite scores do.
    """
    src = F.coalesce(F.lower(F.regexp_replace("source", r"^\s+|\s+$", "")), F.lit(""))
    rows = hits.where(F.col("score").isNotNull() & ~F.isnan("score") & F.col("query_id").isNotNull() & F.col("fqn").isNotNull())
    return rows.groupBy("query_id", src.alias("src"), "fqn").agg(F.max("score").alias("best"))


def fuse(hits: DataFrame, k: int = RRF_K) -> DataFrame:
    """query_id, fqn, rrf_score, n_sources: the sum of 1 / (k + rank) over the sources that returned the item.

    Ranks come from each source of a query separately; equal scores share the
    best rank of their tie, so unit, range and shape of a score have no say.
    Works for a query or source of any size, see
    :func:`tessera.operators.rank.grouped_rank`. An empty input gives no rows.
    """
    best = materialize(clean_hits(hits), "best-hits")
    ranked = grouped_rank(best, ["query_id", "src"], "best")
    return ranked.groupBy("query_id", "fqn").agg(F.sum(1.0 / (F.lit(float(k)) + F.col("rank"))).alias("rrf_score"), F.count(F.lit(1)).alias("n_sources"))


def fused_top(hits: DataFrame, top: int, k: int = RRF_K) -> DataFrame:
    """The ``top`` items of each query by fused score; ties go to the smaller fqn.

    The limit is applied inside each task before the shuffle, so a query that
    holds a third of the items stays cheap.
    """
    order = Window.partitionBy("query_id").orderBy(F.round("rrf_score", 12).desc(), F.col("fqn"))
    return fuse(hits, k).withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
