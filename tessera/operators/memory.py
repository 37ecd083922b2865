"""Scoped memories with decay: validation, recall, listing, forgetting, reaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions import text as X
from tessera.operators.lexical import cosine_to
from tessera.operators.store import VersionedTable
from tessera.session import materialize, scratch_dir
from tessera.tables import micros

#: A memory whose score falls below this is no longer recalled, and is reaped.
FLOOR = 0.1
# Scopes and topics.
SCOPES = ("session", "project", "global")
TOPICS = ("preference", "pattern", "decision", "bug", "todo", "note")


def scope() -> Column:
    return F.lower(F.trim("scope"))


def validity() -> Column:
    """Why a memory can't be saved, null if it can."""
    n = F.length(F.trim(F.coalesce("content", F.lit(""))))
    return (
        F.when(~F.coalesce(scope().isin(*SCOPES), F.lit(False)), "scope")
        .when((scope() != "global") & (F.trim(F.coalesce("scope_id", F.lit(""))) == ""), "scope_id")
        .when(F.col("topic").isNotNull() & ~F.col("topic").isin(*TOPICS), "topic")
        .when(~n.between(1, 4000), "content")
        .when(~F.coalesce(F.col("importance").between(0, 1), F.lit(False)), "importance")
        .when(X.has_secret("content"), "secret")
    )


def save(memories: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M1, M9: the table with the valid new rows appended, and the rejected rows with their reason."""
    judged = new.withColumn("reason", validity())
    good = judged.where(F.col("reason").isNull()).drop("reason").withColumn("scope", scope())
    return memories.unionByName(good.select(*memories.columns)), judged.where(F.col("reason").isNotNull())


def scored(memories: DataFrame, now: Column) -> DataFrame:
    """The table with score: importance weakened by the time since the last access; a null importance scores null."""
    age = (micros(now) - micros("last_accessed_at")) / 1e6
    return memories.withColumn("score", F.round(X.decay_score("importance", age, X.decay_days("scope", "topic")), 6))


def selected(memories: DataFrame, in_scope: str | None = None, scope_id: str | None = None, topic: str | None = None, fqn: str | None = None) -> DataFrame:
    """Optional filters; ``fqn`` must be among the related ones."""
    out = memories
    if in_scope is not None:
        out = out.where(scope() == in_scope)
    if scope_id is not None:
        out = out.where(F.col("scope_id") == scope_id)
    if topic is not None:
        out = out.where(F.col("topic") == topic)
    if fqn is not None:
        out = out.where(F.array_contains("related_fqns", fqn))
    return out


def recall(memories: DataFrame, now: Column, limit: int = 10, query: list[float] | None = None, **filters: str) -> DataFrame:
    """Id, score, weight of the memories above the floor, the best first.

    Ordered by score times cosine similarity to the query vector (0.5 where a
    memory has no usable vector), or by score alone; ``score`` is the decay
    score, ``weight`` what the order follows. limit is 1 to 50.
    """
    x = selected(scored(memories, now), **filters).where(F.col("score") >= FLOOR)
    weight = F.col("score")
    if query is not None:
        weight = weight * F.coalesce(cosine_to("embedding", query), F.lit(0.5))
    x = x.select("id", "score", F.round(weight, 6).alias("weight"))
    return x.orderBy(F.col("weight").desc(), "id").limit(max(1, min(50, limit)))


def touched(memories: DataFrame, recalled: DataFrame, now: Column) -> DataFrame:
    """M3: the table with the access counted and dated on the recalled rows (id)."""
    hit = recalled.select("id").distinct().withColumn("_hit", F.lit(True))
    x = memories.join(F.broadcast(hit), "id", "left")
    return x.withColumn("access_count", F.when(F.col("_hit"), F.coalesce("access_count", F.lit(0)) + 1).otherwise(F.col("access_count"))).withColumn(
        "last_accessed_at", F.when(F.col("_hit"), now).otherwise(F.col("last_accessed_at"))
    ).drop("_hit")


def listed(memories: DataFrame, limit: int = 100, **filters: str) -> DataFrame:
    """M4: all memories that the filters keep, decayed ones too, the most important and last used first; limit 1 to 500."""
    return selected(memories, **filters).orderBy(F.col("importance").desc_nulls_last(), F.col("last_accessed_at").desc_nulls_last(), "id").limit(max(1, min(500, limit)))


def without_session(memories: DataFrame, session: str) -> DataFrame:
    """M6: the table without the rows of a session."""
    return memories.where(~F.coalesce((scope() == "session") & (F.col("scope_id") == session), F.lit(False)))


def reaped(memories: DataFrame, now: Column) -> DataFrame:
    """M7: the table without the rows below the floor; rows without a score stay."""
    return scored(memories, now).where(~F.coalesce(F.col("score") < FLOOR, F.lit(False))).drop("score")


def under_ceiling(memories: DataFrame, now: Column, ceiling: int) -> DataFrame:
    """The ``ceiling`` best rows of each scope and scope id; the limit is applied inside each task first."""
    w = Window.partitionBy(F.lower(F.trim("scope")), "scope_id").orderBy(F.col("score").desc_nulls_last(), "id")
    return scored(memories, now).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= ceiling).drop("_k")


def reaper(memories: VersionedTable, every: str = "1 hour", now: Column | None = None, once: bool = False) -> StreamingQuery:
    """M8: a running query that reaps the current state of a table, at once and then on a schedule; with ``once`` it ends after one.

    A state without anything to reap is not written again; a writer that was
    first makes the reaping wait for its next turn.
    """
    at = now if now is not None else F.expr("cast(current_timestamp() AS timestamp_ntz)")

    def reap(_: DataFrame, __: int) -> None:
        state = memories.read()
        if state is None:
            return
        gone = scored(state, at).where(F.col("score") < FLOOR).limit(1).count()
        if gone:
            try:
                memories.write(reaped(state, at))
            except RuntimeError:
                pass

    spark = memories.spark
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
    out = ticks.writeStream.foreachBatch(reap).option("checkpointLocation", scratch_dir(spark, "reaper"))
    return (out.trigger(once=True) if once else out.trigger(processingTime=every)).start()


def tool(memories: DataFrame, action: str, now: Column, **given) -> tuple[DataFrame, DataFrame]:
    """M9: one memory tool: the table after it, and what it answers.

    save (rows): id and reason of each row, null where it was saved; recall
    (limit, query, filters): the recalled rows, whose access is counted; list
    (limit, filters): rows; forget (id) and clear (session): how many are gone.
    """
    if action == "save":
        after, rejected = save(memories, given["rows"])
        kept = given["rows"].join(rejected.select("id"), "id", "left_anti").select("id", F.lit(None).cast("string").alias("reason"))
        return after, kept.unionByName(rejected.select("id", "reason"))
    if action == "recall":
        found = materialize(recall(memories, now, **given), "recalled")
        return touched(memories, found, now), found
    if action == "list":
        return memories, listed(memories, **given)
    if action == "forget":
        after = memories.where(~F.coalesce(F.col("id") == F.lit(given["id"]), F.lit(False)))
    elif action == "clear":
        after = without_session(memories, given["session"])
    else:
        raise ValueError(f"no such tool: {action}")
    before, left = (x.agg(F.count(F.lit(1)).alias(n)) for x, n in ((memories, "before"), (after, "left")))
    return after, before.join(left, F.lit(True)).select((F.col("before") - F.col("left")).alias("gone"))
