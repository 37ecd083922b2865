"""File events: change kinds, debouncing, project roots, and the streams that carry them.

The watermark (ten minutes of event time) bounds the state: an event that is
later than that is dropped, and state older than that is given up.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.functions import text as X
from tessera.session import shared_dir

WATERMARK = "10 minutes"


def change_kind(c: Column | str) -> Column:
    """Created and deleted as they are, everything else modified."""
    c = F.lower(F.col(c) if isinstance(c, str) else c)
    return F.when(c.isin("created", "deleted"), c).otherwise("modified")


def with_renames(events: DataFrame) -> DataFrame:
    """T4: an event with old_path queues both paths; the others one."""
    paths = F.filter(F.array("old_path", "path"), lambda p: p.isNotNull())
    rest = [c for c in events.columns if c not in ("path", "old_path")]
    return events.select(*rest, F.explode(F.array_distinct(paths)).alias("path"))


def leading_debounce(events: DataFrame, key: str, ts: str, micros_gap: int) -> DataFrame:
    """T1, batch form: the events at least ``micros_gap`` microseconds after the last accepted one of their key.

    ``ts`` is a long in microseconds. Each partition is read in order of key and
    time and keeps one number, the last accepted time, from which a binary
    search leads to the next; memory does not follow the size of a key, and
    though one key's events are decided one after another, the work follows the
    number of those accepted. Events without a key or time are dropped.
    """
    schema = events.schema
    ordered = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).repartition(key).sortWithinPartitions(key, ts)

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_key, last = None, 0
        for p in pdfs:
            key_of, times = p[key].to_numpy(object), p[ts].to_numpy(np.int64)
            keep = np.zeros(len(p), bool)
            first = np.flatnonzero(np.append(True, key_of[1:] != key_of[:-1])) if len(p) else np.zeros(0, int)
            for lo, hi in zip(first, np.append(first[1:], len(p)), strict=True):
                mine = times[lo:hi]
                at = int(np.searchsorted(mine, last + micros_gap)) if key_of[lo] == last_key else 0
                while at < len(mine):  # from one accepted event to the next
                    keep[lo + at] = True
                    last = int(mine[at])
                    at = max(at + 1, int(np.searchsorted(mine, last + micros_gap)))
                last_key = key_of[lo]
            yield p[keep]

    return ordered.mapInPandas(run, schema)


def leading_debounce_stream(events: DataFrame, key: str, ts: str, micros_gap: int) -> DataFrame:
    """T1 on a stream: key, ts of the accepted events; the state of a key is its last accepted time.

    Events of one micro-batch are taken in order of time; one that comes in a
    later batch than an accepted newer one is dropped.
    """

    def step(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for t in sorted(t for p in pdfs for t in p[ts]):
            if last is None or t - last >= micros_gap:
                out.append(int(t))
                last = int(t)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame([(k[0], t) for t in out], columns=[key, ts])

    kind = events.schema[key].dataType.simpleString()
    x = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(key, ts)
    return x.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {ts} long", "last long", "append", GroupStateTimeout.NoTimeout)


def trailing_debounce(events: DataFrame, ts: str, gap: str, path: str, *keys: str) -> DataFrame:
    """first_at, last_at, n, paths (distinct, sorted) of each burst of events that ``gap`` of quiet ends; batch or stream."""
    source = events.withWatermark(ts, WATERMARK) if events.isStreaming else events
    w = F.session_window(ts, gap)
    out = source.groupBy(*keys, w).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(path)).alias("paths"), F.max(ts).alias("last_at"))
    return out.select(*keys, F.col("session_window.start").alias("first_at"), "last_at", "n", "paths")


def project_roots(files: DataFrame, markers: DataFrame) -> DataFrame:
    """Path, root: the nearest directory above a file that holds a marker (column directory); null where there is none.

    Every file is spread over its own ancestors, and these meet the markers by a join.
    """
    parts = F.split(X.slashes("path"), "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    x = files.select("path").distinct().select("path", F.posexplode(ancestors).alias("depth", "directory"))
    hit = x.join(markers.select(X.slashes("directory").alias("directory")).distinct(), "directory").groupBy("path").agg(F.max(F.struct("depth", "directory")).alias("m"))
    return files.select("path").distinct().join(hit, "path", "left").select("path", F.col("m.directory").alias("root"))


def run_jobs(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> list[tuple[int, str]]:
    """Every micro-batch is one job, one after another; a job that fails is noted and the next goes on. Returns (batch, error).

    Runs what is there and ends; the checkpoint remembers what was taken.
    """
    failed: list[tuple[int, str]] = []

    def one(batch: DataFrame, number: int) -> None:
        try:
            work(batch, number)
        except Exception as e:  # isolated: the queue goes on
            failed.append((number, str(e)[:200]))

    at = checkpoint or f"{shared_dir(stream.sparkSession)}/tessera-stream-{uuid.uuid4().hex}"
    stream.writeStream.foreachBatch(one).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    return failed


def collected(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a finite stream gives, as a table: each micro-batch is written to its own folder (the last one counts in complete mode)."""
    spark = stream.sparkSession
    folder = f"{shared_dir(spark)}/tessera-collected-{uuid.uuid4().hex}"
    numbers: list[int] = []

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/b{number}")
        numbers.append(number)

    stream.writeStream.outputMode(mode).foreachBatch(one).option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start().awaitTermination()
    wanted = numbers[-1:] if mode == "complete" else sorted(set(numbers))
    return spark.read.schema(stream.schema).parquet(*[f"{folder}/b{n}" for n in wanted]) if wanted else spark.createDataFrame([], stream.schema)


def landing(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """JSON payloads that appear in a folder. After an overflow the checkpoint knows what was taken, and a new listing finds the rest."""
    return spark.readStream.schema(schema).json(folder)
