"""Progress events of long runs, kept as small files that readers follow as a stream."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from tessera.operators.incremental import publish

EVENT = "run_id string, seq long, phase string, done long, total long, message string"


class Progress:
    """The events of one run; each is a file of its own that appears whole, so a reader never sees half of one."""

    def __init__(self, spark: SparkSession, folder: str, run_id: str):
        self.spark, self.folder, self.run_id, self.seq = spark, folder.rstrip("/"), run_id, 0

    def tell(self, phase: str, done: int = 0, total: int = 0, message: str | None = None) -> None:
        event = {"run_id": self.run_id, "seq": self.seq, "phase": phase, "done": done, "total": total, "message": message}
        if not publish(self.spark, json.dumps(event), self.folder, f"progress-{self.run_id}-{self.seq:08}.json"):
            raise RuntimeError(f"another writer tells of run {self.run_id}")
        self.seq += 1


def events(spark: SparkSession, folder: str) -> DataFrame:
    """All events there are, as a table."""
    return spark.read.schema(EVENT).json(f"{folder.rstrip('/')}/progress-*.json")


def follow(spark: SparkSession, folder: str) -> DataFrame:
    """The events as a stream; a reader that comes back goes on from its checkpoint."""
    return spark.readStream.schema(EVENT).option("pathGlobFilter", "progress-*.json").json(folder)
