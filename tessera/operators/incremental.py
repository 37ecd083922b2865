"""Taking up only what is new or changed since the last successful run."""

from __future__ import annotations

import datetime as dt
import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import bounded, materialize, release
from tessera.tables import blank


def clean_log(log: DataFrame) -> DataFrame:
    """Rows of a hash log with a hash: paths with forward slashes, hashes trimmed and in one case."""
    return log.where(~blank("content_hash")).select(
        "repo_id",
        F.translate("file_path", "\\", "/").alias("file_path"),
        F.upper(F.regexp_replace("content_hash", r"^\s+|\s+$", "")).alias("content_hash"),
        "indexed_at",
        "received_at",
        "row_id",
    )


def watermarks(runs: DataFrame) -> DataFrame:
    """repo_id and low, the started_at of the latest run that succeeded.

    Runs delivered twice count once; repositories without such a run have no row.
    """
    return runs.where(F.col("run_status") == "succeeded").groupBy("repo_id").agg(F.max("started_at").alias("low")).where(F.col("low").isNotNull())


def publish(spark: SparkSession, text: str, folder: str, name: str) -> bool:
    """Make ``folder/name`` with the given content appear at once and whole; False if it is there already.

    The content is staged under another name. On a local file system a hard
    link, elsewhere a rename that refuses to overwrite, gives it its name, so of
    two writers one fails. That needs an atomic rename (HDFS and the like; an
    object store only behind a committer that has one).
    """
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    staged, final = hadoop.Path(f"{folder}/.{name}-{uuid.uuid4().hex}"), hadoop.Path(f"{folder}/{name}")
    fs = staged.getFileSystem(conf)
    out = fs.create(staged, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            os.link(staged.toUri().getPath(), final.toUri().getPath())
        else:
            none = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
            none[0] = getattr(hadoop.Options.Rename, "NONE")
            hadoop.FileContext.getFileContext(final.toUri(), conf).rename(staged, final, none)
    except FileExistsError:
        return False
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    finally:
        if fs.exists(staged):
            fs.delete(staged, False)
    return True


class CommitLog:
    """Runs over an append-only source whose output and watermark are committed together.

    A run writes its tables into a folder of its own; they count only once
    ``commit-N.json``, which names that folder and the new watermark, appears at
    once and whole, see :func:`publish`. A run that dies before leaves the
    watermark where it was and a folder that no commit names; the next run reads
    the same rows again. Of two runs that race for the same number the second
    fails. A run reads the last commit alone, however many there are.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._hadoop.Path(self.folder))

    def _numbers(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._hadoop.Path(self.folder))]
        return sorted(int(x[7:-5]) for x in names if x.startswith("commit-") and x.endswith(".json"))

    def commit(self, number: int) -> dict:
        stream = self._fs.open(self._hadoop.Path(f"{self.folder}/commit-{number}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def last(self) -> dict | None:
        """The latest commit; None before the first."""
        numbers = self._numbers()
        return self.commit(numbers[-1]) if numbers else None

    def add(self, tables: dict[str, DataFrame], before: dict | None, low, high, fail_before_commit: bool = False) -> dict:
        """Write the tables of one run and commit them with its watermark ``high``; ``before`` is the commit that the run began from."""
        number = before["number"] + 1 if before else 0
        part = f"part-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.folder}/{part}/{name}")
        if fail_before_commit:
            raise RuntimeError("stopped before the commit")
        entry = {"number": number, "low": low, "high": high, "part": part, "tables": sorted(tables)}
        if not publish(self.spark, json.dumps(entry), self.folder, f"commit-{number}.json"):
            raise RuntimeError(f"another run has made commit {number}")
        return entry

    def run(self, source: DataFrame, sequence: str, work, fail_before_commit: bool = False) -> dict | None:
        """Process the rows of ``source`` with low < ``sequence`` <= high by ``work(DataFrame) -> DataFrame``.

        low is the watermark of the last commit, high the largest sequence when
        the run starts; rows that arrive later are left to the next run. None if
        there is no new row.
        """
        before = self.last()
        low = before["high"] if before else None
        fresh = source if low is None else source.where(F.col(sequence) > low)
        high = fresh.agg(F.max(sequence)).first()[0]
        if high is None:
            return None
        return self.add({"output": work(fresh.where(F.col(sequence) <= high))}, before, low, high, fail_before_commit)

    def table(self, name: str, commit: dict | None = None) -> DataFrame | None:
        """A table of one commit, by default the last; None where there is none."""
        commit = commit or self.last()
        return self.spark.read.parquet(f"{self.folder}/{commit['part']}/{name}") if commit else None

    def output(self) -> DataFrame | None:
        """The output of all commits, and nothing else; None before the first."""
        parts = [f"{self.folder}/{self.commit(n)['part']}/output" for n in self._numbers()]
        return self.spark.read.parquet(*parts) if parts else None


_TOLD = ("indexed_at", "received_at", "row_id", "content_hash")


def take_up(log: CommitLog, source: DataFrame, upto: DataFrame | dt.datetime | None = None, fail_before_commit: bool = False) -> dict:
    """One run over a hash log: commits ``output`` (repo_id, file_path of the files to take up), ``state`` and ``marks``.

    ``state`` has, for each file, what its rows so far tell (the row with the
    latest indexed_at, then received_at, then row_id); ``marks`` the watermark
    of each repository: rows received before it are covered. A run reads only
    rows that no mark covers, and of them those before its upper limit, which is
    fixed at its start: ``upto`` (repo_id, low) for each repository, where one
    without a row is left out, or a time for all (rows received at it belong to
    the run), by default the latest in the source. A file is taken up if its
    content differs from that of ``state``, or is in none. Null and blank
    hashes do not count; a null received_at is never covered, so such rows are
    read by every run and change nothing twice; null repositories and paths are
    values of their own.
    """
    before = log.last()
    rows = clean_log(source)
    if before:
        marks = log.table("marks", before).select(F.col("repo_id").alias("_repo"), F.col("upto").alias("_done"))
        rows = rows.join(bounded(marks), rows["repo_id"].eqNullSafe(F.col("_repo")), "left")
        rows = rows.where(F.col("_done").isNull() | F.col("received_at").isNull() | (F.col("received_at") >= F.col("_done"))).drop("_repo", "_done")
    if isinstance(upto, DataFrame):
        limits = upto.select(F.col("repo_id").alias("_repo"), F.col("low").alias("_limit"))
        rows = rows.join(bounded(limits), rows["repo_id"].eqNullSafe(F.col("_repo"))).where(F.col("received_at") < F.col("_limit")).drop("_repo", "_limit")
        marks = upto.select("repo_id", F.col("low").alias("upto"))
        high = None
    else:
        high = source.agg(F.max("received_at")).first()[0] if upto is None else upto
        if high is not None:
            rows = rows.where(F.col("received_at").isNull() | (F.col("received_at") <= F.lit(high)))
        after = F.lit(None if high is None else high + dt.timedelta(microseconds=1)).cast(source.schema["received_at"].dataType)
        marks = source.select("repo_id").distinct().select("repo_id", after.alias("upto"))
    told = F.struct(*_TOLD)
    fresh = rows.groupBy("repo_id", "file_path").agg(F.max(told).alias("now"))
    if before:
        state = log.table("state", before)
        old = state.select(F.col("repo_id").alias("_repo"), F.col("file_path").alias("_path"), F.struct(*_TOLD).alias("then"))
        same = F.col("repo_id").eqNullSafe(F.col("_repo")) & F.col("file_path").eqNullSafe(F.col("_path"))
        either = lambda ours, theirs: F.when(F.col("now").isNull(), F.col(theirs)).otherwise(F.col(ours)).alias(ours)
        both = fresh.join(old, same, "full_outer").select(either("repo_id", "_repo"), either("file_path", "_path"), F.greatest("now", "then").alias("now"), "then")
        both = materialize(both, "told")
    else:
        both = materialize(fresh.withColumn("then", F.lit(None).cast(fresh.schema["now"].dataType)), "told")
    output = both.where(F.col("then").isNull() | (F.col("now.content_hash") != F.col("then.content_hash"))).select("repo_id", "file_path")
    tables = {"output": output, "state": both.select("repo_id", "file_path", "now.*"), "marks": marks}
    try:
        return log.add(tables, before, before["high"] if before else None, None if high is None else str(high), fail_before_commit)
    finally:
        release(both)


def next_files(source: DataFrame, runs: DataFrame, folder: str) -> DataFrame:
    """repo_id and file_path of the files that the next run must take up: the output of a run that is committed in ``folder``.

    In an empty folder the state of the last successful runs is committed
    first: for each repository what was received before its watermark.
    """
    log = CommitLog(source.sparkSession, folder)
    if log.last() is None:
        take_up(log, source, watermarks(runs))
    return log.table("output", take_up(log, source))
