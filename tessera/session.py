"""Session factory, the shared folder for cut lineage, and size-checked broadcasts."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it was counted and has no more rows and bytes (as text) than this.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 32 << 20


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; ``conf`` keys use ``__`` for dots."""
    b = (
        SparkSession.builder.master(master)
        .appName("tessera")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Only where that setting is absent on a local master (as in tests) a
    temporary folder is made and set; on a cluster, whose executors could not
    reach it, its absence is an error.
    """
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            return set_dir.get()
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
        at = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        spark.sparkContext.setCheckpointDir(at)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return at


_written: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already
        pass


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        _delete(spark, path)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder, deleted when the process ends."""
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


#: Spark's setting by which the shuffle files of an action are deleted with its end.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, drop_shuffles: bool = False) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    Lineage is cut by files that outlive any executor; unlike ``checkpoint()``
    the rows are computed once and stay columnar and compressed. The files are
    deleted when the process ends or by :func:`release`. With ``drop_shuffles``
    the shuffle files of the write are deleted at its end, not when the driver
    happens to collect its garbage.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    before = spark.conf.get(_DROP_SHUFFLES, "false")
    if drop_shuffles:
        spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._tessera_path = path
    return back


def release(*dfs: DataFrame) -> None:
    """Delete the files of materialized frames that nothing reads any more."""
    for df in dfs:
        path = getattr(df, "_tessera_path", None)
        if path:
            _delete(df.sparkSession, path)


def release_all(spark: SparkSession) -> None:
    """Delete everything that was materialized for the results of a session; call it once they have been read or written.

    A result is lazy and reads its intermediate tables only when an action runs,
    so nothing deletes them before; a long session calls this between queries.
    """
    mine = [w for w in _written if w[0] is spark]
    _written[:] = [w for w in _written if w[0] is not spark]
    for _, path in mine:
        _delete(spark, path)


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has no more rows and bytes than that; it reads one row more than ``max_rows`` at most."""
    size = F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    n, total = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return n <= max_rows and total <= max_bytes


def bounded(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if its rows and bytes were counted and are few, else as it is."""
    return F.broadcast(df) if is_small(df, max_rows, max_bytes) else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once a session, so that they need no copy of it on their path."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        at = Path(tempfile.mkdtemp(prefix="tessera-code-")) / "tessera_package.zip"
        with zipfile.ZipFile(at, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(at))
        _shipped.add(app)
    return spark


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
