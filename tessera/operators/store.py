"""Keyed writes on tables without a table format: each gives the table's next state as a DataFrame.

Nothing is changed in place. :class:`VersionedTable` writes a state to a new
folder and makes it current by one rename of a pointer, so a reader sees the
old state or the new one, and the path that is being read is never overwritten.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators.incremental import publish
from tessera.tables import blank


def keep_last(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """One row a key, the last in the given order (columns in rising order)."""
    packed = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(c) for c in df.columns])
    out = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(F.max(packed).alias("_m"))
    return out.select(*[F.col(f"_m.{c}").alias(c) for c in df.columns])


def upsert(table: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The table with the rows of ``new`` in place of those with the same key (null equals null); ``new`` has one row a key."""
    same = None
    n = new.select(*[F.col(k).alias(f"_n_{k}") for k in key])
    for k in key:
        c = table[k].eqNullSafe(n[f"_n_{k}"])
        same = c if same is None else same & c
    return table.join(n, same, "left_anti").unionByName(new.select(*table.columns))


def write_symbols(symbols: DataFrame, batch: DataFrame, order: Column) -> DataFrame:
    """The symbol table after a batch: last row of an fqn wins, rows without a repository are left out."""
    good = batch.where(F.col("repo_id").isNotNull() & ~blank("fqn"))
    return upsert(symbols, keep_last(good, ["fqn"], order), ["fqn"])


def write_counts(batch: DataFrame) -> DataFrame:
    """Persisted, failed, vector_rows, ok of a batch: distinct fqns written, rows refused, vectors among those written."""
    good = F.col("repo_id").isNotNull() & ~blank("fqn")
    out = batch.groupBy(F.when(good, F.col("fqn")).alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(F.size("embedding") > 0, 1).otherwise(0)).alias("v")
    )
    sums = out.agg(
        F.count("k").alias("persisted"), F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0)).alias("failed"), F.coalesce(F.sum(F.when(F.col("k").isNotNull(), F.col("v"))), F.lit(0)).alias("vector_rows")
    )
    return sums.withColumn("ok", F.col("failed") == 0)


def replace_outgoing(edges: DataFrame, batch: DataFrame) -> DataFrame:
    """All edges out of the batch's sources give way to the batch's edges, repeated ones once."""
    rest = edges.join(batch.select("from_fqn").distinct(), "from_fqn", "left_anti").select(*edges.columns)
    return rest.unionByName(batch.select(*edges.columns).dropDuplicates(["from_fqn", "to_fqn", "type"]))


def delete_outgoing(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """The edges without those out of the given fqns."""
    return edges.join(sources.select(F.col("fqn").alias("from_fqn")).distinct(), "from_fqn", "left_anti")


def existing_only(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges whose two ends are nodes."""
    n = nodes.select("fqn").distinct()
    e = edges.join(n.withColumnRenamed("fqn", "from_fqn"), "from_fqn", "left_semi")
    return e.join(n.withColumnRenamed("fqn", "to_fqn"), "to_fqn", "left_semi")


def placeholders(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Fqn, kind (guessed) of the ends that are no nodes."""
    ends = edges.select("from_fqn").union(edges.select("to_fqn")).toDF("fqn").where(~blank("fqn")).distinct()
    return ends.join(nodes.select("fqn"), "fqn", "left_anti").withColumn("kind", X.infer_kind("fqn"))


def metadata_groups(edges: DataFrame) -> DataFrame:
    """Type, keys (sorted metadata keys, joined by commas), n."""
    keys = F.array_join(F.array_sort(F.coalesce(F.map_keys("metadata"), F.array().cast("array<string>"))), ",")
    return edges.groupBy("type", keys.alias("keys")).agg(F.count(F.lit(1)).alias("n"))


def signature_of(kind: Column | str) -> Column:
    """The signature of methods, functions, constructors and sections; null for other kinds."""
    k = F.lower(kind)
    return F.when(k.isin("method", "function", "constructor", "section"), F.col("signature"))


def accessibility_of(kind: Column | str) -> Column:
    """The accessibility of the kinds that have one; null for endpoints, documents, sections and namespaces."""
    k = F.lower(kind)
    return F.when(~k.isin("api_endpoint", "document", "section", "namespace"), F.nullif(F.trim("accessibility"), F.lit("")))


def register_repository(repos: DataFrame, path: str, name: str, new_id: str, now: Column) -> DataFrame:
    """The name refreshed where the path is known, else a new row."""
    known = repos.withColumn("name", F.when(F.col("path") == path, F.lit(name)).otherwise(F.col("name")))
    fresh = repos.sparkSession.range(1).select(F.lit(new_id).alias("id"), F.lit(name).alias("name"), F.lit(path).alias("path"), now.alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("last_indexed"))
    return known.unionByName(fresh.join(repos.select("path"), "path", "left_anti").select(*repos.columns))


def touch_repository(repos: DataFrame, repo_id: str, now: Column) -> DataFrame:
    """last_indexed set on one repository."""
    return repos.withColumn("last_indexed", F.when(F.col("id") == repo_id, now).otherwise(F.col("last_indexed")))


def without_repository(df: DataFrame, repo_id: str, column: str = "repo_id") -> DataFrame:
    """A table without the rows of a repository; rows without one stay."""
    return df.where(~F.coalesce(F.col(column) == repo_id, F.lit(False)))


def repository_to_delete(repos: DataFrame, name: str) -> tuple[str, str | None]:
    """('ok', id), ('not found', None) or ('ambiguous', None) for an exact name in any case."""
    hit = repos.where(F.lower(F.trim("name")) == name.strip().lower()).select("id").limit(2).collect()
    return ("ok", hit[0][0]) if len(hit) == 1 else ("ambiguous" if hit else "not found", None)


def detach(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """The edges that touch none of the removed nodes (fqn)."""
    g = gone.select("fqn").distinct()
    e = edges.join(g.withColumnRenamed("fqn", "from_fqn"), "from_fqn", "left_anti")
    return e.join(g.withColumnRenamed("fqn", "to_fqn"), "to_fqn", "left_anti")


def symbols_of_files(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """The symbols of the given (repo_id, file_path), either kind of slash."""
    f = files.select("repo_id", X.slashes("file_path").alias("_p")).distinct()
    s = symbols.withColumn("_p", X.slashes("file_path"))
    return s.join(f, ["repo_id", "_p"], "left_semi").drop("_p")


def upsert_hashes(hashes: DataFrame, new: DataFrame) -> DataFrame:
    """One hash a file; ``hashes`` and ``new`` have repo_id, file_path, content_hash."""
    return upsert(hashes, new.dropDuplicates(["repo_id", "file_path"]), ["repo_id", "file_path"])


def latest_hashes(log: DataFrame) -> DataFrame:
    """repo_id, file_path, content_hash that the log tells last, blank ones left out."""
    from tessera.operators.incremental import clean_log

    rows = clean_log(log)
    told = F.struct("indexed_at", "received_at", "row_id", "content_hash")
    return rows.groupBy("repo_id", "file_path").agg(F.max(told).alias("t")).select("repo_id", "file_path", F.col("t.content_hash").alias("content_hash"))


def chunk_plan(items: DataFrame, order: str, size: int) -> DataFrame:
    """The items with the number of the upload chunk each belongs to.

    Numbers follow the order; they are made from counts per range partition, so
    no task holds all rows.
    """
    spread = items.repartitionByRange(F.col(order)).withColumn("_p", F.spark_partition_id())
    from tessera.session import materialize

    placed = materialize(spread, "chunks")
    counts = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    local = placed.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1)
    return local.join(F.broadcast(before), "_p").withColumn("chunk", F.floor((F.col("_before") + F.col("_i")) / size)).drop("_p", "_i", "_before")


class VersionedTable:
    """A Parquet table whose current state is named by a pointer file."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.folder))

    def _pointers(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        return sorted(int(n[8:]) for n in names if n.startswith("current-"))

    def read(self) -> DataFrame | None:
        """The current state; None before the first write."""
        at = self._pointers()
        if not at:
            return None
        name = self.spark.read.text(f"{self.folder}/current-{at[-1]}").first()[0]
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def write(self, state: DataFrame, *partition_by: str) -> int:
        """Write a state and make it current; fails if another writer was first."""
        number = (self._pointers() or [0])[-1] + 1
        name = f"v{number}-{uuid.uuid4().hex}"
        w = state.write.partitionBy(*partition_by) if partition_by else state.write
        w.parquet(f"{self.folder}/{name}")
        if not publish(self.spark, name, self.folder, f"current-{number}"):
            raise RuntimeError(f"another writer has made version {number}")
        return number


# ---- aggregates over repositories and symbols ----


def health(symbols: DataFrame) -> DataFrame:
    """A1, A2: repo_id, total, embeddable, with_embedding, label of each repository."""
    k = F.lower("kind")
    can = k.isin(*X.EMBEDDABLE)
    out = symbols.groupBy("repo_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(can).alias("embeddable"), F.count_if(can & (F.size("embedding") > 0)).alias("with_embedding"))
    share = F.col("with_embedding") / F.col("embeddable")
    label = (
        F.when(F.col("total") == 0, "EMPTY")
        .when(F.col("embeddable") == 0, "OK (nothing to embed)")
        .when(F.col("with_embedding") == 0, "DEGRADED")
        .when(share >= 0.9, "OK")
        .otherwise(F.concat(F.lit("PARTIAL "), F.round(share * 100).cast("long").cast("string"), F.lit("%")))
    )
    return out.withColumn("label", label)


def grouped_by_name(repos: DataFrame) -> DataFrame:
    """A3: name (small letters), primary_id (the newest), stale (ids of the others, sorted)."""
    n = F.lower(F.trim("name"))
    newest = F.max(F.struct(F.coalesce("last_indexed", F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")).alias("t"), "id")).alias("m")
    out = repos.groupBy(n.alias("name")).agg(newest, F.collect_set("id").alias("ids"))
    return out.select("name", F.col("m.id").alias("primary_id"), F.array_sort(F.array_except("ids", F.array("m.id"))).alias("stale"))


def by_module(symbols: DataFrame) -> DataFrame:
    """Module, n of the symbols, grouped by what their path tells."""
    return symbols.groupBy(X.module_from_path("file_path").alias("module")).agg(F.count(F.lit(1)).alias("n"))
