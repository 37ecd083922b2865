"""Scans of source trees, ignore rules, project discovery and landing folders."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as X

#: One list of extensions for scanning, hashing and watching alike.
SOURCE_EXTENSIONS = tuple(X.LANGUAGES)
MARKDOWN_EXTENSIONS = (".md", ".markdown")
# File names of manifests and patterns of configuration files.
MANIFEST = r"(?i)/(package\.json|composer\.json|requirements[^/]*\.txt|pyproject\.toml|cargo\.toml|go\.mod|pom\.xml|[^/]+\.csproj)$"
CONFIG = r"(?i)/(appsettings[^/]*\.json|\.env[^/]*|docker-compose[^/]*\.ya?ml)$"

FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("content", T.StringType()), T.StructField("length", T.LongType()), T.StructField("content_hash", T.StringType())])


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """path (relative, forward slashes), content, length, content_hash of every file below ``root``, one row a file.

    The hash is SHA-256 of the bytes; content is decoded as UTF-8. Empty files
    have no row: file scans leave them out, and there is nothing to extract.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = F.regexp_replace(F.lit(root.rstrip("/")), r"^file:/*", "/")
    path = X.slashes(F.regexp_replace("path", r"^file:/*", "/"))
    rel = F.when(path.startswith(prefix), F.substring(path, F.length(prefix) + 2, F.lit(1 << 20))).otherwise(path)
    return raw.select(rel.alias("path"), F.decode("content", "UTF-8").alias("content"), "length", F.upper(F.sha2(F.col("content"), 256)).alias("content_hash"))


#: Bytes that an uploaded archive, and all that it unpacks to, may have.
ZIP_BYTES = 50 << 20


def unzipped(archives: DataFrame, name: str, data: str, max_bytes: int = ZIP_BYTES) -> DataFrame:
    """The files of uploaded zip archives as :data:`FILES`, with archive and error.

    ``archives``: a name and the bytes, as ``binaryFile`` reads them. Each
    archive is unpacked by itself where it is. Members that would leave the
    archive's folder (absolute, or with ``..``), directories and empty files are
    left out. An archive that is too large, packed or unpacked, or is none gives
    one row with its error and no path.
    """

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in pdfs:
            rows: list[tuple] = []
            for archive, raw in zip(p["archive"], p["raw"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(raw)) as z:
                        members = [m for m in z.infolist() if not m.is_dir() and m.file_size]
                        if len(raw) > max_bytes or sum(m.file_size for m in members) > max_bytes:
                            raise ValueError("the archive is too large")
                        for m in members:
                            path = m.filename.replace("\\", "/")
                            if path.startswith("/") or ":" in path or ".." in path.split("/"):
                                continue
                            body = z.read(m)
                            rows.append((archive, path, body.decode("utf-8", "replace"), len(body), hashlib.sha256(body).hexdigest().upper(), None))
                except (zipfile.BadZipFile, ValueError, RuntimeError, NotImplementedError) as e:
                    rows.append((archive, None, None, None, None, str(e)))
            out = pd.DataFrame(rows, columns=["archive", "path", "content", "length", "content_hash", "error"])
            out["length"] = out["length"].astype("Int64")
            yield out

    some = archives.where(F.col(data).isNotNull()).select(F.col(name).cast("string").alias("archive"), F.col(data).alias("raw"))
    return some.mapInPandas(run, "archive string, path string, content string, length long, content_hash string, error string")


def rooted(path: Column | str) -> Column:
    """A relative path with a slash before it, so that every part of it stands between slashes."""
    return F.concat(F.lit("/"), X.slashes(path))


def source_files(files: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """Files of a known language, outside excluded directories, not ignored."""
    kept = files.where(X.extension("path").isin(*SOURCE_EXTENSIONS) & ~X.in_excluded_dir(rooted("path")))
    return not_ignored(kept, patterns) if patterns is not None else kept


def markdown_files(files: DataFrame) -> DataFrame:
    """S6."""
    return files.where(X.extension("path").isin(*MARKDOWN_EXTENSIONS) & ~X.in_excluded_dir(rooted("path")))


def config_files(files: DataFrame) -> DataFrame:
    """S7."""
    return files.where(rooted("path").rlike(CONFIG) & ~X.in_excluded_dir(rooted("path")))


def manifest_files(files: DataFrame) -> DataFrame:
    """S8."""
    return files.where(rooted("path").rlike(MANIFEST) & ~X.in_excluded_dir(rooted("path")))


def any_indexable(files: DataFrame) -> bool:
    """Whether there is anything to index; reads no more than it needs."""
    return files.where(X.extension("path").isin(*SOURCE_EXTENSIONS, *MARKDOWN_EXTENSIONS) & ~X.in_excluded_dir(rooted("path"))).limit(1).count() > 0


def changed_only(files: DataFrame, changed: DataFrame) -> DataFrame:
    """The files of an explicit list (path)."""
    return files.join(changed.select("path").distinct(), "path", "left_semi")


def ignore_patterns(texts: DataFrame, text: str = "content") -> DataFrame:
    """The patterns of ignore files: lines without blanks, ``#`` comments and a trailing slash."""
    x = texts.select(F.explode(F.split(text, r"\r?\n")).alias("line")).select(F.trim("line").alias("p")).where((F.col("p") != "") & ~F.col("p").startswith("#"))
    return x.select(F.regexp_replace("p", "/+$", "").alias("pattern")).where("pattern <> ''").distinct()


def matches_pattern(path: Column, pattern: Column) -> Column:
    """``*.ext`` at the end, ``a/b`` from the root, a bare name as any part; without case."""
    p, q = F.lower(rooted(path)), F.lower(pattern)
    slash = F.lit("/")
    return (
        F.when(q.startswith("*."), p.endswith(F.substring(q, 2, 1 << 20)))
        .when(q.contains("/"), (p == F.concat(slash, q)) | p.startswith(F.concat(slash, q, slash)))
        .otherwise(F.concat(p, slash).contains(F.concat(slash, q, slash)))
    )


def not_ignored(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """The files that no pattern matches. Patterns come from ignore files; their size is checked before they are broadcast."""
    from tessera.session import bounded

    p = bounded(patterns.select("pattern").distinct())
    return files.join(p, matches_pattern(files["path"], p["pattern"]), "left_anti")


def projects_outside_solutions(files: DataFrame) -> DataFrame:
    """Path of the project files that no solution lists."""
    projects = files.where(F.lower("path").endswith(".csproj")).select("path", F.lower(F.regexp_extract("path", r"([^/]+)$", 1)).alias("file"))
    solutions = files.where(F.lower("path").rlike(r"\.slnx?$"))
    listed = solutions.select(F.explode(F.regexp_extract_all("content", F.lit(r'"([^"]+\.csproj)"'), F.lit(1))).alias("p"))
    listed = listed.select(F.lower(F.regexp_extract(X.slashes("p"), r"([^/]+)$", 1)).alias("file")).distinct()
    return projects.join(listed, "file", "left_anti").select("path")


def project_name(files: DataFrame, directory: str) -> DataFrame:
    """One row, name and rule: solution, package.json (scope dropped), pyproject, a single project, else the directory."""
    base = F.regexp_extract("path", r"([^/]+?)(\.[^./]+)?$", 1)
    top = files.where(~F.col("path").contains("/"))
    only = files.where(F.lower("path").endswith(".csproj")).agg(F.count(F.lit(1)).alias("n"), F.min(base).alias("b"))
    found = top.agg(
        F.min(F.when(F.lower("path").rlike(r"\.slnx?$"), base)).alias("solution"),
        F.min(F.when(F.lower("path") == "package.json", F.regexp_replace(F.get_json_object("content", "$.name"), "^@[^/]*/", ""))).alias("package"),
        F.min(F.when(F.lower("path") == "pyproject.toml", F.nullif(F.regexp_extract("content", r"(?m)^\s*name\s*=\s*[\"']([^\"']+)[\"']", 1), F.lit("")))).alias("pyproject"),
    )
    x = found.join(F.broadcast(only), F.lit(True)).withColumn("project", F.when(F.col("n") == 1, F.col("b")))
    order = ("solution", "package", "pyproject", "project")
    rule = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in order], F.lit("directory"))
    return x.select(F.coalesce(*order, F.lit(directory.rstrip("/").rpartition("/")[2])).alias("name"), rule.alias("rule"))


INGEST = "symbols array<struct<fqn:string,name:string,kind:string,signature:string,file_path:string,repo_id:string>>, relationships array<struct<from_fqn:string,to_fqn:string,type:string>>, file_hashes map<string,string>, project_name string"
# Names of edge types; an unknown one counts as References.
EDGE_TYPES = (
    "Declares", "Inherits", "Implements", "HasMethod", "HasProperty", "HasConstructor", "HasField", "HasEvent", "Calls", "TestCovers", "Creates", "References",
    "UsesType", "DependsOn", "Overrides", "Throws", "Catches", "HttpCalls", "MapsTo", "Configures", "HandledBy", "ReadsConfig", "Subscribes", "Publishes",
    "PipelineOrder", "AcceptsDto", "ReturnsDto", "HasSection", "ContainsProject", "ContainsNamespace", "BelongsToModule",
)


def known_type(c: Column | str) -> Column:
    """The edge type, References for one that is not known."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isin(*EDGE_TYPES), c).otherwise("References")


def ingested(payloads: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Symbols, edges and hashes of uploaded payloads; payloads without any of the three are left out."""
    full = payloads.where((F.coalesce(F.size("symbols"), F.lit(0)) > 0) | (F.coalesce(F.size("relationships"), F.lit(0)) > 0) | (F.coalesce(F.size("file_hashes"), F.lit(0)) > 0))
    s = full.select(F.explode("symbols").alias("s")).select("s.*").where(F.trim("fqn") != "")
    r = full.select(F.explode("relationships").alias("r")).select("r.from_fqn", "r.to_fqn", known_type("r.type").alias("type"))
    h = full.select("project_name", F.explode("file_hashes").alias("file_path", "content_hash"))
    return s, r, h
