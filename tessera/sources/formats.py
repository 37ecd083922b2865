"""Parsers of markdown, configuration files and package manifests: (path, content) to rows."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X

# ---- markdown ----


def sections(docs: DataFrame, path: str = "path", text: str = "content") -> DataFrame:
    """Path, ord, level, heading, start_line, end_line, content of the sections of markdown texts.

    A line that begins with ``#`` is a heading, inside fenced code too; what
    stands before the first is a section of level 0 without a heading. Content
    is trimmed and cut at 500 characters. Work stays in the row; no shuffle.
    """
    lines = docs.select(F.col(path).alias("path"), F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n").alias("lines"))
    flags = F.transform("lines", lambda x, i: F.struct(i.alias("i"), F.regexp_extract(x, r"^\s*(#+)", 1).alias("marks"), x.alias("line")))
    heads = F.filter(flags, lambda s: s["marks"] != "")
    x = lines.select("path", "lines", F.size("lines").alias("n"), heads.alias("heads"))
    before = F.struct(F.lit(-1).alias("i"), F.lit("").alias("marks"), F.lit("").alias("line"))
    starts = F.concat(F.array(before), "heads")
    x = x.select("path", "lines", "n", F.posexplode(F.transform(starts, lambda s, k: F.struct(s["i"].alias("i"), s["marks"].alias("marks"), s["line"].alias("line"), F.coalesce(F.try_element_at(starts, k + 2)["i"], F.lit(None).cast("int")).alias("next")))).alias("ord", "s"))
    end = F.coalesce("s.next", "n")
    body = F.trim(F.array_join(F.slice("lines", F.col("s.i") + 2, F.greatest(end - F.col("s.i") - 1, F.lit(0))), "\n"), F.lit(" \t\n"))
    heading = F.trim(F.regexp_replace("s.line", r"^\s*#+", ""))
    out = x.select("path", "ord", F.length("s.marks").alias("level"), heading.alias("heading"), F.greatest(F.col("s.i") + 1, F.lit(1)).alias("start_line"), end.alias("end_line"), X.truncated(body, 500).alias("content"))
    return out.where((F.col("heading") != "") | (F.col("content") != ""))


def section_edges(found: DataFrame) -> DataFrame:
    """HasSection edges from doc:path to doc:path#slug."""
    doc = F.concat(F.lit("doc:"), "path")
    return found.select(doc.alias("from_fqn"), F.concat(doc, F.lit("#"), X.slug("heading")).alias("to_fqn"), F.lit("HasSection").alias("type"))


# ---- configuration ----


def dotenv_keys(files: DataFrame) -> DataFrame:
    """path, line, key of the assignments of .env files."""
    x = files.select("path", F.posexplode(F.split("content", r"\r?\n")).alias("i", "raw")).select("path", (F.col("i") + 1).alias("line"), F.trim("raw").alias("t"))
    x = x.where((F.col("t") != "") & ~F.col("t").startswith("#") & (F.instr("t", "=") > 1))
    x = x.withColumn("key", F.trim(F.substring_index("t", "=", 1)))
    return x.where(X.is_env_key("key")).select("path", "line", "key")


def _per_file(files: DataFrame, parse: Callable[[str, str], list[tuple]], schema: str) -> DataFrame:
    """Rows of a parser over each (path, content); a file that can't be parsed gives none."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in pdfs:
            rows: list[tuple] = []
            for path, content in zip(p["path"], p["content"], strict=True):
                if content is None:
                    continue
                try:
                    rows += parse(path, content)
                except Exception:  # malformed: best effort
                    continue
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, schema)


def _flatten(x, prefix: str) -> Iterator[tuple[str, str | None]]:
    if isinstance(x, dict):
        for k, v in x.items():
            yield from _flatten(v, f"{prefix}:{k}" if prefix else k)
    elif not isinstance(x, list):
        yield prefix, None if x is None else json.dumps(x) if isinstance(x, bool | int | float) else str(x)


_COMMENT = re.compile(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', re.S)


def json_keys(files: DataFrame) -> DataFrame:
    """path, key (parts joined by colons), value of JSON settings; arrays are skipped, comments allowed."""
    return _per_file(files, lambda p, c: [(p, k, v) for k, v in _flatten(json.loads(_COMMENT.sub(lambda m: m[1] or "", c)), "") if k], "path string, key string, value string")


def _compose(path: str, content: str) -> list[tuple]:
    rows, inside, depth = [], False, 0
    for n, line in enumerate(content.splitlines(), 1):
        t = line.strip()
        if not t:
            continue
        indent = len(line) - len(line.lstrip())
        if t.lower().startswith("environment:"):
            inside, depth = True, indent
        elif inside:
            if indent <= depth and t[0] not in "-#":
                inside = False
                continue
            entry = t.lstrip("-").strip()
            if entry and entry[0] != "#":
                m = re.match(r"([^=]*)=", entry) or re.match(r"([^:]*):", entry)
                if m and re.fullmatch(r"[^\W\d]\w*", m[1].strip()):
                    rows.append((path, n, m[1].strip()))
    return rows


def compose_keys(files: DataFrame) -> DataFrame:
    """path, line, key of the environment blocks of compose files."""
    return _per_file(files, _compose, "path string, line int, key string")


def config_keys(files: DataFrame) -> DataFrame:
    """Fqn, path, provider of the keys of all configuration files."""
    p = F.lower("path")
    js = json_keys(files.where(p.endswith(".json"))).select(F.concat(F.lit("config:"), "key").alias("fqn"), "path", F.lit("json").alias("provider"))
    env = dotenv_keys(files.where(p.rlike(r"(^|/)\.env[^/]*$"))).select(F.concat(F.lit("env:"), "key").alias("fqn"), "path", F.lit("env").alias("provider"))
    com = compose_keys(files.where(p.rlike(r"\.ya?ml$"))).select(F.concat(F.lit("env:"), "key").alias("fqn"), "path", F.lit("docker-compose").alias("provider"))
    return js.unionByName(env).unionByName(com)


def tsconfig_aliases(files: DataFrame) -> DataFrame:
    """F16: path, alias, target of the wildcard paths of tsconfig files, the base folder put before the first target."""

    def parse(path: str, content: str) -> list[tuple]:
        o = json.loads(_COMMENT.sub(lambda m: m[1] or "", content)).get("compilerOptions", {})
        base = o.get("baseUrl", ".").strip("./")
        out = []
        for k, v in o.get("paths", {}).items():
            if k.endswith("*") and v:
                target = v[0].rstrip("*").removeprefix("./")
                out.append((path, k[:-1], f"{base}/{target}" if base else target))
        return out

    return _per_file(files, parse, "path string, alias string, target string")


# ---- manifests ----

DEPENDENCY = "name string, version string, ecosystem string, manifest string, is_dev boolean"


def _json_dependencies(files: DataFrame, parts: dict[str, bool], ecosystem: str) -> DataFrame:
    out = None
    for part, dev in parts.items():
        # each section as a map of raw values: a value that is no string counts as any version
        m = F.from_json(F.get_json_object("content", f"$['{part}']"), "map<string,string>")
        x = files.select("path", F.explode(m).alias("name", "v"))
        version = F.when(F.col("v").isNull() | F.col("v").rlike(r"^\s*[\[{]"), "*").otherwise(F.col("v"))
        x = x.select("name", version.alias("version"), F.lit(ecosystem).alias("ecosystem"), F.col("path").alias("manifest"), F.lit(dev).alias("is_dev"))
        out = x if out is None else out.unionByName(x)
    return out


def npm_dependencies(files: DataFrame) -> DataFrame:
    """the three sections of package.json."""
    return _json_dependencies(files, {"dependencies": False, "devDependencies": True, "peerDependencies": False}, "npm")


def composer_dependencies(files: DataFrame) -> DataFrame:
    """the two sections of composer.json."""
    return _json_dependencies(files, {"require": False, "require-dev": True}, "composer")


def suggests_dev(name: Column | str) -> Column:
    """a file or group name with dev or test in it."""
    return F.lower(name).rlike("dev|test")


def pip_dependencies(files: DataFrame) -> DataFrame:
    """requirements files: comments, options, links and environment markers dropped."""
    file = F.regexp_extract("path", r"([^/]+)$", 1)
    x = files.select("path", suggests_dev(file).alias("is_dev"), F.explode(F.split("content", r"\r?\n")).alias("raw"))
    t = F.trim(F.regexp_replace(F.regexp_replace("raw", r"\s#.*$", ""), ";.*$", ""))
    x = x.select("path", "is_dev", t.alias("t")).where((F.col("t") != "") & ~F.col("t").rlike(r"^(#|-|git\+|http)"))
    x = x.select(X.requirement_name("t").alias("name"), X.requirement_version("t").alias("version"), F.lit("pip").alias("ecosystem"), F.col("path").alias("manifest"), "is_dev")
    return x.where("name <> ''")


def _spec(s: str) -> tuple[str, str]:
    m = re.match(r"([^=><~!\t @]*)(.*)", s.split(";")[0].strip(), re.S)
    return re.sub(r"\[.*\]", "", m[1]).strip(), m[2].strip() or "*"


def _is_dev(group: str) -> bool:
    return bool(re.search("dev|test", group, re.I))


def _version(v) -> str:
    return v if isinstance(v, str) else v.get("version", "*") if isinstance(v, dict) else "*"


def _pyproject(path: str, content: str) -> list[tuple]:
    import tomllib

    t = tomllib.loads(content)
    project, poetry = t.get("project", {}), t.get("tool", {}).get("poetry", {})
    rows = [(*_spec(s), "pip", path, False) for s in project.get("dependencies", [])]
    for group, specs in [*project.get("optional-dependencies", {}).items(), *t.get("dependency-groups", {}).items()]:
        rows += [(*_spec(s), "pip", path, _is_dev(group)) for s in specs if isinstance(s, str)]
    tables = [(poetry.get("dependencies", {}), False), (poetry.get("dev-dependencies", {}), True)]
    tables += [(g.get("dependencies", {}), _is_dev(n)) for n, g in poetry.get("group", {}).items()]
    return rows + [(n, _version(v), "pip", path, dev) for table, dev in tables for n, v in table.items() if n.lower() != "python"]


def _cargo(path: str, content: str) -> list[tuple]:
    import tomllib

    t = tomllib.loads(content)
    tops = [t, *t.get("target", {}).values()]
    return [(n, _version(v), "cargo", path, dev) for top in tops for part, dev in (("dependencies", False), ("build-dependencies", False), ("dev-dependencies", True)) for n, v in top.get(part, {}).items()]


def _go_mod(path: str, content: str) -> list[tuple]:
    rows, block = [], False
    for raw in content.splitlines():
        line = raw.strip()
        if block and line.startswith(")"):
            block = False
        elif re.match(r"require\s*\($", line):
            block = True
        elif (block or line.startswith("require ")) and "// indirect" not in line:
            parts = line.removeprefix("require ").split("//")[0].split()
            if len(parts) >= 2:
                rows.append((parts[0], parts[1], "go", path, False))
    return rows


def _xml(content: str):
    import xml.etree.ElementTree as E

    if "<!DOCTYPE" in content or "<!ENTITY" in content:
        raise ValueError("document types are not read")
    root = E.fromstring(content)
    for x in root.iter():
        x.tag = x.tag.rpartition("}")[2]
    return root


def _pom(path: str, content: str) -> list[tuple]:
    rows = []
    for dep in _xml(content).iter("dependency"):
        get = lambda k, d=dep: (d.findtext(k) or "").strip()
        if get("groupId") and get("artifactId"):
            rows.append((f"{get('groupId')}:{get('artifactId')}", get("version") or "*", "maven", path, get("scope").lower() in ("test", "provided")))
    return rows


def _csproj(path: str, content: str) -> list[tuple]:
    rows = []
    for ref in _xml(content).iter("PackageReference"):
        name = ref.get("Include") or ref.get("Update")
        if name:
            rows.append((name, ref.get("Version") or (ref.findtext("Version") or "").strip() or "*", "nuget", path, False))
    return rows


def _other_manifest(path: str, content: str) -> list[tuple]:
    name = path.rpartition("/")[2].lower()
    if name.endswith(".csproj"):
        return _csproj(path, content)
    return {"pyproject.toml": _pyproject, "cargo.toml": _cargo, "go.mod": _go_mod, "pom.xml": _pom}.get(name, lambda p, c: [])(path, content)


def dependencies(files: DataFrame, ecosystem: str | None = None) -> DataFrame:
    """The dependencies of all manifests (F22 to F28), of one ecosystem where one is given."""
    name = F.lower(F.regexp_extract("path", r"([^/]+)$", 1))
    out = npm_dependencies(files.where(name == "package.json")).unionByName(composer_dependencies(files.where(name == "composer.json")))
    out = out.unionByName(pip_dependencies(files.where(name.rlike(r"^requirements.*\.txt$"))))
    out = out.unionByName(_per_file(files.where(name.rlike(r"^(pyproject\.toml|cargo\.toml|go\.mod|pom\.xml|.*\.csproj)$")), _other_manifest, DEPENDENCY))
    return out if ecosystem is None else out.where(F.lower("ecosystem") == ecosystem.lower())


def by_manifest(found: DataFrame) -> DataFrame:
    """Manifest, ecosystem, n, packages (runtime before development, then by name without case)."""
    order = F.struct("is_dev", F.lower("name").alias("l"), "name", "version")
    packed = F.array_sort(F.collect_list(order))
    return found.groupBy("manifest").agg(F.min("ecosystem").alias("ecosystem"), F.count(F.lit(1)).alias("n"), F.transform(packed, lambda x: F.concat_ws("@", x["name"], x["version"])).alias("packages"))
