"""Queries of source scans, format parsers and extractors, with their SQL.

Real texts come from documents; formats that the tables don't hold come as
small literal files, the same on both sides.
"""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans import samples
from tessera.sources import extract as E
from tessera.sources import files as S
from tessera.sources import formats as P
from tessera.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _q(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def _files(spark: SparkSession, *rows: tuple[str, str]) -> DataFrame:
    return spark.createDataFrame(list(rows), "path string, content string")


def _values(columns: str, *rows: tuple) -> str:
    lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({columns})"


# ---- documents: markdown and code ----

_LINES = """
l AS (SELECT doc_id, unnest(list_zip(string_split(t, chr(10)), range(len(string_split(t, chr(10)))))) AS z, len(string_split(t, chr(10))) AS n
  FROM (SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents WHERE doc_kind IN ('readme', 'changelog') AND text IS NOT NULL)),
m AS (SELECT doc_id, n, z[1] AS line, z[2] AS i, regexp_extract(z[1], '^\\s*(#+)', 1) AS marks FROM l),
g AS (SELECT *, sum(CASE WHEN marks <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS ord FROM m)
"""


@_q(f"""WITH {_LINES}, s AS (
  SELECT doc_id, ord, max(length(marks)) AS level, coalesce(max(trim(regexp_replace(line, '^\\s*#+', ''), ' ')) FILTER (WHERE marks <> ''), '') AS heading,
    CASE WHEN max(length(marks)) > 0 THEN min(i) + 1 ELSE 1 END AS start_line, max(i) + 1 AS end_line,
    trim(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE marks = ''), ''), ' ' || chr(9) || chr(10)) AS content FROM g GROUP BY doc_id, ord)
SELECT doc_id, ord, level, heading, start_line, end_line, CASE WHEN length(content) > 500 THEN substring(content, 1, 500) || '...' ELSE content END AS content FROM s WHERE heading <> '' OR content <> ''""")
def x08_sections(spark, d):
    docs = table(spark, d, "documents").where(F.col("doc_kind").isin("readme", "changelog") & F.col("text").isNotNull())
    out = P.sections(docs.withColumn("path", F.col("doc_id").cast("string")), "path", "text")
    return out.withColumn("doc_id", F.col("path").cast("long")).drop("path")


@_q(f"""WITH {_LINES}, h AS (SELECT doc_id, trim(regexp_replace(line, '^\\s*#+', ''), ' ') AS heading FROM m WHERE marks <> '')
SELECT 'doc:' || doc_id AS from_fqn, 'doc:' || doc_id || '#' || regexp_replace(replace(replace(replace(lower(heading), ' ', '-'), '---', '-'), '--', '-'), '^-+|-+$', '', 'g') AS to_fqn, 'HasSection' AS type FROM h WHERE heading <> ''""")
def x08_section_edges(spark, d):
    docs = table(spark, d, "documents").where(F.col("doc_kind").isin("readme", "changelog") & F.col("text").isNotNull())
    found = P.sections(docs.withColumn("path", F.col("doc_id").cast("string")), "path", "text")
    return P.section_edges(found.where("level > 0 AND heading <> ''"))


def _code(spark: SparkSession, d: str) -> DataFrame:
    """The code of documents as files; the extension is guessed from how functions begin."""
    docs = table(spark, d, "documents").where((F.col("doc_kind") == "code") & F.col("text").isNotNull())
    t = F.col("text")
    ext = (
        F.when(t.rlike(r"(?m)^\s*(async )?def \w+"), "py").when(t.rlike(r"(?m)^\s*func "), "go").when(t.rlike(r"(?m)^\s*(pub )?fn "), "rs")
        .when(t.rlike(r"(?m)^\s*(public |private )?function .*\$"), "php").when(t.rlike(r"(?m)^\s*(export )?(async )?function "), "ts").when(t.rlike(r"(?m)^\s*using [\w.]+;|^\s*namespace |\bget; set;|\bTask<|\bstring \w+[,)]|\bbool \w+[,)]|\bdecimal "), "cs").when(t.rlike(r"(?m)^\s*public "), "java").otherwise("ts")
    )
    return docs.select(F.concat(F.lit("docs/d"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"), t.alias("content"))


@_q("")
def x01_x07_symbols(spark, d):
    return E.symbols_of(E.extract(_code(spark, d)))


@_q("")
def x19_x21_edges(spark, d):
    return E.edges_of(E.extract(_code(spark, d))).drop("metadata")


@_q("")
def x23_metrics(spark, d):
    return E.symbols_of(E.extract(_code(spark, d))).where("complexity IS NOT NULL").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max("complexity").alias("max_complexity"), F.max("nesting").alias("max_nesting"))


@_q("")
def x09_resolved_edges(spark, d):
    rows = E.extract(_code(spark, d))
    s, e = E.symbols_of(rows), E.edges_of(rows)
    return E.resolve_calls(E.resolve_imports(e, s.select(F.col("path").alias("module"))), s).drop("metadata")


# ---- code in several languages, literal ----


def _sample_symbols(spark: SparkSession) -> DataFrame:
    return E.symbols_of(E.extract(_files(spark, *samples.FILES)))


@_q(_values("fqn, kind, start_line, end_line, accessibility", *[r[:5] for r in samples.SYMBOLS]))
def x01_x07_languages(spark, d):
    """The symbols of one file in each language."""
    return _sample_symbols(spark).select("fqn", "kind", "start_line", "end_line", "accessibility")


@_q(_values("fqn, complexity, nesting", *[(r[0], r[6], r[7]) for r in samples.SYMBOLS if r[6] is not None]))
def x23_metrics_by_language(spark, d):
    return _sample_symbols(spark).where("complexity IS NOT NULL").select("fqn", "complexity", "nesting")


@_q(_values("fqn", *[(r[0],) for r in samples.SYMBOLS if r[5]]))
def x24_test_methods(spark, d):
    """Tests by attribute, annotation or name, as the extractor finds them."""
    return _sample_symbols(spark).where("is_test_method").select("fqn")


@_q(_values("fqn, documentation", *samples.DOCUMENTATION))
def x25_documentation(spark, d):
    return _sample_symbols(spark).where("documentation IS NOT NULL").select("fqn", "documentation")


def sample_symbols() -> list[tuple[str, tuple]]:
    """The path and the row of each symbol of the samples; every file's symbols stand together, in the order of the files."""
    roots = ("lib.", "web/", "org.", "net", "crate::", "App", ("Shop.", "API:"))
    return [(path, r) for (path, _), root in zip(samples.FILES, roots, strict=True) for r in samples.SYMBOLS if r[0].startswith(root)]


def _sample_edges(name: str, *kinds: str) -> None:
    def run(spark, d):
        return E.edges_of(E.extract(_files(spark, *samples.FILES))).where(F.col("type").isin(*kinds)).select("from_fqn", "to_fqn", "type")

    QUERIES[name] = run
    ORACLE[name] = _values("from_fqn, to_fqn, type", *[r for r in samples.EDGES if r[2] in kinds])


_sample_edges("x19_calls", "Calls", "Creates", "TestCovers")
_sample_edges("x20_type_dependencies", "UsesType", "DependsOn", "Inherits", "Implements")
_sample_edges("x22_contracts", "AcceptsDto", "ReturnsDto")
_sample_edges("x01_x07_members", "Declares", "HasMethod", "HasConstructor", "HasProperty", "HasField")

_SAMPLES = (
    ("app/svc.py", 'import os, requests\n@app.get("/items")\ndef items(a: Item):\n    if a:\n        return requests.post("http://x/y")\n    return os.getenv("PORT")\n'),
    ("web/a.ts", "import { B } from './b';\n@Controller('cats')\nexport class A extends B {\n  @Get(':id')\n  find(id: string) { bus.emit('found'); return fetch('http://a/b' + process.env.HOST); }\n}\napp.post('/users', create);\n"),
    ("web/b.ts", "export class B {\n  stop() { return 1; }\n}\n"),
    ("j/Foo.java", 'package j;\n@Service\npublic class Foo {\n    public String run() { return System.getenv("HOME"); }\n}\n'),
    ("g/x.go", 'package g\nfunc Run() { os.Getenv("X"); http.Get("http://g") }\n'),
    ("r/m.rs", 'pub fn go() { let k = env::var("K"); reqwest::get("http://r"); }\n'),
    ("p/u.php", "<?php\nfunction top() { getenv('N'); return file_get_contents('http://p'); }\n"),
    ("c/S.cs", 'namespace C;\npublic class S : DbContext\n{\n    public DbSet<User> Users { get; set; }\n    public void Go() { s.AddScoped<IRepo, Repo>(); app.UseAuth(); app.UseRouting(); app.MapGet("/ping", Ping); throw new Oops(); }\n}\n'),
)


def _sample_rows(spark: SparkSession) -> DataFrame:
    return E.extract(_files(spark, *_SAMPLES))


def _edges(name: str, kinds: tuple[str, ...], *rows: tuple) -> None:
    def run(spark, d):
        return E.edges_of(_sample_rows(spark)).where(F.col("type").isin(*kinds)).select("from_fqn", "to_fqn", "type")

    QUERIES[name] = run
    ORACLE[name] = _values("from_fqn, to_fqn, type", *rows)


_edges(
    "x10_http_calls", ("HttpCalls",),
    ("app.svc.items", "http:http://x/y", "HttpCalls"), ("web/a.ts:A.find", "http:http://a/b", "HttpCalls"), ("g.Run", "http:http://g", "HttpCalls"), ("crate::r::m::go", "http:http://r", "HttpCalls"), ("top", "http:http://p", "HttpCalls"),
)
_edges(
    "x11_config_reads", ("ReadsConfig",),
    ("app.svc.items", "env:PORT", "ReadsConfig"), ("web/a.ts:A.find", "env:HOST", "ReadsConfig"), ("j.Foo.run", "env:HOME", "ReadsConfig"), ("g.Run", "env:X", "ReadsConfig"), ("crate::r::m::go", "env:K", "ReadsConfig"), ("top", "env:N", "ReadsConfig"),
)
_edges("x12_events", ("Publishes", "Subscribes"), ("web/a.ts:A.find", "event:found", "Publishes"))
_edges("x14_mappings", ("MapsTo", "Configures"), ("C.S", "User", "MapsTo"))
_edges(
    "x15_x17_routes", ("HandledBy",),
    ("API:GET:items", "app.svc.items", "HandledBy"), ("API:GET:cats/:id", "web/a.ts:A.find", "HandledBy"), ("API:POST:users", "create", "HandledBy"), ("API:GET:ping", "Ping", "HandledBy"),
)
_edges("x18_middleware_order", ("PipelineOrder",), ("middleware:UseAuth", "middleware:UseRouting", "PipelineOrder"))
_edges("x21_exceptions", ("Throws", "Catches"), ("C.S.Go", "Oops", "Throws"))


@_q(_values("fqn, signature", ("DI:j.Foo->j.Foo", "Service"), ("DI:IRepo->Repo", "Scoped")))
def x13_registrations(spark, d):
    return E.symbols_of(_sample_rows(spark)).where("kind = 'di_registration'").select("fqn", "signature")


@_q(_values("from_fqn, to_fqn", ("web/a.ts", "web/b.ts")))
def j14_import_resolution(spark, d):
    rows = _sample_rows(spark)
    e = E.resolve_imports(E.edges_of(rows), E.symbols_of(rows).select(F.col("path").alias("module")))
    return e.where("type = 'DependsOn' AND from_fqn = 'web/a.ts'").select("from_fqn", "to_fqn")


_CALLS = (
    ("a.ts", "import { run as launch, stop } from './lib/b';\nexport function own() { launch(); stop(); own(); rare(); twice(); }\n"),
    ("lib/b.ts", "export function run() { return 1; }\nexport function stop() { return 2; }\nexport function twice() { return 3; }\n"),
    ("c.ts", "export function run() { return 4; }\nexport function stop() { return 5; }\nexport function rare() { return 6; }\nexport function twice() { return 7; }\n"),
)


@_q(_values("from_fqn, to_fqn", *[("a.ts:own", t) for t in ("lib/b.ts:run", "lib/b.ts:stop", "a.ts:own", "c.ts:rare", "twice")]))
def j15_callee_cascade(spark, d):
    """Own file, imported name, name that exists once, else as written."""
    rows = E.extract(_files(spark, *_CALLS))
    s = E.symbols_of(rows)
    return E.resolve_calls(E.resolve_imports(E.edges_of(rows), s.select(F.col("path").alias("module"))), s).where("type = 'Calls'").select("from_fqn", "to_fqn")


# ---- configuration and manifests, literal ----

_CONFIG = (
    ("a/appsettings.json", '{"Db": {"Url": "x", "Pool": {"Max": 5}}, // note\n "List": [1], "Debug": true, "None": null}'),
    ("a/.env", "# c\nPORT=80\n bad key=1\n=x\nHOST = h # y\n\n"),
    ("a/docker-compose.yml", "services:\n  web:\n    environment:\n      - A=1\n      - B\n      C: 2\n      # no\n    image: x\n  D: 3\n"),
    ("a/node_modules/appsettings.json", '{"No": 1}'),
)


@_q(_values("path, key, value", ("a/appsettings.json", "Db:Url", "x"), ("a/appsettings.json", "Db:Pool:Max", "5"), ("a/appsettings.json", "Debug", "true"), ("a/appsettings.json", "None", None)))
def f17_json_keys(spark, d):
    return P.json_keys(_files(spark, _CONFIG[0]))


@_q("WITH t AS (SELECT '" + _CONFIG[1][1].replace("\n", "' || chr(10) || '") + "' AS c), l AS (SELECT unnest(list_zip(string_split(c, chr(10)), range(1, len(string_split(c, chr(10))) + 1))) AS z FROM t) SELECT 'a/.env' AS path, z[2] AS line, trim(split_part(trim(z[1]), '=', 1)) AS key FROM l WHERE trim(z[1]) <> '' AND NOT starts_with(trim(z[1]), '#') AND instr(trim(z[1]), '=') > 1 AND regexp_matches(trim(split_part(trim(z[1]), '=', 1)), '^[\\p{L}_][\\p{L}\\p{Nd}_]*$')")
def f18_dotenv(spark, d):
    return P.dotenv_keys(_files(spark, _CONFIG[1]))


@_q(_values("path, line, key", ("a/docker-compose.yml", 4, "A"), ("a/docker-compose.yml", 6, "C")))
def f20_compose(spark, d):
    return P.compose_keys(_files(spark, _CONFIG[2]))


@_q(_values("fqn, provider", ("config:Db:Url", "json"), ("config:Db:Pool:Max", "json"), ("config:Debug", "json"), ("config:None", "json"), ("env:PORT", "env"), ("env:HOST", "env"), ("env:A", "docker-compose"), ("env:C", "docker-compose")))
def src07_config_scan(spark, d):
    return P.config_keys(S.config_files(_files(spark, *_CONFIG))).select("fqn", "provider")


@_q(_values("path, alias, target", ("tsconfig.json", "@app/", "src/app/"), ("tsconfig.json", "~/", "src/")))
def f16_tsconfig_aliases(spark, d):
    return P.tsconfig_aliases(_files(spark, ("tsconfig.json", '{"compilerOptions": {"baseUrl": "./src", /* c */ "paths": {"@app/*": ["./app/*", "x/*"], "~/*": ["*"], "one": ["o"]}}}')))


_MANIFESTS = (
    ("w/package.json", '{"name": "@a/w", "dependencies": {"left": "^1.0", "odd": {"x": 1}}, "devDependencies": {"jest": "29"}, "peerDependencies": {"react": ">=18"}}'),
    ("h/composer.json", '{"require": {"php": ">=8"}, "require-dev": {"phpunit": "^9"}}'),
    ("p/requirements.txt", "# c\nflask[async]>=2.0 # web\n-r other.txt\ngit+https://x\nnumpy ; python_version<'3'\n\n"),
    ("p/requirements-dev.txt", "pytest==8.0\n"),
    ("q/pyproject.toml", '[project]\nname = "q"\ndependencies = [\n  "a>=1",\n  "b",\n]\n[project.optional-dependencies]\ntest = ["c~=2"]\nweb = ["d"]\n[tool.poetry.dependencies]\npython = "^3"\ne = "^5"\n[tool.poetry.group.dev.dependencies]\nf = {version = "6"}\n'),
    ("r/Cargo.toml", '[dependencies]\nserde = "1"\ntokio = { version = "1.3", features = ["x"] }\nlocal = { path = "../l" }\n[dev-dependencies]\ncrit = "0.5"\n[target."cfg(unix)".dependencies]\nnix = "0.2"\n'),
    ("g/go.mod", "module g\nrequire x.y/z v1.2.3\nrequire (\n\ta.b/c v0.1.0\n\td.e/f v0.2.0 // indirect\n)\n"),
    ("m/pom.xml", '<project xmlns="http://maven"><dependencies><dependency><groupId>org.a</groupId><artifactId>b</artifactId><version>1</version></dependency><dependency><groupId>j</groupId><artifactId>u</artifactId><scope>test</scope></dependency></dependencies></project>'),
    ("c/App.csproj", '<Project><ItemGroup><PackageReference Include="N.A" Version="1.1" /><PackageReference Update="N.B"><Version>2.2</Version></PackageReference><PackageReference Include="N.C" /></ItemGroup></Project>'),
    ("node_modules/x/package.json", '{"dependencies": {"no": "1"}}'),
    ("z/package.json", "{ not json"),
)
_DEPENDENCIES = (
    ("left", "^1.0", "npm", "w/package.json", False), ("odd", "*", "npm", "w/package.json", False), ("jest", "29", "npm", "w/package.json", True), ("react", ">=18", "npm", "w/package.json", False),
    ("php", ">=8", "composer", "h/composer.json", False), ("phpunit", "^9", "composer", "h/composer.json", True),
    ("flask", ">=2.0", "pip", "p/requirements.txt", False), ("numpy", "*", "pip", "p/requirements.txt", False), ("pytest", "==8.0", "pip", "p/requirements-dev.txt", True),
    ("a", ">=1", "pip", "q/pyproject.toml", False), ("b", "*", "pip", "q/pyproject.toml", False), ("c", "~=2", "pip", "q/pyproject.toml", True), ("d", "*", "pip", "q/pyproject.toml", False),
    ("e", "^5", "pip", "q/pyproject.toml", False), ("f", "6", "pip", "q/pyproject.toml", True),
    ("serde", "1", "cargo", "r/Cargo.toml", False), ("tokio", "1.3", "cargo", "r/Cargo.toml", False), ("local", "*", "cargo", "r/Cargo.toml", False), ("crit", "0.5", "cargo", "r/Cargo.toml", True), ("nix", "0.2", "cargo", "r/Cargo.toml", False),
    ("x.y/z", "v1.2.3", "go", "g/go.mod", False), ("a.b/c", "v0.1.0", "go", "g/go.mod", False),
    ("org.a:b", "1", "maven", "m/pom.xml", False), ("j:u", "*", "maven", "m/pom.xml", True),
    ("N.A", "1.1", "nuget", "c/App.csproj", False), ("N.B", "2.2", "nuget", "c/App.csproj", False), ("N.C", "*", "nuget", "c/App.csproj", False),
)
_DEP = "name, version, ecosystem, manifest, is_dev"


@_q(_values(_DEP, *_DEPENDENCIES))
def src08_x26_dependencies(spark, d):
    """All manifests of a tree."""
    return P.dependencies(S.manifest_files(_files(spark, *_MANIFESTS)))


@_q(f"SELECT * FROM ({_values(_DEP, *_DEPENDENCIES)}) WHERE lower(ecosystem) = 'nuget'")
def sel13_x27_ecosystem(spark, d):
    return P.dependencies(S.manifest_files(_files(spark, *_MANIFESTS)), "NuGet")


@_q(f"SELECT manifest, min(ecosystem) AS ecosystem, count(*) AS n, string_agg(name || '@' || version, ',' ORDER BY is_dev, lower(name), name, version) AS packages FROM ({_values(_DEP, *_DEPENDENCIES)}) GROUP BY manifest")
def a05_a06_by_manifest(spark, d):
    return P.by_manifest(P.dependencies(S.manifest_files(_files(spark, *_MANIFESTS)))).withColumn("packages", F.array_join("packages", ","))


_TREE = (("src/a.ts", ""), ("src/gen/b.generated.cs", ""), ("docs/legacy/c.py", ""), ("docs/legacyx/d.py", ""), ("vendor/e.go", ""), ("x/Tmp/f.rs", ""), ("README.md", ""), ("bin/g.py", ""))


@_q(_values("path", ("src/a.ts",), ("docs/legacyx/d.py",)))
def src01_src05_scan(spark, d):
    """Known extensions, excluded directories, and ignore patterns of all three forms."""
    ignore = S.ignore_patterns(_files(spark, (".ignore", "# c\n*.generated.cs\n docs/legacy/ \n\ntmp\n")))
    return S.source_files(_files(spark, *_TREE), ignore).select("path")


def _zip(*members: tuple[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members:
            z.writestr(name, text)
    return out.getvalue()


_UPLOADS = (("one.zip", _zip(("src/a.ts", "export class A {}"), ("src/", ""), ("../up.ts", "x"), ("/abs.ts", "x"), ("docs/empty.md", ""), ("w\\b.py", "def f(): pass\n"))), ("none.zip", b"no archive"), ("null.zip", None))


@_q(_values("archive, path, length, failed", ("one.zip", "src/a.ts", 17, False), ("one.zip", "w/b.py", 14, False), ("none.zip", None, None, True)))
def src14_zip_upload(spark, d):
    """Uploaded archives; what would leave its folder is left out, a broken archive tells so."""
    found = S.unzipped(spark.createDataFrame(list(_UPLOADS), "name string, data binary"), "name", "data")
    return found.select("archive", "path", "length", F.col("error").isNotNull().alias("failed"))


_PAYLOADS = (
    '{"project_name": "p", "symbols": [{"fqn": "a.b", "name": "b", "kind": "class"}, {"fqn": " ", "name": "x"}], "relationships": [{"from_fqn": "a.b", "to_fqn": "c", "type": "Calls"}, {"from_fqn": "a", "to_fqn": "c", "type": "Odd"}], "file_hashes": {"f.py": "AA"}}',
    '{"project_name": "q", "symbols": [], "file_hashes": {}}',
    '{"project_name": "r", "file_hashes": {"g.py": "BB", "h.py": null}}',
)


@_q(_values("part, a, b, c", ("symbol", "a.b", "b", "class"), ("edge", "a.b", "c", "Calls"), ("edge", "a", "c", "References"), ("hash", "p", "f.py", "AA"), ("hash", "r", "g.py", "BB"), ("hash", "r", "h.py", None)))
def src15_ingest(spark, d):
    """Uploaded metadata as symbols, edges and hashes."""
    raw = spark.createDataFrame([(x,) for x in _PAYLOADS], "j string").select(F.from_json("j", S.INGEST).alias("p")).select("p.*")
    s, e, h = S.ingested(raw)
    row = lambda df, part, *cols: df.select(F.lit(part).alias("part"), *[F.col(c).alias(n) for c, n in zip(cols, "abc", strict=True)])
    return row(s, "symbol", "fqn", "name", "kind").unionByName(row(e, "edge", "from_fqn", "to_fqn", "type")).unionByName(row(h, "hash", "project_name", "file_path", "content_hash"))


@_q(_values("pattern", ("*.generated.cs",), ("docs/legacy",), ("tmp",)))
def src04_ignore_file(spark, d):
    return S.ignore_patterns(_files(spark, (".ignore", "# c\n*.generated.cs\n docs/legacy/ \n\ntmp\n")))


@_q(_values("path", ("README.md",)))
def src06_markdown_scan(spark, d):
    return S.markdown_files(_files(spark, *_TREE)).select("path")


@_q(_values("path", ("src/a.ts",), ("x/Tmp/f.rs",)))
def src09_file_list(spark, d):
    return S.changed_only(_files(spark, *_TREE), spark.createDataFrame([("src/a.ts",), ("x/Tmp/f.rs",), ("gone.ts",)], "path string")).select("path")


@_q(_values("path", ("tools/C.csproj",)))
def src11_j16_orphan_projects(spark, d):
    return S.projects_outside_solutions(_files(spark, ("all.sln", 'Project("{F}") = "A", "src\\A.csproj", "{1}"'), ("n.slnx", '<Project Path="src/B.csproj" />'), ("src/A.csproj", ""), ("src/B.csproj", ""), ("tools/C.csproj", "")))


@_q(_values("name, rule", ("w", "package")))
def src12_project_name(spark, d):
    return S.project_name(_files(spark, ("package.json", '{"name": "@a/w"}'), ("pyproject.toml", '[project]\nname = "q"\n')), "/x/dir")


@_q(_values("found", (True,)))
def src18_probe(spark, d):
    return spark.createDataFrame([(S.any_indexable(_files(spark, *_TREE)),)], "found boolean")


@_q("SELECT edge_id, CASE WHEN type IN (" + ", ".join(f"'{t}'" for t in S.EDGE_TYPES) + ") THEN type ELSE 'References' END AS value FROM relationships")
def src15_known_types(spark, d):
    return table(spark, d, "relationships").select("edge_id", S.known_type("type").alias("value"))
