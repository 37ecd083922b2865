"""Queries of the graph operators over the symbol and edge tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import graph as G
from tessera.operators.rank import numbered
from tessera.tables import blank, live_rows, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: SQL of the live symbols and of the clean edges, shared by the queries below.
LIVE = """
live AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fqn ORDER BY indexed_at DESC, id DESC) AS rn FROM code_symbols WHERE fqn IS NOT NULL)
  WHERE rn = 1 AND deleted_at IS NULL),
e AS (SELECT DISTINCT from_fqn, to_fqn, type FROM relationships WHERE trim(from_fqn) <> '' AND trim(to_fqn) <> '')
"""
_NOISE = "(" + "fqn IN (" + ", ".join(f"'{n}'" for n in X.NOISE_NAMES) + ")" + "".join(f" OR starts_with(fqn, '{p}')" for p in X.NOISE_PREFIXES) + ")"


def symbols(spark: SparkSession, d: str) -> DataFrame:
    return live_rows(table(spark, d, "code_symbols"), "name", "kind", "signature", "file_path", "start_line", "end_line", "repo_id", "accessibility", "documentation", "is_test_method")


def edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "relationships").select("from_fqn", "to_fqn", "type")


def busiest(spark: SparkSession, d: str, kind: str, end: str) -> str:
    """The fqn with the most edges of a type at one end, smallest fqn first: the start of a sample traversal."""
    e = G.clean_edges(edges(spark, d), kind)
    r = e.groupBy(end).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), end).first()
    return r[0] if r else ""


def _busiest_sql(kind: str, end: str) -> str:
    return f"(SELECT {end} FROM e WHERE type = '{kind}' GROUP BY {end} ORDER BY count(*) DESC, {end} LIMIT 1)"


def _q(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def _walk(name: str, kind: str, start: str, depth: int, reverse: bool = False) -> str:
    """SQL of a bounded closure as ``name`` (fqn, dist), from the fqns that ``start`` selects."""
    here, there = ("to_fqn", "from_fqn") if reverse else ("from_fqn", "to_fqn")
    return f"""
{name}_w AS (
  SELECT e.{there} AS fqn, 1 AS dist FROM e WHERE type = '{kind}' AND e.{here} IN ({start})
  UNION
  SELECT e.{there}, w.dist + 1 FROM {name}_w w JOIN e ON e.type = '{kind}' AND e.{here} = w.fqn WHERE w.dist < {depth}),
{name} AS (SELECT fqn, min(dist) AS dist FROM {name}_w GROUP BY fqn)"""


for _depth in (1, 2, 3):

    def _callers(spark, d, depth=_depth):
        out = G.callers(edges(spark, d), symbols(spark, d), busiest(spark, d, "Calls", "to_fqn"), depth)
        return out.select("fqn", "dist")

    QUERIES[f"g01_callers_d{_depth}"] = _callers
    _start = _busiest_sql("Calls", "to_fqn")
    ORACLE[f"g01_callers_d{_depth}"] = f"""
WITH RECURSIVE {LIVE}, x AS (SELECT {_start} AS f),
{_walk("c", "Calls", "SELECT e2.to_fqn FROM e e2, x WHERE e2.to_fqn = x.f OR starts_with(e2.to_fqn, x.f || '(')", _depth, True)},
iface AS (
  SELECT DISTINCT a.from_fqn AS fqn FROM e a, (SELECT DISTINCT to_fqn AS i FROM e, x WHERE type = 'Implements' AND contains(from_fqn, regexp_extract(x.f, '(?s)^(.*)\\.[^.]*$', 1))) i, x
  WHERE a.type = 'Calls' AND regexp_extract(x.f, '(?s)^(.*)\\.[^.]*$', 1) <> '' AND contains(a.to_fqn, i.i)
    AND regexp_extract(CASE WHEN instr(a.to_fqn, '(') > 1 THEN split_part(a.to_fqn, '(', 1) ELSE a.to_fqn END, '[^.]*$') = regexp_extract(x.f, '[^.]*$') AND NOT contains(a.from_fqn, i.i))
SELECT fqn, dist FROM c UNION ALL SELECT fqn, 1 FROM iface WHERE fqn NOT IN (SELECT fqn FROM c)"""

for _depth in (2, 5):

    def _callees(spark, d, depth=_depth):
        return G.callees(edges(spark, d), busiest(spark, d, "Calls", "from_fqn"), depth)

    QUERIES[f"g02_callees_d{_depth}"] = _callees
    ORACLE[f"g02_callees_d{_depth}"] = f"""
WITH RECURSIVE {LIVE}, x AS (SELECT {_busiest_sql("Calls", "from_fqn")} AS f),
{_walk("c", "Calls", "SELECT e2.from_fqn FROM e e2, x WHERE e2.from_fqn = x.f OR starts_with(e2.from_fqn, x.f || '(')", _depth)}
SELECT fqn, dist FROM c WHERE NOT {_NOISE}"""


@_q(f"""
WITH RECURSIVE {LIVE}, x AS (SELECT {_busiest_sql("UsesType", "from_fqn")} AS f),
{_walk("a", "DependsOn", "SELECT f FROM x", 2)}, {_walk("b", "UsesType", "SELECT f FROM x", 2)}, {_walk("c", "References", "SELECT f FROM x", 2)},
u AS (SELECT fqn, dist, 0 AS branch FROM a UNION ALL SELECT fqn, dist, 1 FROM b UNION ALL SELECT fqn, dist, 2 FROM c)
SELECT fqn, arg_min(dist, (branch, dist)) AS dist, min(branch) AS branch FROM u WHERE NOT {_NOISE} GROUP BY fqn""")
def g03_dependencies_d2(spark, d):
    return G.dependencies(edges(spark, d), busiest(spark, d, "UsesType", "from_fqn"), 2).select("fqn", "dist", "branch")


@_q(f"WITH RECURSIVE {LIVE}, {_walk('c', 'References', _busiest_sql('References', 'to_fqn'), 2, True)} SELECT fqn, dist FROM c")
def g04_referenced_by_d2(spark, d):
    return G.referenced_by(edges(spark, d), busiest(spark, d, "References", "to_fqn"), 2)


@_q(f"WITH {LIVE}, x AS (SELECT {_busiest_sql('Implements', 'to_fqn')} AS f) SELECT DISTINCT from_fqn AS fqn FROM e, x WHERE type = 'Implements' AND (to_fqn = f OR starts_with(to_fqn, f || '<'))")
def g05_implementations(spark, d):
    return G.implementations(edges(spark, d), busiest(spark, d, "Implements", "to_fqn"))


@_q(f"""
WITH RECURSIVE {LIVE}, x AS (SELECT {_busiest_sql("Inherits", "to_fqn")} AS f),
{_walk("a", "Inherits", "SELECT f FROM x", 10)}, {_walk("b", "Inherits", "SELECT f FROM x", 10, True)}, {_walk("c", "Implements", "SELECT f FROM x", 10)}, {_walk("g", "Implements", "SELECT f FROM x", 10, True)},
u AS (SELECT fqn, dist, 0 AS branch FROM a UNION ALL SELECT fqn, dist, 1 FROM b UNION ALL SELECT fqn, dist, 2 FROM c UNION ALL SELECT fqn, dist, 3 FROM g UNION ALL SELECT f, 0, 4 FROM x)
SELECT fqn, arg_min(dist, (branch, dist)) AS dist, min(branch) AS branch FROM u GROUP BY fqn""")
def g06_hierarchy(spark, d):
    return G.class_hierarchy(edges(spark, d), busiest(spark, d, "Inherits", "to_fqn")).select("fqn", "dist", "branch")


@_q(f"WITH {LIVE}, x AS (SELECT {_busiest_sql('TestCovers', 'to_fqn')} AS f) SELECT DISTINCT from_fqn AS fqn FROM e, x WHERE type = 'TestCovers' AND (to_fqn = f OR starts_with(to_fqn, f || '.') OR starts_with(to_fqn, f || '('))")
def g07_test_coverage(spark, d):
    return G.test_coverage(edges(spark, d), busiest(spark, d, "TestCovers", "to_fqn"))


_CLASS = "(SELECT CASE WHEN contains(f, '.') THEN regexp_extract(f, '(?s)^(.*)\\.[^.]*$', 1) ELSE f END FROM x)"


def _class_of(spark, d) -> str:
    f = busiest(spark, d, "HasMethod", "to_fqn")
    return f.rpartition(".")[0] or f


@_q(f"""WITH {LIVE}, x AS (SELECT {_busiest_sql('HasMethod', 'to_fqn')} AS f)
SELECT fqn, name, kind FROM live WHERE lower(kind) IN ('method', 'function', 'constructor') AND starts_with(fqn, {_CLASS} || '.') ORDER BY name, fqn LIMIT 10""")
def g08_methods_of_type(spark, d):
    return G.methods_of_type(symbols(spark, d), _class_of(spark, d))


@_q("WITH " + LIVE + " SELECT fqn, name FROM live WHERE lower(kind) = 'constructor' AND contains(fqn, 'Router')")
def g09_registrations(spark, d):
    """Label scan with a case-sensitive substring; these tables have no registrations, so constructors stand in."""
    return symbols(spark, d).where((F.lower("kind") == "constructor") & F.col("fqn").contains("Router")).select("fqn", "name")


@_q("WITH " + LIVE + " SELECT to_fqn AS fqn, CASE WHEN bool_or(type = 'UsesType') THEN 0 ELSE 1 END AS branch FROM e WHERE type IN ('UsesType', 'DependsOn') GROUP BY to_fqn")
def g10_entity_map(spark, d):
    """G10 over UsesType and DependsOn, which stand in for MapsTo and Configures."""
    e = edges(spark, d).where(F.col("type").isin("UsesType", "DependsOn"))
    return G.mapped_entities(e.withColumn("type", F.when(F.col("type") == "UsesType", "MapsTo").otherwise("Configures")))


@_q("WITH " + LIVE + " SELECT fqn, name, file_path FROM live WHERE lower(kind) = 'api_endpoint'")
def g11_endpoints(spark, d):
    return G.api_endpoints(symbols(spark, d))


@_q("WITH " + LIVE + " SELECT fqn, name, file_path FROM live WHERE lower(kind) = 'api_endpoint' AND (contains(lower(replace(file_path, '\\', '/')), '/graphcontroller.cs') OR contains(lower(replace(file_path, '\\', '/')), '/graph/')) ORDER BY name, fqn LIMIT 500")
def g11_endpoints_module(spark, d):
    return G.api_endpoints(symbols(spark, d), "Graph")


@_q(f"""
WITH RECURSIVE {LIVE}, ep AS (SELECT DISTINCT fqn FROM live WHERE lower(kind) = 'api_endpoint' AND contains(lower(fqn), 'a') ORDER BY fqn LIMIT 20),
h AS (SELECT DISTINCT to_fqn AS fqn FROM e WHERE type = 'HandledBy' AND from_fqn IN (SELECT fqn FROM ep)),
{_walk("c", "Calls", "SELECT fqn FROM h", 3)}
SELECT fqn, min(dist) AS dist FROM (SELECT fqn, 0 AS dist FROM h UNION ALL SELECT fqn, dist FROM c) WHERE NOT {_NOISE} GROUP BY fqn""")
def g12_data_flow(spark, d):
    return G.data_flow(edges(spark, d), symbols(spark, d), "/A").select("fqn", "dist")


@_q("""WITH """ + LIVE + """, k AS (SELECT DISTINCT to_fqn AS fqn FROM e WHERE type = 'ReadsConfig' AND (starts_with(to_fqn, 'env:') OR starts_with(to_fqn, 'config:')) AND contains(to_fqn, 'ACCESS'))
SELECT fqn, 'key' AS part FROM k UNION ALL SELECT DISTINCT from_fqn, 'reader' FROM e WHERE type = 'ReadsConfig' AND to_fqn IN (SELECT fqn FROM k)""")
def g13_config_usage(spark, d):
    return G.config_usage(edges(spark, d), "ACCESS")


_CANDIDATE = """
cand AS (
  SELECT fqn, name FROM live WHERE lower(kind) IN ('method', 'function') AND (accessibility IS NULL OR lower(trim(accessibility)) IN ('public', 'internal', 'export'))
    AND NOT coalesce(is_test_method, false) AND NOT starts_with(name, '_')
    AND NOT regexp_matches(lower(coalesce(replace(file_path, '\\', '/'), '')), 'test_|/tests/|\\.test\\.|\\.spec\\.|/migrations/versions/'))"""
_MNAME = "regexp_extract(CASE WHEN instr(to_fqn, '(') > 1 THEN split_part(to_fqn, '(', 1) ELSE to_fqn END, '[^.]*$')"
_ALIVE = f"""
has AS (SELECT from_fqn AS owner, to_fqn AS fqn, {_MNAME} AS name FROM e WHERE type = 'HasMethod'),
pairs AS (
  SELECT c.fqn AS cf, b.fqn AS bf FROM has c JOIN e i ON i.type = 'Inherits' AND i.from_fqn = c.owner
  JOIN has b ON b.name = c.name AND (b.owner = i.to_fqn OR (regexp_extract(b.owner, '[^.]*$') = i.to_fqn))),
over AS (SELECT cf AS fqn FROM pairs UNION SELECT bf FROM pairs),
proto AS (SELECT fqn FROM has WHERE name IN (SELECT name FROM has WHERE owner IN (SELECT from_fqn FROM e WHERE type = 'Inherits' AND regexp_extract(to_fqn, '[^.]*$') = 'Protocol'))),
used AS (SELECT to_fqn AS fqn FROM e WHERE type IN ('Calls', 'HandledBy', 'Subscribes', 'TestCovers'))"""


@_q(f"WITH {LIVE}, {_CANDIDATE}, {_ALIVE} SELECT fqn, name FROM cand WHERE name NOT IN ('Main', 'main', '.ctor', 'ctor') AND fqn NOT IN (SELECT fqn FROM used) AND fqn NOT IN (SELECT fqn FROM over) AND fqn NOT IN (SELECT fqn FROM proto)")
def g14_dead_code(spark, d):
    return G.dead_code(symbols(spark, d), edges(spark, d))


@_q(f"WITH {LIVE}, {_CANDIDATE}, {_ALIVE} SELECT fqn, name FROM (SELECT * FROM cand ORDER BY name, fqn LIMIT 500) WHERE name NOT IN ('Main', 'main', '.ctor', 'ctor') AND fqn NOT IN (SELECT fqn FROM used) AND fqn NOT IN (SELECT fqn FROM over) AND fqn NOT IN (SELECT fqn FROM proto)")
def g14_dead_code_page(spark, d):
    return G.dead_code(symbols(spark, d), edges(spark, d), limit=500)


@_q(f"WITH {LIVE}, {_ALIVE} SELECT DISTINCT fqn FROM used")
def j05_used_targets(spark, d):
    return G.used_targets(edges(spark, d))


#: Edges that the fixed tables lack, added to theirs: overrides by full and bare name of the base, a protocol, and a ring of DependsOn.
MORE_EDGES = (
    ("fx.Base", "fx.Base.fetch", "HasMethod"), ("fx.Rss", "fx.Rss.fetch", "HasMethod"), ("fx.Rss", "fx.Base", "Inherits"), ("fx.Atom", "fx.Atom.fetch(int)", "HasMethod"), ("fx.Atom", "Base", "Inherits"),
    ("fx.Base", "fx.Base.alone", "HasMethod"), ("fx.Rss", "fx.Rss.orphan", "HasMethod"), ("fx.Adapter", "Protocol", "Inherits"), ("fx.Adapter", "fx.Adapter.pull", "HasMethod"), ("fx.Feed", "fx.Feed.pull", "HasMethod"),
)
#: Lengths of rings of DependsOn edges, added as well.
RINGS = (2, 3, 12)


def more_edges(spark: SparkSession, d: str) -> DataFrame:
    """The edges with :data:`MORE_EDGES` and :data:`RINGS`."""
    rings = [(f"fx.Ring{n}.C{i}", f"fx.Ring{n}.C{(i + 1) % n}", "DependsOn") for n in RINGS for i in range(n)]
    return edges(spark, d).unionByName(spark.createDataFrame([*MORE_EDGES, *rings], "from_fqn string, to_fqn string, type string"))


_MORE = f"""
more AS (
  SELECT from_fqn, to_fqn, type FROM relationships UNION ALL SELECT * FROM (VALUES {", ".join(str(x) for x in MORE_EDGES)})
  UNION ALL SELECT 'fx.Ring' || n || '.C' || i, 'fx.Ring' || n || '.C' || ((i + 1) % n), 'DependsOn' FROM (SELECT n, unnest(range(n)) AS i FROM (VALUES {", ".join(f"({n})" for n in RINGS)}) v(n))),
e AS (SELECT DISTINCT from_fqn, to_fqn, type FROM more WHERE trim(from_fqn) <> '' AND trim(to_fqn) <> '')
"""


@_q(f"WITH {_MORE}, {_ALIVE} SELECT fqn FROM over")
def j06_j07_overrides(spark, d):
    return G.override_methods(more_edges(spark, d))


@_q(f"WITH {_MORE}, {_ALIVE} SELECT DISTINCT fqn FROM proto")
def j08_protocol(spark, d):
    return G.protocol_methods(more_edges(spark, d))


def _cycle_sql(kind: str) -> str:
    return f"""
WITH RECURSIVE {_MORE}, k AS (SELECT from_fqn, to_fqn FROM e WHERE type = '{kind}'),
w AS (SELECT from_fqn AS s, to_fqn AS t FROM k UNION SELECT w.s, k.to_fqn FROM w JOIN k ON k.from_fqn = w.t)
SELECT DISTINCT s AS fqn FROM w WHERE s = t"""


@_q(_cycle_sql("DependsOn"))
def g15_on_cycle(spark, d):
    return G.on_cycle(more_edges(spark, d), "DependsOn")


@_q(_cycle_sql("Inherits"))
def g15_on_cycle_inherits(spark, d):
    return G.on_cycle(more_edges(spark, d), "Inherits")


@_q(f"""
WITH RECURSIVE {LIVE}, a AS (SELECT from_fqn, to_fqn FROM e WHERE type = 'Inherits'),
r AS (SELECT from_fqn AS s, to_fqn AS t FROM a UNION SELECT r.s, a.to_fqn FROM r JOIN a ON a.from_fqn = r.t),
c AS (SELECT s FROM r WHERE s = t), k AS (SELECT * FROM a WHERE from_fqn IN (SELECT s FROM c) AND to_fqn IN (SELECT s FROM c)),
w AS (
  SELECT from_fqn AS s, to_fqn AS t, [from_fqn, to_fqn] AS p FROM k WHERE to_fqn >= from_fqn
  UNION ALL SELECT w.s, k.to_fqn, list_append(w.p, k.to_fqn) FROM w JOIN k ON k.from_fqn = w.t
  WHERE w.t <> w.s AND k.to_fqn >= w.s AND (k.to_fqn = w.s OR NOT list_contains(w.p, k.to_fqn)))
SELECT 'all' AS repo_id, (row_number() OVER (ORDER BY s, p) - 1)::INTEGER AS n, array_to_string(p, ' -> ') AS path FROM w WHERE t = s""")
def g15_cycle_paths(spark, d):
    """All cycles of Inherits edges, which may cross repositories: one group, numbered by the smallest fqn of the component."""
    paths = G.all_cycle_paths(edges(spark, d), "Inherits")
    return numbered(paths, "component", "n").select(F.lit("all").alias("repo_id"), (F.col("place") - 1).alias("n"), F.array_join("path", " -> ").alias("path"))


@_q(f"WITH {LIVE} SELECT fqn, lower(kind) AS kind, name, (SELECT count(*) FROM live WHERE lower(kind) IN ('class', 'method')) AS total_matching FROM live WHERE lower(kind) IN ('class', 'method') ORDER BY 2, 3, 1 LIMIT 500")
def g16_overview_nodes(spark, d):
    return G.overview_nodes(symbols(spark, d), ["class", "method"])


@_q(f"WITH {LIVE}, n AS (SELECT fqn FROM live ORDER BY lower(kind), name, fqn LIMIT 500) SELECT from_fqn, to_fqn, type FROM e WHERE from_fqn IN (SELECT fqn FROM n) AND to_fqn IN (SELECT fqn FROM n)")
def g16_overview_edges(spark, d):
    return G.edges_inside(edges(spark, d), G.overview_nodes(symbols(spark, d)))


@_q(f"""
WITH RECURSIVE {LIVE}, x AS (SELECT {_busiest_sql('Calls', 'from_fqn')} AS f), u AS (SELECT from_fqn AS a, to_fqn AS b FROM e UNION SELECT to_fqn, from_fqn FROM e),
w AS (SELECT b AS fqn, 1 AS dist FROM u, x WHERE a = f UNION SELECT u.b, w.dist + 1 FROM w JOIN u ON u.a = w.fqn WHERE w.dist < 2)
SELECT fqn, min(dist) AS dist FROM w, x WHERE fqn <> f GROUP BY fqn""")
def g17_neighbors_d2(spark, d):
    return G.neighbors(edges(spark, d), busiest(spark, d, "Calls", "from_fqn"), 2)


@_q(f"""
WITH RECURSIVE {LIVE}, x AS (SELECT {_busiest_sql("Inherits", "to_fqn")} AS f),
{_walk("cl", "Calls", "SELECT e2.to_fqn FROM e e2, x WHERE e2.to_fqn = x.f OR starts_with(e2.to_fqn, x.f || '(')", 1, True)},
iface AS (
  SELECT DISTINCT a.from_fqn AS fqn FROM e a, (SELECT DISTINCT to_fqn AS i FROM e, x WHERE type = 'Implements' AND contains(from_fqn, regexp_extract(x.f, '(?s)^(.*)\\.[^.]*$', 1))) i, x
  WHERE a.type = 'Calls' AND regexp_extract(x.f, '(?s)^(.*)\\.[^.]*$', 1) <> '' AND contains(a.to_fqn, i.i)
    AND regexp_extract(CASE WHEN instr(a.to_fqn, '(') > 1 THEN split_part(a.to_fqn, '(', 1) ELSE a.to_fqn END, '[^.]*$') = regexp_extract(x.f, '[^.]*$') AND NOT contains(a.from_fqn, i.i)),
{_walk("a", "Inherits", "SELECT f FROM x", 10)}, {_walk("b", "Inherits", "SELECT f FROM x", 10, True)}, {_walk("c", "Implements", "SELECT f FROM x", 10)}, {_walk("g", "Implements", "SELECT f FROM x", 10, True)},
{_walk("r", "References", "SELECT f FROM x", 1, True)}
SELECT 'callers' AS section, fqn FROM (SELECT fqn FROM cl UNION SELECT fqn FROM iface)
UNION ALL SELECT DISTINCT 'implementations', from_fqn FROM e, x WHERE type = 'Implements' AND (to_fqn = f OR starts_with(to_fqn, f || '<'))
UNION ALL SELECT 'hierarchy', fqn FROM (SELECT fqn FROM a UNION SELECT fqn FROM b UNION SELECT fqn FROM c UNION SELECT fqn FROM g), x WHERE fqn <> f
UNION ALL SELECT 'referenced_by', fqn FROM r""")
def g18_impact(spark, d):
    return G.impact(edges(spark, d), symbols(spark, d), busiest(spark, d, "Inherits", "to_fqn"), 1)


@_q("WITH " + LIVE + """, k AS (SELECT from_fqn AS fqn FROM e WHERE from_fqn <> to_fqn UNION ALL SELECT to_fqn FROM e WHERE from_fqn <> to_fqn), c AS (SELECT fqn, count(*) AS degree FROM k GROUP BY fqn)
SELECT fqn, degree, round(20 + degree / (SELECT greatest(max(degree), 1)::DOUBLE FROM c) * 40)::BIGINT AS size FROM c""")
def g23_degrees(spark, d):
    return G.degrees(edges(spark, d))


#: Middleware symbols, which the fixed tables lack: fqn, name, file, line.
MIDDLEWARE = (("fx.UseAuth", "UseAuth", "src/Program.cs", 12), ("fx.UseCors", "UseCors", "src/Program.cs", 9), ("fx.UseRouting", "UseRouting", "src/Program.cs", 15), ("fx.UseLog", "UseLog", "src/Other.cs", 3), ("fx.UseNone", "UseNone", "src/Other.cs", None))


def _pipeline_sql(kind: str) -> str:
    rows = ", ".join(f"('{a}', '{b}', 'middleware', '{c}', {n if n is not None else 'NULL'})" for a, b, c, n in MIDDLEWARE)
    return f"""WITH {LIVE}, s AS (SELECT fqn, name, kind, file_path, start_line FROM live UNION ALL SELECT * FROM (VALUES {rows})),
p AS (SELECT fqn, file_path, start_line, name FROM s WHERE lower(kind) = '{kind}' ORDER BY name, fqn LIMIT 100)
SELECT fqn, file_path, row_number() OVER w AS place, lead(fqn) OVER w AS next_fqn FROM p WINDOW w AS (PARTITION BY file_path ORDER BY start_line NULLS FIRST, fqn)"""


def _with_middleware(spark: SparkSession, d: str) -> DataFrame:
    more = spark.createDataFrame(list(MIDDLEWARE), "fqn string, name string, file_path string, start_line int").withColumn("kind", F.lit("middleware"))
    return symbols(spark, d).select("fqn", "name", "kind", "file_path", "start_line").unionByName(more)


@_q(_pipeline_sql("middleware"))
def g22_pipeline(spark, d):
    return G.pipeline(_with_middleware(spark, d), "middleware")


@_q(_pipeline_sql("method"))
def g22_first_methods(spark, d):
    return G.pipeline(_with_middleware(spark, d), "method")


@_q(f"""WITH {LIVE}, x AS (SELECT {_busiest_sql('HasMethod', 'to_fqn')} AS f)
SELECT fqn, name, kind FROM live WHERE lower(kind) IN ('method', 'function', 'constructor') AND starts_with(fqn, {_CLASS} || '.') ORDER BY name, fqn LIMIT 10""")
def g25_did_you_mean(spark, d):
    return G.did_you_mean(symbols(spark, d), _class_of(spark, d) + ".NoSuchMember")


@_q("WITH " + LIVE + " SELECT e.from_fqn, e.to_fqn, e.type, s.kind FROM e JOIN live s ON s.fqn = e.to_fqn")
def j01_expand(spark, d):
    s = symbols(spark, d).select(F.col("fqn").alias("to_fqn"), "kind")
    return G.clean_edges(edges(spark, d)).join(s, "to_fqn").select("from_fqn", "to_fqn", "type", "kind")


@_q("WITH " + LIVE + """, fold AS (SELECT DISTINCT fqn, lower(kind) AS kind FROM live), t AS (SELECT DISTINCT to_fqn AS fqn FROM e)
SELECT t.fqn, coalesce(s.kind, CASE WHEN starts_with(t.fqn, 'DI:') THEN 'di_registration' WHEN starts_with(t.fqn, 'API:') THEN 'api_endpoint'
  WHEN starts_with(t.fqn, 'config:') OR starts_with(t.fqn, 'env:') THEN 'config_key' WHEN starts_with(t.fqn, 'doc:') THEN CASE WHEN contains(t.fqn, '#') THEN 'section' ELSE 'document' END
  WHEN contains(t.fqn, '(') THEN 'method' WHEN regexp_matches(t.fqn, '\\.I\\p{Lu}[^.]*$') THEN 'interface' ELSE 'class' END) AS kind FROM t LEFT JOIN fold s ON s.fqn = t.fqn""")
def j04_kind_lookup(spark, d):
    found = G.clean_edges(edges(spark, d)).select(F.col("to_fqn").alias("fqn")).distinct()
    return G.describe(found, symbols(spark, d)).select("fqn", "kind")


@_q("WITH " + LIVE + " SELECT from_fqn, to_fqn, type FROM e WHERE from_fqn IN (SELECT fqn FROM live) AND to_fqn IN (SELECT fqn FROM live)")
def j09_edges_inside(spark, d):
    return G.edges_inside(edges(spark, d), symbols(spark, d))


def _selected(name: str, match, sql: str, start=None, start_sql: str = "") -> None:
    """Predicates P1 to P4, P10, P12 on edge targets, for the busiest type's owner or another start."""

    def run(spark, d):
        f = (start or _class_of)(spark, d)
        return G.clean_edges(edges(spark, d)).select(F.col("to_fqn").alias("fqn")).distinct().where(match(f))

    QUERIES[name] = run
    first = start_sql or f"SELECT {_CLASS} AS c"
    ORACLE[name] = f"WITH {LIVE}, x AS (SELECT {_busiest_sql('HasMethod', 'to_fqn')} AS f), y AS ({first}) SELECT DISTINCT to_fqn AS fqn FROM e, y WHERE {sql}"


def _first_cut(mark: str):
    """The fqn before ``mark`` in the smallest edge target that has one: a start that its parametrised forms match."""

    def run(spark, d) -> str:
        r = G.typed_edges(edges(spark, d)).where(F.col("to_fqn").contains(mark) & ~F.col("to_fqn").startswith(mark)).agg(F.min("to_fqn")).first()[0]
        return r.split(mark)[0] if r else ""

    return run


def _first_cut_sql(mark: str) -> str:
    return f"SELECT split_part(min(to_fqn), '{mark}', 1) AS c FROM e WHERE instr(to_fqn, '{mark}') > 1"


_selected("sel01_member_match", lambda f: X.matches_member("fqn", f), "to_fqn = c OR starts_with(to_fqn, c || '(')", _first_cut("("), _first_cut_sql("("))
_selected("sel02_generic_match", lambda f: X.matches_generic("fqn", f), "to_fqn = c OR starts_with(to_fqn, c || '<')", _first_cut("<"), _first_cut_sql("<"))
_selected("sel03_covers_match", lambda f: X.covers_member("fqn", f), "to_fqn = c OR starts_with(to_fqn, c || '.') OR starts_with(to_fqn, c || '(')")
_selected("sel04_substring", lambda f: F.col("fqn").contains("Shared."), "contains(to_fqn, 'Shared.')")
_selected("sel10_narrow_noise", lambda f: ~(F.col("fqn").startswith("System.") | F.col("fqn").startswith("Microsoft.")), "NOT starts_with(to_fqn, 'System.') AND NOT starts_with(to_fqn, 'Microsoft.')")


def _optional(*conditions: Column | None) -> Column:
    """P5: the conjunction of the conditions that are given."""
    out = F.lit(True)
    for c in conditions:
        if c is not None:
            out = out & c
    return out


@_q("WITH " + LIVE + " SELECT fqn FROM live WHERE lower(kind) IN ('class', 'interface') AND contains(lower(name), 'router')")
def sel05_optional_filters(spark, d):
    """Optional conjunctive filters, a multi-valued kind."""
    return symbols(spark, d).where(_optional(F.lower("kind").isin("class", "interface"), None, F.lower("name").contains("router"))).select("fqn")


@_q("SELECT count(*) FILTER (WHERE from_fqn IS NULL OR trim(from_fqn) = '') AS no_from, count(*) FILTER (WHERE to_fqn IS NULL OR trim(to_fqn) = '') AS no_to, count(*) FILTER (WHERE trim(from_fqn) <> '' AND trim(to_fqn) <> '') AS kept FROM relationships")
def sel11_dropped_counts(spark, d):
    """Rows dropped for empty ends, counted beside those kept."""
    f, t = blank("from_fqn"), blank("to_fqn")
    return edges(spark, d).agg(F.count_if(f).alias("no_from"), F.count_if(t).alias("no_to"), F.count_if(~f & ~t).alias("kept"))


@_q("WITH " + LIVE + ", k AS (SELECT fqn, row_number() OVER (PARTITION BY lower(kind) ORDER BY name, fqn) AS place, count(*) OVER (PARTITION BY lower(kind)) AS n, lower(kind) AS kind FROM live) SELECT kind, fqn, place, greatest(n - 15, 0) AS more FROM k WHERE place <= 15")
def o07_first_n_with_overflow(spark, d):
    """The first 15 symbols of each kind and how many more there are."""
    s = symbols(spark, d).select(F.lower("kind").alias("kind"), "fqn", "name")
    w = Window.partitionBy("kind").orderBy("name", "fqn")
    first = s.withColumn("place", F.row_number().over(w)).where("place <= 15")
    n = s.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return first.join(F.broadcast(n), "kind").select("kind", "fqn", "place", F.greatest(F.col("n") - 15, F.lit(0)).alias("more"))
