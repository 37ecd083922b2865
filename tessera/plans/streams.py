"""Queries of file events, streams and composed reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.operators import reports as R
from tessera.plans import texts
from tessera.plans.graphs import _NOISE, LIVE, busiest, edges, symbols
from tessera.plans.retrieval import _query_vector, _search_sql
from tessera.session import scratch_dir
from tessera.streaming import watch as T
from tessera.streaming.progress import Progress, follow
from tessera.tables import live_rows, micros, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _q(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


_GAP = 6 * 3600 * 1_000_000


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    return spark.readStream.schema(_events(spark, d).schema).parquet(f"{d}/events*.parquet")


_ACCEPTED = f"""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS us FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
w AS (SELECT user_id, min(us) AS us FROM e GROUP BY user_id
  UNION ALL SELECT w.user_id, (SELECT min(e.us) FROM e WHERE e.user_id = w.user_id AND e.us >= w.us + {_GAP}) FROM w WHERE w.us IS NOT NULL)
SELECT user_id, us FROM w WHERE us IS NOT NULL"""


@_q(_ACCEPTED)
def t01_leading_debounce(spark, d):
    """User stands for the file; six hours for two seconds."""
    e = _events(spark, d).select("user_id", micros("ts").alias("us"))
    return T.leading_debounce(e, "user_id", "us", _GAP)


@_q(_ACCEPTED)
def t01_leading_debounce_stream(spark, d):
    e = _event_stream(spark, d).select("user_id", micros("ts").alias("us"))
    return T.collected(T.leading_debounce_stream(e, "user_id", "us", _GAP), "append")


_SESSIONS = """WITH g AS (SELECT user_id, ts, event_type, CASE WHEN lag(ts) OVER w + INTERVAL 6 HOUR > ts THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS n, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS paths FROM s GROUP BY user_id, k"""


def _flat(df: DataFrame) -> DataFrame:
    return df.select("user_id", micros("first_at").alias("first_us"), micros("last_at").alias("last_us"), "n", F.array_join("paths", ",").alias("paths"))


@_q(_SESSIONS)
def t02_trailing_debounce(spark, d):
    e = _events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return _flat(T.trailing_debounce(e, "ts", "6 hours", "event_type", "user_id"))


@_q(_SESSIONS)
def t02_trailing_debounce_stream(spark, d):
    """T2 as a stream, run to its end; in complete mode, so that the last bursts are there too."""
    e = _event_stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return _flat(T.collected(T.trailing_debounce(e, "ts", "6 hours", "event_type", "user_id"), "complete"))


@_q("SELECT event_id, CASE WHEN event_type IN ('created', 'deleted') THEN event_type ELSE 'modified' END AS kind FROM events")
def t03_change_kind(spark, d):
    return _events(spark, d).select("event_id", T.change_kind("event_type").alias("kind"))


@_q("SELECT event_id, event_type AS path FROM events UNION ALL SELECT event_id, 'u' || user_id FROM events WHERE event_type = 'click' ORDER BY 1")
def t04_renames(spark, d):
    e = _events(spark, d).select("event_id", F.col("event_type").alias("path"), F.when(F.col("event_type") == "click", F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("old_path"))
    return T.with_renames(e)


@_q("SELECT event_type, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY event_type")
def t05_t06_job_queue(spark, d):
    """Each micro-batch is a job; what it does is written, failures would be noted beside."""
    stream = _event_stream(spark, d).where("event_type <> 'error'").select("event_type", "event_id")
    return T.collected(stream).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@_q("WITH f AS (SELECT DISTINCT replace(file_path, '\\', '/') AS path FROM file_hashes), p AS (SELECT path, string_split(path, '/') AS a FROM f) SELECT path, CASE WHEN a[1] < 'm' AND len(a) > 2 THEN a[1] || '/' || a[2] WHEN len(a) > 1 THEN a[1] END AS root FROM p")
def t07_project_root(spark, d):
    """Top directories are projects, and the second level of those that begin before m."""
    from tessera.functions import text as X

    files = table(spark, d, "file_hashes").select(X.slashes("file_path").alias("path")).distinct()
    parts = F.split("path", "/")
    one = files.where(F.size(parts) > 1).select(parts[0].alias("directory"))
    two = files.where((F.size(parts) > 2) & (parts[0] < "m")).select(F.concat_ws("/", parts[0], parts[1]).alias("directory"))
    return T.project_roots(files, one.union(two).distinct())


_PHASES = (("scan", 0, 0, None), ("parse", 3, 10, None), ("parse", 10, 10, None), ("done", 10, 10, "10 files"))


@_q(texts._values("run_id, seq, phase, done, total, message", *[("r1", i, *p) for i, p in enumerate(_PHASES)]))
def t11_progress(spark, d):
    """The events of a run, followed as a stream."""
    folder = scratch_dir(spark, "progress")
    told = Progress(spark, folder, "r1")
    for p in _PHASES:
        told.tell(*p)
    return T.collected(follow(spark, folder))


# ---- reports ----


_FROM = "(SELECT f FROM x)"
_NARROW = "NOT starts_with(fqn, 'System.') AND NOT starts_with(fqn, 'Microsoft.')"


def _page_sql(section: str, body: str) -> str:
    return f"(SELECT '{section}' AS section, fqn FROM (SELECT DISTINCT fqn FROM ({body})) WHERE {_NARROW} ORDER BY fqn LIMIT 10)"


@_q(f"""WITH {LIVE}, hits AS (SELECT * FROM ({_search_sql("the newest throws")}) WHERE place <= 10),
x AS (SELECT fqn AS f FROM hits JOIN live USING (fqn) WHERE lower(kind) IN ('class', 'interface', 'method', 'record', 'struct', 'function') ORDER BY place LIMIT 1),
own AS (SELECT f, regexp_extract(CASE WHEN instr(f, '(') > 1 THEN split_part(f, '(', 1) ELSE f END, '(?s)^(.*)[.][^.]*$', 1) AS owner, regexp_extract(CASE WHEN instr(f, '(') > 1 THEN split_part(f, '(', 1) ELSE f END, '[^.]*$') AS name FROM x),
i AS (SELECT DISTINCT to_fqn AS i FROM e, own WHERE type = 'Implements' AND contains(from_fqn, owner)),
iface AS (SELECT a.from_fqn AS fqn FROM e a, i, own WHERE a.type = 'Calls' AND owner <> '' AND contains(a.to_fqn, i) AND NOT contains(a.from_fqn, i)
  AND regexp_extract(CASE WHEN instr(a.to_fqn, '(') > 1 THEN split_part(a.to_fqn, '(', 1) ELSE a.to_fqn END, '[^.]*$') = name)
SELECT 'symbol' AS section, f AS fqn FROM x
UNION ALL {_page_sql("callers", f"SELECT from_fqn AS fqn FROM e WHERE type = 'Calls' AND (to_fqn = {_FROM} OR starts_with(to_fqn, {_FROM} || '(')) UNION ALL SELECT fqn FROM iface")}
UNION ALL {_page_sql("dependencies", f"SELECT to_fqn AS fqn FROM e WHERE type IN ('DependsOn', 'UsesType', 'References') AND from_fqn = {_FROM} AND NOT {_NOISE.replace('fqn', 'to_fqn')}")}
UNION ALL {_page_sql("callees", f"SELECT to_fqn AS fqn FROM e WHERE type = 'Calls' AND (from_fqn = {_FROM} OR starts_with(from_fqn, {_FROM} || '(')) AND NOT {_NOISE.replace('fqn', 'to_fqn')}")}
UNION ALL {_page_sql("implementations", f"SELECT from_fqn AS fqn FROM e WHERE type = 'Implements' AND (to_fqn = {_FROM} OR starts_with(to_fqn, {_FROM} || '<'))")}
UNION ALL {_page_sql("referenced_by", f"SELECT from_fqn AS fqn FROM e WHERE type = 'References' AND to_fqn = {_FROM}")}""")
def g19_explore(spark, d):
    return R.explore(symbols(spark, d), edges(spark, d), "the newest throws", deep=True)


_TYPES = "('class', 'interface', 'struct', 'record')"
_SL = "replace(file_path, '\\', '/')"
_MODULE = f"coalesce(list_filter(string_split({_SL}, '/'), lambda p: contains(p, '.') AND NOT ends_with(p, '.cs'))[1], nullif(CASE WHEN len(string_split({_SL}, '/')) >= 2 THEN string_split({_SL}, '/')[-2] END, ''), 'Unknown')"


@_q("WITH " + LIVE + f""", x AS (SELECT 'types' AS part, {_MODULE} AS grp, name, fqn FROM live WHERE lower(kind) IN {_TYPES} UNION ALL SELECT 'endpoints', {_MODULE}, name, fqn FROM live WHERE lower(kind) = 'api_endpoint'),
y AS (SELECT *, row_number() OVER (PARTITION BY part, grp ORDER BY name, fqn) AS k, count(*) OVER (PARTITION BY part, grp) AS c FROM x)
SELECT part, grp, max(c) AS n, string_agg(name, ', ' ORDER BY k) FILTER (WHERE k <= 15) AS sample FROM y GROUP BY part, grp""")
def g20_g21_architecture(spark, d):
    return R.architecture(symbols(spark, d), edges(spark, d))


@_q("WITH " + LIVE + f""", x AS (SELECT 'types' AS part, {_MODULE} AS grp, name, fqn FROM live WHERE lower(kind) IN {_TYPES} UNION ALL SELECT 'endpoints', {_MODULE}, name, fqn FROM live WHERE lower(kind) = 'api_endpoint'),
y AS (SELECT *, row_number() OVER (PARTITION BY part, grp ORDER BY name, fqn) AS k, count(*) OVER (PARTITION BY part, grp) AS c FROM x),
r AS (SELECT part, grp, max(c) AS n, string_agg(name, ', ' ORDER BY k) FILTER (WHERE k <= 15) AS sample FROM y GROUP BY part, grp),
l AS (SELECT DISTINCT part, '' AS grp, '## ' || upper(part[1]) || part[2:] AS line FROM r
  UNION ALL SELECT part, '_' || grp, '- **' || grp || '** (' || n || '): ' || sample || CASE WHEN n > 15 THEN ' ... ' || (n - 15) || ' more' ELSE '' END FROM r)
SELECT row_number() OVER (ORDER BY part, grp) AS ord, line FROM l""")
def w17_markdown_export(spark, d):
    return R.markdown_export(R.architecture(symbols(spark, d), edges(spark, d)))


@_q("SELECT from_fqn, to_fqn, type FROM relationships WHERE trim(from_fqn) <> '' AND trim(to_fqn) <> '' GROUP BY ALL")
def g24_client_edges(spark, d):
    e = G.clean_edges(edges(spark, d))
    return G.edges_inside(e, G.endpoints(e))


@_q("")
def x29_embeddings(spark, d):
    s = live_rows(table(spark, d, "code_symbols"), "kind", "signature", "documentation")
    out = R.embed_symbols(s)
    return out.select("fqn", F.size("vector").alias("dims"), F.round(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), 3).alias("length"))


_PLAIN = """array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(documentation, '^\\s*/\\*+', ''), '\\*+/\\s*$', ''), '\\r?\\n'),
  lambda x: trim(regexp_replace(x, '^\\s*(?:\\*+|///?)?\\s?', ''), ' ')), lambda x: x <> '' AND NOT starts_with(x, '@')), ' ')"""


@_q(f"WITH {LIVE}, p AS (SELECT fqn, {_PLAIN} AS t FROM live WHERE lower(kind) IN ('method', 'function')) SELECT fqn, nullif(substring(regexp_extract(t, '(?s)^(.*?[.!?])(?:\\s|$)', 1), 1, 200), '') AS summary FROM p")
def x28_summaries(spark, d):
    s = live_rows(table(spark, d, "code_symbols"), "kind", "signature", "documentation")
    return R.summarized(s)


@_q("")
def r07_approximate_top(spark, d):
    """A hundred candidates by signature, compared exactly; the vectors of live symbols and memories."""
    s = live_rows(table(spark, d, "code_symbols"), "embedding").select(F.col("fqn").alias("key"), "embedding")
    every = s.unionByName(table(spark, d, "agent_memories").select(F.col("id").alias("key"), "embedding"))
    return R.ann_top(R.signature_index(every, "key", "embedding", 768), "key", "embedding", _query_vector(spark, d))


@_q("WITH RECURSIVE " + LIVE + ", x AS (SELECT (SELECT from_fqn FROM e WHERE type = 'Calls' GROUP BY from_fqn ORDER BY count(*) DESC, from_fqn LIMIT 1) AS f), w AS (SELECT to_fqn AS fqn, 1 AS dist FROM e, x WHERE type IN ('Calls', 'UsesType', 'References') AND from_fqn = f UNION SELECT e.to_fqn, w.dist + 1 FROM w JOIN e ON e.from_fqn = w.fqn AND type IN ('Calls', 'UsesType', 'References') WHERE w.dist < 4) SELECT fqn, min(dist) AS dist FROM w GROUP BY fqn")
def j02_bounded_chain(spark, d):
    """A chain of self joins over several edge types at once."""
    seed = spark.createDataFrame([(busiest(spark, d, "Calls", "from_fqn"),)], "fqn string")
    return G.closure(G.clean_edges(edges(spark, d), "Calls", "UsesType", "References"), seed, 4)


@_q("SELECT id, regexp_extract(CASE WHEN instr(fqn, '(') > 1 THEN split_part(fqn, '(', 1) ELSE fqn END, '[^.]*$') AS method, regexp_extract(CASE WHEN instr(fqn, '(') > 1 THEN split_part(fqn, '(', 1) ELSE fqn END, '(?s)^(.*)\\.[^.]*$', 1) AS owner, upper(sha256(fqn)) AS hash FROM code_symbols")
def sql01_functions(spark, d):
    """The registered functions, called from SQL."""
    from tessera.functions.sql import register

    register(spark)
    return spark.sql("SELECT id, method_name(fqn) AS method, containing_type(fqn) AS owner, content_hash(fqn) AS hash FROM {s}", s=table(spark, d, "code_symbols"))


@_q("")
def sql02_extract_lateral(spark, d):
    """The extractor as a table function, joined laterally to whole texts in their own languages."""
    from tessera.functions.sql import register
    from tessera.plans.texts import _code

    register(spark)
    return spark.sql("SELECT c.path, x.fqn, x.kind, x.start_line FROM {c} c, LATERAL extract_symbols(c.path, c.content) x", c=_code(spark, d))


@_q(texts._values("path, fqn, kind, start_line", *[(p, r[0], r[1], r[2]) for p, r in texts.sample_symbols()]))
def sql02_extract_languages(spark, d):
    """The same on one file in each language."""
    from tessera.functions.sql import register
    from tessera.plans.samples import FILES

    register(spark)
    c = spark.createDataFrame(list(FILES), "path string, content string")
    return spark.sql("SELECT c.path, x.fqn, x.kind, x.start_line FROM {c} c, LATERAL extract_symbols(c.path, c.content) x", c=c)
