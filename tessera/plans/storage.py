"""Queries of writes, aggregates and incremental steps over the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import graph as G
from tessera.operators import store as W
from tessera.operators.incremental import clean_log
from tessera.plans.graphs import LIVE, edges, symbols
from tessera.plans.scalars import NOW
from tessera.tables import live_rows, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _q(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


#: The first half of 2025 stands for what is stored, the rest for a batch that comes in.
CUT = "2025-03-01 00:00:00"


def _cut():
    return F.lit(CUT).cast("timestamp_ntz")


def _halves(spark, d, t="code_symbols"):
    df = table(spark, d, t)
    return df.where(F.col("indexed_at") < _cut()), df.where(F.col("indexed_at") >= _cut())


_STATE = f"""
old AS (SELECT *, row_number() OVER (PARTITION BY fqn ORDER BY indexed_at DESC, id DESC) AS rn FROM code_symbols WHERE indexed_at < TIMESTAMP '{CUT}' AND fqn IS NOT NULL),
new AS (SELECT *, row_number() OVER (PARTITION BY fqn ORDER BY indexed_at DESC, id DESC) AS rn FROM code_symbols WHERE indexed_at >= TIMESTAMP '{CUT}' AND repo_id IS NOT NULL AND trim(fqn) <> '')"""


@_q(f"WITH {_STATE} SELECT fqn, id FROM new WHERE rn = 1 UNION ALL SELECT fqn, id FROM old WHERE rn = 1 AND fqn NOT IN (SELECT fqn FROM new)")
def w01_w07_symbol_upsert(spark, d):
    old, new = _halves(spark, d)
    cols = ("fqn", "id", "repo_id", "indexed_at")
    stored = W.keep_last(old.select(*cols).where("fqn IS NOT NULL"), ["fqn"], F.col("indexed_at"), F.col("id"))
    return W.write_symbols(stored, new.select(*cols), F.struct("indexed_at", "id")).select("fqn", "id")


@_q(f"""SELECT count(DISTINCT fqn) FILTER (WHERE repo_id IS NOT NULL AND trim(fqn) <> '') AS persisted, count(*) FILTER (WHERE repo_id IS NULL OR coalesce(trim(fqn), '') = '') AS failed,
count(DISTINCT fqn) FILTER (WHERE repo_id IS NOT NULL AND trim(fqn) <> '' AND len(embedding) > 0) AS vector_rows, count(*) FILTER (WHERE repo_id IS NULL OR coalesce(trim(fqn), '') = '') = 0 AS ok FROM code_symbols WHERE indexed_at >= TIMESTAMP '{CUT}'""")
def w07_w21_write_counts(spark, d):
    return W.write_counts(_halves(spark, d)[1])


_E_OLD = f"o AS (SELECT from_fqn, to_fqn, type FROM relationships WHERE indexed_at < TIMESTAMP '{CUT}' AND trim(from_fqn) <> '' AND trim(to_fqn) <> '')"
_E_NEW = f"n AS (SELECT from_fqn, to_fqn, type FROM relationships WHERE indexed_at >= TIMESTAMP '{CUT}' AND trim(from_fqn) <> '' AND trim(to_fqn) <> '')"


def _edge_halves(spark, d):
    old, new = _halves(spark, d, "relationships")
    ok = (F.trim("from_fqn") != "") & (F.trim("to_fqn") != "")
    return (x.where(ok).select("from_fqn", "to_fqn", "type") for x in (old, new))


@_q(f"WITH {_E_OLD}, {_E_NEW}, s AS (SELECT * FROM o WHERE from_fqn NOT IN (SELECT from_fqn FROM n) UNION ALL SELECT DISTINCT * FROM n) SELECT from_fqn, to_fqn, type, count(*) AS n FROM s GROUP BY ALL")
def w02_edge_replace(spark, d):
    old, new = _edge_halves(spark, d)
    return W.replace_outgoing(old, new).groupBy("from_fqn", "to_fqn", "type").agg(F.count(F.lit(1)).alias("n"))


@_q(f"WITH {_E_OLD}, {_E_NEW} SELECT from_fqn, to_fqn, type, count(*) AS n FROM o WHERE from_fqn NOT IN (SELECT from_fqn FROM n) GROUP BY ALL")
def w03_delete_outgoing(spark, d):
    old, new = _edge_halves(spark, d)
    return W.delete_outgoing(old, new.select(F.col("from_fqn").alias("fqn"))).groupBy("from_fqn", "to_fqn", "type").agg(F.count(F.lit(1)).alias("n"))


@_q("WITH " + LIVE + " SELECT from_fqn, to_fqn, type FROM e WHERE from_fqn IN (SELECT fqn FROM live) AND to_fqn IN (SELECT fqn FROM live)")
def w04_edges_existing_only(spark, d):
    return W.existing_only(G.clean_edges(edges(spark, d)), symbols(spark, d)).select("from_fqn", "to_fqn", "type")


@_q("WITH " + LIVE + """, x AS (SELECT from_fqn AS fqn FROM e UNION SELECT to_fqn FROM e) SELECT fqn, CASE WHEN starts_with(fqn, 'DI:') THEN 'di_registration' WHEN starts_with(fqn, 'API:') THEN 'api_endpoint'
  WHEN starts_with(fqn, 'config:') OR starts_with(fqn, 'env:') THEN 'config_key' WHEN starts_with(fqn, 'doc:') THEN CASE WHEN contains(fqn, '#') THEN 'section' ELSE 'document' END
  WHEN contains(fqn, '(') THEN 'method' WHEN regexp_matches(fqn, '\\.I\\p{Lu}[^.]*$') THEN 'interface' ELSE 'class' END AS kind FROM x WHERE fqn NOT IN (SELECT fqn FROM live)""")
def w05_placeholders(spark, d):
    return W.placeholders(G.clean_edges(edges(spark, d)), symbols(spark, d))


@_q("SELECT type, array_to_string(list_sort(map_keys(coalesce(metadata, MAP {}))), ',') AS keys, count(*) AS n FROM relationships GROUP BY ALL")
def w06_metadata_groups(spark, d):
    return W.metadata_groups(table(spark, d, "relationships"))


@_q("SELECT id, CASE WHEN lower(kind) IN ('method', 'function', 'constructor', 'section') THEN signature END AS signature, CASE WHEN lower(kind) NOT IN ('api_endpoint', 'document', 'section', 'namespace') THEN nullif(trim(accessibility, ' '), '') END AS accessibility FROM code_symbols")
def w08_w09_projections(spark, d):
    return table(spark, d, "code_symbols").select("id", W.signature_of("kind").alias("signature"), W.accessibility_of("kind").alias("accessibility"))


@_q("WITH p AS (SELECT min(path) AS known FROM repositories) SELECT id, CASE WHEN path = known THEN 'renamed' ELSE name END AS name, path FROM repositories, p UNION ALL SELECT 'new-id', 'fresh', '/fresh/path' ORDER BY 1")
def w10_register(spark, d):
    repos = table(spark, d, "repositories")
    known = repos.agg(F.min("path")).first()[0]
    now = F.lit(NOW).cast("timestamp_ntz")
    out = W.register_repository(repos, known, "renamed", "unused", now)
    return W.register_repository(out, "/fresh/path", "fresh", "new-id", now).select("id", "name", "path")


@_q("SELECT id, name, path FROM repositories WHERE path = (SELECT min(path) FROM repositories)")
def w11_lookup(spark, d):
    repos = table(spark, d, "repositories")
    return repos.where(F.col("path") == repos.agg(F.min("path")).first()[0]).select("id", "name", "path")


_BIG = "(SELECT repo_id FROM code_symbols WHERE repo_id IS NOT NULL GROUP BY repo_id ORDER BY count(*) DESC, repo_id LIMIT 1)"


def _big_repo(spark, d) -> str:
    s = table(spark, d, "code_symbols").where("repo_id IS NOT NULL").groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))
    return s.orderBy(F.col("n").desc(), "repo_id").first()[0]


@_q(f"WITH b AS (SELECT {_BIG} AS r) SELECT 'repositories' AS tab, count(*) AS n FROM repositories, b WHERE id <> r UNION ALL SELECT 'symbols', count(*) FROM code_symbols, b WHERE repo_id IS NULL OR repo_id <> r UNION ALL SELECT 'hashes', count(*) FROM file_hashes, b WHERE repo_id IS NULL OR repo_id <> r")
def w12_delete_cascade(spark, d):
    r = _big_repo(spark, d)
    parts = (("repositories", "id", "repositories"), ("symbols", "repo_id", "code_symbols"), ("hashes", "repo_id", "file_hashes"))
    outs = [W.without_repository(table(spark, d, t), r, c).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("tab"), "n") for n, c, t in parts]
    return outs[0].unionByName(outs[1]).unionByName(outs[2])


@_q(f"SELECT id, CASE WHEN id = {_BIG} THEN epoch_us(TIMESTAMP '{NOW}') ELSE epoch_us(last_indexed) END AS at_us FROM repositories")
def w13_touch(spark, d):
    from tessera.tables import micros

    return W.touch_repository(table(spark, d, "repositories"), _big_repo(spark, d), F.lit(NOW).cast("timestamp_ntz")).select("id", micros("last_indexed").alias("at_us"))


_LOG = "log AS (SELECT repo_id, replace(file_path, '\\', '/') AS file_path, upper(trim(content_hash)) AS h, indexed_at, received_at, row_id FROM file_hashes WHERE trim(content_hash) <> '')"
_LATEST = f"{_LOG}, latest AS (SELECT repo_id, file_path, arg_max(h, (indexed_at, received_at, row_id)) AS content_hash FROM log GROUP BY ALL)"
_STORED = f"{_LATEST}, stored AS (SELECT repo_id, file_path, arg_max(h, (indexed_at, received_at, row_id)) AS content_hash FROM log WHERE received_at < TIMESTAMP '{CUT}' GROUP BY ALL)"


def _stored(spark, d):
    log = table(spark, d, "file_hashes")
    return W.latest_hashes(log.where(F.col("received_at") < _cut())), W.latest_hashes(log)


@_q(f"WITH {_LATEST} SELECT repo_id, file_path, content_hash FROM latest")
def src16_w14_hash_map(spark, d):
    return W.latest_hashes(table(spark, d, "file_hashes"))


@_q(f"WITH {_LATEST} SELECT repo_id, file_path, content_hash FROM latest")
def w14_t10_hash_upsert(spark, d):
    stored, now = _stored(spark, d)
    return W.upsert_hashes(stored, now)


@_q(f"WITH {LIVE}, b AS (SELECT {_BIG} AS r), g AS (SELECT fqn FROM live, b WHERE repo_id = r) SELECT from_fqn, to_fqn, type FROM e WHERE from_fqn NOT IN (SELECT fqn FROM g) AND to_fqn NOT IN (SELECT fqn FROM g)")
def w15_delete_repository_edges(spark, d):
    gone = symbols(spark, d).where(F.col("repo_id") == _big_repo(spark, d))
    return W.detach(G.clean_edges(edges(spark, d)), gone).select("from_fqn", "to_fqn", "type")


_DELETED = f"{_STORED}, f AS (SELECT repo_id, file_path FROM stored WHERE hash(file_path) IS NOT NULL AND length(file_path) % 3 = 0)"


@_q(f"WITH {LIVE}, {_DELETED}, g AS (SELECT s.fqn FROM live s JOIN f ON f.repo_id = s.repo_id AND f.file_path = replace(s.file_path, '\\', '/')) SELECT from_fqn, to_fqn, type FROM e WHERE from_fqn NOT IN (SELECT fqn FROM g) AND to_fqn NOT IN (SELECT fqn FROM g)")
def w16_delete_files(spark, d):
    gone = _stored(spark, d)[0].where(F.length("file_path") % 3 == 0)
    return W.detach(G.clean_edges(edges(spark, d)), W.symbols_of_files(symbols(spark, d), gone)).select("from_fqn", "to_fqn", "type")


@_q(f"SELECT row_id FROM file_hashes WHERE repo_id IS NULL OR repo_id <> {_BIG}")
def w18_force_reindex(spark, d):
    return W.without_repository(table(spark, d, "file_hashes"), _big_repo(spark, d)).select("row_id")


@_q("WITH n AS (SELECT lower(trim(name)) AS k, count(*) AS c, min(id) AS id FROM repositories GROUP BY 1), x AS (SELECT min(k) FILTER (WHERE c = 1) AS one, min(k) FILTER (WHERE c > 1) AS many FROM n) SELECT 'one' AS ask, 'ok' AS answer, (SELECT id FROM n WHERE k = one) AS id FROM x WHERE one IS NOT NULL UNION ALL SELECT 'many', 'ambiguous', NULL FROM x WHERE many IS NOT NULL UNION ALL SELECT 'none', 'not found', NULL")
def w19_delete_guard(spark, d):
    repos = table(spark, d, "repositories")
    n = repos.groupBy(F.lower(F.trim("name")).alias("k")).agg(F.count(F.lit(1)).alias("c"))
    asks = {"one": n.where("c = 1").agg(F.min("k")).first()[0], "many": n.where("c > 1").agg(F.min("k")).first()[0], "none": "no such repository"}
    rows = [(a, *W.repository_to_delete(repos, k)) for a, k in asks.items() if k is not None]
    return spark.createDataFrame(rows, "ask string, answer string, id string")


@_q("SELECT edge_id, (row_number() OVER (ORDER BY edge_id) - 1) // 5000 AS chunk FROM relationships")
def w20_chunk_plan(spark, d):
    return W.chunk_plan(table(spark, d, "relationships").select("edge_id"), "edge_id", 5000).select("edge_id", "chunk")


@_q(f"WITH {_STORED} SELECT l.repo_id, l.file_path FROM latest l LEFT JOIN stored s USING (repo_id, file_path) WHERE s.content_hash IS DISTINCT FROM l.content_hash")
def j10_t08_change_set(spark, d):
    """Files that are new or differ from what is stored."""
    stored, now = _stored(spark, d)
    s = stored.withColumnRenamed("content_hash", "_h")
    return now.join(s, ["repo_id", "file_path"], "left").where(~F.col("_h").eqNullSafe(F.col("content_hash"))).select("repo_id", "file_path")


@_q(f"WITH {_STORED} SELECT repo_id, count(*) AS n_files, count(*) FILTER (WHERE changed) AS n_changed, CASE WHEN count(*) FILTER (WHERE known) = 0 THEN 'full' WHEN count(*) FILTER (WHERE changed) = 0 THEN 'nothing' ELSE 'incremental' END AS plan FROM (SELECT l.repo_id, s.content_hash IS NOT NULL AS known, s.content_hash IS DISTINCT FROM l.content_hash AS changed FROM latest l LEFT JOIN stored s USING (repo_id, file_path)) GROUP BY repo_id")
def t08_run_plan(spark, d):
    """For each repository whether the next run is full, incremental, or has nothing to do."""
    stored, now = _stored(spark, d)
    x = now.join(stored.withColumnRenamed("content_hash", "_h"), ["repo_id", "file_path"], "left")
    changed, known = ~F.col("_h").eqNullSafe(F.col("content_hash")), F.col("_h").isNotNull()
    out = x.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_files"), F.count_if(changed).alias("n_changed"), F.count_if(known).alias("k"))
    plan = F.when(F.col("k") == 0, "full").when(F.col("n_changed") == 0, "nothing").otherwise("incremental")
    return out.select("repo_id", "n_files", "n_changed", plan.alias("plan"))


@_q(f"WITH {_STORED}, disk AS (SELECT DISTINCT repo_id, file_path FROM log WHERE received_at >= TIMESTAMP '{CUT}') SELECT repo_id, file_path FROM stored WHERE (repo_id, file_path) NOT IN (SELECT (repo_id, file_path) FROM disk)")
def j11_t09_deleted_files(spark, d):
    """Stored files that the later listing no longer has."""
    stored, _ = _stored(spark, d)
    disk = clean_log(table(spark, d, "file_hashes")).where(F.col("received_at") >= _cut()).select("repo_id", "file_path").distinct()
    return stored.join(disk, ["repo_id", "file_path"], "left_anti").select("repo_id", "file_path")


_CHANGED = f"{_STORED}, ch AS (SELECT l.repo_id, l.file_path FROM latest l LEFT JOIN stored s USING (repo_id, file_path) WHERE s.content_hash IS DISTINCT FROM l.content_hash), sy AS (SELECT s.fqn FROM live s JOIN ch ON ch.repo_id = s.repo_id AND ch.file_path = replace(s.file_path, '\\', '/'))"


@_q(f"WITH {LIVE}, {_CHANGED} SELECT 'symbol' AS part, count(*) AS n FROM sy UNION ALL SELECT 'edge', count(*) FROM e WHERE from_fqn IN (SELECT fqn FROM sy)")
def sel15_incremental_trim(spark, d):
    """Symbols of changed files, and edges whose source is one of them."""
    changed = j10_t08_change_set(spark, d)
    s = W.symbols_of_files(symbols(spark, d), changed)
    e = G.clean_edges(edges(spark, d)).join(s.select(F.col("fqn").alias("from_fqn")), "from_fqn", "left_semi")
    count = lambda df, n: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("part"), "n")
    return count(s, "symbol").unionByName(count(e, "edge"))


@_q("WITH " + LIVE + " SELECT s.fqn, CASE WHEN len(s.embedding) > 0 THEN len(s.embedding) END AS dims FROM live s")
def j12_attach_embedding(spark, d):
    """Symbols with their vector attached by fqn; a missing or empty vector is null."""
    v = live_rows(table(spark, d, "code_symbols"), "embedding").select("fqn", F.when(F.size("embedding") > 0, F.col("embedding")).alias("v"))
    return symbols(spark, d).select("fqn").join(v, "fqn", "left").select("fqn", F.size("v").try_cast("int").alias("dims")).withColumn("dims", F.when(F.col("dims") >= 0, F.col("dims")))


_CAN = "lower(kind) IN (" + ", ".join(f"'{k}'" for k in X.EMBEDDABLE) + ")"


@_q("WITH " + LIVE + f""", h AS (SELECT repo_id, count(*) AS total, count(*) FILTER (WHERE {_CAN}) AS embeddable, count(*) FILTER (WHERE {_CAN} AND len(embedding) > 0) AS with_embedding FROM live GROUP BY repo_id)
SELECT *, CASE WHEN total = 0 THEN 'EMPTY' WHEN embeddable = 0 THEN 'OK (nothing to embed)' WHEN with_embedding = 0 THEN 'DEGRADED' WHEN with_embedding / embeddable::DOUBLE >= 0.9 THEN 'OK' ELSE 'PARTIAL ' || round(with_embedding / embeddable::DOUBLE * 100)::BIGINT || '%' END AS label FROM h""")
def a01_a02_health(spark, d):
    return W.health(live_rows(table(spark, d, "code_symbols"), "repo_id", "kind", "embedding"))


@_q("WITH r AS (SELECT *, lower(trim(name)) AS k, row_number() OVER (PARTITION BY lower(trim(name)) ORDER BY last_indexed DESC NULLS LAST, id DESC) AS rn FROM repositories) SELECT k AS name, max(id) FILTER (WHERE rn = 1) AS primary_id, array_to_string(list_sort(coalesce(list(id) FILTER (WHERE rn > 1), [])), ',') AS stale FROM r GROUP BY k")
def a03_group_repositories(spark, d):
    return W.grouped_by_name(table(spark, d, "repositories")).withColumn("stale", F.array_join("stale", ","))


_SL = "replace(file_path, '\\', '/')"


@_q("WITH " + LIVE + f" SELECT coalesce(list_filter(string_split({_SL}, '/'), lambda p: contains(p, '.') AND NOT ends_with(p, '.cs'))[1], nullif(CASE WHEN len(string_split({_SL}, '/')) >= 2 THEN string_split({_SL}, '/')[-2] END, ''), 'Unknown') AS module, count(*) AS n FROM live GROUP BY 1")
def a04_by_module(spark, d):
    return W.by_module(symbols(spark, d))


@_q("SELECT from_fqn, to_fqn, type, min(edge_id) AS first_id, max(edge_id) AS last_id FROM relationships GROUP BY ALL")
def a08_distinct_by_key(spark, d):
    """Keep first and keep last of repeated edges."""
    return table(spark, d, "relationships").groupBy("from_fqn", "to_fqn", "type").agg(F.min("edge_id").alias("first_id"), F.max("edge_id").alias("last_id"))


@_q("WITH " + LIVE + " SELECT (SELECT count(DISTINCT (repo_id, file_path)) FROM live) AS files, (SELECT count(*) FROM live) AS symbols, (SELECT count(*) FROM e) AS relationships, (SELECT count(*) FROM live WHERE len(embedding) > 0) AS embeddings")
def a10_index_stats(spark, d):
    s = live_rows(table(spark, d, "code_symbols"), "repo_id", "file_path", "embedding")
    a = s.agg(F.count_distinct(F.struct("repo_id", "file_path")).alias("files"), F.count(F.lit(1)).alias("symbols"), F.count_if(F.size("embedding") > 0).alias("embeddings"))
    b = G.clean_edges(edges(spark, d)).agg(F.count(F.lit(1)).alias("relationships"))
    return a.join(F.broadcast(b), F.lit(True)).select("files", "symbols", "relationships", "embeddings")


@_q("SELECT repo_id, median(s) AS median_s FROM (SELECT DISTINCT run_id, repo_id, (epoch_us(finished_at) - epoch_us(started_at)) / 1000000.0::DOUBLE AS s FROM index_runs WHERE finished_at IS NOT NULL) GROUP BY repo_id")
def a11_median_run(spark, d):
    """Median duration of the runs of a repository, runs delivered twice once."""
    from tessera.tables import micros

    r = table(spark, d, "index_runs").where("finished_at IS NOT NULL").select("run_id", "repo_id", ((micros("finished_at") - micros("started_at")) / 1e6).alias("s")).distinct()
    return r.groupBy("repo_id").agg(F.median("s").alias("median_s"))


@_q("SELECT n_repos, CASE WHEN n_repos = 1 THEN 'implicit' WHEN n_repos = 0 THEN 'unknown' ELSE 'refuse' END AS scope FROM (SELECT count(*) AS n_repos FROM repositories)")
def sel17_scope_guard(spark, d):
    """Without a repository named, one repository is the implicit scope, several are refused."""
    n = table(spark, d, "repositories").agg(F.count(F.lit(1)).alias("n_repos"))
    return n.withColumn("scope", F.when(F.col("n_repos") == 1, "implicit").when(F.col("n_repos") == 0, "unknown").otherwise("refuse"))


@_q("SELECT id, name, path FROM repositories ORDER BY name")
def w11_list_repositories(spark, d):
    return table(spark, d, "repositories").select("id", "name", "path").orderBy("name")
