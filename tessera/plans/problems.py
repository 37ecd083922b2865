"""Queries of the general training-data problems: p3, p5, p6, p7."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.hierarchy import descendant_counts, descendants, parent_links, solve_forest
from tessera.operators.incremental import CommitLog, next_files, take_up
from tessera.operators.keycounts import dense_key_results, heavy_keys
from tessera.operators.orphans import orphan_references, orphan_report
from tessera.session import materialize, scratch_dir
from tessera.tables import micros, table


#: Ends of the first two of three runs over the hash log; the third takes the rest.
THREE_RUNS = ("2025-01-26 12:00:00", "2025-03-23 00:00:00")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    out = []
    for t, key, one_in in (("relationships", "to_fqn", 100), ("code_symbols", "repo_id", 20)):
        out.append(heavy_keys(table(spark, d, t), key, one_in).select(F.lit(f"{t}.{key}").alias("key_column"), "key_value"))
    return out[0].unionByName(out[1])


def p3_key_results(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "relationships")
    lines = F.col("metadata")["line"].try_cast("long")
    at = micros("indexed_at")
    a = dense_key_results(r, "to_fqn", {"n_with_line": F.when(lines.isNotNull(), 1), "line_sum": lines}, {"first_us": at}, {"last_us": at})
    s = table(spark, d, "code_symbols")
    spans = F.col("end_line").cast("long") - F.col("start_line").cast("long")
    b = dense_key_results(s, "repo_id", {"n_with_line": F.when(F.col("start_line").isNotNull(), 1), "line_sum": spans}, {"first_us": at}, {"last_us": at})
    return a.withColumn("key_column", F.lit("relationships.to_fqn")).unionByName(b.withColumn("key_column", F.lit("code_symbols.repo_id")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return next_files(table(spark, d, "file_hashes"), table(spark, d, "index_runs"), scratch_dir(spark, "runs"))


def p5_three_runs(spark: SparkSession, d: str) -> DataFrame:
    """What three runs take up, each from where the one before has committed; the second dies once before its commit and is run again."""
    source = table(spark, d, "file_hashes")
    log = CommitLog(spark, scratch_dir(spark, "runs"))
    limits = [dt.datetime.fromisoformat(t) for t in THREE_RUNS]
    done = []
    for n, upto in enumerate([*limits, None]):
        if n == 1:
            try:
                take_up(log, source, upto, fail_before_commit=True)
            except RuntimeError:
                pass
        done.append(log.table("output", take_up(log, source, upto)).withColumn("run", F.lit(n)))
    return done[0].unionByName(done[1]).unionByName(done[2])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return solve_forest(parent_links(table(spark, d, "relationships")))


def p6_tree(spark: SparkSession, d: str) -> DataFrame:
    forest = materialize(solve_forest(parent_links(table(spark, d, "relationships")), with_path=True), "forest")
    out = forest.join(descendant_counts(forest), "fqn", "left")
    return out.select("fqn", "root_fqn", "node_depth", F.array_join("path", " > ").alias("path_text"), F.coalesce("n_descendants", F.lit(0)).alias("n_descendants"))


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(solve_forest(parent_links(table(spark, d, "relationships")), with_path=True))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(table(spark, d, "relationships"), table(spark, d, "code_symbols")).select("edge_id", "edge_end", "orphan_state")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(table(spark, d, "relationships"), table(spark, d, "code_symbols"))


QUERIES = {f.__name__: f for f in (p3_found, p3_key_results, p5_found, p5_three_runs, p6_found, p6_tree, p6_descendants, p7_found, p7_report)}

_ENDS = """
ends AS (
  SELECT edge_id, 'from' AS edge_end, from_fqn AS key, indexed_at FROM relationships
  UNION ALL SELECT edge_id, 'to', to_fqn, indexed_at FROM relationships),
refs AS (
  SELECT * FROM ends WHERE key IS NOT NULL AND trim(key) <> ''
    AND NOT starts_with(key, 'env:') AND NOT starts_with(key, 'http:') AND NOT starts_with(key, 'event:')),
ranked AS (SELECT fqn, deleted_at, row_number() OVER (PARTITION BY fqn ORDER BY indexed_at DESC, id DESC) AS rn FROM code_symbols),
firsts AS (SELECT fqn, min(indexed_at) AS first_at FROM code_symbols GROUP BY fqn),
state AS (
  SELECT r.edge_id, r.edge_end, r.indexed_at,
    CASE WHEN c.fqn IS NULL THEN 'missing' WHEN c.deleted_at IS NOT NULL THEN 'deleted'
         WHEN f.first_at > r.indexed_at THEN 'late' END AS orphan_state
  FROM refs r LEFT JOIN (SELECT * FROM ranked WHERE rn = 1) c ON c.fqn = r.key LEFT JOIN firsts f ON f.fqn = r.key)
"""

_FOREST = """
up AS (
  SELECT CASE WHEN type = 'Inherits' THEN from_fqn ELSE to_fqn END AS c, CASE WHEN type = 'Inherits' THEN to_fqn ELSE from_fqn END AS p
  FROM relationships WHERE type IN ('Inherits', 'Declares')),
nodes AS (
  SELECT node, min(parent) AS parent FROM (
    SELECT c AS node, CASE WHEN trim(p) <> '' THEN p END AS parent FROM up UNION ALL SELECT p, NULL FROM up)
  WHERE node IS NOT NULL AND trim(node) <> '' GROUP BY node),
tree AS (
  SELECT node, node AS root, 0 AS depth, node AS path FROM nodes WHERE parent IS NULL
  UNION ALL
  SELECT n.node, t.root, t.depth + 1, t.path || ' > ' || n.node FROM nodes n JOIN tree t ON n.parent = t.node)
"""

ORACLE = {
    "p3_found": """
SELECT 'relationships.to_fqn' AS key_column, to_fqn AS key_value FROM relationships WHERE trim(to_fqn) <> ''
GROUP BY to_fqn HAVING count(*) * 100 >= (SELECT count(*) FROM relationships)
UNION ALL
SELECT 'code_symbols.repo_id', repo_id FROM code_symbols WHERE trim(repo_id) <> ''
GROUP BY repo_id HAVING count(*) * 20 >= (SELECT count(*) FROM code_symbols)""",
    "p3_key_results": """
SELECT 'relationships.to_fqn' AS key_column, to_fqn AS key_value, count(*) AS n_rows,
  CAST(count(TRY_CAST(metadata['line'] AS BIGINT)) AS BIGINT) AS n_with_line, CAST(coalesce(sum(TRY_CAST(metadata['line'] AS BIGINT)), 0) AS BIGINT) AS line_sum,
  min(epoch_us(indexed_at)) AS first_us, max(epoch_us(indexed_at)) AS last_us FROM relationships GROUP BY to_fqn
UNION ALL
SELECT 'code_symbols.repo_id', repo_id, count(*), count(start_line), CAST(coalesce(sum(end_line - start_line), 0) AS BIGINT), min(epoch_us(indexed_at)), max(epoch_us(indexed_at))
FROM code_symbols GROUP BY repo_id""",
    "p5_found": """
WITH log AS (
  SELECT repo_id, replace(file_path, '\\', '/') AS file_path, upper(trim(content_hash)) AS h, indexed_at, received_at, row_id
  FROM file_hashes WHERE trim(content_hash) <> ''),
mark AS (SELECT repo_id, max(started_at) AS low FROM index_runs WHERE run_status = 'succeeded' GROUP BY repo_id),
told AS (
  SELECT l.repo_id, l.file_path, arg_max(h, (indexed_at, received_at, row_id)) AS now_h,
    arg_max(h, (indexed_at, received_at, row_id)) FILTER (WHERE received_at < low) AS then_h
  FROM log l LEFT JOIN mark m ON m.repo_id = l.repo_id GROUP BY l.repo_id, l.file_path)
SELECT repo_id, file_path FROM told WHERE then_h IS NULL OR now_h <> then_h""",
    "p5_three_runs": f"""
WITH log AS (
  SELECT repo_id, replace(file_path, '\\', '/') AS file_path, upper(trim(content_hash)) AS h, indexed_at, received_at, row_id
  FROM file_hashes WHERE trim(content_hash) <> ''),
lim AS (SELECT 0 AS run, TIMESTAMP '{THREE_RUNS[0]}' AS upto, NULL::TIMESTAMP AS low UNION ALL SELECT 1, TIMESTAMP '{THREE_RUNS[1]}', TIMESTAMP '{THREE_RUNS[0]}' UNION ALL SELECT 2, TIMESTAMP '9999-01-01', TIMESTAMP '{THREE_RUNS[1]}'),
told AS (
  SELECT run, repo_id, file_path, arg_max(h, (indexed_at, received_at, row_id)) AS now_h, arg_max(h, (indexed_at, received_at, row_id)) FILTER (WHERE received_at <= low) AS then_h
  FROM log, lim WHERE received_at <= upto GROUP BY ALL)
SELECT CAST(run AS INTEGER) AS run, repo_id, file_path FROM told WHERE then_h IS NULL OR now_h <> then_h""",
    "p6_found": f"""
WITH RECURSIVE {_FOREST}
SELECT n.node AS fqn, coalesce(t.root, '') AS root_fqn, CAST(coalesce(t.depth, -1) AS INTEGER) AS node_depth FROM nodes n LEFT JOIN tree t ON t.node = n.node""",
    "p6_tree": f"""
WITH RECURSIVE {_FOREST},
above AS (
  SELECT n.node, n.parent AS anc FROM nodes n JOIN tree t ON t.node = n.node WHERE n.parent IS NOT NULL
  UNION ALL SELECT a.node, n.parent FROM above a JOIN nodes n ON n.node = a.anc WHERE n.parent IS NOT NULL),
below AS (SELECT anc, count(*) AS k FROM above GROUP BY anc)
SELECT n.node AS fqn, coalesce(t.root, '') AS root_fqn, CAST(coalesce(t.depth, -1) AS INTEGER) AS node_depth, t.path AS path_text, coalesce(b.k, 0) AS n_descendants
FROM nodes n LEFT JOIN tree t ON t.node = n.node LEFT JOIN below b ON b.anc = n.node""",
    "p6_descendants": f"""
WITH RECURSIVE {_FOREST},
above AS (
  SELECT n.node, n.parent AS anc, 1 AS k FROM nodes n JOIN tree t ON t.node = n.node WHERE n.parent IS NOT NULL
  UNION ALL SELECT a.node, n.parent, a.k + 1 FROM above a JOIN nodes n ON n.node = a.anc WHERE n.parent IS NOT NULL)
SELECT anc AS fqn, node AS descendant_fqn, k AS distance FROM above""",
    "p7_found": f"WITH {_ENDS} SELECT edge_id, edge_end, orphan_state FROM state WHERE orphan_state IS NOT NULL",
    "p7_report": f"""
WITH {_ENDS} SELECT edge_end, orphan_state, strftime(indexed_at, '%Y-%m') AS month, count(*) AS n FROM state WHERE orphan_state IS NOT NULL GROUP BY ALL""",
}
