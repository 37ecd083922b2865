"""Queries of the training-data problems on text and vectors: p1, p2, p4, p8, p9, p10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, comments, fusion, kmtree, leak, subjects
from tessera.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return comments.paired_symbols(table(spark, d, "code_symbols")).select("id")


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    return comments.paired_symbols(table(spark, d, "code_symbols"))


def p1_source_pairs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return comments.paired_sources(docs, "doc_id", "text").withColumnRenamed("key", "doc_id")


#: Small source files: comments above and inside, near and far, of several forms, and heads of many lines.
SOURCES = (
    ("a.py", 'def keep(\n    first: int,\n    second: int,\n) -> int:\n    """Keeps the newest rows and drops the rest.\n\n    Args:\n        first: the first\n    """\n    return first\n\n\ndef _x(a):\n    """TODO"""\n\n\n# Waits until the lock is free.\nasync def wait(lock):\n    pass\n'),
    ("b.ts", "/**\n * Sorts by age before it answers.\n * @param rows the rows\n */\nexport function sorted(rows: Row[]): Row[] {\n  return rows;\n}\n\n// Far from everything.\n\n\n\n\n\nfunction lonely() {}\n\n// eslint-disable-next-line\nfunction quiet() {}\n"),
    ("c.go", "// Close gives the handle back to the pool.\nfunc (c *Conn) Close() error {\n\treturn nil\n}\n\n// Dial.\nfunc Dial(host string) error { return nil }\n"),
    ("d.rs", "/// Never blocks.\npub fn poll(&self) -> bool { true }\n/// Counts\n/// each page once.\nfn count(pages: &[Page]) -> usize { 0 }\n"),
    ("e.cs", "public class A {\n    /// <summary>Rounds to whole cents.</summary>\n    /// <param name=\"amount\">the amount</param>\n    public decimal Round(decimal amount)\n    {\n        return amount;\n    }\n    /// <inheritdoc/>\n    public void Stop() { }\n}\n"),
    ("f.java", "class B {\n    /** Two threads may call it at once. @param left a @param right b */\n    /** Adds both halves of the ledger.\n     * @param left the left\n     * @param right the right\n     */\n    int add(int left, int right) { return left + right; }\n}\n"),
)
#: What :data:`SOURCES` hold, read off by hand: path, name, kind, line, description.
SOURCE_PAIRS = (
    ("a.py", "keep", "function", 1, "Keeps the newest rows and drops the rest."), ("a.py", "wait", "function", 18, "Waits until the lock is free."), ("b.ts", "sorted", "function", 5, "Sorts by age before it answers."),
    ("c.go", "Close", "function", 2, "Close gives the handle back to the pool."), ("d.rs", "poll", "function", 2, "Never blocks."), ("d.rs", "count", "function", 5, "Counts\neach page once."),
    ("e.cs", "Round", "method", 4, "Rounds to whole cents."), ("f.java", "add", "method", 7, "Adds both halves of the ledger."),
)


def p1_source_samples(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of small files in several languages."""
    files = spark.createDataFrame(list(SOURCES), "path string, content string")
    return comments.paired_sources(files, "path", "content").select(F.col("key").alias("path"), "name", "kind", "line", "description")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fused_top(table(spark, d, "search_results"), 3).select("query_id", "fqn")


def p2_fused(spark: SparkSession, d: str) -> DataFrame:
    out = fusion.fuse(table(spark, d, "search_results"))
    return out.select("query_id", "fqn", F.round("rrf_score", 9).alias("rrf_score"), "n_sources")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return kmtree.collection(table(spark, d, "code_symbols"), table(spark, d, "agent_memories"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return kmtree.similar_pairs(_vectors(spark, d)).select("key_a", "key_b")


def p4_knn(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar of every symbol whose id is divisible by 20, against all vectors."""
    asked = F.col("key").startswith("symbol:") & (F.expr("try_cast(substring(key, 8) AS BIGINT)") % 20 == 0)
    return kmtree.nearest(_vectors(spark, d), 5, asked).select("key", "other", F.round("similarity", 4).alias("similarity"), "place")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_texts(table(spark, d, "documents"), "doc_id", "text")


def p8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    back = bpe.decode_texts(bpe.encode_texts(docs, "doc_id", "text")).withColumnRenamed("text", "decoded")
    return docs.join(back, "doc_id").select("doc_id", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "item_text").select("doc_id", "item_id")


def p9_proximity(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "item_text", span=16)


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items")
    found = leak.leaks(table(spark, d, "documents"), "doc_id", "text", items, "item_id", "item_text")
    per_item = found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))
    return items.join(per_item, "item_id", "left").select("item_id", "suite", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    return subjects.subject_areas(spark, t("documents"), t("subject_areas"), t("subject_examples"), t("eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject")


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).groupBy("subject").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_sentences").alias("n_sentences"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_pairs, p1_source_pairs, p1_source_samples, p2_found, p2_fused, p4_found, p4_knn, p8_ids, p8_roundtrip, p9_found, p9_proximity, p9_report, p10_found, p10_composition)
}

_RRF = """
best AS (
  SELECT query_id, lower(trim(source)) AS src, fqn, max(score) AS best FROM search_results
  WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
ranked AS (SELECT *, rank() OVER (PARTITION BY query_id, src ORDER BY best DESC) AS r FROM best),
fused AS (SELECT query_id, fqn, sum(1.0::DOUBLE / (60 + r)) AS rrf_score, count(*) AS n_sources FROM ranked GROUP BY ALL)
"""

_LEAK = r"""
doc_words AS (
  SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '\p{Cf}+', '', 'g')), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
item_words AS (
  SELECT item_id, regexp_extract_all(lower(regexp_replace(item_text, '\p{Cf}+', '', 'g')), '[\p{L}\p{N}]+') AS w FROM eval_items),
doc_grams AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM doc_words)),
item_grams AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM item_words)),
found AS (SELECT DISTINCT doc_id, item_id FROM doc_grams JOIN item_grams USING (g))
"""

_PROXIMITY = r"""
WITH dw AS (
  SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM (
    SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '\p{Cf}+', '', 'g')), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL)),
iw AS (
  SELECT item_id, unnest(w) AS term, unnest(range(len(w))) AS off FROM (
    SELECT item_id, regexp_extract_all(lower(regexp_replace(item_text, '\p{Cf}+', '', 'g')), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE item_text IS NOT NULL)),
hit AS (SELECT doc_id, item_id, pos - off AS shift, off FROM dw JOIN iw USING (term)),
full_hit AS (SELECT * FROM hit QUALIFY count(*) OVER (PARTITION BY doc_id, item_id, shift) >= 12),
near AS (
  SELECT doc_id, item_id, shift, shift + off AS pos, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY off RANGE BETWEEN CURRENT ROW AND 15 FOLLOWING) AS n FROM full_hit),
best AS (SELECT doc_id, item_id, shift, max(n) AS n, min(pos) AS p FROM near WHERE n >= 12 GROUP BY ALL)
SELECT doc_id, item_id, max(n)::INTEGER AS n_words, arg_min(p, (-n, p))::INTEGER AS first_pos FROM best GROUP BY ALL
"""

_SQL_TEXT = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"

ORACLE = {
    "p1_source_samples": f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_SQL_TEXT, r)) + ')' for r in SOURCE_PAIRS)}) AS t(path, name, kind, line, description)",
    "p2_found": f"""
WITH {_RRF}
SELECT query_id, fqn FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 12) DESC, fqn) AS k FROM fused) WHERE k <= 3""",
    "p2_fused": f"WITH {_RRF} SELECT query_id, fqn, round(rrf_score, 9) AS rrf_score, n_sources FROM fused",
    "p4_found": """
WITH live AS (
  SELECT id, embedding, deleted_at, row_number() OVER (PARTITION BY fqn ORDER BY indexed_at DESC, id DESC) AS rn FROM code_symbols),
v AS (
  SELECT 'symbol:' || id AS key, embedding::DOUBLE[] AS e FROM live WHERE rn = 1 AND deleted_at IS NULL
  UNION ALL SELECT 'memory:' || id, embedding::DOUBLE[] FROM agent_memories),
ok AS (
  SELECT key, e FROM v WHERE len(e) = 768 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
sim AS (
  SELECT a.key AS key, b.key AS other, list_cosine_similarity(a.e, b.e) AS s FROM ok a JOIN ok b ON a.key <> b.key),
near AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY s DESC, other) AS k FROM sim)
SELECT DISTINCT least(key, other) AS key_a, greatest(key, other) AS key_b FROM near WHERE k <= 5 AND s >= 0.8""",
    "p8_roundtrip": "SELECT doc_id, true AS same FROM documents",
    "p9_found": f"WITH {_LEAK} SELECT doc_id, item_id FROM found",
    "p9_proximity": _PROXIMITY,
    "p9_report": f"""
WITH {_LEAK}
SELECT i.item_id, i.suite, count(f.doc_id) AS n_docs FROM eval_items i LEFT JOIN found f ON f.item_id = i.item_id GROUP BY ALL""",
}
