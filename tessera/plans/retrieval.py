"""Queries of lexical, vector and hybrid retrieval, formatting, and memories, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import lexical as L
from tessera.operators import memory as M
from tessera.operators.rank import numbered
from tessera.plans.graphs import LIVE, symbols
from tessera.plans.scalars import NOW
from tessera.tables import live_rows, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: Sample queries: all words in one symbol; any prefix; only a substring.
ALL_WORDS, ANY_PREFIX, SUBSTRING = "the newest throws", "restor settl zzz", "lockrange zzzz"


def _q(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def _words(c: str) -> str:
    stop = ", ".join(f"'{w}'" for w in L.STOP_WORDS)
    return f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{Nd}}_]+'), lambda w: w NOT IN ({stop})))"


_BAGS = "bags AS (SELECT fqn, length(name) AS len, name, signature, " + ", ".join(f"{_words(f)} AS w_{f}" for f in L.FIELDS) + " FROM live)"


def _tier(terms: list[str], prefix: bool) -> str:
    test = (lambda f, t: f"len(list_filter(w_{f}, lambda w: starts_with(w, '{t}'))) > 0") if prefix else (lambda f, t: f"list_contains(w_{f}, '{t}')")
    n = " + ".join("(CASE WHEN " + " OR ".join(test(f, t) for f in L.FIELDS) + " THEN 1 ELSE 0 END)" for t in terms)
    score = " + ".join(f"(CASE WHEN {test(f, t)} THEN {w} ELSE 0 END)" for t in terms for f, w in L.FIELDS.items())
    return f"SELECT fqn, len, {n} AS n, round(({score})::DOUBLE, 6) AS score FROM bags"


def _ilike(terms: list[str]) -> str:
    has = lambda t: " OR ".join(f"contains(lower(coalesce({c}, '')), '{t.lower()}')" for c in ("name", "fqn", "signature"))
    return " + ".join(f"(CASE WHEN {has(t)} THEN 1 ELSE 0 END)" for t in terms)


@_q(f"WITH {LIVE}, {_BAGS}, t AS ({_tier(["newest", "throws"], False)}) SELECT fqn, score FROM t WHERE n = 2")
def r02_and_tier(spark, d):
    return L.and_tier(symbols(spark, d), ALL_WORDS)


@_q(f"WITH {LIVE}, {_BAGS}, t AS ({_tier(['restor', 'settl', 'zzz'], True)}) SELECT fqn, score FROM t WHERE n > 0")
def r03_or_tier(spark, d):
    return L.or_tier(symbols(spark, d), ANY_PREFIX)


@_q(f"WITH {LIVE} SELECT fqn, name, matched, round(matched / 2.0::DOUBLE, 6) AS score FROM (SELECT fqn, name, {_ilike(SUBSTRING.split())} AS matched FROM live) WHERE matched > 0")
def r04_ilike_tier(spark, d):
    return L.ilike_tier(symbols(spark, d), SUBSTRING)


def _tiered_sql(words: list[str], prefixes: list[str], terms: list[str]) -> str:
    return f"""
WITH {LIVE}, {_BAGS}, a AS ({_tier(words, False)}), o AS ({_tier(prefixes, True)}),
i AS (SELECT fqn, length(name) AS len, {_ilike(terms)} AS m FROM live),
u AS (
  SELECT fqn, len, score, 1 AS tier FROM a WHERE n = {len(words)} UNION ALL SELECT fqn, len, score, 2 FROM o WHERE n > 0
  UNION ALL SELECT fqn, len, round(m / {len(terms)}.0::DOUBLE, 6), 3 FROM i WHERE m > 0)
SELECT row_number() OVER (ORDER BY score DESC, len, fqn) AS place, fqn, score, tier FROM u WHERE tier = (SELECT min(tier) FROM u) ORDER BY place LIMIT 20"""


@_q(_tiered_sql(["newest", "throws"], ["newest", "throws"], ["newest", "throws"]))
def r01_tiered_all_words(spark, d):
    return L.tiered_search(symbols(spark, d), ALL_WORDS)


@_q(_tiered_sql(["restor", "settl", "zzz"], ["restor", "settl", "zzz"], ["restor", "settl", "zzz"]))
def r01_tiered_prefix(spark, d):
    return L.tiered_search(symbols(spark, d), ANY_PREFIX)


@_q(_tiered_sql(["lockrange", "zzzz"], ["lockrange", "zzzz"], ["lockrange", "zzzz"]))
def r01_tiered_substring(spark, d):
    return L.tiered_search(symbols(spark, d), SUBSTRING)


@_q("")
def r01_stemmed(spark, d):
    """R1 to R3 over a stored index of stems, ranked by weight, number and nearness."""
    from tessera.operators import textindex

    s = symbols(spark, d)
    return L.tiered_search(s, "newest throwing", index=textindex.build(s))


_STOP = ", ".join(f"'{w}'" for w in L.STOP_WORDS)
_TOK = f"list_filter(regexp_split_to_array(text, '[\\s,;:()\\[\\]{{}}\"'']+'), lambda t: t <> '')"


@_q(f"""WITH x AS (SELECT doc_id, {_TOK} AS tok FROM documents WHERE text IS NOT NULL),
y AS (SELECT doc_id, tok, list_filter(tok, lambda t: lower(t) NOT IN ({_STOP}) AND (length(t) > 1 OR regexp_matches(t, '^\\p{{Lu}}$'))) AS a FROM x)
SELECT doc_id, array_to_string(CASE WHEN len(a) > 0 THEN a ELSE list_filter(tok, lambda t: length(t) > 1) END, ' ') AS terms FROM y""")
def r05_split_terms(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.array_join(L.split_terms_col("text"), " ").alias("terms"))


_STRUCT = " OR ".join(f"contains(lower(q), '{w}')" for w in L.STRUCTURAL)


@_q(f"SELECT doc_id, CASE WHEN {_STRUCT} THEN 'Graph' WHEN contains(q, '.') AND NOT contains(q, ' ') THEN 'Bm25' ELSE 'Hybrid' END AS route FROM (SELECT doc_id, text AS q FROM documents WHERE text IS NOT NULL)")
def r08_classify(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", L.classify_col("text").alias("route"))


_TRIMSET = "[,;:()\\[\\]{}\"''?!]+"


@_q(f"""WITH x AS (SELECT doc_id, text AS q FROM documents WHERE text IS NOT NULL),
y AS (SELECT doc_id, q, list_filter(list_transform(list_filter(string_split(q, ' '), lambda t: t <> ''), lambda t: regexp_replace(t, '^{_TRIMSET}|{_TRIMSET}$', '', 'g')),
  lambda t: t <> '' AND (contains(t, '.') OR (regexp_matches(t, '^\\p{{Lu}}') AND regexp_matches(t, '\\p{{Ll}}') AND length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) >= 2)
    OR (regexp_matches(t, '^\\p{{Ll}}') AND regexp_matches(t, '\\p{{Lu}}')) OR (regexp_matches(t, '^[\\p{{Lu}}\\p{{Nd}}_]+$') AND length(t) >= 2))) AS k FROM x)
SELECT doc_id, CASE WHEN contains(q, ' ') AND len(k) > 0 THEN array_to_string(k, ' ') END AS code FROM y""")
def r09_code_tokens(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", L.code_tokens_col("text").alias("code"))


_VEC = "SELECT id, embedding::DOUBLE[] AS e FROM agent_memories WHERE len(embedding) = 768 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0"
_QUERY_VECTOR = f"(SELECT e FROM ({_VEC}) ORDER BY id LIMIT 1)"


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    """The first usable vector by id stands for the embedded query."""
    m = table(spark, d, "agent_memories").select("id", "embedding")
    one = m.where(L.cosine_to("embedding", [1.0] * 768).isNotNull()).orderBy("id").first()
    return list(one["embedding"]) if one else [1.0] * 768


@_q(f"SELECT id, round(list_cosine_similarity(e, {_QUERY_VECTOR}), 6) AS score FROM ({_VEC}) ORDER BY score DESC, id LIMIT 10")
def r06_vector_top(spark, d):
    return L.vector_top(table(spark, d, "agent_memories"), "id", "embedding", _query_vector(spark, d))


_KIND_VEC = """k AS (SELECT fqn, lower(kind) AS kind, embedding::DOUBLE[] AS e FROM live WHERE len(embedding) = 768 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0)"""


@_q(f"WITH {LIVE}, {_KIND_VEC} SELECT fqn, round(list_cosine_similarity(e, {_QUERY_VECTOR}), 6) AS score FROM k WHERE kind = 'method' ORDER BY score DESC, fqn LIMIT 10")
def r06_vector_top_kind(spark, d):
    s = live_rows(table(spark, d, "code_symbols"), "kind", "embedding").where(F.lower("kind") == "method")
    return L.vector_top(s, "fqn", "embedding", _query_vector(spark, d))


#: A query in words with a code token, and what a model might write for it.
MIXED, DOCUMENT = "who calls VerifyPayload with the newest key", "VerifyPayload checks the payload of the newest key and throws if it is stale"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return live_rows(table(spark, d, "code_symbols"), "embedding").select("fqn", "embedding")


def _hashed(text: str) -> list[float]:
    from tessera.operators.reports import hashed_embedding

    return [float(x) for x in hashed_embedding(text, 768)]


def _near_sql(vector: str) -> str:
    return f"SELECT fqn, row_number() OVER (ORDER BY s DESC, fqn) AS r FROM (SELECT fqn, round(list_cosine_similarity(e, {vector}), 6) AS s FROM k) QUALIFY r <= 20"


def _vector_sql(text: str) -> str:
    return "[" + ", ".join(str(x) for x in _hashed(text)) + "]::DOUBLE[]"


def _fused_sql(lexical: str, vector: str, *more: str) -> str:
    """The fused page of a lexical search, a vector, and searches whose hits make one list."""
    more_ctes = "".join(f", m{i} AS ({q})" for i, q in enumerate(more))
    joined = " UNION ALL ".join(f"SELECT {i} AS v, place, fqn FROM m{i}" for i in range(len(more)))
    expanded = f" UNION ALL SELECT fqn, row_number() OVER (ORDER BY v, place), 2, 'expanded' FROM ({joined})" if more else ""
    return f"""WITH {LIVE}, {_KIND_VEC}, b AS ({lexical}){more_ctes}, v AS ({_near_sql(vector)}),
l AS (SELECT fqn, r, 0 AS ord, 'vector' AS src FROM v UNION ALL SELECT fqn, place, 1, 'bm25' FROM b{expanded}),
f AS (SELECT fqn, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score, arg_min(src, (ord, r)) AS source, min(ord) AS ord, arg_min(r, (ord, r)) AS r FROM l GROUP BY fqn)
SELECT row_number() OVER (ORDER BY score DESC, ord, r, fqn) AS place, fqn, score, source FROM f ORDER BY place LIMIT 20"""


def _search_sql(query: str) -> str:
    """The tiered search of a query as SQL."""
    words = sorted({w for t in L.split_terms(query) for w in L._plain_words(t)})
    return _tiered_sql(words, L.clean_terms(query), L.split_terms(query))


@_q(_fused_sql(_search_sql(L.code_tokens(MIXED)), _QUERY_VECTOR))
def r10_hybrid(spark, d):
    """Lexical on the code part of the query, vectors on the whole, fused; the first usable vector is the query's."""
    return L.hybrid(symbols(spark, d), _vectors(spark, d), MIXED, lambda q: _query_vector(spark, d))


@_q(_search_sql(ALL_WORDS).replace("SELECT row_number() OVER (ORDER BY score DESC, len, fqn) AS place, fqn, score, tier FROM u", "SELECT place, fqn, round(1.0::DOUBLE / (60 + place), 9) AS score, 'bm25' AS source FROM (SELECT row_number() OVER (ORDER BY score DESC, len, fqn) AS place, fqn, tier FROM u").replace(" ORDER BY place LIMIT 20", ") ORDER BY place LIMIT 20"))
def r11_vector_away(spark, d):
    """A vector side that fails leaves the lexical one."""

    def away(q: str) -> list[float]:
        raise ConnectionError(q)

    return L.hybrid(symbols(spark, d), _vectors(spark, d), ALL_WORDS, away)


@_q(_fused_sql(_search_sql(L.code_tokens(MIXED)), _vector_sql(DOCUMENT)))
def r14_hypothetical(spark, d):
    """The vector side embeds what a model writes for the query; hashes of words stand for an embedding service."""
    return L.hybrid(symbols(spark, d), _vectors(spark, d), MIXED, _hashed, hypothetical=lambda q: DOCUMENT)


@_q("""WITH h AS (SELECT query_id, fqn, lower(trim(source)) AS s, score FROM search_results WHERE score IS NOT NULL AND NOT isnan(score)),
l AS (SELECT query_id, fqn, s, row_number() OVER (PARTITION BY query_id, s ORDER BY score DESC, fqn) AS r, CASE s WHEN 'vector' THEN 0 WHEN 'bm25' THEN 1 WHEN 'graph' THEN 2 WHEN 'memory' THEN 3 ELSE 4 END AS ord FROM h),
f AS (SELECT query_id, fqn, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score, arg_min(s, (ord, r)) AS source, min(ord) AS ord, arg_min(r, (ord, r)) AS r FROM l GROUP BY query_id, fqn)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord, r, fqn) AS place, fqn, score, source FROM f QUALIFY place <= 20""")
def r12_rrf(spark, d):
    """R12 as the engine's own fusion has it, for every query_id: an item that one list holds twice adds up."""
    hits = table(spark, d, "search_results").where("score IS NOT NULL AND NOT isnan(score)").withColumn("s", F.lower(F.trim("source")))
    return L.rrf({s: L.ranked(hits.where(F.col("s") == s), F.col("score").desc(), F.col("fqn"), by="query_id").select("query_id", "fqn", "rank") for s in ("vector", "bm25", "graph", "memory", "rerank")}, "fqn", by="query_id")


@_q(_fused_sql(_search_sql(ALL_WORDS), _QUERY_VECTOR, _search_sql(ANY_PREFIX), _search_sql(SUBSTRING)))
def r13_variants(spark, d):
    """Other phrasings, each searched, concatenated into one list whose ranks go on, then fused."""
    return L.hybrid(symbols(spark, d), _vectors(spark, d), ALL_WORDS, lambda q: _query_vector(spark, d), variants=lambda q: [q, ANY_PREFIX, SUBSTRING])


def _hits(spark: SparkSession, d: str, order: bool = False) -> DataFrame:
    s = live_rows(table(spark, d, "code_symbols"), "name", "kind", "signature", "file_path", "start_line", "documentation", "summary")
    s = s.withColumn("score", F.lit(1.0)).withColumn("source", F.lit("graph"))
    return numbered(s, "fqn") if order else s


def _entry_sql(level: int) -> str:
    head = "'[' || kind || '] ' || fqn"
    doc = lambda n: f"CASE WHEN documentation IS NOT NULL THEN chr(10) || '  Doc: ' || CASE WHEN length(documentation) > {n} THEN substring(documentation, 1, {n}) || '...' ELSE documentation END ELSE '' END"
    place = "chr(10) || '  Signature: ' || coalesce(signature, 'N/A') || chr(10) || '  File: ' || coalesce(file_path, '') || ':' || coalesce(start_line::VARCHAR, '')"
    if level == 0:
        return f"{head} || CASE WHEN signature IS NOT NULL THEN ' — ' || signature ELSE '' END"
    if level == 1:
        return f"{head} || {place} || {doc(150)}"
    return f"{head} || {place} || {doc(200)} || CASE WHEN summary IS NOT NULL THEN chr(10) || '  Summary: ' || summary ELSE '' END || chr(10) || '  Score: 1.0000 (graph)'"


for _level in (0, 1, 2):

    def _format(spark, d, level=_level):
        return _hits(spark, d).select("fqn", L.entry_text(level).alias("entry"))

    QUERIES[f"r16_format_l{_level}"] = _format
    ORACLE[f"r16_format_l{_level}"] = f"WITH {LIVE} SELECT fqn, {_entry_sql(_level)} AS entry FROM live"


@_q(f"""WITH {LIVE}, x AS (SELECT row_number() OVER (ORDER BY fqn) AS place, {_entry_sql(0)} AS entry FROM live),
y AS (SELECT place, entry, coalesce(sum(length(entry) + 1) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(entry) AS n FROM x)
SELECT place, entry FROM y WHERE place < coalesce((SELECT min(place) FROM y WHERE n // 4 > 4000), 1000000000)""")
def r15_compress(spark, d):
    """R15, O3 over all live symbols: the level follows the number of hits, the text ends where the budget does."""
    return L.compress(_hits(spark, d, order=True))


@_q("SELECT id, name, path FROM repositories WHERE lower(trim(name)) = lower((SELECT name FROM repositories ORDER BY id LIMIT 1)) ORDER BY last_indexed DESC NULLS LAST, id LIMIT 1")
def r17_resolve_repository(spark, d):
    repos = table(spark, d, "repositories")
    return L.resolve_repository(repos, repos.orderBy("id").first()["name"].strip())


@_q(f"SELECT id, CASE WHEN last_indexed IS NULL THEN '(never)' WHEN s >= 86400 THEN floor(s / 86400)::BIGINT || CASE WHEN floor(s / 86400) = 1 THEN ' day ago' ELSE ' days ago' END WHEN s >= 21600 THEN floor(s / 3600)::BIGINT || ' hours ago' END AS label FROM (SELECT *, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_indexed)) / 1000000.0::DOUBLE AS s FROM repositories)")
def r19_index_age(spark, d):
    from tessera.tables import micros

    age = (micros(F.lit(NOW).cast("timestamp_ntz")) - micros("last_indexed")) / 1e6
    return table(spark, d, "repositories").select("id", X.index_age_label(age).alias("label"))


@_q("""WITH b AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}_]+') AS w FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, len(w) AS len, len(list_filter(w, lambda x: x = 'ledger')) AS t0, len(list_filter(w, lambda x: x = 'nightly')) AS t1 FROM b),
s AS (SELECT count(*) AS n, avg(len) AS al, count(*) FILTER (WHERE t0 > 0) AS d0, count(*) FILTER (WHERE t1 > 0) AS d1 FROM t)
SELECT doc_id, score FROM (SELECT doc_id, round((ln(1 + (n - d0 + 0.5::DOUBLE) / (d0 + 0.5::DOUBLE)) * t0 * 2.2::DOUBLE / (t0 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / al))
  + ln(1 + (n - d1 + 0.5::DOUBLE) / (d1 + 0.5::DOUBLE)) * t1 * 2.2::DOUBLE / (t1 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / al)))::DOUBLE, 6) AS score FROM t, s) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20""")
def r20_bm25_documents(spark, d):
    return L.bm25(table(spark, d, "documents"), "doc_id", "text", "nightly ledger")


def _level_sql(n: str) -> str:
    """The entry at the level that so many hits allow, with a real score and source."""
    two = _entry_sql(2).replace("'  Score: 1.0000 (graph)'", "'  Score: ' || printf('%.4f', score) || ' (bm25)'")
    return f"CASE WHEN 4000 // greatest({n}, 1) >= 500 THEN {two} WHEN 4000 // greatest({n}, 1) >= 150 THEN {_entry_sql(1)} ELSE {_entry_sql(0)} END"


@_q(f"""WITH {LIVE}, t AS ({_search_sql(ALL_WORDS)}), j AS (SELECT t.place, t.score, live.* FROM t JOIN live USING (fqn)),
x AS (SELECT place, {_level_sql("(SELECT count(*) FROM j)")} AS entry FROM j),
y AS (SELECT place, entry, coalesce(sum(length(entry) + 1) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(entry) AS n FROM x)
SELECT place, entry FROM y WHERE place < coalesce((SELECT min(place) FROM y WHERE n // 4 > 4000), 1000000000)""")
def r18_search_tool(spark, d):
    """The lexical tool: twenty hits, compressed."""
    s = symbols(spark, d)
    full = live_rows(table(spark, d, "code_symbols"), "name", "kind", "signature", "file_path", "start_line", "documentation", "summary")
    hits = L.tiered_search(s, ALL_WORDS).join(full, "fqn").withColumn("source", F.lit("bm25"))
    return L.compress(hits)


# ---- memories ----

_DAYS = "CASE WHEN lower(trim(scope)) = 'session' THEN 1 " + " ".join(f"WHEN topic = '{t}' THEN {n}" for t, n in X.TOPIC_DAYS.items()) + " ELSE 60 END"
_SCORED = f"""s AS (SELECT *, round(importance::DOUBLE * exp(-pow(greatest(0.0::DOUBLE, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_accessed_at)) / 1000000.0::DOUBLE) / (86400.0::DOUBLE * ({_DAYS})), 1.5::DOUBLE)), 6) AS score FROM agent_memories)"""


def _now() -> F.Column:
    return F.lit(NOW).cast("timestamp_ntz")


def _memories(spark, d):
    return table(spark, d, "agent_memories")


@_q(f"WITH {_SCORED} SELECT id, score, score AS weight FROM s WHERE score >= 0.1 ORDER BY score DESC, id LIMIT 10")
def m02_recall(spark, d):
    return M.recall(_memories(spark, d), _now())


@_q(f"""WITH {_SCORED}, ok AS (SELECT id AS oid, list_cosine_similarity(e, {_QUERY_VECTOR}) AS sim FROM ({_VEC}))
SELECT id, score, round(score * coalesce(sim, 0.5), 6) AS weight FROM s LEFT JOIN ok ON oid = id WHERE score >= 0.1 AND lower(trim(scope)) = 'global' ORDER BY weight DESC, id LIMIT 20""")
def m02_recall_cosine(spark, d):
    return M.recall(_memories(spark, d), _now(), 20, _query_vector(spark, d), in_scope="global")


@_q(f"""WITH {_SCORED}, r AS (SELECT id FROM s WHERE score >= 0.1 ORDER BY score DESC, id LIMIT 10)
SELECT id, CASE WHEN id IN (SELECT id FROM r) THEN coalesce(access_count, 0) + 1 ELSE access_count END AS access_count, CASE WHEN id IN (SELECT id FROM r) THEN epoch_us(TIMESTAMP '{NOW}') ELSE epoch_us(last_accessed_at) END AS at_us FROM agent_memories""")
def m03_bump(spark, d):
    from tessera.tables import micros

    m = _memories(spark, d)
    return M.touched(m, M.recall(m, _now()), _now()).select("id", "access_count", micros("last_accessed_at").alias("at_us"))


@_q("SELECT id, topic, importance::DOUBLE AS importance FROM agent_memories WHERE topic = 'decision' ORDER BY agent_memories.importance DESC NULLS LAST, last_accessed_at DESC NULLS LAST, id LIMIT 100")
def m04_list(spark, d):
    return M.listed(_memories(spark, d), topic="decision").select("id", "topic", F.col("importance").cast("double").alias("importance"))


@_q("SELECT id FROM agent_memories WHERE id <> (SELECT min(id) FROM agent_memories)")
def m05_forget(spark, d):
    m = _memories(spark, d)
    gone = m.agg(F.min("id")).first()[0]
    return m.where(~F.coalesce(F.col("id") == F.lit(gone), F.lit(False))).select("id")


@_q("WITH x AS (SELECT min(scope_id) AS sid FROM agent_memories WHERE lower(trim(scope)) = 'session') SELECT id FROM agent_memories, x WHERE NOT coalesce(lower(trim(scope)) = 'session' AND scope_id = sid, false)")
def m06_clear_session(spark, d):
    m = _memories(spark, d)
    sid = m.where(M.scope() == "session").agg(F.min("scope_id")).first()[0]
    return M.without_session(m, sid).select("id")


@_q(f"WITH {_SCORED} SELECT id FROM s WHERE NOT coalesce(score < 0.1, false)")
def m07_reap(spark, d):
    return M.reaped(_memories(spark, d), _now()).select("id")


@_q("WITH k AS (SELECT f, count(*) AS n FROM (SELECT unnest(related_fqns) AS f FROM agent_memories) GROUP BY f ORDER BY n DESC, f LIMIT 1), " + _SCORED + " SELECT id, score, score AS weight FROM s WHERE score >= 0.1 AND list_contains(related_fqns, (SELECT f FROM k)) ORDER BY score DESC, id LIMIT 10")
def m11_linked(spark, d):
    m = _memories(spark, d)
    top = m.select(F.explode("related_fqns").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "f").first()
    return M.recall(m, _now(), 10, fqn=top[0])


@_q(f"WITH {_SCORED} SELECT id, score FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(scope)), scope_id ORDER BY score DESC NULLS LAST, id) AS k FROM s) WHERE k <= 5")
def m12_ceiling(spark, d):
    return M.under_ceiling(_memories(spark, d), _now(), 5).select("id", "score")


@_q("""SELECT id, CASE WHEN coalesce(lower(trim(scope)) NOT IN ('session', 'project', 'global'), true) THEN 'scope'
  WHEN lower(trim(scope)) <> 'global' AND trim(coalesce(scope_id, '')) = '' THEN 'scope_id'
  WHEN topic IS NOT NULL AND topic NOT IN ('preference', 'pattern', 'decision', 'bug', 'todo', 'note') THEN 'topic'
  WHEN length(trim(coalesce(content, ''), ' ')) NOT BETWEEN 1 AND 4000 THEN 'content' WHEN coalesce(importance NOT BETWEEN 0 AND 1, true) THEN 'importance' END AS reason FROM agent_memories""")
def m01_validity(spark, d):
    """Why a row could not be saved (no content of these tables holds a secret)."""
    return _memories(spark, d).select("id", M.validity().alias("reason"))


@_q("SELECT m.id, r.name AS repo_name FROM agent_memories m LEFT JOIN repositories r ON lower(trim(m.scope)) = 'project' AND r.id = m.scope_id")
def j13_memory_repository(spark, d):
    """Project memories with the name of their repository."""
    from tessera.session import bounded

    r = bounded(table(spark, d, "repositories").select(F.col("id").alias("_rid"), F.col("name").alias("repo_name")))
    m = _memories(spark, d)
    return m.join(r, (M.scope() == "project") & (m["scope_id"] == r["_rid"]), "left").select("id", "repo_name")


@_q("SELECT count(*) AS n FROM agent_memories")
def a07_memory_count(spark, d):
    return _memories(spark, d).agg(F.count(F.lit(1)).alias("n"))


_NEW = (("n1", "Keeps the newest key.", " Global", None, "note", 0.5), ("n2", "x", "project", " ", "note", 0.5), ("n3", "x", "odd", None, None, 0.5), ("n4", "x", "global", None, "gossip", 0.5), ("n5", " ", "global", None, None, 0.5), ("n6", "x", "session", "s", None, 1.5))


@_q("SELECT * FROM (VALUES ('n1', NULL), ('n2', 'scope_id'), ('n3', 'scope'), ('n4', 'topic'), ('n5', 'content'), ('n6', 'importance')) AS t(id, reason)")
def m09_save_tool(spark, d):
    """M1, M9: what the save tool answers, row by row."""
    m = _memories(spark, d)
    new = spark.createDataFrame(list(_NEW), "id string, content string, scope string, scope_id string, topic string, importance float")
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in m.schema.fields if f.name not in new.columns]
    after, answer = M.tool(m, "save", _now(), rows=new.select("*", *rest))
    assert after.columns == m.columns
    return answer


@_q("SELECT count(*) AS gone FROM agent_memories WHERE lower(trim(scope)) = 'session' AND scope_id = (SELECT min(scope_id) FROM agent_memories WHERE lower(trim(scope)) = 'session')")
def m09_clear_tool(spark, d):
    m = _memories(spark, d)
    sid = m.where(M.scope() == "session").agg(F.min("scope_id")).first()[0]
    return M.tool(m, "clear", _now(), session=sid)[1]


@_q(f"WITH {_SCORED} SELECT id FROM s WHERE NOT coalesce(score < 0.1, false)")
def m08_reaper(spark, d):
    """M8: the table after one turn of the reaper."""
    from tessera.operators.store import VersionedTable
    from tessera.session import scratch_dir

    kept = VersionedTable(spark, scratch_dir(spark, "memories"))
    kept.write(_memories(spark, d))
    M.reaper(kept, now=_now(), once=True).awaitTermination()
    return kept.read().select("id")
