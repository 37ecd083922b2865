"""Lexical search over symbols, ranked lists and their fusion, and budgeted formatting.

Words are the runs of letters, digits and ``_`` in small letters; stop words
are dropped, nothing is stemmed. The score of a match is the sum of the
weights of the fields in which each term occurs.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X

# Words that no query looks for.
STOP_WORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may",
    "might", "shall", "can", "need", "must", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "into", "through", "during", "before", "after",
    "above", "below", "and", "but", "or", "nor", "not", "so", "yet", "both", "either", "this", "that", "these", "those", "it", "its", "what", "which", "who",
    "whom", "how", "where", "when", "why", "all", "each", "every", "any", "few", "more", "most", "some", "about", "between", "under", "over", "such", "only",
    "also", "than",
)
#: Weights of name, fqn, signature and documentation.
FIELDS = {"name": 1.0, "fqn": 0.4, "signature": 0.2, "documentation": 0.1}
#: Words that make a query a structural one.
STRUCTURAL = ("caller", "callers", "called by", "depends on", "dependency", "implements", "inherits", "hierarchy", "override")
_PUNCTUATION = " ,;:()[]{}\"'"


def split_terms(query: str) -> list[str]:
    """The terms of a query: without stop words and single small letters; if nothing is left, its longer tokens."""
    tokens = query.translate({ord(c): " " for c in _PUNCTUATION}).split()
    terms = [t for t in tokens if t.lower() not in STOP_WORDS and (len(t) > 1 or t.isupper())]
    return terms or [t for t in tokens if len(t) > 1]


def split_terms_col(query: Column | str) -> Column:
    """R5 as a column: an array of terms; null for null."""
    query = F.col(query) if isinstance(query, str) else query
    tokens = F.filter(F.split(query, r"[\s,;:()\[\]{}\"']+"), lambda t: t != "")
    terms = F.filter(tokens, lambda t: ~F.lower(t).isin(*STOP_WORDS) & ((F.length(t) > 1) | t.rlike(r"^\p{Lu}$")))
    return F.when(F.size(terms) > 0, terms).otherwise(F.filter(tokens, lambda t: F.length(t) > 1))


def classify_col(query: Column | str) -> Column:
    """Graph for structural words, Bm25 for one dotted token, else Hybrid."""
    query = F.col(query) if isinstance(query, str) else query
    graph = reduce(lambda a, b: a | b, [F.lower(query).contains(w) for w in STRUCTURAL])
    return F.when(graph, "Graph").when(query.contains(".") & ~query.contains(" "), "Bm25").otherwise("Hybrid")


def code_tokens_col(query: Column | str) -> Column:
    """The tokens of a mixed query that look like code, joined by spaces; null without a space or such a token."""
    query = F.col(query) if isinstance(query, str) else query
    cleaned = F.transform(F.filter(F.split(query, " "), lambda t: t != ""), lambda t: F.regexp_replace(t, r"^[,;:()\[\]{}\"'?!]+|[,;:()\[\]{}\"'?!]+\z", ""))
    code = lambda t: t.contains(".") | X.is_pascal(t) | X.is_camel(t) | (t.rlike(r"^[\p{Lu}\p{Nd}_]+\z") & (F.length(t) >= 2))
    kept = F.filter(cleaned, lambda t: (t != "") & code(t))
    return F.when(query.contains(" ") & (F.size(kept) > 0), F.array_join(kept, " "))


def classify(query: str) -> str:
    """R8 of one query."""
    if any(w in query.lower() for w in STRUCTURAL):
        return "Graph"
    return "Bm25" if "." in query and " " not in query else "Hybrid"


def code_tokens(query: str) -> str | None:
    """R9 of one query."""
    marks = ",;:()[]{}\"'?!"
    has = lambda t, test: any(test(c) for c in t)
    kept = []
    for t in (x.strip(marks) for x in query.split(" ")):
        pascal = t[:1].isupper() and has(t, str.islower) and sum(c.isupper() for c in t) >= 2
        camel = t[:1].islower() and has(t, str.isupper)
        caps = len(t) >= 2 and all(c.isupper() or c.isdecimal() or c == "_" for c in t)
        if t and ("." in t or pascal or camel or caps):
            kept.append(t)
    return " ".join(kept) if " " in query and kept else None


def words_of(c: Column | str) -> Column:
    """Distinct words of a text, in small letters, without stop words; empty for null."""
    c = F.col(c) if isinstance(c, str) else c
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{Nd}_]+)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(*STOP_WORDS)))


def _word_test(term: str, prefix: bool):
    return (lambda w: w.startswith(term)) if prefix else (lambda w: w == F.lit(term))


def _scored(symbols: DataFrame, terms: list[str], prefix: bool) -> DataFrame:
    """fqn, n (terms found), score. One scan, no index: the fields' words are tested in place."""
    hits, score = F.lit(0), F.lit(0.0)
    df = symbols.select("fqn", *[words_of(f).alias(f"_{f}") for f in FIELDS])
    for t in terms:
        found = {f: F.exists(f"_{f}", _word_test(t, prefix)) for f in FIELDS}
        hits = hits + F.when(reduce(lambda a, b: a | b, found.values()), 1).otherwise(0)
        for f, weight in FIELDS.items():
            score = score + F.when(found[f], weight).otherwise(0.0)
    return df.select("fqn", hits.alias("n"), F.round(score, 6).alias("score"))


def and_tier(symbols: DataFrame, query: str) -> DataFrame:
    """R2: fqn, score of the symbols in which every word of the query occurs."""
    terms = sorted({w for t in split_terms(query) for w in _plain_words(t)})
    if not terms:
        return symbols.select("fqn", F.lit(0.0).alias("score")).limit(0)
    return _scored(symbols, terms, False).where(F.col("n") == len(terms)).select("fqn", "score")


def clean_terms(query: str) -> list[str]:
    """The sanitized terms of a query in small letters, each once."""
    return sorted({"".join(c for c in t if c.isascii() and (c.isalnum() or c == "_")).lower() for t in split_terms(query)} - {""})


def or_tier(symbols: DataFrame, query: str) -> DataFrame:
    """Fqn, score of the symbols in which any sanitized term begins a word; nothing for a query of one term."""
    terms, clean = split_terms(query), clean_terms(query)
    if len(terms) <= 1 or not clean:
        return symbols.select("fqn", F.lit(0.0).alias("score")).limit(0)
    return _scored(symbols, clean, True).where(F.col("n") > 0).select("fqn", "score")


def ilike_tier(symbols: DataFrame, query: str) -> DataFrame:
    """Fqn, name, matched, score (share of terms) of the symbols with a term inside name, fqn or signature, in any case."""
    terms = split_terms(query)
    if not terms:
        return symbols.select("fqn", "name", F.lit(0).alias("matched"), F.lit(0.0).alias("score")).limit(0)
    has = lambda t: reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(f, F.lit(""))), F.lit(t.lower())) for f in ("name", "fqn", "signature")])
    matched = reduce(lambda a, b: a + b, [F.when(has(t), 1).otherwise(0) for t in terms])
    return symbols.select("fqn", "name", matched.alias("matched")).where("matched > 0").withColumn("score", F.round(F.col("matched") / len(terms), 6))


def _plain_words(s: str) -> list[str]:
    return [w for w in re.findall(r"[^\W]+", s.lower()) if w not in STOP_WORDS]


def tiered_search(symbols: DataFrame, query: str, limit: int = 20, index: DataFrame | None = None) -> DataFrame:
    """Place, fqn, score, tier of the first tier that finds anything: all words, any prefix, any substring.

    The tiers are one plan: rows keep the lowest tier that has any row. A blank
    query finds nothing. Ties: shorter name, then fqn. With an ``index``
    (:func:`tessera.operators.textindex.build`) of the symbols the first two
    tiers compare stems and rank by number and nearness of matches, and read the
    lists of the query's terms alone.
    """
    from tessera.operators import textindex

    names = symbols.select("fqn", F.length("name").alias("_len"))
    by_words = (and_tier(symbols, query), or_tier(symbols, query)) if index is None else (textindex.and_tier(index, query), textindex.or_tier(index, query))
    tiers = [*by_words, ilike_tier(symbols, query).select("fqn", "score")]
    every = reduce(DataFrame.unionByName, [t.withColumn("tier", F.lit(i + 1)) for i, t in enumerate(tiers)])
    lowest = every.agg(F.min("tier").alias("_low"))
    kept = every.join(F.broadcast(lowest), F.col("tier") == F.col("_low")).join(names, "fqn")
    page = kept.orderBy(F.col("score").desc(), "_len", "fqn").limit(limit)
    w = Window.orderBy(F.col("score").desc(), "_len", "fqn")
    return page.select(F.row_number().over(w).alias("place"), "fqn", "score", "tier")


def bm25(docs: DataFrame, key: str, text: str, query: str, limit: int = 20, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key, score of the best documents by BM25 with these constants; document frequencies over the whole corpus."""
    terms = sorted(set(_plain_words(query)))
    bag = docs.where(F.col(text).isNotNull()).select(key, F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{Nd}_]+)"), F.lit(1)).alias("w"))
    tf = bag.select(key, F.size("w").alias("len"), *[F.size(F.filter("w", _word_test(t, False))).alias(f"tf{i}") for i, t in enumerate(terms)])
    stats = tf.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    x = tf.join(F.broadcast(stats), F.lit(True))
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score = score + idf * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    out = x.select(key, F.round(score, 6).alias("score")).where("score > 0")
    return out.orderBy(F.col("score").desc(), key).limit(limit)


def cosine_to(vector: Column | str, query: list[float]) -> Column:
    """cosine similarity of a column of vectors to one vector, by Arrow batches in double precision.

    Null for vectors that are null, of another length, zero, or with a null or a value that is not finite.
    """
    q = np.array(query, float)
    q = q / (np.linalg.norm(q) or np.nan)

    def similarity(v: pa.Array) -> pa.Array:
        usable = pc.fill_null(pc.equal(pc.list_value_length(v), len(q)), False)
        x = v.filter(usable).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(q))
        out = np.full(len(v), np.nan)
        with np.errstate(divide="ignore", invalid="ignore"):
            out[usable.to_numpy(zero_copy_only=False)] = (x @ q) / np.linalg.norm(x, axis=1)
        return pa.array(out, mask=~np.isfinite(out))

    return F.arrow_udf(similarity, "double")(vector)


def vector_top(vectors: DataFrame, key: str, vector: str, query: list[float], limit: int = 10) -> DataFrame:
    """Key, score of the rows most similar to one vector by cosine; rows without a usable vector stay out.

    Every task keeps its own best rows, so no more than ``limit`` of each are merged.
    """
    out = vectors.where(F.size(vector) == len(query)).select(key, F.round(cosine_to(vector, query), 6).alias("score"))
    return out.where(F.col("score").isNotNull()).orderBy(F.col("score").desc(), key).limit(limit)


def rrf(lists: dict[str, DataFrame], key: str, limit: int = 20, k: int = 60, by: str | None = None) -> DataFrame:
    """Place, key, score, source of several ranked lists (key, rank from 1) fused: sum of 1 / (k + rank).

    A key that a list holds twice adds up; its source is the first list that has
    it; ties go to the earlier list, the better rank, then the smaller key. With
    a column ``by`` of the lists, each of its values is fused and limited by itself.
    """
    group = [by] if by else []
    parts = [df.select(*group, key, F.col("rank").cast("long").alias("rank"), F.lit(i).alias("ord"), F.lit(name).alias("source")) for i, (name, df) in enumerate(lists.items())]
    every = reduce(DataFrame.unionByName, parts)
    out = every.groupBy(*group, key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("s"), F.min(F.struct("ord", "rank", "source")).alias("f"))
    out = out.select(*group, key, F.round("s", 9).alias("score"), "f.source", F.col("f.ord").alias("ord"), F.col("f.rank").alias("r"))
    order = (F.col("score").desc(), F.col("ord"), F.col("r"), F.col(key))
    page = out if by else out.orderBy(*order).limit(limit)
    placed = page.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return placed.where(F.col("place") <= limit).select(*group, "place", key, "score", "source")


def hybrid(
    symbols: DataFrame,
    vectors: DataFrame,
    query: str,
    embed: Callable[[str], list[float] | None],
    limit: int = 20,
    variants: Callable[[str], list[str]] | None = None,
    hypothetical: Callable[[str], str | None] | None = None,
) -> DataFrame:
    """Place, fqn, score, source: lexical and vector hits of a query, fused.

    The lexical side searches the query's code tokens (R9), or all of it where
    it has none. The vector side embeds the whole query, or the hypothetical
    document that ``hypothetical`` writes for it (R14; None or a failure leaves
    the query). ``variants`` gives other phrasings (R13): the first repeats the
    query and is skipped, the hits of the others make one list. ``vectors``: fqn,
    embedding. A vector side that fails or finds nothing leaves the lexical one (R11).
    """
    lexical = ranked(tiered_search(symbols, code_tokens(query) or query), F.col("place")).select("fqn", "rank")
    lists = {"bm25": lexical}
    vector = _attempt(lambda: embed((hypothetical and _attempt(lambda: hypothetical(query))) or query))
    if vector is not None and len(vector):
        near = vector_top(vectors, "fqn", "embedding", list(vector), 20)
        lists = {"vector": ranked(near, F.col("score").desc(), F.col("fqn")).select("fqn", "rank"), **lists}
    others = (_attempt(lambda: variants(query)) or [])[1:] if variants else []
    if others:
        parts = [tiered_search(symbols, q).withColumn("_v", F.lit(i)) for i, q in enumerate(others)]
        lists["expanded"] = ranked(reduce(DataFrame.unionByName, parts), F.col("_v"), F.col("place")).select("fqn", "rank")
    return rrf(lists, "fqn", limit)


def phrasings(query: str) -> list[str]:
    """R13 without a model: the query's names split into words, and its terms without the rest."""
    terms = split_terms(query)
    split = " ".join(re.sub(r"(?<=[a-z0-9])(?=[A-Z])|[._]", " ", t) for t in terms)
    return [q for q in dict.fromkeys((split, " ".join(terms))) if q and q != query]


def _attempt(call: Callable):
    """What ``call`` gives, None if it fails: services beside a search may be away."""
    try:
        return call()
    except Exception:  # noqa: BLE001
        return None


def ranked(df: DataFrame, *order: Column, by: str | None = None) -> DataFrame:
    """O1: a result page with its ranks from 1; with a column ``by``, one page for each of its values."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*([by] if by else [])).orderBy(*order)))


def entry_text(level: Column | int) -> Column:
    """One hit as text at a level of detail: 0 a line, 1 with place and documentation, 2 with summary and score."""
    lv = F.lit(level) if isinstance(level, int) else level
    sig = F.when(F.col("signature").isNotNull(), F.concat(F.lit(" — "), "signature")).otherwise("")
    head = F.concat(F.lit("["), "kind", F.lit("] "), "fqn")
    doc = lambda n: F.when(F.col("documentation").isNotNull(), F.concat(F.lit("\n  Doc: "), X.truncated("documentation", n))).otherwise("")
    place = F.concat(F.lit("\n  Signature: "), F.coalesce("signature", F.lit("N/A")), F.lit("\n  File: "), F.coalesce("file_path", F.lit("")), F.lit(":"), F.coalesce(F.col("start_line").cast("string"), F.lit("")))
    extra = F.concat(F.when(F.col("summary").isNotNull(), F.concat(F.lit("\n  Summary: "), "summary")).otherwise(""), F.lit("\n  Score: "), F.format_string("%.4f", "score"), F.lit(" ("), "source", F.lit(")"))
    return F.when(lv == 0, F.concat(head, sig)).when(lv == 1, F.concat(head, place, doc(150))).otherwise(F.concat(head, place, doc(200), extra))


def level_for(count: Column, budget: int = 4000) -> Column:
    """The level of detail that a token budget allows for so many hits."""
    each = F.floor(F.lit(budget) / F.greatest(count, F.lit(1)))
    return F.when(each >= 500, 2).when(each >= 150, 1).otherwise(0)


def compress(hits: DataFrame, place: str = "place", budget: int = 4000) -> DataFrame:
    """Place, entry of the hits, in order, that fit the budget of tokens (four characters each).

    An entry has two characters at least with its line break, so the budget
    tells how many of the first hits can count at most; only these are ordered.
    """
    n = hits.agg(F.count(F.lit(1)).alias("_n"))
    x = hits.join(F.broadcast(n), F.lit(True)).withColumn("entry", entry_text(level_for(F.col("_n"), budget))).select(place, "entry")
    x = x.orderBy(place).limit(2 * budget + 4)
    first = Window.orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_before", F.coalesce(F.sum(F.length("entry") + 1).over(first), F.lit(0)))
    x = x.withColumn("_over", (F.floor((F.col("_before") + F.length("entry")) / 4) > budget).cast("int"))
    first_over = F.sum("_over").over(Window.orderBy(place).rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("_cut", first_over).where("_cut = 0").select(place, "entry")


def resolve_repository(repos: DataFrame, wanted: str) -> DataFrame:
    """The repository of a name: equal without case, else contained in name or path; the last indexed first."""
    w = wanted.strip().lower()
    if not w:
        return repos.select("id", "name", "path")
    tier = F.when(F.lower(F.trim("name")) == w, 1).when(F.lower("name").contains(w) | F.lower("path").contains(w), 2)
    return repos.withColumn("_t", tier).where(F.col("_t").isNotNull()).orderBy("_t", F.col("last_indexed").desc_nulls_last(), "id").limit(1).select("id", "name", "path")
