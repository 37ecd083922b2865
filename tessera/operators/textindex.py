"""A stored inverted index of stems with positions, and ranks by weight, number and nearness of matches."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.stem import stem
from tessera.operators.lexical import FIELDS, STOP_WORDS, _plain_words, clean_terms, split_terms
from tessera.session import materialize

_WORD = re.compile(r"[^\W_]+")
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
_STOP = frozenset(STOP_WORDS)
#: The sum of 1 / i² over all i: what a term that is everywhere could reach.
_ALL = math.pi**2 / 6


def lexemes(text: str | None) -> list[tuple[int, str]]:
    """Position and stem of each word of a text; a name of several words counts whole and, at the same place, by its parts. Stop words have a place but no stem."""
    out: list[tuple[int, str]] = []
    for i, w in enumerate(_WORD.findall(text or "")):
        parts = [p.lower() for p in _HUMP.split(w)]
        for t in dict.fromkeys([w.lower(), *parts]):
            if t not in _STOP:
                out.append((i, stem(t)))
    return out


def term_score(weights: list[float]) -> float:
    """What one term adds to a rank: its occurrences in order, each worth less by the square of its number; the best one counts as the first."""
    total = sum(w / (i + 1) ** 2 for i, w in enumerate(weights))
    best = max(range(len(weights)), key=lambda i: (weights[i], -i))
    return (weights[best] + total - weights[best] / (best + 1) ** 2) / _ALL


def near_score(places: list[list[int]], weights: list[list[float]]) -> float:
    """The rank of a text in which all of several terms occur: every pair of occurrences of two terms adds by weight and nearness."""
    out = 0.0
    for i in range(len(places)):
        for k in range(i):
            for a, wa in zip(places[i], weights[i], strict=True):
                for b, wb in zip(places[k], weights[k], strict=True):
                    far = abs(a - b)
                    near = 1e-30 if far > 100 or not far else 1 / (1.005 + 0.05 * math.exp(far / 1.5 - 2))
                    out = 1 - (1 - out) * (1 - math.sqrt(wa * wb * near))
    return out


def build(symbols: DataFrame) -> DataFrame:
    """fqn, term, places, weights, score: the postings of symbols (fqn and the fields of :data:`FIELDS`), ordered by term.

    The fields of a symbol follow one another, so places tell how near words
    are. Written once and laid out by ranges of terms, so that a search reads
    the row groups of its terms; a term of many symbols is spread over ranges.
    """
    cols = ["fqn", *[f for f in FIELDS if f != "fqn"]]

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in pdfs:
            rows = []
            for values in zip(*[p[c] for c in cols], strict=True):
                row = dict(zip(cols, values, strict=True))
                found: dict[str, tuple[list[int], list[float]]] = {}
                at = 0
                for field, weight in FIELDS.items():
                    last = -1
                    for i, t in lexemes(row[field]):
                        places, weights = found.setdefault(t, ([], []))
                        if not places or places[-1] != at + i:
                            places.append(at + i)
                            weights.append(weight)
                        last = i
                    at += last + 1
                rows += [(row["fqn"], t, a, w, term_score(w)) for t, (a, w) in found.items()]
            yield pd.DataFrame(rows, columns=["fqn", "term", "places", "weights", "score"])

    some = symbols.where(F.col("fqn").isNotNull()).select(*cols)
    rows = some.mapInPandas(run, "fqn string, term string, places array<int>, weights array<double>, score double")
    return materialize(rows.repartitionByRange("term", "fqn").sortWithinPartitions("term", "fqn"), "text-index")


def and_tier(index: DataFrame, query: str) -> DataFrame:
    """R2: fqn, score of the symbols that hold the stem of every word of the query."""
    terms = sorted({stem(w) for t in split_terms(query) for w in _plain_words(t)})
    if not terms:
        return index.select("fqn", "score").limit(0)
    hits = index.where(F.col("term").isin(terms))
    if len(terms) == 1:
        return hits.select("fqn", F.round("score", 6).alias("score"))
    all_of = hits.groupBy("fqn").agg(F.count(F.lit(1)).alias("n"), F.collect_list("places").alias("places"), F.collect_list("weights").alias("weights")).where(F.col("n") == len(terms))

    def rank(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in pdfs:
            yield pd.DataFrame({"fqn": p["fqn"], "score": [round(near_score([list(x) for x in a], [list(x) for x in w]), 6) for a, w in zip(p["places"], p["weights"], strict=True)]})

    return all_of.select("fqn", "places", "weights").mapInPandas(rank, "fqn string, score double")


def or_tier(index: DataFrame, query: str) -> DataFrame:
    """Fqn, score of the symbols with a stem that begins with the stem of any term; nothing for a query of one term."""
    clean = sorted({stem(t) for t in clean_terms(query)})
    if len(split_terms(query)) <= 1 or not clean:
        return index.select("fqn", "score").limit(0)
    hit = F.lit(False)
    matches = F.lit(0)
    for t in clean:
        hit = hit | F.col("term").startswith(t)
        matches = matches + F.when(F.col("term").startswith(t), 1).otherwise(0)
    return index.where(hit).groupBy("fqn").agg(F.round(F.sum(F.col("score") * matches) / len(clean), 6).alias("score"))
