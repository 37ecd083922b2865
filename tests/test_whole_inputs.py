"""Queries take their whole input: every line of a text, every ranked list, every cycle."""

from __future__ import annotations

from tessera.operators import graph as G
from tessera.plans import graphs as P
from tessera.plans import problems as H
from tessera.plans import retrieval as Q


def _documents(spark, at, *texts):
    rows = [(f"d{i}", t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id string, text string").write.parquet(f"{at}/documents.parquet")
    return str(at)


def test_texts_are_read_beyond_their_first_line(spark, tmp_path):
    d = _documents(spark, tmp_path, "plain words\nfind callers\r\nof OrderService.run now", "\nthe hierarchy", "see API)\nor MAX_ROWS!\n", "a.b\nc", None)
    by = lambda df: {r[0]: r[1] for r in df.collect()}
    terms = by(Q.r05_split_terms(spark, d))
    assert terms == {"d0": "plain words find callers OrderService.run now", "d1": "hierarchy", "d2": "see API MAX_ROWS!", "d3": "a.b"}
    assert by(Q.r08_classify(spark, d)) == {"d0": "Graph", "d1": "Graph", "d2": "Hybrid", "d3": "Bm25"}
    # as in the reference, tokens end at spaces only, and marks before a line break are not trimmed: MAX_ROWS!\n is no word in capitals
    assert by(Q.r09_code_tokens(spark, d)) == {"d0": "OrderService.run", "d1": None, "d2": "API)\nor", "d3": None}


def _edges(spark, pairs):
    return spark.createDataFrame([(a, b, "Inherits") for a, b in pairs], "from_fqn string, to_fqn string, type string")


def test_cycles_of_any_length(spark):
    ring = [(f"r{i:02}", f"r{(i + 1) % 14:02}") for i in range(14)]
    pairs = [*ring, ("x", "r00"), ("r05", "y"), ("y", "z"), ("self", "self"), ("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("d", "e"), ("e", "d")]
    want = {**{f"r{i:02}": "r00" for i in range(14)}, "self": "self", "b": "b", "c": "b", "d": "d", "e": "d"}
    e = _edges(spark, pairs)
    assert {r["fqn"] for r in G.on_cycle(e, "Inherits").collect()} == set(want)
    for capacity in (1000, 0):
        assert {r["fqn"]: r["component"] for r in G.cycle_components(e, "Inherits", capacity).collect()} == want


def test_cycle_paths_have_no_limit(spark, tmp_path):
    pairs = [(f"t{i:03}.{a}", f"t{i:03}.{b}") for i in range(110) for a, b in (("a", "b"), ("b", "a"))]
    _edges(spark, pairs).write.parquet(f"{tmp_path}/relationships.parquet")
    got = {r["n"]: r["path"] for r in P.g15_cycle_paths(spark, str(tmp_path)).collect()}
    assert got == {i: f"t{i:03}.a -> t{i:03}.b -> t{i:03}.a" for i in range(110)}


def test_rrf_fuses_every_query(spark, tmp_path):
    rows = [(q, f"f{i:02}", float(30 - i), s) for q in (1, 2) for s in ("vector", " BM25") for i in range(25)]
    rows += [(3, "twice", 2.0, "graph"), (3, "twice", 1.0, "graph"), (3, "once", 3.0, "graph"), (3, "nan", float("nan"), "graph")]
    spark.createDataFrame(rows, "query_id long, fqn string, score double, source string").write.parquet(f"{tmp_path}/search_results.parquet")
    got = Q.r12_rrf(spark, str(tmp_path)).collect()
    for q in (1, 2):
        mine = sorted((r["place"], r["fqn"], r["source"]) for r in got if r["query_id"] == q)
        assert mine == [(i + 1, f"f{i:02}", "vector") for i in range(20)]
    assert {(r["place"], r["fqn"], r["score"]) for r in got if r["query_id"] == 3} == {(1, "twice", round(1 / 62 + 1 / 63, 9)), (2, "once", round(1 / 61, 9))}


def test_descendants_are_listed(spark, tmp_path):
    _edges(spark, [("b", "a"), ("c", "b"), ("d", "b"), ("x", "y"), ("y", "x"), ("z", "x")]).write.parquet(f"{tmp_path}/relationships.parquet")
    got = sorted((r["fqn"], r["descendant_fqn"], r["distance"]) for r in H.QUERIES["p6_descendants"](spark, str(tmp_path)).collect())
    assert got == [("a", "b", 1), ("a", "c", 2), ("a", "d", 2), ("b", "c", 1), ("b", "d", 1)]
