"""The engine's own operators on small fixtures with known answers."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import graph as G
from tessera.operators import lexical as L
from tessera.operators import memory as M
from tessera.operators import reports as R
from tessera.operators import store as W
from tessera.sources import extract as E
from tessera.sources import files as S
from tessera.streaming import watch as T

NODE = "fqn string, name string, kind string, signature string, file_path string, start_line int, accessibility string, is_test_method boolean, repo_id string, documentation string"


def edges(spark, *rows):
    return spark.createDataFrame([(a, b, t) for a, t, b in rows], "from_fqn string, to_fqn string, type string")


def nodes(spark, *rows):
    return spark.createDataFrame([(f, f.split("(")[0].rpartition(".")[2], k, None, p, 1, a, False, "r", None) for f, k, p, a in rows], NODE)


def fqns(df):
    return sorted(r["fqn"] for r in df.collect())


# ---- traversals ----


def test_callers_by_depth(spark):
    e = edges(spark, ("A.a", "Calls", "B.b"), ("B.b", "Calls", "C.c"))
    n = nodes(spark)
    assert fqns(G.callers(e, n, "C.c", 1)) == ["B.b"] and fqns(G.callers(e, n, "C.c", 3)) == ["A.a", "B.b"]


def test_cycle_ends_and_diamond_counts_once(spark):
    e = edges(spark, ("a", "Calls", "b"), ("b", "Calls", "a"), ("a", "Calls", "c"), ("b", "Calls", "d"), ("c", "Calls", "d"), (None, "Calls", "a"), ("a", "Calls", " "))
    assert fqns(G.callees(e, "a", 3)) == ["a", "b", "c", "d"]


def test_signatures_match_but_members_do_not(spark):
    e = edges(spark, ("x", "Calls", "N.C.m(int)"), ("y", "Calls", "N.C"), ("z", "Calls", "N.Cx"))
    assert fqns(G.callers(e, nodes(spark), "N.C.m", 1)) == ["x"] and fqns(G.callers(e, nodes(spark), "N.C", 1)) == ["y"]


def test_interface_callers(spark):
    e = edges(spark, ("N.Impl", "Implements", "N.IFace"), ("N.Other.go", "Calls", "N.IFace.run"), ("N.IFace.self", "Calls", "N.IFace.run"), ("N.Far.go", "Calls", "N.Else.run"))
    assert fqns(G.callers(e, nodes(spark), "N.Impl.run", 1)) == ["N.Other.go"]


def test_dependencies_never_mix_types(spark):
    e = edges(spark, ("a", "DependsOn", "b"), ("b", "UsesType", "c"), ("a", "UsesType", "System.Text"), ("a", "References", "d"), ("d", "References", "e"))
    assert fqns(G.dependencies(e, "a", 2)) == ["b", "d", "e"]


def test_hierarchy_has_no_siblings(spark):
    e = edges(spark, ("One", "Inherits", "Base"), ("Two", "Inherits", "Base"), ("One", "Implements", "IOne"), ("Sub", "Inherits", "One"))
    assert fqns(G.class_hierarchy(e, "One")) == ["Base", "IOne", "One", "Sub"]


def test_closure_equals_search(spark):
    r = random.Random(8)
    pairs = {(f"n{r.randrange(25)}", f"n{r.randrange(25)}") for _ in range(45)}
    e = edges(spark, *[(a, "Calls", b) for a, b in pairs])
    want: dict[str, int] = {}
    front, level = {"n1"}, 0
    while front and level < 6:
        level += 1
        front = {b for a, b in pairs if a in front} - set(want)
        want |= dict.fromkeys(front, level)
    got = {x["fqn"]: x["dist"] for x in G.closure(G.clean_edges(e), spark.createDataFrame([("n1",)], "fqn string"), 6).collect()}
    assert got == want


def test_dead_code(spark):
    n = nodes(
        spark,
        ("Base.fetch", "method", "a.cs", "public"), ("Rss.fetch", "METHOD", "b.cs", "public"), ("App.Main", "method", "c.cs", "public"), ("App.orphan", "function", "c.py", None), ("App._x", "method", "c.py", None),
        ("App.hidden", "method", "c.py", "private"), ("T.t", "method", "/tests/x.py", None), ("App.used", "method", "d.py", None), ("Rss", "class", "b.cs", "public"), ("P.m", "method", "p.py", None), ("Q.m", "method", "q.py", None),
    )
    e = edges(
        spark, ("Base", "HasMethod", "Base.fetch"), ("Rss", "HasMethod", "Rss.fetch"), ("Rss", "Inherits", "Base"), ("z", "Calls", "App.used"), ("P", "HasMethod", "P.m"), ("Q", "HasMethod", "Q.m"), ("P", "Inherits", "Protocol")
    )
    assert fqns(G.dead_code(n, e)) == ["App.orphan"]
    assert fqns(G.override_methods(e)) == ["Base.fetch", "Rss.fetch"] and fqns(G.protocol_methods(e)) == ["P.m", "Q.m"]


def test_cycles(spark):
    n = nodes(spark, *[(f"c{i:03d}", "class", "x", None) for i in range(20)])
    e = edges(spark, *[(f"c{i:03d}", "DependsOn", f"c{i + 1:03d}") for i in range(9)], ("c015", "DependsOn", "c016"), ("c016", "DependsOn", "c017"), ("c017", "DependsOn", "c015"))
    assert fqns(G.on_cycle(e)) == ["c015", "c016", "c017"]
    assert [r["path"] for r in G.cycle_paths(n, e).collect()] == [["c015", "c016", "c017", "c015"]]


def test_neighbors_degrees_and_hint(spark):
    e = edges(spark, ("a", "Calls", "b"), ("c", "UsesType", "a"), ("c", "Calls", "d"), ("a", "Calls", "a"))
    assert fqns(G.neighbors(e, "a", 1)) == ["b", "c"] and fqns(G.neighbors(e, "a", 2)) == ["b", "c", "d"]
    assert {r["fqn"]: (r["degree"], r["size"]) for r in G.degrees(e).collect()} == {"a": (2, 60), "b": (1, 40), "c": (2, 60), "d": (1, 40)}
    n = nodes(spark, ("N.C.one", "method", "x", None), ("N.C.two", "method", "x", None))
    assert fqns(G.did_you_mean(n, "N.C")) == fqns(G.did_you_mean(n, "N.C.typo")) == ["N.C.one", "N.C.two"] and not fqns(G.did_you_mean(n, "N.C.f(int)"))


def test_graphs_of_nothing(spark):
    e, n = edges(spark), nodes(spark)
    assert not fqns(G.callers(e, n, "x", 3)) and not fqns(G.dead_code(n, e)) and not fqns(G.on_cycle(e)) and fqns(G.class_hierarchy(e, "x")) == ["x"]
    assert G.cycle_paths(n, e).count() == 0


# ---- retrieval ----


def test_rrf(spark):
    a = spark.createDataFrame([("A", 1), ("B", 2)], "fqn string, rank int")
    b = spark.createDataFrame([("B", 1), ("C", 2), ("C", 3)], "fqn string, rank int")
    got = L.rrf({"vector": a, "bm25": b}, "fqn").orderBy("place").collect()
    assert [r["fqn"] for r in got] == ["B", "C", "A"] and got[0]["source"] == "vector" and abs(got[1]["score"] - (1 / 62 + 1 / 63)) < 1e-8
    assert L.rrf({"x": a, "y": b}, "fqn", limit=1).count() == 1


@pytest.mark.parametrize(("query", "terms"), [("how does the OrderService work", ["OrderService", "work"]), ("the is", ["the", "is"]), ("T a", ["T"]), ("", []), ("get(x), [y]", ["get"]), ("tìm kiếm", ["tìm", "kiếm"])])
def test_terms(spark, query, terms):
    assert L.split_terms(query) == terms
    assert list(spark.createDataFrame([(query,)], "q string").select(L.split_terms_col("q")).first()[0]) == terms


def test_tiers(spark):
    s = spark.createDataFrame([("N.fooBar", "fooBar", "m", "fooBar(x)", "reads the file"), ("N.file", "file", "m", None, None), ("N.other", "other", "m", "", "writes")], "fqn string, name string, kind string, signature string, documentation string")
    tier = lambda q: [(r["fqn"], r["tier"]) for r in L.tiered_search(s, q).orderBy("place").collect()]
    assert tier("file") == [("N.file", 1), ("N.fooBar", 1)] and tier("fil writ") == [("N.file", 2), ("N.other", 2), ("N.fooBar", 2)] and tier("oBa") == [("N.fooBar", 3)] and tier(" ") == []


def test_budget(spark):
    rows = [(i, f"f{i}", "method", "s" * 50, "p", 1, "d" * 1000, None, 0.5, "x") for i in range(100)]
    hits = spark.createDataFrame(rows, "place int, fqn string, kind string, signature string, file_path string, start_line int, documentation string, summary string, score double, source string")
    assert L.compress(hits, budget=500).count() < 100 and "Score: 0.5000 (x)" in L.compress(hits.limit(1)).first()["entry"]
    assert L.compress(hits.limit(0)).count() == 0


# ---- memories ----


def test_memories(spark):
    now = dt.datetime(2025, 7, 1)
    old = lambda d: now - dt.timedelta(days=d)
    rows = [
        ("fresh", "c", "global", None, "note", 0.5, [], None, now, now, 0), ("todo", "c", "global", None, "todo", 0.5, [], None, now, old(60), 0), ("pref", "c", "global", None, "preference", 0.8, ["N.x"], [1.0, 0.0], now, old(100), 1),
        ("later", "c", "SESSION", "s1", None, 1.0, None, [0.0, 0.0], now, now + dt.timedelta(days=1), None), ("none", None, None, None, None, None, None, None, None, None, None),
    ]
    m = spark.createDataFrame(rows, "id string, content string, scope string, scope_id string, topic string, importance double, related_fqns array<string>, embedding array<float>, created_at timestamp_ntz, last_accessed_at timestamp_ntz, access_count int")
    t = F.lit(now)
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(M.recall(m, t)) == ["later", "pref", "fresh"]
    assert ids(M.recall(m, t, query=[1.0, 0.0]))[0] == "pref"
    assert ids(M.recall(m, t, fqn="N.x")) == ["pref"]
    assert sorted(ids(M.reaped(m, t))) == ["fresh", "later", "none", "pref"] and sorted(ids(M.reaped(M.reaped(m, t), t))) == ["fresh", "later", "none", "pref"]
    assert sorted(ids(M.without_session(m, "s1"))) == ["fresh", "none", "pref", "todo"]
    assert ids(M.listed(m))[0] == "later" and len(ids(M.listed(m, 2))) == 2
    assert {r["id"]: r["access_count"] for r in M.touched(m, M.recall(m, t, 1), t).collect()}["later"] == 1
    saved, refused = M.save(m.limit(0), m)
    assert sorted(ids(saved)) == ["fresh", "later", "pref", "todo"] and {r["id"]: r["reason"] for r in refused.collect()} == {"none": "scope"}


# ---- stores ----


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4), (None, 5)], "k string, v int")
    once = W.upsert(old, new, ["k"])
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(once) == rows(W.upsert(once, new, ["k"])) and once.count() == 4


def test_edges_of_a_batch(spark):
    e = edges(spark, ("a", "Calls", "b"), ("c", "Calls", "d"))
    out = W.replace_outgoing(e, edges(spark, ("a", "Calls", "x"), ("a", "Calls", "x")))
    assert sorted((r[0], r[1]) for r in out.collect()) == [("a", "x"), ("c", "d")]
    n = nodes(spark, ("a", "class", "x", None), ("x", "class", "x", None))
    assert W.existing_only(out, n).count() == 1 and fqns(W.placeholders(out, n)) == ["c", "d"]


def test_versions(spark, tmp_path):
    t = W.VersionedTable(spark, f"file://{tmp_path}/t")
    assert t.read() is None
    t.write(spark.range(3))
    first = t.read()
    t.write(first.unionByName(spark.range(3, 5)))
    assert t.read().count() == 5 and first.count() == 3


# ---- sources and streams ----


def test_read_tree_and_extract(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a.py").write_text("class A:\n    def run(self):\n        return self.stop()\n    def stop(self): pass\n")
    (tmp_path / "src" / "bad.py").write_text("def (:\n")
    (tmp_path / "node_modules" / "b.ts").write_text("export class B {}\n")
    (tmp_path / "empty.go").write_text("")
    files = S.source_files(S.read_tree(spark, str(tmp_path)))
    assert sorted(r["path"] for r in files.collect()) == ["src/a.py", "src/bad.py"]
    rows = E.extract(files)
    assert fqns(E.symbols_of(rows)) == ["src.a", "src.a.A", "src.a.A.run", "src.a.A.stop"]
    assert ("src.a.A.run", "src.a.A.stop", "Calls") in {(r[1], r[2], r[3]) for r in E.edges_of(rows).collect()}


def test_masked_languages():
    got = E.parse("x/Foo.java", 'package p;\npublic class Foo extends Bar {\n    // if (a) { b(); }\n    public int run(int a) { if (a > 0 && b) { return stop("if ("); } return 0; }\n    int stop(String s) { return 1; }\n}\n')
    by = {s.fqn: s for s in got.symbols}
    assert by["p.Foo.run"].complexity == 3 and by["p.Foo.run"].nesting == 1 and by["p.Foo.run"].access == "public"
    assert ("p.Foo.run", "p.Foo.stop", "Calls") in got.edges and ("p.Foo", "Bar", "Inherits") in got.edges
    assert E.parse("a.txt", "x") is None and E.parse("a.py", "def (") is None


def test_debounce(spark):
    e = spark.createDataFrame([("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 1), (None, 5), ("a", None)], "path string, us long")
    assert sorted((r[0], r[1]) for r in T.leading_debounce(e, "path", "us", 2).collect()) == [("a", 0), ("a", 2), ("b", 1)]
    assert T.leading_debounce(e.limit(0), "path", "us", 2).count() == 0


def test_debounce_stream_with_text_keys(spark, tmp_path):
    spark.createDataFrame([("a", 0), ("a", 1), ("b", 7)], "path string, us long").write.parquet(f"{tmp_path}/in/1")
    s = spark.readStream.schema("path string, us long").parquet(f"{tmp_path}/in/*")
    assert sorted((r[0], r[1]) for r in T.collected(T.leading_debounce_stream(s, "path", "us", 2)).collect()) == [("a", 0), ("b", 7)]


def test_jobs_are_isolated(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/in/1")
    s = spark.readStream.schema("id long").parquet(f"{tmp_path}/in/*")
    bad = T.run_jobs(s, lambda df, n: (_ for _ in ()).throw(ValueError("no")))
    assert bad == [(0, "no")]


def test_embeddings_isolate_batches(spark):
    s = spark.createDataFrame([(f"f{i}", "method", f"s{i}", "key AKIA" + "A" * 16) for i in range(4)], "fqn string, kind string, signature string, documentation string")

    def fails(texts):
        assert not any("AKIAA" in t for t in texts)
        raise OSError("down")

    assert all(r["vector"] is None for r in R.embed_symbols(s, embed=fails).collect()) and len(R.embed_symbols(s, 16).first()["vector"]) == 16


def test_functions_of_null_and_odd_text(spark):
    df = spark.createDataFrame([(None,), ("",), ("(",), ("x" * 10_000,)], "s string")
    for f in (X.method_name, X.containing_type, X.normalize_generics, X.infer_kind, X.sanitize_label, X.normalize_route, X.normalize_path, X.slug, X.redact, X.has_secret, X.language_of, X.module_from_path, X.clean_docstring, X.clean_doc_comment, X.xml_summary):
        assert df.select(f("s")).count() == 4 and len(df.select(f("s")).collect()) == 4


def test_sql_functions_equal_the_columns(spark):
    from tessera.functions.sql import register

    register(spark)
    texts = [
        "A.B.Run(int, List<Map<K, V>>)", "DI:IFoo->Foo", "API:GET:items/{id}", "config:a", "doc:x#y", "doc:x", "N.IThing", "N.Thing", "List<Map<A, B>>.x", "", None, "a/b/../c/./d", "..\\x\\y", "../../a",
        "src/a.ts:Foo.bar", "Hello  World --- X", '"quoted"', "Ünïcode-1 _x", "/a/", "a//", "p(q", "(x",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    for name in ("method_name", "containing_type", "normalize_generics", "infer_kind", "sanitize_label", "normalize_path", "directory_of", "module_of", "member_of", "slug", "unquote", "normalize_route"):
        got = {r["i"]: (r["a"], r["b"]) for r in df.select("i", getattr(X, name)("s").alias("a"), F.expr(f"{name}(s)").alias("b")).collect()}
        assert all(a == b for a, b in got.values()), (name, {texts[i]: v for i, v in got.items() if v[0] != v[1]})
    pairs = spark.createDataFrame([("/api/", "/x"), ("", "x"), (None, "/x/"), ("a", None), ("api/[Controller]/[action]", "Cat$Controller")], "p string, r string")
    for r in pairs.select(X.join_route("p", "r").alias("a"), F.expr("join_route(p, r)").alias("b"), X.expand_route("p", "r", F.lit("Go")).alias("c"), F.expr("expand_route(p, r, 'Go')").alias("d")).collect():
        assert r["a"] == r["b"] and r["c"] == r["d"]
    one = spark.sql("SELECT cosine_similarity(array(1D, 0D), array(1D, 1D)) AS a, cosine_similarity(array(0D), array(1D)) AS b, cosine_similarity(array(1D), array(1D, 2D)) AS c").first()
    assert abs(one["a"] - 0.5**0.5) < 1e-12 and one["b"] is None and one["c"] is None


def test_calls_follow_imports(spark):
    """The file's own name, then an imported one (under its local name), then one that exists once, else as written."""
    files = [
        ("a.ts", "import { run as launch, stop } from './lib/b';\nexport function own() { launch(); stop(); own(); rare(); twice(); }\n"),
        ("lib/b.ts", "export function run() { return 1; }\nexport function stop() { return 2; }\nexport function twice() { return 3; }\n"),
        ("c.ts", "export function run() { return 4; }\nexport function stop() { return 5; }\nexport function rare() { return 6; }\nexport function twice() { return 7; }\n"),
    ]
    rows = E.extract(spark.createDataFrame(files, "path string, content string"))
    s, e = E.symbols_of(rows), E.edges_of(rows)
    out = E.resolve_calls(E.resolve_imports(e, s.select(F.col("path").alias("module"))), s).where("type = 'Calls'")
    assert {r["to_fqn"] for r in out.collect() if r["from_fqn"] == "a.ts:own"} == {"lib/b.ts:run", "lib/b.ts:stop", "a.ts:own", "c.ts:rare", "twice"}


def test_embedder_retries_and_halves():
    from tessera.sources.services import embedder

    calls, waits = [], []

    def post(url, body, headers):
        calls.append(len(body["input"]))
        if len(calls) == 1:
            raise OSError("away")
        if "bad" in body["input"]:
            raise ValueError("refused")
        return {"embeddings": [[float(len(t))] for t in body["input"]]}

    got = embedder("local", "http://x", "m", batch=4, tries=2, post=post, sleep=waits.append)(["a", "bb", "bad", "dddd", "e"])
    assert got == [[1.0], [2.0], None, [4.0], [1.0]] and waits[0] == 0.5 and calls[:2] == [4, 4]
    hosted = embedder("hosted", "u", "m", post=lambda u, b, h: {"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]})
    assert hosted(["a", "b"]) == [[1.0], [2.0]]
    assert embedder("vertex", "u", "m", post=lambda u, b, h: {"predictions": [{"embeddings": {"values": [3.0]}}]})(["a"]) == [[3.0]]


def test_stems():
    from tessera.functions.stem import stem

    # words and stems that the algorithm's description gives
    pairs = "caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit operator oper feudalism feudal decisiveness decis hopefulness hope formaliti formal sensibiliti sensibl triplicate triplic formative form formalize formal electrical electr goodness good revival reviv allowance allow inference infer airliner airlin adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll".split()
    assert [(w, stem(w)) for w in pairs[::2]] == list(zip(pairs[::2], pairs[1::2], strict=True))


def test_ranks_by_number_and_nearness():
    from tessera.operators import textindex as I

    assert round(I.term_score([0.1]), 7) == 0.0607927 and round(I.near_score([[1], [2]], [[0.1], [0.1]]), 7) == 0.0991032
    assert I.term_score([0.1, 1.0]) > I.term_score([1.0]) > I.term_score([0.1, 0.1])
    assert I.near_score([[1], [2]], [[1], [1]]) > I.near_score([[1], [9]], [[1], [1]]) > I.near_score([[1], [300]], [[1], [1]])


def test_stemmed_search(spark):
    from tessera.operators import textindex as I

    rows = [
        ("a.LoadPages", "LoadPages", "LoadPages()", "Loads the newest pages."), ("b.Page", "Page", None, "Throws pages away while loading."), ("c.Other", "Other", "Other(int)", None), ("d.Loader", "Loader", "Loader()", "x " * 200 + "page"),
        ("e.Empty", None, None, None), (None, "LoadPage", None, None),
    ]
    s = spark.createDataFrame(rows, "fqn string, name string, signature string, documentation string").withColumn("term", F.lit("clash"))
    index = I.build(s)
    find = lambda q: [(r["fqn"], r["tier"]) for r in L.tiered_search(s, q, index=index).orderBy("place").collect()]
    assert find("loading page") == [("a.LoadPages", 1), ("b.Page", 1), ("d.Loader", 1)] or find("loading page")[:2] == [("a.LoadPages", 1), ("b.Page", 1)]
    assert [f for f, _ in find("newest zzz")] == ["a.LoadPages"] and find("newest zzz")[0][1] == 2
    assert find("Othe") == [("c.Other", 3)] and find("  ") == []


def test_approximate_neighbours_reach_their_recall(spark):
    import numpy as np

    r = np.random.default_rng(4)
    x = (r.normal(size=(60, 64))[r.integers(0, 60, 3000)] + 0.5 * r.normal(size=(3000, 64))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9001, None), (9002, [1.0]), (9003, [0.0] * 64), (9004, [float("nan")] * 64)]
    index = R.signature_index(spark.createDataFrame(rows, "key long, v array<float>"), "key", "v", 64).cache()
    assert index.count() == 3000
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    shares = []
    for q in r.integers(0, 3000, 8):
        true = set(np.argsort(-(u @ u[q]))[:10].tolist())
        shares.append(len(true & {t["key"] for t in R.ann_top(index, "key", "v", x[q].tolist()).collect()}) / 10)
    assert np.mean(shares) >= 0.9


def test_archives_have_limits(spark):
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("big.py", "x" * 5000)
    df = spark.createDataFrame([("a", out.getvalue()), ("b", out.getvalue()[:40]), ("c", b"")], "name string, data binary").withColumn("path", F.lit("clash"))
    got = {r["archive"]: r["error"] for r in S.unzipped(df, "name", "data", 4000).collect()}
    assert set(got) == {"a", "b", "c"} and got["a"] == "the archive is too large" and all(got.values())
    assert S.unzipped(df.where("name = 'a'"), "name", "data").first()["length"] == 5000
    assert S.unzipped(df.limit(0), "name", "data").count() == 0


def test_memory_tools(spark):
    now = F.lit("2025-01-10 00:00:00").cast("timestamp_ntz")
    rows = [("a", "one", "global", None, "note", 0.9, ["x"], None, dt.datetime(2025, 1, 9), dt.datetime(2025, 1, 9), 1), ("b", "two", "session", "s", "note", 0.5, [], None, dt.datetime(2025, 1, 9), dt.datetime(2025, 1, 9), 0)]
    m = spark.createDataFrame(rows, "id string, content string, scope string, scope_id string, topic string, importance float, related_fqns array<string>, embedding array<float>, created_at timestamp_ntz, last_accessed_at timestamp_ntz, access_count int")
    after, found = M.tool(m, "recall", now, limit=1)
    assert [r["id"] for r in found.collect()] == ["a"] and {r["id"]: r["access_count"] for r in after.collect()} == {"a": 2, "b": 0}
    after, gone = M.tool(m, "forget", now, id="b")
    assert gone.first()[0] == 1 and after.count() == 1
    assert M.tool(m, "clear", now, session="t")[1].first()[0] == 0
    assert M.tool(m, "list", now, topic="note")[1].count() == 2
    with pytest.raises(ValueError):
        M.tool(m, "odd", now)


def test_progress_is_followed(spark, tmp_path):
    from tessera.streaming import progress as P

    told = P.Progress(spark, str(tmp_path), "r")
    told.tell("scan", 0, 2)
    told.tell("done", 2, 2, "ok")
    assert [(r["seq"], r["phase"]) for r in P.events(spark, str(tmp_path)).orderBy("seq").collect()] == [(0, "scan"), (1, "done")]
    with pytest.raises(RuntimeError):
        P.Progress(spark, str(tmp_path), "r").tell("again")


def test_broadcasts_are_bounded_by_bytes(spark):
    from tessera.session import is_small

    df = spark.range(100).withColumn("t", F.repeat(F.lit("x"), 1000))
    assert is_small(df) and not is_small(df, max_rows=99) and not is_small(df, max_bytes=50_000) and is_small(df.limit(0))


def test_hybrid_uses_what_is_there(spark):
    rows = [("a.LoadPage", "LoadPage", None, None), ("b.Other", "Other", None, "Loads a page.")]
    s = spark.createDataFrame(rows, "fqn string, name string, signature string, documentation string")
    v = spark.createDataFrame([("b.Other", [1.0, 0.0]), ("a.LoadPage", [0.0, 1.0]), ("c.Bad", None)], "fqn string, embedding array<float>")
    names = lambda **k: [(r["fqn"], r["source"]) for r in L.hybrid(s, v, "where is LoadPage used", **k).orderBy("place").collect()]
    assert names(embed=lambda q: None) == [("a.LoadPage", "bm25")]
    assert names(embed=lambda q: [1.0, 0.1]) == [("a.LoadPage", "vector"), ("b.Other", "vector")]
    asked = []
    L.hybrid(s, v, "q", lambda q: asked.append(q), hypothetical=lambda q: "a document")
    L.hybrid(s, v, "q", lambda q: asked.append(q), hypothetical=lambda q: 1 / 0)
    assert asked == ["a document", "q"]
    assert ("b.Other", "expanded") in names(embed=lambda q: None, variants=lambda q: [q, "other thing"])
