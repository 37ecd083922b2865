"""The general training-data operators on small cases with known answers."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import hierarchy as H
from tessera.operators import incremental as I
from tessera.operators import keycounts as K
from tessera.operators import orphans as O
from tessera.operators.hotjoin import hot_join
from tessera.operators.rank import grouped_rank, numbered

T0 = dt.datetime(2025, 1, 10)
DAY = dt.timedelta(days=1)


# ---- results per key ----


def test_dense_key_results_counts_every_row(spark):
    rows = [("a", 1), ("a", None), (None, 5), ("", 2), ("b", 3)] * 50 + [("hot", i) for i in range(3000)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v long").repartition(7)
    got = {r["key_value"]: (r["n_rows"], r["s"], r["lo"], r["hi"]) for r in K.dense_key_results(df, "k", {"s": F.col("v")}, {"lo": F.col("v")}, {"hi": F.col("v")}).collect()}
    assert got == {"a": (100, 50, 1, 1), None: (50, 250, 5, 5), "": (50, 100, 2, 2), "b": (50, 150, 3, 3), "hot": (3000, sum(range(3000)), 0, 2999)}


def test_dense_key_results_of_nulls_and_nothing(spark):
    df = spark.createDataFrame([("a", None)], "k string, v long")
    r = K.dense_key_results(df, "k", {"s": F.col("v")}, {"lo": F.col("v")}).first()
    assert (r["n_rows"], r["s"], r["lo"]) == (1, 0, None)
    assert K.dense_key_results(df.limit(0), "k").count() == 0
    assert K.heavy_keys(df.limit(0), "k", 100).count() == 0


def test_dense_key_results_over_many_keys(spark):
    df = spark.range(5000).select((F.col("id") % 1250).cast("string").alias("k"), F.lit("clash").alias("n_rows"))
    got = {r[0]: r[1] for r in K.dense_key_results(df, "k").collect()}
    assert len(got) == 1250 and set(got.values()) == {4}


def test_heavy_keys_count_rows_without_key_in_the_total(spark):
    df = spark.createDataFrame([("a",)] * 10 + [("b",)] * 9 + [(None,)] * 961 + [("  ",)] * 20, "k string")
    assert {r["key_value"] for r in K.heavy_keys(df, "k", 100).collect()} == {"a"}


# ---- joins and ranks under skew ----


def test_hot_join_equals_plain_join(spark):
    left = spark.createDataFrame([("h", i) for i in range(100)] + [("c", 1), ("x", 2), (None, 3)], "k string, v int")
    right = spark.createDataFrame([("h", "H"), ("c", "C")], "k string, w string")
    hot = spark.createDataFrame([("h",)], "k string")
    for how in ("inner", "left"):
        assert sorted(map(str, hot_join(left, right, ["k"], "k", hot, how).collect())) == sorted(map(str, left.join(right, "k", how).collect()))


def test_grouped_rank_equals_rank(spark):
    r = random.Random(3)
    rows = [(g, r.choice([0.0, 1.5, r.random() * 100, float("inf")])) for g in ["a"] * 500 + ["b"] * 3 + ["c"]]
    df = spark.createDataFrame(rows, "g string, s double")
    want = sorted((g, s, 1 + sum(1 for h, t in rows if h == g and t > s)) for g, s in rows)
    for whole in (0, 100_000):
        got = sorted((x["g"], x["s"], x["rank"]) for x in grouped_rank(df, ["g"], "s", buckets=8, whole=whole).collect())
        assert got == want


def test_numbered(spark):
    df = spark.createDataFrame([(f"k{i:03}", i % 7) for i in range(300)], "k string, m int").repartition(5)
    assert [(r["place"], r["k"]) for r in numbered(df, "k").orderBy("place").collect()] == [(i + 1, f"k{i:03}") for i in range(300)]
    assert numbered(df.limit(0), "k").count() == 0


# ---- incremental ----


def _log(spark, *rows):
    return spark.createDataFrame(list(rows), "row_id long, file_path string, repo_id string, content_hash string, indexed_at timestamp_ntz, received_at timestamp_ntz")


def _runs(spark, *rows):
    return spark.createDataFrame(list(rows), "run_id long, repo_id string, started_at timestamp_ntz, finished_at timestamp_ntz, run_status string")


def test_changed_files(spark, tmp_path):
    runs = _runs(spark, (1, "r", T0, None, "succeeded"), (1, "r", T0, None, "succeeded"), (2, "r", T0 + 9 * DAY, None, "failed"), (3, "s", None, None, "succeeded"), (4, "s", T0, None, None))
    before, after = T0 - DAY, T0 + DAY
    log = _log(
        spark,
        (1, "same.py", "r", "AA", before, before), (2, "same.py", "r", " aa ", after, after),  # hashed again, no change
        (3, "changed.py", "r", "AA", before, before), (4, "changed.py", "r", "BB", after, after),
        (5, "new\\file.py", "r", "CC", after, after), (5, "new\\file.py", "r", "CC", after, after),
        (6, "late.py", "r", "DD", before - DAY, after), (7, "late.py", "r", "EE", before, before),  # an old hash that arrives late
        (8, "edge.py", "r", "FF", T0, T0),  # received exactly at the watermark: not covered
        (9, "none.py", "r", None, after, after), (10, "blank.py", "r", "  ", after, after),
        (11, "first.py", "s", "GG", before, before), (12, "other.py", None, "HH", before, before),
        (13, "back.py", "r", "AA", before, before), (14, "back.py", "r", "BB", T0, after), (15, "back.py", "r", "AA", after, after),
    )
    got = sorted((r[0] or "", r[1]) for r in I.next_files(log, runs, f"{tmp_path}/a").collect())
    assert got == [("", "other.py"), ("r", "changed.py"), ("r", "edge.py"), ("r", "new/file.py"), ("s", "first.py")]
    assert I.next_files(log, runs, f"{tmp_path}/a").count() == 0  # that run is committed, nothing came since
    assert I.next_files(log.limit(0), runs, f"{tmp_path}/b").count() == 0
    assert I.next_files(log.withColumn("low", F.lit(1)).withColumn("_done", F.lit(1)), runs.limit(0), f"{tmp_path}/c").count() > 0


def test_runs_take_up_each_change_once(spark, tmp_path):
    """State is kept with the watermark: a run that dies repeats nothing and skips nothing, rows after its upper limit wait, late rows count."""
    rows = [
        (1, "a", "r", "A", T0, T0), (2, "b", "r", "B", T0 + DAY, T0 + DAY), (3, "a", "r", "A2", T0 + DAY, T0 + DAY), (4, "a", "r", "OLD", T0 - DAY, T0 + 2 * DAY), (5, "c", None, "C", T0, T0 + 2 * DAY),
        (6, "b", "r", "b ", T0 + 3 * DAY, T0 + 3 * DAY), (7, "d", "new", "D", T0, T0 + 3 * DAY), (8, "n", "r", "N", T0, None),
    ]
    df = _log(spark, *rows)
    log = I.CommitLog(spark, f"{tmp_path}/log")
    out = lambda c: sorted((r[0] or "", r[1]) for r in log.table("output", c).collect())
    assert out(I.take_up(log, df, T0)) == [("r", "a"), ("r", "n")]
    with pytest.raises(RuntimeError):
        I.take_up(log, df, T0 + DAY, fail_before_commit=True)
    assert out(I.take_up(log, df, T0 + DAY)) == [("r", "a"), ("r", "b")]
    assert out(I.take_up(log, df, T0 + 2 * DAY)) == [("", "c")]
    assert out(I.take_up(log, df)) == [("new", "d")]
    assert out(I.take_up(log, df)) == [] and log.last()["number"] == 4


def test_publish_refuses_to_overwrite(spark, tmp_path):
    assert I.publish(spark, "one", str(tmp_path), "x") and not I.publish(spark, "two", str(tmp_path), "x")
    assert (tmp_path / "x").read_text() == "one" and [p.name for p in tmp_path.iterdir() if "x" in p.name and not p.name.endswith(".crc")] == ["x"]


def test_commit_log_neither_skips_nor_repeats(spark, tmp_path):
    log = I.CommitLog(spark, f"file://{tmp_path}/log")
    src = lambda n: spark.range(n).select(F.col("id").alias("seq"))
    assert log.output() is None
    log.run(src(10), "seq", lambda df: df)
    with pytest.raises(RuntimeError):
        log.run(src(20), "seq", lambda df: df, fail_before_commit=True)
    with pytest.raises(Exception):  # noqa: B017
        log.run(src(20), "seq", lambda df: df.select(F.raise_error(F.lit("bad"))))
    assert log.output().count() == 10
    assert log.run(src(25), "seq", lambda df: df)["low"] == 9
    assert log.run(src(25), "seq", lambda df: df) is None
    assert sorted(r[0] for r in log.output().collect()) == list(range(25))


# ---- hierarchies ----


def _edges(spark, *rows):
    return spark.createDataFrame(list(rows), "from_fqn string, to_fqn string, type string, root string")


def _brute(links: dict[str, str | None]) -> dict[str, tuple[str, int]]:
    out = {}
    for n in links:
        at, d = n, 0
        while links.get(at) is not None and d <= len(links):
            at, d = links[at], d + 1
        out[n] = (at, d) if d <= len(links) else ("", -1)
    return out


def test_forest_small(spark):
    e = _edges(
        spark,
        ("b", "a", "Inherits", "x"), ("b", "a", "Inherits", "x"), ("b", "c", "Declares", "x"), ("s", "s", "Inherits", "x"),
        ("p", "q", "Inherits", "x"), ("q", "p", "Inherits", "x"), ("t", "p", "Inherits", "x"), (None, "lone", "Inherits", "x"), ("  ", "lone2", "Declares", "x"), ("n", "m", "Calls", "x"),
    )
    out = H.solve_forest(H.parent_links(e), with_path=True)
    got = {r["fqn"]: (r["root_fqn"], r["node_depth"], r["path"]) for r in out.collect()}
    assert got == {
        "a": ("a", 0, ["a"]), "b": ("a", 1, ["a", "b"]), "c": ("a", 2, ["a", "b", "c"]), "lone": ("lone", 0, ["lone"]), "lone2": ("lone2", 0, ["lone2"]),
        "s": ("", -1, None), "p": ("", -1, None), "q": ("", -1, None), "t": ("", -1, None),
    }
    pairs = {(r["fqn"], r["descendant_fqn"], r["distance"]) for r in H.descendants(out).collect()}
    assert pairs == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}
    assert H.solve_forest(H.parent_links(e.limit(0))).count() == 0


def test_second_parents_are_told(spark):
    e = _edges(spark, ("b", "a", "Inherits", "x"), ("b", "a", "Inherits", "x"), ("z", "b", "Declares", "x"), ("c", "a", "Inherits", "x"), (None, "c", "Declares", "x"))
    assert {tuple(r) for r in H.parent_conflicts(e).collect()} == {("b", "a", True), ("b", "z", False)}
    assert H.parent_conflicts(e.limit(0)).count() == 0


@pytest.mark.parametrize("shape", ["random", "chain", "star"])
def test_forest_recursion(spark, shape):
    r = random.Random(5)
    n = 300
    links: dict[str, str | None] = {"n0": None}
    for i in range(1, n):
        links[f"n{i}"] = {"random": f"n{r.randrange(i)}", "chain": f"n{i - 1}", "star": "n0"}[shape]
    if shape == "random":
        links |= {"c0": "c1", "c1": "c2", "c2": "c0", "d": "c1", "other": None, "o1": "other"}
    df = spark.createDataFrame(list(links.items()), "node string, parent string")
    out = H.solve_forest(df, with_path=True, capacity=100, parts=5).collect()
    assert {x["fqn"]: (x["root_fqn"], x["node_depth"]) for x in out} == _brute(links)
    assert len(out) == len(links)
    for x in out:
        if x["path"] is not None:
            assert len(x["path"]) == x["node_depth"] + 1 and x["path"][0] == x["root_fqn"] and x["path"][-1] == x["fqn"]
            assert all(links[c] == p for p, c in zip(x["path"], x["path"][1:], strict=False))


# ---- orphans ----


def test_bitmaps():
    r = np.random.default_rng(2)
    a, b = r.integers(0, 300_000, 20_000), np.concatenate([r.integers(0, 300_000, 50), np.arange(70_000, 140_000)])
    one, two = O.Bitmap.of(a), O.Bitmap.of(b)
    assert one.andnot(two).decode().tolist() == sorted(set(a) - set(b))
    assert (one & two).decode().tolist() == sorted(set(a) & set(b))
    assert (two & one).decode().tolist() == sorted(set(a) & set(b))
    assert two.andnot(one).decode().tolist() == sorted(set(b) - set(a))
    assert O.Bitmap.of(np.zeros(0, int)).decode().tolist() == []


def test_orphans(spark):
    sym = spark.createDataFrame(
        [(1, "live", T0, None), (2, "gone", T0, None), (3, "gone", T0 + DAY, T0 + DAY), (4, "back", T0, T0), (5, "back", T0 + DAY, None), (6, "young", T0 + 3 * DAY, None), (7, "young", T0 + 40 * DAY, None), (8, None, T0, None)],
        "id long, fqn string, indexed_at timestamp_ntz, deleted_at timestamp_ntz",
    )
    e = spark.createDataFrame(
        [
            (1, "live", "gone", T0 + DAY), (2, "nowhere", "live", T0 + DAY), (3, None, "  ", T0), (4, "env:X", "http:y", T0), (5, "event:z", "back", T0 + DAY),
            (6, "young", "young", T0 + 2 * DAY), (7, "young", "live", T0 + 3 * DAY), (8, "young", "live", T0 + 60 * DAY), (9, "nowhere", "young", None), (10, "live", "live", T0 - 400 * DAY), (10, "nowhere", "live", T0 + DAY),
        ],
        "edge_id long, from_fqn string, to_fqn string, indexed_at timestamp_ntz",
    )
    got = sorted((r["edge_id"], r["edge_end"], r["orphan_state"]) for r in O.orphan_references(e.withColumn("period", F.lit("clash")), sym).collect())
    assert got == [(1, "to", "deleted"), (2, "from", "missing"), (6, "from", "late"), (6, "to", "late"), (9, "from", "missing"), (10, "from", "late"), (10, "from", "missing"), (10, "to", "late")]
    rep = {(r["edge_end"], r["orphan_state"], r["month"]): r["n"] for r in O.orphan_report(e, sym).collect()}
    assert rep[("from", "missing", None)] == 1 and rep[("from", "missing", "2025-01")] == 2
    assert O.orphan_references(e.limit(0), sym).count() == 0
    assert O.orphan_references(e, sym.limit(0)).where("orphan_state <> 'missing'").count() == 0
