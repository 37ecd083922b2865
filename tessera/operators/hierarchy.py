"""Parent links to trees: contract chains inside partitions, solve the smaller forest of exits, expand."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.hotjoin import hot_join, hot_keys
from tessera.session import materialize, shuffle_partitions
from tessera.tables import blank

#: Nodes that one task contracts; a quotient of no more than this is solved by one task.
FRAGMENT_NODES = 500_000

_LINKS = "node string, parent string, steps long, trail array<string>"
_PARTS = "node string, exit string, steps long, looped boolean, trail array<string>"


def parent_rows(edges: DataFrame) -> DataFrame:
    """node and parent (null where the row tells none) of every end of an Inherits or Declares row; rows repeat.

    Inherits leads from child to parent, Declares from parent to child. Null and
    blank ends are no nodes, though the other end of their row is one.
    """
    up = edges.where(F.col("type").isin("Inherits", "Declares"))
    child = F.when(F.col("type") == "Inherits", F.col("from_fqn")).otherwise(F.col("to_fqn"))
    parent = F.when(F.col("type") == "Inherits", F.col("to_fqn")).otherwise(F.col("from_fqn"))
    pair = up.select(F.when(~blank(child), child).alias("c"), F.when(~blank(parent), parent).alias("p"))
    both = F.array(F.struct(F.col("c").alias("node"), F.col("p").alias("parent")), F.struct(F.col("p").alias("node"), F.lit(None).cast("string").alias("parent")))
    return pair.select(F.explode(both).alias("x")).select("x.node", "x.parent").where(F.col("node").isNotNull())


def parent_links(edges: DataFrame) -> DataFrame:
    """node and parent (null at a root) for every fqn of :func:`parent_rows`.

    Repeated rows count once; should a child name several parents, the smallest
    counts, and :func:`parent_conflicts` tells of the others.
    """
    return parent_rows(edges).groupBy("node").agg(F.min("parent").alias("parent"))


def parent_conflicts(edges: DataFrame) -> DataFrame:
    """node, parent, kept of the nodes that name several parents: one row for each, kept is true for the one that counts."""
    rows = parent_rows(edges).where(F.col("parent").isNotNull()).distinct()
    many = rows.groupBy("node").agg(F.min("parent").alias("first"), F.max("parent").alias("last")).where("first <> last")
    return rows.join(many.select("node", "first"), "node").select("node", "parent", (F.col("parent") == F.col("first")).alias("kept"))


def _contract(with_trail: bool):
    """Follow links as far as they stay in the partition.

    In: node, parent (null at a root), steps (of the link), trail (nodes that
    the link jumps over, nearest first). Out: node, exit (the first ancestor
    that is elsewhere; the root itself where looped is null), steps to it,
    looped (true: the way up runs in a circle; false: it leaves; null: it ends
    here), trail.
    """

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [p for p in pdfs if len(p)]
        if not parts:
            return
        g = pd.concat(parts, ignore_index=True)
        del parts
        node, parent = g["node"].to_numpy(object), g["parent"].to_numpy(object)
        n = len(node)
        up = pd.Index(node).get_indexer(parent)
        is_root = pd.isna(parent)
        up[is_root] = -1
        top = up < 0
        w = g["steps"].to_numpy(np.int64)
        jump = np.where(top, np.arange(n), up)
        d = np.where(top, 0, w)
        for _ in range(max(1, int(n).bit_length()) + 1):
            d = d + d[jump] * (jump != np.arange(n))
            jump = jump[jump]
            if top[jump].all():
                break
        at_top = top[jump]
        ends = is_root[jump]
        steps = d + np.where(ends, 0, w[jump])
        exits = np.where(ends, node[jump], parent[jump])
        exits[~at_top] = None
        looped = np.where(at_top, np.where(ends, None, False), True)
        steps[~at_top] = -1
        out = pd.DataFrame({"node": node, "exit": exits, "steps": steps, "looped": looped})
        if not with_trail:
            out["trail"] = None
            yield out
            return
        # nodes nearer to their top come first, so that the trail above each is ready
        own = g["trail"].to_numpy(object)
        trail: list = [None] * n
        for i in np.lexsort((np.arange(n), d)):
            if not at_top[i]:
                continue
            mine = list(own[i]) if own[i] is not None else []
            if top[i]:
                trail[i] = mine
            else:
                trail[i] = [*mine, node[up[i]], *trail[up[i]]]
        out["trail"] = trail
        for lo in range(0, n, 20_000):
            yield out.iloc[lo : lo + 20_000]

    return run


def _solve(links: DataFrame, with_trail: bool, capacity: int, parts: int, level: int) -> DataFrame:
    """node, root, depth, trail (nodes from the parent up to the root) of each node; root null in circles."""
    n = links.count()
    done = ["node", F.col("exit").alias("root"), F.col("steps").alias("depth"), "trail"]
    if level and n <= capacity:
        return links.repartition(1).mapInPandas(_contract(with_trail), _PARTS).select(*done)
    parts = max(parts, -(-n // capacity))
    # A node whose coin shows tails goes where its parent is if that one shows heads, unless many share the parent:
    # so each level joins a good part of any long chain, and no partition gathers a hot parent's children.
    hot = materialize(hot_keys(links.groupBy("parent").agg(F.count(F.lit(1)).alias("n")), "parent", "n", n), "hot-parents")
    coin = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(level)), F.lit(2)) == 1
    marked = links.join(F.broadcast(hot.select(F.col("parent").alias("_hot"))), F.col("parent") == F.col("_hot"), "left")
    mate = F.when(~coin("node") & coin("parent") & F.col("_hot").isNull(), F.col("parent")).otherwise(F.col("node"))
    spread = marked.withColumn("_mate", mate).drop("_hot").repartition(parts, "_mate").drop("_mate")
    local = materialize(spread.mapInPandas(_contract(with_trail), _PARTS), f"fragments-{level}")
    leaving = local.where(F.col("looped") == F.lit(False))
    exits = leaving.groupBy("exit").agg(F.count(F.lit(1)).alias("n"))
    # both sides grow with the nodes, so neither is ever broadcast
    quotient = local.join(exits.select(F.col("exit").alias("node")).hint("merge"), "node", "left_semi").select(
        "node", F.when(F.col("looped") == F.lit(False), F.col("exit")).alias("parent"), "steps", "looped", "trail", F.col("exit").alias("end")
    )
    quotient = materialize(quotient, f"quotient-{level}")
    # Roots and circles that are known already keep what they have; in the quotient they are roots.
    as_links = quotient.select("node", "parent", F.when(F.col("parent").isNotNull(), F.col("steps")).otherwise(F.lit(0)).alias("steps"), F.when(F.col("parent").isNotNull(), F.col("trail")).alias("trail"))
    if as_links.limit(1).count() == 0:
        return local.select(*done)
    above = _solve(as_links, with_trail, capacity, max(1, parts // 2), level + 1)
    ends = quotient.where(F.col("parent").isNull()).select(F.col("node").alias("root"), F.col("end").alias("_end"), F.col("steps").alias("_more"), F.col("trail").alias("_rest"))
    # what lies above an exit: the way to its quotient root, then from there to its own root
    hot_roots = materialize(hot_keys(above.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "root", "n", n), "hot-roots")
    solved = hot_join(above.where(F.col("root").isNotNull()), ends, ["root"], "root", hot_roots, grows=True)
    join_trails = lambda a, b: F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>")))
    solved = solved.select(
        F.col("node").alias("exit"),
        F.col("_end").alias("_root"),
        F.when(F.col("_end").isNotNull(), F.col("depth") + F.col("_more")).otherwise(F.lit(-1)).alias("_depth"),
        (F.when(F.col("_end").isNotNull(), join_trails(F.col("trail"), F.col("_rest"))) if with_trail else F.lit(None).cast("array<string>")).alias("_trail"),
    )
    solved = materialize(solved, f"solved-{level}")
    hot_exits = materialize(hot_keys(exits, "exit", "n", n), "hot-exits")
    below = hot_join(leaving, solved, ["exit"], "exit", hot_exits, "left", grows=True)
    trail = F.when(F.col("_root").isNotNull(), join_trails(F.concat(F.col("trail"), F.array("exit")), F.col("_trail"))) if with_trail else F.lit(None).cast("array<string>")
    below = below.select("node", F.col("_root").alias("root"), F.when(F.col("_root").isNotNull(), F.col("steps") + F.col("_depth")).otherwise(F.lit(-1)).alias("depth"), trail.alias("trail"))
    return local.where(F.col("looped").isNull() | F.col("looped")).select(*done).unionByName(below)


def solve_forest(links: DataFrame, with_path: bool = False, capacity: int = FRAGMENT_NODES, parts: int | None = None) -> DataFrame:
    """fqn, root_fqn, node_depth, and path (from the root down to the node) if wanted, of each row of ``links`` (node, parent).

    A root has depth 0 and is its own root. A node from which the way up never
    ends, in a circle or below one, has root_fqn '', node_depth -1 and a null
    path. ``node`` is unique and not null; a parent that is no node is a root
    that has no row. Work: each level hashes the nodes over partitions, follows
    every chain to its exit with vectorised pointer doubling, and hands only
    the exits on; no task holds more than about ``capacity`` nodes.
    """
    base = materialize(links.select("node", "parent", F.lit(1).cast("long").alias("steps"), F.lit(None).cast("array<string>").alias("trail")), "links")
    # a parent without a row of its own stands for a root
    gaps = base.select(F.col("parent").alias("node")).where(F.col("node").isNotNull()).distinct().join(base.select("node").hint("merge"), "node", "left_anti")
    full = base.unionByName(gaps.select("node", F.lit(None).cast("string").alias("parent"), F.lit(1).cast("long").alias("steps"), F.lit(None).cast("array<string>").alias("trail")))
    out = _solve(full, with_path, capacity, parts or shuffle_partitions(links.sparkSession), 0)
    cols: list[Column] = [F.col("node").alias("fqn"), F.coalesce("root", F.lit("")).alias("root_fqn"), F.when(F.col("root").isNull(), F.lit(-1)).otherwise(F.col("depth")).cast("int").alias("node_depth")]
    if with_path:
        cols.append(F.when(F.col("root").isNotNull(), F.reverse(F.concat(F.array("node"), F.coalesce(F.col("trail"), F.array().cast("array<string>"))))).alias("path"))
    return out.select(*cols)


def descendants(forest: DataFrame) -> DataFrame:
    """fqn, descendant_fqn, distance: one row for each node below another, from a forest with paths."""
    x = forest.where(F.col("path").isNotNull()).select(F.col("fqn").alias("descendant_fqn"), "node_depth", F.posexplode("path").alias("at", "fqn"))
    return x.where(F.col("at") < F.col("node_depth")).select("fqn", "descendant_fqn", (F.col("node_depth") - F.col("at")).alias("distance"))


def descendant_counts(forest: DataFrame) -> DataFrame:
    """fqn and n_descendants of the nodes that have any; counted before the shuffle."""
    return descendants(forest).groupBy("fqn").agg(F.count(F.lit(1)).alias("n_descendants"))
