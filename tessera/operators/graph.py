"""Bounded traversals and analyses of a typed edge table.

Edges have from_fqn, to_fqn, type; nodes have fqn, name, kind, signature,
file_path, start_line, accessibility, is_test_method, repo_id. Edges with a
null or blank end take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.session import BROADCAST_BYTES, BROADCAST_ROWS, bounded, is_small, materialize, release
from tessera.tables import blank

#: Levels after which a traversal writes what it has seen, so that the plan stays short.
CUT_EVERY = 4


def typed_edges(edges: DataFrame, *types: str) -> DataFrame:
    """from_fqn, to_fqn, type of the edges with both ends, of the given types if any are given; repeated ones stay."""
    e = edges.where(F.col("type").isin(*types)) if types else edges
    return e.where(~blank("from_fqn") & ~blank("to_fqn")).select("from_fqn", "to_fqn", "type")


def clean_edges(edges: DataFrame, *types: str) -> DataFrame:
    """Distinct from_fqn, to_fqn, type with both ends; of the given types only, if any are given."""
    return typed_edges(edges, *types).distinct()


def steps(edges: DataFrame, branch: int = 0, reverse: bool = False) -> DataFrame:
    """The edges as steps of a walk: branch, _at, fqn."""
    here, there = ("to_fqn", "from_fqn") if reverse else ("from_fqn", "to_fqn")
    return edges.select(F.lit(branch).alias("branch"), F.col(here).alias("_at"), F.col(there).alias("fqn"))


def walks(ways: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """branch, fqn and dist of every node at 1 to ``depth`` steps from the seeds (branch, fqn), the shortest counted.

    ``ways``: see :func:`steps`; walks of different branches never mix but
    advance together. A seed is in the result if a path of positive length leads
    back to it. Each level joins the frontier with the ways, in which repeated
    edges need not be merged, and drops what was seen before; a frontier proved
    small is broadcast, so a level is one scan and no shuffle of the edges.
    """
    frontier = seeds.select("branch", F.col("fqn").alias("_at")).distinct()
    small = is_small(frontier)
    seen: DataFrame | None = None
    for level in range(1, max(1, depth) + 1):
        found = ways.join(F.broadcast(frontier) if small else frontier, ["branch", "_at"]).select("branch", "fqn").distinct()
        if seen is not None:
            found = found.join(seen.select("branch", "fqn"), ["branch", "fqn"], "left_anti")
        found = materialize(found, f"level-{level}")
        new = found.withColumn("dist", F.lit(level))
        seen = new if seen is None else seen.unionByName(new)
        if level == depth:
            break
        n, size = found.agg(F.count(F.lit(1)), F.sum(F.octet_length("fqn"))).first()
        if n == 0:
            break
        small = n <= BROADCAST_ROWS and size <= BROADCAST_BYTES
        if level % CUT_EVERY == 0:
            seen = materialize(seen, f"seen-{level}")
        frontier = found.select("branch", F.col("fqn").alias("_at"))
    return seen


def closure(edges: DataFrame, seeds: DataFrame, depth: int, reverse: bool = False) -> DataFrame:
    """fqn and dist of every node at 1 to ``depth`` steps from the seeds (column fqn), see :func:`walks`."""
    return walks(steps(edges, 0, reverse), seeds.select(F.lit(0).alias("branch"), "fqn"), depth).select("fqn", "dist")


def seeds_of(nodes: DataFrame, where: Column) -> DataFrame:
    return nodes.where(where).select("fqn").distinct()


def endpoints(edges: DataFrame) -> DataFrame:
    """All distinct ends of the edges, as fqn."""
    return edges.select("from_fqn").union(edges.select("to_fqn")).toDF("fqn").distinct()


def first_by(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """For each key the first row in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") == 1).drop("_k")


def describe(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Name, kind, signature, file and line of results by fqn.

    The kind is the stored one of the fqn, else of the fqn with folded type
    arguments, else what the spelling suggests.
    """
    info = nodes.select("fqn", "name", F.lower("kind").alias("kind"), "signature", "file_path", "start_line")
    folded = nodes.select(X.normalize_generics("fqn").alias("_folded"), F.lower("kind").alias("_kind2")).groupBy("_folded").agg(F.min("_kind2").alias("_kind2"))
    out = found.join(info, "fqn", "left").withColumn("_folded", X.normalize_generics("fqn")).join(folded, "_folded", "left")
    return out.withColumn("kind", F.coalesce("kind", "_kind2", X.infer_kind("fqn"))).withColumn("name", F.coalesce("name", X.method_name("fqn"))).drop("_folded", "_kind2")


def _ends_matching(edges: DataFrame, column: str, match: Column) -> DataFrame:
    return edges.where(match).select(F.col(column).alias("fqn")).distinct()


def callers(edges: DataFrame, nodes: DataFrame, fqn: str, depth: int = 1) -> DataFrame:
    """G1: fqn, branch (0 direct, 1 through an interface), dist of the callers of a method within 1 to 5 steps."""
    depth = max(1, min(5, depth))
    calls = typed_edges(edges, "Calls")
    direct = closure(calls, _ends_matching(calls, "to_fqn", X.matches_member("to_fqn", fqn)), depth, reverse=True)
    via = interface_callers(edges, nodes, fqn)
    both = direct.withColumn("branch", F.lit(0)).unionByName(via.select("fqn", F.lit(1).alias("dist"), F.lit(1).alias("branch")))
    return first_by(both, "fqn", F.col("branch"), F.col("dist"))


def interface_callers(edges: DataFrame, nodes: DataFrame, fqn: str) -> DataFrame:
    """Who calls a method of that name on an interface that the method's type implements, from outside the interface."""
    name, owner = _split_member(fqn)
    if not name or not owner:
        return edges.select(F.col("from_fqn").alias("fqn")).limit(0)
    ifaces = typed_edges(edges, "Implements").where(F.col("from_fqn").contains(owner)).select(F.col("to_fqn").alias("iface")).distinct()
    calls = typed_edges(edges, "Calls").where(X.method_name("to_fqn") == name)
    # a name contains an interface's: no key to join on, so all interfaces are asked, in blocks of a proven size
    ifaces = materialize(ifaces, "interfaces")
    blocks = max(1, -(-ifaces.count() // BROADCAST_ROWS))
    inside = F.col("to_fqn").contains(F.col("iface")) & ~F.col("from_fqn").contains(F.col("iface"))
    parts = [ifaces if blocks == 1 else ifaces.where(F.pmod(F.xxhash64("iface"), F.lit(blocks)) == i) for i in range(blocks)]
    hits = [calls.join(F.broadcast(p), inside).select(F.col("from_fqn").alias("fqn")) for p in parts]
    return reduce(DataFrame.unionByName, hits).distinct()


def _split_member(fqn: str) -> tuple[str, str]:
    base = fqn.split("(")[0] if fqn.find("(") > 0 else fqn
    owner, _, name = base.rpartition(".")
    return name, owner


def callees(edges: DataFrame, fqn: str, depth: int = 1) -> DataFrame:
    """Fqn, dist of what a method calls within 1 to 5 steps, without framework noise."""
    calls = typed_edges(edges, "Calls")
    out = closure(calls, _ends_matching(calls, "from_fqn", X.matches_member("from_fqn", fqn)), max(1, min(5, depth)))
    return out.where(~X.is_noise("fqn"))


def dependencies(edges: DataFrame, fqn: str, depth: int = 1) -> DataFrame:
    """Fqn, branch, dist over DependsOn, then UsesType, then References, never mixed on a path; 1 to 3 steps."""
    e = typed_edges(edges, "DependsOn", "UsesType", "References")
    branch = F.when(F.col("type") == "DependsOn", 0).when(F.col("type") == "UsesType", 1).otherwise(2)
    ways = e.select(branch.alias("branch"), F.col("from_fqn").alias("_at"), F.col("to_fqn").alias("fqn"))
    out = walks(ways, _branches(edges, fqn, 3), max(1, min(3, depth)))
    return first_by(out, "fqn", F.col("branch"), F.col("dist")).where(~X.is_noise("fqn"))


def _branches(edges: DataFrame, fqn: str, n: int) -> DataFrame:
    """One seed for each of ``n`` branches."""
    return edges.sparkSession.range(n).select(F.col("id").cast("int").alias("branch"), F.lit(fqn).alias("fqn"))


def referenced_by(edges: DataFrame, fqn: str, depth: int = 1) -> DataFrame:
    """Fqn, dist of what refers to a symbol."""
    e = typed_edges(edges, "References")
    return closure(e, _ends_matching(e, "to_fqn", F.col("to_fqn") == fqn), depth, reverse=True)


def implementations(edges: DataFrame, fqn: str) -> DataFrame:
    """Fqn of the direct implementations of an interface or its generic forms."""
    e = typed_edges(edges, "Implements")
    return _ends_matching(e, "from_fqn", X.matches_generic("to_fqn", fqn))


def class_hierarchy(edges: DataFrame, fqn: str, depth: int = 10) -> DataFrame:
    """Fqn, branch, dist: ancestors, descendants, interfaces, implementors, then the class itself (dist 0)."""
    e = typed_edges(edges, "Inherits", "Implements")
    up = F.when(F.col("type") == "Inherits", 0).otherwise(2)
    both = F.array(F.struct(up.alias("branch"), F.col("from_fqn").alias("_at"), F.col("to_fqn").alias("fqn")), F.struct((up + 1).alias("branch"), F.col("to_fqn").alias("_at"), F.col("from_fqn").alias("fqn")))
    ways = e.select(F.explode(both).alias("w")).select("w.*")
    own = edges.sparkSession.range(1).select(F.lit(4).alias("branch"), F.lit(fqn).alias("fqn"), F.lit(0).alias("dist"))
    return first_by(walks(ways, _branches(edges, fqn, 4), depth).unionByName(own), "fqn", F.col("branch"), F.col("dist"))


def test_coverage(edges: DataFrame, fqn: str) -> DataFrame:
    """Fqn of the tests that cover a symbol or a member of it."""
    e = typed_edges(edges, "TestCovers")
    return _ends_matching(e, "from_fqn", X.covers_member("to_fqn", fqn))


def methods_of_type(nodes: DataFrame, class_fqn: str, limit: int = 10) -> DataFrame:
    """The methods whose fqn begins with the type, by name then fqn; the limit is part of the operator."""
    own = nodes.where(F.lower("kind").isin("method", "function", "constructor") & F.col("fqn").startswith(class_fqn + "."))
    return own.select("fqn", "name", "kind").orderBy("name", "fqn").limit(limit)


def data_flow(edges: DataFrame, nodes: DataFrame, route: str) -> DataFrame:
    """Fqn, branch (0 handlers, 1 downstream), dist: up to 20 endpoints that contain the route, their handlers, three steps of calls."""
    part = route.strip().lstrip("/").lower()
    eps = nodes.where((F.lower("kind") == "api_endpoint") & F.lower("fqn").contains(part)).select(F.col("fqn").alias("from_fqn")).distinct().orderBy("from_fqn").limit(20)
    handlers = materialize(typed_edges(edges, "HandledBy").join(F.broadcast(eps), "from_fqn").select(F.col("to_fqn").alias("fqn")).distinct(), "handlers")
    down = closure(typed_edges(edges, "Calls"), handlers, 3)
    both = handlers.select("fqn", F.lit(0).alias("dist"), F.lit(0).alias("branch")).unionByName(down.withColumn("branch", F.lit(1)))
    return first_by(both, "fqn", F.col("branch"), F.col("dist")).where(~X.is_noise("fqn"))


def config_usage(edges: DataFrame, key: str | None = None) -> DataFrame:
    """Fqn, part (key or reader): configuration keys that contain ``key`` (all without one), and what reads them."""
    e = clean_edges(edges, "ReadsConfig")
    keys = e.select(F.col("to_fqn").alias("fqn")).where(X.infer_kind("fqn") == "config_key").distinct()
    if not key:
        return keys.withColumn("part", F.lit("key"))
    keys = keys.where(F.col("fqn").contains(key))
    readers = e.join(keys.withColumnRenamed("fqn", "to_fqn"), "to_fqn").select(F.col("from_fqn").alias("fqn")).distinct()
    return keys.withColumn("part", F.lit("key")).unionByName(readers.withColumn("part", F.lit("reader")))


def mapped_entities(edges: DataFrame) -> DataFrame:
    """Fqn, branch: targets of MapsTo, then of Configures."""
    e = typed_edges(edges, "MapsTo", "Configures")
    return e.groupBy(F.col("to_fqn").alias("fqn")).agg(F.min(F.when(F.col("type") == "MapsTo", 0).otherwise(1)).alias("branch"))


def api_endpoints(nodes: DataFrame, module: str | None = None, limit: int = 500) -> DataFrame:
    """Endpoint symbols; with a module only those whose path has it as a controller file or folder, by name, limited."""
    eps = nodes.where(F.lower("kind") == "api_endpoint").select("fqn", "name", "file_path")
    if module is None:
        return eps
    p, m = F.lower(X.slashes("file_path")), module.lower()
    return eps.where(p.contains(f"/{m}controller.cs") | p.contains(f"/{m}/")).orderBy("name", "fqn").limit(limit)


def used_targets(edges: DataFrame) -> DataFrame:
    """Fqn of everything that is called, handles, subscribes or is covered by a test."""
    return typed_edges(edges, "Calls", "HandledBy", "Subscribes", "TestCovers").select(F.col("to_fqn").alias("fqn")).distinct()


def override_methods(edges: DataFrame) -> DataFrame:
    """Fqn of methods that override, or are overridden by, a method of the same name on a base of their type.

    The base of an Inherits edge may be a bare name; it is compared as such and by its last segment.
    """
    last = lambda c: F.substring_index(c, ".", -1)
    has = typed_edges(edges, "HasMethod").select(F.col("from_fqn").alias("owner"), F.col("to_fqn").alias("fqn"), X.method_name("to_fqn").alias("name")).distinct()
    up = typed_edges(edges, "Inherits").select(F.col("from_fqn").alias("owner"), F.col("to_fqn").alias("base")).distinct()
    child = has.join(up, "owner").select(F.col("base").alias("key"), "name", "fqn")
    base = has.select(F.explode(F.array_distinct(F.array("owner", last("owner")))).alias("key"), "name", "fqn")
    # no method is ever paired with another: each side is asked whether the other has its key
    sides = [a.join(b.select("key", "name").distinct(), ["key", "name"], "left_semi").select("fqn") for a, b in ((child, base), (base, child))]
    return sides[0].unionByName(sides[1]).distinct()


def protocol_methods(edges: DataFrame) -> DataFrame:
    """Fqn of methods with the name of a method of a type that inherits from Protocol."""
    has = typed_edges(edges, "HasMethod").select(F.col("from_fqn").alias("owner"), F.col("to_fqn").alias("fqn"), X.method_name("to_fqn").alias("name"))
    protocols = typed_edges(edges, "Inherits").where(F.substring_index("to_fqn", ".", -1) == "Protocol").select(F.col("from_fqn").alias("owner")).distinct()
    names = has.join(protocols, "owner", "left_semi").select("name").distinct()
    return has.join(names, "name", "left_semi").select("fqn").distinct()


def dead_code_candidates(nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """G14, first part: public or unmarked methods and functions outside tests, by name; limited where a limit is given."""
    path = F.lower(F.coalesce(X.slashes("file_path"), F.lit("")))
    in_tests = F.lit(False)
    for part in ("test_", "/tests/", ".test.", ".spec.", "/migrations/versions/"):
        in_tests = in_tests | path.contains(part)
    access = F.lower(F.trim("accessibility"))
    ok = (
        F.lower("kind").isin("method", "function")
        & (access.isNull() | access.isin("public", "internal", "export"))
        & ~F.coalesce("is_test_method", F.lit(False))
        & ~F.col("name").startswith("_")
        & ~in_tests
    )
    out = nodes.where(ok).select("fqn", "name")
    return out if limit is None else out.orderBy("name", "fqn").limit(limit)


def dead_code(nodes: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    """Candidates that nothing uses and that no override or protocol explains; entry points and constructors are alive.

    With ``limit`` it applies to the candidates before the anti joins, as a result page.
    """
    out = dead_code_candidates(nodes, limit).where(~F.col("name").isin("Main", "main", ".ctor", "ctor"))
    for used in (used_targets(edges), override_methods(edges), protocol_methods(edges)):
        out = out.join(used, "fqn", "left_anti")
    return out


#: Edges of which one task finds the cycles; more are first split over the cluster.
CYCLE_EDGES = 500_000


def _strong_components(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """fqn and component (its smallest fqn) of the nodes on a cycle of the edges of one partition, by Tarjan's search."""
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    g = pd.concat(parts)
    out_edges: dict[str, list[str]] = {}
    for a, b in zip(g["from_fqn"], g["to_fqn"], strict=True):
        out_edges.setdefault(a, []).append(b)
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    waiting: list[str] = []
    inside: set[str] = set()
    rows: list[tuple[str, str]] = []
    for root in out_edges:
        if root in index:
            continue
        todo: list[tuple[str, Iterator[str]]] = []
        nxt: str | None = root
        while nxt is not None or todo:
            if nxt is not None:
                index[nxt] = low[nxt] = len(index)
                waiting.append(nxt)
                inside.add(nxt)
                todo.append((nxt, iter(out_edges.get(nxt, ()))))
            at, rest = todo[-1]
            nxt = None
            for b in rest:
                if b not in index:
                    nxt = b
                    break
                if b in inside:
                    low[at] = min(low[at], index[b])
            if nxt is not None:
                continue
            todo.pop()
            if todo:
                low[todo[-1][0]] = min(low[todo[-1][0]], low[at])
            if low[at] == index[at]:
                found = [waiting.pop()]
                while found[-1] != at:
                    found.append(waiting.pop())
                inside.difference_update(found)
                if len(found) > 1 or at in out_edges.get(at, ()):
                    first = min(found)
                    rows.extend((f, first) for f in found)
    yield pd.DataFrame(rows, columns=["fqn", "component"])


def _split_off(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """fqn and component of the nodes on a cycle through the largest node that leads to them, and the edges that other cycles may have.

    Every node takes the largest fqn that reaches it as its colour; what leads
    back to that fqn inside the colour is its strong component.
    """
    ends = endpoints(e)
    kept = colour = materialize(ends.select("fqn", F.col("fqn").alias("colour")), "cycle-colour")
    while True:
        told = e.join(colour, e["from_fqn"] == colour["fqn"]).select(F.col("to_fqn").alias("fqn"), F.col("colour").alias("told")).groupBy("fqn").agg(F.max("told").alias("told"))
        new = colour.join(told, "fqn", "left").select("fqn", F.greatest("colour", "told").alias("colour"), (F.col("told") > F.col("colour")).alias("moved"))
        new = materialize(new, "cycle-colour")
        release(kept)
        kept, colour = new, new.select("fqn", "colour")
        if new.where("moved").limit(1).count() == 0:
            break
    a, b = colour.toDF("from_fqn", "colour"), colour.toDF("to_fqn", "colour2")
    same = materialize(e.join(a, "from_fqn").join(b, "to_fqn").where("colour = colour2").select("from_fqn", "to_fqn", "colour"), "cycle-same")
    seen = front = materialize(colour.where("fqn = colour").select("fqn"), "cycle-back")
    while front.limit(1).count():
        front = same.join(front.toDF("to_fqn"), "to_fqn", "left_semi").select(F.col("from_fqn").alias("fqn")).distinct().join(seen, "fqn", "left_anti")
        front = materialize(front, "cycle-front")
        before, seen = seen, materialize(seen.unionByName(front), "cycle-back")
        release(before)
    kept = same.join(seen.toDF("from_fqn"), "from_fqn", "left_semi").join(seen.toDF("to_fqn"), "to_fqn", "left_semi")
    hit = kept.select(F.col("from_fqn").alias("fqn"), "colour").distinct()
    hit = hit.join(hit.groupBy("colour").agg(F.min("fqn").alias("component")), "colour").select("fqn", "component")
    rest = same.join(seen.toDF("from_fqn"), "from_fqn", "left_anti").join(seen.toDF("to_fqn"), "to_fqn", "left_anti")
    return materialize(hit, "cycle-hit"), materialize(rest.select("from_fqn", "to_fqn"), "cycle-edges")


def cycle_components(edges: DataFrame, kind: str = "DependsOn", capacity: int = CYCLE_EDGES) -> DataFrame:
    """fqn and component (the smallest fqn on a cycle with it) of the nodes that reach themselves over one edge type, however long the way.

    While there are more edges than one task takes, nodes without a way in or
    out are peeled off, and where that takes little away whole components are
    split off; the rest is one depth-first search.
    """
    e = materialize(clean_edges(edges, kind).select("from_fqn", "to_fqn"), "cycle-edges")
    parts: list[DataFrame] = []
    while (n := e.count()) > capacity:
        e = e.join(e.select(F.col("to_fqn").alias("from_fqn")).distinct(), "from_fqn", "left_semi")
        e = materialize(e.join(e.select(F.col("from_fqn").alias("to_fqn")).distinct(), "to_fqn", "left_semi").select("from_fqn", "to_fqn"), "cycle-core")
        if e.count() > 0.9 * n:
            hit, e = _split_off(e)
            parts.append(hit)
    last = e.repartition(1).mapInPandas(_strong_components, "fqn string, component string")
    return materialize(reduce(DataFrame.unionByName, [*parts, last]), "cycle-nodes")


def on_cycle(edges: DataFrame, kind: str = "DependsOn") -> DataFrame:
    """G15, set form: fqn of nodes that reach themselves over one edge type."""
    return cycle_components(edges, kind).select("fqn")


#: Nodes of one group that a path search takes, and paths that it gives; both are part of the operator.
CYCLE_NODES, CYCLE_PATHS = 200, 20


def cycle_paths(nodes: DataFrame, edges: DataFrame, kind: str = "DependsOn") -> DataFrame:
    """G15, path form: repo_id, n, path of the cycles that a depth-first search meets among the first 200 types of each repository."""
    types = nodes.where(F.lower("kind").isin("class", "struct", "record")).select("repo_id", "fqn")
    w = Window.partitionBy("repo_id").orderBy("fqn")
    few = types.withColumn("k", F.row_number().over(w)).where(F.col("k") <= CYCLE_NODES).drop("k")
    return _paths(few, edges, kind, CYCLE_PATHS)


def all_cycle_paths(edges: DataFrame, kind: str = "DependsOn") -> DataFrame:
    """G15, path form without limits: component, n, path of every cycle that a depth-first search of each strong component meets."""
    looped = cycle_components(edges, kind).select("fqn", F.col("component").alias("repo_id"))
    return _paths(looped, edges, kind, None).withColumnRenamed("repo_id", "component")


def _paths(few: DataFrame, edges: DataFrame, kind: str, limit: int | None) -> DataFrame:
    """repo_id, n, path of the first cycles that a depth-first search meets inside each group (repo_id) of nodes; all without a limit."""
    e = clean_edges(edges, kind)
    inside = e.join(few.withColumnRenamed("fqn", "from_fqn"), "from_fqn").join(few.select(F.col("repo_id").alias("r2"), F.col("fqn").alias("to_fqn")), "to_fqn").where("repo_id = r2")

    def search(g: pd.DataFrame) -> pd.DataFrame:
        out_edges: dict[str, list[str]] = {}
        for a, b in sorted(set(zip(g["from_fqn"], g["to_fqn"], strict=True))):
            out_edges.setdefault(a, []).append(b)
        found: list[list[str]] = []
        done: set[str] = set()
        for root in sorted(out_edges):
            if root in done:
                continue
            done.add(root)
            path, place, todo = [root], {root: 0}, [iter(out_edges[root])]
            while todo:
                nxt = next(todo[-1], None)
                if nxt is None:
                    todo.pop()
                    place.pop(path.pop())
                elif nxt in place:
                    found.append([*path[place[nxt] :], nxt])
                elif nxt not in done:
                    done.add(nxt)
                    place[nxt] = len(path)
                    path.append(nxt)
                    todo.append(iter(out_edges.get(nxt, [])))
        rows = [(g["repo_id"].iloc[0], i, p) for i, p in enumerate(found[:limit])]
        return pd.DataFrame(rows, columns=["repo_id", "n", "path"])

    return inside.groupBy("repo_id").applyInPandas(search, "repo_id string, n int, path array<string>")


def overview_nodes(nodes: DataFrame, kinds: list[str] | None = None, limit: int = 500) -> DataFrame:
    """Fqn, kind, name of the first nodes by kind and name, with the count of all that match."""
    n = nodes.where(F.lower("kind").isin(*kinds)) if kinds else nodes
    page = n.select("fqn", F.lower("kind").alias("kind"), "name").orderBy(F.lower("kind"), "name", "fqn").limit(limit)
    total = n.agg(F.count(F.lit(1)).alias("total_matching"))
    return page.join(F.broadcast(total), F.lit(True))


def edges_inside(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Distinct edges with both ends among the chosen nodes (fqn)."""
    side = bounded(chosen.select("fqn"))
    e = clean_edges(edges)
    e = e.join(side, e["from_fqn"] == side["fqn"], "left_semi")
    return e.join(side, e["to_fqn"] == side["fqn"], "left_semi")


def neighbors(edges: DataFrame, fqn: str, depth: int = 1) -> DataFrame:
    """Fqn, dist of nodes within 1 to 3 steps in either direction, without the centre."""
    ends = F.array(F.struct("from_fqn", "to_fqn"), F.struct(F.col("to_fqn").alias("from_fqn"), F.col("from_fqn").alias("to_fqn")))
    both = typed_edges(edges).select(F.explode(ends).alias("e")).select("e.*")
    start = edges.sparkSession.range(1).select(F.lit(fqn).alias("fqn"))
    return closure(both, start, max(1, min(3, depth))).where(F.col("fqn") != fqn)


def impact(edges: DataFrame, nodes: DataFrame, fqn: str, depth: int = 2) -> DataFrame:
    """Section, fqn: callers, implementations, hierarchy and referrers of a symbol."""
    parts = {
        "callers": callers(edges, nodes, fqn, depth),
        "implementations": implementations(edges, fqn),
        "hierarchy": class_hierarchy(edges, fqn).where(F.col("fqn") != fqn),
        "referenced_by": referenced_by(edges, fqn, depth),
    }
    return reduce(DataFrame.unionByName, [p.select(F.lit(k).alias("section"), "fqn") for k, p in parts.items()])


def degrees(edges: DataFrame) -> DataFrame:
    """Fqn, degree (self loops left out), size = round(20 + degree / highest degree * 40)."""
    e = clean_edges(edges).where("from_fqn <> to_fqn")
    both = e.select(F.col("from_fqn").alias("fqn")).union(e.select("to_fqn"))
    d = both.groupBy("fqn").agg(F.count(F.lit(1)).alias("degree"))
    top = d.agg(F.greatest(F.max("degree"), F.lit(1)).alias("_top"))
    return d.join(F.broadcast(top), F.lit(True)).select("fqn", "degree", F.round(20 + F.col("degree") / F.col("_top") * 40).cast("long").alias("size"))


def pipeline(nodes: DataFrame, kind: str = "method", limit: int = 100) -> DataFrame:
    """The first symbols of a kind by name, numbered in each file by line, with their successor."""
    page = nodes.where(F.lower("kind") == kind).select("fqn", "name", "file_path", "start_line").orderBy("name", "fqn").limit(limit)
    w = Window.partitionBy("file_path").orderBy("start_line", "fqn")
    return page.select("fqn", "file_path", F.row_number().over(w).alias("place"), F.lead("fqn").over(w).alias("next_fqn"))


def did_you_mean(nodes: DataFrame, fqn: str) -> DataFrame:
    """Methods of the fqn taken as a type, else of its parent; nothing for an fqn with parameters."""
    none = nodes.select("fqn", "name", "kind").limit(0)
    if "(" in fqn:
        return none
    own = methods_of_type(nodes, fqn)
    parent = fqn.rpartition(".")[0]
    if not parent or own.limit(1).count():
        return own
    return methods_of_type(nodes, parent)
