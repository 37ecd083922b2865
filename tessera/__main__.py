"""python -m tessera index DIR STORE | status STORE | search STORE [--vector] [--expand] QUERY | callers STORE FQN [DEPTH] | export STORE OUT"""

from __future__ import annotations

import sys
import time

from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.operators import lexical as L
from tessera.operators import reports as R
from tessera.operators import store as W
from tessera.operators import textindex as X
from tessera.session import build_session, ship
from tessera.sources import extract as E
from tessera.sources import files as S
from tessera.streaming.progress import Progress


def _nodes(symbols):
    return symbols.withColumn("repo_id", F.lit("local")).withColumn("summary", F.lit(None).cast("string"))


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in ("index", "status", "search", "callers", "export"):
        print(__doc__)
        return 2
    spark = ship(build_session())
    spark.sparkContext.setLogLevel("ERROR")
    command, at = args[0], args[2] if args[0] == "index" else args[1]
    tables = {n: W.VersionedTable(spark, f"{at.rstrip('/')}/{n}") for n in ("symbols", "edges", "hashes")}
    if command == "index":
        files = S.source_files(S.read_tree(spark, args[1]))
        known = tables["hashes"].read()
        changed = files if known is None else files.join(known.select("path", "content_hash"), ["path", "content_hash"], "left_anti")
        gone = None if known is None else known.join(files.select("path"), "path", "left_anti")
        told = Progress(spark, f"{at.rstrip('/')}/progress", time.strftime("%Y%m%dT%H%M%S"))
        n = changed.count()
        told.tell("scan", n, n)
        rows = E.extract(changed)
        for name, new in (("symbols", E.symbols_of(rows)), ("edges", E.edges_of(rows))):
            old = tables[name].read()
            if old is not None:
                stale = changed.select("path").unionByName(gone.select("path"))
                new = old.join(stale, "path", "left_anti").unionByName(new)
            tables[name].write(new)
            told.tell(name, n, n)
        tables["hashes"].write(files.select("path", "content_hash"))
        told.tell("done", n, n)
        print(f"{n} files taken up, {tables['symbols'].read().count()} symbols, {tables['edges'].read().count()} edges")
        return 0
    symbols, edges = tables["symbols"].read(), tables["edges"].read()
    if symbols is None:
        print("nothing is indexed there")
        return 1
    nodes = _nodes(symbols).withColumnRenamed("path", "file_path")
    if command == "status":
        nodes.groupBy("kind").count().orderBy("kind").show(100, truncate=False)
    elif command == "search":
        query = " ".join(a for a in args[2:] if not a.startswith("--"))
        if "--vector" in args or "--expand" in args:
            vectors = R.embed_symbols(nodes).withColumnRenamed("vector", "embedding")
            embed = (lambda q: R.hashed_embedding(q, 256).tolist()) if "--vector" in args else (lambda q: None)
            variants = (lambda q: [q, *L.phrasings(q)]) if "--expand" in args else None
            hits = L.hybrid(nodes, vectors, query, embed, variants=variants).join(nodes, "fqn")
        else:
            hits = L.tiered_search(nodes, query, index=X.build(nodes)).join(nodes, "fqn").withColumn("source", F.lit("bm25"))
        print("\n".join(r["entry"] for r in L.compress(hits).orderBy("place").collect()))
    elif command == "callers":
        found = G.callers(edges, nodes, args[2], int(args[3]) if len(args) > 3 else 1)
        found.orderBy("dist", "fqn").show(200, truncate=False)
    else:
        R.markdown_export(R.architecture(nodes, edges)).orderBy("ord").select("line").coalesce(1).write.mode("overwrite").text(args[2])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
