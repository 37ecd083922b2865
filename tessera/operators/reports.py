"""Composed reports: exploring a symbol, onboarding, architecture, export, and offline embeddings."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import graph as G
from tessera.operators import lexical as L


def explore(symbols: DataFrame, edges: DataFrame, query: str, deep: bool = False) -> DataFrame:
    """Section, fqn of what surrounds the best type or method that a query finds: the symbol, its callers and dependencies; deep: more."""
    hits = L.tiered_search(symbols, query, 10).join(symbols.select("fqn", F.lower("kind").alias("kind")), "fqn")
    top = hits.where(F.col("kind").isin("class", "interface", "method", "record", "struct", "function")).orderBy("place").first()
    none = symbols.select(F.lit("").alias("section"), "fqn").limit(0)
    if top is None:
        return none
    f = top["fqn"]
    page = lambda df, name: df.where(~F.col("fqn").startswith("System.") & ~F.col("fqn").startswith("Microsoft.")).select("fqn").orderBy("fqn").limit(10).select(F.lit(name).alias("section"), "fqn")
    parts = [symbols.where(F.col("fqn") == f).select(F.lit("symbol").alias("section"), "fqn"), page(G.callers(edges, symbols, f), "callers"), page(G.dependencies(edges, f), "dependencies")]
    if deep:
        parts += [page(G.callees(edges, f), "callees"), page(G.implementations(edges, f), "implementations"), page(G.referenced_by(edges, f), "referenced_by")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def architecture(symbols: DataFrame, edges: DataFrame, first: int = 15) -> DataFrame:
    """Part, grp, n, sample: endpoints, types and entities by module with the first names and how many there are."""
    module = X.module_from_path("file_path")
    types = symbols.where(F.lower("kind").isin("class", "interface", "struct", "record")).select(F.lit("types").alias("part"), module.alias("grp"), "name", "fqn")
    eps = symbols.where(F.lower("kind") == "api_endpoint").select(F.lit("endpoints").alias("part"), module.alias("grp"), "name", "fqn")
    ents = G.mapped_entities(edges).select(F.lit("entities").alias("part"), F.lit("all").alias("grp"), X.method_name("fqn").alias("name"), "fqn")
    every = types.unionByName(eps).unionByName(ents)
    n = every.groupBy("part", "grp").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("part", "grp").orderBy("name", "fqn")
    shown = every.withColumn("k", F.row_number().over(w)).where(F.col("k") <= first)
    sample = shown.groupBy("part", "grp").agg(F.array_sort(F.collect_list(F.struct("k", "name"))).alias("s"))
    return n.join(sample, ["part", "grp"]).select("part", "grp", "n", F.array_join(F.transform("s", lambda x: x["name"]), ", ").alias("sample"))


def markdown_export(report: DataFrame) -> DataFrame:
    """Ord, line: the architecture report as markdown text, in order; write it with ``df.write.text``."""
    head = report.select("part").distinct().select("part", F.lit("").alias("grp"), F.concat(F.lit("## "), F.initcap("part")).alias("line"))
    more = F.when(F.col("n") > 15, F.concat(F.lit(" ... "), (F.col("n") - 15).cast("string"), F.lit(" more"))).otherwise("")
    body = report.select("part", F.concat(F.lit("_"), "grp").alias("grp"), F.concat(F.lit("- **"), "grp", F.lit("** ("), F.col("n").cast("string"), F.lit("): "), "sample", more).alias("line"))
    w = Window.orderBy("part", "grp")
    return head.unionByName(body).select(F.row_number().over(w).alias("ord"), "line")


def hashed_embedding(text: str, dims: int) -> np.ndarray:
    """A vector of unit length from signed hashes of the words and word pairs of a text; zero for a text without words."""
    import re

    words = re.findall(r"[^\W_]+", text.lower())
    v = np.zeros(dims, np.float32)
    for w in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]:
        h = zlib.crc32(w.encode())
        v[h % dims] += 1.0 if h & 0x80000000 else -1.0
    n = float(np.linalg.norm(v))
    return v / n if n else v


def embed_symbols(symbols: DataFrame, dims: int = 256, embed: Callable[[list[str]], list] | None = None, batch: int = 50) -> DataFrame:
    """Fqn, vector of the embeddable symbols; secrets are redacted first, blank texts have none.

    ``embed`` takes a batch of texts and gives their vectors; the default needs
    no service. A batch that fails leaves its rows with a null vector.
    """
    rows = symbols.where(F.lower("kind").isin(*X.EMBEDDABLE))
    rows = rows.select("fqn", X.redact(X.embedding_text("kind", "fqn", "signature", "documentation")).alias("t")).where(F.trim("t") != "")

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in pdfs:
            vectors: list = []
            for lo in range(0, len(p), batch):
                part = p["t"].iloc[lo : lo + batch].tolist()
                try:
                    vectors += [None if v is None else [float(x) for x in v] for v in (embed(part) if embed else (hashed_embedding(t, dims) for t in part))]
                except Exception:  # isolated: one batch
                    vectors += [None] * len(part)
            yield pd.DataFrame({"fqn": p["fqn"], "vector": vectors})

    return rows.mapInPandas(run, "fqn string, vector array<float>")


def summarized(symbols: DataFrame, summarize: Callable[[str], str | None] | None = None) -> DataFrame:
    """Fqn, summary (at most 200 characters) of methods and functions by a given callable; without one, the first sentence of the documentation."""
    rows = symbols.where(F.lower("kind").isin("method", "function")).select("fqn", "documentation", X.embedding_text("kind", "fqn", "signature", "documentation").alias("t"))
    if summarize is None:
        plain = X.clean_doc_comment("documentation")
        return rows.select("fqn", F.nullif(F.substring(F.regexp_extract(plain, r"(?s)^(.*?[.!?])(?:\s|$)", 1), 1, 200), F.lit("")).alias("summary"))

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in pdfs:
            yield pd.DataFrame({"fqn": p["fqn"], "summary": [(summarize(t) or "")[:200] or None for t in p["t"]]})

    return rows.select("fqn", "t").mapInPandas(run, "fqn string, summary string")


#: Bits of a signature, and candidates of a query whose vectors are compared exactly.
SIGNATURE_BITS, CANDIDATES = 4096, 100


def _planes(dims: int, bits: int) -> np.ndarray:
    return np.random.default_rng(7).normal(size=(dims, bits)).astype(np.float32)


def signature_index(vectors: DataFrame, key: str, vector: str, dims: int, bits: int = SIGNATURE_BITS) -> DataFrame:
    """Key, vector, signature: on which side of random planes each usable vector lies, a bit for each plane; no shuffle.

    Vectors that are null, of another length, zero or not finite stay out.
    """
    planes = _planes(dims, bits)

    def sign(v: pa.Array) -> pa.Array:
        usable = pc.fill_null(pc.equal(pc.list_value_length(v), dims), False).to_numpy(zero_copy_only=False)
        x = v.filter(pa.array(usable)).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dims)
        good = np.isfinite(x).all(1) & (x != 0).any(1)
        codes = np.packbits(np.where(good[:, None], x, 0) @ planes > 0, axis=1)
        out: list[bytes | None] = [None] * len(v)
        for i, ok, c in zip(np.flatnonzero(usable), good, codes, strict=True):
            out[i] = c.tobytes() if ok else None
        return pa.array(out, pa.binary())

    return vectors.select(key, vector, F.arrow_udf(sign, "binary")(vector).alias("signature")).where(F.col("signature").isNotNull())


def ann_top(index: DataFrame, key: str, vector: str, query: list[float], limit: int = 10, width: int = CANDIDATES, bits: int = SIGNATURE_BITS) -> DataFrame:
    """Key, score of the rows near a query vector: the ``width`` nearest by signature are compared exactly.

    Each task keeps its own ``width`` rows; a signature has a sixth of the bytes of a vector of 768 floats.
    """
    code = np.packbits(np.array(query, np.float32) @ _planes(len(query), bits) > 0)

    def apart(s: pa.Array) -> pa.Array:
        x = np.frombuffer(b"".join(s.to_pylist()), np.uint8).reshape(-1, len(code))
        return pa.array(np.bitwise_count(x ^ code).sum(1, dtype=np.int32), pa.int32())

    near = index.withColumn("_d", F.arrow_udf(apart, "int")("signature")).orderBy("_d", key).limit(width)
    return L.vector_top(near, key, vector, query, limit)
