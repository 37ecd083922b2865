"""References to records that do not exist, by compressed bitmaps of dictionary codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.hotjoin import hot_join, hot_keys
from tessera.session import materialize, shuffle_partitions
from tessera.tables import blank, micros

#: Ends with these prefixes name things outside the symbol table.
OUTSIDE = ("env:", "http:", "event:")

#: References and symbols of one key range at most, about; a reducer holds one range at a time.
RANGE_ROWS = 500_000

_CHUNK = 1 << 16
_SPARSE = 4096


class Bitmap:
    """A set of codes in chunks of 65,536: sorted short arrays where sparse, packed bits where dense."""

    def __init__(self, chunks: dict[int, np.ndarray] | None = None):
        self.chunks = chunks or {}

    @staticmethod
    def of(codes: np.ndarray) -> Bitmap:
        codes = np.unique(codes)
        at = codes // _CHUNK
        cuts = np.flatnonzero(np.diff(at, prepend=-1))
        parts = np.split(codes, cuts[1:]) if len(codes) else []
        return Bitmap({int(p[0] // _CHUNK): Bitmap._pack((p % _CHUNK).astype(np.uint16)) for p in parts})

    @staticmethod
    def _pack(low: np.ndarray) -> np.ndarray:
        if len(low) < _SPARSE:
            return low
        bits = np.zeros(_CHUNK, np.bool_)
        bits[low] = True
        return np.packbits(bits)

    @staticmethod
    def _bits(c: np.ndarray | None) -> np.ndarray:
        if c is not None and c.dtype == np.uint8:
            return c
        bits = np.zeros(_CHUNK, np.bool_)
        if c is not None:
            bits[c] = True
        return np.packbits(bits)

    @staticmethod
    def _list(c: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(c)).astype(np.uint16) if c.dtype == np.uint8 else c

    def _with(self, other: Bitmap, keep_common: bool) -> Bitmap:
        out = {}
        for k, a in self.chunks.items():
            b = other.chunks.get(k)
            if b is None:
                if not keep_common:
                    out[k] = a
                continue
            if a.dtype == np.uint8:
                c = self._list(a & (self._bits(b) if keep_common else ~self._bits(b)))
            else:
                inside = np.unpackbits(b)[a].astype(bool) if b.dtype == np.uint8 else np.isin(a, b)
                c = a[inside if keep_common else ~inside]
            if len(c):
                out[k] = self._pack(c)
        return Bitmap(out)

    def __and__(self, other: Bitmap) -> Bitmap:
        return self._with(other, True)

    def andnot(self, other: Bitmap) -> Bitmap:
        return self._with(other, False)

    def decode(self) -> np.ndarray:
        parts = [self._list(c).astype(np.int64) + k * _CHUNK for k, c in sorted(self.chunks.items())]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def reference_ends(edges: DataFrame) -> DataFrame:
    """edge_id, edge_end, key, period (months since 0000), ts (microseconds) of each end that is a reference.

    Null and blank ends and those with a prefix of :data:`OUTSIDE` are none.
    """
    ends = F.explode(
        F.array(
            F.struct(F.lit("from").alias("edge_end"), F.col("from_fqn").alias("key")),
            F.struct(F.lit("to").alias("edge_end"), F.col("to_fqn").alias("key")),
        )
    ).alias("e")
    out = edges.select("edge_id", micros("indexed_at").alias("ts"), (F.year("indexed_at") * 12 + F.month("indexed_at") - 1).alias("period"), ends)
    out = out.select("edge_id", "e.edge_end", "e.key", "period", "ts").where(~blank("key"))
    for p in OUTSIDE:
        out = out.where(~F.col("key").startswith(p))
    return out


def _month_start(period: int) -> int:
    """Microseconds at the start of a month."""
    return int(np.datetime64(f"{period // 12:04d}-{period % 12 + 1:02d}-01", "us").astype(np.int64))


def _survivors(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of the rows of one reducer, sorted by key range, the (key, period, state) that are not sound."""

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        code, keys = pd.factorize(g["key"].to_numpy(object), sort=False)
        is_parent = g["is_parent"].to_numpy()
        parent = code[is_parent]
        first = np.full(len(keys), np.iinfo(np.int64).min)
        earliest = g["earliest"].to_numpy()[is_parent]
        first[parent] = np.where(np.isnan(earliest), np.iinfo(np.int64).min, np.nan_to_num(earliest)).astype(np.int64)
        known = Bitmap.of(parent)
        live = Bitmap.of(parent[g["live"].to_numpy()[is_parent].astype(bool)])
        refs = g[~is_parent]
        ref_code = code[~is_parent]
        outs = []
        for period in refs["period"].unique():
            ref = Bitmap.of(ref_code[(refs["period"] == period).to_numpy()])
            # keys seen before the period began can't be late in it; edges without a time are never late
            since = first < _month_start(int(period)) if period >= 0 else np.ones(len(keys), bool)
            early = Bitmap.of(np.flatnonzero(since))
            for state, bits in (("missing", ref.andnot(known)), ("deleted", (ref & known).andnot(live)), ("late", (ref & live).andnot(early))):
                hit = bits.decode()
                if len(hit):
                    outs.append((keys[hit], np.full(len(hit), period, np.int32), np.full(len(hit), state, object), first[hit]))
        cols = [np.concatenate(c) for c in zip(*outs, strict=True)] if outs else [np.zeros(0, object), np.zeros(0, np.int32), np.zeros(0, object), np.zeros(0, np.int64)]
        return pd.DataFrame(dict(zip(("key", "period", "orphan_state", "first_ts"), cols, strict=True)))

    held: list[pd.DataFrame] = []
    for pdf in pdfs:
        while len(pdf):
            here = pdf["key_range"].iloc[0]
            if held and held[0]["key_range"].iloc[0] != here:
                yield solve(pd.concat(held, ignore_index=True))
                held = []
            n = int(np.searchsorted(pdf["key_range"].to_numpy(), here, side="right"))
            held.append(pdf.iloc[:n])
            pdf = pdf.iloc[n:]
    if held:
        yield solve(pd.concat(held, ignore_index=True))


def orphan_keys(ends: DataFrame, symbols: DataFrame, ranges: int | None = None) -> DataFrame:
    """key, period, orphan_state and first_ts (when a late key first came) of the references that are not sound.

    References are reduced to distinct (key, period), symbols to one row a key;
    both go to the reducer of their key range, which codes the keys as
    integers and computes reference AND NOT parent on bitmaps per period.
    """
    ranges = ranges or max(4 * shuffle_partitions(ends.sparkSession), -(-(ends.count() + symbols.count()) // RANGE_ROWS))
    refs = ends.select("key", F.coalesce("period", F.lit(-1)).alias("period")).distinct()
    nothing = lambda kind: F.lit(None).cast(kind)
    refs = refs.select("key", "period", F.lit(False).alias("is_parent"), F.lit(False).alias("live"), nothing("long").alias("earliest"))
    packed = F.struct("indexed_at", "id", "deleted_at")
    parents = symbols.where(F.col("fqn").isNotNull()).groupBy("fqn").agg(F.max(packed).alias("cur"), F.min("indexed_at").alias("first"))
    parents = parents.select(
        F.col("fqn").alias("key"), F.lit(-1).alias("period"), F.lit(True).alias("is_parent"), F.col("cur.deleted_at").isNull().alias("live"), micros("first").alias("earliest")
    )
    both = refs.unionByName(parents).withColumn("key_range", F.pmod(F.xxhash64("key"), F.lit(ranges)).cast("int"))
    both = both.repartition("key_range").sortWithinPartitions("key_range")
    return both.mapInPandas(_survivors, "key string, period int, orphan_state string, first_ts long")


def orphan_references(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """edge_id, edge_end, orphan_state, period (months since 0000, null without a time) of each faulty end.

    missing: no symbol row has that fqn; deleted: its symbol is not live; late:
    the first of its rows came after the edge. Every row counts, repeated edges
    too. An edge without a time is never late. Ends that many edges share meet
    their verdict by broadcast, see :func:`~tessera.operators.hotjoin.hot_join`.
    """
    ends = reference_ends(edges)
    total = edges.count()
    ranges = max(4 * shuffle_partitions(edges.sparkSession), -(-(2 * total + symbols.count()) // RANGE_ROWS))
    orphans = materialize(orphan_keys(ends, symbols, ranges), "orphans")
    counts = ends.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    hot = materialize(hot_keys(counts, "key", "n", 2 * total), "hot-ends")
    left = ends.withColumn("period", F.coalesce("period", F.lit(-1)))
    out = hot_join(left, orphans, ["key", "period"], "key", hot)
    out = out.where((F.col("orphan_state") != "late") | (F.col("first_ts") > F.col("ts")))
    return out.select("edge_id", "edge_end", "orphan_state", F.when(F.col("period") >= 0, F.col("period")).alias("period"))


def orphan_report(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """edge_end, orphan_state, month (yyyy-MM, null without a time), n: faulty ends counted."""
    month = F.format_string("%04d-%02d", (F.col("period") / 12).cast("int"), F.col("period") % 12 + 1)
    out = orphan_references(edges, symbols).withColumn("month", F.when(F.col("period").isNotNull(), month))
    return out.groupBy("edge_end", "orphan_state", "month").agg(F.count(F.lit(1)).alias("n"))


