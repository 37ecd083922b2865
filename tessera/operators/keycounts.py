"""Results per key when a few keys hold most rows.

Every input split encodes its own keys with an Arrow dictionary, adds its rows
into dense arrays (``numpy.bincount`` for counts, scatter-reduce for the
measures) and sends one array block for each range of key hashes. Blocks of
the same range are summed by the reducers. A key that holds a third of all
rows is one array cell of each split, so no task sees its rows together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import shuffle_partitions

#: Distinct keys that one split gathers before it sends what it has.
FLUSH_KEYS = 500_000
#: Distinct keys that one reducer holds, about; more keys make more reducers.
REDUCER_KEYS = 500_000

_NONE_MIN, _NONE_MAX = np.iinfo(np.int64).max, np.iinfo(np.int64).min


class _Dense:
    """Dense accumulators, one cell a key; new keys take the next cell."""

    def __init__(self, sums: int, lows: int, highs: int):
        self.code: dict[str | None, int] = {}
        self.n = np.zeros(0, np.int64)
        self.sums = [np.zeros(0, np.int64) for _ in range(sums)]
        self.lows = [np.zeros(0, np.int64) for _ in range(lows)]
        self.highs = [np.zeros(0, np.int64) for _ in range(highs)]

    def cells(self, keys: list[str | None]) -> np.ndarray:
        code = self.code
        at = np.fromiter((code.setdefault(k, len(code)) for k in keys), np.int64, len(keys))
        if len(code) > len(self.n):
            room = max(len(code), 2 * len(self.n))
            grow = lambda a, fill: np.concatenate([a, np.full(room - len(a), fill, np.int64)])
            self.n = grow(self.n, 0)
            self.sums = [grow(a, 0) for a in self.sums]
            self.lows = [grow(a, _NONE_MIN) for a in self.lows]
            self.highs = [grow(a, _NONE_MAX) for a in self.highs]
        return at

    def add(self, at: np.ndarray, n: np.ndarray, sums: list, lows: list, highs: list) -> None:
        """``at``: the cell of each incoming value; several may go to one cell."""
        np.add.at(self.n, at, n)
        for mine, x in zip(self.sums, sums, strict=True):
            np.add.at(mine, at, x)
        for mine, x in zip(self.lows, lows, strict=True):
            np.minimum.at(mine, at, x)
        for mine, x in zip(self.highs, highs, strict=True):
            np.maximum.at(mine, at, x)


def _ints(col: pa.Array | pa.ChunkedArray, fill: int) -> np.ndarray:
    return pc.fill_null(pc.cast(col, pa.int64()), fill).to_numpy(zero_copy_only=False)


def dense_key_results(
    df: DataFrame,
    key: str,
    sums: dict[str, Column] | None = None,
    lows: dict[str, Column] | None = None,
    highs: dict[str, Column] | None = None,
) -> DataFrame:
    """One row for each value of the string column ``key``: key_value, n_rows and the measures.

    ``sums``, ``lows`` and ``highs`` map output names to integer columns; nulls
    add nothing, and a minimum or maximum over nulls alone is null. The null
    key has its own row. An empty input gives no rows. Repeated rows count.
    """
    sums, lows, highs = sums or {}, lows or {}, highs or {}
    names = [*sums, *lows, *highs]
    ns, nl, nh = len(sums), len(lows), len(highs)
    distinct = df.agg(F.approx_count_distinct(key)).first()[0]
    tasks = max(shuffle_partitions(df.sparkSession), -(-distinct // REDUCER_KEYS))
    blocks = 4 * tasks
    picked = df.select(
        F.col(key).cast("string").alias("k"),
        *[c.cast("long").alias(f"m{i}") for i, c in enumerate([*sums.values(), *lows.values(), *highs.values()])],
    )
    fills = [0] * ns + [_NONE_MIN] * nl + [_NONE_MAX] * nh
    block_type = T.StructType(
        [T.StructField("block", T.IntegerType()), T.StructField("k", T.ArrayType(T.StringType())), T.StructField("n", T.ArrayType(T.LongType()))]
        + [T.StructField(f"m{i}", T.ArrayType(T.LongType())) for i in range(len(names))]
    )
    arrow_block = pa.schema(
        [("block", pa.int32()), ("k", pa.list_(pa.string())), ("n", pa.list_(pa.int64())), *[(f"m{i}", pa.list_(pa.int64())) for i in range(len(names))]]
    )

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        acc = _Dense(ns, nl, nh)

        def flush() -> Iterator[pa.RecordBatch]:
            keys = list(acc.code)
            if not keys:
                return
            to = np.fromiter((-1 if k is None else zlib.crc32(k.encode()) % blocks for k in keys), np.int32, len(keys))
            order = np.argsort(to, kind="stable")
            edges = np.flatnonzero(np.diff(to[order], prepend=-2))
            offsets = pa.array(np.append(edges, len(order)).astype(np.int32))
            lists = lambda a: pa.ListArray.from_arrays(offsets, a)
            cols = [acc.n, *acc.sums, *acc.lows, *acc.highs]
            yield pa.RecordBatch.from_arrays(
                [pa.array(to[order][edges]), lists(pa.array(keys, pa.string()).take(pa.array(order))), *[lists(pa.array(c[: len(keys)][order])) for c in cols]],
                schema=arrow_block,
            )

        for b in batches:
            enc = b.column(0).dictionary_encode()
            local = pc.fill_null(enc.indices, len(enc.dictionary)).to_numpy(zero_copy_only=False)
            size = len(enc.dictionary) + 1
            cols = [_ints(b.column(1 + i), fills[i]) for i in range(len(names))]
            n = np.bincount(local, minlength=size)
            part = _Dense(ns, nl, nh)
            part.cells(list(range(size)))
            part.add(local, np.ones(len(local), np.int64), cols[:ns], cols[ns : ns + nl], cols[ns + nl :])
            used = np.flatnonzero(n)
            keys = enc.dictionary.to_pylist() + [None]
            at = acc.cells([keys[i] for i in used])
            acc.add(at, n[used], [a[used] for a in part.sums], [a[used] for a in part.lows], [a[used] for a in part.highs])
            if len(acc.code) > FLUSH_KEYS:
                yield from flush()
                acc = _Dense(ns, nl, nh)
        yield from flush()

    out_type = T.StructType([T.StructField("key_value", T.StringType()), T.StructField("n_rows", T.LongType())] + [T.StructField(x, T.LongType()) for x in names])
    arrow_out = pa.schema([("key_value", pa.string()), ("n_rows", pa.int64()), *[(x, pa.int64()) for x in names]])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = _Dense(ns, nl, nh)
        for b in batches:
            flat = [b.column(i).flatten() for i in range(1, b.num_columns)]
            cols = [c.to_numpy(zero_copy_only=False) for c in flat[1:]]
            acc.add(acc.cells(flat[0].to_pylist()), cols[0], cols[1 : 1 + ns], cols[1 + ns : 1 + ns + nl], cols[1 + ns + nl :])
        keys = list(acc.code)
        cut = [pa.array(a[: len(keys)]) for a in (acc.n, *acc.sums)]
        for fill, arrays in ((_NONE_MIN, acc.lows), (_NONE_MAX, acc.highs)):
            cut += [pa.array(a[: len(keys)], mask=a[: len(keys)] == fill) for a in arrays]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *cut], schema=arrow_out)

    blocked = picked.mapInArrow(split, block_type)
    by_block = blocked.repartition("block") if tasks == shuffle_partitions(df.sparkSession) else blocked.repartition(tasks, "block")
    return by_block.mapInArrow(reduce, out_type)


def heavy_keys(df: DataFrame, key: str, one_in: int) -> DataFrame:
    """key_value and n_rows of the keys, not null or blank, that hold at least one in ``one_in`` of all rows.

    All rows count in the total, those without a key too. There are at most
    ``one_in`` such keys; an empty input has none.
    """
    total = df.count()
    per_key = dense_key_results(df, key)
    return per_key.where((F.col("n_rows") * one_in >= total) & (F.trim("key_value") != ""))
