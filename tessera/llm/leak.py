"""Evaluation texts inside training text: a stored positional inverted index and offset-adjusted intersection."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import materialize, shuffle_partitions

#: Consecutive words of an item that make a leak.
MIN_WORDS = 12
#: Rare terms of a window that must agree on a shift before the lists of its other terms are read.
AGREE = 3
#: Words of the documents whose postings lie together; a longer document is a range of its own.
RANGE_WORDS = 500_000
#: Words of the items that are looked up in one pass over the index.
CHUNK_WORDS = 200_000

_WORD = re.compile(r"[^\W_]+")
# Format characters (Cf) stand below 0x20000 or among the tags.
_INVISIBLE = {i: None for i in (*range(0x20000), *range(0xE0000, 0xE0080)) if unicodedata.category(chr(i)) == "Cf"}


def words(text: str | None) -> list[str]:
    """The words of a text: longest runs of letters and digits in one case, after format characters (Cf) are dropped. None for null."""
    if not text:
        return []
    if not text.isascii() and not text.replace("\n", " ").isprintable():  # no format character is
        text = text.translate(_INVISIBLE)
    return _WORD.findall(text.lower())


# ---- the index ----


@dataclass
class PostingsIndex:
    """Positional postings of a corpus in a table of lists, one for each term and range of documents.

    Columns of ``lists``: range_id; term (null in the one row of each range that
    holds its documents); n, how many postings; places, their positions in the
    range as increasing 32-bit integers, each given by its distance from the
    one before (in the row of documents: where each document begins, and the
    end); docs, the documents' ids. Positions count words through all documents
    of the range. A term that is in every document has a list of bounded size in
    each range, so no list is hot.
    """

    lists: DataFrame

    @staticmethod
    def build(docs: DataFrame, doc: str, text: str, range_words: int = RANGE_WORDS) -> PostingsIndex:
        """The index of whole texts, written once to the shared folder; rows without an id are no documents. No shuffle."""
        return PostingsIndex(materialize(_postings(docs, doc, text, range_words), "postings"))

    def write(self, path: str) -> None:
        """Keep the index for later sets of items, laid out by ranges of terms, so that a search for few terms reads few row groups."""
        by_term = self.lists.repartitionByRange("term", "range_id").sortWithinPartitions("term", "range_id")
        by_term.write.mode("overwrite").option("compression", "zstd").parquet(path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> PostingsIndex:
        return PostingsIndex(spark.read.parquet(path))


def _postings(docs: DataFrame, doc: str, text: str, range_words: int) -> DataFrame:
    kind = docs.schema[doc].dataType
    schema = T.StructType(
        [T.StructField("range_id", T.LongType()), T.StructField("term", T.StringType()), T.StructField("n", T.LongType()), T.StructField("places", T.BinaryType()), T.StructField("docs", T.ArrayType(kind))]
    )

    def lists(number: int, codes: list[int], terms: list[str], starts: list[int], ids: pa.Array) -> pa.RecordBatch:
        """One range: ``codes`` are the terms of its words in the order of the text."""
        code = np.array(codes, np.int32)
        order = np.argsort(code, kind="stable").astype(np.int32)
        n = np.bincount(code, minlength=len(terms))
        ends = np.cumsum(n)
        step = np.diff(order, prepend=0).astype("<i4")
        first = (ends - n)[n > 0]
        step[first] = order[first]
        data = step.tobytes()
        places = [data[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
        where = np.diff(np.array([*starts, len(codes)], np.int64), prepend=0).astype("<i4").tobytes()
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number] * (len(terms) + 1), pa.int64()),
                pa.array([None, *terms], pa.string()),
                pa.array(np.append(len(ids), n), pa.int64()),
                pa.array([where, *places], pa.binary()),
                pa.array([ids.to_pylist(), *[None] * len(terms)], pa.list_(ids.type)),
            ],
            names=["range_id", "term", "n", "places", "docs"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: list[int] = []
        starts: list[int] = []
        known: dict[str, int] = {}
        ids: list[pa.Array] = []
        number = None
        for b in batches:
            done = 0
            for i, (at, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                ws = words(t)
                if number is not None and len(codes) + len(ws) > range_words:
                    ids.append(b.column(2).slice(done, i - done))
                    yield lists(number, codes, list(known), starts, pa.concat_arrays(ids))
                    codes, starts, known, ids, done, number = [], [], {}, [], i, None
                number = at if number is None else number
                starts.append(len(codes))
                codes += [known.setdefault(w, len(known)) for w in ws]
            ids.append(b.column(2).slice(done))
        if number is not None:
            yield lists(number, codes, list(known), starts, pa.concat_arrays(ids))

    # a range bears the number of its first document, which no other partition gives
    rows = docs.where(F.col(doc).isNotNull()).select(F.monotonically_increasing_id().alias("at"), F.col(text).cast("string").alias("t"), F.col(doc).alias("doc_id"))
    return rows.mapInArrow(run, schema)


# ---- the search ----


@dataclass
class Plan:
    """An item prepared for the search: its words, and the offsets of the rarest of each window."""

    item: object
    terms: list[str]
    anchors: list[int]


def plan(item: object, terms: list[str], df: dict[str, int], min_words: int, span: int) -> Plan | None:
    """Anchors: of each window of ``span`` words (or the whole item, if it is shorter) so many of its rarest terms that :data:`AGREE` must agree.

    None if the item is too short, or if no window can be in the corpus, since more of its words are not there than may differ.
    """
    if len(terms) < min_words:
        return None
    size = min(span, len(terms))
    need = min(AGREE, min_words)
    rate = [df.get(t, 0) for t in terms]
    anchors: set[int] = set()
    for w in range(len(terms) - size + 1):
        rarest = sorted(range(w, w + size), key=lambda o: (rate[o], o))
        if sum(rate[o] == 0 for o in rarest) <= size - min_words:
            anchors.update(rarest[: size - min_words + need])
    return Plan(item, terms, sorted(anchors)) if anchors else None


def search_range(lists: dict[str, np.ndarray], starts: np.ndarray, plans: list[Plan], min_words: int, span: int) -> list[tuple[int, int, int, int]]:
    """(document, plan, n_words, first_pos) of the leaks in one range.

    ``lists``: sorted positions of each term; ``starts``: where each document
    begins, and the end. Anchor positions minus item offset give shifts; shifts
    on which fewer than :data:`AGREE` anchors agree inside one document are
    dropped; for the others the lists of all terms of the item are intersected.
    """
    need = min(AGREE, min_words)
    none = np.zeros(0, np.int64)
    out: list[tuple[int, int, int, int]] = []
    for number, p in enumerate(plans):
        found = [(o, lists.get(p.terms[o], none)) for o in p.anchors]
        place = np.concatenate([x for _, x in found]) if found else none
        if len(place) < need:
            continue
        shift = np.concatenate([x - o for o, x in found])
        doc = np.searchsorted(starts, place, side="right") - 1
        order = np.lexsort((doc, shift))
        shift, doc = shift[order], doc[order]
        new = np.append(True, (np.diff(shift) != 0) | (np.diff(doc) != 0))
        first = np.flatnonzero(new)
        agree = np.diff(np.append(first, len(shift))) >= need
        shift, doc = shift[first[agree]], doc[first[agree]]
        if not len(shift):
            continue
        hit = np.zeros((len(shift), len(p.terms)), bool)
        for o, t in enumerate(p.terms):
            mine = lists.get(t, none)
            if len(mine):
                want = shift + o
                at = np.minimum(np.searchsorted(mine, want), len(mine) - 1)
                hit[:, o] = (mine[at] == want) & (want >= starts[doc]) & (want < starts[doc + 1])
        total = np.concatenate([np.zeros((len(shift), 1), np.int64), np.cumsum(hit, axis=1)], axis=1)
        ends = np.minimum(np.arange(len(p.terms)) + span, len(p.terms))
        n = np.where(hit, total[:, ends] - total[:, :-1], 0)
        for i in np.flatnonzero((n >= min_words).any(1)):
            out.append((int(doc[i]), number, int(n[i].max()), int(shift[i] + np.flatnonzero(n[i] >= min_words)[0] - starts[doc[i]])))
    return out


def _searcher(shared, min_words: int, span: int):
    """The search of one range as a function of its rows."""

    def search(g: pd.DataFrame) -> pd.DataFrame:
        positions = lambda data: np.cumsum(np.frombuffer(data, "<i4").astype(np.int64))
        is_docs = g["term"].isna()
        head = g[is_docs].iloc[0]
        lists = {t: positions(d) for t, d in zip(g["term"][~is_docs], g["places"][~is_docs], strict=True)}
        rows = search_range(lists, positions(head["places"]), shared.value, min_words, span)
        return pd.DataFrame([(head["docs"][d], shared.value[p].item, n, at) for d, p, n, at in rows], columns=["doc_id", "item_id", "n_words", "first_pos"])

    return search


def _item_chunks(items: DataFrame, item: str, text: str) -> Iterator[list[tuple[object, list[str]]]]:
    """The items with their words, in chunks of about :data:`CHUNK_WORDS` words, each collected by itself."""
    rows = items.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(F.col(item).alias("item_id"), F.col(text).cast("string").alias("t"))
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    chunks = max(1, -(-size // (5 * CHUNK_WORDS)))
    for c in range(chunks if n else 0):
        mine = rows if chunks == 1 else rows.where(F.pmod(F.xxhash64("item_id", "t"), F.lit(chunks)) == c)
        yield [(r["item_id"], words(r["t"])) for r in mine.collect()]


def find_leaks(index: PostingsIndex, items: DataFrame, item: str, item_text: str, min_words: int = MIN_WORDS, span: int | None = None) -> DataFrame:
    """doc_id, item_id, n_words (words that agree at the best place), first_pos: documents that hold part of an item.

    A document holds part of an item if, at one shift, at least ``min_words`` of
    some ``span`` consecutive words of the item (or of all, if it has fewer)
    stand at the same distances in the document; with ``span`` equal to
    ``min_words`` (the default) that is the exact phrase, with a larger one a
    proximity match that forgives changed words.

    Items are taken in chunks of bounded size. For each the frequencies of its
    terms are read from the index, then the lists of these terms, range by
    range, see :func:`search_range`; no other list is read and no posting is
    paired with another. Items that are null or too short give no rows; each
    row of a repeated id counts, the best place is given.
    """
    spark = index.lists.sparkSession
    span = span or min_words
    doc_kind, item_kind = index.lists.schema["docs"].dataType.elementType, items.schema[item].dataType
    schema = T.StructType([T.StructField("doc_id", doc_kind), T.StructField("item_id", item_kind), T.StructField("n_words", T.IntegerType()), T.StructField("first_pos", T.IntegerType())])
    out: DataFrame | None = None
    ranges = index.lists.where("term IS NULL").count()
    tasks = max(1, min(ranges, max(shuffle_partitions(spark), ranges // 64)))
    for chunk in _item_chunks(items, item, item_text):
        terms = sorted({w for _, ws in chunk if len(ws) >= min_words for w in ws})
        if not terms:
            continue
        wanted = F.broadcast(spark.createDataFrame([(t,) for t in terms], "term string"))  # at most the words of one chunk
        lists = index.lists.where(F.col("term").between(terms[0], terms[-1])).join(wanted, "term", "left_semi")
        df = {r[0]: r[1] for r in lists.groupBy("term").agg(F.sum("n")).collect()}
        plans = [p for i, ws in chunk if (p := plan(i, ws, df, min_words, span))]
        if not plans:
            continue
        kept = index.lists.where("term IS NULL").unionByName(lists.select(index.lists.columns))
        hits = kept.repartition(tasks, "range_id").groupBy("range_id").applyInPandas(_searcher(spark.sparkContext.broadcast(plans), min_words, span), schema)
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        return spark.createDataFrame([], schema)
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_words", (-F.col("first_pos")).alias("q"))).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.n_words").alias("n_words"), (-F.col("b.q")).cast("int").alias("first_pos"))


def leaks(docs: DataFrame, doc: str, doc_text: str, items: DataFrame, item: str, item_text: str, min_words: int = MIN_WORDS, span: int | None = None) -> DataFrame:
    """:func:`find_leaks` over an index that is built for the occasion. Null and empty texts give no rows."""
    return find_leaks(PostingsIndex.build(docs, doc, doc_text), items, item, item_text, min_words, span)
