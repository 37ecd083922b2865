"""Byte-pair encoding by a lazily determinised transducer, and streaming decoding."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the vocabulary lies by default; a parameter of every function that needs it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the public pattern that splits text before byte-level BPE, white space spelled by its Unicode property.
PIECES = (
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)

#: Determinised states, and whole pieces, that are kept before the tables are built anew.
KEEP_STATES = 400_000
KEEP_PIECES = 200_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to id, from lines of base64 and rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class MergeTransducer:
    """The merges of a byte-level BPE compiled into a transducer from bytes to ids.

    Nondeterministic view: after some bytes of a piece, a token may begin at
    several earlier places; each such place has one tokenisation of what stands
    before it, whose last token must be able to stand before the next. A
    determinised state is the set of these places: where each is in the trie of
    tokens, and its ids that are not yet emitted. What all have in common is
    emitted at once; so the lookahead is bounded by the longest token. States
    and transitions are made when a text first needs them.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.child: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for b, i in ranks.items():
            at = 0
            for x in b:
                nxt = self.child[at].get(x)
                if nxt is None:
                    nxt = len(self.child)
                    self.child[at][x] = nxt
                    self.child.append({})
                    self.ends.append(-1)
                at = nxt
            self.ends[at] = i
        self._fits: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.states: dict[tuple, int] = {}
        self.content: list[tuple] = []
        self.step: list[dict[int, tuple[int, tuple[int, ...]]]] = []
        self.rest: list[tuple[int, ...]] = []
        self.start = self._state(-1, ((0, ()),))

    def _state(self, before: int, places: tuple) -> int:
        key = (before, places)
        at = self.states.get(key)
        if at is None:
            at = self.states[key] = len(self.content)
            self.content.append(key)
            self.step.append({})
            self.rest.append(places[-1][1])  # the place after the last byte comes last
        return at

    def merge(self, data: bytes) -> list[int]:
        """The ids of ``data`` by repeated merging of the pair of lowest rank: the definition, for pairs of tokens."""
        parts = [bytes([x]) for x in data]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, a: int, b: int) -> bool:
        """Whether merging leaves token ``b`` after token ``a`` as they are."""
        if a < 0:
            return True
        known = self._fits.get((a, b))
        if known is None:
            known = self._fits[a, b] = self.merge(self.token[a] + self.token[b]) == [a, b]
        return known

    def _advance(self, at: int, x: int) -> tuple[int, tuple[int, ...]]:
        before, places = self.content[at]
        going, ended = [], None
        for node, path in places:
            nxt = self.child[node].get(x)
            if nxt is None:
                continue
            if self.child[nxt]:
                going.append((nxt, path))
            token = self.ends[nxt]
            if ended is None and token >= 0 and self.fits(path[-1] if path else before, token):
                ended = (*path, token)
        assert ended is not None
        going.append((0, ended))
        common = 0
        shortest = min(len(p) for _, p in going)
        while common < shortest and all(p[common] == ended[common] for _, p in going):
            common += 1
        emitted = ended[:common]
        if common:
            going = [(n, p[common:]) for n, p in going]
            before = emitted[-1]
        out = self._state(before, tuple(going)), emitted
        self.step[at][x] = out
        return out

    def piece(self, data: bytes) -> list[int]:
        """The ids of one piece."""
        if len(self.content) > KEEP_STATES:
            self._reset()
        at, out, step = self.start, [], self.step
        for x in data:
            move = step[at].get(x)
            if move is None:
                move = self._advance(at, x)
            at = move[0]
            if move[1]:
                out.extend(move[1])
        out.extend(self.rest[at])
        return out


class Encoder:
    """Whole texts to ids; special tokens have no meaning."""

    def __init__(self, ranks: dict[bytes, int]):
        self.transducer = MergeTransducer(ranks)
        self.split = regex.compile(PIECES).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; null and empty texts have none."""
        if not text:
            return []
        out: list[int] = []
        known = self.known
        for p in self.split(text):
            ids = known.get(p)
            if ids is None:
                if len(known) > KEEP_PIECES:
                    known.clear()
                ids = tuple(self.transducer.piece(p.encode()))
                if len(p) < 64:
                    known[p] = ids
            out.extend(ids)
        return out


class Utf8Machine:
    """Bytes in portions of any size to text; a character split between portions waits for its rest.

    The state is how many bytes are missing, and the range that the next must
    be in. A byte out of range ends the bad sequence, which becomes one U+FFFD,
    and is read again from the start state.
    """

    def __init__(self) -> None:
        self.held = bytearray()
        self.missing, self.low, self.high = 0, 0x80, 0xBF

    def _lead(self, x: int) -> str:
        if x < 0x80:
            return chr(x)
        if 0xC2 <= x <= 0xF4:
            self.missing = 1 + (x >= 0xE0) + (x >= 0xF0)
            self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(x, 0x80)
            self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(x, 0xBF)
            self.held = bytearray([x])
            return ""
        return "�"

    def feed(self, data: bytes) -> str:
        if not self.missing:
            try:
                return data.decode()
            except UnicodeDecodeError:
                pass
        out = []
        for x in data:
            if self.missing and self.low <= x <= self.high:
                self.held.append(x)
                self.missing -= 1
                self.low, self.high = 0x80, 0xBF
                if not self.missing:
                    out.append(self.held.decode())
            else:
                if self.missing:
                    out.append("�")
                    self.missing = 0
                out.append(self._lead(x))
        return "".join(out)

    def end(self) -> str:
        left, self.missing = self.missing, 0
        return "�" if left else ""


def decode_stream(ids: Iterable[int], token: dict[int, bytes]) -> Iterator[str]:
    """Text for each id as it comes; ids that are not in the vocabulary give U+FFFD."""
    machine = Utf8Machine()
    for i in ids:
        data = token.get(i)
        yield machine.end() + "�" if data is None else machine.feed(data)
    yield machine.end()


_encoders: dict[int, Encoder] = {}


def _encoder(data: bytes) -> Encoder:
    """One encoder a Python worker and vocabulary; workers live on from task to task."""
    key = hash(data)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(read_ranks(data))
    return _encoders[key]


def encode_texts(docs: DataFrame, doc: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and ids (list of integers) of every row; null and empty texts give an empty list.

    Repeated rows give repeated rows. The vocabulary (under 2 MB) is read by the
    driver and broadcast, so it need not lie on the executors. No shuffle.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    kind = docs.schema[doc].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared.value)
        for b in batches:
            ids = pa.array([enc.encode(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["doc_id", "ids"])

    return docs.select(F.col(doc).alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(run, schema)


def decode_texts(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and text of each row of doc_id and ids; a null list gives a null text."""
    spark = encoded.sparkSession
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    schema = T.StructType([encoded.schema["doc_id"], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = _encoder(shared.value).transducer.token
        for b in batches:
            texts = [None if ids is None else "".join(decode_stream(ids, token)) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, schema)
