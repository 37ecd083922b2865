"""Subject areas of documents: complement naive Bayes, refined by expectation-maximization, calibrated for each subject."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import materialize

#: Hashed features: words and pairs of neighbouring words, apart for each language; and hashed words that tell languages.
FEATURES, LANGUAGE_WORDS = 1 << 17, 1 << 16
#: Labelled rows, and rows known to have no subject, that are used at most: those of the smallest hash, of every subject alike.
LABELLED_ROWS = 20_000
#: Of the labelled rows of a subject and language each fifth is kept for calibration, and takes no part in the model.
CALIBRATION_EACH = 5
#: Passes over the unlabelled corpus that refine the model, and rounds in which a document's mixture of subjects settles.
EM_PASSES, MIXTURE_ROUNDS = 3, 3
#: Weight of a labelled row against an unlabelled one in the refined model.
LABEL_WEIGHT = 3.0
#: Pseudo counts: in proportion to a feature's share of its language; and alike for all features and subjects, in
#: the first model, where a rare word may be labelled once, and in the refined ones, where it is a slip.
PRIOR_SHARE, FIRST_FLAT, PRIOR_FLAT = 500.0, 0.1, 1.0
#: Log ratios nearer to zero than this are no evidence.
EVIDENCE = 1.0
#: Slope and offset of the log odds of a subject by its score, before calibration.
FIRST_CUT = (1.0, -4.0)
#: What a document's mixture holds of every subject, and of none, before any sentence is seen.
MIXTURE_PRIOR = 0.05
#: The surest posterior in calibration, the weight of all subjects' sentences beside one's own, and rounds in which it settles.
SUREST, POOLED_WEIGHT, CALIBRATION_ROUNDS = 0.998, 0.1, 4
#: A subject counts from this share of the sentences that deal with any.
SHARE = 0.25

_BLOCK = 8192

_ENDS = re.compile(r"[.!?][\s\"'*_)]+|\|")
_GOES_ON = re.compile(r"[ \t]*(?:>[ \t]*|//[ \t]*|\*[ \t]+|#[ \t]+)?([a-zà-ỹ])")
_SPANS = re.compile(r"`[^`\n]*`|<[^<>\n]{0,40}>")
_NAMES = re.compile(r"\S*[/\\]\S+|\b\w*[a-z0-9][A-Z]\w*|\b\w+_\w+|&\w+;")
_WORD = re.compile(r"[^\W\d_]{2,}")
_CODE = re.compile(r"\s*(?:return|def|fn|func|function|export|public|private|import|class)\b.*[({;:]")
# Format characters (Cf) stand below 0x20000 or among the tags.
_INVISIBLE = {i: None for i in (*range(0x20000), *range(0xE0000, 0xE0080)) if unicodedata.category(chr(i)) == "Cf"}
#: Spellings of which the words are kept at hand.
_KNOWN_TOKENS = 500_000


def _token_words(token: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(_NAMES.sub(" ", token))]


class _Words(dict):
    """The words of a token in small letters as 32-bit hashes; tokens seen before are looked up."""

    def __missing__(self, token: str) -> tuple[int, ...]:
        got = tuple(zlib.crc32(w.encode()) for w in _token_words(token))
        if len(token) <= 40:
            if len(self) >= _KNOWN_TOKENS:
                self.clear()
            self[token] = got
        return got


def _sentences(text: str) -> Iterator[str]:
    """The sentences of a text without code and marked names; a line that begins small goes on with the one above."""
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
    whole: list[str] = []
    for line in text.splitlines():
        if not line.isprintable():  # no format character is
            line = line.translate(_INVISIBLE)
        if whole and whole[-1] and whole[-1][-1] not in ".!?:|>" and (m := _GOES_ON.match(line)):
            whole[-1] = f"{whole[-1]} {line[m.start(1) :].rstrip()}"
        else:
            whole.append(line.rstrip())
    for line in whole:
        for s in _ENDS.split(line) if line else ():
            if s and s.rstrip()[-1:] not in (";", "{", "}") and not _CODE.match(s):
                yield _SPANS.sub(" ", s) if "`" in s or "<" in s else s


def sentences(text: str) -> Iterator[list[str]]:
    """The words, in small letters, of each sentence with at least two; code and names of code are left out."""
    for s in _sentences(text):
        words = [w for t in s.split() for w in _token_words(t)]
        if len(words) >= 2:
            yield words


def parse(texts: list[str | None], words: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The word hashes of texts one after another, how many each text has, where its sentences begin in its own, and how many it has."""
    codes: list[int] = []
    starts: list[int] = []
    sizes, counts = [], []
    for text in texts:
        begin, before = len(codes), len(starts)
        for s in _sentences(text) if text else ():
            at = len(codes)
            for t in s.split():
                codes += words[t]
            if len(codes) - at >= 2:
                starts.append(at - begin)
            else:
                del codes[at:]
        sizes.append(len(codes) - begin)
        counts.append(len(starts) - before)
    return np.array(codes, np.uint32), np.array(sizes, np.int64), np.array(starts, np.int32), np.array(counts, np.int64)


def language_table(labelled: list[tuple[str, str]]) -> np.ndarray:
    """The log rate of each hashed word in each language, from texts (language, text); one column if no language is told.

    Words that no text holds say nothing.
    """
    langs = sorted({a for a, _ in labelled if a})
    if len(langs) < 2:
        return np.zeros((LANGUAGE_WORDS, 1), np.float32)
    words, n = _Words(), np.zeros((LANGUAGE_WORDS, len(langs)))
    for lang, text in labelled:
        if lang:
            np.add.at(n[:, langs.index(lang)], parse([text], words)[0] % LANGUAGE_WORDS, 1)
    totals, every = n.sum(0), n.sum(1, keepdims=True)
    out = np.log((n + 1000 * every / max(every.sum(), 1) + 0.01) / (totals + 1000))
    out -= out.mean(1, keepdims=True)
    out[every[:, 0] == 0] = 0
    return out.astype(np.float32)


@dataclass
class Sentences:
    """The sentences of some texts: features one after another, where each sentence begins, and its text (in order)."""

    ids: np.ndarray
    starts: np.ndarray
    owner: np.ndarray

    @staticmethod
    def of_codes(codes: np.ndarray, sizes: np.ndarray, starts: np.ndarray, counts: np.ndarray, langs: np.ndarray) -> Sentences:
        """``codes`` and sentence ``starts`` of several texts, with the ``sizes`` and ``counts`` of each text.

        Features of a sentence: its words, then its pairs of neighbouring words;
        those of a language (the likeliest of the sentence by ``langs``) are the
        numbers that leave it as rest.
        """
        owner = np.repeat(np.arange(len(counts)), counts)
        if not len(owner):
            return Sentences(np.zeros(0, np.int64), np.zeros(0, np.int64), owner)
        begin = starts + np.repeat(np.cumsum(sizes) - sizes, counts)
        length = np.diff(np.append(begin, len(codes)))
        n_lang = langs.shape[1]
        room = np.uint64(FEATURES // n_lang)
        words = codes.astype(np.uint64)
        mixed = words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        pairs = np.append(mixed >> np.uint64(40), np.uint64(0))
        at = 2 * begin - np.arange(len(begin))  # a sentence of n words has 2 n - 1 features
        ids = np.empty(2 * len(codes) - len(begin), np.int64)
        place = np.arange(len(codes)) - np.repeat(begin, length)
        first, size = np.repeat(at, length), np.repeat(length, length)
        ids[first + place] = words % room
        inner = place < size - 1
        ids[(first + size + place)[inner]] = (pairs % room)[inner]
        lang = np.add.reduceat(langs[words % np.uint64(LANGUAGE_WORDS)], begin, axis=0).argmax(1)
        return Sentences(ids * n_lang + np.repeat(lang, 2 * length - 1), at, owner)

    @staticmethod
    def of(texts: list[str | None], langs: np.ndarray) -> Sentences:
        return Sentences.of_codes(*parse(texts, _Words()), langs)

    @staticmethod
    def of_lists(codes: pa.ListArray, starts: pa.ListArray, langs: np.ndarray) -> Sentences:
        sizes = lambda a: np.diff(a.offsets.to_numpy())
        values = lambda a: a.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        return Sentences.of_codes(values(codes) & 0xFFFFFFFF, sizes(codes), values(starts), sizes(starts), langs)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        if not len(self.starts):
            return np.zeros((0, weights.shape[1]), np.float32)
        return np.add.reduceat(weights[self.ids], self.starts, axis=0)

    def add(self, counts: np.ndarray, shares: np.ndarray) -> None:
        """Count each sentence's features for the subjects in the proportions of ``shares``."""
        sizes = np.diff(np.append(self.starts, len(self.ids)))
        for c in range(counts.shape[1]):
            counts[:, c] += np.bincount(self.ids, weights=np.repeat(shares[:, c], sizes), minlength=FEATURES)


def complement_weights(counts: np.ndarray, n_lang: int, flat: float = PRIOR_FLAT) -> np.ndarray:
    """For each feature and subject the log ratio of its rate in the subject to its rate in the complement.

    ``counts``: features by subjects and, last, what has no subject. Rates are
    taken inside each language, and shrunk towards the language's own rate.
    """
    k = counts.shape[1] - 1
    lang = np.arange(FEATURES) % n_lang
    totals = np.stack([counts[lang == i].sum(0) for i in range(n_lang)])
    every, all_of = counts.sum(1), totals.sum(1)
    rate = every / np.maximum(all_of[lang], 1)
    out = np.zeros((FEATURES, k), np.float32)
    for c in range(k):
        inside, outside = counts[:, c], every - counts[:, c]
        a = (inside + PRIOR_SHARE * rate + flat) / (totals[lang, c] + PRIOR_SHARE)
        b = (outside + PRIOR_SHARE * rate + flat * (k - 1)) / ((all_of - totals[:, c])[lang] + PRIOR_SHARE)
        out[:, c] = np.log(a) - np.log(b)
    out[(np.abs(out) < EVIDENCE) | (every == 0)[:, None]] = 0
    return out


def posteriors(scores: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Independent probabilities that a sentence deals with each subject; ``cut``: slope and offset of each."""
    return 1 / (1 + np.exp(-np.clip(scores * cut[:, 0] + cut[:, 1], -50, 50)))


_SLOPES, _MIDDLES = 2.0 ** np.arange(-2, 2.5, 0.5), np.arange(0, 20.5, 0.5)


def _fits(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Log likelihood of ``y`` (from 0 to 1) by score for each slope and middle; no curve is surer than :data:`SUREST`."""
    out = np.zeros((len(_SLOPES), len(_MIDDLES)))
    for i, slope in enumerate(_SLOPES):
        for j, middle in enumerate(_MIDDLES):
            p = 1 - SUREST + (2 * SUREST - 1) / (1 + np.exp(-np.clip(slope * (x - middle), -50, 50)))
            out[i, j] = np.sum(weight * (y * np.log(p) + (1 - y) * np.log(1 - p)))
    return out


def calibrate(x: np.ndarray, text: np.ndarray, label: np.ndarray, rounds: int = CALIBRATION_ROUNDS) -> np.ndarray:
    """Slope and offset, a row for each subject, of the posterior of a sentence by its score.

    ``x``: scores of held-out sentences by subjects; ``text``: the text of
    each; ``label``: the subject of each text. A sentence of another subject's
    text is none of this one; of the sentences of a labelled text only some are
    of its subject, so they count by their posterior, and a text counts by the
    posterior of its best one, so a wrong label has little say. Both are settled
    in ``rounds``. The curve of a subject follows its own sentences; those of
    all subjects count beside them with :data:`POOLED_WEIGHT`, so that a subject
    with few labels has the common curve. Where many curves fit alike, the mean
    of their middles is taken.
    """
    k = x.shape[1]
    cut = np.tile(np.array(FIRST_CUT), (k, 1))
    if not len(x):
        return cut
    own = label[text]
    for _ in range(rounds):
        p = posteriors(x, cut)
        sure = np.zeros(len(label))
        np.maximum.at(sure, text, p[np.arange(len(x)), own])
        fits = [_fits(x[:, c], np.where(own == c, p[:, c], 0.0), sure[text]) for c in range(k)]
        pooled = POOLED_WEIGHT * sum(fits)
        for c, fit in enumerate(fits):
            fit = fit + pooled
            i = int(np.argmax(fit.max(1)))
            w = np.exp(fit[i] - fit[i].max())
            cut[c] = _SLOPES[i], -_SLOPES[i] * float(np.sum(w * _MIDDLES) / np.sum(w))
    return cut


def mixtures(s: Sentences, scores: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """E-step: the posterior mixture of every subject and, last, of none in the text of each sentence.

    A text is a mixture of subjects and none, of which each sentence has one; a
    sentence's posterior is the odds that its score gives it times the text's
    share, a text's share the mean of its sentences' posteriors. Both settle in
    :data:`MIXTURE_ROUNDS` rounds. All words of a text count in its mixture, so
    what the texts of every subject have in common becomes no evidence.
    """
    k = scores.shape[1]
    odds = np.ones((len(scores), k + 1))
    odds[:, :k] = np.exp(np.clip(scores * cut[:, 0] + cut[:, 1], -30, 30))
    if not len(scores):
        return odds
    new = np.diff(s.owner, prepend=-1) != 0
    first, of_text = np.flatnonzero(new), np.cumsum(new) - 1
    r = odds / odds.sum(1, keepdims=True)
    for _ in range(MIXTURE_ROUNDS):
        share = np.add.reduceat(r, first, axis=0) + MIXTURE_PRIOR
        share /= share.sum(1, keepdims=True)
        r = odds * share[of_text]
        r /= r.sum(1, keepdims=True)
    return share[of_text]


def parsed_texts(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """doc_id, codes, starts: every text as word hashes and sentence starts, read once for all passes; no shuffle."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc].dataType), T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("starts", T.ArrayType(T.IntegerType()))])

    lists = lambda values, sizes: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values.view(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                codes, sizes, starts, counts = parse(part.column(1).to_pylist(), words)
                yield pa.RecordBatch.from_arrays([part.column(0), lists(codes, sizes), lists(starts, counts)], names=["doc_id", "codes", "starts"])

    return docs.select(F.col(doc).alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(run, schema)


def _expected_counts(parsed: DataFrame, weights: np.ndarray, cut: np.ndarray, langs: np.ndarray) -> np.ndarray:
    """One pass: the features of the whole corpus, counted for the subjects by the mixtures of their texts."""
    spark = parsed.sparkSession
    shared = spark.sparkContext.broadcast((weights, cut, langs))
    k = weights.shape[1]
    schema = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("counts", T.BinaryType())])
    out_schema = pa.schema([("block", pa.int32()), ("counts", pa.binary())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, c, langs = shared.value
        counts = np.zeros((FEATURES, k + 1))
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                s = Sentences.of_lists(part.column(0), part.column(1), langs)
                if len(s.starts):
                    s.add(counts, mixtures(s, s.scores(w), c))
        for i in range(FEATURES // _BLOCK):
            part = counts[i * _BLOCK : (i + 1) * _BLOCK]
            if part.any():
                data = zlib.compress(part.astype(np.float32).tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([data], pa.binary())], schema=out_schema)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(data), np.float32)
                sums[i] = sums[i] + part if i in sums else part.astype(np.float64)
        for i, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([x.tobytes()], pa.binary())], schema=out_schema)

    # FEATURES / _BLOCK rows of fixed size come to the driver, whatever the corpus
    rows = parsed.select("codes", "starts").mapInArrow(split, schema).repartition(FEATURES // _BLOCK, "block").mapInArrow(total, schema).collect()
    counts = np.zeros((FEATURES, k + 1))
    for r in rows:
        counts[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = np.frombuffer(r["counts"], np.float64).reshape(_BLOCK, k + 1)
    shared.destroy()
    return counts


@dataclass
class SubjectModel:
    """``cut``: slope and offset of the posterior of each subject; ``langs``: see :func:`language_table`."""

    subjects: list[str]
    weights: np.ndarray
    cut: np.ndarray
    langs: np.ndarray


def train(
    parsed: DataFrame, subjects: list[str], labelled: list[tuple[str, str]], held_out: list[tuple[str, str]], neutral: list[str], langs: np.ndarray | None = None, passes: int = EM_PASSES
) -> SubjectModel:
    """Fit on labelled texts (subject, text), refine on the whole unlabelled corpus, calibrate on held-out texts.

    Labels are compared without case and surrounding blanks; rows with another
    label or without a text are left out. ``neutral`` texts belong to no
    subject. In every pass each text of the corpus counts for the subjects by its
    mixture, see :func:`mixtures`; ``langs`` (:func:`language_table`) keeps
    languages apart. ``held_out`` texts are seen
    by no pass; their sentences make the curves of the posteriors, see
    :func:`calibrate`. Without any labelled text no document has a subject.
    """
    place = {s.strip().lower(): i for i, s in enumerate(subjects)}
    known = lambda rows: [(place[a.strip().lower()], t) for a, t in rows if a and t and a.strip().lower() in place]
    k = len(subjects)
    fit, apart = known(labelled), known(held_out)
    langs = np.zeros((LANGUAGE_WORDS, 1), np.float32) if langs is None else langs
    n_lang = langs.shape[1]
    cut = np.tile(np.array(FIRST_CUT), (max(k, 1), 1))
    if not fit:  # nothing to tell subjects by
        return SubjectModel(list(subjects), np.zeros((FEATURES, max(k, 1)), np.float32), cut, langs)
    seen = Sentences.of([t for _, t in fit], langs)
    fixed = np.zeros((FEATURES, k + 1))
    if len(seen.starts):
        seen.add(fixed, np.eye(k + 1)[np.array([a for a, _ in fit], np.int64)[seen.owner]])
    none = Sentences.of(list(neutral), langs)
    if len(none.starts):
        none.add(fixed, np.eye(k + 1)[np.full(len(none.starts), k)])
    weights = complement_weights(fixed, n_lang, FIRST_FLAT)
    for _ in range(passes):
        weights = complement_weights(LABEL_WEIGHT * fixed + _expected_counts(parsed, weights, cut, langs), n_lang)
    test = Sentences.of([t for _, t in apart], langs)
    if len(test.starts):
        cut = calibrate(test.scores(weights).astype(float), test.owner, np.array([a for a, _ in apart]))
    return SubjectModel(list(subjects), weights, cut, langs)


def document_subjects(parsed: DataFrame, model: SubjectModel) -> DataFrame:
    """doc_id, subject, n_sentences, n_any, posterior: for each document the subjects that any of its sentences deals with.

    ``parsed``: see :func:`parsed_texts`. n_sentences deal with the subject,
    n_any with any subject; posterior is the highest of the subject. A sentence
    deals with every subject whose own posterior is at least one half. Null and
    empty texts and texts without such a sentence have no rows; repeated rows
    repeat. No shuffle.
    """
    spark = parsed.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kind = parsed.schema["doc_id"].dataType
    schema = T.StructType(
        [T.StructField("doc_id", kind), T.StructField("subject", T.StringType()), T.StructField("n_sentences", T.LongType()), T.StructField("n_any", T.LongType()), T.StructField("posterior", T.DoubleType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = m.subjects
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                s = Sentences.of_lists(part.column(1), part.column(2), m.langs)
                p = posteriors(s.scores(m.weights), m.cut)
                n, top, some = np.zeros((part.num_rows, len(names)), np.int64), np.zeros((part.num_rows, len(names))), np.zeros(part.num_rows, np.int64)
                at, which = np.nonzero(p >= 0.5)
                np.add.at(n, (s.owner[at], which), 1)
                np.maximum.at(top, (s.owner[at], which), p[at, which])
                np.add.at(some, s.owner[np.unique(at)], 1)
                rows, cols = np.nonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows)), pa.array([names[c] for c in cols], pa.string()), pa.array(n[rows, cols]), pa.array(some[rows]), pa.array(top[rows, cols])],
                    names=["doc_id", "subject", "n_sentences", "n_any", "posterior"],
                )

    return parsed.select("doc_id", "codes", "starts").mapInArrow(run, schema)


def labelled_rows(examples: DataFrame, bound: int = LABELLED_ROWS) -> tuple[list[tuple[str, str, str | None]], list[tuple[str, str, str | None]]]:
    """Labelled texts (subject, text, language) that fit the model, and those held out for its calibration.

    ``examples``: subject, example_text, and lang if there is one. Each subject
    gives the same number at most, by the hash of its texts, so a run repeats;
    of a subject's rows in one language each :data:`CALIBRATION_EACH`-th is held out.
    """
    lang = F.lower(F.trim("lang")) if "lang" in examples.columns else F.lit(None)
    rows = examples.select(F.lower(F.trim("subject")).alias("s"), lang.cast("string").alias("l"), F.col("example_text").cast("string").alias("t")).where("s IS NOT NULL AND trim(t) <> ''")
    rows = rows.withColumn("h", F.xxhash64("t", F.lit(11)))
    n = max(1, rows.select("s").distinct().count())
    few = rows.withColumn("k", F.row_number().over(Window.partitionBy("s").orderBy("h", "t"))).where(F.col("k") <= max(1, bound // n))
    each = few.withColumn("p", F.row_number().over(Window.partitionBy("s", "l").orderBy("h", "t"))).select("s", "t", "l", (F.col("p") % CALIBRATION_EACH == 0).alias("apart"))
    got = each.orderBy("s", "t").collect()  # at most ``bound`` rows
    return [(r["s"], r["t"], r["l"]) for r in got if not r["apart"]], [(r["s"], r["t"], r["l"]) for r in got if r["apart"]]


def subject_areas(spark: SparkSession, docs: DataFrame, areas: DataFrame, examples: DataFrame, neutral: DataFrame | None = None) -> DataFrame:
    """doc_id and subject of the areas that hold at least :data:`SHARE` of a document's subject sentences, with the columns of :func:`document_subjects`.

    ``docs``: doc_id, text; ``areas``: subject; ``examples``: subject,
    example_text and perhaps lang; ``neutral``: item_text of no subject. At most
    :data:`LABELLED_ROWS` examples and neutral texts are read; ``areas`` is the
    list of a taxonomy and is read whole.
    """
    names = [r[0] for r in areas.select("subject").where("subject IS NOT NULL").distinct().orderBy("subject").collect()]
    labelled, held_out = labelled_rows(examples)
    none = []
    if neutral is not None:
        by_hash = neutral.select("item_text").where("item_text IS NOT NULL").orderBy(F.xxhash64("item_text", F.lit(11)), "item_text").limit(LABELLED_ROWS)
        none = [r[0] for r in by_hash.collect()]
    parsed = materialize(parsed_texts(docs, "doc_id", "text"), "parsed")
    pairs = lambda rows: [(s, t) for s, t, _ in rows]
    model = train(parsed, names, pairs(labelled), pairs(held_out), none, language_table([(lang, t) for _, t, lang in labelled]))
    return document_subjects(parsed, model).where(F.col("n_sentences") >= SHARE * F.col("n_any"))
