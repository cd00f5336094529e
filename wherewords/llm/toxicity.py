"""Toxic documents by compression distance.

Two zstandard dictionaries: one trained on ordinary text, and the same with what sets toxic
text apart, the words that toxic texts hold far more often. A document is read in short
overlapping windows; one that compresses better under the toxic dictionary speaks for
toxicity. A document's window differences are summed up in a few figures; thresholds and
weights of those are calibrated on labelled documents that the dictionaries have not seen.

Three things make short windows comparable to the byte: words lie at the end of the
dictionary, where references to them are short; every window ends with the same few bytes,
which both dictionaries end with, as the compressor looks for no match in the last eight
bytes; and by them every window is worth compressing, so that none is stored as it is.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wherewords.llm.tables import crc_bucket, small_batches, table, texts_of

#: Labelled documents per class that are fitted on at most, and the longest of them.
SAMPLE_ROWS, SAMPLE_CHARS = 3000, 50_000
#: Pieces of text that the common dictionary is trained on.
WINDOW_BYTES = 64
#: Windows that are scored, and how far apart they begin.
SCORED_BYTES, STRIDE = 16, 8
#: Windows that are compressed at once.
AT_ONCE = 1 << 14
COMMON_BYTES, OWN_BYTES = 60_000, 6_000
#: Words that set a class apart: in how many of its documents, and how many times as often as
#: in the other class; their length.
WORD_DOCS, WORD_RATIO, WORD_LETTERS = 4, 12.0, range(3, 31)
#: Parts of the labelled texts, each calibrating what the others train.
FOLDS = 3
#: Tables that a trained dictionary begins with; its content is used without them.
HEADER_BYTES = 300
#: End of both dictionaries and of every window; no byte of it begins a letter.
STUB = bytes(range(0x80, 0x90))
#: Gains in bytes that windows are counted from.
GAINS = (1, 2, 3, 4, 5, 6)
FIGURES = len(GAINS) + 5
#: No window differs by so many bytes.
MOST_GAIN = 1 << 15

MATCHING = {
    "strategy": zstd.STRATEGY_DFAST, "hash_log": 15, "chain_log": 15, "window_log": 18,
    "min_match": 3, "search_log": 5, "target_length": 32,
}


def windows_of(text: str) -> Iterator[bytes]:
    """Pieces of at most :data:`WINDOW_BYTES`, cut at blanks where there are any."""
    raw = text.lower().encode("utf-8", "surrogatepass")
    at = 0
    while at < len(raw):
        to = at + WINDOW_BYTES
        if to < len(raw):
            blank = raw.rfind(b" ", at + 1, to)
            to = blank if blank > at else to
        yield raw[at:to]
        at = to


def scored_windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The windows of the texts one after the other, each as two 8-byte words, and how many
    each text has; a text's last window is filled up with blanks."""
    raws = [text.lower().encode("utf-8", "surrogatepass") for text in texts]
    sizes = np.fromiter(map(len, raws), np.int64, len(raws))
    counts = np.where(sizes > 0, np.maximum(0, -(-(sizes - SCORED_BYTES) // STRIDE)) + 1, 0)
    widths = np.where(counts > 0, (counts - 1) * STRIDE + SCORED_BYTES, 0)
    filled = np.frombuffer(b"".join(raw.ljust(n, b" ") for raw, n in zip(raws, widths.tolist(), strict=True)), np.uint64)
    # A window is a word and the one behind it; a text has a word more than windows.
    starts = np.arange(int(counts.sum())) + np.repeat(np.cumsum(counts > 0) - 1, counts)
    return np.stack([filled[starts], filled[starts + 1]], axis=1) if len(starts) else np.zeros((0, 2), np.uint64), counts


def with_stubs(windows: np.ndarray) -> zstd.BufferWithSegments:
    """Windows with the stub behind each."""
    ended = np.empty((len(windows), 4), np.uint64)
    ended[:, :2], ended[:, 2:] = windows, np.frombuffer(STUB, np.uint64)
    width = SCORED_BYTES + len(STUB)
    places = np.full((len(windows), 2), width, np.uint64)
    places[:, 0] = np.arange(len(windows)) * width
    return zstd.BufferWithSegments(ended.tobytes(), places.tobytes())


@dataclass
class Model:
    """Dictionaries, and the weights of a document's figures. Pickled to the workers."""

    ordinary: bytes
    toxic: bytes
    weights: list[float]
    bias: float

    def __post_init__(self):
        self._pair = None

    def __getstate__(self):
        return (self.ordinary, self.toxic, self.weights, self.bias)

    def __setstate__(self, state):
        self.ordinary, self.toxic, self.weights, self.bias = state
        self._pair = None

    def _compressors(self):
        if self._pair is None:
            settings = zstd.ZstdCompressionParameters(write_content_size=False, **MATCHING)
            self._pair = []
            for content in (self.ordinary, self.toxic):
                words = zstd.ZstdCompressionDict(content + STUB, dict_type=zstd.DICT_TYPE_RAWCONTENT)
                words.precompute_compress(compression_params=settings)
                self._pair.append(zstd.ZstdCompressor(dict_data=words, compression_params=settings))
        return self._pair

    def gains(self, windows: np.ndarray) -> np.ndarray:
        """Bytes that the toxic dictionary saves in each window. A call of the library sets its
        tables up anew, so windows of many texts go into one."""
        ordinary, toxic = self._compressors()
        out = np.empty(len(windows), np.int64)
        for begin in range(0, len(windows), AT_ONCE):
            part = with_stubs(windows[begin : begin + AT_ONCE])
            first, second = (
                np.fromiter(map(len, c.multi_compress_to_buffer(part)), np.int16, len(part)) for c in (ordinary, toxic)
            )
            out[begin : begin + AT_ONCE] = first - second
        return out

    def figures(self, texts: list[str]) -> np.ndarray:
        """What each text's window differences come to, a row a text; all zero for an empty text."""
        found = np.zeros((len(texts), FIGURES))
        for begin, end in _runs_of(texts):
            windows, counts = scored_windows(texts[begin:end])
            gains = self.gains(windows)
            some = np.flatnonzero(counts)
            if len(some):
                found[begin + some] = _figures(gains, counts[some])
        return found

    def score(self, texts: list[str]) -> np.ndarray:
        found = self.figures(texts)
        return 1 / (1 + np.exp(-np.clip(found @ np.array(self.weights) + self.bias, -30, 30)))


def _runs_of(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Begin and end of runs of texts that have about :data:`AT_ONCE` windows together."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= AT_ONCE * STRIDE:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _figures(gains: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The figures of texts with ``counts`` windows each, none of them 0."""
    first = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(counts)), counts)
    # Falling within each text: sorted as one number, the gain counted down.
    ranked = np.sort((owner << 16) + (MOST_GAIN - gains))
    ranked = (MOST_GAIN - (ranked & 0xFFFF)).astype(float)
    mean = np.add.reduceat(gains.astype(float), first) / counts
    top = sum(np.where(counts > k, ranked[np.minimum(first + k, len(ranked) - 1)], 0.0) for k in range(3)) / np.minimum(counts, 3)
    above = [np.add.reduceat((gains >= least).astype(np.int64), first) for least in GAINS]
    share = np.add.reduceat((gains >= 4).astype(np.int64), first) / counts
    return np.column_stack([np.clip(mean, -3, 3), ranked[first], top, np.log1p(counts), share, *map(np.log1p, above)])


#: Without labelled documents of both classes nothing is known: all scores are near zero.
UNKNOWN = Model(b" ordinary", b" toxic", [0.0] * FIGURES, -30.0)


def without_copies(texts: list[str]) -> list[str]:
    """The texts but for near copies of earlier ones, whose words would count many times:
    texts that share one of four smallest hashes of five words in a row."""
    seen: set[tuple[int, int]] = set()
    kept = []
    for text in texts:
        words = text.split()
        runs = {zlib.crc32(" ".join(words[i : i + 5]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(words) - 4))}
        least = {(k, min((run * k) & 0xFFFFFFFF for run in runs)) for k in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)}
        if seen.isdisjoint(least):
            kept.append(text)
        seen |= least
    return kept


def _word_docs(texts: list[str]) -> Counter:
    return Counter(word for text in texts for word in set(text.lower().split()))


def _apart(texts: list[str], others: list[str]) -> bytes:
    """The words that set a class apart, up to :data:`OWN_BYTES`, the most telling ones last."""
    own, other = _word_docs(texts), _word_docs(others)
    odds = {}
    for word, n in own.items():
        times = (n / len(texts)) / ((other[word] + 0.2) / len(others))
        if n >= WORD_DOCS and times > WORD_RATIO and len(word) in WORD_LETTERS:
            odds[word] = (n / len(texts)) / ((other[word] + 1) / len(others)) * min(1.0, n / 5)
    content, size = [], 0
    for word in sorted(odds, key=lambda w: (-odds[w], w)):
        raw = b" " + word.encode("utf-8", "surrogatepass") + b" "
        size += len(raw)
        if size > OWN_BYTES:
            break
        content.append(raw)
    return b"".join(reversed(content))


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """Content of a trained dictionary; of few samples, the samples themselves."""
    try:
        return zstd.train_dictionary(size + HEADER_BYTES, samples, k=32, d=8).as_bytes()[HEADER_BYTES:]
    except zstd.ZstdError:
        return b"".join(samples)[-size:]


def train_dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    common = _dictionary([w for text in ordinary for w in windows_of(text)], COMMON_BYTES)
    return common + _apart(ordinary, toxic), common + _apart(toxic, ordinary)


def calibrate(figures: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[list[float], float]:
    """Logistic weights by Newton steps, the bias moved so that 0.5 is the best F1."""
    scale = figures.std(axis=0) + 1e-9
    x = np.column_stack([figures / scale, np.ones(len(figures))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - toxic)) + 1e-2 * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w = w - np.linalg.solve(curve, slope)
    logits = x @ w
    order = np.argsort(-logits, kind="stable")
    hit, all_hit = np.cumsum((weight * toxic)[order]), (weight * toxic).sum()
    f1 = 2 * hit / (np.cumsum(weight[order]) + all_hit)
    best = int(np.argmax(f1))
    after = logits[order][min(best + 1, len(order) - 1)]
    cut = (logits[order][best] + after) / 2
    return list(w[:-1] / scale), float(w[-1] - cut)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model out of the labelled rows of ``docs``.

    Per class the :data:`SAMPLE_ROWS` rows with the smallest hash of the key that have at
    most :data:`SAMPLE_CHARS` code points; each calibrates what others train. Null labels and
    texts do not count; of several labels of a key the largest does. Without rows of both
    classes: :data:`UNKNOWN`.
    """
    marks = labels.filter(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("key")).agg(F.max(label).alias("toxic"))
    usable = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(
        (F.char_length("text") > 0) & (F.char_length("text") <= SAMPLE_CHARS)
    )
    totals = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.col("key").cast("string"))
    samples: dict[int, list[str]] = {}
    for mark in (0, 1):
        # About twice as many by their hash alone, so that few pass the driver.
        share = min(1.0, 2 * SAMPLE_ROWS / max(1, totals.get(mark, 0)))
        few = marks.filter((F.col("toxic") == mark) & (F.pmod(order, F.lit(1 << 30)) < share * (1 << 30)))
        keys = few.orderBy(order, "key").limit(SAMPLE_ROWS).select("key")
        # At most SAMPLE_ROWS keys.
        rows = usable.join(F.broadcast(keys), "key").select("key", "text").collect()
        rows.sort(key=lambda r: (r["key"], r["text"]))
        samples[mark] = without_copies([r["text"] for r in rows])
    if not all(samples.values()):
        return UNKNOWN
    # Figures of texts that the dictionaries have not seen: each fold's from the others' texts.
    folds = FOLDS if min(map(len, samples.values())) >= FOLDS else 1
    found, marks_of = [], []
    for fold in range(folds):
        learn = {m: [t for i, t in enumerate(s) if folds == 1 or i % folds != fold] for m, s in samples.items()}
        part = Model(*train_dictionaries(learn[1], learn[0]), [0.0] * FIGURES, 0.0)
        for mark in (0, 1):
            held = samples[mark][fold::folds]
            found.append(part.figures(held))
            marks_of += [float(mark)] * len(held)
    figures, marks_of = np.concatenate(found), np.array(marks_of)
    model = Model(*train_dictionaries(samples[1], samples[0]), [0.0] * FIGURES, 0.0)
    # Each class counts as it does among all labels.
    weight = np.where(marks_of == 1, totals[1] / len(samples[1]), totals[0] / len(samples[0]))
    model.weights, model.bias = calibrate(figures, marks_of, weight / weight.mean())
    return model


def scores(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of each row. A null text counts as empty; repeated rows score alike;
    null keys stay; other columns are left out; an empty table gives no rows."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(shared.value.score(texts_of(batch, "text")))], ["key", "score"]
            )

    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "key bigint, score double").withColumnRenamed("key", key)


def without_toxic(docs: DataFrame, model: Model, text: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below the limit, with all their columns."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.score(texts_of(batch, text)) < limit))

    return docs.mapInArrow(run, docs.schema)


def learning_rows(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Labels outside the held-out fifth."""
    return labels.filter(crc_bucket(F.col(key), 5) != 0)


def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, learning_rows(table(spark, sf_dir, "labels")))
    return scores(docs, model).select(
        "doc_id", (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
