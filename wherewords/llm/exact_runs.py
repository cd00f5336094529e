"""Exact runs of words that several documents hold, wherever in a line they begin.

Every run of :data:`RUN_WORDS` words is looked at, across line ends, too. To count them all
would be a row per word, so each run has a mark, the smallest hash of the :data:`GRAM_WORDS`
words in a row that lie inside it: equal runs have equal marks, neighbours mostly share
theirs, and a run whose mark no other document has is in no other document. Marks are
counted first, and only the runs of shared marks after that. The document with the smallest
key keeps a run, and the others lose its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wherewords.llm.tables import WordBatch, _power, changed_rows, few, free_name, list_array, mix, pieces, small_batches, steady_places, texts_of, word_spans
from wherewords.session import stage

#: A passage of over 50 words has a run of 51.
RUN_WORDS, GRAM_WORDS = 51, 26
#: Texts of a batch that are looked at together: bounds the memory when texts are long.
TEXTS = 100
_BASE = 0xAF251AF3B0F025B5
_INVERSE = pow(_BASE, -1, 1 << 64)


def hashes_of_runs(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each ``k`` words in a row."""
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _power(_BASE, len(words)), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * _power(_INVERSE, len(words))[: max(len(words) - k + 1, 0)])


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` values in a row."""
    size = 1
    while size < width:
        step = min(size, width - size)
        values = np.minimum(values[:-step], values[step:])
        size += step
    return values


def runs_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word in it, hash and mark of every run in the texts."""
    words = WordBatch(texts)
    if len(words.hashes) < RUN_WORDS:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    runs = hashes_of_runs(words.hashes, RUN_WORDS)
    marks = smallest(hashes_of_runs(words.hashes, GRAM_WORDS), RUN_WORDS - GRAM_WORDS + 1)
    text = np.repeat(np.arange(len(texts)), np.diff(words.first))[: len(runs)]
    at = np.arange(len(runs))
    whole = np.flatnonzero(at + RUN_WORDS <= words.first[text + 1])
    return text[whole], at[whole] - words.first[text[whole]], runs[whole], marks[whole]


def marks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, marks): distinct marks of each row."""
    for big in batches:
        for batch in pieces(big, TEXTS):
            text, _, _, marks = runs_of(texts_of(batch, "text"))
            order = np.lexsort((marks, text))
            text, marks = text[order], marks[order]
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (marks[1:] != marks[:-1])
            lengths = np.bincount(text[new], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), list_array(marks[new].view(np.int64), lengths, pa.int64())], ["row", "marks"]
            )


def marked_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, key, at, run) of the runs with one of the row's shared marks."""
    for big in batches:
        for batch in pieces(big, TEXTS):
            text, at, runs, marks = runs_of(texts_of(batch, "text"))
            shared = batch.column("marks")
            begins, chosen = np.searchsorted(text, np.arange(batch.num_rows + 1)), [np.zeros(0, np.int64)]
            for i in range(batch.num_rows):
                own = slice(begins[i], begins[i + 1])
                chosen.append(begins[i] + np.flatnonzero(np.isin(marks[own].view(np.int64), shared[i].values.to_numpy())))
            chosen = np.concatenate(chosen)
            place = pa.array(text[chosen])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row").take(place), batch.column("key").take(place),
                    pa.array(at[chosen].astype(np.int32)), pa.array(runs[chosen].view(np.int64)),
                ],
                ["row", "key", "at", "run"],
            )


def without_words(text: str, at: list[int]) -> str:
    """The text without the runs that begin at these words; white space around them stays."""
    raw = text.encode("utf-8", "surrogatepass")
    starts, ends = word_spans(np.frombuffer(raw, np.uint8))
    change = np.zeros(len(starts) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, np.asarray(at) + RUN_WORDS, -1)
    lost = np.concatenate([[False], np.cumsum(change)[:-1] > 0, [False]])
    edges = np.flatnonzero(lost[1:] != lost[:-1])
    left, begin = [], 0
    for first, last in zip(edges[::2], edges[1::2], strict=True):
        left.append(raw[begin : starts[first]])
        begin = ends[last - 1]
    return b"".join([*left, raw[begin:]]).decode("utf-8", "surrogatepass")


def repeated_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, at): first words, from 0, of the runs that a row loses; rows with any.

    Words are runs without ASCII white space, A-Z in lower case. Rows without a key are
    last, and among equal keys the first row read is first. A run that only one row
    repeats stays. ``row`` is a row's place in ``docs``, which must be a stored table.
    """
    spark = docs.sparkSession
    small_batches(spark)
    steady_places(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    marks = stage(rows.select("row", "text").mapInArrow(marks_of, "row bigint, marks array<bigint>"), "marks")
    each = marks.select("row", F.explode("marks").alias("mark"))
    shared = stage(each.groupBy("mark").agg(F.count("*").alias("n")).filter("n > 1").select("mark"), "shared-marks")
    own = stage(each.join(shared, "mark").groupBy("row").agg(F.collect_list("mark").alias("marks")), "marks-of-rows")
    kind = docs.schema[key].dataType.simpleString()
    # Texts stay where they are, but for those with a shared mark.
    promising = rows.join(few(own.select("row")), "row", "left_semi")
    found = stage(
        promising.join(own, "row").mapInArrow(marked_runs, f"row bigint, key {kind}, at int, run bigint"), "marked-runs"
    )
    rank = F.struct(F.col("key").isNull().alias("no_key"), "key", "row")
    firsts = stage(
        found.groupBy("run").agg(F.min(rank).alias("first"), F.min("row").alias("low"), F.max("row").alias("high"))
        .filter("low < high").select("run", F.col("first.row").alias("first_row")),
        "repeated-runs",
    )
    lost = found.join(firsts, "run").filter(F.col("row") != F.col("first_row"))
    return lost.groupBy("row").agg(F.collect_list("at").alias("at"))


def without_repeated_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with its columns and the repeated runs taken out of the text.

    Rows of which no word is left are dropped; untouched rows stay as they are.
    """
    at = free_name(docs, "at")
    lost = stage(repeated_runs(docs, key, text).withColumnRenamed("at", at), "lost-runs")

    def change(rows: DataFrame) -> DataFrame:
        names = rows.columns

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [without_words(t, a) for t, a in zip(texts_of(batch, text), batch.column(at).to_pylist(), strict=True)]
                yield batch.set_column(names.index(text), text, pa.array(texts, pa.string()))

        return rows.mapInArrow(cut, rows.schema).filter(F.col(text).rlike(r"[^\x20\x09-\x0D]"))

    return changed_rows(docs, lost, change)
