"""What the operators of this subpackage share: tables, Arrow batches, hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of an Arrow batch: bounds the memory of a Python worker when texts are long.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Python workers get at most :data:`BATCH_ROWS` rows at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def steady_places(spark: SparkSession) -> None:
    """Rows of a stored table get the same place in every scan of this session.

    Small tables are split by the number of cores, which changes when an executor is lost;
    from now on it counts as it is.
    """
    if not spark.conf.get("spark.sql.files.minPartitionNum", None):
        spark.conf.set("spark.sql.files.minPartitionNum", spark.sparkContext.defaultParallelism)


def free_name(docs: DataFrame, name: str) -> str:
    """The name, or a longer one that no column of ``docs`` has."""
    taken = {column.lower() for column in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Up to so many rows of one or two numbers are broadcast to pick texts or sets (16 MB).
BROADCAST_ROWS = 1_000_000


def few(numbers: DataFrame) -> DataFrame:
    """A staged table of one or two numbers a row, broadcast if it is small; beyond that size
    a join with it shuffles both sides."""
    return F.broadcast(numbers) if numbers.count() <= BROADCAST_ROWS else numbers


def changed_rows(docs: DataFrame, changes: DataFrame, change) -> DataFrame:
    """``docs`` with ``change(rows)`` for the rows that ``changes`` has, and the others as they are.

    ``changes`` is staged and has each ``row``, a row's place in the stored table ``docs``, once.
    ``change`` gets those rows with the columns of ``docs`` and of ``changes``, of which it may
    drop some. Only rows that change are shuffled. Column names: ``changes`` must use names
    that ``docs`` has not, but for ``row``, which becomes free here.
    """
    steady_places(docs.sparkSession)
    place = free_name(docs, "row")
    numbered = docs.withColumn(place, F.monotonically_increasing_id())
    changes = changes.withColumnRenamed("row", place)
    touched = few(changes.select(place))
    rows = numbered.join(touched, place, "left_semi").join(changes, place)
    same = numbered.join(touched, place, "left_anti")
    return same.select(*docs.columns).unionAll(change(rows).select(*docs.columns))


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` but for the rows whose place is in ``gone`` (row); all columns stay.

    ``docs`` is a stored table, in which a row's place does not change. ``gone`` should be
    staged: its true size decides whether it is broadcast.
    """
    steady_places(docs.sparkSession)
    place = free_name(docs, "row")
    numbered = docs.withColumn(place, F.monotonically_increasing_id())
    return numbered.join(gone.select(F.col("row").alias(place)), place, "left_anti").select(*docs.columns)


def crc_bucket(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; a null key counts as empty text."""
    return (F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts).cast("int")


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """A text column with nulls as empty texts."""
    return [text or "" for text in batch.column(column).to_pylist()]


def list_array(values: np.ndarray, lengths, kind: pa.DataType) -> pa.ListArray:
    """One list per length out of the values that lie one after the other."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def pieces(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``rows`` rows."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


# --- 64-bit hashes of words, computed for a whole batch of texts at once ----

MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finalizer of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_A
    x = x ^ (x >> np.uint64(27))
    x = x * MIX_B
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER_CASE = np.arange(256, dtype=np.uint8)
LOWER_CASE[65:91] += 32
# A random value per byte; in the second, upper and lower case A-Z have the same.
_EXACT = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LETTER = _EXACT[LOWER_CASE]
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_CHUNK = 1 << 17
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of an odd number, modulo 2**64."""
    if len(_powers.get(base, ())) < n:
        grown = np.full(max(n, _CHUNK), base, np.uint64)
        grown[0] = 1
        _powers[base] = np.multiply.accumulate(grown)
    return _powers[base][:n]


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of bytes other than white space."""
    space = np.ones(len(raw) + 2, bool)
    space[1:-1] = _SPACE[raw]
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[::2], edges[1::2]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """Hash of each word: a polynomial over its bytes, with ``lower`` letters A-Z in lower case.

    The sum over a word is the difference of two running sums, divided by the power at
    which the word begins. Words are taken in chunks of about 64 KB, so that memory
    follows the longest word, not the text.
    """
    letter = _LETTER if lower else _EXACT
    out, first = np.empty(len(starts), np.uint64), 0
    while first < len(starts):
        begin = starts[first]
        last = max(first + 1, int(np.searchsorted(starts, begin + _CHUNK // 2)))
        part = raw[begin : ends[last - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(letter[part] * _power(_BASE, len(part)), out=sums[1:])
        at, to = starts[first:last] - begin, ends[first:last] - begin
        word = (sums[to] - sums[at]) * _power(_INVERSE, len(part))[at]
        out[first:last] = mix(word + (to - at).astype(np.uint64))
        first = last
    return out


class WordBatch:
    """Words of a batch of texts: hashes in one array, and where each text begins."""

    def __init__(self, texts: list[str], hashed: bool = True):
        parts = [text.encode("utf-8", "surrogatepass") for text in texts]
        self.raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        self.starts, self.ends = word_spans(self.raw)
        if hashed:
            self.hashes = word_hashes(self.raw, self.starts, self.ends)
        ends = np.cumsum([len(part) + 1 for part in parts])
        #: Words of text i: first[i] up to first[i + 1].
        self.first = np.concatenate([[0], np.searchsorted(self.starts, ends)]).astype(np.int64)
