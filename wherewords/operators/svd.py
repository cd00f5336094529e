"""The largest singular values and vectors of a long table, by a randomized block method.

The matrix is (row, col, value) and stays a table. A few random directions are multiplied by
it and its transpose in turn, as joins and sums of short vectors; in between, they are made
orthonormal by their Gram matrix, which alone passes the driver: ``k + OVERSAMPLE`` numbers
squared, whatever the size of the matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wherewords.session import stage

OVERSAMPLE, POWERS = 30, 3
# Directions whose share of the largest square is smaller are rounding errors.
LEAST_SHARE = 1e-12


def _product(cells: DataFrame, key: str, over: str, vectors: DataFrame) -> DataFrame:
    """(key, vector): the sums of value times the vector of the other side, partly in the map tasks."""
    scaled = F.transform("vector", lambda x: x * F.col("value"))
    sums = cells.join(vectors, over).groupBy(key).agg(Summarizer.sum(array_to_vector(scaled)).alias("sum"))
    return stage(sums.select(key, vector_to_array("sum").alias("vector")), "directions")


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("vector").flatten().to_numpy().reshape(batch.num_rows, -1)


def _gram(vectors: DataFrame) -> np.ndarray:
    """The vectors' products with each other, summed over all rows, within the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [x.T @ x for x in (_rows(batch) for batch in batches if batch.num_rows)]
        if sums:
            yield pa.RecordBatch.from_pydict({"gram": pa.array([sum(sums).reshape(-1)], pa.list_(pa.float64()))})

    parts = vectors.select("vector").mapInArrow(run, "gram array<double>")
    whole = parts.agg(Summarizer.sum(array_to_vector("gram")).alias("sum")).first()["sum"].toArray()
    return whole.reshape(round(len(whole) ** 0.5), -1)


def _turned(vectors: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Each row's vector times a small matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                turned = _rows(batch) @ matrix
                offsets = np.arange(len(turned) + 1, dtype=np.int32) * matrix.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(turned.reshape(-1)))
                yield batch.set_column(batch.schema.get_field_index("vector"), "vector", lists)

    return vectors.mapInArrow(run, vectors.schema)


def _orthonormal(vectors: DataFrame) -> DataFrame:
    """The same space by vectors of length one at right angles; null directions are dropped."""
    values, turns = np.linalg.eigh(_gram(vectors))
    real = values > LEAST_SHARE * max(values[-1], 0.0)
    return _turned(vectors, turns[:, real] / np.sqrt(values[real]))


def block_svd(cells: DataFrame, row: str, col: str, value: str, k: int, seed: int = 1, powers: int = POWERS) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """(left, values, right): (row, vector), the singular values, (col, vector); up to ``k`` of
    them, largest first. An empty or zero table has none."""
    cells = cells.select(F.col(row).alias("_row"), F.col(col).alias("_col"), F.col(value).cast("double").alias("value"))
    cells = cells.filter(F.col("value").isNotNull() & (F.col("value") != 0))
    width = F.sequence(F.lit(0), F.lit(k + OVERSAMPLE - 1))
    random = F.transform(width, lambda j: F.xxhash64(F.col("_col").cast("string"), j, F.lit(seed)).cast("double") / 2.0**63)
    start = cells.select("_col").distinct().select("_col", random.alias("vector"))
    left = _product(cells, "_row", "_col", start)
    if left.isEmpty():
        none = start.withColumnRenamed("_col", col)
        return left.withColumnRenamed("_row", row), np.zeros(0), none
    left = _orthonormal(left)
    # With a direction for every column the space is complete, and one turn is enough.
    columns = start.limit(k + OVERSAMPLE + 1).count()
    for _ in range(powers if columns > k + OVERSAMPLE else 0):
        right = _orthonormal(_product(cells, "_col", "_row", left))
        left = _orthonormal(_product(cells, "_row", "_col", right))
    right = _product(cells, "_col", "_row", left)
    squares, turns = np.linalg.eigh(_gram(right))
    largest = [i for i in np.argsort(-squares)[:k] if squares[i] > LEAST_SHARE * squares.max()]
    values, turns = np.sqrt(squares[largest]), turns[:, largest]
    return (
        _turned(left, turns).withColumnRenamed("_row", row), values, _turned(right, turns / values).withColumnRenamed("_col", col),
    )
