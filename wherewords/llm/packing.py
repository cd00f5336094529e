"""Sequences of neighbouring documents along a space-filling curve.

A document's token ids are hashed features; their mean of fixed random vectors is a
point of a few dimensions. The points' places along a Hilbert curve are range-sorted, and
each range is cut into full sequences. What a range has left at its end is cut into
sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wherewords.llm.encode import read_tokenizer, worker_encoder
from wherewords.llm.tables import mix, pieces, small_batches, table, texts_of
from wherewords.session import stage

DIMS, BITS = 4, 12
#: Coordinates beyond this are cut: means of random signs over a text lie well inside.
REACH = 0.25
ENCODE_ROWS = 250


def signs(ids: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """A fixed random -1 or 1 per id and dimension."""
    hashed = mix(ids.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))
    bits = (hashed[:, None] >> np.arange(dims, dtype=np.uint64)) & np.uint64(1)
    return bits.astype(np.float32) * 2 - 1


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place along the Hilbert curve of points with integer coordinates below ``2**bits``.

    The usual state-free form: undo the excess rotations from the highest bit down, take
    the Gray code, interleave the bits.
    """
    axes = [points[:, d].astype(np.int64) for d in range(points.shape[1])]
    step = 1 << (bits - 1)
    while step > 1:
        low = step - 1
        for d in range(len(axes)):
            here = (axes[d] & step) != 0
            swap = np.where(here, 0, (axes[0] ^ axes[d]) & low)
            axes[0] = axes[0] ^ swap ^ np.where(here, low, 0)
            if d:
                axes[d] = axes[d] ^ swap
        step >>= 1
    for d in range(1, len(axes)):
        axes[d] = axes[d] ^ axes[d - 1]
    parity = np.zeros_like(axes[0])
    step = 1 << (bits - 1)
    while step > 1:
        parity ^= np.where((axes[-1] & step) != 0, step - 1, 0)
        step >>= 1
    key = np.zeros_like(parity)
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << 1) | (((axis ^ parity) >> bit) & 1)
    return key


def encoded_points(broadcast, end_id: int):
    """Ids of each document and its place along the curve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(broadcast.value)
        vectors = signs(np.arange(encoder.tokenizer.get_vocab_size() + end_id + 1))
        narrow = "<u2" if len(vectors) <= 1 << 16 else "<u4"
        for big in batches:
            for batch in pieces(big, ENCODE_ROWS):
                flat, lengths = encoder.encode(texts_of(batch, "text"), end_id)
                sums = np.add.reduceat(vectors[flat], np.cumsum(lengths) - lengths, axis=0)
                means = np.clip(sums / lengths[:, None] / REACH, -1, 1)
                grid = np.minimum(((means + 1) / 2 * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
                stored = flat.astype(narrow)
                ends = np.cumsum(lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key"), pa.array(hilbert_keys(grid)),
                        pa.array([stored[b - n : b].tobytes() for b, n in zip(ends, lengths, strict=True)], pa.binary()),
                    ],
                    ["key", "place", "ids"],
                )

    return run


def powers_of(length: int) -> list[int]:
    """The length as a sum of falling powers of two."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


def packed(width: int, sequence_tokens: int):
    """Pieces of a sorted partition. Holds the pieces of one open sequence at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        # Open sequence: (key, start, ids, tokens of the document) of each piece.
        waiting: list[tuple] = []
        filled, number = 0, 0
        for batch in batches:
            rows: list[tuple] = []
            for key, raw in zip(batch.column("key").to_pylist(), batch.column("ids"), strict=True):
                ids = np.frombuffer(raw.as_py(), f"<u{width}").astype("<u4")
                at = 0
                while at < len(ids):
                    take = min(len(ids) - at, sequence_tokens - filled)
                    waiting.append((key, at, ids[at : at + take], len(ids)))
                    at, filled = at + take, filled + take
                    if filled == sequence_tokens:
                        rows += _placed(waiting, [sequence_tokens], base + number)
                        waiting, filled, number = [], 0, number + 1
            yield _pieces_batch(rows)
        yield _pieces_batch(_placed(waiting, powers_of(filled), base + number))

    return run


def _placed(waiting: list[tuple], sizes: list[int], sequence: int) -> list[tuple]:
    """Rows of the waiting pieces, put into sequences of the given sizes."""
    rows, open_sizes, offset = [], list(sizes), 0
    for key, start, ids, total in waiting:
        at = 0
        while at < len(ids):
            take = min(len(ids) - at, open_sizes[0] - offset)
            part = ids[at : at + take]
            rows.append((key, start + at, take, zlib.crc32(part), total, sequence, offset))
            at, offset = at + take, offset + take
            if offset == open_sizes[0]:
                open_sizes.pop(0)
                sequence, offset = sequence + 1, 0
    return rows


#: Ids of a task, and stretches of the curve that they are counted in.
TASK_TOKENS, CURVE_BUCKETS = 2_000_000, 1 << 16
PIECES = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _pieces_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in PIECES]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], PIECES)


def _equal_ranges(points: DataFrame, task_bytes: int) -> DataFrame:
    """The rows dealt to ranges of the curve with about as many ids each.

    The curve is cut into :data:`CURVE_BUCKETS` stretches, whose ids are added up from its
    beginning; where the sum passes another ``task_bytes``, a task begins. A stretch with more
    than a task's share, as of copies, is dealt to as many tasks by hash.
    """
    size = F.octet_length("ids").cast("bigint")
    shape = points.agg(F.min("place").alias("low"), F.max("place").alias("high"), F.sum(size).alias("bytes")).first()
    if shape["low"] is None:
        return points
    tasks = max(1, -(-shape["bytes"] // task_bytes))
    stretch = (shape["high"] - shape["low"]) // CURVE_BUCKETS + 1
    bucket = F.floor((F.col("place") - shape["low"]) / F.lit(stretch)).cast("int")
    placed = points.withColumn("bucket", bucket)
    sums = placed.groupBy("bucket").agg(F.sum(size).alias("bytes"))
    before = F.sum("bytes").over(Window.orderBy("bucket")) - F.col("bytes")
    starts = stage(sums.select("bucket", before.alias("before"), "bytes"), "curve-stretches")
    chance = F.pmod(F.xxhash64("key", "ids"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    inside = F.when(F.col("bytes") > task_bytes, F.col("bytes") * chance).otherwise(0.0)
    task = F.least(F.floor((F.col("before") + inside) / task_bytes), F.lit(tasks - 1)).cast("int")
    # At most CURVE_BUCKETS rows of three numbers.
    return placed.join(F.broadcast(starts), "bucket").withColumn("task", task).repartitionById(tasks, "task").select(*points.columns)


def pack_documents(
    docs: DataFrame,
    tokenizer_json: str,
    end_id: int,
    key: str = "doc_id",
    text: str = "text",
    sequence_tokens: int = 4096,
) -> DataFrame:
    """One row per piece: (key, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Each id of each row, an end id included, lies in one piece; a null or empty text has
    the end id alone. Every sequence but the last ones of a range is full, and those are
    powers of two long. Ties along the curve go by key, then by ids; rows repeated as a
    whole are packed as often as they occur; null keys stay null; other columns are left
    out; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    points = stage(
        rows.mapInArrow(
            encoded_points(spark.sparkContext.broadcast(tokenizer_json), end_id),
            "key bigint, place bigint, ids binary",
        ),
        "packing-ids",
    )
    from tokenizers import Tokenizer

    most = Tokenizer.from_str(tokenizer_json).get_vocab_size() + end_id + 1
    width = 2 if most <= 1 << 16 else 4
    ranged = _equal_ranges(points, TASK_TOKENS * width).sortWithinPartitions("place", "key", "ids")
    kinds = ", ".join(f"{name} bigint" for name in PIECES)
    return ranged.select("key", "ids").mapInArrow(packed(width, sequence_tokens), kinds).withColumnRenamed("key", key)


def op10_packing(spark, sf_dir, tokenizer=None):
    tokenizer_json = read_tokenizer(tokenizer or public_tokenizers.path("word_bpe_49k.json"))
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_json, end_id=2)
