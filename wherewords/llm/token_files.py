"""Token ids in Parquet lists, written in key order and read back by column.

One file per range of keys. Ids are a list column, dictionary-encoded or delta-packed;
row groups and pages are bounded, and the page index lets a reader skip to the rows of a
key range. Lengths and starts are plain columns, so metadata is read without the ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wherewords.llm.encode import read_tokenizer, worker_encoder
from wherewords.llm.tables import list_array, pieces, small_batches, table, texts_of
from wherewords.session import staged_path

#: ``part`` counts the files in key order; ``part_start`` is the ids before the row in its file.
SCHEMA = "key bigint, part int, part_start bigint, n_tokens int, tokens array<int>"
ENCODE_ROWS = 1000


def encoded_rows(broadcast, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before = worker_encoder(broadcast.value), 0
        part = TaskContext.get().partitionId()
        for big in batches:
            for batch in pieces(big, ENCODE_ROWS):
                ids, lengths = encoder.encode(texts_of(batch, "text"), end_id)
                starts = before + np.cumsum(lengths) - lengths
                before += int(lengths.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key"), pa.array(np.full(len(lengths), part, np.int32)), pa.array(starts),
                        pa.array(lengths.astype(np.int32)),
                        list_array(ids.view(np.int32), lengths, pa.int32()),
                    ],
                    ["key", "part", "part_start", "n_tokens", "tokens"],
                )

    return run


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer_json: str,
    end_id: int,
    key: str = "doc_id",
    text: str = "text",
    encoding: str = "dictionary",
    row_group_bytes: int = 32 << 20,
    page_rows: int = 2000,
) -> None:
    """Writes one row per input row in ascending key order, null keys first, then by text.

    A null or empty text has the end id alone. ``encoding`` is ``dictionary`` or ``delta``.
    Rows repeated as a whole are written as often as they occur; other columns are left
    out; an empty table gives files without rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding!r}")
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("key").sortWithinPartitions("key", "text")
    encoded = ordered.mapInArrow(encoded_rows(spark.sparkContext.broadcast(tokenizer_json), end_id), SCHEMA)
    (
        encoded.write.option("compression", "zstd")
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .parquet(path)
    )


def token_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(key, part, start, n_tokens): ``start`` counts the ids of all rows before. Reads no ids."""
    rows = spark.read.schema(SCHEMA).parquet(path).select("key", "part", "part_start", "n_tokens")
    return _with_start(rows, rows)


def _with_start(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    # One row per file.
    parts = metadata.groupBy("part").agg(F.sum("n_tokens").alias("ids"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("part", F.coalesce(F.sum("ids").over(order), F.lit(0)).alias("before"))
    return rows.join(before, "part").withColumn("start", F.col("before") + F.col("part_start")).drop(
        "before", "part_start"
    )


def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("tokens")
        offsets = lists.offsets.to_numpy()
        raw = lists.values.to_numpy().astype("<u4", copy=False)
        sums = [zlib.crc32(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(name) for name in ("key", "part", "part_start")),
                pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, pa.int64()),
            ],
            ["key", "part", "part_start", "n_tokens", "ids_crc32"],
        )


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) out of the files: counts and sums of the ids read."""
    small_batches(spark)
    files = spark.read.schema(SCHEMA).parquet(path)
    found = files.select("key", "part", "part_start", "tokens").mapInArrow(
        checked, "key bigint, part int, part_start bigint, n_tokens bigint, ids_crc32 bigint"
    )
    return _with_start(found, files.select("part", "n_tokens")).select("key", "start", "n_tokens", "ids_crc32")


def op9_token_files(spark, sf_dir, tokenizer=None):
    path = staged_path(spark, "token-files")
    tokenizer_json = read_tokenizer(tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
    write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_json, end_id=0)
    return token_digests(spark, path).withColumnRenamed("key", "doc_id")
