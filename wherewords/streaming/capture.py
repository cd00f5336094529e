"""Capture of message streams: region filter, cap per country, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from wherewords.operators.regions import tag_region
from wherewords.operators.windows import cap_per_key

CORRUPT = "_corrupt_record"


def read_tweet_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    fmt: str = "json",
    max_files: int = 100,
    keep_bad_rows: bool = False,
) -> DataFrame:
    """Messages from files arriving in a folder, ``max_files`` per batch.

    With ``keep_bad_rows`` a line that is no valid JSON gives a row with the line
    in ``_corrupt_record``.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if keep_bad_rows:
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if fmt == "json":
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    return reader.format(fmt).load(path)


def write_capture_stream(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    partition_by: str | None = None,
    fmt: str = "json",
) -> DataStreamWriter:
    """Appending file sink, one message per line; a folder per country if asked.

    Rows of a country are not gathered for it: each task writes its own file.
    """
    writer = (
        stream.writeStream.format(fmt)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    return writer.partitionBy(partition_by) if partition_by else writer


def run_available(writer: DataStreamWriter) -> StreamingQuery:
    """Process what is there, then stop."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def write_capped_stream(
    stream: DataFrame,
    key: str,
    n: int,
    path: str,
    checkpoint: str,
    fmt: str = "json",
    order: list[str] | None = None,
) -> DataStreamWriter:
    """File sink with at most ``n`` messages per key over the life of the stream, a folder per
    batch and key.

    The only state is a ledger beside the checkpoint: how many messages each key has had up to a
    batch. A batch drops the rows of full keys, ranks the others within their key by
    ``order``, or by their hash, and writes those there is room for, then the ledger. Both are
    folders of the batch, so a batch that is repeated after a failure overwrites them with the
    same rows. Ranks are taken per (key, salt) first, so that no task has all rows of a hot key.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        spark, ledger = batch.sparkSession, f"{checkpoint}/ledger"
        kind = batch.schema[key].dataType.simpleString()
        kept = f"`{key}` {kind}, _kept bigint"
        # The latest entry is enough, as it counts from the beginning.
        before = spark.read.schema(kept).parquet(f"{ledger}/batch={batch_id - 1}") if batch_id else spark.createDataFrame([], kept)
        before = before.withColumnRenamed(key, "_key")
        same = F.col(key).eqNullSafe(F.col("_key"))
        open_ = batch.join(before, same, "left").filter(F.coalesce("_kept", F.lit(0)) < n)
        ranked = cap_per_key(
            open_.withColumn("_order", F.xxhash64(*batch.columns)), key, n, order or ["_order"]
        )
        rank = F.row_number().over(Window.partitionBy(key).orderBy(*(order or ["_order"])))
        passed = ranked.withColumn("_place", rank).filter(F.col("_place") + F.coalesce("_kept", F.lit(0)) <= n)
        out = f"{path}/batch={batch_id}"
        passed.select(*batch.columns).write.mode("overwrite").partitionBy(key).format(fmt).save(out)
        new = spark.read.schema(batch.schema).format(fmt).load(out).groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_kept"))
        total = before.unionAll(new).groupBy("_key").agg(F.sum("_kept").alias("_kept"))
        total.withColumnRenamed("_key", key).write.mode("overwrite").parquet(f"{ledger}/batch={batch_id}")

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)


def running_count(stream: DataFrame, key: str) -> DataFrame:
    """Messages per key so far; for ``update`` or ``complete`` output."""
    return stream.groupBy(key).agg(F.count("*").alias("n"))


def capture_regions(
    stream: DataFrame,
    boxes: DataFrame,
    path: str,
    checkpoint: str,
    cap: int = 5000,
    fmt: str = "json",
) -> DataStreamWriter:
    """All countries at once: tag each message with the countries around it, cap
    every country, write a folder per batch and country."""
    return write_capped_stream(tag_region(stream, boxes), "country", cap, path, checkpoint, fmt)


def route_bad_rows(
    stream: DataFrame, good_path: str, side_path: str, checkpoint: str
) -> DataStreamWriter:
    """Good rows to one folder, unreadable lines to another.

    Each batch overwrites its own sub-folder, so that a repeated batch after a
    failure leaves no duplicates.
    """

    def route(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            bad = F.col(CORRUPT).isNotNull()
            batch.filter(~bad).drop(CORRUPT).write.mode("overwrite").json(
                f"{good_path}/batch={batch_id}"
            )
            batch.filter(bad).select(F.col(CORRUPT).alias("line")).write.mode("overwrite").json(
                f"{side_path}/batch={batch_id}"
            )
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(route).option("checkpointLocation", checkpoint)
