"""Exact duplicates by a tree merge of sorted digest runs.

Each input partition sorts its digests into a run with one entry per digest. In
binomial rounds the runs of partitions that differ in one digit of their number are
exchanged: an entry moves to the partition whose digit is that of the entry's target,
and the runs that meet there are merged. After the last round each digest lies at its
target with the smallest identifier of all its rows. A digest is held at most once per
run, so that a text with any number of copies is at most ``fan_in`` entries at a merge.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wherewords.llm.tables import list_array, small_batches, table
from wherewords.session import stage

#: Same text only if all three agree: a digest alone never merges two entries.
IDENTITY = ["digest", "n_bytes", "check"]
ENTRY = "digest binary, n_bytes int, check bigint, best_chars int, best_id bigint, best_row bigint, n bigint"


def best() -> list[Column]:
    """The first entry of an identity in this order stays."""
    return [F.col("best_chars").desc(), F.col("best_id").asc_nulls_last(), F.col("best_row").asc()]


def without_space(text: Column) -> Column:
    """The text without blanks, tabs and line ends; a null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def _heads(batch: pa.RecordBatch) -> np.ndarray:
    """Rows of a sorted batch at which a new identity begins."""
    # Digests have one length, so they lie in the buffer without gaps.
    digest = batch.column("digest")
    width = len(digest[0].as_py())
    raw = np.frombuffer(digest.buffers()[2], np.uint8)[digest.offset * width :][: len(digest) * width]
    keys = [raw.reshape(-1, width)]
    keys += [batch.column(name).to_numpy().reshape(-1, 1) for name in IDENTITY[1:]]
    new = np.ones(len(digest), bool)
    new[1:] = False
    for key in keys:
        new[1:] |= (key[1:] != key[:-1]).any(axis=1)
    return np.flatnonzero(new)


def leaf_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of a sorted partition with their members. A digest that goes on in the
    next batch gets another entry, which the first merge joins."""
    for batch in batches:
        if not batch.num_rows:
            continue
        heads = _heads(batch)
        counts = np.diff([*heads, batch.num_rows])
        first = batch.take(pa.array(heads))
        offsets = pa.array(np.append(heads, batch.num_rows).astype(np.int32))
        members = pa.StructArray.from_arrays(
            [batch.column("best_id"), batch.column("best_row")], ["id", "row"]
        )
        yield pa.RecordBatch.from_arrays(
            [*first.columns[:6], pa.array(counts, pa.int64()), pa.ListArray.from_arrays(offsets, members)],
            [*first.schema.names[:6], "n", "members"],
        )


def merged_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One entry per identity of a sorted partition: the first, with the counts added."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        heads = _heads(batch)
        sums = np.add.reduceat(batch.column("n").to_numpy(), heads)
        first = batch.take(pa.array(heads))
        entries = pa.RecordBatch.from_arrays(
            [*first.columns[:6], pa.array(sums, pa.int64())], batch.schema.names[:7]
        )
        # The last identity may go on in the next batch.
        held = entries.slice(entries.num_rows - 1)
        yield entries.slice(0, entries.num_rows - 1)
    if held is not None:
        yield held


def tree_merge(runs: DataFrame, leaves: int, fan_in: int) -> DataFrame:
    """One entry per identity of all runs, merged in rounds of at most ``fan_in`` runs."""
    rounds = max(1, math.ceil(math.log(max(leaves, 2)) / math.log(fan_in)))
    digits = max(2, math.ceil(leaves ** (1 / rounds) - 1e-9))
    nodes = digits**rounds
    held = runs.withColumn("node", F.shiftright("best_row", 33).cast("int"))
    target = F.pmod("check", F.lit(nodes))
    for level in range(rounds):
        weight = digits**level

        def digit(node):
            return F.floor(node / weight) % digits

        # Later levels may have moved to another best row: the run's place is kept apart.
        moved = held.withColumn(
            "node", (F.col("node") + (digit(target) - digit(F.col("node"))) * weight).cast("int")
        )
        order = ["node", *IDENTITY, *best()]
        met = moved.repartitionById(nodes, "node").sortWithinPartitions(*order)
        columns = [part.split()[0] for part in ENTRY.split(", ")]
        held = met.select(*columns).mapInArrow(merged_run, ENTRY)
        held = held.withColumn("node", F.spark_partition_id())
    return held.drop("node")


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", fan_in: int = 8) -> DataFrame:
    """One row per input row: (key, keep_id, group_size, kept, text_sha256).

    Rows are in one group if their texts are equal without white space. Of a group the
    row with the most code points stays, then the smallest key, then the first row read;
    null keys come last. A null text counts as empty; an empty table gives no rows;
    other columns are not read. Rows repeated as a whole: exactly one is kept.
    """
    small_batches(docs.sparkSession)
    bare = without_space(F.col(text))
    rows = docs.select(F.col(key).cast("bigint").alias("best_id"), text).select(
        F.unhex(F.sha2(bare, 256)).alias("digest"),
        F.octet_length(bare).alias("n_bytes"),
        F.xxhash64(bare).alias("check"),
        F.coalesce(F.char_length(text), F.lit(0)).alias("best_chars"),
        "best_id",
        F.monotonically_increasing_id().alias("best_row"),
    )
    run = rows.sortWithinPartitions(*IDENTITY, *best())
    leaves = stage(
        run.mapInArrow(leaf_runs, f"{ENTRY}, members array<struct<id:bigint,row:bigint>>"), "digest-runs"
    )
    last = leaves.agg(F.max(F.shiftright("best_row", 33))).first()[0]
    merged = tree_merge(leaves.drop("members"), (last or 0) + 1, fan_in)
    winners = merged.select(
        *IDENTITY, F.col("best_id").alias("keep_id"), F.col("best_row").alias("keep_row"),
        F.col("n").alias("group_size"),
    )
    return (
        leaves.select(*IDENTITY, "members")
        .join(winners, IDENTITY)
        .select("*", F.explode("members").alias("member"))
        .select(
            F.col("member.id").alias(key), "keep_id", "group_size",
            (F.col("member.row") == F.col("keep_row")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def op2_exact_dedup(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents"))


SQL = r"""
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER w = 1 AS kept, text_sha256
FROM (SELECT doc_id, length(coalesce(text, '')) AS chars,
        sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)"""
