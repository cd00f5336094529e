"""Aggregates: country profiles, counts, weights and accuracy measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wherewords.session import stage


def group_counts(df: DataFrame, key: str, min_count: int | None = None) -> DataFrame:
    """Rows per key; with ``min_count``, only keys with more rows than that."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return counts if min_count is None else counts.filter(F.col("n") > min_count)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def null_profile(df: DataFrame) -> DataFrame:
    """Number of nulls per column, one row."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])


def mean(col: str) -> Column:
    return F.avg(col)


def median(col: str) -> Column:
    """Exact median. Its state holds the distinct values of a group, so use it on
    columns with few of them, such as the 86,400 seconds of a day."""
    return F.median(col)


def centroid(lon: str, lat: str) -> list[Column]:
    return [F.avg(lon).alias("lon"), F.avg(lat).alias("lat")]


def centroid_of(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.filter(F.col(key) == value).agg(*centroid("lon", "lat"))


def mode_first(df: DataFrame, key: str, cols: list[str], order: str) -> DataFrame:
    """The most common value of each column per key; of equally common ones, the
    one met first by ``order``. Nulls do not count.

    All columns are counted in one pass: (key, column, value) first, so that a
    hot key is already small when its values are compared.
    """
    entries = F.array(
        *[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in cols]
    )
    counts = (
        df.select(key, order, F.explode(entries).alias("entry"))
        .select(key, order, "entry.*")
        .filter(F.col("value").isNotNull())
        .groupBy(key, "name", "value")
        .agg(F.count("*").alias("n"), F.min(order).alias("first"))
    )
    rank = F.struct(F.col("n"), -F.col("first"))
    return counts.groupBy(key).agg(
        *[
            F.max_by("value", F.when(F.col("name") == c, rank)).cast(df.schema[c].dataType).alias(c)
            for c in cols
        ]
    )


def join_text(
    df: DataFrame, key: str, cols: list[str], order: str, sep: str = " ", chunk: int = 256
) -> DataFrame:
    """Texts of a key joined in the order of a unique integer column.

    The joined text comes in pieces (``key``, ``piece``), each of at most
    ``chunk`` rows; the pieces of a key in order are its whole text. A key that
    holds a third of all rows thus never becomes one value in one task.
    """
    pieces = df.withColumn("piece", F.floor(F.col(order) / chunk).cast("bigint"))
    quoted = sep.replace("'", "''")
    joined = [
        F.expr(f"listagg({c}, '{quoted}') WITHIN GROUP (ORDER BY {order})").alias(c) for c in cols
    ]
    return pieces.groupBy(key, "piece").agg(F.count("*").alias("n_rows"), *joined)


def profile(df: DataFrame, key: str = "place_country", order: str = "tweet_id") -> DataFrame:
    """One row per key: the dominant language, source and UTC offset, mean
    followers and friends, median second of the day, mean position.

    The texts of a key are not part of the row: they are the long tables of
    ``words.term_counts``, or the pieces of :func:`join_text`.
    """
    numbers = df.groupBy(key).agg(
        F.count("*").alias("n_rows"),
        mean("user_followers_count").alias("user_followers_count"),
        mean("user_friends_count").alias("user_friends_count"),
        median("seconds").alias("seconds"),
        *centroid("lon", "lat"),
    )
    modes = mode_first(df, key, ["user_lang", "source", "user_utc_offset"], order)
    return numbers.filter(F.col(key).isNotNull()).join(modes, key, "left")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight n / (k * n_label) per label."""
    counts = stage(
        df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n_label")),
        "label-counts",
    )
    total = counts.agg((F.sum("n_label") / F.count("*")).alias("balanced_size")).scalar()
    return counts.select(label, "n_label", (total / F.col("n_label")).alias("weight"))


def with_class_weight(df: DataFrame, label: str) -> DataFrame:
    """Rows with the weight of their label."""
    return df.join(class_weights(df, label).select(label, "weight"), label)


def exact_accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.agg(
        F.count_if(F.col(actual) == F.col(predicted)).alias("correct"),
        F.count("*").alias("total"),
    )


def candidate_accuracy(df: DataFrame, actual: str, candidates: str) -> DataFrame:
    """How many rows have the actual value among their candidates."""
    return df.agg(
        F.count_if(F.array_contains(candidates, F.col(actual))).alias("correct"),
        F.count("*").alias("total"),
    )


def hit_rate(df: DataFrame, actual: str, ranked: str, k: int = 5) -> DataFrame:
    """Share of rows with the actual value in the first ``k`` of a ranked array."""
    hit = F.array_contains(F.slice(ranked, 1, k), F.col(actual))
    return df.agg(F.avg(F.coalesce(hit, F.lit(False)).cast("double")).alias("hit_rate"))
