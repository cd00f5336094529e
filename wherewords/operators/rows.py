"""Row operators: projections, filters, splits, samples, sorts, set operations."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wherewords.functions import scalars, text
from wherewords.session import stage
from wherewords.sources.files import union_all  # noqa: F401  (the union operator)


def select_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols)


def drop_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.drop(*cols)


def with_text_columns(df: DataFrame) -> DataFrame:
    """The text columns derived from a message: tags, names, clean text, seconds of day."""
    return df.withColumns(
        {
            "hashtags": text.hashtags(F.col("text")),
            "mentions": text.mentions(F.col("text")),
            "clean_text": text.clean_text(F.col("text")),
            "seconds": scalars.seconds_of_day(F.col("created_at")),
        }
    )


def drop_all_null(df: DataFrame) -> DataFrame:
    return df.na.drop("all")


def keep_not_null(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col).isNotNull())


def to_number(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns as double; a value that is no number becomes null."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in cols})


def null_text(df: DataFrame, col: str, nan_compat: bool = False) -> DataFrame:
    return df.withColumn(col, text.null_text(F.col(col), nan_compat))


def canonical_lang(df: DataFrame, lang_map: DataFrame, col: str = "user_lang") -> DataFrame:
    """Language codes replaced by the code they count as; others stay."""
    return (
        df.join(lang_map.withColumnRenamed("raw", col), col, "left")
        .withColumn(col, F.coalesce("canonical", col))
        .drop("canonical")
        .select(*df.columns)
    )


def fill_conditional(
    df: DataFrame, langs: list[str], default: str, out: str = "filled"
) -> DataFrame:
    """The clean text for some languages, a default for all others and for empty text."""
    keep = F.col("user_lang").isin(langs) & (F.col("clean_text") != "")
    return df.withColumn(out, F.when(keep, F.col("clean_text")).otherwise(F.lit(default)))


def with_row_id(df: DataFrame, order_by: str, buckets: int = 1000) -> DataFrame:
    """Positions 0..n-1 by a unique numeric column, without one task seeing all rows.

    Approximate quantiles cut the column into ``buckets`` ranges of about equal
    size; each range is numbered on its own and shifted by the rows before it.
    """
    shares = [i / buckets for i in range(1, buckets)]
    # Neither an empty table nor one bucket has quantiles; the Bucketizer needs a cut.
    ready = shares and not df.isEmpty()
    cuts = df.approxQuantile(order_by, shares, 0.1 / buckets) if ready else []
    splits = [float("-inf"), *sorted(set(cuts) or {0.0}), float("inf")]
    ranged = Bucketizer(splits=splits, inputCol="_order", outputCol="_range").transform(
        df.withColumn("_order", F.col(order_by).cast("double"))
    )
    before = (
        ranged.groupBy("_range")
        .agg(F.count("*").alias("_rows"))
        # One row per range, at most ``buckets`` of them.
        .withColumn("_before", F.sum("_rows").over(Window.orderBy("_range")) - F.col("_rows"))
    )
    position = F.row_number().over(Window.partitionBy("_range").orderBy(order_by))
    return (
        ranged.withColumn("_position", position)
        .join(before, "_range")
        .withColumn("row_id", F.col("_before") + F.col("_position") - 1)
        .select(*df.columns, "row_id")
    )


def resume_after(df: DataFrame, order_by: str, label: str, start: int) -> DataFrame:
    """Rows from the one labelled ``start`` on, in the order of ``order_by``."""
    first = df.filter(F.col(label) == start).agg(F.min(order_by)).scalar()
    return df.filter(F.col(order_by) >= first)


def column_values(df: DataFrame, col: str) -> DataFrame:
    """One column, kept as a table."""
    return df.select(col)


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def rows_of_group(df: DataFrame, key: str, values: list) -> DataFrame:
    return df.filter(F.col(key).isin(values))


def sort_by(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.orderBy(*cols)


def sort_by_score(df: DataFrame, score: str, key: str) -> DataFrame:
    return df.orderBy(F.desc(score), F.asc(key))


def first_n(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first ``n`` rows by a total order (a small ``n``: the result is one partition)."""
    return df.orderBy(*order).limit(n)


def shuffle(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows in an order that depends on the key and the seed only."""
    return df.orderBy(scalars.hash_number(F.col(key), seed), key)


def is_holdout(key: Column, share: float, seed: int | None = None) -> Column:
    """True for about ``share`` of the keys, the same ones in every run."""
    return scalars.hash_number(key, seed) < int(share * 2**32)


def holdout(df: DataFrame, key: str, share: float = 0.2, seed: int | None = None) -> DataFrame:
    """The held-out rows; a filter on the key's hash, so there is no shuffle."""
    return df.filter(is_holdout(F.col(key), share, seed))


def split(
    df: DataFrame, key: str, test_share: float = 0.2, seed: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(training rows, test rows), disjoint and complete."""
    test = is_holdout(F.col(key), test_share, seed)
    return df.filter(~test), df.filter(test)


def half_split(df: DataFrame, key: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """(base half, meta half) by the parity of the seeded hash."""
    odd = scalars.hash_bucket(F.col(key), 2, seed) == 1
    return df.filter(~odd), df.filter(odd)


def exact_holdout(
    df: DataFrame, key: str, share: float = 0.2, seed: int | None = None
) -> DataFrame:
    """Exactly ``int(share * n)`` rows: those with the smallest key hashes.

    A histogram over the upper 16 bits of the hash finds the bucket in which the
    count is reached; only that bucket, 1/65536 of the rows, is ranked.
    """
    hashed = df.withColumn("_hash", scalars.hash_number(F.col(key), seed)).withColumn(
        "_bucket", F.shiftright("_hash", 16)
    )
    running = F.sum("_rows").over(Window.orderBy("_bucket"))
    histogram = (
        hashed.groupBy("_bucket")
        .agg(F.count("*").alias("_rows"))
        .withColumn("_running", running)
        .withColumn("_wanted", F.floor(F.lit(share) * F.sum("_rows").over(Window.partitionBy())))
    )
    cut = stage(
        histogram.filter(
            (F.col("_running") >= F.col("_wanted"))
            & (F.col("_running") - F.col("_rows") < F.col("_wanted"))
        ).select("_bucket", (F.col("_wanted") - F.col("_running") + F.col("_rows")).alias("_take")),
        "holdout-cut",
    )
    bucket, take = cut.select("_bucket").scalar(), cut.select("_take").scalar()
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy("_hash", key))
    whole = hashed.filter(F.col("_bucket") < bucket)
    partial = hashed.filter(F.col("_bucket") == bucket).withColumn("_rank", rank)
    return whole.select(*df.columns).unionAll(
        partial.filter(F.col("_rank") <= take).select(*df.columns)
    )


def complement(df: DataFrame, sample: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the sample."""
    return df.join(sample.select(key), key, "left_anti")
