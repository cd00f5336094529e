"""Joins: membership filters and positional feature stacks."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wherewords.operators.aggregates import group_counts
from wherewords.operators.vocabulary import dense_ids
from wherewords.session import stage


def keep_frequent(df: DataFrame, key: str, min_count: int = 10) -> DataFrame:
    """Rows whose key occurs more than ``min_count`` times.

    The list of keys is staged, so the semi join is a broadcast if the list is
    small and the rows are not shuffled for it.
    """
    frequent = stage(group_counts(df, key, min_count).select(key), "frequent")
    return df.join(frequent, key, "left_semi")


def keep_known_lang(df: DataFrame, trained: DataFrame, col: str = "user_lang") -> DataFrame:
    """Rows whose language occurs in the training rows."""
    return df.join(stage(trained.select(col).distinct(), "languages"), col, "left_semi")


def one_hot(df: DataFrame, col: str, known: list[str], prefix: str = "lang_") -> DataFrame:
    """A 0/1 column per known value, on the same row; values outside give all 0. For values
    without a known bound take :func:`one_hot_cells` or :func:`one_hot_vector`."""
    return df.withColumns(
        {f"{prefix}{v}": F.coalesce(F.col(col) == v, F.lit(False)).cast("int") for v in known}
    )


def one_hot_vector(df: DataFrame, col: str, out: str) -> PipelineModel:
    """Stages that add the flags of a value as one sparse vector, however many values.

    The values of ``df`` are saved with the model; others, and nulls, give all 0.
    """
    index = f"{out}_index"
    indexer = StringIndexer(
        inputCol=col, outputCol=index, handleInvalid="keep", stringOrderType="alphabetAsc"
    )
    encoder = OneHotEncoder(inputCol=index, outputCol=out, dropLast=True)
    return Pipeline(stages=[indexer, encoder]).fit(df)


def one_hot_cells(df: DataFrame, key: str, col: str, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(values, cells): the distinct values numbered in their order, (col, id), and the flags
    that are one, (key, term, value) with the value's id as term; the others are not written.

    ``known`` are the values of training rows; others, and nulls, have no flag. However many
    values there are, none passes the driver and no plan grows with them.
    """
    values = stage(dense_ids(df, col), "flag-values") if known is None else known
    flags = df.select(key, col).join(values, col).select(key, F.col("id").alias("term"), F.lit(1.0).alias("value"))
    return values, flags


def stack_features(df: DataFrame, blocks: list[str], out: str = "features") -> DataFrame:
    """Numeric and vector columns of a row as one vector, in the given order."""
    return VectorAssembler(inputCols=blocks, outputCol=out, handleInvalid="keep").transform(df)
