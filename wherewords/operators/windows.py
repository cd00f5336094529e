"""Ranking inside groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cap_per_key(df: DataFrame, key: str, n: int, order: list[str], salts: int = 64) -> DataFrame:
    """The first ``n`` rows of each key by a total order.

    Ranked twice: within (key, salt), which spreads a hot key over ``salts``
    tasks and leaves at most ``salts * n`` of its rows, then within the key.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    for keys in ([key, "_salt"], [key]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        salted = salted.withColumn("_rank", rank).filter(F.col("_rank") <= n)
    return salted.select(*df.columns)


def top_k(scores: DataFrame, query: str, doc: str, score: str, k: int) -> DataFrame:
    """The ``k`` best documents of each query, ties by document; adds ``rank``."""
    best_first = Window.partitionBy(query).orderBy(F.desc(score), F.asc(doc))
    return scores.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)


def best_of(scores: DataFrame, query: str, doc: str, score: str) -> DataFrame:
    """The best document of each query, ties by document; combined before the shuffle."""
    rest = [c for c in scores.columns if c != query]
    best = F.min_by(F.struct(*rest), F.struct(-F.col(score), F.col(doc)))
    return scores.groupBy(query).agg(best.alias("best")).select(query, "best.*")


def ranked_docs(top: DataFrame, query: str, doc: str) -> DataFrame:
    """The output of :func:`top_k` as one array per query, best first."""
    pairs = F.array_sort(F.collect_list(F.struct("rank", doc)))
    return top.groupBy(query).agg(F.transform(pairs, lambda p: p[doc]).alias("ranked"))
