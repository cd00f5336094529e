"""Similarity of queries to a corpus: sparse by term, dense by blocks."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wherewords.functions import scalars
from wherewords.session import stage

# Numbers (rows x dimensions) up to which a dense corpus is broadcast: 64 MB of doubles.
BROADCAST_NUMBERS = 8_000_000


def score_pairs(queries: DataFrame, corpus: DataFrame, query: str, doc: str) -> DataFrame:
    """Cosine of every query with every corpus document that shares a term.

    Both sides are unit TF-IDF rows (key, term, weight). An equi join on the
    term: the corpus is broadcast if it is small, and a hot term is split by
    AQE if it is not, since the sum regroups by query anyway.
    """
    shared = queries.alias("q").join(corpus.alias("c"), "term")
    product = F.col("q.weight") * F.col("c.weight")
    return shared.groupBy(f"q.{query}", f"c.{doc}").agg(F.sum(product).alias("score"))


def best_in_blocks(
    points: DataFrame,
    table: DataFrame,
    id_col: str,
    vec: str,
    key: str,
    table_vec: str,
    badness: Callable[[Column, Column], Column],
    k: int = 1,
    block_rows: int = 512,
) -> DataFrame:
    """The ``k`` table rows with the least badness for each point.

    The table is packed into blocks of about ``block_rows`` vectors and a point
    meets each block once, keeping ``k`` rows per block: no row per pair is ever
    produced. Adds ``ranked``, an array of (badness, key), best first, ties by key.
    """
    table = stage(table.select(F.col(key).alias("key"), F.col(table_vec).alias("vec")), "dense")
    rows, width = table.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    n_blocks = max(1, ceil(rows / block_rows))
    blocks = table.groupBy(F.pmod(F.xxhash64("key"), F.lit(n_blocks)).alias("_block")).agg(
        F.collect_list(F.struct("key", "vec")).alias("_members")
    )
    if rows * width <= BROADCAST_NUMBERS:
        blocks = F.broadcast(blocks)
    met = points.withColumn(
        "_block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<bigint>"))
    ).join(blocks, "_block")
    rated = F.transform(
        "_members",
        lambda m: F.struct(badness(F.col(vec), m["vec"]).alias("badness"), m["key"].alias("key")),
    )
    met = met.withColumn("ranked", F.slice(F.array_sort(rated), 1, k)).drop("_members", "_block")
    if n_blocks == 1:
        return met
    merged = met.groupBy(id_col).agg(F.flatten(F.collect_list("ranked")).alias("ranked"))
    merged = merged.withColumn("ranked", F.slice(F.array_sort("ranked"), 1, k))
    return points.join(merged, id_col)


def nearest_by_cosine(
    queries: DataFrame, corpus: DataFrame, query: str, doc: str, vec: str, k: int, digits: int = 9
) -> DataFrame:
    """(query, doc, score, rank): the ``k`` corpus vectors with the largest
    cosine; it is rounded to ``digits`` first, so that ties are real."""

    def badness(a: Column, b: Column) -> Column:
        return -F.round(scalars.cosine(a, b), digits)

    ranked = best_in_blocks(queries, corpus, query, vec, doc, vec, badness, k)
    return ranked.select(query, F.posexplode("ranked").alias("_pos", "_hit")).select(
        query,
        F.col("_hit.key").alias(doc),
        (-F.col("_hit.badness")).alias("score"),
        (F.col("_pos") + 1).alias("rank"),
    )
