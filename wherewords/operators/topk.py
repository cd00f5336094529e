"""The best documents of sparse queries, by blocks of queries and groups of documents.

Terms and documents are numbered. A block of queries meets, for each of its terms, one list
of the documents of a group, so a list goes to a block once, however many of its queries
hold the term, and a query's products are added up where they are made: no row per pair of
query and document is ever written. Memory is bounded by a block's terms times a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wherewords.operators.blocks import BLOCK_ROWS, CELLS, renamed, sparse_rows
from wherewords.operators.vocabulary import dense_ids
from wherewords.session import stage

# Documents of a group.
GROUP_DOCS = 512
# Term of a cell that adds nothing, for queries without known terms.
NOTHING = -1


def half_up(values: np.ndarray, digits: int) -> np.ndarray:
    """Rounded as SQL does it."""
    return np.sign(values) * np.floor(np.abs(values) * 10.0**digits + 0.5) / 10.0**digits


def list_matrix(lists: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted terms, terms x documents) of rows (term, slots, weights)."""
    terms = lists["term"].to_numpy()
    slots = lists["slots"].combine_chunks()
    matrix = np.zeros((len(terms), width))
    matrix[np.repeat(np.arange(len(terms)), slots.value_lengths().to_numpy()), slots.flatten().to_numpy()] = lists["weights"].combine_chunks().flatten().to_numpy()
    order = np.argsort(terms, kind="stable")
    return terms[order], matrix[order]


def products(terms: np.ndarray, matrix: np.ndarray, rows: pa.Table, *values: str) -> list[np.ndarray]:
    """For each named list of values, every row's sum of value times the term's documents; the
    matrix is squared for all but the first."""
    lists = rows["terms"].combine_chunks()
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    own = lists.flatten().to_numpy()
    place = np.searchsorted(terms, own)
    known = place < len(terms)
    known[known] = terms[place[known]] == own[known]
    row, place = row[known], place[known]
    step = max(1, CELLS // max(1, matrix.shape[1]))
    found = []
    for n, name in enumerate(values):
        value = rows[name].combine_chunks().flatten().to_numpy()[known]
        out = np.zeros((len(lists), matrix.shape[1]))
        for begin in range(0, len(row), step):
            part = slice(begin, begin + step)
            docs = matrix[place[part]]
            at, first = np.unique(row[part], return_index=True)
            out[at] += np.add.reduceat(value[part, None] * (docs**2 if n else docs), first)
        found.append(out)
    return found


def nearest_sparse(
    queries: DataFrame, corpus: DataFrame, query: str, doc: str, k: int, digits: int = 9, keys: DataFrame | None = None, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(query, doc, score, rank): the ``k`` documents with the largest products.

    Both sides are rows (key, term, weight); the score is rounded first, so that ties are
    real, and ties go to the smaller document. Documents without a shared term score 0,
    so that each query has ``k``, if there are as many. ``keys`` are the queries asked for, those
    without terms included; without it, those of ``queries``.
    """
    corpus = stage(corpus.select(doc, "term", "weight"), "corpus")
    names = stage(dense_ids(corpus, doc, "_doc"), "documents")
    terms = stage(dense_ids(corpus, "term", "_term"), "terms")
    n_docs = names.count()
    groups = max(1, -(-n_docs // GROUP_DOCS))
    width = F.lit(GROUP_DOCS)
    lists = stage(
        corpus.join(names, doc).join(terms, "term")
        .groupBy(F.col("_term").alias("term"), F.floor(F.col("_doc") / width).cast("int").alias("group"))
        .agg(F.collect_list(F.struct((F.col("_doc") % width).cast("int").alias("slot"), "weight")).alias("cells"))
        .select("term", "group", F.col("cells.slot").alias("slots"), F.col("cells.weight").alias("weights")),
        "lists",
    )
    asked = queries.select(query).distinct() if keys is None else keys.select(query)
    cells = queries.join(terms, "term").select(query, F.col("_term").alias("term"), F.col("weight").alias("value"))
    nothing = asked.select(query, F.lit(NOTHING).cast("bigint").alias("term"), F.lit(0.0).alias("value"))
    rows = sparse_rows(cells.unionAll(nothing), query, block_rows)
    kind = rows.schema[query].dataType.simpleString()

    def best(rows: pa.Table, lists: pa.Table) -> pa.Table:
        group = rows["group"][0].as_py()
        own, matrix = list_matrix(lists, min(GROUP_DOCS, n_docs - group * GROUP_DOCS))
        scores = half_up(products(own, matrix, rows, "values")[0], digits)
        # Stable: equal scores keep the order of the documents.
        order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        top = np.take_along_axis(scores, order, axis=1)
        return pa.table({
            query: rows[query].combine_chunks().take(pa.array(np.repeat(np.arange(len(scores)), order.shape[1]))),
            "_doc": pa.array((order + group * GROUP_DOCS).reshape(-1)), "score": pa.array(top.reshape(-1)),
            "rank": pa.array(np.tile(np.arange(1, order.shape[1] + 1, dtype=np.int32), len(scores))),
        })

    each = rows.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))) if n_docs else rows.withColumn("group", F.lit(0)).limit(0)
    needed = rows.select("block", F.explode("terms").alias("term")).distinct().join(lists, "term")
    found = renamed(each).groupBy("block", "group").cogroup(needed.groupBy("block", "group")).applyInArrow(best, f"{query} {kind}, _doc bigint, score double, rank int")
    if groups > 1:
        order = Window.partitionBy(query).orderBy(F.desc("score"), "_doc")
        found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return found.join(names, "_doc").select(query, doc, "score", "rank")
