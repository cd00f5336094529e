"""Clusters of country profiles."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wherewords.functions.scalars import squared_distance
from wherewords.operators import lloyd
from wherewords.operators.similarity import best_in_blocks
from wherewords.operators.vocabulary import dense_ids
from wherewords.session import small_table, stage

# Documents whose exact coordinates are computed; their square matrix passes the driver.
MAX_DOCS = 2000


def doc_keys(weights: DataFrame, key: str) -> list:
    """Sorted document keys, refused above :data:`MAX_DOCS`."""
    rows = weights.select(key).distinct().limit(MAX_DOCS + 1).collect()
    if len(rows) > MAX_DOCS:
        raise ValueError(f"more than {MAX_DOCS} documents: cluster hashed vectors instead")
    return sorted(r[0] for r in rows)


def term_rows(weights: DataFrame, key: str, keys: list, term: str, value: str) -> DataFrame:
    """(term, row): one vector per term with its value in each document.

    Terms are the distributed side and the few documents the columns, so the
    vocabulary may be of any size.
    """
    spark = weights.sparkSession
    kind = weights.schema[key].dataType.simpleString()
    numbers = small_table(
        spark, [(k, i) for i, k in enumerate(keys)], f"{key} {kind}, _doc int"
    )
    by_doc = F.map_from_entries(F.collect_list(F.struct("_doc", F.col(value).cast("double"))))
    cells = F.transform(
        F.sequence(F.lit(0), F.lit(len(keys) - 1)),
        lambda i: F.coalesce(F.try_element_at("_by_doc", i), F.lit(0.0)),
    )
    return (
        weights.join(numbers, key)
        .groupBy(term)
        .agg(by_doc.alias("_by_doc"))
        .select(term, array_to_vector(cells).alias("row"))
    )


def doc_svd(rows: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, documents x k right vectors) of the term rows."""
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(rows.select("row"), "row"))
    svd = matrix.computeSVD(k, computeU=False)
    return np.array(svd.s.toArray()), np.array(svd.V.toArray())


def doc_coordinates(weights: DataFrame, key: str = "doc_key", term: str = "term") -> DataFrame:
    """(key, features): documents as short vectors with the same distances as
    their full TF-IDF vectors.

    A rotation of n documents into n dimensions keeps all distances, so k-means
    on these vectors is k-means on the whole vocabulary.
    """
    keys = doc_keys(weights, key)
    values, vectors = doc_svd(term_rows(weights, key, keys, term, "weight"), len(keys))
    placed = [(k, Vectors.dense(row)) for k, row in zip(keys, vectors * values)]
    return weights.sparkSession.createDataFrame(placed, [key, "features"])


def kmeans(vectors: DataFrame, key: str, k: int, seeds: list[int] | None = None, max_iter: int = 100) -> DataFrame:
    """(key, cluster) of the cheapest of ten starts, or of one for each seed."""
    return kmeans_sweep(vectors, key, [k], seeds, max_iter).drop("k")


def one_cluster_each(docs: DataFrame, key: str) -> DataFrame:
    """k = number of documents: every document its own cluster, numbered by key."""
    return dense_ids(docs, key, "cluster").withColumn("cluster", F.col("cluster").cast("int"))


def renumber(clustered: DataFrame) -> DataFrame:
    """Cluster numbers without gaps, as the classifiers need them as labels."""
    numbers = dense_ids(clustered, "cluster", "_new")
    joined = clustered.join(numbers, "cluster").withColumn("cluster", F.col("_new").cast("int"))
    return joined.select(*clustered.columns)


def kmeans_sweep(
    vectors: DataFrame, key: str, ks: list[int], seeds: list[int] | None = None, max_iter: int = 100
) -> DataFrame:
    """(k, key, cluster) for several numbers of clusters, all fitted in the same passes; of each
    the cheapest of ten starts, or of one for each seed."""
    fits = lloyd.fit_all(vectors, key, ks, seeds or list(range(1, lloyd.STARTS + 1)), max_iter=max_iter)
    return lloyd.assigned(vectors, key, lloyd.best_of_starts(fits))


def cluster_members(clustered: DataFrame, doc: str = "doc_key") -> DataFrame:
    """(cluster, members, size): the sorted documents of each cluster. The
    documents are profiles, one per country, so the lists are short."""
    members = F.array_sort(F.collect_list(doc))
    return clustered.groupBy("cluster").agg(members.alias("members")).withColumn(
        "size", F.size("members")
    )


def cluster_sizes(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("cluster").agg(F.count("*").alias("size"))


def label_of_cluster(pred: DataFrame, mapping: DataFrame, doc: str = "doc_key") -> DataFrame:
    """The first document of the predicted cluster as label."""
    first = stage(mapping.groupBy("cluster").agg(F.min(doc).alias("label")), "cluster-labels")
    return pred.join(first, "cluster")


def candidates_of_cluster(pred: DataFrame, members: DataFrame) -> DataFrame:
    """All documents of the predicted cluster as an array."""
    lists = stage(members.select("cluster", F.col("members").alias("candidates")), "candidates")
    return pred.join(lists, "cluster")


def candidate_profiles(pred: DataFrame, profiles: DataFrame, doc: str = "doc_key") -> DataFrame:
    """Each prediction with the profiles of its cluster as one array of rows, by document; a row
    per prediction, not per pair."""
    parts = F.struct(doc, *[c for c in profiles.columns if c not in (doc, "cluster")])
    lists = profiles.groupBy("cluster").agg(F.array_sort(F.collect_list(parts)).alias("profiles"))
    return pred.join(stage(lists, "profiles"), "cluster")


def assign_nearest(
    points: DataFrame, centroids: DataFrame, point: str, vec: str, center: str, center_vec: str,
    digits: int = 9,
) -> DataFrame:
    """(point, vec, cluster, distance2): the nearest centroid, ties by its key."""

    def badness(a, b):
        return F.round(squared_distance(a, b), digits)

    ranked = best_in_blocks(points, centroids, point, vec, center, center_vec, badness)
    best = F.get("ranked", F.lit(0))
    return ranked.select(
        point, vec, best["key"].alias("cluster"), best["badness"].alias("distance2")
    )


def lloyd_step(assigned: DataFrame, vec: str) -> DataFrame:
    """(cluster, n, center): the mean vector of each cluster, combined in the map tasks."""
    as_vector = array_to_vector(F.transform(vec, lambda x: x.cast("double")))
    return (
        assigned.groupBy("cluster")
        .agg(F.count("*").alias("n"), Summarizer.mean(as_vector).alias("mean"))
        .select("cluster", "n", vector_to_array("mean").alias("center"))
    )
