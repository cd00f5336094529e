"""Choice of parameters: classifier grids and the number of clusters."""

from __future__ import annotations

from itertools import product

from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wherewords.operators.clusters import cluster_members, kmeans_sweep, renumber
from wherewords.session import stage


def grid_search(
    df: DataFrame,
    features: str,
    label: str,
    regs: tuple[float, ...] = (1e-3, 1e-2),
    folds: int = 2,
    max_iters: tuple[int, ...] = (5,),
    intercepts: tuple[bool, ...] = (True,),
    parallelism: int = 4,
    seed: int = 42,
):
    """Cross-validated hinge classifiers over regularization weights, numbers of steps and
    intercepts: the fitted ``CrossValidatorModel`` with ``avgMetrics`` in the order of
    ``product(regs, max_iters, intercepts)``."""
    svc = LinearSVC()
    ovr = OneVsRest(classifier=svc, featuresCol=features, labelCol=label)
    # The grid is over the outer estimator's classifier: one per combination.
    settings = [
        {svc.regParam: reg, svc.maxIter: steps, svc.fitIntercept: intercept}
        for reg, steps, intercept in product(regs, max_iters, intercepts)
    ]
    grid = (
        ParamGridBuilder()
        .addGrid(ovr.classifier, [svc.copy(own) for own in settings])
        .build()
    )
    return CrossValidator(
        estimator=ovr,
        estimatorParamMaps=grid,
        evaluator=MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy"),
        numFolds=folds,
        parallelism=parallelism,
        seed=seed,
    ).fit(df)


def k_sweep(
    vectors: DataFrame, predict, ks: list[int], actual: str = "place_country", key: str = "doc_key"
) -> DataFrame:
    """(k, correct, total): candidate-set accuracy for several numbers of clusters.

    ``predict(clustered)`` gives rows (actual, cluster) for a clustering
    (key, cluster).
    """
    results = None
    swept = stage(kmeans_sweep(vectors, key, ks), "k-sweep")
    for k in ks:
        clustered = stage(renumber(swept.filter(F.col("k") == k).select(key, "cluster")), "k-sweep")
        members = cluster_members(clustered, key).select("cluster", "members")
        hits = predict(clustered).join(members, "cluster").agg(
            F.lit(k).alias("k"),
            F.count_if(F.array_contains("members", F.col(actual))).alias("correct"),
            F.count("*").alias("total"),
        )
        results = hits if results is None else results.unionAll(hits)
    return results
