"""Fitted models: invariants, reloads, and their linear algebra."""

import time

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from checks.base import messages, stopwords
from wherewords.operators import clusters, features, lloyd, svd
from wherewords.operators.classify import decision_margins, train_hinge, with_prediction
from wherewords.operators.joins import keep_frequent
from wherewords.plans import ensemble, retrieval


@pytest.fixture(scope="module")
def labelled(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    vec = array_to_vector(F.transform("embedding", lambda x: x.cast("double")))
    return rows.select("vec_id", vec.alias("features"), (F.col("label") % 4).alias("label")).persist()


def test_margins_equal_the_estimators(labelled):
    model = train_hinge(labelled, "features", "label", balanced=True)
    ours = with_prediction(decision_margins(model, labelled, "margins"), "margins", "ours")
    both = model.transform(ours).select(
        vector_to_array("margins").alias("a"), vector_to_array("rawPrediction").alias("b"),
        "ours", "prediction",
    ).collect()
    for row in both:
        assert np.allclose(row["a"], row["b"]) and row["ours"] == row["prediction"]


def test_margins_of_sparse_and_empty_vectors(spark, labelled):
    words = spark.createDataFrame([(0, ["a", "b", "b"]), (1, []), (2, ["c"])], "id int, w array<string>")
    sparse = features.tweet_vectors(words, "w", 64, "features")
    model = train_hinge(labelled, "features", "label")
    margins = decision_margins(model, sparse, "m").orderBy("id").collect()
    assert np.allclose(margins[1]["m"].toArray(), [m.intercept for m in model.models])


def test_kmeans_covers_all_points(labelled):
    swept = clusters.kmeans_sweep(labelled, "vec_id", [3, 6], seeds=[1, 2])
    sizes = {r["k"]: r["n"] for r in swept.groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert sizes == {3: 500, 6: 500}


def test_renumber_closes_gaps(spark):
    df = spark.createDataFrame([("a", 4), ("b", 9), ("c", 4)], "doc_key string, cluster int")
    assert sorted(map(tuple, clusters.renumber(df).collect())) == [("a", 0), ("b", 1), ("c", 0)]


def test_topics_equal_a_dense_svd(spark):
    docs = {"a": {"x": 3, "y": 1}, "b": {"y": 2, "z": 2}, "c": {"z": 5, "x": 1}, "d": {"w": 1, "x": 2}}
    terms = sorted({t for d in docs.values() for t in d})
    matrix = np.array([[d.get(t, 0) for d in docs.values()] for t in terms], float)
    tf = spark.createDataFrame(
        [(d, t, n) for d, ts in docs.items() for t, n in ts.items()], "doc_key string, term string, tf bigint"
    )
    model = retrieval.lsi(tf, 2)
    queries = spark.createDataFrame([(1, "x", 1), (1, "z", 2), (2, "w", 1), (2, "new", 4)], "tweet_id bigint, term string, tf bigint")
    found = {(r["tweet_id"], r["doc_key"]): r["score"] for r in retrieval.retrieve_top_k(queries, model, 4).collect()}
    u = np.linalg.svd(matrix)[0][:, :2]
    bags = {1: {"x": 1, "z": 2}, 2: {"w": 1}}
    for q, bag in bags.items():
        left = np.array([bag.get(t, 0) for t in terms], float) @ u
        for i, d in enumerate(docs):
            right = matrix[:, i] @ u
            cosine = left @ right / np.linalg.norm(left) / np.linalg.norm(right)
            assert found[q, d] == pytest.approx(cosine, abs=1e-6)


def test_topics_of_many_documents(spark):
    """More documents than any square matrix of them could hold, in five groups of words."""
    n = 20_000
    cells = spark.range(n * 6).select(
        F.concat(F.lit("d"), (F.col("id") % n).cast("string")).alias("doc_key"),
        F.concat(F.lit("t"), ((F.col("id") % n) % 5 * 40 + F.xxhash64("id") % 20 + 20).cast("string")).alias("term"),
    ).groupBy("doc_key", "term").agg(F.count("*").alias("tf"))
    model = retrieval.lsi(cells, 5)
    docs = {r["doc_key"]: np.array(r["topics"]) for r in model.docs.filter("doc_key IN ('d0', 'd5', 'd1', 'd6')").collect()}
    cosine = lambda a, b: docs[a] @ docs[b] / np.linalg.norm(docs[a]) / np.linalg.norm(docs[b])
    assert model.docs.count() == n and cosine("d0", "d5") > 0.9 and cosine("d1", "d6") > 0.9 and abs(cosine("d0", "d1")) < 0.1


def test_block_svd_equals_numpy(spark):
    rng = np.random.default_rng(6)
    matrix = rng.poisson(0.3, (80, 50)) * rng.random((80, 1)) * 5
    cells = spark.createDataFrame([(f"r{i}", j, float(x)) for i, row in enumerate(matrix) for j, x in enumerate(row)], "r string, c int, x double")
    left, values, right = svd.block_svd(cells, "r", "c", "x", 4, powers=8)
    u, s, v = np.linalg.svd(matrix, full_matrices=False)
    assert np.allclose(values, s[:4], rtol=1e-3)
    rows, cols = {r["r"]: r["vector"] for r in left.collect()}, {r["c"]: r["vector"] for r in right.collect()}
    ours = np.array([rows.get(f"r{i}", [0.0] * 4) for i in range(80)]) * values @ np.array([cols.get(j, [0.0] * 4) for j in range(50)]).T
    assert np.abs(ours - u[:, :4] * s[:4] @ v[:4]).max() < 0.02 * s[0]
    # Fewer directions than asked for, and none at all.
    one = spark.createDataFrame([("a", 1, 2.0), ("b", 1, 0.0)], "r string, c int, x double")
    assert np.allclose(svd.block_svd(one, "r", "c", "x", 3)[1], [2.0])
    assert len(svd.block_svd(one.limit(0), "r", "c", "x", 3)[1]) == 0


def test_messages_without_known_terms_are_retrieved(spark):
    tf = spark.createDataFrame([("a", "x", 2), ("b", "y", 1)], "doc_key string, term string, tf bigint")
    queries = spark.createDataFrame([(1, "new", 1)], "tweet_id bigint, term string, tf bigint")
    rows = retrieval.retrieve_top_k(queries, retrieval.lsi(tf, 2), 2).collect()
    assert [(r["doc_key"], r["score"], r["rank"]) for r in sorted(rows, key=lambda r: r["rank"])] == [("a", 0.0, 1), ("b", 0.0, 2)]


def test_sweep_in_the_same_passes(spark):
    """Far apart clouds are found by every start; no pass is made for one model alone."""
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(6, 4)) * 30
    points = [(i, (centers[i % 6] + rng.normal(size=4)).tolist()) for i in range(300)]
    df = spark.createDataFrame(points, "doc_key int, features array<double>")
    fits = lloyd.fit_all(df, "doc_key", [6, 3, 1], list(range(1, 11)))
    assert len(fits) == 30 and max(f.passes for f in fits) < 40
    best = lloyd.best_of_starts(fits)
    x = np.array([v for _, v in points])
    for k, fit in best.items():
        near = ((x[:, None] - fit.centers) ** 2).sum(axis=2)
        assert fit.cost == pytest.approx(near.min(axis=1).sum())
        assert np.allclose(fit.centers, [x[near.argmin(axis=1) == c].mean(axis=0) for c in range(k)])
        assert fit.cost == min(f.cost for f in fits if f.k == k)
    clusters_of = {r["doc_key"]: r["cluster"] for r in lloyd.assigned(df, "doc_key", {6: best[6]}).collect()}
    assert len({(i % 6, c) for i, c in clusters_of.items()}) == 6
    table = lloyd.centers_table(spark, best)
    assert table.count() == 10 and lloyd.fit_all(df.limit(0), "doc_key", [2], [1]) == []


def test_equal_points_leave_fewer_clusters(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "doc_key int, features array<double>")
    assert {r["cluster"] for r in clusters.kmeans(df, "doc_key", 3).collect()} == {0}


def test_ensemble_ends_and_reloads(spark, folder, tmp_path):
    """A real run with the defaults, on the smallest tables."""
    df = keep_frequent(messages(spark, folder), "place_country", 20)
    stops = stopwords(spark, folder)
    started = time.time()
    model = ensemble.train_ensemble(df, stops)
    model.save(str(tmp_path / "model"))
    again = ensemble.Ensemble.load(str(tmp_path / "model"))
    first, second = (
        {r["tweet_id"]: r["predicted_location"] for r in ensemble.predict_ensemble(df, m).collect()}
        for m in (model, again)
    )
    assert first == second and len(first) == df.count() and time.time() - started < 240
    assert set(first.values()) <= {r[0] for r in df.select("place_country").distinct().collect()}
