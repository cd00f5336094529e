"""The meta forest on small tables, and steps of several problems in a block."""

import threading

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler

from wherewords.operators import blocks, classify


def test_parts_of_a_forest_grow_at_the_same_time(spark, tmp_path, monkeypatch):
    fit, together = RandomForestClassifier.fit, threading.Barrier(3, timeout=120)

    def watched(estimator, rows):
        together.wait()  # breaks if one fit ends before the next begins
        return fit(estimator, rows)

    monkeypatch.setattr(RandomForestClassifier, "fit", watched)
    monkeypatch.setattr(classify, "FEW_ROWS", 80)
    rows = [(float(i % 3), float(i % 3), float(i * 37 % 11)) for i in range(90)]
    table = VectorAssembler(inputCols=["a", "b"], outputCol="v").transform(spark.createDataFrame(rows, "label double, a double, b double").coalesce(1))
    model = classify.train_meta_forest(table, "v", "label", trees=3, max_depth=4)
    assert model.getNumTrees == model.getOrDefault("numTrees") == len(model.trees) == 3
    assert model.getOrDefault("maxDepth") == 4 and model.getPredictionCol() == "meta_prediction"
    PipelineModel([model]).write().overwrite().save(str(tmp_path / "m"))
    for m in (model, PipelineModel.load(str(tmp_path / "m"))):
        assert all(r["label"] == r["meta_prediction"] for r in m.transform(table).collect())


def test_problems_of_a_block_step_apart():
    """Rows of two problems in one block move as each problem's rows do alone."""
    terms = [[-2, 5, 6], [-1, 1, 2], [-2, 6], [-1, 2, 3], [-1, 1], [-2, 5]]
    rows = pa.table({
        "terms": pa.array(terms, pa.list_(pa.int64())), "values": pa.array([[1.0] * len(t) for t in terms]),
        "label": pa.array([0, 1, 1, 0, 1, 0]), "weight": pa.array([1.0] * 6),
    })
    assert blocks._problems(rows).tolist() == [-2, -1, -2, -1, -1, -2]

    def ascent(part):
        names = np.unique(part["terms"].combine_chunks().flatten().to_numpy())
        n = part.num_rows
        return blocks._ascent(part, blocks.Cells.of(part, names), np.zeros((len(names), 2)), np.zeros((n, 2)), 0.5, 1, 4000, 1)[0]

    whole = ascent(rows)
    for problem in (-2, -1):
        own = [i for i, t in enumerate(terms) if t[0] == problem]
        assert np.allclose(whole[own], ascent(rows.take(own)), atol=1e-2)
