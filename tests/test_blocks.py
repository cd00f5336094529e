"""Numbering, sparse blocks and the classifiers on them, against numpy and SQL."""

from hashlib import md5

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wherewords.operators import blocks, clusters, features
from wherewords.operators.vocabulary import dense_ids
from wherewords.plans import textclass
from wherewords.session import stage


@pytest.mark.parametrize("ranges", [1, 7, None])
def test_dense_ids(spark, ranges):
    values = ["b", "a", "é", None, "zz", "", "a"] + [f"t{i}" for i in range(40)]
    df = spark.createDataFrame([(v, 1) for v in values], "term string, id int")
    found = {r["term"]: r["n"] for r in dense_ids(df, "term", "n", ranges).collect()}
    assert found == {v: i for i, v in enumerate(sorted({v for v in values if v is not None}, key=str.encode))}
    assert dense_ids(df.limit(0), "term").count() == 0


def test_dense_ids_of_ten_million_terms(spark, monkeypatch):
    """No row passes the driver, and the numbers have no gap."""
    terms = spark.range(10_000_000).select(F.md5(F.col("id").cast("string").cast("binary")).alias("term"))

    def refuse(*_):
        raise AssertionError("collected")

    with monkeypatch.context() as patched:
        patched.setattr(type(terms), "collect", refuse)
        patched.setattr(type(terms), "toPandas", refuse)
        numbered = stage(dense_ids(terms, "term"), "numbered")
    row = numbered.agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"), F.sum("id").alias("sum")).first()
    assert tuple(row) == (10**7, 0, 10**7 - 1, 10**7 * (10**7 - 1) // 2)
    near = numbered.filter("id BETWEEN 4999990 AND 5000010").orderBy("id").collect()
    assert [r["term"] for r in near] == sorted(r["term"] for r in near)


@pytest.mark.parametrize("n", [2_001, 200_000])
def test_clusters_of_any_number(spark, n):
    docs = spark.range(n).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("doc_key"))
    row = clusters.one_cluster_each(docs, "doc_key").agg(F.count("*"), F.count_distinct("cluster"), F.max("cluster")).first()
    assert tuple(row) == (n, n, n - 1)
    gaps = docs.withColumn("cluster", (F.substring("doc_key", 2, 9).cast("int") * 3))
    row = clusters.renumber(gaps).agg(F.count("*"), F.count_distinct("cluster"), F.max("cluster")).first()
    assert tuple(row) == (n, n, n - 1)


def test_count_vectorize(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, None), (4, ["c", None])], "k int, words array<string>")
    vocab, counts = features.count_vectorize(df, "k", "words")
    assert {r["word"]: r["id"] for r in vocab.collect()} == {"a": 0, "b": 1, "c": 2}
    assert sorted(map(tuple, counts.collect())) == [(1, 0, 1), (1, 1, 2), (4, 2, 1)]


# --- sums over term vectors --------------------------------------------------


def long(matrix):
    return [(i, j, float(x)) for i, row in enumerate(matrix) for j, x in enumerate(row) if x]


def test_block_sums(spark, monkeypatch):
    monkeypatch.setattr(blocks, "CELLS", 7)
    rng = np.random.default_rng(0)
    matrix = rng.integers(0, 3, (40, 30)) * rng.random((40, 30))
    vectors = rng.random((30, 4))
    cells = spark.createDataFrame([*long(matrix), (50, 99, 1.0)], "k int, term int, value double")
    table = spark.createDataFrame([(j, v.tolist()) for j, v in enumerate(vectors)], "term bigint, vector array<double>")
    found = {r["k"]: r["sums"] for r in blocks.block_sums(blocks.sparse_rows(cells, "k", 9), "k", table, 4).collect()}
    # Row 50 has an unknown term alone.
    assert np.allclose([found[i] for i in range(40)], matrix @ vectors) and found[50] == [0.0] * 4


# --- classifiers -----------------------------------------------------------------


def solved(x, label, classes, weight, reg, passes=3000):
    """The optimum, by many passes over one block."""
    x = np.column_stack([x, np.ones(len(x))])
    sign = np.where(np.arange(classes) == label[:, None], 1.0, -1.0)
    alpha, w = np.zeros((len(x), classes)), np.zeros((x.shape[1], classes))
    for _ in range(passes):
        for i in range(len(x)):
            new = np.clip(alpha[i] + (1 - sign[i] * (x[i] @ w)) * reg * len(x) / (x[i] @ x[i]), 0, weight[i])
            w += np.outer(x[i], (new - alpha[i]) * sign[i]) / reg / len(x)
            alpha[i] = new
    loss = (weight[:, None] * np.maximum(0, 1 - sign * (x @ w))).sum() / len(x)
    return w, reg / 2 * (w**2).sum() + loss


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(4)
    label = rng.choice(3, 90, p=[0.7, 0.2, 0.1])
    x = rng.normal(size=(90, 6)) + 2 * np.eye(6)[label]
    x[rng.random(x.shape) < 0.3] = 0
    cells = stage(spark.createDataFrame(long(x), "k bigint, term int, value double"), "cells")
    labels = stage(spark.createDataFrame([(i, int(c)) for i, c in enumerate(label)] + [(500, None)], "k bigint, label int"), "labels")
    return x, label, cells, labels


def as_matrix(model, terms):
    rows = {r["term"]: r["vector"] for r in model.weights.collect()}
    return np.array([rows.get(t, [0.0] * model.classes) for t in [*range(terms), blocks.BIAS]])


@pytest.mark.parametrize("block_rows,rounds,most", [(1000, None, 1.03), (30, 20, 1.2)])
def test_training_reaches_the_optimum(points, block_rows, rounds, most):
    """In one block within the gap; in several, on few dense columns, where blocks disagree
    most, near it after some rounds."""
    x, label, cells, labels = points
    weight = (90 / (3 * np.bincount(label)))[label]
    _, best = solved(x, label, 3, weight, 0.01)
    settings = {"rounds": rounds, "local_passes": 10} if rounds else {}
    model = blocks.train_hinge_rows(cells, labels, "k", 3, balanced=True, reg=0.01, gap=2e-2, block_rows=block_rows, **settings)
    w = as_matrix(model, 6)
    sign = np.where(np.arange(3) == label[:, None], 1.0, -1.0)
    margins = np.column_stack([x, np.ones(90)]) @ w
    value = 0.005 * (w**2).sum() + (weight[:, None] * np.maximum(0, 1 - sign * margins)).sum() / 90
    assert best - 1e-9 <= value <= best * most
    found = {r["k"]: r["margins"] for r in blocks.hinge_margins(model, cells, labels.select("k"), "k", block_rows).collect()}
    assert np.allclose([found[i] for i in range(90)], margins)
    # A row without terms has the intercepts.
    assert np.allclose(found[500], w[-1])


def test_plain_training_takes_its_passes(spark):
    """Rows of a class have a word of it among others, as texts do."""
    rng = np.random.default_rng(3)
    x = np.zeros((60, 200))
    for i, row in enumerate(x):
        row[rng.choice(np.arange(3, 200), 8, replace=False)] = 0.3
        row[i % 3] = 0.5
    cells = spark.createDataFrame(long(x), "k bigint, term int, value double")
    labels = spark.createDataFrame([(i, i % 3) for i in range(60)], "k bigint, label int")
    model = blocks.train_hinge_rows(cells, labels, "k", 3)
    margins = np.column_stack([x, np.ones(60)]) @ as_matrix(model, 200)
    assert (margins.argmax(axis=1) == np.arange(60) % 3).mean() > 0.95


def test_problems_in_the_same_passes(spark, points):
    """Two classifiers trained as one equal each on its own."""
    x, label, cells, labels = points
    twice = cells.unionAll(cells.select(F.col("k") + 1000, F.col("term") + 100, F.col("value") * 2))
    both = labels.unionAll(labels.select(F.col("k") + 1000, "label"))
    bias = F.lit(blocks.BIAS) - (F.col("k") >= 1000).cast("int")
    model = blocks.train_hinge_rows(twice, both, "k", 3, balanced=True, reg=0.01, gap=1e-4, problems=2, bias=bias)
    rows = {r["term"]: r["vector"] for r in model.weights.collect()}
    weight = (90 / (3 * np.bincount(label)))[label]
    for shift, scale, constant in ((0, 1, -1), (100, 2, -2)):
        w, _ = solved(x * scale, label, 3, weight, 0.01)
        own = np.array([rows[shift + t] for t in range(6)] + [rows[constant]])
        assert np.abs(own - w).max() < 0.1


def test_margins_equal_sql_over_the_saved_weights(spark, points, tmp_path):
    _, _, cells, labels = points
    model = blocks.train_hinge_rows(cells, labels, "k", 3, balanced=True, reg=0.01)
    model.save(str(tmp_path / "hinge"))
    again = blocks.HingeModel.load(str(tmp_path / "hinge"))
    cells.write.parquet(str(tmp_path / "cells"))
    sql = f"""WITH w AS (SELECT term, unnest(vector) AS w, generate_subscripts(vector, 1) - 1 AS c FROM '{tmp_path}/hinge/weights/*.parquet'),
      x AS (SELECT k, term, value FROM '{tmp_path}/cells/*.parquet'),
      rows AS (SELECT * FROM x UNION ALL SELECT DISTINCT k, {blocks.BIAS}, 1.0 FROM x)
      SELECT k, c, sum(value * w) FROM rows JOIN w USING (term) GROUP BY ALL"""
    expected = {(k, c): m for k, c, m in duckdb.sql(sql).fetchall()}
    rows = blocks.hinge_margins(again, cells, cells.select("k").distinct(), "k").collect()
    found = {(r["k"], c): m for r in rows for c, m in enumerate(r["margins"])}
    assert set(found) == set(expected) and all(found[k] == pytest.approx(expected[k]) for k in found)


# --- text --------------------------------------------------------------------------


def test_fourier_map_of_text(spark):
    def unit(label):
        return (int(md5(label.encode()).hexdigest()[:8], 16) + 0.5) / 2**32

    cells = spark.createDataFrame([(1, 0, 0.6), (1, 5, 0.8), (2, 5, 1.0)], "k bigint, term bigint, value double")
    found = {(r["k"], r["term"]): r["value"] for r in textclass.FourierMap(0.5, 12, 3).features(cells, "k").collect()}
    for k, own in {1: {0: 0.6, 5: 0.8}, 2: {5: 1.0}}.items():
        for d in range(12):
            w = {t: np.sqrt(-2 * np.log(unit(f"3:{t}:{d}:r"))) * np.cos(2 * np.pi * unit(f"3:{t}:{d}:a")) for t in own}
            z = sum(v * w[t] for t, v in own.items()) + 2 * np.pi * unit(f"3:{d}:b")
            assert found[k, d] == pytest.approx(np.sqrt(2 / 12) * np.cos(z))


def test_text_models_reload(spark, tmp_path):
    texts = {"a": "sun sea sand", "b": "sea salt ship", "c": "snow ice cold", "d": "ice ski snow"}
    tf = spark.createDataFrame([(k, w, 1) for k, t in texts.items() for w in t.split()], "doc_key string, term string, tf bigint")
    labels = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1), ("d", 1)], "doc_key string, label int")
    asked = spark.createDataFrame([("q", "sea", 1), ("q", "new", 9), ("r", "ski", 2), ("r", "snow", 1)], "doc_key string, term string, tf bigint")
    keys = spark.createDataFrame([("q",), ("r",), ("nothing",)], "doc_key string")
    for name, mapped in (("linear", None), ("rbf", textclass.FourierMap(gamma=0.5))):
        model = textclass.train_text(tf, labels, "doc_key", 2, mapped, balanced=True)
        first = {r["doc_key"]: r["prediction"] for r in model.predict(asked, keys, "doc_key").collect()}
        assert len(first) == 3 and (mapped or (first["q"], first["r"]) == (0, 1))
        model.save(str(tmp_path / name))
        again = textclass.TextModel.load(str(tmp_path / name)).predict(asked, keys, "doc_key").collect()
        assert {r["doc_key"]: r["prediction"] for r in again} == first


def test_pairs_of_neighbours(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 2, "b"), (1, 5, "a"), (2, 0, "c")], "k int, pos int, word string")
    found = sorted(map(tuple, textclass.with_pairs(rows, ["k"]).collect()))
    assert found == [(1, "a"), (1, "a"), (1, "a b"), (1, "b"), (1, "b a"), (2, "c")]


def test_block_sums_in_parts(spark, monkeypatch):
    """A block's terms may be dealt to parts: no task then meets all their vectors."""
    monkeypatch.setattr(blocks, "VECTOR_CELLS", 40)
    rng = np.random.default_rng(1)
    matrix, vectors = rng.random((6, 50)), rng.random((50, 4))
    cells = spark.createDataFrame([*long(matrix), (None, 3, 2.0)], "k int, term int, value double")
    table = spark.createDataFrame([(j, v.tolist()) for j, v in enumerate(vectors)], "term bigint, vector array<double>")
    summed = blocks.block_sums(blocks.sparse_rows(cells, "k"), "k", table, 4)
    found = {r["k"]: r["sums"] for r in summed.collect()}
    assert np.allclose([found[i] for i in range(6)], matrix @ vectors) and np.allclose(found[None], 2 * vectors[3])


def test_products_of_rows(monkeypatch):
    """Common terms as matrices, others pair by pair, a term that a row has twice included."""
    monkeypatch.setattr(blocks, "CELLS", 90)
    rng = np.random.default_rng(2)
    dense = np.where(rng.random((30, 80)) < rng.random(80) ** 2, rng.random((30, 80)), 0)
    row, place = np.nonzero(dense)
    cells = blocks.Cells(row, place, dense[row, place])
    assert np.allclose(cells.gram(30), dense @ dense.T)
    numbers = rng.random((30, 3))
    assert np.allclose(cells.back(numbers, 80), dense.T @ numbers)
    twice = blocks.Cells(np.array([0, 0, 1]), np.array([5, 5, 5]), np.array([1.0, 2.0, 3.0]))
    assert np.allclose(twice.gram(2), [[6, 9], [6, 9]])


def test_weights_of_one_block_stay_there(points, monkeypatch):
    """Only weights of terms that several blocks have are sent around in a round."""
    _, _, cells, labels = points
    sent, summed = [], blocks._summed
    monkeypatch.setattr(blocks, "_summed", lambda vectors: sent.append(vectors.count()) or summed(vectors))
    own = cells.withColumn("term", F.col("k").cast("int") * 10 + F.col("term")).unionAll(cells)
    model = blocks.train_hinge_rows(own, labels, "k", 3, rounds=1, block_rows=45)
    assert 0 < sent[0] <= 7 * 2 < model.weights.count()
