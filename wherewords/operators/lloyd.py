"""K-means with many numbers of clusters and starts in the same passes over the points.

A pass compares each block of points with the centres of all models at once and adds the
points up per centre within the task, so it shuffles a row per task and centre. Starts are
chosen as by k-means||, for all models in the same rounds. What the driver holds are centres:
numbers of clusters times dimensions, none of which grows with the points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wherewords.session import small_table, stage

# Rounds of choosing candidates, and how many a round chooses for each cluster.
SEED_ROUNDS, SEED_SHARE = 5, 2.0
STARTS = 10


@dataclass
class Fit:
    """A model: number of clusters, seed, centres, cost, and the passes it took."""

    k: int
    seed: int
    centers: np.ndarray
    cost: float
    passes: int


def _points(batch: pa.RecordBatch) -> np.ndarray:
    lists = batch.column("vector")
    return lists.flatten().to_numpy().reshape(batch.num_rows, -1)


def _distances(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    squares = (points**2).sum(axis=1)[:, None] - 2 * points @ centers.T + (centers**2).sum(axis=1)
    return np.maximum(squares, 0)


def _with_places(vectors: DataFrame, key: str, features: str) -> DataFrame:
    """(hash, vector): the points, and a number of each that chance is drawn from."""
    vector = F.col(features)
    if not vectors.schema[features].dataType.simpleString().startswith("array"):
        vector = vector_to_array(vector)
    return vectors.select(F.xxhash64(F.col(key).cast("string")).alias("hash"), vector.cast("array<double>").alias("vector"))


def _costs(points: DataFrame, models: list[np.ndarray]) -> np.ndarray:
    """The cost of the points under each list of centres."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(models))
        for batch in batches:
            if batch.num_rows:
                total += [_distances(_points(batch), c).min(axis=1).sum() for c in models]
        yield pa.RecordBatch.from_pydict({"model": pa.array(range(len(models)), pa.int32()), "cost": pa.array(total)})

    rows = points.mapInArrow(run, "model int, cost double").groupBy("model").agg(F.sum("cost").alias("cost")).collect()
    return np.array([r["cost"] for r in sorted(rows, key=lambda r: r["model"])])


def _unit(hashes: np.ndarray, seed: int) -> np.ndarray:
    """Uniform numbers in [0, 1) from hashes and a seed."""
    x = hashes.view(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def _chosen(points: DataFrame, models: list[np.ndarray], ks: list[int], seeds: list[int], costs: np.ndarray, round_: int) -> list[np.ndarray]:
    """New candidates for each model, likelier the farther from its old ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, hashes = _points(batch), batch.column("hash").to_numpy()
            for m, centers in enumerate(models):
                far = _distances(x, centers).min(axis=1)
                taken = np.flatnonzero(_unit(hashes, 1000 * seeds[m] + round_) * costs[m] < SEED_SHARE * ks[m] * far)
                if len(taken):
                    yield pa.RecordBatch.from_pydict({
                        "model": pa.array(np.full(len(taken), m, np.int32)), "hash": pa.array(hashes[taken]),
                        "vector": pa.array(list(x[taken]), pa.list_(pa.float64())),
                    })

    # About SEED_SHARE * k rows of each model.
    rows = points.mapInArrow(run, "model int, hash bigint, vector array<double>").orderBy("model", "hash").collect()
    found: list[list] = [[] for _ in models]
    for r in rows:
        found[r["model"]].append(r["vector"])
    return [np.array(v).reshape(-1, centers.shape[1]) for v, centers in zip(found, models, strict=True)]


def _sums(points: DataFrame, models: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(points, mean of the points) of each centre of each model, and the cost, in one pass."""
    offsets = np.cumsum([0, *map(len, models)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cost = np.zeros(offsets[-1]), np.zeros((offsets[-1], models[0].shape[1])), np.zeros(len(models))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _points(batch)
            for m, centers in enumerate(models):
                far = _distances(x, centers)
                own = far.argmin(axis=1)
                cost[m] += far[np.arange(len(x)), own].sum()
                n[offsets[m] : offsets[m + 1]] += np.bincount(own, minlength=len(centers))
                np.add.at(sums, offsets[m] + own, x)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({
            "center": pa.array(used.astype(np.int32)), "n": pa.array(n[used]), "vector": pa.array(list(sums[used]), pa.list_(pa.float64())),
            "cost": pa.array(np.zeros(len(used))),
        })
        yield pa.RecordBatch.from_pydict({
            "center": pa.array(-1 - np.arange(len(models)), pa.int32()), "n": pa.array(np.zeros(len(models))),
            "vector": pa.array([np.zeros(sums.shape[1])] * len(models), pa.list_(pa.float64())), "cost": pa.array(cost),
        })

    summed = points.mapInArrow(run, "center int, n double, vector array<double>, cost double").groupBy("center").agg(
        F.sum("n").alias("n"), Summarizer.sum(array_to_vector("vector")).alias("sum"), F.sum("cost").alias("cost")
    )
    # One row for each centre.
    rows = {r["center"]: r for r in summed.collect()}
    out = []
    for m, centers in enumerate(models):
        n, means = np.zeros(len(centers)), centers.copy()
        for i in range(len(centers)):
            if (r := rows.get(int(offsets[m]) + i)) is not None:
                n[i], means[i] = r["n"], r["sum"].toArray() / r["n"]
        out.append((n, means, rows[-1 - m]["cost"]))
    return out


def _spread_out(candidates: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """``k`` of the weighted candidates, each likelier the farther from those taken before."""
    rng = np.random.default_rng(seed)
    taken = [int(rng.choice(len(candidates), p=weights / weights.sum()))]
    while len(taken) < min(k, len(candidates)):
        odds = weights * _distances(candidates, candidates[taken]).min(axis=1)
        if not odds.sum():
            break
        taken.append(int(rng.choice(len(candidates), p=odds / odds.sum())))
    return candidates[taken]


def fit_all(vectors: DataFrame, key: str, ks: list[int], seeds: list[int], features: str = "features", max_iter: int = 100) -> list[Fit]:
    """A model for each number of clusters and seed. Equal points may leave a model with fewer
    clusters than asked for; without points there are no models."""
    points = stage(_with_places(vectors, key, features), "points")
    jobs = [(k, seed) for k in ks for seed in seeds]
    first = {
        seed: points.orderBy(F.xxhash64("hash", F.lit(seed)), "hash").select("vector").limit(1).collect() for seed in seeds
    }
    if not jobs or not first[seeds[0]]:
        return []
    models = [np.array(first[seed][0]["vector"])[None, :] for _, seed in jobs]
    for round_ in range(SEED_ROUNDS):
        costs = _costs(points, models)
        new = _chosen(points, models, [k for k, _ in jobs], [s for _, s in jobs], costs, round_)
        models = [np.concatenate([old, more]) for old, more in zip(models, new, strict=True)]
    weighed = _sums(points, models)
    models = [_spread_out(c, w[0], k, seed) for c, w, (k, seed) in zip(models, weighed, jobs, strict=True)]
    fits: list[Fit | None] = [None] * len(jobs)
    open_ = list(range(len(jobs)))
    for passed in range(1, max_iter + 1):
        for place, (_, means, cost) in zip(list(open_), _sums(points, [models[m] for m in open_]), strict=True):
            still = np.allclose(means, models[place], rtol=0, atol=1e-9)
            if still or passed == max_iter:
                fits[place] = Fit(*jobs[place], models[place], cost, passed)
            models[place] = means
        open_ = [m for m in open_ if fits[m] is None]
        if not open_:
            break
    return fits


def best_of_starts(fits: list[Fit]) -> dict[int, Fit]:
    """The cheapest model of each number of clusters, ties by seed."""
    return {k: min((f for f in fits if f.k == k), key=lambda f: (f.cost, f.seed)) for k in {f.k for f in fits}}


def assigned(vectors: DataFrame, key: str, fits: dict[int, Fit], features: str = "features") -> DataFrame:
    """(k, key, cluster) of all points under each of the models."""
    names, centers = list(fits), [f.centers for f in fits.values()]
    kind = vectors.schema[key].dataType.simpleString()
    vector = F.col(features)
    if not vectors.schema[features].dataType.simpleString().startswith("array"):
        vector = vector_to_array(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _points(batch)
                for k, own in zip(names, centers, strict=True):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), k, np.int32)), batch.column(key), pa.array(_distances(x, own).argmin(axis=1).astype(np.int32))],
                        ["k", key, "cluster"],
                    )

    rows = vectors.select(key, vector.cast("array<double>").alias("vector"))
    return rows.mapInArrow(run, f"k int, {key} {kind}, cluster int")


def centers_table(spark, fits: dict[int, Fit]) -> DataFrame:
    """(k, cluster, center) of the models."""
    rows = [(k, i, c.tolist()) for k, f in fits.items() for i, c in enumerate(f.centers)]
    return small_table(spark, rows, "k int, cluster int, center array<double>")
