"""Sparse rows in blocks: sums over a table of term vectors, and linear classifiers.

Rows are (key, term, value). A block holds some hundreds of rows, and only meets the vectors
of its own terms, so that neither a vocabulary nor a weight table is ever in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wherewords.session import small_table, stage

# Rows of a block; cells of a product that are held at once.
BLOCK_ROWS = 2000
CELLS = 1 << 20
# A term is common if more than one in so many of a block's rows have it.
COMMON_SHARE = 7
# Numbers of the vectors that a block meets at once.
VECTOR_CELLS = 1 << 24
# Rows of a block whose dual steps are taken on products that are at hand.
STEP_ROWS = 64
# The constant feature that carries a classifier's intercept.
BIAS = -1


def sparse_rows(features: DataFrame, key: str, block_rows: int = BLOCK_ROWS, by: list[str] | None = None) -> DataFrame:
    """(block, key, terms, values): each row's features in one place, rows dealt to blocks.

    ``features`` has (key, term, value) with numbers as terms; a row's features are one task's, the
    terms of a row being few beside the vocabulary. ``by`` names columns that stay with the
    row, one value for each key.
    """
    by = by or []
    rows = stage(
        features.groupBy(key, *by).agg(F.sort_array(F.collect_list(F.struct(F.col("term").cast("bigint").alias("term"), F.col("value").cast("double").alias("value")))).alias("cells"))
        .select(key, *by, F.col("cells.term").alias("terms"), F.col("cells.value").alias("values")),
        "sparse-rows",
    )
    blocks = max(1, -(-rows.count() // block_rows))
    return rows.withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of ``width`` numbers as rows."""
    return column.combine_chunks().flatten().to_numpy().reshape(len(column), width)


def _lists(matrix: np.ndarray) -> pa.ListArray:
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix, float).reshape(-1)))


@dataclass
class Cells:
    """The known cells of a block's rows: row, place of the term among the vectors, value."""

    row: np.ndarray
    place: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table, terms: np.ndarray) -> Cells:
        """``terms`` are sorted; cells of other terms are left out."""
        lists = rows["terms"].combine_chunks()
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        own, value = lists.flatten().to_numpy(), rows["values"].combine_chunks().flatten().to_numpy()
        place = np.searchsorted(terms, own)
        known = place < len(terms)
        known[known] = terms[place[known]] == own[known]
        return cls(row[known], place[known], value[known])

    def sums(self, vectors: np.ndarray, n: int) -> np.ndarray:
        """Each row's cells times their vectors, added up; some cells at a time."""
        out = np.zeros((n, vectors.shape[1]))
        step = max(1, CELLS // max(1, vectors.shape[1]))
        for begin in range(0, len(self.row), step):
            part = slice(begin, begin + step)
            rows, first = np.unique(self.row[part], return_index=True)
            out[rows] += np.add.reduceat(self.value[part, None] * vectors[self.place[part]], first)
        return out

    def last(self) -> np.ndarray:
        """The values, but 0 for all but the last cell of a term that a row has several times."""
        again = (self.row[1:] == self.row[:-1]) & (self.place[1:] == self.place[:-1])
        return np.where(np.append(again, False), 0.0, self.value) if len(again) else self.value

    def back(self, rows: np.ndarray, n_terms: int) -> np.ndarray:
        """Each term's cells times the numbers of their rows, added up; some cells at a time."""
        out = np.zeros((n_terms, rows.shape[1]))
        order = np.argsort(self.place, kind="stable")
        row, place, value = self.row[order], self.place[order], self.last()[order]
        step = max(1, CELLS // max(1, rows.shape[1]))
        for begin in range(0, len(row), step):
            part = slice(begin, begin + step)
            terms, first = np.unique(place[part], return_index=True)
            out[terms] += np.add.reduceat(value[part, None] * rows[row[part]], first)
        return out

    def gram(self, n: int) -> np.ndarray:
        """The rows' products with each other: terms of many rows as matrices, some columns at a
        time, and the pairs of rows of the others one by one."""
        out = np.zeros((n, n))
        if not len(self.row):
            return out
        order = np.argsort(self.place, kind="stable")
        row, place, value, last = self.row[order], self.place[order], self.value[order], self.last()[order]
        term = np.cumsum(np.append(True, place[1:] != place[:-1])) - 1
        counts = np.bincount(term)
        common = counts * COMMON_SHARE > n
        column, width = (np.cumsum(common) - 1)[term], max(1, CELLS // n)
        whole = np.flatnonzero(common[term])
        for begin in range(0, int(common.sum()), width):
            lo, hi = np.searchsorted(column[whole], [begin, begin + width])
            own = whole[lo:hi]
            left, right = np.zeros((n, width)), np.zeros((n, width))
            np.add.at(left, (row[own], column[own] - begin), value[own])
            np.add.at(right, (row[own], column[own] - begin), last[own])
            out += left @ right.T
        flat = out.reshape(-1)
        own = np.flatnonzero(~common[term])
        np.add.at(flat, row[own] * (n + 1), value[own] * last[own])
        step, ends = 1, np.cumsum(counts)[term]
        while len(own := own[own + step < ends[own]]):
            other = own + step
            np.add.at(flat, row[own] * n + row[other], value[own] * last[other])
            np.add.at(flat, row[other] * n + row[own], value[other] * last[own])
            step += 1
        return out


def renamed(df: DataFrame) -> DataFrame:
    """The same columns under new identities, so that a table can meet what is made of it."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _with_vectors(rows: DataFrame, vectors: DataFrame, *by: str):
    """The rows of each block, or other group, and the vectors of its terms, as two groupings."""
    needed = rows.select(*by, F.explode("terms").alias("term")).distinct()
    return renamed(rows).groupBy(*by).cogroup(needed.join(vectors, "term").groupBy(*by))


def _sorted_vectors(vectors: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(vectors["term"].to_numpy(), kind="stable")
    return vectors["term"].to_numpy()[order], _matrix(vectors["vector"], width)[order]


def _summed(vectors: DataFrame) -> DataFrame:
    """(term, vector): the vectors of each term added up, a batch of sorted rows at a time."""

    def made(terms: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(terms), _lists(sums)], ["term", "vector"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = np.zeros(0, np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            terms = np.concatenate([last, batch.column("term").to_numpy()])
            matrix = batch.column("vector").flatten().to_numpy().reshape(batch.num_rows, -1)
            matrix = matrix if held is None else np.concatenate([held, matrix])
            first = np.flatnonzero(np.append(True, terms[1:] != terms[:-1]))
            terms, sums = terms[first], np.add.reduceat(matrix, first)
            # The next batch may go on with the last term.
            last, held = terms[-1:], sums[-1:]
            yield made(terms[:-1], sums[:-1])
        if held is not None:
            yield made(last, held)

    return vectors.repartition("term").sortWithinPartitions("term").mapInArrow(run, "term bigint, vector array<double>")


def block_sums(rows: DataFrame, key: str, vectors: DataFrame, width: int) -> DataFrame:
    """(key, sums): for each of the :func:`sparse_rows` the sum of value times vector.

    ``vectors`` has (term, vector of ``width`` numbers); terms outside it add nothing.
    """

    def run(rows: pa.Table, vectors: pa.Table) -> pa.Table:
        terms, matrix = _sorted_vectors(vectors, width)
        return pa.table({key: rows[key], "sums": _lists(Cells.of(rows, terms).sums(matrix, rows.num_rows))})

    kind = rows.schema[key].dataType.simpleString()
    most = rows.groupBy("block").agg(F.sum(F.size("terms")).alias("cells")).agg(F.max("cells")).first()[0] or 0
    parts = -(-most * width // VECTOR_CELLS)
    if parts <= 1:
        return _with_vectors(rows, vectors, "block").applyInArrow(run, f"{key} {kind}, sums array<double>")
    # Rows may be whole countries: their terms are dealt to parts, and the parts' sums added up.
    cell = F.explode(F.arrays_zip("terms", "values")).alias("cell")
    part = F.pmod(F.xxhash64("cell.terms"), F.lit(parts)).cast("int").alias("part")
    cells = rows.select("block", key, cell).groupBy("block", part, key).agg(F.sort_array(F.collect_list("cell")).alias("cells"))
    split = stage(cells.select("block", "part", key, F.col("cells.terms").alias("terms"), F.col("cells.values").alias("values")), "row-parts")
    sums = _with_vectors(split, vectors, "block", "part").applyInArrow(run, f"{key} {kind}, sums array<double>")
    summed = sums.groupBy(key).agg(Summarizer.sum(array_to_vector("sums")).alias("sum"))
    return summed.select(key, vector_to_array("sum").alias("sums"))


# --- linear classifiers, all classes at once ------------------------------------


@dataclass
class HingeModel:
    """One weight per term and class; the intercept is the term :data:`BIAS`."""

    weights: DataFrame  # term, vector
    classes: int

    def save(self, path: str) -> None:
        self.weights.write.parquet(f"{path}/weights")
        small_table(self.weights.sparkSession, [(self.classes,)], "classes bigint").write.parquet(f"{path}/settings")

    @classmethod
    def load(cls, path: str) -> HingeModel:
        read = SparkSession.active().read
        return cls(read.parquet(f"{path}/weights"), read.parquet(f"{path}/settings").first()["classes"])


def with_bias(features: DataFrame, keys: DataFrame, key: str, bias: Column | None = None) -> DataFrame:
    """The features and the constant one, for all ``keys``: a row without terms has that alone.
    ``bias`` is the constant's term, an expression on ``keys``, if not all rows share one."""
    bias = F.lit(BIAS) if bias is None else bias
    constant = keys.select(key, bias.cast("bigint").alias("term"), F.lit(1.0).alias("value"))
    return features.select(key, F.col("term").cast("bigint").alias("term"), F.col("value").cast("double").alias("value")).unionAll(constant)


def _signs(rows: pa.Table, classes: int) -> np.ndarray:
    """1 for each row's own class, -1 for the others."""
    return np.where(np.arange(classes) == rows["label"].to_numpy().astype(int)[:, None], 1.0, -1.0)


def _problems(rows: pa.Table) -> np.ndarray:
    """The constant term of each row, which tells the problems apart; 0 without one."""
    lists = rows["terms"].combine_chunks()
    lengths, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
    first = np.zeros(len(lengths), np.int64)
    first[lengths > 0] = flat[(np.cumsum(lengths) - lengths)[lengths > 0]]
    return np.minimum(first, 0)


def _ascent(rows: pa.Table, cells: Cells, weights: np.ndarray, alpha: np.ndarray, scale: float, spread: int, passes: int, seed: int):
    """Coordinate ascent over a block's dual variables, all classes of a row in one step.

    Blocks work at the same time, so a step counts ``spread`` times, as if the others made it
    as well; that keeps the sum of all blocks' steps an ascent. A step changes the other rows'
    margins by the rows' products, so that no weight is touched before the end. Gives (new
    alpha, change of the weights, loss and dual sum before).
    """
    n, classes = alpha.shape
    weight, sign = rows["weight"].to_numpy(), _signs(rows, classes)
    start = cells.sums(weights, n)
    loss = (weight[:, None] * np.maximum(0, 1 - sign * start)).sum()
    dual = alpha.sum()
    norms = np.bincount(cells.row, cells.value**2, n)
    products = scale * spread * cells.gram(n)
    problem = _problems(rows)
    # Rows of two problems have no product, so each problem's steps are on its own.
    apart = [np.flatnonzero(problem == p) for p in np.unique(problem)]
    apart = [(own, products if len(own) == n else products[np.ix_(own, own)]) for own in apart]
    moved = np.zeros((n, classes))
    new, change, products_of = np.empty(classes), np.empty(classes), np.empty((STEP_ROWS, classes))
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        before = alpha.copy()
        order = rng.permutation(n)
        order = order[norms[order] > 0]
        for members, products in apart:
            turns = np.searchsorted(members, order[problem[order] == problem[members[0]]])
            shift = moved[members]
            for begin in range(0, len(turns), STEP_ROWS):
                near = turns[begin : begin + STEP_ROWS]
                own, lines = members[near], products[near]
                margins, among = start[own] + lines @ shift, lines[:, near]
                # Few numbers a step: what costs time are the calls, so rows and buffers are at hand.
                signs, old, bounds, steps = list(sign[own]), list(alpha[own]), weight[own].tolist(), (scale * spread * norms[own]).tolist()
                for k, (i, at) in enumerate(zip(own.tolist(), near.tolist())):
                    np.multiply(signs[k], margins[k], out=new)
                    np.subtract(1, new, out=new)
                    np.divide(new, steps[k], out=new)
                    np.add(old[k], new, out=new)
                    np.maximum(new, 0, out=new)
                    np.minimum(new, bounds[k], out=new)
                    np.subtract(new, old[k], out=change)
                    if np.count_nonzero(change):
                        np.multiply(change, signs[k], out=change)
                        # The rows before it are done; the next group's margins are made anew.
                        later = margins[k + 1 :]
                        later += np.multiply(among[k + 1 :, k, None], change, out=products_of[k + 1 : len(own)])
                        shift[at] += change
                        alpha[i] = new
            moved[members] = shift
        # The block has settled: the other blocks' turn.
        if (np.abs(alpha - before).max(axis=1) <= SETTLED * weight).all():
            break
    return alpha, scale * cells.back(moved, len(weights)), loss, dual


PLAIN_PASSES, MOST_ROUNDS, LOCAL_PASSES = 5, 40, 40
# Change of a dual variable, as a share of its bound, that ends a round early.
SETTLED = 1e-3


def train_hinge_rows(
    features: DataFrame, labels: DataFrame, key: str, classes: int, balanced: bool = False, reg: float = 1e-3,
    rounds: int | None = None, local_passes: int | None = None, gap: float = 5e-2, block_rows: int = BLOCK_ROWS, seed: int = 42,
    problems: int = 1, bias: Column | None = None,
) -> HingeModel:
    """One-against-rest hinge classifiers of all classes in the same passes.

    ``features`` (key, term, value), ``labels`` (key, label in 0..classes-1). Each class
    minimises ``reg / 2 |w|^2`` plus the mean hinge loss, rows weighing n / (classes * n_label)
    if ``balanced``. A round takes each block's rows through dual coordinate steps on the
    weights of its own terms; the changes of all blocks add up. Plain models take
    :data:`PLAIN_PASSES` rounds of one pass; balanced ones go on until the primal is within
    ``gap`` of the dual, relative to it, or for :data:`MOST_ROUNDS`. Rows without a label don't count.

    ``problems`` classifiers of equally many rows are trained as one if they have no term in
    common: ``bias`` then tells their constants apart, see :func:`with_bias`.
    """
    constant = (F.lit(BIAS) if bias is None else bias).cast("bigint")
    known = stage(
        labels.filter(F.col("label").isNotNull()).select(key, F.col("label").cast("int").alias("label"), constant.alias("bias")), "labels"
    )
    sizes = known.groupBy("label").agg(F.count("*").alias("_rows"))
    n = known.count()
    weight = F.lit(float(n)) / (F.lit(classes) * F.col("_rows")) if balanced else F.lit(1.0)
    weighed = known.join(sizes, "label").select(key, "label", weight.alias("weight"))
    cells = with_bias(features.join(known.select(key), key, "left_semi"), known, key, F.col("bias")).join(weighed, key)
    rows = sparse_rows(cells, key, block_rows, by=["label", "weight"])
    blocks = max(1, -(-n // block_rows))
    if rounds is None:
        rounds, local_passes, gap = (MOST_ROUNDS, local_passes or LOCAL_PASSES, gap) if balanced else (PLAIN_PASSES, 1, 0.0)
    scale = problems / (reg * max(n, 1))
    kind = rows.schema[key].dataType.simpleString()
    row_kind = rows.select("block", key, "label", "weight", "terms", "values")

    def of_block(rows: pa.Table, vectors: pa.Table):
        """(rows, alpha, terms, places of those that other blocks have as well, cells, weights).

        The weights of the others follow from alpha, so they go nowhere."""
        state = rows.filter(pa.compute.is_valid(rows["alpha"]))
        rows = rows.filter(pa.compute.is_valid(rows["terms"]))
        alpha = np.zeros((rows.num_rows, classes))
        if state.num_rows:
            before = {k: i for i, k in enumerate(state[key].to_pylist())}
            alpha = _matrix(state["alpha"], classes)[[before[k] for k in rows[key].to_pylist()]].copy()
        terms = np.unique(rows["terms"].combine_chunks().flatten().to_numpy())
        cells = Cells.of(rows, terms)
        weights = scale * cells.back(alpha * _signs(rows, classes), len(terms))
        shared = np.searchsorted(terms, vectors["term"].to_numpy())
        weights[shared] = 0
        if known := vectors.filter(pa.compute.is_valid(vectors["vector"])):
            weights[np.searchsorted(terms, known["term"].to_numpy())] = _matrix(known["vector"], classes)
        return rows, alpha, terms, np.sort(shared), cells, weights

    def ascend(round_: int) -> Callable:
        def run(rows: pa.Table, vectors: pa.Table) -> pa.Table:
            block = rows["block"][0].as_py()
            rows, alpha, terms, shared, cells, weights = of_block(rows, vectors)
            square = (weights**2).sum() - (weights[shared] ** 2).sum()
            alpha, change, loss, dual = _ascent(rows, cells, weights, alpha, scale, blocks, local_passes or 1, seed + 1000 * round_ + block)
            moved = shared[np.abs(change[shared]).max(axis=1, initial=0) > 0]
            states = pa.table({
                "block": pa.array(np.full(rows.num_rows, block, np.int32)), key: rows[key], "alpha": _lists(alpha),
                "term": pa.nulls(rows.num_rows, pa.int64()), "change": pa.nulls(rows.num_rows, pa.list_(pa.float64())),
                **{name: pa.nulls(rows.num_rows, pa.float64()) for name in ("loss", "dual", "square")},
            })
            changes = pa.table({
                "block": pa.nulls(len(moved), pa.int32()), key: pa.nulls(len(moved), rows[key].type), "alpha": pa.nulls(len(moved), pa.list_(pa.float64())),
                "term": pa.array(terms[moved]), "change": _lists(change[moved]),
                **{name: pa.nulls(len(moved), pa.float64()) for name in ("loss", "dual", "square")},
            })
            sums = pa.table({
                "block": pa.nulls(1, pa.int32()), key: pa.nulls(1, rows[key].type), "alpha": pa.nulls(1, pa.list_(pa.float64())),
                "term": pa.nulls(1, pa.int64()), "change": pa.nulls(1, pa.list_(pa.float64())),
                "loss": pa.array([loss]), "dual": pa.array([dual]), "square": pa.array([square]),
            })
            return pa.concat_tables([states, changes, sums])

        return run

    def own_weights(rows: pa.Table, vectors: pa.Table) -> pa.Table:
        """The weights of the terms that no other block has."""
        _, _, terms, shared, _, weights = of_block(rows, vectors)
        used = np.setdiff1d(np.flatnonzero(np.abs(weights).max(axis=1, initial=0) > 0), shared)
        return pa.table({"term": pa.array(terms[used]), "vector": _lists(weights[used])})

    spark = features.sparkSession
    needed = stage(rows.select("block", F.explode("terms").alias("term")).distinct(), "block-terms")
    several = needed.groupBy("term").agg(F.count("*").alias("_blocks")).filter("_blocks > 1")
    needed = stage(needed.join(several.select("term"), "term", "left_semi"), "shared-terms")
    nothing = spark.createDataFrame([], f"block int, {key} {kind}, alpha array<double>, term bigint, change array<double>, loss double, dual double, square double")
    state, weights = nothing, nothing.select("term", F.col("change").alias("vector"))

    def met(state: DataFrame, weights: DataFrame):
        static = row_kind.withColumn("alpha", F.lit(None).cast("array<double>"))
        known_state = state.filter("alpha is not null").select(
            "block", key, F.lit(None).cast("int").alias("label"), F.lit(None).cast("double").alias("weight"),
            F.lit(None).cast("array<bigint>").alias("terms"), F.lit(None).cast("array<double>").alias("values"), "alpha",
        )
        return renamed(static.unionAll(known_state)).groupBy("block").cogroup(needed.join(weights, "term", "left").groupBy("block"))

    for round_ in range(rounds):
        before, state = state, stage(met(state, weights).applyInArrow(ascend(round_), nothing.schema), "ascent")
        if gap and round_:
            sums = state.agg(*[F.sum(name).alias(name) for name in ("loss", "dual", "square")]).first()
            square = sums["square"] + (weights.agg(F.sum(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))).first()[0] or 0.0)
            primal = reg / 2 * square + sums["loss"] * problems / n
            dual = sums["dual"] * problems / n - reg / 2 * square
            if primal - dual <= gap * max(abs(dual), 1e-12):
                state = before
                break
        changes = state.filter("term is not null").select("term", F.col("change").alias("vector"))
        weights = stage(_summed(weights.unionAll(changes)), "weights")
    own = met(state, weights).applyInArrow(own_weights, "term bigint, vector array<double>")
    return HingeModel(stage(weights.unionAll(own), "weights"), classes)


def hinge_margins(
    model: HingeModel, features: DataFrame, keys: DataFrame, key: str, block_rows: int = BLOCK_ROWS, bias: Column | None = None
) -> DataFrame:
    """(key, margins): the margin of every class for all ``keys``; unknown terms count nothing."""
    rows = sparse_rows(with_bias(features, keys, key, bias), key, block_rows)
    return block_sums(rows, key, model.weights, model.classes).withColumnRenamed("sums", "margins")


def predicted_class(margins: DataFrame, out: str = "prediction") -> DataFrame:
    """The class with the largest margin, ties to the smaller one."""
    return margins.withColumn(out, (F.array_position("margins", F.array_max("margins")) - 1).cast("int"))


def fourier_vectors(terms: DataFrame, gamma: float = 1.0, dims: int = 100, seed: int = 1) -> DataFrame:
    """(term, vector): random weights of each term, normal with variance 2 * gamma, from the
    hash of (seed, term, dimension), so that no table of them has to be kept."""
    numbers = F.sequence(F.lit(0), F.lit(dims - 1))

    def unit(d, kind: str):
        label = F.concat(F.lit(f"{seed}:"), F.col("term").cast("string"), F.lit(":"), d.cast("string"), F.lit(f":{kind}"))
        return (F.conv(F.substring(F.md5(label.cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / 2**32

    normal = F.transform(
        numbers, lambda d: F.sqrt(F.lit(2 * gamma)) * F.sqrt(-2 * F.log(unit(d, "r"))) * F.cos(2 * F.pi() * unit(d, "a"))
    )
    return terms.select("term", normal.alias("vector"))


def sparse_fourier(rows: DataFrame, key: str, vectors: DataFrame, dims: int = 100, seed: int = 1) -> DataFrame:
    """(key, mapped): sqrt(2 / dims) * cos(projection + offset) of sparse rows of text."""
    numbers = F.sequence(F.lit(0), F.lit(dims - 1))
    label = lambda d: F.concat(F.lit(f"{seed}:"), d.cast("string"), F.lit(":b")).cast("binary")
    offsets = F.transform(
        numbers, lambda d: 2 * F.pi() * ((F.conv(F.substring(F.md5(label(d)), 1, 8), 16, 10).cast("double") + 0.5) / 2**32)
    )
    sums = block_sums(rows, key, vectors, dims).withColumn("offsets", offsets)
    return sums.select(key, F.zip_with("sums", "offsets", lambda x, b: (2.0 / dims) ** 0.5 * F.cos(x + b)).alias("mapped"))
