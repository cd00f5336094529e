"""Near copies by an LSH forest of MinHash signatures.

A text's signature is sorted in several orders, each beginning at another of its values. In
a sorted order similar texts lie together, the closer the longer the prefix that they
share. How deep a prefix has to be for two texts to be candidates is a matter of the region:

* texts that share a short prefix with few others are compared with all of those;
* where many share it, the region is cut at the next value, and so on, until few are left;
* wherever a text ends up, its next neighbours in the order are candidates as well;
* when the links so far have joined texts to components, regions that were cut are looked at
  once more from the top: now only pairs across components count, and a region whose texts
  are mostly one component has few of those, however many texts it holds.

Orders are sorted by ranges, so that a region of any size is many tasks; what lies on both
sides of a cut between tasks is looked at once more. Candidates pass a sketch of 128 bits, and
are confirmed on their whole sets: first the best one of each text, then what would join two
components that are still apart.

Two texts of similarity ``s`` are missed with a chance of ``(1 - s**d) ** ORDERS``, where ``d`` is
the depth of their region: at 0.85 that is 4e-7 for 4 values, 2e-3 for 8, the latter only where
many texts share 7 values and are still of many components. Equal sets are one node from the
start, so that exact copies make no region dense.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wherewords.llm.components import merged
from wherewords.llm.jaccard_join import shingle_sets
from wherewords.llm.tables import few, list_array, mix, pieces, small_batches, steady_places, table, texts_of
from wherewords.session import stage

#: The contract of op13_lsh_forest; defaults are five words and 80 %.
PERCENT, SHINGLE_WORDS = 85, 3
#: Sorted orders, values between the beginnings of two of them, values that are sorted by.
ORDERS, STEP, DEPTH = 20, 8, 16
VALUES = ORDERS * STEP
#: Least depth of candidates, and most texts of a region that are all compared.
LEAST_DEPTH, REGION = 4, 16
#: Pairs across components for each text of a region, up to which all of those are candidates.
ACROSS = 4
#: Neighbours in the order, on either side, that are candidates at any density.
NEIGHBOURS = 2
SKETCH_BITS = 128
#: Standard deviations below the expected agreement of sketches that still pass.
SLACK = 4.5
#: Sorted rows of a task.
TASK_ROWS = 200_000
SET_ROWS = 200
#: Tasks that share the rows of a component.
SALTS = 16

_SEEDS = mix(np.arange(1, 2 * VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_TIMES, _PLUS = (_SEEDS[:VALUES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (_SEEDS[VALUES:] >> np.uint64(32)).astype(np.uint32)


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """A row of :data:`VALUES` 16-bit values for each set that is not empty."""
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    shingles = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), VALUES), np.uint16)
    for k in range(VALUES):
        least = np.minimum.reduceat(shingles * _TIMES[k] + _PLUS[k], starts)
        # Minima are small numbers: their upper bits alone would tell little.
        out[:, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row's bytes as one value."""
    raw = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)
    return pa.array([r.tobytes() for r in raw], pa.binary())


def _bytes(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _signed(words: int):
    """Size, two digests, signature and sketch of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in pieces(big, SET_ROWS):
                sets = shingle_sets(texts_of(batch, "text"), words)
                sizes = np.array([len(s) for s in sets], np.int64)
                values = np.zeros((len(sets), VALUES), np.uint16)
                if sizes.any():
                    values[sizes > 0] = minhash([s for s in sets if len(s)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row"), batch.column("key"), pa.array(sizes),
                        pa.array(np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)),
                        pa.array(np.array([np.bitwise_xor.reduce(mix(s + np.uint64(1))) for s in sets], np.uint64).view(np.int64)),
                        _binary(values), _binary(np.packbits((values[:, :SKETCH_BITS] & 1).astype(bool), axis=1)),
                    ],
                    ["row", "key", "n", "sum", "xor", "values", "sketch"],
                )

    return run


def _least_agreement(percent: int) -> float:
    share = (1 + percent / 100) / 2
    return SKETCH_BITS * share - SLACK * (SKETCH_BITS * share * (1 - share)) ** 0.5


class Sorted:
    """Rows in one of the sorted orders after the other."""

    def __init__(self, rows: pa.Table):
        self.rows = rows
        self.node, self.n = rows["node"].to_numpy(), rows["n"].to_numpy()
        values = _bytes(rows["prefix"], 2 * DEPTH).view(np.uint16)
        self.sketch = _bytes(rows["sketch"], SKETCH_BITS // 8).view(np.uint64)
        order = rows["order"].to_numpy()
        same = (values[1:] == values[:-1]) & (order[1:] == order[:-1])[:, None]
        #: Values that a row shares with the one before it, from the first on.
        self.shared = np.concatenate([[0], np.cumprod(same, axis=1, dtype=np.uint8).sum(axis=1)])[: len(order)]

    def regions(self) -> tuple[np.ndarray, np.ndarray]:
        """A region of each row, and the first row of those that stay too large at any depth."""
        n = len(self.node)
        region, open_, pivot = np.full(n, -1, np.int64), np.ones(n, bool), np.arange(n)
        self.cut = np.zeros(n, bool)
        for depth in range(LEAST_DEPTH, DEPTH + 1):
            run = np.cumsum(self.shared < depth) - 1
            small = open_ & (np.bincount(run, minlength=1)[run] <= REGION)
            region[small] = run[small] + depth * (n + 1)
            open_ &= ~small
            #: Rows of regions that were cut.
            self.cut |= open_
            if not open_.any():
                return region, pivot
        first = np.flatnonzero(self.shared < DEPTH)[run]
        pivot[open_] = first[open_]
        return region, pivot

    def candidates(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of nodes that share enough for their region and pass the sketch."""
        region, pivot = self.regions()
        places = np.arange(len(self.node))
        found = [(pivot[pivot < places], places[pivot < places])]
        linked = self.shared >= LEAST_DEPTH
        for step in range(1, min(REGION, len(places))):
            left, right = places[:-step], places[step:]
            near = (region[left] >= 0) & (region[left] == region[right])
            if step <= NEIGHBOURS:
                between = np.lib.stride_tricks.sliding_window_view(linked[1:], step).all(axis=1)
                near |= between
            found.append((left[near], right[near]))
        i, j = (np.concatenate(c) for c in zip(*found, strict=True))
        a, b, _ = self.alike(i, j, percent)
        return a, b

    def alike(self, i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes of the pairs of rows that pass by size and sketch, and the sketches' agreement."""
        fit = 100 * np.minimum(self.n[i], self.n[j]) >= percent * np.maximum(self.n[i], self.n[j])
        i, j = i[fit], j[fit]
        bits = SKETCH_BITS - np.bitwise_count(self.sketch[i] ^ self.sketch[j]).sum(axis=1, dtype=np.int64)
        near = bits >= _least_agreement(percent)
        i, j = i[near], j[near]
        return np.minimum(self.node[i], self.node[j]), np.maximum(self.node[i], self.node[j]), bits[near]

    def across(self, percent: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of rows of two components, in regions as wide as :data:`ACROSS` allows."""
        comp = self.rows["comp"].to_numpy()
        open_, found = np.ones(len(comp), bool), []
        for depth in range(LEAST_DEPTH, DEPTH + 1):
            run = np.cumsum(self.shared < depth) - 1
            size = np.bincount(run)
            _, first, each = np.unique(np.stack([run, comp]), axis=1, return_index=True, return_counts=True)
            crossing = (size**2 - np.bincount(run[first], each.astype(float) ** 2)) / 2
            closed = open_ & (crossing <= ACROSS * size)[run]
            begins = np.append(np.flatnonzero(self.shared < depth), len(comp))
            for k in np.unique(run[closed & (crossing > 0)[run]]):
                own = np.arange(begins[k], begins[k + 1])
                names, place, counts = np.unique(comp[own], return_inverse=True, return_counts=True)
                main = place == counts.argmax()
                # Each row outside the largest component with all rows of the others after it, or in that.
                outside = np.flatnonzero(~main)
                left, right = np.nonzero((place[outside][:, None] != place) & (main | (np.arange(len(own)) > outside[:, None])))
                found.append(self.alike(own[outside[left]], own[right], percent))
            open_ &= ~closed
            if not open_.any():
                break
        return found

    def ends(self) -> pa.Table:
        """The first and last rows that may have partners in the tasks before and after."""
        breaks = np.flatnonzero(self.shared < LEAST_DEPTH)
        n = len(self.node)
        head = min(REGION, int(breaks[1]) if len(breaks) > 1 else n)
        tail = max(n - REGION, int(breaks[-1]), head)
        return pa.concat_tables([self.rows.slice(0, head), self.rows.slice(tail)])


ROW = "order int, prefix binary, node bigint, n bigint, sketch binary"
_ROW_SCHEMA = pa.schema([("order", pa.int32()), ("prefix", pa.binary()), ("node", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary())])
#: What a line of the walk is.
PAIR, END, CUT = 0, 1, 2


def _lines(kind: int, a: pa.Array, b: pa.Array, rows: pa.Table | None) -> pa.RecordBatch:
    n = len(a)
    columns = [c.combine_chunks() for c in rows.columns] if rows else [pa.nulls(n, f.type) for f in _ROW_SCHEMA]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), a, b, *columns], ["kind", "a", "b", *_ROW_SCHEMA.names])


def _walked(percent: int):
    """Candidates (a, b) of a task's rows, then its ends and its rows of cut regions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [batch for batch in batches if batch.num_rows]
        if not parts:
            return
        rows = Sorted(pa.Table.from_batches(parts).select(_ROW_SCHEMA.names))
        a, b = rows.candidates(percent)
        yield _lines(PAIR, pa.array(a), pa.array(b), None)
        for kind, own in ((END, rows.ends()), (CUT, rows.rows.filter(pa.array(rows.cut)))):
            none = pa.nulls(own.num_rows, pa.int64())
            yield _lines(kind, none, none, own)

    return run


def _crossed(percent: int):
    """(a, b, hits) of the pairs across components, ``hits`` being the sketches' agreement."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [batch for batch in batches if batch.num_rows]
        found = Sorted(pa.Table.from_batches(parts)).across(percent) if parts else []
        if found:
            # A pair that meets in several orders of the task is one.
            pairs, first = np.unique(np.stack([np.concatenate([a for a, _, _ in found]), np.concatenate([b for _, b, _ in found])]), axis=1, return_index=True)
            bits = np.concatenate([n for _, _, n in found])[first]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(bits)], ["a", "b", "hits"])

    return run


def _sets_of(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in pieces(big, SET_ROWS):
                sets = shingle_sets(texts_of(batch, "text"), words)
                shingles = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node"), list_array(shingles, [len(s) for s in sets], pa.int64())], ["node", "shingles"]
                )

    return run


def _orders(nodes: DataFrame) -> DataFrame:
    """Each node's row in each order."""
    twice = nodes.select("node", "n", "sketch", F.concat("values", "values").alias("twice"))
    return twice.select("node", "n", "sketch", "twice", F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1))).alias("order")).select(
        "order", F.substring("twice", F.col("order") * (2 * STEP) + 1, F.lit(2 * DEPTH)).alias("prefix"), "node", "n", "sketch"
    )


def _in_order(rows: DataFrame, n: int) -> DataFrame:
    """The rows sorted by ranges, some hundred thousand a task."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ROWS))
    place = ["order", "prefix", "node"]
    return rows.repartitionByRange(tasks, *place).sortWithinPartitions(*place)


def _candidates(nodes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(a, b, hits): pairs of nodes, and in how many orders they met; and the rows of the
    orders whose regions were cut."""
    rows = _in_order(_orders(nodes), nodes.count() * ORDERS)
    walked = stage(rows.mapInArrow(_walked(percent), f"kind int, a bigint, b bigint, {ROW}"), "walked")

    def over_cuts(group: pa.Table) -> pa.Table:
        own = group.select(_ROW_SCHEMA.names).sort_by([("prefix", "ascending"), ("node", "ascending")])
        a, b = Sorted(own).candidates(percent)
        return pa.table({"a": a, "b": b})

    ends = walked.filter(F.col("kind") == END).select(*_ROW_SCHEMA.names, F.substring("prefix", 1, 2 * LEAST_DEPTH).alias("region"))
    # At most 2 * REGION rows of each task, so few of even a hot region.
    seams = ends.groupBy("order", "region").applyInArrow(over_cuts, "a bigint, b bigint")
    met = walked.filter(F.col("kind") == PAIR).select("a", "b").unionAll(seams)
    pairs = stage(met.groupBy("a", "b").agg(F.count("*").alias("hits")), "candidates")
    return pairs, walked.filter(F.col("kind") == CUT).select(*_ROW_SCHEMA.names)


def _crossing(cut: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(a, b, hits): candidates across components from the regions that were cut."""
    own = cut.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    crossed = _in_order(own, cut.count()).mapInArrow(_crossed(percent), "a bigint, b bigint, hits bigint")
    return stage(crossed.groupBy("a", "b").agg(F.max("hits").alias("hits")), "crossing")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    pairs = stage(pairs.select("a", "b"), "pairs")
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")).join(few(pairs), "a")
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    same = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - same
    return left.join(right, "b").filter(100 * same >= percent * union).select("a", "b")


def _best(pairs: DataFrame) -> DataFrame:
    """Of each node the pair that met most often."""
    # Each side is brought down to a row per node before the two meet.
    sides = [
        pairs.groupBy(F.col(own).alias("node")).agg(F.max(F.struct("hits", F.col(other).alias("other"))).alias("best"))
        for own, other in (("a", "b"), ("b", "a"))
    ]
    best = sides[0].unionAll(sides[1]).groupBy("node").agg(F.max("best").alias("best"))
    return best.select(F.least("node", "best.other").alias("a"), F.greatest("node", "best.other").alias("b")).distinct()


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs that lie in two components."""
    own = labels.select(F.col("node").alias("a"), F.col("comp").alias("comp_a"))
    other = labels.select(F.col("node").alias("b"), F.col("comp").alias("comp_b"))
    return pairs.join(own, "a").join(other, "b").filter("comp_a <> comp_b").select("a", "b", "hits")


def _joined(rows: DataFrame, pairs: DataFrame, labels: DataFrame, words: int, percent: int) -> DataFrame:
    """``labels`` (node, comp) with what the pairs (a, b, hits) join when confirmed; nodes that
    are new are added."""
    nodes = stage(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "paired")
    sets = stage(
        rows.select(F.col("row").alias("node"), "text").join(few(nodes), "node", "left_semi").mapInArrow(
            _sets_of(words), "node bigint, shingles array<bigint>"
        ),
        "sets",
    )
    new = nodes.join(labels, "node", "left_anti").select("node", F.col("node").alias("comp"))
    labels = stage(labels.unionAll(new), "labels")
    for _ in range(2):
        first = stage(_best(pairs), "best")
        labels = merged(labels, stage(_confirmed(first, sets, percent), "links"))
        pairs = stage(_apart(pairs.join(first, ["a", "b"], "left_anti"), labels), "apart")
    return merged(labels, stage(_confirmed(pairs, sets, percent), "links"))


def _components(rows: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, comp) of all nodes that have candidates."""
    pairs, cut = _candidates(nodes, percent)
    none = pairs.limit(0).select(F.col("a").alias("node"), F.col("b").alias("comp"))
    labels = _joined(rows, pairs, none, words, percent)
    return _joined(rows, _crossing(cut, labels, percent), labels, words, percent)


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: (key, n_shingles, component_id, kept).

    Two texts are linked if their sets of shingles, ``words`` words in a row, have a Jaccard
    similarity of ``percent`` or more. Words are runs without ASCII white space, A-Z in lower
    case; texts of fewer words are one shingle; nulls and empty texts have none and are
    alone. ``component_id`` is the smallest key of the component; rows without a key count
    in it but don't name it. ``kept``: the row has that key; a row without a key only if it is the
    first of a component that has none. Repeated rows are in one component; other columns are left out;
    an empty table gives no rows. ``docs`` is a stored table: it is read twice, and rows are
    told apart by their place.
    """
    spark = docs.sparkSession
    small_batches(spark)
    steady_places(spark)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")
    )
    signed = stage(
        rows.mapInArrow(_signed(words), "row bigint, key bigint, n bigint, sum bigint, xor bigint, values binary, sketch binary"), "signed"
    )
    same = ["n", "sum", "xor"]
    heads = stage(signed.filter("n > 0").groupBy(*same).agg(F.min("row").alias("node")), "heads")
    nodes = signed.select(F.col("row").alias("node"), "n", "values", "sketch").join(few(heads.select("node")), "node", "left_semi")
    labels = _components(rows, stage(nodes, "nodes"), words, percent)
    placed = heads.join(labels, "node", "left").select(*same, F.coalesce("comp", "node").alias("comp"))
    members = stage(signed.select("row", "key", *same).join(placed, same, "left").select("row", "key", "n", "comp"), "members")
    # Only components of several rows have a name to look up; salted, as one may hold most rows.
    names = (
        members.filter("comp is not null").groupBy("comp")
        .agg(F.min("key").alias("name"), F.min("row").alias("first"), F.count("*").alias("size")).filter("size > 1")
        .select("comp", "name", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    members = members.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    first: Column = F.coalesce(F.col("row") == F.col("first"), F.lit(True))
    component = F.coalesce("name", "key")
    return members.join(names, ["comp", "salt"], "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.when(F.col("key").isNotNull(), F.col("key") == component).otherwise(F.col("name").isNull() & first).alias("kept"),
    )


def op13_lsh_forest(spark, sf_dir):
    return near_copies(table(spark, sf_dir, "documents"), words=SHINGLE_WORDS, percent=PERCENT)
