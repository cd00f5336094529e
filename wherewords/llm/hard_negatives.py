"""Hard negatives by slots: for each positive of an anchor, the best rows of other labels
whose score lies in a window below the positive's.

The windows of an anchor's positives overlap, but their upper limits cut the scores into
disjoint slots: slot ``j`` is what lies under the ``j``-th limit and not under the next. Tasks
keep the best few rows of each slot, merges of tasks keep the best few of those, and what
lies under the ``j``-th limit is slot ``j`` followed by all later ones: one walk from the last
slot up answers all windows. A window's lower limit then cuts the end of its answer off.

Anchors meet all rows in cells, blocks of anchors by blocks of rows, so that a task holds
two blocks of bounded size whatever the labels and scores are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wherewords.llm.tables import table
from wherewords.session import stage

#: Rows and anchors of a block; anchors that a task scores at once.
ROWS, ANCHORS, AT_ONCE = 8192, 2048, 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score in percent of the positive's: at least, at most.
LOW, HIGH = 50, 95


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows; shorter ones count as ending in zeros."""
    lists = column.combine_chunks()
    lengths = lists.value_lengths().to_numpy()
    width = int(lengths.max(initial=0))
    values = lists.flatten().to_numpy()
    if (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))
    # Whole numbers are exact in a float as long as no sum can leave its mantissa.
    reach = np.prod([np.sqrt((m.astype(float) ** 2).sum(axis=1).max(initial=0)) for m in (a, b)])
    kind = np.float32 if reach < 2**24 else np.float64 if reach < 2**53 else np.int64
    return a.astype(kind), b.astype(kind)


def _best(groups: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each group's ``k`` largest scores, ties by smaller id."""
    order = np.lexsort((ids, -scores, groups))
    own = groups[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, int)
    rank = np.arange(len(own)) - np.repeat(first, np.diff(np.r_[first, len(own)]))
    return order[rank < k]


def _scored(rows: pa.Table, anchors: pa.Table, wanted: Callable, group: Callable, k: int) -> pa.Table:
    """The best ``k`` rows of each (anchor, group) among the wanted places of the scores."""
    ids, labels = rows["id"].to_numpy(), rows["label"].to_numpy()
    anchor_ids, anchor_labels = anchors["id"].to_numpy(), anchors["label"].to_numpy()
    right, left = _same_width(_matrix(rows["vector"]), _matrix(anchors["vector"]))
    parts = []
    for begin in range(0, len(left), AT_ONCE):
        part = slice(begin, begin + AT_ONCE)
        scores = left[part] @ right.T
        same_label = anchor_labels[part, None] == labels
        i, j = np.nonzero(wanted(part, scores, same_label, anchor_ids[part, None] == ids))
        found, slots = scores[i, j].astype(np.int64), np.zeros(len(i), np.int64)
        if len(i):
            slots = group(part, i, found)
        kept = _best(i * (POSITIVES_MOST + 1) + slots, found, ids[j], k)
        parts.append((anchor_ids[part][i[kept]], slots[kept], ids[j[kept]], found[kept]))
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    return pa.table({
        "anchor": columns[0], "slot": columns[1].astype(np.int32), "id": columns[2], "score": columns[3],
    })


#: More slots than any list of limits has.
POSITIVES_MOST = 1 << 20
FOUND = "anchor bigint, slot int, id bigint, score bigint"


def _positives(k: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        return _scored(
            rows, anchors, lambda part, scores, same, itself: same & ~itself, lambda part, i, found: np.zeros(len(i), np.int64), k
        )

    return run


def _negatives(k: int):
    """Per slot; scores below the least lower limit answer nothing."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        lists = anchors["limits"].combine_chunks()
        lengths = lists.value_lengths().to_numpy()
        limits = np.full((len(lengths), int(lengths.max(initial=1))), np.iinfo(np.int64).min)
        limits[np.arange(limits.shape[1]) < lengths[:, None]] = lists.flatten().to_numpy()
        least = anchors["least"].to_numpy()

        def wanted(part, scores, same, itself):
            return ~same & (scores <= limits[part, :1]) & (scores >= least[part, None])

        def group(part, i, found):
            return (limits[part][i] >= found[:, None]).sum(axis=1) - 1

        return _scored(rows, anchors, wanted, group, k)

    return run


def _cells(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, run: Callable) -> DataFrame:
    """Every block of rows with every block of anchors, one cell a task at a time."""
    row_blocks, anchor_blocks = max(1, -(-n_rows // ROWS)), max(1, -(-n_anchors // ANCHORS))
    block = F.xxhash64("id", F.lit(12))
    in_row = F.pmod(block, F.lit(row_blocks)).cast("int")
    in_column = F.pmod(block, F.lit(anchor_blocks)).cast("int")
    left = rows.withColumn("down", in_row).withColumn("across", F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1))))
    right = anchors.withColumn("across", in_column).withColumn("down", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
    return left.groupBy("down", "across").cogroup(right.groupBy("down", "across")).applyInArrow(run, FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each (anchor, slot) over all tasks."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _suffixes(slots: Column, positives: Column, k: int) -> Column:
    """For each positive the first ``k`` of its slot and all later ones, from the last up."""

    def step(done: Column, j: Column) -> Column:
        own = F.filter(slots, lambda e: e["slot"] == j)
        last = F.get(done, F.lit(0))
        head = F.slice(F.concat(own, F.coalesce(last, F.slice(slots, 1, 0))), 1, k)
        return F.concat(F.array(head), done)

    begin = F.slice(F.array(slots), 1, 0)
    return F.aggregate(F.sequence(F.size(positives) - 1, F.lit(0), F.lit(-1)), begin, step)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "vector", label: str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vector`` holds whole numbers; a score is the inner product with the anchor, a shorter
    vector counting as ending in zeros. Higher scores come first, ties by smaller key. An
    anchor's positives are its first ``positives`` other rows of the same label; of each,
    the first ``negatives`` rows of other labels come whose score is ``low`` to ``high``
    percent of the positive's. So a positive with a negative score has none.

    Rows without key, label or vector, or with a null component, take no part. A key names
    one row: of several, that with the smallest label, then vector. ``is_anchor`` is a condition
    on the columns of ``vectors``, of which others than the three are left out; an empty
    table gives no rows, an anchor without positives or negatives none.
    """
    usable = F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull())
    rows = stage(
        vectors.filter(usable).select(
            F.col(key).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"),
            F.col(vector).cast("array<bigint>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
        )
        .groupBy("id").agg(F.min(F.struct("label", "vector", "anchor")).alias("row")).select("id", "row.*"),
        "vectors",
    )
    size = rows.agg(F.count("*").alias("rows"), F.count_if("anchor").alias("anchors")).first()
    # Names of its own, as both sides of a cell come from one table.
    anchors = rows.filter("anchor").select(*(F.col(c).alias(c) for c in ("id", "label", "vector")))
    rows = rows.drop("anchor")

    near = _cells(rows, anchors, size["rows"], size["anchors"], _positives(positives))
    pairs = stage(_top(near, positives).select("anchor", "rank", "id", "score"), "positives")

    lists = pairs.filter("score >= 0").groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("positives"))
    limit = F.transform("positives", lambda p: F.floor(p["score"] * high / 100))
    least = F.ceil(F.array_min(F.transform("positives", lambda p: p["score"])) * low / 100)
    lists = stage(lists.select(F.col("anchor").alias("id"), "positives", limit.alias("limits"), least.alias("least")), "limits")

    asked = anchors.join(lists.select("id", "limits", "least"), "id")
    slots = _top(_cells(rows, asked, size["rows"], size["anchors"], _negatives(negatives)), negatives)
    merged = slots.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("slot", "rank", "id", "score"))).alias("slots"))
    answers = lists.join(merged.withColumnRenamed("anchor", "id"), "id").select(
        F.col("id").alias("anchor_id"), F.explode(F.arrays_zip("positives", _suffixes(F.col("slots"), F.col("positives"), negatives).alias("found"))).alias("answer")
    )
    positive = F.col("answer.positives")
    return (
        answers.select("anchor_id", positive["id"].alias("positive_id"), positive["score"].alias("positive_score"), F.posexplode("answer.found").alias("place", "negative"))
        .filter(100 * F.col("negative.score") >= low * F.col("positive_score"))
        .select(
            "anchor_id", "positive_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("negative.id").alias("negative_id"),
            "positive_score", F.col("negative.score").alias("negative_score"),
        )
    )


def whole_numbers(vector: Column) -> Column:
    """floor(256 x) of each component; a null vector for a null or non-finite one."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(vector, lambda x: F.floor(256 * x.cast("double"))))


def op12_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        whole_numbers(F.col("embedding")).alias("vector"),
    )
    return hard_negatives(rows, F.col("vec_id") % 50 == 0)


SQL = f"""
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT a.id AS anchor_id, r.id, a.label = r.label AS same,
    CAST(list_sum(list_transform(list_zip(a.vec, r.vec), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v r ON a.id <> r.id WHERE a.id % 50 = 0),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT anchor_id, positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER best <= {NEGATIVES}"""
