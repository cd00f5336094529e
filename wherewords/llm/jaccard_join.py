"""Near-duplicate texts: a Jaccard join of shingle sets by adaptive multi-match prefixes.

All sets have their shingles in one order: those found to be common last, by how common
they are, the others by hash. Two sets with an overlap of at least ``o`` share ``l`` of
their first ``n - o + l`` shingles for any ``l``, so a longer prefix may ask for more:

1. Every distinct set has a short prefix. How often its shingles occur in other prefixes
   is the estimate of its candidates; a set with too few shared ones has no partner.
2. The sets that are left get a prefix by that estimate: the more candidates, the longer
   it is and the more shingles must be shared. Sets with too few are left out again.
3. Each shingle's sets have one pivot, the same wherever it occurs, and each set joins the
   pivot it shares most with. Within such a cluster, sets are compared block by block, all
   at once; a task holds two blocks, and gives no more links than they have sets.
4. Pairs across clusters that share enough prefix shingles are compared one by one.

A comparison takes the whole sets. Equal sets are one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wherewords.llm.components import merged
from wherewords.llm.tables import WordBatch, list_array, mix, pieces, small_batches, steady_places, table, texts_of, without_rows
from wherewords.session import stage

#: The contract of op4_jaccard_join; elsewhere they are arguments.
PERCENT, SHINGLE_WORDS = 90, 3
#: Matches asked for, as 1 in so many of a set's shingles; and from what estimate of
#: candidates per prefix shingle on.
FIRST_MATCHES = 20
MATCHES = [(0, 20), (3, 5), (16, 2)]
#: A shingle is common from this share of all shingles on: so there are at most as many.
COMMON = 500_000
#: Matches with its pivot, as 1 in so many, for which a set joins a cluster.
PIVOT_MATCHES = 60
BLOCK_SETS = 200
#: Rows of two blocks in an Arrow batch.
BLOCK_ROWS = 4
#: Up to so many rows of a few numbers are broadcast to pick texts or sets; with more, those
#: are shuffled for it.
BROADCAST_ROWS = 1_000_000
SET_ROWS = 500


def shingle_sets(texts: list[str], size: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of ``size`` words; a shorter text is one shingle."""
    words = WordBatch(texts)
    h = words.hashes
    spread = np.uint64(0x9E3779B97F4A7C15)
    n = max(len(h) - size + 1, 0)
    every = mix(h[size - 1 :])
    for k in range(size - 2, -1, -1):
        every = mix(h[k : k + n] * spread + every)
    sets = []
    for begin, end in zip(words.first[:-1], words.first[1:], strict=True):
        if end - begin >= size:
            sets.append(np.unique(every[begin : end - size + 1]))
        else:
            whole, rest = h[begin:end], np.zeros(1, np.uint64)
            for k in range(len(whole) - 1, 0, -1):
                rest = mix(whole[k : k + 1] + rest * spread)
            sets.append(mix(whole[:1] + spread * np.uint64(len(whole)) + rest[: len(whole)]))
    return sets


def overlap(n, percent: int = PERCENT):
    """The least overlap of a set of ``n`` with any partner."""
    return -(-percent * n // 100)


def repeated(words: int):
    """(shingle, c) of the shingles that several sets of a batch have; with a null, how many
    shingles there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = np.concatenate([*shingle_sets(texts_of(batch, "text"), words), np.zeros(0, np.uint64)])
            unique, counts = np.unique(every, return_counts=True)
            several = counts > 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([None, *unique[several].view(np.int64).tolist()], pa.int64()),
                    pa.array(np.append(len(every), counts[several])),
                ],
                ["shingle", "c"],
            )

    return run


class Order:
    """The order of shingles: common ones last, rarest of them first."""

    def __init__(self, common: np.ndarray, often: np.ndarray):
        self.common, self.rank = common, np.argsort(np.argsort(often, kind="stable"), kind="stable")

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.common):
            return shingles
        at = np.minimum(np.searchsorted(self.common, shingles), len(self.common) - 1)
        last = self.common[at] == shingles
        return np.concatenate([shingles[~last], shingles[last][np.argsort(self.rank[at[last]])]])


def common_order(texts: DataFrame, words: int) -> Order:
    """The order, from counts over all texts. At most :data:`COMMON` shingles are common:
    each has that share of all."""
    counts = stage(
        texts.mapInArrow(repeated(words), "shingle bigint, c bigint").groupBy("shingle").agg(F.sum("c").alias("c")), "repeated-shingles"
    )
    total = counts.filter("shingle is null").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()["n"]
    common = counts.filter(F.col("shingle").isNotNull() & (F.col("c") * COMMON >= total)).toPandas()
    shingles = common["shingle"].to_numpy(np.int64).view(np.uint64)
    by_hash = np.argsort(shingles)
    return Order(shingles[by_hash], common["c"].to_numpy(np.int64)[by_hash])


def signatures(order, words: int, percent: int):
    """Size, two digests and the short prefix of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in pieces(big, SET_ROWS):
                sets = shingle_sets(texts_of(batch, "text"), words)
                sizes = np.array([len(s) for s in sets], np.int64)
                prefixes = [order.value(s)[: len(s) - overlap(len(s), percent) + max(1, len(s) // FIRST_MATCHES)] for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row"), batch.column("key"), pa.array(sizes),
                        pa.array(np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)),
                        pa.array(np.array([np.bitwise_xor.reduce(mix(s + np.uint64(1))) for s in sets], np.uint64).view(np.int64)),
                        _lists(prefixes),
                    ],
                    ["row", "key", "n", "sum", "xor", "prefix"],
                )

    return run


def _few(numbers: DataFrame) -> DataFrame:
    """A staged table of numbers, to be broadcast if it is small enough."""
    return F.broadcast(numbers) if numbers.count() <= BROADCAST_ROWS else numbers


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    return list_array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64), [len(s) for s in sets], pa.int64())


def whole_sets(order, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in pieces(big, SET_ROWS):
                sets = [order.value(s) for s in shingle_sets(texts_of(batch, "text"), words)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(name) for name in ("node", "n", "often")), _lists(sets)], ["node", "n", "often", "shingles"]
                )

    return run


def similar(sets: list[np.ndarray], left: int, percent: int = PERCENT) -> np.ndarray:
    """Pairs of places whose sets are similar enough. With ``left``, only pairs of one of
    the first ``left`` sets and one of the others."""
    sizes = np.array([len(s) for s in sets])
    unique, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    several = counts[column] > 1
    owner, column = owner[several], (np.cumsum(counts > 1) - 1)[column[several]]
    by_column = np.argsort(column, kind="stable")
    owner, column = owner[by_column], column[by_column]
    a, b = (slice(0, left), slice(left, None)) if left else (slice(None), slice(None))
    same = np.zeros((len(sets[a]), len(sets[b])), np.float32)
    width = 4096
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [begin, begin + width])
        has = np.zeros((len(sets), width), np.float32)
        has[owner[lo:hi], column[lo:hi] - begin] = 1
        same += has[a] @ has[b].T
    union = sizes[a][:, None] + sizes[b][None, :] - same
    found = np.argwhere(100 * same >= percent * union)
    return found + [0, left] if left else found[found[:, 0] < found[:, 1]]


def spanning(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    """As few of the pairs as hold their components together."""
    top = list(range(n))

    def find(k: int) -> int:
        while top[k] != k:
            top[k] = top[top[k]]
            k = top[k]
        return k

    kept = []
    for i, j in pairs.tolist():
        x, y = find(i), find(j)
        if x != y:
            top[x] = y
            kept.append((i, j))
    return kept


def compared(percent: int):
    """Links (a, b) within a block, or between two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links: list[tuple[int, int]] = []
            for own, other in zip(batch.column("members"), batch.column("others"), strict=True):
                nodes, sets, left = [], [], 0
                for members in (own, other):
                    left = len(sets)
                    if members.is_valid:
                        nodes += members.values.field("node").to_pylist()
                        lists = members.values.field("shingles")
                        sets += [lists[i].values.to_numpy() for i in range(len(lists))]
                links += [(nodes[i], nodes[j]) for i, j in spanning(similar(sets, left if left < len(sets) else 0, percent), len(sets))]
            a, b = zip(*links, strict=True) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _least_overlap(n: Column, percent: int) -> Column:
    return F.ceil(n * percent / 100)


def _least_matches(n: Column, one_in: Column) -> Column:
    return F.greatest(F.floor(n / one_in), F.lit(1))


def _shared(prefixes: DataFrame) -> DataFrame:
    """Rows (shingle, node, ...) of shingles with several nodes. ``often`` counts those, and
    ``with_k`` those among them that ask for 1 in k matches."""
    counts = [F.count_if(F.col("one_in") == one).alias(f"with_{one}") for _, one in MATCHES]
    often = stage(
        prefixes.groupBy("shingle").agg(F.count("*").alias("often"), *counts).filter("often > 1"), "shared-shingles"
    )
    return prefixes.join(often, "shingle")


def _promising(shared: DataFrame, percent: int) -> DataFrame:
    """(node, n, often): nodes that share enough for some kind of partner.

    A partner is no smaller than the node's least overlap, and of both demands the smaller
    one holds. ``often`` is the mean number of nodes of a shared shingle.
    """
    hits = [
        F.count_if(F.col(f"with_{one}") > (F.col("one_in") == one).cast("int")).alias(f"hits_{one}") for _, one in MATCHES
    ]
    sums = shared.groupBy("node").agg(
        F.first("n").alias("n"), F.first("one_in").alias("one_in"), (F.sum("often") / F.count("*")).alias("often"), *hits
    )
    enough = F.lit(False)
    for _, one in MATCHES:
        least = _least_matches(_least_overlap(F.col("n"), percent), F.greatest("one_in", F.lit(one)))
        enough = enough | (F.col(f"hits_{one}") >= least)
    return sums.filter(enough).select("node", "n", "often")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    same = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - same
    pairs = _few(stage(pairs.select("a", "b"), "pairs"))
    return left.join(pairs, "a").join(right, "b").filter(100 * same >= percent * union).select("a", "b")


def _fit(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, percent: int = PERCENT
) -> DataFrame:
    """One row per document: (key, n_shingles, component_id).

    Two texts are linked if their sets of shingles, ``words`` words in a row, have a Jaccard
    similarity of ``percent`` or more. Words are runs without ASCII white space, A-Z in lower
    case; texts of fewer words are one shingle; nulls and empty texts have none and are alone. ``component_id`` is the
    smallest key of the component; rows without a key count in it but don't name it.
    Repeated rows are in one component; other columns are left out; an empty table gives
    no rows. ``docs`` is a stored table: it is read twice, and rows are told apart by
    their place.
    """
    members = _members(docs, key, text, words, percent)
    names = members.filter("comp is not null").groupBy("comp").agg(F.min("key").alias("name"))
    return members.join(names, "comp", "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("name", "key").alias("component_id")
    )


def one_per_component(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, percent: int = PERCENT
) -> DataFrame:
    """``docs`` with its columns and of each component the row with the smallest key, then
    the first one; rows without a key last. Rows without shingles all stay."""
    members = _members(docs, key, text, words, percent).filter("comp is not null")
    rank = F.struct(F.col("key").isNull().alias("no_key"), "key", "row")
    first = members.groupBy("comp").agg(F.min(rank).alias("first"), F.count("*").alias("size")).filter("size > 1")
    gone = members.join(first, "comp").filter(F.col("row") != F.col("first.row")).select("row")
    return without_rows(docs, stage(gone, "near-duplicates"))


def _members(docs: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """(row, key, n, comp) of all rows; no comp without shingles."""
    spark = docs.sparkSession
    small_batches(spark)
    steady_places(spark)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")
    )
    order = spark.sparkContext.broadcast(common_order(rows.select("text"), words))
    signed = stage(
        rows.mapInArrow(signatures(order, words, percent), "row bigint, key bigint, n bigint, sum bigint, xor bigint, prefix array<bigint>"),
        "signatures",
    )
    same = ["n", "sum", "xor"]
    nodes = stage(signed.filter("n > 0").groupBy(*same).agg(F.min("row").alias("node")), "nodes")
    labels = _linked(rows, signed, nodes, order, words, percent)
    placed = nodes.join(labels, "node", "left").select(*same, F.coalesce("comp", "node").alias("comp"))
    return stage(signed.select("row", "key", *same).join(placed, same, "left").select("row", "key", "n", "comp"), "members")


def _linked(rows: DataFrame, signed: DataFrame, nodes: DataFrame, order, words: int, percent: int) -> DataFrame:
    """(node, comp) of the nodes that may have partners."""
    one_in = F.lit(FIRST_MATCHES)
    first = (
        signed.select(F.col("row").alias("node"), "n", "prefix")
        .join(_few(nodes.select("node")), "node", "left_semi")
        .select("node", "n", one_in.alias("one_in"), F.explode("prefix").alias("shingle"))
    )
    partners = stage(_promising(_shared(first), percent), "promising")

    sets = stage(
        rows.select(F.col("row").alias("node"), "text").join(_few(partners), "node").mapInArrow(
            whole_sets(order, words), "node bigint, n bigint, often double, shingles array<bigint>"
        ),
        "sets",
    )
    divisor = F.lit(MATCHES[0][1])
    for from_often, one in MATCHES[1:]:
        divisor = F.when(F.col("often") >= from_often, one).otherwise(divisor)
    size = (F.col("n") - _least_overlap(F.col("n"), percent) + _least_matches(F.col("n"), F.col("one_in"))).cast("int")
    longer = sets.withColumn("one_in", divisor).select(
        "node", "n", "one_in", F.explode(F.slice("shingles", 1, size)).alias("shingle")
    )
    kept = stage(_promising(_shared(longer), percent).select("node"), "candidates")
    sets = stage(sets.join(_few(kept), "node", "left_semi").select("node", "n", "shingles"), "sets")

    size = (F.col("n") - _least_overlap(F.col("n"), percent) + _least_matches(F.col("n"), F.lit(FIRST_MATCHES))).cast("int")
    prefixes = sets.select("node", "n", F.lit(FIRST_MATCHES).alias("one_in"), F.explode(F.slice("shingles", 1, size)).alias("shingle"))
    prefixes = stage(_shared(prefixes).select("shingle", "node", "n"), "prefixes")
    labels = kept.select("node", F.col("node").alias("comp"))
    clusters = merged(labels, stage(_pivots(prefixes, percent), "pivots"))
    links = _block_links(clusters, sets, percent).unionAll(_verified(_cross_pairs(prefixes, clusters, percent), sets, percent))
    return merged(labels, stage(links, "links"))


def _pivots(prefixes: DataFrame, percent: int) -> DataFrame:
    """(a, b): each node with the pivot that it shares most with, if that is enough."""
    rank = F.xxhash64("node")
    pivots = prefixes.groupBy("shingle").agg(F.min(F.struct(rank.alias("rank"), "node", "n")).alias("pivot"))
    met = prefixes.join(pivots, "shingle").filter(
        (F.col("node") != F.col("pivot.node")) & _fit(F.col("n"), F.col("pivot.n"), percent)
    )
    counts = met.groupBy(F.col("node").alias("a"), F.col("pivot.node").alias("b")).agg(
        F.count("*").alias("hits"), F.first(F.least("n", "pivot.n")).alias("n")
    )
    best = counts.groupBy("a").agg(F.max(F.struct("hits", "b", "n")).alias("best"))
    return best.filter(F.col("best.hits") >= _least_matches(F.col("best.n"), F.lit(PIVOT_MATCHES))).select("a", F.col("best.b").alias("b"))


def _block_links(clusters: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the nodes of a cluster, all pairs compared, block by block."""
    spark = sets.sparkSession
    sizes = clusters.groupBy("comp").agg(F.ceil(F.count("*") / BLOCK_SETS).alias("blocks"), F.count("*").alias("size")).filter("size > 1")
    block = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks"))
    placed = stage(clusters.join(sizes, "comp").select("node", "comp", "blocks", block.alias("block")), "places")
    # About BLOCK_SETS sets in each.
    blocks = stage(
        sets.select("node", "shingles").join(_few(placed), "node").groupBy("comp", "blocks", "block").agg(F.collect_list(F.struct("node", "shingles")).alias("members")),
        "blocks",
    )
    other = blocks.select("comp", F.col("block").alias("after"), F.col("members").alias("others"))
    pairs = blocks.filter("blocks > 1").join(other, "comp").filter("block < after").select("members", "others")
    alone = blocks.select("members", F.lit(None).cast(blocks.schema["members"].dataType).alias("others"))
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BLOCK_ROWS)
    try:
        return stage(alone.unionAll(pairs).mapInArrow(compared(percent), "a bigint, b bigint"), "block-links")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def _cross_pairs(prefixes: DataFrame, clusters: DataFrame, percent: int) -> DataFrame:
    """(a, b): all pairs across clusters that share as many prefix shingles as asked for."""
    own = prefixes.join(clusters, "node")
    split = own.groupBy("shingle").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high")
    left = stage(own.join(split.select("shingle"), "shingle", "left_semi"), "open-prefixes")
    a, b = left.alias("a"), left.alias("b")
    met = a.join(
        b,
        (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.comp") < F.col("b.comp")) & _fit(F.col("a.n"), F.col("b.n"), percent),
    )
    return (
        met.groupBy(F.col("a.node").alias("a"), F.col("b.node").alias("b"))
        .agg(F.count("*").alias("hits"), F.first(F.least("a.n", "b.n")).alias("n"))
        .filter(F.col("hits") >= _least_matches(F.col("n"), F.lit(FIRST_MATCHES)))
    )


def op4_jaccard_join(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
