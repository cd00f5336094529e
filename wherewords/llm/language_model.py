"""A hashed maximum-entropy language model with class-factored softmax.

A token's probability is that of its class given the three words before, times that of the
word in its class given the words before. Both factors are softmaxes over the same kind of
features: n-grams of the words before (1, 2, 3) and skips over one or two of them, hashed into
the rows of a table of weights; for the word in its class they are hashed together with the
class. Classes: the text's end, the frequent words by their rank, and groups of all other words
by their first letters. Numbers of classes, of places in a class and of rows grow with the
vocabulary. A frequent word has a place of its own; the others of a class meet in its places by
their hash and have their smoothed share of a place's counts, with one share for unknown words,
so that the probabilities of all tokens add up to one.

All counts cover all training texts, and so does training: both softmaxes start from the counts,
every task follows the gradient over its texts, and the tasks' changes are averaged by how often
each saw a row's features. Scoring looks frequent words up in the task; counts of the others are
joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wherewords.llm.tables import LOWER_CASE, WordBatch, crc_bucket, list_array, mix, pieces, small_batches, table, texts_of
from wherewords.session import stage

GROUPS = 8
#: Classes of frequent words, and places in a class, at most.
SIDE = 40
CLASSES = 1 + GROUPS + SIDE
#: Rows of a table of weights, at most and at least.
BUCKETS, LEAST_BUCKETS = 1 << 16, 1 << 12
#: Bits of a word in a context of three.
BITS = 21
#: A word is frequent from this share of all tokens on: so every task holds as many at most.
HEAD_WORDS = 1 << 20
#: Features of a word in its class, the first of those of a class.
WORD_FEATURES = 3
#: Features whose rows many tokens of a step share, the first: words, not their n-grams.
SHARED_FEATURES = 2
#: Every text is in one round; tokens of a step; a step's length.
ROUNDS, STEP_TOKENS, RATE = 2, 4096, 0.4
#: Rows of a table that are sent together.
SENT_ROWS = 1 << 10
SMOOTH = 0.5
END = np.uint64(0xE17D0000E17D0001)
#: Distinct words gathered in a task before they are sent on.
FLUSH_WORDS = 2_000_000


def tokens_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and letter group of all tokens, ends included, and how many each text has."""
    words = WordBatch(texts)
    lengths = np.diff(words.first) + 1
    ends = np.zeros(int(lengths.sum()), bool)
    ends[np.cumsum(lengths) - 1] = True
    hashes = np.full(len(ends), END)
    hashes[~ends] = words.hashes
    groups = np.zeros(len(ends), np.int64)
    first = LOWER_CASE[words.raw[words.starts]].astype(np.uint64)
    second = np.where(words.ends - words.starts > 1, LOWER_CASE[words.raw[words.starts + 1]], 0).astype(np.uint64)
    groups[~ends] = (mix(first * np.uint64(256) + second + np.uint64(1)) % np.uint64(GROUPS)).astype(np.int64)
    return hashes, groups, lengths


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, letters, c): counts of a task's words, in portions."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def flushed() -> pa.RecordBatch:
        words, groups, counts = (np.concatenate(column) for column in zip(*held, strict=True))
        unique, first, where = np.unique(words, return_index=True, return_inverse=True)
        sums = np.bincount(where, counts, len(unique)).astype(np.int64)
        held.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(unique.view(np.int64)), pa.array(groups[first].astype(np.int32)), pa.array(sums)], ["word", "letters", "c"]
        )

    for batch in batches:
        hashes, groups, _ = tokens_of(texts_of(batch, "text"))
        unique, first, counts = np.unique(hashes, return_index=True, return_counts=True)
        held.append((unique, groups[first], counts))
        if sum(len(words) for words, _, _ in held) > FLUSH_WORDS:
            yield flushed()
    if held:
        yield flushed()


@dataclass
class Lexicon:
    """What tasks know of the words: frequent ones with their counts and places, and the places' sums."""

    words: np.ndarray  # sorted hashes
    counts: np.ndarray
    ranks: np.ndarray  # place among the words with a place of their own, -1 without
    sums: np.ndarray  # smoothed counts of each class and place; 0 without words
    train_tokens: int
    distinct: int

    def held(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and ranks of frequent words; -1 for others."""
        if not len(self.words):
            return np.full(len(hashes), -1, np.int64), np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        found = self.words[at] == hashes
        return np.where(found, self.counts[at], -1), np.where(found, self.ranks[at], -1)

    def classes(self, hashes: np.ndarray, groups: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of each word and its place there: frequent words by rank, others by letters and hash."""
        width = self.sums.shape[1]
        single = ranks >= 0
        classes = np.where(single, 1 + GROUPS + ranks // width, 1 + groups)
        places = np.where(single, ranks % width, hash_places(hashes, width))
        end = hashes == END
        classes[end], places[end] = 0, 0
        return classes, places

    def starts(self) -> tuple[np.ndarray, np.ndarray]:
        """Both softmaxes without a context: logarithms of the shares of the classes, and of the
        places in each class."""
        with np.errstate(divide="ignore"):
            places = np.log(self.sums)
            classes = np.log(self.sums.sum(axis=1))
        # What no word has is far below all others, but finite.
        return np.maximum(classes, -1e4).astype(np.float32), np.maximum(places, -1e4).astype(np.float32)


def hash_places(hashes: np.ndarray, width: int) -> np.ndarray:
    """Place of a word that has none of its own; :func:`learn_lexicon` has the same as a column."""
    return ((hashes >> np.uint64(16)) % np.uint64(width)).astype(np.int64)


def contexts_of(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The three words before each token as one number; before a text there is its end."""
    words = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    place = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    context = np.zeros(len(words), np.int64)
    for back in (1, 2, 3):
        before = np.zeros(len(words), np.int64)
        before[back:] = words[:-back]
        context = (context << BITS) | np.where(place >= back, before, 0)
    return context


def features_of(contexts: np.ndarray, buckets: int = BUCKETS, classes: np.ndarray | None = None) -> np.ndarray:
    """Rows of the active features of each context: 1-gram, skip, 2-gram, skip, 3-gram; with
    ``classes`` the first of them, for the words of those classes. The starts are the bias."""
    mask = (1 << BITS) - 1
    one, two, three = contexts >> 2 * BITS, (contexts >> BITS) & mask, contexts & mask
    kinds = [one, two, one << BITS | two, one << BITS | three, contexts]
    if classes is not None:
        kinds = kinds[:WORD_FEATURES]
    salt = np.uint64(0) if classes is None else mix(classes.astype(np.uint64) + np.uint64(1))
    stacked = [mix(value.astype(np.uint64) * np.uint64(8) + np.uint64(k) + salt) for k, value in enumerate(kinds)]
    return (np.stack(stacked) % np.uint64(buckets)).astype(np.int64)


def logits_of(weights: np.ndarray, rows: np.ndarray, start: np.ndarray | float) -> np.ndarray:
    logits = weights.take(rows[0], axis=0) + start
    for row in rows[1:]:
        logits += weights.take(row, axis=0)
    logits -= logits.max(axis=1, keepdims=True)
    return logits


def log_softmax(
    weights: np.ndarray, contexts: np.ndarray, start: np.ndarray | float = 0.0, classes: np.ndarray | None = None
) -> np.ndarray:
    logits = logits_of(weights, features_of(contexts, len(weights), classes), start)
    return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def put_rows(weights: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """``weights[at] = rows``, each row moved as one value; of equal places the last counts."""
    whole = f"V{weights.itemsize * weights.shape[1]}"
    weights.view(whole).reshape(-1)[at] = np.ascontiguousarray(rows).view(whole).reshape(-1)


def follow_gradient(weights: np.ndarray, seen: np.ndarray, rows: np.ndarray, start: np.ndarray, targets: np.ndarray) -> None:
    """One step of ``weights`` along the log-likelihood of the targets. A row goes by its summed
    gradient, less far the more often it was ``seen``; of an n-gram that is in a step more than
    once, the last place counts."""
    p = logits_of(weights, rows, start)
    np.exp(p, out=p)
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(len(targets)), targets] -= 1
    for row in rows[SHARED_FEATURES:]:
        np.add.at(seen, row, 1.0)
        length = (RATE / np.sqrt(seen[row])).astype(np.float32)[:, None]
        put_rows(weights, row, weights.take(row, axis=0) - p * length)
    for row in rows[:SHARED_FEATURES]:
        order = np.argsort(row, kind="stable")
        ordered = row[order]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        often = np.diff(np.append(first, len(row)))
        at = ordered[first]
        seen[at] += often
        length = (RATE / np.maximum(np.sqrt(seen[at]), often / 4)).astype(np.float32)[:, None]
        # Differences of running sums: a reduceat over short groups takes far longer.
        sums = np.cumsum(p.take(order, axis=0), axis=0).take(first + often - 1, axis=0)
        sums[1:] -= sums[:-1].copy()
        put_rows(weights, at, weights.take(at, axis=0) - sums * length)


def _learnt(shared):
    """(tables, first row, weights, times seen): what a task's texts change, weighted by the times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, before = shared.value
        starts = lexicon.starts()
        weights = [table.copy() for table in before]
        seen = [np.zeros(len(table)) for table in before]
        for big in batches:
            for batch in pieces(big, 500):
                hashes, groups, lengths = tokens_of(texts_of(batch, "text"))
                classes, places = lexicon.classes(hashes, groups, lexicon.held(hashes)[1])
                contexts = contexts_of(hashes, lengths)
                for begin in range(0, len(hashes), STEP_TOKENS):
                    part = slice(begin, begin + STEP_TOKENS)
                    own, at = contexts[part], classes[part]
                    follow_gradient(weights[0], seen[0], features_of(own, len(weights[0])), starts[0], at)
                    words = at > 0
                    if words.any():
                        own, at = own[words], at[words]
                        rows = features_of(own, len(weights[1]), at)
                        follow_gradient(weights[1], seen[1], rows, starts[1][at], places[part][words])
        for k, (now, old, often) in enumerate(zip(weights, before, seen, strict=True)):
            for begin in range(0, len(now), SENT_ROWS):
                part = slice(begin, begin + SENT_ROWS)
                if often[part].any():
                    change = ((now[part] - old[part]) * often[part, None]).astype(np.float32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k], pa.int32()), pa.array([begin], pa.int32()), pa.array([change.tobytes()], pa.binary()),
                         pa.array([often[part].tobytes()], pa.binary())],
                        ["kind", "begin", "change", "seen"],
                    )

    return run


def _averaged(rows: pa.Table) -> pa.Table:
    """The changes of all tasks to one part of a table, averaged by the times they saw each row."""
    # In a fixed order, so that sums are the same in every run.
    found = sorted(zip(rows["change"].to_pylist(), rows["seen"].to_pylist(), strict=True))
    often = sum(np.frombuffer(seen) for _, seen in found)
    change = sum(np.frombuffer(change, np.float32).reshape(len(often), -1).astype(float) for change, _ in found)
    mean = (change / np.maximum(often, 1)[:, None]).astype(np.float32)
    return pa.table({"kind": rows["kind"][:1], "begin": rows["begin"][:1], "change": pa.array([mean.tobytes()], pa.binary())})


def train(train_texts: DataFrame, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Weights of both softmaxes: of the classes, rows × classes, and of the words in their
    classes, rows × places. Every training text is in one of the rounds."""
    spark = train_texts.sparkSession
    classes, width = lexicon.sums.shape
    buckets = min(BUCKETS, max(LEAST_BUCKETS, 1 << (lexicon.distinct // 4).bit_length()))
    weights = np.zeros((buckets, classes), np.float32), np.zeros((buckets, width), np.float32)
    for r in range(ROUNDS):
        shared = spark.sparkContext.broadcast((lexicon, weights))
        own = train_texts.filter(F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(ROUNDS)) == r)
        # A task sends as much as the tables hold, so there is one for each core, or for some parts of the input.
        changes = own.coalesce(max(spark.sparkContext.defaultParallelism, own.rdd.getNumPartitions() // 8)).mapInArrow(
            _learnt(shared), "kind int, begin int, change binary, seen binary"
        )
        averaged = changes.groupBy("kind", "begin").applyInArrow(_averaged, "kind int, begin int, change binary")
        for row in averaged.collect():
            table, begin = weights[row["kind"]], row["begin"]
            part = np.frombuffer(row["change"], np.float32).reshape(-1, table.shape[1])
            table[begin : begin + len(part)] += part
        shared.unpersist()
    return weights


def learn_lexicon(train_texts: DataFrame) -> tuple[Lexicon, DataFrame]:
    """The lexicon, and the stored counts (word, letters, c) of all training tokens."""
    counts = stage(
        train_texts.mapInArrow(counted, "word bigint, letters int, c bigint")
        .groupBy("word").agg(F.first("letters").alias("letters"), F.sum("c").alias("c")),
        "word-counts",
    )
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    end = F.col("word") == int(END.view(np.int64))
    top = counts.filter((F.col("c") * HEAD_WORDS >= totals["n"]) | end).toPandas()
    top = top.sort_values(["c", "word"], ascending=[False, True])
    words, often = top["word"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64)
    letters = top["letters"].to_numpy(np.int64)
    side = min(SIDE, max(1, round(0.25 * totals["v"] ** (1 / 3))))
    ranked = np.flatnonzero(words != END)[: side * side]
    ranks = np.full(len(words), -1)
    ranks[ranked] = np.arange(len(ranked))
    # Smoothed counts of the places: of all words by letters and hash, less those with their own.
    sums = np.zeros((1 + GROUPS + side, side))
    place = F.pmod(F.shiftrightunsigned("word", 16), F.lit(side)).alias("place")
    for row in counts.groupBy("letters", place).agg((F.sum("c") + SMOOTH * F.count("*")).alias("s")).collect():
        sums[1 + row["letters"], row["place"]] = row["s"]
    for own in (ranked, np.flatnonzero(words == END)):
        np.subtract.at(sums, (1 + letters[own], hash_places(words[own], side)), often[own] + SMOOTH)
    sums[1 : 1 + GROUPS] += SMOOTH  # for an unknown word
    sums[1 + GROUPS :].flat[: len(ranked)] = often[ranked] + SMOOTH
    sums[0, 0] = often[words == END].sum() + SMOOTH
    order = np.argsort(words)
    return Lexicon(words[order], often[order], ranks[order], sums, totals["n"], totals["v"]), counts


def log_model(lexicon: Lexicon, weights, contexts: np.ndarray, classes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """log10 of both factors for each token, a step's tokens at a time."""
    starts, out = lexicon.starts(), np.empty(len(contexts))
    for begin in range(0, len(contexts), STEP_TOKENS):
        part = slice(begin, begin + STEP_TOKENS)
        own, at, place = contexts[part], classes[part], places[part]
        logs = log_softmax(weights[0], own, starts[0])[np.arange(len(own)), at].astype(float)
        words = at > 0
        if words.any():
            own, at, place = own[words], at[words], place[words]
            logs[words] += log_softmax(weights[1], own, starts[1][at], at)[np.arange(len(own)), place]
        out[part] = logs
    return out / np.log(10)


def _scored(spark, lexicon: Lexicon, weights: tuple[np.ndarray, np.ndarray]):
    shared = spark.sparkContext.broadcast((lexicon, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, weights = shared.value
        in_place = np.log10(np.maximum(lexicon.sums, SMOOTH))
        for big in batches:
            for batch in pieces(big, 500):
                hashes, groups, lengths = tokens_of(texts_of(batch, "text"))
                counts, ranks = lexicon.held(hashes)
                classes, places = lexicon.classes(hashes, groups, ranks)
                own = log_model(lexicon, weights, contexts_of(hashes, lengths), classes, places)
                # Words without a place of their own have their share of its counts.
                grouped = (ranks < 0) & (classes > 0)
                share = np.where(counts >= 0, np.log10(np.maximum(counts, 0) + SMOOTH), 0.0)
                begins = np.cumsum(lengths) - lengths
                rest = counts < 0
                rests = np.add.reduceat(rest.astype(np.int64), begins)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row"), batch.column("key"), pa.array(lengths),
                        pa.array(np.add.reduceat((counts > 0).astype(np.int64), begins)),
                        pa.array(np.add.reduceat(share, begins)),
                        pa.array(np.add.reduceat(own + np.where(grouped, share - in_place[classes, places], 0.0), begins)),
                        list_array(hashes[rest].view(np.int64), rests, pa.int64()),
                    ],
                    ["row", "key", "n_tokens", "n_known", "share", "model", "rest"],
                )

    return run


def score_texts(docs: DataFrame, training, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: (key, n_tokens, n_known, train_tokens, base_score, score).

    ``training`` is the condition on ``docs`` for the rows to learn from. Null texts count
    as empty and have the end alone; repeated rows all count and are scored alike; null
    keys stay; other columns are left out; an empty table gives no rows. Without training
    rows every token is unknown. ``docs`` is a stored table: it is read several times.
    """
    spark = docs.sparkSession
    small_batches(spark)
    train_texts = docs.filter(training).select(F.col(text).alias("text"))
    lexicon, counts = learn_lexicon(train_texts)
    weights = train(train_texts, lexicon)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")
    )
    scored = stage(
        rows.mapInArrow(
            _scored(spark, lexicon, weights),
            "row bigint, key bigint, n_tokens bigint, n_known bigint, share double, model double, rest array<bigint>",
        ),
        "scored",
    )
    # Words that tasks don't hold: their counts by a join, summed up per row again.
    rest = (
        scored.select("row", F.explode("rest").alias("word"))
        .join(counts.select("word", "c"), "word", "left")
        .groupBy("row")
        .agg(
            F.count("c").alias("rest_known"),
            F.sum(F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)).alias("rest_share"),
        )
    )
    all_counts = float(np.log10(lexicon.train_tokens + SMOOTH * (lexicon.distinct + 1)))
    rest_share = F.coalesce("rest_share", F.lit(0.0))
    return scored.drop("rest").join(rest, "row", "left").select(
        F.col("key").alias(key), "n_tokens", (F.col("n_known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(lexicon.train_tokens).cast("bigint").alias("train_tokens"),
        (F.col("share") + rest_share - F.col("n_tokens") * all_counts).alias("base_score"),
        (F.col("model") + rest_share).alias("score"),
    )


def op7_language_model(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = crc_bucket(F.col("doc_id"), 5) == 1
    scored = score_texts(docs, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
