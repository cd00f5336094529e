"""Text features: TF-IDF weights, vectors for the estimators, random Fourier maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.ml.feature import HashingTF, StopWordsRemover
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wherewords.functions import text
from wherewords.operators.blocks import renamed
from wherewords.operators.vocabulary import dense_ids
from wherewords.operators.words import doc_freq
from wherewords.session import stage


def idf_weight(n: Column, df: Column) -> Column:
    """Smoothed inverse document frequency, ln((1 + n) / (1 + df)) + 1."""
    return F.log((1 + n) / (1 + df)) + 1


def idf_table(tf: DataFrame, key: str, term: str = "term") -> DataFrame:
    """(term, df, idf) over the documents of a count table."""
    n_docs = tf.agg(F.count_distinct(key)).scalar()
    return doc_freq(tf, term).withColumn("idf", idf_weight(n_docs, F.col("df")))


def tfidf(
    tf: DataFrame, idf: DataFrame, key: str, term: str = "term", short_docs: bool = True
) -> DataFrame:
    """(key, term, weight): tf * idf, scaled to length 1 per document.

    Terms outside ``idf`` are left out, so the training table of
    :func:`idf_table` also weighs other documents. ``short_docs`` gets the
    length from a window over each document, one shuffle for many short texts;
    documents that may hold a large share of all rows (one per country) take
    ``False``: their lengths are aggregated and joined instead.
    """
    raw = tf.join(idf.select(term, "idf"), term).select(
        key, term, (F.col("tf") * F.col("idf")).alias("weight")
    )
    square = F.sum(F.col("weight") * F.col("weight"))
    if short_docs:
        scaled = raw.withColumn("_norm", F.sqrt(square.over(Window.partitionBy(key))))
    else:
        scaled = raw.join(raw.groupBy(key).agg(F.sqrt(square).alias("_norm")), key)
    return scaled.select(key, term, (F.col("weight") / F.col("_norm")).alias("weight"))


def count_vectorize(df: DataFrame, key: str, words: str) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, counts): the distinct words numbered in their order, (word, id), and the
    rows' counts, (key, id, tf); both of any size."""
    tokens = df.select(key, F.explode(words).alias("word"))
    counts = stage(tokens.filter("word is not null").groupBy(key, "word").agg(F.count("*").alias("tf")), "counts")
    vocab = stage(dense_ids(counts, "word"), "vocabulary")
    return vocab, counts.join(vocab, "word").select(key, "id", "tf")


FIELDS = ("text", "user_description", "hashtags")
# Words of Spark's English list that are in scikit-learn's not, which the reference takes words out by.
KEPT_WORDS = "theirs having does did doing s t just don ought".split()


def field_grams(df: DataFrame, stop: list[str] | None = None) -> DataFrame:
    """For each text field a column ``<field>_grams``: the message tokens without
    stop words (by default Spark's English ones but :data:`KEPT_WORDS`), and their pairs."""
    if stop is None:
        stop = [w for w in StopWordsRemover.loadDefaultStopWords("english") if w not in KEPT_WORDS]
    cleaned = {
        "text": text.clean_text(F.col("text")),
        "user_description": text.clean_text(text.null_text(F.col("user_description"))),
        "hashtags": text.clean_text(text.hashtags(F.col("text"))),
    }
    names = [f"_{f}_words" for f in FIELDS]
    words = df.withColumns(
        {name: text.tweet_tokens(cleaned[f]) for name, f in zip(names, FIELDS)}
    )
    kept = StopWordsRemover(
        inputCols=names, outputCols=[f"{n}_kept" for n in names], stopWords=stop
    ).transform(words)
    return kept.withColumns(
        {f"{f}_grams": text.ngrams(F.col(f"_{f}_words_kept"), 2) for f in FIELDS}
    ).drop(*names, *[f"{n}_kept" for n in names])


def grams_long(df: DataFrame, key: str) -> DataFrame:
    """(key, field, term) of the three fields in one table."""
    grams = F.array(
        *[F.struct(F.lit(f).alias("field"), F.col(f"{f}_grams").alias("grams")) for f in FIELDS]
    )
    return (
        df.select(key, F.explode(grams).alias("part"))
        .select(key, "part.field", F.explode("part.grams").alias("term"))
    )


# Counted terms that are numbered together, and the least number of tasks' shares of the terms.
NUMBERED_ROWS = 1 << 20
SHARES = 256


def tfidf_fields(grams: DataFrame, key: str) -> DataFrame:
    """TF-IDF of the three fields in one job, each field a corpus of its own.

    A block of messages numbers its own terms, in the order of their shares of all terms. Its
    sorted lists of terms go to the document frequencies, compressed, numbers alone come back, and
    the messages are numbers under the block's lists.
    """
    spark = grams.sparkSession
    shares = max(SHARES, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    tf = grams.filter("term is not null").groupBy(key, "field", "term").agg(F.count("*").alias("tf"))
    kind = tf.schema[key].dataType.simpleString()
    shared = tf.withColumn("share", F.pmod(F.xxhash64("field", "term"), F.lit(shares)).cast("int"))
    # Staged: read three times below, for one pass over the texts.
    blocks = stage(
        shared.sortWithinPartitions(key).mapInArrow(_numbered_blocks(key), "block bigint, share int, field string, docs bigint, packed binary"),
        "field-blocks",
    )
    found = blocks.filter("share is not null").groupBy("share").applyInArrow(_summed_lists, "block bigint, share int, packed binary")
    n_docs = blocks.filter("field is not null").groupBy("field").agg(F.sum("docs").alias("n_docs"))
    rows = blocks.drop("docs").join(F.broadcast(n_docs), "field", "left")  # one row per field, three in all
    return renamed(rows).groupBy("block").cogroup(renamed(found).groupBy("block")).applyInArrow(
        _block_weights(key), f"{key} {kind}, field string, term string, weight double"
    )


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(packed: pa.Scalar) -> pa.Table:
    with pa.ipc.open_stream(packed.as_buffer()) as stream:
        return stream.read_all().combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    """A column in one piece."""
    found = table[name].combine_chunks()
    return pa.concat_arrays(found.chunks) if isinstance(found, pa.ChunkedArray) else found


def _numbered_blocks(key: str, block_rows: int = NUMBERED_ROWS) -> Callable:
    """Counts (key, field, term, tf, share), sorted by key, as blocks of whole keys: for each
    share a list (field, term, n) of the terms that ``n`` of the block's documents hold, and for
    each field the documents (key, steps from id to id, tfs); an id is the term's place in all lists of the block."""

    def numbered(rows: pa.Table, block: int) -> Iterator[pa.RecordBatch]:
        columns = {name: _column(rows, name).dictionary_encode("encode") for name in (key, "field", "term")}
        doc, field, term = (columns[name].indices.to_numpy().astype(np.int64) for name in (key, "field", "term"))
        share, tf = rows["share"].to_numpy(), rows["tf"].to_numpy()
        # The terms by their order, so that lists are sorted and compress well.
        place = np.empty(len(columns["term"].dictionary), np.int64)
        place[pa.compute.sort_indices(columns["term"].dictionary).to_numpy()] = np.arange(len(place))
        n_fields, n_terms = len(columns["field"].dictionary), len(place)
        names, ids, n = np.unique((share.astype(np.int64) * n_fields + field) * n_terms + place[term], return_inverse=True, return_counts=True)
        sorted_terms = columns["term"].dictionary.take(pa.compute.sort_indices(columns["term"].dictionary))
        own, found = names // n_terms % n_fields, names // n_terms // n_fields
        listed = pa.table({"field": columns["field"].dictionary.take(pa.array(own)), "term": sorted_terms.take(pa.array(names % n_terms)), "n": pa.array(n)})
        ends = np.append(np.flatnonzero(found[1:] != found[:-1]) + 1, len(found))
        parts = [(int(found[end - 1]), None, None, _packed(listed.slice(begin, end - begin))) for begin, end in zip([0, *ends[:-1]], ends)]
        for code, name in enumerate(columns["field"].dictionary.to_pylist()):
            at = np.flatnonzero(field == code)
            at = at[np.lexsort((ids[at], doc[at]))]
            begins = np.append(True, doc[at][1:] != doc[at][:-1])
            first = np.flatnonzero(begins)
            # Ids grow in a document: their steps are small numbers.
            steps = np.diff((np.cumsum(begins) - 1) * len(names) + ids[at], prepend=0)
            starts, keys = pa.array(np.append(first, len(at)).astype(np.int32)), columns[key].dictionary.take(pa.array(doc[at][first]))
            docs = pa.table({
                key: keys, "steps": pa.ListArray.from_arrays(starts, pa.array(steps.astype(np.int32))),
                "tfs": pa.ListArray.from_arrays(starts, pa.array(tf[at])),
            })
            parts.append((None, name, len(keys) - keys.null_count, _packed(docs)))
        kinds = {"share": pa.int32(), "field": pa.string(), "docs": pa.int64(), "packed": pa.binary()}
        yield pa.RecordBatch.from_arrays(
            [pa.array([block] * len(parts), pa.int64()), *[pa.array(c, k) for c, k in zip(zip(*parts), kinds.values())]], ["block", *kinds]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task's partition and the number of the block in it.
        block, held, size, most = TaskContext.get().partitionId() << 32, [], 0, block_rows
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < most:
                continue
            rows = pa.Table.from_batches(held)
            docs = _column(rows, key).dictionary_encode("encode").indices.to_numpy()
            # The next batch may go on with the last key.
            whole = int(np.searchsorted(docs, docs[-1]))
            if whole:
                yield from numbered(rows.slice(0, whole), block)
                block += 1
                held = rows.slice(whole).to_batches()
                size -= whole
            most = max(block_rows, 2 * size)
        if size:
            yield from numbered(pa.Table.from_batches(held), block)

    return run


def _summed_lists(lists: pa.Table) -> pa.Table:
    """For each block's list of a share the documents of all blocks that hold its terms."""
    parts = [_unpacked(packed) for packed in _column(lists, "packed")]
    whole = pa.concat_tables(parts)
    field, term = (_column(whole, name).dictionary_encode("encode") for name in ("field", "term"))
    names = term.indices.to_numpy().astype(np.int64) * len(field.dictionary) + field.indices.to_numpy()
    df = np.bincount(names, whole["n"].to_numpy()).astype(np.int64)[names]
    ends = np.cumsum([part.num_rows for part in parts])
    packed = [_packed(pa.table({"df": pa.array(df[end - part.num_rows : end])})) for part, end in zip(parts, ends)]
    return pa.table({"block": lists["block"], "share": lists["share"], "packed": pa.array(packed, pa.binary())})


def _block_weights(key: str) -> Callable:
    """(key, field, term, weight) of a block's documents."""

    def whole(parts: pa.Table, name: str) -> pa.Array:
        return _column(pa.concat_tables([_unpacked(packed) for packed in _column(parts.sort_by("share"), "packed")]), name)

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        is_list = pa.compute.is_valid(rows["share"])
        terms, df = whole(rows.filter(is_list), "term"), whole(found, "df").to_numpy()
        out = []
        for part in rows.filter(pa.compute.invert(is_list)).to_pylist():
            docs = _unpacked(pa.scalar(part["packed"], pa.binary()))
            lists = _column(docs, "steps")
            lengths, ids = lists.value_lengths().to_numpy(), np.cumsum(lists.flatten().to_numpy(), dtype=np.int64) % len(terms)
            raw = _column(docs, "tfs").flatten().to_numpy() * (np.log((1 + part["n_docs"]) / (1 + df[ids])) + 1)
            norm = np.sqrt(np.add.reduceat(raw * raw, np.cumsum(lengths) - lengths))
            out.append(pa.table({
                key: _column(docs, key).take(pa.array(np.repeat(np.arange(len(lengths)), lengths))),
                "field": pa.array([part["field"]], pa.string()).take(pa.array(np.zeros(len(ids), np.int8))),
                "term": terms.take(pa.array(ids)), "weight": pa.array(raw / np.repeat(norm, lengths)),
            }))
        return pa.concat_tables(out)

    return run


def tweet_vectors(df: DataFrame, words: str, dims: int = 4096, out: str = "tf") -> DataFrame:
    """Hashed count vectors of a token array, row by row."""
    return HashingTF(inputCol=words, outputCol=out, numFeatures=dims).transform(df)


def profile_vectors(df: DataFrame, key: str, vec: str = "tf") -> DataFrame:
    """Count vectors summed per key, partly in the map tasks."""
    return df.groupBy(key).agg(Summarizer.sum(F.col(vec)).alias(vec))


def assemble_features(df: DataFrame, margins: list[str], flags: list[str], out: str) -> DataFrame:
    """Margins, friends, seconds, followers and language flags as one vector."""
    from wherewords.operators.joins import stack_features

    numbers = ["user_friends_count", "seconds", "user_followers_count"]
    filled = df.fillna(0.0, subset=numbers)
    return stack_features(filled, [*margins, *numbers, *flags], out)


@lru_cache(maxsize=4)
def fourier_weights(size: int, gamma: float, dims: int, seed: int) -> tuple:
    """(size x dims weights, dims offsets) of the RBF map, from hashes of the
    indices: normal with variance 2 * gamma, and uniform in [0, 2 pi)."""

    def unit(label: str) -> float:
        return (int(md5(label.encode()).hexdigest()[:8], 16) + 0.5) / 2**32

    weights = np.empty((size, dims))
    for i in range(size):
        for d in range(dims):
            radius = np.sqrt(-2.0 * np.log(unit(f"{seed}:{i}:{d}:r")))
            weights[i, d] = radius * np.cos(2 * np.pi * unit(f"{seed}:{i}:{d}:a"))
    offsets = np.array([2 * np.pi * unit(f"{seed}:{d}:b") for d in range(dims)])
    return weights * np.sqrt(2 * gamma), offsets


def random_fourier(
    values: Column, size: int, gamma: float = 1.0, dims: int = 100, seed: int = 1
) -> Column:
    """RBF kernel map of a numeric array of length ``size``: sqrt(2 / dims) *
    cos(x W + b), as one matrix product per Arrow batch."""

    @F.pandas_udf("array<double>")
    def rbf(batch: pd.Series) -> pd.Series:
        weights, offsets = fourier_weights(size, gamma, dims, seed)
        if batch.empty:
            return batch
        mapped = np.cos(np.stack(batch.to_numpy()).astype(float) @ weights + offsets)
        return pd.Series(list(np.sqrt(2.0 / dims) * mapped))

    return rbf(values)


def random_fourier_vectors(df: DataFrame, vec: str, size: int, out: str, **settings) -> DataFrame:
    """:func:`random_fourier` of a vector column, as a vector column."""
    from pyspark.ml.functions import vector_to_array

    return df.withColumn(out, array_to_vector(random_fourier(vector_to_array(vec), size, **settings)))
