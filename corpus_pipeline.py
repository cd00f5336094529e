"""Documents to training sequences: five stages, each written as Parquet and read again.

Every stage takes what its predecessor kept, and its decisions hold: toxic documents go,
recurring lines and passages that an earlier document holds go, of near copies one stays,
contaminated documents go, and the rest is packed. All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wherewords.llm import decontaminate, exact_runs, jaccard_join, line_dedup, packing, toxicity
from wherewords.llm.encode import read_tokenizer
from wherewords.llm.tables import table
from wherewords.session import stage

#: Shingle words and least similarity of near copies.
COPY_WORDS, COPY_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, toxicity.learning_rows(table(spark, sf_dir, "labels")))
    return toxicity.without_toxic(docs, model)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole lines first, then runs of over 50 words wherever they lie. ``n_chars`` follows the
    text; documents of which nothing is left go."""
    lines = stage(line_dedup.without_recurring_lines(docs), "without-lines")
    return exact_runs.without_repeated_runs(lines).withColumn("n_chars", F.char_length("text").cast("bigint"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_per_component(docs, words=COPY_WORDS, percent=COPY_PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tokenizer = read_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack_documents(docs, tokenizer, end_id=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_recurring_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]

#: Trained scores have no SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
