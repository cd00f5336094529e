"""Country retrieval: the five most similar profiles of each message."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wherewords.operators.features import idf_table, tfidf
from wherewords.operators.similarity import nearest_by_cosine
from wherewords.operators.svd import block_svd
from wherewords.operators.topk import nearest_sparse
from wherewords.session import stage


@dataclass
class TopicModel:
    """Latent topics of the profiles' raw term counts."""

    terms: DataFrame  # term, topic array
    docs: DataFrame  # doc_key, topics


def lsi(profile_tf: DataFrame, k: int = 2) -> TopicModel:
    """Truncated SVD of the count matrix, of any number of documents and terms."""
    counts = stage(profile_tf.select("doc_key", "term", "tf"), "topic-counts")
    terms, values, docs = block_svd(counts, "term", "doc_key", "tf", k)
    scale = F.array(*[F.lit(float(x)) for x in values]).cast("array<double>")
    topics = F.zip_with("vector", scale, lambda x, s: x * s)
    return TopicModel(
        stage(terms.select("term", F.col("vector").alias("topic")), "topic-terms"),
        stage(docs.select("doc_key", topics.alias("topics")), "topic-docs"),
    )


def fold_in(query_tf: DataFrame, model: TopicModel, query: str = "tweet_id") -> DataFrame:
    """Topic vectors of messages; unknown terms add nothing, and a message of those alone
    has a zero vector."""
    size = model.docs.select(F.max(F.size("topics"))).first()[0] or 0
    sums = [
        F.sum(F.col("tf") * F.get("topic", F.lit(i))).alias(f"_{i}") for i in range(size)
    ]
    return (
        query_tf.join(model.terms, "term", "left")
        .groupBy(query)
        .agg(*sums)
        .select(query, F.array(*[F.coalesce(f"_{i}", F.lit(0.0)) for i in range(size)]).alias("topics"))
    )


def retrieve_top_k(
    query_tf: DataFrame, model: TopicModel, k: int = 5, query: str = "tweet_id", digits: int = 9
) -> DataFrame:
    """(query, doc_key, score, rank) by topic cosine."""
    return nearest_by_cosine(
        fold_in(query_tf, model, query), model.docs, query, "doc_key", "topics", k, digits
    )


def retrieve_top_k_tfidf(
    query_tf: DataFrame, profile_tf: DataFrame, k: int = 5, query: str = "tweet_id", digits: int = 6, keys: DataFrame | None = None
) -> DataFrame:
    """The same by TF-IDF cosine over shared terms; ``keys`` are the messages asked for, those
    without a known term included."""
    idf = stage(idf_table(profile_tf, "doc_key"), "idf")
    corpus = tfidf(profile_tf, idf, "doc_key", short_docs=False)
    return nearest_sparse(tfidf(query_tf, idf, query), corpus, query, "doc_key", k, digits, keys)
