"""Messages to countries and coordinates: cluster, candidates, cosine re-rank."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wherewords.operators.aggregates import profile
from wherewords.operators.blocks import BLOCK_ROWS, renamed
from wherewords.operators.features import idf_weight
from wherewords.operators.topk import GROUP_DOCS, half_up, list_matrix, products
from wherewords.operators.vocabulary import dense_ids
from wherewords.operators.words import message_term_counts
from wherewords.session import stage


# Number of the list with the profiles' squared lengths.
SQUARES = -2


@dataclass
class CountryModel:
    """What is learnt from the training rows: one profile row per country, and
    the long counts of its terms."""

    profiles: DataFrame  # doc_key, lat, lon, user_lang, ...
    profile_tf: DataFrame  # doc_key, term, tf


def learn_countries(train: DataFrame, stopwords: DataFrame) -> CountryModel:
    """Profiles and term counts of the countries in ``train``, both staged."""
    rows = profile(train).withColumnRenamed("place_country", "doc_key")
    named = train.withColumnRenamed("place_country", "doc_key").filter(F.col("doc_key").isNotNull())
    return CountryModel(
        stage(rows, "profiles"), stage(message_term_counts(named, stopwords, "doc_key"), "profile-terms")
    )


def geolocate(
    pred: DataFrame,
    query_tf: DataFrame,
    profiles: DataFrame,
    profile_tf: DataFrame,
    idf_scope: str = "global",
    digits: int = 6,
    query: str = "tweet_id",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The most similar country of the predicted cluster, for all messages at once.

    ``pred`` (query, cluster), ``query_tf`` (query, term, tf), ``profiles``
    (doc_key, cluster, lat, lon), ``profile_tf`` (doc_key, term, tf). Gives
    (query, cluster, country, lat, lon, score), ties by country.

    ``idf_scope="global"`` weighs terms over all profiles. ``"cluster"`` weighs
    them for each message over its candidates and the message itself, as if the
    TF-IDF were fitted anew per message; the document frequencies of the cluster
    are enough for that.

    A block of messages of one cluster meets the counts of its own terms, and
    products are added up in place, see :mod:`wherewords.operators.topk`.
    """
    if idf_scope not in ("global", "cluster"):
        raise ValueError("idf_scope is 'global' or 'cluster'")
    per_cluster = idf_scope == "cluster"
    in_cluster = Window.partitionBy("cluster").orderBy("doc_key")
    profiles = stage(
        profiles.select("doc_key", "cluster", "lat", "lon").withColumn("slot", F.row_number().over(in_cluster) - 1), "clustered-profiles"
    )
    n_docs = profiles.count()
    sizes = stage(profiles.groupBy("cluster").agg(F.count("*").alias("cluster_size")), "cluster-sizes")
    terms = stage(dense_ids(profile_tf, "term", "term_id"), "terms")
    counts = stage(
        profile_tf.join(profiles.select("doc_key", "cluster", "slot"), "doc_key").join(terms, "term").select("cluster", "slot", "term", "term_id", "tf"),
        "profile-counts",
    )
    in_scope = counts.groupBy("cluster", "term_id").agg(F.count("*").alias("df")) if per_cluster else counts.groupBy("term_id").agg(F.count("*").alias("df"))
    in_scope = stage(in_scope, "document-frequencies")
    scope = ["cluster", "term_id"] if per_cluster else ["term_id"]

    # Lengths of the profiles before a message is added.
    n = F.col("cluster_size") + 1 if per_cluster else F.lit(n_docs)
    entries = counts.join(in_scope, scope).join(sizes, "cluster")
    square = F.sum(F.pow(F.col("tf") * idf_weight(n, F.col("df")), F.lit(2.0)))
    lengths = entries.groupBy("cluster", "slot").agg(square.alias("square"))
    candidates = stage(
        profiles.join(lengths, ["cluster", "slot"], "left").withColumn("square", F.coalesce("square", F.lit(0.0))), "candidates"
    )

    # Messages: per term the weight in the product, and what the message adds to a profile's length.
    known = query_tf.join(pred.select(query, "cluster"), query).join(sizes, "cluster").join(terms, "term", "left").join(in_scope, scope, "left")
    found = F.coalesce("df", F.lit(0))
    if per_cluster:
        idf = idf_weight(n, found + 1)
        added = idf * idf - F.pow(idf_weight(n, found), F.lit(2.0))
    else:
        idf = F.when(F.col("df").isNotNull(), idf_weight(n, F.col("df"))).otherwise(0.0)
        added = F.lit(0.0)
    cells = known.select(query, "cluster", "term_id", "tf", idf.alias("idf"), added.alias("added"), F.col("df").isNotNull().alias("shared"))
    cell = F.struct(F.col("term_id").alias("term"), (F.col("tf") * F.pow("idf", F.lit(2.0))).alias("value"), "added")
    rows = stage(
        cells.groupBy(query, "cluster").agg(
            F.sum(F.pow(F.col("tf") * F.col("idf"), F.lit(2.0))).alias("own"), F.collect_list(F.when(F.col("shared"), cell)).alias("cells")
        ).filter(F.size("cells") > 0)
        .select(query, "cluster", "own", F.col("cells.term").alias("terms"), F.col("cells.value").alias("values"), F.col("cells.added").alias("added")),
        "message-rows",
    )
    blocks = max(1, -(-rows.count() // block_rows))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(query), F.lit(blocks)).cast("int"))

    width = F.lit(GROUP_DOCS)
    group, slot = F.floor(F.col("slot") / width).cast("int").alias("group"), (F.col("slot") % width).cast("int")
    lists = counts.groupBy("cluster", group, F.col("term_id").alias("term")).agg(F.collect_list(F.struct(slot.alias("slot"), F.col("tf").cast("double").alias("weight"))).alias("cells"))
    # The profiles' lengths come along as the list of a term that no message has.
    squares = candidates.groupBy("cluster", group).agg(F.collect_list(F.struct(slot.alias("slot"), F.col("square").alias("weight"))).alias("cells"))
    lists = stage(
        lists.unionAll(squares.select("cluster", "group", F.lit(SQUARES).cast("bigint").alias("term"), "cells"))
        .select("cluster", "group", "term", F.col("cells.slot").alias("slots"), F.col("cells.weight").alias("weights")),
        "lists",
    )
    kind, cluster_kind = (f.schema[c].dataType.simpleString() for f, c in ((rows, query), (rows, "cluster")))

    def best(rows: pa.Table, lists: pa.Table) -> pa.Table:
        group = rows["group"][0].as_py()
        width = int(np.max(lists["slots"].combine_chunks().flatten().to_numpy(), initial=-1)) + 1
        own, matrix = list_matrix(lists, width)
        square = matrix[own == SQUARES].sum(axis=0)
        product, extra = products(own, matrix, rows, "values", "added")
        with np.errstate(divide="ignore", invalid="ignore"):
            scores = product / np.sqrt(rows["own"].to_numpy())[:, None] / np.sqrt(extra + square)
        scores = half_up(np.where(product > 0, scores, 0.0), digits)
        slot = scores.argmax(axis=1)
        return pa.table({
            query: rows[query], "cluster": rows["cluster"], "slot": pa.array((slot + group * GROUP_DOCS).astype(np.int32)),
            "score": pa.array(scores[np.arange(len(scores)), slot]),
        })

    groups = lists.select("cluster", "group").distinct()
    each = rows.join(groups, "cluster")
    needed = rows.select("cluster", "block", F.explode(F.concat("terms", F.array(F.lit(SQUARES).cast("bigint")))).alias("term")).distinct()
    met = renamed(each).groupBy("cluster", "block", "group").cogroup(needed.join(lists, ["cluster", "term"]).groupBy("cluster", "block", "group"))
    scored = met.applyInArrow(best, f"{query} {kind}, cluster {cluster_kind}, slot int, score double")
    chosen = scored.groupBy(query, "cluster").agg(F.min(F.struct((-F.col("score")).alias("badness"), "slot")).alias("best"))
    placed = (
        pred.select(query, "cluster").join(chosen, [query, "cluster"], "left")
        .withColumn("score", F.coalesce(-F.col("best.badness"), F.lit(0.0)))
        # Without a shared term the first candidate.
        .withColumn("slot", F.when(F.col("score") > 0, F.col("best.slot")).otherwise(0))
    )
    return placed.join(candidates, ["cluster", "slot"]).select(
        query, "cluster", F.col("doc_key").alias("country"), "lat", "lon", "score"
    )


def geolocate_messages(
    test: DataFrame,
    model: CountryModel,
    stopwords: DataFrame,
    clusters: DataFrame | None = None,
    pred: DataFrame | None = None,
    idf_scope: str = "global",
    query: str = "tweet_id",
) -> DataFrame:
    """:func:`geolocate` of raw message rows. Without ``clusters`` (doc_key, cluster) and ``pred``
    (query, cluster) every country is a candidate. ``query`` is the grain: the rows of one value
    are located as one text, a message or all messages of a user."""
    if clusters is None:
        clusters = model.profiles.select("doc_key", F.lit(0).alias("cluster"))
        pred = test.select(query).distinct().withColumn("cluster", F.lit(0))
    return geolocate_counts(message_term_counts(test, stopwords, query), model, clusters, pred, idf_scope, query)


def geolocate_counts(
    query_tf: DataFrame, model: CountryModel, clusters: DataFrame, pred: DataFrame, idf_scope: str = "global", query: str = "tweet_id"
) -> DataFrame:
    """:func:`geolocate_messages` of messages whose terms are counted already, (query, term, tf)."""
    profiles = model.profiles.join(clusters, "doc_key")
    return geolocate(pred, query_tf, profiles, model.profile_tf, idf_scope, query=query)
