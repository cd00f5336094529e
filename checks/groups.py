"""Aggregates, weights, accuracy, caps, clusters given as data."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import MESSAGES, TWEETS, messages, sql, table, tweets
from wherewords.operators import aggregates, clusters, rows, windows
from wherewords.operators.rows import canonical_lang
from wherewords.sources.languages import language_dimension

QUERIES: dict = {}
SQL: dict = {}


def add(name: str, oracle: str | None):
    def register(query):
        QUERIES[name] = query
        if oracle is not None:
            SQL[name] = oracle
        return query

    return register


add("country_counts", sql("SELECT place_country, count(*) AS n FROM tweets GROUP BY 1 HAVING count(*) > 10", TWEETS))(
    lambda spark, folder: aggregates.group_counts(tweets(spark, folder), "place_country", 10))
add("row_count", sql("SELECT count(*) AS n FROM tweets", TWEETS))(
    lambda spark, folder: aggregates.row_count(tweets(spark, folder)))
add("lang_counts", sql("SELECT user_lang, count(*) AS n FROM messages GROUP BY 1", TWEETS, MESSAGES))(
    lambda spark, folder: aggregates.group_counts(messages(spark, folder), "user_lang"))
add("distinct_lang", sql("SELECT DISTINCT user_lang FROM messages", TWEETS, MESSAGES))(
    lambda spark, folder: rows.distinct_values(messages(spark, folder), "user_lang"))

NULLABLE = ["tweet_id", "text", "user_description", "user_lang", "lon"]
add("null_counts", sql("SELECT " + ", ".join(f"count(*) FILTER ({c} IS NULL) AS {c}" for c in NULLABLE) + " FROM tweets", TWEETS))(
    lambda spark, folder: aggregates.null_profile(tweets(spark, folder).select(*NULLABLE)))


def mode_sql(col: str) -> str:
    """The most common value per country, the first met of equally common ones."""
    return f"""{col}_mode AS (SELECT place_country, {col} FROM (
      SELECT place_country, {col}, row_number() OVER (PARTITION BY place_country ORDER BY count(*) DESC, min(tweet_id)) AS r
      FROM tweets WHERE {col} IS NOT NULL GROUP BY 1, 2) WHERE r = 1)"""


MODES = [mode_sql(c) for c in ("user_lang", "source", "user_utc_offset")]

add("country_mode", sql("SELECT * FROM user_lang_mode JOIN source_mode USING (place_country) JOIN user_utc_offset_mode USING (place_country)", TWEETS, *MODES))(
    lambda spark, folder: aggregates.mode_first(tweets(spark, folder), "place_country", ["user_lang", "source", "user_utc_offset"], "tweet_id"))

PROFILE = """profiles AS (SELECT place_country, count(*) AS n_rows, avg(user_followers_count) AS user_followers_count,
  avg(user_friends_count) AS user_friends_count, median(seconds) AS seconds, avg(lon) AS lon, avg(lat) AS lat
  FROM messages GROUP BY 1)"""


@add("country_profile", sql(
    """SELECT place_country, n_rows, round(p.user_followers_count, 6) AS user_followers_count, round(p.user_friends_count, 6) AS user_friends_count,
    p.seconds, round(p.lon, 6) AS lon, round(p.lat, 6) AS lat, coalesce(l.canonical, m.user_lang) AS user_lang, source, user_utc_offset
    FROM profiles p JOIN user_lang_mode m USING (place_country) JOIN source_mode USING (place_country)
    JOIN user_utc_offset_mode USING (place_country) LEFT JOIN lang_map l ON l.raw = m.user_lang""", TWEETS, MESSAGES, PROFILE, *MODES))
def country_profile(spark, folder):
    """Profiles of the raw language codes, recoded after the mode."""
    df = rows.with_text_columns(tweets(spark, folder))
    profile = canonical_lang(aggregates.profile(df), language_dimension(spark))
    rounded = ["user_followers_count", "user_friends_count", "lon", "lat"]
    return profile.withColumns({c: F.round(c, 6) for c in rounded})


add("country_median", sql("SELECT place_country, median(seconds) AS seconds FROM messages GROUP BY 1", TWEETS, MESSAGES))(
    lambda spark, folder: messages(spark, folder).groupBy("place_country").agg(aggregates.median("seconds").alias("seconds")))
add("country_centroid", sql("SELECT place_country, round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat FROM tweets GROUP BY 1", TWEETS))(
    lambda spark, folder: tweets(spark, folder).groupBy("place_country").agg(*aggregates.centroid("lon", "lat")).select(
        "place_country", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat")))
add("centroid_of", sql("SELECT round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat FROM tweets WHERE place_country = 'NATION_24'", TWEETS))(
    lambda spark, folder: aggregates.centroid_of(tweets(spark, folder), "place_country", "NATION_24").select(
        F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat")))


@add("country_text", sql(
    """SELECT place_country, CAST(tweet_id // 256 AS BIGINT) AS piece, count(*) AS n_rows, string_agg(clean_text, ' ' ORDER BY tweet_id) AS clean_text,
    string_agg(user_description, ' ' ORDER BY tweet_id) AS user_description, string_agg(hashtags, ' ' ORDER BY tweet_id) AS hashtags
    FROM messages GROUP BY 1, 2""", TWEETS, MESSAGES))
def country_text(spark, folder):
    return aggregates.join_text(messages(spark, folder), "place_country", ["clean_text", "user_description", "hashtags"], "tweet_id")


add("class_weights", sql("SELECT place_country, n_label, round((SELECT sum(n_label) / CAST(count(*) AS DOUBLE) FROM c) / n_label, 6) AS weight FROM c", TWEETS, "c AS (SELECT place_country, count(*) AS n_label FROM tweets GROUP BY 1)"))(
    lambda spark, folder: aggregates.class_weights(tweets(spark, folder), "place_country").withColumn("weight", F.round("weight", 6)))


@add("weighted_rows", sql("SELECT round(sum(w.weight), 3) AS total FROM tweets JOIN w USING (place_country)", TWEETS, "c AS (SELECT place_country, count(*) AS n_label FROM tweets GROUP BY 1)", "w AS (SELECT place_country, (SELECT sum(n_label) / CAST(count(*) AS DOUBLE) FROM c) / n_label AS weight FROM c)"))
def weighted_rows(spark, folder):
    weighted = aggregates.with_class_weight(tweets(spark, folder), "place_country")
    return weighted.agg(F.round(F.sum("weight"), 3).alias("total"))


add("cap_per_country", sql("SELECT tweet_id, place_country FROM (SELECT *, row_number() OVER (PARTITION BY place_country ORDER BY created_at, tweet_id) AS r FROM tweets) WHERE r <= 20", TWEETS))(
    lambda spark, folder: windows.cap_per_key(tweets(spark, folder), "place_country", 20, ["created_at", "tweet_id"]).select("tweet_id", "place_country"))
add("cap_per_event_type", "SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events) WHERE r <= 1500")(
    lambda spark, folder: windows.cap_per_key(table(spark, folder, "events"), "event_type", 1500, ["ts", "event_id"]).select("event_id", "event_type"))


# --- clusters given by the data: nations by region ---------------------------


def given_clusters(spark, folder):
    return table(spark, folder, "nation").select(F.col("n_name").alias("doc_key"), F.col("n_regionkey").alias("cluster"))


def given_predictions(spark, folder):
    """The right cluster for three messages in four, the next one for the others."""
    shift = F.when(F.col("tweet_id") % 4 == 0, 1).otherwise(0)
    return tweets(spark, folder).select("tweet_id", "place_country", ((F.col("n_regionkey") + shift) % 5).alias("cluster"))


CLUSTERS = "clustered AS (SELECT n_name AS doc_key, n_regionkey AS cluster FROM nation)"
PRED = "pred AS (SELECT tweet_id, place_country, (n_regionkey + CASE WHEN tweet_id % 4 = 0 THEN 1 ELSE 0 END) % 5 AS cluster FROM tweets)"

add("cluster_members", sql("SELECT cluster, string_agg(doc_key, '|' ORDER BY doc_key) AS members, CAST(count(*) AS INTEGER) AS size FROM clustered GROUP BY 1", CLUSTERS))(
    lambda spark, folder: clusters.cluster_members(given_clusters(spark, folder)).withColumn("members", F.array_join("members", "|")))
add("cluster_sizes", sql("SELECT cluster, count(*) AS size FROM clustered GROUP BY 1", CLUSTERS))(
    lambda spark, folder: clusters.cluster_sizes(given_clusters(spark, folder)))
add("cluster_label", sql("SELECT tweet_id, (SELECT min(doc_key) FROM clustered c WHERE c.cluster = p.cluster) AS label FROM pred p", TWEETS, CLUSTERS, PRED))(
    lambda spark, folder: clusters.label_of_cluster(given_predictions(spark, folder), given_clusters(spark, folder)).select("tweet_id", "label"))
add("cluster_candidates", sql("SELECT tweet_id, (SELECT string_agg(doc_key, '|' ORDER BY doc_key) FROM clustered c WHERE c.cluster = p.cluster) AS candidates FROM pred p", TWEETS, CLUSTERS, PRED))(
    lambda spark, folder: clusters.candidates_of_cluster(given_predictions(spark, folder), clusters.cluster_members(given_clusters(spark, folder))).select("tweet_id", F.array_join("candidates", "|").alias("candidates")))
add("candidate_profiles", sql("SELECT tweet_id, string_agg(doc_key, '|' ORDER BY doc_key) AS profiles FROM pred JOIN clustered USING (cluster) GROUP BY 1", TWEETS, CLUSTERS, PRED))(
    lambda spark, folder: clusters.candidate_profiles(given_predictions(spark, folder), given_clusters(spark, folder)).select("tweet_id", F.array_join(F.transform("profiles", lambda p: p["doc_key"]), "|").alias("profiles")))
add("exact_accuracy", sql("SELECT count(*) FILTER (label = place_country) AS correct, count(*) AS total FROM pred p JOIN (SELECT cluster, min(doc_key) AS label FROM clustered GROUP BY 1) USING (cluster)", TWEETS, CLUSTERS, PRED))(
    lambda spark, folder: aggregates.exact_accuracy(clusters.label_of_cluster(given_predictions(spark, folder), given_clusters(spark, folder)), "place_country", "label"))
add("candidate_accuracy", sql("SELECT count(*) FILTER ((p.cluster, p.place_country) IN (SELECT (cluster, doc_key) FROM clustered)) AS correct, count(*) AS total FROM pred p", TWEETS, CLUSTERS, PRED))(
    lambda spark, folder: aggregates.candidate_accuracy(clusters.candidates_of_cluster(given_predictions(spark, folder), clusters.cluster_members(given_clusters(spark, folder))), "place_country", "candidates"))
