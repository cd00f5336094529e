"""TF-IDF, cosines, margins, Fourier maps, centroids."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import (
    IS_TEST, MESSAGES, STOPS, TERMS, TWEETS, messages, sql, sql_clean, sql_hashtags, sql_idf,
    sql_tokens, stopwords, table, train_test, tweets,
)
from checks.stops import ENGLISH, KEPT
from checks.words import country_tf
from wherewords.functions import scalars, text
from wherewords.operators import clusters, features, similarity, windows, words
from wherewords.operators.classify import linear_margins
from wherewords.plans.textclass import FourierMap, numbered_idf, text_features
from wherewords.plans.retrieval import retrieve_top_k_tfidf
from wherewords.session import stage

QUERIES: dict = {}
SQL: dict = {}


def add(name: str, oracle: str | None):
    def register(query):
        QUERIES[name] = query
        if oracle is not None:
            SQL[name] = oracle
        return query

    return register


BASE = (TWEETS, MESSAGES, STOPS, TERMS)


def sql_tfidf(out: str, tf: str, key: str, idf: str) -> str:
    return f"""{out} AS (SELECT {key}, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY {key})) AS weight
      FROM (SELECT {key}, term, tf * idf AS raw FROM {tf} JOIN {idf} USING (term)))"""


def sql_idf_table(out: str, tf: str, key: str) -> str:
    n = f"(SELECT count(DISTINCT {key}) FROM {tf})"
    return f"{out} AS (SELECT term, count(*) AS df, {sql_idf(n, 'count(*)')} AS idf FROM {tf} GROUP BY term)"


COUNTRY_TF = "country_tf AS (SELECT place_country AS doc_key, term, count(*) AS tf FROM terms GROUP BY 1, 2)"
TRAIN_TF = f"train_tf AS (SELECT place_country AS doc_key, term, count(*) AS tf FROM terms WHERE NOT ({IS_TEST}) GROUP BY 1, 2)"
TEST_TF = f"test_tf AS (SELECT tweet_id, term, count(*) AS tf FROM terms WHERE {IS_TEST} GROUP BY 1, 2)"


@add("tfidf", sql("SELECT doc_key, term, round(weight, 6) AS weight FROM w", *BASE, COUNTRY_TF, sql_idf_table("idf", "country_tf", "doc_key"), sql_tfidf("w", "country_tf", "doc_key", "idf")))
def tfidf(spark, folder):
    tf = stage(country_tf(spark, folder), "country-tf")
    weights = features.tfidf(tf, features.idf_table(tf, "doc_key"), "doc_key", short_docs=False)
    return weights.withColumn("weight", F.round("weight", 6))


def train_test_tf(spark, folder):
    stops = stopwords(spark, folder)
    train, test = train_test(messages(spark, folder))
    train_tf = words.message_term_counts(train.withColumnRenamed("place_country", "doc_key"), stops, "doc_key")
    return stage(train_tf, "train-tf"), words.message_term_counts(test, stops, "tweet_id")


@add("tfidf_transform", sql("SELECT tweet_id, term, round(weight, 6) AS weight FROM w", *BASE, TRAIN_TF, TEST_TF, sql_idf_table("idf", "train_tf", "doc_key"), sql_tfidf("w", "test_tf", "tweet_id", "idf")))
def tfidf_transform(spark, folder):
    """Held-out messages under the training vocabulary and weights."""
    train_tf, test_tf = train_test_tf(spark, folder)
    weights = features.tfidf(test_tf, stage(features.idf_table(train_tf, "doc_key"), "idf"), "tweet_id")
    return weights.withColumn("weight", F.round("weight", 6))


COSINES = (
    *BASE, TRAIN_TF, TEST_TF, sql_idf_table("idf", "train_tf", "doc_key"),
    sql_tfidf("q", "test_tf", "tweet_id", "idf"), sql_tfidf("c", "train_tf", "doc_key", "idf"),
    "met AS (SELECT tweet_id, doc_key, round(sum(q.weight * c.weight), 6) AS score FROM q JOIN c USING (term) GROUP BY 1, 2)",
    f"scores AS (SELECT tweet_id, doc_key, coalesce(score, 0) AS score FROM (SELECT tweet_id FROM tweets WHERE {IS_TEST}) CROSS JOIN (SELECT DISTINCT doc_key FROM c) LEFT JOIN met USING (tweet_id, doc_key))",
)


@add("cosine_all", sql("SELECT tweet_id, doc_key, score FROM scores", *COSINES))
def cosine_all(spark, folder):
    """Every held-out message against every country profile."""
    return every_cosine(spark, folder, 1 << 30).drop("rank")


def every_cosine(spark, folder, k):
    train_tf, test_tf = train_test_tf(spark, folder)
    return retrieve_top_k_tfidf(test_tf, train_tf, k, keys=train_test(tweets(spark, folder))[1].select("tweet_id"))


@add("top5_cosine", sql("SELECT tweet_id, doc_key, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY tweet_id ORDER BY score DESC, doc_key) AS r FROM scores) WHERE r <= 5", *COSINES))
def top5_cosine(spark, folder):
    return every_cosine(spark, folder, 5)


@add("best_candidate", sql("SELECT tweet_id, doc_key, score FROM (SELECT *, row_number() OVER (PARTITION BY tweet_id ORDER BY score DESC, doc_key) AS r FROM scores) WHERE r = 1", *COSINES))
def best_candidate(spark, folder):
    return windows.best_of(cosine_all(spark, folder), "tweet_id", "doc_key", "score")


@add("hit_at_5", sql(
    f"SELECT round(avg(CAST(coalesce(hit, FALSE) AS DOUBLE)), 6) AS hit_rate FROM (SELECT tweet_id, place_country FROM tweets WHERE {IS_TEST}) t LEFT JOIN (SELECT tweet_id, doc_key AS place_country, TRUE AS hit FROM (SELECT *, row_number() OVER (PARTITION BY tweet_id ORDER BY score DESC, doc_key) AS r FROM scores) WHERE r <= 5) h USING (tweet_id, place_country)", *COSINES))
def hit_at_5(spark, folder):
    from wherewords.operators.aggregates import hit_rate

    ranked = windows.ranked_docs(top5_cosine(spark, folder), "tweet_id", "doc_key")
    test = train_test(tweets(spark, folder))[1].select("tweet_id", "place_country")
    rate = hit_rate(test.join(ranked, "tweet_id", "left"), "place_country", "ranked", 5)
    return rate.withColumn("hit_rate", F.round("hit_rate", 6))


# --- three fields with pairs -------------------------------------------------




def sql_field(name: str, expr: str) -> str:
    """Message tokens without stop words, and their pairs, of one field."""
    stop = ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH if w not in KEPT)
    token = text.TWEET_TOKEN.replace("'", "''")
    return f"""{name}_chars AS (SELECT tweet_id, string_split(regexp_replace({expr}, '{text.HANDLE}', '\\1 ', 'g'), '') AS chars FROM messages),
    {name}_words AS (SELECT tweet_id, list_filter(regexp_extract_all(lower(array_to_string(list_filter(chars,
      lambda c, i: NOT (i > 3 AND c = chars[i - 1] AND c = chars[i - 2] AND c = chars[i - 3])), '')), '{token}'), lambda t: t NOT IN ({stop})) AS w FROM {name}_chars),
    {name}_grams AS (SELECT tweet_id, '{name}' AS field, unnest(list_concat(w, coalesce(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), []))) AS term FROM {name}_words)"""


FIELDS = [
    sql_field("text", "clean_text"),
    sql_field("user_description", sql_clean("coalesce(user_description, '')")),
    sql_field("hashtags", sql_clean("hashtags")),
]


@add("tfidf_fields", sql(
    f"""SELECT tweet_id, field, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY tweet_id, field)), 6) AS weight FROM (
    SELECT tweet_id, field, term, tf * {sql_idf('n', 'df')} AS raw FROM tf JOIN df USING (field, term) JOIN n USING (field))""",
    TWEETS, MESSAGES, *FIELDS,
    "grams AS (SELECT * FROM text_grams UNION ALL SELECT * FROM user_description_grams UNION ALL SELECT * FROM hashtags_grams)",
    "tf AS (SELECT tweet_id, field, term, count(*) AS tf FROM grams GROUP BY 1, 2, 3)",
    "df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY 1, 2)",
    "n AS (SELECT field, count(DISTINCT tweet_id) AS n FROM tf GROUP BY 1)"))
def tfidf_fields(spark, folder):
    grams = features.field_grams(tweets(spark, folder))
    weights = features.tfidf_fields(features.grams_long(grams, "tweet_id"), "tweet_id")
    return weights.withColumn("weight", F.round("weight", 6))


@add("count_vectors", sql(
    "SELECT item_id, CAST(id AS BIGINT) AS id, count(*) AS tf FROM words JOIN ids USING (word) GROUP BY ALL",
    "words AS (SELECT item_id, unnest(" + sql_tokens("lower(" + sql_clean("text") + ")") + ") AS word FROM benchmark)",
    "ids AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS id FROM (SELECT DISTINCT word FROM words))"))
def count_vectors(spark, folder):
    """Counts under the whole numbered vocabulary."""
    items = table(spark, folder, "benchmark").select("item_id", text.lower_tokens(text.clean_words(F.col("text"))).alias("words"))
    return features.count_vectorize(items, "item_id", "words")[1]


@add("meta_features", sql("SELECT tweet_id, user_friends_count, CAST(seconds AS DOUBLE) AS seconds, CAST(user_followers_count AS DOUBLE) AS user_followers_count, CAST(user_lang = 'en' AS INTEGER) + 0.0 AS lang_en FROM messages", TWEETS, MESSAGES).replace("AS INTEGER) + 0.0 AS lang_en", "AS DOUBLE) AS lang_en"))
def meta_features(spark, folder):
    """The numeric part of the stacked features, through the assembled vector."""
    from pyspark.ml.functions import vector_to_array

    from wherewords.operators.joins import one_hot

    df = one_hot(messages(spark, folder), "user_lang", ["en"])
    stacked = features.assemble_features(df, [], ["lang_en"], "features")
    values = stacked.select("tweet_id", vector_to_array("features").alias("v"))
    names = ["user_friends_count", "seconds", "user_followers_count", "lang_en"]
    return values.select("tweet_id", *[F.get("v", F.lit(i)).alias(n) for i, n in enumerate(names)])


# --- dense vectors -------------------------------------------------------------

DIMS = "dims AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, CAST(unnest(range(len(embedding))) AS INTEGER) AS i FROM embeddings)"
CENTERS = "centers AS (SELECT label, i, avg(x) AS c FROM dims GROUP BY 1, 2)"


def embeddings(spark, folder):
    return table(spark, folder, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))


def centers(spark, folder):
    """The mean vector of each label."""
    labelled = embeddings(spark, folder).withColumnRenamed("label", "cluster")
    return stage(clusters.lloyd_step(labelled, "embedding").select(F.col("cluster").alias("label"), "center"), "centers")


@add("nearest_centroid", sql(
    "SELECT vec_id, label AS cluster, d AS distance2 FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, label) AS r FROM (SELECT d.vec_id, c.label, round(sum((d.x - c.c) * (d.x - c.c)), 6) AS d FROM dims d JOIN centers c USING (i) GROUP BY 1, 2)) WHERE r = 1", DIMS, CENTERS))
def nearest_centroid(spark, folder):
    assigned = clusters.assign_nearest(embeddings(spark, folder), centers(spark, folder), "vec_id", "embedding", "label", "center", digits=6)
    return assigned.select("vec_id", "cluster", "distance2")


@add("lloyd_step", sql(
    "SELECT cluster, i, round(avg(x), 6) AS value FROM dims JOIN (SELECT vec_id, label AS cluster FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, label) AS r FROM (SELECT d.vec_id, c.label, round(sum((d.x - c.c) * (d.x - c.c)), 9) AS d FROM dims d JOIN centers c USING (i) GROUP BY 1, 2)) WHERE r = 1) USING (vec_id) GROUP BY 1, 2", DIMS, CENTERS))
def lloyd_step(spark, folder):
    assigned = clusters.assign_nearest(embeddings(spark, folder), centers(spark, folder), "vec_id", "embedding", "label", "center")
    moved = clusters.lloyd_step(assigned, "embedding")
    return moved.select("cluster", F.posexplode("center").alias("i", "value")).withColumn("value", F.round("value", 6))


@add("cosine_pairs", sql(
    "SELECT d.vec_id, round(sum(d.x * c.c) / sqrt(sum(d.x * d.x)) / sqrt(sum(c.c * c.c)), 6) AS cosine FROM dims d JOIN centers c USING (label, i) GROUP BY 1", DIMS, CENTERS))
def cosine_pairs(spark, folder):
    """Each vector with the mean of its label."""
    pairs = embeddings(spark, folder).join(centers(spark, folder), "label")
    return pairs.select("vec_id", F.round(scalars.cosine(F.col("embedding"), F.col("center")), 6).alias("cosine"))


@add("top3_cosine_dense", sql(
    "SELECT vec_id, label, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS r FROM (SELECT d.vec_id, c.label, round(sum(d.x * c.c) / sqrt(sum(d.x * d.x)) / sqrt(sum(c.c * c.c)), 6) AS score FROM dims d JOIN centers c USING (i) GROUP BY 1, 2)) WHERE r <= 3", DIMS, CENTERS))
def top3_cosine_dense(spark, folder):
    corpus = centers(spark, folder).withColumnRenamed("center", "embedding")
    queries = embeddings(spark, folder).select("vec_id", "embedding")
    top = similarity.nearest_by_cosine(queries, corpus, "vec_id", "label", "embedding", 3, digits=6)
    return top.select("vec_id", "label", "score", F.col("rank").cast("int").alias("rank"))


@add("linear_margins", sql(
    "SELECT d.vec_id, c.label, round(sum(d.x * c.c) - 0.5 * sum(c.c * c.c), 6) AS margin FROM dims d JOIN centers c USING (i) GROUP BY 1, 2", DIMS, CENTERS))
def margins(spark, folder):
    """Margins of the nearest-mean classifier: x c - |c|^2 / 2."""
    points = embeddings(spark, folder).select("vec_id", F.posexplode("embedding").alias("feature", "value"))
    by_label = centers(spark, folder)
    slopes = by_label.select("label", F.posexplode("center").alias("feature", "weight"))
    bias = by_label.select("label", F.lit(-1).alias("feature"), (-0.5 * scalars.dot(F.col("center"), F.col("center"))).alias("weight"))
    return linear_margins(points, stage(slopes.unionAll(bias), "coefficients"), "vec_id", "label").withColumn("margin", F.round("margin", 6))


def sql_unit(label: str) -> str:
    return f"((CAST('0x' || substr(md5({label}), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


@add("random_fourier", sql(
    f"""SELECT vec_id, CAST(d AS INTEGER) AS d, round(sqrt(2.0 / 100) * cos(sum(x * w) + any_value(b)), 6) AS value FROM dims JOIN w USING (i) JOIN b USING (d) GROUP BY 1, 2""",
    DIMS,
    f"""w AS (SELECT CAST(i AS INTEGER) AS i, d, sqrt(2 * 0.5) * sqrt(-2 * ln({sql_unit("'1:' || i || ':' || d || ':r'")})) * cos(2 * pi() * {sql_unit("'1:' || i || ':' || d || ':a'")}) AS w FROM range(64) a(i), range(100) c(d))""",
    f"""b AS (SELECT d, 2 * pi() * {sql_unit("'1:' || d || ':b'")} AS b FROM range(100) c(d))"""))
def random_fourier(spark, folder):
    mapped = embeddings(spark, folder).select("vec_id", features.random_fourier(F.col("embedding"), 64, gamma=0.5, seed=1).alias("z"))
    return mapped.select("vec_id", F.posexplode("z").alias("d", "value")).withColumn("value", F.round("value", 6))


@add("text_fourier", sql(
    "SELECT tweet_id, CAST(d AS INTEGER) AS d, round(sqrt(2.0 / 100) * cos(sum(weight * w) + any_value(b)), 6) AS value FROM q JOIN w USING (term) JOIN b USING (d) GROUP BY 1, 2",
    *COSINES[:-3],
    "ids AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS i FROM idf)",
    f"""w AS (SELECT term, d, sqrt(2.0) * sqrt(-2 * ln({sql_unit("'1:' || i || ':' || d || ':r'")})) * cos(2 * pi() * {sql_unit("'1:' || i || ':' || d || ':a'")}) AS w FROM ids, range(100) c(d))""",
    f"""b AS (SELECT d, 2 * pi() * {sql_unit("'1:' || d || ':b'")} AS b FROM range(100) c(d))"""))
def text_fourier(spark, folder):
    """Held-out messages through the map in front of the non-linear text classifier."""
    train_tf, test_tf = train_test_tf(spark, folder)
    weights = text_features(test_tf, numbered_idf(train_tf, "doc_key"), "tweet_id")
    return FourierMap().features(weights, "tweet_id").select(
        "tweet_id", F.col("term").cast("int").alias("d"), F.round("value", 6).alias("value")
    )
