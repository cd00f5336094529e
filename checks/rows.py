"""Sources, sinks, row operators and membership joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import (
    IS_TEST, MESSAGES, STOPS, TEST_BELOW, TWEETS, messages, sql, sql_clean, sql_hash, stopwords,
    table, train_test, tweets,
)
from wherewords.functions import scalars, text
from wherewords.operators import joins, regions, rows
from wherewords.session import staged_path
from wherewords.sources import files

QUERIES: dict = {}
SQL: dict = {}


def add(name: str, oracle: str | None):
    def register(query):
        QUERIES[name] = query
        if oracle is not None:
            SQL[name] = oracle
        return query

    return register


LATIN = "regexp_replace({}, '[^\\x00-\\x{{ff}}]', '?', 'g')"


@add("scan_roundtrip", sql(
    f"""SELECT tweet_id, {LATIN.format("text")} AS text, {LATIN.format("user_description")} AS user_description,
    user_lang, place_country, place_country || ', here' AS place_full_name,
    CAST(user_followers_count AS DOUBLE) AS user_followers_count, user_friends_count, lon, lat,
    CAST(hour(created_at) * 3600 + minute(created_at) * 60 + second(created_at) AS INTEGER) AS seconds
    FROM tweets""", TWEETS))
def scan_roundtrip(spark, folder):
    """Latin-1 CSV in several files written and read back by column name."""
    df = tweets(spark, folder).withColumns({
        "place_full_name": F.concat("place_country", F.lit(", here")),
        "created_at": F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"),
    })
    named = df.select(*[F.col(ours).alias(head) for head, ours, _ in files.TWEET_COLUMNS], "tweet_id")
    folder = staged_path(spark, "csv")
    for part in (0, 1):
        half = named.filter(F.col("tweet_id") % 2 == part)
        # In one folder, the second files with their columns in another order.
        files.write_table(
            half.select(*reversed(half.columns)) if part else half, f"{folder}/order={part}", "csv", encoding="ISO-8859-1"
        )
    back = files.read_tweets(spark, [folder], extra={"tweet_id": "bigint"})
    return back.select(
        "tweet_id", "text", "user_description", "user_lang", "place_country", "place_full_name",
        "user_followers_count", "user_friends_count", "lon", "lat",
        scalars.seconds_of_day(F.col("created_at")).alias("seconds"),
    )


@add("region_roundtrip", "SELECT n_name AS country, CAST(n_nationkey + 1000 AS INTEGER) AS woeid FROM nation")
def region_roundtrip(spark, folder):
    path = staged_path(spark, "regions")
    nation = table(spark, folder, "nation")
    files.write_table(nation.select(F.col("n_name").alias("Country"), (F.col("n_nationkey") + 1000).alias("woeid")), path, "csv")
    return files.read_regions(spark, path).select("country", scalars.int_key(F.col("woeid")).alias("woeid"))


@add("stopword_table", sql("SELECT lang, word FROM stops", STOPS))
def stopword_table(spark, folder):
    """Stop words written as one JSON object and read back as rows."""
    path = staged_path(spark, "stopwords-json")
    lists = stopwords(spark, folder).groupBy("lang").agg(F.collect_list("word").alias("words"))
    whole = lists.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("lang", "words")))).alias("value"))
    whole.write.text(path)
    return files.read_stopwords(spark, path)


@add("features_roundtrip", sql("SELECT tweet_id, seconds, user_lang, clean_text FROM messages", TWEETS, MESSAGES))
def features_roundtrip(spark, folder):
    path = staged_path(spark, "features")
    files.write_table(rows.select_columns(messages(spark, folder), ["tweet_id", "seconds", "user_lang", "clean_text"]), path)
    return files.read_features(spark, path)


@add("predictions_roundtrip", sql("SELECT count(*) AS n, count(predicted_location) AS n_predicted FROM (SELECT place_country AS predicted_location FROM tweets)", TWEETS))
def predictions_roundtrip(spark, folder):
    path = staged_path(spark, "predictions")
    files.write_predictions(tweets(spark, folder).withColumn("predicted_location", F.col("place_country")), path)
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.count("predicted_location").alias("n_predicted"))


@add("select_columns", sql("SELECT tweet_id, source, lon, lat FROM tweets", TWEETS))
def select_columns(spark, folder):
    return rows.select_columns(tweets(spark, folder), ["tweet_id", "source", "lon", "lat"])


@add("text_columns", sql("SELECT tweet_id, hashtags, clean_text, seconds FROM messages", TWEETS, MESSAGES))
def text_columns(spark, folder):
    return rows.with_text_columns(tweets(spark, folder)).select("tweet_id", "hashtags", "clean_text", "seconds")


@add("drop_columns", "SELECT event_id, user_id, event_type FROM events")
def drop_columns(spark, folder):
    return rows.drop_columns(table(spark, folder, "events"), ["ts", "value", "props"])


@add("drop_all_null", "SELECT a, b FROM (SELECT CASE WHEN doc_id % 3 > 0 THEN doc_id END AS a, CASE WHEN doc_id % 2 > 0 THEN lang END AS b FROM documents) WHERE a IS NOT NULL OR b IS NOT NULL")
def drop_all_null(spark, folder):
    docs = table(spark, folder, "documents")
    sparse = docs.select(F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")).alias("a"), F.when(F.col("doc_id") % 2 > 0, F.col("lang")).alias("b"))
    return rows.drop_all_null(sparse)


@add("keep_not_null", sql("SELECT tweet_id, user_description FROM tweets WHERE user_description IS NOT NULL", TWEETS))
def keep_not_null(spark, folder):
    return rows.keep_not_null(tweets(spark, folder), "user_description").select("tweet_id", "user_description")


@add("numeric_coerce", sql("SELECT tweet_id, TRY_CAST(raw AS DOUBLE) AS raw FROM (SELECT tweet_id, CASE WHEN tweet_id % 7 = 0 THEN 'n/a' ELSE CAST(user_followers_count AS VARCHAR) END AS raw FROM tweets)", TWEETS))
def numeric_coerce(spark, folder):
    raw = F.when(F.col("tweet_id") % 7 == 0, "n/a").otherwise(F.col("user_followers_count").cast("string"))
    return rows.to_number(tweets(spark, folder).select("tweet_id", raw.alias("raw")), ["raw"])


@add("description_text", sql("SELECT tweet_id, coalesce(user_description, '') AS user_description, coalesce(user_description, 'nan') AS compat FROM tweets", TWEETS))
def description_text(spark, folder):
    df = tweets(spark, folder).select("tweet_id", "user_description", F.col("user_description").alias("compat"))
    return rows.null_text(rows.null_text(df, "user_description"), "compat", nan_compat=True)


@add("lang_canonical", sql("SELECT tweet_id, user_lang FROM messages", TWEETS, MESSAGES))
def lang_canonical(spark, folder):
    return messages(spark, folder).select("tweet_id", "user_lang")


# Fixed value: the languages that are filled.
LISTED = ["fil", "sr", "uk", "hr", "pl", "sk", "sv", "ja"]


@add("conditional_fill", sql(
    f"SELECT tweet_id, CASE WHEN t.user_lang IN ({', '.join(repr(x) for x in LISTED)}) AND {sql_clean('text')} <> '' THEN {sql_clean('text')} ELSE 'Yet to be Filled' END AS filled FROM tweets t", TWEETS))
def conditional_fill(spark, folder):
    df = rows.with_text_columns(tweets(spark, folder))
    return rows.fill_conditional(df, LISTED, "Yet to be Filled").select("tweet_id", "filled")


@add("row_ids", "SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS row_id FROM events")
def row_ids(spark, folder):
    events = table(spark, folder, "events").select("event_id")
    return rows.with_row_id(events, "event_id", buckets=64)


@add("resume_after", "SELECT n_name, n_nationkey FROM nation WHERE n_name >= (SELECT n_name FROM nation WHERE n_nationkey = 14)")
def resume_after(spark, folder):
    return rows.resume_after(table(spark, folder, "nation"), "n_name", "n_nationkey", 14).select("n_name", "n_nationkey")


@add("column_values", "SELECT n_name FROM nation")
def column_values(spark, folder):
    return rows.column_values(table(spark, folder, "nation"), "n_name")


@add("doc_text", sql("SELECT tweet_id, clean_text || ' ' || hashtags AS doc_text FROM messages", TWEETS, MESSAGES))
def doc_text(spark, folder):
    return messages(spark, folder).select("tweet_id", text.doc_text(F.col("clean_text"), F.col("hashtags")).alias("doc_text"))


@add("lat_lon", sql("SELECT tweet_id, lat, lon FROM tweets", TWEETS))
def lat_lon(spark, folder):
    pairs = tweets(spark, folder).select("tweet_id", scalars.lat_lon(F.col("lat"), F.col("lon")).alias("pair"))
    return pairs.select("tweet_id", "pair.lat", "pair.lon")


@add("rows_of_group", sql("SELECT tweet_id, place_country FROM tweets WHERE place_country IN ('NATION_24', 'NATION_7')", TWEETS))
def rows_of_group(spark, folder):
    return rows.rows_of_group(tweets(spark, folder), "place_country", ["NATION_24", "NATION_7"]).select("tweet_id", "place_country")


@add("frequent_country", sql("SELECT tweet_id, place_country FROM tweets WHERE place_country IN (SELECT place_country FROM tweets GROUP BY 1 HAVING count(*) > 10)", TWEETS))
def frequent_country(spark, folder):
    return joins.keep_frequent(tweets(spark, folder), "place_country", 10).select("tweet_id", "place_country")


def boxes_of_nations(spark, folder):
    """One box per nation; neighbours share an edge."""
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    return table(spark, folder, "nation").select(
        F.col("n_name").alias("country"),
        (k * 14 - 170).cast("double").alias("lon_min"), (r * 30 - 70).cast("double").alias("lat_min"),
        (k * 14 - 156).cast("double").alias("lon_max"), (r * 30 - 40).cast("double").alias("lat_max"),
    )


@add("region_dim", "SELECT n_name AS country, CAST(n_nationkey * 14 - 170 AS DOUBLE) AS lon_min, CAST(n_nationkey + 1000 AS INTEGER) AS woeid FROM nation")
def region_dim(spark, folder):
    """Nations have boxes, the listed regions of the world have none."""
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    listed = nation.select(F.col("n_name").alias("country"), (F.col("n_nationkey") + 1000).cast("string").alias("woeid"))
    listed = listed.unionAll(region.select("r_name", F.col("r_regionkey").cast("string")))
    return regions.region_dim(listed, boxes_of_nations(spark, folder)).select("country", "lon_min", "woeid")


@add("train_split", sql(f"SELECT tweet_id FROM tweets WHERE NOT ({IS_TEST})", TWEETS))
def train_split(spark, folder):
    return train_test(tweets(spark, folder))[0].select("tweet_id")


@add("test_split", sql(f"SELECT tweet_id FROM tweets WHERE {IS_TEST}", TWEETS))
def test_split(spark, folder):
    return rows.holdout(tweets(spark, folder), "tweet_id", 0.2).select("tweet_id")


@add("exact_holdout", f"SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY {sql_hash('CAST(event_id AS VARCHAR)')}, event_id) AS r, count(*) OVER () AS n FROM events) WHERE r <= floor(0.2 * n)")
def exact_holdout(spark, folder):
    return rows.exact_holdout(table(spark, folder, "events").select("event_id"), "event_id", 0.2)


@add("complement", f"SELECT event_id FROM events WHERE NOT ({sql_hash('CAST(event_id AS VARCHAR)')} < {TEST_BELOW})")
def complement(spark, folder):
    events = table(spark, folder, "events")
    return rows.complement(events, rows.holdout(events, "event_id", 0.2), "event_id").select("event_id")


@add("base_meta_split", sql(f"SELECT tweet_id, {sql_hash(chr(39).join(['CAST(tweet_id AS VARCHAR) || ', ':111', '']))} % 2 = 1 AS is_meta FROM tweets", TWEETS))
def base_meta_split(spark, folder):
    base, meta = rows.half_split(tweets(spark, folder).select("tweet_id"), "tweet_id", 111)
    return base.withColumn("is_meta", F.lit(False)).unionAll(meta.withColumn("is_meta", F.lit(True)))


@add("shuffled", f"SELECT event_id, {sql_hash(chr(39).join(['CAST(event_id AS VARCHAR) || ', ':111', '']))} AS place FROM events")
def shuffled(spark, folder):
    events = rows.shuffle(table(spark, folder, "events"), "event_id", 111)
    return events.select("event_id", scalars.hash_number(F.col("event_id"), 111).alias("place"))


@add("sorted_regions", "SELECT n_name, n_regionkey FROM nation ORDER BY n_name")
def sorted_regions(spark, folder):
    return rows.sort_by(table(spark, folder, "nation").select("n_name", "n_regionkey"), ["n_name"])


@add("sorted_scores", "SELECT event_id, value FROM events ORDER BY value DESC, event_id")
def sorted_scores(spark, folder):
    return rows.sort_by_score(table(spark, folder, "events").select("event_id", "value"), "value", "event_id")


@add("first_rows", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 5")
def first_rows(spark, folder):
    events = table(spark, folder, "events").select("event_id", "value").withColumn("minus", -F.col("value"))
    return rows.first_n(events, 5, ["minus", "event_id"]).select("event_id", "value")


@add("union_sources", "SELECT doc_id AS id, lang, NULL AS role, text FROM documents UNION ALL SELECT conv_id, NULL, role, text FROM conversations")
def union_sources(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "lang", "text")
    talks = table(spark, folder, "conversations").select("text", "role", F.col("conv_id").alias("id"))
    return rows.union_all([docs, talks])


@add("known_lang", sql(f"SELECT tweet_id, user_lang FROM messages WHERE {IS_TEST} AND user_lang IN (SELECT user_lang FROM messages WHERE NOT ({IS_TEST}))", TWEETS, MESSAGES))
def known_lang(spark, folder):
    train, test = train_test(messages(spark, folder))
    return joins.keep_known_lang(test, train).select("tweet_id", "user_lang")


@add("lang_one_hot", sql(
    "SELECT tweet_id, user_lang, CAST(id AS BIGINT) AS id FROM messages JOIN ids USING (user_lang)", TWEETS, MESSAGES,
    "ids AS (SELECT user_lang, row_number() OVER (ORDER BY user_lang) - 1 AS id FROM (SELECT DISTINCT user_lang FROM messages WHERE user_lang IS NOT NULL))"))
def lang_one_hot(spark, folder):
    """The flag of each message's language, by its number."""
    df = messages(spark, folder).select("tweet_id", "user_lang")
    values, cells = joins.one_hot_cells(df, "tweet_id", "user_lang")
    return cells.join(values, cells["term"] == values["id"]).select("tweet_id", "user_lang", "id")
