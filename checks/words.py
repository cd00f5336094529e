"""Text functions, stop words, stems, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import (
    MESSAGES, STOPS, TERMS, TWEETS, messages, sql, sql_clean, sql_hashtags, sql_stem, sql_tokens,
    stopwords, table, tweets,
)
from wherewords.functions import scalars, text
from wherewords.operators import words
from wherewords.session import stage
from wherewords.sources.languages import stem_rule_dimension

QUERIES: dict = {}
SQL: dict = {}


def add(name: str, oracle: str | None):
    def register(query):
        QUERIES[name] = query
        if oracle is not None:
            SQL[name] = oracle
        return query

    return register


def of_text(column, alias):
    return lambda spark, folder: tweets(spark, folder).select("tweet_id", column(F.col("text")).alias(alias))


def joined(function):
    """An array of tokens as one text, for the comparison."""
    return lambda c: F.array_join(function(c), "|")


add("hashtags", sql(f"SELECT tweet_id, array_to_string({sql_hashtags('text')}, ', ') AS hashtags FROM tweets", TWEETS))(of_text(text.hashtags, "hashtags"))

add("hashtag_values", sql(f"SELECT DISTINCT tag FROM (SELECT unnest({sql_hashtags('text')}) AS tag FROM tweets)", TWEETS))(
    lambda spark, folder: tweets(spark, folder).select(F.explode(text.hashtag_set(F.col("text"))).alias("tag")).distinct()
)

MENTION = rf"(^|[^{text.LETTER}0-9_.-])@([{text.LETTER}][{text.LETTER}0-9]+)"
add("mentions", sql(f"SELECT tweet_id, array_to_string(regexp_extract_all(text, '{MENTION}', 2), ', ') AS mentions FROM tweets", TWEETS))(of_text(text.mentions, "mentions"))

add("clean_text", sql(f"SELECT tweet_id, {sql_clean('text')} AS clean_text FROM tweets", TWEETS))(of_text(text.clean_text, "clean_text"))

add("clean_documents", f"SELECT doc_id, {sql_clean('text')} AS clean_text FROM documents")(
    lambda spark, folder: table(spark, folder, "documents").select("doc_id", text.clean_text(F.col("text")).alias("clean_text"))
)

add("seconds_of_day", "SELECT event_id, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS INTEGER) AS seconds, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS INTEGER) AS seconds_text FROM events")(
    lambda spark, folder: table(spark, folder, "events").select(
        "event_id", scalars.seconds_of_day(F.col("ts")).alias("seconds"),
        scalars.seconds_of_day_text(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("seconds_text"),
    )
)

add("tokens", sql(f"SELECT tweet_id, array_to_string({sql_tokens('text')}, '|') AS tokens FROM tweets", TWEETS))(of_text(joined(text.tokens), "tokens"))
add("lower_tokens", sql(f"SELECT tweet_id, array_to_string(list_transform({sql_tokens('clean_text')}, lambda t: lower(t)), '|') AS tokens FROM messages", TWEETS, MESSAGES))(
    lambda spark, folder: messages(spark, folder).select("tweet_id", F.array_join(text.lower_tokens(text.tokens(F.col("clean_text"))), "|").alias("tokens"))
)

# Runs of equal characters cut to three without a back-reference: a character
# goes if it equals each of the three before it.
HANDLE_FREE = rf"regexp_replace(text, '{text.HANDLE}', '\1 ', 'g')"
TWEET_TOKEN = text.TWEET_TOKEN.replace("'", "''")
add("tweet_tokens", sql(
    f"""SELECT tweet_id, array_to_string(regexp_extract_all(lower(array_to_string(list_filter(chars,
      lambda c, i: NOT (i > 3 AND c = chars[i - 1] AND c = chars[i - 2] AND c = chars[i - 3])), '')),
      '{TWEET_TOKEN}'), '|') AS tokens
    FROM (SELECT tweet_id, string_split({HANDLE_FREE}, '') AS chars FROM tweets)""", TWEETS))(of_text(joined(text.tweet_tokens), "tokens"))

add("vector_tokens", sql(f"SELECT tweet_id, array_to_string(regexp_extract_all(lower(text), '{text.VECTOR_TOKEN}'), '|') AS tokens FROM tweets", TWEETS))(of_text(joined(text.vector_tokens), "tokens"))
add("word_tokens", sql(f"SELECT tweet_id, array_to_string(regexp_extract_all(lower(text), '{text.WORD_TOKEN}'), '|') AS tokens FROM tweets", TWEETS))(of_text(joined(text.word_tokens), "tokens"))

add("bigrams", sql(
    f"""SELECT tweet_id, coalesce(array_to_string(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), '|'), '') AS bigrams
    FROM (SELECT tweet_id, {sql_tokens('clean_text')} AS w FROM messages)""", TWEETS, MESSAGES))(
    lambda spark, folder: messages(spark, folder).select("tweet_id", F.array_join(text.bigrams(text.tokens(F.col("clean_text"))), "|").alias("bigrams"))
)

add("place_parts", "SELECT n_nationkey, n_name AS city, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")(
    lambda spark, folder: table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    .select("n_nationkey", text.place_parts(F.concat("n_name", F.lit(", "), "r_name")).alias("parts"))
    .select("n_nationkey", F.get("parts", F.lit(0)).alias("city"), F.get("parts", F.lit(1)).alias("region"))
)

WORD_ROWS = f"""tokens AS (SELECT tweet_id, user_lang, pos, lower(w[pos]) AS word FROM (
  SELECT tweet_id, user_lang, w, unnest(range(1, len(w) + 1)) AS pos FROM (
    SELECT tweet_id, user_lang, {sql_tokens('clean_text')} AS w FROM messages)))"""


def token_rows(spark, folder):
    return words.explode_tokens(messages(spark, folder), ["tweet_id", "user_lang"], text.tokens(F.col("clean_text")))


@add("stopword_removed", sql(
    "SELECT tweet_id, user_lang, CAST(pos - 1 AS INTEGER) AS pos, word FROM tokens t WHERE NOT EXISTS (SELECT 1 FROM stops s WHERE s.lang = t.user_lang AND s.word = t.word)",
    TWEETS, MESSAGES, STOPS, WORD_ROWS))
def stopword_removed(spark, folder):
    return words.remove_stopwords(token_rows(spark, folder), stopwords(spark, folder)).select("tweet_id", "user_lang", "pos", "word")


@add("stem_vocab", sql(f"SELECT DISTINCT user_lang AS lang, word, {sql_stem('word', 'user_lang')} AS stem FROM tokens", TWEETS, MESSAGES, WORD_ROWS))
def stem_vocab(spark, folder):
    lowered = token_rows(spark, folder).withColumn("word", F.lower("word"))
    return words.stem_vocabulary(lowered, stem_rule_dimension(spark))


DESCRIPTION_ROWS = f"""said AS (SELECT tweet_id, user_lang, pos, lower(w[pos]) AS word FROM (
  SELECT tweet_id, user_lang, w, unnest(range(1, len(w) + 1)) AS pos FROM (
    SELECT tweet_id, user_lang, {sql_tokens(sql_clean('user_description'))} AS w FROM messages)))"""


@add("description_tokens", sql(
    f"SELECT tweet_id, CAST(pos - 1 AS INTEGER) AS pos, {sql_stem('word', 'user_lang')} AS word FROM said t WHERE NOT EXISTS (SELECT 1 FROM stops s WHERE s.lang = t.user_lang AND s.word = t.word)",
    TWEETS, MESSAGES, STOPS, DESCRIPTION_ROWS))
def description_tokens(spark, folder):
    return words.description_tokens(messages(spark, folder), stopwords(spark, folder)).select("tweet_id", "pos", "word")


def country_tf(spark, folder):
    df = messages(spark, folder).withColumnRenamed("place_country", "doc_key")
    return words.message_term_counts(df, stopwords(spark, folder), "doc_key")


def tweet_tf(spark, folder):
    return words.message_term_counts(messages(spark, folder), stopwords(spark, folder), "tweet_id")


COUNTRY_TF = "country_tf AS (SELECT place_country AS doc_key, term, count(*) AS tf FROM terms GROUP BY 1, 2)"
TWEET_TF = "tweet_tf AS (SELECT tweet_id, term, count(*) AS tf FROM terms GROUP BY 1, 2)"

add("term_freq", sql("SELECT tweet_id, term, tf FROM tweet_tf", TWEETS, MESSAGES, STOPS, TERMS, TWEET_TF))(tweet_tf)
add("country_term_freq", sql("SELECT doc_key, term, tf FROM country_tf", TWEETS, MESSAGES, STOPS, TERMS, COUNTRY_TF))(country_tf)
add("doc_freq", sql("SELECT term, count(*) AS df FROM tweet_tf GROUP BY 1", TWEETS, MESSAGES, STOPS, TERMS, TWEET_TF))(
    lambda spark, folder: words.doc_freq(tweet_tf(spark, folder))
)


@add("stemmed_only", sql("SELECT tweet_id, count(*) AS n FROM terms WHERE tweet_id IN (SELECT tweet_id FROM messages WHERE user_lang NOT IN ('zh', 'ja')) GROUP BY 1", TWEETS, MESSAGES, STOPS, TERMS))
def stemmed_only(spark, folder):
    """Terms of the languages that have a stemmer."""
    kept = words.message_terms(messages(spark, folder), stopwords(spark, folder), ["tweet_id"], drop_unstemmed=True)
    return kept.groupBy("tweet_id").agg(F.count("*").alias("n"))


@add("bag_of_words", sql(
    "SELECT b.item_id, b.term, b.tf FROM (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(" + sql_tokens("lower(" + sql_clean("text") + ")") + ") AS term FROM benchmark) GROUP BY 1, 2) b WHERE b.term IN (SELECT DISTINCT term FROM terms)",
    TWEETS, MESSAGES, STOPS, TERMS))
def bag_of_words(spark, folder):
    """Benchmark texts as counts over the vocabulary of the messages."""
    items = table(spark, folder, "benchmark").select("item_id", F.explode(text.tokens(F.lower(text.clean_text(F.col("text"))))).alias("term"))
    vocab = stage(words.vocabulary(words.message_terms(messages(spark, folder), stopwords(spark, folder), ["tweet_id"])), "vocabulary")
    bag = words.bag_of_words(words.term_counts(items, "item_id"), vocab)
    return bag.select("item_id", "term", "tf")
