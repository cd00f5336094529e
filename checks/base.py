"""The message view on the test tables and the SQL pieces the checks share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wherewords.functions import text
from wherewords.operators.rows import canonical_lang, split, with_text_columns
from wherewords.operators.windows import cap_per_key
from wherewords.session import spread, stage
from wherewords.sources.languages import LANGUAGE_MAP, STEM_ROUTES, STEM_RULES, language_dimension

TEST_BELOW = int(0.2 * 2**32)
# Tasks for the texts of one split of the input (128 MB by default).
TASKS_PER_SPLIT = 8


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- messages -------------------------------------------------------------


def tweets(spark: SparkSession, folder: str) -> DataFrame:
    """Messages made of documents, events and nations: whole texts with tags, a
    user name and a URL appended; skewed countries; mixed language codes."""
    d, e, n, c = (
        table(spark, folder, name).alias(name[0])
        for name in ("documents", "events", "nation", "conversations")
    )
    # The partitioning that the joins below need at any size. The number is given, so that a
    # task's share of the texts, and its counts of their words, stay small on large tables.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = d.repartition(max(parts, TASKS_PER_SPLIT * d.rdd.getNumPartitions()), "doc_id")
    doc = F.col("d.doc_id")
    nation = F.floor(F.sqrt(doc % 625)).cast("int")
    turns = F.array_sort(F.collect_list(F.struct("c.turn", "c.text")))
    described = c.groupBy(F.col("c.conv_id").alias("conv_id")).agg(
        F.array_join(turns.getField("text"), " ").alias("user_description")
    )
    tag = F.concat(F.lit(" #"), F.col("d.source"))
    body = F.concat(
        text.single_blanks(F.col("d.text")),
        tag,
        F.lit(" #"),
        F.col("e.event_type"),
        F.when(doc % 3 == 0, tag).otherwise(""),
        F.lit(" @user"),
        F.col("e.user_id"),
        F.lit(" http://t.co/"),
        doc,
    )
    code = F.coalesce(
        F.get(F.array(*map(F.lit, ["en-GB", "zh-CN", "es-MX", "pt-PT", "uk", "ja"])), (doc % 10).cast("int")),
        F.col("d.lang"),
    )
    return (
        d.join(e, F.col("e.event_id") == doc)
        .join(n, F.col("n.n_nationkey") == nation)
        .join(described, F.col("conv_id") == doc, "left")
        .select(
            doc.alias("tweet_id"),
            F.col("e.ts").alias("created_at"),
            body.alias("text"),
            F.col("n.n_name").alias("place_country"),
            F.col("d.source").alias("source"),
            "user_description",
            code.alias("user_lang"),
            F.col("e.user_id").alias("user_followers_count"),
            F.col("e.value").alias("user_friends_count"),
            (doc % 3).cast("int").alias("user_utc_offset"),
            (F.col("n.n_nationkey") * 14 - 170 + doc % 14).cast("double").alias("lon"),
            (F.col("n.n_regionkey") * 30 - 70 + doc % 7).cast("double").alias("lat"),
            F.col("n.n_nationkey").alias("n_nationkey"),
            F.col("n.n_regionkey").alias("n_regionkey"),
        )
    )


TWEETS = f"""tweets AS (
  SELECT d.doc_id AS tweet_id, e.ts AS created_at,
    regexp_replace(d.text, '[{text.SPACE}]+', ' ', 'g') || ' #' || d.source || ' #' || e.event_type
      || CASE WHEN d.doc_id % 3 = 0 THEN ' #' || d.source ELSE '' END
      || ' @user' || e.user_id || ' http://t.co/' || d.doc_id AS text,
    n.n_name AS place_country, d.source AS source, c.told AS user_description,
    CASE d.doc_id % 10 WHEN 0 THEN 'en-GB' WHEN 1 THEN 'zh-CN' WHEN 2 THEN 'es-MX'
      WHEN 3 THEN 'pt-PT' WHEN 4 THEN 'uk' WHEN 5 THEN 'ja' ELSE d.lang END AS user_lang,
    e.user_id AS user_followers_count, e.value AS user_friends_count,
    CAST(d.doc_id % 3 AS INTEGER) AS user_utc_offset,
    CAST(n.n_nationkey * 14 - 170 + d.doc_id % 14 AS DOUBLE) AS lon,
    CAST(n.n_regionkey * 30 - 70 + d.doc_id % 7 AS DOUBLE) AS lat,
    n.n_nationkey, n.n_regionkey
  FROM documents d JOIN events e ON e.event_id = d.doc_id
  JOIN nation n ON n.n_nationkey = CAST(floor(sqrt(d.doc_id % 625)) AS INTEGER)
  LEFT JOIN (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS told FROM conversations GROUP BY conv_id) c
    ON c.conv_id = d.doc_id)"""


def sql_clean(expr: str) -> str:
    # Fixed value: what counts as no word decides the result.
    pattern = rf"@[A-Za-z0-9]+|[^0-9A-Za-z \t]|[{text.WORD}]+://[^{text.SPACE}]+"
    return (
        f"trim(regexp_replace(regexp_replace({expr}, '{pattern}', ' ', 'g'), '[ \\t]+', ' ', 'g'))"
    )


def sql_tokens(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '[{text.SPACE}]+'), lambda t: t <> '')"


def sql_hashtags(expr: str) -> str:
    return (
        f"list_sort(list_distinct(list_transform(list_filter({sql_tokens(expr)}, "
        "lambda t: starts_with(t, '#')), lambda t: trim(t, '#'))))"
    )


def sql_hash(expr: str) -> str:
    return f"CAST('0x' || substr(md5({expr}), 1, 8) AS BIGINT)"


def sql_idf(n: str, df: str) -> str:
    return f"(ln((1 + {n}) / CAST(1 + {df} AS DOUBLE)) + 1)"


def sql_stem(word: str, lang: str) -> str:
    """The suffix rules as nested CASE, longest suffix first."""
    branches = []
    for code, route in STEM_ROUTES.items():
        own = sorted((r for r in STEM_RULES if r[0] == route), key=lambda r: -len(r[1]))
        cases = " ".join(
            f"WHEN ends_with({word}, '{s}') AND length({word}) - {len(s)} >= {m} "
            f"THEN substr({word}, 1, length({word}) - {len(s)}) || '{r}'"
            for _, s, r, m in own
        )
        if cases:
            branches.append(f"WHEN '{code}' THEN CASE {cases} ELSE {word} END")
    return f"CASE {lang} {' '.join(branches)} ELSE {word} END"


SECONDS = "CAST(hour(created_at) * 3600 + minute(created_at) * 60 + second(created_at) AS INTEGER)"

MESSAGES = f"""lang_map(raw, canonical) AS (
  VALUES {", ".join(f"('{a}', '{b}')" for a, b in LANGUAGE_MAP)}),
messages AS (
  SELECT t.* REPLACE (coalesce(m.canonical, t.user_lang) AS user_lang),
    {sql_clean("t.text")} AS clean_text,
    array_to_string({sql_hashtags("t.text")}, ', ') AS hashtags,
    {SECONDS} AS seconds
  FROM tweets t LEFT JOIN lang_map m ON m.raw = t.user_lang)"""


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """The messages with canonical languages and the derived text columns."""
    recoded = canonical_lang(tweets(spark, folder), language_dimension(spark))
    return with_text_columns(recoded)


# --- stop words: the ten most frequent words per language -------------------


def stopwords(spark: SparkSession, folder: str) -> DataFrame:
    words = spread(table(spark, folder, "documents").select("lang", "text")).select(
        F.col("lang"), F.explode(text.clean_words(F.col("text"))).alias("word")
    ).withColumn("word", F.lower("word"))
    counts = words.groupBy("lang", "word").agg((-F.count("*")).alias("minus_n"))
    top = cap_per_key(counts, "lang", 10, ["minus_n", "word"])
    return stage(top.select("lang", "word"), "stopwords")


STOPS = f"""stops AS (
  SELECT lang, word FROM (
    SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS r
    FROM (SELECT lang, unnest({sql_tokens("lower(" + sql_clean("text") + ")")}) AS word FROM documents)
    GROUP BY lang, word) WHERE r <= 10)"""

# Terms of a message, one row per occurrence.
TERMS = f"""word_rows AS (
  SELECT tweet_id, place_country, user_lang, unnest({sql_tokens("lower(clean_text)")}) AS word
  FROM messages),
terms AS (
  SELECT * FROM (
    SELECT tweet_id, place_country, {sql_stem("word", "user_lang")} AS term FROM word_rows w
    WHERE NOT EXISTS (SELECT 1 FROM stops s WHERE s.lang = w.user_lang AND s.word = w.word)
    UNION ALL
    SELECT tweet_id, place_country, unnest({sql_tokens("lower(" + sql_clean("hashtags") + ")")})
    FROM messages) WHERE length(term) >= 2)"""

IS_TEST = f"{sql_hash('CAST(tweet_id AS VARCHAR)')} < {TEST_BELOW}"


def train_test(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split(df, "tweet_id", 0.2)


def sql(body: str, *ctes: str) -> str:
    return f"WITH {', '.join(ctes)} {body}" if ctes else body
