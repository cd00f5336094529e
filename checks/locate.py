"""Region joins, place mentions and geolocation."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import (
    IS_TEST, MESSAGES, STOPS, TERMS, TWEETS, messages, sql, sql_idf, sql_tokens, stopwords, table,
    train_test, tweets,
)
from checks.groups import CLUSTERS, given_clusters
from checks.rows import boxes_of_nations
from wherewords.functions import text
from wherewords.operators import regions
from wherewords.operators.joins import keep_frequent
from wherewords.plans.geolocate import geolocate_messages, learn_countries
from wherewords.sources.boxes import COUNTRY_BOXES, bbox_dimension, rekey

QUERIES: dict = {}
SQL: dict = {}


def add(name: str, oracle: str | None):
    def register(query):
        QUERIES[name] = query
        if oracle is not None:
            SQL[name] = oracle
        return query

    return register


BOXES = """boxes AS (SELECT n_name AS country, n_nationkey * 14 - 170 AS lon_min, n_regionkey * 30 - 70 AS lat_min,
  n_nationkey * 14 - 156 AS lon_max, n_regionkey * 30 - 40 AS lat_max FROM nation)"""
WIDE = """wide AS (SELECT r_name AS country, -180 AS lon_min, r_regionkey * 30 - 70 AS lat_min, 180 AS lon_max, r_regionkey * 30 - 40 AS lat_max FROM region)"""
INSIDE = "t.lon BETWEEN b.lon_min AND b.lon_max AND t.lat BETWEEN b.lat_min AND b.lat_max"
IN_BOX = f"SELECT tweet_id, b.country FROM tweets t JOIN boxes b ON {INSIDE}"


def points(spark, folder):
    return tweets(spark, folder).select("tweet_id", "lon", "lat")



def in_leaves(spark, folder):
    """Crowded cells cut by a quadtree over the points."""
    located = points(spark, folder)
    leaves = regions.crowded_leaves(located, 200)
    return regions.tag_region(located, boxes_of_nations(spark, folder), leaves=leaves)



add("bbox_join", sql(IN_BOX, TWEETS, BOXES))(
    lambda spark, folder: regions.tag_region(points(spark, folder), boxes_of_nations(spark, folder)).select("tweet_id", "country"))
add("bbox_grid_join", sql(IN_BOX, TWEETS, BOXES))(
    lambda spark, folder: regions.tag_region(points(spark, folder), boxes_of_nations(spark, folder), cell_deg=7.0).select("tweet_id", "country"))
add("bbox_crowded_join", sql(IN_BOX, TWEETS, BOXES))(
    lambda spark, folder: in_leaves(spark, folder).select("tweet_id", "country"))


@add("bbox_smallest", sql(f"SELECT tweet_id, country FROM (SELECT tweet_id, b.country, row_number() OVER (PARTITION BY tweet_id ORDER BY (lon_max - lon_min) * (lat_max - lat_min), b.country) AS r FROM tweets t JOIN (SELECT * FROM boxes UNION ALL SELECT * FROM wide) b ON {INSIDE}) WHERE r = 1", TWEETS, BOXES, WIDE))
def bbox_smallest(spark, folder):
    r = F.col("r_regionkey")
    wide = table(spark, folder, "region").select(
        F.col("r_name").alias("country"), F.lit(-180.0).alias("lon_min"), (r * 30 - 70).cast("double").alias("lat_min"),
        F.lit(180.0).alias("lon_max"), (r * 30 - 40).cast("double").alias("lat_max"))
    both = boxes_of_nations(spark, folder).unionAll(wide)
    return regions.tag_region(points(spark, folder), both, multi="smallest").select("tweet_id", "country")


VALUES = ", ".join(
    "('{}', {})".format(name, ", ".join(edges))
    for _, name, *edges in (line.split(",") for line in COUNTRY_BOXES.strip().splitlines())
)
REAL = f"real_boxes(country, lon_min, lat_min, lon_max, lat_max) AS (VALUES {VALUES})"


@add("country_tag", sql(f"SELECT tweet_id, b.country FROM tweets t JOIN real_boxes b ON {INSIDE}", TWEETS, REAL))
def country_tag(spark, folder):
    """Messages inside the boxes of real countries, overlaps and all."""
    return regions.tag_region(points(spark, folder), bbox_dimension(spark)).select("tweet_id", "country")


@add("country_tag_width", sql(f"SELECT b.country, count(*) AS n, max(b.lon_max - b.lon_min) AS width FROM tweets t JOIN real_boxes b ON {INSIDE} GROUP BY 1", TWEETS, REAL.replace("VALUES (", "VALUES (").replace("AS (VALUES", "AS (SELECT col0, CAST(col1 AS DOUBLE), CAST(col2 AS DOUBLE), CAST(col3 AS DOUBLE), CAST(col4 AS DOUBLE) FROM (VALUES") + ")"))
def country_tag_width(spark, folder):
    """Messages per country with the width of its box, from the re-keyed dimension."""
    by_name = rekey(bbox_dimension(spark), "country", "lon_min", "lat_min", "lon_max", "lat_max")
    counts = country_tag(spark, folder).groupBy("country").agg(F.count("*").alias("n"))
    width = F.get("box", F.lit(2)) - F.get("box", F.lit(0))
    return counts.join(by_name, "country").select("country", "n", width.alias("width"))


PLACES = f"""gazetteer AS (SELECT DISTINCT lower(place) AS place FROM (
    SELECT event_type AS place FROM events UNION ALL SELECT source FROM documents UNION ALL SELECT 'the ' || event_type FROM events)),
  gram_words AS (SELECT tweet_id, list_transform({sql_tokens('clean_text')}, lambda t: lower(t)) AS w FROM messages),
  grams AS (SELECT tweet_id, unnest(w) AS place FROM gram_words
    UNION ALL SELECT tweet_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM gram_words
    UNION ALL SELECT tweet_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM gram_words)"""


@add("place_mentions", sql("SELECT tweet_id, string_agg(place, '|' ORDER BY place) AS places FROM (SELECT DISTINCT tweet_id, place FROM grams JOIN gazetteer USING (place)) GROUP BY 1", TWEETS, MESSAGES, PLACES))
def place_mentions(spark, folder):
    """Names of one to three words out of a gazetteer of tags and their phrases."""
    kinds = table(spark, folder, "events").select(F.col("event_type").alias("place")).distinct()
    names = kinds.unionAll(table(spark, folder, "documents").select("source").distinct())
    names = names.unionAll(kinds.select(F.concat(F.lit("the "), "place")))
    gazetteer = names.select(F.lower("place").alias("place"))
    words = text.lower_tokens(text.clean_words(F.col("text")))
    found = regions.extract_places(tweets(spark, folder), gazetteer, "tweet_id", words)
    return regions.place_list(found, "tweet_id").select("tweet_id", F.array_join("places", "|").alias("places"))


# --- geolocation -------------------------------------------------------------

FREQUENT = "frequent AS (SELECT place_country FROM tweets GROUP BY 1 HAVING count(*) > 10)"
CORE = (
    TWEETS, MESSAGES, STOPS, TERMS, FREQUENT,
    f"train_tf AS (SELECT place_country AS doc_key, term, count(*) AS tf FROM terms WHERE place_country IN (FROM frequent) AND NOT ({IS_TEST}) GROUP BY 1, 2)",
    f"test_tf AS (SELECT tweet_id, term, count(*) AS tf FROM terms WHERE place_country IN (FROM frequent) AND {IS_TEST} GROUP BY 1, 2)",
    f"places AS (SELECT place_country AS doc_key, avg(lat) AS lat, avg(lon) AS lon FROM tweets WHERE place_country IN (FROM frequent) AND NOT ({IS_TEST}) GROUP BY 1)",
    f"test AS (SELECT tweet_id, n_regionkey FROM tweets WHERE place_country IN (FROM frequent) AND {IS_TEST})",
)
# For tests with one cluster for all, and with the nations' regions as clusters.
ALL = (*CORE, "docs AS (SELECT doc_key, 0 AS cluster, lat, lon FROM places)", "pred AS (SELECT tweet_id, 0 AS cluster FROM test)")
BY_REGION = (
    *CORE, CLUSTERS, "docs AS (SELECT doc_key, cluster, lat, lon FROM places JOIN clustered USING (doc_key))",
    "pred AS (SELECT tweet_id, (n_regionkey + CASE WHEN tweet_id % 4 = 0 THEN 1 ELSE 0 END) % 5 AS cluster FROM test)",
)
GLOBAL = (
    f"df AS (SELECT term, {sql_idf('(SELECT count(*) FROM docs)', 'count(*)')} AS idf FROM train_tf JOIN docs USING (doc_key) GROUP BY 1)",
    "q AS (SELECT tweet_id, term, tf * idf AS w FROM test_tf JOIN df USING (term))",
    "c AS (SELECT doc_key, term, tf * idf AS w FROM train_tf JOIN df USING (term))",
    "qn AS (SELECT tweet_id, sqrt(sum(w * w)) AS n FROM q GROUP BY 1)",
    "cn AS (SELECT doc_key, sqrt(sum(w * w)) AS n FROM c GROUP BY 1)",
    "dots AS (SELECT tweet_id, doc_key, sum(q.w * c.w) AS dot FROM q JOIN c USING (term) GROUP BY 1, 2)",
    "scored AS (SELECT p.tweet_id, p.cluster, d.doc_key, d.lat, d.lon, coalesce(round(dot / qn.n / cn.n, 6), 0) AS score FROM pred p JOIN docs d USING (cluster) LEFT JOIN dots x ON x.tweet_id = p.tweet_id AND x.doc_key = d.doc_key LEFT JOIN qn ON qn.tweet_id = p.tweet_id LEFT JOIN cn ON cn.doc_key = d.doc_key)",
)
# TF-IDF fitted anew for each message on its candidates and itself.
REFIT = (
    "m AS (SELECT cluster, count(*) AS size FROM docs GROUP BY 1)",
    "pairs AS (SELECT p.tweet_id, p.cluster, d.doc_key, d.lat, d.lon FROM pred p JOIN docs d USING (cluster))",
    "corpus AS (SELECT tweet_id, doc_key, term, tf FROM pairs JOIN train_tf USING (doc_key) UNION ALL SELECT tweet_id, NULL, term, tf FROM test_tf)",
    "fit AS (SELECT tweet_id, term, count(*) AS df FROM corpus GROUP BY 1, 2)",
    f"w AS (SELECT c.tweet_id, c.doc_key, c.term, c.tf * {sql_idf('(m.size + 1)', 'f.df')} AS w FROM corpus c JOIN fit f USING (tweet_id, term) JOIN pred p USING (tweet_id) JOIN m USING (cluster))",
    "n AS (SELECT tweet_id, doc_key, sqrt(sum(w * w)) AS n FROM w GROUP BY 1, 2)",
    "dots AS (SELECT a.tweet_id, b.doc_key, sum(a.w * b.w) AS dot FROM w a JOIN w b USING (tweet_id, term) WHERE a.doc_key IS NULL AND b.doc_key IS NOT NULL GROUP BY 1, 2)",
    "scored AS (SELECT p.*, coalesce(round(dot / qn.n / cn.n, 6), 0) AS score FROM pairs p LEFT JOIN dots x ON x.tweet_id = p.tweet_id AND x.doc_key = p.doc_key LEFT JOIN n qn ON qn.tweet_id = p.tweet_id AND qn.doc_key IS NULL LEFT JOIN n cn ON cn.tweet_id = p.tweet_id AND cn.doc_key = p.doc_key)",
)
BEST = "SELECT tweet_id, cluster, doc_key AS country, round(lat, 6) AS lat, round(lon, 6) AS lon, score FROM (SELECT *, row_number() OVER (PARTITION BY tweet_id ORDER BY score DESC, doc_key) AS r FROM scored) WHERE r = 1"


def located(spark, folder, by_region: bool, idf_scope: str):
    stops = stopwords(spark, folder)
    train, test = train_test(keep_frequent(messages(spark, folder), "place_country", 10))
    model = learn_countries(train, stops)
    clusters = pred = None
    if by_region:
        clusters = given_clusters(spark, folder)
        shift = F.when(F.col("tweet_id") % 4 == 0, 1).otherwise(0)
        pred = test.select("tweet_id", ((F.col("n_regionkey") + shift) % 5).alias("cluster"))
    found = geolocate_messages(test, model, stops, clusters, pred, idf_scope)
    return found.withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)})


add("geolocate_holdout", sql(BEST, *ALL, *GLOBAL))(lambda spark, folder: located(spark, folder, False, "global"))
add("geolocate", sql(BEST, *BY_REGION, *GLOBAL))(lambda spark, folder: located(spark, folder, True, "global"))
add("geolocate_refit", sql(BEST, *BY_REGION, *REFIT))(lambda spark, folder: located(spark, folder, True, "cluster"))
