"""Streams over the events table, each equal to its batch query."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import TWEETS, sql, table, tweets
from checks.locate import BOXES, INSIDE
from checks.rows import boxes_of_nations
from wherewords.session import staged_path
from wherewords.streaming import capture

QUERIES: dict = {}
SQL: dict = {}


def add(name: str, oracle: str | None):
    def register(query):
        QUERIES[name] = query
        if oracle is not None:
            SQL[name] = oracle
        return query

    return register


def message_files(spark, folder):
    """The message points as JSON files, one message per line."""
    path = staged_path(spark, "messages")
    points = tweets(spark, folder).select("tweet_id", "created_at", "place_country", "lon", "lat")
    points.repartition(4, "tweet_id").write.json(path)
    return path


SCHEMA = "tweet_id bigint, created_at timestamp, place_country string, lon double, lat double"


def event_stream(spark, folder):
    """The events as files that arrive one per batch."""
    events, path = table(spark, folder, "events"), staged_path(spark, "events")
    events.repartition(3, "event_id").write.parquet(path)
    return capture.read_tweet_stream(spark, path, events.schema, fmt="parquet", max_files=1)


@add("stream_region", sql(f"SELECT tweet_id, b.country FROM tweets t JOIN boxes b ON {INSIDE}", TWEETS, BOXES))
def stream_region(spark, folder):
    stream = capture.read_tweet_stream(spark, message_files(spark, folder), SCHEMA, max_files=1)
    tagged = capture.tag_region(stream, boxes_of_nations(spark, folder)).select("tweet_id", "country")
    out = staged_path(spark, "tagged")
    capture.run_available(capture.write_capture_stream(tagged, out, staged_path(spark, "checkpoint")))
    return spark.read.schema("tweet_id bigint, country string").json(out)


@add("stream_cap", "SELECT event_type, least(count(*), 1500) AS n FROM events GROUP BY 1")
def stream_cap(spark, folder):
    out = staged_path(spark, "capped")
    capture.run_available(capture.write_capped_stream(event_stream(spark, folder), "event_type", 1500, out, staged_path(spark, "checkpoint")))
    return spark.read.json(out).groupBy("event_type").agg(F.count_distinct("event_id").alias("n"))


@add("stream_count", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_count(spark, folder):
    counts = capture.running_count(event_stream(spark, folder), "event_type")
    out = staged_path(spark, "counts")

    def keep_latest(batch, batch_id):
        batch.write.mode("overwrite").parquet(out)

    capture.run_available(counts.writeStream.outputMode("complete").foreachBatch(keep_latest).option("checkpointLocation", staged_path(spark, "checkpoint")))
    return spark.read.parquet(out)


@add("stream_capture", sql(f"SELECT country, least(count(*), 25) AS n FROM (SELECT b.country FROM tweets t JOIN boxes b ON {INSIDE}) GROUP BY 1", TWEETS, BOXES))
def stream_capture(spark, folder):
    """Every country at once: tag, cap at 25, a folder per country."""
    stream = capture.read_tweet_stream(spark, message_files(spark, folder), SCHEMA, max_files=2)
    out = staged_path(spark, "captured")
    capture.run_available(capture.capture_regions(stream, boxes_of_nations(spark, folder), out, staged_path(spark, "checkpoint"), cap=25))
    return spark.read.json(out).groupBy("country").agg(F.count("*").alias("n"))


@add("stream_bad_rows", "SELECT event_type, count(*) FILTER (event_id % 10 <> 0) AS n_good, count(*) FILTER (event_id % 10 = 0) AS n_bad FROM events GROUP BY 1")
def stream_bad_rows(spark, folder):
    """Every tenth line is cut short; good and bad lines are all found again."""
    line = F.to_json(F.struct("event_id", "event_type", "value"))
    cut = F.concat(F.lit('{"event_id": "'), F.col("event_type"))
    events = table(spark, folder, "events")
    path = staged_path(spark, "lines")
    events.select(F.when(F.col("event_id") % 10 == 0, cut).otherwise(line).alias("value")).write.text(path)
    stream = capture.read_tweet_stream(spark, path, "event_id bigint, event_type string, value double", keep_bad_rows=True)
    good, side = staged_path(spark, "good"), staged_path(spark, "bad")
    capture.run_available(capture.route_bad_rows(stream, good, side, staged_path(spark, "checkpoint")))
    kept = spark.read.json(good).select("event_type", F.lit(1).alias("good"))
    bad = spark.read.json(side).select(F.regexp_extract("line", '"([a-z]+)$', 1).alias("event_type"), F.lit(0).alias("good"))
    return kept.unionAll(bad).groupBy("event_type").agg(
        F.count_if(F.col("good") == 1).alias("n_good"), F.count_if(F.col("good") == 0).alias("n_bad"))
