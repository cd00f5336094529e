"""TF-IDF of the fields over blocks of messages."""

import math
from collections import Counter

from wherewords.operators import features


def _rows(n):
    """(key, field, term): messages of words of their own and of shared ones, keys that come twice, and null ones."""
    rows = []
    for i in range(n):
        key = None if i % 50 == 0 else i // 2 if i % 10 == 0 else i
        rows += [(key, "text", f"own{i}"), (key, "text", "all"), (key, "text", "all"), (key, "text", f"some {i % 7}"), (key, "hashtags", "all")]
        rows += [(key, "user_description", f"wörd {i % 5}")] * (i % 3)
    return rows


def _weights(rows):
    tf = Counter(rows)
    df = Counter((f, t) for _, f, t in tf)
    n = {f: len({k for k, g, _ in tf if g == f and k is not None}) for _, f, _ in tf}
    raw = {(k, f, t): c * (math.log((1 + n[f]) / (1 + df[f, t])) + 1) for (k, f, t), c in tf.items()}
    norm = Counter()
    for (k, f, _), w in raw.items():
        norm[k, f] += w * w
    return {x: w / math.sqrt(norm[x[:2]]) for x, w in raw.items()}


def test_weights_do_not_depend_on_the_blocks(spark, monkeypatch):
    rows = _rows(400)
    grams = spark.createDataFrame(rows, "tweet_id bigint, field string, term string").repartition(3)
    whole = _weights(rows)
    for most in (1 << 20, 40):
        monkeypatch.setattr(features, "_numbered_blocks", lambda key, make=features._numbered_blocks, most=most: make(key, most))
        found = {(r["tweet_id"], r["field"], r["term"]): r["weight"] for r in features.tfidf_fields(grams, "tweet_id").collect()}
        assert found.keys() == whole.keys()
        assert all(abs(found[x] - w) < 1e-9 for x, w in whole.items())
        monkeypatch.undo()


def test_no_messages(spark):
    grams = spark.createDataFrame([], "tweet_id bigint, field string, term string")
    assert features.tfidf_fields(grams, "tweet_id").collect() == []


def test_terms_are_shuffled_compressed_and_once(spark, monkeypatch):
    """What is staged and shuffled after the counts are numbers and compressed lists, no rows of text."""
    paths, seen = [], features.stage

    def watched(df, label):
        paths.append(label)
        return seen(df, label)

    monkeypatch.setattr(features, "stage", watched)
    grams = spark.createDataFrame(_rows(60), "tweet_id bigint, field string, term string")
    plan = features.tfidf_fields(grams, "tweet_id")._jdf.queryExecution().optimizedPlan().toString()
    assert paths == ["field-blocks"]
    assert "Window" not in plan and "term#" not in plan.split("FlatMapCoGroups", 1)[1].split("\n", 1)[1]


def test_words_that_the_reference_keeps_are_kept(spark):
    """Of Spark's English stop words, those that are none of the reference's ``stop_words='english'``."""
    df = spark.createDataFrame([(1, "She does the thing, just did it", None)], "tweet_id bigint, text string, user_description string")
    row = features.field_grams(df).first()
    assert row["text_grams"] == ["does", "thing", "just", "did", "does thing", "thing just", "just did"]
    assert row["user_description_grams"] == row["hashtags_grams"] == []
